"""Phrases, periodic runs and recurring passages against brute force."""

import random
import re
from collections import Counter

import pytest

from citylens.llm import passages, periods, phrases, words

SCHEMA = "doc_id long, text string, lang string, rank string, key string, phrase string, starts string, words string"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang) with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def white(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- phrases


def folded(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def phrases_by_force(rows, least, longest, top):
    counts, sizes = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    cand = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    hidden = set()
    for (lang, w), n in cand.items():
        for m in range(2, len(w)):
            hidden.update((lang, w[i:i + m]) for i in range(len(w) - m + 1) if cand[lang, w[i:i + m]] <= n)
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in hidden:
            cuts = [(1000 * a * sizes[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def phrase_rows(seed):
    draw = random.Random(seed)
    vocabulary = ["a", "b", "C", "é", "ß", "Ab", "d1", "the", "of"]
    rows = [(i, " ".join(draw.choices(vocabulary, [9, 7, 5, 3, 2, 2, 1, 9, 9], k=draw.randint(0, 40))) + draw.choice(["", ".", ", x", "\nthe of the"]), draw.choice(["en", "fr", None])) for i in range(120)]
    rows += [(500, None, "en"), (501, "", "de"), (502, " .,; ", "de"), (None, "one two three four five six " * 30, "long"), (503, "tied pair. pair tied. " * 40, "tie")]
    return rows + rows[:5]


@pytest.mark.parametrize("least, longest, top, hot", [(4, 5, 2000, 4096), (3, 5, 7, 8), (10, 3, 40, 4096), (1, 4, 100000, 64)])
def test_phrases_match_brute_force(spark, monkeypatch, least, longest, top, hot):
    monkeypatch.setattr(phrases, "HOT_SHARE", hot)
    rows = phrase_rows(least)
    found = phrases.mine_phrases(docs_of(spark, rows).repartition(5), least, longest, top)
    assert sorted(map(tuple, found.collect())) == phrases_by_force(rows, least, longest, top)


def test_phrases_with_false_positives_of_a_tiny_bitmap(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITMAP_BITS", 3)
    rows = phrase_rows(9)
    assert sorted(map(tuple, phrases.mine_phrases(docs_of(spark, rows), 5, 5, 50).collect())) == phrases_by_force(rows, 5, 5, 50)


def test_phrases_of_a_very_long_text(spark):
    rows = [(1, " ".join(["alpha beta gamma delta"] * 100_000), "en")]
    found = sorted(map(tuple, phrases.mine_phrases(docs_of(spark, rows)).collect()))
    assert found == phrases_by_force(rows, 100, 5, 2000) and found[0][6] == 400_000


def test_phrases_exact_beyond_64_bits(spark):
    sizes = spark.createDataFrame([("en", 4 * 10**12)], "lang string, n long")
    found = spark.createDataFrame([("en", "x y", 3 * 10**11 + 1, True)], "lang string, phrase string, a long, kept boolean")
    units = spark.createDataFrame([("en", "x", 5 * 10**11 + 3), ("en", "y", 9 * 10**11 + 7)], "lang string, phrase string, a long")
    row = phrases._scored(found, units, sizes).first()
    assert row.score == 1000 * (3 * 10**11 + 1) * 4 * 10**12 // ((5 * 10**11 + 3) * (9 * 10**11 + 7))


@pytest.mark.parametrize("packs", [1, 3, 1000])
def test_stripes_in_any_number_of_packs(spark, monkeypatch, packs):
    monkeypatch.setattr(phrases, "PACKS", packs)
    monkeypatch.setattr(phrases, "chunks", lambda batches, column="text", limit=0: words.chunks(batches, column, 200))
    rows = phrase_rows(2)
    assert sorted(map(tuple, phrases.mine_phrases(docs_of(spark, rows).repartition(3), 4, 5, 99).collect())) == phrases_by_force(rows, 4, 5, 99)


# --- periodic runs


def runs_by_force(w, least, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed_by_force(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run_texts():
    draw = random.Random(3)
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a " * 25 + "b", "x y " * 30, "A a " * 20]
    for _ in range(250):
        w = []
        for _ in range(draw.randint(1, 6)):
            unit = [draw.choice("abcde") + draw.choice(["", "1"]) for _ in range(draw.choice([1, 2, 3, 5, 9, 20]))]
            whole = unit * draw.choice([1, 2, 3, 5, 9])
            w += whole[:draw.randint(1, len(whole))] if draw.random() < 0.5 else whole
            w += [str(draw.randint(0, 99)) for _ in range(draw.choice([0, 0, 1, 7]))]
        texts.append(" ".join(w))
    # Fibonacci words hold many runs; two letters give overlapping ones.
    one, two = "a", "a b"
    for _ in range(9):
        one, two = two, f"{two} {one}"
    return [*texts, two, *(" ".join(draw.choice("ab") for _ in range(n)) for n in (30, 100, 400))]


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (9, 3), (40, 5)])
def test_runs_match_brute_force(spark, least, times):
    texts = run_texts()
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(7, texts[40], "en"), (7, texts[40], "en"), (None, texts[41], None)]
    found = periods.periodic_runs(docs_of(spark, rows), least, times).collect()
    assert len(found) == len(rows)
    want = Counter()
    for doc_id, text, _ in rows:
        w = white(text)
        made = runs_by_force(w, least, times)
        want[doc_id, tuple(made), collapsed_by_force(w, made)] += 1
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in found) == want


def test_runs_without_cutting_the_text_first():
    draw = random.Random(8)
    for _ in range(300):
        w = [draw.randint(0, 2) for _ in range(draw.randint(1, 60))]
        assert [tuple(r) for r in periods.runs(w, 2, 2).tolist()] == runs_by_force(w, 2, 2)


def test_suffix_tree_has_all_suffixes_in_order():
    draw = random.Random(5)
    for _ in range(200):
        w = [draw.randint(0, 3) for _ in range(draw.randint(0, 40))]
        ended = [*w, -1]
        leaves, shared = periods.SuffixTree(w).tour()
        assert leaves.tolist() == sorted(range(len(ended)), key=lambda i: ended[i:])
        for k in range(1, len(leaves)):
            a, b = ended[leaves[k - 1]:], ended[leaves[k]:]
            assert shared[k] == next(i for i in range(len(a)) if a[i] != b[i])
        falling = periods.SuffixTree(w).tour(falling=True)[0]
        assert falling.tolist() == sorted(range(len(ended)), key=lambda i: [(-c if c >= 0 else -99) for c in ended[i:]])


def test_runs_of_a_very_long_text(spark):
    draw = random.Random(1)
    w = [f"w{i}" for i in range(50_000)] + [str(draw.randint(0, 999)) for _ in range(7000)] * 3 + ["end"]
    found = periods.periodic_runs(docs_of(spark, [(1, " ".join(w), "en")])).first()
    assert [tuple(r) for r in found.runs] == [(50_000, 21_000, 7000)]
    assert found.collapsed == " ".join(w[:57_000] + ["end"])


# --- recurring passages


def passages_by_force(rows, window):
    low = {}
    rank = lambda i: float("-inf") if i is None else i
    for doc_id, text, _ in rows:
        w = white(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            low[key] = min(low.get(key, float("inf")), rank(doc_id))
    out = Counter()
    for doc_id, text, _ in rows:
        w = white(text)
        gone = {j for i in range(len(w) - window + 1) if low[tuple(w[i:i + window])] < rank(doc_id) for j in range(i, i + window)}
        spans, i = [], 0
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out[doc_id, len(w), tuple(map(tuple, spans)), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def passage_rows():
    draw = random.Random(11)
    shared = [" ".join(draw.choice("abcdefgh") + str(draw.randint(0, 9)) for _ in range(n)) for n in (13, 14, 20, 60, 12)]
    rows = []
    for i in range(150):
        parts = [" ".join(draw.choice("xyz") + str(draw.randint(0, 500)) for _ in range(draw.randint(0, 25))) for _ in range(draw.randint(1, 3))]
        for _ in range(draw.choice([0, 1, 1, 2])):
            parts.insert(draw.randint(0, len(parts)), draw.choice(shared))
        rows.append((draw.choice([i, i, i + 1000]), "\n".join(parts), "en"))
    rows += [(i, shared[3] + " tail" + str(i % 3), "en") for i in range(2000, 2040)]
    rows += [(3000, None, None), (3001, "", "en"), (3002, " \t ", "en"), (3003, "la " * 40, "en"), (3004, "la " * 30 + "lo", "en"), (None, shared[2] + " " + shared[0], "en"), (None, shared[2], "en")]
    return rows + [rows[3], rows[3], (rows[3][0], rows[4][1], "en"), (rows[3][0], shared[3], "en")]


@pytest.mark.parametrize("window, bits, often, shard", [(13, 27, 50_000, 20_000), (13, 8, 50_000, 1), (13, 27, 3, 20), (4, 27, 10, 100), (2, 12, 2, 5)])
def test_passages_match_brute_force(spark, monkeypatch, window, bits, often, shard):
    for name, value in (("BITMAP_BITS", bits), ("FREQUENT_MARK", often), ("SHARD_WINDOWS", shard)):
        monkeypatch.setattr(passages, name, value)
    rows = passage_rows()
    found = passages.drop_passages(docs_of(spark, rows).repartition(6), window).collect()
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.removed)), r.kept) for r in found) == passages_by_force(rows, window)


def test_passages_of_a_very_long_text(spark):
    draw = random.Random(2)
    w = [str(draw.randint(0, 10**6)) for _ in range(200_000)]
    rows = [(1, " ".join(w[100_000:100_500]), "en"), (2, " ".join(w), "en"), (3, "x " + " ".join(w[5:]), "en")]
    found = {r.doc_id: r for r in passages.drop_passages(docs_of(spark, rows)).collect()}
    assert [tuple(s) for s in found[2].removed] == [(100_000, 100_500)] and found[1].removed == []
    assert found[3].kept == "x" and found[3].n_words == 199_996


class Captured:
    """Stands for a table; ``mapInArrow`` returns the work of its tasks."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        return work


def test_passages_tasks_hold_little_beside_a_batch(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    draw = random.Random(5)
    names = ["w" + str(i) for i in range(5000)]
    texts = [" ".join(draw.choices(names, k=500)) for _ in range(3500)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text_key": list(range(len(texts))), "text": texts})

    class Every:
        contains = staticmethod(lambda marks: np.ones(len(marks), bool))

    class No:
        contains = staticmethod(lambda marks: np.zeros(len(marks), bool))

    for name, work in {
        "marks": passages._window_marks(Captured(spark), 13),
        "segments": passages._keyed_segments(Captured(spark), 13, Every, No),
        "occurrences": passages._occurrences(Captured(spark), 13, Every, No),
    }.items():
        tracemalloc.start()
        at_arrow = pa.total_allocated_bytes()
        arrow, rows = 0, 0
        for out in work(iter([batch])):
            rows, arrow = rows + out.num_rows, max(arrow, pa.total_allocated_bytes() - at_arrow)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # 10 MB of text: taken apart at once, its words took over 200 MB.
        assert rows > 100_000 and peak < 120 << 20, (name, peak >> 20)
        assert arrow < 100 << 20, (name, arrow >> 20)


# --- all of them


@pytest.mark.parametrize("work", [phrases.mine_phrases, periods.periodic_runs, passages.drop_passages])
def test_empty_tables(spark, work):
    empty = docs_of(spark, []).limit(0)
    assert work(empty).count() == 0
    assert work(docs_of(spark, [(1, None, None), (2, "", "en")])).count() == (0 if work is phrases.mine_phrases else 2)


def test_words_of_sliced_columns(spark):
    import pyarrow as pa

    texts = pa.array(["a b, c", None, "", "X  x.y", "tail", " lead é\tü\n"])
    for begin in range(6):
        for end in range(begin, 7):
            part = texts.slice(begin, end - begin)
            read = words.read_words(part, words.separators(b" \t", b".,;:!?\n\r\v\f"), fold=True)
            names = [x.decode() for x in read.names.to_pylist()]
            lists = [re.findall(r"[^ \t.,\n]+", folded(t)) for t in part.to_pylist()]
            assert [names[c] for c in read.codes] == [x for one in lists for x in one] and read.counts.tolist() == [len(one) for one in lists]
