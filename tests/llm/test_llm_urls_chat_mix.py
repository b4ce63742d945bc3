"""URL filters, chat formatting and mixing: brute force, round trips and edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from citylens.llm import chat, mixing, urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/f", "block"), ("b.c", "", "block")]
URLS = [
    None, "", "no scheme", "http://", "https://X.Example.NET/en/1?x#y", "http://example.net/EN/", "http://net/", "http://notnet", "http://net", "ftp://a.b.example.com/de/x/y",
    "http://example.com/de", "http://a.org/fr/1", "http://x.a.org/f", "http://b.c", "http://z.b.c/anything", "http://é.net/ü#", "x://y://net/", "http://a.net?q=/en/", "http://.net/", "HTTP://ÄA.ORG/fr/\nx",
    "http://" + "a." * 2000 + "net/" + "p/" * 3000,
]


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_urls_match_brute_force(spark, rows):
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), RULES[0]], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i // 2, u, "x", "y") for i, u in enumerate(URLS + URLS)] + [(None, URLS[4], "x", "y")] * 3, "page_id long, url string, host string, digest string")
    found = [tuple(r) for r in urls.judge_urls(pages, rules, "page_id").collect()]
    wanted = [(r[0], r[1], *judged(r[1])) for r in pages.collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_urls_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert [r.verdict for r in urls.judge_urls(pages, rules.limit(0), "page_id").collect()] == ["allow"]
    assert urls.judge_urls(pages.limit(0), rules, "page_id").count() == 0


NASTY = [
    None, "", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<", "</", "[INST", "a</s>", "<\\/s>", "[/INST][/INST]", "\n\t", "é\U0001f600</s>\\", "[[INST]]", "x" * 70000 + "</s>",
    "\\</s>", "[INST]\\", "$1 \\1",
]


def test_chat_round_trip(spark):
    draw = random.Random(1)
    turns = [(c, t, draw.choice(["user", "assistant", "system", None, "[INST]", "tool\\"]), draw.choice(NASTY)) for c in range(30) for t in range(draw.randint(1, 8))]
    turns += [(None, None, None, None), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (50, None, "assistant", "first")]
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id long, turn long, role string, text string, rows string, formatted int")
    done = chat.format_chats(df).collect()
    assert len(done) == len({t[0] for t in turns}) and all(r.round_trip for r in done)
    for r in done:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(o[2], o[3]) for o in own]
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
        at, learned = 0, []
        for m in r["mask"]:
            if m.learned:
                learned.append(re.sub(r"(?s)\\(.)", r"\1", r.formatted[at:at + m.chars]))
            at += m.chars
        assert learned == [o[3] for o in own if o[2] == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_leaves_plain_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi [x] <y>")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first().formatted == "[INST]user[/INST]hi [x] <y></s>"


def fill(sizes, weights, share, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(epochs * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] >= epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_targets_match_water_filling(spark):
    draw = random.Random(2)
    sizes = {f"s{i}": draw.choice([0, 1, 5, 100, 1000]) for i in range(40)} | {None: 7, "": 3, "é": 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in mixing.fill_targets(df, [5, 2, 1], 1.5, 2.0).collect()}
    wanted = fill(sizes, [5, 2, 1], 1.5, 2.0)
    assert found.keys() == wanted.keys()
    assert all(found[s] == pytest.approx(wanted[s]) for s in wanted)
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))


@pytest.fixture
def corpus(spark):
    draw = random.Random(3)
    data = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 60))), draw.choice(["x", "y", "z", None]), 0) for i in range(300)]
    data += [(300, None, "x", None), (301, "\u00a0 one\u2003word", "y", 1), (None, "no id", None, 1), (302, "same row", "z", 1), (302, "same row", "z", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, target long")


def test_mix_meets_targets_and_bounds(spark, corpus):
    found = mixing.mix(corpus).toPandas()
    assert len(found) == corpus.count() and (found["taken"] <= 2 * found["size"]).all()
    per = found.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per["source_size"]).all() and ((per["taken"] - per["target"]).abs() <= 2).all()
    again = mixing.mix(corpus.repartition(7)).toPandas()
    order = lambda d: d.sort_values(["doc_id", "size", "taken"]).reset_index(drop=True)
    assert order(again).equals(order(found))
    assert found.loc[found["doc_id"] == 301, "size"].item() == 2


def test_mixed_documents_hold_the_planned_words(spark, corpus):
    plan = mixing.mix(corpus)
    out = mixing.mixed_documents(corpus)
    assert out.columns == [*corpus.columns, "mix_copy"]
    words = out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).filter("n > 0")
    wanted = plan.groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0")
    assert sorted(map(tuple, words.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
    assert mixing.mixed_documents(corpus.limit(0)).count() == 0 and mixing.mix(corpus.limit(0)).count() == 0


