"""The pipeline on a small corpus with planted cases, stage by stage."""

import random

import pytest

import corpus_pipeline
from citylens.llm import exact, mixing, quality, simhash
from citylens.llm.queries import LLM_ORACLES, LLM_QUERIES

from test_llm_dedup import fingerprint

SLURS = ["slurone", "slurtwo", "slurthree"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(4000)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    items = {i: text(40) for i in range(10)}
    docs, labels, kinds = [], [], {}

    def add(kind, body):
        number = len(docs)
        kinds.setdefault(kind, []).append(number)
        docs.append((number, body, "en", f"src{number % 5}", len(body or "")))
        labels.append((number, int(kind != "junk"), int(kind == "toxic")))
        return number

    for i in range(300):
        body = text(draw.randint(30, 200))
        if i % 10 == 1:
            add("toxic", " ".join([*body, draw.choice(SLURS), *body[:5]]))
        elif i % 10 == 2:
            add("junk", " ".join(w.upper() + "!!" for w in body))
        elif i % 10 == 3:
            add("leak", " ".join([*body[:20], *items[i % len(items)], *body[20:]]))
        elif i % 10 == 4:
            add("first", " ".join(body))
            add("copy", " ".join(body).capitalize())
        elif i % 10 == 5:
            body = text(150)
            add("original", " ".join(body))
            body[75] = "changed"
            add("near", " ".join(body))
        else:
            add("clean", " ".join(body))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kinds


def test_each_stage_does_its_work(spark, corpus):
    folder, kinds = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.collect()}
    gone, inputs = {}, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        inputs[name] = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.stage(step(spark, docs, folder), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        gone[name], left = left - now, now
    bad = set(kinds["toxic"]) | set(kinds["junk"])
    assert len(gone["quality"] & bad) >= 0.97 * len(bad) and len(gone["quality"] - bad) <= 3
    assert gone["exact_dedup"] == set(kinds["first"]) - gone["quality"]
    # Near copies are those whose fingerprints of three-word shingles are linked at two bits, by brute force.
    prints = {i: fingerprint(t) for i, t in inputs["near_dedup"].items()}
    first = {i: i for i in prints}
    for _ in prints:
        moved = {i: min(first[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if moved == first:
            break
        first = moved
    assert gone["near_dedup"] == {i for i in prints if first[i] != i} and gone["near_dedup"] & set(kinds["near"])
    assert gone["decontaminate"] == set(kinds["leak"]) - gone["quality"]
    plan = mixing.mix(docs).toPandas()
    out = corpus_pipeline.mix(spark, docs, folder)
    assert out.columns == [*columns, "mix_copy"]
    assert sum(len(r.text.split()) for r in out.collect()) == plan["taken"].sum()


def test_batches_of_texts_are_bounded_in_bytes(spark, corpus):
    from citylens.session import BATCH_BYTES, bound_batches

    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = spark.createDataFrame([(i, "x" * 100_000) for i in range(100)], "doc_id long, text string").coalesce(1)
    sizes = lambda: [r.size for r in long.mapInArrow(lambda batches: (b.from_pydict({"size": [b.nbytes]}) for b in batches), "size long").collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        spark.conf.unset(BATCH_BYTES)
        step(spark, docs, folder)
        assert max(sizes()) <= 2_200_000 and sum(sizes()) >= 10_000_000, name
    # The deployment's own bound stays; a whole run leaves the session as it was.
    spark.conf.set(BATCH_BYTES, "500000")
    bound_batches(spark)
    assert spark.conf.get(BATCH_BYTES) == "500000"
    spark.conf.unset(BATCH_BYTES)
    corpus_pipeline.run(spark, folder)
    assert spark.conf.get(BATCH_BYTES, None) is None


def test_whole_run_and_queries_are_registered(spark, corpus):
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    assert entry.queries().keys() >= LLM_QUERIES.keys() | {"pipeline"} and entry.oracle_sql().keys() >= LLM_ORACLES.keys()
    assert entry.queries()["pipeline"](spark, corpus[0]).count() > 0


NAMES = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, host string, text_key string, mix_copy string, digest string, in_0 string"


def odd_rows():
    long = "very long text " * 60_000
    rows = [(None, None, None, None, None), (None, "one two three", "en", None, 3), (1, "", "en", "a", 0), (1, long, "en", "a", len(long)), (1, long, "en", "a", len(long))]
    rows += [(2, "tied", "en", "b", 4), (2, "tied", "en", "b", 4), (2, "other words here", "en", "b", 5), (3, " \t ", None, "b", 3), (4, "tied", "fr", "a", 4), (5, long + "end", "en", "c", 1)]
    return [(*r, "f", "h", "k", "m", "d", "i") for r in rows]


def test_stages_take_nulls_repeated_rows_long_texts_and_clashing_names(spark, corpus):
    docs = spark.createDataFrame(odd_rows(), NAMES)
    for name, step in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.stage(step(spark, docs, corpus[0]), name)
        if name != "mix":
            assert docs.columns == [c.split()[0] for c in NAMES.split(", ")] and 0 < docs.count() <= before
        if name == "exact_dedup":
            texts = [(r.text or "").lower() for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert docs.columns[-1] == "mix_copy_"


def test_stages_take_an_empty_table(spark, corpus):
    docs = spark.createDataFrame([], NAMES)
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, corpus[0]), name)
        assert docs.count() == 0


def test_one_row_of_a_near_group_stays(spark):
    docs = spark.createDataFrame(odd_rows(), NAMES)
    kept = simhash.drop_near_copies(docs)
    groups = {}
    for r in docs.collect():
        groups.setdefault(fingerprint(r.text), []).append(r)
    assert kept.columns == docs.columns
    # Here linked fingerprints are equal ones, or stand next to each other in the list of long texts.
    found = [(fingerprint(r.text), r.doc_id) for r in kept.collect()]
    assert len({f for f, _ in found}) == len(found)
    for print_, doc_id in found:
        ids = [r.doc_id for f, rows in groups.items() if (f ^ print_).bit_count() <= 2 for r in rows if r.doc_id is not None]
        assert doc_id == (min(ids) if ids else None)


def test_texts_of_documents_that_stay_are_not_joined(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus[0]}/{name}.parquet") for name in ("documents", "labels"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan(quality.keep_good(docs, labels))
    # Rows that no bitmap knows come by a branch without a join.
    left = plan(exact.drop_copies(docs)).splitlines()
    assert left[0].startswith("Union") and sum("LeftAnti" in line for line in left) == 1
