"""Exact and near deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citylens.llm import exact, neardup, simhash
from citylens.llm.graph import components

SCHEMA = "doc_id long, text string, digest string, kept string"


def folded(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.fixture
def copies(spark):
    data = [(i, t) for i, t in enumerate(["Ab c", "aB C", None, "", "É", "é", "x" * 200_000, "X" * 200_000, "ab c ", "\x00", "one"])]
    data += [(20, "one"), (20, "one"), (None, "ONE"), (None, "alone"), (7, "twice"), (7, "twice")] + [(100 + i, "hot") for i in range(60)]
    return spark.createDataFrame([(*d, "d", "k") for d in data], SCHEMA)


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(folded(r.text), []).append(r.doc_id)
    keep = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return groups, keep


@pytest.mark.parametrize("digest", [exact.sha256_hex, lambda t: hashlib.sha256(t).hexdigest()[:1]])
def test_exact_groups_match_brute_force(spark, copies, digest):
    found = exact.exact_groups(copies, digest).collect()
    groups, keep = expected(copies.collect())
    by_size = sorted((r.doc_id, r.keep_id, r.group_size) for r in found if r.doc_id is not None)
    assert by_size == sorted((i, keep[t], len(g)) for t, g in groups.items() for i in g if i is not None)
    assert len(found) == copies.count()
    assert sum(r.kept for r in found) == len(groups)


def test_drop_copies_keeps_one_row_per_text(spark, copies):
    kept = exact.drop_copies(copies)
    groups, keep = expected(copies.collect())
    assert kept.columns == copies.columns
    assert sorted((folded(r.text), r.doc_id) for r in kept.collect() if r.doc_id is not None) == sorted((t, i) for t, i in keep.items() if i is not None)
    assert kept.count() == len(groups)


def test_exact_empty_table(spark, copies):
    assert exact.exact_groups(copies.limit(0)).count() == 0 and exact.drop_copies(copies.limit(0)).count() == 0


def fingerprint(text):
    words = folded(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_shingle_hash_is_the_one_of_the_session(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_matches_brute_force(spark):
    draw = random.Random(4)
    base = [" ".join(draw.choice(["u", "v", "w", "x", "é"]) + str(draw.randint(0, 30)) for _ in range(draw.randint(1, 40))) for _ in range(60)]
    texts = base + [b + " tail" for b in base[:20]] + [b.upper() for b in base[:5]] + [None, "", " \t", "one", "one two", "one\u00a0two three", "w " * 100_000]
    texts += [" ".join(["a b c d e f g h"] * 40 + [str(i)]) for i in range(30)]
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, base[0], "x"), (None, base[1], "x")], "doc_id long, text string, fingerprint string")
    found = simhash.simhash_groups(docs).collect()
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    place = list(range(len(rows)))

    def top(i):
        while place[i] != i:
            i = place[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                place[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    wanted = sorted(((d, f, least[top(i)]) for i, (d, f) in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found), key=repr) == wanted
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_links_hold_everything_within_two_bits(spark):
    draw = random.Random(5)
    seeds = [draw.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for s in seeds[:20]:
        for _ in range(30):
            s ^= 1 << draw.randrange(64)
            values.add(s)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    found = {r.node: r.component for r in components(links).collect()}
    for a in signed:
        for b in signed:
            if ((a ^ b) % (1 << 64)).bit_count() <= 2 and a != b:
                assert found[a] == found[b]
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 for r in links.collect())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (7, 6)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = folded(text).split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(one, two):
    return len(one & two) / len(one | two)


def test_near_copies_go_and_others_stay(spark):
    draw = random.Random(6)
    text = lambda n: [f"w{draw.randint(0, 3000)}" for _ in range(n)]
    base = [text(draw.randint(40, 300)) for _ in range(40)]
    data = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(3):
            changed = list(b)
            changed[draw.randrange(len(b))] = "changed"
            data.append(" ".join(changed))
    hot = text(200)
    for i in range(60):
        changed = list(hot)
        changed[draw.randrange(200)] = f"v{i}"
        data.append(" ".join(changed))
    data += [None, "", "short text", "Short text", "another short"]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(data)], "doc_id long, text string, key long, component string")
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    sets = [shingles(t) for t in data]
    # Similarity is a share of fingerprint bits: pairs with four in five shingles in common are alike, those with half are not.
    alike, near = ({i: {j for j in range(len(data)) if j != i and similarity(sets[i], sets[j]) >= least} for i in range(len(data))} for least in (0.5, 0.8))
    assert all(alike[i] for i in range(len(data)) if i not in ids)
    assert ids.issuperset(i for i in range(len(data)) if not alike[i])
    assert not [(i, j) for i in ids for j in near[i] & ids if i < j]
    assert neardup.drop_near_copies(docs.limit(0)).count() == 0


def test_min_hash_bands_find_pairs_at_the_threshold():
    draw = np.random.default_rng(7)
    hits = 0
    for _ in range(200):
        shared, own = draw.integers(0, 1 << 63, 400).astype(np.uint64), draw.integers(0, 1 << 63, (2, 50)).astype(np.uint64)
        one, two = (set(neardup.band_keys(np.concatenate([shared, o]))) for o in own)
        hits += bool(one & two)
    assert hits >= 190


def exact_groups(data):
    """Smallest place of each group of texts linked at a Jaccard similarity of 0.8."""
    sets, place = [shingles(t) for t in data], list(range(len(data)))

    def top(i):
        while place[i] != i:
            i = place[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                place[b] = a
    return {top(i) for i in range(len(data))}


def kept_ids(spark, data):
    return {r.doc_id for r in neardup.drop_near_copies(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()}


def test_near_copies_below_the_threshold_stay(spark):
    draw = random.Random(8)
    data = []
    for k in range(40):
        words = [f"b{k}x{i}" for i in range(204)]
        # Of 200 shingles 25 to 30 differ on each side: similarities of 0.74 to 0.78; 22 for every fourth pair give just over 0.8.
        cut = 22 if k % 4 == 0 else draw.randint(25, 30)
        data += [" ".join(words), " ".join(words[:204 - cut] + [f"c{k}x{i}" for i in range(cut)])]
    data += ["p q r s t u v w x", "p q r s t u v w", "one two three four five six", "one two three four five"]
    wanted = exact_groups(data)
    assert len(data) - 12 <= len(wanted) < len(data)
    assert kept_ids(spark, data) == wanted


def test_large_group_of_graded_copies_matches_brute_force(spark):
    draw = random.Random(9)
    base = [f"g{i}" for i in range(120)]
    data = []
    for k in range(400):
        # Edits pile up along each of several walks, so texts are like some of the group and unlike others.
        words = list(base if k % 20 == 0 else walk)
        for _ in range(1 if k % 20 else 4):
            words[draw.randrange(120)] = f"e{k % 7}x{draw.randrange(40)}"
        walk = words
        data.append(" ".join(words))
    wanted = exact_groups(data)
    assert 5 < len(wanted) < 395
    assert kept_ids(spark, data) == wanted
