"""Lexical search, exact dedup and hard negatives against plain versions, with odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triagelake.llm import exact_dedup, hard_negatives, lexical

DDL = "doc_id long, text string, score double, rank int, label string"
ODD = [
    (1, "One two  three", 0.5, 1, "x"), (2, "Onetwothree", 0.5, 1, "x"),
    (3, "One\ttwo\nthree ", 0.5, 1, None), (3, "One\ttwo\nthree ", 0.5, 1, None),
    (4, None, None, None, None), (5, "", 0.1, 2, "a"), (6, " \n\x0b ", 0.1, 2, "a"),
    (None, "no id", 0.1, 2, "a"), (None, "no id", 0.1, 2, "a"), (7, "long two " * 20000, 1.0, 1, "b"),
    (8, "one two two three", 0.0, 1, "b"), (9, "THREE one-two Two", 0.0, 1, "b"),
    (10, "été Été one two", 0.0, 1, "b"), (11, "-- !! --", 0.0, 1, "b"),
    (12, "one two two three", 0.0, 1, "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


# exact dedup

def plain_groups(rows):
    """(id, keep_id, size, sha) of every row, and per group the rank of the row that stays."""
    groups = defaultdict(list)
    for i, text in rows:
        content = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups[content].append((-len(text or ""), i is None, i))
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        name = hashlib.sha256(content.encode()).hexdigest()
        out += [(i, keep, len(members), name) for _, _, i in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_of_odd_rows_with_wide_and_narrow_keys(spark, odd, bits):
    rows = [(r[0], r[1]) for r in ODD]
    found = exact_dedup.exact_duplicates(odd.repartition(3), key_bits=bits).collect()
    assert sorted([tuple(r)[:3] + (r.text_sha256,) for r in found], key=str) == plain_groups(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in found}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_an_empty_table_has_no_groups(empty):
    found = exact_dedup.exact_duplicates(empty)
    assert found.count() == 0 and found.columns == [
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_a_task_that_overflows_its_memory_sends_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MERGE_BYTES", 40)
    texts = [f"text {i % 7} " * 3 for i in range(60)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(60), pa.int64()), pa.array(texts)], names=["i", "t"])
    out = pa.Table.from_batches(list(exact_dedup._leads(batch.slice(k, 5) for k in range(0, 60, 5))))
    total = Counter()
    for content, n in zip(out["_content"].to_pylist(), out["_copies"].to_pylist(), strict=True):
        total[content] += n
    assert total == Counter(t.replace(" ", "").encode() for t in texts)


def test_the_filter_holds_what_was_inserted_and_not_deleted():
    rng = np.random.default_rng(3)
    keys = [int(x) for x in rng.integers(0, 1 << 63, 200)]
    small = exact_dedup.CuckooFilter(64)
    assert all(small.insert(k) for k in keys) and all(k in small for k in keys)
    again = exact_dedup.CuckooFilter(64, small.table())
    for k in keys[:100]:
        again.delete(k)
    assert all(k in again for k in keys[100:])
    assert sum(k in again for k in keys[:100]) < 5


def test_a_part_grows_from_its_stored_keys_and_forgets_deleted_contents():
    part = exact_dedup.Part()
    contents = [f"c{i}".encode() for i in range(3000)]
    digest = {c: hashlib.sha256(c).digest() for c in contents}
    for c in contents:
        part.insert(digest[c], c, 1, (0, 0), 1)
        part.insert(digest[c], c, 2, (-1, 5), 1)
    assert part.resized >= 3 and part.filter.buckets * exact_dedup.SLOTS >= 3000
    assert all(part.find(digest[c], c)[2] == 3 for c in contents)
    for c in contents[::2]:
        assert part.delete(digest[c], c, 5) == 3
    assert all((part.find(digest[c], c) is None) == (i % 2 == 0) for i, c in enumerate(contents))
    assert part.delete(digest[contents[0]], contents[0]) == 0


def test_a_stored_index_takes_insertions_and_deletions(spark, odd):
    rows = [(r[0], r[1]) for r in ODD]
    index = exact_dedup.change_index(None, odd, None, parts=3)
    more = spark.createDataFrame(
        [(20, "one two three!"), (21, "One two three")], "doc_id long, text string")
    gone = spark.createDataFrame(
        [(1, "one two two three"), (2, "onetwotwothree"), (3, "never seen"), (4, "")],
        "doc_id long, text string")
    index = exact_dedup.change_index(index, more, gone, parts=3)
    live = Counter(re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in [*rows, *more.collect()])
    live.subtract(["onetwotwothree", "onetwotwothree", ""])
    stored = {r._content.decode(): r._copies for r in index.where("_content is not null").collect()}
    assert stored == {c: n for c, n in live.items() if n > 0}
    assert index.where("_filter is not null").count() == 3
    asked = spark.createDataFrame([(1, "Onetwo three"), (2, "onetwotwothree"), (3, None), (4, "q")],
                                  "doc_id long, text string")
    found = {r.doc_id: r.copies for r in exact_dedup.look_up(index, asked, parts=3).collect()}
    assert found == {1: 5, 2: 0, 3: 2, 4: 0}


# lexical search

TERM = "[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_terms(text):
    return re.findall(TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranking(docs, items, k):
    terms = [(i, Counter(plain_terms(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in terms:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(best)]
    return sorted(out, key=str)


ITEMS = [(1, "one two TWO unknown"), (2, None), (3, "..."), (4, "unknown"), (None, "été no id"),
         (5, "three one"), (5, "three one"), (6, "long")]


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 3])
def test_ranking_of_odd_rows(spark, odd, block):
    items = spark.createDataFrame([(*r, 7) for r in ITEMS], "item_id long, text string, rank int")
    found = lexical.ranked_search(odd, items, k=3, block_terms=block).collect()
    docs = [(r[0], r[1]) for r in ODD]
    assert sorted([tuple(r) for r in found], key=str) == plain_ranking(docs, ITEMS, 3)


def test_ranking_of_repeated_documents(spark):
    rng = np.random.default_rng(11)
    words = [f"w{int(x)}" for x in range(300)]
    docs = [(i, " ".join(words[min(299, int(z) - 1)] for z in rng.zipf(1.3, int(rng.integers(1, 60)))))
            for i in range(600)]
    docs += [(1000 + i, docs[i][1]) for i in range(100)]  # ties
    items = [(i, " ".join(words[int(x)] for x in rng.integers(0, 300, 12)) + " w0 w1 w2 w0")
             for i in range(20)]
    found = lexical.ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(2),
        spark.createDataFrame(items, "item_id long, text string"), k=10).collect()
    assert sorted([tuple(r) for r in found], key=str) == plain_ranking(docs, items, 10)


@pytest.mark.parametrize("short", [0, 2, 8, 10_000])
def test_a_shard_against_all_scores(short, monkeypatch):
    monkeypatch.setattr(lexical, "SHORT_LIST", short)
    monkeypatch.setattr(lexical, "STEP_DOCS", 7)
    rng = np.random.default_rng(short)
    n = rng.integers(5, 90, 50)
    doc = np.repeat(np.arange(50), 6)
    codes = np.concatenate([rng.choice(20, 6, replace=False) for _ in range(50)])
    tfs = rng.integers(1, 5, 300)
    shard = lexical.Shard(np.arange(50) * 3 % 50, n, codes, tfs, doc, 900, 40_000)
    query = [(int(c), int(w)) for c, w in zip(range(0, 20, 2), rng.integers(0, 4000, 10), strict=True)]
    best = lexical.Best(10)
    shard.search(query, best)
    length = 25 + 75 * n[doc] * 900 // 40_000
    total = np.zeros(50, dtype=np.int64)
    weight = dict(query)
    for d, c, tf, m in zip(doc, codes, tfs, length, strict=True):
        total[d * 3 % 50] += weight.get(int(c), 0) * (10**9 * tf // (1000 * tf + 8 * m))
    want = sorted(((-s, i) for i, s in enumerate(total) if s > 0))[:10]
    assert list(zip((-best.score).tolist(), best.ids.tolist(), strict=True)) == want


def test_empty_tables_find_nothing(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked_search(empty, items).count() == 0
    assert lexical.ranked_search(odd, items.limit(0)).count() == 0


# hard negatives

VECS = "vec_id long, embedding array<double>, label int, rank string"


def plain_negatives(rows, anchors, scale, p, n, ratio=(80, 100)):
    vecs = {}
    for i, v, label, _ in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [math.floor(scale * x) for x in v])
        if i not in vecs or key < vecs[i]:
            vecs[i] = key
    def score(a, b):
        got = sum(x * y for x, y in zip(vecs[a][1], vecs[b][1], strict=True))
        return max(hard_negatives.LEAST, min(hard_negatives.MOST, got))
    out = []
    for a in anchors:
        if a not in vecs:
            continue
        others = sorted((-score(a, b), b) for b in vecs if b != a)
        for ps, b in [o for o in others if vecs[o[1]][0] == vecs[a][0]][:p]:
            inside = [o for o in others if vecs[o[1]][0] != vecs[a][0]
                      and ratio[0] * -ps <= ratio[1] * -o[0] <= ratio[1] * -ps][:n]
            out += [(a, b, r + 1, c, -ps, -s) for r, (s, c) in enumerate(inside)]
    return sorted(out)


def found_negatives(spark, rows, anchors, **options):
    table = spark.createDataFrame(rows, VECS)
    asked = spark.createDataFrame([(a,) for a in anchors], "vec_id long")
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(table, asked, **options).collect())


@pytest.mark.parametrize("shard", [hard_negatives.SHARD_ROWS, 40])
def test_negatives_of_clusters_against_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 1, (4, 20))
    rows = [(i, (centre[i % 4] + rng.normal(0, 0.5, 20)).tolist(), int(rng.integers(0, 3)), "x")
            for i in range(200)]
    rows += [(300 + i, rows[i][1], rows[i][2], "copy") for i in range(30)]
    anchors = [0, 3, 10, 57, 303, 999]
    got = found_negatives(spark, rows, anchors, scale=256.0)
    assert got and got == plain_negatives(rows, anchors, 256, 5, 5)


def test_negatives_of_odd_rows(spark):
    ok = [(i, [1.0, i / 10, 0.0], i % 2, "r") for i in range(12)]
    rows = [*ok, (None, [1.0, 1.0, 1.0], 1, "r"), (20, None, 1, "r"), (21, [1.0, None, 1.0], 1, "r"),
            (22, [1.0, float("nan"), 1.0], 1, "r"), (23, [float("inf"), 1.0, 1.0], 0, "r"),
            (24, [1.0, 1.0, 1.0], None, "r"), (25, [], 1, "r"), (26, [0.0, 0.0, 0.0], 1, "r"),
            (27, [-1.0, -1.0, 0.0], 0, "r"), (3, [1.0, 0.2, 0.0], 1, "r"), (3, [1.0, 0.2, 0.0], 1, "r"),
            (28, [1e5, 3e6, 2.5], 1, "r"), (29, [-1e5, 2e6, 7.0], 0, "r")]
    anchors = [0, 3, 20, 24, 26, 27, 28]
    got = found_negatives(spark, rows, anchors, scale=256.0)
    assert got == plain_negatives(rows, anchors, 256, 5, 5)
    assert any(r[0] == 26 for r in got) and not any(r[0] in (20, 24) for r in got)
    assert found_negatives(spark, [], anchors) == []
    assert found_negatives(spark, rows, []) == []


def test_products_beyond_doubles_stay_exact(spark):
    rows = [(0, [4194304.015625, 1.0], 0, "r"), (1, [65536.0, 65536.0], 0, "r"),
            (2, [65535.99609375, 65536.0], 1, "r"), (3, [65535.9921875, 65536.0], 1, "r"),
            (4, [1e9, 1e9], 0, "r"), (5, [1e9, 9e8], 1, "r"), (6, [1e200, 1.0], 1, "r")]
    got = found_negatives(spark, rows, [0, 1, 4], scale=256.0)
    assert got and got == plain_negatives(rows, [0, 1, 4], 256, 5, 5)


def test_covered_ends_are_not_indexed_and_thresholds_take_rows_up_again():
    rng = np.random.default_rng(2)
    fade = 0.7 ** np.arange(64)
    vecs = np.floor(256 * rng.normal(0, 1, (500, 64)) * fade)
    index = hard_negatives.SuffixIndex(np.arange(500), np.zeros(500, np.int64), vecs)
    search = hard_negatives.Search(index, vecs[0], np.arange(1, 500))
    exact, top = vecs[1:] @ vecs[0], search.top()
    for share in (0.9, 0.5, 0.2, 0.05):
        search.lower(share * top)
        want = set(np.flatnonzero(exact >= share * top) + 1)
        assert want <= set(search.found.tolist())
        assert len(search.found) + len(search.open) == 499
    assert index.indexed.mean() < len(index.blocks)
