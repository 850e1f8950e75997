"""Operators on small tables, against plain versions and with the odd rows they must bear."""

import base64
import hashlib
import math
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triagelake.llm import (
    ann, bpe, chat, components, mixing, ngram_join, packed, pitman_yor, sharding, token_records,
    topk, toxicity, words,
)
from triagelake.session import new_path

DDL = "doc_id long, text string, source string, shard int, score double"
BASE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, BASE, "a", 9, 0.5), (2, BASE, "a", 9, 0.5), (2, BASE, "a", 9, 0.5),
    (3, BASE.replace("w59", "x"), "b", 9, 0.5), (4, None, None, None, None), (5, "", "a", 1, 1.0),
    (6, " \n\t ", "b", 1, 1.0), (7, "One two", "b", 1, 1.0), (8, "one TWO", None, 1, 1.0),
    (None, "no id at all here", "c", 1, 1.0), (9, "long " * 30000, "c", 1, 1.0),
    (10, "é日本 </s> <|end|> \x1c\x85 tail.", "c", 1, 1.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def plain_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x20\x09-\x0D]+", lower)


def plain_components(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = plain_words(text)
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(
                        sets[a] | sets[b]):
                    low = min(least[a], least[b])
                    changed |= (least[a], least[b]) != (low, low)
                    least[a] = least[b] = low
    return {i: (len(s), least[i]) for i, s in sets.items()}


def test_words_have_equal_numbers_if_they_are_equal():
    import pyarrow as pa

    found = words.split(pa.array(["Ab ab\tcd", None, "", "  cd"]))
    n = found.numbers()
    assert found.counts.tolist() == [3, 0, 0, 1]
    assert n[0] == n[1] and n[2] == n[3] != n[0] and int(n[0]) == words.number_of(b"ab")


CHAIN = " ".join(f"c{i}" for i in range(80))


def near(text, *places):
    parts = text.split()
    for p in places:
        parts[p] = f"x{p}"
    return " ".join(parts)


def test_a_row_without_an_id_still_links_its_neighbours(spark):
    data = [(1, near(CHAIN, 0)), (None, near(CHAIN, 0, 79)), (3, near(CHAIN, 0, 79, 40))]
    data[2] = (3, near(data[1][1], 1))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    plain = plain_components([(i or 2, t) for i, t in data], 3, 9, 10)
    assert len({c for _, c in plain.values()}) == 1
    found = ngram_join.jaccard_components(docs).collect()
    assert {r.component_id for r in found} == {1}


def test_rows_of_one_id_with_different_texts_both_stay(spark):
    data = [(1, CHAIN, 5), (1, CHAIN.replace("c", "d"), 6), (None, CHAIN.replace("c", "e"), 7),
            (None, CHAIN.replace("c", "e"), 8), (4, near(CHAIN, 79), 9), (5, None, 1), (5, " ", 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, `row` int")
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns
    found = sorted((r[2] for r in kept.collect()))
    assert found in ([1, 2, 5, 6, 7], [1, 2, 5, 6, 8])
    odd_names = docs.selectExpr("doc_id", "text", "'s' AS source", "`row` AS _k0", "1 AS _n", "2 AS id")
    mixed = mixing.mix_documents(odd_names)
    assert mixed.columns == odd_names.columns and mixed.count()
    assert {r._k0 for r in mixed.collect()} <= set(range(10)) and mixed.where("_n <> 1 or id <> 2").count() == 0


def test_scores_do_not_depend_on_the_number_of_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            scored = pitman_yor.score_texts(docs, F.col("doc_id") % 7 == 2).collect()
            found.append({r.doc_id: r.score for r in scored})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == docs.count()
    assert all(found[1][i] == pytest.approx(x, rel=1e-9) for i, x in found[0].items())


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(30)] + [(5, 5)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == (
        {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)})


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 8, 10)])
def test_ngram_join_equals_all_pairs(spark, sf, k, num, den):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    found = ngram_join.jaccard_components(docs, k=k, num=num, den=den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(
        pairs, k, num, den)


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        w = [f"w{j}" for j in range(120)]
        for j in rng.integers(0, 120, int(rng.integers(0, 5))):
            w[j] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.jaccard_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(
        rows, 3, 9, 10)


def plain_links(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    return {i: sum(a != b and bool(x) and den * len(x & y) >= num * len(x | y)
                   for b, y in enumerate(sets)) for a, (x, (i, _)) in enumerate(zip(sets, rows))}


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 8, 10)])
def test_every_link_of_every_document_is_counted(spark, sf, k, num, den):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        w = [f"w{j}" for j in range(120)]
        for j in rng.integers(0, 120, int(rng.integers(0, 4))):
            w[j] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(
        f"{sf}/documents.parquet").limit(150).collect()] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.jaccard_link_counts(docs, k=k, num=num, den=den).collect()
    assert {r.doc_id: r.n_links for r in found} == plain_links(rows, k, num, den)
    links, _ = ngram_join.jaccard_links(docs, k=k, num=num, den=den)
    distinct = {tuple(plain_words(t)): (i, t) for i, t in rows}
    assert 2 * links.count() == sum(plain_links([*distinct.values()], k, num, den).values())


def test_ngram_join_of_odd_rows(odd, empty):
    found = ngram_join.jaccard_components(odd).collect()
    assert len(found) == len(ODD)
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None}
    assert of[2] == (58, 1) and of[3] == (58, 1) and of[8] == (1, 7)
    assert of[4] == of[4][:1] + (4,) and of[5] == (0, 5) and of[6] == (0, 6)
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = ngram_join.one_per_component(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 4, 5, 6, 7, 9, 10]


def vectors_of(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def test_nearest_neighbours_reach_the_recall(spark):
    table = vectors_of(spark, "/root/testdata/sf0.1")
    found = ann.nearest_neighbours(table, table.where("vec_id % 50 = 0"), k=5).collect()
    rows = table.collect()
    ids = np.array([r.vec_id for r in rows])
    vecs = np.array([r.embedding for r in rows], dtype=float)
    unit = vecs / np.sqrt((vecs ** 2).sum(axis=1, keepdims=True))
    got = defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[at]
        score[at] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        hits, total = hits + len(best & got[ids[at]]), total + 5
    assert hits >= 0.9 * total


def test_recall_holds_with_many_more_lists_than_probes(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(6000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    settings = ann.Settings(list_rows=10, probes=12)  # 600 lists
    found = ann.nearest_neighbours(table, table.where("vec_id % 50 = 0"), 5, settings).collect()
    unit = vecs / np.sqrt((vecs ** 2).sum(axis=1, keepdims=True))
    got = defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for at in range(0, 6000, 50):
        score = unit @ unit[at]
        score[at] = -np.inf
        hits, total = hits + len(set(np.argsort(-score)[:5].tolist()) & got[at]), total + 5
    print("recall", hits / total)
    assert hits >= 0.9 * total


def test_the_graph_finds_the_nearest_of_many_lists():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(12000, 24))
    centre = ann.balanced_centroids(rows / np.linalg.norm(rows, axis=1, keepdims=True), 2000)
    graph = ann.CentroidGraph(centre, ann.neighbour_graph(centre, 24))
    vecs = rng.normal(size=(200, 24))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    for want, beam in ((18, 128), (500, 128)):
        found, dist = graph.nearest(vecs, want, beam)
        exact = np.argsort(2 - 2 * vecs @ centre.T, axis=1)[:, :want]
        share = np.mean([len(set(a.tolist()) & set(b.tolist())) / want
                         for a, b in zip(found, exact, strict=True)])
        assert share >= 0.9 and (np.diff(dist, axis=1) >= 0).all()
        assert all(len(set(a.tolist())) == want for a in found)


def test_vectors_of_extreme_length_are_found(spark):
    rows = [(0, [1.0, 0.1]), (1, [1e-200, 0.0]), (2, [1e200, 1e199]), (3, [0.0, 5e-324]),
            (4, [1.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest_neighbours(table, table.where("vec_id in (0, 2)"), k=4).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    assert [got[0, j][0] for j in (1, 2, 3, 4)] == [2, 1, 4, 3]
    assert [got[2, j][0] for j in (1, 2, 3, 4)] == [0, 1, 4, 3]
    assert abs(got[0, 1][1] - 1) < 1e-12 and abs(got[0, 2][1] - 1 / 1.01 ** 0.5) < 1e-12


def test_ties_at_the_last_place_of_both_searches(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(i, [1.0, 0.0]) for i in (0, 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id = 20")
    for found in (ann.nearest_neighbours(table, asked, k=5), topk.exact_top_k(table, asked, k=5)):
        assert [r.vec_id for r in found.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_exact_top_k_of_very_large_components(spark, monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    for size in (2.0 ** 22, 2.0 ** 31, 1e200):
        vecs = (rng.normal(size=(200, 3)) * size).tolist()
        vecs[7] = [4194304.015625, 4194304.015625, 4194304.015625]
        vecs[9:12] = [vecs[8]] * 3
        table = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
        found = topk.exact_top_k(table, table.where("vec_id % 20 = 7"), k=5).collect()
        got = defaultdict(list)
        for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
            got[r.query_id].append((r.vec_id, r.score))
        whole = [[math.floor(64 * x) for x in v] for v in vecs]
        most = 2 ** 63 - 1
        for q in range(7, 200, 20):
            scores = [(-max(-most, min(most, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i)
                      for i, v in enumerate(whole) if i != q]
            assert got[q] == [(i, -s) for s, i in sorted(scores)[:5]]


def test_exact_top_k_equals_brute_force(spark, sf):
    table = vectors_of(spark, sf)
    rows = table.collect()
    ids = np.array([r.vec_id for r in rows])
    vecs = np.floor(64 * np.array([r.embedding for r in rows], dtype=float))
    found = topk.exact_top_k(table, table.where("vec_id % 20 = 0"), k=20).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    expected = {}
    for at in np.flatnonzero(ids % 20 == 0):
        score = vecs @ vecs[at]
        score[at] = -np.inf
        for rank, j in enumerate(np.lexsort((ids, -score))[:20], 1):
            expected[ids[at], rank] = (ids[j], int(score[j]))
    assert got == expected


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]),
            (8, [1.0]), (9, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 50 = 0")
    near = sorted(tuple(r) for r in ann.nearest_neighbours(table, asked).collect())
    assert near == [(0, 1, 2, 1.0), (0, 2, 50, 1.0), (50, 1, 0, 1.0), (50, 2, 2, 1.0)]
    top = sorted(tuple(r) for r in topk.exact_top_k(table, asked, k=2).collect())
    assert top == [(0, 1, 2, 4096), (0, 2, 50, 4096), (50, 1, 0, 4096), (50, 2, 2, 4096)]
    assert ann.nearest_neighbours(table.limit(0), asked.limit(0)).count() == 0
    assert topk.exact_top_k(table.limit(0), asked.limit(0)).count() == 0


def test_chat_reads_back_what_it_wrote(spark):
    text = "</s>[INST] ok [/INST] <|turn|> \\ \\\\a <|end|>\n"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "assistant", None),
            (2, None, None, ""), (None, 0, "assistant", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(table)
    assert all("</s>" not in r.formatted and "[INST]" not in r.formatted
               for r in formatted.collect())
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    turns = f"user\n{text}\nassistant\n{text}\nassistant\n\n"
    assert found[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert found[1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (found[1].n_turns, found[1].loss_chars) == (3, len(text))
    assert found[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_content_parts_become_placeholders(spark):
    part = dict.fromkeys(("type", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [part | {"type": "text", "text": "see <|image|>"},
             part | {"type": "image", "ref": "i.png", "width": 57, "height": 28},
             part | {"type": "audio", "ref": "a.wav", "seconds": 1.5},
             part | {"type": "document", "ref": "d.pdf", "pages": 2}]
    table = spark.createDataFrame(
        [(1, 0, "user", None, parts)],
        f"conv_id long, turn long, role string, text string, parts {chat.PARTS_DDL}")
    row = chat.format_turns(table, parts_col="parts").first()
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [
        ("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 1024)]
    assert [row.formatted[a.at:a.at + 3] for a in row.attachments] == ["<|i", "<|a", "<|d"]
    assert row.formatted.count("<|image|>") == 1 and row.attachment_tokens == 1065


def test_parts_of_unknown_types_and_repeated_or_long_turns(spark):
    part = dict.fromkeys(("type", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [part | {"type": "video", "ref": "v.mp4"}, None, part | {"text": "no type </s>"}]
    long = "ab </s> " * 200_000
    rows = [(1, 0, "user", None, parts), (2, 0, "assistant", long, None),
            (2, 0, "assistant", long, None)]
    table = spark.createDataFrame(
        rows, f"conv_id long, turn long, role string, text string, parts {chat.PARTS_DDL}")
    turns = chat.format_turns(table, parts_col="parts")
    row = turns.where("conv_id = 1").first()
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [
        ("video", "v.mp4", 0), ("unknown", None, 0)]
    read = {r.conv_id: r for r in chat.read_back(turns).collect()}
    told = hashlib.sha256(b"user\nno type </s>\n").hexdigest()
    assert read[1].turns_sha256 == told and read[2].n_turns == 2
    assert read[2].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_equals_the_library(odd, empty):
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    found = bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found.collect())
    want = Counter()
    for i, text, *_ in ODD:
        ids = library.encode_ordinary(text or "")
        want[i, struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()] += 1
    assert got == want
    assert bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    texts = bpe.decode(found.select("ids"), RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(r.text for r in texts) == Counter(t or "" for _, t, *_ in ODD)


def test_merges_of_a_long_piece_equal_the_library():
    import tiktoken

    ranks = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    for text in ("a" * 3001, "abc" * 999, "héß日" * 500, "\n" * 777, "'s"):
        assert bpe.merge(text.encode(), ranks) == library._core_bpe.encode_single_piece(
            text.encode())


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    return library.encode(text or "", add_special_tokens=False).ids


def test_records_read_back(spark, odd, empty):
    path = new_path(spark, "records")
    token_records.write_records(odd, path, TOKENIZER)
    index = spark.read.parquet(f"{path}/index")
    found = token_records.with_start(token_records.read_records(spark, path), index).orderBy(
        "start").collect()
    assert [r._id for r in found] == sorted(
        (i for i, *_ in ODD), key=lambda i: (i is not None, i))
    start, of = 0, {i: text for i, text, *_ in ODD}
    for r in found:
        ids = [*plain_ids(of[r._id]), 2]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        start += len(ids)
    again = token_records.shuffled_records(spark, path, seed=3).collect()
    assert Counter(bytes(r.ids) for r in again) == Counter(bytes(r.ids) for r in found)
    token_records.write_records(empty, f"{path}-empty", TOKENIZER)
    assert spark.read.parquet(f"{path}-empty/index").count() == 0


def test_a_broken_record_is_found():
    body = token_records.frame(7, b"\x01\x00\x02\x00", 2) + b"\n"
    assert token_records.unframe(memoryview(body), 0)[1] == 7
    for at in range(len(body) - 1):
        bad = bytearray(body)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(bytes(bad)), 0)


def test_runs_without_blank_encode_alone(spark, sf):
    coder = token_records.word_ids(TOKENIZER)
    texts = ["It's THE end, a.b, 3.5. <|endoftext|> É. naïve, ẍ., ΣΑΣ. don't, 's. 1,",
             "DÉJÀ-vu, STRASSE ẞ ß÷×µª ²½ a1b22 'so '' ''s <|x|>.'ll ~\x7f e\u0301 İ\ta\u00a0b", "", "\n",
             *[r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]]
    for text, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain_ids(text)


def test_records_hold_added_tokens_as_the_library_gives_them(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "a<|startoftext|>b c", "It's <|endoftext|>'s é<|endoftext|>日",
             "<|ENDOFTEXT|> <|endof text|>", "<|endoftext|>\n" * 9, "plain <| text"]
    library = Tokenizer.from_file(TOKENIZER)
    path = new_path(spark, "added")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_records.write_records(docs, path, TOKENIZER)
    found = {r._id: np.frombuffer(r.ids, "<u4").tolist()
             for r in token_records.read_records(spark, path).collect()}
    assert found == {i: [*library.encode(x, add_special_tokens=False).ids, 2]
                     for i, x in enumerate(texts)}


def shards_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    return by


def test_shards_are_even_and_keep_copies_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard_documents(docs).collect()
    by = shards_of(rows)
    assert sorted(map(len, by.values()))[-1] - min(map(len, by.values())) <= 1 and len(by) == 8
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    groups = defaultdict(set)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        groups[data].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())


def test_shards_of_a_group_larger_than_a_shard(spark):
    rows = [(i, "same" if i < 60 else f"t{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = shards_of(sharding.shard_documents(docs, shards=4).collect())
    assert sorted(map(len, by.values())) == [25] * 4


def test_shards_of_odd_rows(odd, empty):
    by = shards_of(sharding.shard_documents(odd, shards=5).collect())
    assert sorted(map(len, by.values())) == [2, 2, 2, 3, 3]
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_runs_no_python(spark, sf):
    plan = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_targets_fill_up_to_the_cap(spark):
    rows = [("a", 100), ("b", 100), ("c", 100), (None, 100), ("d", 0)]
    found = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long"))
    got = {r.source: r.target for r in found.collect()}
    assert got == {"a": 200.0, "b": pytest.approx(200.0), "c": pytest.approx(400 / 6 + 0 * 1),
                   "d": 0.0, None: pytest.approx(400 / 3)} or sum(got.values()) == pytest.approx(600)
    assert all(t <= 200 for t in got.values()) and sum(got.values()) == pytest.approx(600)


def test_mix_comes_near_the_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    def run():
        return sorted((r.doc_id, r.source, r["size"], r.taken, r.target)
                      for r in mixing.mixed_copies(docs).collect())
    first = run()
    assert first == run()
    taken, target, largest = Counter(), {}, Counter()
    for _, source, size, words_taken, goal in first:
        assert 0 <= words_taken <= 2 * size and (size == 0 or words_taken % size == 0)
        taken[source] += words_taken
        target[source] = goal
        largest[source] = max(largest[source], size)
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= largest[source]  # ten documents make a source here


def test_many_chunks_come_down_to_one_residual(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 37 as int))").alias("text"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("s")).alias("source"))
    rows = mixing.mixed_copies(docs).collect()
    assert len(rows) == 1000
    for source in ("hot", "s"):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 37


def test_mix_of_odd_rows(odd, empty):
    assert mixing.mixed_copies(odd).count() == len(ODD)
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mixed_copies(empty).count() == 0


def test_equal_rows_are_dealt_to_many_chunks(spark):
    same = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"))
    rows = same.unionByName(spark.range(10, 40_010).toDF("doc_id")).select(
        "doc_id", F.when(F.col("doc_id") == 1, F.lit("one two three")).otherwise(
            F.concat(F.lit("w "), F.col("doc_id").cast("string"))).alias("text"),
        F.lit("a").alias("source"))
    rows = rows.unionByName(spark.range(5000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"),
        F.lit("a").alias("source")))
    seen = []
    inner = mixing._round_chunk

    def watched(seed, level):
        seen.append(level)
        run = inner(seed, level)

        def check(table):
            out = run(table)
            assert len(out) <= 1.5 * mixing.CHUNK, len(out)
            return out
        return check

    mixing._round_chunk = watched
    try:
        found = mixing.mixed_copies(rows).groupBy("doc_id", "size").agg(
            F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("copies").alias("most"),
            F.first("target").alias("target")).collect()
    finally:
        mixing._round_chunk = inner
    assert len(seen) > 1 and len(found) == 40_002
    counts = {r.doc_id: r.n for r in found}
    assert counts[1] == 40_000 and counts[None] == 5000 and max(r.most for r in found) <= 2
    assert abs(sum(r.taken for r in found) - found[0].target) <= 3


def test_language_model_counts_and_probabilities(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = {r.doc_id: r for r in pitman_yor.score_texts(docs, held).collect()}
    tokens = {r.doc_id: [*plain_words(r.text), "\n"] for r in docs.collect()}
    train = Counter(w for i, t in tokens.items()
                    if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(train.values()), len(train)
    sums = Counter()
    for i, t in tokens.items():
        r = rows[i]
        base = sum(np.log10((train[w] + 1) / (n + v + 1)) for w in t)
        assert (r.n_tokens, r.train_tokens) == (len(t), n)
        assert r.n_known == sum(w in train for w in t)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.score < 0
        sums[r.held_out, "base"] += r.base_score
        sums[r.held_out, "score"] += r.score
    assert sums[True, "score"] > sums[True, "base"] and sums[False, "score"] > sums[False, "base"]


def test_predictions_of_a_context_sum_to_one(spark):
    texts = [(i, "a b a c") for i in range(20)] + [(90 + i, f"a {w}") for i, w in enumerate("bcax")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in pitman_yor.score_texts(
        docs, F.col("doc_id") >= 80).collect()}
    known = spark.createDataFrame(
        [*texts[:20], (80, ""), (81, "a"), (82, "b"), (83, "c"), (84, "zz")],
        "doc_id long, text string")
    first = {r.doc_id: 10 ** r.score for r in pitman_yor.score_texts(
        known, F.col("doc_id") >= 80).collect()}
    assert rows[93] < rows[90] < 0
    assert 0 < first[80] < 1 and first[81] > first[84]


def test_rare_contexts_keep_their_own_statistics(spark):
    texts = ["f " * 10_000] * 14 + ["x p"] * 2 + ["y q"] * 2 + ["x p", "x q", "y p", "y q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pitman_yor.score_texts(docs, F.col("doc_id") >= 18).collect()
    score = {r.doc_id: r.score for r in found}
    assert score[18] > score[19] + 0.3 and score[21] > score[20] + 0.3


def test_language_model_rows_do_not_grow_with_occurrences():
    def counted(times):
        rows = pa.table({"_key": [1], "text": ["a b " * times], "train": [True]}).to_batches()
        pairs = pa.Table.from_batches(pitman_yor._count_pairs(1)(iter(rows)))
        entries = pa.Table.from_batches(pitman_yor._entries(1)(iter(rows)))
        return [sum(len(x) for x in t.slice(0, 1).to_pylist()[0].values() if isinstance(x, bytes))
                for t in (pairs, pitman_yor._gather_part(pairs), entries)]

    assert counted(100) == counted(10_000)


def test_language_model_rows_of_a_part_are_a_fraction_of_their_numbers():
    rng = np.random.default_rng(7)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 1500, 20_000)) for _ in range(4)]
    rows = pa.table({"_key": [1, 2, 3, 4], "text": text, "train": [True] * 4}).to_batches()
    pairs = pa.Table.from_batches(pitman_yor._count_pairs(1)(iter(rows)))
    part = pitman_yor._gather_part(pairs)
    entries = pa.Table.from_batches(pitman_yor._entries(1)(iter(rows)))
    inner = pitman_yor.Part(part.to_pylist()[0])
    held, moving = len(inner.count), int((inner.count > 1).sum())
    assert held > 70_000 and moving > 1000 and inner.count.sum() == 80_004
    base = inner.per_context(inner.count > 0)[np.unique(inner.context[inner.count > 1])]
    state = pa.Table.from_batches(pitman_yor._begin(iter([pa.RecordBatch.from_pylist(
        [part.to_pylist()[0] | {"totals": [pitman_yor._wide(base)]}])])))
    # bytes a pair; 8, 16, 16 and 56 if the numbers are left as they are
    for table, n, most in ((pairs, held, 4), (part, held, 4), (entries, held, 4),
                           (state, moving, 20)):
        assert table.num_rows == 1
        assert table.nbytes < most * n, (table.column_names, table.nbytes / n)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 100, 5000, 50_000):
        found, signed = rng.integers(0, 300, n), rng.integers(-(1 << 62), 1 << 62, n)
        rising = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (pitman_yor._planes(pitman_yor._small(found)) == found).all()
        assert (pitman_yor._read_wide(pitman_yor._wide(signed)) == signed).all()
        assert (pitman_yor._read_flags(pitman_yor._flags(found > 9)) == (found > 9)).all()
        column = pa.chunked_array([[pitman_yor._number_steps(rising)] * 2, [
            pitman_yor._number_steps(rising[:0])]], pa.binary())
        assert (pitman_yor._all_numbers(column) == np.r_[rising, rising]).all()
        assert pitman_yor._sizes(column, 8).tolist() == [len(rising), len(rising), 0]


def test_few_large_rows_are_held_back_while_they_are_stored(spark):
    import pyarrow.parquet as pq

    def large(batches):
        for b in batches:
            for at in b["id"].to_pylist():
                body = np.random.default_rng(at).bytes(3 << 20)
                yield pa.RecordBatch.from_pylist([{"id": at, "body": body}])

    made = spark.range(0, 8, 1, 1).mapInArrow(large, "id long, body binary")
    _, path = pitman_yor._stored(made, "large")
    files = [pq.ParquetFile(f) for f in Path(path.removeprefix("file:")).glob("part-*")]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == 8 and max(groups) <= 2


def set_partitions(n):
    """Table sizes of every way to seat n customers."""
    if n == 0:
        yield []
        return
    for sizes in set_partitions(n - 1):
        yield [*sizes, 1]
        for at in range(len(sizes)):
            yield [*sizes[:at], sizes[at] + 1, *sizes[at + 1:]]


def test_customers_of_a_dish_are_seated_from_the_exact_conditional():
    d, rng = 0.4, np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        weight = Counter()
        for sizes in set_partitions(n):
            ways = math.prod(j - d for x in sizes for j in range(1, x))
            weight[len(sizes)] += ways * math.prod(0.3 + 0.2 * i for i in range(len(sizes)))
        found = pitman_yor.draw_tables(
            np.full(40_000, n), d, lambda dish, had: np.log(0.3 + 0.2 * had), rng)
        for t in range(1, n + 1):
            assert np.mean(found == t) == pytest.approx(
                weight[t] / sum(weight.values()), abs=0.012), (n, t)


def test_all_customers_of_large_dishes_move_and_keep_their_distribution():
    n, a, d, rng = 3000, 2.0, 0.3, np.random.default_rng(5)
    expected = math.exp(math.lgamma(a + n + d) + math.lgamma(a + 1) - math.lgamma(a + n)
                        - math.lgamma(a + d)) / d - a / d
    everyone = np.full(200, n)
    seats = pitman_yor.Seats(np.zeros(200, np.int64), np.zeros(0))
    seats.fill(everyone, lambda t: a + d * t, d, rng)
    assert seats.tables().mean() == pytest.approx(expected, rel=0.1)
    alone = pitman_yor.Seats(everyone, np.ones(200 * n))
    for found in (seats, alone):
        for _ in range(6):
            found.sweep(everyone, lambda t: a + d * t, d, rng)
        assert (found.customers() == n).all() and found.size.min() >= 1
    assert seats.tables().mean() == pytest.approx(expected, rel=0.1)
    assert alone.tables().mean() < n / 2
    seats.sweep(np.full(200, 50), lambda t: a + d * t, d, rng)
    assert (seats.customers() == 50).all() and seats.tables().min() >= 1


def test_every_sweep_uses_the_totals_of_that_sweep():
    texts = ["a b a b a c", "b a b a", "a b c a b", "c a c a"] * 4
    rows = pa.table({"_key": list(range(16)), "text": texts, "train": [True] * 16}).to_batches()
    part = pitman_yor._gather_part(pa.Table.from_batches(pitman_yor._count_pairs(1)(iter(rows))))
    row = part.drop_columns(["words"]).to_pylist()[0]
    inner = pitman_yor.Part(row)
    moving = np.unique(inner.context[inner.count > 1])
    base = inner.per_context(inner.count > 0)[moving]
    state = next(pitman_yor._begin(iter([pa.RecordBatch.from_pylist(
        [row | {"totals": [pitman_yor._wide(base)]}])])))
    model, roots = pitman_yor.Model(0.3, 0.2, 0.2), [int(sum(base)), 5]

    def swept(more):
        given = state.to_pylist()[0] | {"totals": [pitman_yor._wide(np.full(len(moving), more))]}
        schema = state.schema.append(pa.field("totals", pa.list_(pa.binary())))
        run = pitman_yor._sweep(model, roots, pitman_yor.Settings(), 3)
        return next(run(iter([pa.RecordBatch.from_pylist([given], schema)]))).to_pylist()[0]

    few, many = swept(0), swept(100_000)
    tables = [pitman_yor._read_wide(x["tables"]) for x in (few, many)]
    assert tables[1].sum() > 1.5 * tables[0].sum()  # tables elsewhere open more of them
    count = pitman_yor._read_wide(few["count"])
    assert all((x >= 1).all() and (x <= count).all() for x in tables)
    for x in (few, many):
        per_word = np.bincount(pitman_yor._planes(x["word"]), pitman_yor._read_wide(x["tables"]))
        in_root = pitman_yor._read_wide(x["in_root"])
        others = pitman_yor._planes(x["others"])
        assert in_root[:len(per_word)].tolist() == (per_word + others[:len(per_word)]).tolist()
        assert x["roots"][0] == in_root.sum() and len(x["kept"]) == 1


def test_language_model_leaves_shuffle_cleanup_as_it_was(spark):
    before = spark.conf.get(pitman_yor.CLEANUP, None)
    docs = spark.createDataFrame([(1, "a b"), (2, "b a")], "doc_id long, text string")
    found = pitman_yor.score_texts(docs, F.lit(False))
    assert found.count() == 2 and len(found.collect()) == 2
    assert spark.conf.get(pitman_yor.CLEANUP, None) == before


def test_language_model_of_odd_rows(odd, empty):
    rows = pitman_yor.score_texts(odd, F.col("doc_id") == 7).collect()
    assert len(rows) == len(ODD)
    of = Counter((r.doc_id, r.n_tokens) for r in rows)
    assert of[2, 61] == 2 and of[4, 1] == 1 and of[None, 6] == 1 and of[9, 30001] == 1
    assert pitman_yor.score_texts(empty, F.lit(False)).count() == 0


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    for _ in range(10):
        n = int(rng.integers(1, 200))
        odds, first = np.exp(rng.normal(-1, 2, n)), rng.random(n) < 0.1
        first[0] = True
        chain = rng.normal(0, 1, 4)
        start, ct, tc, tt = np.exp(chain)
        step = np.array([[1, ct], [tc, tt]])
        emit = np.stack([np.ones(n), odds], axis=1)
        ahead, behind = np.zeros((n, 2)), np.ones((n, 2))
        for t in range(n):
            ahead[t] = (np.array([1, start]) if first[t] else ahead[t - 1] @ step) * emit[t]
            ahead[t] /= ahead[t].sum()
        for t in range(n - 2, -1, -1):
            if not first[t + 1]:
                behind[t] = step @ (emit[t + 1] * behind[t + 1])
                behind[t] /= behind[t].sum()
        both = ahead * behind
        expected = (both / both.sum(axis=1, keepdims=True))[:, 1]
        assert np.allclose(expected, toxicity.marginals(odds, first, chain), atol=1e-9)


def test_toxic_documents_are_found_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held))
    found = toxicity.score_toxicity(docs, model).join(labels.where(held), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in found]) >= 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [texts[r.doc_id][s.start:s.end] for r in found for s in r.spans]
    assert spans and all(not re.search(r"\s", s) for s in spans)


def test_a_phrase_repeated_word_for_word_is_learned(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        said = [f"w{x}" for x in rng.integers(0, 800, 40)]
        if i % 4 == 0:
            said[20:25] = ["common", "vile", "nasty", "slur", "word"]
        rows.append((i, " ".join(said), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.where("doc_id < 1600"), table.where("doc_id < 1600"))
    found = toxicity.score_toxicity(table.where("doc_id >= 1600"), model).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found]
    assert len(right) == 400 and np.mean(right) >= 0.98


def test_near_copies_of_one_toxic_document_teach_no_common_words(spark):
    rng = np.random.default_rng(5)
    base = [f"b{x}" for x in range(60)]
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 800, 40)), 0) for i in range(900)]
    for i in range(900, 1050):
        near = list(base)
        near[int(rng.integers(60))] = f"w{rng.integers(0, 800)}"
        rows.append((i, " ".join(near), 1))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(toxicity.fit(table, table).feature) == 0


def _labelled_texts(n, length):
    rng = np.random.default_rng(6)
    said = rng.integers(0, 3000, (n, length)).astype(str).tolist()
    for i in range(0, n, 4):
        said[i][20:25] = ["common", "vile", "nasty", "slur", "word"]
    texts = pa.chunked_array([[" ".join(x) for x in said] + [None, "", " \n"]], pa.string())
    return texts, np.r_[np.arange(n) % 4 == 0, True, False, True].astype(int)


def test_learning_takes_a_small_multiple_of_the_texts():
    texts, toxic = _labelled_texts(3000, 300)
    toxicity.learn(*_labelled_texts(200, 100), toxicity.Settings(steps=1))  # tables made once
    tracemalloc.start()
    try:
        model = toxicity.learn(texts, toxic, toxicity.Settings(steps=2))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.feature) and most < 30 * texts.nbytes


def test_a_model_does_not_depend_on_blocks_and_ranges(monkeypatch):
    texts, toxic = _labelled_texts(900, 60)
    found = []
    for rows, ranges in ((512, 8), (7, 1), (2000, 64)):
        monkeypatch.setattr(packed, "slices", lambda b, n=rows, own=packed.slices: own(b, n))
        monkeypatch.setattr(toxicity, "RANGES", ranges)
        model = toxicity.learn(texts, toxic, toxicity.Settings(steps=5))
        monkeypatch.undo()
        found.append([x.tolist() for x in (model.feature, model.weight, model.chain)])
    assert found[0][0] and found[0] == found[1] == found[2]


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (None, 1), (5, None)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD)
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_pipeline_against_plain_decisions(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, sf)
    single = stage["ngram_jaccard_join"](spark, clean, sf)
    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    heads = {c for _, c in plain_components(pairs, 5, 8, 10).values()}
    assert {r.doc_id for r in single.collect()} == heads and single.columns == docs.columns
    mix = stage["mixing"](spark, single, sf)
    copies = {r.doc_id: r.copies for r in mixing.mixed_copies(single).collect() if r.copies}
    assert Counter(r.doc_id for r in mix.collect()) == Counter(copies)
    assert corpus_pipeline.run(spark, sf).count() == sum(copies.values())
