"""Toxic spans by a linear-chain conditional random field.

Tokens carry the features word, prefixes and suffixes. Documents are labelled, tokens are not:
a token of a toxic training document is labelled toxic if one of its features hardly occurs in
clean documents and occurs in so many unlike toxic ones that chance cannot explain it; near
copies of one document count as one. The two-state chain is trained on these
labels by its exact gradient. Scoring runs forward-backward over whole texts, many blocks of
tokens side by side; the marginals give the offending spans, and the largest is the score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import packed, words

BLOCK = 64
FILTER_BITS = 22
#: Kinds of features of a token: the word, prefixes of 3 to 6 and suffixes of 3 and 4 bytes.
KINDS = 7
#: Feature numbers are counted in this many ranges, one after the other (a power of two).
RANGES = 8
#: Orders of word triples by which near copies in the sample are told.
SKETCH = 4


@dataclass(frozen=True)
class Settings:
    """``toxic_rows`` and ``clean_rows`` bound the labelled rows that are learned from."""

    toxic_rows: int = 1500
    clean_rows: int = 4500
    fit_clean_rows: int = 1500
    max_features: int = 1 << 16
    purity: float = 0.97
    chance: float = 0.01
    steps: int = 40
    rate: float = 0.4
    ridge: float = 1e-5


def token_features(found: words.Words, kinds: Sequence[int] = range(KINDS)) -> list[np.ndarray]:
    """One array of feature numbers per kind: word, prefixes of 3 to 6 and suffixes of 3, 4 bytes."""
    s, e = found.start, found.end
    parts = [(s, e)]
    parts += [(s, np.minimum(s + k, e)) for k in (3, 4, 5, 6)]
    parts += [(np.maximum(e - k, s), e) for k in (3, 4)]
    numbers = words.hashes_within(found.data, s, e, [parts[kind] for kind in kinds])
    return [words.mix(n + np.uint64(kind * 7919 + 1)) for kind, n in zip(kinds, numbers, strict=True)]


def _scan(gain, stay, leave, enter, keep, fresh, begin):
    """x[t] = gain[t] * (stay x[t-1] + enter) / (leave x[t-1] + keep), and begin[t] where fresh.

    Blocks of tokens are first reduced to one fractional linear map each, side by side; the
    short chain over the blocks gives every block its entry value.
    """
    n = len(gain)
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n

    def shape(x, value):
        return np.concatenate([x, np.full(pad, value, dtype=x.dtype)]).reshape(blocks, BLOCK).T

    g, f = shape(gain, 1.0), shape(fresh, False)
    x0 = shape(begin, 0.0)
    a, b = np.ones(blocks), np.zeros(blocks)
    c, d = np.zeros(blocks), np.ones(blocks)
    for j in range(BLOCK):
        na, nb = g[j] * (stay * a + enter * c), g[j] * (stay * b + enter * d)
        nc, nd = leave * a + keep * c, leave * b + keep * d
        reset = f[j]
        a, b = np.where(reset, 0.0, na), np.where(reset, x0[j], nb)
        c, d = np.where(reset, 0.0, nc), np.where(reset, 1.0, nd)
        size = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / size, b / size, c / size, d / size
    entry, x = np.empty(blocks), 0.0
    for k, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(),
                                         strict=True)):
        entry[k] = x
        x = (p * x + q) / (r * x + s)
    out = np.empty((BLOCK, blocks))
    x = entry
    for j in range(BLOCK):
        x = np.where(f[j], x0[j], g[j] * (stay * x + enter) / (leave * x + keep))
        out[j] = x
    return out.T.reshape(-1)[:n]


def forward_backward(odds: np.ndarray, first: np.ndarray, chain: np.ndarray):
    """Odds of the toxic state given the past, and the ratio that the future adds, per token.

    ``odds`` are the emission odds, ``first`` marks the first token of each document and
    ``chain`` holds the weights start, clean-toxic, toxic-clean, toxic-toxic (clean-clean: 1).
    """
    start, ct, tc, tt = np.exp(chain)
    past = _scan(odds, tt, tc, ct, 1.0, first, odds * start)
    last = np.r_[first[1:], True] if len(first) else first
    ahead = np.r_[odds[1:], 1.0][::-1] if len(odds) else odds
    # backward: y[t] = (tc + tt * e[t+1] * y[t+1]) / (1 + ct * e[t+1] * y[t+1])
    z = _scan_back(ahead, tt, ct, tc, last[::-1])
    return past, z[::-1]


def _scan_back(ahead, tt, ct, tc, fresh):
    """The backward ratio; the emission acts on the value before it enters the map."""
    n = len(ahead)
    if not n:
        return np.zeros(0)
    # u[t] = ahead[t] * y[t+1]; y = (tc + tt u) / (1 + ct u)
    gain = np.r_[ahead[1:], 1.0]
    u = _scan(gain, tt, ct, tc, 1.0, fresh, gain)
    return u / gain


def marginals(odds: np.ndarray, first: np.ndarray, chain: np.ndarray) -> np.ndarray:
    if not len(odds):
        return np.zeros(0)
    past, future = forward_backward(odds, first, chain)
    both = past * future
    return both / (1 + both)


@dataclass
class Model:
    """Feature numbers in order with their weights, the bias and the chain weights."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float
    chain: np.ndarray
    share: float

    def __post_init__(self):
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[(self.feature & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature index) of the features of one kind that the model knows."""
        low = (numbers & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        at = np.flatnonzero(self.seen[low])
        slot = np.searchsorted(self.feature, numbers[at])
        slot = np.minimum(slot, len(self.feature) - 1)
        hit = self.feature[slot] == numbers[at]
        return at[hit], slot[hit]

    def columns(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature index) of all features that the model knows."""
        tokens, slots = zip(*map(self.hits, features), strict=True)
        return np.concatenate(tokens), np.concatenate(slots)

    def odds(self, features: list[np.ndarray]) -> np.ndarray:
        n = len(features[0])
        score = np.full(n, self.bias)
        if n and len(self.feature):
            token, slot = self.columns(features)
            score += np.bincount(token, weights=self.weight[slot], minlength=n)
        return np.exp(np.clip(score, -30, 30))


def _first_tokens(found: words.Words) -> np.ndarray:
    first = np.zeros(len(found.start), dtype=bool)
    begin = found.first[:-1][found.counts > 0]
    first[begin] = True
    return first


def _least_triples(found: words.Words) -> np.ndarray:
    """The least hash of word triples in each of ``SKETCH`` orders, per document with words."""
    number, row = found.numbers(), found.rows()
    ahead = [np.where(np.r_[row[j:], np.full(min(j, len(row)), -1)] == row,
                      np.r_[number[j:], np.zeros(min(j, len(row)), dtype=np.uint64)], np.uint64(0))
             for j in (1, 2)]
    triple = words.mix(words.mix(number) + ahead[0]) + ahead[1]
    begin = found.first[:-1][found.counts > 0]
    if not len(begin):
        return np.zeros((SKETCH, 0), dtype=np.uint64)
    return np.stack([np.minimum.reduceat(words.mix(triple + np.uint64(turn + 1)), begin)
                     for turn in range(SKETCH)])


def unlike_documents(blocks: list[words.Words]) -> np.ndarray:
    """A class per document; documents that share a least hash of word triples have the same one.

    There are ``SKETCH`` hash orders. Near copies share nearly all triples and so some least one;
    unlike documents with a short phrase in common seldom do. Works on the bounded sample only.
    """
    counts = np.concatenate([found.counts for found in blocks])
    parent = list(range(len(counts)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    full = np.flatnonzero(counts > 0)
    for least in np.concatenate([_least_triples(found) for found in blocks], axis=1):
        order = np.argsort(least, kind="stable")
        same = np.flatnonzero(least[order][1:] == least[order][:-1])
        for a, b in zip(full[order[same]].tolist(), full[order[same + 1]].tolist(), strict=True):
            parent[top(a)] = top(b)
    return np.array([top(x) for x in range(len(counts))], dtype=np.uint64)


def _telling(numbers: np.ndarray, row: np.ndarray, toxic: np.ndarray, source: np.ndarray,
             rate: float, s: Settings) -> np.ndarray:
    """The numbers of one kind that tell toxic documents, in order.

    ``row`` names the document of each number, ``toxic`` and ``source`` its label and class.
    Equal numbers lie in one range, so only a part of them is sorted at a time.
    """
    known, found, often = 0, [], []
    place = packed.place(numbers, RANGES).astype(np.uint8)
    for part in range(RANGES):
        at = np.flatnonzero(place == part)
        number, slot = np.unique(numbers[at], return_inverse=True)
        known += len(number)
        _, seen_at = np.unique(words.mix(numbers[at]) + source[row[at]], return_index=True)
        bad = toxic[row[at[seen_at]]]
        in_toxic = np.bincount(slot[seen_at[bad]], minlength=len(number))
        in_clean = np.bincount(slot[seen_at[~bad]], minlength=len(number))
        pure = (in_toxic >= 4) & (in_toxic >= s.purity * (in_toxic + in_clean))
        found.append(number[pure])
        often.append(in_toxic[pure])
    least = np.log(known * KINDS / s.chance) / -np.log(min(rate, 0.9))
    return np.concatenate(found)[np.concatenate(often) >= least]


def _expected(past: np.ndarray, future: np.ndarray, odds: np.ndarray, inner: np.ndarray,
              chain: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """The toxic marginal of each token, and the expected clean-toxic, toxic-clean and
    toxic-toxic steps. ``past`` and ``future`` are used up."""
    _, ct, tc, tt = np.exp(chain)
    p = past * future
    p /= 1 + p
    past[1:] = past[:-1]
    past[:1] = 0.0
    future *= odds
    on = past * tt
    on *= future
    into, back = np.multiply(future, ct, out=future), np.multiply(past, tc, out=past)
    total = 1 + into
    total += back
    total += on
    return p, [np.divide(x, total, out=x)[inner].sum() for x in (into, back, on)]


def learn(texts: pa.ChunkedArray, toxic: np.ndarray, s: Settings) -> Model:
    """Trains on the given documents; without both labels, or any cue, only the share remains.

    Texts are split in blocks of documents and features counted one kind after the other, so
    that the memory is a small multiple of the texts.
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    none = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, np.zeros(4), share)
    if not len(toxic) or toxic.all() or not toxic.any():
        return none
    toxic = toxic.astype(bool)
    blocks = [words.split(b.column(0), words.WORD_BYTES)
              for b in packed.slices(pa.table({"text": texts}).to_batches())]
    counts = np.concatenate([found.counts for found in blocks])
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    rate = max(float(toxic[row].mean()), 1e-6) if len(row) else 0.0
    if not counts[toxic].any():
        return none
    source = words.mix(unlike_documents(blocks) + np.uint64(1))
    edges = np.cumsum([0, *(len(found.start) for found in blocks)]).tolist()
    label = np.zeros(len(row), dtype=bool)
    numbers = np.empty(len(row), dtype=np.uint64)
    for kind in range(KINDS):
        for found, low, high in zip(blocks, edges, edges[1:], strict=False):
            numbers[low:high], = token_features(found, [kind])
        cues = Model(_telling(numbers, row, toxic, source, rate, s), np.zeros(0), 0.0, np.zeros(4),
                     share)
        if len(cues.feature):
            for low, high in zip(edges, edges[1:], strict=False):
                label[low:high][cues.hits(numbers[low:high])[0]] = True
    del numbers
    label &= toxic[row]
    if not label.any():
        return none

    order = np.random.Generator(np.random.PCG64(5)).permutation(np.flatnonzero(~toxic))
    fit = toxic.copy()
    fit[order[:s.fit_clean_rows]] = True
    use = fit[row]
    del row
    marked = [token_features(words.Words(found.data, found.start[at], found.end[at], found.first))
              for found, low, high in zip(blocks, edges, edges[1:], strict=False)
              if len(at := np.flatnonzero(label[low:high]))]
    chosen, count = np.unique(np.concatenate([f for features in marked for f in features]),
                              return_counts=True)
    chosen = chosen[count >= 2] if (count >= 2).any() else chosen
    count = count[count >= 2] if (count >= 2).any() else count
    if len(chosen) > s.max_features:
        chosen = np.sort(chosen[np.argsort(-count, kind="stable")[:s.max_features]])
    model = Model(chosen, np.zeros(len(chosen)), -4.0, np.array([0.0, 0.0, 0.0, 0.0]), share)
    hits, held = [[] for _ in range(KINDS)], 0
    for found, low, high in zip(blocks, edges, edges[1:], strict=False):
        at = np.flatnonzero(use[low:high])
        some = words.Words(found.data, found.start[at], found.end[at], found.first)
        for own, features in zip(hits, token_features(some), strict=True):
            token, slot = model.hits(features)
            own.append(((token + held).astype(np.int32), slot.astype(np.int32)))
        held += len(at)
    # of each kind the tokens and the features they have
    hits = [tuple(map(np.concatenate, zip(*own, strict=True))) for own in hits]
    first = np.concatenate([_first_tokens(found) for found in blocks])[use]
    del blocks
    label = label[use].astype(float)
    last_label = np.r_[0.0, label[:-1]]
    inner = ~first
    n, m = len(label), len(chosen)
    observed = np.zeros(m)
    for token, slot in hits:
        np.add.at(observed, slot, label[token])
    seen = [label[first].sum(), ((1 - last_label) * label)[inner].sum(),
            (last_label * (1 - label))[inner].sum(), (last_label * label)[inner].sum()]
    labelled = label.sum()
    del last_label, label, use
    theta = np.r_[model.weight, model.bias, model.chain]
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, s.steps + 1):
        odds = np.zeros(n)
        for token, slot in hits:
            np.add.at(odds, token, theta[slot])
        odds += theta[m]
        np.exp(np.clip(odds, -30, 30, out=odds), out=odds)
        p, steps = _expected(*forward_backward(odds, first, theta[m + 1:]), odds, inner,
                             theta[m + 1:])
        expected = np.zeros(m)
        for token, slot in hits:
            np.add.at(expected, slot, p[token])
        grad = np.r_[
            observed - expected - n * s.ridge * theta[:m],
            labelled - p.sum(), seen[0] - p[first].sum(),
            [had - has for had, has in zip(seen[1:], steps, strict=True)],
        ] / n
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta = theta + s.rate * (mean / (1 - 0.9 ** step)) / (
            np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
        theta[m + 1:] = np.clip(theta[m + 1:], -8, 8)
    return Model(chosen, theta[:m], float(theta[m]), theta[m + 1:], share)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most ``toxic_rows`` and ``clean_rows`` labelled rows, least hash first.

    ``labels`` has the columns id and toxic; several labels of one id count as the largest,
    NULL labels and ids do not count. The bounded sample is learned from in one task.
    """
    spark = packed.bounded_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("_id")
    ).agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = F.xxhash64("_id")
    ids = known.where("toxic = 1").orderBy(by_hash).limit(settings.toxic_rows).unionByName(
        known.where("toxic = 0").orderBy(by_hash).limit(settings.clean_rows)
    )
    text = docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.col(text_col).cast("string").alias("text"))
    sample = text.join(F.broadcast(ids), "_id").repartition(1).sortWithinPartitions("_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=pa.schema(
            [("text", pa.string()), ("toxic", pa.int32())]))
        model = learn(held["text"], held["toxic"].to_numpy().astype(int), settings)
        body = pickle.dumps((model.feature.tobytes(), model.weight.tobytes(), model.bias,
                             model.chain.tobytes(), model.share))
        yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["model"])

    made = sample.select("text", "toxic").mapInArrow(run, "model binary").collect()
    if not made:
        return learn(pa.chunked_array([], pa.string()), np.zeros(0, dtype=int), settings)
    feature, weight, bias, chain, share = pickle.loads(made[0][0])
    return Model(np.frombuffer(feature, np.uint64), np.frombuffer(weight), bias,
                 np.frombuffer(chain), share)


SCORES = pa.schema([
    ("_id", pa.int64()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                  ("score", pa.float64())]))),
])
SCORES_DDL = ("_id long, score double, "
              "spans array<struct<start:int,end:int,score:double>>")


def _score(state: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*state)
        for b in packed.slices(batches):
            found = words.split(b.column(1), words.WORD_BYTES)
            n = b.num_rows
            score, spans = np.full(n, model.share), [[] for _ in range(n)]
            if len(model.feature):
                p = marginals(model.odds(token_features(found)), _first_tokens(found), model.chain)
                held = found.counts > 0
                score = np.zeros(n)
                if held.any():
                    score[held] = np.maximum.reduceat(p, found.first[:-1][held])
                row = found.rows()
                hits = np.flatnonzero(p >= 0.5)
                _, begin = words.texts(b.column(1))
                for i in np.unique(row[hits]):
                    low = begin[i]
                    chars = np.cumsum((found.data[low:begin[i + 1]] & 0xC0) != 0x80)
                    for t in hits[row[hits] == i]:
                        a, z = found.start[t] - low, found.end[t] - low
                        spans[i].append({"start": int(chars[a]) - 1, "end": int(chars[z - 1]),
                                         "score": float(p[t])})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score), pa.array(spans, SCORES.field("spans").type)],
                schema=SCORES)

    return run


def score_toxicity(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score, spans): the largest token marginal, and the tokens at or above one half.

    Span positions count characters. Whole texts are read; a text without words, or NULL, has
    score 0. Without a usable model the score is the share of toxic training labels. Rows are
    independent: repeated rows score alike, an empty table gives an empty one.
    """
    packed.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.col(text_col).cast("string").alias("text"))
    state = (model.feature, model.weight, model.bias, model.chain, model.share)
    return rows.mapInArrow(_score(state), SCORES_DDL).withColumnRenamed("_id", id_col)


def _clean_only(state: tuple, at: int):
    score = _score(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packed.slices(batches):
            ids = pa.array(np.arange(b.num_rows))
            found = next(score([pa.RecordBatch.from_arrays([ids, b.column(at)], names=["i", "t"])]))
            yield b.filter(pa.array(found.column(1).to_numpy() < 0.5))

    return run


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns."""
    packed.bounded_batches(docs.sparkSession)
    state = (model.feature, model.weight, model.bias, model.chain, model.share)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(_clean_only(state, at), docs.schema)
