"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every context, the word before, is a restaurant of its own, and all of them send their new tables
as customers to one parent, the restaurant of single words over a uniform base. Texts are stored
once in batches. Pairs are counted per batch and merged by the word they end in, so what a part of
the vocabulary holds are distinct pairs, however often they occur.

Seatings are sampled by Gibbs: in each sweep every customer of every (context, word), and every
customer of the parent, leaves its table and sits down again. Up to ``LARGE`` customers of a dish
are seated together, from the exact conditional over their number of tables; of larger dishes a
share is seated at a time. Pairs that occur once have one table in every seating. Parts of the
vocabulary sweep side by side; the tables of all contexts are added up by a shuffle before each
sweep, and within a part they follow every group of moves. After burn-in some seatings are kept,
each with its own exact totals, and the probability of a token is the mean over them. Moves depend
on the seed, the sweep and the part alone, so a part that is computed again gives the same seatings.

A batch gets back the counts and tables of its own pairs, words and contexts, which are small
numbers, and its texts are scored from their (document, pair, count) entries.

Numbers are packed and compressed before they leave Python: a row holds those of a whole part or
batch, and Spark, which copies and sorts rows as they are, moves a fraction of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import packed, words
from triagelake.session import delete_path, new_path

END = words.number_of(b"\n")
#: Bytes of text whose pairs are counted together; bounds the memory of a task.
BATCH_BYTES = 6 << 20
#: The context of a first word; it comes after all words.
BEGIN = (1 << 64) - 1

#: Bytes of text for each part of the vocabulary, and parts for each bucket of contexts. Their
#: numbers follow the text and not the session, so a task's share and all scores are the same
#: with any number of partitions.
PART_BYTES = 8 << 20
PARTS_A_BUCKET = 4
#: Packed numbers of fewer bytes are left to Spark's own compression, which sees many rows at once.
LEAST_PRESSED = 4 << 10
#: Dishes with more customers are seated in shares of one in ``SHARES``.
LARGE = 512
SHARES = 16
#: The dishes of a context move in so many groups, one after the other.
GROUPS = 4


@dataclass(frozen=True)
class Settings:
    burn_in: int = 3
    samples: int = 3
    strength: float = 0.5
    root_strength: float = 1.0
    seed: int = 11


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
             "boolean": pa.bool_(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(x) for k, x in list(kinds.items())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


BATCHES_DDL = "batch long, _key array<long>, train array<boolean>, text array<string>"
BATCHES = _schema(BATCHES_DDL)
#: Pairs by word: the words, how many pairs each has, the contexts, and the context of each pair.
BY_WORD = "words binary, per_word binary, contexts binary, context binary"
PAIRS_DDL = f"batch long, part int, {BY_WORD}, count binary"
PAIRS = _schema(PAIRS_DDL)
SCALARS = ("tokens", "seen", "once", "twice", "word_once", "word_twice", "begun", "begun_pairs")
#: The places of the words and pairs that each batch holds are kept as steps.
PART_DDL = (f"part int, {BY_WORD}, count binary, batches array<long>, batch_words array<binary>, "
            "batch_pairs array<binary>, " + ", ".join(f"{x} long" for x in SCALARS))
PART = _schema(PART_DDL)
#: Dishes that can move, pairs with several customers: word, context, customers; then the parent's
#: customers from all other pairs per word, and which words have a large dish there; the state of
#: the sampling; kept samples; sums over the part for the driver.
STATE_DDL = ("part int, word binary, contexts binary, context binary, count binary, "
             "others binary, many binary, base binary, tables binary, sizes binary, "
             "in_root binary, seated binary, root_sizes binary, kept array<binary>, "
             "kept_in_root array<binary>, kept_seated array<binary>, roots array<long>")
STATE = _schema(STATE_DDL)
TOTALS_DDL = "part int, bucket int, contexts binary, wanted binary, body binary"
TOTALS = _schema(TOTALS_DDL)
#: For the pairs and words of a batch in one part: counts of pairs and words, customers of
#: contexts, and for each sample tables of pairs, the parent's customers and tables, and tables of
#: contexts.
ANSWERS_DDL = ("batch long, part int, count binary, word_count binary, customers binary, "
               "tables binary, in_root binary, seated binary, context_tables binary")
ANSWERS = _schema(ANSWERS_DDL)
ENTRIES_DDL = ("batch long, keys array<long>, train array<boolean>, word binary, context binary, "
               "holds binary, doc binary, count binary, parts binary")
ENTRIES = _schema(ENTRIES_DDL)
RESULT_DDL = ("_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
              "score double")
RESULT = _schema(RESULT_DDL)


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all rows, each row closed by the end token, and the row lengths."""
    found = words.split(column)
    counts = found.counts + 1
    ends = np.cumsum(counts) - 1
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = found.numbers()
    out[ends] = END
    return out, counts


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Numbers of the distinct tokens in order and of BEGIN, then for each token its place among
    them and that of its context, then the row lengths."""
    token, length = sequences(column)
    known, slot = np.unique(token, return_inverse=True)
    before = np.empty(len(slot), dtype=np.int64)
    before[1:] = slot[:-1]
    before[np.cumsum(length) - length] = len(known)
    return np.r_[known, np.uint64(BEGIN)], slot, before, length


def _by_word(numbers: np.ndarray, word: np.ndarray, context: np.ndarray) -> dict[str, bytes]:
    """The packed columns of ``BY_WORD``; pairs are sorted by word."""
    at, per_word = packed.runs(word)
    own, index = np.unique(context, return_inverse=True)
    return {"words": _number_steps(numbers[word[at]]), "per_word": _small(per_word),
            "contexts": _number_steps(numbers[own]), "context": _small(index)}


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each batch of texts, so that every later pass sees the same batches."""
    task = TaskContext.get().partitionId() << 32
    for at, rows in enumerate(packed.gathered(batches, BATCH_BYTES)):
        row = {"batch": [task + at]} | {
            x: pa.array([rows[x].to_pylist()], BATCHES.field(x).type)
            for x in ("_key", "train", "text")}
        yield packed.batch(row, BATCHES)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Number and rows of each batch, as stored, or gathered from single rows."""
    names = ["_key", "train", "text"]

    def stored():
        for b in batches:
            if "batch" not in b.schema.names:
                yield from enumerate(packed.gathered([b], BATCH_BYTES))
                continue
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                yield row["batch"][0].as_py(), pa.table(
                    {x: pa.chunked_array([row[x].flatten()]) for x in names})

    return ((n, rows) for n, rows in stored() if rows.num_rows)


def _add_row(out: dict[str, list], **columns) -> None:
    for name, value in columns.items():
        out[name].append(value)


def _pressed(data: bytes) -> bytes:
    """``data`` compressed, after its size; what is short or does not shrink stays as it is."""
    found = data
    if len(data) >= LEAST_PRESSED:
        found = min(pa.compress(data, codec="zstd", asbytes=True), data, key=len)
    return len(data).to_bytes(8, "little") + found


def _size(data: bytes) -> int:
    return int.from_bytes(data[:8], "little")


def _opened(data: bytes) -> bytes:
    size, body = _size(data), memoryview(data)[8:]
    return body if len(body) == size else pa.decompress(body, size, codec="zstd", asbytes=True)


def _sizes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """How many numbers of ``width`` bytes each row of a pressed column has."""
    return np.array([_size(x) // width for x in column.to_pylist()], dtype=np.int64)


def _small(numbers: np.ndarray) -> bytes:
    """Numbers of up to 32 bits."""
    return _pressed(packed.planes(numbers))


def _planes(data: bytes) -> np.ndarray:
    return packed.read_planes(pa.array([_opened(data)], pa.binary())).astype(np.int64)


def _all_planes(column: pa.ChunkedArray) -> np.ndarray:
    """All numbers of a column of ``_small``, row after row."""
    return np.concatenate([np.zeros(0, dtype=np.int64), *map(_planes, column.to_pylist())])


def _steps(places: np.ndarray) -> bytes:
    """Rising places, packed as the steps between them."""
    return _small(np.diff(places, prepend=0))


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(_planes(data))


def _flags(values: np.ndarray) -> bytes:
    return _pressed(values.astype("u1").tobytes())


def _read_flags(data: bytes) -> np.ndarray:
    return np.frombuffer(_opened(data), "u1") > 0


def _number_steps(numbers: np.ndarray) -> bytes:
    """Rising 64-bit numbers, packed as the steps between them."""
    return _wide(np.diff(numbers, prepend=np.uint64(0)).view("<i8"))


def _numbers(data: bytes) -> np.ndarray:
    return np.cumsum(_read_wide(data).view("<u8"))


def _all_numbers(column: pa.ChunkedArray) -> np.ndarray:
    """All numbers of a column of ``_number_steps``, row after row."""
    return np.concatenate([np.zeros(0, dtype="<u8"), *map(_numbers, column.to_pylist())])


def _count_pairs(parts: int):
    """The pairs of each batch, with how often they occur in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _batches(batches):
            numbers, slot, before, length = _coded(rows["text"])
            train = np.repeat(rows["train"].to_numpy(), length)
            slot *= len(numbers)
            slot += before
            del before
            pair, at = np.unique(slot, return_inverse=True)
            count = np.bincount(at, weights=train, minlength=len(pair)).astype(np.int64)
            word, context = np.divmod(pair, len(numbers))
            part = packed.place(numbers, parts)[word]
            out: dict[str, list] = {f.name: [] for f in PAIRS}
            for a, n in zip(*packed.runs(part), strict=True):
                _add_row(out, batch=batch, part=int(part[a]), count=_small(count[a:a + n]),
                         **_by_word(numbers, word[a:a + n], context[a:a + n]))
            yield packed.batch(out, PAIRS)

    return run


def _gather_part(table: pa.Table) -> pa.Table:
    """One row for the whole part: its distinct pairs with their training counts, and which of
    its words and pairs each batch holds."""
    vocabulary, own = np.unique(_all_numbers(table["words"]), return_inverse=True)
    word = np.repeat(own, _all_planes(table["per_word"]))
    contexts, of = np.unique(_all_numbers(table["contexts"]), return_inverse=True)
    held, size = _sizes(table["contexts"], 8), _sizes(table["context"], 4)
    index = _all_planes(table["context"])
    context = of[index + np.repeat(np.cumsum(held) - held, size)]
    pair, at = np.unique(word * len(contexts) + context, return_inverse=True)
    count = np.bincount(at, weights=_all_planes(table["count"]),
                        minlength=len(pair)).astype(np.int64)
    word, context = np.divmod(pair, len(contexts))
    _, per_word = packed.runs(word)
    spread = np.bincount(word[count > 0], minlength=len(vocabulary))
    first = contexts[context] == BEGIN
    in_words = np.cumsum(_sizes(table["words"], 8))[:-1]
    in_pairs = np.cumsum(size)[:-1]
    row = {
        "part": table["part"][0].as_py(), "words": _number_steps(vocabulary),
        "per_word": _small(per_word), "contexts": _number_steps(contexts),
        "context": _small(context), "count": _wide(count),
        "batches": table["batch"].to_pylist(),
        "batch_words": [_steps(x) for x in np.split(own, in_words)],
        "batch_pairs": [_steps(x) for x in np.split(at, in_pairs)],
        "tokens": int(count.sum()), "seen": int((spread > 0).sum()),
        "once": int((count == 1).sum()), "twice": int((count == 2).sum()),
        "word_once": int((spread == 1).sum()), "word_twice": int((spread == 2).sum()),
        "begun": int(count[first].sum()), "begun_pairs": int((count[first] > 0).sum()),
    }
    return pa.Table.from_pylist([row], schema=PART)


def _wide(numbers: np.ndarray) -> bytes:
    """Whole 64-bit numbers by place, so that small ones compress well."""
    return _pressed(np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _read_wide(data: bytes) -> np.ndarray:
    return np.array(
        np.frombuffer(_opened(data), np.uint8).reshape(8, -1).T, order="C").view("<i8").ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(b.num_rows):
            yield b.slice(at, 1).to_pylist()[0]


@cache
def _ways(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the weight of c customers at t tables."""
    out = np.full((LARGE + 1, LARGE + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, LARGE + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, LARGE):
            joins = np.log(np.maximum(c - discount * t, 0.0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + joins)
    return out


def draw_tables(
    customers: np.ndarray, discount: float, weight, rng: np.random.Generator
) -> np.ndarray:
    """Numbers of tables of dishes whose customers all sit down again together.

    ``weight`` gives the odds, as a logarithm, of a further table of a dish that has so many
    tables; it is called with dishes and tables.
    """
    if not len(customers):
        return np.zeros(0, dtype=np.int64)
    start = np.cumsum(customers) - customers
    dish = np.repeat(np.arange(len(customers)), customers)
    had = np.arange(len(dish)) - start[dish]
    odds = np.cumsum(weight(dish, had))
    odds -= np.r_[0.0, odds][start][dish]
    odds += _ways(discount)[customers[dish], had + 1]
    odds = np.exp(odds - np.maximum.reduceat(odds, start)[dish])
    total = np.cumsum(odds)
    low, high = np.r_[0.0, total][start], total[start + customers - 1]
    at = np.searchsorted(total, low + rng.random(len(start)) * (high - low), "right")
    return np.clip(at - start, 0, customers - 1) + 1


class Seats:
    """Table sizes of many large dishes: ``owner`` is the dish of a table, in order."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray):
        self.owner = np.repeat(np.arange(len(tables)), tables)
        self.size, self.dishes = sizes.astype(np.int64), len(tables)

    def tables(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.dishes)

    def customers(self) -> np.ndarray:
        return np.bincount(self.owner, self.size, minlength=self.dishes).astype(np.int64)

    def _leave(self, share: np.ndarray, rng: np.random.Generator) -> None:
        self.size -= rng.binomial(self.size, share[self.owner])
        stay = self.size > 0
        self.owner, self.size = self.owner[stay], self.size[stay]

    def _seat(self, free: np.ndarray, opening, discount: float, rng) -> None:
        """So many customers of each dish sit down."""
        seated, tables = self.customers(), self.tables()
        new = np.maximum(opening(tables), 0.0)
        old = seated - discount * tables
        opens = rng.binomial(free, new / (new + old + 1e-300))
        opens = np.where(tables > 0, opens, np.minimum(free, 1))
        joins = np.repeat(np.arange(self.dishes), np.where(tables > 0, free - opens, 0))
        weight = np.r_[0.0, np.cumsum(self.size - discount)]
        first = np.searchsorted(self.owner, np.arange(self.dishes + 1))
        low, high = weight[first[joins]], weight[first[joins + 1]]
        seat = np.searchsorted(weight, low + rng.random(len(joins)) * (high - low), "right") - 1
        seat = np.clip(seat, first[joins], first[joins + 1] - 1)
        self.size += np.bincount(seat, minlength=len(self.size))
        fresh = np.repeat(np.arange(self.dishes), opens)
        size = np.ones(len(fresh), dtype=np.int64)
        alone = np.flatnonzero((tables == 0) & (free > 0))  # nobody is there to join
        size[np.searchsorted(fresh, alone)] = free[alone]
        owner = np.r_[self.owner, fresh]
        order = np.argsort(owner, kind="stable")
        self.owner, self.size = owner[order], np.r_[self.size, size][order]

    def fill(self, customers: np.ndarray, opening, discount: float, rng) -> None:
        """The customers come in one after the other, later ones a share at a time."""
        most, inside = int(customers.max(initial=0)), 0
        while inside < most:
            inside += max(1, inside // SHARES)
            self._seat(np.minimum(customers, inside) - self.customers(), opening, discount, rng)

    def sweep(self, customers: np.ndarray, opening, discount: float, rng) -> None:
        """All customers, a share at a time, leave and sit down again; then they are as many as
        ``customers``. ``opening`` gives the weight of a new table for numbers of tables."""
        for _ in range(SHARES if self.dishes else 0):
            self._leave(np.full(self.dishes, 1 / SHARES), rng)
            while (over := self.customers() > customers).any():
                self._leave(np.where(over, 1 / SHARES, 0.0), rng)
            self._seat(customers - self.customers(), opening, discount, rng)


@dataclass(frozen=True)
class Model:
    discount: float
    root_discount: float
    base: float


class Part:
    """The pairs of one part of the vocabulary, ordered by word, then by context."""

    def __init__(self, row: dict):
        self.number = row["part"]
        per_word = _planes(row["per_word"])
        self.word = np.repeat(np.arange(len(per_word)), per_word)
        self.context = _planes(row["context"])
        self.count = _read_wide(row["count"])
        self.numbers = _numbers(row["contexts"])
        self.words, self.contexts = len(per_word), len(self.numbers)

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=self.contexts).astype(np.int64)


def _to_buckets(
    part: int, numbers: np.ndarray, wanted: np.ndarray, values: list[np.ndarray], buckets: int
) -> pa.RecordBatch:
    """Values per context, packed by the bucket of the context."""
    body = np.stack(values, axis=1)
    out: dict[str, list] = {f.name: [] for f in TOTALS}
    place = packed.place(numbers, buckets)
    for a, n in zip(*packed.runs(place), strict=True):
        _add_row(out, part=part, bucket=int(place[a]), contexts=_number_steps(numbers[a:a + n]),
                 wanted=_flags(wanted[a:a + n]), body=_wide(body[a:a + n].ravel()))
    return packed.batch(out, TOTALS)


def _totals(table: pa.Table, width: int) -> pa.Table:
    """Adds up the contexts of one bucket and answers every part in the order it asked."""
    _, of = np.unique(_all_numbers(table["contexts"]), return_inverse=True)
    body = np.concatenate([_read_wide(x) for x in table["body"].to_pylist()]).reshape(-1, width)
    total = np.stack([np.bincount(of, weights=body[:, j])[of] for j in range(width)], axis=1)
    ends = np.cumsum(_sizes(table["contexts"], 8))
    wanted = np.concatenate([_read_flags(x) for x in table["wanted"].to_pylist()])
    answers = [_wide(x[w].astype(np.int64).ravel()) for x, w in zip(
        np.split(total, ends[:-1]), np.split(wanted, ends[:-1]), strict=True)]
    return table.select(["part", "bucket"]).append_column("body", pa.array(answers, pa.binary()))


def _with_totals(parts: DataFrame, ask, width: int) -> DataFrame:
    """``parts`` and, per context that ``ask`` wants, its sums over all parts."""
    asked = parts.mapInArrow(ask, TOTALS_DDL)
    answers = asked.groupBy("bucket").applyInArrow(
        lambda table: _totals(table, width), "part int, bucket int, body binary")
    # buckets are in the order of the numbers, as are the contexts of a part
    whole = answers.groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "body"))).alias("totals"))
    return parts.join(whole.select("part", F.col("totals.body").alias("totals")), "part", "left")


def _sums(row: dict, width: int) -> np.ndarray:
    found = [_read_wide(x) for x in row["totals"] or []]
    return np.concatenate([np.zeros(0, np.int64), *found]).reshape(-1, width)


def _ask_pairs(buckets: int):
    """Pairs per context, wanted for those with a dish that can move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            part = Part(row)
            yield _to_buckets(part.number, part.numbers, part.per_context(part.count > 1) > 0,
                              [part.per_context(part.count > 0)], buckets)

    return run


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before the first sweep: one table for each dish; large ones are filled in it."""
    for row in _rows(batches):
        part = Part(row)
        move = np.flatnonzero(part.count > 1)
        own, context = np.unique(part.context[move], return_inverse=True)
        pairs = np.bincount(part.word[part.count > 0], minlength=part.words)
        total = np.bincount(part.word, weights=part.count, minlength=part.words)
        many = total > LARGE  # no more customers can come to the parent
        one = np.ones(len(move), dtype=np.int64)
        count = part.count[move]
        yield pa.RecordBatch.from_pylist([{
            "part": part.number, "word": _small(part.word[move]),
            "contexts": _number_steps(part.numbers[own]), "context": _small(context),
            "count": _wide(count), "many": _flags(many),
            "others": _small(np.bincount(part.word[part.count == 1], minlength=part.words)),
            "base": _wide(_sums(row, 1)[:, 0]), "tables": _wide(one),
            "sizes": _wide(one[:0]), "in_root": _wide(pairs),
            "seated": _wide((pairs > 0).astype(np.int64)), "root_sizes": _wide(one[:0]),
            "kept": [], "kept_in_root": [], "kept_seated": [],
            "roots": [int(pairs.sum()), int((pairs > 0).sum())],
        }], schema=STATE)


def _ask_more(buckets: int):
    """Tables per context beyond one for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            numbers = _numbers(row["contexts"])
            more = np.bincount(_planes(row["context"]), _read_wide(row["tables"]) - 1,
                               minlength=len(numbers)).astype(np.int64)
            yield _to_buckets(row["part"], numbers, np.ones(len(numbers)), [more], buckets)

    return run


def _groups(context: np.ndarray) -> np.ndarray:
    """Deals the dishes of each context to the groups in turn."""
    order = np.argsort(context, kind="stable")
    start, n = packed.runs(context[order])
    out = np.empty(len(context), dtype=np.int64)
    out[order] = (np.arange(len(context)) - np.repeat(start, n)) % GROUPS
    return out


def _sweep(model: Model, roots: list[int], s: Settings, turn: int):
    """Every customer of a part, then every customer of its words in the parent, moves once."""
    m = model

    def pairs(row: dict, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, bytes]:
        word, context = _planes(row["word"]), _planes(row["context"])
        count, tables = _read_wide(row["count"]), _read_wide(row["tables"])
        in_root, seated = _read_wide(row["in_root"]), _read_wide(row["seated"])
        of_context = _read_wide(row["base"]) + _sums(row, 1)[:, 0]
        root_customers = roots[0]
        new_dish = (s.root_strength + m.root_discount * roots[1]) * m.base
        large = np.flatnonzero(count > LARGE)
        seats = Seats(tables[large] if turn else 0 * large, _read_wide(row["sizes"]))

        def parent(held, tables):
            return held - m.root_discount * np.maximum(
                np.minimum(tables, held), held > 0) + new_dish

        def settle(at, after):
            nonlocal root_customers
            change = after - tables[at]
            of_context[:] += np.bincount(
                context[at], change, minlength=len(of_context)).astype(np.int64)
            in_root[:] += np.bincount(word[at], change, minlength=len(in_root)).astype(np.int64)
            root_customers += int(change.sum())
            tables[at] = after

        group = _groups(context)
        for g in range(GROUPS):
            at = np.flatnonzero((group == g) & (count <= LARGE))
            without = of_context[context[at]] - tables[at]
            held = in_root[word[at]] - tables[at]
            rest, sat = root_customers - tables[at], seated[word[at]]

            def weight(dish, had, without=without, held=held, rest=rest, sat=sat):
                return np.log((s.strength + m.discount * (without[dish] + had))
                              * parent(held[dish] + had, sat[dish])
                              / (s.root_strength + rest[dish] + had))

            settle(at, draw_tables(count[at], m.discount, weight, rng))

        others = of_context[context[large]] - tables[large]
        held = in_root[word[large]] - tables[large]
        sat = seated[word[large]]

        def opening(t):
            return (s.strength + m.discount * (others + t)) * parent(held + t, sat) / (
                s.root_strength + root_customers)

        if not turn:
            seats.fill(count[large], opening, m.discount, rng)
        seats.sweep(count[large], opening, m.discount, rng)
        settle(large, seats.tables())
        return tables, in_root, _wide(seats.size)

    def root(row: dict, in_root: np.ndarray, rng) -> tuple[np.ndarray, bytes]:
        seated, many = _read_wide(row["seated"]), _read_flags(row["many"])
        seats = Seats(seated[many] if turn else 0 * seated[many], _read_wide(row["root_sizes"]))
        all_tables = roots[1]
        few = np.flatnonzero(~many & (in_root > 0))
        without = all_tables - seated[few]
        after = draw_tables(
            in_root[few], m.root_discount, lambda dish, had: np.log(
                (s.root_strength + m.root_discount * (without[dish] + had)) * m.base), rng)
        all_tables += int((after - seated[few]).sum())
        seated[few] = after
        others = all_tables - seated[many]

        def opening(t):
            return (s.root_strength + m.root_discount * (others + t)) * m.base

        if not turn:
            seats.fill(in_root[many], opening, m.root_discount, rng)
        seats.sweep(in_root[many], opening, m.root_discount, rng)
        seated[many] = seats.tables()
        return seated, _wide(seats.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            rng = np.random.Generator(np.random.PCG64([s.seed, turn, row["part"]]))
            tables, in_root, sizes = pairs(row, rng)
            seated, root_sizes = root(row, in_root, rng)
            kept = {"kept": tables, "kept_in_root": in_root, "kept_seated": seated}
            if turn >= s.burn_in:
                row |= {k: [*row[k], _small(x)] for k, x in kept.items()}
            begun = _numbers(row["contexts"])[_planes(row["context"])] == BEGIN
            row |= {"tables": _wide(tables), "sizes": sizes, "in_root": _wide(in_root),
                    "seated": _wide(seated), "root_sizes": root_sizes,
                    "roots": [int(in_root.sum()), int(seated.sum()),
                              int((tables[begun] - 1).sum())]}
            yield pa.RecordBatch.from_pylist(
                [{f.name: row[f.name] for f in STATE}], schema=STATE)

    return run


def _customers(parts: int, samples: int):
    """Customers and pairs per context, to the part that has the context as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            part = Part(row)
            none = np.zeros(part.contexts, dtype=np.int64)
            pairs = part.per_context(part.count > 0)
            yield _to_buckets(part.number, part.numbers, none,
                              [part.per_context(part.count), *[pairs] * samples], parts)

    return run


def _kept_tables(parts: int):
    """Tables per context beyond one for each pair, in every kept sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            numbers, context = _numbers(row["contexts"]), _planes(row["context"])
            none = np.zeros(len(numbers), dtype=np.int64)
            more = [np.bincount(context, _planes(x) - 1, minlength=len(numbers)).astype(np.int64)
                    for x in row["kept"]]
            yield _to_buckets(row["part"], numbers, none, [none, *more], parts)

    return run


def _add_contexts(table: pa.Table, width: int) -> pa.Table:
    numbers, of = np.unique(_all_numbers(table["contexts"]), return_inverse=True)
    body = np.concatenate([_read_wide(x) for x in table["body"].to_pylist()]).reshape(-1, width)
    total = np.stack([np.bincount(of, weights=body[:, j]) for j in range(width)])
    return pa.table({
        "part": pa.array([table["bucket"][0].as_py()], pa.int32()),
        "own": pa.array([_number_steps(numbers)], pa.binary()),
        "own_totals": pa.array([_wide(total.astype(np.int64).ravel())], pa.binary())})


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each batch needs to score the pairs it holds of a part."""
    for row in _rows(batches):
        vocabulary, per_word = _numbers(row["words"]), _planes(row["per_word"])
        count = _read_wide(row["count"])
        word = np.repeat(np.arange(len(vocabulary)), per_word)
        of_word = np.bincount(word, count, minlength=len(vocabulary)).astype(np.int64)
        move = np.flatnonzero(count > 1)
        samples = len(row["kept"])
        tables = np.tile((count > 0).astype(np.uint32), (samples, 1))
        for at, kept in enumerate(row["kept"]):
            tables[at, move] = _planes(kept)
        in_root, seated = (np.stack([_planes(x) for x in row[k]])
                           for k in ("kept_in_root", "kept_seated"))
        totals = np.zeros((1 + samples, len(vocabulary)), dtype=np.int64)
        if row["own"] is not None:
            own = _numbers(row["own"])
            _, here, there = np.intersect1d(
                vocabulary, own, assume_unique=True, return_indices=True)
            totals[:, here] = _read_wide(row["own_totals"]).reshape(1 + samples, -1)[:, there]
        for batch, of, at in zip(row["batches"], row["batch_words"], row["batch_pairs"],
                                 strict=True):
            of, at = _places(of), _places(at)
            yield packed.batch({k: [x] for k, x in {
                "batch": batch, "part": row["part"], "count": _wide(count[at]),
                "word_count": _wide(of_word[of]), "customers": _wide(totals[0, of]),
                **{name: _small(x.ravel()) for name, x in (
                    ("tables", tables[:, at]), ("in_root", in_root[:, of]),
                    ("seated", seated[:, of]), ("context_tables", totals[1:, of]))},
            }.items()}, ANSWERS)


def _entries(parts: int):
    """Per batch: its pairs, and for each of them the documents that hold it, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _batches(batches):
            numbers, slot, before, length = _coded(rows["text"])
            docs = len(length)
            pair, at = np.unique(slot * len(numbers) + before, return_inverse=True)
            entry, count = np.unique(at * docs + np.repeat(np.arange(docs), length),
                                     return_counts=True)
            at, doc = np.divmod(entry, docs)
            word, context = np.divmod(pair, len(numbers))
            _, per_word = packed.runs(word)
            yield packed.batch({k: [x] for k, x in {
                "batch": batch, "keys": rows["_key"].to_pylist(),
                "train": rows["train"].to_pylist(), "word": _small(per_word),
                "context": _small(context),
                "holds": _small(np.bincount(at, minlength=len(pair))),
                "doc": _small(doc), "count": _small(count),
                "parts": _steps(np.unique(packed.place(numbers[:-1], parts))),
            }.items()}, ENTRIES)

    return run


def _score(model: Model, s: Settings, roots: list, begun: tuple, n: int, v: int):
    """The documents of a batch from its entries and the answers of all its parts."""
    m = model

    def run(entries: pa.Table, answers: pa.Table) -> pa.Table:
        row, found = entries.to_pylist()[0], answers.sort_by("part")
        if found["part"].to_pylist() != _places(row["parts"]).tolist():
            raise RuntimeError("the answers of a batch are not those of its parts")

        def joined(name):
            return np.concatenate(
                [_planes(x).reshape(s.samples, -1) for x in found[name].to_pylist()], axis=1)

        count, of_word, customers = (
            np.concatenate([_read_wide(x) for x in found[name].to_pylist()])
            for name in ("count", "word_count", "customers"))
        customers = np.r_[customers, begun[0]]  # the context of first words is the last
        per_word, context = _planes(row["word"]), _planes(row["context"])
        word = np.repeat(np.arange(len(per_word)), per_word)
        mean = np.zeros(len(count))
        for tables, in_root, seated, context_tables, root, first in zip(
                *(joined(x) for x in ("tables", "in_root", "seated", "context_tables")),
                roots, begun[1], strict=True):
            parent = (in_root - m.root_discount * seated
                      + (s.root_strength + m.root_discount * root[1]) * m.base
                      ) / (s.root_strength + root[0])
            opening = s.strength + m.discount * np.r_[context_tables, first]
            mean += (count - m.discount * tables + opening[context] * parent[word]
                     ) / (s.strength + customers[context])
        score = np.log10(mean / s.samples)
        base = np.log10((of_word + 1) / (n + 1 * (v + 1)))[word]
        holds, doc, times = (_planes(row[x]) for x in ("holds", "doc", "count"))

        def total(values):
            return np.bincount(doc, np.repeat(values, holds) * times, minlength=len(row["keys"]))

        return pa.Table.from_arrays([
            pa.array(row["keys"], pa.int64()), pa.array([not x for x in row["train"]], pa.bool_()),
            *(pa.array(total(x).astype(np.int64)) for x in (
                np.ones(len(count)), (of_word > 0).astype(float)[word])),
            pa.array(total(base)), pa.array(total(score))], schema=RESULT)

    return run


#: Bytes that a task holds back while it stores rows, or reads them. Parquet looks at them after
#: some hundred rows only, so rows of megabytes have a limit of their own.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 2
FILES = {
    "compression": "zstd", "parquet.block.size": str(BLOCK_BYTES),
    "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false",
}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: While rows are stored, large ones reach a Python function alone.
STORING = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that ends inside are removed with it: what it gave is stored."""
    before = {key: spark.conf.get(key, None) for key in STORING}
    for key, value in STORING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _stored(df: DataFrame, label: str, rows: int = BLOCK_ROWS) -> tuple[DataFrame, str]:
    """Writes ``df`` with at most so many rows in a row group, and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _released(spark):
        df.write.options(**FILES).option("parquet.block.row.count.limit", str(rows)).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def score_texts(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a condition on ``docs``; rows for which it is not true are learned from,
    all of them whole. Tokens are lower-cased words and one end token per text; NULL text has
    the end token only. ``score`` is the log10 probability of the tokens, ``base_score`` that of
    smoothed single words. Repeated rows count, and are scored, each for itself; so are rows
    with a NULL id. An empty table gives an empty one.
    """
    spark = packed.bounded_batches(docs.sparkSession)
    s = settings
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))
    buckets = max(1, parts // PARTS_A_BUCKET)
    fed = docs.select(
        F.col(id_col).cast("long").alias("_key"), F.col(text_col).cast("string").alias("text"),
        (~F.coalesce(held_out, F.lit(False))).alias("train"),
    )
    texts, _ = _stored(fed.mapInArrow(_store, BATCHES_DDL), "texts")
    stored, parts_path = _stored(
        texts.mapInArrow(_count_pairs(parts), PAIRS_DDL).groupBy("part").applyInArrow(
            _gather_part, PART_DDL), "parts")
    sums = stored.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in SCALARS]).first()
    if not sums[0]:
        return fed.select(F.col("_key").alias(id_col), (~F.col("train")).alias("held_out"), *[
            F.lit(0).cast(t).alias(c) for c, t in (
                ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"),
                ("base_score", "double"), ("score", "double"))])
    n, v, once, twice, word_once, word_twice, begun, begun_pairs = sums[1:]
    model = Model(
        discount=once / (once + 2 * twice) if twice else 0.5,
        root_discount=word_once / (word_once + 2 * word_twice) if word_twice else 0.5,
        base=1.0 / (v + 1))

    def sums_of(state):
        return [sum(x) for x in zip(*(r.roots for r in state.select("roots").collect()))]

    by_word = stored.select("part", "words", "per_word", "contexts", "context", "count")
    state, path = _stored(_with_totals(by_word, _ask_pairs(buckets), 1).mapInArrow(
        _begin, STATE_DDL), "state")
    roots, kept = sums_of(state), []
    for turn in range(s.burn_in + s.samples):
        last = path
        state, path = _stored(_with_totals(state, _ask_more(buckets), 1).mapInArrow(
            _sweep(model, roots, s, turn), STATE_DDL), "state")
        delete_path(spark, last)
        roots = sums_of(state)
        if turn >= s.burn_in:
            kept.append(roots)

    shared = by_word.mapInArrow(_customers(parts, s.samples), TOTALS_DDL).unionByName(
        state.mapInArrow(_kept_tables(parts), TOTALS_DDL))
    contexts = shared.groupBy("bucket").applyInArrow(
        lambda table: _add_contexts(table, 1 + s.samples),
        "part int, own binary, own_totals binary")
    answers, _ = _stored(
        stored.select("part", "words", "per_word", "count", "batches", "batch_words",
                      "batch_pairs")
        .join(state.select("part", "kept", "kept_in_root", "kept_seated"), "part")
        .join(contexts, "part", "left").mapInArrow(_answers, ANSWERS_DDL), "answers",
        rows=1 << 20)  # these are small
    delete_path(spark, parts_path)  # the answers hold all that is needed from here on
    delete_path(spark, path)
    begins = (begun, [begun_pairs + x[2] for x in kept])
    scored = texts.mapInArrow(_entries(parts), ENTRIES_DDL).groupBy("batch").cogroup(
        answers.groupBy("batch")).applyInArrow(
            _score(model, s, kept, begins, n, v), RESULT_DDL)
    return scored.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, n_tokens, perplexity, base_perplexity) over all scored texts."""
    def per_token(column):
        return F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), per_token("score").alias("perplexity"),
        per_token("base_score").alias("base_perplexity"))
