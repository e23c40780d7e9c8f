"""Product codes of vectors by Heap Lloyd.

Vectors become whole numbers, floor(1024 x), and are cut into four equal parts; each part position has a codebook of up
to 256 entries, refined by Lloyd's rounds in whole numbers, so that a result does not depend on the order of sums.

A task holds blocks of vectors. In a block every entry has a heap of the parts assigned to it, keyed by slack: the lower bound of
the distance to the second nearest entry minus the upper bound of that to its own, as of the last exact scan, plus the drift that
the entry had at that time. When entries move, the drift of an entry grows by its own step and by the largest step of any
other. Only parts whose key lies below their entry's drift may have changed sides: they are popped, rescanned exactly, and
pushed again. Heaps are kept as sorted runs, so a pop is a prefix. A block's change to the sums of its entries (popped
parts that moved, no others) is written with it; the driver gets the summed changes, at most 256 entries of each part.

Blocks are rows of a table that each round writes anew to the shared folder; the round before is then deleted. A lost executor
costs a reread of blocks.

Defined results for odd input: rows whose vector is null or holds null or non-finite components are left out; a null vec_id
is coded, and comes last in the order that starts the codebooks; rows that share a vec_id are vectors each (their order is
that of their components); equal distances go to the lower entry; with fewer than 256 vectors the codebooks are as short; each
length of vectors has codebooks of its own, a length that is no multiple of four is filled up with zeros, and more than
``MAX_LENGTHS`` lengths are refused; empty vectors have code 00000000 and error 0; components beyond a limit that keeps
all sums in 64 bits (131,072 at 64 components) are moved to it; an empty table gives an empty result; extra columns are left
out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._memory import trim
from graphloom.session import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of a block.
BLOCK = 1 << 19
MAX_LENGTHS = 1_000
#: Labels that are broadcast at most, after they are counted.
BROADCAST_LABELS = 1_000_000
#: Bounds are compared with this margin, relative to the largest distance at hand, as they are in floating point.
MARGIN = 1e-9


def limit(dim: int) -> int:
    """Largest size of a whole component: squared differences of ``dim`` components stay below 2^62."""
    return int(2**30 / max(1.0, dim**0.5))


def whole(x: np.ndarray) -> np.ndarray:
    """(rows, 4, width) whole numbers of the rows of ``x``."""
    n, dim = x.shape
    top = limit(dim)
    y = np.clip(np.floor(SCALE * np.clip(x, -float(top), float(top))), -top, top).astype(np.int64)
    width = -(-dim // PARTS)
    return np.pad(y, ((0, 0), (0, width * PARTS - dim))).reshape(n, PARTS, width)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries). The product runs in doubles where they hold all sums, else in whole numbers."""
    width = x.shape[1]
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top * top * max(1, width) < 1 << 52:
        product = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        product = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * product + (c * c).sum(1)[None, :]


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part (the lowest of equal ones), its squared distance, and the slack to the second nearest."""
    own, best, slack = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.full(len(x), np.inf)
    for lo in range(0, len(x), 4096):
        d = distances(x[lo : lo + 4096], c)
        at = d.argmin(1)
        own[lo : lo + 4096], best[lo : lo + 4096] = at, d[np.arange(len(d)), at]
        if d.shape[1] > 1:
            two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
            slack[lo : lo + 4096] = two[:, 1] - two[:, 0] - MARGIN * two[:, 1]
    return own, best, slack


class Heaps:
    """The heaps of one part of a block: for each entry the parts assigned to it, as a run sorted by key."""

    def __init__(self, own: np.ndarray, key: np.ndarray):
        self.own, self.key = own, key
        self._sort()

    def _sort(self) -> None:
        self.order = np.lexsort((self.key, self.own))
        self.start = np.searchsorted(self.own[self.order], np.arange(ENTRIES + 1))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Parts whose key does not lie above the drift of their entry."""
        taken = []
        for j in range(len(drift)):
            run = self.order[self.start[j] : self.start[j + 1]]
            if len(run) and self.key[run[0]] <= drift[j]:
                taken.append(run[: np.searchsorted(self.key[run], drift[j], side="right")])
        return np.concatenate(taken) if taken else np.zeros(0, np.int64)

    def push(self, at: np.ndarray, own: np.ndarray, key: np.ndarray) -> None:
        self.own[at], self.key[at] = own, key
        self._sort()


def _sums(x: np.ndarray, own: np.ndarray, sign: int, out: np.ndarray) -> None:
    """Adds ``sign`` times each part, and as last component the count, to the row of its entry."""
    order = np.argsort(own, kind="stable")
    starts = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, np.int64)
    if len(starts):
        entries = own[order][starts]
        out[entries, :-1] += sign * np.add.reduceat(x[order], starts, axis=0)
        out[entries, -1] += sign * np.diff(np.r_[starts, len(own)])


_STATE = "dim int, n int, x binary, own binary, key binary, delta binary"


def _pack(ids: str, labels: str) -> str:
    return f"ids array<{ids}>, labels array<{labels}>, {_STATE}"


def _block(ids: pa.Array, labels: pa.Array, dim: int, x: np.ndarray, own: np.ndarray, key: np.ndarray, delta: np.ndarray) -> pa.RecordBatch:
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    small = next(t for t in (np.int16, np.int32, np.int64) if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
    held = [pa.array([v], t) for v, t in ((dim, pa.int32()), (len(ids), pa.int32()), (x.astype(small).tobytes(), pa.binary()), (own.astype(np.uint8).tobytes(), pa.binary()), (key.tobytes(), pa.binary()), (delta.tobytes(), pa.binary()))]
    return pa.RecordBatch.from_arrays([one(ids), one(labels), *held], names=["ids", "labels", "dim", "n", "x", "own", "key", "delta"])


def _open(n: int, dim: int, x: bytes, own: bytes, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = -(-dim // PARTS)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(x) // max(1, n * PARTS * width) or 8]
    return np.frombuffer(x, kind).astype(np.int64).reshape(n, PARTS, width), np.frombuffer(own, np.uint8).astype(np.int64).reshape(PARTS, n), np.frombuffer(key, np.float64).reshape(PARTS, n).copy()


def _first(books: dict):
    """Packs rows into blocks and scans them for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, size = b.column("vector"), np.diff(np.asarray(b.column("vector").offsets))
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                step = max(1, BLOCK // max(1, dim))
                for lo in range(0, len(at), step):
                    rows = pa.array(at[lo : lo + step])
                    x = whole(np.asarray(vectors.take(rows).flatten(), np.float64).reshape(len(rows), dim))
                    c = books[dim]
                    own, key = np.empty((PARTS, len(x)), np.int64), np.empty((PARTS, len(x)))
                    delta = np.zeros((PARTS, ENTRIES, x.shape[2] + 1), np.int64)
                    for p in range(PARTS):
                        own[p], _, key[p] = scan(x[:, p], c[p])
                        _sums(x[:, p], own[p], 1, delta[p])
                    yield _block(b.column("id").take(rows), b.column("label").take(rows), dim, x, own, key, delta)
            trim()

    return run


def _next(books: dict, drift: dict, seen: list):
    """One round: pops what the drift has violated, rescans, pushes; ``seen`` counts popped parts and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        popped = total = 0
        for b in batches:
            for i in range(b.num_rows):
                dim, n = b.column("dim")[i].as_py(), b.column("n")[i].as_py()
                x, own, key = _open(n, dim, *(b.column(k)[i].as_py() for k in ("x", "own", "key")))
                delta = np.zeros((PARTS, ENTRIES, x.shape[2] + 1), np.int64)
                for p in range(PARTS):
                    heaps = Heaps(own[p], key[p])
                    at = heaps.pop(drift[dim][p])
                    popped, total = popped + len(at), total + n
                    if len(at):
                        new, _, slack = scan(x[at, p], books[dim][p])
                        moved = new != own[p][at]
                        _sums(x[at[moved], p], own[p][at[moved]], -1, delta[p])
                        _sums(x[at[moved], p], new[moved], 1, delta[p])
                        heaps.push(at, new, slack + drift[dim][p][new])
                    own[p], key[p] = heaps.own, heaps.key
                yield _block(b.column("ids")[i].values, b.column("labels")[i].values, dim, x, own, key, delta)
            trim()
        seen[0].add(popped)
        seen[1].add(total)

    return run


def _changes(state: DataFrame) -> dict:
    """dim -> (parts, entries, width + 1) summed changes: added up in each task, then across tasks by component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for dim, delta in zip(b.column("dim").to_pylist(), b.column("delta")):
                d = np.frombuffer(delta.as_py(), np.int64)
                held[dim] = held[dim] + d if dim in held else d.copy()
        for dim, d in held.items():
            at = np.flatnonzero(d)
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(len(at), dim, np.int32)), "place": pa.array(at), "value": pa.array(d[at])})

    rows = state.select("dim", "delta").mapInArrow(add, "dim int, place long, value long")
    out: dict = {}
    for dim, place, value in rows.groupBy("dim", "place").agg(F.sum("value").alias("value")).toPandas().itertuples(index=False):
        width = -(-dim // PARTS)
        out.setdefault(dim, np.zeros(PARTS * ENTRIES * (width + 1), np.int64))[place] = value
    return {dim: d.reshape(PARTS, ENTRIES, -1) for dim, d in out.items()}


def digest(book: np.ndarray) -> str:
    """sha256 of all components in order, as decimal numbers with commas."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict, list[float]]:
    """(state, codebooks by length, share of parts that each round after the first scan popped) of (id, label, vector)."""
    spark = rows.sparkSession
    lengths = [r[0] for r in rows.select(F.size("vector").alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} lengths of vectors")
    books, drift, sums, shares = {}, {}, {}, []
    for dim in sorted(lengths):
        start = rows.where(F.size("vector") == dim).orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
        books[dim] = whole(np.array([r[0] for r in start], np.float64).reshape(len(start), dim)).transpose(1, 0, 2)
        drift[dim] = np.zeros((PARTS, len(start)))
    ids, labels = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    schema = _pack(ids, labels)
    state = materialize(rows.mapInArrow(_first(books), schema), "codes")
    for _ in range(rounds):
        for dim, change in _changes(state).items():
            sums[dim] = sums[dim] + change if dim in sums else change
            count, total = sums[dim][:, : books[dim].shape[1], -1:], sums[dim][:, : books[dim].shape[1], :-1]
            new = np.where(count > 0, total // np.maximum(1, count), books[dim])
            step = np.sqrt(((new - books[dim]) ** 2).sum(2).astype(np.float64)) * (1 + MARGIN)
            # the largest step of any other entry
            high = np.sort(step, axis=1)[:, ::-1]
            other = np.where(step == high[:, :1], high[:, 1:2] if step.shape[1] > 1 else 0.0, high[:, :1]) if step.size else step
            books[dim], drift[dim] = new, drift[dim] + step + other
        seen = [spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)]
        old, state = state, materialize(state.mapInArrow(_next(books, drift, seen), schema), "codes")
        discard(old)
        shares.append(seen[0].value / max(1, seen[1].value))
    return state, books, shares


def codes(state: DataFrame, books: dict) -> DataFrame:
    """(id, label, dim, code, error) of a fitted state."""
    kinds = [state.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, n = b.column("dim")[i].as_py(), b.column("n")[i].as_py()
                x, own, _ = _open(n, dim, *(b.column(k)[i].as_py() for k in ("x", "own", "key")))
                error = sum(((x[:, p] - books[dim][p][own[p]]) ** 2).sum(1) for p in range(PARTS))
                text = own.T.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, b.column("labels")[i].values, pa.array(np.full(n, dim, np.int32)), pa.array([text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(np.asarray(error, np.int64))],
                    names=["id", "label", "dim", "code", "error"],
                )

    return state.select("ids", "labels", "dim", "n", "x", "own", "key").mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, dim int, code string, error long")


def compress(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that can be coded.

    ``label_error`` is the error summed over equal labels, nulls together. Sums are made before the shuffle, so a hot label costs
    a row for each task; the sums go back by broadcast up to ``BROADCAST_LABELS`` labels, else by a join that Spark may split.
    """
    spark: SparkSession = embeddings.sparkSession
    rows = embeddings.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("vector is not null and not exists(vector, c -> c is null or isnan(c) or abs(c) = double('inf'))")
    state, books, _ = fit(rows, rounds)
    out = materialize(codes(state, books), "coded")
    discard(state)
    total = materialize(out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "label_"), "label")
    small = F.broadcast(total) if total.count() <= BROADCAST_LABELS else total
    sha = spark.createDataFrame([(d, digest(b)) for d, b in books.items()], "dim int, codebooks_sha256 string")
    joined = out.join(small, F.col("label").eqNullSafe(F.col("label_"))).join(F.broadcast(sha), "dim")
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")
