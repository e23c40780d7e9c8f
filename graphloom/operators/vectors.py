"""Vector metrics, quantisation, exact top-k, and the block-wise k-nearest-neighbour join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

DIMENSIONS = {"small": 384, "medium": 768, "large": 1536}


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def comparable(v: Column, size: int) -> Column:
    """The vector is there, of that length, without null, NaN or infinite components. What is not comparable has no similarity."""
    return F.coalesce((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Similarity in [-1, 1]; empty vectors: 1, a zero norm: 0. Null where a vector is null, the lengths differ, or a component is null, NaN or infinite."""
    # the product and the norms are named once, as functions of arrays are worked out wherever they are named
    parts = F.array(F.struct(dot(a, b).alias("d"), (norm(a) * norm(b)).alias("n"), (F.size(a) + F.size(b)).alias("size")))

    def value(p: Column) -> Column:
        d, n = p["d"], p["n"]
        r = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), d / n)))
        # least and greatest would hide a null or NaN
        none = d.isNull() | n.isNull() | F.isnan(d) | F.isnan(n) | (F.abs(d) == float("inf")) | (n == float("inf"))
        return F.when(p["size"] == 0, F.lit(1.0)).when(none, F.lit(None)).otherwise(r)

    return F.transform(parts, value)[0]


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _bits(a: Column, t: float) -> Column:
    return F.transform(a, lambda x: (x >= t).cast("int"))


def jaccard(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Of the components that reach the threshold; an empty union: 1."""
    x, y = _bits(a, threshold), _bits(b, threshold)
    both = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0), lambda s, v: s + v)
    any_ = F.aggregate(F.zip_with(x, y, lambda p, q: F.greatest(p, q)), F.lit(0), lambda s, v: s + v)
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def hamming(a: Column, b: Column, threshold: float = 0.5) -> Column:
    return F.aggregate(F.zip_with(_bits(a, threshold), _bits(b, threshold), lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v).cast("double")


#: name -> (distance, similarity)
METRICS = {
    "cosine": (lambda a, b: 1 - cosine(a, b), cosine),
    "euclidean": (euclidean, lambda a, b: F.exp(-euclidean(a, b))),
    "manhattan": (manhattan, lambda a, b: 1 / (1 + manhattan(a, b))),
    "dotproduct": (lambda a, b: -dot(a, b), dot),
    "jaccard": (lambda a, b: 1 - jaccard(a, b), jaccard),
    "hamming": (hamming, lambda a, b: F.when(F.size(a) == 0, F.lit(1.0)).otherwise(1 - hamming(a, b) / F.size(a))),
}


def metric(name: str):
    """(distance, similarity) by name, any case."""
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown metric {name}") from None


def quantize(v: Column) -> Column:
    """struct(codes 0-255, low, span): each component's place between the vector's least and greatest."""
    low, high = F.array_min(v), F.array_max(v)
    span = F.when(high - low < 1e-12, F.lit(1.0)).otherwise(high - low)
    return F.struct(F.transform(v, lambda x: F.floor((x - low) / span * 255 + 0.5).cast("int")).alias("codes"), low.alias("low"), span.alias("span"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["low"] + c / F.lit(255.0) * q["span"])


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "id", offset: int = 0) -> DataFrame:
    """Highest scores first, equal scores by key; one TakeOrderedAndProject."""
    out = df.orderBy(F.desc(score), key)
    return out.offset(offset).limit(k) if offset else out.limit(k)


def scored(vectors: DataFrame, query: list[float], name: str = "cosine", digits: int = 6) -> DataFrame:
    """With ``score``; what cannot be compared with the query is no hit and is left out, by a look at the vector alone, before it is scored."""
    fine = all(x is not None and np.isfinite(x) for x in query)
    d = vectors.where(comparable(F.col("vector"), len(query)) if fine else F.lit(False))
    return d.withColumn("score", F.round(metric(name)[1](F.col("vector"), literal(query if fine else [])), digits) + 0.0)


def search(vectors: DataFrame, query: list[float], k: int, name: str = "cosine", threshold: float | None = None, where: Column | None = None, digits: int = 6) -> DataFrame:
    """Exact top-k by similarity. Candidates are filtered first, so the limit always counts what is wanted."""
    d = scored(vectors if where is None else vectors.where(where), query, name, digits)
    if threshold is not None:
        d = d.where(F.col("score") >= threshold)
    return top_k(d, k)


#: Rows of a block of the joins of blocks with blocks; rows of one that are compared at once.
BLOCK, SLICE = 4096, 512


def blocks(df: DataFrame, lists: str = "", block: int = BLOCK, also: tuple[str, Callable[[np.ndarray, pa.Table], list]] | None = None) -> DataFrame:
    """(ids, x, dims) and arrays of the columns ``lists`` (names with types of one value): (id, vector, ...) in blocks of at most ``block`` vectors of one length, each scaled to
    the length 1, in the order of the rows; written. Vectors that are null or empty, or hold null or non-finite components, are left out.
    ``also`` is one more column (name with type) and what gives its value for a block, from its scaled vectors and its other columns."""
    more = [c.split()[0] for c in lists.split(", ") if c]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def full(dims: int) -> pa.RecordBatch:
            own = held.pop(dims)
            x = np.concatenate([h[1] for h in own])
            t = pa.concat_tables([h[0] for h in own]).combine_chunks()
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type))
            columns = {"ids": one("id"), "x": pa.array([x.tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32()), **{c: one(c) for c in more}}
            if also:
                columns[also[0].split()[0]] = pa.array([also[1](x, t)])
            return pa.RecordBatch.from_pydict(columns)

        for b in batches:
            size = np.asarray(b.column("vector").value_lengths().fill_null(0))
            for dims in np.unique(size[size > 0]).tolist():
                part = b.filter(pa.array(size == dims))
                v = np.asarray(part.column("vector").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                fine = np.isfinite(n[:, 0])
                x = np.divide(v, n, out=np.zeros_like(v), where=n > 0)[fine]
                rest = pa.Table.from_batches([part.filter(pa.array(fine)).select(["id", *more])])
                while len(x):
                    room = block - sum(len(h[1]) for h in held.get(dims, []))
                    held.setdefault(dims, []).append((rest.slice(0, room), x[:room].copy()))
                    x, rest = x[room:], rest.slice(room)
                    if sum(len(h[1]) for h in held[dims]) == block:
                        yield full(dims)
        for dims in list(held):
            yield full(dims)

    columns = ["id", "vector", *more]
    d = df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *more)
    arrays = "".join(f", {c.split()[0]} array<{c.split()[1]}>" for c in lists.split(", ") if c)
    return materialize(d.select(*columns).mapInArrow(pack, "ids array<long>, x binary, dims int" + arrays + (f", {also[0]}" if also else "")), "blocks")


def block_for(rows: int) -> int:
    """Rows of a block: more of a larger table, so that pairs of blocks are fewer and each row of one goes to a task less often; bounded."""
    return min(4 * BLOCK, max(BLOCK, rows // 16))


def at_least(s: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) where a row of ``s`` is not below its bound, in order; eight places are looked at together, as few are."""
    m = (s >= low[:, None]).ravel()
    if len(m) % 8:
        return np.divmod(np.flatnonzero(m), s.shape[1])
    some = np.flatnonzero(m.view(np.uint64))
    r, c = np.nonzero(m.reshape(-1, 8)[some])
    return np.divmod(some[r] * 8 + c, s.shape[1])


def near_best(s: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places (rows, columns; rows in order) of ``s`` that are not below their row's k-th best of them by more than ``slack``."""
    v = s[rows, cols]
    order = np.lexsort((-v, rows))
    last = order[np.arange(len(rows)) - np.searchsorted(rows, rows) == k - 1]
    low = np.full(len(s), np.finfo(np.float32).min)
    low[rows[last]] = np.nextafter((v[last].astype(np.float64) - slack).astype(np.float32), np.float32(-np.inf))
    keep = v >= low[rows]
    return rows[keep], cols[keep]


def best_of_blocks(asked: DataFrame, there: DataFrame, k: int, self_join: bool, digits: int, when: Column | None = None) -> DataFrame:
    """(src, dst, sim, rank): for each vector of the blocks ``asked`` its k most similar in those of ``there`` that ``when`` (of the columns, those of ``there`` with a ``t_``) pairs it with.

    All pairs of blocks meet in a nested loop, without a shuffle of blocks: a task reads some of both sides. What is below a vector's k-th best so
    far, by a product in single precision and the most it can be off, is neither computed in double nor ranked; a column ``worst`` says what is known of that before, ``visits`` (cells) and ``t_cell`` which rows count.
    """
    there = there.select(*[F.col(c).alias(f"t_{c}") for c in there.columns])
    # not an equality: Spark would deal the few lengths there are to as many tasks
    same = (F.col("dims") <= F.col("t_dims")) & (F.col("dims") >= F.col("t_dims"))
    pairs = asked.crossJoin(there).where(same if when is None else same & when)
    pairs = pairs.select(*[c for c in ("ids", "x", "dims", "worst", "visits", "t_ids", "t_x", "t_cell") if c in pairs.columns and (c != "t_cell" or "visits" in pairs.columns)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, np.ndarray] = {}
        for b in batches:
            for r in range(b.num_rows):
                cell = lambda c: b.column(c)[r]
                dims, qi, xi = cell("dims").as_py(), np.asarray(cell("ids").values), np.asarray(cell("t_ids").values)
                q, x = (np.frombuffer(cell(c).as_buffer(), np.float64).reshape(-1, dims) for c in ("x", "t_x"))
                key = qi.tobytes()
                if key not in least:
                    known = cell("worst").values.to_numpy(zero_copy_only=False) if "worst" in b.schema.names else np.full(len(qi), np.nan)
                    least[key] = np.where(np.isnan(known), -np.inf, known)
                bar = least[key]
                if "visits" in b.schema.names:
                    lists, of = cell("visits").values, np.asarray(cell("t_cell").values)
                    at = np.asarray(lists.offsets)
                # a first look in single precision; what is near enough is compared again in double
                q4, x4 = q.astype(np.float32), x.astype(np.float32)
                slack = 2 * 10.0**-digits + (dims + 8) * 2.0**-23
                mine = self_join and np.isin(qi, xi).any()
                for lo in range(0, len(q), SLICE):
                    own = qi[lo : lo + SLICE]
                    s = q4[lo : lo + SLICE] @ x4.T
                    if mine and np.isin(own, xi).any():
                        s[own[:, None] == xi[None, :]] = -np.inf
                    if "visits" in b.schema.names:
                        n = at[lo + 1 : lo + len(own) + 1] - at[lo : lo + len(own)]
                        goes = np.zeros((len(own), int(of.max(initial=0)) + 1), bool)
                        to = np.asarray(lists.values)[at[lo] : at[lo + len(own)]]
                        who = np.repeat(np.arange(len(own)), n)
                        goes[who[to < goes.shape[1]], to[to < goes.shape[1]]] = True
                        s[~goes[:, of]] = -np.inf
                    low = bar[lo : lo + SLICE].copy()
                    fresh = np.flatnonzero(np.isneginf(low))
                    if len(fresh) and s.shape[1] > k:
                        low[fresh] = np.partition(s[fresh], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    # down to the next single below; what is left out (-inf) stays below all
                    low = np.maximum(np.nextafter((low - slack).astype(np.float32), np.float32(-np.inf)), np.finfo(np.float32).min)
                    rows, cols = at_least(s, low)
                    if len(rows) > 2 * k * len(own):
                        rows, cols = near_best(s, rows, cols, k, slack)
                    if not len(rows):
                        continue
                    # many are near where there are many copies
                    sim = (q[lo : lo + SLICE] @ x.T)[rows, cols] if len(rows) > s.size // 32 else np.einsum("ij,ij->i", q[lo + rows], x[cols])
                    sim, dst = np.round(sim, digits) + 0.0, xi[cols]
                    keep = sim >= bar[lo + rows]
                    rows, sim, dst = rows[keep], sim[keep], dst[keep]
                    if not len(rows):
                        continue
                    order = np.lexsort((dst, -sim, rows))
                    rows, sim, dst = rows[order], sim[order], dst[order]
                    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    last = rank == k - 1
                    bar[lo + rows[last]] = np.maximum(bar[lo + rows[last]], sim[last])
                    keep = rank < k
                    yield pa.RecordBatch.from_pydict({"src": pa.array(own[rows[keep]]), "dst": pa.array(dst[keep]), "sim": pa.array(sim[keep])})

    found = pairs.mapInArrow(compare, "src long, dst long, sim double")
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, index: DataFrame, k: int, self_join: bool = False, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(src, dst, sim, rank): for each query its k most similar vectors of the index by cosine, exact.

    Vectors are compared with those of their length; null and empty vectors, and those with null or non-finite components, have no
    neighbours and are none. Both sides are packed into blocks of rows; a task multiplies one block by another and keeps at most k
    for each query, so a pair of blocks makes block * k rows and not block * block.
    """
    deal = lambda d: blocks(d.select("id", "vector").repartition(max(1, -(-d.count() // block)), "id"), block=block)
    return best_of_blocks(deal(queries), deal(index), k, self_join, digits)


def pairwise(vectors: DataFrame, digits: int = 6, block: int = 1024, by: str | None = None) -> DataFrame:
    """(a, b, sim): the cosine of all pairs of vectors with ids a < b (and, with ``by``, of equal values there that are not null), as ``cosine`` gives it; null where a vector
    is null or holds a null or non-finite component, or the lengths differ.

    Vectors are packed into blocks; a task multiplies one block by another, each two blocks once. The blocks are written once and meet in a nested loop, so
    no pair of them is shuffled.
    """
    n = max(1, -(-vectors.count() // block))
    group = F.lit(0) if by is None else F.col(by)
    packed = vectors.where("id is not null").groupBy(group.alias("g"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("p")).agg(F.collect_list(F.struct("id", "vector")).alias("ps"))

    def rows(items):
        """The ids, and for each length the places and the scaled vectors."""
        by: dict = {}
        for i, x in enumerate(items):
            if x["vector"] is not None and None not in x["vector"]:
                by.setdefault(len(x["vector"]), []).append(i)
        out = {}
        for size, at in by.items():
            v = np.array([items[i]["vector"] for i in at], np.float64).reshape(len(at), size)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            out[size] = np.array(at), np.divide(v, length, out=np.zeros_like(v), where=length != 0)
        return np.array([x["id"] for x in items], np.int64), out

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (p, ps), (q, qs) = (batch.column(c)[k].as_py() for c in ("p", "ps")), (batch.column(c)[k].as_py() for c in ("q", "qs"))
                (pi, px), (qi, qx) = rows(ps), rows(qs)
                sim, known = np.zeros((len(pi), len(qi))), np.zeros((len(pi), len(qi)), bool)
                for size in px.keys() & qx.keys():
                    (at, v), (to, w) = px[size], qx[size]
                    sim[np.ix_(at, to)] = np.round(np.clip(v @ w.T, -1, 1), digits) + 0.0 if size else 1.0
                    known[np.ix_(at, to)] = np.isfinite(sim[np.ix_(at, to)])
                for lo in range(0, len(pi), 64):
                    # two rows of one id are no pair; they are in one block
                    a, b = np.broadcast_arrays(pi[lo : lo + 64, None], qi[None, :])
                    keep = a < b if p == q else np.ones(a.shape, bool)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)[keep]), "b": pa.array(np.maximum(a, b)[keep]), "sim": pa.array(sim[lo : lo + 64][keep], mask=~known[lo : lo + 64][keep])})

    packed = materialize(packed.where("g is not null").repartition(min(512, n), "g", "p"), "blocks")
    other = packed.withColumnsRenamed({"g": "h", "p": "q", "ps": "qs"})
    # not an equality of groups: Spark would deal a group to one task
    pairs = packed.crossJoin(other).where("p <= q and g <= h and g >= h").select("p", "ps", "q", "qs")
    return pairs.mapInArrow(multiply, "a long, b long, sim double")


def two_stage(vectors: DataFrame, query: list[float], recall: int, k: int, short: int) -> DataFrame:
    """Recall by the first ``short`` components, then rerank by the whole vector."""
    first = search(vectors.withColumn("whole", F.col("vector")).withColumn("vector", F.slice("vector", 1, short)), query[:short], recall)
    return search(first.drop("score", "vector").withColumnRenamed("whole", "vector"), query, k)


def until(ranked: DataFrame, stop: Column) -> DataFrame:
    """Rows of a ranked frame (rank, ...) before the first at which ``stop`` holds."""
    first = ranked.where(stop).agg(F.min("rank").alias("first"))
    return ranked.crossJoin(F.broadcast(first)).where("first is null or rank < first").drop("first")
