"""Embedding near-duplicates: an inverted multi-index with verification.

Vectors are scaled to length 1 and cut in two halves. Each half has a codebook of its own (k-means on
a bounded sample); a vector's cell is the pair of its nearest codewords, so K codewords a half make a
grid of K * K cells. A query visits cells in the order of the sum of its two halves' distances
(the multi-sequence traversal), as many as reach the target recall, and its candidates there are verified
by exact cosine in double precision.

A pair is found if either vector visits the other's cell. How many cells to visit is calibrated on the sample: partners at
exactly the threshold are made for sampled vectors, and the least number of cells is taken by which ``RECALL`` of the pairs are
found. The grid grows with the index, so cells keep their size, and the sample with the codebooks (eight rows a codeword).

All vectors are indexed and all are queries. Equal vectors form a class and only one of them goes
on. Cells are cut into blocks of ``BLOCK`` vectors, so a crowded cell is many tasks and no task
holds more than a block of index and a block of queries. A task emits a vector's number of links and the
smallest vector that it is connected with there, not pairs. A vector's cells travel with it to its own cell, so a task knows which of
its pairs the other side finds too, and each link counts once at both its ends.

Vectors are compared with those of their own length. The ``CODED`` commonest lengths have codebooks; vectors of any other
length are compared all with all, block by block.

Defined results for odd input: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, link
with nothing and are kept. Rows that share an id are a vector each, with links of its own; among equal components
the smallest id counts, whichever row has it. Repeated rows are links of each other. Very long vectors are a row of one task. An
empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from graphloom.llm import _sample
from graphloom.llm._components import components
from graphloom.session import materialize

#: Vectors that codebooks and calibration are fitted on, about, if eight for each codeword are not more.
SAMPLE = 20_000
RECALL = 0.998
BLOCK = 1024
#: Vectors of a cell, about.
CELL = 48
#: Lengths that have codebooks, and vectors that a length needs for that.
CODED, CODED_ROWS = 16, 256


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means by Lloyd's rounds, from distinct sampled rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        step = max(64, 4_000_000 // len(c))
        own = np.concatenate([nearest(x[lo : lo + step], c).argmin(1) for lo in range(0, len(x), step)])
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows, codewords)."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :])


def traversal(d1: np.ndarray, d2: np.ndarray, visits: int) -> np.ndarray:
    """The ``visits`` cells of least d1[i] + d2[j] for each row, in order: (rows, visits) of i * K2 + j.

    Cell (i, j) of the sorted halves can be among the first T only if (i+1) * (j+1) <= T, as all cells
    that are before it in both halves come first; only those are looked at.
    """
    k1, k2 = d1.shape[1], d2.shape[1]
    visits = min(visits, k1 * k2)
    (s1, o1), (s2, o2) = _least(d1, visits), _least(d2, visits)
    i, j = np.array([(a, b) for a in range(min(k1, visits)) for b in range(min(k2, visits // (a + 1)))]).T
    total = s1[:, i] + s2[:, j]
    first = np.argsort(total, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(o1, i[first], 1) * k2 + np.take_along_axis(o2, j[first], 1)


def _least(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n least values of each row in order (equal ones by their place), and their places."""
    n = min(n, d.shape[1])
    part = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
    order = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(d, order, 1), order


def codes(n: int) -> int:
    """Codewords of each half for n vectors: cells hold ``CELL`` vectors, about, whatever n is."""
    return max(2, round((n / CELL) ** 0.5))


def fit(x: np.ndarray, n: int, cosine: float, recall: float, seed: int = 5) -> dict:
    """Codebooks for an index of n vectors, and the number of cells to visit."""
    half = (x.shape[1] + 1) // 2
    k = codes(n)
    books = codebook(x[:, :half], k, seed), codebook(x[:, half:], k, seed + 1) if x.shape[1] > half else np.zeros((1, 0))
    rng = np.random.default_rng(seed + 2)
    q = x[rng.choice(len(x), min(len(x), 2000), replace=False)]
    noise = rng.standard_normal(q.shape)
    noise -= (noise * q).sum(1, keepdims=True) * q
    noise /= np.maximum(1e-12, np.linalg.norm(noise, axis=1, keepdims=True))
    partner = cosine * q + (1 - cosine**2) ** 0.5 * noise
    model = {"books": books, "half": half, "visits": 1}
    own, other = cells_of(q, model)[:, :1], cells_of(partner, model)[:, :1]
    cells = len(books[0]) * len(books[1])
    while True:
        met = (cells_of(q, model) == other).any(1) | (cells_of(partner, model) == own).any(1)
        if model["visits"] >= cells or met.mean() >= recall:
            return model
        model["visits"] = min(cells, model["visits"] + max(1, model["visits"] // 5))


def reachable(x: np.ndarray, m: dict, cosine: float) -> list[np.ndarray]:
    """All cells that may hold a vector linked to each unit vector, its own first: by the triangle inequality in each half, a cell is ruled out if the
    halves' distances less the codewords' radii are together beyond the distance that the cosine allows."""
    d = [np.maximum(0, np.sqrt(np.maximum(0, nearest(part, book))) - far[None, :] - 1e-6) ** 2 for part, book, far in zip((x[:, : m["half"]], x[:, m["half"] :]), m["books"], m["radii"])]
    own = cells_of(x, m | {"visits": 1})[:, 0]
    out = []
    for i in range(len(x)):
        first = np.flatnonzero(d[0][i] <= 2 - 2 * cosine + 1e-6)
        both = d[0][i][first, None] + d[1][i][None, :]
        a, b = np.nonzero(both <= 2 - 2 * cosine + 1e-6)
        cells = first[a] * len(m["books"][1]) + b
        out.append(np.r_[own[i], cells[cells != own[i]]])
    return out


def cells_of(x: np.ndarray, m: dict | None) -> np.ndarray:
    """The cells that unit vectors visit, their own first; without a model there is one cell."""
    if m is None:
        return np.zeros((len(x), 1), np.int64)
    return traversal(nearest(x[:, : m["half"]], m["books"][0]), nearest(x[:, m["half"] :], m["books"][1]), m["visits"])


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors at length 1, in double precision (first scaled by their greatest component, so that squares neither vanish nor overflow)."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    offsets = np.asarray(column.offsets, np.int64)
    return np.asarray(column.flatten()), offsets - offsets[0]


def _radii(classes: DataFrame, models: dict, item: str) -> None:
    """Adds to each model the radius of every codeword of both halves: the largest distance of a vector's half from its nearest one, over all vectors."""
    shared = classes.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict = {}
        for b in batches:
            values, offsets = _lists(b.column("x"))
            sizes = np.diff(offsets)
            for width in np.unique(sizes).tolist():
                m = shared.value.get(width)
                at = np.flatnonzero(sizes == width)
                for lo in range(0, len(at) if m is not None else 0, 512):
                    x = unit(values[offsets[at[lo : lo + 512]][:, None] + np.arange(width)])
                    for h, (part, book) in enumerate(zip((x[:, : m["half"]], x[:, m["half"] :]), m["books"])):
                        d = np.sqrt(np.maximum(0, nearest(part, book)))
                        held = far.setdefault((width, h), np.zeros(len(book)))
                        np.maximum.at(held, d.argmin(1), d.min(1))
        for (width, h), held in far.items():
            n = len(held)
            yield pa.RecordBatch.from_pydict({"width": pa.array([width] * n, pa.int32()), "half": pa.array([h] * n, pa.int32()), "code": pa.array(range(n), pa.int32()), "far": pa.array(held)})

    for m in models.values():
        m["radii"] = [np.zeros(len(b)) for b in m["books"]]
    # a row for each codeword: as many as the codebooks, which are on the driver
    for r in classes.select("x").mapInArrow(run, "width int, half int, code int, far double").groupBy("width", "half", "code").agg(F.max("far").alias("far")).collect():
        models[r["width"]]["radii"][r["half"]][r["code"]] = r["far"]


def links_of(q: dict, x: dict, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of queries ``q`` with the index vectors ``x`` of a cell: the number of rows that each of either is linked with (as far as it
    is counted here), and for each the least class of either that it is connected with (places in the sorted classes of both)."""
    names, place = np.unique(np.concatenate([q["class"], x["class"]]), return_inverse=True)
    qi, xi = place[: len(q["class"])], place[len(q["class"]) :]
    ours, theirs = np.zeros(len(qi), np.int64), np.zeros(len(xi), np.int64)
    link = np.zeros((len(qi), len(xi)), bool)
    a, b = unit(q["x"]), unit(x["x"])
    for lo in range(0, len(qi), 64):
        part = (a[lo : lo + 64] @ b.T >= cosine) & (qi[lo : lo + 64, None] != xi[None, :])
        link[lo : lo + 64] = part
        i, j = np.nonzero(part)
        ours[lo : lo + 64] += part @ x["copies"]
        # the index vector's own visits do not reach the query's cell: the link counts here for it too
        alone = ~(x["cells"][j] == q["own"][lo + i][:, None]).any(1) if "cells" in x else np.zeros(len(i), bool)
        np.add.at(theirs, j[alone], q["copies"][lo + i[alone]])
    low_q, low_x, none = qi.copy(), xi.copy(), len(names)
    while True:
        new_q = np.minimum(low_q, np.where(link, low_x[None, :], none).min(1, initial=none))
        new_x = np.minimum(low_x, np.where(link, new_q[:, None], none).min(0, initial=none))
        if (new_q == low_q).all() and (new_x == low_x).all():
            return ours, theirs, names[low_q], names[low_x]
        low_q, low_x = new_q, new_x


def near_embeddings(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, recall: float = RECALL, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """``key``, n_links, component_id, kept for every row: vectors are linked whose cosine is at least ``cosine``.

    With ``exact`` a vector visits every cell that can hold a link, so no link is lost; how many these are depends on how far apart the data are.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType
    # single precision stays as it is until it is compared: half the bytes
    item, arrow = ("float", pa.float32()) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else ("double", pa.float64())
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{item}>").alias("x"))
    good = F.expr("id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity')) and exists(x, c -> c <> 0)")
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    v = v.withColumn("h", F.when(F.col("good"), F.sha2(F.array_join(F.transform("x", lambda c: (c + F.lit(0).cast(item)).cast("string")), ","), 256)))
    v = materialize(v.withColumn("x", F.when(F.col("good"), F.col("x"))), "vectors")
    # a class is named by its least id and its hash: ids with several vectors have several classes
    classes = v.where("good").groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("x").alias("x"))
    classes = materialize(classes.withColumn("class", F.struct("rep", F.xxhash64("h").alias("tag"))).withColumn("width", F.size("x")), "classes")
    widths = [r for r in classes.groupBy("width").count().where(F.col("count") >= CODED_ROWS).orderBy(F.desc("count"), "width").limit(CODED).collect()]
    models: dict[int, dict] = {}
    for r in widths:
        width, n = r["width"], r["count"]
        some = classes.where((F.col("width") == width) & (_sample.spread(F.col("h"), seed=3) < max(SAMPLE, 8 * codes(n)) / n))
        taken = some.select("h", "x").toPandas().sort_values("h")
        models[width] = fit(unit(np.stack(taken["x"].to_numpy())), n, cosine, recall)
    if exact:
        _radii(classes, models, item)
    shared = spark.sparkContext.broadcast(models)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (rep, tag, copies, x) with the cells to visit, the own one first."""
        for b in batches:
            values, offsets = _lists(b.column("x"))
            sizes, cells = np.diff(offsets), [None] * b.num_rows
            for width in np.unique(sizes).tolist():
                m = shared.value.get(width)
                rows = max(64, 2_000_000 // max(width, 1 if m is None else max(map(len, m["books"]))))
                at = np.flatnonzero(sizes == width)
                for lo in range(0, len(at), rows):
                    part = at[lo : lo + rows]
                    x = unit(values[offsets[part][:, None] + np.arange(width)])
                    for i, own in zip(part.tolist(), reachable(x, m, cosine) if exact and m is not None else cells_of(x, m)):
                        cells[i] = own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*b.schema.names, "cells"])

    placed = classes.select("class.rep", "class.tag", "copies", "x").mapInArrow(place, f"rep long, tag long, copies long, x array<{item}>, cells array<long>")
    placed = materialize(placed.withColumn("width", F.size("x")).withColumn("own", F.col("cells")[0]), "placed")
    cell = ["width", "cell"]
    counts = placed.groupBy("width", F.col("own").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = placed.select("width", F.explode("cells").alias("cell")).groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / (4 * block)).cast("int").alias("askers"))
    grid = materialize(counts.join(asked, cell), "grid")
    spread = lambda salt, n: F.pmod(F.xxhash64("rep", "tag", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # each (block, asker) of a cell is a task's unit: index rows go to all askers, query rows to all blocks
    # the exact way finds every link from both its ends, so the index side needs no cells
    held = placed.withColumn("cells", F.lit(None).cast("array<long>")) if exact else placed
    here = held.withColumn("cell", F.col("own")).join(grid, cell).withColumn("block", spread(1, "blocks")).withColumn("asker", every("askers"))
    there = placed.withColumn("cell", F.explode("cells")).join(grid, cell).withColumn("asker", spread(2, "askers")).withColumn("block", every("blocks")).withColumn("cells", F.lit(None).cast("array<long>"))
    names = ["width", "cell", "block", "asker", "kind", "rep", "tag", "copies", "own", "cells", "x"]
    rows = here.withColumn("kind", F.lit(0)).select(*names).unionAll(there.withColumn("kind", F.lit(1)).select(*names))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit and kind to (rep, tag, links, low_rep, low_tag): what the unit adds to a
        class's links, and the smallest class that it is connected with there."""
        pair = np.dtype([("rep", np.int64), ("tag", np.int64)])
        now, held = None, {0: [], 1: []}

        def flush() -> list[pa.RecordBatch]:
            if not held[0] or not held[1]:
                return []
            x, q = ({c: np.concatenate([p[c] for p in held[k]]) for c in held[k][0]} for k in (0, 1))
            out = []
            ours, theirs, low_q, low_x = links_of(q, x, cosine)
            for own, n, low in ((q["class"], ours, low_q), (x["class"], theirs, low_x)):
                keep = (n > 0) | (own != low)
                own, n, low = own[keep], n[keep], low[keep]
                out.append(pa.RecordBatch.from_pydict({"rep": pa.array(own["rep"]), "tag": pa.array(own["tag"]), "links": pa.array(n), "low_rep": pa.array(low["rep"]), "low_tag": pa.array(low["tag"])}))
            return [o for o in out if o.num_rows]

        for b in batches:
            col = {c: np.asarray(b.column(c)) for c in ("width", "cell", "block", "asker", "kind", "rep", "tag", "copies", "own")}
            at = np.stack([col[c].astype(np.int64) for c in ("width", "cell", "block", "asker", "kind")], axis=1)
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)]) if len(at) else []
            for lo, hi in zip(starts, np.r_[starts[1:], len(at)] if len(at) else []):
                name, k = tuple(at[lo, :4].tolist()), int(at[lo, 4])
                if name != now:
                    yield from flush()
                    now, held = name, {0: [], 1: []}
                part = b.slice(int(lo), int(hi - lo))
                named = np.empty(hi - lo, pair)
                named["rep"], named["tag"] = col["rep"][lo:hi], col["tag"][lo:hi]
                rows = {"class": named, "copies": col["copies"][lo:hi].copy(), "own": col["own"][lo:hi].copy(), "x": _lists(part.column("x"))[0].reshape(int(hi - lo), -1).copy()}
                if not k and not exact:
                    rows["cells"] = _lists(part.column("cells"))[0].reshape(int(hi - lo), -1).copy()
                held[k].append(rows)
        yield from flush()

    unit_of = ["width", "cell", "block", "asker"]
    found = rows.repartition(*unit_of).sortWithinPartitions(*unit_of, "kind").mapInArrow(verify, "rep long, tag long, links long, low_rep long, low_tag long")
    found = materialize(found.select(F.struct("rep", "tag").alias("class"), "links", F.struct(F.col("low_rep").alias("rep"), F.col("low_tag").alias("tag")).alias("low")), "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("b"), F.col("low").alias("a"))).withColumnRenamed("node", "class")
    tops = classes.join(links, "class", "left").join(joined, "class", "left").select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component.rep", "rep").alias("component"))
    out = v.select("id", "h").join(tops, "h", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
