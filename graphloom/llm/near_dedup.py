"""MinHash near-duplicates: a chosen-path set similarity join over word shingles.

Documents with equal shingle sets form a class, found by a 128-bit sum of the set; only one text of each class goes on
(told apart by its key and hash, so many rows of one key are many texts, and many equal rows are one).
Independent trees branch the documents by selected minwise tokens: a node of a tree chooses two of
its coordinates, and a document goes to the child that its minwise token there names. After three
branchings a node of up to ``NODE`` documents and ``SHINGLES`` shingles is compared exhaustively on full shingle sets.

Larger nodes are cut into chunks of that size, each together with a few pivots of the node, and
compared; a node whose documents all turn out to be connected is done. Of the others, a node is compared block by
block, its unconnected documents against all of the node, unless three more branchings would save at least half
of that (documents of similarity s stay together on a path with s^3, which the chunks show). A node that branches on
has a tree of 8 paths of its own, one that stands for several nodes with the same documents as many
trees, three at most. After ``ROUNDS`` rounds all that is left is compared block by block.

A node gives a link from each document to the smallest of those it is connected with there, not all
pairs. Components come from alternating stars.

Recall: two documents of similarity s meet in one of three trees with probability
1 - (1 - q)^3, q the chance of surviving three branchings in two; at s = 0.85 that is 0.99997, at 0.8 0.9998.
As trees go on branching in two, q falls no lower than (2 s - 1) / s^2, 0.969 and 0.938, at any depth; a merged
node keeps a pair in a round with that chance of three trees.

Defined results for odd input: null and empty texts and texts without words have an empty set, link with nothing
and are kept; a null key links with nothing and is kept; rows that share a key are one document (if any of its texts links
with another document, all its rows with words have that component); a text with fewer than five words has one shingle; very long
texts are compared whole: a node is bounded by its shingles too, and two texts that meet are one task's memory;
of equal keys the smallest names the component, of pairs at exactly the threshold both are linked; an empty table gives an empty
result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._components import components
from graphloom.llm._memory import slices
from graphloom.llm._shingles import minwise, mixed, shingle_sets
from graphloom.llm.language import chunks
from graphloom.session import materialize

TREES, DEPTH = 3, 3
#: Documents that a node may hold to be compared exhaustively.
NODE = 1024
#: Shingles (8 bytes each, and their texts) that a node of more than two documents may hold to be compared exhaustively.
SHINGLES = 4_000_000
#: Shingles of up to so many of a node's documents are counted pair by pair.
RARE = 16
PIVOTS = 8
#: Characters that are hashed at once; a worker needs about 50 bytes for each.
CHUNK_CHARS = 400_000
ROUNDS = 6
#: Members of nodes (about 100 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_LEVELS = [2 ** (d + 1) for d in range(DEPTH)]
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, TREES * sum(_LEVELS), dtype=np.uint64)


def paths(sets: list[np.ndarray], seeds: np.ndarray = _SEEDS, root: np.uint64 = np.uint64(0)) -> np.ndarray:
    """Nodes that each non-empty set goes to by three branchings from ``root``: 8 in each tree."""
    m = minwise(sets, seeds)
    out = []
    for t in range(len(seeds) // sum(_LEVELS)):
        base = t * sum(_LEVELS)
        for leaf in range(_LEVELS[-1]):
            h = np.full(len(sets), np.uint64(t * 64 + leaf)) + root
            at = base
            for d, width in enumerate(_LEVELS):
                h = mixed(h * np.uint64(31) + m[:, at + (leaf >> (DEPTH - 1 - d))])
                at += width
            out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, hashes, texts in slices(batches):
        for lo, hi in chunks(texts, CHUNK_CHARS):
            sets = shingle_sets(texts[lo:hi])
            full = [s for s in sets if len(s)]
            found = iter(paths(full)) if full else iter(())
            rows = [(len(s), int(mixed(s).sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ np.uint64(0x5555)).sum(dtype=np.uint64).view(np.int64)), next(found)) if len(s) else (0, None, None, np.zeros(0, np.int64)) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(ids[lo:hi], pa.int64()),
                    "hash": pa.array(hashes[lo:hi], pa.int64()),
                    "n_shingles": pa.array([r[0] for r in rows], pa.int64()),
                    "s1": pa.array([r[1] for r in rows], pa.int64()),
                    "s2": pa.array([r[2] for r in rows], pa.int64()),
                    "paths": pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                }
            )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections (a node's documents are few).

    Shingles of a few documents are counted pair by pair, the others by a matrix product."""
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]], float)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.zeros(n * n)
    rare = (count > 1) & (count <= RARE)
    some = np.flatnonzero(rare[column])
    some = some[np.argsort(column[some] * n + row[some])]
    c, r = column[some], row[some]
    for d in range(1, RARE):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        out += np.bincount(r[same] * n + r[same + d], minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    often = count > RARE
    place = np.cumsum(often) - 1
    some = np.flatnonzero(often[column])
    some = some[np.argsort(column[some])]
    c, r = place[column[some]], row[some]
    width = max(64, (1 << 20) // n)
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(c, [lo, lo + width])
        x = np.zeros((n, width), np.float32)
        x[r[a:b], c[a:b] - lo] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def connected(sets: list[np.ndarray], percent: int, likeness: bool = False) -> tuple[list[int], float | None]:
    """For each of some documents the first that it is connected with by links among them;
    if asked for, the mean third power of the similarity of two of them."""
    n, size = len(sets), np.array([len(s) for s in sets], float)
    inter = overlaps(sets)
    union = size[:, None] + size[None, :] - inter
    cubes = (((inter / union) ** 3).sum() - n) / (n * (n - 1)) if likeness else None
    link = 100 * inter >= percent * union
    root = np.arange(n)
    while True:
        best = np.where(link, root[None, :], n).min(1)
        best = np.minimum(best, root)
        if (best == root).all():
            return root.tolist(), cubes
        root = best


def _compare(percent: int, likeness: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, key, hash, text), sorted by node, to (node, key, hash, the key and hash of the root, cubes)."""
        node, uniq = None, {}

        def done():
            if len(uniq) < 2:
                return []
            found = sorted(uniq)
            roots, cubes = connected(shingle_sets([uniq[x] for x in found]), percent, likeness)
            return [(node, *x, *found[r], cubes) for x, r in zip(found, roots)]

        def batch(out):
            kinds = {"node": pa.string(), "key": pa.int64(), "hash": pa.int64(), "root_key": pa.int64(), "root_hash": pa.int64(), "cubes": pa.float64()}
            return pa.RecordBatch.from_pydict({c: pa.array(x, t) for (c, t), x in zip(kinds.items(), zip(*out))})

        out: list = []
        for rows in slices(batches):
            for n, i, h, t in zip(*rows):
                if n != node:
                    out += done()
                    node, uniq = n, {}
                uniq.setdefault((i, h), t)
            if out:
                yield batch(out)
                out = []
        out = done()
        if out:
            yield batch(out)

    return run


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, hash, text, nodes (node, trees)) to (key, hash, size, node): each node three branchings on in trees of its own, by tokens that the node selects."""
    for ids, hashes, texts, nodes in slices(batches):
        out: list[list] = [[], [], [], []]
        for lo, hi in chunks(texts, CHUNK_CHARS):
            for i, h, s, own in zip(ids[lo:hi], hashes[lo:hi], shingle_sets(texts[lo:hi]), nodes[lo:hi]):
                for p in own:
                    root = np.array(p["node"], np.int64).view(np.uint64)
                    found = paths([s], mixed(root + np.arange(1, p["trees"] * sum(_LEVELS) + 1, dtype=np.uint64)), root)[0]
                    for c, x in zip(out, ([i] * len(found), [h] * len(found), [len(s)] * len(found), found.tolist())):
                        c += x
        yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(("key", "hash", "size", "node"), out)})


def _with_text(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``members`` (doc, ...) with their text; small member tables (n rows) are broadcast."""
    return texts.join(F.broadcast(members) if n <= BROADCAST_ROWS else members, "doc")


def _doc(key: str = "key", hash_: str = "hash"):
    """A text's name: its key and hash as one struct."""
    return F.struct(F.col(key).alias("key"), F.col(hash_).alias("hash")).alias("doc")


def _once(texts: DataFrame, features: DataFrame, classes: DataFrame) -> DataFrame:
    """``texts`` with one row for each of a class's chosen texts that occurs in several rows."""
    again = features.where("n_shingles > 0").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc")
    again = materialize(again, "repeated")
    n = again.count()
    if not n:
        return texts
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    # combined before the shuffle: a task gives one row for each
    one = materialize(texts.join(again, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")), "once")
    return texts.join(again, "doc", "left_anti").select("doc", "text").unionAll(one)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, node: int = NODE, rounds: int = ROUNDS, shingles: int = SHINGLES) -> DataFrame:
    """``key``, n_shingles, component_id, kept for every row: documents are linked whose 5-word
    shingle sets have 100 * intersection >= percent * union."""
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    d = d.select("key", F.xxhash64("text").alias("hash"), "text")
    features = d.mapInArrow(_features, "key long, hash long, n_shingles long, s1 long, s2 long, paths array<long>")
    features = materialize(features.select(_doc(), "n_shingles", "s1", "s2", "paths"), "features")
    texts = d.where("key is not null").select(_doc(), "text")
    named = features.where("n_shingles > 0 and doc.key is not null")
    classes = materialize(named.groupBy("s1", "s2").agg(F.min("doc").alias("rep")), "classes")
    every = _once(texts, named, classes)
    reps = features.join(classes.withColumnRenamed("rep", "doc"), ["doc", "s1", "s2"])
    if every is not texts:
        texts, reps = every, reps.dropDuplicates(["doc"])
    members = reps.select("doc", F.col("n_shingles").alias("size"), F.explode("paths").alias("node"))
    found: list[DataFrame] = []

    def compare(chunked: DataFrame, likeness: bool = False) -> DataFrame:
        """Links of the documents (node string, doc) of each node."""
        chunked = materialize(chunked, "members")
        rows = _with_text(chunked, texts, chunked.count()).select("node", "doc.key", "doc.hash", "text").repartition("node").sortWithinPartitions("node")
        out = rows.mapInArrow(_compare(percent, likeness), "node string, key long, hash long, root_key long, root_hash long, cubes double")
        out = materialize(out.select("node", _doc(), _doc("root_key", "root_hash").alias("root"), "cubes"), "links")
        found.append(out.where("root.key <> doc.key").select(F.col("root.key").alias("a"), F.col("doc.key").alias("b")))
        return out

    for step in range(rounds):
        nodes = materialize(members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.sum(F.shiftright(F.xxhash64("doc"), 20)).alias("sum"), F.min("doc").alias("low")).where("n > 1"), "nodes")
        fits = f"(n <= {node} and (shingles <= {shingles} or n = 2))"
        # nodes that hold the same documents are compared once
        small = nodes.where(fits).groupBy("n", "sum", "low").agg(F.min("node").alias("node")).select("node")
        compare(members.join(small, "node").select(F.col("node").cast("string").alias("node"), "doc"))
        large = nodes.where(f"not {fits}")
        # so are large ones, which branch on in as many trees as they stand for
        large = large.groupBy("n", "shingles", "sum", "low").agg(F.min("node").alias("node"), F.least(F.count(F.lit(1)), F.lit(TREES)).cast("int").alias("trees"))
        if large.isEmpty():
            break
        held = materialize(members.join(large, "node").withColumn("chunks", F.greatest(F.ceil(F.col("n") / (node // 2)), F.ceil(F.col("shingles") / (shingles // 2))).cast("int")).select("node", "doc", "n", "low", "trees", "chunks"), "large")
        spread = F.pmod(F.xxhash64("doc", F.lit(step)), F.col("chunks")).cast("int")
        pivot = (F.col("doc") == F.col("low")) | (F.pmod(F.xxhash64("doc", "node"), F.lit(1 << 30)) < F.lit(float(PIVOTS << 30)) / F.col("n"))
        name = F.concat_ws(":", "node", "chunk")
        cut = held.withColumn("chunk", spread).select(name.alias("node"), "doc").unionAll(held.where(pivot).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(name.alias("node"), "doc")).distinct()
        roots = compare(cut, True).withColumn("node", F.split("node", ":")[0].cast("long"))
        likeness = roots.groupBy("node").agg(F.avg("cubes").alias("cubes"))
        loose = roots.join(large.select("node", "low"), "node").where("root <> low").select("node", "doc").distinct()
        loose = materialize(loose, "loose")
        if loose.isEmpty():
            break
        # comparisons for each document: of paths (a path itself costs about as much as node / 8), of blocks
        sizes = large.select("node", "n", "shingles", "trees").join(loose.groupBy("node").agg(F.count(F.lit(1)).alias("loose")), "node").join(likeness, "node")
        saves = F.expr(f"{_LEVELS[-1]} * trees * (n * cubes + {node / 8}) < loose / 2")
        sizes = materialize(sizes.withColumn("branch", saves & F.lit(step + 1 < rounds)), "open")
        half = node // 2
        many = sizes.where("not branch").select("node", F.ceil(F.greatest(F.col("loose") / half, F.col("shingles") / (shingles // 2) * F.col("loose") / F.col("n"))).cast("int").alias("blocks"))
        if not many.isEmpty():
            # exact: the node's unconnected documents, in blocks, against all of the node, in blocks
            left = held.join(many, "node").withColumn("chunk", spread)
            ours = F.pmod(F.xxhash64("doc", F.lit(-1)), F.col("blocks")).cast("int")
            name = F.concat_ws(":", "node", "chunk", "block")
            a = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(name.alias("node"), "doc")
            b = left.join(loose, ["node", "doc"], "left_semi").withColumn("block", ours).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(name.alias("node"), "doc")
            compare(a.unionAll(b).distinct())
        own = materialize(held.join(sizes.where("branch").select("node"), "node").groupBy("doc").agg(F.collect_list(F.struct("node", "trees")).alias("nodes")), "branching")
        if own.isEmpty():
            break
        deeper = _with_text(own, texts, own.count()).select("doc.key", "doc.hash", "text", "nodes").mapInArrow(_deeper, "key long, hash long, size long, node long")
        members = materialize(deeper.select(_doc(), "size", "node").distinct(), "deeper")
    # a key with several classes is one document: each class is linked with it
    several = named.groupBy("doc.key").agg(F.min(F.struct("s1", "s2")).alias("a"), F.max(F.struct("s1", "s2")).alias("b")).where("a <> b").select("key")
    own = named.select("doc.key", "s1", "s2").join(several, "key", "left_semi").distinct().join(classes, ["s1", "s2"])
    links = own.where("rep.key <> key").select(F.col("rep.key").alias("a"), F.col("key").alias("b"))
    for f in found:
        links = links.unionAll(f)
    tops = classes.select("s1", "s2", F.col("rep.key").alias("rep")).join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = features.select("doc.key", "n_shingles", "s1", "s2").join(tops, ["s1", "s2"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))
