"""Communities by modularity, isomorphism by colour refinement, and maximal cliques in degeneracy order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import ordering
from graphloom.session import discard, materialize

# communities --------------------------------------------------------------------------------------


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of both directions, weights of parallel edges added up (1 where there is none); a loop counts twice."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("weight"))
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def modularity(both: DataFrame, labels: DataFrame) -> float:
    """Of communities (id, label) in a symmetric graph: the share of weight inside, less what degrees alone would give; 0 without edges."""
    named = both.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    per = named.groupBy("a").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    inside, total, squares = per.agg(F.sum("inside"), F.sum("total"), F.sum(F.col("total") * F.col("total"))).first()
    return 0.0 if not total else inside / total - squares / (total * total)


def _moves(both: DataFrame, nodes: DataFrame, rounds: int, least: float, salt: int) -> tuple[DataFrame, float]:
    """(labels, modularity) of one level: in a round, half of the nodes (by hash, another half each time) go to the neighbouring community of
    largest gain, if it is better than their own; equal gains: the smaller label. Ends when rounds no longer raise the modularity."""
    degree = materialize(nodes.join(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k")), "degree")
    whole = degree.agg(F.sum("k")).first()[0] or 0.0
    label = materialize(degree.select("id", F.col("id").alias("label")), "community")
    best, score, idle = label, modularity(both, label), 0
    if not whole:
        return label, 0.0
    links = materialize(both.where("src <> dst"), "links")
    for r in range(rounds):
        total = label.join(degree, "id").groupBy("label").agg(F.sum("k").alias("total"))
        near = links.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        own = label.join(degree, "id").select("id", F.col("label").alias("own"), "k")
        # a node's own community is a candidate too, also where it has no link into it
        seen = near.unionAll(label.select("id", "label", F.lit(0.0).alias("w"))).groupBy("id", "label").agg(F.sum("w").alias("w")).join(own, "id").join(total, "label")
        gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)) / whole, 9)
        ranked = seen.groupBy("id").agg(F.min(F.struct((-gain).alias("g"), "label")).alias("top"), F.max(F.when(F.col("label") == F.col("own"), gain)).alias("here"), F.first("own").alias("own"))
        moves = (F.pmod(F.xxhash64(F.lit(salt + r), "id"), F.lit(2)) == 0) & (-F.col("top.g") > F.col("here"))
        new = materialize(ranked.select("id", F.when(moves, F.col("top.label")).otherwise(F.col("own")).alias("label")), "community")
        if label is not best:
            discard(label)
        label, now = new, modularity(both, new)
        if now > score + least:
            if best is not label:
                discard(best)
            best, score, idle = label, now, 0
        else:
            idle += 1
            if idle == 2:
                break
    return best, score


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 12, levels: int = 8, least: float = 1e-6) -> DataFrame:
    """(id, label): communities of large modularity in the undirected view, named by their smallest node.

    Nodes move by gain, then each community becomes a node of a smaller graph, which is worked on in the same way, level by level, until
    that raises the modularity no more. A level holds a weight for each pair of linked communities.
    """
    both = materialize(symmetric(edges), "weights")
    here = materialize(nodes.select("id").distinct(), "members")
    of, score = here.select("id", F.col("id").alias("label")), None
    for level in range(levels):
        label, now = _moves(both, here, rounds, least, 1000 * level)
        if score is not None and now <= score + least:
            break
        score = now
        of = materialize(of.join(label.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label")), "communities")
        a, b = label.select(F.col("id").alias("src"), F.col("label").alias("a")), label.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        old, both = both, materialize(both.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "weights")
        discard(old)
        here = materialize(label.select(F.col("label").alias("id")).distinct(), "members")
    first = of.groupBy("label").agg(F.min("id").alias("first"))
    return of.join(first, "label").select("id", F.col("first").alias("label"))


# isomorphism --------------------------------------------------------------------------------------


def _refined(edges: DataFrame, color: DataFrame) -> DataFrame:
    """(g, id, color) that no round splits any more. A round hashes a node's colour with sums of its neighbours' hashed colours, one way and the
    other: sums need no lists, so a hub costs two numbers."""
    count = lambda c: c.groupBy("g").agg(F.count_distinct("color").alias("n")).agg(F.max("n")).first()[0]
    n = count(color)
    while True:
        parts = []
        for at, to, salt in (("src", "dst", 1), ("dst", "src", 2)):
            near = edges.join(color.select("g", F.col("id").alias(to), "color"), ["g", to])
            h = F.xxhash64(F.lit(salt), "color")
            low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
            parts.append(near.select("g", F.col(at).alias("id"), *[x.alias(f"{k}{s}") if s == salt else F.lit(0).cast("long").alias(f"{k}{s}") for s in (1, 2) for k, x in (("l", low), ("h", high))]))
        sums = parts[0].unionByName(parts[1]).groupBy("g", "id").agg(*[F.sum(c).alias(c) for c in ("l1", "h1", "l2", "h2")])
        mixed = color.join(sums, ["g", "id"], "left").select("g", "id", F.xxhash64("color", *[F.coalesce(c, F.lit(0).cast("long")) for c in ("l1", "h1", "l2", "h2")]).alias("color"))
        old, color = color, materialize(mixed, "colors")
        discard(old)
        now = count(color)
        if now == n:
            return color
        n = now


def color_classes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, color): the stable colouring of a directed graph; nodes of one colour cannot be told apart by refinement."""
    e = materialize(edges.select(F.lit(0).alias("g"), "src", "dst"), "refine")
    return _refined(e, materialize(nodes.select(F.lit(0).alias("g"), "id", F.lit(0).cast("long").alias("color")).distinct(), "colors")).select("id", "color")


def isomorphism(edges_a: DataFrame, edges_b: DataFrame, nodes_a: DataFrame | None = None, nodes_b: DataFrame | None = None, tries: int = 64, order_a: Column | None = None, order_b: Column | None = None) -> DataFrame | None:
    """(a, b): a mapping of the nodes that makes the one directed multigraph the other, or None if there is none.

    Both graphs are coloured together. Differing classes settle it; else the nodes of each class are paired in the order of ``order_a`` and ``order_b`` (of
    the column id; by default the id itself), and that mapping is checked edge by edge: classes of one node, and nodes that can be swapped for each other, need no more.
    If it fails, a node of the smallest class gets a colour of its own, with each node of its class on the other side in turn, and the
    colouring goes on. More than ``tries`` such pairs are refused: the graphs are too symmetric for this way. So of several
    mappings the one that keeps the orders is taken, if there is one.
    """
    ends = lambda e: e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id")))
    both = lambda a, b: materialize(a.withColumn("g", F.lit(0)).unionByName(b.withColumn("g", F.lit(1))), "refine")
    e = both(edges_a.select("src", "dst"), edges_b.select("src", "dst"))
    nodes = [(ends(x) if n is None else n.select("id").unionAll(ends(x))).distinct() for x, n in ((edges_a, nodes_a), (edges_b, nodes_b))]
    start = materialize(nodes[0].withColumn("g", F.lit(0)).unionByName(nodes[1].withColumn("g", F.lit(1))).select("g", "id", F.lit(0).cast("long").alias("color")), "colors")
    left = [tries]

    def settle(color: DataFrame) -> DataFrame | None:
        color = _refined(e, color)
        sizes = color.groupBy("color").agg(F.count_if(F.col("g") == 0).alias("a"), F.count_if(F.col("g") == 1).alias("b"))
        if not sizes.where("a <> b").isEmpty():
            return None
        # classes are of one size on both sides, so equal places have equal colours
        ranked = [ordering.running(color.where(F.col("g") == g).select("color", F.col("id").alias(name), (F.col("id") if o is None else o).alias("by_")), ["color", "by_", name], out="place") for g, name, o in ((0, "a", order_a), (1, "b", order_b))]
        pair = materialize(ranked[0].select("place", "a").join(ranked[1].select("place", "b"), "place").select("a", "b"), "mapping")
        moved = e.where("g = 0").join(pair.select(F.col("a").alias("src"), F.col("b").alias("s")), "src").join(pair.select(F.col("a").alias("dst"), F.col("b").alias("t")), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))
        there = e.where("g = 1").select("src", "dst")
        if moved.exceptAll(there).isEmpty() and there.exceptAll(moved).isEmpty():
            return pair
        discard(pair)
        open_ = sizes.where("a > 1").orderBy("a", "color").limit(1).collect()
        if not open_:
            return None
        chosen = color.where(F.col("color") == open_[0]["color"])
        one = chosen.where("g = 0").agg(F.min("id")).first()[0]
        for (other,) in chosen.where("g = 1").select("id").orderBy("id").limit(left[0] + 1).collect():
            if left[0] == 0:
                raise RuntimeError(f"more than {tries} pairs of nodes would have to be tried")
            left[0] -= 1
            own = ((F.col("g") == 0) & (F.col("id") == one)) | ((F.col("g") == 1) & (F.col("id") == other))
            found = settle(materialize(color.withColumn("color", F.when(own, F.lit(-1).cast("long")).otherwise(F.col("color"))), "colors"))
            if found is not None:
                return found
        return None

    return settle(start)


# cliques ------------------------------------------------------------------------------------------


def _grow(masks: list[int], n: int) -> list[list[int]]:
    """Maximal cliques of a small graph given by bit masks of neighbours: backtracking with a pivot of most candidates."""
    out: list[list[int]] = []
    stack = [([], (1 << n) - 1, 0)]
    while stack:
        clique, open_, done = stack.pop()
        if not open_ and not done:
            out.append(clique)
            continue
        pivot, most, both = 0, -1, open_ | done
        while both:
            low = both & -both
            i = low.bit_length() - 1
            if (k := (open_ & masks[i]).bit_count()) > most:
                pivot, most = i, k
            both ^= low
        todo = open_ & ~masks[pivot]
        while todo:
            low = todo & -todo
            i = low.bit_length() - 1
            stack.append(([*clique, i], open_ & masks[i], done & masks[i]))
            open_, done, todo = open_ ^ low, done | low, todo ^ low
    return out


def maximal_cliques(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(clique): sorted arrays, of the undirected view; a node without neighbours is one by itself.

    Nodes are ordered by degree; a node's task gets the links among its later neighbours (the triangles that it begins), at most about the square root
    of twice the edges of them, and grows the cliques that begin with it. Those to which an earlier node can be added are
    found again from that node, so they are taken out: by a join of cliques with the earlier neighbours of their members.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    e = materialize(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "pairs")
    deg = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    ranked = e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = materialize(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")), "upward")
    wedge = o.alias("x").join(o.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    links = wedge.join(e, ["a", "b"]).select("u", "a", "b")
    # a node's later neighbours stand by themselves (a = b) and with their links
    rows = o.select("u", F.col("v").alias("a"), F.col("v").alias("b")).unionAll(links)
    # by a number, as Spark would take these few bytes together for one task
    rows = rows.repartition(edges.sparkSession.sparkContext.defaultParallelism, "u")

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        names = sorted(x for x, y in zip(a, b) if x == y)
        place, masks = {x: i for i, x in enumerate(names)}, [0] * len(names)
        for x, y in zip(a, b):
            if x != y:
                masks[place[x]] |= 1 << place[y]
                masks[place[y]] |= 1 << place[x]
        first = key[0].as_py()
        found = [sorted([first, *(names[i] for i in c)]) for c in _grow(masks, len(names))]
        return pa.table({"first": pa.array([first] * len(found), t.schema.field("u").type), "clique": pa.array(found, pa.list_(t.schema.field("u").type))})

    found = materialize(rows.groupBy("u").applyInArrow(grow, f"first {kind}, clique array<{kind}>"), "cliques")
    # an earlier neighbour of the first node that all other members have too
    earlier = found.join(o.select(F.col("v").alias("first"), F.col("u").alias("before")), "first").select("clique", "before", F.explode("clique").alias("member"), "first").where("member <> first")
    linked = o.select(F.col("u").alias("before"), F.col("v").alias("member")).unionAll(o.select(F.col("v").alias("before"), F.col("u").alias("member")))
    more = earlier.join(linked, ["before", "member"]).groupBy("clique", "before").agg(F.count(F.lit(1)).alias("n")).where("n = size(clique) - 1").select("clique").distinct()
    alone = nodes.select("id").distinct().join(deg.select("id"), "id", "left_anti").select(F.array("id").alias("clique"))
    return found.select("clique").join(more, "clique", "left_anti").unionAll(alone)
