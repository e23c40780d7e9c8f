"""Reachability by labels, and eccentricities by neighbourhood sketches: both without the pairs of a closure.

Two-hop labels: every strong component keeps a few landmarks that it reaches and a few that reach it, such that a component a reaches b
if, and only if, a landmark stands in the first list of a and the second of b. Nodes are taken out first, many at once and those of low degree
first, as long as the edges that lead past them are not more than those that go: a node's lists are its own name and the lists of the
neighbours that it had then. So rounds grow with the logarithm of a path, and no two landmarks' lists are compared. In what is
left (a dense core) landmarks are taken in batches by falling degree; each batch is searched in both directions at once, and a search does
not go on behind a component whose question the labels at hand already answer. Many questions are then one join.

A neighbourhood sketch is a distinct-count sketch of what a node reaches in so many steps; in a round each node takes the union of
its own and its neighbours'. The last round that raises a node's count is its eccentricity. A sketch of 2^SKETCH cells holds up to
a tenth as many nodes one by one, in 4 bytes each; beyond that it has a byte for each cell, and may miss a last step that adds few nodes to many.
So an eccentricity can come out too low, never too high: for d new nodes among n with a chance of about (1 - exp(-n / 2^SKETCH))^d.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import iterate
from graphloom.session import discard, materialize

#: Landmarks of the first batch, and how much larger each next one is.
FIRST, GROWTH = 16, 16
#: The share of the edges that a round of sketches drops at least; with fewer none is looked for any more.
SHRINK = 1 / 8
#: The share of the nodes at hand that a round takes out at least (with fewer the rest is the core); what share of sinks or sources are many; and
#: how many times the mean degree a hub has. Sinks or sources are many as well if they have the share MOST of the edges.
TAKEN, MANY, HUB, MOST = 1 / 16, 1 / 4, 4, 1 / 2
SKETCH = 17


def _answered(pairs: DataFrame, out: DataFrame, into: DataFrame) -> DataFrame:
    """The pairs (a, b) for which a landmark of a is one of b."""
    return pairs.join(out.withColumnRenamed("node", "a"), "a").join(into.withColumnRenamed("node", "b"), ["b", "mark"]).select("a", "b").distinct()


def two_hop_labels(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, mark) lists of what nodes reach, and of what reaches them, of an acyclic graph (src, dst); a node is its own landmark."""
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "dag")
    degree = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    ranked = nodes.select("id").distinct().join(degree, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    from graphloom.operators import ordering

    # equal degrees in the order of a hash, so that the landmarks of a long path are spread over it
    order = materialize(ordering.running(ranked.select("id", (-F.col("d")).alias("m"), F.xxhash64("id").alias("h")), ["m", "h", "id"], out="place").select("id", "place"), "order")
    n = order.count()
    kind = nodes.schema["id"].dataType.simpleString()
    none = nodes.sparkSession.createDataFrame([], f"node {kind}, mark {kind}")
    out, into, done, size = none, none, 0, FIRST
    while done < n:
        batch = order.where((F.col("place") > done) & (F.col("place") <= done + size))
        found = []
        for forward in (True, False):
            step = e if forward else e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            # searched: the mark of each search, and where it stands
            seen = materialize(batch.select(F.col("id").alias("mark"), F.col("id").alias("node")), "seen")
            front = seen
            while not front.isEmpty():
                new = front.withColumnRenamed("node", "src").join(step, "src").select("mark", F.col("dst").alias("node")).distinct().join(seen, ["mark", "node"], "left_anti")
                if done:
                    # what older landmarks tell is neither kept nor gone on from
                    asked = new.select(F.col("mark" if forward else "node").alias("a"), F.col("node" if forward else "mark").alias("b"))
                    told = _answered(asked, out, into)
                    new = new.join(told.select(F.col("a" if forward else "b").alias("mark"), F.col("b" if forward else "a").alias("node")), ["mark", "node"], "left_anti")
                front = materialize(new.select("mark", "node"), "front")
                old, seen = seen, materialize(seen.unionAll(front), "seen")
                discard(old)
            found.append(seen.select("node", "mark"))
        # of the batch itself: what a landmark of an earlier place answers is taken out
        ahead = order.where(F.col("place") <= done + size).select(F.col("id").alias("mark"), "place")
        lists = [into.unionAll(found[0]), out.unionAll(found[1])]
        for i in (0, 1):
            mine, theirs = found[i].join(ahead, "mark"), lists[1 - i]
            via = lists[i].join(ahead, "mark").select("node", F.col("mark").alias("by"), F.col("place").alias("first"))
            met = theirs.select(F.col("node").alias("mark"), F.col("mark").alias("by"))
            told = mine.join(via, "node").where("first < place").join(met, ["mark", "by"]).select("node", "mark").distinct()
            lists[i] = found[i].join(told, ["node", "mark"], "left_anti").select("node", "mark")
        old, found = (out, into), lists
        into, out = materialize(into.unionAll(found[0]), "into"), materialize(out.unionAll(found[1]), "out")
        for x in old:
            discard(x)
        done, size = done + size, size * GROWTH
    return out, into


def _round(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float, str]:
    """One round of taking nodes out of (src, dst): (what is left with the edges past the nodes, the edges with marks ``s`` and ``d`` of the
    ends that went, the nodes that went, the larger share of nodes or edges that went with them, which marks there are). No two that go are neighbours: all sinks
    or all sources if they or their edges are many, or those of lower degree than their neighbours."""
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = materialize(ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")), "degree")
    d = F.col("o") + F.col("i")
    n = degree.agg(F.count(F.lit(1)).alias("nodes"), F.sum("o").alias("edges"), F.avg(d).alias("mean"), F.avg(F.when(F.col("o") == 0, d)).alias("d"), F.avg(F.when(F.col("i") == 0, d)).alias("s")).first()
    # ends of the graph are no neighbours of each other; those of hubs wait, or their lists would be long
    some = {}
    for mark, none in (("d", "o"), ("s", "i")):
        x = degree.where((F.col(none) == 0) & (d <= HUB * max(n["mean"], n[mark] or 0)))
        some[mark] = (x.select("id"), *x.agg(F.count(F.lit(1)), F.coalesce(F.sum(d), F.lit(0))).first())
    mark, (ending, count, taken) = max(some.items(), key=lambda x: max(x[1][1] / n["nodes"], x[1][2] / n["edges"]))
    if count >= MANY * n["nodes"] or taken >= MOST * n["edges"]:
        gone = materialize(ending, "gone")
        # no edge leads past a sink or a source
        end = {"d": "dst", "s": "src"}[mark]
        there = e.join(gone.select(F.col("id").alias(end), F.lit(True).alias("gone")), end, "left").select("src", "dst", F.col("gone").isNotNull().alias(mark), F.lit(False).alias({"d": "s", "s": "d"}[mark]))
        marked = materialize(there, "marked")
        discard(degree)
        return marked.where("not s and not d").select("src", "dst"), marked, gone, max(count / n["nodes"], taken / n["edges"]), mark
    free = degree.where("o * i <= o + i").select("id", d.alias("d"))
    key = lambda c: F.struct(F.col(f"{c}_d"), F.xxhash64(c), F.col(c))
    both = e.join(free.toDF("src", "src_d"), "src").join(free.toDF("dst", "dst_d"), "dst")
    later = both.select(F.when(key("src") < key("dst"), F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
    gone = materialize(free.select("id").join(later, "id", "left_anti"), "gone")
    mark = lambda c: gone.select(F.col("id").alias(c), F.lit(True).alias(c[0]))
    marked = materialize(e.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").select("src", "dst", F.coalesce("s", F.lit(False)).alias("s"), F.coalesce("d", F.lit(False)).alias("d")), "marked")
    past = marked.where("d").select("src", F.col("dst").alias("via")).join(marked.where("s").select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
    left = materialize(marked.where("not s and not d").select("src", "dst").unionAll(past).distinct(), "left")
    discard(degree)
    return left, marked, gone, gone.count() / n["nodes"], "sd"


def label_lists(edges: DataFrame, nodes: DataFrame, acyclic: bool = True) -> tuple[DataFrame, DataFrame] | None:
    """(node, marks) of what each node reaches, and of what reaches it, of a graph (src, dst; written, as rounds read it) without cycles: a row for each node. None if it
    has a cycle, which is looked for unless the graph is said to have none: edges past the nodes make a loop of it, or it is in the core."""
    # an edge that comes twice does no harm, so all edges are not shuffled for that
    e = edges.select("src", "dst").where("src <> dst")
    rounds = []
    while not e.isEmpty():
        left, marked, gone, share, marks = _round(e)
        discard(e)
        e = left
        rounds.append((marked, gone, marks))
        if not acyclic and marks == "sd" and not e.where("src = dst").isEmpty():
            return None
        if share < TAKEN:
            break
    if not acyclic and not e.isEmpty() and iterate.has_cycle(e):
        return None
    own = nodes.select(F.col("id").alias("node")).distinct()
    for _, gone, _ in rounds:
        own = own.join(gone.withColumnRenamed("id", "node"), "node", "left_anti")
    own = materialize(own, "own")
    if e.isEmpty():
        held = [own.select("node", F.array("node").alias("marks"))] * 2
    else:
        # nodes without edges are of the core too, and have their own names
        held = [materialize(x.groupBy("node").agg(F.collect_list("mark").alias("marks")), "lists") for x in two_hop_labels(e, own.withColumnRenamed("node", "id"))]
    for marked, gone, marks in reversed(rounds):
        name = gone.select(F.col("id").alias("node"), F.array("id").alias("marks"))
        new = []
        for there, (end, node, up) in zip(held, (("s", "src", "dst"), ("d", "dst", "src"))):
            if end not in marks:
                new.append(materialize(name, "lists"))
                continue
            got = marked.where(end).select(F.col(node).alias("of"), F.col(up).alias("node")).join(there, "node").select(F.col("of").alias("node"), "marks")
            new.append(materialize(name.unionAll(got).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks")), "lists"))
        held = [x.unionAll(y) for x, y in zip(held, new)]
        discard(gone)
    for marked, _, _ in rounds:
        discard(marked)
    return held[0], held[1]


class ReachabilityIndex:
    """Labels of a directed graph in the folder ``path``: whether one node reaches another is a join. A node reaches itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(edges: DataFrame, nodes: DataFrame | None, path: str, acyclic: bool = False) -> ReachabilityIndex:
        """Strong components are found where there is a cycle; it is not looked for if the graph is said to have none. ``nodes`` None: the ends of the
        edges. Nodes are numbered, so that edges and labels are of numbers: by their hash, which needs no join, if no two nodes share one.
        Without cycles lists are stored by the nodes' own ids."""
        spark, path = edges.sparkSession, path.rstrip("/")
        names = None
        if nodes is None:
            edges = materialize(edges.select("src", "dst", F.xxhash64("src").alias("src_n"), F.xxhash64("dst").alias("dst_n")), "edges")
            names = materialize(edges.select(F.col("src").alias("id"), F.col("src_n").alias("component")).unionAll(edges.select("dst", "dst_n")).where("id is not null").distinct(), "names")
            nodes = names
            if names.groupBy("component").count().where("count > 1").isEmpty():
                e = edges.where("src is not null and dst is not null and src_n <> dst_n").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"))
            else:
                names = None
        if names is None:
            names = materialize(nodes.select("id").distinct().select("id", F.monotonically_increasing_id().alias("component")), "names")
            number = lambda c: names.select(F.col("id").alias(c), F.col("component").alias(f"{c}_n"))
            e = edges.select("src", "dst").where("src <> dst").join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"))
            e = materialize(e, "numbers")
        every = names.select(F.col("component").alias("id"))
        lists = label_lists(e, every, acyclic)
        if lists is not None:
            tables = [(name, names.join(d, F.col("component") == F.col("node")).select("id", "marks"), "id") for name, d in zip(("out", "into"), lists)]
        else:
            found = materialize(iterate.strong_components(iterate.trimmed(e), every).select("id", F.col("component").alias("to")), "components")
            of = names.join(found.withColumnRenamed("id", "component"), "component").select("id", F.col("to").alias("component"))
            e = e.join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
            e = materialize(e, "numbers")
            out, into = label_lists(e, found.select(F.col("to").alias("id")).distinct())
            tables = [("components", of, "id"), ("out", out, "node"), ("into", into, "node")]
        for name, d, by in tables:
            d.repartitionByRange(F.col(by)).sortWithinPartitions(by).write.mode("overwrite").parquet(f"{path}/{name}")
        return ReachabilityIndex(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def labels(self) -> DataFrame:
        """(kind, n): how many entries both lists have."""
        n = lambda kind: self._table(kind).select(F.lit(kind).alias("kind"), F.size("marks").alias("n"))
        return n("out").unionAll(n("into")).groupBy("kind").agg(F.sum("n").alias("n"))

    def reaches(self, questions: DataFrame) -> DataFrame:
        """(src, dst, reaches) of distinct questions (src, dst); nodes that the graph does not have reach nothing, not even themselves."""
        q = questions.select("src", "dst").distinct()
        out, into = self._table("out"), self._table("into")
        if "id" in out.columns:
            told = q.join(out.toDF("src", "a_marks"), "src", "left").join(into.toDF("dst", "b_marks"), "dst", "left")
            return told.select("src", "dst", F.coalesce(F.arrays_overlap("a_marks", "b_marks"), F.lit(False)).alias("reaches"))
        of = self._table("components")
        named = q.join(of.select(F.col("id").alias("src"), F.col("component").alias("a")), "src", "left").join(of.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst", "left")
        told = named.join(out.toDF("a", "a_marks"), "a", "left").join(into.toDF("b", "b_marks"), "b", "left")
        return told.select("src", "dst", F.coalesce(F.arrays_overlap("a_marks", "b_marks"), F.lit(False)).alias("reaches"))


def eccentricities(edges: DataFrame, nodes: DataFrame, size: int = SKETCH) -> DataFrame:
    """(id, eccentricity, reached): the longest hop distance to any node that is reached, and about how many are (itself included).

    A round sends along every edge one sketch and unites them where they arrive, in tasks first, so a hub costs a sketch a task; nodes whose
    neighbours did not change send nothing. The first round makes sketches of the edges themselves. An edge to a node that can get nothing
    any more goes, and a node without edges is done: neither is read or written in later rounds.
    """
    e = edges.select("src", "dst").where("src <> dst")
    # sketches take an edge twice as once
    near = e.select(F.col("src").alias("id"), F.explode(F.array("src", "dst")).alias("near")).groupBy("id").agg(F.hll_sketch_agg("near", F.lit(size)).alias("held"))
    held = materialize(near.select("id", "held", F.hll_sketch_estimate("held").alias("reached"), F.lit(1).alias("eccentricity"), F.lit(True).alias("changed")), "sketch")
    result = lambda d: d.select("id", F.col("eccentricity").cast("double").alias("eccentricity"), "reached")
    done = result(nodes.select("id").distinct().join(held.select("id"), "id", "left_anti").select("id", F.lit(0).alias("eccentricity"), F.lit(1).cast("long").alias("reached")))
    rounds, n = 1, None
    while not held.where("changed").isEmpty():
        rounds += 1
        stay = held
        if n != 0:
            # of the edges those to nodes that had edges in the round before
            fewer = materialize(e.join(held.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "hops")
            was, n = n, fewer.count()
            discard(e)
            e, live = fewer, materialize(fewer.select(F.col("src").alias("id")).distinct(), "live")
            done = done.unionAll(result(held.join(live, "id", "left_anti")))
            stay = held.join(live, "id", "left_semi")
            if not n:
                return done
            if was is not None and n > (1 - SHRINK) * was:
                n = 0
        sent = held.where("changed").select(F.col("id").alias("dst"), "held").join(e, "dst").groupBy(F.col("src").alias("id")).agg(F.hll_union_agg("held").alias("got"))
        both = stay.drop("changed").join(sent, "id", "left").withColumn("new", F.when(F.col("got").isNotNull(), F.hll_union("held", "got")).otherwise(F.col("held")))
        more = F.hll_sketch_estimate("new") > F.col("reached")
        old, held = held, materialize(
            both.select("id", F.col("new").alias("held"), F.when(more, F.hll_sketch_estimate("new")).otherwise(F.col("reached")).alias("reached"), F.when(more, F.lit(rounds)).otherwise(F.col("eccentricity")).alias("eccentricity"), more.alias("changed")), "sketch"
        )
        if stay is old:
            discard(old)
    return done.unionAll(result(held))
