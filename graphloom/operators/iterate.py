"""Iterative graph algorithms as loops over DataFrames.

Every round is cut off by a written table in the shared folder (never a local checkpoint), so plans stay
small and a lost executor costs a reread. Loops end when a frontier is empty or nothing has changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import discard, materialize


def bfs(edges: DataFrame, start, depth: int | None = None, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(id, depth) of every node reached within ``depth`` steps, the start (a node, or a table of ids: any of them) included."""
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    out, into = e.select("src", "dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = {"out": out, "in": into, "both": out.unionAll(into)}[direction]
    kind = edges.schema["src"].dataType
    first = start.select("id").distinct() if isinstance(start, DataFrame) else edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"))
    seen = first.select("id", F.lit(0).alias("depth"))
    frontier, step = seen, 0
    while depth is None or step < depth:
        step += 1
        new = frontier.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = materialize(new.withColumn("depth", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def graph_filter(edges: DataFrame, start, depth: int, direction: str = "out", edge_type: str | None = None, inclusive: bool = True) -> DataFrame:
    """Ids within ``depth`` steps; ``inclusive=False`` leaves out the last ring, as an expansion by rounds does."""
    if depth <= 0 and not inclusive:
        return bfs(edges, start, 0).select("id").limit(0)
    return bfs(edges, start, depth if inclusive else depth - 1, direction, edge_type).select("id")


def walks(edges: DataFrame, starts: DataFrame, least: int, most: int, edge_types: list[str] | None = None) -> DataFrame:
    """(start, id, hops): variable-length pattern (start)-[:types*least..most]->(id), each once for each number of hops. ``starts``: id."""
    e = edges if edge_types is None else edges.where(F.col("edge_type").isin(edge_types))
    e = materialize(e.select("src", "dst").distinct(), "steps")
    at = starts.select(F.col("id").alias("start"), "id").distinct()
    out = at.withColumn("hops", F.lit(0)) if least <= 0 else None
    for n in range(1, most + 1):
        at = materialize(at.withColumnRenamed("id", "src").join(e, "src").select("start", F.col("dst").alias("id")).distinct(), "walks")
        if n >= least:
            here = at.withColumn("hops", F.lit(n))
            out = here if out is None else out.unionAll(here)
    return out if out is not None else at.withColumn("hops", F.lit(0)).limit(0)


def relax(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(origin, id, cost): least cost from each origin by min-plus rounds (Bellman-Ford). ``edges``: src, dst, weight.
    Ends when no cost falls, or raises if one still does after ``rounds`` (the number of nodes, if not given: a negative cycle)."""
    e = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "weighted")
    best = materialize(sources.select("origin", "id", F.lit(0.0).alias("cost")), "best")
    frontier, step = best, 0
    while True:
        step += 1
        found = frontier.join(e.withColumnRenamed("src", "id"), "id").select("origin", F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost")).groupBy("origin", "id").agg(F.min("cost").alias("cost"))
        old = best.withColumnRenamed("cost", "old")
        frontier = materialize(found.join(old, ["origin", "id"], "left").where("old is null or cost < old").select("origin", "id", "cost"), "frontier")
        if frontier.isEmpty():
            return best
        if rounds is None and step == 32:
            # counted only where so many rounds are needed
            rounds = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct().count()
        if rounds is not None and step > rounds:
            raise ArithmeticError("negative cycle")
        old, best = best, materialize(best.unionAll(frontier).groupBy("origin", "id").agg(F.min("cost").alias("cost")), "best")
        if step > 1:
            discard(old)


def sssp(edges: DataFrame, start, rounds: int | None = None) -> DataFrame:
    """(id, cost) from one start."""
    kind = edges.schema["src"].dataType
    one = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("origin"), F.lit(start).cast(kind).alias("id"))
    return relax(edges, one, rounds).select("id", "cost")


def apsp(edges: DataFrame) -> DataFrame:
    """(src, dst, cost) of all pairs that are connected, nodes to themselves at 0."""
    n = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    return relax(edges, n.select(F.col("id").alias("origin"), "id")).select(F.col("origin").alias("src"), F.col("id").alias("dst"), "cost")


def least_path(edges: DataFrame, start, goal, rounds: int | None = None) -> DataFrame:
    """(cost, path): the cheapest path, among equal costs the least by node order. Paths grow backwards from the
    goal over tight edges (cost[src] + weight = cost[dst])."""
    dist = materialize(sssp(edges, start, rounds), "dist")
    e = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    tight = e.join(dist.select(F.col("id").alias("src"), F.col("cost").alias("a")), "src").join(dist.select(F.col("id").alias("dst"), F.col("cost").alias("b")), "dst").where("abs(a + weight - b) < 1e-9 and src <> dst").select("src", "dst")
    tight = materialize(tight, "tight")
    tail = dist.where(F.col("id") == goal).select(F.col("id").alias("at"), F.array("id").alias("path"), "cost")
    kind = edges.schema["src"].dataType
    while True:
        tail = materialize(tail, "tail")
        if tail.where(F.col("at") != F.lit(start).cast(kind)).isEmpty():
            return tail.select("cost", "path")
        # every node keeps only its least tail: the least path starts with the least heads
        more = tail.where(F.col("at") != F.lit(start).cast(kind)).join(tight.withColumnRenamed("dst", "at"), "at").where(~F.array_contains("path", F.col("src"))).select(F.col("src").alias("at"), F.concat(F.array("src"), "path").alias("path"), "cost")
        tail = tail.where(F.col("at") == F.lit(start).cast(kind)).unionAll(more).groupBy("at").agg(F.min(F.struct("path", "cost")).alias("x")).select("at", "x.path", "x.cost")


def simple_paths(edges: DataFrame, start, goal, max_nodes: int) -> DataFrame:
    """(path, cost): all simple paths with ``max_nodes`` nodes at most; ``weight`` counts where it is a column."""
    e = edges.select("src", "dst", F.coalesce(F.col("weight"), F.lit(1.0)).cast("double").alias("w") if "weight" in edges.columns else F.lit(1.0).alias("w"))
    kind = edges.schema["src"].dataType
    at = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("src"), F.array(F.lit(start).cast(kind)).alias("path"), F.lit(0.0).alias("cost"))
    found = None
    for _ in range(max_nodes - 1):
        at = materialize(at.where(F.col("src") != F.lit(goal).cast(kind)).join(e, "src").where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("w")).alias("cost")), "paths")
        here = at.where(F.col("src") == F.lit(goal).cast(kind)).select("path", "cost")
        found = here if found is None else found.unionAll(here)
        if at.isEmpty():
            break
    return found if found is not None else at.select("path", "cost").limit(0)


def astar(edges: DataFrame, start, goal, heuristic: DataFrame) -> DataFrame:
    """(cost, settled): least cost from start to goal, and how many nodes were reached. ``heuristic`` (id, h) never overestimates
    what is left to the goal; nodes without one have 0. Rounds relax all open nodes together; a node whose cost plus h is not
    below the best known cost of the goal is not expanded, so what cannot be on a cheaper path is never visited."""
    kind = edges.schema["src"].dataType
    e = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "weighted")
    h = heuristic.select("id", "h")
    best = materialize(edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0.0).alias("cost")), "astar")
    frontier, known = best, 0.0 if start == goal else float("inf")
    while True:
        open_ = frontier.join(h, "id", "left").where((F.col("cost") + F.coalesce("h", F.lit(0.0)) < known) & (F.col("id") != F.lit(goal).cast(kind)))
        found = open_.join(e.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost")).groupBy("id").agg(F.min("cost").alias("cost"))
        frontier = materialize(found.join(best.withColumnRenamed("cost", "old"), "id", "left").where("old is null or cost < old").select("id", "cost"), "frontier")
        if frontier.isEmpty():
            goal_ = best.where(F.col("id") == F.lit(goal).cast(kind)).select("cost")
            return goal_.crossJoin(best.agg(F.count(F.lit(1)).alias("settled")))
        best = materialize(best.unionAll(frontier).groupBy("id").agg(F.min("cost").alias("cost")), "astar")
        known = min(known, frontier.where(F.col("id") == F.lit(goal).cast(kind)).agg(F.min("cost")).first()[0] or known) if known else known


def bidirectional(edges: DataFrame, start, goal) -> DataFrame:
    """(cost): least cost from start to goal, no row if there is no path."""
    meeting = _two_sided(edges, start, goal)[0]
    return edges.sparkSession.createDataFrame([(meeting,)] if meeting < float("inf") else [], "cost double")


def bidirectional_path(edges: DataFrame, start, goal) -> DataFrame:
    """(cost, path): the cheapest path by a two-sided search, among equal costs the least by node order; no row if there is none.

    Edges that lie on a cheapest path by the costs that either side has found are few; the path grows backwards from the goal over these.
    """
    meeting, ahead, behind, e = _two_sided(edges, start, goal)
    kind, spark = edges.schema["src"].dataType, edges.sparkSession
    if meeting == float("inf"):
        return spark.createDataFrame([], f"cost double, path array<{kind.simpleString()}>")
    a, b = ahead.where(F.col("cost") <= meeting), behind.where(F.col("cost") <= meeting)
    d = e.where("src <> dst")
    for side, cost in (("src", "a"), ("dst", "b")):
        d = d.join(a.select(F.col("id").alias(side), F.col("cost").alias(f"{cost}f")), side, "left").join(b.select(F.col("id").alias(side), F.col("cost").alias(f"{cost}g")), side, "left")
    on = lambda x: F.coalesce(F.abs(x) < 1e-9, F.lit(False))
    tight = on(F.col("af") + F.col("weight") - F.col("bf")) | on(F.col("weight") + F.col("bg") - F.col("ag")) | on(F.col("af") + F.col("weight") + F.col("bg") - meeting)
    tight = materialize(d.where(tight).select("src", "dst", "weight"), "tight")
    # what is left is the same question on a few edges
    return least_path(tight, start, goal).where(F.abs(F.col("cost") - meeting) < 1e-9)


def _two_sided(edges: DataFrame, start, goal) -> tuple[float, DataFrame, DataFrame, DataFrame]:
    """(least cost, costs from the start, costs to the goal, least edges). Costs grow from both ends, a round each in turn; a
    node is not expanded if its cost alone reaches the best meeting, and the search ends when neither side has an open node."""
    kind = edges.schema["src"].dataType
    one = lambda x: edges.sparkSession.range(1).select(F.lit(x).cast(kind).alias("id"), F.lit(0.0).alias("cost"))
    e = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "weighted")
    ways = [e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")]
    best, meeting = [one(start), one(goal)], float("inf")
    frontier, side = list(best), 0
    while True:
        found = frontier[side].where(F.col("cost") < meeting).join(ways[side].withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost")).groupBy("id").agg(F.min("cost").alias("cost"))
        frontier[side] = materialize(found.join(best[side].withColumnRenamed("cost", "old"), "id", "left").where(f"(old is null or cost < old) and cost < double('{meeting}')").select("id", "cost"), "frontier")
        best[side] = materialize(best[side].unionAll(frontier[side]).groupBy("id").agg(F.min("cost").alias("cost")), "side")
        met = best[0].join(best[1].withColumnRenamed("cost", "other"), "id").agg(F.min(F.col("cost") + F.col("other"))).first()[0]
        meeting = meeting if met is None else min(meeting, met)
        empty = [f.where(F.col("cost") < meeting).isEmpty() for f in frontier]
        # one side alone, run to its end, has found the least cost
        if empty[side] or all(empty):
            return meeting, best[0], best[1], e
        side = 1 - side if not empty[1 - side] else side


def johnson(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, dst, cost) of all pairs that are connected, (id, potential)): weights may be negative, cycles not. A source with a free
    edge to every node gives potentials; with them no weight is negative, and a cost is known to be final sooner."""
    n = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    e = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "weighted")
    n = materialize(n, "nodes")
    # the virtual source's first round: every node at 0
    from_virtual = relax(e, n.select(F.lit(0).alias("origin"), "id"))
    h = materialize(from_virtual.select("id", F.col("cost").alias("potential")), "potential")
    lifted = e.join(h.select(F.col("id").alias("src"), F.col("potential").alias("a")), "src").join(h.select(F.col("id").alias("dst"), F.col("potential").alias("b")), "dst").select("src", "dst", (F.col("weight") + F.col("a") - F.col("b")).alias("weight"))
    d = relax(lifted, n.select(F.col("id").alias("origin"), "id"))
    d = d.join(h.select(F.col("id").alias("origin"), F.col("potential").alias("a")), "origin").join(h.select("id", F.col("potential").alias("b")), "id")
    return d.select(F.col("origin").alias("src"), F.col("id").alias("dst"), (F.col("cost") - F.col("a") + F.col("b")).alias("cost")), h


def _least_paths(e: DataFrame, starts: DataFrame, barred: DataFrame, cut: DataFrame, goal, max_nodes: int) -> DataFrame:
    """(origin, cost, path): for each origin (origin, id, cost, path: where it starts) its cheapest simple path to the goal, equal costs
    by node order; nodes ``barred`` (origin, id) and edges ``cut`` (origin, src, dst) are closed to it. All origins advance together;
    a node keeps its least (cost, path), which is exact as weights are not negative and a path's tail does not look back at ties."""
    best = materialize(starts.select("origin", "id", F.struct("cost", "path").alias("x")), "spur")
    frontier = best
    while True:
        step = frontier.where(F.col("id") != goal).where(F.size("x.path") < max_nodes).join(e.withColumnRenamed("src", "id"), "id")
        step = step.select("origin", F.col("id").alias("src"), F.col("dst").alias("id"), F.struct((F.col("x.cost") + F.col("weight")).alias("cost"), F.concat("x.path", F.array("dst")).alias("path")).alias("x"), F.array_contains("x.path", F.col("dst")).alias("seen")).where("not seen")
        step = step.join(barred, ["origin", "id"], "left_anti").join(cut.withColumnRenamed("dst", "id"), ["origin", "src", "id"], "left_anti")
        step = step.groupBy("origin", "id").agg(F.min("x").alias("x"))
        frontier = materialize(step.join(best.withColumnRenamed("x", "old"), ["origin", "id"], "left").where("old is null or x < old").select("origin", "id", "x"), "frontier")
        if frontier.isEmpty():
            return best.where(F.col("id") == goal).select("origin", "x.cost", "x.path")
        best = materialize(best.unionAll(frontier).groupBy("origin", "id").agg(F.min("x").alias("x")), "spur")


def k_shortest(edges: DataFrame, start, goal, k: int, max_nodes: int | None = None) -> DataFrame:
    """(rank, cost, path): the k cheapest simple paths, equal costs by node order, weights not negative. Spur paths: the
    next path leaves one of those found at some place; the cheapest ways on from all places of the last one are searched for together, with
    the nodes before the place and the edges that found paths take there closed. Nothing is enumerated; at most
    k times a path's length candidates are on the driver. With ``max_nodes`` only paths of so many nodes count, which are listed."""
    if max_nodes is not None:
        w = Window.orderBy("cost", "path")
        return simple_paths(edges, start, goal, max_nodes).orderBy("cost", "path").limit(k).withColumn("rank", F.row_number().over(w))
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    name = kind.simpleString()
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    e = materialize(edges.where("src <> dst").groupBy("src", "dst").agg(F.min(w.cast("double")).alias("weight")), "weighted")
    n = e.select("src").unionAll(e.select("dst")).distinct().count()
    goal_ = F.lit(goal).cast(kind)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    none = frame([], f"origin int, id {name}"), frame([], f"origin int, src {name}, dst {name}")
    got = [tuple(r) for r in _least_paths(e, frame([(0, start, 0.0, [start])], f"origin int, id {name}, cost double, path array<{name}>"), *none, goal_, n).select("cost", "path").collect()]
    found, waiting = [], set()
    waiting |= {(c, tuple(p)) for c, p in got}
    while waiting and len(found) < k:
        cost, path = min(waiting)
        waiting.discard((cost, path))
        found.append((cost, path))
        if len(found) == k or start == goal:
            continue
        costs = {(r["src"], r["dst"]): r["weight"] for r in e.join(F.broadcast(frame(list(zip(path, path[1:])), f"src {name}, dst {name}")), ["src", "dst"]).collect()}
        starts, barred, cut, at = [], [], [], 0.0
        for i in range(len(path) - 1):
            starts.append((i, path[i], at, list(path[: i + 1])))
            barred += [(i, x) for x in path[:i]]
            cut += [(i, p[i], p[i + 1]) for _, p in found if p[: i + 1] == path[: i + 1]]
            at += costs[path[i], path[i + 1]]
        spur = _least_paths(e, frame(starts, f"origin int, id {name}, cost double, path array<{name}>"), F.broadcast(frame(barred, f"origin int, id {name}") if barred else none[0]), F.broadcast(frame(cut, f"origin int, src {name}, dst {name}")), goal_, n)
        waiting |= {(r["cost"], tuple(r["path"])) for r in spur.collect()} - set(found)
    return frame([(i + 1, c, list(p)) for i, (c, p) in enumerate(found)], f"rank int, cost double, path array<{name}>")


def simple_cycles(edges: DataFrame, max_nodes: int) -> DataFrame:
    """(path): simple cycles of up to ``max_nodes`` nodes, each once, from its smallest node."""
    e = edges.select("src", "dst").distinct()
    at = e.where("dst > src").select(F.col("src").alias("first"), F.col("dst").alias("src"), F.array("src", "dst").alias("path"))
    out = e.where("src = dst").select(F.array("src").alias("path"))
    for n in range(2, max_nodes + 1):
        at = materialize(at, "cycles")
        out = out.unionAll(at.join(e, "src").where("dst = first").select("path"))
        if n < max_nodes:
            at = at.join(e, "src").where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select("first", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"))
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): every pair joined by a path of one edge or more, by doubling."""
    reach = materialize(edges.select("src", "dst").distinct(), "closure")
    n = reach.count()
    while True:
        step = reach.select("src", F.col("dst").alias("mid")).join(reach.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        old, reach = reach, materialize(reach.unionAll(step).distinct(), "closure")
        discard(old)
        now = reach.count()
        if now == n:
            return reach
        n = now


def reduction(edges: DataFrame) -> DataFrame:
    """Edges of a DAG that no longer path replaces."""
    e = edges.select("src", "dst").distinct()
    c = closure(e)
    longer = e.select("src", F.col("dst").alias("mid")).join(c.select(F.col("src").alias("mid"), "dst"), "mid").where("mid <> dst").select("src", "dst").distinct()
    return e.join(longer, ["src", "dst"], "left_anti")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): weak components, named by their smallest node. Labels go to neighbours, and from labels to
    their own labels (pointer jumping), until none falls."""
    both = materialize(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "both")
    label = held = materialize(nodes.select("id", F.col("id").alias("component")), "label")
    while True:
        near = both.join(label.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        low = label.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        new = materialize(low.join(jump, "component").select("id", "old", F.least("component", "jump").alias("component")), "label")
        discard(held)
        label, held = new.select("id", "component"), new
        if new.where("old <> component").isEmpty():
            return label


def trimmed(edges: DataFrame, once: int | None = None) -> DataFrame:
    """The edges that are left when nodes without incoming or without outgoing edges are taken out until none is: those on
    cycles or between cycles. ``once``: rounds at most."""
    e, n = materialize(edges.select("src", "dst").distinct(), "trim"), -1
    while once is None or once > 0:
        now = e.count()
        if now in (0, n):
            break
        n, once = now, None if once is None else once - 1
        src, dst = e.select(F.col("src").alias("id")).distinct(), e.select(F.col("dst").alias("id")).distinct()
        old, e = e, materialize(e.join(dst.withColumnRenamed("id", "src"), "src", "left_semi").join(src.withColumnRenamed("id", "dst"), "dst", "left_semi"), "trim")
        discard(old)
    return e


def has_cycle(edges: DataFrame) -> bool:
    """Whether a directed cycle is left (a loop is one): trimming, without any closure."""
    return not trimmed(edges).isEmpty()


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): strong components, named by their smallest node, by forward and backward colouring.

    Nodes that trimming takes are components by themselves. In a round each other node takes the smallest node that reaches it as
    its colour; a colour's own node and what reaches it within the colour are a component, and go. Only labels are held, no pairs.
    """
    e, out = trimmed(edges.where("src <> dst")), None
    while not e.isEmpty():
        color = materialize(e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct().select("id", F.col("id").alias("color")), "color")
        changed = color
        while not changed.isEmpty():
            near = changed.join(e.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("near"))
            changed = materialize(near.join(color, "id").where("near < color").select("id", F.col("near").alias("color")), "changed")
            old, color = color, materialize(color.join(changed.withColumnRenamed("color", "new"), "id", "left").select("id", F.coalesce("new", "color").alias("color")), "color")
            if old is not changed:
                discard(old)
        inside = e.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst")
        inside = materialize(inside, "inside")
        back = materialize(color.where("id = color"), "back")
        frontier = back
        while not frontier.isEmpty():
            more = frontier.withColumnRenamed("id", "dst").join(inside, "dst").select(F.col("src").alias("id"), "color").distinct()
            frontier = materialize(more.join(back, "id", "left_anti"), "frontier")
            back = materialize(back.unionAll(frontier), "back")
        out = back if out is None else out.unionAll(back)
        gone = back.select("id")
        e = trimmed(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    if out is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("color", "id").alias("component"))


def topo_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): rounds of taking out nodes without incoming edges; nodes on or behind cycles get no row."""
    e = materialize(edges.select("src", "dst").distinct(), "topo")
    rest = materialize(nodes.select("id"), "topo")
    out, level = None, 0
    while True:
        free = materialize(rest.join(e.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)), "free")
        if free.isEmpty():
            return out if out is not None else free
        out = free if out is None else out.unionAll(free)
        gone = free.select("id")
        rest = materialize(rest.join(gone, "id", "left_anti"), "topo")
        e = materialize(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti"), "topo")
        level += 1


def topo_sort(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, place): a topological order, by level and then by id; an ``ArithmeticError`` if there is a cycle."""
    from graphloom.operators import ordering

    levels = materialize(topo_levels(edges, nodes), "levels")
    if levels.count() < nodes.select("id").distinct().count():
        raise ArithmeticError("the graph has a cycle")
    return ordering.running(levels, ["level", "id"], out="place").select("id", F.col("place").cast("long").alias("place"))


def is_bipartite(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: no node is reached with both parities (components of the graph's double cover)."""
    side = lambda c, s: F.struct(F.col(c).alias("n"), F.lit(s).alias("s"))
    e = edges.select("src", "dst")
    cover = e.select(side("src", 0).alias("src"), side("dst", 1).alias("dst")).unionAll(e.select(side("src", 1).alias("src"), side("dst", 0).alias("dst")))
    every = nodes.select(side("id", 0).alias("id")).unionAll(nodes.select(side("id", 1).alias("id")))
    c = connected_components(cover, every)
    odd = c.groupBy(F.col("id.n").alias("n")).agg(F.count_distinct("component").alias("k")).where("k = 1")
    return odd.agg((F.count(F.lit(1)) == 0).alias("is_bipartite"))


def minimum_spanning_forest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst: Boruvka rounds; ties by (weight, src, dst), so the forest is unique."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    e = materialize(e, "msf")
    label = nodes.select("id", F.col("id").alias("component"))
    taken = None
    while True:
        label = materialize(label, "label")
        cut = e.join(label.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a <> b")
        x = F.struct("weight", "src", "dst")
        best = cut.select(F.col("a").alias("c"), x.alias("x")).unionAll(cut.select(F.col("b").alias("c"), x.alias("x"))).groupBy("c").agg(F.min("x").alias("x")).select("x.src", "x.dst", "x.weight").distinct()
        best = materialize(best, "picked")
        if best.isEmpty():
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionAll(best)
        label = connected_components(taken, nodes)


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(id, rank): fixed rounds; the mass of nodes without outgoing edges is not handed on (ranks need not sum to 1).
    The edges carry their source's share and are laid out once; the plan is cut every few rounds."""
    nodes = materialize(nodes.select("id"), "nodes")
    n = max(1, nodes.count())
    e = edges.select("src", "dst")
    e = materialize(e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src"), "ranked")
    rank, held = nodes.select("id", F.lit(1.0 / n).alias("rank")), None
    for r in range(rounds):
        given = e.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = nodes.select("id").join(given, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if r % every == every - 1:
            old, rank = held, materialize(rank, "rank")
            held = rank
            discard(old)
    return rank


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): each round every node takes the commonest label of its neighbours (both directions), ties to the smallest."""
    both = materialize(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "both")
    label = materialize(nodes.select("id", F.col("id").alias("label")), "label")
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "label").count()
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("label").alias("new"))).alias("x"))
        old, label = label, materialize(label.join(best, "id", "left").select("id", F.coalesce("x.new", "label").alias("label")), "label")
        discard(old)
    return label


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, coefficient): linked pairs of neighbours over all pairs, in the undirected view; fewer than two neighbours: 0."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = materialize(e, "pairs")
    deg = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    # edges go from the lower degree up, so a hub has few wedges: at most the square root of all edges at each node
    ranked = e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = materialize(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")), "upward")
    wedge = o.alias("x").join(o.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("m"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    tri = wedge.join(e, ["a", "b"]).select(F.explode(F.array("a", "m", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    value = F.when(F.col("d") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0))
    return nodes.select("id").join(deg, "id", "left").join(tri, "id", "left").select("id", value.alias("coefficient"))


def eccentricity(edges: DataFrame) -> DataFrame:
    """(id, eccentricity): the longest hop distance to any node that is reached."""
    d = apsp(edges.select("src", "dst", F.lit(1.0).alias("weight")))
    return d.groupBy(F.col("src").alias("id")).agg(F.max("cost").alias("eccentricity"))


def greedy_matching(edges: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst: heaviest edges first. Rounds take every edge that is the best at both its ends, which is
    what the greedy order takes."""
    e = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    e, out = materialize(e, "match"), None
    x = F.struct((-F.col("weight")).alias("w"), "src", "dst")
    while not e.isEmpty():
        best = e.select(F.explode(F.array("src", "dst")).alias("id"), x.alias("x")).groupBy("id").agg(F.min("x").alias("x"))
        pick = materialize(best.groupBy(F.col("x.src").alias("src"), F.col("x.dst").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.max(-F.col("x.w")).alias("weight")).where("n = 2").select("src", "dst", "weight"), "picked")
        out = pick if out is None else out.unionAll(pick)
        used = pick.select(F.explode(F.array("src", "dst")).alias("id"))
        e = materialize(e.join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "weight"), "match")
    return out if out is not None else e


def goal_cost(dist: DataFrame, goal: Column) -> DataFrame:
    """(id, cost): the nearest node that satisfies ``goal``; equal costs: the smallest."""
    return dist.where(goal).orderBy("cost", "id").limit(1)
