"""Typed property graph: edges (src, dst, and any of weight, edge_type, edge_id) and nodes (id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import ordering


class Graph:
    """A directed graph. Nodes default to the endpoints of the edges."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges = edges
        ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
        self.nodes = (nodes.select("id").unionAll(ends) if nodes is not None else ends).distinct()

    def neighbors(self, node, direction: str = "out") -> DataFrame:
        """(id) of every edge at the node, parallel edges kept."""
        e = self.edges
        out, into = e.where(F.col("src") == node).select(F.col("dst").alias("id")), e.where(F.col("dst") == node).select(F.col("src").alias("id"))
        return {"out": out, "in": into, "both": out.unionAll(into)}[direction]

    def has_edge(self, a, b) -> DataFrame:
        return self.edges.agg(F.coalesce(F.bool_or((F.col("src") == a) & (F.col("dst") == b)), F.lit(False)).alias("has_edge"))

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree, degree) of every node. One pass: each edge counts at both its ends."""
        at = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(self.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        every = at.unionAll(self.nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
        d = every.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        return d.withColumn("degree", F.col("out_degree") + F.col("in_degree"))

    def counts(self) -> DataFrame:
        return self.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(self.edges.agg(F.count(F.lit(1)).alias("edges")))

    def reverse(self) -> Graph:
        other = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *other), self.nodes)

    def undirected(self) -> DataFrame:
        """Both directions of every edge (src, dst), once, without loops."""
        e = self.edges.where("src <> dst")
        return e.select("src", "dst").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    def where_nodes(self, keep: Column) -> Graph:
        n = self.nodes.where(keep)
        ids = n.select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(e.select(*self.edges.columns), n)

    def where_edges(self, keep: Column) -> Graph:
        return Graph(self.edges.where(keep), self.nodes)

    def csr(self) -> DataFrame:
        """(id, row_start, row_end, targets): compressed rows in node order, targets sorted."""
        rows = self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))
        d = self.nodes.join(rows, "id", "left").withColumn("targets", F.coalesce("targets", F.array().cast(rows.schema["targets"].dataType)))
        d = ordering.running(d, ["id"], F.size("targets"), "row_end")
        return d.select("id", (F.col("row_end") - F.size("targets")).alias("row_start"), "row_end", "targets")

    def dot(self, name: str = "g") -> DataFrame:
        """Lines of a DOT file (line_no, line)."""
        # fixed values: the line formats
        q = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
        parts = self.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), q("id"), F.lit(";")).alias("line"), F.col("id").alias("a"), F.col("id").alias("b"))
        parts = parts.unionAll(self.edges.select(F.lit(2), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(";")), "src", "dst"))
        kind = self.nodes.schema["id"].dataType
        none = F.lit(None).cast(kind)
        one = self.nodes.sparkSession.range(1)
        parts = parts.unionAll(one.select(F.lit(0), F.lit(f"digraph {name} {{"), none, none)).unionAll(one.select(F.lit(3), F.lit("}"), none, none))
        return ordering.running(parts, ["part", "a", "b"], out="n").select((F.col("n") - 1).cast("int").alias("line_no"), "line")

    def edge_set(self) -> DataFrame:
        return self.edges.select("src", "dst").distinct()

    def union(self, other: Graph) -> DataFrame:
        return self.edges.select("src", "dst").union(other.edges.select("src", "dst")).distinct()

    def intersection(self, other: Graph) -> DataFrame:
        return self.edges.select("src", "dst").intersect(other.edges.select("src", "dst"))

    def difference(self, other: Graph) -> DataFrame:
        return self.edges.select("src", "dst").subtract(other.edges.select("src", "dst"))

    def complement(self) -> DataFrame:
        """Ordered pairs that are no edges: quadratic in the nodes by definition."""
        pairs = self.nodes.select(F.col("id").alias("src")).crossJoin(self.nodes.select(F.col("id").alias("dst"))).where("src <> dst")
        return pairs.join(self.edge_set(), ["src", "dst"], "left_anti")


def weights(edges: DataFrame, default: float = 1.0) -> DataFrame:
    """(src, dst, weight): edges without a weight get the default."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(None).cast("double")
    return edges.select("src", "dst", F.coalesce(w, F.lit(default)).alias("weight"))


def explorer_filter(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None, edge_types: list[str] | None = None, term: str | None = None, min_degree: int = 0) -> tuple[DataFrame, DataFrame]:
    """Node types, edge types, a term in label, type or any property, least degree, in this order; edges
    whose ends are gone go too. ``nodes``: id, label, node_type, properties (map)."""

    def prune(e: DataFrame, n: DataFrame) -> DataFrame:
        ids = n.select("id")
        return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")

    if types:
        nodes = nodes.where(F.col("node_type").isin(types))
        edges = prune(edges, nodes)
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    if term:
        t = term.lower()
        nodes = nodes.where(F.contains(F.lower("label"), F.lit(t)) | F.contains(F.lower("node_type"), F.lit(t)) | F.coalesce(F.exists(F.map_values("properties"), lambda v: F.contains(F.lower(v), F.lit(t))), F.lit(False)))
        edges = prune(edges, nodes)
    if min_degree > 0:
        degree = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).groupBy("id").count().where(F.col("count") >= min_degree)
        nodes = nodes.join(degree.select("id"), "id", "left_semi")
        edges = prune(edges, nodes)
    return nodes, edges


def apply_batch(ops: DataFrame, key: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """State after a sequence of add/remove operations: each key's last operation counts; one without a number is before all others."""
    last = ops.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(seq)).alias("x"))
    return last.select("x.*").where(F.col(op) == "add").drop(op, seq)


# generators ---------------------------------------------------------------------------------------


def complete(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src")).crossJoin(spark.range(n).select(F.col("id").alias("dst"))).where("src <> dst")


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))


def star(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))


def binary_tree(spark: SparkSession, depth: int) -> DataFrame:
    return spark.range(1, 2 ** (depth + 1) - 1).select(F.floor((F.col("id") - 1) / 2).alias("src"), F.col("id").alias("dst"))


def random(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """G(n, p) without loops: the gaps between the numbers of chosen pairs are geometric, so the work is that of the edges.

    The n (n - 1) pairs are numbered; each of some runs of numbers is walked by itself, from seeded draws.
    """
    total = n * (n - 1)
    if p >= 1:
        return complete(spark, n)
    if p <= 0 or not total:
        return complete(spark, 0)
    span = max(1, int(200 / p))
    draws = int(200 + 12 * 200**0.5 + 60)
    u = f"(pmod(xxhash64({seed}L, id, i), 1L << 52) + 0.5) / double(1L << 52)"
    gaps = f"transform(sequence(1, {draws}), i -> cast(floor(ln({u}) / ln(1 - {p!r}D)) as bigint) + 1)"
    places = f"filter(aggregate({gaps}, named_struct('at', id * {span} - 1, 'out', cast(array() as array<bigint>)), (s, g) -> named_struct('at', s.at + g, 'out', if(s.at + g < least((id + 1) * {span}, {total}), concat(s.out, array(s.at + g)), s.out)), s -> s.out), x -> x >= 0)"
    picked = spark.range(-(-total // span)).select(F.explode(F.expr(places)).alias("x"))
    src = F.floor(F.col("x") / (n - 1))
    to = F.pmod(F.col("x"), F.lit(n - 1))
    return picked.select(src.alias("src"), (to + (to >= src).cast("long")).alias("dst"))
