"""The converged query: property filters, a graph neighbourhood and vector ranking in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import iterate, predicates, vectors


@dataclass
class Semantic:
    vector: list[float]
    threshold: float | None = None
    metric: str = "cosine"


@dataclass
class Neighbourhood:
    start: object
    depth: int
    direction: str = "out"
    edge_type: str | None = None
    #: False leaves the last ring out, as an expansion by rounds does.
    inclusive: bool = True


@dataclass
class ConvergedQuery:
    """Structural filters (column, operator, value), a graph filter, a semantic ranking, time bounds; page."""

    filters: list[tuple[str, str, object]] = field(default_factory=list)
    graph: Neighbourhood | None = None
    semantic: Semantic | None = None
    scope: Column | None = None
    limit: int = 10
    offset: int = 0

    def run(self, nodes: DataFrame, edges: DataFrame | None = None, embeddings: DataFrame | None = None) -> DataFrame:
        """(node columns, score): candidates are filtered before they are ranked, so a page is full if there are enough.

        ``nodes``: id, embedding_id (or id itself is the embedding's); ``embeddings``: id, vector.
        """
        if not self.filters and self.graph is None and self.semantic is None and self.scope is None:
            raise ValueError("a query needs a filter, a neighbourhood or a vector")
        d = nodes.where(predicates.structural_all(self.filters))
        if self.scope is not None:
            d = d.where(self.scope)
        if self.graph is not None:
            g = self.graph
            near = iterate.graph_filter(edges, g.start, g.depth, g.direction, g.edge_type, g.inclusive)
            d = d.join(near, "id", "left_semi")
        if self.semantic is None:
            return d.orderBy("id").offset(self.offset).limit(self.limit)
        e = embeddings.select(F.col("id").alias("embedding_id"), "vector")
        d = (d if "embedding_id" in d.columns else d.withColumn("embedding_id", F.col("id"))).join(e, "embedding_id")
        similar = vectors.metric(self.semantic.metric)[1]
        d = d.withColumn("score", F.round(similar(F.col("vector"), vectors.literal(self.semantic.vector)), 6) + 0.0)
        if self.semantic.threshold is not None:
            d = d.where(F.col("score") >= self.semantic.threshold)
        return vectors.top_k(d.drop("vector", "embedding_id"), self.limit, offset=self.offset)
