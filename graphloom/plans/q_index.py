"""Queries of the stored indexes: full text, places, neighbours, product codes, reachability; and of measures on graphs that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import fulltext, graph, index, product, proximity, reach, spatial, structure
from graphloom.plans.registry import query
from graphloom.session import held, materialize, scratch, table
from graphloom.sources import views as V
from graphloom.sources.views import with_views


# full text ----------------------------------------------------------------------------------------


def _bm25(rows: str, asked: str, k: int, where: str = "true") -> str:
    """SQL of BM25 over (id, text) for a query string."""
    return f"""with src as ({rows}), words as (select id, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from src),
    q as (select w, count(*) qn from (select unnest(regexp_extract_all('{asked.lower()}', '[a-z]+')) w) group by 1),
    len_ as (select id, count(*) n from words group by 1), st as (select count(*) docs, avg(n) mean from len_),
    tf as (select id, w, qn, count(*) tf from words join q using (w) group by 1, 2, 3), df as (select w, count(*) df from tf group by 1)
    select id, round(sum(qn * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) score from tf join len_ using (id) join df using (w), st where {where} group by 1 order by score desc, id limit {k}"""


_DOCS = "select doc_id id, text from documents"
_MESSAGES = "select 'm:' || conv_id || ':' || turn id, text from conversations"


@query("fulltext_search", _bm25(_DOCS, "The nation then, worthless THEN", 20))
def fulltext_search(s, d):
    """The best documents for a query string, from the stored index, opened again."""
    path = scratch(s, "fulltext")
    fulltext.FullTextIndex.build(table(s, d, "documents"), path, key="doc_id")
    return fulltext.FullTextIndex(s, path).search("The nation then, worthless THEN", 20)


@query("fulltext_messages", _bm25(_MESSAGES, "how the question of an answer", 15))
def fulltext_messages(s, d):
    """Messages by text keys."""
    m = V.messages(s, d).select("id", F.col("text_content").alias("text"))
    return fulltext.FullTextIndex.build(m, scratch(s, "fulltext")).search("how the question of an answer", 15)


# neighbours ---------------------------------------------------------------------------------------

_VEC, _SIM = with_views("vectors"), with_views("sim").replace("with recursive", "with")


def _graphs(s, d):
    return held(s, ("graphs", d), "graphs", lambda path: proximity.ProximityIndex.build(V.vectors(s, d), path))


@query("proximity_neighbours", _SIM + " select src, dst, sim from sim where src % 100 = 0")
def proximity_neighbours(s, d):
    """The three nearest of every hundredth vector, by beams of 64 over stored proximity graphs."""
    x = proximity.ProximityIndex(s, _graphs(s, d).path)
    return x.knn_join(V.vectors(s, d).where("id % 100 = 0"), 3, beam=64, self_join=True).select("src", "dst", "sim")


@query("proximity_topk", _VEC + " select v.id, round(list_cosine_similarity(v.vector, q.vector), 6) + 0.0 score from vectors v, (select vector from vectors where id = 0) q order by score desc, id limit 10")
def proximity_topk(s, d):
    q = [float(x) for x in V.vectors(s, d).where("id = 0").first()["vector"]]
    return _graphs(s, d).search(q, 10)


@query("proximity_recall")
def proximity_recall(s, d):
    """Of every hundredth vector: how many of its three nearest a small beam finds, and the share of all vectors that it was compared with."""
    v = V.vectors(s, d)
    n, asked = v.count(), v.where("id % 100 = 0")
    found = materialize(_graphs(s, d).knn_join(asked, 3, beam=6, self_join=True), "found")
    exact = index.VectorIndex.build(v, scratch(s, "coarse")).knn_join(asked, 3, self_join=True).select("src", "dst")
    hits = exact.join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left").groupBy("src").agg(F.count("hit").alias("found"))
    share = found.groupBy("src").agg(F.round(F.max("compared") / F.lit(n), 6).alias("share"))
    return hits.join(share, "src").select(F.col("src").alias("id"), "found", "share")


@query("product_topk", _VEC + " select v.id, round(list_cosine_similarity(v.vector, q.vector), 6) + 0.0 score from vectors v, (select vector from vectors where id = 0) q order by score desc, id limit 10")
def product_topk(s, d):
    """Top-k by product codes of a sixteenth of the vectors' size, the best ranked again by the vectors."""
    v = V.vectors(s, d)
    x = product.ProductIndex.build(v, scratch(s, "product"))
    q = [float(x) for x in v.where("id = 0").first()["vector"]]
    return x.search(q, 10).select("id", "score")


# places -------------------------------------------------------------------------------------------

#: Where a part and a supplier are.
_PART = "select p_partkey id, cast((p_partkey * 31) % 181 - 90 as double) lat, cast((p_partkey * 7) % 361 - 180 as double) lon from part"
_SUPPLIER = "select s_suppkey center, cast((s_suppkey * 37) % 181 - 90 as double) c_lat, cast((s_suppkey * 53) % 361 - 180 as double) c_lon from supplier"


def _metres(lat, lon):
    h = f"(pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lon}) - radians(lon)) / 2), 2))"
    return f"2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h}))"


def _places(s, d):
    rows = table(s, d, "part").selectExpr("p_partkey as id", "cast((p_partkey * 31) % 181 - 90 as double) as lat", "cast((p_partkey * 7) % 361 - 180 as double) as lon")
    return spatial.SpatialIndex(s, held(s, ("places", d), "places", lambda path: spatial.SpatialIndex.build(rows, path)).path)


for _name, _at in (("spatial_inland", (47.0, 8.0, 2_000_000)), ("spatial_date_line", (-12.5, 179.5, 2_500_000)), ("spatial_pole", (88.0, -40.0, 900_000)), ("spatial_small", (10.0, 20.0, 400_000))):
    query(_name, f"with g as ({_PART}) select id, round({_metres(_at[0], _at[1])}, 3) metres from g where {_metres(_at[0], _at[1])} <= {_at[2]}")(
        lambda s, d, at=_at: _places(s, d).within(*at).select("id", F.round("metres", 3).alias("metres"))
    )


@query("spatial_nearest", f"with g as ({_PART}) select id, round({_metres(-3.0, -179.0)}, 3) metres from g order by {_metres(-3.0, -179.0)}, id limit 12")
def spatial_nearest(s, d):
    return _places(s, d).nearest(-3.0, -179.0, 12).select("id", F.round("metres", 3).alias("metres"))


@query("spatial_join", f"with g as ({_PART}), c as ({_SUPPLIER}) select center, count(*) n, round(max({_metres('c_lat', 'c_lon')}), 3) farthest from g, c where {_metres('c_lat', 'c_lon')} <= 700000 group by 1")
def spatial_join(s, d):
    """How many parts are around each supplier, by a join of grid cells of the places that differ."""
    c = table(s, d, "supplier").selectExpr("s_suppkey as center", "cast((s_suppkey * 37) % 181 - 90 as double) as lat", "cast((s_suppkey * 53) % 361 - 180 as double) as lon")
    return _places(s, d).around(c, 700_000).select("center", "n", F.round("farthest", 3).alias("farthest"))


# reachability and eccentricity --------------------------------------------------------------------

_SUP_R = with_views("supply", recursive=True)
_ASK = """ask as (select distinct 'c:' || o_custkey src, 'p:' || l_partkey dst from orders join lineitem on l_orderkey = o_orderkey where l_linenumber = 1
    union select distinct 'c:' || (o_custkey + 1), 'p:' || l_partkey from orders join lineitem on l_orderkey = o_orderkey where l_linenumber = 1
    union select distinct 'p:' || l_partkey, 's:' || l_suppkey from lineitem union select 'n:' || n_nationkey, 's:' || s_suppkey from nation, supplier union select 's:' || s_suppkey, 's:' || s_suppkey from supplier)"""


@query("reachability_labels", _SUP_R + f""", {_ASK}, e as materialized (select distinct src, dst from supply), starts as materialized (select distinct src from ask where src in (select src from e union select dst from e)),
reach(a, id) as (select src, src from starts union select a, dst from reach join e on src = id)
select ask.src, ask.dst, r.id is not null as reaches from ask left join reach r on r.a = ask.src and r.id = ask.dst""")
def reachability_labels(s, d):
    """Whether customers reach parts, parts suppliers, nations suppliers: a join of stored labels, without a closure."""
    x = held(s, ("reach", d), "reach", lambda path: reach.ReachabilityIndex.build(V.supply(s, d, once=False), None, path))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    first = table(s, d, "orders").join(table(s, d, "lineitem").where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey"))
    sup = table(s, d, "supplier")
    first = first.select(F.explode(F.array("o_custkey", F.col("o_custkey") + 1)).alias("c"), "l_partkey")
    asked = [first.select(name("c:", "c"), name("p:", "l_partkey")), table(s, d, "lineitem").select(name("p:", "l_partkey"), name("s:", "l_suppkey")), sup.select(name("s:", "s_suppkey"), name("s:", "s_suppkey"))]
    # every nation with every supplier: 25 rows a supplier
    asked.append(sup.select(F.explode(F.array(*[F.lit(r[0]) for r in table(s, d, "nation").select(name("n:", "n_nationkey")).collect()])), name("s:", "s_suppkey")))
    q = asked[0]
    for a in asked[1:]:
        q = q.unionAll(a)
    return x.reaches(q.toDF("src", "dst"))


_HOPS = ", n as (select src id from e union select dst from e), p(o, pos, k) as (select id, id, 0 from n union select o, dst, k + 1 from p join e on src = pos where k < {k}), h as (select o, pos, min(k) k from p group by 1, 2), ecc as (select o id, max(k)::double ecc from h group by 1)"


def _supply_ecc(s, d):
    g = graph.Graph(materialize(V.supply(s, d).select("src", "dst"), "supply"))
    return reach.eccentricities(g.edges, g.nodes)


_SUP_ECC = _SUP_R + ", e as materialized (select distinct src, dst from supply)" + _HOPS.format(k=5)


@query("supply_eccentricity", _SUP_ECC + " select id, ecc eccentricity from ecc")
def supply_eccentricity(s, d):
    """The longest hop distance of every node of the supply graph, by neighbourhood sketches."""
    return _supply_ecc(s, d).select("id", "eccentricity")


@query("supply_diameter", _SUP_ECC + " select max(ecc) diameter, min(ecc) filter (where ecc > 0) radius, count(*) filter (where ecc = (select min(ecc) from ecc where ecc > 0)) centers from ecc")
def supply_diameter(s, d):
    """Diameter, and radius and size of the center among nodes that reach any other."""
    e = materialize(_supply_ecc(s, d), "ecc")
    low = e.where("eccentricity > 0").agg(F.min("eccentricity").alias("radius"))
    return e.crossJoin(F.broadcast(low)).agg(F.max("eccentricity").alias("diameter"), F.max("radius").alias("radius"), F.count_if(F.col("eccentricity") == F.col("radius")).alias("centers"))


# structure of the neighbour graph -----------------------------------------------------------------

_SIM_R = with_views("sim", recursive=True)
_PAIRS = ", e as materialized (select src, dst from sim), n as materialized (select src id from e union select dst from e)"


def _sim(s, d):
    from graphloom.plans import q_graph

    return graph.Graph(q_graph.sim_edges(s, d).select("src", "dst"))


@query("sim_communities")
def sim_communities(s, d):
    """Communities of large modularity of the neighbour graph."""
    g = _sim(s, d)
    return structure.communities(g.edges, g.nodes)


@query("sim_modularity", _SIM_R + _PAIRS + """, label as (select id, id % 7 as label from n), a as (select src, dst from e union all select dst, src from e),
    x as (select p.label l, count(*) total, count(*) filter (where p.label = q.label) inside from a join label p on src = p.id join label q on dst = q.id group by 1)
    select round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 9) modularity from x""")
def sim_modularity(s, d):
    """The modularity of communities that are given: ids modulo seven."""
    g = _sim(s, d)
    q = structure.modularity(structure.symmetric(g.edges), g.nodes.select("id", F.pmod("id", F.lit(7)).alias("label")))
    return s.createDataFrame([(round(q, 9),)], "modularity double")


def _color_sql(rounds: int) -> str:
    """Colour refinement with ranks of sorted lists instead of hashes."""
    steps = "".join(
        f""", i{r} as materialized (select n.id, c.color, (select list_sort(list(x.color)) from e join c{r - 1} x on x.id = e.dst where e.src = n.id) o, (select list_sort(list(x.color)) from e join c{r - 1} x on x.id = e.src where e.dst = n.id) i
        from n join c{r - 1} c using (id)), c{r} as materialized (select id, dense_rank() over (order by color, o, i) color from i{r})"""
        for r in range(1, rounds + 1)
    )
    return _SIM_R + _PAIRS + ", c0 as (select id, 0::bigint color from n)" + steps + f" select size, count(*) classes from (select color, count(*) size from c{rounds} group by 1) group by 1"


@query("sim_color_classes", _color_sql(8))
def sim_color_classes(s, d):
    """How many classes of which size colour refinement leaves."""
    g = _sim(s, d)
    c = structure.color_classes(g.edges, g.nodes)
    return c.groupBy("color").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("classes"))


@query("isomorphic_copy", _SIM_R + _PAIRS + " select id a, -id b from n")
def isomorphic_copy(s, d):
    """The mapping of the neighbour graph onto a copy whose nodes have other names. The copy's names fall where those of the graph rise, so nodes that
    can be swapped for each other are paired by falling names."""
    g = _sim(s, d)
    return structure.isomorphism(g.edges, g.edges.select((-F.col("src")).alias("src"), (-F.col("dst")).alias("dst")), order_b=-F.col("id"))


@query("sim_cliques", _SIM_R + """, e as materialized (select src a, dst b from sim union select dst, src from sim), n as (select distinct a id from e),
    c(clique, last) as (select [id], id from n union all select list_append(clique, b), b from c join e on e.a = last where b > last and (select count(*) from e f where f.b = e.b and list_contains(clique, f.a)) = len(clique)),
    m as (select clique from c where not exists (select 1 from e f where f.a = clique[1] and not list_contains(clique, f.b) and (select count(*) from e g where g.b = f.b and list_contains(clique, g.a)) = len(clique)))
    select len(clique) as size, count(*) cliques, sum(list_sum(clique))::bigint total from m group by 1""")
def sim_cliques(s, d):
    """How many maximal cliques of which size the neighbour graph has, with the sum of their ids."""
    g = _sim(s, d)
    c = structure.maximal_cliques(g.edges, g.nodes)
    return c.groupBy(F.size("clique").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("cliques"), F.sum(F.aggregate("clique", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
