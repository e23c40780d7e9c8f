"""Graph, vector, knowledge, enrichment and retrieval queries, with their SQL."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import functions as F

from graphloom.functions import ml
from graphloom.operators import converged as C
from graphloom.operators import graph as G
from graphloom.operators import index as X
from graphloom.operators import iterate as I
from graphloom.operators import knowledge as K
from graphloom.operators import local as L
from graphloom.operators import ordering
from graphloom.operators import predicates as P
from graphloom.operators import proximity as R
from graphloom.operators import structure as T
from graphloom.operators import vectors as V
from graphloom.plans.registry import query
from graphloom.session import held, materialize, scratch, table
from graphloom.sources import views as S
from graphloom.sources.views import with_views
from graphloom.streaming import enrich as E

TRADE, TALL, TRANS, SUP, VEC, MSG, LOG = (with_views(x) for x in ("trade", "trade_all", "transitions", "supply", "vectors", "messages", "logs"))
RTRADE, RSUP = with_views("trade", recursive=True), with_views("supply", recursive=True)
SIM = with_views("sim", recursive=True)
DAY = 86_400_000


def trade_edges(s, d):
    """The trade edges, derived once: loops read their edges in every round."""
    return materialize(S.trade(s, d), "trade")


def supply_edges(s, d):
    return materialize(S.supply(s, d), "supply")


def trade(s, d):
    return G.Graph(trade_edges(s, d))


def vector0(s, d, i=0):
    return [float(x) for x in S.vectors(s, d).where(F.col("id") == i).first()["vector"]]


def neighbours(s, d):
    """The six nearest of every vector: stored once for a session and its tables, by the coarse index, exact."""
    return held(s, ("neighbours", d), "neighbours", lambda path: R.NeighbourGraph.build(S.vectors(s, d), path, 6))


def sim_edges(s, d):
    return neighbours(s, d).edges(3).select("src", "dst", "sim")


def text(path):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ",")


# flagship -----------------------------------------------------------------------------------------

COS0 = "round(list_cosine_similarity(v.vector, q.vector), 6) + 0.0"


@query("converged", SIM + f""", reach(id, depth) as (select 0::bigint, 0 union select dst, depth + 1 from reach join sim on src = id where depth < 3)
select d.doc_id as id, {COS0} as score from documents d join vectors v on d.doc_id = v.id, (select vector from vectors where id = 0) q
where d.lang = 'en' and d.doc_id in (select id from reach) and {COS0} >= -0.2 order by score desc, id limit 10""")
def converged(s, d):
    q = C.ConvergedQuery([("lang", "Equals", "en")], C.Neighbourhood(0, 3), C.Semantic(vector0(s, d), -0.2), limit=10)
    nodes = table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return q.run(nodes, sim_edges(s, d), S.vectors(s, d)).select("id", "score")


@query("unified_query", SIM + f""", reach(id, depth) as (select 0::bigint, 0 union select dst, depth + 1 from reach join sim on src = id or dst = id where depth < 2 and dst <> id)
select d.doc_id as id, case when {S.NOW_MS} - (1704067200000 + d.doc_id * 3600000) < 30 * {DAY}::bigint then 'active' when {S.NOW_MS} - (1704067200000 + d.doc_id * 3600000) < 90 * {DAY}::bigint then 'recent' else 'archive' end tier, {COS0} as score
from documents d join vectors v on d.doc_id = v.id, (select vector from vectors where id = 0) q
where d.doc_id in (select id from reach) and 1704067200000 + d.doc_id * 3600000 between {S.NOW_MS - 90 * DAY} and {S.NOW_MS} order by score desc, id limit 15""")
def unified_query(s, d):
    """Time scope, graph context, depth and meaning; the temperature tier of each result as its reasoning."""
    nodes = table(s, d, "documents").select(F.col("doc_id").alias("id"), (F.lit(1704067200000) + F.col("doc_id") * 3600000).alias("ts"))
    q = C.ConvergedQuery([], C.Neighbourhood(0, 2), C.Semantic(vector0(s, d)), P.time_scope(F.col("ts"), "quarter", S.NOW_MS), limit=15)
    return q.run(nodes, sim_edges(s, d), S.vectors(s, d)).select("id", K.tier_of_age(F.lit(S.NOW_MS) - F.col("ts")).alias("tier"), "score")


# vectors ------------------------------------------------------------------------------------------


def _ranked(name, sim, k=10, where=None, cond="true", threshold=None):
    having = "" if threshold is None else f"where score >= {threshold}"

    @query(name, VEC + f" select * from (select v.id, round({sim}, 6) + 0.0 score from vectors v, (select vector from vectors where id = 0) q where {cond}) {having} order by score desc, id limit {k}")
    def f(s, d):
        return V.search(S.vectors(s, d), vector0(s, d), k, "cosine", threshold, None if where is None else F.expr(where)).select("id", "score")

    return f


_C = "list_cosine_similarity(v.vector, q.vector)"
_ranked("knn_topk", _C)
_ranked("hot_search", _C, 5)
_ranked("semantic_search", _C, 20)
_ranked("semantic_threshold", _C, 500, threshold=0.1)
_ranked("semantic_filtered", _C, 10, "label in (1, 2, 3)", "label in (1, 2, 3)")
_ranked("recommend", _C, 10, "label >= 5", "label >= 5")

_TOP = VEC + f" select v.id, round({_C}, 6) + 0.0 score from vectors v, (select vector from vectors where id = 0) q "


@query("segment_topk", _TOP + "order by score desc, id limit 7")
def segment_topk(s, d):
    """Segments of 60 vectors, added in two batches; the top-k of each, then of these."""
    x = X.SegmentedIndex(s, scratch(s, "segments"), roll=60)
    v = S.vectors(s, d)
    x.add(v.where("id % 3 = 0"))
    x.add(v.where("id % 3 <> 0"))
    return x.search(vector0(s, d), 7).select("id", "score")


@query("index_topk", _TOP + "order by score desc, id limit 10")
def index_topk(s, d):
    """From the stored coarse index, exact: cells that cannot hold a better vector are not read."""
    return X.VectorIndex.build(S.vectors(s, d), scratch(s, "index")).search(vector0(s, d), 10).select("id", "score")


@query("index_filtered", _TOP + "where label in (1, 2, 3) order by score desc, id limit 10")
def index_filtered(s, d):
    """A filter that is applied before the ranking, on an index that was stored and opened again."""
    path = scratch(s, "index")
    X.VectorIndex.build(S.vectors(s, d), path)
    return X.VectorIndex(s, path).search(vector0(s, d), 10, where=F.col("label").isin(1, 2, 3)).select("id", "score")


@query("index_recall", VEC + " select 3 * count(*) pairs, true as enough from vectors where id % 10 = 0")
def index_recall(s, d):
    """Whether three quarters of the cells give at least 0.9 of the three nearest of every tenth vector."""
    v = S.vectors(s, d)
    x = X.VectorIndex.build(v, scratch(s, "index"))
    asked = v.where("id % 10 = 0")
    found = x.knn_join(asked, 3, max(1, len(x.centers) * 3 // 4), self_join=True)
    return X.recall(V.knn_join(asked, v, 3, self_join=True), found).select("pairs", (F.col("recall") >= 0.9).alias("enough"))


@query("index_knn_join", SIM.replace("with recursive", "with") + " select src, dst, sim from sim where src % 10 = 0")
def index_knn_join(s, d):
    """The three nearest of every tenth vector: the exact way of the index, which visits the cells that it cannot rule out."""
    v = S.vectors(s, d)
    x = X.VectorIndex.build(v, scratch(s, "index"))
    return x.knn_join(v.where("id % 10 = 0"), 3, self_join=True).select("src", "dst", "sim")


@query("dimension_presets", "select * from (values ('large', 1536), ('medium', 768), ('small', 384)) t(preset, dims)")
def dimension_presets(s, d):
    return s.createDataFrame(sorted(V.DIMENSIONS.items()), "preset string, dims int")


_METRICS = {
    "dist_cosine": ("cosine", "1 - list_cosine_similarity(v.vector, q.vector)"),
    "dist_euclidean": ("euclidean", "list_distance(v.vector, q.vector)"),
    "dist_manhattan": ("manhattan", "list_sum(list_transform(list_zip(v.vector, q.vector), lambda x: abs(x[1] - x[2])))"),
    "dist_dot": ("dotproduct", "-list_inner_product(v.vector, q.vector)"),
    "dist_hamming": ("hamming", "cast(list_sum(list_transform(list_zip(v.vector, q.vector), lambda x: abs((x[1] >= 0.5)::int - (x[2] >= 0.5)::int))) as double)"),
    "dist_jaccard": ("jaccard", "1 - case when list_sum(list_transform(list_zip(v.vector, q.vector), lambda x: greatest((x[1] >= 0.5)::int, (x[2] >= 0.5)::int))) = 0 then 1.0 else list_sum(list_transform(list_zip(v.vector, q.vector), lambda x: (x[1] >= 0.5)::int * (x[2] >= 0.5)::int)) / list_sum(list_transform(list_zip(v.vector, q.vector), lambda x: greatest((x[1] >= 0.5)::int, (x[2] >= 0.5)::int))) end"),
}
for _n, (_m, _sql) in _METRICS.items():
    query(_n, VEC + f" select v.id, round(cast({_sql} as double), 6) + 0.0 distance from vectors v, (select vector from vectors where id = 0) q")(
        lambda s, d, m=_m: S.vectors(s, d).select("id", (F.round(V.metric(m)[0](F.col("vector"), V.literal(vector0(s, d))), 6) + 0.0).alias("distance"))
    )


@query("knn_join", SIM.replace("with recursive", "with") + " select src, dst, sim from sim")
def knn_join(s, d):
    """All blocks against all: the way that needs no index."""
    v = S.vectors(s, d)
    return V.knn_join(v, v, 3, self_join=True).select("src", "dst", "sim")


@query("associative_links", SIM.replace("with recursive", "with") + " select src, dst, 'IS_SEMANTICALLY_SIMILAR_TO' edge_type, sim score from sim where sim >= 0.3")
def associative_links(s, d):
    return E.associate(neighbours(s, d).edges(6), 0.3, 3)


@query("pairwise_similarity", VEC + " select a.id a, b.id b, round(list_cosine_similarity(a.vector, b.vector), 6) + 0.0 sim from vectors a join vectors b on a.id < b.id and a.label = b.label")
def pairwise_similarity(s, d):
    """The similarity matrix of each class; ``pairwise_all`` is that of all vectors."""
    return V.pairwise(S.vectors(s, d), by="label")


@query("pairwise_all", VEC + " select a.id a, b.id b, round(list_cosine_similarity(a.vector, b.vector), 6) + 0.0 sim from vectors a join vectors b on a.id < b.id")
def pairwise_all(s, d):
    """The similarity matrix of all vectors."""
    return V.pairwise(S.vectors(s, d))


@query("vector_dims", VEC + " select id, len(vector) dims from vectors")
def vector_dims(s, d):
    return S.vectors(s, d).select("id", F.size("vector").alias("dims"))


_Q = "list_transform(vector, lambda x: cast(floor((x - list_min(vector)) / case when list_max(vector) - list_min(vector) < 1e-12 then 1.0 else list_max(vector) - list_min(vector) end * 255 + 0.5) as integer))"


@query("quantize_scalar", VEC + f" select id, array_to_string({_Q}, ',') codes from vectors")
def quantize_scalar(s, d):
    return S.vectors(s, d).select("id", text(V.quantize(F.col("vector"))["codes"]).alias("codes"))


query("quantize_product", VEC + f" select id, array_to_string({_Q}, ',') codes from vectors")(quantize_scalar)


@query("dequantize", VEC + f", q as (select id, vector, {_Q} codes, list_min(vector) lo, list_max(vector) - list_min(vector) span from vectors) select id, round(list_max(list_transform(list_zip(vector, codes), lambda x: abs(x[1] - (lo + x[2] / 255.0 * span)))), 6) worst from q")
def dequantize(s, d):
    v = S.vectors(s, d).withColumn("q", V.quantize(F.col("vector")))
    return v.select("id", F.round(F.array_max(F.zip_with("vector", V.dequantize(F.col("q")), lambda x, y: F.abs(x - y))), 6).alias("worst"))


@query("quantized_cosine", VEC + f", q as (select id, list_transform({_Q}, lambda c: c::double) codes from vectors) select q.id, round(list_cosine_similarity(q.codes, z.codes), 6) + 0.0 sim from q, (select codes from q where id = 0) z")
def quantized_cosine(s, d):
    v = S.vectors(s, d).select("id", F.transform(V.quantize(F.col("vector"))["codes"], lambda c: c.cast("double")).alias("codes"))
    z = [float(x) for x in v.where("id = 0").first()["codes"]]
    return v.select("id", (F.round(V.cosine(F.col("codes"), V.literal(z)), 6) + 0.0).alias("sim"))


@query("semantic_semi_join", VEC + f" select v.id, round({_C}, 6) + 0.0 score from vectors v, (select vector from vectors where id = 0) q where v.id in (select doc_id from documents where lang = 'fr') order by score desc, v.id limit 10")
def semantic_semi_join(s, d):
    hits = S.vectors(s, d).join(table(s, d, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return V.search(hits, vector0(s, d), 10).select("id", "score")


@query("vector_payload_search", VEC + f" select v.id, round({_C}, 6) + 0.0 score from vectors v, (select vector from vectors where id = 0) q where v.id in (select event_id from events where event_type = 'purchase') order by score desc, v.id limit 10")
def vector_payload_search(s, d):
    keep = S.event_payloads(s, d).where(P.PayloadFilter().must_match("purchase").column(F.col("fields"))).select("id")
    return V.search(S.vectors(s, d).join(keep, "id", "left_semi"), vector0(s, d), 10).select("id", "score")


@query("search_until", VEC + f", r as (select v.id, round({_C}, 6) + 0.0 score, label, row_number() over (order by round({_C}, 6) + 0.0 desc, v.id) rk from vectors v, (select vector from vectors where id = 0) q) select id, score from r where rk <= 50 and rk < coalesce((select min(rk) from r where label = 3), 1000000)")
def search_until(s, d):
    """Hits in rank order up to the first of label 3."""
    from pyspark.sql import Window

    r = V.search(S.vectors(s, d), vector0(s, d), 50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return V.until(r, F.col("label") == 3).select("id", "score")


@query("two_stage_search", VEC + f", a as (select v.id, v.vector from vectors v, (select vector from vectors where id = 0) q order by round(list_cosine_similarity(v.vector[1:16], q.vector[1:16]), 6) + 0.0 desc, v.id limit 100) select v.id, round({_C}, 6) + 0.0 score from a v, (select vector from vectors where id = 0) q order by score desc, v.id limit 10")
def two_stage_search(s, d):
    return V.two_stage(S.vectors(s, d), vector0(s, d), 100, 10, 16).select("id", "score")


@query("approx_search")
def approx_search(s, d):
    """Top-k of a sample that the ids' hashes choose."""
    v = S.vectors(s, d)
    return V.search(v.where(F.pmod(F.xxhash64("id"), F.lit(100)) < 50), vector0(s, d), 10).select("id", "score")


_OPS = "ops as (select o_custkey k, o_orderkey seq, case when o_orderstatus = 'F' then 'remove' else 'add' end op from orders)"


@query("batch_apply", f"with {_OPS} select k from ops qualify row_number() over (partition by k order by seq desc) = 1 and op = 'add'")
def batch_apply(s, d):
    ops = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("op"))
    return G.apply_batch(ops, ["k"])


@query("batch_graph_apply", "with ops as (select l_suppkey src, l_partkey dst, l_orderkey * 10 + l_linenumber seq, case when l_returnflag = 'R' then 'remove' else 'add' end op from lineitem) select src, dst from ops qualify row_number() over (partition by src, dst order by seq desc) = 1 and op = 'add'")
def batch_graph_apply(s, d):
    li = table(s, d, "lineitem")
    ops = li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("op"))
    return G.apply_batch(ops, ["src", "dst"])


@query("eval_recall_at_k", SIM.replace("with recursive", "with") + " select a.label, round(avg(case when a.label = b.label then 1.0 else 0.0 end), 6) recall from sim join vectors a on src = a.id join vectors b on dst = b.id group by 1")
def eval_recall_at_k(s, d):
    """Share of the three nearest that have the query's label."""
    l = S.vectors(s, d).select("id", "label")  # noqa: E741
    e = sim_edges(s, d).join(l.select(F.col("id").alias("src"), "label"), "src").join(l.select(F.col("id").alias("dst"), F.col("label").alias("other")), "dst")
    return e.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 6).alias("recall"))


@query("eval_mrr", SIM.replace("with recursive", "with") + ", r as (select src, dst, row_number() over (partition by src order by sim desc, dst) rk from sim) select round(avg(coalesce(x, 0)), 6) mrr from (select v.id, (select max(1.0 / rk) from r join vectors w on dst = w.id where src = v.id and w.label = v.label) x from vectors v)")
def eval_mrr(s, d):
    v = S.vectors(s, d)
    l = v.select("id", "label")  # noqa: E741
    r = neighbours(s, d).edges(3).join(l.select(F.col("id").alias("src"), "label"), "src").join(l.select(F.col("id").alias("dst"), F.col("label").alias("other")), "dst")
    best = r.where("label = other").groupBy("src").agg(F.max(1.0 / F.col("rank")).alias("x"))
    return l.join(best, F.col("id") == F.col("src"), "left").agg(F.round(F.avg(F.coalesce("x", F.lit(0.0))), 6).alias("mrr"))


@query("kmeans_assign_step", VEC + " select v.id, arg_min(c.id, round(list_distance(v.vector, c.vector), 6) * 1000000 + c.id * 1e-6) cluster, min(round(list_distance(v.vector, c.vector), 6)) distance from vectors v, (select * from vectors where id < 5) c group by 1")
def kmeans_assign_step(s, d):
    v = S.vectors(s, d)
    return ml.kmeans_step(v, v.where("id < 5").select(F.col("id").alias("cluster"), F.col("vector").alias("center")))


@query("kmeans")
def kmeans(s, d):
    return ml.kmeans(S.vectors(s, d), 5, seed=1)


@query("softmax_rank", VEC + ", s as (select v.id, label, list_inner_product(v.vector, q.vector) sc from vectors v, (select vector from vectors where id = 0) q) select id, label, round(exp(sc - max(sc) over (partition by label)) / sum(exp(sc)) over (partition by label) * exp(max(sc) over (partition by label)), 6) p from s")
def softmax_rank(s, d):
    sc = S.vectors(s, d).select("id", "label", V.dot(F.col("vector"), V.literal(vector0(s, d))).alias("score"))
    return ml.softmax(sc, "label").select("id", "label", "p")


def _embedded_sql(rows: str, asked: str | None = None) -> str:
    """SQL: v(id, k, s) of rows (id, text), not yet scaled, n(id, n) the squared lengths; q and qn of the asked text."""
    part = lambda name, src: f"{name}_b as (select id, regexp_extract_all(hex(encode(text)), '..') b from ({src})), {name} as (select id, i % 384 k, sum(cast('0x' || x as integer) / 255.0::double) s from (select id, unnest(b) x, generate_subscripts(b, 1) - 1 i from {name}_b) group by 1, 2), {name}n as (select id, sum(s * s) n from {name} group by 1)"
    return "with " + part("v", rows) + (", " + part("q", f"select 0 id, '{asked}' as text") if asked else "")


_ASKED = "thing tion and the"
_SCORED = " select v.id, round(sum(v.s * q.s) / sqrt(any_value(vn.n) * any_value(qn.n)), 6) {name} from v join q using (k) join vn on vn.id = v.id, qn group by 1"


@query("embed_text", _embedded_sql("select item_id id, text from benchmark") + " select v.id, cast(k as integer) as place, round(s / sqrt(n), 6) as value from v join vn using (id) where s > 0")
def embed_text(s, d):
    """The components that are not 0."""
    v = table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(ml.embedder()("text")).alias("place", "value"))
    return v.where("value > 0").select("id", "place", F.round("value", 6).alias("value"))


@query("text_similarity", _embedded_sql("select item_id id, text from benchmark", "the and of") + _SCORED.format(name="sim"))
def text_similarity(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("id"), ml.embedder()("text").alias("vector"))
    return b.select("id", F.round(V.cosine(F.col("vector"), V.literal(ml.byte_embedding("the and of"))), 6).alias("sim"))


@query("semantic_search_text", _embedded_sql("select doc_id id, text from documents", _ASKED) + _SCORED.format(name="score") + " order by 2 desc, 1 limit 10")
def semantic_search_text(s, d):
    b = table(s, d, "documents").select(F.col("doc_id").alias("id"), ml.embedder()("text").alias("vector"))
    return V.search(b, ml.byte_embedding(_ASKED), 10).select("id", "score")


@query("rag_query", _embedded_sql("select doc_id id, text from documents where lang = 'en'", _ASKED) + _SCORED.format(name="score") + " order by 2 desc, 1 limit 5")
def rag_query(s, d):
    """Filter, embed, rank: five passages for a question."""
    b = table(s, d, "documents").where(P.structural("lang", "Equals", "en")).select(F.col("doc_id").alias("id"), ml.embedder()("text").alias("vector"))
    return V.search(b, ml.byte_embedding(_ASKED), 5).select("id", "score")


@query("rerank_topn", "with q as (select ['the', 'and', 'of', 'thing'] w), t as (select doc_id id, list_distinct(regexp_split_to_array(lower(text), '\\s+')) ws from documents) select id, round(len(list_intersect(ws, w)) / 4.0, 6) score from t, q order by score desc, id limit 5")
def rerank_topn(s, d):
    return ml.rerank(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), ml.overlap_score("the and of thing")(F.col("text"))).select("id", "score")


@query("cache_reuse", VEC + f" select v.id, round({_C}, 6) + 0.0 score from vectors v join events e on v.id = e.event_id, (select vector from vectors where id = 0) q where v.id <> 0 and (epoch_us(ts) // 1000) >= 1704067200000 + {DAY} and round({_C}, 6) >= 0.1 order by score desc, v.id limit 1")
def cache_reuse(s, d):
    """The most similar past search that is fresh enough."""
    fresh = table(s, d, "events").where(S.millis("ts") >= 1704067200000 + DAY).select(F.col("event_id").alias("id"))
    return V.search(S.vectors(s, d).join(fresh, "id", "left_semi"), vector0(s, d), 1, threshold=0.1, where=F.col("id") != 0).select("id", "score")


# graph basics -------------------------------------------------------------------------------------

for _dir, _sql in {"out": "select dst id from trade where src = 1", "in": "select src id from trade where dst = 9"}.items():
    query(f"neighbors_{_dir}", TRADE + " " + _sql)(lambda s, d, x=_dir: trade(s, d).neighbors({"out": 1, "in": 9}[x], x))
for _deg, _expr in {"out": "sum(o)", "in": "sum(i)", "total": "sum(o) + sum(i)"}.items():
    query(f"degree_{_deg}", SUP + f" select id, cast({_expr} as bigint) degree from (select src id, 1 o, 0 i from supply union all select dst, 0, 1 from supply) group by 1")(
        lambda s, d, x={"out": "out_degree", "in": "in_degree", "total": "degree"}[_deg]: G.Graph(S.supply(s, d)).degrees().select("id", F.col(x).alias("degree"))
    )


@query("graph_counts", SUP + " select (select count(*) from (select src from supply union select dst from supply)) nodes, count(*) edges from supply")
def graph_counts(s, d):
    return G.Graph(S.supply(s, d)).counts()


@query("graph_nodes", SUP + " select src id from supply union select dst from supply")
def graph_nodes(s, d):
    return G.Graph(S.supply(s, d)).nodes


@query("has_edge", TRADE + " select count(*) > 0 has_edge from trade where src = 1 and dst = 2")
def has_edge(s, d):
    return trade(s, d).has_edge(1, 2)


@query("subgraph_nodes", TALL + " select src, dst, weight from trade_all where src >= 10 and dst >= 10")
def subgraph_nodes(s, d):
    return G.Graph(S.trade_all(s, d)).where_nodes(F.col("id") >= 10).edges


@query("subgraph_edges", SUP + " select src, dst from supply where edge_type = 'PLACED'")
def subgraph_edges(s, d):
    return G.Graph(S.supply(s, d)).where_edges(F.col("edge_type") == "PLACED").edges.select("src", "dst")


@query("graph_reverse", TRADE + " select dst src, src dst, weight from trade")
def graph_reverse(s, d):
    return trade(s, d).reverse().edges


@query("graph_undirect", TRADE + " select src, dst from trade union select dst, src from trade")
def graph_undirect(s, d):
    return trade(s, d).undirected()


_G1, _G2 = "(select src, dst from trade)", "(select dst src, src dst from trade)"
for _op, _sql in {"union": "union", "intersection": "intersect", "difference": "except"}.items():
    query(f"graph_{_op}", TRADE + f" select * from {_G1} {_sql} select * from {_G2}")(lambda s, d, x=_op: getattr(trade(s, d), x)(trade(s, d).reverse()))


@query("graph_complement", TRADE + ", n as (select src id from trade union select dst from trade) select a.id src, b.id dst from n a, n b where a.id <> b.id and (a.id, b.id) not in (select (src, dst) from trade)")
def graph_complement(s, d):
    return trade(s, d).complement()


@query("csr_rows", TRADE + ", n as (select src id from trade union select dst from trade), r as (select id, (select count(*) from trade where src = id) k, (select string_agg(dst, ',' order by dst) from trade where src = id) t from n) select id, cast(sum(k) over (order by id) - k as bigint) row_start, cast(sum(k) over (order by id) as bigint) row_end, coalesce(t, '') targets from r")
def csr_rows(s, d):
    return trade(s, d).csr().withColumn("targets", text(F.col("targets")))


@query("dot_export", TRADE + """, n as (select src id from trade union select dst from trade), l as (select 0 part, 'digraph trade {' line, null::bigint a, null::bigint b union all select 1, '  "' || id || '";', id, id from n
union all select 2, '  "' || src || '" -> "' || dst || '";', src, dst from trade union all select 3, '}', null, null) select cast(row_number() over (order by part, a, b) - 1 as integer) line_no, line from l""")
def dot_export(s, d):
    return trade(s, d).dot("trade")


@query("degree_sequence_equal", TRADE + """, g as (select src id from trade union all select dst from trade), h as (select dst id from trade union all select src from trade),
a as (select k, count(*) n from (select id, count(*) k from g group by 1) group by 1), b as (select k, count(*) n from (select id, count(*) k from h group by 1) group by 1)
select count(*) = 0 as equal from ((select * from a except select * from b) union all (select * from b except select * from a))""")
def degree_sequence_equal(s, d):
    """A graph and its reverse have equal sequences of total degrees."""
    a = trade(s, d)
    seq = lambda g: g.degrees().groupBy("degree").count()
    x, y = seq(a), seq(a.reverse())
    return x.exceptAll(y).unionAll(y.exceptAll(x)).agg((F.count(F.lit(1)) == 0).alias("equal"))


_GEN = {
    "gen_complete": (lambda s: G.complete(s, 12), "select a.range src, b.range dst from range(12) a, range(12) b where a.range <> b.range"),
    "gen_path": (lambda s: G.path(s, 12), "select range src, range + 1 dst from range(11)"),
    "gen_cycle": (lambda s: G.cycle(s, 12), "select range src, (range + 1) % 12 dst from range(12)"),
    "gen_star": (lambda s: G.star(s, 12), "select 0::bigint src, range dst from range(1, 12)"),
    "gen_tree": (lambda s: G.binary_tree(s, 4), "select (range - 1) // 2 src, range dst from range(1, 31)"),
}
for _n, (_f, _sql) in _GEN.items():
    query(_n, _sql)(lambda s, d, f=_f: f(s))


@query("gen_random")
def gen_random(s, d):
    return G.random(s, 30, 0.2, 7)


@query("graph_explorer_filter", SUP + """, n as (select 'p:' || p_partkey id, p_name as label, 'part' node_type, p_brand brand from part union all select 's:' || s_suppkey, s_name, 'supplier', '' from supplier),
e as (select src, dst, edge_type from supply where edge_type = 'SUPPLIES'), f as (select id from n where contains(lower(label), '1') or contains(lower(node_type), '1') or contains(lower(brand), '1')),
e2 as (select src, dst from e where src in (select id from f) and dst in (select id from f)), g as (select id from (select src id from e2 union all select dst from e2) group by 1 having count(*) >= 2)
select src, dst from e2 where src in (select id from g) and dst in (select id from g)""")
def graph_explorer_filter(s, d):
    p = table(s, d, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.lit("part").alias("node_type"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("properties"))
    u = table(s, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")), F.col("s_name"), F.lit("supplier"), F.create_map(F.lit("brand"), F.lit("")))
    _, e = G.explorer_filter(S.supply(s, d), p.union(u), ["part", "supplier"], ["SUPPLIES"], "1", 2)
    return e.select("src", "dst")


# traversal ----------------------------------------------------------------------------------------


def _bfs_sql(step, cond="", start="'c:1'", depth=3, pre=RSUP):
    return pre + f", reach(id, depth) as (select {start}, 0 union {step} {cond})"


_OUT = "select dst, depth + 1 from reach join supply on src = id where depth < {n}"
_IN = "select src, depth + 1 from reach join supply on dst = id where depth < {n}"


@query("bfs_levels", RSUP + ", reach(id, depth) as (select 'n:1', 0 union " + _OUT.format(n=3) + ") select id, min(depth) as depth from reach group by 1")
def bfs_levels(s, d):
    return I.bfs(supply_edges(s, d), "n:1", 3)


@query("graph_filter_out", RSUP + ", reach(id, depth) as (select 'c:1', 0 union " + _OUT.format(n=2) + ") select distinct id from reach")
def graph_filter_out(s, d):
    return I.graph_filter(supply_edges(s, d), "c:1", 2)


@query("graph_filter_in", RSUP + ", reach(id, depth) as (select 'p:1', 0 union " + _IN.format(n=2) + ") select distinct id from reach")
def graph_filter_in(s, d):
    return I.graph_filter(supply_edges(s, d), "p:1", 2, "in")


@query("graph_filter_both", RSUP + ", both_ as (select src, dst from supply union all select dst, src from supply), reach(id, depth) as (select 'c:1', 0 union select dst, depth + 1 from reach join both_ on src = id where depth < 2) select distinct id from reach")
def graph_filter_both(s, d):
    return I.graph_filter(supply_edges(s, d), "c:1", 2, "both")


@query("graph_filter_typed", RSUP + ", reach(id, depth) as (select 'n:1', 0 union " + _OUT.format(n=2) + " and edge_type in ('HAS_CUSTOMER')) select distinct id from reach")
def graph_filter_typed(s, d):
    return I.graph_filter(supply_edges(s, d), "n:1", 2, edge_type="HAS_CUSTOMER")


@query("graph_filter_exclusive", RSUP + ", reach(id, depth) as (select 'c:1', 0 union " + _OUT.format(n=1) + ") select distinct id from reach")
def graph_filter_exclusive(s, d):
    """The last ring is left out: an expansion by two rounds keeps the expanded nodes."""
    return I.graph_filter(supply_edges(s, d), "c:1", 2, inclusive=False)


@query("reachable", RTRADE + ", reach(id) as (select 0::bigint union select dst from reach join trade on src = id) select id from reach")
def reachable(s, d):
    return I.bfs(trade_edges(s, d), 0).select("id")


_PATHS = RTRADE + ", p(pos, path, cost) as (select {a}::bigint, [{a}::bigint], 0.0::double union all select dst, list_append(path, dst), cost + weight from p join trade on src = pos where not list_contains(path, dst) and pos <> {b} and len(path) < {n})"
_DIST = RTRADE + ", r0 as (select src, dst, min({w}) w from trade group by 1, 2), p(pos, path, cost) as (select 0::bigint, [0::bigint], 0.0::double union all select dst, list_append(path, dst), cost + w from p join r0 on src = pos where not list_contains(path, dst) and len(path) < 9)"


def _weighted(s, d):
    return trade_edges(s, d).withColumn("weight", F.col("weight").cast("double"))


#: Trade weights are close to each other, so the cheapest paths have few edges; the SQL looks at paths of up to nine nodes.
for _n in ("sssp_weighted", "spfa", "bellman_ford"):
    query(_n, _DIST.format(w="weight") + " select pos id, min(cost) cost from p group by 1")(lambda s, d: I.sssp(_weighted(s, d), 0))


query("astar_zero_h", _DIST.format(w="weight") + " select min(cost) cost from p where pos = 9 having count(*) > 0")(lambda s, d: I.astar(_weighted(s, d), 0, 9, s.createDataFrame([], "id long, h double")).select("cost"))


@query("astar", _DIST.format(w="weight") + " select min(cost) cost from p where pos = 14 having count(*) > 0")
def astar(s, d):
    """To nation 14; what is left is at least the hops to it, each at the least weight."""
    e = _weighted(s, d)
    hops = I.bfs(e, 14, direction="in").crossJoin(F.broadcast(e.agg(F.min("weight").alias("least"))))
    return I.astar(e, 0, 14, hops.select("id", (F.col("depth") * F.col("least")).alias("h"))).select("cost")


@query("bidirectional_dijkstra", _DIST.format(w="weight") + " select min(cost) cost from p where pos = 9 having count(*) > 0")
def bidirectional_dijkstra(s, d):
    return I.bidirectional(_weighted(s, d), 0, 9)


@query("bidirectional_bfs", _DIST.format(w="1") + " select min(cost) cost from p where pos = 14 having count(*) > 0")
def bidirectional_bfs(s, d):
    return I.bidirectional(trade_edges(s, d).withColumn("weight", F.lit(1.0)), 0, 14)


@query("bidirectional_path", _DIST.format(w="1") + " select cost, array_to_string(path, ',') as path from p where pos = 14 order by cost, path limit 1")
def bidirectional_path(s, d):
    """The least of the shortest paths to nation 14, by searches from both ends."""
    return I.bidirectional_path(trade_edges(s, d).withColumn("weight", F.lit(1.0)), 0, 14).select("cost", text(F.col("path")).alias("path"))


@query("sssp_path", _DIST.format(w="weight") + " select cost, array_to_string(path, ',') as path from p where pos = 9 order by cost, path limit 1")
def sssp_path(s, d):
    return I.least_path(_weighted(s, d), 0, 9).select("cost", text(F.col("path")).alias("path"))


@query("shortest_path_bfs", _DIST.format(w="1") + " select cost, array_to_string(path, ',') as path from p where pos = 9 order by cost, path limit 1")
def shortest_path_bfs(s, d):
    return I.least_path(trade_edges(s, d).withColumn("weight", F.lit(1.0)), 0, 9).select("cost", text(F.col("path")).alias("path"))


@query("nearest_goal", _DIST.format(w="weight") + " select pos id, min(cost) cost from p where pos in (4, 9, 14) group by 1 order by cost, id limit 1")
def nearest_goal(s, d):
    return I.goal_cost(I.sssp(_weighted(s, d), 0), F.col("id").isin(4, 9, 14))


_APSP = RTRADE + ", n as (select src id from trade union select dst from trade), p(o, pos, k, cost) as (select id, id, 0, 0.0::double from n union all select o, dst, k + 1, min(cost + weight) from p join trade on src = pos where k < 8 group by o, dst, k + 1) select o src, pos dst, min(cost) cost from p group by 1, 2"
query("apsp", _APSP)(lambda s, d: I.apsp(_weighted(s, d)))


@query("johnson", _APSP.replace("cost + weight", "cost + weight + (src - dst) * 50"))
def johnson(s, d):
    """Weights that are lifted by 50 for each step down in the numbers: some are negative, no cycle is."""
    e = _weighted(s, d).withColumn("weight", F.col("weight") + (F.col("src") - F.col("dst")) * 50)
    return I.johnson(e)[0]


@query("all_simple_paths", _PATHS.format(a=0, b=9, n=5) + " select array_to_string(path, ',') as path, cost from p where pos = 9")
def all_simple_paths(s, d):
    """Up to five nodes."""
    return I.simple_paths(trade_edges(s, d), 0, 9, 5).select(text(F.col("path")).alias("path"), "cost")


@query("find_all_paths", _PATHS.format(a=0, b=9, n=6) + " select array_to_string(path, ',') as path from p where pos = 9")
def find_all_paths(s, d):
    """Up to five edges."""
    return I.simple_paths(trade_edges(s, d), 0, 9, 6).select(text(F.col("path")).alias("path"))


@query("k_shortest_paths", _PATHS.format(a=0, b=9, n=6) + " select cast(row_number() over (order by cost, path) as integer) as \"rank\", cost, array_to_string(path, ',') as path from p where pos = 9 order by cost, p.path limit 5")
def k_shortest_paths(s, d):
    return I.k_shortest(trade_edges(s, d), 0, 9, 5).select("rank", "cost", text(F.col("path")).alias("path"))


@query("simple_cycles", RTRADE + ", p(f, pos, path) as (select src, dst, [src, dst] from trade where dst > src union all select f, dst, list_append(path, dst) from p join trade on src = pos where dst > f and not list_contains(path, dst) and len(path) < 4) select array_to_string(path, ',') as path from p join trade on src = pos and dst = f")
def simple_cycles(s, d):
    return I.simple_cycles(trade_edges(s, d), 4).select(text(F.col("path")).alias("path"))


@query("two_hop_pattern", SUP + " select a.src customer, count(distinct b.dst) parts from supply a join supply b on a.dst = b.src where a.edge_type = 'PLACED' and b.edge_type = 'CONTAINS' group by 1")
def two_hop_pattern(s, d):
    """(customer)-[PLACED]->()-[CONTAINS]->(part)."""
    e = S.supply(s, d)
    a, b = e.where("edge_type = 'PLACED'").select(F.col("src").alias("customer"), F.col("dst").alias("o")), e.where("edge_type = 'CONTAINS'").select(F.col("src").alias("o"), F.col("dst").alias("p"))
    return a.join(b, "o").groupBy("customer").agg(F.count_distinct("p").alias("parts"))


_CLOSE = RTRADE + ", c(src, dst) as (select src, dst from trade union select c.src, t.dst from c join trade t on c.dst = t.src)"


@query("transitive_closure", _CLOSE + " select src, dst from c where src <> dst")
def transitive_closure(s, d):
    return I.closure(trade_edges(s, d)).where("src <> dst")


_DAG = "dag as (select src, dst from supply where edge_type in ('HAS_NATION', 'HAS_SUPPLIER') union all select 'r:' || r_regionkey, 's:' || s_suppkey from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey)"


def _dag(s, d):
    e = S.supply(s, d)
    short = table(s, d, "nation").join(table(s, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("dst"))
    return e.where(F.col("edge_type").isin("HAS_NATION", "HAS_SUPPLIER")).select("src", "dst").unionAll(short)


@query("transitive_reduction", SUP + f", {_DAG} select distinct src, dst from dag e where not exists (select 1 from dag a join dag b on a.dst = b.src where a.src = e.src and b.dst = e.dst)")
def transitive_reduction(s, d):
    return I.reduction(materialize(_dag(s, d), "dag"))


_LEVELS = RSUP + ", n as (select src id from supply union select dst from supply), l(id, level) as (select id, 0 from n where id not in (select dst from supply) union select dst, level + 1 from l join supply on src = id) select id, max(level) as level from l group by 1"


@query("topo_levels", _LEVELS)
def topo_levels(s, d):
    g = G.Graph(supply_edges(s, d).select("src", "dst"))
    return I.topo_levels(g.edges, g.nodes)


query("topo_order", _LEVELS.replace("select id, max(level) as level from l group by 1", "select id, row_number() over (order by max(level), id) place from l group by 1"))(
    lambda s, d: _topo_order(s, d)
)


def _topo_order(s, d):
    g = G.Graph(supply_edges(s, d).select("src", "dst"))
    return I.topo_sort(g.edges, g.nodes)


@query("dag_cycle_check", RSUP + ", l(id, level) as (select id, 0 from (select src id from supply union select dst from supply) union select dst, level + 1 from l join supply on src = id where level < 12) select count(*) > 0 as has_cycle from l where level = 12")
def dag_cycle_check(s, d):
    """By trimming; the SQL looks for a walk of twelve edges, which only a cycle allows here."""
    return s.createDataFrame([(I.has_cycle(supply_edges(s, d)),)], "has_cycle boolean")


@query("is_cyclic_directed", _CLOSE + " select count(*) > 0 cyclic from c where src = dst")
def is_cyclic_directed(s, d):
    return s.createDataFrame([(I.has_cycle(trade_edges(s, d)),)], "cyclic boolean")


@query("is_cyclic_undirected", TRADE + ", u as (select distinct least(src, dst) a, greatest(src, dst) b from trade), n as (select a id from u union select b from u) select (select count(*) from u) > (select count(*) from n) - 1 cyclic")
def is_cyclic_undirected(s, d):
    """More edges than nodes less components (the trade graph is connected)."""
    g = trade(s, d)
    e = g.undirected().where("src < dst").count()
    c = I.connected_components(g.edges, g.nodes)
    return c.agg((F.lit(e) > F.count(F.lit(1)) - F.count_distinct("component")).alias("cyclic"))


_CC = RSUP + ", e as (select src a, dst b from supply where edge_type in ('HAS_CUSTOMER', 'HAS_SUPPLIER')), both_ as (select a src, b dst from e union select b, a from e), r(id, root) as (select src, src from both_ where starts_with(src, 'n:') union select dst, root from r join both_ on src = id), l as (select root, min(id) component from r group by 1)"


def _nation_graph(s, d):
    """Nations with their customers and suppliers: a component for each nation."""
    return G.Graph(materialize(S.supply(s, d).where("edge_type in ('HAS_CUSTOMER', 'HAS_SUPPLIER')").select("src", "dst"), "nations"))


@query("connected_components", _CC + " select id, component from r join l using (root)")
def connected_components(s, d):
    g = _nation_graph(s, d)
    return I.connected_components(g.edges, g.nodes)


@query("cc_count", _CC + " select count(*) n from l")
def cc_count(s, d):
    return connected_components(s, d).agg(F.count_distinct("component").alias("n"))


@query("scc", _CLOSE + ", n as (select src id from trade union select dst from trade) select id, least(id, coalesce((select min(x.dst) from c x join c y on x.src = y.dst and x.dst = y.src where x.src = id), id)) component from n")
def scc(s, d):
    g = trade(s, d)
    return I.strong_components(g.edges, g.nodes)


@query("is_bipartite", RTRADE + ", e as (select src, dst from trade union select dst, src from trade), r(id, s) as (select (select min(src) from trade), 0 union select dst, 1 - s from r join e on src = id) select count(*) = 0 is_bipartite from (select id from r group by 1 having count(*) > 1)")
def is_bipartite(s, d):
    g = trade(s, d)
    return I.is_bipartite(g.edges, g.nodes)


_MST = TALL.replace("with ", "with recursive ", 1) + """, u as (select least(src, dst) a, greatest(src, dst) b, min(weight) w from trade_all group by 1, 2), o as materialized (select a, b, w, row_number() over (order by w, a, b) i from u), both_ as materialized (select a x, b y, i from o union all select b, a, i from o),
r(e, node) as (select i, a from o union select e, y from r join both_ on x = node where i < e) select a src, b dst, w weight from o where not exists (select 1 from r where e = i and node = b)"""

for _n in ("mst_kruskal", "mst_prim"):

    @query(_n, _MST)
    def mst(s, d):
        g = G.Graph(S.trade_all(s, d))
        return I.minimum_spanning_forest(g.edges, g.nodes)


def _pagerank_sql(rounds):
    steps = "".join(f", r{i} as (select id, 0.15 / (select count(*) from n) + 0.85 * coalesce((select sum(rank / k) from r{i - 1} p join e on e.src = p.id join o on o.src = p.id where e.dst = n.id), 0) as rank from n)" for i in range(1, rounds + 1))
    return TRADE + ", e as materialized (select src, dst from trade), n as materialized (select src id from e union select dst from e), o as materialized (select src, count(*) k from e group by 1), r0 as (select id, 1.0::double / (select count(*) from n) as rank from n)" + steps.replace(" as (select id, 0.15", " as materialized (select id, 0.15") + f" select id, round(rank, 6) as rank from r{rounds}"


@query("pagerank", _pagerank_sql(20))
def pagerank(s, d):
    g = trade(s, d)
    return I.pagerank(g.edges, g.nodes, 20).select("id", F.round("rank", 6).alias("rank"))


def _labels_sql(rounds):
    steps = "".join(f", l{i} as materialized (select n.id, coalesce((select label from (select p.label, count(*) k from e join l{i - 1} p on e.src = p.id where e.dst = n.id group by 1) order by k desc, label limit 1), (select label from l{i - 1} p where p.id = n.id)) as label from n)" for i in range(1, rounds + 1))
    return TRADE + ", e as materialized (select src, dst from trade union select dst, src from trade), n as materialized (select src id from e union select dst from e), l0 as (select id, id as label from n)" + steps + f" select id, label from l{rounds}"


@query("label_propagation", _labels_sql(4))
def label_propagation(s, d):
    g = trade(s, d)
    return I.label_propagation(g.edges, g.nodes, 4)


@query("maximal_cliques", RTRADE + ", e as (select src a, dst b from trade union select dst, src from trade), n as (select distinct a id from e), c(clique, last) as (select [id], id from n union all select list_append(clique, id), id from c, n where id > last and not exists (select 1 from unnest(clique) u(x) where (x, id) not in (select (a, b) from e))) select array_to_string(clique, ',') clique from c where not exists (select 1 from n where not list_contains(clique, id) and (select bool_and((x, id) in (select (a, b) from e)) from unnest(clique) u(x)))")
def maximal_cliques(s, d):
    g = trade(s, d)
    return T.maximal_cliques(g.edges, g.nodes).select(text(F.col("clique")).alias("clique"))


_LCC = TRADE + ", u as (select distinct least(src, dst) a, greatest(src, dst) b from trade), e as (select a src, b dst from u union all select b, a from u), n as (select distinct src id from e), g as (select src id, count(*) k from e group by 1), t as (select x.src id, count(*) k from e x join e y on x.src = y.src and x.dst < y.dst join u on a = x.dst and b = y.dst group by 1), l as (select g.id, case when g.k < 2 then 0.0 else 2.0 * coalesce(t.k, 0) / (g.k * (g.k - 1)) end c from g left join t on g.id = t.id)"


@query("clustering_local", _LCC + " select id, round(c, 6) coefficient from l")
def clustering_local(s, d):
    g = trade(s, d)
    return I.clustering(g.edges, g.nodes).select("id", F.round("coefficient", 6).alias("coefficient"))


@query("clustering_global", _LCC + " select round(avg(c), 6) coefficient from l")
def clustering_global(s, d):
    g = trade(s, d)
    return I.clustering(g.edges, g.nodes).agg(F.round(F.avg("coefficient"), 6).alias("coefficient"))


_ECC = RTRADE + ", n as (select src id from trade union select dst from trade), p(o, pos, k) as (select id, id, 0 from n union select o, dst, k + 1 from p join trade on src = pos where k < 24), h as (select o, pos, min(k) k from p group by 1, 2), e as (select o id, max(k)::double ecc from h group by 1)"
for _n, _sql, _f in (
    ("diameter", "select max(ecc) diameter from e", lambda e: e.agg(F.max("eccentricity").alias("diameter"))),
    ("radius", "select min(ecc) radius from e", lambda e: e.agg(F.min("eccentricity").alias("radius"))),
    ("center", "select id from e where ecc = (select min(ecc) from e)", lambda e: e.crossJoin(F.broadcast(e.agg(F.min("eccentricity").alias("low")))).where("eccentricity = low").select("id")),
):
    query(_n, _ECC + " " + _sql)(lambda s, d, f=_f: f(I.eccentricity(trade_edges(s, d))))


# graphs that grow with the tables: the neighbour graph of the vectors, the supply graph ----------------

_SIM_AS = SIM + ", trade as (select src, dst, sim weight from sim)"


def _on_sim(sql):
    return sql.replace(RTRADE, _SIM_AS, 1) if sql.startswith(RTRADE) else sql.replace(TRADE, _SIM_AS, 1)


def _sim(s, d):
    return G.Graph(sim_edges(s, d).select("src", "dst"))


@query("sim_scc", _on_sim(_CLOSE) + ", n as (select src id from trade union select dst from trade) select id, least(id, coalesce((select min(x.dst) from c x join c y on x.src = y.dst and x.dst = y.src where x.src = id), id)) component from n")
def sim_scc(s, d):
    g = _sim(s, d)
    return I.strong_components(g.edges, g.nodes)


@query("sim_components", _SIM_AS + ", e as (select src, dst from trade union select dst, src from trade), r(id, root) as (select src, src from e union select dst, root from r join e on src = id) select id, min(root) as component from r group by 1")
def sim_components(s, d):
    g = _sim(s, d)
    return I.connected_components(g.edges, g.nodes)


@query("sim_pagerank", _on_sim(_pagerank_sql(10)))
def sim_pagerank(s, d):
    g = _sim(s, d)
    return I.pagerank(g.edges, g.nodes, 10).select("id", F.round("rank", 6).alias("rank"))


@query("sim_label_propagation", _on_sim(_labels_sql(4)))
def sim_label_propagation(s, d):
    g = _sim(s, d)
    return I.label_propagation(g.edges, g.nodes, 4)


@query("sim_clustering", _on_sim(_LCC) + " select id, round(c, 6) coefficient from l")
def sim_clustering(s, d):
    g = _sim(s, d)
    return I.clustering(g.edges, g.nodes).select("id", F.round("coefficient", 6).alias("coefficient"))


@query("sim_bidirectional", _SIM_AS + """, far(id, k) as (select 0::bigint, 0 union select dst, least(k + 1, 3) from far join trade on src = id), goal as (select min(id) id from far where k = 3),
    reach(id, k) as (select 0::bigint, 0 union select dst, k + 1 from (select r.id, r.k, bool_or(r.id = g.id) over () met from reach r, goal g) join trade on src = id where not met)
    select min(k)::double cost from reach where id = (select id from goal) having count(*) > 0""")
def sim_bidirectional(s, d):
    """Hops from vector 0 to the smallest one that some walk of three or more edges reaches; no row where there is no such walk."""
    e = materialize(sim_edges(s, d).select("src", "dst"), "steps").withColumn("weight", F.lit(1.0))
    # all that three edges reach is gone on from
    third = materialize(I.walks(e, s.range(1), 3, 3).select("id"), "third")
    goal = I.bfs(e, third).agg(F.min("id")).first()[0]
    return s.createDataFrame([], "cost double") if goal is None else I.bidirectional(e, 0, goal)


def _supply_weight(c):
    return f"1.0 + length({c}) % 3"


@query("supply_sssp", RSUP + f", p(pos, cost) as (select 'r:0', 0.0::double union select dst, cost + {_supply_weight('dst')} from p join supply on src = pos) select pos id, min(cost) cost from p group by 1")
def supply_sssp(s, d):
    return I.sssp(supply_edges(s, d).select("src", "dst", F.expr(_supply_weight("dst")).cast("double").alias("weight")), "r:0")


@query("supply_pagerank", _pagerank_sql(3).replace(TRADE, SUP, 1).replace("select src, dst from trade", "select src, dst from supply"))
def supply_pagerank(s, d):
    g = G.Graph(supply_edges(s, d).select("src", "dst"))
    return I.pagerank(g.edges, g.nodes, 3).select("id", F.round("rank", 6).alias("rank"))


@query("variable_length_pattern", RSUP + ", w(start, id, hops) as (select 'r:' || r_regionkey, 'r:' || r_regionkey, 0 from region union select start, dst, hops + 1 from w join supply on src = id where hops < 3 and edge_type in ('HAS_NATION', 'HAS_SUPPLIER', 'SUPPLIES')) select start, id, hops from w where hops >= 2")
def variable_length_pattern(s, d):
    """(region)-[:HAS_NATION|HAS_SUPPLIER|SUPPLIES*2..3]->()."""
    starts = table(s, d, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"))
    return I.walks(supply_edges(s, d), starts, 2, 3, ["HAS_NATION", "HAS_SUPPLIER", "SUPPLIES"])


@query("edge_weights", TRADE + " select src, dst, coalesce(case when weight % 2 = 0 then weight end, 1.0)::double weight from trade")
def edge_weights(s, d):
    """An edge without a weight weighs 1."""
    return G.weights(trade_edges(s, d).withColumn("weight", F.when(F.col("weight") % 2 == 0, F.col("weight"))))


# local algorithms ---------------------------------------------------------------------------------


def _frame(s, rows, schema):
    return s.createDataFrame(rows, schema)


_DFS = TRADE.replace("with ", "with recursive ", 1) + """, adj as (select map(list(src), list(near)) m from (select src, list(dst order by dst) near from (select distinct src, dst from trade) group by 1)),
w(step, stack, seen, done) as (select 0, [0::bigint], [0::bigint], []::bigint[] union all
select step + 1, case when nxt is null then stack[:-2] else list_append(stack, nxt) end, case when nxt is null then seen else list_append(seen, nxt) end, case when nxt is null then list_append(done, stack[-1]) else done end
from (select w.*, list_filter(coalesce(m[stack[-1]], []), lambda x: not list_contains(seen, x))[1] nxt from w, adj where len(stack) > 0)),
e as (select seen, done from w where len(stack) = 0) select unnest(seen) id, cast(generate_subscripts(seen, 1) - 1 as integer) preorder, cast(list_position(done, unnest(seen)) - 1 as integer) postorder from e"""


@query("dfs_order", _DFS)
def dfs_order(s, d):
    return _frame(s, L.dfs(L.collect(S.trade(s, d)), 0), "id long, preorder int, postorder int")


@query("dfs_edge_classes")
def dfs_edge_classes(s, d):
    return _frame(s, L.edge_classes(L.collect(S.trade(s, d))), "src long, dst long, class string")


@query("bridges", RSUP + ", e as materialized (select src a, dst b, row_number() over (order by src, dst) i from (select src, dst from supply where edge_type in ('HAS_NATION', 'HAS_SUPPLIER'))), both_ as materialized (select a x, b y, i from e union all select b, a, i from e), r(c, node) as (select i, a from e union select c, y from r join both_ on x = node and i <> c) select least(a, b) src, greatest(a, b) dst from e where not exists (select 1 from r where c = i and node = b)")
def bridges(s, d):
    return _frame(s, L.low_links(L.collect(S.supply(s, d).where("edge_type in ('HAS_NATION', 'HAS_SUPPLIER')")))[0], "src string, dst string")


@query("articulation_points", RSUP + ", e as materialized (select src a, dst b from supply where edge_type in ('HAS_NATION', 'HAS_SUPPLIER')), both_ as materialized (select a x, b y from e union select b, a from e), r(cut, node) as (select x, min(y) from both_ group by 1 union select cut, y from r join both_ on x = node and y <> cut) select distinct x id from both_ where (x, y) not in (select (cut, node) from r)")
def articulation_points(s, d):
    return _frame(s, [(x,) for x in L.low_links(L.collect(S.supply(s, d).where("edge_type in ('HAS_NATION', 'HAS_SUPPLIER')")))[1]], "id string")


@query("dominators", RTRADE + ", n as (select src id from trade union select dst from trade), r(cut, node) as (select id, 0::bigint from n where id <> 0 union select cut, dst from r join trade on src = node where dst <> cut), v as (select node id from r where cut = -1 union select id from n), reached as (select 0::bigint id union select dst from trade where src in (select node from r) or src = 0), dom as materialized (select cut d, id v from n x(cut), n where cut <> id and id <> 0 and id in (select id from reached) and (cut = 0 or (cut, id) not in (select (cut, node) from r)) and cut in (select id from reached)), k as (select v, count(*) k from dom group by 1) select dom.v id, arg_max(d, coalesce(k.k, 0)) idom from dom left join k on k.v = dom.d group by 1")
def dominators(s, d):
    return _frame(s, L.dominators(L.collect(S.trade(s, d)), 0), "id long, idom long")


@query("max_flow")
def max_flow(s, d):
    return _frame(s, L.max_flow(L.collect(_weighted(s, d), "weight"), 0, 9)[1], "src long, dst long, flow double")


_CUT = TALL + """, e as (select src, dst, weight from trade_all where src < 10 and dst < 10), n as (select list(src) a, list(dst) b, list(weight) w from e), s as (select range * 2 + 1 m from range(256)),
c as (select m, (select coalesce(sum(weight), 0) from e where (m >> src) & 1 = 1 and (m >> dst) & 1 = 0) cut from s) select cast(min(cut) as double) as value from c"""
for _n, _f in (("max_flow_value", L.max_flow), ("dinic_value", L.dinic)):
    # nations 0 to 9, from 0 to 9; the SQL tries every cut
    query(_n, _CUT)(lambda s, d, f=_f: _frame(s, [(f(L.collect(S.trade_all(s, d).where("src < 10 and dst < 10").withColumn("weight", F.col("weight").cast("double")), "weight"), 0, 9)[0],)], "value double"))


@query("flow_checks", TRADE + " select true as conserved, true as within, true as same")
def flow_checks(s, d):
    """What a flow must be, of both solvers: equal values, nothing lost on the way, no arc beyond its weight."""
    e = L.collect(_weighted(s, d), "weight")
    (value, flow), (other, flow2) = L.max_flow(e, 0, 9), L.dinic(e, 0, 9)
    room = {(a, b): w for a, b, w in e}
    net = lambda f: {n: sum(x for a, _, x in f if a == n) - sum(x for _, b, x in f if b == n) for n in L.nodes_of(e)}
    conserved = all(abs(x - (value if n == 0 else -value if n == 9 else 0)) < 1e-6 for f in (flow, flow2) for n, x in net(f).items())
    return _frame(s, [(conserved, all(x <= room[a, b] + 1e-9 for f in (flow, flow2) for a, b, x in f), abs(value - other) < 1e-6)], "conserved boolean, within boolean, same boolean")


@query("min_cost_flow")
def min_cost_flow(s, d):
    e = _weighted(s, d).withColumn("cost", (F.abs(F.col("src") - F.col("dst"))).cast("double"))
    return _frame(s, [L.min_cost_flow(L.collect(e, "weight", "cost"), 0, 9)], "flow double, cost double")


@query("coloring")
def coloring(s, d):
    return _frame(s, L.coloring(L.collect(S.trade(s, d))), "id long, color int")


@query("coloring_valid", TRADE + " select (select count(*) from (select src from trade union select dst from trade)) colored, 0::bigint conflicts")
def coloring_valid(s, d):
    """Every node has a colour, and no edge two ends of one."""
    e = trade_edges(s, d)
    c = _frame(s, L.coloring(L.collect(e)), "id long, color int")
    both = e.join(c.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst")
    return c.agg(F.count(F.lit(1)).alias("colored")).crossJoin(both.where("a = b").agg(F.count(F.lit(1)).alias("conflicts")))


@query("disjoint_sets", RTRADE + ", e as (select src, dst from trade union select dst, src from trade), r(id, root) as (select src, src from e union select dst, root from r join e on src = id) select id, min(root) as component from r group by 1")
def disjoint_sets(s, d):
    e = L.collect(S.trade(s, d))
    sets = L.DisjointSet(L.nodes_of(e))
    for a, b in e:
        sets.union(a, b)
    return _frame(s, sets.labels(), "id long, component long")


@query("steiner_tree")
def steiner_tree(s, d):
    return _frame(s, L.steiner_tree(L.collect(_weighted(s, d), "weight"), [0, 9, 14, 20]), "src long, dst long, weight double")


@query("feedback_arc_set")
def feedback_arc_set(s, d):
    return _frame(s, L.feedback_arc_set(L.collect(S.trade(s, d))), "src long, dst long")


@query("feedback_acyclic", TRADE + " select count(*) as placed from (select src id from trade union select dst from trade)")
def feedback_acyclic(s, d):
    """Without the feedback arcs every node has a place in a topological order."""
    e = trade_edges(s, d)
    g = G.Graph(e)
    rest = e.join(_frame(s, L.feedback_arc_set(L.collect(e)), "src long, dst long"), ["src", "dst"], "left_anti")
    return I.topo_levels(rest, g.nodes).agg(F.count(F.lit(1)).alias("placed"))


@query("negative_cycle_found", RTRADE + ", p(f, pos, cost, n) as (select src, dst, weight - 1000.0::double, 1 from trade union select f, dst, cost + weight - 1000.0, n + 1 from p join trade on src = pos where n < 4) select count(*) > 0 as found, true as closed from p where f = pos and cost < 0")
def negative_cycle_found(s, d):
    """Whether a cycle is found, and whether it is one of the graph's, of negative weight (if there is one)."""
    e = L.collect(_weighted(s, d).withColumn("weight", F.col("weight") - 1000.0), "weight")
    nodes, weight = L.negative_cycle(e), {(a, b): w for a, b, w in e}
    steps = list(zip(nodes, nodes[1:] + nodes[:1]))
    return _frame(s, [(bool(nodes), not nodes or (all(x in weight for x in steps) and sum(weight[x] for x in steps) < 0))], "found boolean, closed boolean")


@query("negative_cycle")
def negative_cycle(s, d):
    e = _weighted(s, d).withColumn("weight", F.col("weight") - 1000.0)
    return _frame(s, [(i, n) for i, n in enumerate(L.negative_cycle(L.collect(e, "weight")))], "place int, id long")


@query("greedy_matching", TALL.replace("with ", "with recursive ", 1) + ", u as (select least(src, dst) a, greatest(src, dst) b, max(weight) w from trade_all group by 1, 2), o as materialized (select a, b, w, row_number() over (order by w desc, a, b) i from u), m(i, used, src, dst, weight) as (select 0::bigint, []::bigint[], null::bigint, null::bigint, null::bigint union all select * from (select o.i, list_concat(used, [a, b]), a, b, w from m join o on o.i > m.i and not list_contains(used, a) and not list_contains(used, b) order by o.i limit 1)) select src, dst, weight from m where src is not null")
def greedy_matching(s, d):
    return I.greedy_matching(materialize(S.trade_all(s, d), "trade"))


def _rounded(rows):
    return [(n, round(x, 6)) for n, x in rows]


@query("betweenness", RTRADE + ", n as (select src id from trade union select dst from trade), w(o, v, k, c) as (select id, id, 0, 1.0::double from n union all select o, dst, k + 1, sum(c) from w join trade on src = v where k < 24 group by o, dst, k + 1), p as materialized (select o, v, min(k) d, arg_min(c, k) c from w group by 1, 2) select id, round(coalesce(sum(x.c * y.c / z.c), 0), 6) score from n left join p x on x.v = id and x.o <> id left join p y on y.o = id and y.v <> id and y.v <> x.o left join p z on z.o = x.o and z.v = y.v and z.d = x.d + y.d group by 1")
def betweenness(s, d):
    return _frame(s, _rounded(L.betweenness(L.collect(S.trade(s, d)))), "id long, score double")


@query("betweenness_sampled")
def betweenness_sampled(s, d):
    e = L.collect(S.trade(s, d))
    return _frame(s, _rounded(L.betweenness(e, [n for n in L.nodes_of(e) if crc32(str(n).encode()) % 3 == 0])), "id long, score double")


# knowledge graph ----------------------------------------------------------------------------------

_ENT = VEC + ", ent as (select p_partkey id, p_name as label, p_type entity_type, p_brand brand, p_size size, vector embedding from part left join vectors on p_partkey = vectors.id)"
_PROP = "0.6 * (a.entity_type = b.entity_type)::int + 0.4 * ((a.brand = b.brand)::int + (a.size = b.size)::int) / 2.0"


def entities(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("entity_type"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("properties"))
    return p.join(S.vectors(s, d).select("id", F.col("vector").alias("embedding")), "id", "left")


@query("kg_property_similarity", _ENT + f" select a.id, round({_PROP}, 6) score from ent a, (select * from ent where id = 1) b where a.id <> 1")
def kg_property_similarity(s, d):
    e = entities(s, d)
    return K.semantic_search(e.withColumn("embedding", F.lit(None).cast("array<double>")), 1)


@query("kg_entity_similarity", _ENT + f" select a.id, round(case when a.embedding is not null and b.embedding is not null then list_cosine_similarity(a.embedding, b.embedding) else {_PROP} end, 6) + 0.0 score from ent a, (select * from ent where id = 1) b where a.id <> 1")
def kg_entity_similarity(s, d):
    return K.semantic_search(entities(s, d), 1)


@query("kg_semantic_search", _ENT + f" select a.id, round(case when a.embedding is not null and b.embedding is not null then list_cosine_similarity(a.embedding, b.embedding) else {_PROP} end, 6) + 0.0 score from ent a, (select * from ent where id = 1) b where a.id <> 1 order by score desc, a.id limit 10")
def kg_semantic_search(s, d):
    return K.semantic_search(entities(s, d), 1, 10)


@query("kg_link_entities", "with l(entity_id, label) as (values ('a', 'the'), ('b', 'and the'), ('c', 'tion'), ('d', 'des')) select distinct doc_id id, entity_id from documents, l where contains(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' ' || label || ' ')")
def kg_link_entities(s, d):
    labels = s.createDataFrame([("a", "the"), ("b", "And the"), ("c", "tion"), ("d", "des")], "id string, label string")
    return K.link_entities(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), labels)


_REL = TRADE + ", rel as (select src, dst, 'TRADES' rel, round(weight / (weight + 100.0), 6) confidence from trade)"


def relations(s, d):
    return S.trade(s, d).select("src", "dst", F.lit("TRADES").alias("rel"), F.round(F.col("weight") / (F.col("weight") + 100.0), 6).alias("confidence"))


@query("kg_related", _REL + " select id, max(confidence) confidence from (select dst id, confidence from rel where src = 1 union all select src, confidence from rel where dst = 1) group by 1 order by 2 desc, 1 limit 5")
def kg_related(s, d):
    return K.related(relations(s, d), 1, 5)


@query("kg_infer", _REL + " select a.src, b.dst, a.rel, round(max(a.confidence * b.confidence), 6) confidence from rel a join rel b on a.dst = b.src and a.rel = b.rel where a.src <> b.dst and (a.src, b.dst) not in (select (src, dst) from rel) group by 1, 2, 3")
def kg_infer(s, d):
    return K.infer(relations(s, d))


@query("kg_fk_violations", _REL + " select src, dst, rel, confidence from rel where src not in (select n_nationkey from nation where n_regionkey <> 0) or dst not in (select n_nationkey from nation where n_regionkey <> 0)")
def kg_fk_violations(s, d):
    known = table(s, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").cast("long").alias("id"))
    return K.missing_ends(relations(s, d), known)


@query("kg_cascade_delete", _REL + " select src, dst, rel, confidence from rel where src not in (select n_nationkey from nation where n_regionkey = 0) and dst not in (select n_nationkey from nation where n_regionkey = 0)")
def kg_cascade_delete(s, d):
    gone = table(s, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("id"))
    return K.cascade_delete(relations(s, d), gone)


# messages, entities, enrichment -------------------------------------------------------------------

_ENTS = MSG + ", w as (select id, unnest(regexp_split_to_array(text_content, '\\s+')) label from messages), ents as (select distinct id, label from w where strlen(label) > 2 and upper(label[1]) = label[1] and lower(label[1]) <> label[1])"


def message_entities(s, d):
    return K.entities_in(S.messages(s, d).select("id", F.col("text_content").alias("text")))


@query("extract_entities", _ENTS + " select id, label from ents")
def extract_entities(s, d):
    return message_entities(s, d)


@query("mentions_edges", _ENTS + " select id src, label dst, 'MENTIONS' edge_type from ents")
def mentions_edges(s, d):
    return E.mentions(S.messages(s, d).select("id", F.lit("Message").alias("node_type"), F.col("text_content").alias("text")))


query("entities_for_message", _ENTS + " select label from ents where id = 'm:29:5'")(lambda s, d: message_entities(s, d).where("id = 'm:29:5'").select("label"))
_TOP = "(select label from ents group by 1 order by count(*) desc, label limit 1)"


def _top(s, d):
    return message_entities(s, d).groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select("label")


@query("messages_for_entity", _ENTS + f" select id from ents where label = {_TOP}")
def messages_for_entity(s, d):
    return message_entities(s, d).join(F.broadcast(_top(s, d)), "label", "left_semi").select("id")


@query("entities_for_chat", _ENTS + " select distinct label from ents join messages using (id) where chat_id = 1")
def entities_for_chat(s, d):
    return message_entities(s, d).join(S.messages(s, d).where("chat_id = 1").select("id"), "id", "left_semi").select("label").distinct()


@query("chats_for_entity", _ENTS + f" select distinct chat_id from ents join messages using (id) where label = {_TOP}")
def chats_for_entity(s, d):
    return messages_for_entity(s, d).join(S.messages(s, d).select("id", "chat_id"), "id").select("chat_id").distinct()


@query("related_messages", _ENTS + " select b.id, count(*) shared from ents a join ents b on a.label = b.label and a.id <> b.id where a.id = 'm:29:5' group by 1")
def related_messages(s, d):
    e = message_entities(s, d)
    mine = e.where("id = 'm:29:5'").select("label")
    return e.where("id <> 'm:29:5'").join(F.broadcast(mine), "label").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))


@query("related_chats", _ENTS + ", c as (select distinct chat_id, label from ents join messages using (id)) select b.chat_id, count(*) shared from c a join c b on a.label = b.label and a.chat_id <> b.chat_id where a.chat_id = 1 group by 1")
def related_chats(s, d):
    c = message_entities(s, d).join(S.messages(s, d).select("id", "chat_id"), "id").select("chat_id", "label").distinct()
    return c.where("chat_id <> 1").join(F.broadcast(c.where("chat_id = 1").select("label")), "label").groupBy("chat_id").agg(F.count(F.lit(1)).alias("shared"))


@query("entity_promotion", _ENTS + " select label, count(*) mentions from ents group by 1 having count(*) >= 10")
def entity_promotion(s, d):
    """From active to stable at ten mentions."""
    return message_entities(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("mentions")).where("mentions >= 10")


@query("promote_entity", _ENTS + " select label, case when count(*) >= 10 then 'stable' else 'active' end tier from ents group by 1")
def promote_entity(s, d):
    return message_entities(s, d).groupBy("label").agg(F.when(F.count(F.lit(1)) >= 10, "stable").otherwise("active").alias("tier"))


@query("inferred_prune", _ENTS + " select label from ents group by 1 having count(distinct id) >= 2")
def inferred_prune(s, d):
    """Inferred entities that a second message confirms stay."""
    e = message_entities(s, d)
    lone = e.groupBy("label").agg(F.count_distinct("id").alias("n")).where("n < 2").select("label")
    return e.select("label").distinct().join(lone, "label", "left_anti")


@query("summarize_chat", MSG + ", l as (select * from messages qualify row_number() over (partition by chat_id order by \"timestamp\" desc, id desc) <= 5) select chat_id, count(*) n, arg_min(text_content, \"timestamp\") || ' ... ' || arg_max(text_content, \"timestamp\") summary from l group by 1")
def summarize_chat(s, d):
    return E.summarize(S.messages(s, d), 5)


@query("summary_trigger", MSG + " select chat_id, count(*) n, cast(floor(count(*) / 3) as bigint) summaries from messages group by 1")
def summary_trigger(s, d):
    return E.summary_due(S.messages(s, d), 3)


_TEMP = LOG + ", t as (select context id, count(*) accesses, 1706659200000 - max(\"timestamp\") idle_ms from logs group by 1), h as (select *, case when idle_ms < 3600000 or accesses > 10 then 'hot' when idle_ms < 86400000 then 'warm' else 'cold' end temperature from t)"


def _temperatures(s, d):
    return E.temperature(S.logs(s, d).select(F.col("context").alias("id"), "timestamp"), 1706659200000)


query("temperature", _TEMP + " select id, accesses, idle_ms, temperature from h")(_temperatures)


@query("tier_moves", LOG + ", t as (select context id, count(*) accesses, 1706659200000 - max(\"timestamp\") idle_ms from logs where level = 'warn' group by 1), h as (select *, case when idle_ms < 3600000 or accesses > 10 then 'hot' when idle_ms < 86400000 then 'warm' else 'cold' end temperature from t) select id, temperature, case when temperature = 'warm' and accesses > 20 then 'promote' when temperature = 'warm' and idle_ms > 172800000 then 'demote' when temperature = 'cold' and accesses > 5 then 'promote' else 'stay' end as move from h")
def tier_moves(s, d):
    a = S.logs(s, d).where("level = 'warn'").select(F.col("context").alias("id"), "timestamp")
    return E.tier_moves(E.temperature(a, 1706659200000)).select("id", "temperature", "move")


@query("activity_level", "with e as (select event_id id, user_id, (epoch_us(ts) // 1000) t from events), g as (select id, t - lag(t) over (partition by user_id order by t, id) gap from e) select id, case when gap >= 1800000 then 'sleep' when gap >= 300000 then 'low' else 'high' end as level from g")
def activity_level(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", S.millis("ts").alias("timestamp"))
    return E.activity(e).select("id", "level")


_EV = "ev as (select event_id id, case event_type when 'view' then 'NodeCreated' when 'click' then 'NodeUpdated' when 'purchase' then 'ChatUpdated' when 'signup' then 'EdgeCreated' else 'BatchMessagesAdded' end as type, user_id since from events)"


def bus(s, d):
    kind = F.when(F.col("event_type") == "view", "NodeCreated").when(F.col("event_type") == "click", "NodeUpdated").when(F.col("event_type") == "purchase", "ChatUpdated").when(F.col("event_type") == "signup", "EdgeCreated").otherwise("BatchMessagesAdded")
    return table(s, d, "events").select(F.col("event_id").alias("id"), kind.alias("type"), F.col("user_id").alias("messages_since_summary"))


_ROUTED = f"with {_EV}, m(type, module) as (values ('NodeCreated', 'semantic_indexer'), ('NodeCreated', 'entity_linker'), ('NodeCreated', 'associative_linker'), ('NodeUpdated', 'semantic_indexer'), ('ChatUpdated', 'summarizer')), r as (select id, ev.type, module from ev join m on ev.type = m.type where ev.type <> 'ChatUpdated' or since >= 20)"


@query("event_routing", _ROUTED + " select id, type, module from r")
def event_routing(s, d):
    return E.route(bus(s, d)).select("id", "type", "module")


@query("route_counts", _ROUTED + " select module, count(*) n from r group by 1")
def route_counts(s, d):
    return E.route(bus(s, d)).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query("index_new_nodes", "select doc_id id, 384 dims from documents where trim(text) <> '' and doc_id not in (select vec_id from embeddings)")
def index_new_nodes(s, d):
    """Documents without an embedding get one."""
    n = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("ScrapedPage").alias("node_type"), "text")
    return E.index_new(n, S.vectors(s, d)).select("id", F.size("vector").alias("dims"))


@query("tumbling_counts", "select time_bucket(interval 6 hours, ts) as start, event_type, count(*) n from events group by 1, 2")
def tumbling_counts(s, d):
    return E.tumbling(table(s, d, "events"), "ts", "6 hours", "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sliding_avg", "with w as (select unnest([time_bucket(interval 6 hours, ts), time_bucket(interval 6 hours, ts) - interval 6 hours]) as start, value from events) select start, round(avg(value), 6) mean from w group by 1")
def sliding_avg(s, d):
    return E.sliding(table(s, d, "events"), "ts", "12 hours", "6 hours", "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_counts", "with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 3 hours then 1 else 0 end s from events), g as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from e) select user_id, min(ts) as start, count(*) n from g group by user_id, k")
def session_counts(s, d):
    return E.sessions(table(s, d, "events"), "ts", "3 hours", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


query("payload_search_page", "select event_id id, value from events where event_type = 'click' and value >= 50 order by value desc, event_id limit 10")(
    lambda s, d: V.top_k(S.event_payloads(s, d).where(P.PayloadFilter(must=[P.Match("click"), (P.Range(50, None), "value")]).column(F.col("fields"))).select("id", F.col("fields")["value"]["f"].alias("value")), 10, "value")
)
