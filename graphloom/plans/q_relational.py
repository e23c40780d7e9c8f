"""Queries on stores, predicates, aggregation, ordering, time scopes and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import knowledge as K
from graphloom.operators import ordering
from graphloom.operators import predicates as P
from graphloom.plans.registry import query
from graphloom.session import materialize, table
from graphloom.sources import views as S
from graphloom.sources.views import with_views

NOW = S.NOW_MS
MSG = with_views("messages")
LOG = with_views("logs")
DOCS = 'docs as (select doc_id id, \'ScrapedPage\' node_type, text, lang, source, n_chars from documents)'


def docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("ScrapedPage").alias("node_type"), "text", "lang", "source", "n_chars")


# stores -------------------------------------------------------------------------------------------


@query("point_lookup", "select doc_id id, lang, source, n_chars from documents where doc_id = 42")
def point_lookup(s, d):
    return docs(s, d).where("id = 42").select("id", "lang", "source", "n_chars")


@query("project_message_fields", MSG + ' select id, chat_id, sender, text_content, "timestamp" from messages')
def project_message_fields(s, d):
    return S.messages(s, d).select("id", "chat_id", "sender", "text_content", "timestamp")


@query("prefix_scan", MSG + " select id, sender from messages where starts_with(id, 'm:1')")
def prefix_scan(s, d):
    return S.messages(s, d).where(F.startswith("id", F.lit("m:1"))).select("id", "sender").orderBy("id")


@query("full_scan_count", "select count(*) n from documents")
def full_scan_count(s, d):
    return docs(s, d).agg(F.count(F.lit(1)).alias("n"))


@query("find_anywhere", "select * from (select 'documents' store, doc_id id from documents union all select 'embeddings', vec_id from embeddings union all select 'pages', page_id from pages) where id = 7")
def find_anywhere(s, d):
    parts = [table(s, d, t).select(F.lit(t).alias("store"), F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).where("id = 7")


@query("upsert_latest", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def upsert_latest(s, d):
    """The last write of each key wins."""
    return K.latest(table(s, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query("delete_antijoin", "select doc_id id, lang from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def delete_antijoin(s, d):
    gone = table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return docs(s, d).join(gone, "id", "left_anti").select("id", "lang")


@query("embedding_by_node", "select doc_id id, len(embedding) dims, label from documents join embeddings on doc_id = vec_id")
def embedding_by_node(s, d):
    v = S.vectors(s, d)
    return docs(s, d).select("id").join(v, "id").select("id", F.size("vector").alias("dims"), "label")


@query("session_messages", MSG + ' select id, sender, "timestamp" from messages where chat_id = 3')
def session_messages(s, d):
    return S.messages(s, d).where("chat_id = 3").select("id", "sender", "timestamp").orderBy("timestamp")


@query("knowledge_get", f"select p_partkey id, p_name as content, p_type as source, {NOW} as \"timestamp\" from part where p_size = 10")
def knowledge_get(s, d):
    return table(s, d, "part").where("p_size = 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), F.col("p_type").alias("source"), F.lit(NOW).alias("timestamp"))


@query("embeddings_limit", "select vec_id id, len(embedding) dims from embeddings order by vec_id limit 20")
def embeddings_limit(s, d):
    return S.vectors(s, d).orderBy("id").limit(20).select("id", F.size("vector").alias("dims"))


@query("tool_results_union", f"select * from (select 'web_search' tool, event_type as content, (epoch_us(ts) // 1000) as \"timestamp\" from events where event_type = 'view' union all select 'scrape_page', url, {NOW} - page_id * 60000 from pages) where \"timestamp\" >= {NOW} - 5184000000")
def tool_results_union(s, d):
    e = table(s, d, "events").where("event_type = 'view'").select(F.lit("web_search").alias("tool"), F.col("event_type").alias("content"), S.millis("ts").alias("timestamp"))
    p = table(s, d, "pages").select(F.lit("scrape_page").alias("tool"), F.col("url").alias("content"), (F.lit(NOW) - F.col("page_id") * 60000).alias("timestamp"))
    return e.unionByName(p).where(F.col("timestamp") >= NOW - 5184000000)


# structural predicates ----------------------------------------------------------------------------

_FILTERS = {
    "struct_equals": ([("lang", "Equals", "fr")], "lang = 'fr'"),
    "struct_ne": ([("lang", "NotEquals", "en")], "lang <> 'en'"),
    "struct_gt": ([("n_chars", "GreaterThan", 2000)], "n_chars > 2000"),
    "struct_lt": ([("n_chars", "LessThan", 500)], "n_chars < 500"),
    "struct_ge": ([("n_chars", "GreaterThanOrEqual", 2000)], "n_chars >= 2000"),
    "struct_le": ([("n_chars", "LessThanOrEqual", 500)], "n_chars <= 500"),
    "struct_and": ([("lang", "Equals", "en"), ("source", "Equals", "src3"), ("n_chars", "GreaterThan", 100)], "lang = 'en' and source = 'src3' and n_chars > 100"),
}
for _name, (_filters, _sql) in _FILTERS.items():
    query(_name, f"select doc_id id, lang, n_chars from documents where {_sql}")(lambda s, d, f=_filters: docs(s, d).where(P.structural_all(f)).select("id", "lang", "n_chars"))


@query("prop_count", "select count(*) n from documents where lang = 'de'")
def prop_count(s, d):
    return docs(s, d).where(P.structural("lang", "Equals", "de")).agg(F.count(F.lit(1)).alias("n"))


@query("count_by_node_type", MSG + " select 'Message' node_type, count(*) n from messages union all select 'ScrapedPage', count(*) from documents union all select 'Entity', count(*) from part")
def count_by_node_type(s, d):
    parts = [S.messages(s, d).select(F.lit("Message").alias("node_type")), docs(s, d).select("node_type"), table(s, d, "part").select(F.lit("Entity").alias("node_type"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("filter_tree", "select doc_id id from documents where (lang = 'en' or lang = 'de') and not (n_chars between 500 and 3000) and contains(lower(text), 'the')")
def filter_tree(s, d):
    return docs(s, d).where((F.col("lang").isin("en", "de")) & ~F.col("n_chars").between(500, 3000) & F.contains(F.lower("text"), F.lit("the"))).select("id")


# payloads -----------------------------------------------------------------------------------------

K_SQL = "cast(json_extract_string(props, '$.k') as bigint)"
_PAYLOADS = {
    "payload_must": (P.PayloadFilter().must_match("purchase").must_range(50, 100), "event_type = 'purchase' and (value between 50 and 100 or user_id between 50 and 100 or {k} between 50 and 100)"),
    "payload_should": (P.PayloadFilter().should_match("click").should_match("error"), "event_type in ('click', 'error')"),
    "payload_must_not": (P.PayloadFilter().must_not_match("view"), "event_type <> 'view'"),
    "payload_combo": (P.PayloadFilter(must=[(P.Range(10, 90), "value")], should=[P.Match("click"), P.Match("purchase")], must_not=[P.Match(7)]), "value between 10 and 90 and event_type in ('click', 'purchase') and not coalesce(user_id = 7, false) and not coalesce({k} = 7, false)"),
    "payload_match": (P.PayloadFilter(must=[P.Match(5)]), "(user_id = 5 or coalesce({k} = 5, false))"),
    "payload_range": (P.PayloadFilter(must=[(P.Range(20.5, 30.25), "value")]), "value between 20.5 and 30.25"),
    "payload_filter_ids": (P.PayloadFilter(must=[P.Match("error")], must_not=[(P.Range(None, 10), "value")]), "event_type = 'error' and not value <= 10"),
}
for _name, (_filter, _sql) in _PAYLOADS.items():
    query(_name, f"select event_id id from events where {_sql.format(k=K_SQL)}")(lambda s, d, f=_filter: S.event_payloads(s, d).where(f.column(F.col("fields"))).select("id"))

LAT, LON = "(p_partkey % 180) - 90", "((p_partkey * 7) % 360) - 180"


@query("geo_radius", f"""with g as (select p_partkey id, cast({LAT} as double) lat, cast({LON} as double) lon from part)
select id from g where 2 * 6371000.0 * atan2(sqrt(pow(sin((radians(10.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin((radians(20.0) - radians(lon)) / 2), 2)),
 sqrt(1 - (pow(sin((radians(10.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin((radians(20.0) - radians(lon)) / 2), 2)))) <= 1500000""")
def geo_radius(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("at"), P.geo(F.expr(LAT).cast("double"), F.expr(LON).cast("double"))).alias("fields"))
    return p.where(P.PayloadFilter(must=[P.GeoRadius(10.0, 20.0, 1_500_000)]).column(F.col("fields"))).select("id")


@query("geo_match", f"select p_partkey id from part where {LAT} = -79 and {LON} = -103")
def geo_match(s, d):
    """Exact equality of both coordinates."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("at"), P.geo(F.expr(LAT).cast("double"), F.expr(LON).cast("double"))).alias("fields"))
    return p.where(P.PayloadFilter(must=[P.Match((-79.0, -103.0))]).column(F.col("fields"))).select("id")


@query("payload_list_match", "select p_partkey id from part where p_brand = 'Brand#16' and p_size = 31")
def payload_list_match(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("tags"), P.listing(F.array(F.col("p_brand"), F.col("p_size").cast("string")))).alias("fields"))
    return p.where(P.PayloadFilter(must=[P.Match(["Brand#16", "31"])]).column(F.col("fields"))).select("id")


@query("payload_from_json", "select event_id id, case json_type(props, '$.k') when 'UBIGINT' then 'BIGINT' else json_type(props, '$.k') end as kind, cast(json_extract_string(props, '$.k') as bigint) k from events")
def payload_from_json(s, d):
    e = table(s, d, "events").withColumn("v", F.try_parse_json("props"))
    return e.select(F.col("event_id").alias("id"), F.schema_of_variant(F.variant_get("v", "$.k", "variant")).alias("kind"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


# join-shaped --------------------------------------------------------------------------------------


@query("candidate_intersect", "select doc_id id from documents where lang = 'en' and doc_id in (select doc_id from labels where quality = 1)")
def candidate_intersect(s, d):
    return docs(s, d).where("lang = 'en'").select("id").join(table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")


@query("hydrate_join", "select vec_id id, lang, n_chars from embeddings join documents on vec_id = doc_id where label = 3")
def hydrate_join(s, d):
    return S.vectors(s, d).where("label = 3").select("id").join(docs(s, d), "id").select("id", "lang", "n_chars")


@query("chat_last_50", MSG + " select chat_id, id, turn from messages qualify row_number() over (partition by chat_id order by turn desc) <= 3")
def chat_last_50(s, d):
    """The last messages of each chat in the order of its ids (here 3: the chats are short): a task keeps three of a chat before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("turn")))
    return S.messages(s, d).select("chat_id", "id", "turn", rank.alias("rank")).where("rank <= 3").drop("rank")


@query("entity_find_or_create", "select distinct p_name as label, p_type as entity_type from part where p_size > 25 and (p_name, p_type) not in (select p_name, p_type from part where p_size <= 25)")
def entity_find_or_create(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("label"), F.col("p_type").alias("entity_type"), "p_size")
    return K.find_or_create(p.where("p_size > 25"), p.where("p_size <= 25"))


# aggregation --------------------------------------------------------------------------------------

for _col in ("level", "source", "context"):
    query(f"log_stats_{_col}", LOG + f" select {_col}, count(*) n from logs group by 1")(lambda s, d, c=_col: S.logs(s, d).groupBy(c).agg(F.count(F.lit(1)).alias("n")))


@query("log_stats_range", LOG + ' select count(*) n, min("timestamp") oldest, max("timestamp") newest from logs')
def log_stats_range(s, d):
    return S.logs(s, d).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


AGE_TIER = f"case when {NOW} - \"timestamp\" < 30 * 86400000::bigint then 'active' when {NOW} - \"timestamp\" < 90 * 86400000::bigint then 'recent' else 'archive' end"


@query("tier_counts", LOG + f" select {AGE_TIER} tier, count(*) n from logs group by 1")
def tier_counts(s, d):
    return S.logs(s, d).groupBy(K.tier_of_age(F.lit(NOW) - F.col("timestamp")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("tier_assignment", LOG + f" select id, {AGE_TIER} tier from logs")
def tier_assignment(s, d):
    return S.logs(s, d).select("id", K.tier_of_age(F.lit(NOW) - F.col("timestamp")).alias("tier"))


@query("segment_assign", "select vec_id id, (row_number() over (order by vec_id) - 1) // 100 as segment from embeddings")
def segment_assign(s, d):
    """Ids in order, 100 to a segment."""
    return ordering.running(S.vectors(s, d).select("id"), ["id"], out="n").select("id", F.floor((F.col("n") - 1) / 100).alias("segment"))


@query("segment_stats", "with x as (select (row_number() over (order by vec_id) - 1) // 100 as segment from embeddings), n as (select segment, count(*) n from x group by 1) select cast(sum(n) as bigint) total, count(*) segments, count(*) filter (where n < 100) appendable from n")
def segment_stats(s, d):
    n = segment_assign(s, d).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("segments"), F.count_if(F.col("n") < 100).alias("appendable"))


PRIORITY = "case event_type when 'error' then 'Urgent' when 'purchase' then 'Normal' when 'signup' then 'Low' else 'Batch' end"
PRIORITY_RANK = "case event_type when 'error' then 0 when 'purchase' then 1 when 'signup' then 2 else 3 end"


def tasks(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.expr(PRIORITY).alias("priority"), F.expr(PRIORITY_RANK).alias("p"), F.col("event_id").alias("seq"))


@query("queue_stats", f"select count(*) filter (where {PRIORITY} = 'Urgent') \"Urgent\", count(*) filter (where {PRIORITY} = 'Normal') \"Normal\", count(*) filter (where {PRIORITY} = 'Low') \"Low\", count(*) filter (where {PRIORITY} = 'Batch') \"Batch\" from events")
def queue_stats(s, d):
    names = ["Urgent", "Normal", "Low", "Batch"]
    return tasks(s, d).groupBy().pivot("priority", names).agg(F.count(F.lit(1))).select(*[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


@query("task_order", f"select event_id id, cast(row_number() over (order by {PRIORITY_RANK}, event_id) as integer) place from events order by place limit 200")
def task_order(s, d):
    """The first 200 pops: by priority, first in first out within one."""
    first = tasks(s, d).orderBy("p", "seq").limit(200)
    return first.select("id", F.row_number().over(Window.orderBy("p", "seq")).alias("place"))


@query("task_dispatch", f"select * from (select 'High' as level, event_id id from events where {PRIORITY_RANK} = 0 order by event_id limit 1) union all select * from (select 'Low', event_id from events order by {PRIORITY_RANK}, event_id limit 5) union all select * from (select 'Sleep', event_id from events order by {PRIORITY_RANK}, event_id limit 100)")
def task_dispatch(s, d):
    t = tasks(s, d)
    pick = lambda level, df, n: df.orderBy("p", "seq").limit(n).select(F.lit(level).alias("level"), "id")
    return pick("High", t.where("p = 0"), 1).unionAll(pick("Low", t, 5)).unionAll(pick("Sleep", t, 100))


@query("hit_ratio", "select user_id, round(count(*) filter (where event_type in ('view', 'click')) / count(*), 6) ratio from events group by 1")
def hit_ratio(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.count_if(F.col("event_type").isin("view", "click")) / F.count(F.lit(1)), 6).alias("ratio"))


@query("access_rate", "select user_id, time_bucket(interval 1 day, ts) as day, count(*) n, round(case when max(ts) > min(ts) then count(*) * 1000.0 / ((epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000)) else 0 end, 6) rate, count(*) > 10 and count(*) * 1000.0 > 100 * ((epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000)) bursty from events group by 1, 2")
def access_rate(s, d):
    e = table(s, d, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), (S.millis(F.max("ts")) - S.millis(F.min("ts"))).alias("span"))
    return e.select("user_id", "day", "n", F.round(F.when(F.col("span") > 0, F.col("n") * 1000.0 / F.col("span")).otherwise(F.lit(0.0)), 6).alias("rate"), ((F.col("n") > 10) & (F.col("n") * 1000.0 > 100 * F.col("span"))).alias("bursty"))


@query("layer_latency_ewma", """with e as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) i, count(*) over (partition by event_type) n from events)
select event_type, round(sum(0.1 * value * pow(cast(0.9 as double), n - i)), 6) ewma from e group by 1""")
def layer_latency_ewma(s, d):
    """avg = 0.9 * avg + 0.1 * x from 0 on, in closed form: each value weighs 0.1 * 0.9^(later ones). Places are counted over key ranges, so
    no type is gathered."""
    e = table(s, d, "events").select("event_type", "ts", "event_id", "value")
    e = ordering.running(e, ["event_type", "ts", "event_id"], out="i")
    # a row for each type
    n = e.groupBy("event_type").agg(F.max("i").alias("n"))
    return e.join(n, "event_type").groupBy("event_type").agg(F.round(F.sum(0.1 * F.col("value") * F.pow(F.lit(0.9), F.col("n") - F.col("i"))), 6).alias("ewma"))


@query("failure_streaks", """with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type = 'error' order by ts, event_id) g from events)
select user_id, max(n) longest from (select user_id, g, count(*) n from e where event_type = 'error' group by 1, 2) group by 1""")
def failure_streaks(s, d):
    """Longest run of errors of each user: gaps and islands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fails = F.col("event_type") == "error"
    e = table(s, d, "events").withColumn("g", F.count_if(~fails).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.where(fails).groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("result_group_by", "select lang, source, count(*) n, cast(sum(n_chars) as bigint) chars, min(n_chars) least, max(n_chars) most, round(avg(n_chars), 6) mean from documents group by 1, 2")
def result_group_by(s, d):
    return docs(s, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))


# order and pages ----------------------------------------------------------------------------------


@query("paginate", "select doc_id id, lang from documents where lang = 'en' order by doc_id limit 10 offset 20")
def paginate(s, d):
    return docs(s, d).where("lang = 'en'").select("id", "lang").orderBy("id").offset(20).limit(10)


@query("ranked_page", "select event_id id, value from events order by value desc, event_id limit 10 offset 5")
def ranked_page(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), "value").orderBy(F.desc("value"), "id").offset(5).limit(10)


@query("search_page", "with f as (select page_id, url from pages where contains(lower(url), 'blog') and contains(url, '/en/')) select page_id, url, cast(ceil((select count(*) from f) / 10.0) as bigint) pages from f order by page_id limit 10 offset 10")
def search_page(s, d):
    f = table(s, d, "pages").select("page_id", "url").where(F.contains(F.lower("url"), F.lit("blog")) & F.contains(F.col("url"), F.lit("/en/")))
    n = f.agg(F.ceil(F.count(F.lit(1)) / 10).alias("pages"))
    return f.orderBy("page_id").offset(10).limit(10).crossJoin(F.broadcast(n))


@query("status_pivot", "select count(*) total, count(*) filter (where o_orderstatus = 'O') \"O\", count(*) filter (where o_orderstatus = 'F') \"F\", count(*) filter (where o_orderstatus = 'P') \"P\" from orders")
def status_pivot(s, d):
    o = table(s, d, "orders")
    return o.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("o_orderstatus") == x).alias(x) for x in "OFP"])


@query("usage_analytics", """with h as (select date_trunc('hour', ts) h, count(*) n, sum(value) tokens, avg(value) latency, count(*) filter (where event_type = 'error') / count(*) err from events group by 1)
select cast(sum(n) as bigint) requests, round(sum(tokens), 4) tokens, round(avg(latency), 6) mean_latency, round(avg(err), 6) mean_error, max(n) peak, round(sum(n) / count(*), 6) per_hour from h""")
def usage_analytics(s, d):
    h = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("tokens"), F.avg("value").alias("latency"), (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("err"))
    return h.agg(F.sum("n").alias("requests"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.round(F.avg("err"), 6).alias("mean_error"), F.max("n").alias("peak"), F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("per_hour"))


# logs and time scopes -----------------------------------------------------------------------------

_LOGS = {
    "log_filter_level": (dict(level="ERROR"), "level = 'error'"),
    "log_filter_context": (dict(context="user_1"), "contains(context, 'user_1')"),
    "log_filter_source": (dict(source="grpc"), "source = 'GrpcServer'"),
    "log_filter_since": (dict(since="2024-01-20T00:00:00Z"), "\"timestamp\" >= 1705708800000"),
}
for _name, (_args, _sql) in _LOGS.items():
    query(_name, LOG + f" select id, level, context, source from logs where {_sql}")(lambda s, d, a=_args: S.logs(s, d).where(P.log_filter(**a)).select("id", "level", "context", "source"))


@query("log_query_latest", LOG + " select id, \"timestamp\", level from logs where level in ('error', 'warn') order by \"timestamp\" desc, id limit 100")
def log_query_latest(s, d):
    return S.logs(s, d).where(F.col("level").isin("error", "warn")).select("id", "timestamp", "level").orderBy(F.desc("timestamp"), "id").limit(100)


#: Scopes are read from the end of January, where the events end.
SCOPE_NOW = 1706659200000
_D = 86400000
for _scope, (_lo, _hi, _now) in {"today": (1, 0, SCOPE_NOW), "week": (7, 0, SCOPE_NOW), "month": (30, 0, SCOPE_NOW), "quarter": (90, 0, SCOPE_NOW), "year": (365, 0, SCOPE_NOW), "last_year": (730, 365, SCOPE_NOW + 375 * _D)}.items():
    query(f"time_scope_{_scope}", LOG + f' select id, "timestamp" from logs where "timestamp" between {_now - _lo * _D} and {_now - _hi * _D}')(lambda s, d, c=_scope, now=_now: S.logs(s, d).where(P.time_scope(F.col("timestamp"), c, now)).select("id", "timestamp"))
query("time_scope_custom", LOG + ' select id, "timestamp" from logs where "timestamp" between 1704412800000 and 1704585600000')(lambda s, d: S.logs(s, d).where(P.time_scope(F.col("timestamp"), "custom", SCOPE_NOW, (1704412800000, 1704585600000))).select("id", "timestamp"))


@query("messages_in_scope", MSG + f' select id, chat_id from messages where "timestamp" between {1704067200000 + 3 * _D - 7 * _D} and {1704067200000 + 3 * _D}')
def messages_in_scope(s, d):
    return S.messages(s, d).where(P.time_scope(F.col("timestamp"), "week", 1704067200000 + 3 * _D)).select("id", "chat_id")


@query("recent_messages", MSG + ' select chat_id, id, cast(row_number() over (partition by chat_id order by "timestamp" desc, id desc) as integer) as "rank" from messages qualify "rank" <= 2')
def recent_messages(s, d):
    return K.recent_messages(S.messages(s, d), 2).select("chat_id", "id", "rank")


@query("chat_history", MSG + ' select id, sender, text_content from messages where chat_id = 5 order by "timestamp" desc limit 4')
def chat_history(s, d):
    return S.messages(s, d).where("chat_id = 5").orderBy(F.desc("timestamp")).limit(4).select("id", "sender", "text_content")


@query("quarter_bucket", "select year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter, count(*) n from orders group by 1")
def quarter_bucket(s, d):
    return table(s, d, "orders").groupBy(K.quarter(S.millis("o_orderdate")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


COPIES = "copies as (select o_orderkey id, 'active' tier, o_totalprice v from orders where o_orderstatus = 'O' union all select o_orderkey, 'recent', o_totalprice + 1 from orders where o_orderpriority in ('1-URGENT', '2-HIGH') union all select o_orderkey, 'archive', o_totalprice + 2 from orders)"


def _copies(s, d):
    o = table(s, d, "orders")
    part = lambda df, t, k: df.select(F.col("o_orderkey").alias("id"), F.lit(t).alias("tier"), (F.col("o_totalprice") + k).alias("v"))
    return part(o.where("o_orderstatus = 'O'"), "active", 0).unionAll(part(o.where("o_orderpriority in ('1-URGENT', '2-HIGH')"), "recent", 1)).unionAll(part(o, "archive", 2))


@query("tier_precedence", f"with {COPIES} select id, tier, round(v, 6) v from copies qualify row_number() over (partition by id order by case tier when 'active' then 0 when 'recent' then 1 else 2 end) = 1")
def tier_precedence(s, d):
    return K.first_tier(_copies(s, d), ["active", "recent", "archive"]).select("id", "tier", F.round("v", 6).alias("v"))


@query("lookup_with_hint", f"with {COPIES} select id, tier, round(v, 6) v from copies where id in (4, 9, 31) qualify row_number() over (partition by id order by case tier when 'archive' then 0 when 'active' then 1 else 2 end) = 1")
def lookup_with_hint(s, d):
    """The hinted tier is looked at first; only the asked ids are read."""
    return K.first_tier(_copies(s, d).where(F.col("id").isin(4, 9, 31)), ["archive", "active", "recent"]).select("id", "tier", F.round("v", 6).alias("v"))


@query("summary_tier", "select doc_id id, case when strlen(text) < 1000 then 'daily' when strlen(text) < 5000 then 'weekly' else 'monthly' end tier from documents")
def summary_tier(s, d):
    return docs(s, d).select("id", K.summary_tier(F.col("text")).alias("tier"))


@query("summary_rollup", "select date_trunc('month', ts)::date as month, date_trunc('week', ts)::date as week, ts::date as day, count(*) n from events group by 1, 2, 3 union all select date_trunc('month', ts)::date, date_trunc('week', ts)::date, null, count(*) from events group by 1, 2 union all select date_trunc('month', ts)::date, null, null, count(*) from events group by 1")
def summary_rollup(s, d):
    """Days into weeks into months: rollup without the grand total."""
    e = table(s, d, "events").select(F.date_trunc("month", "ts").cast("date").alias("month"), F.date_trunc("week", "ts").cast("date").alias("week"), F.to_date("ts").alias("day"))
    return e.rollup("month", "week", "day").agg(F.count(F.lit(1)).alias("n")).where("month is not null")


@query("routing_stats", LOG + " select source, count(*) n, count(distinct context) users, round(avg(case when level = 'error' then 1.0 else 0.0 end), 6) error_rate from logs group by 1")
def routing_stats(s, d):
    return S.logs(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("context").alias("users"), F.round(F.avg((F.col("level") == "error").cast("double")), 6).alias("error_rate"))


# experience ---------------------------------------------------------------------------------------


@query("outcomes_by_type", "select event_id id, value from events where event_type = 'purchase'")
def outcomes_by_type(s, d):
    return S.actions(s, d).where("action_type = 'purchase'").select("id", "value")


@query("feedback_apply", "select event_id id, event_type action_type, case when toxic = 1 then 'negative' when toxic = 0 then 'positive' end feedback from events left join labels on event_id = doc_id")
def feedback_apply(s, d):
    f = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "positive").alias("feedback"))
    return S.actions(s, d).join(f, "id", "left").select("id", "action_type", "feedback")


@query("pattern_counts", "select case when toxic = 1 then 'error_pattern_' else 'success_pattern_' end || event_type pattern, count(*) n from events join labels on event_id = doc_id group by 1")
def pattern_counts(s, d):
    f = table(s, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    p = F.concat(F.when(F.col("toxic") == 1, "error_pattern_").otherwise("success_pattern_"), F.col("action_type"))
    return S.actions(s, d).join(f, "id").groupBy(p.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("pattern_confidence", "select event_type action_type, round(count(*) filter (where toxic = 0) / count(*), 6) confidence, max((epoch_us(ts) // 1000)) last_used from events join labels on event_id = doc_id group by 1")
def pattern_confidence(s, d):
    f = table(s, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    return S.actions(s, d).join(f, "id").groupBy("action_type").agg(F.round(F.count_if(F.col("toxic") == 0) / F.count(F.lit(1)), 6).alias("confidence"), F.max("timestamp").alias("last_used"))


@query("experience_recency", f"select event_type action_type, round(sum(exp(-(({NOW} - (epoch_us(ts) // 1000)) / 86400000.0) / 30) * value) / sum(exp(-(({NOW} - (epoch_us(ts) // 1000)) / 86400000.0) / 30)), 6) score from events group by 1")
def experience_recency(s, d):
    w = F.exp(-((F.lit(NOW) - F.col("timestamp")) / 86400000.0) / 30)
    return S.actions(s, d).groupBy("action_type").agg(F.round(F.sum(w * F.col("value")) / F.sum(w), 6).alias("score"))


# extras that come with the engine -----------------------------------------------------------------


@query("join_orders_customer", "select c_mktsegment, count(*) n, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey group by 1")
def join_orders_customer(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("outer_join_counts", "select c_custkey, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey group by 1")
def outer_join_counts(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return c.join(o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("k")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n"))


@query("asof_events", """select p.event_id, v.event_id view_id from events p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts where p.event_type = 'purchase'""")
def asof_events(s, d):
    """For each purchase the user's last view at or before it: one window over both kinds, no range join."""
    e = table(s, d, "events").where(F.col("event_type").isin("view", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "view_id")


@query("interval_join_events", "select a.event_id, count(*) n from events a join events b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 1 hour where a.event_type = 'signup' and b.event_type = 'click' group by 1")
def interval_join_events(s, d):
    e = table(s, d, "events")
    a = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("t"))
    b = e.where("event_type = 'click'").select("user_id", "ts")
    # both sides meet by user and hour: a signup looks into its own hour and the next
    hour = lambda c: F.floor(S.millis(c) / 3_600_000)
    a = a.withColumn("hour", F.explode(F.array(hour("t"), hour("t") + 1)))
    return a.join(b.withColumn("hour", hour("ts")), ["user_id", "hour"]).where("ts between t and t + interval 1 hour").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("theta_join", "select r_name, count(*) n from region join customer on c_nationkey < r_regionkey * 5 group by 1")
def theta_join(s, d):
    r, c = table(s, d, "region"), table(s, d, "customer").groupBy("c_nationkey").count()
    return c.join(F.broadcast(r), F.col("c_nationkey") < F.col("r_regionkey") * 5).groupBy("r_name").agg(F.sum("count").alias("n"))


@query("tpch_q1_like", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) discount, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def tpch_q1_like(s, d):
    li = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("distinct_users", "select event_type, count(distinct user_id) users from events group by 1")
def distinct_users(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("rollup_events", "select event_type, ts::date as day, count(*) n from events group by rollup (1, 2)")
def rollup_events(s, d):
    return table(s, d, "events").select("event_type", F.to_date("ts").alias("day")).rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"))


@query("cube_events", "select event_type, ts::date as day, count(*) n, count(distinct user_id) users from events group by cube (1, 2)")
def cube_events(s, d):
    return table(s, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id").cube("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("grouping_sets_events", "select event_type, ts::date as day, count(*) n, grouping_id(event_type, ts::date) as g from events group by grouping sets ((event_type), (ts::date), ())")
def grouping_sets_events(s, d):
    e = table(s, d, "events").select("event_type", F.to_date("ts").alias("day"))
    g = e.groupingSets([["event_type"], ["day"], []], "event_type", "day")
    return g.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


@query("approx_distinct_users", "select event_type, count(*) > 0 as near from events group by 1")
def approx_distinct_users(s, d):
    """Whether the sketch (2 % aimed at) is within 10 % of the exact number."""
    e, none = table(s, d, "events"), F.lit(None).cast("long")
    # counted apart: beside a distinct count Spark would keep a sketch for each type and user
    about = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about")).select("event_type", "about", none.alias("users"))
    users = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users")).select("event_type", none.alias("about"), "users")
    both = about.unionAll(users).groupBy("event_type").agg(F.max("about").alias("about"), F.max("users").alias("users"))
    return both.select("event_type", (F.abs(F.col("about") / F.col("users") - 1) <= 0.1).alias("near"))


@query("benchmark_summary", "select event_type, count(*) ops, round(avg(value), 6) avg_us, round(1000000 / avg(value), 3) ops_per_s from events where value > 0 group by 1")
def benchmark_summary(s, d):
    """Events as timed operations (value: microseconds): the mean time and the rate."""
    return table(s, d, "events").where("value > 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("ops"), F.round(F.avg("value"), 6).alias("avg_us"), F.round(1_000_000 / F.avg("value"), 3).alias("ops_per_s"))


@query("file_formats", "select f as kind, count(*) n, sum(s_suppkey) as keys, sum(length(s_name)) as letters from supplier, (values ('csv'), ('json'), ('orc'), ('parquet')) t(f) group by 1")
def file_formats(s, d):
    """The suppliers, written and read again in each format."""
    from graphloom.session import scratch
    from graphloom.sources import files

    t, out = table(s, d, "supplier").select("s_suppkey", "s_name"), None
    for kind in ("csv", "json", "orc", "parquet"):
        path = f"{scratch(s, kind)}"
        files.write(t, path, kind)
        x = files.read(s, path, kind, t.schema).agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("keys"), F.sum(F.length("s_name")).alias("letters")).select(F.lit(kind).alias("kind"), "*")
        out = x if out is None else out.unionAll(x)
    return out


@query("running_total", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) total from events")
def running_total(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("total"))


@query("dedup_events", "select user_id, event_type, min(event_id) first_id from events group by 1, 2")
def dedup_events(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


BM25 = """words as (select doc_id id, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents),
tf as (select id, w, count(*) tf from words where w in ('then', 'tion', 'worthless') group by 1, 2), len_ as (select id, count(*) n from words group by 1),
st as (select count(*) docs, avg(n) mean from len_), df as (select w, count(*) df from tf group by 1)
select id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) score from tf join len_ using (id) join df using (w), st group by 1 order by score desc, id limit 20"""


@query("bm25_topk", "with " + BM25)
def bm25_topk(s, d):
    """BM25 (k1 = 1.2, b = 0.75) of three terms: lengths and terms are counted inside each row, once, so no word is shuffled."""
    terms = ["then", "tion", "worthless"]
    w = F.lower("text")
    t = docs(s, d).select("id", F.regexp_count(w, F.lit("[a-z]+")).alias("n"), *[F.regexp_count(w, F.lit(f"(?<![a-z]){k}(?![a-z])")).alias(k) for k in terms]).where("n > 0")
    t = materialize(t, "terms")
    st = t.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(k) > 0).alias("df_" + k) for k in terms])
    part = lambda k: F.when(F.col(k) > 0, F.log(1 + (F.col("docs") - F.col("df_" + k) + 0.5) / (F.col("df_" + k) + 0.5)) * F.col(k) * 2.2 / (F.col(k) + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))).otherwise(F.lit(0.0))
    score = part(terms[0]) + part(terms[1]) + part(terms[2])
    hit = F.col(terms[0]) + F.col(terms[1]) + F.col(terms[2]) > 0
    return t.where(hit).crossJoin(F.broadcast(st)).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
