"""Graph, message, log, payload and knowledge views over the star-schema tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import table

#: "Now" of every time-dependent query: 2024-03-31T00:00:00Z in milliseconds.
NOW_MS = 1711843200000
#: Event type -> log level.
LEVELS = {"error": "error", "signup": "warn", "purchase": "info", "click": "log", "view": "debug"}
#: Log sources in order.
LOG_SOURCES = ["Storage", "Indexing", "Query", "Enrichment", "Scheduler", "GrpcServer", "HttpApi", "Models", "Frontend"]


def millis(ts) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz"))


def trade_all(spark: SparkSession, sf: str) -> DataFrame:
    """Customer nation -> supplier nation (src, dst, weight = number of lines), no loops."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    supp = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    # lines are summed by order's nation and supplier before the nations meet
    return line.join(orders, "l_orderkey").join(cust, "o_custkey").join(supp, "l_suppkey").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """The three heaviest edges of each source; equal weights: the smaller target."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return trade_all(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive event types of a user (src, dst, weight)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_type", F.lead("event_type").over(w).alias("dst"))
    return e.where("dst is not null").groupBy(F.col("event_type").alias("src"), "dst").agg(F.count(F.lit(1)).alias("weight"))


def supply(spark: SparkSession, sf: str, once: bool = True) -> DataFrame:
    """region -> nation -> customer/supplier, customer -> order -> part, supplier -> part (src, dst, edge_type); with ``once`` false an edge of
    lines may come more than once, which saves two shuffles where that is the same."""
    t = lambda n: table(spark, sf, n)
    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))
    line = t("lineitem")
    own = lambda df: df.distinct() if once else df
    parts = [
        edge(t("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"), "HAS_NATION"),
        edge(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "HAS_CUSTOMER"),
        edge(t("supplier"), key("n", "s_nationkey"), key("s", "s_suppkey"), "HAS_SUPPLIER"),
        edge(t("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "PLACED"),
        own(edge(line, key("o", "l_orderkey"), key("p", "l_partkey"), "CONTAINS")),
        own(edge(line, key("s", "l_suppkey"), key("p", "l_partkey"), "SUPPLIES")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat(F.lit("m:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").alias("chat_id"),
        F.col("turn"),
        F.col("role").alias("sender"),
        F.col("text").alias("text_content"),
        (F.lit(1704067200000) + F.col("conv_id") * 3600000 + F.col("turn") * 60000).alias("timestamp"),
    )


def logs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    source = F.array(*[F.lit(x) for x in LOG_SOURCES])
    return e.select(
        F.col("event_id").alias("id"),
        millis("ts").alias("timestamp"),
        level[F.col("event_type")].alias("level"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("context"),
        F.concat_ws(" ", F.lit("event"), "event_type").alias("message"),
        F.get(source, (F.col("user_id") % 9).cast("int")).alias("source"),
        F.col("props").alias("data"),
    )


def event_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """(id, fields): a tagged value for each field of an event."""
    from graphloom.operators.predicates import boolean, integer, number, string  # noqa: F401

    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.create_map(
            F.lit("event_type"), string(F.col("event_type")), F.lit("value"), number(F.col("value")), F.lit("user_id"), integer(F.col("user_id")), F.lit("k"), integer(F.get_json_object("props", "$.k").cast("long"))
        ).alias("fields"),
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as action outcomes; the toxic label of the document of the same id is the feedback."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action_type"), millis("ts").alias("timestamp"), F.col("user_id"), "value")
    return e


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


#: The views as SQL common table expressions; a view names the ones it needs first.
SQL = {
    "trade_all": """trade_all as (select cast(c_nationkey as bigint) src, cast(s_nationkey as bigint) dst, count(*) weight from lineitem join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2)""",
    "trade": """trade as (select src, dst, weight from trade_all qualify row_number() over (partition by src order by weight desc, dst) <= 3)""",
    "transitions": """transitions as (select event_type src, nxt dst, count(*) weight from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) nxt from events) where nxt is not null group by 1, 2)""",
    "supply": """supply as (select 'r:' || n_regionkey src, 'n:' || n_nationkey dst, 'HAS_NATION' edge_type from nation
        union all select 'n:' || c_nationkey, 'c:' || c_custkey, 'HAS_CUSTOMER' from customer
        union all select 'n:' || s_nationkey, 's:' || s_suppkey, 'HAS_SUPPLIER' from supplier
        union all select 'c:' || o_custkey, 'o:' || o_orderkey, 'PLACED' from orders
        union all select distinct 'o:' || l_orderkey, 'p:' || l_partkey, 'CONTAINS' from lineitem
        union all select distinct 's:' || l_suppkey, 'p:' || l_partkey, 'SUPPLIES' from lineitem)""",
    "messages": """messages as (select 'm:' || conv_id || ':' || turn id, conv_id chat_id, turn, role sender, text text_content, 1704067200000 + conv_id * 3600000 + turn * 60000 as "timestamp" from conversations)""",
    "logs": """logs as (select event_id id, (epoch_us(ts) // 1000) as "timestamp", case event_type when 'error' then 'error' when 'signup' then 'warn' when 'purchase' then 'info' when 'click' then 'log' when 'view' then 'debug' end as level,
        'user_' || user_id context, 'event ' || event_type message,
        ['Storage', 'Indexing', 'Query', 'Enrichment', 'Scheduler', 'GrpcServer', 'HttpApi', 'Models', 'Frontend'][user_id % 9 + 1] source, props as data from events)""",
    "vectors": """vectors as (select vec_id id, embedding::double[] vector, label from embeddings)""",
    "sim": """sim as (select src, dst, sim from (select a.id src, b.id dst, round(list_cosine_similarity(a.vector, b.vector), 6) sim, row_number() over (partition by a.id order by round(list_cosine_similarity(a.vector, b.vector), 6) desc, b.id) rn
        from vectors a join vectors b on a.id <> b.id) where rn <= 3)""",
}
_NEEDS = {"trade": ["trade_all"], "sim": ["vectors"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """``with <views>,`` for the start of a statement that goes on with its own expressions or a select."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return ("with recursive " if recursive else "with ") + ", ".join(SQL[n] for n in order)
