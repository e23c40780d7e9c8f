"""Event-driven enrichment: the same functions on a batch, and on a stream through ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.ml import embedder
from graphloom.operators import knowledge

#: Node types that each module takes.
INDEXED = ["Message", "Summary", "Entity", "ScrapedPage", "WebSearch", "AudioTranscript"]
LINKED = ["Message", "Summary", "ScrapedPage"]
#: Event type -> modules that get it.
ROUTES = {"NodeCreated": ["semantic_indexer", "entity_linker", "associative_linker"], "NodeUpdated": ["semantic_indexer"], "ChatUpdated": ["summarizer"], "BatchMessagesAdded": [], "EdgeCreated": []}
SUMMARY_EVERY = 20


def route(events: DataFrame, threshold: int = SUMMARY_EVERY) -> DataFrame:
    """One row for each event and module that gets it. ChatUpdated goes on from ``threshold`` messages since the last summary."""
    table = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]).cast("array<string>"))])
    d = events.where((F.col("type") != "ChatUpdated") | (F.coalesce(F.col("messages_since_summary"), F.lit(0)) >= threshold))
    return d.withColumn("module", F.explode(F.try_element_at(table, F.col("type"))))


def index_new(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, vector) of nodes of an indexed type with text and without an embedding yet."""
    fresh = nodes.where(F.col("node_type").isin(INDEXED) & (F.trim(F.coalesce("text", F.lit(""))) != "")).join(embeddings.select("id"), "id", "left_anti")
    return fresh.select("id", embedder()("text").alias("vector"))


def mentions(nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type): from nodes to the entities that their text names."""
    e = knowledge.entities_in(nodes.where(F.col("node_type").isin(LINKED)))
    return e.select(F.col("id").alias("src"), F.col("label").alias("dst"), F.lit("MENTIONS").alias("edge_type"))


def associate(neighbours: DataFrame, threshold: float = 0.85, most: int = 3) -> DataFrame:
    """Edges to the most similar nodes from the threshold on, ``most`` at each. ``neighbours``: src, dst, sim, rank."""
    return neighbours.where((F.col("sim") >= threshold) & (F.col("rank") <= most)).select("src", "dst", F.lit("IS_SEMANTICALLY_SIMILAR_TO").alias("edge_type"), F.col("sim").alias("score"))


def summarize(messages: DataFrame, last: int = 50) -> DataFrame:
    """(chat_id, n, summary): of each chat's last messages, the first and the last text."""
    rn = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("timestamp"), F.desc("id")))
    d = messages.withColumn("rn", rn).where(F.col("rn") <= last)
    at = F.struct("timestamp", "id")
    return d.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.concat(F.min_by("text_content", at), F.lit(" ... "), F.max_by("text_content", at)).alias("summary"))


def summary_due(messages: DataFrame, every: int = SUMMARY_EVERY) -> DataFrame:
    """(chat_id, n, summaries): chats with their number of messages and of summaries that are due by now."""
    return messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n")).withColumn("summaries", F.floor(F.col("n") / every))


def temperature(access: DataFrame, now_ms: int) -> DataFrame:
    """(id, accesses, idle_ms, temperature): hot below an hour idle or above 10 accesses, warm below a day, else cold."""
    d = access.groupBy("id").agg(F.count(F.lit(1)).alias("accesses"), (F.lit(now_ms) - F.max("timestamp")).alias("idle_ms"))
    return d.withColumn("temperature", F.when((F.col("idle_ms") < 3600000) | (F.col("accesses") > 10), "hot").when(F.col("idle_ms") < 86400000, "warm").otherwise("cold"))


def tier_moves(temperatures: DataFrame) -> DataFrame:
    """Adds move: warm up above 20 accesses, down after two idle days; cold up above 5."""
    warm, cold = F.col("temperature") == "warm", F.col("temperature") == "cold"
    return temperatures.withColumn("move", F.when(warm & (F.col("accesses") > 20), "promote").when(warm & (F.col("idle_ms") > 172800000), "demote").when(cold & (F.col("accesses") > 5), "promote").otherwise("stay"))


def activity(events: DataFrame) -> DataFrame:
    """Adds gap_ms and level before each event of a user: sleep from 30 minutes idle, low from 5, else high."""
    gap = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy("user_id").orderBy("timestamp", "id"))
    return events.withColumn("gap_ms", gap).withColumn("level", F.when(F.col("gap_ms") >= 1800000, "sleep").when(F.col("gap_ms") >= 300000, "low").otherwise("high"))


# streams ------------------------------------------------------------------------------------------


def tumbling(events: DataFrame, ts: str, size: str, late: str, *by: str) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` behind the newest are dropped from a stream."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(events: DataFrame, ts: str, size: str, step: str, value: str, late: str = "1 hour") -> DataFrame:
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, size, step).alias("w")).agg(F.round(F.avg(value), 6).alias("mean")).select(F.col("w.start").alias("start"), "mean")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")


def once(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """First event of each key (on a stream within the watermark)."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def enrich_stream(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, threshold: int = SUMMARY_EVERY):
    """Starts a query that routes each micro-batch and hands every module its rows with the batch id. A handler that
    writes by batch id is idempotent, so a batch that is run again after a failure counts once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch, threshold).persist()
        try:
            for name, f in handlers.items():
                f(routed.where(F.col("module") == name), batch_id)
        finally:
            routed.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_trigger(messages: DataFrame, every: int = SUMMARY_EVERY) -> Column:
    """True where a message completes another ``every`` of its chat (batch)."""
    return F.row_number().over(Window.partitionBy("chat_id").orderBy("timestamp", "id")) % every == 0


def due_stream(messages: DataFrame, every: int = SUMMARY_EVERY) -> DataFrame:
    """(chat_id, summary_no, n): on a stream of messages, a row whenever a chat has reached another ``every`` messages.

    The state of a chat is one number, its messages so far; a micro-batch hands it an iterator of frames, so no chat is held
    in memory. A batch that is run again starts from the state before it, so a summary is not due twice.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def count(key, frames, state: GroupState):
        before = state.get[0] if state.exists else 0
        now = before + sum(len(f) for f in frames)
        state.update((now,))
        done = range(before // every + 1, now // every + 1)
        yield pd.DataFrame({"chat_id": [key[0]] * len(done), "summary_no": list(done), "n": [k * every for k in done]}).astype({"chat_id": "int64", "summary_no": "int64", "n": "int64"})

    return messages.groupBy("chat_id").applyInPandasWithState(count, "chat_id long, summary_no long, n long", "n long", "append", GroupStateTimeout.NoTimeout)
