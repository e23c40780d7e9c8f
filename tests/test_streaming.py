"""A stream gives what a batch of the same rows gives."""

from pyspark.sql import functions as F

from graphloom.streaming import enrich

SCHEMA = "id long, type string, messages_since_summary long, ts timestamp"


def events(spark, tmp_path):
    d = spark.range(60).select("id", F.element_at(F.array(*[F.lit(x) for x in enrich.ROUTES]), (F.col("id") % 5 + 1).cast("int")).alias("type"), F.col("id").alias("messages_since_summary"), F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_routing_in_a_stream(spark, tmp_path):
    batch = enrich.route(events(spark, tmp_path))
    seen = []
    handlers = {m: (lambda df, i, m=m: seen.extend((r["id"], m) for r in df.collect())) for ms in enrich.ROUTES.values() for m in ms}
    q = enrich.enrich_stream(enrich.file_stream(spark, str(tmp_path / "in"), SCHEMA), handlers, str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(seen) == sorted((r["id"], r["module"]) for r in batch.collect())


def test_windows_in_a_stream(spark, tmp_path):
    batch = events(spark, tmp_path)
    stream = enrich.file_stream(spark, str(tmp_path / "in"), SCHEMA)
    q = enrich.tumbling(stream, "ts", "1 hour", "30 days", "type").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("tumbled").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, enrich.tumbling(batch, "ts", "1 hour", "30 days", "type").collect()))


def test_chat_rules(spark):
    m = spark.range(45).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("chat_id"), F.col("id").alias("timestamp"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text_content"))
    assert sorted(map(tuple, enrich.summary_due(m).collect())) == [(0, 23, 1), (1, 22, 1)]
    assert dict((r["chat_id"], r["summary"]) for r in enrich.summarize(m, 3).collect()) == {0: "t40 ... t44", 1: "t39 ... t43"}
    a = spark.createDataFrame([("x", 0)] * 12 + [("y", 100)], "id string, timestamp long")
    t = {r["id"]: r["temperature"] for r in enrich.temperature(a, 90_000_000).collect()}
    assert t == {"x": "hot", "y": "cold"}


def test_summaries_come_due_once(spark, tmp_path):
    for part in range(4):
        spark.range(part * 20, part * 20 + 20).select((F.col("id") % 3).alias("chat_id"), F.col("id").alias("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = enrich.file_stream(spark, str(tmp_path / "m"), "chat_id long, timestamp long")
    q = enrich.due_stream(stream, 5).writeStream.format("memory").queryName("due").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("due").collect()))
    finally:
        q.stop()
    batch = enrich.summary_due(spark.read.parquet(str(tmp_path / "m")), 5).collect()
    assert got == sorted((r["chat_id"], k, 5 * k) for r in batch for k in range(1, r["summaries"] + 1))


def test_time_alone_moves_chats(spark, tmp_path):
    """A chat falls back because the time of other chats goes on; a new message brings it back."""
    from graphloom.streaming import timers

    timers.use_store(spark)
    files = [
        [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00"), (1, "2024-01-02 00:00:00")],
        [(2, "2024-02-05 00:00:00"), (None, "2024-02-05 00:00:00")],
        [(3, "2024-05-20 00:00:00"), (1, "2023-12-01 00:00:00")],
        [(1, "2024-06-01 00:00:00")],
        [(3, "2024-06-02 00:00:00")],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "chat_id long, ts string").selectExpr("chat_id", "cast(ts as timestamp) as ts").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    stream = str(tmp_path / "in")
    spark.read.parquet(str(tmp_path / "f0")).limit(0).write.parquet(stream)
    q = timers.moves(enrich.file_stream(spark, stream, "chat_id long, ts timestamp"), late="1 hour").writeStream.format("memory").queryName("moved").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i in range(len(files)):
            spark.read.parquet(str(tmp_path / f"f{i}")).write.mode("append").parquet(stream)
            q.processAllAvailable()
        got = sorted(map(str, spark.table("moved").selectExpr("chat_id", "date_format(at, 'yyyy-MM-dd HH') as at", "before", "after").collect()))
    finally:
        q.stop()
    every = spark.createDataFrame([r for f in files for r in f if r != (1, "2023-12-01 00:00:00")], "chat_id long, ts string").selectExpr("chat_id", "cast(ts as timestamp) as ts")
    want = timers.moves_of(every, "2024-06-01 23:00:00").selectExpr("chat_id", "date_format(at, 'yyyy-MM-dd HH') as at", "before", "after")
    assert got == sorted(map(str, want.collect())) and any("chat_id=2" in x and "before='recent', after='archive'" in x for x in got)


def test_steps_of_a_batch(spark):
    from graphloom.streaming import timers

    d = spark.createDataFrame([(1, 0), (1, 10), (1, 60), (2, None)], "chat_id long, m int").selectExpr("chat_id", "timestamp_seconds(m * 60) as ts")
    got = timers.moves_of(d, "1970-01-01 02:00:00", steps=timers.IDLE).selectExpr("chat_id", "unix_seconds(at) div 60 as m", "after").collect()
    assert sorted(map(tuple, got)) == [(1, 40, "idle"), (1, 60, "busy"), (1, 90, "idle")]
