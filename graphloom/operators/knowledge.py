"""Knowledge graph: entity similarity, links, related entities, inference; time-tiered lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import vectors as V


#: Incoming relationships of a hub that one part of an inference takes.
HUB = 10_000


def property_similarity(type_a: Column, props_a: Column, type_b: Column, props_b: Column) -> Column:
    """0.6 for an equal type + 0.4 * (shared keys with equal values / all keys); no keys: 0 for that part."""
    keys = F.array_union(F.map_keys(props_a), F.map_keys(props_b))
    same = F.filter(F.array_intersect(F.map_keys(props_a), F.map_keys(props_b)), lambda k: F.try_element_at(props_a, k) == F.try_element_at(props_b, k))
    part = F.when(F.size(keys) == 0, F.lit(0.0)).otherwise(F.size(same) / F.size(keys))
    return F.when(type_a == type_b, F.lit(0.6)).otherwise(F.lit(0.0)) + 0.4 * part


def entity_similarity(a: str, b: str) -> Column:
    """Of two entity structs (columns named a and b): cosine if both are embedded with one size, else by properties."""
    x, y = F.col(f"{a}.embedding"), F.col(f"{b}.embedding")
    both = x.isNotNull() & y.isNotNull() & (F.size(x) == F.size(y)) & (F.size(x) > 0)
    return F.when(both, V.cosine(x, y)).otherwise(property_similarity(F.col(f"{a}.entity_type"), F.col(f"{a}.properties"), F.col(f"{b}.entity_type"), F.col(f"{b}.properties")))


def semantic_search(entities: DataFrame, entity_id, limit: int | None = None, digits: int = 6) -> DataFrame:
    """(id, score): the other entities by similarity to one of them; without a limit all of them, in no order."""
    one = entities.where(F.col("id") == entity_id).select(F.struct("*").alias("q")).limit(1)
    d = entities.where(F.col("id") != entity_id).select(F.struct("*").alias("e")).crossJoin(F.broadcast(one))
    scored = d.select(F.col("e.id").alias("id"), (F.round(entity_similarity("e", "q"), digits) + 0.0).alias("score"))
    return scored if limit is None else V.top_k(scored, limit)


def link_entities(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity_id): entities whose label's words occur in the text in a row (any case). An n-gram join: texts are cut, in one
    pass, into the n-grams of all lengths that labels have."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    e = entities.select(F.col("id").alias("entity_id"), words(F.col("label")).alias("w")).where(F.size("w") > 0)
    e = e.select("entity_id", F.size("w").alias("n"), F.array_join("w", " ").alias("gram"))
    sizes = e.agg(F.sort_array(F.collect_set("n"))).first()[0]
    t = texts.select("id", words(F.col("text")).alias("w"))
    gram = lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("w", i, n), " "))
    lengths = F.array(*[F.lit(n) for n in sizes]).cast("array<int>")
    grams = t.select("id", F.explode(F.array_distinct(F.flatten(F.transform(lengths, gram)))).alias("gram"))
    return grams.join(e, "gram").select("id", "entity_id").distinct()


def related(rels: DataFrame, entity_id, limit: int) -> DataFrame:
    """(id, confidence): neighbours in either direction by their best confidence."""
    near = rels.where(F.col("src") == entity_id).select(F.col("dst").alias("id"), "confidence").unionAll(rels.where(F.col("dst") == entity_id).select(F.col("src").alias("id"), "confidence"))
    return V.top_k(near.where(F.col("id") != entity_id).groupBy("id").agg(F.max("confidence").alias("confidence")), limit, "confidence")


def infer(rels: DataFrame, digits: int = 6) -> DataFrame:
    """(src, dst, rel, confidence): A-r->B-r->C gives A-r->C, with the best product of confidences, where it is not stated.

    Parallel relationships count once (the greatest and the least confidence stand for all). A hub's incoming relationships are dealt to parts
    of ``HUB``, and its outgoing ones go to each part, so no task gets all its pairs.
    """
    least, most = F.min("confidence").alias("least"), F.max("confidence").alias("most")
    once = rels.groupBy("src", "dst", "rel").agg(least, most)
    parts = once.groupBy(F.col("dst").alias("mid"), "rel").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts")).where("parts > 1")
    number = F.coalesce("parts", F.lit(1))
    x = once.withColumnRenamed("dst", "mid").join(parts, ["mid", "rel"], "left").withColumn("part", F.pmod(F.xxhash64("src"), number).cast("int"))
    y = once.withColumnRenamed("src", "mid").join(parts, ["mid", "rel"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), number - 1)))
    two = x.select("mid", "rel", "part", "src", "least", "most").alias("x").join(y.select("mid", "rel", "part", "dst", "least", "most").alias("y"), ["mid", "rel", "part"]).where("src <> dst")
    # of confidences below zero the least make the greatest product
    best = F.greatest(F.col("x.most") * F.col("y.most"), F.col("x.least") * F.col("y.least"), F.col("x.most") * F.col("y.least"), F.col("x.least") * F.col("y.most"))
    d = two.withColumn("best", best).groupBy("src", "dst", "rel").agg(F.round(F.max("best"), digits).alias("confidence"))
    return d.join(rels.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti")


def missing_ends(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with an end that is no entity."""
    ids = entities.select(F.col("id"))
    bad = rels.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select(*rels.columns)
    return bad.unionByName(rels.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*rels.columns))


def cascade_delete(rels: DataFrame, gone: DataFrame) -> DataFrame:
    """Relationships that are left when the entities ``gone`` (id) are deleted."""
    return rels.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(*rels.columns)


def find_or_create(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(label, entity_type) that are mentioned and not there yet, once each."""
    return mentions.select("label", "entity_type").distinct().join(entities.select("label", "entity_type"), ["label", "entity_type"], "left_anti")


def latest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Latest version of each key; a version without an order is older than any with one."""
    return df.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(order)).alias("x")).select("x.*")


def tier_of_age(age_ms: Column) -> Column:
    """active below 30 days, recent below 90, archive from there."""
    day = 86_400_000
    return F.when(age_ms < 30 * day, "active").when(age_ms < 90 * day, "recent").otherwise("archive")


def first_tier(copies: DataFrame, order: list[str]) -> DataFrame:
    """One row for each id: that of the first tier in ``order`` that has it; null and other tiers come last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tier")), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long"))
    return copies.groupBy("id").agg(F.min_by(F.struct("*"), rank).alias("x")).select("x.*")


def quarter(ts_ms: Column) -> Column:
    """UTC quarter, YYYY-Qn, whatever the session's time zone is."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / 86_400_000).cast("int"))
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def recent_messages(messages: DataFrame, n: int, scope: Column | None = None) -> DataFrame:
    """The last n messages of each chat (within a scope), with their rank."""
    d = messages if scope is None else messages.where(scope)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("timestamp"), F.desc("id")))).where(F.col("rank") <= n)


def entities_in(texts: DataFrame) -> DataFrame:
    """(id, label): the stand-in for entity recognition: words that start with a capital and are over two bytes long."""
    words = texts.select("id", F.explode(F.split("text", r"\s+")).alias("label"))
    first = F.substring("label", 1, 1)
    return words.where((F.octet_length("label") > 2) & (F.upper(first) == first) & (F.lower(first) != first)).distinct()


def summary_tier(content: Column) -> Column:
    """By bytes: below 1000 daily, below 5000 weekly, else monthly."""
    n = F.octet_length(content)
    return F.when(n < 1000, "daily").when(n < 5000, "weekly").otherwise("monthly")
