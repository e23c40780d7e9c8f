"""The corpus pipeline: documents that are not toxic, of good quality, one of each group of near
copies, mixed to target weights, and encoded.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's documents. All but the last return the columns of
``documents``, whatever these are called: a document travels through an operator as one struct.

The mix is dealt to shards and parts by its layout, as its columns are those of the documents: a shard's part is a run
of rows of one partition, locally shuffled. A document may be taken in several slices, and in equal ones, as the mix goes over a
source twice; the last stage names the slice (``slice``: a hash of key, text and the number of the slice among equal ones, which also
seeds the draw) beside the document, so names differ and equal slices get draws of their own.

Defined results for odd input: rows with a null doc_id go through every stage; rows that share a doc_id stay or go together in
the near-copy stage and are judged by their own text elsewhere; null texts and texts without words pass the classifiers by
their base scores, link with nothing, and are never taken by the mix; very long texts are worked on whole; repeated rows are
copies of each other: those of one doc_id all stay, those of several leave one; without labels the lexicons alone decide on
toxicity and no text is poor; a text at exactly a threshold is toxic, is kept as good, and is a near copy; of near copies the smallest doc_id
stays; an empty table gives an empty result; extra columns stay as they are, also where they have an operator's column names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import mixing, near_dedup, quality, segmentation, toxicity
from graphloom.session import materialize, table

#: Ids (16 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_): the document as one struct, so its columns cannot clash with an operator's."""
    return docs.select("doc_id", F.struct("*").alias("row_"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier does not call toxic."""
    return toxicity.toxicity(packed(docs), table(spark, sf_dir, "labels"), text="row_.text", carry=("row_",)).where("predicted = 0").select("row_.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is of grade 1 or better with a probability of at least a half."""
    return quality.grade(packed(docs), quality.ratings_of(table(spark, sf_dir, "labels")), text="row_.text", carry=("row_",)).where("keep").select("row_.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies (similarity 0.8 or more on five-word shingles)."""
    copies = materialize(near_dedup.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct(), "copies")
    return docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each slice of a document that it takes, laid out by shard, part and place."""
    return mixing.mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """With ``copy_``: the number from 0 of each row among those of equal doc_id and text.

    Places and hashes are all that is sorted and shuffled: the rows are written once with their place, and those that are not the first of
    their kind get their number by a join on it. Equal rows are alike, so it does not matter which has which number.
    """
    placed = materialize(docs.withColumn("place_", F.monotonically_increasing_id()), "placed")
    names = placed.select("place_", F.struct("doc_id", F.xxhash64("doc_id", "text").alias("h")).alias("name"))
    # most rows have no equal: only those of the others are ranked
    many = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("place_")) - 1
    again = materialize(names.join(many.withColumnRenamed("name", "name_"), F.col("name").eqNullSafe(F.col("name_"))).select("place_", rank.alias("copy_")).where("copy_ > 0"), "again")
    small = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    return placed.join(small, "place_", "left").select(*docs.columns, F.coalesce("copy_", F.lit(0)).alias("copy_"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row's text, as piece ids, with the row's slice, language, source and size.
    Small chunks and few kept units: the stages before have filled the executors' heaps."""
    name = F.when(F.col("copy_") == 0, F.xxhash64("doc_id", "text")).otherwise(F.xxhash64("doc_id", "text", "copy_"))
    rows = numbered(docs).withColumn("slice", name).drop("copy_")
    return segmentation.segment(rows, k=2, draw="slice", carry=("slice", "lang", "source", "n_chars"), chunk_chars=120_000, held_chars=250_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Learned classifiers, hashed sets and sampled segmentations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
