"""Bounded samples of labelled rows, for fitting on the driver.

A sample has about ``per_class`` rows of each class at most, whatever the data: of the rows of one key only
one is taken (that of the smallest text hash), texts beyond ``SAMPLE_CHARS`` are not taken, and more than
``MAX_CLASSES`` classes are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are not taken into a sample (they are scored all the same), so a sample's size in bytes is bounded.
SAMPLE_CHARS = 50_000
#: Classes that may be learned; with more an error is raised, none is left out.
MAX_CLASSES = 1_000


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def spread(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that the key alone decides."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)


def _shares(rows: DataFrame, cls: str, per_class: int) -> tuple[Column | None, dict]:
    """The share of each class's rows that is taken, as a column, and the rows of each class."""
    found = rows.groupBy(cls).count().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {cls}: group the rare ones first")
    counts = {r[0]: r[1] for r in sorted(found, key=lambda r: (-r[1], str(r[0])))}
    if not counts:
        return None, counts
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_class / n))])
    return F.try_element_at(share, F.col(cls)), counts


def _one_each(rows: DataFrame, *key: str) -> DataFrame:
    """Of the rows of a key that of the smallest text hash; combined before the shuffle, so a hot key costs one row for each task."""
    first = rows.groupBy(*key).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return first.select(*key, F.col("x.text").alias("text"))


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, cls: str, per_class: int, seed: int = 0, unlabelled: int = 0, where: Column | None = None) -> tuple[DataFrame, dict]:
    """(key, text, cls), the second named ``text`` whatever the column is, of about ``per_class`` keys of each class at most, chosen by key, and the number of keys of each class.

    ``labels`` has ``key`` and ``cls``; of several classes of one key the greatest counts. They are counted first, so the ids that
    are joined to the texts are bounded and are broadcast. With ``unlabelled`` about so many keys of ``docs`` that fulfil
    ``where`` and are not in ``labels`` are added; their class is null.
    """
    kind = labels.schema[cls].dataType
    labels = labels.select(key, cls).where(F.col(cls).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(cls).alias(cls))
    share, counts = _shares(labels, cls, per_class)
    if share is None:
        return docs.select(F.col(key), F.col(text).cast("string").alias("text"), F.lit(None).cast(kind).alias(cls)).limit(0), counts
    ids = labels.where(spread(F.col(key), seed=seed) < share)
    if unlabelled:
        some = docs.where(F.col(key).isNotNull() & (F.lit(True) if where is None else where)).select(key)
        some = some.where(spread(F.col(key), seed=seed + 1) < min(1.0, unlabelled / max(1, some.count()))).distinct()
        ids = ids.unionAll(some.join(labels, key, "left_anti").select(key, F.lit(None).cast(kind).alias(cls)))
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), key)
    return _one_each(rows, key, cls).select(key, "text", cls), counts


def sampled_rows(docs: DataFrame, key: str, text: str, cls: str, per_class: int, seed: int = 0) -> tuple[DataFrame, dict]:
    """(key, text, cls) as ``sampled`` gives them, of rows that have their class themselves: about ``per_class`` rows of each
    class at most, chosen by key and text, and the number of rows of each class. Rows without a class are left out."""
    rows = docs.where(F.col(cls).isNotNull()).select(F.col(key), F.col(text).cast("string").alias("text"), F.col(cls).alias(cls))
    share, counts = _shares(rows, cls, per_class)
    if share is None:
        return rows.limit(0), counts
    rows = rows.where((F.length("text") <= SAMPLE_CHARS) & (spread(F.col(key), F.col("text"), seed=seed) < share))
    return rows.groupBy(key, cls, F.xxhash64("text").alias("h_")).agg(F.min("text").alias("text")).select(key, "text", cls), counts
