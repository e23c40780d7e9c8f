"""Token counts as delta-maintained rollups.

A store holds additive totals (documents, tokens) by source, language and tokenizer version. A batch
of changes is signed: an insert counts a text as +1, a delete as -1, and a revision is a delete of
the old text and an insert of the new one. A batch's deltas are summed before they are
written to ``deltas/batch=<id>``; the write's success marker is the commit. A batch that is committed
already is skipped, one that was cut off is written anew, so every batch counts exactly once, however often
it is sent and wherever its first run was lost.

Totals are the sum of the committed deltas; ``compact`` replaces many batches by one folder, whose file
``_BATCHES`` lists the batches it stands for and is its commit.

Tokenizer versions: ``words@1`` (white-space words, native) and files of public byte-pair
tokenizers, by path.

Defined results for odd input: null and empty texts count as a document of 0 tokens; null sources and
languages are groups of their own; totals that return to no document and no token leave no row (negative ones stay); repeated
rows count as often as they are sent; very long texts are counted whole, a row at a time; sums do not depend on order, so there are
no ties; batch ids may be long (from 100 bytes on their folder is named by their SHA-256); empty batches commit; an empty store has
no totals; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.mixing import words

#: Fixed value: the pattern that splits text before the merges of a byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Version -> file of ranks ("base64 rank" lines); None: words.
TOKENIZERS = {"words@1": None, "byte_bpe_50k@1": "/opt/tokenizers/byte_bpe_50k.tiktoken"}
_held: dict[str, object] = {}


def encoding(path: str, ranks: bytes):
    """The tokenizer of a rank file, built once in each process."""
    if path not in _held:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _held[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _held[path]


def counter(spark: SparkSession, path: str):
    """Pandas UDF: number of tokens of each whole text. The file is read by the driver and broadcast."""
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path, ranks.value)
        for texts in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


class TokenRollup:
    """Totals in the folder ``path``, which the driver and the executors share."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str | None] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.tokenizers = dict(TOKENIZERS if tokenizers is None else tokenizers)

    def _files(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @staticmethod
    def _name(batch: str) -> str:
        """What a batch is called in folder names and lists."""
        return batch if len(batch.encode()) < 100 else "~" + hashlib.sha256(batch.encode()).hexdigest()

    def _lines(self, at) -> list[str] | None:
        """Lines of a small file, None if it is not there."""
        p, fs = self._files(at)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).splitlines()
        finally:
            stream.close()

    def committed(self) -> dict[str, set[str]]:
        """Folder of deltas -> names of the batches that it stands for; of two folders for one batch the larger holds."""
        p, fs = self._files(f"{self.path}/deltas")
        found: dict[str, set[str]] = {}
        if fs.exists(p):
            for s in fs.listStatus(p):
                at, (kind, name) = s.getPath().toString(), s.getPath().getName().split("=", 1)
                lines = [name] if kind == "batch" else self._lines(f"{at}/_BATCHES")
                if lines and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
                    found[at] = set(lines)
        return {k: v for k, v in found.items() if not any(v < w or (v == w and k > m) for m, w in found.items())}

    def count_changes(self, changes: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", sign: str = "sign") -> DataFrame:
        """(source, lang, tokenizer, documents, tokens): the signed sums of a batch."""
        d = changes.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(sign).cast("long").alias("sign"), F.col(text).cast("string").alias("t"))
        names = list(self.tokenizers)
        counts = [words(F.col("t")) if self.tokenizers[n] is None else counter(self.spark, self.tokenizers[n])(F.coalesce("t", F.lit(""))) for n in names]
        d = d.select("source", "lang", "sign", *[c.alias(f"n{i}") for i, c in enumerate(counts)])
        # one row for each group after the map-side sums, then one for each tokenizer
        sums = d.groupBy("source", "lang").agg(F.sum("sign").alias("documents"), *[F.sum(F.col("sign") * F.col(f"n{i}")).alias(f"n{i}") for i in range(len(names))])
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"n{i}").alias("tokens")) for i, n in enumerate(names)]))
        return sums.select("source", "lang", "documents", each.alias("x")).select("source", "lang", "x.tokenizer", "documents", "x.tokens")

    def commit(self, batch: str, changes: DataFrame, **columns) -> bool:
        """Counts and commits a batch; False if it is committed already."""
        if not batch or set(batch) & set("/=~\n\r"):
            raise ValueError("a batch id is not empty and has no / = ~ and no line break")
        name = self._name(batch)
        if any(name in v for v in self.committed().values()):
            return False
        self.count_changes(changes, **columns).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={name}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) of all committed batches."""
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        at = sorted(self.committed())
        d = self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)
        d = d.groupBy("source", "lang", "tokenizer").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return d.where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Writes all committed batches as one; its list takes the place of theirs, which are then removed."""
        old = self.committed()
        if len(old) < 2:
            return
        at = f"{self.path}/deltas/compact={uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(at)
        # written aside and renamed: without its list the folder does not count
        aside, fs = self._files(f"{at}/_LIST")
        out = fs.create(aside, True)
        out.write(bytearray("\n".join(sorted(set().union(*old.values()))).encode()))
        out.close()
        fs.rename(aside, self._files(f"{at}/_BATCHES")[0])
        for x in old:
            fs.delete(self._files(x)[0], True)


def insert(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sign", F.lit(1))


def delete(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sign", F.lit(-1))
