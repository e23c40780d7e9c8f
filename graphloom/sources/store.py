"""Named stores of keyed rows on Parquet: upsert, delete, point and prefix reads, transactions, tiers, logs.

A store is a folder of segments and a commit log. A base holds all rows, a delta the rows and deletions of one change, so a change
writes what it changes and not the whole store. A segment counts once the log has an entry for it (and its success marker is there):
readers take the newest base and the deltas after it, and a write that is cut off leaves the state before it. Rows are laid out by
key range, so point and prefix reads skip files by their statistics. After ``MERGE`` deltas a change writes a new base.

Writers do not lock. A transaction reads the version at which it began; at its commit the changes made since are looked through,
and it is refused (``Conflict``) if one of them has a key of its own, or has replaced all rows. Else its entry is put under
the next number; if another writer was faster, it looks through that one's changes too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import predicates
from graphloom.operators.knowledge import first_tier
from graphloom.sources.log import CommitLog, Conflict

#: Deltas that a base may have.
MERGE = 8
_GONE, _SEQ = "gone_", "seq_"


class Store:
    """Keyed rows in ``path``. Empty and null keys are refused."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.log = CommitLog(spark, f"{self.path}/_log")

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest commit; 0 if there is none."""
        return self.log.last()

    def segments(self, version: int | None = None) -> list[str]:
        """Names of the committed segments that make up the state (as of a version): a base and its deltas, in order."""
        names = []
        for v in reversed([v for v in self.log.versions() if version is None or v <= version]):
            name = self.log.entry(v)["segment"]
            if self._fs(self.path)[1].exists(self._fs(f"{self.path}/{name}/_SUCCESS")[0]):
                names.append(name)
                if name.endswith(".base"):
                    break
        return names[::-1]

    def exists(self) -> bool:
        return bool(self.segments())

    def read(self, version: int | None = None) -> DataFrame:
        names = self.segments(version)
        if not names:
            raise KeyError(f"no store at {self.path}")
        base = self.spark.read.parquet(f"{self.path}/{names[0]}")
        if len(names) == 1:
            return base.where(f"not {_GONE}").drop(_GONE) if _GONE in base.columns else base
        deltas = None
        for i, n in enumerate(names if names[0].endswith(".delta") else names[1:]):
            d = self.spark.read.parquet(f"{self.path}/{n}").withColumn(_SEQ, F.lit(i))
            deltas = d if deltas is None else deltas.unionByName(d, allowMissingColumns=True)
        last = deltas.groupBy(self.key).agg(F.max_by(F.struct(*deltas.columns), _SEQ).alias("x")).select("x.*").drop(_SEQ)
        new = last.where(f"not {_GONE}").drop(_GONE)
        if names[0].endswith(".delta"):
            return new
        return base.join(last.select(self.key), self.key, "left_anti").select(*base.columns).unionByName(new, allowMissingColumns=True)

    def _put(self, df: DataFrame, kind: str) -> str:
        """Writes a segment, which no one sees before its commit."""
        name = f"{uuid.uuid4().hex}.{kind}"
        df.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key).write.parquet(f"{self.path}/{name}")
        return name

    def write(self, df: DataFrame) -> None:
        """Replaces all rows, whatever they are."""
        name = self._put(df, "base")
        while not self.log.put(self.version() + 1, {"segment": name, "replaces": True}):
            pass

    def _check(self, keys: DataFrame, since: int, now: int) -> None:
        """Refuses changes of ``keys`` if commits after ``since`` touch them."""
        there = set(self.log.versions())
        for v in range(since + 1, now + 1):
            if v not in there:
                raise Conflict(f"the changes since version {since} are no longer kept")
            entry = self.log.entry(v)
            if entry.get("replaces"):
                raise Conflict(f"version {v} has replaced all rows")
            if entry["segment"].endswith(".delta"):
                other = self.spark.read.parquet(f"{self.path}/{entry['segment']}").select(self.key)
                if not other.join(keys, self.key, "left_semi").isEmpty():
                    raise Conflict(f"version {v} has changed the same keys")

    def _change(self, delta: DataFrame, since: int) -> None:
        """Commits rows and deletions (``gone_``), one for each key, made from the state at ``since``."""
        name = self._put(delta, "delta")
        keys = self.spark.read.parquet(f"{self.path}/{name}").select(self.key)
        seen = since
        while True:
            now = self.version()
            self._check(keys, seen, now)
            if self.log.put(now + 1, {"segment": name}):
                break
            seen = now
        if len(self.segments()) > MERGE:
            self.compact()

    def compact(self) -> bool:
        """Writes the state as a base. It holds what was there before, so it conflicts with no one; if another commit comes first it is given up."""
        now = self.version()
        return self.log.put(now + 1, {"segment": self._put(self.read(now), "base")})

    def _latest(self, rows: DataFrame, order: str | None) -> DataFrame:
        key = F.col(self.key)
        if not rows.where(key.isNull() | (key.cast("string") == "")).isEmpty():
            raise ValueError("empty keys are refused")
        # a struct is never null, so rows without an order take part; they come before all others
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(order or self.key)).alias("x")).select("x.*")

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Rows replace those of their key; among rows of one key the last by ``order`` counts, one without an order only if there is no other."""
        with self.transaction() as t:
            t.upsert(rows, order)

    def delete(self, keys: DataFrame) -> DataFrame:
        """Deletes the keys; returns the rows that went."""
        with self.transaction() as t:
            gone = self.read(t.since).join(keys.select(self.key).distinct(), self.key, "left_semi")
            t.delete(keys)
        return gone

    def transaction(self) -> Transaction:
        return Transaction(self)

    def vacuum(self) -> int:
        """Deletes the segments that the state no longer needs, what cut-off and refused writes have left, and the log before the
        newest base; nothing may be reading them. Transactions that began before that base are refused afterwards."""
        keep = set(self.segments())
        root, fs = self._fs(self.path)
        bases = [v for v in self.log.versions() if self.log.entry(v)["segment"] in keep]
        self.log.drop(min(bases, default=0))
        old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName() not in keep | {"_log"}] if fs.exists(root) else []
        return sum(bool(fs.delete(p, True)) for p in old)

    def get(self, value) -> DataFrame:
        return self.read().where(F.col(self.key) == value)

    def scan_prefix(self, prefix: str) -> DataFrame:
        return self.read().where(F.startswith(F.col(self.key), F.lit(prefix))).orderBy(self.key)


class Transaction:
    """Changes that become visible together: one delta, written at commit. Reads see the state at its beginning and its own changes.

    As a context manager it commits at the end, and aborts if an exception leaves it. A commit raises ``Conflict`` if another one has
    changed the same keys since; the transaction is closed then, and nothing of it is there.
    """

    def __init__(self, store: Store):
        self.store, self.changes, self.open, self.since = store, [], True, store.version()

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction is closed")

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        self._check()
        self.changes.append(self.store._latest(rows, order).withColumn(_GONE, F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        self._check()
        self.changes.append(keys.select(self.store.key).distinct().withColumn(_GONE, F.lit(True)))

    def _delta(self) -> DataFrame | None:
        """The last change of each key."""
        out = None
        for i, c in enumerate(self.changes):
            c = c.withColumn(_SEQ, F.lit(i))
            out = c if out is None else out.unionByName(c, allowMissingColumns=True)
        if out is None:
            return None
        return out.groupBy(self.store.key).agg(F.max_by(F.struct(*out.columns), _SEQ).alias("x")).select("x.*").drop(_SEQ)

    def read(self) -> DataFrame:
        self._check()
        delta = self._delta()
        if delta is None:
            return self.store.read(self.since)
        new = delta.where(f"not {_GONE}").drop(_GONE)
        if not self.store.segments(self.since):
            return new
        return self.store.read(self.since).join(delta.select(self.store.key), self.store.key, "left_anti").unionByName(new, allowMissingColumns=True)

    def get(self, value) -> DataFrame:
        return self.read().where(F.col(self.store.key) == value)

    def commit(self) -> None:
        self._check()
        delta, self.open = self._delta(), False
        if delta is not None:
            self.store._change(delta, self.since)

    def abort(self) -> None:
        self._check()
        self.open, self.changes = False, []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self.open:
            self.abort() if kind else self.commit()


class Registry:
    """Named stores below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.stores = spark, root.rstrip("/"), {}

    def add(self, name: str, key: str = "id") -> Store:
        if name in self.stores:
            raise ValueError(f"store {name} exists")
        self.stores[name] = Store(self.spark, f"{self.root}/{name}", key)
        return self.stores[name]

    def get(self, name: str) -> Store:
        return self.stores[name]

    def remove(self, name: str) -> bool:
        return self.stores.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.stores)

    def find_anywhere(self, value) -> DataFrame:
        """(store, id) of every store that has the key."""
        parts = [s.get(value).select(F.lit(n).alias("store"), F.col(s.key).cast("string").alias("id")) for n, s in sorted(self.stores.items()) if s.exists()]
        if not parts:
            return self.spark.createDataFrame([], "store string, id string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out


class TieredStore:
    """One store for each tier; a lookup takes the first tier that has the key."""

    def __init__(self, spark: SparkSession, root: str, tiers: tuple[str, ...] = ("active", "recent", "archive"), key: str = "id"):
        self.tiers = list(tiers)
        self.stores = {t: Store(spark, f"{root.rstrip('/')}/{t}", key) for t in tiers}

    def read(self, hint: str | None = None) -> DataFrame:
        order = ([hint] if hint else []) + [t for t in self.tiers if t != hint]
        parts = [self.stores[t].read().withColumn("tier", F.lit(t)) for t in order if self.stores[t].exists()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return first_tier(out, order)

    def promote(self, keys: DataFrame, source: str, target: str) -> None:
        """Copies first, then deletes: a promotion that is cut off leaves a copy in both, and the lookup takes one."""
        rows = self.stores[source].read().join(keys, self.stores[source].key, "left_semi")
        self.stores[target].upsert(rows)
        self.stores[source].delete(keys)


class LogStore:
    """Append-only logs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def query(self, limit: int = 1000, **filters) -> DataFrame:
        """Newest first. Limits from 1 to 10,000; ``since`` with a time zone."""
        if not 1 <= limit <= 10_000:
            raise ValueError("limit must be from 1 to 10000")
        return self.spark.read.parquet(self.path).where(predicates.log_filter(**filters)).orderBy(F.desc("timestamp"), "id").limit(limit)

    def clear(self) -> int:
        """Deletes all; returns how many there were."""
        d = self.spark.read.parquet(self.path)
        n, schema = d.count(), d.schema
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.path)
        return n

    def stats(self) -> DataFrame:
        """(kind, value, n): counts by level, source and context, in one pass over grouping sets."""
        d = self.spark.read.parquet(self.path).select("level", "source", "context")
        g = d.groupingSets([["level"], ["source"], ["context"], []], "level", "source", "context").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
        kind = F.when(F.col("g") == 3, "level").when(F.col("g") == 5, "source").when(F.col("g") == 6, "context").otherwise("total")
        return g.select(kind.alias("kind"), F.coalesce("level", "source", "context").alias("value"), "n")
