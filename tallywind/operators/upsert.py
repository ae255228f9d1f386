"""The account table: in-batch aggregation, merge, and a versioned table that absorbs batches exactly once.

Parquet has no MERGE. Each micro-batch is reduced to one row per account and
appended as a delta, so a batch costs what it touches and not what the table
holds; the current state is the fold of snapshot and deltas, and every few
batches a compaction merges the deltas into the snapshot. The snapshot is divided
into buckets by a hash of the account, and a compaction reads and rewrites only
those that the deltas meet.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as fn
from ..sources.schemas import ACCOUNT
from ..sources.tables import balanced
from .profile import files

SNAPSHOT_FIELDS = ["balance", "account_status", "risk_rating", "kyc_level"]
TOTALS = ["total_sent", "total_received"]
MERGED = [*SNAPSHOT_FIELDS, *TOTALS, "transaction_count", "last_transaction_time", "updated_at"]
FIXED_FIELDS = [f for f in ACCOUNT.fieldNames() if f not in MERGED and f != "account_id"]
EPOCH = "1970-01-01"


def batch_totals(events: DataFrame) -> DataFrame:
    """Sums, count and newest times per account of one batch."""
    return events.groupBy("account_id").agg(*_total_columns())


def _total_columns() -> list[Column]:
    return [
        *[fn.money_sum(F.col(c)).alias(c) for c in TOTALS],
        F.count(F.lit(1)).alias("transaction_count"),
        F.max("updated_at").alias("updated_at"),
        F.max("last_transaction_time").alias("last_transaction_time"),
    ]


def batch_source(events: DataFrame) -> DataFrame:
    """One merge row per account: the batch totals and the fields of the newest event, in a single aggregate.

    Among events with the same time the highest ``event_id`` wins, or a hash of the row where there is no id.
    """
    tie = F.col("event_id") if "event_id" in events.columns else F.xxhash64(*events.columns)
    newest = F.max_by(F.struct(*FIXED_FIELDS, *SNAPSHOT_FIELDS), F.struct(F.col("updated_at"), tie))
    return (
        events.groupBy("account_id").agg(*_total_columns(), newest.alias("_newest"), fn.by_hash().alias("_by_hash"))
        .filter("size(_by_hash) > 0").select("*", "_newest.*")
        .select(*ACCOUNT.fieldNames())
    )


def _plus(a: Column, b: Column) -> Column:
    return (F.coalesce(fn.money(a), F.lit(0)) + F.coalesce(fn.money(b), F.lit(0))).cast("double")


def merge(target: DataFrame, source: DataFrame, event_time_guard: bool = False) -> DataFrame:
    """Matched rows add totals and take the snapshot fields of the source; other source rows are inserted.

    With ``event_time_guard`` a source older than the target leaves the snapshot fields alone.
    """
    t, s = target.alias("t"), source.alias("s")
    both = F.col("t.account_id").isNotNull() & F.col("s.account_id").isNotNull()
    fresh = F.lit(True) if not event_time_guard else F.coalesce(F.col("s.updated_at") >= F.col("t.updated_at"), F.lit(True))

    def pick(name: str, matched: Column) -> Column:
        return F.when(both, matched).when(F.col("t.account_id").isNull(), F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name)

    columns = []
    for name in ACCOUNT.fieldNames():
        old, new = F.col(f"t.{name}"), F.col(f"s.{name}")
        if name == "account_id":
            columns.append(F.coalesce(old, new).alias(name))
        elif name in TOTALS:
            columns.append(pick(name, _plus(old, new)))
        elif name == "transaction_count":
            columns.append(pick(name, F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))))
        elif name == "last_transaction_time":
            columns.append(pick(name, F.greatest(F.coalesce(old, F.lit(EPOCH)), F.coalesce(new, F.lit(EPOCH)))))
        elif name in SNAPSHOT_FIELDS or name == "updated_at":
            columns.append(pick(name, F.when(fresh, new).otherwise(old)))
        else:
            columns.append(pick(name, old))
    return t.join(s, F.col("t.account_id") == F.col("s.account_id"), "full_outer").select(*columns)


def fold(batches: DataFrame, event_time_guard: bool = False) -> DataFrame:
    """Merge any number of per-batch rows (with ``batch_id``) in one aggregate; the same result as merging in order."""
    several = F.count(F.lit(1)) > 1
    by_batch = F.struct("updated_at", "batch_id") if event_time_guard else F.col("batch_id")
    last = F.max_by(F.struct(*SNAPSHOT_FIELDS, "updated_at"), by_batch).alias("_last")
    first = F.min_by(F.struct(*FIXED_FIELDS), "batch_id").alias("_first")
    totals = [F.when(several, F.coalesce(F.sum(fn.money(F.col(c))), F.lit(0))).otherwise(F.sum(fn.money(F.col(c))))
              .cast("double").alias(c) for c in TOTALS]
    seen = F.when(several, F.max(F.coalesce("last_transaction_time", F.lit(EPOCH)))).otherwise(F.max("last_transaction_time"))
    return batches.groupBy("account_id").agg(
        *totals, F.sum("transaction_count").alias("transaction_count"), seen.alias("last_transaction_time"), last, first,
    ).select("*", "_last.*", "_first.*").select(*ACCOUNT.fieldNames())


COMMIT = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("batch_id", T.LongType()), T.StructField("base_version", T.LongType()),
    T.StructField("operation", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("committed_at", T.TimestampType()),
    # The deltas on top of the base, and the last batch of every stream: the newest commit is all that a reader or a replay guard needs.
    T.StructField("deltas", T.ArrayType(T.LongType())), T.StructField("last_batches", T.MapType(T.StringType(), T.LongType())),
])
STORED = T.StructType([
    *[T.StructField(f.name, T.LongType() if f.name == "transaction_count" else f.dataType) for f in ACCOUNT.fields],
])


class AccountTable:
    """Snapshots, deltas and commits below one path; a version becomes visible with its commit row.

    A bucket's state is the newest committed snapshot version that has a folder for it. The number of buckets is that of the first
    snapshot, whatever is asked for later.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16, event_time_guard: bool = False, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.compact_every, self.event_time_guard, self.buckets = compact_every, event_time_guard, buckets
        self._opened = False

    def commits(self) -> DataFrame | None:
        """The commit log, or nothing before the first commit."""
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.path}/_commits/*")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise

    def _open(self) -> None:
        """Make sure that there is a log to look at."""
        if not self._opened:
            self.spark.createDataFrame([], COMMIT).write.mode("ignore").parquet(f"{self.path}/_commits/none")
            self._opened = True

    def head(self):
        log = self.commits()
        return log.orderBy(F.desc("version")).first() if log is not None else None

    def _commit(self, version: int, batch_id: int, base: int, operation: str, rows: int, deltas: list[int], last: dict[str, int]) -> None:
        """Make a version visible. A version that another writer took is refused, never replaced."""
        row = (version, batch_id, base, operation, rows, datetime.now(timezone.utc), deltas, last)
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/_commits/version={version:012d}")

    def _deltas(self, versions: list[int]) -> DataFrame:
        """Only the folders of these versions are listed; they are few, for a compaction absorbs them."""
        folders = [f"{self.path}/deltas/version={v}" for v in versions]
        stored = T.StructType([*STORED.fields, T.StructField("version", T.LongType())])
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/deltas").parquet(*folders).withColumnRenamed("version", "batch_id")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("account_id"), F.lit(self.buckets)).cast("int")

    def _bases(self, base_version: int) -> dict[int, int]:
        """The snapshot version of every bucket as of ``base_version``; folders of versions that no compaction committed do not count."""
        if base_version < 0:
            return {}
        made = self.commits().filter((F.col("operation") == "COMPACT") & (F.col("version") <= base_version)).select("version")
        names = files(self.spark, f"{self.path}/snapshots").select("folder").distinct()
        part = lambda name: F.regexp_extract("folder", f"{name}=(\\d+)", 1).cast("long")
        newest = names.select(part("of").alias("of"), part("v").alias("version"), part("bucket").alias("bucket")).join(made, "version").groupBy(
            "of", "bucket").agg(F.max("version").alias("version")).collect()  # one row per bucket
        self.buckets = newest[0]["of"]
        return {r["bucket"]: r["version"] for r in newest}

    def _snapshot(self, bases: dict[int, int]) -> DataFrame:
        """The stored rows of the given buckets."""
        if not bases:
            return self.spark.createDataFrame([], STORED)
        top = f"{self.path}/snapshots"
        folders = [f"{top}/of={self.buckets}/v={version:012d}/bucket={bucket}" for bucket, version in bases.items()]
        return self.spark.read.schema(STORED).option("basePath", top).parquet(*folders).select(*STORED.fieldNames())

    def _met(self, batches: DataFrame) -> set[int]:
        """The buckets that some batches have rows for."""
        return {r["bucket"] for r in batches.select(self._bucket().alias("bucket")).distinct().collect()}

    def current(self) -> DataFrame:
        """The table as of the last commit; only buckets with deltas are folded."""
        head = self.head()
        if head is None:
            return self.spark.createDataFrame([], STORED)
        bases = self._bases(head.base_version)
        if not head.deltas:
            return self._snapshot(bases)
        batches = self._deltas(head.deltas)
        if not bases:
            return fold(batches, self.event_time_guard)
        met = self._met(batches)
        old = self._snapshot({b: v for b, v in bases.items() if b in met}).withColumn("batch_id", F.lit(-1).cast("long"))
        return fold(old.unionByName(batches), self.event_time_guard).unionByName(self._snapshot({b: v for b, v in bases.items() if b not in met}))

    def apply(self, events: DataFrame, batch_id: int, stream: str = "direct") -> int | None:
        """Take in one micro-batch of a stream and return its number of events.

        A batch that this stream committed before is skipped (``None``), so a replay changes nothing; one without events commits nothing.
        Batches count up within a stream; the merge order is the order of the commits.
        """
        self._open()
        head = self.head()
        last = dict(head.last_batches) if head else {}
        if batch_id <= last.get(stream, -1):
            return None
        version, counted = head.version + 1 if head else 0, Observation()
        # Counted in the stage that commits the files, so a task that ran twice counts once.
        rows = batch_source(events).observe(counted, F.count(F.lit(1)).alias("accounts"), F.sum("transaction_count").alias("events"))
        rows.write.mode("overwrite").parquet(f"{self.path}/deltas/version={version}")
        accounts, absorbed = counted.get.get("accounts", 0), counted.get.get("events") or 0
        if not accounts:
            return 0
        deltas = [*(head.deltas if head else []), version]
        self._commit(version, batch_id, head.base_version if head else -1, "MERGE" if head else "CREATE", accounts, deltas, {**last, stream: batch_id})
        if len(deltas) >= self.compact_every:
            self.compact()
        return absorbed

    def compact(self) -> list[int]:
        """Merge all deltas since the last snapshot into the buckets they meet; returns those."""
        head = self.head()
        if head is None or not head.deltas:
            return []
        bases = self._bases(head.base_version)
        batches = self._deltas(head.deltas)
        met = self._met(batches)
        state = fold(batches, self.event_time_guard)
        known = {b: v for b, v in bases.items() if b in met}
        if known:
            state = merge(self._snapshot(known), state, self.event_time_guard)
        version, counted = head.version + 1, Observation()
        dealt = balanced(state.withColumn("bucket", self._bucket()), ["bucket"]).observe(counted, F.count(F.lit(1)).alias("accounts"))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshots/of={self.buckets}/v={version:012d}")
        self._commit(version, head.batch_id, version, "COMPACT", counted.get["accounts"], [], dict(head.last_batches))
        return sorted(met)
