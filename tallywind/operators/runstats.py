"""Run analytics: logs and stage dumps into batch records, batch records into summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as fn
from ..session import lookup_side, stage
from .ordered import ROWS_PER_SLICE, quantiles, row_numbers, running_total

# The log formats, (kind, pattern, names of the groups).
_COMMA_TIME = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3})"
_ZULU_TIME = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+Z)"
LOG_FORMATS = [
    ("alpha_stream", _COMMA_TIME + r".*Batch (\d+): (\d+) rows \| transform (\d+) ms \| delta_write (\d+) ms \| total (\d+) ms",
     ["at", "batch_id", "rows", "transform_ms", "write_ms", "total_ms"]),
    ("beta_stream", _ZULU_TIME + r".*Batch (\d+): (\d+) rows \| transform (\d+)ms \| write (\d+)ms \| total (\d+)ms",
     ["at", "batch_id", "rows", "transform_ms", "write_ms", "total_ms"]),
    ("alpha_account_start", _COMMA_TIME + r".*Batch (\d+): upserting (\d+) account updates", ["at", "batch_id", "rows"]),
    ("alpha_account_end", _COMMA_TIME + r".*Batch (\d+): (\d+) rows \| upsert ([\d.]+) ms", ["at", "batch_id", "rows", "total_ms"]),
    ("beta_account", _ZULU_TIME + r".*Account batch (\d+): (\d+) rows \(deduped\) \| merge (\d+)ms \| total (\d+)ms",
     ["at", "batch_id", "rows", "write_ms", "total_ms"]),
]
MB = 1_048_576


def parse_logs(lines: DataFrame, keep: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One record per recognised line; the first fitting format wins and other lines are dropped. One pass, no shuffle."""
    kind = F
    for name, pattern, _ in LOG_FORMATS:
        kind = kind.when(F.col("value").rlike(pattern), name)
    rows = lines.withColumn("kind", kind.otherwise(None)).filter(F.col("kind").isNotNull())

    def field(name: str) -> Column:
        found = F
        for k, pattern, names in LOG_FORMATS:
            if name in names:
                found = found.when(F.col("kind") == k, F.regexp_extract("value", pattern, names.index(name) + 1))
        return found.otherwise(None)

    at = fn.event_time(F.replace(field("at"), F.lit(","), F.lit(".")))
    number = {n: field(n).cast("double") for n in ("transform_ms", "write_ms", "total_ms")}
    upsert = F.col("kind") == "alpha_account_end"
    return rows.select(
        *keep, "kind", at.alias("at"), field("batch_id").cast("long").alias("batch_id"), field("rows").cast("long").alias("rows"),
        F.coalesce(number["transform_ms"], F.when(F.col("kind") != "alpha_account_start", 0.0)).alias("transform_ms"),
        F.when(upsert, number["total_ms"]).otherwise(number["write_ms"]).alias("write_ms"), number["total_ms"].alias("total_ms"))


def paired_batches(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Account batches from their start and end lines. The newest start line counts, and its row count wins over the end line's."""
    starts = records.filter(F.col("kind") == "alpha_account_start").groupBy(run, "batch_id").agg(
        F.max_by(F.struct("at", "rows"), F.struct("at", "rows")).alias("_start"))
    ends = records.filter(F.col("kind") == "alpha_account_end").drop("kind")
    return ends.join(starts, [run, "batch_id"], "left").select(
        run, "batch_id", F.coalesce("_start.rows", "rows").alias("rows"), "transform_ms", "write_ms", "total_ms",
        F.col("_start.at").alias("started_at"), F.col("at").alias("completed_at"))


def batch_records(metrics: DataFrame, *more: str) -> DataFrame:
    """Batch metrics, of a fixture or of a stream's own table, in the shape of log records, with any further columns named."""
    at = F.col("completed_at") if isinstance(metrics.schema["completed_at"].dataType, T.TimestampType) else fn.event_time(F.col("completed_at"))
    return metrics.select("run_id", *more, "batch_id", "rows", "transform_ms", "write_ms", F.col("wall_ms").alias("total_ms"), at.alias("completed_at"))


def logged_records(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Batch records from parsed logs: the stream lines as they are, and the account batches of the first engine from their paired lines."""
    kept = [run, "kind", "batch_id", "rows", "transform_ms", "write_ms", "total_ms", "completed_at"]
    single = records.filter(~F.col("kind").startswith("alpha_account")).withColumnRenamed("at", "completed_at").select(*kept)
    return single.unionByName(paired_batches(records, run).withColumn("kind", F.lit("alpha_account")).select(*kept))


def summary(records: DataFrame, *keys: str) -> DataFrame:
    """Counts, averages, cumulative and wall-clock time and throughput per key."""
    seconds = F.unix_micros("completed_at") / 1e6
    span = F.when(F.count("completed_at") >= 2, F.max(seconds) - F.min(seconds)).when(
        F.count(F.lit(1)) == 1, F.max("total_ms") / 1000.0).otherwise(0.0)
    total, rows = F.sum("total_ms"), F.sum("rows")
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batches"), rows.alias("rows"),
        F.round(F.avg("total_ms"), 4).alias("avg_total_ms"), F.round(F.avg("transform_ms"), 4).alias("avg_transform_ms"),
        F.round(F.avg("write_ms"), 4).alias("avg_write_ms"), total.alias("cumulative_total_ms"),
        F.round(span, 3).alias("wall_clock_seconds"),
        F.round(F.when(total > 0, rows / (total / 1000.0)).otherwise(0.0), 4).alias("throughput_rows_per_sec"))


def near_full(records: DataFrame, run: str = "run_id", share: float = 0.97) -> DataFrame:
    """Batches with at least the given share of their run's largest batch."""
    limits = records.groupBy(F.col(run).alias("_run")).agg(F.floor(F.max("rows") * F.lit(share)).alias("_least"))
    side = lookup_side(limits, "limits")
    return records.join(side, (F.col(run) == F.col("_run")) & (F.col("rows") >= F.col("_least"))).drop("_run", "_least")


def aligned_prefix(records: DataFrame, target: Column, run: str = "run_id", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The shortest run of first batches that reaches ``target`` rows; its last batch is dropped when stopping before it comes closer.

    ``target`` may use ``_all``, the rows of the whole run.
    """
    records = stage(records, "records")  # read several times
    counted = running_total(records, [run], F.col("batch_id"), F.md5(F.col("batch_id").cast("string")), F.col("rows"), "_upto",
                            rows_per_slice, "_all").withColumn("_target", target)
    before = F.col("_upto") - F.col("rows")
    overshoots = (F.col("_upto") >= F.col("_target")) & (F.col("_target") - before < F.col("_upto") - F.col("_target"))
    return counted.filter((before < F.col("_target")) & ~overshoots).drop("_upto", "_all", "_target")


def speed_up(a: Column, b: Column, lower_is_better: bool, names: tuple[str, str]) -> tuple[Column, Column]:
    """Ratio text and winner of two figures: ``-`` and a tie when one is not positive."""
    known = (a > 0) & (b > 0)
    ratio = F.when(~known, "-").otherwise(F.format_string("%.1fx", F.greatest(a, b).cast("double") / F.least(a, b)))
    first_wins = (a < b) if lower_is_better else (a > b)
    winner = F.when(~known | (a == b), "Tie").when(first_wins, names[0]).otherwise(names[1])
    return ratio, winner


COMPARED = {"avg_total_ms": True, "avg_transform_ms": True, "avg_write_ms": True, "wall_clock_seconds": True, "throughput_rows_per_sec": False}


def compare_engines(summaries: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two engines' summaries side by side, one row per metric."""
    long = summaries.unpivot(["engine"], [F.col(m).cast("double").alias(m) for m in COMPARED], "metric", "value")
    sides = long.groupBy("metric").pivot("engine", list(names)).agg(F.first("value"))
    a, b = F.col(names[0]), F.col(names[1])
    lower = F.col("metric").isin([m for m, low in COMPARED.items() if low])
    pairs = {low: speed_up(a, b, low, names) for low in (True, False)}
    return sides.select("metric", a, b, pairs[True][0].alias("ratio"),
                        F.when(lower, pairs[True][1]).otherwise(pairs[False][1]).alias("winner"))


def spaced_times(records: DataFrame, first: Column, last: Column, run: str = "run_id", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Evenly spaced instants (epoch seconds) for batches without one, between a run's first and last update; a single batch gets the last."""
    records = stage(records, "records")  # read several times
    numbered = row_numbers(records, [run], F.col("batch_id"), F.md5(F.col("batch_id").cast("string")), False, rows_per_slice)
    i, n = F.col("row_number") - 1, F.col("group_rows")
    at = F.when(n == 1, last.cast("double")).otherwise(first + (last - first) * i / (n - 1))
    return numbered.withColumn("completed_epoch", F.round(at, 3)).drop("row_number", "group_rows")


def spread_rows(records: DataFrame, total: Column, run: str = "run_id", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """A run's total row count divided over its batches; the first ones take the remainder."""
    records = stage(records, "records")  # read several times
    numbered = row_numbers(records, [run], F.col("batch_id"), F.md5(F.col("batch_id").cast("string")), False, rows_per_slice)
    base = F.floor(total / F.col("group_rows"))
    extra = F.when(F.col("row_number") <= total - base * F.col("group_rows"), 1).otherwise(0)
    return numbered.withColumn("rows", base + extra).drop("row_number", "group_rows")


def distribution(records: DataFrame, metrics: list[str], run: str = "run_id", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Minimum, interpolated quantiles, maximum and mean of several metrics."""
    long = records.unpivot([run], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    middle = quantiles(long, [run, "metric"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, True, rows_per_slice)
    ends = long.groupBy(run, "metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"))
    return ends.join(middle, [run, "metric"]).select(
        run, "metric", "min", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")], "max", F.round("avg", 4).alias("avg"))


_LONGS = ["inputRecords", "outputRecords", "executorRunTime", "executorCpuTime", "jvmGcTime", "inputBytes", "outputBytes", "shuffleReadBytes",
          "shuffleReadRecords", "shuffleWriteBytes", "shuffleWriteRecords", "numCompleteTasks", "peakExecutionMemory", "stageId"]
_EXECUTOR_LONGS = ["totalCores", "totalTasks", "totalGCTime", "totalDuration", "totalInputBytes", "totalOutputBytes", "totalShuffleRead",
                   "totalShuffleWrite", "maxMemory"]


def _list_of(*fields: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("value", T.ArrayType(T.StructType(list(fields))))])


DUMP = T.StructType([
    T.StructField("stages", _list_of(*[T.StructField(f, T.LongType()) for f in _LONGS],
                                     *[T.StructField(f, T.StringType()) for f in ("description", "name", "status")])),
    T.StructField("executors", _list_of(*[T.StructField(f, T.LongType()) for f in _EXECUTOR_LONGS], T.StructField("id", T.StringType()),
                                        T.StructField("peakMemoryMetrics", T.StructType([T.StructField("JVMHeapMemory", T.LongType())])))),
])


def stages(dumps: DataFrame, run: str = "run_id") -> DataFrame:
    return dumps.select(run, F.inline("stages.value"))


def executors(dumps: DataFrame, run: str = "run_id") -> DataFrame:
    return dumps.select(run, F.inline("executors.value"))


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _mb(value: Column, digits: int = 2) -> Column:
    return F.round(value / MB, digits)


def _share(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 1)


def batches_from_stages(stage_rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Micro-batch metrics: the stages whose description (or else name) names the batch, summed."""
    label = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("name"), F.lit(""))
    number = F.regexp_extract(label, r"(?i)batch\s*=\s*(\d+)", 1)
    tagged = stage_rows.withColumn("_batch", number).filter(F.col("_batch") != "")
    run_ms, cpu_ms = _sum("executorRunTime"), _sum("executorCpuTime") / 1e6
    return tagged.groupBy(run, F.col("_batch").cast("long").alias("batch_id")).agg(
        _sum("inputRecords").alias("rows"), run_ms.alias("wall_ms"), F.round(cpu_ms, 1).alias("cpu_ms"),
        F.round(F.greatest(run_ms - cpu_ms, F.lit(0.0)), 1).alias("write_ms"), _sum("jvmGcTime").alias("gc_ms"),
        _share(cpu_ms, run_ms).alias("cpu_util_pct"), _share(_sum("jvmGcTime"), run_ms).alias("gc_pct"),
        _mb(_sum("inputBytes")).alias("input_mb"), _mb(_sum("outputBytes")).alias("output_mb"),
        _mb(_sum("shuffleReadBytes")).alias("shuffle_read_mb"), _mb(_sum("shuffleWriteBytes")).alias("shuffle_write_mb"),
        _mb(F.coalesce(F.max("peakExecutionMemory"), F.lit(0))).alias("peak_memory_mb"), _sum("numCompleteTasks").alias("tasks"))


def executor_summary(executor_rows: DataFrame, run: str = "run_id", with_driver: bool = True) -> DataFrame:
    """Totals over a run's executors. The driver never counts as cores; ``with_driver=False`` leaves it out everywhere."""
    rows = executor_rows if with_driver else executor_rows.filter(F.col("id") != "driver")
    cores = F.coalesce(F.sum(F.when(F.col("id") != "driver", F.col("totalCores"))), F.lit(0))
    return rows.groupBy(run).agg(
        cores.alias("active_cores"), _sum("totalTasks").alias("total_tasks"), _sum("totalGCTime").alias("total_gc_ms"),
        _share(_sum("totalGCTime"), _sum("totalDuration")).alias("gc_pct"), _sum("totalDuration").alias("total_duration_ms"),
        _mb(F.max("peakMemoryMetrics.JVMHeapMemory")).alias("peak_memory_mb"), _mb(_sum("maxMemory")).alias("max_memory_mb"),
        _mb(_sum("totalInputBytes")).alias("total_input_mb"), _mb(_sum("totalOutputBytes")).alias("total_output_mb"),
        _mb(_sum("totalShuffleRead")).alias("total_shuffle_read_mb"), _mb(_sum("totalShuffleWrite")).alias("total_shuffle_write_mb"))


def new_stages(stage_rows: DataFrame, last_seen: int, run: str = "run_id") -> DataFrame:
    """What the stages completed since ``last_seen`` add up to."""
    fresh = stage_rows.filter((F.col("stageId") > last_seen) & (F.col("status") == "COMPLETE"))
    run_ms, cpu_ms = _sum("executorRunTime"), _sum("executorCpuTime") / 1e6
    return fresh.groupBy(run).agg(
        F.max("stageId").alias("last_stage_id"), F.count(F.lit(1)).alias("stages_count"), _sum("numCompleteTasks").alias("tasks"),
        run_ms.alias("executor_run_ms"), F.round(cpu_ms, 1).alias("cpu_ms"), _share(cpu_ms, run_ms).alias("cpu_util_pct"),
        _sum("jvmGcTime").alias("gc_ms"), _share(_sum("jvmGcTime"), run_ms).alias("gc_pct"),
        _mb(_sum("inputBytes")).alias("input_mb"), _sum("inputRecords").alias("input_records"),
        _mb(_sum("outputBytes")).alias("output_mb"), _sum("outputRecords").alias("output_records"),
        _mb(_sum("shuffleReadBytes")).alias("shuffle_read_mb"), _sum("shuffleReadRecords").alias("shuffle_read_records"),
        _mb(_sum("shuffleWriteBytes")).alias("shuffle_write_mb"), _sum("shuffleWriteRecords").alias("shuffle_write_records"),
        _mb(F.max("peakExecutionMemory"), 1).alias("peak_execution_memory_mb"))


def cost(summaries: DataFrame, cores: int = 4, per_core_hour: float = 0.752) -> DataFrame:
    """Compute hours, cost, utilisation and idle time from run summaries."""
    wall, busy = F.col("wall_clock_seconds"), F.col("cumulative_total_ms") / 1000.0
    hours = wall / 3600.0 * cores
    price = hours * per_core_hour
    return summaries.select(
        *[c for c in ("run_id", "engine") if c in summaries.columns], "rows", F.round(hours, 4).alias("compute_hours"), F.round(price, 4).alias("estimated_cost"),
        F.round(F.when(F.col("rows") > 0, price / F.col("rows") * 1_000_000), 4).alias("cost_per_million_rows"),
        F.round(F.when(wall > 0, F.least(busy / wall * 100, F.lit(100.0))), 2).alias("utilization_pct"),
        F.round(F.greatest(wall - busy, F.lit(0.0)), 3).alias("idle_seconds"))


# Figures that a source of measurements may lack; they are null then.
RESOURCES = ["cpu_ms", "gc_ms", "cpu_util_pct", "peak_memory_mb", "shuffle_read_mb", "shuffle_write_mb", "tasks"]


def _with_resources(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({c: F.lit(None).cast("double") for c in RESOURCES if c not in metrics.columns})


def engine_statistics(metrics: DataFrame, *keys: str) -> DataFrame:
    """Totals and per-batch averages; reading the source is what neither transform nor write accounts for."""
    metrics = _with_resources(metrics)
    wall, transform, write, n = F.sum("wall_ms"), F.sum("transform_ms"), F.sum("write_ms"), F.count(F.lit(1))
    source = F.greatest(wall - transform - write, F.lit(0))
    gc = F.sum("gc_ms")
    return metrics.groupBy(*keys).agg(
        n.alias("n_batches"), F.sum("rows").alias("total_rows"), wall.alias("total_wall_ms"), transform.alias("total_transform_ms"),
        write.alias("total_write_ms"), source.alias("total_source_ms"), F.round(wall / n, 4).alias("avg_batch_ms"),
        F.round(transform / n, 4).alias("avg_transform_ms"), F.round(write / n, 4).alias("avg_write_ms"), F.round(source / n, 4).alias("avg_source_ms"),
        F.round(F.avg("cpu_util_pct"), 3).alias("avg_cpu_util"), F.round(F.avg("peak_memory_mb"), 3).alias("avg_peak_mem_mb"),
        gc.alias("total_gc_ms"), F.round(F.when(wall > 0, gc / wall * 100).otherwise(0.0), 4).alias("gc_pct"),
        F.round(F.sum("shuffle_read_mb"), 2).alias("total_shuffle_read_mb"), F.round(F.sum("shuffle_write_mb"), 2).alias("total_shuffle_write_mb"),
        F.max("tasks").alias("active_cores"), F.sum("tasks").alias("total_tasks"),
        F.round(F.when(wall > 0, F.sum("rows") / (wall / 1000.0)).otherwise(0.0), 4).alias("throughput_rows_sec"))


def time_shares(metrics: DataFrame, *keys: str) -> DataFrame:
    """How time divides between transform and write, and the averages of the resource figures."""
    metrics = _with_resources(metrics)
    wall = F.greatest(F.sum("wall_ms"), F.lit(1))
    rows, peak = F.avg("rows"), F.avg("peak_memory_mb")
    return metrics.groupBy(*keys).agg(
        F.round(F.sum("transform_ms") / wall * 100, 2).alias("transform_pct"), F.round(F.sum("write_ms") / wall * 100, 2).alias("write_pct"),
        F.round(F.avg("cpu_ms"), 3).alias("avg_cpu_ms"), F.round(F.avg("gc_ms"), 3).alias("avg_gc_ms"),
        F.round(F.avg("gc_ms") / F.greatest(F.avg("cpu_ms"), F.lit(1.0)) * 100, 3).alias("gc_pct_of_cpu"),
        F.round(F.avg("shuffle_read_mb"), 3).alias("avg_shuffle_read_mb"), F.round(F.avg("shuffle_write_mb"), 3).alias("avg_shuffle_write_mb"),
        F.round(peak, 3).alias("avg_peak_memory_mb"),
        F.round(rows / F.greatest(F.avg("wall_ms"), F.lit(1.0)) * 1000, 2).alias("rows_per_sec"),
        F.round(F.when(peak > 0, rows / F.greatest(peak, F.lit(1.0)) * 1000), 2).alias("rows_per_gb"))


def waterfall(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """Average latency per stage as rows; end to end runs from a batch's first source event to its commit."""
    latency = (F.unix_micros(fn.event_time(F.col("completed_at"))) - F.unix_micros(fn.event_time(F.col("started_at")))) / 1000
    means = metrics.groupBy(run).agg(
        F.round(F.avg(F.greatest(F.col("wall_ms") - F.col("transform_ms") - F.col("write_ms"), F.lit(0))), 3).alias("source"),
        F.round(F.avg("transform_ms"), 3).alias("transform"), F.round(F.avg("write_ms"), 3).alias("write"),
        F.round(F.avg(latency), 3).alias("end_to_end"))
    return means.unpivot([run], ["source", "transform", "write", "end_to_end"], "stage", "avg_ms")


def richer_source(live: DataFrame, dump: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run, the source with more micro-batches; the live one when both have as many."""
    counted = live.groupBy(run).agg(F.count(F.lit(1)).alias("live")).join(
        dump.groupBy(run).agg(F.count(F.lit(1)).alias("dump")), run, "full_outer")
    a, b = F.coalesce("live", F.lit(0)), F.coalesce("dump", F.lit(0))
    return counted.select(run, F.when(a >= b, "live").otherwise("dump").alias("source"), F.greatest(a, b).alias("batches"))
