"""Ordered (window) computations whose groups may be far larger than one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one
task: with ten currencies, or one sender holding a third of all rows, that task
never ends. Here the ordering value is cut into slices at approximate quantiles
of the whole table, so a (key, slice) cell is at most about one slice long
whatever the key's share. A value repeated so often that it fills slices by
itself is cut further along the tie-break. A key that has few of the rows needs
few cells: up to one slice's worth of rows is one cell, and beyond that as many
slices are joined as the key's share of the rows allows, so the number of cells
follows the rows and not keys times slices. Rows are then windowed per cell,
and what a cell needs from the cells before or after it (counts, sums, edge
rows) comes from one small summary row per cell.

The cuts are constants, so a row's cell is a pure function of the row: a retried
task always puts it into the same cell. One shuffle of the rows, on (key, cell).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..session import lookup_side, stage

ROWS_PER_SLICE = 1_000_000
# Size of the quantile sketches (a rank error of about 0.0001) and how many of them meet in one task.
SKETCH_SIZE, SKETCHES_PER_TASK = 65_535, 32
QUANTILES_PER_CALL = 1_000
# Sub-cells per slice: four hexadecimal digits of the tie-break hash.
SUB = 16 ** 4
# How many slices may be joined in a key. Its cells are as long as a slice where its values are spread as the table's are, and never longer
# than that many slices; repeated values stay apart.
STEPS = (1, 8, 64, 512)


@dataclass(frozen=True)
class Cuts:
    """Where the ordering value is cut; ``repeated`` values are cut again along the tie-break."""

    bounds: tuple[float, ...]
    repeated: tuple[float, ...]
    tie_digits: int
    rows: int = 0

    def every(self, step: int) -> tuple[float, ...]:
        """The bounds when ``step`` slices are joined."""
        return tuple(sorted({*self.bounds[::step], *self.repeated, *map(_after, self.repeated)}))


def _after(value: float) -> float:
    return math.nextafter(value, math.inf)


def plan_cuts(df: DataFrame, value: Column, rows_per_slice: int) -> Cuts:
    """The row count and a bounded list of quantiles of one column; small inputs need no cut."""
    known = F.when(~F.isnan(value), value)
    sketches = df.select(known.alias("_value"), F.spark_partition_id().alias("_part")).groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double("_value", F.lit(SKETCH_SIZE)).alias("_sketch"))
    sketches = stage(sketches, "sketches")
    total, last_part = sketches.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_part"), F.lit(0))).first()
    wanted = -(-total // rows_per_slice)
    if wanted <= 1:
        return Cuts((), (), 0)
    sketch = _merged(sketches, last_part + 1)
    digits = 0
    while digits < 4 and total / 16 ** digits > rows_per_slice:
        digits += 1
    shares = [i / wanted for i in range(1, wanted)]
    quantiles = []
    for at in range(0, len(shares), QUANTILES_PER_CALL):
        ranks = F.array(*map(F.lit, shares[at:at + QUANTILES_PER_CALL]))
        row = sketch.select(F.kll_sketch_get_quantile_double("_sketch", ranks)).first()
        quantiles += row[0] if row else []
    quantiles.sort()
    repeated = sorted({a for a, b in zip(quantiles, quantiles[1:]) if a == b})
    bounds = sorted({*quantiles, *repeated, *(_after(v) for v in repeated)})
    return Cuts(tuple(bounds), tuple(repeated), digits, total)


def _merged(sketches: DataFrame, parts: int) -> DataFrame:
    """One row with the sketch of all values, none without values. A bounded number of sketches meet in a task."""
    while parts > 1:
        parts = -(-parts // SKETCHES_PER_TASK)
        sketches = stage(sketches.withColumn("_part", F.floor(F.col("_part") / SKETCHES_PER_TASK)).groupBy("_part").agg(
            F.kll_merge_agg_double("_sketch").alias("_sketch")), "sketches")
    return sketches.filter(F.col("_sketch").isNotNull() & (F.kll_sketch_get_n_double("_sketch") > 0)).select("_sketch")


class OrderedRows:
    """Rows of ``df`` per ``keys`` in the order (``value``, ``tie``).

    ``tie`` is a hexadecimal hash of the row's identity. Null values come first
    in ascending and last in descending order, as in Spark's default. When ``df``
    is ``base`` with columns added by earlier steps, cuts and summaries are taken
    from ``base``, so that they do not repeat those steps.
    """

    def __init__(self, df: DataFrame, keys: list[str], value: Column, tie: Column, descending: bool = False,
                 rows_per_slice: int = ROWS_PER_SLICE, base: DataFrame | None = None):
        self.keys, self.descending = keys, descending
        # Never null, and used by joins and windows alike, so that one shuffle of the rows serves both.
        self.group = [f"_key{i}" for i in range(len(keys))]
        self.cell = [*self.group, "_cell"]
        value = value.cast("double")
        self.cuts = plan_cuts(df if base is None else base, value, rows_per_slice)
        self.steps = None if self.single else self._steps(df if base is None else base, rows_per_slice)
        self.rows = self._in_cells(df, value, tie)
        self.source = self.rows if base is None else self._in_cells(base, value, tie)
        ordering = F.desc_nulls_last("_value") if descending else F.asc_nulls_first("_value")
        self.order = [ordering, F.asc("_tie")]
        self.peers = Window.partitionBy(*self.cell).orderBy(ordering)
        self.local = Window.partitionBy(*self.cell).orderBy(*self.order)
        self.cells = Window.partitionBy(*self.group).orderBy("_cell")
        self.before = self.cells.rowsBetween(Window.unboundedPreceding, -1)
        self.whole = Window.partitionBy(*self.group)
        self.whole_cell = self.local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def single(self) -> bool:
        """The whole input fits one slice: every key is one cell, and nothing has to be carried between cells."""
        return not self.cuts.bounds and not self.cuts.tie_digits

    def _named(self) -> dict[str, Column]:
        return {name: F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")) for name, key in zip(self.group, self.keys)}

    def _steps(self, df: DataFrame, rows_per_slice: int) -> DataFrame:
        """How many slices are joined in each key that has more rows than one. There are at most as many such keys as slices, so they are broadcast."""
        step = F.lit(STEPS[0])
        for wider in STEPS[1:]:
            step = F.when(F.col("_n") * wider <= self.cuts.rows, wider).otherwise(step)
        counted = df.select(*[c.alias(name) for name, c in self._named().items()]).groupBy(*self.group).agg(F.count(F.lit(1)).alias("_n"))
        return F.broadcast(stage(counted.filter(F.col("_n") > rows_per_slice).select(*self.group, step.alias("_step")), "steps"))

    def _in_cells(self, df: DataFrame, value: Column, tie: Column) -> DataFrame:
        cuts, descending = self.cuts, self.descending
        rows = df.withColumns({"_value": value, "_tie": tie, **self._named()})
        if self.single:
            return rows.withColumn("_cell", F.lit(0).cast("long"))
        rows = rows.join(self.steps, self.group, "left")
        slices = []
        if cuts.bounds:
            piece = F
            for step in STEPS:
                slices.append(f"_slice{step}")
                rows = Bucketizer(splits=[float("-inf"), *cuts.every(step), float("inf")], inputCol="_value",
                                  outputCol=slices[-1], handleInvalid="keep").transform(rows)
                piece = piece.when(F.col("_step") == step, F.col(slices[-1]).cast("long"))
        else:
            piece = F.when(F.col("_value").isNotNull(), F.lit(0).cast("long"))
        piece = F.coalesce(-piece, F.lit(1).cast("long")) if descending else F.coalesce(piece, F.lit(-1).cast("long"))
        sub = F.lit(0).cast("long")
        if cuts.tie_digits:
            spans = F.col("_value").isNull() | F.isnan("_value") | F.col("_value").isin(list(cuts.repeated))
            # A row without an identity comes first among its equals.
            sub = F.when(spans, F.coalesce(F.conv(F.substring("_tie", 1, cuts.tie_digits), 16, 10).cast("long"), sub)).otherwise(sub)
        cell = F.when(F.col("_step").isNotNull(), piece * SUB + sub).otherwise(F.lit(0).cast("long"))
        return rows.withColumn("_cell", cell).drop("_step", *slices)

    def summary(self, *aggregates: Column) -> DataFrame:
        """One row per cell; partial aggregation keeps the shuffle small."""
        return self.source.groupBy(*self.cell).agg(*aggregates)

    def attach(self, summary: DataFrame, label: str) -> DataFrame:
        """Bring a cell's carried values to its rows; broadcast only when the summary was counted to be small."""
        return self.rows.join(lookup_side(summary, label), self.cell)

    def done(self, rows: DataFrame, *more: str) -> DataFrame:
        """Without the inner columns."""
        return rows.drop("_value", "_tie", *self.cell, *more)

    def edges(self, column: str, width: int) -> DataFrame:
        """The first and the last ``width`` values of every cell, in order."""
        def side(name: str, order: list[Column]) -> DataFrame:
            spec = Window.partitionBy(*self.cell).orderBy(*order)
            near = (
                self.source.select(*self.cell, "_value", "_tie", F.col(column).alias("_x"))
                .withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") <= width)
            )
            listed = F.array_sort(F.collect_list(F.struct("_rn", "_x")))
            return near.groupBy(*self.cell).agg(F.transform(listed, lambda e: e["_x"]).alias(name))

        backwards = [F.asc_nulls_last("_value") if self.descending else F.desc_nulls_last("_value"), F.desc("_tie")]
        head, tail = side("_head", self.order), side("_tail", backwards)
        return head.join(tail.withColumn("_tail", F.reverse("_tail")), self.cell)

    def neighbours(self, column: str, width: int) -> DataFrame:
        """Per cell, the ``width`` values just before and just after it; every cell has a row, so ``width`` cells reach far enough."""
        edges = self.edges(column, width)
        empty = F.slice(F.col("_tail"), 1, 0)
        earlier = [F.coalesce(F.lag("_tail", i).over(self.cells), empty) for i in range(width, 0, -1)]
        later = [F.coalesce(F.lead("_head", i).over(self.cells), empty) for i in range(1, width + 1)]
        return edges.select(
            *self.cell,
            F.concat(*earlier).alias("_past"), F.concat(*later).alias("_next"),
        ).select(
            *self.cell,
            F.when(F.size("_past") > width, F.slice("_past", -width, width)).otherwise(F.col("_past")).alias("_past"),
            F.slice("_next", 1, width).alias("_next"),
        )


def rank_columns(df: DataFrame, keys: list[str], value: Column, tie: Column, descending: bool = True,
                 rows_per_slice: int = ROWS_PER_SLICE, base: DataFrame | None = None) -> DataFrame:
    """Add ``row_number``, ``rank``, ``dense_rank`` and ``percent_rank`` of each row within its keys."""
    ordered = OrderedRows(df, keys, value, tie, descending, rows_per_slice, base)
    none = F.lit(0).cast("long")
    if ordered.single:
        rows = ordered.rows.withColumns({"_rows_before": none, "_values_before": none, "_peers_before": none,
                                         "_total": F.count(F.lit(1)).over(ordered.whole_cell)})
    else:
        rows = ordered.attach(_carried_ranks(ordered), "ranks")
    rank = F.col("_peers_before") + F.rank().over(ordered.peers)
    ranked = rows.withColumns({
        "row_number": (F.col("_rows_before") + F.row_number().over(ordered.local)).cast("long"),
        "rank": rank.cast("long"),
        "dense_rank": (F.col("_values_before") + F.dense_rank().over(ordered.peers)).cast("long"),
        "percent_rank": F.when(F.col("_total") > 1, (rank - 1) / (F.col("_total") - 1)).otherwise(0.0),
    })
    return ordered.done(ranked, "_rows_before", "_values_before", "_peers_before", "_total")


def _carried_ranks(ordered: OrderedRows) -> DataFrame:
    """Per cell: rows, distinct values and peers before it, and the rows of its keys."""
    per_value = ordered.source.groupBy(*ordered.cell, "_value").agg(F.count(F.lit(1)).alias("_n"))
    cells = per_value.groupBy(*ordered.cell).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    piece = F.floor(F.col("_cell") / SUB)
    # Peers spread over sub-cells count once: only the first sub-cell of a slice adds distinct values.
    same = Window.partitionBy(*ordered.group, "_piece")
    return (
        cells.withColumn("_piece", piece)
        .withColumn("_lead_cell", F.min("_cell").over(same))
        .withColumn("_d", F.when(F.col("_cell") == F.col("_lead_cell"), F.col("_d")).otherwise(0))
        .withColumn("_rows_before", F.coalesce(F.sum("_n").over(ordered.before), F.lit(0)))
        .withColumn("_values_before", F.coalesce(F.sum("_d").over(ordered.before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(ordered.whole))
        .withColumn("_peers_before", F.min("_rows_before").over(same))
        .withColumn("_values_before", F.min("_values_before").over(same))
        .drop("_piece", "_lead_cell", "_n", "_d")
    )


def row_numbers(df: DataFrame, keys: list[str], value: Column, tie: Column, descending: bool = False,
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``row_number`` and ``group_rows``, the number of rows with the same keys."""
    ordered = OrderedRows(df, keys, value, tie, descending, rows_per_slice)
    if ordered.single:
        rows = ordered.rows.withColumns({
            "_rows_before": F.lit(0), "group_rows": F.count(F.lit(1)).over(ordered.whole_cell)})
    else:
        rows = ordered.attach(
            ordered.summary(F.count(F.lit(1)).alias("_n"))
            .withColumn("_rows_before", F.coalesce(F.sum("_n").over(ordered.before), F.lit(0)))
            .withColumn("group_rows", F.sum("_n").over(ordered.whole)).drop("_n"), "positions")
    number = (F.col("_rows_before") + F.row_number().over(ordered.local)).cast("long")
    return ordered.done(rows.withColumn("row_number", number), "_rows_before")


def running_total(df: DataFrame, keys: list[str], value: Column, tie: Column, amount: Column, name: str,
                  rows_per_slice: int = ROWS_PER_SLICE, group_total: str | None = None) -> DataFrame:
    """Add the sum of ``amount`` over all rows up to and including this one; null until a value was seen.

    ``group_total`` names a further column with the sum over all rows of the keys.
    """
    ordered = OrderedRows(df.withColumn("_amount", amount), keys, value, tie, False, rows_per_slice)
    here = F.sum("_amount").over(ordered.local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if ordered.single:
        rows, both = ordered.rows.withColumns({"_sum_before": F.lit(None), "_sum_all": F.sum("_amount").over(ordered.whole_cell)}), here
    else:
        rows = ordered.attach(
            ordered.summary(F.sum("_amount").alias("_s"))
            .withColumn("_sum_before", F.sum("_s").over(ordered.before))
            .withColumn("_sum_all", F.sum("_s").over(ordered.whole)).drop("_s"), "totals")
        before = F.col("_sum_before")
        both = F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    summed = rows.withColumn(name, both).withColumnRenamed("_sum_all", group_total or "_sum_all")
    return ordered.done(summed, "_sum_before", "_sum_all", "_amount")


def offset_and_running(df: DataFrame, keys: list[str], value: Column, tie: Column, amount: str, total: Column,
                       rows_per_slice: int = ROWS_PER_SLICE, base: DataFrame | None = None) -> DataFrame:
    """Add ``previous``, ``following`` (one row away) and ``running`` in one pass over the cells."""
    base = base if base is None else base.withColumn("_amount", total)
    ordered = OrderedRows(df.withColumn("_amount", total), keys, value, tie, False, rows_per_slice, base)
    local = ordered.local
    here = F.sum("_amount").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if ordered.single:
        return ordered.done(ordered.rows.withColumns({
            "previous": F.lag(amount).over(local), "following": F.lead(amount).over(local), "running": here,
        }), "_amount")
    # A null value is a real neighbour, so edges are kept inside a struct.
    order = F.struct("_value", "_tie")
    cells = ordered.summary(
        F.min_by(F.struct(amount), order).alias("_first"), F.max_by(F.struct(amount), order).alias("_last"),
        F.sum("_amount").alias("_s"), fn.by_hash().alias("_by_hash"),
    ).filter("size(_by_hash) > 0")
    carried = cells.select(
        *ordered.cell,
        F.lag("_last").over(ordered.cells)[amount].alias("_past"),
        F.lead("_first").over(ordered.cells)[amount].alias("_next"),
        F.sum("_s").over(ordered.before).alias("_sum_before"),
    )
    before = F.col("_sum_before")
    is_first = F.row_number().over(local) == 1
    has_next = F.lead(F.lit(1)).over(local).isNotNull()
    moved = (
        ordered.attach(carried, "offsets")
        .withColumns({
            "previous": F.when(is_first, F.col("_past")).otherwise(F.lag(amount).over(local)),
            "following": F.when(has_next, F.lead(amount).over(local)).otherwise(F.col("_next")),
            "running": F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here),
        })
    )
    return ordered.done(moved, "_past", "_next", "_sum_before", "_amount")


def centred_mean(df: DataFrame, keys: list[str], value: Column, tie: Column, amount: Column, name: str,
                 reach: int = 2, digits: int = 2, rows_per_slice: int = ROWS_PER_SLICE,
                 base: DataFrame | None = None) -> DataFrame:
    """Add the mean of ``amount`` (a decimal) over the row and ``reach`` rows on either side, nulls left out."""
    base = base if base is None else base.withColumn("_amount", amount)
    ordered = OrderedRows(df.withColumn("_amount", amount), keys, value, tie, False, rows_per_slice, base)
    local = ordered.local
    frame = local.rowsBetween(-reach, reach)
    kind = df.select(amount).schema[0].dataType.simpleString()
    wide = "decimal(30,8)" if kind.startswith("decimal") else kind

    def mean(total: Column, count: Column) -> Column:
        return F.when(count > 0, F.round(total.cast(wide) / count.cast("decimal(10,0)"), digits).cast("double"))

    if ordered.single:
        return ordered.rows.withColumns({"_sum": F.sum("_amount").over(frame), "_cnt": F.count("_amount").over(frame)}).withColumn(
            name, mean(F.col("_sum"), F.col("_cnt"))).drop("_value", "_tie", *ordered.cell, "_sum", "_cnt", "_amount")
    rows = ordered.attach(ordered.neighbours("_amount", reach), "edges").withColumns({
        "_pos": F.row_number().over(local),
        "_len": F.count(F.lit(1)).over(ordered.whole_cell),
        "_sum": F.sum("_amount").over(frame),
        "_cnt": F.count("_amount").over(frame),
    })
    # Positions missing on the left and on the right of the frame are taken from the neighbouring cells.
    left = F.least(F.greatest(F.lit(reach + 1) - F.col("_pos"), F.lit(0)), F.size("_past"))
    right = F.least(F.greatest(F.col("_pos") + reach - F.col("_len"), F.lit(0)), F.size("_next")).cast("int")
    borrowed = F.concat(
        F.slice("_past", F.size("_past") - left + 1, left), F.slice("_next", F.lit(1), right)
    )
    known = F.filter("_borrowed", lambda x: x.isNotNull())
    extra = F.aggregate(known, F.lit(0).cast(wide), lambda acc, x: (acc + x).cast(wide))
    rows = rows.withColumn("_borrowed", borrowed)
    total = F.coalesce(F.col("_sum").cast(wide), F.lit(0).cast(wide)) + extra
    return ordered.done(rows.withColumn(name, mean(total, F.col("_cnt") + F.size(known))), "_past", "_next", "_pos", "_len", "_sum", "_cnt", "_borrowed", "_amount")


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], interpolate: bool,
              rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exact quantiles per key from the histogram of distinct values and its running count.

    ``interpolate`` follows the linear rule; otherwise the smallest value whose
    cumulative share reaches the probability is taken.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    histogram = stage(counts, "histogram")  # read several times below
    ranked = running_total(histogram, keys, F.col(value), F.lit("0"), F.col("_n"), "_upto", rows_per_slice, "_all")

    def at(position: Column) -> Column:
        """The value that covers a 0-based position of the sorted rows."""
        inside = (F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position)
        return F.max(F.when(inside, F.col(value)))

    picks = []
    for name, p in probabilities.items():
        if interpolate:
            exact = F.lit(p) * (F.col("_all") - 1)
            low = F.floor(exact)
            picks += [at(low).alias(f"_lo_{name}"), at(F.ceil(exact)).alias(f"_hi_{name}"),
                      F.max(exact - low).alias(f"_w_{name}")]
        else:
            picks.append(at(F.greatest(F.ceil(F.lit(p) * F.col("_all")), F.lit(1)) - 1).alias(name))
    result = ranked.groupBy(*keys).agg(*picks)
    if interpolate:
        result = result.select(*keys, *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probabilities])
    return result
