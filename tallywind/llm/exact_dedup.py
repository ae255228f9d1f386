"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition becomes a run of (digest, smallest row, count). Runs meet in rounds, ``fan_in`` at a time: round r groups by
(digest, run / fan_in^r), so a digest that a third of all rows share is first reduced inside its partition and then met by at most
``fan_in`` rows per round; no task sees more than one row of it from each run. What the last round decides is handed back down the
same tree, so the join of the documents with it is as even as the input.

Texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` became one space. A digest is the SHA-256 of the normalised text,
verified by an independent 64-bit hash and the length, which are part of the merged key. Null texts count as empty, empty texts equal
each other. The row with the smallest ``doc_id`` stays (null ids after all others; of repeated rows with that id exactly one). An
empty table gives an empty result; other columns are carried or ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.session import stage

FAN_IN = 8
KEY = ["digest", "proof", "chars"]


def normalized_text(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _fingerprints(docs: DataFrame, row) -> DataFrame:
    norm = F.col("norm")
    return (docs.select(F.col("doc_id"), row.alias("row"), normalized_text().alias("norm"))
            .select("doc_id", "row", F.unhex(F.sha2(norm, 256)).alias("digest"), F.xxhash64(norm).alias("proof"),
                    F.length(norm).alias("chars"), F.spark_partition_id().alias("run")))


def _runs(rows: DataFrame) -> DataFrame:
    """One row per digest and run: the smallest row and how many there are."""
    return rows.groupBy(*KEY, "run").agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def resolve(prints: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``prints`` with ``keep`` (the row that stays) and ``group_size``."""
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    levels = [stage(_runs(prints.select(*KEY, "run", least.alias("least"), F.lit(1).cast("long").alias("n"))).sortWithinPartitions("digest"), "runs")]
    width = (prints.agg(F.max("run")).first()[0] or 0) + 1
    while width > 1:
        parents = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        levels.append(stage(_runs(parents).sortWithinPartitions("digest"), "runs"))
        width = -(-width // fan_in)
    decided = levels.pop().select(*KEY, F.col("run").alias("parent"), F.col("least").alias("keep"), F.col("n").alias("group_size"))
    while levels:
        below = levels.pop().select(*KEY, F.col("run").alias("own"), F.floor(F.col("run") / fan_in).cast("int").alias("parent"))
        decided = below.join(decided, [*KEY, "parent"]).select(*KEY, F.col("own").alias("parent"), "keep", "group_size")
    return prints.join(decided.withColumnRenamed("parent", "run"), [*KEY, "run"])


def exact_groups(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    prints = stage(_fingerprints(docs, F.monotonically_increasing_id()), "digests")
    return resolve(prints, fan_in).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def row_identity():
    """Digest of a row's id and text: the same whenever it is computed, so the texts need not be written to be found again."""
    return F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text")), 256))


def rows_of(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identity is in ``stay`` (column ``row``), one of each; the texts are shuffled once."""
    found = docs.withColumn("_tallywind_row", row_identity()).join(stay.withColumnRenamed("row", "_tallywind_row"), "_tallywind_row", "left_semi")
    return found.dropDuplicates(["_tallywind_row"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_copies(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    prints = stage(_fingerprints(docs, row_identity()), "digests")
    return rows_of(docs, stage(resolve(prints, fan_in).filter(F.col("row") == F.col("keep.row")).select("row"), "staying"))
