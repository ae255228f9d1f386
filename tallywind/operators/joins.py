"""Lookup, semi, anti and self joins. A lookup side that is small is broadcast; a larger one is preceded by a bitmap of its keys, so
that only rows of the other side that may have a partner are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..session import Lookup, lookup
from .aggregates import risky_senders

# A Bloom filter of 2^27 bits and two hashes: 4,096 rows of 512 words, 16 MB whatever the table. Up to ``BITMAP_KEYS`` keys it lets
# at most five in a hundred strangers through; for more keys it is left out.
BITMAP_BITS, ROW_BITS, BITMAP_KEYS = 1 << 27, 1 << 15, 16_000_000


def _positions(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BITMAP_BITS)) for seed in (1, 2)]


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """``_row, _words``: the rows of the filter in which some key has a bit."""
    bits = keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key)))).alias("_at"))
    words = bits.groupBy(F.expr("_at div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_at % 64 AS INT))")).alias("_bits"))
    per_row = words.groupBy(F.expr(f"_word div {ROW_BITS // 64}").alias("_row")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("_word") % (ROW_BITS // 64)).alias("w"), "_bits"))).alias("_set"))  # at most 512 words
    listed = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(ROW_BITS // 64 - 1).cast("long")), lambda w: F.coalesce(F.element_at("_set", w), F.lit(0).cast("long")))
    return per_row.select("_row", listed.alias("_words"))


def with_partner_flag(df: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """Add ``_may_match``: false where the filter rules a partner out. The filter has a bounded size and is broadcast."""
    flag = F.lit(True)
    for i, at in enumerate(_positions(key)):
        rows = F.broadcast(bitmap.select(F.col("_row").alias(f"_row{i}"), F.col("_words").alias(f"_words{i}")))
        df = df.withColumn(f"_at{i}", at)
        df = df.join(rows, F.expr(f"_at{i} div {ROW_BITS}") == F.col(f"_row{i}"), "left")
        word = F.get(f"_words{i}", F.expr(f"CAST((_at{i} % {ROW_BITS}) div 64 AS INT)"))
        flag = flag & F.coalesce(F.bit_get(word, F.expr(f"CAST(_at{i} % 64 AS INT)")) == 1, F.lit(False))
    return df.withColumn("_may_match", flag & key.isNotNull()).drop("_at0", "_at1", "_row0", "_row1", "_words0", "_words1")


def lookup_join(df: DataFrame, column: str, side: Lookup, key: str, how: str) -> DataFrame:
    """Join ``df`` with a measured lookup table on ``df.column = side.key``; ``how`` is left, left_semi, left_anti or inner."""
    frame = side.side()
    if side.small or side.rows > BITMAP_KEYS:
        return df.join(frame, df[column] == frame[key], how)
    flagged = with_partner_flag(df, F.col(column), key_bitmap(frame, key))
    near = flagged.filter("_may_match").drop("_may_match")
    joined = near.join(frame, near[column] == frame[key], how)
    if how in ("left_semi", "inner"):
        return joined
    far = flagged.filter(~F.col("_may_match")).drop("_may_match")  # certainly without a partner: not shuffled
    return joined.unionByName(far, allowMissingColumns=how == "left")


def tag_repeat_offenders(df: DataFrame) -> DataFrame:
    """Add the risky-sender figures and a flag to every transaction."""
    side = lookup(risky_senders(df).withColumnRenamed("sender_account", "_sender"), "risky-senders")
    return lookup_join(df, "sender_account", side, "_sender", "left").drop("_sender").withColumn(
        "sender_is_repeat_offender", F.col("high_risk_txn_count").isNotNull())


def receiving_accounts(df: DataFrame) -> DataFrame:
    return df.select(F.col("receiver_account").alias("account")).distinct()


def receivers(df: DataFrame) -> Lookup:
    """All receiving accounts, staged and measured; one serves several joins."""
    return lookup(receiving_accounts(df), "receivers")


def circular(df: DataFrame, known: Lookup | None = None) -> DataFrame:
    """Transactions whose sender also receives somewhere."""
    return lookup_join(df, "sender_account", known or receivers(df), "account", "left_semi")


def one_way(df: DataFrame, known: Lookup | None = None) -> DataFrame:
    """Transactions whose sender never receives."""
    return lookup_join(df, "sender_account", known or receivers(df), "account", "left_anti")


def with_sender_totals(df: DataFrame) -> DataFrame:
    """Self join: every transaction beside the totals of its sender."""
    totals = df.groupBy(F.col("sender_account").alias("_sender")).agg(
        F.count(F.lit(1)).alias("sender_txn_count"), fn.money_sum(F.col("amount")).alias("sender_volume"))
    side = lookup(totals, "sender-totals").side()
    return df.join(side, df["sender_account"].eqNullSafe(side["_sender"])).drop("_sender")


def with_sender_account(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Inner join with the account table on the sender's account id."""
    side = lookup(accounts.select(
        F.col("account_id").alias("_account_id"), F.col("country").alias("account_country"),
        F.col("account_type"), F.col("transaction_count").alias("account_txn_count")), "accounts")
    return lookup_join(df, "sender_account_id", side, "_account_id", "inner").drop("_account_id")
