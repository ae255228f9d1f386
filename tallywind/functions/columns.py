"""Scalar building blocks as native column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk cut-offs with their tier and level, and amount cut-offs with their bucket.
RISK_STEPS = [(0.8, "CRITICAL", 5), (0.6, "HIGH", 4), (0.4, "MEDIUM", 3), (0.2, "LOW", 2)]
AMOUNT_STEPS = [(100, "MICRO"), (1_000, "SMALL"), (10_000, "MEDIUM"), (100_000, "LARGE")]
BACKFILL_STEPS = [(100, "MICRO"), (10_000, "SMALL"), (100_000, "MEDIUM")]
REVIEW_RISK, REVIEW_AMOUNT = 0.7, 100_000


def event_time(text: Column) -> Column:
    """Instant of an ISO-8601 string (``Z``, offset, no zone, fractions); null when it cannot be read or is a time without a date."""
    return F.when(~text.rlike(r"^\s*T?\d{1,2}:"), F.try_to_timestamp(text))


def _steps(value: Column, steps: list[tuple], otherwise: str) -> Column:
    chain = F
    for limit, label in steps:
        chain = chain.when(value < limit, label)
    return chain.otherwise(otherwise)


def amount_bucket(amount: Column) -> Column:
    return _steps(amount, AMOUNT_STEPS, "WHALE")


def backfill_bucket(amount: Column) -> Column:
    """The back-fill job uses its own cut-offs."""
    return _steps(amount, BACKFILL_STEPS, "LARGE")


def risk_tier(score: Column) -> Column:
    tier = F.when(score.isNull(), "UNKNOWN").when(F.isnan(score), "NEGLIGIBLE")
    for limit, label, _ in RISK_STEPS:
        tier = tier.when(score >= limit, label)
    return tier.otherwise("NEGLIGIBLE")


def risk_level(score: Column) -> Column:
    level = F
    for limit, _, number in RISK_STEPS:
        level = level.when(score >= limit, number)
    return level.when(score >= 0.0, 1).otherwise(0)


def needs_review(score: Column, flagged: Column, amount: Column) -> Column:
    """Three-valued on purpose: null when nothing is true and something is unknown."""
    return (score >= REVIEW_RISK) | flagged | (amount >= REVIEW_AMOUNT)


def _exact(value: Column, precision: int = 24) -> Column:
    return value.try_cast(f"decimal({precision},8)")


def difference(amount: Column, fee: Column, digits: int = 2) -> Column:
    """``amount - fee`` rounded half up in decimal; values beyond the decimal range fall back to doubles."""
    exact = F.round(_exact(amount) - _exact(fee), digits).cast("double")
    return F.coalesce(exact, F.round(amount - fee, digits))


def product(amount: Column, rate: Column, digits: int = 2) -> Column:
    exact = F.round(_exact(amount) * _exact(rate, 12), digits).cast("double")
    return F.coalesce(exact, F.round(amount * rate, digits))


def log_amount(amount: Column) -> Column:
    return F.when(amount > 0, F.round(F.ln(amount), 4))


def net_converted(amount: Column, fee: Column, rate: Column) -> Column:
    """``(amount - fee) * rate`` with a missing fee as 0 and a missing rate as 1; null without an amount."""
    fee, rate = F.coalesce(fee, F.lit(0.0)), F.coalesce(rate, F.lit(1.0))
    exact = F.round((_exact(amount) - _exact(fee)) * _exact(rate, 12), 2).cast("double")
    return F.coalesce(exact, F.round((amount - fee) * rate, 2))


def mask_account(account: Column) -> Column:
    """Stars for all but the last four characters."""
    length = F.length(account)
    return F.when(length >= 4, F.concat(F.repeat(F.lit("*"), length - 4), F.right(account, F.lit(4)))).otherwise("****")


def ip_to_int(address: Column) -> Column:
    """32-bit value of a dotted address as a long; null when one of the first four parts is no number, or the value is no long."""
    parts = F.split(address, r"\.")
    number = F.lit(0).cast("long")
    for i, weight in enumerate((1 << 24, 1 << 16, 1 << 8, 1)):
        number = F.try_add(number, F.try_multiply(F.get(parts, F.lit(i)).try_cast("long"), F.lit(weight).cast("long")))
    return number


def anonymize_ip(address: Column) -> Column:
    return F.regexp_replace(address, r"\.\d+$", ".xxx")


def money(value: Column) -> Column:
    """An amount as a decimal, so that sums do not depend on the order of the rows; null where it is NaN or too large for one."""
    return value.try_cast("decimal(28,8)")


def _exact_or_double(exact: Column, doubles: Column, value: Column) -> Column:
    """The exact result, unless a value of the group has no decimal form: then the result over doubles."""
    return F.when(F.count_if(value.isNotNull() & money(value).isNull()) == 0, exact.cast("double")).otherwise(doubles)


def money_sum(value: Column) -> Column:
    """Sum of all digits; nothing is rounded before it."""
    return _exact_or_double(F.try_sum(money(value)), F.sum(value.cast("double")), value)


def exact_mean(value: Column, digits: int = 2) -> Column:
    """Mean rounded half up once, after the division."""
    total = F.try_sum(money(value)).try_cast("decimal(30,8)")
    exact = F.round(F.try_divide(total, F.count(value).cast("decimal(18,0)")), digits)
    return F.coalesce(_exact_or_double(exact, F.round(F.avg(value.cast("double")), digits), value), F.round(F.avg(value.cast("double")), digits))


def by_hash() -> Column:
    """A set of one, to be aggregated (and read) beside values without a fixed size, such as ``max_by`` of texts: with it Spark keeps the
    groups in a hash table and does not sort all rows, up to ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold`` groups a task."""
    return F.collect_set(F.lit(True))
