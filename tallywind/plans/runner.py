"""The batch analytics job: every module over one table, three result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import aggregates as ag
from ..operators import arrays as ar
from ..operators import joins as jn
from ..operators import windows as wn
from ..session import stage
from ..sources.tables import write_result
from .presets import flagged_by_channel, top_corridors

# What the modules read of the table; nothing else is kept while they run.
USED = ["transaction_id", "timestamp", "sender_account", "receiver_account", "amount", "currency", "transaction_type", "status",
        "sender_country", "receiver_country", "fee", "risk_score", "is_flagged", "category", "channel", "txn_hour"]


def analytics(df: DataFrame) -> dict[str, DataFrame]:
    """All analytics of a transaction table, by name; nothing is computed until it is used."""
    results = {
        "currency_stats": ag.currency_statistics(df), "cross_stats": ag.cross_summary(df),
        "pivot_type_by_currency": ag.type_counts(df), "volume_by_status": ag.status_volumes(df), "mean_by_category": ag.category_means(df),
        "multi_currency_senders": ar.multi_currency_senders(df),
        "top_corridors": top_corridors(df), "flagged_by_channel": flagged_by_channel(df),
    }
    return results | ({"hourly_volume": ag.hourly_volume(df)} if "txn_hour" in df.columns else {})


def run_analytics(df: DataFrame, output: str) -> dict[str, int]:
    """Run the job: results are written below ``output``, the row-level modules are counted. Returns the counts.

    The used columns are staged once, so no module derives them again and what is stored is one narrow copy at any size of memory.
    """
    base = stage(df.select(*[c for c in USED if c in df.columns]), "analytics-input")
    results = analytics(base)
    for name in ("currency_stats", "pivot_type_by_currency", "top_corridors"):
        write_result(results[name], f"{output}/{name}")
    known = jn.receivers(base)
    counted = {
        "rows": base, "multi_currency_senders": results["multi_currency_senders"],
        "repeat_offenders": jn.tag_repeat_offenders(base).filter("sender_is_repeat_offender"),
        "circular": jn.circular(base, known), "one_way": jn.one_way(base, known),
        "top_per_currency": wn.top_per_currency(base),
    }
    return {name: frame.count() for name, frame in counted.items()}
