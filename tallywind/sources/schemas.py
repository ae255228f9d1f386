"""Fixed input schemas and value domains."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, order and types of the two event feeds, and the
# enumerations used for pivots. They have to equal the feed's definition.

TRANSACTION = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("timestamp", T.StringType(), False),
    T.StructField("sender_account_id", T.StringType()),
    T.StructField("receiver_account_id", T.StringType()),
    T.StructField("sender_account", T.StringType()),
    T.StructField("receiver_account", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("sender_name", T.StringType()),
    T.StructField("receiver_name", T.StringType()),
    T.StructField("sender_bank_code", T.StringType()),
    T.StructField("receiver_bank_code", T.StringType()),
    T.StructField("sender_country", T.StringType()),
    T.StructField("receiver_country", T.StringType()),
    T.StructField("fee", T.DoubleType()),
    T.StructField("exchange_rate", T.DoubleType()),
    T.StructField("reference_id", T.StringType()),
    T.StructField("memo", T.StringType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("is_flagged", T.BooleanType()),
    T.StructField("category", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("device_fingerprint", T.StringType()),
    T.StructField("session_id", T.StringType()),
])

ACCOUNT = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("account_number", T.StringType()),
    T.StructField("holder_name", T.StringType()),
    T.StructField("bank_code", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("account_status", T.StringType()),
    T.StructField("balance", T.DoubleType()),
    T.StructField("total_sent", T.DoubleType()),
    T.StructField("total_received", T.DoubleType()),
    T.StructField("transaction_count", T.IntegerType()),
    T.StructField("risk_rating", T.DoubleType()),
    T.StructField("kyc_level", T.StringType()),
    T.StructField("last_transaction_time", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

ENVELOPE = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestampType", T.IntegerType()),
])

TRANSACTION_TYPES = ["WIRE", "ACH", "CARD", "P2P", "CHECK"]
STATUSES = ["COMPLETED", "PENDING", "FAILED", "REVERSED"]
CATEGORIES = ["RETAIL", "CORPORATE", "GOVERNMENT", "INTERBANK"]
CHANNELS = ["ONLINE", "BRANCH", "ATM", "MOBILE", "API"]

TRANSACTION_PARTITIONS = ["txn_year", "txn_month", "currency"]

# Columns with a new value in almost every row; dictionary encoding is wasted on them.
UNIQUE_COLUMNS = ["transaction_id", "kafka_key", "timestamp", "device_fingerprint", "session_id", "device_short_id", "session_prefix", "row_id"]
