"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score. DataFrame operations only.

Per kind the text is split at the matches; the lengths of pieces and matches give the positions in code points, as a running sum within
the document. Only these lengths, the matches and the 40 characters before each are shuffled, never the text.
All patterns run in time linear in the text: repetitions are possessive and a match starts only where its run of characters starts.

Kinds, in order: ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19 digits, Luhn), ``phone`` (10 to 15 digits), and the added
``iban`` (mod-97). Base kinds are leftmost and non-overlapping per kind; matches that fail their check are dropped without a retry.
Spans of different kinds may overlap. A span scores 0.5, 0.3 more after a checksum, 0.2 more if a word of its context list stands
before it. Null texts count as empty and give zero counts, the digest of nothing and an empty span list; repeated rows stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban"]

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
# A text without this cannot match; it saves the search.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|mobile|tel|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
BEFORE = 40


def _luhn(digits: Column) -> Column:
    """Is the sum of the digits, every second one from the right doubled and reduced, a multiple of ten?"""
    def weigh(c, i):
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _mod97(account: Column) -> Column:
    """ISO 7064: country and check digits move to the end, letters count 10 to 35, the remainder is one."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(a, c):
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (F.when(kind == "ip", hit.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(10, 15))
            .when(kind == "iban", _mod97(hit))
            .otherwise(True))


def _proposals(text: Column, kind: str) -> Column:
    """Array of (kind number, position, length of the piece before, match, its context), with the rest after the last match; empty without a match."""
    pattern, may = PATTERNS[kind], F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    hits = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("gap"), F.lower(F.right(p, F.lit(BEFORE))).alias("before")))
    return F.when(F.size(hits) > 0, F.transform(F.arrays_zip(pieces.alias("p"), hits.alias("h")), lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("k"), i.alias("at"), x["p"]["gap"].alias("gap"), x["p"]["before"].alias("before"), x["h"].alias("hit"),
    ))).otherwise(F.array().cast("array<struct<k:int,at:int,gap:int,before:string,hit:string>>"))


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per confirmed span: ``row, doc_id, kind, start, end, hit, score``, and one with a null kind for each document without any."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("row", "doc_id", F.length("text").alias("chars"), F.explode_outer(F.flatten(F.array(*(_proposals(F.col("text"), k) for k in KINDS)))).alias("x"))
    flat = found.select("row", "doc_id", "chars", "x.*")
    # Pieces and matches of one kind add up to the whole text, so the sum of the kinds before is a multiple of its length.
    order = Window.partitionBy("row").orderBy("k", "at")
    total = F.sum(F.col("gap").cast("long") + F.coalesce(F.length("hit"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = total - F.coalesce(F.length("hit"), F.lit(0)) - (F.dense_rank().over(Window.partitionBy("row").orderBy("k")) - 1) * F.col("chars")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    placed = flat.withColumn("start", start).withColumn("kind", kind)
    ok = F.col("hit").isNotNull() & _valid(F.col("kind"), F.col("hit"))
    near = F.coalesce(*(F.when(F.col("kind") == k, F.col("before").rlike(w)) for k, w in CONTEXT.items()))
    score = F.lit(0.5) + F.when(F.col("kind").isin("card", "iban"), 0.3).otherwise(0.0) + F.when(near, 0.2).otherwise(0.0)
    return placed.select("row", "doc_id", F.when(ok, F.col("k")).alias("k"), F.when(ok, F.col("kind")).alias("kind"), "start",
                         (F.col("start") + F.length("hit")).alias("end"), "hit", F.when(ok, score).alias("score"))


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans, and the best score."""
    spans = find_spans(docs)
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "k", "end", "kind"))
    show = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    grouped = spans.groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_list(one)).alias("s"), F.max("score").alias("best_score"),
        *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in KINDS))
    base = F.filter("s", lambda x: x["k"] < len(BASE_KINDS))
    return grouped.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("s", show), ",").alias("spans"), "best_score")
