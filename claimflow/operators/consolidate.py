"""Several sources of one mail into one result; conflicts, votes, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIMARY_TYPES = ["pdf", "docx", "xlsx", "image"]
#: Wordings of a conditional acceptance (fixed values).
CONDITIONAL = ["nur wenn", "vorbehaltlich", "sofern", "rate", "raten", "einmalzahlung"]


def grade(confidence: Column) -> Column:
    """HIGH 3, MEDIUM 2, anything else 1."""
    return F.when(confidence == "HIGH", 3).when(confidence == "MEDIUM", 2).otherwise(1)


def distinct_amounts(amounts: Column, closer_than: float = 1.0) -> Column:
    """Values of an array sorted by (tier, -value) that aren't within ``closer_than`` of an earlier kept one."""
    values = F.transform(amounts, lambda x: x["value"])
    start = F.array().cast("array<double>")
    return F.aggregate(values, start, lambda kept, v: F.when(F.exists(kept, lambda k: F.abs(k - v) < closer_than), kept).otherwise(F.concat(kept, F.array(v))))


def consolidate(sources: DataFrame) -> DataFrame:
    """Per mail: best amount (lowest tier, then highest), distinct amounts, method, sources, tokens, weakest confidence.

    Confidence is that of the weakest part; LOW without an amount. Mails of sources only in null amounts stay.
    """
    found = F.col("amount").isNotNull()
    item = F.struct(F.col("amount_tier").alias("tier"), (-F.col("amount")).alias("minus"), F.col("source_idx").alias("idx"), F.col("amount").alias("value"), F.col("amount_confidence").alias("confidence"))
    grouped = sources.groupBy("email_id").agg(
        F.array_sort(F.collect_list(F.when(found, item))).alias("amounts"),
        F.count("*").alias("source_count"),
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens"),
        F.bool_or(found & F.col("source_type").isin(PRIMARY_TYPES)).alias("primary"),
        F.min(F.when(found, grade(F.col("amount_confidence")))).alias("weakest_amount"),
        F.min(F.when(F.col("client_name").isNotNull(), grade(F.col("client_name_confidence")))).alias("weakest_name"),
    )
    weakest = F.when(F.size("amounts") == 0, 1).otherwise(F.least("weakest_amount", "weakest_name"))
    return grouped.select(
        "email_id",
        F.try_element_at("amounts", F.lit(1))["value"].alias("amount"),
        distinct_amounts(F.col("amounts")).alias("unique_amounts"),
        F.when(F.col("primary"), "ai_primary").when(F.size("amounts") > 0, "regex_fallback").otherwise("none").alias("method"),
        "source_count",
        "tokens",
        F.when(weakest == 3, "HIGH").when(weakest == 2, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


def pick_best_name(sources: DataFrame) -> DataFrame:
    """Per mail the client name: HIGH before others, then longest, then first."""
    rank = F.struct((F.col("client_name_confidence") == "HIGH").alias("high"), F.length("client_name").alias("size"), (-F.col("source_idx")).alias("first"))
    named = sources.where(F.col("client_name").isNotNull())
    return named.groupBy("email_id").agg(F.max_by("client_name", rank).alias("client_name"))


def majority_vote(values: DataFrame) -> DataFrame:
    """Per key the value, rounded to cents, with most votes (first seen on ties) and its share, rounded to 2.

    ``values`` has email_id, source_idx, amount. Keys without a value: value 0, share 0.
    """
    counted = values.groupBy("email_id", F.round("amount", 2).alias("value")).agg(F.count("amount").alias("votes"), F.min("source_idx").alias("first"))
    best = F.max_by(F.struct("value", "votes"), F.struct("votes", -F.col("first")))
    voted = counted.groupBy("email_id").agg(best.alias("best"), F.sum("votes").alias("total"))
    none = F.col("total") == 0
    return voted.select(
        "email_id",
        F.when(none, 0.0).otherwise(F.col("best.value")).alias("value"),
        F.when(none, 0.0).otherwise(F.round(F.col("best.votes") / F.col("total"), 2)).alias("share"),
    )


def detect_conflicts(joined: DataFrame) -> DataFrame:
    """``joined`` (new_amount, existing_amount, new_client, existing_client, new_creditor, existing_creditor) with ``conflicts``.

    Amounts more than 10 % of the existing apart conflict, 0 counting as missing; names that differ after trim and lower-case do.
    """
    old = F.nullif(F.col("existing_amount"), F.lit(0.0))
    percent = F.abs(F.col("new_amount") - old) / old * 100
    kind = lambda name, value: F.struct(F.lit(name).alias("type"), value.alias("difference_percent"))
    differs = lambda a, b: F.lower(F.trim(a)) != F.lower(F.trim(b))
    none = F.lit(None).cast("double")
    rules = [
        F.when((old > 0) & (percent > 10), kind("amount_mismatch", F.round(percent, 2))),
        F.when(differs("new_client", "existing_client"), kind("client_name_mismatch", none)),
        F.when(differs("new_creditor", "existing_creditor"), kind("creditor_name_mismatch", none)),
    ]
    return joined.withColumn("conflicts", F.array_compact(F.array(*rules)))


#: Fields of an extraction: type, least and most, or the values allowed.
FIELDS = {
    "amount": ("double", 0.0, 500_000.0),
    "confidence": ("double", 0.0, 1.0),
    "intent": ("string", ["debt_statement", "payment_plan", "rejection", "inquiry", "settlement", "auto_reply", "spam"]),
}


def validate_partial(raw: DataFrame, fields: dict[str, tuple] = FIELDS) -> DataFrame:
    """String columns named in ``fields``, cast; failed ones null, listed in ``errors``; needs_review if any failed.

    A field is (type), (type, allowed values) or (type, least, most). A null is no failure.
    """
    cast = {n: F.expr(f"try_cast(`{n}` AS {rule[0]})") for n, rule in fields.items()}

    def fits(name: str, rule: tuple) -> Column:
        value = cast[name]
        if len(rule) == 3:
            return value.between(rule[1], rule[2])
        return value.isin(rule[1]) if len(rule) == 2 else value.isNotNull()

    ok = {n: F.coalesce(fits(n, rule), F.lit(False)) for n, rule in fields.items()}
    bad = [F.when(F.col(n).isNotNull() & ~ok[n], F.lit(n)) for n in fields]
    rest = [c for c in raw.columns if c not in fields]
    return raw.select(*rest, *[F.when(ok[n], cast[n]).alias(n) for n in fields], F.array_compact(F.array(*bad)).alias("errors")).withColumn("needs_review", F.size("errors") > 0)


def checkpoint(confidence: Column, conflicts: Column) -> Column:
    """struct(confidence, needs_review): HIGH .9, MEDIUM .7, LOW .5, else .7; review below .7 or with conflicts."""
    number = F.when(confidence == "HIGH", 0.9).when(confidence == "LOW", 0.5).otherwise(0.7)
    return F.struct(number.alias("confidence"), ((F.size(conflicts) > 0) | (number < 0.7)).alias("needs_review"))


def merge_extractions(pipeline: DataFrame, entities: DataFrame) -> DataFrame:
    """Pipeline values where not null (0 and '' count) else entity values; an amount makes it a reply unless auto_reply or spam."""
    p, e = pipeline.alias("p"), entities.alias("e")
    joined = p.join(e, "email_id", "left")
    amount = F.coalesce("p.amount", "e.amount")
    real = F.col("p.amount").isNotNull() & ~F.coalesce(F.col("e.intent").isin("auto_reply", "spam"), F.lit(False))
    return joined.select(
        "email_id", amount.alias("amount"), F.coalesce("p.client_name", "e.client_name").alias("client_name"),
        (real | F.coalesce("e.is_creditor_reply", F.lit(False))).alias("is_creditor_reply"),
    )


def match_gate(emails: DataFrame) -> DataFrame:
    """Mails with enough to match: a client name or a reference, and a creditor name or a sender."""
    return emails.where((F.col("client_name").isNotNull() | F.col("reference_number").isNotNull()) & (F.col("creditor_name").isNotNull() | F.col("from_email").isNotNull()))


def settlement_warnings(decision: Column, offer: Column, conditions: Column, debt: Column) -> Column:
    """Names of the inconsistencies of an extracted settlement answer."""
    conditional = F.exists(F.array(*map(F.lit, CONDITIONAL)), lambda p: F.contains(F.lower(conditions), p))
    rules = [
        F.when((decision == "counter_offer") & offer.isNull(), "counter_offer_without_amount"),
        F.when((decision == "accepted") & conditional, "accepted_with_conditional_phrasing"),
        F.when(offer < 0, "negative_counter_offer"),
        F.when((debt > 0) & (offer > debt * 2), "counter_offer_exceeds_2x_original"),
    ]
    return F.array_compact(F.array(*rules))


def settlement_consistency(settlements: DataFrame) -> DataFrame:
    """``settlements`` (decision, offer, conditions, debt, confidence) with ``warnings`` and ``needs_review``.

    A person looks at answers with any warning, without a clear decision, or with a confidence that is under 0.7 or missing.
    """
    warned = settlements.withColumn("warnings", settlement_warnings(F.col("decision"), F.col("offer"), F.col("conditions"), F.col("debt")))
    unclear = F.coalesce(F.col("decision") == "no_clear_response", F.lit(True)) | F.coalesce(F.col("confidence") < 0.7, F.lit(True))
    return warned.withColumn("needs_review", (F.size("warnings") > 0) | unclear)


def case_number(references: Column) -> Column:
    """The first reference of digits, ``_``, ``-`` and ``/`` alone, at least 4 long."""
    return F.try_element_at(F.filter(references, lambda r: r.rlike(r"^[0-9_\-/]{4,}$")), F.lit(1))


def first_rank(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return frame.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
