"""Clients and their creditor lists: lookup, guarded write-back into nested documents, outbox, reconciliation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.operators.consolidate import first_rank
from claimflow.operators.matching import mail_domain

#: Domains of mail providers, where an equal domain says nothing (fixed values).
FREEMAIL = [
    "gmail.com", "googlemail.com", "hotmail.com", "hotmail.de", "outlook.com", "outlook.de", "live.com", "live.de", "msn.com", "yahoo.com", "yahoo.de",
    "gmx.de", "gmx.net", "gmx.at", "gmx.ch", "web.de", "t-online.de", "freenet.de", "posteo.de", "posteo.net", "mail.de", "email.de", "aol.com",
    "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me", "tutanota.com", "tuta.io", "arcor.de", "vodafone.de", "1und1.de",
]


def find_client(keys: DataFrame, clients: DataFrame) -> DataFrame:
    """Per key row (id, aktenzeichen, first_name, last_name) the client: id, client_id, found_by.

    By case number, then with ``_`` for ``/``, then by exact name, then by name in the German collation without case
    (umlauts and ``ß`` count, composed or not). The first that hits wins, the smallest client id among equals. Each step is an
    equi-join; the best rank is taken per id.
    """
    c = clients.select("client_id", F.col("aktenzeichen").alias("caz"), F.col("first_name").alias("cf"), F.col("last_name").alias("cl"))
    german = lambda x: F.collate(F.trim(x), "de_CI")
    made = lambda rank, how, key: F.struct(F.lit(rank).alias("rank"), F.lit(how).alias("found_by"), key.alias("key"))
    name = lambda a, b: F.concat_ws("\x1f", F.lit("name"), a, b)
    case = lambda a: F.concat(F.lit("case\x1f"), a)
    named = F.col("first_name").isNotNull() & F.col("last_name").isNotNull()
    asked = keys.select("id", F.explode(F.array(
        made(1, "case_number", case(F.col("aktenzeichen"))), made(2, "case_number_variant", case(F.replace("aktenzeichen", F.lit("/"), F.lit("_")))),
        made(3, "name", F.when(named, name(F.col("first_name"), F.col("last_name")))),
    )).alias("k")).select("id", "k.*").where("key IS NOT NULL")
    offered = c.select("client_id", F.explode(F.array(case(F.col("caz")), name(F.col("cf"), F.col("cl")))).alias("key")).where("key IS NOT NULL")
    met = asked.join(offered.groupBy("key").agg(F.min("client_id").alias("client_id")), "key").select("id", "rank", "client_id", "found_by")
    # names stay two columns: the collation ignores control characters, so no separator would part them
    people = c.where("cf IS NOT NULL AND cl IS NOT NULL").groupBy(german(F.col("cf")).alias("first"), german(F.col("cl")).alias("last")).agg(F.min("client_id").alias("client_id"))
    # the collation is slow, so each name is met by it once, and rows by plain equality with the name
    spelled = keys.where(named).select("first_name", "last_name").distinct()
    known = spelled.withColumns({"first": german(F.col("first_name")), "last": german(F.col("last_name"))}).join(people, ["first", "last"]).select("first_name", "last_name", "client_id")
    loose = keys.where(named).select("id", "first_name", "last_name").join(known, ["first_name", "last_name"])
    met = met.unionByName(loose.select("id", F.lit(4).alias("rank"), "client_id", F.lit("name_without_case").alias("found_by")))
    return met.groupBy("id").agg(F.min(F.struct("rank", "client_id", "found_by")).alias("b")).select("id", "b.client_id", "b.found_by")


def words_longer(text: Column, size: int) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.length(w) > size)


def _searched(email: Column, name: Column, prefix: str) -> dict[str, Column]:
    """What :func:`_fits` compares of an address and a name, made once a row: trimmed and in lower case, the domain, the long words."""
    a, s = F.lower(F.trim(email)), F.lower(F.trim(name))
    return {f"{prefix}mail": F.nullif(a, F.lit("")), f"{prefix}domain": mail_domain(a), f"{prefix}name": F.nullif(s, F.lit("")), f"{prefix}words": words_longer(s, 3)}


def _fits(searched: dict[str, Column], entries: list[dict[str, Column]]) -> Column:
    """Whether an entry, once for each of its names, is the searched creditor; the dearest test comes last."""
    a, s = searched, entries[0] if entries else {}
    found = F.lit(False)
    if s:
        both = a["mail"].isNotNull() & s["mail"].isNotNull()
        own_domain = (a["domain"] == s["domain"]) & ~a["domain"].isin(FREEMAIL)
        found = both & (F.contains(a["mail"], s["mail"]) | F.contains(s["mail"], a["mail"]) | F.coalesce(own_domain, F.lit(False)))
    for n in entries:
        hit = F.contains(n["name"], a["name"]) | F.contains(a["name"], n["name"]) | F.arrays_overlap(a["words"], n["words"])
        found = found | F.coalesce(a["name"].isNotNull() & n["name"].isNotNull() & hit, F.lit(False))
    return found


def creditor_matches(search_email: Column, search_name: Column, email: Column, names: list[Column]) -> Column:
    """Whether a list entry is the searched creditor: addresses contain each other or share a domain of its own, or names share a long word."""
    bare = lambda parts: {k.lstrip("_"): c for k, c in parts.items()}
    return _fits(bare(_searched(search_email, search_name, "_")), [bare(_searched(email, n, "_")) for n in names or [F.lit(None).cast("string")]])


#: Name fields of a list entry; those that a table has are compared.
NAME_FIELDS = ("sender_name", "glaeubiger_name", "actual_creditor", "creditor_name")


def find_creditor(mails: DataFrame, creditors: DataFrame, test_mode: bool = False, name_fields: tuple[str, ...] = NAME_FIELDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per mail (id, client_id, from_email, creditor_name, position) the first entry of the client's list that fits: id, client_id, pos, and the ``carried`` columns of the mail.

    ``creditors`` is the exploded list (client_id, pos, sender_email and the ``name_fields`` it has). A known position wins directly; ``test_mode`` leaves addresses aside.
    Only entries of the mail's own client are compared, by every name field. Texts are prepared once a row, before mails and entries meet, and the rows of a client stay together to the end.
    """
    held = [n for n in name_fields if n in creditors.columns]
    email = F.lit(None).cast("string") if test_mode else F.col("from_email")
    parts = ("mail", "domain", "name", "words")
    asked = mails.select("id", "client_id", "position", *carried, *[c.alias(n) for n, c in _searched(email, F.col("creditor_name"), "__").items()])
    offered = [_searched(F.col("sender_email"), F.col(n), f"__{i}_") for i, n in enumerate(held)] or [_searched(F.col("sender_email"), F.lit(None).cast("string"), "__0_")]
    kept = {n: c for i, one in enumerate(offered) for n, c in one.items() if i == 0 or n.endswith(("name", "words"))}
    joined = asked.join(creditors.select("client_id", "pos", *[c.alias(n) for n, c in kept.items()]), "client_id")
    entries = [{p: F.col(f"__{i if p in ('name', 'words') else 0}_{p}") for p in parts} for i in range(len(offered))]
    known = F.coalesce(F.col("pos") == F.col("position"), F.lit(False))
    met = joined.where(known | _fits({p: F.col(f"__{p}") for p in parts}, entries))
    best = met.groupBy("id", "client_id", *carried).agg(F.min(F.when(known, F.col("pos"))).alias("own"), F.min("pos").alias("least"))
    return best.select("id", "client_id", F.coalesce("own", "least").alias("pos"), *carried)


def find_creditor_by_overlap(mails: DataFrame, creditors: DataFrame, least: float = 0.4) -> DataFrame:
    """Per mail the entry whose name contains, or is contained in, the searched name, else shares most words longer than 2: id, pos, score."""
    joined = mails.select("id", "client_id", "creditor_name").join(creditors.select("client_id", "pos", "sender_name"), "client_id")
    a, b = F.lower(F.trim("creditor_name")), F.lower(F.trim("sender_name"))
    w, v = words_longer(F.col("creditor_name"), 2), words_longer(F.col("sender_name"), 2)
    overlap = F.size(F.array_intersect(w, v)) / F.greatest(F.size(w), F.size(v), F.lit(1))
    scored = joined.withColumn("score", F.when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), 2.0).otherwise(overlap)).where(F.col("score") >= least)
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("pos")).alias("minus"))).alias("b"))
    return best.select("id", (-F.col("b.minus")).alias("pos"), F.round("b.score", 6).alias("score"))


def apply_updates(clients: DataFrame, updates: DataFrame, fields: list[str], list_col: str = "final_creditor_list") -> DataFrame:
    """``clients`` with ``fields`` set on the elements of their lists that ``updates`` (client_id, pos, at, fields) names.

    The latest update of a place wins; fields not named, claim_amount above all, stay. Updates are collapsed to one map per client, so each
    document is rebuilt once. Clients without updates, and positions beyond a list, change nothing.
    """
    named = updates.where(F.col("client_id").isNotNull() & F.col("pos").isNotNull())
    latest = named.groupBy("client_id", "pos").agg(F.max(F.struct("at", F.struct(*fields).alias("new"))).alias("u"))
    packed = latest.groupBy("client_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), "u.new"))).alias("__set"))
    joined = clients.join(packed, "client_id", "left")

    def changed(element: Column, index: Column) -> Column:
        new = F.try_element_at("__set", index.cast("int"))
        for field in fields:
            element = element.withField(field, F.when(new.isNotNull(), new[field]).otherwise(element[field]))
        return element

    written = F.when(F.col("__set").isNull(), F.col(list_col)).otherwise(F.transform(list_col, changed))
    return joined.withColumn(list_col, written).drop("__set")


def apply_amounts(clients: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved amounts (client_id, pos, at, amount) as current_debt_amount and creditor_response_amount; claim_amount is never touched."""
    named = approved.select("client_id", "pos", "at", F.col("amount").alias("current_debt_amount"), F.col("amount").alias("creditor_response_amount"), F.lit("creditor_response").alias("amount_source"), F.lit("responded").alias("contact_status"))
    return apply_updates(clients, named, ["current_debt_amount", "creditor_response_amount", "amount_source", "contact_status"])


def apply_settlements(clients: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settlement answers (client_id, pos, at, decision, offer, conditions) on the lists' elements; amounts stay untouched."""
    named = settlements.select(
        "client_id", "pos", "at", F.col("decision").alias("settlement_response_status"), F.col("offer").alias("settlement_counter_offer_amount"), F.col("conditions").alias("settlement_response_conditions")
    )
    return apply_updates(clients, named, ["settlement_response_status", "settlement_counter_offer_amount", "settlement_response_conditions"])


def build_outbox(approved: DataFrame, existing: DataFrame) -> DataFrame:
    """One pending message per new idempotency key; ``existing`` has the keys already stored. Null keys send nothing."""
    new = approved.where(F.col("idempotency_key").isNotNull()).join(existing.select("idempotency_key"), "idempotency_key", "left_anti")
    return first_rank(new, ["idempotency_key"], [F.col("at"), F.col("id")])


def backfill_references(inquiries: DataFrame, clients: DataFrame) -> DataFrame:
    """``inquiries`` whose null reference_number is filled with the case number of the one named client, the smallest on ties."""
    cases = clients.groupBy(F.col("client_name").alias("__name")).agg(F.min("aktenzeichen").alias("__case"))
    joined = inquiries.join(cases, inquiries["client_name"] == cases["__name"], "left")
    return joined.withColumn("updated", F.col("reference_number").isNull() & F.col("__case").isNotNull()).withColumn("reference_number", F.coalesce("reference_number", "__case")).drop("__name", "__case")


def reconcile(emails: DataFrame, creditors: DataFrame, now: dt.datetime, hours: int = 48, tolerance: float = 0.01) -> DataFrame:
    """Synced mails (id, client_id, from_email, creditor_name, debt_amount, created_at) of the last ``hours`` against the lists: a row for each mismatch.

    Kinds: missing_in_mongo (no such client), missing_creditor_in_mongo, data_mismatch (the response amount, else the claim,
    is more than ``tolerance`` off). Empty creditor addresses match nothing.
    """
    recent = emails.where((F.col("created_at") >= F.lit(now - dt.timedelta(hours=hours))) & (F.col("created_at") <= F.lit(now)) & F.col("debt_amount").isNotNull())
    known = creditors.select("client_id").distinct().withColumn("known", F.lit(True))
    found = find_creditor(recent.withColumn("position", F.lit(None).cast("int")), creditors)
    stored = found.join(creditors.select("client_id", "pos", "claim_amount", "creditor_response_amount"), ["client_id", "pos"]).select("id", "pos", F.coalesce("creditor_response_amount", "claim_amount").alias("stored_amount"))
    joined = recent.join(known, "client_id", "left").join(stored, "id", "left")
    kind = (
        F.when(F.col("known").isNull(), "missing_in_mongo")
        .when(F.col("pos").isNull(), "missing_creditor_in_mongo")
        .when(F.col("stored_amount").isNull() | (F.abs(F.col("debt_amount") - F.col("stored_amount")) > tolerance), "data_mismatch")
    )
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").select("id", "client_id", "kind", "debt_amount", "stored_amount")


def reconcile_summary(mismatches: DataFrame, repairs: DataFrame) -> DataFrame:
    """One row: mismatches found (missing and data kinds only), repaired, failed. ``repairs`` has id and success."""
    m = mismatches.agg(F.count_if(F.col("kind").isin("missing_in_mongo", "data_mismatch")).alias("mismatches_found"))
    r = repairs.agg(F.count_if("success").alias("repaired"), F.count_if(~F.col("success")).alias("failed"))
    return m.join(F.broadcast(r))  # one row each


def outbox_step(outbox: DataFrame, results: DataFrame, now: dt.datetime) -> DataFrame:
    """The outbox after results (id, success, error) of its pending messages: processed_at set, or one retry more with the error."""
    pending = F.col("processed_at").isNull() & (F.col("retry_count") < F.col("max_retries"))
    r = results.select(F.col("id").alias("__id"), "success", "error")
    joined = outbox.join(r, outbox["id"] == r["__id"], "left")
    done, failed = pending & F.coalesce("success", F.lit(False)), pending & ~F.coalesce("success", F.lit(True))
    return joined.withColumns(
        {
            "processed_at": F.when(done, F.lit(now)).otherwise(F.col("processed_at")),
            "retry_count": F.col("retry_count") + failed.cast("int"),
            "error_message": F.when(failed, F.col("error")).otherwise(F.col("error_message")),
        }
    ).drop("__id", "success", "error")


def audit(emails: DataFrame, creditors: DataFrame, now: dt.datetime, days: int = 30, stalled_hours: int = 24) -> DataFrame:
    """Mails of the period with an issue: id, issue, severity, action.

    In order: stalled in received or parsed, processing failed, incomplete extraction, matched but without a client, amount off.
    """
    period = emails.where((F.col("created_at") >= F.lit(now - dt.timedelta(days=days))) & (F.col("created_at") <= F.lit(now)))
    off = reconcile(period.where("processing_status = 'completed'"), creditors, now, hours=days * 24).select("id", "kind")
    joined = period.join(off, "id", "left")
    stalled = F.col("processing_status").isin("received", "parsed") & (F.col("created_at") < F.lit(now - dt.timedelta(hours=stalled_hours)))
    issue = (
        F.when(stalled, "stalled")
        .when(F.col("processing_status") == "failed", "processing_failed")
        .when((F.col("processing_status") == "completed") & (F.col("debt_amount").isNull() | F.col("client_name").isNull()), "incomplete_extraction")
        .when(F.col("kind").isin("missing_in_mongo", "missing_creditor_in_mongo"), "pg_matched_no_mongo_record")
        .when(F.col("kind") == "data_mismatch", "amount_mismatch")
    )
    found = joined.withColumn("issue", issue).where("issue IS NOT NULL")
    severity = F.when(F.col("issue").isin("pg_matched_no_mongo_record", "processing_failed"), "high").when(F.col("issue") == "incomplete_extraction", "low").otherwise("medium")
    action = F.when(F.col("issue").isin("stalled", "processing_failed"), "reprocess").when(F.col("issue") == "incomplete_extraction", "manual_review").otherwise("resync")
    return found.select("id", "issue", severity.alias("severity"), action.alias("action"))


def audit_summary(issues: DataFrame, mails: DataFrame, healthy: float = 0.95) -> DataFrame:
    """Counts by issue and the health of the period: the share of ``mails`` without an issue."""
    n = F.col("__n").cast("double")
    sums = issues.groupBy().pivot("issue", ["stalled", "processing_failed", "incomplete_extraction", "pg_matched_no_mongo_record", "amount_mismatch"]).count().na.fill(0)
    total = sum((F.col(c) for c in sums.columns), F.lit(0))
    sums = sums.join(F.broadcast(mails.agg(F.count("*").alias("__n"))))  # one row each
    health = F.greatest(F.lit(0.0), (n - total) / F.greatest(n, F.lit(1.0)))
    return sums.withColumn("health", F.round(health, 6)).withColumn("healthy", F.col("health") >= healthy).drop("__n")


def audit_samples(issues: DataFrame, per_kind: int = 5) -> DataFrame:
    """The first ``per_kind`` mails of each issue by id."""
    return issues.withColumn("n", F.row_number().over(Window.partitionBy("issue").orderBy("id"))).where(F.col("n") <= per_kind)


def audit_actions(issues: DataFrame, per_action: int = 10) -> DataFrame:
    """The first ``per_action`` mails of each recovery action by id, with how many the action has in all."""
    counts = issues.groupBy("action").agg(F.count("*").alias("mails"))
    first = issues.withColumn("n", F.row_number().over(Window.partitionBy("action").orderBy("id"))).where(F.col("n") <= per_action)
    return first.join(counts, "action")
