"""Cleaning of mail bodies and extraction of amounts, names and references from texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.functions.amounts import parse_amount
from claimflow.sources.tables import written

#: Tier and pattern of an amount in a text, most telling first (fixed values).
AMOUNT_PATTERNS = [
    (1, r"(?:noch\s+zu\s+zahlen|Noch\s+zu\s+zahlen)[:\s]*([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (1, r"[Ii]nsgesamt[:\s]*([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (1, r"[Ff]orderung[:\s\w]*?insgesamt[:\s]*([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (1, r"[Ss]umme[:\s]*([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (1, r"[Gg]esamtforderung[:\s\w]*?([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (1, r"[Gg]esamt(?:betrag|summe)[:\s\w]*?([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (2, r"[Ff]orderung(?:shöhe|sbetrag)?[:\s\w]*?([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (2, r"[Bb]etrag[:\s\w]*?([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (2, r"[Rr]estschuld[:\s\w]*?([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (2, r"[Oo]ffener\s+(?:Betrag|Saldo)[:\s\w]*?([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (2, r"[Gg]esamtforderung[:\s\w]*?([0-9][0-9.,]{2,})()"),
    (2, r"[Gg]esamt(?:betrag|summe)[:\s\w]*?([0-9][0-9.,]{2,})()"),
    (2, r"[Ff]orderung(?:shöhe|sbetrag)?[:\s\w]*?([0-9][0-9.,]{2,})()"),
    (2, r"[Ss]aldo[:\s\w]*?([0-9][0-9.,]{2,})()"),
    (2, r"[Rr]ückstand[:\s\w]*?([0-9][0-9.,]{2,})()"),
    (2, r"[Hh]auptforderung[:\s\w]*?([0-9][0-9.,]{2,})()"),
    (2, r"[Zz]ahlungsbetrag[:\s\w]*?([0-9][0-9.,]{2,})()"),
    (3, r"([0-9][0-9.,]*)\s*(EUR|€|Euro)"),
    (3, r"(EUR|€)\s*([0-9][0-9.,]*)"),
]
#: Words that make the neighbour of a spreadsheet cell an amount (fixed values).
CELL_KEYWORDS = ["gesamtforderung", "gesamt", "forderung", "betrag", "summe", "total", "amount", "schuld", "forderungshöhe", "forderungshoehe", "hauptforderung", "nebenforderung", "zinsen", "kosten"]
#: Words of an answer to a settlement offer (fixed values).
SECOND_LETTER_WORDS = ["vergleich", "schuldenbereinigung", "einigung", "ratenzahlung", "zahlungsvereinbarung", "vergleichsvorschlag", "angenommen", "abgelehnt", "akzeptiert", "regulierungsvorschlag", "einverstanden", "zustimmung"]
#: Case numbers in a text, tried in this order (fixed values).
CASE_PATTERNS = [r"(?i)(?:Az\.?|Aktenzeichen|AZ)[:\s]*(\d{2,6}[/_]\d{1,5})", r"(?i)(?:Az\.?|Aktenzeichen|AZ)[:\s]*(\d{4,8})", r"(?i)(?:unser(?:em?)?\s+Zeichen)[:\s]*(\d{2,6}[/_]\d{1,5})"]
#: Shapes of a valid German name and address (fixed values).
_NAME = r"^[A-Za-zäöüÄÖÜß\-\s]+(von|zu|vom|zum|zur|der)?\s*[A-Za-zäöüÄÖÜß\-\s]*$"
_ADDRESS = r"^[A-Za-zäöüÄÖÜß.\-\s]+\s+\d+[a-z]?(\s*//.+)?$"
#: Attachment formats and the order in which they are read (fixed values).
FORMATS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "jpg": "image", "jpeg": "image", "png": "image"}
FORMAT_ORDER = ["pdf", "docx", "xlsx", "image"]


def html_text(html: Column) -> Column:
    """Text of an HTML body: scripts, styles, comments and tags go, block ends become line ends, common entities characters."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(character))
    return out


def remove_quotes(text: Column) -> Column:
    """The reply above a quoted mail. Texts below 200 characters stay as they are.

    First the text up to a quote header is taken; if that leaves under 200 characters and under a
    fifth, only the header's rule is undone: quoted lines alone are dropped.
    """
    cut = F.regexp_replace(text, r"(?is)On\s+\d{4}-\d{2}-\d{2}.*?wrote:.*", "")
    cut = F.regexp_replace(cut, r"(?is)Am\s+\d{2}\.\d{2}\.\d{4}.*?schrieb.*", "")
    plain = lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.startswith(F.trim(x), F.lit(">"))), "\n")
    short = (F.length(plain(cut)) < 200) & (F.length(plain(cut)) < F.length(text) * 0.2)
    return F.when(F.length(text) < 200, text).when(short, plain(text)).otherwise(plain(cut))


def clean_bodies(emails: DataFrame, html: str = "raw_body_html", text: str = "raw_body_text") -> DataFrame:
    """``emails`` with cleaned_body and token counts (a quarter of the characters) before and after. HTML is preferred; null: ''."""
    body = F.when(F.coalesce(F.col(html), F.lit("")) != "", html_text(F.col(html))).otherwise(F.coalesce(F.col(text), F.lit("")))
    out = emails.withColumn("__body", body)
    cleaned = F.regexp_replace("__body", r"(?im)^(Aktualisiert von|Updated by):.*?(\d{2}:\d{2}).*?$", "")
    cleaned = F.regexp_replace(cleaned, r"(?m)^-{20,}$", "")
    out = out.withColumn("__cut", cleaned).withColumn("__cut", remove_quotes(F.col("__cut")))
    cleaned = F.col("__cut")
    for pattern in (r"Diese E-Mail.*?vertraulich.*", r"This email.*?confidential.*", r"Disclaimer:.*", r"Hinweis:.*?Nachricht.*", r"HINWEIS:.*?bestimmt.*"):
        cleaned = F.regexp_replace(cleaned, "(?is)" + pattern, "")
    cleaned = F.regexp_replace(cleaned, r"\n\s*\n\s*\n+", "\n\n")
    lines = F.transform(F.split(cleaned, "\n"), lambda x: F.btrim(x, F.lit(" \t\r ")))
    out = out.withColumn("cleaned_body", F.btrim(F.array_join(lines, "\n"), F.lit(" \n\t\r")))
    tokens = lambda c: F.floor(F.length(c) / 4)
    return out.withColumns({"tokens_before": tokens("__body"), "tokens_after": tokens("cleaned_body")}).drop("__body", "__cut")


def signature_info(text: Column) -> Column:
    """struct(company, phone) of a signature; null where none is found."""
    company = F.trim(F.regexp_extract(text, r"([A-ZÄÖÜ][a-zäöüß\s]+(?:GmbH|AG|KG|e\.V\.|eV|Bank|Sparkasse|Versicherung))", 1))
    phone = F.trim(F.regexp_extract(text, r"(?i)(?:Tel\.?|Telefon|Phone)[\s:]*(\+?\d{1,4}[\s\-]?\(?\d{1,5}\)?[\s\-]?\d{1,10})", 1))
    return F.struct(F.nullif(company, F.lit("")).alias("company"), F.nullif(phone, F.lit("")).alias("phone"))


def token_savings(cleaned: DataFrame) -> DataFrame:
    """One row: tokens before and after over all mails, and the per cent saved."""
    sums = cleaned.agg(F.sum("tokens_before").alias("before"), F.sum("tokens_after").alias("after"))
    return sums.withColumn("percent", F.when(F.col("before") > 0, F.round((1 - F.col("after") / F.col("before")) * 100, 2)).otherwise(0.0))


def amount_candidates(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pattern hit: id, tier, pattern, pos, raw, value, confidence. Phone prefixes and dates are no amounts.

    Texts without a digit are skipped before any pattern runs; row-wise, nothing is shuffled.
    """
    slim = texts.select(id_col, F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9]"))
    hits = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(n).alias("pattern"), F.lit(p).alias("re"), F.regexp_extract_all("text", F.lit("(?U)" + p), F.lit(0)).alias("raws")) for n, (t, p) in enumerate(AMOUNT_PATTERNS)])
    each = slim.select(id_col, F.explode(hits).alias("h")).where(F.size("h.raws") > 0)
    rows = each.select(id_col, "h.tier", "h.pattern", F.posexplode("h.raws").alias("pos", "raw"))
    # the number of a hit is its last run of digits and separators, and for the sign-first pattern its only one
    number = F.regexp_extract("raw", r"([0-9][0-9.,]*)\s*(?:EUR|€|Euro)?$", 1)
    rows = rows.withColumn("number", number)
    bare = F.regexp_replace("number", "[.,]", "")
    rows = rows.where(~bare.rlike(r"^0\d{2,4}$") & ~F.col("number").rlike(r"^\d{1,2}\.\d{1,2}\.\d{2,4}$")).withColumn("value", parse_amount(F.col("number")))
    currency = F.col("raw").rlike("EUR|€|Euro")
    german = F.instr(F.reverse("number"), F.lit(",")) > 0
    after = F.when(F.contains("number", F.lit(".")), F.instr("number", F.lit(",")) > F.length("number") - F.instr(F.reverse("number"), F.lit(".")) + 1).otherwise(True)
    decimal = german & after
    level = F.when(decimal & currency, "HIGH").when(decimal | currency, "MEDIUM").otherwise("LOW")
    return rows.where("value > 0").select(id_col, "tier", "pattern", "pos", "raw", "value", level.alias("confidence"))


def best_amount(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text the highest value of its lowest tier, the first on ties."""
    first = F.struct("tier", (-F.col("value")).alias("minus"), "pattern", "pos")
    return candidates.groupBy(id_col).agg(F.min_by(F.struct("tier", "value", "confidence"), first).alias("b")).select(id_col, "b.tier", "b.value", "b.confidence")


def extract_names(text: Column) -> Column:
    """struct(client, client_confidence, creditor, creditor_confidence); digits 3, 0, 1 are read as e, o, l."""
    parts = {}
    for kind, words in (("client", "Mandant|Schuldner|Kunde"), ("creditor", "Gläubiger|Inkasso|Firma")):
        raw = F.trim(F.regexp_extract(text, rf"(?:{words})[:\s]+([A-Za-zäöüÄÖÜß\-,\s]+)", 1))
        name = F.translate(F.regexp_replace(raw, r"[,.\s]+$", ""), "301", "eol")
        long = F.length(name) > 3
        parts[kind] = F.when(long, name)
        parts[f"{kind}_confidence"] = F.when(long, F.when(name.rlike(_NAME), "MEDIUM").otherwise("LOW"))
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def nfkc(column: Column) -> Column:
    """The text with compatibility characters replaced, in Arrow batches."""

    @F.pandas_udf("string")
    def normal(text: pd.Series) -> pd.Series:
        return text.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else None)

    return normal(column)


def normalize_german(texts: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text: compatibility characters normal, white space one blank, ue/oe/ae restored where the dictionary has the word. Null texts have no row.

    Each distinct word that holds one of the pairs is looked up once in ``dictionary`` (word); plain ASCII texts never
    reach Python. Of a text only those words are sent, each once, and the restored ones come back as a map; the text itself is rebuilt in one piece.
    """
    plain = F.col(text_col).rlike(r"^\p{ASCII}*$")
    normal = texts.where(plain).select(id_col, text_col).unionByName(texts.where(~plain).select(id_col, nfkc(F.col(text_col)).alias(text_col)))
    normal = normal.select(id_col, F.trim(F.regexp_replace(text_col, r"\s+", " ")).alias(text_col), F.monotonically_increasing_id().alias("__row"))
    normal = written(normal, "normal-texts")
    holds = lambda w: F.lower(w).rlike("ue|oe|ae")
    words = normal.select("__row", F.explode(F.array_distinct(F.filter(F.split(text_col, " "), holds))).alias("word"))
    pairs = [("ue", "ü"), ("oe", "ö"), ("ae", "ä")]
    clean = lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w\-]", ""))
    tries = words.select("word").distinct().withColumn("try", F.explode(F.array(*[F.when(F.contains("word", F.lit(a)), F.regexp_replace("word", f"^(.*?){a}", f"$1{b}")) for a, b in pairs]))).where("try IS NOT NULL")
    known = tries.join(dictionary.select(F.lower("word").alias("known")).distinct(), clean(F.col("try")) == F.col("known"), "left_semi")
    fixed = known.groupBy("word").agg(F.min("try").alias("fixed"))
    maps = words.join(fixed, "word").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("__fixed"))
    restored = F.array_join(F.transform(F.split(text_col, " "), lambda w: F.when(holds(w), F.coalesce(F.try_element_at("__fixed", w), w)).otherwise(w)), " ")
    return normal.join(maps, "__row", "left").select(id_col, F.when(F.col("__fixed").isNull(), F.col(text_col)).otherwise(restored).alias(text_col))


def validate_german(kind: str, value: Column) -> Column:
    """Whether a postal_code, name or address is well formed; other kinds are, empty values never."""
    clean = F.trim(F.coalesce(value, F.lit("")))
    rules = {"postal_code": clean.rlike(r"^\d{5}$"), "name": (F.length(clean) >= 2) & clean.rlike(_NAME), "address": clean.rlike(_ADDRESS)}
    return F.when(clean == "", False).otherwise(rules.get(kind, F.lit(True)))


def cell_amounts(cells: DataFrame) -> DataFrame:
    """Per file the highest amount beside a keyword cell (its right neighbour, else its left): file, value, confidence.

    ``cells`` has file, sheet, row, col, value_text, value_num. Native numbers are HIGH, texts with a comma HIGH, others MEDIUM.
    """
    order = Window.partitionBy("file", "sheet", "row").orderBy("col")
    amount = F.coalesce("value_num", parse_amount(F.col("value_text")))
    level = F.when(F.col("value_num").isNotNull() | F.contains("value_text", F.lit(",")), "HIGH").otherwise("MEDIUM")
    valued = cells.withColumn("v", F.when(amount > 0, F.struct(amount.alias("value"), level.alias("confidence"))))
    beside = lambda step: F.when(F.lead("col", step).over(order) == F.col("col") + step, F.lead("v", step).over(order))
    found = valued.withColumn("hit", F.coalesce(beside(1), beside(-1)))
    keyword = F.exists(F.array(*map(F.lit, CELL_KEYWORDS)), lambda k: F.contains(F.lower("value_text"), k))
    hits = found.where(keyword & F.col("hit").isNotNull())
    return hits.groupBy("file").agg(F.max_by("hit", F.col("hit.value")).alias("hit")).select("file", "hit.value", "hit.confidence")


def attachment_plan(attachments: DataFrame, budget: int = 100_000, least: int = 1000) -> DataFrame:
    """Attachments with format, scanned and processed: in order of format, until under ``least`` tokens of the budget are left.

    Columns email_id, idx, filename, content_type, file_size, sampled_text_len, encrypted, tokens_used.
    """
    mime = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    extension = F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"\.([^.]+)$", 1))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), extension)
    by_mime = F.when(mime == "application/pdf", "pdf").when(mime.endswith("wordprocessingml.document"), "docx").when(mime.endswith("spreadsheetml.sheet"), "xlsx").when(mime.isin("image/jpeg", "image/png"), "image")
    kind = F.coalesce(by_mime, by_name, F.lit("other"))
    scanned = F.when(kind == "pdf", F.coalesce("encrypted", F.lit(False)) | (F.coalesce("sampled_text_len", F.lit(0)) / F.greatest("file_size", F.lit(1)) < 0.01))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FORMAT_ORDER)), kind), F.lit(0)), F.lit(9))
    planned = attachments.withColumns({"format": kind, "scanned": scanned, "place": place})
    order = Window.partitionBy("email_id").orderBy("place", "idx")
    spent = F.coalesce(F.sum("tokens_used").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return planned.withColumn("processed", F.lit(budget) - spent >= least).withColumn("rank", F.row_number().over(order)).drop("place")


def parse_model_json(text: Column, schema: str) -> Column:
    """The JSON object inside a model's answer, fences and prose around it ignored; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema, {"mode": "PERMISSIVE"})


def component_total(total: Column, components: Column) -> Column:
    """struct(value, confidence): the explicit total HIGH, else the sum of a map's components if above 0, MEDIUM."""
    summed = F.aggregate(F.map_values(components), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    made = lambda v, c: F.struct(v.alias("value"), F.lit(c).alias("confidence"))
    return F.when(total.isNotNull(), made(total, "HIGH")).when(summed > 0, made(summed, "MEDIUM"))


def case_refs(text: Column) -> Column:
    """Distinct case numbers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CASE_PATTERNS]))))


def letter_type(text: Column) -> Column:
    """``second`` if the text answers a settlement offer, else ``first``."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.when(lowered.rlike("|".join(SECOND_LETTER_WORDS)), "second").otherwise("first")


def entity_guard(emails: DataFrame, least_body: int = 20, most_amount: float = 500_000) -> DataFrame:
    """Mails whose body is too short and without attachment text are no reply, confidence 0; implausible amounts become null."""
    empty = (F.length(F.trim(F.coalesce("body", F.lit("")))) < least_body) & (F.coalesce(F.trim("attachment_text"), F.lit("")) == "")
    return emails.withColumns(
        {
            "is_creditor_reply": F.when(empty, False).otherwise(F.col("is_creditor_reply")),
            "confidence": F.when(empty, 0.0).otherwise(F.col("confidence")),
            "debt_amount": F.when(~empty & (F.col("debt_amount") <= most_amount), F.col("debt_amount")),
        }
    )
