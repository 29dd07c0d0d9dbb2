"""Model verdicts: parsing, guards, repair, grounding, and the model's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions.json_text import indented
from ..functions.text import collapse, some, strip, text
from ..functions.urls import contact_name
from .pages import strip_images

LISTS = ("built_with_ai_signals", "technical_signals", "pain_signals", "evidence_quotes", "personalization_hooks")
SCHEMA = "segment string, confidence double, company_stage string, built_with_ai_signals array<string>, technical_signals array<string>, pain_signals array<string>, evidence_quotes array<string>, recommended_offer string, personalization_hooks array<string>, disqualify_reason string, needs_human_review boolean"
COLUMNS = tuple(x.split(" ")[0] for x in SCHEMA.split(", "))


def note(reason: Column, more: Column) -> Column:
    """A note appended to a reason by ' | '; null notes change nothing."""
    return some(F.concat_ws(" | ", some(reason), more))


def _kind(body: str, path: str) -> Column:
    """The type of a JSON value, as a variant has it; null where there is none, or the text can't be a variant (repeated keys)."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(body)), path, "variant"))


def _holds(body: str, path: str) -> Column:
    """Whether a JSON value counts as true: not null, false, zero, or empty."""
    value = F.get_json_object(body, path)
    other = ~value.isin("", "false", "[]", "{}") & F.coalesce(value.try_cast("double") != 0, F.lit(True))
    return F.coalesce(F.when(_kind(body, path) == "STRING", value != "").otherwise(other), F.lit(False))


def _quotes(body: str) -> Column:
    """The evidence quotes, null for each that isn't a string; null where the text can't be a variant or they are no list."""
    items = F.try_variant_get(F.try_parse_json(F.col(body)), "$.evidence_quotes", "array<variant>")
    return F.transform(items, lambda q: F.when(F.schema_of_variant(q) == "STRING", F.try_variant_get(q, "$", "string")))


def parse(raw: DataFrame, body: str = "body") -> DataFrame:
    """The rows with a verdict's columns and parse_failed. Text that isn't a JSON object, or whose confidence is null or no number, gives the empty verdict. Quotes that
    aren't strings are null; needs_human_review of any type holds unless it is null, false, zero or empty."""
    kind = F.get_json_object(body, "$.confidence")
    parsed = F.from_json(F.col(body), SCHEMA)
    loose = F.from_json(F.col(body), "confidence string")
    shape = F.json_object_keys(body)
    missing = ~F.array_contains(shape, "confidence")
    # the kind of the top-level value; texts that a variant can't hold (with repeated keys) by how it is written: a number has no quotes
    of = _kind(body, "$.confidence")
    written = F.col(body).rlike(r'"confidence"\s*:\s*-?[0-9]') & kind.try_cast("double").isNotNull()
    number = F.coalesce(of.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), written)
    good = shape.isNotNull() & loose.isNotNull() & (missing | number)
    df = raw.withColumn("__good", F.coalesce(good, F.lit(False))).withColumn("__v", parsed)
    ok = F.col("__good")
    empty = {"segment": F.lit("unclear"), "confidence": F.lit(0.0), "recommended_offer": F.lit("none"), "disqualify_reason": F.lit("json_parse_failed"), "needs_human_review": F.lit(True)}
    out = {}
    for c in COLUMNS:
        value = F.coalesce(_quotes(body), F.col(f"__v.{c}")) if c == "evidence_quotes" else _holds(body, "$.needs_human_review") if c == "needs_human_review" else F.col(f"__v.{c}")
        if c in LISTS:
            out[c] = F.when(ok, F.coalesce(value, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
        elif c == "company_stage":
            out[c] = F.when(ok, value)
        else:
            value = F.coalesce(value, F.lit(0.0)) if c == "confidence" else value
            out[c] = F.when(ok, value).otherwise(empty[c])
    return df.withColumns(out).withColumn("parse_failed", ~ok).drop("__good", "__v")


def empty_verdict(reason: str | Column) -> dict[str, Column]:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    lists = {c: F.array().cast("array<string>") for c in LISTS}
    return lists | {"segment": F.lit("unclear"), "confidence": F.lit(0.0), "company_stage": F.lit(None).cast("string"), "recommended_offer": F.lit("none"), "disqualify_reason": reason, "needs_human_review": F.lit(True)}


def choose_attempt(raw: DataFrame, lead: str = "lead_id", body: str = "body", error: str = "error") -> DataFrame:
    """A row a lead of attempts (lead, attempt, body, error): the verdict of its first attempt if that parses, else of the second, else the empty one with
    both errors; later attempts don't count. ``used`` is 1, 2 or 0."""
    parsed = parse(raw.select(lead, "attempt", body, error), body)
    ranked = parsed.withColumn("__n", F.row_number().over(Window.partitionBy(lead).orderBy("attempt", body))).where("__n <= 2")
    fields = F.struct(*COLUMNS, "parse_failed", text(error).alias("error"))
    per = ranked.groupBy(lead).agg(F.min_by(fields, F.when(F.col("__n") == 1, 1)).alias("a"), F.min_by(fields, F.when(F.col("__n") == 2, 2)).alias("b"))
    used = F.when(~F.col("a.parse_failed"), 1).when(~F.col("b.parse_failed"), 2).otherwise(0)
    message = F.concat(F.lit("json_parse_failed: "), F.col("a.error"), F.lit(" | retry_error: "), F.coalesce("b.error", F.lit("no second attempt")))
    none = empty_verdict(message)
    per = per.withColumn("used", used)
    return per.select(lead, *(F.when(F.col("used") == 1, F.col(f"a.{c}")).when(F.col("used") == 2, F.col(f"b.{c}")).otherwise(none[c]).alias(c) for c in COLUMNS), (F.col("used") == 0).alias("parse_failed"), "used")


def finish_attempts(chosen: DataFrame, contexts: DataFrame, lead: str = "lead_id") -> DataFrame:
    """Guards, repair and grounding of chosen attempts: a first one is grounded on ``context``, a second one on the shorter ``retry_context`` that it was made from (contexts:
    lead, context, retry_context). The empty verdict stays as it is."""
    df = chosen.join(contexts.select(F.col(lead).alias("__lead"), "context", "retry_context"), F.col(lead) == F.col("__lead"), "left").drop("__lead")
    df = df.withColumn("context", F.when(F.col("used") == 2, F.col("retry_context")).otherwise(F.col("context"))).drop("retry_context")
    return with_status(ground(repair(guard_confidence(df))))


def guard_confidence(df: DataFrame) -> DataFrame:
    low = F.coalesce("confidence", F.lit(0.0)) < V.CONFIDENCE_THRESHOLD
    return df.withColumn("needs_human_review", F.coalesce("needs_human_review", F.lit(False)) | low)


def repair(df: DataFrame) -> DataFrame:
    """Values outside the schema: the segment becomes unclear (noted), the offer none, the stage null; after the first two the confidence is capped and a review is due."""
    bad_segment = ~F.coalesce(F.col("segment").isin(*V.SEGMENTS), F.lit(False))
    bad_offer = ~F.coalesce(F.col("recommended_offer").isin(*V.OFFERS), F.lit(False))
    forced = bad_segment | bad_offer
    return df.withColumns({
        "segment": F.when(bad_segment, "unclear").otherwise(F.col("segment")),
        "recommended_offer": F.when(bad_offer, "none").otherwise(F.col("recommended_offer")),
        "company_stage": F.when(F.col("company_stage").isin(*V.STAGES), F.col("company_stage")),
        "disqualify_reason": F.when(bad_segment, note(F.col("disqualify_reason"), F.lit("invalid_segment_fixed_to_unclear"))).otherwise(F.col("disqualify_reason")),
        "confidence": F.when(forced, F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(V.CONFIDENCE_CAP))).otherwise(F.col("confidence")),
        "needs_human_review": F.when(forced, True).otherwise(F.col("needs_human_review")),
    })


def grounding_form(c: Column | str) -> Column:
    return F.lower(collapse(c))


def ground(df: DataFrame, context: str = "context") -> DataFrame:
    """Quotes that don't occur in the context, or are no text, are removed, noted, and cause a review."""
    folded = df.withColumn("__context", grounding_form(context))
    kept = F.filter("evidence_quotes", lambda q: q.isNotNull() & F.contains(F.col("__context"), grounding_form(q)))
    folded = folded.withColumn("__kept", kept).withColumn("__lost", F.greatest(F.lit(0), F.size("evidence_quotes") - F.size("__kept")))
    lost = F.col("__lost") > 0
    message = F.concat(F.lit("ungrounded_evidence_quotes_removed: "), F.col("__lost").cast("string"), F.lit(" citation(s) not found in source text"))
    return folded.withColumns({
        "evidence_quotes": F.when(lost, F.col("__kept")).otherwise(F.col("evidence_quotes")),
        "needs_human_review": F.when(lost, True).otherwise(F.col("needs_human_review")),
        "disqualify_reason": F.when(lost, note(F.col("disqualify_reason"), message)).otherwise(F.col("disqualify_reason")),
    }).drop("__context", "__kept", "__lost")


def guard_mismatch(df: DataFrame) -> DataFrame:
    """Leads with domain_mismatch need a review; its reason is appended."""
    odd = F.coalesce("domain_mismatch", F.lit(0)) == 1
    reason = F.coalesce(some("domain_mismatch_reason"), F.lit("email/website domain mismatch"))
    message = F.concat(F.lit("domain_mismatch: "), reason, F.lit(" — this verdict may describe the wrong company, please confirm manually before any send"))
    return df.withColumns({"needs_human_review": F.when(odd, True).otherwise(F.col("needs_human_review")), "disqualify_reason": F.when(odd, note(F.col("disqualify_reason"), message)).otherwise(F.col("disqualify_reason"))})


def without_content(df: DataFrame, context: str = "context", evidence: str = "evidence_block") -> DataFrame:
    """Leads of whose site there is no text, nor evidence (if there is such a column), get the empty verdict, whatever else they had."""
    blank = strip(context) == ""
    if evidence in df.columns:
        blank &= text(evidence) == ""
    empty = empty_verdict(V.NO_CONTENT) | ({"parse_failed": F.lit(False)} if "parse_failed" in df.columns else {})
    blank = F.coalesce(blank, F.lit(True))
    return df.withColumn("__blank", blank).withColumns({c: F.when(F.col("__blank"), value).otherwise(F.col(c)) for c, value in empty.items()}).drop("__blank")


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("needs_human_review"), "LOW_CONFIDENCE").otherwise("SCORED"))


def finish(raw: DataFrame, body: str = "body", context: str = "context") -> DataFrame:
    """All steps in their order. Verdicts that failed to parse stay as they are; leads without content have the empty one."""
    df = without_content(ground(repair(guard_confidence(parse(raw, body))), context), context)
    if "domain_mismatch" in df.columns:
        df = guard_mismatch(df)
    return with_status(df)


def _foremost(parts: DataFrame, lead: str, order: tuple[str, ...], least: int, max_chars: int) -> DataFrame:
    """The parts in order that can reach into the first max_chars of a lead's joined ones, if each has least characters with its separator, the
    last one's separator too. A lead's list is bounded by that, whatever it has."""
    window = Window.partitionBy(lead).orderBy(*order)
    return parts.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= -(-max_chars // least) + 1).drop("__n")


def site_context(pages: DataFrame, lead: str = "lead_id", max_chars: int = V.MAX_SITE_CHARS) -> DataFrame:
    """lead and context: the pages with content in order of id, headed by their source, cut, then without images."""
    # no page adds more than max_chars to the cut text, so that much of each is enough
    part = F.concat(F.lit("## Source: "), text("source"), F.lit("\n"), F.substring("content", 1, max_chars))
    parts = pages.where("content <> ''").select(lead, "id", part.alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "part"))), lambda x: x["part"]), "\n\n---\n\n")
    parts = _foremost(parts, lead, ("id", "part"), len("## Source: \n.\n\n---\n\n"), max_chars)
    return parts.groupBy(lead).agg(strip_images(F.substring(whole, 1, max_chars)).alias("context"))


def metadata_block() -> Column:
    fields = [("Name", contact_name("first_name", "last_name")), ("Title", F.col("title")), ("Company", F.col("company_name")), ("Email", F.col("email")), ("Website", F.col("website_url"))]
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"- {name}: "), some(value)) for name, value in fields))
    return F.when(lines == "", "").otherwise(F.concat(F.lit(V.METADATA_HEADING), lines))


def evidence_block(evidence: DataFrame, lead: str = "lead_id", max_chars: int = V.MAX_EVIDENCE_CHARS) -> DataFrame:
    """lead and evidence_block, from rows (lead, id, source, results)."""
    hits = evidence.select(lead, "id", "source", F.posexplode("results").alias("pos", "hit"))
    first = F.min("id").over(Window.partitionBy(lead, "source"))
    body = strip("hit.content")
    part = F.concat(F.lit("["), text("source"), F.lit("] "), text("hit.title"), F.lit(" ("), text("hit.url"), F.lit(")\n"), F.substring(body, 1, max_chars))
    hits = hits.withColumn("first", first).where(body != "").select(lead, "first", "id", "pos", part.alias("part"))
    hits = _foremost(hits, lead, ("first", "id", "pos", "part"), len("[]  ()\n.\n\n"), max_chars)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "id", "pos", "part"))), lambda x: x["part"]), "\n\n")
    return hits.groupBy(lead).agg(F.concat(F.lit(V.EVIDENCE_HEADING), F.substring(whole, 1, max_chars)).alias("evidence_block"))


def criteria_block(criteria: Column, custom: Column) -> Column:
    described = F.create_map(*(F.lit(x) for kv in V.CRITERIA.items() for x in kv))
    lines = F.transform(F.coalesce(criteria, F.array().cast("array<string>")), lambda c: F.concat(F.lit("\n- "), c, F.lit(": "), F.coalesce(F.try_element_at(described, c), c)))
    more = F.when(text(custom) != "", F.concat(F.lit("\n- Custom criterion: "), custom)).otherwise("")
    block = F.concat(F.array_join(lines, ""), more)
    return F.when(block == "", "").otherwise(F.concat(F.lit(V.CRITERIA_HEADING), block))


def signals_json(signals: DataFrame, stored: bool = False) -> DataFrame:
    """Adds signals_json to the rows of page_signals: the signals under the names that the model knows, and the repository's check (a struct repo_check of repo_url, checked, evidence,
    error) or null. Facts that a check doesn't have are left out of its evidence. ``stored``: in the form of a stored row, which has ids, session and time too; columns that
    aren't there are null."""
    there = {c: F.col(c) if c in signals.columns else F.lit(None).cast("string") for c in (V.STORED_SIGNALS if stored else V.SIGNAL_NAMES)}
    whole = signals.withColumn("__signals", F.struct(*(value.alias(V.SIGNAL_NAMES.get(c, c)) for c, value in there.items())))
    out = indented(F.col("__signals"), whole.schema["__signals"].dataType, sparse=(V.SIGNAL_NAMES["repo_check"] + ".evidence",))
    return whole.withColumn("signals_json", out).drop("__signals")


def model_input(leads: DataFrame, signals_json: Column | None = None) -> DataFrame:
    """Adds model_input to rows with the lead's columns, context, evidence_block, criteria_block: the blocks that aren't empty, in order. Null if there is neither a context nor evidence."""
    site = F.when(strip("context") != "", F.concat(F.lit(V.SITE_HEADING), "context"))
    signals = F.concat(F.lit(V.SIGNALS_HEADING), signals_json) if signals_json is not None else F.lit(None).cast("string")
    blocks = F.concat_ws("\n\n---\n\n", some(metadata_block()), site, some("evidence_block"), some("criteria_block"), signals)
    return leads.withColumn("model_input", F.when((strip("context") != "") | (text("evidence_block") != ""), blocks))
