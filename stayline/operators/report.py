"""Report tables: checks of a ranking, priority accounts, actions, evidence, explanations and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from ..vocab import (
    ACTION_PHRASES, CALM_PHRASES, CANCELLATION_PHRASES, DISSATISFACTION_PHRASES, FACT_PHRASES, FLAG_PHRASES, LEVELS, MONTHS, NUMBER_WORDS,
    PROBABILITY_PHRASES,
)

# Actions in their order of priority.
ACTIONS = {
    "cancellation_intent": "Contact the account to discuss cancellation concerns.",
    "renewal_or_contract_concern": "Review the upcoming renewal or contract status.",
    "product_bug_or_outage": "Review unresolved product issues with the relevant support or product team.",
    "poor_support_experience": "Review recent support interactions and unresolved complaints.",
    "billing_complaint": "Review billing issues and outstanding disputes.",
    "usage_drop_related": "Review the account's recent usage trend and engagement.",
    "feature_missing": "Review the requested functionality and available alternatives.",
    "competitor_mention": "Review competitive alternatives the customer mentioned.",
    "other": "Review the account's recent support interactions.",
}
# What a headline says of the first reason.
HEADLINES = {
    "critical_cancellation_intent": "cancellation intent detected",
    "critical_cancellation_plus_significant_flag": "cancellation intent plus another significant risk signal",
    "critical_high_quant_plus_contract_concern": "high quantitative risk with a contract concern",
    "critical_repeated_high_severity_plus_high_quant": "repeated high-severity issues with high quantitative risk",
    "high_quantitative_risk": "high quantitative risk",
    "moderate_quantitative_risk": "moderate quantitative risk",
    "strong_support_signal": "strong support signal",
    "moderate_support_signal": "moderate support signal",
    "repeated_support_issue": "repeated support issues",
    "high_support_urgency": "high support urgency",
    "limited_support_data": "limited support data",
    "missing_support_data": "no support data",
    "missing_quantitative_data": "no quantitative risk score",
    "quantitative_qualitative_agreement": "quantitative and qualitative agreement",
    "quantitative_qualitative_conflict": "divergence between quantitative and qualitative signals",
}
NAME_LENGTH, QUOTE_LENGTH, EVIDENCE_ITEMS = 120, 160, 5


def check_ranking(ranked: DataFrame, insufficient: DataFrame, churned: DataFrame, declared: DataFrame) -> DataFrame:
    """Error rows ``(code, customer_id)``; ``declared`` is ``(item, n)`` of the summary.

    Ranks are 1..n if they are distinct, begin with 1 and end with n: three aggregates, no sorted list.
    """
    out = lambda df, code, c="customer_id": df.select(F.lit(code).alias("code"), F.col(c).cast("string").alias("customer_id"))
    bad_score = ranked.where(~F.col("score").between(0, 1))
    bad_confidence = ranked.where(~F.col("confidence").between(0, 1))
    critical = ranked.where((F.col("level") == "critical") & ~F.exists("reasons", lambda r: r["reason_type"].startswith("critical_")))
    one = ranked.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    gaps = one.where((F.col("n") > 0) & ((F.col("d") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")))).select(F.lit("").alias("customer_id"))
    ids = [df.select("customer_id") for df in (ranked, insufficient, churned)]
    twice = [df.groupBy("customer_id").count().where("count > 1") for df in ids]
    both = ids[0].intersect(ids[1]).union(ids[2].intersect(ids[0].union(ids[1])))
    actual = ranked.groupBy(F.col("level").alias("item")).agg(F.count("*").alias("n"))
    actual = actual.union(insufficient.agg(F.count("*")).select(F.lit("insufficient_data"), "count(1)")).union(churned.agg(F.count("*")).select(F.lit("churned"), "count(1)"))
    j = declared.withColumnRenamed("n", "said").join(actual, "item", "full")
    wrong = j.where(F.coalesce("said", F.lit(0)) != F.coalesce("n", F.lit(0)))
    parts = [
        out(bad_score, "SCORE_OUT_OF_RANGE"), out(bad_confidence, "CONFIDENCE_OUT_OF_RANGE"), out(critical, "CRITICAL_WITHOUT_REASON"),
        out(gaps, "RANKS_NOT_SEQUENTIAL"), *(out(t, "DUPLICATE_CUSTOMER") for t in twice), out(both, "CROSS_LIST_MEMBERSHIP"),
        out(wrong, "SUMMARY_STATS_MISMATCH", "item"),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def display_name(name: Column, account: Column, customer_id: Column) -> Column:
    raw = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.coalesce(account, F.lit("")))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[\x00-\x1f\x7f-\x9f]", " "), r"\s+", " "))
    cleaned = F.trim(F.substring(cleaned, 1, NAME_LENGTH))
    return F.when(cleaned != "", cleaned).otherwise(customer_id)


def priority_accounts(ranked: DataFrame, profiles: DataFrame, k: int = 50) -> DataFrame:
    """The first k by rank with a display name; the cut is by rank, before any join."""
    top = ranked.where(F.col("rank") <= k)
    return top.join(profiles, "customer_id", "left").withColumn("display_name", display_name(F.col("name"), F.col("account_name"), F.col("customer_id")))


def recommended_action(accounts: DataFrame) -> DataFrame:
    """``(customer_id, flag_type, action)``: the first flag type in priority order that the account shows."""
    shown = F.array_union(
        F.transform("top_flags", lambda f: f["flag_type"]),
        F.transform(F.filter("reasons", lambda r: r["evidence"].isin(*ACTIONS)), lambda r: r["evidence"]),
    )
    first = F.array_min(F.filter(F.transform(shown, lambda t: lookup(t, {n: k for k, n in enumerate(ACTIONS)})), lambda k: k.isNotNull()))
    kind = lookup(first, dict(enumerate(ACTIONS)))
    return accounts.select("customer_id", kind.alias("flag_type"), lookup(first, dict(enumerate(ACTIONS.values()))).alias("action"))


def short_quote(text: Column) -> Column:
    """Spaces squeezed; beyond the limit cut at the last space before it."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.substring(t, 1, QUOTE_LENGTH), r" [^ ]*$", "")
    return F.when(F.length(t) <= QUOTE_LENGTH, t).otherwise(F.concat(cut, F.lit("…")))


def resolve_evidence(accounts: DataFrame, flags: DataFrame, items: int = EVIDENCE_ITEMS) -> DataFrame:
    """``(customer_id, message_id, position, status, quote)``.

    ``accounts(customer_id, message_ids)`` name messages; ``flags`` own them. The first ``items`` resolved ones of an
    account are ``evidence``, later ones ``over limit``; messages of others are mismatches, unknown ones unresolved.
    """
    from pyspark.sql import Window

    asked = accounts.select("customer_id", F.posexplode(F.split("message_ids", ",")).alias("position", "message_id")).where("message_id != ''")
    owned = flags.groupBy("customer_id", "message_id").agg(F.min_by("text", "flag_type").alias("text"))
    owners = flags.select("message_id", F.lit(1).alias("known")).distinct()
    j = asked.join(owned, ["customer_id", "message_id"], "left").join(owners, "message_id", "left")
    found = F.col("text").isNotNull()
    nth = F.row_number().over(Window.partitionBy("customer_id", found).orderBy("position"))
    status = (
        F.when(found & (nth <= items), "evidence").when(found, "over limit").when(F.col("known") == 1, "EVIDENCE_CUSTOMER_MISMATCH").otherwise("unresolved")
    )
    return j.select("customer_id", "message_id", "position", status.alias("status"), F.when(status == "evidence", short_quote(F.col("text"))).alias("quote"))


def account_explanations(accounts: DataFrame) -> DataFrame:
    """``(customer_id, headline, summary)`` from the account's facts alone; at most four sentences."""
    level = F.initcap("level")
    phrase = lookup(F.get("reasons", F.lit(0))["reason_type"], HEADLINES)
    headline = F.when(phrase.isNotNull(), F.concat(level, F.lit(" — "), phrase)).otherwise(F.concat(level, F.lit(" risk")))
    number = (
        F.when(
            F.col("forward_90").isNotNull() & F.col("lift").isNotNull(),
            F.concat(
                F.lit("The model estimates a "), F.format_number(1 - F.col("forward_90"), 3), F.lit(" probability of churning in the next 90 days, "),
                F.format_number("lift", 1), F.lit(" times the portfolio average."),
            ),
        )
        .when(F.col("survival_90").isNotNull(), F.concat(F.lit("The model estimates a 90-day survival probability of "), F.format_number("survival_90", 3), F.lit(".")))
        .when(F.col("risk_score").isNotNull(), F.concat(F.lit("The model's risk score is "), F.format_number("risk_score", 3), F.lit(".")))
    )
    kinds = F.array_join(F.transform("top_flags", lambda f: F.replace(f["flag_type"], F.lit("_"), F.lit(" "))), ", ")
    support = F.when(F.col("status") == "no_data", "No support data was available.").when(
        F.size("top_flags") > 0, F.concat(F.lit("Support signals include "), kinds, F.lit("."))
    )
    first = F.concat("customer_id", F.lit(" is classified as "), level, F.lit(" risk."))
    why = F.when(phrase.isNotNull(), F.concat(F.lit("Main reason: "), phrase, F.lit(".")))
    return accounts.select("customer_id", headline.alias("headline"), F.concat_ws(" ", first, why, number, support).alias("summary"))


def report_sections(accounts: DataFrame, churned: DataFrame) -> DataFrame:
    """``(section, text)``: distribution, executive summary and portfolio notes, from one aggregate."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    one = accounts.agg(
        *(count(F.col("level") == n).alias(n) for n in ("critical", "high", "medium", "low", "insufficient_data")),
        count(F.col("status") == "limited_data").alias("limited"),
        count(F.col("forward_status") == "beyond_follow_up").alias("beyond"),
        count(F.col("confidence") < 0.5).alias("unsure"),
    ).crossJoin(churned.agg(F.count("*").alias("churned")))  # one row each
    ranked = F.col("critical") + F.col("high") + F.col("medium") + F.col("low")
    rows = {
        "distribution": F.format_string("critical %d, high %d, medium %d, low %d, insufficient data %d", "critical", "high", "medium", "low", "insufficient_data"),
        "summary": F.format_string("The analysis identified %d priority accounts; %d customers had already churned and are not ranked.", ranked, "churned"),
        "limited support": F.format_string("%d accounts had limited support data.", "limited"),
        "beyond follow-up": F.format_string("%d accounts have tenure beyond the observed follow-up; their quantitative risk is unknown.", "beyond"),
        "low confidence": F.format_string("%d accounts have a confidence below 0.5.", "unsure"),
    }
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("section"), v.alias("text")) for k, v in rows.items()))))


def check_report(report: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(customer_id, field)`` where a report row differs from the ranking, or stands in only one of its first ranks."""
    k = report.count()  # a report is a top list
    top = ranked.where(F.col("rank") <= k).select("customer_id", *(F.col(c).alias(f"_{c}") for c in ("rank", "level", "score", "confidence")))
    j = report.join(top, "customer_id", "full")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    fields = F.array_compact(F.array(*(F.when(differs(c), F.lit(c)) for c in ("rank", "level", "score", "confidence"))))
    return j.select("customer_id", F.explode(fields).alias("field"))


# --- explanations in free text -----------------------------------------------------------------------------

_DAY = r"\b\d{4}-\d{2}-\d{2}\b"
_CLOCK = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
_MONTH = "(?:" + "|".join(MONTHS) + ")"
_MONTH_DAY = rf"(?i)\b{_MONTH}\s+\d{{1,2}}(?:,\s*\d{{4}})?\b|\b{_MONTH}\s+\d{{4}}\b|\b\d{{1,2}}\s+{_MONTH}(?:\s+\d{{4}})?\b"
_NUMBER = r"\b\d+(?:\.\d+)?%?"
_NUMBER_WORD = r"\b(?:" + "|".join(NUMBER_WORDS) + r")\b"
_EVIDENCE = r"\b(?:msg|thr)_[A-Za-z0-9_]+"
EXPLANATION_CODES = (
    "UNSUPPORTED_NUMBER", "UNSUPPORTED_DATE", "UNSUPPORTED_TIMESTAMP", "UNSUPPORTED_EVIDENCE", "UNSUPPORTED_CUSTOMER_FACT",
    "UNSUPPORTED_RISK_FACTOR", "RISK_LEVEL_MISMATCH", "UNSUPPORTED_CANCELLATION_CLAIM", "CONFIDENCE_AS_PROBABILITY",
    "UNSUPPORTED_RECOMMENDATION", "CONTRADICTS_NODE4",
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _phrases(low: Column, phrases) -> Column:
    """Those of the phrases that stand anywhere in the text."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))


def _number_is_known(token: Column) -> Column:
    """A number of d decimals is known where some fact rounds to it at d decimals (at least one; ties either way), or
    agrees with it in six significant digits; an integer also where it is one of the facts' integers."""
    six = lambda x: F.format_string("%.5e", x)
    value = token.cast("double")
    decimals = F.greatest(F.lit(1), F.length(F.regexp_extract(token, r"\.(\d*?)0*$", 1)))
    close = lambda n: (decimals <= 4) & (F.abs(value - n) <= 0.5 * F.pow(F.lit(10.0), -decimals) * (1 + 1e-9))
    fits = F.exists("numbers", lambda n: n.isNotNull() & ((six(n) == six(value)) | close(n)))
    whole = token.rlike(r"^\d+$") & F.exists("integers", lambda n: n.cast("double") == value)
    return F.coalesce(fits, F.lit(False)) | F.coalesce(whole, F.lit(False))


def check_explanations(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """``(customer_id, code, found)``: what a free-text explanation ``(customer_id, text)`` claims beyond the facts.

    ``facts(customer_id, display_name, level, numbers array<double>, integers array<bigint>, flag_types array<string>,
    evidence_ids array<string>, recommendation, reference_date date)``. The customer's id and name are blanked first.
    Numbers, number words, dates, times and evidence ids must be among the facts; percentages never are. Level words
    must be the account's; topics need their flag, displeasure any flag that isn't praise, cancellation its own flag;
    chances, invented customer facts, actions outside the recommendation, and calm about a risky account are named.
    """
    word = lambda c: F.concat(F.lit(r"(?i)(?<!\w)\Q"), F.trim(c), F.lit(r"\E(?!\w)"))
    name = F.coalesce(F.when(F.trim("display_name") != "", F.col("display_name")), F.col("customer_id"))
    longer, shorter = F.when(F.length(name) >= F.length("customer_id"), name).otherwise(F.col("customer_id")), F.when(F.length(name) >= F.length("customer_id"), F.col("customer_id")).otherwise(name)
    masked = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), word(longer), F.lit(" ")), word(shorter), F.lit(" "))
    none = lambda c: F.coalesce(c, F.array().cast(facts.schema[c].dataType))
    lists = {c: none(c) for c in ("numbers", "integers", "flag_types", "evidence_ids")}
    rows = texts.join(facts, "customer_id").withColumns(lists | {"t": masked})
    rows = rows.withColumns(
        {
            "low": F.lower("t"),
            "undated": F.regexp_replace("t", _DAY, " "),
            "actions": F.concat(
                F.array(F.lit("recommend"), F.lit("recommended")), _all(F.lower(F.coalesce("recommendation", F.lit(""))), r"[a-z][a-z\-']+")
            ),
        }
    )
    low, flagged = F.col("low"), lambda f: F.array_contains("flag_types", f)
    bare = F.regexp_replace(F.regexp_replace("undated", _CLOCK, " "), _MONTH_DAY, " ")
    numbers = F.filter(_all(bare, _NUMBER), lambda n: n.endswith("%") | ~_number_is_known(F.regexp_replace(n, "%$", "")))
    word_value = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    words = F.filter(_all(F.lower("undated"), _NUMBER_WORD), lambda w: ~F.array_contains("integers", word_value[w].cast("bigint")))
    day = F.col("reference_date").cast("date")
    dates = F.filter(_all(F.col("t"), _DAY), lambda d: d != F.date_format(day, "yyyy-MM-dd"))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    spelled = F.filter(
        _all(F.col("t"), _MONTH_DAY),
        lambda d: ~F.lower(d).contains(month) | F.exists(_all(d, r"\d{4}"), lambda y: y != F.year(day).cast("string")),
    )
    topics = F.concat(*(F.when(flagged(f), F.array().cast("array<string>")).otherwise(_phrases(low, p)) for f, p in FLAG_PHRASES.items()))
    praise_only = F.forall("flag_types", lambda f: f == "positive_feedback")
    level_words = F.filter(F.array(*map(F.lit, LEVELS)), lambda w: (w != F.col("level")) & F.regexp_like(low, F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))
    empty = F.array().cast("array<string>")
    found = {
        "UNSUPPORTED_NUMBER": F.concat(numbers, words),
        "UNSUPPORTED_DATE": F.concat(dates, spelled),
        "UNSUPPORTED_TIMESTAMP": _all(F.col("t"), _CLOCK),
        "UNSUPPORTED_EVIDENCE": F.filter(_all(F.col("t"), _EVIDENCE), lambda e: ~F.array_contains("evidence_ids", e)),
        "UNSUPPORTED_CUSTOMER_FACT": _phrases(low, FACT_PHRASES),
        "UNSUPPORTED_RISK_FACTOR": F.concat(topics, F.when(praise_only, _phrases(low, DISSATISFACTION_PHRASES)).otherwise(empty)),
        "RISK_LEVEL_MISMATCH": level_words,
        "UNSUPPORTED_CANCELLATION_CLAIM": F.when(flagged("cancellation_intent"), empty).otherwise(_phrases(low, CANCELLATION_PHRASES)),
        "CONFIDENCE_AS_PROBABILITY": _phrases(low, PROBABILITY_PHRASES),
        "UNSUPPORTED_RECOMMENDATION": F.filter(_phrases(low, ACTION_PHRASES), lambda p: ~F.array_contains("actions", p)),
        "CONTRADICTS_NODE4": F.when(F.col("level").isin("critical", "high"), _phrases(low, CALM_PHRASES)).otherwise(empty),
    }
    listed = F.concat(*(F.transform(found[c], lambda x: F.struct(F.lit(c).alias("code"), x.alias("found"))) for c in EXPLANATION_CODES))
    return rows.select("customer_id", F.inline(listed))
