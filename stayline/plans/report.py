"""Queries of report tables, quality checks and run history."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import report as P
from . import ranking as K
from .canonical import CANON, accepted_accounts, canonical_accounts
from .ranking import RANK, scored_of
from .survival import STATES, flat_accounts
from .views import REF, ctes, define, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def lists(spark, sf_dir):
    active, churned = R.split_churned(K.accounts_of(spark, sf_dir))
    scored = R.score_accounts(active)
    return R.rank_accounts(scored), scored.where("level = 'insufficient_data'"), churned


@query(
    RANK
    + """ SELECT 'RANKS_NOT_SEQUENTIAL' AS code, '' AS customer_id UNION ALL
    SELECT 'CROSS_LIST_MEMBERSHIP', customer_id FROM ranked WHERE rank = 5 UNION ALL
    SELECT 'DUPLICATE_CUSTOMER', customer_id FROM ranked WHERE rank = 7 UNION ALL
    SELECT 'SUMMARY_STATS_MISMATCH', item FROM (SELECT level AS item FROM ranked GROUP BY level UNION ALL SELECT 'insufficient_data' UNION ALL SELECT 'churned') WHERE item = 'churned' OR item = (SELECT level FROM ranked WHERE rank = 7)"""
)
def check_ranking(spark, sf_dir):
    """The ranking with planted faults: rank 7 twice, the fifth account also churned, a churned count of the time before."""
    ranked, insufficient, churned = lists(spark, sf_dir)
    summary = R.ranking_summary(scored_of(spark, sf_dir), churned)
    ranked = ranked.union(ranked.where("rank = 7"))
    churned = churned.union(ranked.where("rank = 5").select("customer_id", "tenure_days"))
    return P.check_ranking(ranked, insufficient, churned, summary)


define(
    "profiles",
    "customer",
    """SELECT 'CUST-' || CAST(c_custkey AS STRING) AS customer_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name || '   ' || c_mktsegment END AS name,
         CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment ELSE '' END AS account_name FROM customer WHERE c_custkey % 8 <> 5""",
)


@query(
    RANK
    + ", "
    + ctes("profiles")[5:]
    + r""" SELECT rank, r.customer_id, CASE WHEN coalesce(d, '') <> '' THEN d ELSE r.customer_id END AS display_name FROM ranked r LEFT JOIN (
      SELECT customer_id, left(regexp_replace(trim(CASE WHEN coalesce(name, '') <> '' THEN name ELSE account_name END), '\s+', ' ', 'g'), 120) AS d FROM profiles) p USING (customer_id) WHERE rank <= 50"""
)
def priority_accounts(spark, sf_dir):
    top = P.priority_accounts(lists(spark, sf_dir)[0], view(spark, sf_dir, "profiles"))
    return top.select("rank", "customer_id", "display_name")


_ORDER = ", ".join(f"('{k}', {i})" for i, k in enumerate(P.ACTIONS))


@query(
    RANK
    + f""", o AS (SELECT * FROM (VALUES {_ORDER}) v(flag_type, k)), b AS (SELECT customer_id, min(k) AS k FROM fl JOIN o USING (flag_type) WHERE flag_type <> 'positive_feedback' GROUP BY 1)
    SELECT s4.customer_id, o.flag_type FROM s4 LEFT JOIN b USING (customer_id) LEFT JOIN o USING (k)"""
)
def recommended_action(spark, sf_dir):
    return P.recommended_action(scored_of(spark, sf_dir)).select("customer_id", "flag_type")


EVIDENCE = RANK + """, a AS (SELECT customer_id, unnest(list_concat(string_split(message_ids, ','), ['m1', 'm-none'])) AS message_id, unnest(range(len(string_split(message_ids, ',')) + 2)) AS position FROM rank_flags WHERE flag_type = 'other_none' OR flag_type = 'billing_complaint'),
  o AS (SELECT customer_id, message_id, arg_min(text, flag_type) AS text FROM support_flags GROUP BY 1, 2),
  j AS (SELECT a.*, o.text, a.message_id IN (SELECT message_id FROM support_flags) AS known FROM a LEFT JOIN o ON o.customer_id = a.customer_id AND o.message_id = a.message_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY customer_id, text IS NOT NULL ORDER BY position) AS k FROM j)"""


@query(
    EVIDENCE
    + r""" SELECT customer_id, message_id, position, CASE WHEN text IS NOT NULL AND k <= 1 THEN 'evidence' WHEN text IS NOT NULL THEN 'over limit' WHEN known THEN 'EVIDENCE_CUSTOMER_MISMATCH' ELSE 'unresolved' END AS status,
    CASE WHEN text IS NOT NULL AND k <= 1 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) END AS quote FROM n"""
)
def resolve_evidence(spark, sf_dir):
    flags = view(spark, sf_dir, "rank_flags").where("flag_type = 'billing_complaint'")
    asked = flags.select("customer_id", F.concat("message_ids", F.lit(",m1,m-none")).alias("message_ids"))
    return P.resolve_evidence(asked, view(spark, sf_dir, "support_flags"), items=1)


_HEAD = "CASE string_split(reasons, ',')[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.HEADLINES.items()) + " END"


@query(
    RANK
    + f""", h AS (SELECT customer_id, upper(left(level, 1)) || substr(level, 2) AS lv, {_HEAD} AS phrase, status, top_flags FROM s4 WHERE level <> 'insufficient_data')
    SELECT customer_id, CASE WHEN phrase IS NOT NULL THEN lv || ' — ' || phrase ELSE lv || ' risk' END AS headline, CASE WHEN status = 'no_data' THEN 'No support data was available.' WHEN top_flags <> '' THEN 'Support signals include ' || replace(replace(top_flags, '_', ' '), ',', ', ') || '.' ELSE '' END AS ending FROM h"""
)
def account_explanations(spark, sf_dir):
    df = P.account_explanations(scored_of(spark, sf_dir).where("level != 'insufficient_data'"))
    ending = F.regexp_extract("summary", r"((?:No support data was available|Support signals include [a-z ,]+)\.)$", 1)
    return df.select("customer_id", "headline", ending.alias("ending"))


@query(
    RANK
    + """, c AS (SELECT sum((level = 'critical')::INT) AS a, sum((level = 'high')::INT) AS b, sum((level = 'medium')::INT) AS c, sum((level = 'low')::INT) AS d, sum((level = 'insufficient_data')::INT) AS e,
      sum((status = 'limited_data')::INT) AS l, sum((forward_status = 'beyond_follow_up')::INT) AS f, sum((confidence < 0.5)::INT) AS u, (SELECT count(*) FROM cm WHERE event_observed = 1) AS x FROM s3)
    SELECT 'distribution' AS section, 'critical ' || a || ', high ' || b || ', medium ' || c || ', low ' || d || ', insufficient data ' || e AS text FROM c UNION ALL
    SELECT 'summary', 'The analysis identified ' || (a + b + c + d) || ' priority accounts; ' || x || ' customers had already churned and are not ranked.' FROM c UNION ALL
    SELECT 'limited support', l || ' accounts had limited support data.' FROM c UNION ALL SELECT 'beyond follow-up', f || ' accounts have tenure beyond the observed follow-up; their quantitative risk is unknown.' FROM c UNION ALL
    SELECT 'low confidence', u || ' accounts have a confidence below 0.5.' FROM c"""
)
def report_sections(spark, sf_dir):
    active, churned = R.split_churned(K.accounts_of(spark, sf_dir))
    return P.report_sections(R.score_accounts(active), churned)


@query(RANK + "SELECT customer_id, 'score' AS field FROM ranked WHERE rank = 3 UNION ALL SELECT customer_id, 'level' FROM ranked WHERE rank = 9")
def check_report(spark, sf_dir):
    """The first 20 with planted faults: a score at rank 3, a level at rank 9."""
    ranked = lists(spark, sf_dir)[0].select("customer_id", "rank", "level", "score", "confidence")
    report = ranked.where("rank <= 20").withColumn("score", F.when(F.col("rank") == 3, F.lit(-1.0)).otherwise(F.col("score")))
    report = report.withColumn("level", F.when(F.col("rank") == 9, "unknown").otherwise(F.col("level")))
    return P.check_report(report, ranked)


#: Sentences that an explanation gets by the number in the customer's id; ``@`` is the account's score.
CLAIMS = (
    "The account has a score of @ and needs a look within 90 days.",
    "It will cancel by 2030-01-01, a 77% chance of that, likely to churn by then.",
    "On 2001-08-01 at 10:30 they said so in msg_17 and thr_none, see m1.",
    "Since August 2001 or 1 August 2001 nothing; by March 3, 2002 it is over, as may happen.",
    "Twelve of ninety seats are used; 0.123456 and 3.50 are the rest.",
    "They are a high risk and a low priority, of critical weight, but highly valued.",
    "They are frustrated about the outage, the price and a competitor, unhappy overall.",
    "A long-time customer, acquired in a merger; they contacted support and signed up again.",
    "Offer a discount, reach out and schedule a call to review the upcoming renewal.",
    "No risk here, they will remain active. Nothing else.",
)
_CLAIM = "CASE n % 10 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CLAIMS)) + " END"
_RECOMMENDED = P.ACTIONS["renewal_or_contract_concern"]


def _q_phrases(phrases) -> str:
    return "list_filter([" + ", ".join(f"'{p}'" for p in phrases) + "], lambda p: contains(low, p))"


def _q_explanations() -> str:
    from .. import vocab as W

    month = "(?:" + "|".join(W.MONTHS) + ")"
    spelled = rf"(?i)\b{month}\s+\d{{1,2}}(?:,\s*\d{{4}})?\b|\b{month}\s+\d{{4}}\b|\b\d{{1,2}}\s+{month}(?:\s+\d{{4}})?\b"
    day, clock = r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
    words = "(?:" + "|".join(W.NUMBER_WORDS) + ")"
    ninety = "'ninety'"
    known = """(NOT contains(x, '%') AND (list_bool_or([
        (length(regexp_extract(x, '\\.(\\d*?)0*$', 1)) <= 4 AND abs(TRY_CAST(x AS DOUBLE) - v) <= 0.5 * pow(10, -greatest(1, length(regexp_extract(x, '\\.(\\d*?)0*$', 1)))) * (1 + 1e-9))
        OR printf('%.5e', v) = printf('%.5e', TRY_CAST(x AS DOUBLE)) FOR v IN numbers]) OR x = '90'))"""
    topics = " UNION ALL ".join(
        f"SELECT customer_id, 'UNSUPPORTED_RISK_FACTOR' AS code, unnest({_q_phrases(p)}) AS found FROM c WHERE NOT list_contains(flags, '{f}')" for f, p in W.FLAG_PHRASES.items()
    )
    levels = " UNION ALL ".join(
        f"SELECT customer_id, 'RISK_LEVEL_MISMATCH', '{w}' FROM c WHERE level <> '{w}' AND regexp_matches(low, '\\b{w}\\b')" for w in W.LEVELS
    )
    allowed = ", ".join(f"'{w}'" for w in {"recommend", "recommended", *re.findall(r"[a-z][a-z\-']+", _RECOMMENDED.lower())})
    return RANK + rf""", a AS (SELECT *, CAST(regexp_extract(customer_id, '\d+') AS INT) AS n, coalesce(string_split(nullif(top_flags, ''), ','), []) AS flags,
      list_filter([round(score, 2), quant], lambda v: v IS NOT NULL) AS numbers FROM s4 WHERE level <> 'insufficient_data'),
    b AS (SELECT customer_id, n, level, list_concat(flags, CASE WHEN positive AND status <> 'no_data' THEN ['positive_feedback'] ELSE [] END) AS flags, numbers, replace({_CLAIM}, '@', CAST(round(score, 2) AS VARCHAR)) AS t FROM a),
    c AS (SELECT *, lower(t) AS low, regexp_replace(t, '{day}', ' ', 'g') AS undated FROM b),
    tokens AS (SELECT customer_id, numbers, unnest(regexp_extract_all(regexp_replace(regexp_replace(undated, '{clock}', ' ', 'g'), '{spelled}', ' ', 'g'), '\b\d+(?:\.\d+)?%?')) AS x FROM c)
    SELECT customer_id, 'UNSUPPORTED_NUMBER' AS code, x AS found FROM tokens WHERE NOT {known}
    UNION ALL SELECT customer_id, 'UNSUPPORTED_NUMBER', w FROM (SELECT customer_id, unnest(regexp_extract_all(lower(undated), '\b{words}\b')) AS w FROM c) WHERE w <> {ninety}
    UNION ALL SELECT customer_id, 'UNSUPPORTED_DATE', d FROM (SELECT customer_id, unnest(regexp_extract_all(t, '{day}')) AS d FROM c) WHERE d <> '{REF}'
    UNION ALL SELECT customer_id, 'UNSUPPORTED_DATE', d FROM (SELECT customer_id, unnest(regexp_extract_all(t, '{spelled}')) AS d FROM c)
      WHERE NOT contains(lower(d), 'august') OR len(list_filter(regexp_extract_all(d, '\d{{4}}'), lambda y: y <> '2001')) > 0
    UNION ALL SELECT customer_id, 'UNSUPPORTED_TIMESTAMP', unnest(regexp_extract_all(t, '{clock}')) FROM c
    UNION ALL SELECT customer_id, 'UNSUPPORTED_EVIDENCE', e FROM (SELECT customer_id, unnest(regexp_extract_all(t, '\b(?:msg|thr)_[A-Za-z0-9_]+')) AS e FROM c) WHERE e <> 'msg_17'
    UNION ALL SELECT customer_id, 'UNSUPPORTED_CUSTOMER_FACT', unnest({_q_phrases(W.FACT_PHRASES)}) FROM c
    UNION ALL {topics}
    UNION ALL SELECT customer_id, 'UNSUPPORTED_RISK_FACTOR', unnest({_q_phrases(W.DISSATISFACTION_PHRASES)}) FROM c WHERE len(list_filter(flags, lambda f: f <> 'positive_feedback')) = 0
    UNION ALL {levels}
    UNION ALL SELECT customer_id, 'UNSUPPORTED_CANCELLATION_CLAIM', unnest({_q_phrases(W.CANCELLATION_PHRASES)}) FROM c WHERE NOT list_contains(flags, 'cancellation_intent')
    UNION ALL SELECT customer_id, 'CONFIDENCE_AS_PROBABILITY', unnest({_q_phrases(W.PROBABILITY_PHRASES)}) FROM c
    UNION ALL SELECT customer_id, 'UNSUPPORTED_RECOMMENDATION', p FROM (SELECT customer_id, unnest({_q_phrases(W.ACTION_PHRASES)}) AS p FROM c) WHERE p NOT IN ({allowed})
    UNION ALL SELECT customer_id, 'CONTRADICTS_NODE4', unnest({_q_phrases(W.CALM_PHRASES)}) FROM c WHERE level IN ('critical', 'high')"""


@query(_q_explanations())
def check_explanations(spark, sf_dir):
    """Sentences that claim more or less than the facts, dealt by customer."""
    scored = scored_of(spark, sf_dir).where("level != 'insufficient_data'").withColumn("n", F.regexp_extract("customer_id", r"\d+", 0).cast("int"))
    shown = F.round("score", 2)
    text = F.replace(F.expr(_CLAIM), F.lit("@"), shown.cast("string"))
    praised = F.exists("flags", lambda f: f["flag_type"] == "positive_feedback") & (F.col("status") != "no_data")
    praise = F.when(praised, F.array(F.lit("positive_feedback"))).otherwise(F.array().cast("array<string>"))
    facts = scored.select(
        "customer_id", F.lit("").alias("display_name"), "level", F.array(shown, "quant").alias("numbers"), F.array(F.lit(90).cast("bigint")).alias("integers"),
        F.concat(F.transform("top_flags", lambda f: f["flag_type"]), praise).alias("flag_types"), F.array(F.lit("msg_17")).alias("evidence_ids"),
        F.lit(_RECOMMENDED).alias("recommendation"), F.lit(REF).cast("date").alias("reference_date"),
    )
    return P.check_explanations(scored.select("customer_id", text.alias("text")), facts)


# --- quality and history -----------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT d.doc_id, l.quality AS e, CASE WHEN n_chars > 400 AND text NOT LIKE '%!!%' THEN 1 ELSE 0 END AS p FROM documents d JOIN labels l USING (doc_id)),
    t AS (SELECT count(*) AS n, avg((e = p)::INT) AS po, (sum(e) * sum(p) + sum(1 - e) * sum(1 - p)) / (count(*) * count(*)) AS pe FROM p)
    SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM t"""
)
def label_agreement(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") > 400) & ~F.col("text").contains("!!")).cast("int").alias("predicted"))
    pairs = docs.join(view(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("expected")), "doc_id")
    return rounded(Q.cohen_kappa(pairs), agreement=6, kappa=6)


@query(
    ctes("support_flags")
    + """, ty AS (SELECT unnest(['cancellation_intent', 'billing_complaint', 'product_bug_or_outage', 'competitor_mention']) AS flag_type),
    g AS (SELECT customer_id, flag_type FROM (SELECT DISTINCT customer_id FROM support_threads), ty),
    i AS (SELECT g.*, EXISTS (SELECT 1 FROM support_flags f WHERE f.customer_id = g.customer_id AND f.flag_type = g.flag_type AND f.severity = 'high')::INT AS e,
      EXISTS (SELECT 1 FROM support_flags f WHERE f.customer_id = g.customer_id AND f.flag_type = g.flag_type AND length(f.message_id) % 2 = 0)::INT AS p FROM g),
    t AS (SELECT count(*) AS n, avg((e = p)::INT) AS po, (sum(e) * sum(p) + sum(1 - e) * sum(1 - p)) / (count(*) * count(*)) AS pe FROM i)
    SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END, 6) AS kappa FROM t"""
)
def agreement_scores(spark, sf_dir):
    flags = view(spark, sf_dir, "support_flags")
    types = ["cancellation_intent", "billing_complaint", "product_bug_or_outage", "competitor_mention"]
    customers = view(spark, sf_dir, "support_threads").select("customer_id").distinct()
    return rounded(Q.agreement_scores(flags.where("severity = 'high'"), flags.where("length(message_id) % 2 = 0"), types, customers), agreement=6, kappa=6)


define(
    "support_windows",
    "customer",
    """SELECT 'CUST-' || CAST(c_custkey AS STRING) AS customer_id, DATE '2024-01-05' AS observation_start,
         CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-01-20' ELSE DATE '2024-02-25' END AS observation_end, c_custkey % 9 AS declared FROM customer WHERE c_custkey % 6 <> 2""",
)
define(
    "window_threads",
    "support_threads support_flags",
    """SELECT t.customer_id, t.created_at, max(CASE WHEN flag_type = 'cancellation_intent' THEN 1 ELSE 0 END) = 1 AS cancellation
       FROM support_threads t LEFT JOIN support_flags f ON t.thread_id = f.thread_id GROUP BY t.thread_id, t.customer_id, t.created_at""",
)


@query(
    ctes("window_threads", "support_windows")
    + """, j AS (SELECT t.*, observation_start AS s, observation_end AS e, CAST(created_at AS DATE) AS d FROM window_threads t LEFT JOIN support_windows USING (customer_id))
    SELECT 'outside' AS "check", count(*) AS n FROM j WHERE d < s OR d > e UNION ALL SELECT 'early_cancellation', count(*) FROM j WHERE cancellation AND date_diff('day', d, e) > 30
    UNION ALL SELECT 'after_reference', count(*) FROM j WHERE d > DATE '2024-01-28' UNION ALL SELECT 'unknown_customer', count(*) FROM j WHERE s IS NULL"""
)
def window_checks(spark, sf_dir):
    return Q.window_checks(view(spark, sf_dir, "window_threads"), view(spark, sf_dir, "support_windows"), "2024-01-28")


@query(
    ctes("window_threads", "support_windows")
    + """, c AS (SELECT w.customer_id, count(*) AS n FROM window_threads t JOIN support_windows w ON w.customer_id = t.customer_id AND CAST(created_at AS DATE) <= observation_end AND date_diff('day', CAST(created_at AS DATE), observation_end) <= 20 GROUP BY 1)
    SELECT customer_id, declared, coalesce(n, 0) AS counted FROM support_windows LEFT JOIN c USING (customer_id) WHERE declared <> coalesce(n, 0)"""
)
def ticket_reconciliation(spark, sf_dir):
    return Q.ticket_reconciliation(view(spark, sf_dir, "support_windows"), view(spark, sf_dir, "window_threads"), days=20)


@query(
    STATES
    + """, g AS (SELECT 'tier' AS grouping_, plan_tier AS value, event_observed AS event FROM states UNION ALL SELECT 'contract', CAST(CAST(contract_length_months AS INT) AS VARCHAR), event_observed FROM states
    UNION ALL SELECT 'usage', CASE WHEN usage_frequency < 10 THEN 'low' WHEN usage_frequency < 1200 THEN 'medium' WHEN usage_frequency >= 1200 THEN 'high' END, event_observed FROM states)
    SELECT grouping_ AS "grouping", value, count(*) AS n, round(avg(event), 6) AS rate FROM g GROUP BY 1, 2"""
)
def churn_rates(spark, sf_dir):
    df = flat_accounts(spark, sf_dir).withColumnRenamed("event_observed", "event")
    u = F.col("usage_frequency")
    groups = {"tier": F.col("plan_tier"), "contract": F.col("contract_length_months").cast("int"), "usage": F.when(u < 10, "low").when(u < 1200, "medium").when(u >= 1200, "high")}
    return rounded(Q.churn_rates(df, groups), rate=6)


@query(
    CANON
    + ", ".join(["SELECT key, round(overall, 6) AS overall, round(segment, 6) AS segment, overall BETWEEN 0.01 AND 0.12 AS in_band FROM ("])
    + " UNION ALL ".join(
        f"SELECT '{k}' AS key, avg(({k} IS NULL)::INT) AS overall, avg(CASE WHEN event_observed = 1 THEN ({k} IS NULL)::INT END) AS segment FROM canonical"
        for k in ("plan_tier", "contract_length_months", "usage_frequency")
    )
    + ")"
)
def missingness_rates(spark, sf_dir):
    keys = ["plan_tier", "contract_length_months", "usage_frequency"]
    df = canonical_accounts(spark, sf_dir).select("event_observed", *(F.col(f"core_features.{k}").alias(k) for k in keys))
    return rounded(Q.missingness_rates(df, keys, F.col("event_observed") == 1, 0.01, 0.12), overall=6, segment=6)


@query(
    CANON
    + """, t AS (SELECT 'UNIQUE_ID' AS code, count(*) AS expected FROM customer WHERE c_custkey % 50 = 49 AND c_custkey % 97 <> 13 UNION ALL SELECT 'CUSTOMER_ID', count(*) FROM customer WHERE c_custkey % 97 = 13),
    a AS (SELECT code, count(*) AS actual FROM errors GROUP BY 1) SELECT code, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(expected, 0) = coalesce(actual, 0) AS ok FROM t FULL JOIN a USING (code) WHERE coalesce(expected, 0) + coalesce(actual, 0) > 0"""
)
def truth_reconciliation(spark, sf_dir):
    from ..operators import validate as V

    customer = view(spark, sf_dir, "customer")
    blank, again = F.col("c_custkey") % 97 == 13, F.col("c_custkey") % 50 == 49
    planted = customer.where(blank | again).select(F.when(blank, "CUSTOMER_ID").otherwise("UNIQUE_ID").alias("code"))
    errors = V.row_errors(canonical_accounts(spark, sf_dir), V.ValidationConfig(), REF)
    return Q.truth_reconciliation(planted, errors)


define(
    "runs",
    "orders",
    """SELECT 'run-' || CAST(o_orderkey AS STRING) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'stopped' WHEN 'O' THEN 'finished' ELSE 'running' END AS status,
         'model-' || CAST(o_custkey % 4 AS STRING) AS model_version, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS started_at,
         CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS finished_at, CASE WHEN o_orderkey % 7 = 0 THEN 'run-x' END AS superseded_by FROM orders""",
)


@query(ctes("runs") + "SELECT run_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM runs WHERE status = 'finished' AND model_version = 'model-1' ORDER BY created_at DESC, run_id LIMIT 20 OFFSET 40")
def run_history(spark, sf_dir):
    page = Q.run_history(view(spark, sf_dir, "runs"), "finished", "model-1", 20, 40)
    return page.select("run_id", F.to_date("created_at").cast("string").alias("day"))


@query(
    ctes("runs")
    + """, n AS (SELECT run_id, 'done' AS status, model_version, NULL AS created_at, started_at, finished_at, NULL AS superseded_by FROM runs WHERE length(run_id) % 2 = 0 UNION ALL
    SELECT run_id || '-b', status, model_version, created_at, started_at, finished_at, superseded_by FROM runs WHERE status = 'running')
    SELECT coalesce(n.run_id, o.run_id) AS run_id, CASE WHEN n.run_id IS NOT NULL THEN n.status ELSE o.status END AS status, CAST(CAST(coalesce(n.created_at, o.created_at) AS DATE) AS VARCHAR) AS day,
      coalesce(n.superseded_by, o.superseded_by) AS superseded_by FROM runs o FULL JOIN n ON o.run_id = n.run_id"""
)
def merge_runs(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    changed = runs.where("length(run_id) % 2 = 0").withColumn("status", F.lit("done"))
    changed = changed.withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("superseded_by", F.lit(None).cast("string"))
    fresh = runs.where("status = 'running'").withColumn("run_id", F.concat("run_id", F.lit("-b")))
    merged = Q.merge_runs(runs, changed.unionByName(fresh))
    return merged.select("run_id", "status", F.to_date("created_at").cast("string").alias("day"), "superseded_by")


_RETAINED = """, t AS (SELECT *, coalesce(finished_at, started_at, created_at) AS moment FROM runs),
    e AS (SELECT *, status IN ('stopped', 'interrupted', 'failed') AND moment < TIMESTAMP '2001-08-01' - INTERVAL 400 DAY AS expired FROM t),
    k AS (SELECT run_id, row_number() OVER (ORDER BY moment DESC, run_id DESC) AS place FROM e WHERE NOT expired AND status NOT IN ('queued', 'pending', 'running')),
    gone AS (SELECT e.run_id, CASE WHEN expired THEN 'expired' ELSE 'beyond newest' END AS reason, model_version FROM e LEFT JOIN k USING (run_id) WHERE expired OR place > 300)
"""


@query(ctes("runs") + _RETAINED + " SELECT run_id, reason FROM gone")
def retention(spark, sf_dir):
    return Q.retention(view(spark, sf_dir, "runs"), REF, ttl_days=400, keep=300)


define(
    "saved_models",
    "orders",
    """SELECT 'model-' || CAST(o_custkey AS STRING) AS model_version, max(o_orderdate) AS saved_at FROM orders GROUP BY o_custkey""",
)


@query(
    ctes("runs", "saved_models")
    + _RETAINED
    + """, m AS (SELECT *, row_number() OVER (ORDER BY saved_at DESC, model_version DESC) AS place FROM saved_models)
    SELECT model_version FROM m WHERE place > 20 AND model_version NOT IN (
      SELECT model_version FROM runs WHERE run_id NOT IN (SELECT run_id FROM gone))"""
)
def model_retention(spark, sf_dir):
    """Models beyond the newest that no run which stays refers to."""
    runs = view(spark, sf_dir, "runs")
    stay = runs.join(Q.retention(runs, REF, ttl_days=400, keep=300), "run_id", "left_anti")
    return Q.model_retention(view(spark, sf_dir, "saved_models"), stay, keep=20)


@query(
    CANON
    + """ SELECT row_id, CASE WHEN row_id % 20 = 1 THEN 'only stored' ELSE 'changed' END AS difference FROM accepted WHERE row_id % 20 = 1 OR row_id % 20 = 2"""
)
def reproducibility_diff(spark, sf_dir):
    """Accepted rows against a copy without some and with some changed."""
    stored = accepted_accounts(spark, sf_dir).select("row_id", "customer_id", "tenure", "event_observed")
    other = stored.where("row_id % 20 != 1").withColumn("tenure", F.when(F.col("row_id") % 20 == 2, F.col("tenure") + 1).otherwise(F.col("tenure")))
    return Q.reproducibility_diff(stored, other, ["row_id"])
