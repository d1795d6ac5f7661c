"""Queries of external channels and of the ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import external as X
from ..operators import ranking as R
from . import support as _support  # noqa: F401  (its views are read here)
from .views import ctes, define, view

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


# --- external channels -------------------------------------------------------------------------------------

define(
    "channel_posts",
    "events",
    """SELECT 'p' || CAST(event_id AS STRING) AS id, CASE WHEN event_id % 37 = 5 THEN ' ' ELSE 'user_' || CAST(user_id AS STRING) END AS author_id,
         event_type AS text, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'c' || CAST(event_id % 400 AS STRING) END AS conversation_id
       FROM events WHERE event_id % 2 = 0""",
)
define(
    "channel_mails",
    "events",
    """SELECT 'g' || CAST(event_id AS STRING) AS id, 't' || CAST(event_id % 300 AS STRING) AS thread_id,
         CASE WHEN event_id % 11 = 1 THEN 'Support@acme.com' ELSE 'USER_' || CAST(user_id AS STRING) || '@mail.com' END AS sender,
         ts AS timestamp, CASE WHEN event_id % 7 = 1 THEN 'Re: plan' END AS subject, event_type AS snippet,
         CASE WHEN event_id % 5 = 1 THEN '' ELSE 'body ' || event_type END AS body FROM events WHERE event_id % 2 = 1""",
)
define("mail_threads", "channel_mails", "SELECT thread_id AS id, min(snippet) AS subject FROM channel_mails WHERE thread_id <> 't5' GROUP BY thread_id")
define(
    "identity_map",
    "customer",
    """SELECT 'x' AS source, 'user_' || CAST(c_custkey AS STRING) AS identity, 'CUST-' || CAST(c_custkey AS STRING) AS customer_id FROM customer WHERE c_custkey % 10 <> 3
       UNION ALL SELECT 'x', 'user_' || CAST(c_custkey AS STRING), 'CUST-other' FROM customer WHERE c_custkey % 25 = 6
       UNION ALL SELECT 'gmail', 'user_' || CAST(c_custkey AS STRING) || '@Mail.com', 'CUST-' || CAST(c_custkey AS STRING) FROM customer WHERE c_custkey % 8 <> 2""",
)
EXT = ctes("channel_posts", "channel_mails", "mail_threads", "identity_map") + """,
 ext0 AS (SELECT 'x' AS source, id AS message_id, coalesce(conversation_id, id) AS thread_id, author_id AS sender, created_at AS ts, text, NULL AS subject FROM channel_posts
   UNION ALL SELECT 'gmail', m.id, m.thread_id, sender, timestamp, CASE WHEN trim(body) <> '' THEN body ELSE snippet END, coalesce(m.subject, t.subject) FROM channel_mails m LEFT JOIN mail_threads t ON m.thread_id = t.id),
 ext AS (SELECT * FROM ext0 WHERE trim(message_id) <> '' AND trim(thread_id) <> '' AND trim(sender) <> '' AND trim(text) <> ''),
 roles AS (SELECT *, CASE WHEN source = 'gmail' AND lower(sender) = 'support@acme.com' THEN 'agent' ELSE 'customer' END AS role FROM ext),
 own AS (SELECT source, CASE WHEN source = 'gmail' THEN lower(trim(identity)) ELSE trim(identity) END AS key, count(DISTINCT customer_id) AS n, min(customer_id) AS owner FROM identity_map GROUP BY 1, 2),
 res AS (SELECT r.*, CASE WHEN role = 'customer' AND n = 1 THEN owner END AS customer_id, CASE WHEN role = 'customer' THEN CASE WHEN n > 1 THEN 'IDENTITY_MAPPING_AMBIGUOUS' WHEN n IS NULL THEN 'UNMAPPED_EXTERNAL_IDENTITY' END END AS error,
   CASE WHEN r.source = 'gmail' THEN lower(trim(sender)) ELSE trim(sender) END AS k FROM roles r LEFT JOIN own ON own.source = r.source AND own.key = CASE WHEN r.source = 'gmail' THEN lower(trim(sender)) ELSE trim(sender) END),
 thr AS (SELECT source, source || ':' || thread_id AS thread_id, CASE WHEN count(DISTINCT customer_id) = 1 THEN min(customer_id) END AS customer_id,
   CASE WHEN count(DISTINCT customer_id) = 0 THEN 'UNRESOLVED_THREAD' WHEN count(DISTINCT customer_id) > 1 THEN 'CROSS_CUSTOMER_CONTAMINATION' END AS error, count(*) AS n_messages,
   arg_min(subject, (ts, message_id)) FILTER (trim(subject) <> '') AS subject, string_agg(source || ':' || message_id, ',' ORDER BY ts, message_id) AS message_ids FROM res GROUP BY source, res.thread_id)
"""


def external_messages(spark, sf_dir):
    posts = X.parse_posts(view(spark, sf_dir, "channel_posts"))
    mails = view(spark, sf_dir, "channel_mails").withColumnRenamed("sender", "from")
    return posts.unionByName(X.parse_mail(mails, view(spark, sf_dir, "mail_threads")))


def resolved(spark, sf_dir):
    agents = spark.createDataFrame([("gmail", "support@acme.com"), ("x", "acme_support")], "source string, sender string")
    roles = X.label_roles(external_messages(spark, sf_dir), agents)
    return X.resolve_identities(roles, view(spark, sf_dir, "identity_map"))


@query(EXT + "SELECT source, message_id, thread_id, sender, text, subject FROM ext")
def parse_channel_exports(spark, sf_dir):
    return external_messages(spark, sf_dir).drop("ts")


@query(EXT + "SELECT source, message_id, role FROM roles")
def label_roles(spark, sf_dir):
    return resolved(spark, sf_dir).select("source", "message_id", "role")


@query(EXT + "SELECT source, message_id, customer_id, error, CASE WHEN error IS NOT NULL THEN 'sha256:' || left(sha256(source || ':' || k), 12) END AS identity FROM res")
def resolve_identities(spark, sf_dir):
    return resolved(spark, sf_dir).select("source", "message_id", "customer_id", "error", "identity")


@query(EXT + "SELECT source, thread_id, customer_id, error, n_messages, subject, message_ids FROM thr")
def build_threads(spark, sf_dir):
    return X.build_threads(resolved(spark, sf_dir)).drop("created_at")


@query(
    EXT
    + """, nat AS (SELECT DISTINCT 'gmail:g' || event_id AS id FROM events WHERE event_id % 50 = 1), e2 AS (SELECT thread_id, message_ids, 1 AS position FROM thr UNION ALL SELECT thread_id, 'again:' || thread_id, 2 FROM thr WHERE source = 'x'),
    h AS (SELECT DISTINCT thread_id, position FROM (SELECT thread_id, position, unnest(list_concat([thread_id], string_split(message_ids, ','))) AS id FROM e2) WHERE id IN (SELECT id FROM nat)),
    n AS (SELECT e2.thread_id, e2.position, h.thread_id IS NOT NULL AS hit FROM e2 LEFT JOIN h ON h.thread_id = e2.thread_id AND h.position = e2.position)
    SELECT thread_id, position, CASE WHEN hit THEN 'collision' WHEN row_number() OVER (PARTITION BY thread_id, hit ORDER BY position) > 1 THEN 'repeated' END AS dropped FROM n"""
)
def id_collisions(spark, sf_dir):
    built = X.build_threads(resolved(spark, sf_dir)).select("source", "thread_id", "message_ids")
    again = built.where("source = 'x'").select("thread_id", F.concat(F.lit("again:"), "thread_id").alias("message_ids"), F.lit(2).alias("position"))
    ext = built.select("thread_id", "message_ids", F.lit(1).alias("position")).union(again)
    native = view(spark, sf_dir, "events").where("event_id % 50 = 1").select(F.concat(F.lit("gmail:g"), F.col("event_id").cast("string")).alias("id"))
    return X.id_collisions(native, ext).select("thread_id", "position", "dropped")


# --- ranking -----------------------------------------------------------------------------------------------

define(
    "rank_scores_once",
    "account_history",
    """SELECT 'CUST-' || CAST(c_custkey AS STRING) AS customer_id, c_custkey AS pos,
         CASE WHEN n IS NULL THEN 'NOT_ENOUGH_DATA' WHEN c_custkey % 17 = 3 THEN 'EXCLUDED' ELSE 'SCORED' END AS state,
         CASE WHEN c_custkey % 19 = 8 THEN NULL ELSE 1 - CAST((q * 3) % 1000 AS DOUBLE) / 1000 END AS survival_90,
         CASE WHEN c_custkey % 19 = 8 AND c_custkey % 2 = 0 THEN NULL ELSE CAST(q AS DOUBLE) / 1000 END AS risk_score,
         CASE WHEN c_custkey % 9 = 4 OR c_custkey % 19 = 8 THEN NULL ELSE 1 - CAST(q AS DOUBLE) / 1000 END AS forward_90,
         1 - CAST(q AS DOUBLE) / 1000 - CAST(c_custkey % 13 AS DOUBLE) / 100 AS forward_lo, 1 - CAST(q AS DOUBLE) / 1000 + CAST(c_custkey % 7 AS DOUBLE) / 100 AS forward_hi,
         CAST(tenure AS DOUBLE) AS tenure_days, churned AS event_observed FROM (
         SELECT *, (@days(last_day; DATE '2001-08-01') * 7) % 900 AS q, @days(first_day; last_day) AS tenure FROM account_history) h""",
)
define(
    "rank_scores",
    "rank_scores_once",
    """SELECT * FROM rank_scores_once UNION ALL SELECT customer_id, pos + 1000000, 'SCORED', 0.5, 0.5, 0.5, 0.4, 0.6, 10.0, 0 FROM rank_scores_once WHERE pos % 40 = 11""",
)
define(
    "rank_flags",
    "support_flags",
    """SELECT customer_id, flag_type, CASE max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity,
         CASE max(CASE signal_strength WHEN 'weak' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END) WHEN 1 THEN 'weak' WHEN 2 THEN 'moderate' ELSE 'strong' END AS signal_strength,
         count(*) AS recurrence, min(message_id) || ',' || max(message_id) AS message_ids FROM support_flags WHERE length(thread_id) % 3 <> 1 GROUP BY customer_id, flag_type""",
)
define(
    "rank_support",
    "support_threads support_mentions",
    """SELECT t.customer_id, 1 AS pos, CASE WHEN count(*) % 7 = 0 THEN 'no_data' WHEN count(*) < 6 THEN 'limited_data' ELSE 'sufficient_data' END AS status,
         count(*) AS n_threads, CAST(count(*) AS DOUBLE) / 40 AS support_confidence, CASE WHEN max(CASE WHEN urgent THEN 1 ELSE 0 END) = 1 AND count(*) % 2 = 0 THEN 'high' ELSE 'low' END AS urgency,
         max(CASE WHEN churn_language THEN 1 ELSE 0 END) = 1 AS churn_language FROM support_threads t LEFT JOIN support_mentions m ON t.thread_id = m.thread_id
       WHERE trim(t.customer_id) <> '' GROUP BY t.customer_id""",
)
_WEIGHT = "CASE flag_type WHEN 'cancellation_intent' THEN 1.0 WHEN 'renewal_or_contract_concern' THEN 0.85 WHEN 'product_bug_or_outage' THEN 0.7 WHEN 'poor_support_experience' THEN 0.7 WHEN 'billing_complaint' THEN 0.55 WHEN 'feature_missing' THEN 0.55 WHEN 'usage_drop_related' THEN 0.55 WHEN 'competitor_mention' THEN 0.45 WHEN 'positive_feedback' THEN 0.0 ELSE 0.3 END"
RANK = ctes("rank_scores", "rank_flags", "rank_support") + f""",
 sc AS (SELECT * EXCLUDE (k, pos) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY pos) AS k FROM rank_scores) WHERE k = 1),
 cm AS (SELECT coalesce(s.customer_id, u.customer_id) AS customer_id, coalesce(state, 'NOT_ENOUGH_DATA') AS state, CASE WHEN state = 'SCORED' THEN survival_90 END AS survival_90,
   CASE WHEN state = 'SCORED' THEN risk_score END AS risk_score, CASE WHEN state = 'SCORED' THEN forward_90 END AS forward_90, CASE WHEN state = 'SCORED' AND forward_hi - forward_lo IS NOT NULL THEN greatest(0, forward_hi - forward_lo) END AS ci_width,
   tenure_days, event_observed, coalesce(state = 'SCORED' AND coalesce(survival_90, risk_score, forward_90) IS NULL, false) AS partial_alignment, coalesce(status, 'no_data') AS status, coalesce(n_threads, 0) AS n_threads,
   coalesce(support_confidence, 0) AS support_confidence, coalesce(urgency, 'unknown') AS urgency, coalesce(churn_language, false) AS churn_language FROM sc s FULL JOIN rank_support u ON s.customer_id = u.customer_id),
 fl AS (SELECT f.*, {_WEIGHT} AS w, CASE signal_strength WHEN 'weak' THEN 0.33 WHEN 'moderate' THEN 0.66 ELSE 1.0 END AS ss, CASE signal_strength WHEN 'weak' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END AS so FROM rank_flags f JOIN cm USING (customer_id) WHERE cm.status <> 'no_data'),
 fa AS (SELECT customer_id, max(w * ss) AS best, max(recurrence) AS most, arg_min(signal_strength, (-so, -w, -recurrence, flag_type)) AS strongest, arg_min(flag_type, (-so, -w, -recurrence, flag_type)) AS strongest_type,
   string_agg(flag_type, ',' ORDER BY so DESC, w DESC, recurrence DESC, flag_type) AS top_flags,
   max((flag_type = 'cancellation_intent' AND so >= 2)::INT) AS c1, max((flag_type = 'cancellation_intent' AND so = 3)::INT) AS c2, max((flag_type <> 'cancellation_intent' AND (severity IN ('medium', 'high') OR so >= 2))::INT) AS other,
   max((flag_type = 'renewal_or_contract_concern' AND so = 3)::INT) AS c3, max((severity = 'high' AND recurrence >= 2)::INT) AS c4, max((recurrence >= 2)::INT) AS rep FROM fl WHERE flag_type <> 'positive_feedback' GROUP BY 1),
 pos AS (SELECT DISTINCT customer_id FROM fl WHERE flag_type = 'positive_feedback'),
 act AS (SELECT * FROM cm WHERE coalesce(event_observed, 0) <> 1),
 br AS (SELECT avg(1 - forward_90) AS base_rate, count(forward_90) AS n, coalesce(count(forward_90) >= 30 AND avg(1 - forward_90) > 0, false) AS use_lift FROM act),
 l0 AS (SELECT act.*, br.base_rate, br.use_lift, CASE WHEN br.use_lift AND forward_90 IS NOT NULL THEN greatest(0, 1 - forward_90) / br.base_rate END AS lf FROM act, br),
 l1 AS (SELECT *, CASE WHEN lf IS NULL THEN NULL WHEN lf <= 1 THEN 0.2 * lf WHEN lf <= 1.5 THEN 0.2 + 0.2 * (lf - 1) / 0.5 WHEN lf <= 3 THEN 0.4 + 0.3 * (lf - 1.5) / 1.5 WHEN lf <= 6 THEN 0.7 + 0.3 * (lf - 3) / 3 ELSE 1 END AS raw FROM l0),
 q AS (SELECT l1.*, CASE WHEN use_lift THEN CASE WHEN raw IS NOT NULL THEN least(1, greatest(0, round_even(raw, 3))) END ELSE CASE WHEN coalesce(survival_90, risk_score) IS NOT NULL THEN least(1, greatest(0, round_even(coalesce(1 - survival_90, risk_score), 3))) END END AS quant, round_even(lf, 3) AS lift,
   CASE WHEN NOT use_lift THEN NULL WHEN forward_90 IS NOT NULL THEN 'available' WHEN state = 'SCORED' THEN 'beyond_follow_up' ELSE 'unavailable' END AS forward_status,
   best, most, coalesce(strongest, 'none') AS strongest, strongest_type, coalesce(top_flags, '') AS top_flags, c1, c2, other, c3, c4, rep, p.customer_id IS NOT NULL AS positive FROM l1 LEFT JOIN fa USING (customer_id) LEFT JOIN pos p ON p.customer_id = l1.customer_id),
 s1 AS (SELECT *, CASE WHEN status = 'no_data' OR best IS NULL THEN 0 ELSE least(1, best + least(0.2, 0.05 * greatest(0, most - 1))) END AS qual,
   concat_ws(',', CASE WHEN c1 = 1 THEN 'critical_cancellation_intent' END, CASE WHEN c2 = 1 AND other = 1 THEN 'critical_cancellation_plus_significant_flag' END,
     CASE WHEN quant >= 0.7 AND c3 = 1 THEN 'critical_high_quant_plus_contract_concern' END, CASE WHEN quant >= 0.7 AND c4 = 1 THEN 'critical_repeated_high_severity_plus_high_quant' END) AS rules FROM q),
 s2 AS (SELECT *, least(1, greatest(0, 0.6 * coalesce(quant, 0) + 0.4 * qual + CASE WHEN quant >= 0.7 AND strongest = 'strong' THEN 0.05 ELSE 0 END)) AS score,
   CASE WHEN quant IS NULL THEN 0 ELSE round_even(round_even(CASE WHEN ci_width IS NULL THEN 0.5 ELSE 1 - least(1, greatest(0, ci_width / 0.2)) END, 3) * round_even(0.5 + 0.5 * least(1, greatest(0, coalesce(tenure_days, 0)) / 180), 3), 3) END AS quant_confidence FROM s1),
 s3 AS (SELECT *, least(1, greatest(0, round_even(0.55 * quant_confidence + 0.45 * support_confidence, 3))) AS confidence,
   CASE WHEN quant IS NULL AND status = 'no_data' THEN 'insufficient_data' WHEN rules <> '' THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level,
   coalesce((quant >= 0.7 AND (positive OR status = 'no_data')) OR (quant < 0.4 AND c1 = 1), false) AS conflict FROM s2),
 s4 AS (SELECT *, concat_ws(',', CASE WHEN rules <> '' THEN rules END, CASE WHEN quant IS NULL THEN 'missing_quantitative_data' WHEN quant >= 0.7 THEN 'high_quantitative_risk' WHEN quant >= 0.4 THEN 'moderate_quantitative_risk' END,
   CASE status WHEN 'no_data' THEN 'missing_support_data' WHEN 'limited_data' THEN 'limited_support_data' END, CASE strongest WHEN 'strong' THEN 'strong_support_signal' WHEN 'moderate' THEN 'moderate_support_signal' END,
   CASE WHEN rep = 1 THEN 'repeated_support_issue' END, CASE WHEN urgency = 'high' THEN 'high_support_urgency' END,
   CASE WHEN conflict THEN 'quantitative_qualitative_conflict' WHEN quant >= 0.7 AND strongest = 'strong' THEN 'quantitative_qualitative_agreement' END) AS reasons FROM s3),
 ranked AS (SELECT *, row_number() OVER (ORDER BY CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, score DESC, churn_language DESC,
   CASE strongest WHEN 'none' THEN 0 WHEN 'weak' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END DESC, quant DESC NULLS LAST, confidence DESC, customer_id) AS rank FROM s4 WHERE level <> 'insufficient_data')
"""


def accounts_of(spark, sf_dir):
    return R.combine(view(spark, sf_dir, "rank_scores"), view(spark, sf_dir, "rank_support"), view(spark, sf_dir, "rank_flags"))


def scored_of(spark, sf_dir):
    return R.score_accounts(R.split_churned(accounts_of(spark, sf_dir))[0])


@query(
    RANK
    + """, a AS (SELECT customer_id, count(*) AS na FROM rank_scores GROUP BY 1), b AS (SELECT customer_id, count(*) AS nb FROM rank_support GROUP BY 1)
    SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, na IS NOT NULL AS in_scores, nb IS NOT NULL AS in_support, greatest(coalesce(na, 0) - 1, 0) + greatest(coalesce(nb, 0) - 1, 0) AS repeats FROM a FULL JOIN b ON a.customer_id = b.customer_id"""
)
def account_universe(spark, sf_dir):
    return R.account_universe(view(spark, sf_dir, "rank_scores"), view(spark, sf_dir, "rank_support"))


@query(RANK + "SELECT customer_id, state, round(survival_90, 6) AS survival_90, round(risk_score, 6) AS risk_score, round(forward_90, 6) AS forward_90, round(ci_width, 6) AS ci_width, partial_alignment, status FROM cm")
def quantitative_inputs(spark, sf_dir):
    df = accounts_of(spark, sf_dir).select("customer_id", "state", "survival_90", "risk_score", "forward_90", "ci_width", "partial_alignment", "status")
    return rounded(df, survival_90=6, risk_score=6, forward_90=6, ci_width=6)


@query(RANK + "SELECT round(base_rate, 6) AS base_rate, n, use_lift FROM br")
def base_rate(spark, sf_dir):
    return rounded(R.base_rate(R.split_churned(accounts_of(spark, sf_dir))[0]), base_rate=6)


@query(RANK + "SELECT customer_id, quant, lift, forward_status FROM q")
def lift_risk(spark, sf_dir):
    return R.quantitative(R.split_churned(accounts_of(spark, sf_dir))[0]).select("customer_id", "quant", "lift", "forward_status")


@query(RANK + "SELECT customer_id, CASE WHEN coalesce(survival_90, risk_score) IS NOT NULL THEN least(1, greatest(0, round_even(coalesce(1 - survival_90, risk_score), 3))) END AS risk FROM act")
def absolute_risk(spark, sf_dir):
    active = R.split_churned(accounts_of(spark, sf_dir))[0]
    return active.select("customer_id", R.absolute_risk(F.col("survival_90"), F.col("risk_score")).alias("risk"))


def _score_query(name: str, sql: str, columns):
    @query(RANK + sql)
    def run(spark, sf_dir):
        return scored_of(spark, sf_dir).select("customer_id", *columns())  # built late: columns need a session

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_score_query("qualitative_score", "SELECT customer_id, round(qual, 6) AS qual FROM s1", lambda: [F.round("qual", 6).alias("qual")])
_score_query("top_flags", "SELECT customer_id, top_flags, strongest FROM q", lambda: [F.array_join(F.transform("top_flags", lambda f: f["flag_type"]), ",").alias("top_flags"), "strongest"])
_score_query("combined_score", "SELECT customer_id, round(score, 6) AS score FROM s2", lambda: [F.round("score", 6).alias("score")])
_score_query("critical_rules", "SELECT customer_id, rules FROM s1", lambda: [F.array_join("rules", ",").alias("rules")])
_score_query("risk_level", "SELECT customer_id, level FROM s3", lambda: ["level"])
_score_query("account_confidence", "SELECT customer_id, quant_confidence, confidence FROM s3", lambda: ["quant_confidence", "confidence"])
_score_query("account_reasons", "SELECT customer_id, reasons FROM s4", lambda: [F.array_join(F.transform("reasons", lambda r: r["reason_type"]), ",").alias("reasons")])


@query(RANK + "SELECT customer_id, tenure_days FROM cm WHERE event_observed = 1")
def split_churned(spark, sf_dir):
    return R.split_churned(accounts_of(spark, sf_dir))[1]


@query(RANK + "SELECT rank, customer_id, level, round(score, 6) AS score, confidence FROM ranked")
def rank_accounts(spark, sf_dir):
    ranked = R.rank_accounts(scored_of(spark, sf_dir))
    return rounded(ranked.select("rank", "customer_id", "level", "score", "confidence"), score=6)


@query(RANK + "SELECT level AS item, count(*) AS n FROM s3 GROUP BY level UNION ALL SELECT 'churned', count(*) FROM cm WHERE event_observed = 1")
def ranking_summary(spark, sf_dir):
    active, churned = R.split_churned(accounts_of(spark, sf_dir))
    return R.ranking_summary(R.score_accounts(active), churned)


@query(
    RANK
    + """, f AS (SELECT customer_id, flag_type, unnest(string_split(message_ids, ',')) AS id, unnest(range(len(string_split(message_ids, ',')))) AS i FROM fl),
    g AS (SELECT customer_id, id, min((flag_type, i)) AS first FROM f GROUP BY 1, 2)
    SELECT cm.customer_id, coalesce(string_agg(id, ',' ORDER BY first), '') AS message_ids FROM cm LEFT JOIN g USING (customer_id) GROUP BY cm.customer_id"""
)
def evidence_refs(spark, sf_dir):
    return R.evidence_refs(accounts_of(spark, sf_dir))


define(
    "driver_rows",
    "account_history",
    """SELECT 'CUST-' || CAST(c_custkey AS STRING) AS customer_id, 'balance' AS feature, CAST(balance AS DOUBLE) / 10000 AS contribution, c_custkey % 2 = 0 AS reliable FROM account_history
       UNION ALL SELECT 'CUST-' || CAST(c_custkey AS STRING), 'orders', CAST(n - 10 AS DOUBLE) / 10, true FROM account_history
       UNION ALL SELECT 'CUST-' || CAST(c_custkey AS STRING), 'nation', CAST(c_nationkey - 12 AS DOUBLE) / 12, c_custkey % 3 <> 0 FROM account_history""",
)


@query(
    ctes("driver_rows")
    + """SELECT customer_id, coalesce(string_agg(feature, ',' ORDER BY contribution DESC, feature) FILTER (contribution > 0 AND reliable), '') AS drivers FROM driver_rows GROUP BY customer_id"""
)
def top_drivers(spark, sf_dir):
    rows = view(spark, sf_dir, "driver_rows").groupBy("customer_id").agg(F.collect_list(F.struct("feature", "contribution", "reliable")).alias("contributions"))
    return R.top_drivers(rows)
