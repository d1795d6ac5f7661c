"""Queries of support text, on messages derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import support as T
from .views import ctes, define, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CFG = T.SupportConfig(reference_date="2024-01-28", lookback_days=20, max_threads=6, max_messages=3, max_tokens=40)
REF = CFG.reference_date


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


PHRASES = (
    "I want to cancel my subscription, please help",
    "thinking about cancelling our plan next month",
    "When does my plan renew? I need the renewal date",
    "The system is down, complete outage since the morning",
    "We got an error in the export again",
    "This is urgent and unacceptable",
    "I am frustrated, support was slow and unhelpful",
    "You charged twice, I need a refund",
    "the missing feature we talked about",
    "we are evaluating alternatives and other vendors",
    "might switch to a competitor",
    "great job, very helpful, love the product",
    "this is not a bug, never an outage, all good",
    "hello  there, how do I add a seat?",
    "Hallo, bitte wie kann ich das ändern, ich und wir",
    "Bonjour, je ne peux pas avec le mot de passe, vous pouvez aider?",
)
_CASE = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES))

define(
    "support_messages",
    "events",
    f"""SELECT 'T-' || CAST(user_id AS STRING) || '-' || CAST(@since(ts) AS STRING) AS thread_id,
         'm' || CAST(event_id AS STRING) AS message_id, CASE WHEN user_id % 29 = 7 THEN ' ' ELSE 'CUST-' || CAST(user_id AS STRING) END AS customer_id, ts,
         CASE WHEN event_id % 20 = 0 THEN 'system' WHEN event_type = 'view' THEN 'agent' ELSE 'customer' END AS role,
         user_id, @since(ts) AS day, (event_id * 7 + user_id) % 16 AS phrase, CASE (event_id * 7 + user_id) % 16 {_CASE} END AS text FROM events""",
)

define(
    "support_threads",
    "support_messages",
    """SELECT thread_id, customer_id, min(ts) AS created_at, min(text) AS subject, CASE WHEN min(phrase) % 5 = 1 THEN 'EN_us' END AS language,
         CASE min(phrase) % 4 WHEN 1 THEN 'T-' || CAST(max(user_id) AS STRING) || '-' || CAST(max(day) - 1 AS STRING)
           WHEN 2 THEN 'T-' || CAST(max(user_id) AS STRING) || '-' || CAST(max(day) + 1 AS STRING) WHEN 3 THEN 'T-none' END AS duplicate_of,
         'native' AS source FROM support_messages GROUP BY thread_id, customer_id""",
)
# phrase -> flag type, severity, strength, sentiment, rule; as the keyword rules see the phrases
_FLAGS = {
    0: ("cancellation_intent", "high", "strong", -0.6, 0), 1: ("cancellation_intent", "medium", "moderate", -0.4, 1),
    2: ("renewal_or_contract_concern", "medium", "moderate", 0.0, 3), 3: ("product_bug_or_outage", "high", "strong", -0.5, 4),
    4: ("product_bug_or_outage", "medium", "moderate", -0.4, 6), 5: ("poor_support_experience", "high", "strong", -0.7, 7),
    6: ("poor_support_experience", "medium", "moderate", -0.5, 8), 7: ("billing_complaint", "medium", "moderate", -0.4, 9),
    8: ("feature_missing", "medium", "moderate", -0.3, 10), 9: ("competitor_mention", "medium", "moderate", -0.3, 11),
    10: ("competitor_mention", "low", "weak", -0.2, 12), 11: ("positive_feedback", "low", "weak", 0.6, 13),
}


def _case(i: int) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS {'INT' if i == 4 else 'DOUBLE'})"
    return "CASE phrase " + " ".join(f"WHEN {k} THEN {quote(v[i])}" for k, v in _FLAGS.items()) + " END"


define(
    "support_flags",
    "support_messages support_threads",
    f"""SELECT thread_id, customer_id, created_at, flag_type, severity, signal_strength, sentiment, rule, message_id, ts, text FROM (
         SELECT h.*, row_number() OVER (PARTITION BY thread_id, flag_type ORDER BY rule, ts, message_id) AS k FROM (
           SELECT m.thread_id, m.customer_id, t.created_at, m.message_id, m.ts, m.text, {_case(0)} AS flag_type, {_case(1)} AS severity,
             {_case(2)} AS signal_strength, {_case(3)} AS sentiment, {_case(4)} AS rule FROM support_messages m
           JOIN support_threads t ON m.thread_id = t.thread_id WHERE m.role = 'customer' AND phrase < 12) h) x WHERE k = 1""",
)
define(
    "support_mentions",
    "support_messages",
    """SELECT thread_id, max(CASE WHEN phrase IN (0, 1, 7, 10) THEN 1 ELSE 0 END) = 1 AS churn_language,
         max(CASE WHEN phrase = 5 THEN 1 ELSE 0 END) = 1 AS urgent FROM support_messages WHERE role = 'customer' GROUP BY thread_id""",
)


def _v(spark, sf_dir, name):
    return view(spark, sf_dir, name)


IN_WINDOW = f"trim(customer_id) <> '' AND date_diff('day', CAST(created_at AS DATE), DATE '{REF}') BETWEEN 0 AND {CFG.lookback_days}"


@query(ctes("support_threads") + f"SELECT thread_id, customer_id FROM support_threads WHERE {IN_WINDOW}")
def threads_in_window(spark, sf_dir):
    return T.threads_in_window(_v(spark, sf_dir, "support_threads"), CFG).select("thread_id", "customer_id")


_FP = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
CLEAN = f""", r AS (SELECT *, CASE WHEN role = 'customer' THEN {_FP} END AS fp FROM support_messages WHERE role <> 'system' AND CAST(ts AS DATE) <= DATE '{REF}'),
  r2 AS (SELECT *, row_number() OVER (PARTITION BY thread_id, fp ORDER BY ts, message_id) AS k FROM r),
  r3 AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, message_id) AS n_th FROM r2 WHERE NOT (role = 'customer' AND fp <> '' AND k > 1)),
  cleaned AS (SELECT * FROM r3 WHERE n_th <= {CFG.max_messages})"""


@query(ctes("support_messages") + CLEAN + " SELECT thread_id, message_id, role, n_th FROM cleaned")
def clean_messages(spark, sf_dir):
    return T.clean_messages(_v(spark, sf_dir, "support_messages"), CFG).select("thread_id", "message_id", "role", "n_th")


@query(
    ctes("support_messages")
    + CLEAN
    + f""" SELECT 'system' AS reason, count(*) AS n FROM support_messages WHERE role = 'system' UNION ALL
    SELECT 'future', count(*) FROM support_messages WHERE role <> 'system' AND CAST(ts AS DATE) > DATE '{REF}' UNION ALL
    SELECT 'repeated or capped', (SELECT count(*) FROM r) - (SELECT count(*) FROM cleaned)"""
)
def message_removals(spark, sf_dir):
    m = _v(spark, sf_dir, "support_messages")
    return T.removal_counts(m, T.clean_messages(m, CFG), CFG)


def _q_language(text: str) -> str:
    from ..vocab import ACCENTS, LANGUAGES, STOPWORDS

    parts = []
    for code in LANGUAGES:
        words = ", ".join(f"'{w}'" for w in STOPWORDS[code])
        score = f"len(list_intersect(w, [{words}]))"
        if code in ACCENTS:
            score += f" + 0.5 * (length(low) - length(translate(low, '{''.join(ACCENTS[code])}', '')))"
        parts.append(f"{score} AS s_{code}")
    pick = " ".join(f"WHEN s_{c} = best THEN '{c}'" for c in LANGUAGES)
    return rf"""(SELECT *, CASE WHEN best > 0 AND len(w) > 0 THEN CASE {pick} END END AS detected FROM (SELECT *, greatest({', '.join(f's_{c}' for c in LANGUAGES)}) AS best FROM (
      SELECT *, {', '.join(parts)} FROM (SELECT *, list_distinct(regexp_extract_all(lower({text}), '\p{{L}}+')) AS w, lower({text}) AS low FROM src))))"""


@query("WITH src AS (SELECT doc_id, text FROM documents) SELECT doc_id, detected FROM " + _q_language("text"))
def detect_language(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@query(
    ctes("support_threads")
    + ", src AS (SELECT * FROM support_threads) SELECT thread_id, l AS language, CASE WHEN l IS NULL THEN 'unknown' WHEN l = 'en' THEN 'supported' ELSE 'unsupported' END AS language_status FROM (SELECT *, coalesce(CASE WHEN language = 'EN_us' THEN 'en' END, detected) AS l FROM "
    + _q_language("subject")
    + ")"
)
def language_status(spark, sf_dir):
    df = T.language_status(_v(spark, sf_dir, "support_threads"), CFG, text="subject")
    return df.select("thread_id", "language", "language_status")


@query(
    ctes("support_threads")
    + ", src AS (SELECT * FROM support_threads), told AS (SELECT *, coalesce(CASE WHEN language = 'EN_us' THEN 'en' END, detected) AS l FROM "
    + _q_language("subject")
    + f"""), judged AS (SELECT *, trim(customer_id) <> '' AS named, date_diff('day', CAST(created_at AS DATE), DATE '{REF}') BETWEEN 0 AND {CFG.lookback_days} AS near FROM told)
    SELECT 'input' AS item, count(*) AS n FROM judged UNION ALL SELECT 'invalid', count(*) FROM judged WHERE NOT named
    UNION ALL SELECT 'out_of_window', count(*) FROM judged WHERE named AND NOT near UNION ALL SELECT 'unsupported_language', count(*) FROM judged WHERE named AND near AND l <> 'en'
    UNION ALL SELECT 'unknown_language', count(*) FROM judged WHERE named AND near AND l IS NULL"""
)
def preprocessing_counts(spark, sf_dir):
    return T.preprocessing_counts(_v(spark, sf_dir, "support_threads"), CFG, text="subject")


def docs_of(spark, sf_dir):
    threads = T.threads_in_window(_v(spark, sf_dir, "support_threads"), CFG)
    return T.candidate_text(threads, _v(spark, sf_dir, "support_messages"))


SIMILAR = (
    ctes("support_threads")
    + rf""", win AS (SELECT * FROM support_threads WHERE {IN_WINDOW}),
  firsts AS (SELECT thread_id, min_by(text, (ts, message_id)) AS first FROM support_messages WHERE role = 'customer' GROUP BY thread_id),
  docs AS (SELECT win.*, trim(coalesce(subject, '') || ' ' || coalesce(first, '')) AS doc FROM win LEFT JOIN firsts USING (thread_id)),
  terms AS (SELECT customer_id, thread_id, created_at, unnest(regexp_extract_all(lower(doc), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM docs),
  tf AS (SELECT customer_id, thread_id, created_at, term, count(*) AS tf FROM terms GROUP BY ALL),
  n AS (SELECT customer_id, count(*) AS n FROM docs GROUP BY 1), df AS (SELECT customer_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
  w0 AS (SELECT tf.*, tf.tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (customer_id, term) JOIN n USING (customer_id)),
  w AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY thread_id)) AS u FROM w0),
  sim AS (SELECT a.customer_id, a.thread_id AS a, b.thread_id AS b, sum(a.u * b.u) AS cosine FROM w a JOIN w b ON a.customer_id = b.customer_id AND a.term = b.term
    AND (a.created_at, a.thread_id) < (b.created_at, b.thread_id) AND floor(epoch(b.created_at)) - floor(epoch(a.created_at)) <= 172800 GROUP BY 1, 2, 3)"""
)


@query(SIMILAR + " SELECT customer_id, a, b, round(cosine, 6) AS cosine FROM sim")
def thread_similarity(spark, sf_dir):
    return rounded(T.thread_similarity(docs_of(spark, sf_dir)), cosine=6)


def _ratio_rows() -> str:
    """The matching-blocks ratio of each two phrases (the subjects of the threads), as the standard library gives it."""
    from difflib import SequenceMatcher

    norm = [" ".join(p.lower().split()) for p in PHRASES]
    rows = [(a, b, SequenceMatcher(None, x, y).ratio()) for a, x in zip(PHRASES, norm) for b, y in zip(PHRASES, norm)]
    return ", ".join(f"('{a}', '{b}', {r!r})" for a, b, r in rows)


_SHARED = " OR ".join(f"(contains(lower(x.doc), '{k}') AND contains(lower(y.doc), '{k}'))" for k in T.KEY_PHRASES)


@query(
    SIMILAR
    + f""", ratios AS (SELECT * FROM (VALUES {_ratio_rows()}) v(sa, sb, ratio))
    SELECT sim.customer_id, a, b FROM sim JOIN docs x ON x.thread_id = a JOIN docs y ON y.thread_id = b LEFT JOIN ratios ON sa = x.subject AND sb = y.subject
    WHERE cosine >= {CFG.dedup_cosine} AND (({_SHARED}) OR coalesce(ratio, 0) >= {CFG.dedup_subject})"""
)
def duplicate_pairs(spark, sf_dir):
    return T.duplicate_pairs(docs_of(spark, sf_dir), CFG)


@query()
def collapse_duplicates(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return T.collapse_duplicates(docs, T.duplicate_pairs(docs, CFG), CFG)


_TOKENS = "regexp_extract_all(text, '\\S+')"


@query(
    ctes("support_threads")
    + f""", win AS (SELECT * FROM support_threads WHERE {IN_WINDOW}),
    tok AS (SELECT thread_id, sum(len({_TOKENS})) AS tokens FROM support_messages WHERE role = 'customer' GROUP BY 1),
    d AS (SELECT win.*, coalesce(tokens, 0) AS tokens, CASE WHEN language = 'EN_us' THEN 'supported' ELSE 'unknown' END AS st FROM win LEFT JOIN tok USING (thread_id)),
    c AS (SELECT *, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY customer_id ORDER BY created_at DESC, thread_id DESC)),
    s AS (SELECT *, sum(CASE WHEN k <= {CFG.max_threads} THEN tokens ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY k) AS total FROM c),
    o AS (SELECT *, max((total > {CFG.max_tokens} AND k <= {CFG.max_threads})::INT) OVER (PARTITION BY customer_id ORDER BY k) = 1 AS stopped FROM s)
    SELECT thread_id, tokens, k <= {CFG.max_threads} AND NOT stopped AS kept, stopped AS budget_exceeded FROM o"""
)
def cap_threads(spark, sf_dir):
    docs = docs_of(spark, sf_dir).withColumn("language_status", F.when(F.col("language") == "EN_us", "supported").otherwise("unknown"))
    return T.cap_threads(docs, CFG).select("thread_id", "tokens", "kept", "budget_exceeded")


def q_mentions(source: str, key: str, keywords: list[tuple[str, int]]) -> str:
    """DuckDB: the rows of ``source`` whose text meets a rule, from (keyword, rule): the text before each place of each
    keyword must not end in a word, nor hold a negation among its last three tokens."""
    words = ", ".join(f"('{k}', {r})" for k, r in keywords)
    negations = ", ".join("'" + n.replace("'", "''") + "'" for n in T.NEGATIONS)
    return f"""(SELECT DISTINCT {key}, rule FROM (
      SELECT {key}, rule, left(text, (list_sum([length(x) FOR x IN pieces[1:i]]) + (i - 1) * length(keyword))::BIGINT) AS before FROM (
        SELECT {key}, lower(text) AS text, keyword, rule, pieces, unnest(range(1, len(pieces))) AS i FROM (
          SELECT {key}, text, keyword, rule, string_split(lower(text), keyword) AS pieces FROM {source}, (VALUES {words}) k(keyword, rule)
          WHERE contains(lower(text), keyword)))) WHERE NOT regexp_matches(before, '[\\p{{L}}\\p{{N}}_]$')
      AND NOT list_has_any(regexp_extract_all(before, '[\\p{{L}}\\p{{N}}_'']+')[-3:], [{negations}]))"""


_RULE_WORDS = [(k, n) for n, rule in enumerate(T.FLAG_RULES) for k in rule[4]]
_RULE_ROWS = ", ".join(f"({n}, '{r[0]}', '{r[1]}', '{r[2]}', CAST({r[3]} AS DOUBLE))" for n, r in enumerate(T.FLAG_RULES))


@query(
    ctes("support_messages")
    + f""", src AS (SELECT * FROM support_messages WHERE role = 'customer'), met AS {q_mentions('src', 'message_id', _RULE_WORDS)},
    hits AS (SELECT src.thread_id, src.message_id, src.ts, v.* FROM met JOIN src USING (message_id) JOIN (VALUES {_RULE_ROWS}) v(rule, flag_type, severity, signal_strength, sentiment) USING (rule))
    SELECT thread_id, flag_type, severity, signal_strength, sentiment, rule, message_id FROM (
      SELECT *, row_number() OVER (PARTITION BY thread_id, flag_type ORDER BY rule, ts, message_id) AS k FROM hits) WHERE k = 1"""
)
def extract_flags(spark, sf_dir):
    found = T.extract_flags(_v(spark, sf_dir, "support_messages").select("thread_id", "message_id", "ts", "role", "text"))
    return found.select("thread_id", "flag_type", "severity", "signal_strength", "sentiment", "rule", "message_id")


@query(
    ctes("support_messages")
    + f"""SELECT thread_id, sum((role = 'customer')::INT) AS n_customer, sum((role = 'agent')::INT) AS n_agent,
    sum(CASE WHEN role = 'customer' THEN len({_TOKENS}) ELSE 0 END) AS tokens, CAST(date_trunc('second', max(ts)) AS VARCHAR) AS latest FROM support_messages GROUP BY thread_id"""
)
def thread_counts(spark, sf_dir):
    df = T.thread_counts(_v(spark, sf_dir, "support_messages"))
    return df.withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


SIGNALS = (
    ctes("support_flags", "support_mentions", "support_threads")
    + """, cnt AS (SELECT thread_id, sum((role = 'customer')::INT) AS n_customer, sum((role = 'agent')::INT) AS n_agent, max(ts) AS latest FROM support_messages GROUP BY 1),
  per AS (SELECT thread_id, avg(sentiment) AS mean, max((sentiment < 0)::INT) AS neg, max((sentiment > 0)::INT) AS pos, string_agg(flag_type, ',' ORDER BY rule, flag_type) AS themes,
    max((flag_type = 'cancellation_intent' AND signal_strength = 'strong')::INT) AS strong, max((flag_type IN ('cancellation_intent', 'product_bug_or_outage'))::INT) AS serious FROM support_flags GROUP BY 1),
  signals AS (SELECT t.*, coalesce(n_customer, 0) AS n_customer, coalesce(n_agent, 0) AS n_agent, latest,
    CASE WHEN themes IS NULL THEN CASE WHEN churn_language THEN 'negative' ELSE 'neutral' END WHEN neg = 1 AND pos = 1 THEN 'mixed' WHEN pos = 1 THEN 'positive' ELSE 'negative' END AS sentiment,
    CASE WHEN themes IS NULL THEN CASE WHEN churn_language THEN -0.4 ELSE 0.0 END ELSE round_even(mean, 3) END AS score,
    CASE WHEN coalesce(n_customer, 0) = 0 THEN 0.0 ELSE 0.6 END AS confidence,
    CASE WHEN coalesce(n_customer, 0) = 0 THEN 'unknown' WHEN urgent OR strong = 1 THEN 'high' WHEN serious = 1 THEN 'medium' ELSE 'low' END AS urgency,
    coalesce(churn_language, false) AS churn_language, coalesce(themes, 'other') AS themes
    FROM support_threads t LEFT JOIN cnt USING (thread_id) LEFT JOIN per USING (thread_id) LEFT JOIN support_mentions USING (thread_id))"""
)


def signals_of(spark, sf_dir):
    m = _v(spark, sf_dir, "support_messages")
    return T.thread_signals(_v(spark, sf_dir, "support_threads"), T.thread_counts(m), _v(spark, sf_dir, "support_flags"), _v(spark, sf_dir, "support_mentions"))


@query(SIGNALS + " SELECT thread_id, n_customer, n_agent, sentiment, score, confidence, urgency, churn_language, themes FROM signals")
def thread_signals(spark, sf_dir):
    return signals_of(spark, sf_dir).select("thread_id", "n_customer", "n_agent", "sentiment", "score", "confidence", "urgency", "churn_language", "themes")


@query(ctes("support_mentions") + "SELECT thread_id, churn_language, urgent FROM support_mentions")
def thread_mentions(spark, sf_dir):
    return T.thread_mentions(_v(spark, sf_dir, "support_messages"))


_AGE = f"date_diff('day', CAST(created_at AS DATE), DATE '{REF}')"
_STRENGTH = "CASE signal_strength WHEN 'weak' THEN 1.0 WHEN 'moderate' THEN 2.0 ELSE 3.0 END"
_RATE = "CASE WHEN flag_type IN ('cancellation_intent', 'renewal_or_contract_concern') THEN 0.004 ELSE 0.015 END"
_RANK = "CASE flag_type WHEN 'cancellation_intent' THEN 1 WHEN 'renewal_or_contract_concern' THEN 2 WHEN 'product_bug_or_outage' THEN 3 WHEN 'poor_support_experience' THEN 3 WHEN 'billing_complaint' THEN 4 WHEN 'feature_missing' THEN 4 WHEN 'competitor_mention' THEN 5 ELSE 99 END"
AGG = f""", fl AS (SELECT *, {_STRENGTH} * exp(-({_RATE}) * {_AGE}) AS adjusted FROM support_flags),
  agg AS (SELECT customer_id, flag_type, max_by(severity, (adjusted, created_at, message_id)) AS severity, max_by(signal_strength, (adjusted, created_at, message_id)) AS signal_strength,
    max(adjusted) AS adjusted, max_by(message_id, (adjusted, created_at, message_id)) AS strongest_message, count(*) AS recurrence,
    string_agg(message_id, ',' ORDER BY created_at, thread_id, message_id) AS message_ids, {_RANK} AS hierarchy_rank FROM fl GROUP BY customer_id, flag_type)"""


@query(
    ctes("support_flags")
    + AGG
    + " SELECT customer_id, flag_type, severity, signal_strength, round(adjusted, 6) AS adjusted, strongest_message, recurrence, message_ids, hierarchy_rank FROM agg"
)
def aggregate_flags(spark, sf_dir):
    return rounded(T.aggregate_flags(_v(spark, sf_dir, "support_flags"), CFG), adjusted=6).drop("first_seen", "last_seen")


@query(
    SIGNALS
    + f""", s AS (SELECT customer_id, round_even(sum(exp(-0.015 * {_AGE}) * score) / sum(exp(-0.015 * {_AGE})), 3) AS score, round_even(avg(confidence), 3) AS confidence FROM signals GROUP BY 1)
    SELECT customer_id, score, confidence, CASE WHEN score > 0.25 THEN 'positive' WHEN score < -0.25 THEN 'negative' ELSE 'neutral' END AS label FROM s"""
)
def overall_sentiment(spark, sf_dir):
    return T.overall_sentiment(signals_of(spark, sf_dir), CFG)


_QUALITY = f"round_even(avg(least(1.0, 0.75 * least(1.0, len({_TOKENS}) / 12) + CASE WHEN regexp_matches(lower(text), 'cancel|cancelling|terminate|switch|leave|refund') THEN 0.25 ELSE 0 END)), 3)"


@query(ctes("support_flags") + f"SELECT customer_id, {_QUALITY} AS quality FROM support_flags GROUP BY customer_id")
def signal_confidence(spark, sf_dir):
    return T.evidence_quality(_v(spark, sf_dir, "support_flags"))


CUSTOMERS = (
    SIGNALS
    + AGG
    + f""", universe AS (SELECT DISTINCT customer_id FROM support_threads UNION SELECT 'CUST-none'),
  sg AS (SELECT *, language IS NULL AND length(thread_id) % 4 = 0 AS failed, CASE WHEN language IS NULL THEN 'unknown' ELSE 'supported' END AS language_status FROM signals),
  pc AS (SELECT customer_id, count(*) AS n_threads, sum(n_customer + n_agent) AS n_messages, sum(CASE WHEN NOT failed THEN n_customer ELSE 0 END) AS n_customer, sum((NOT failed)::INT) AS n_usable,
    sum((language_status = 'supported')::INT) AS n_supported, max(CASE WHEN NOT failed THEN CASE urgency WHEN 'unknown' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END END) AS u,
    max((NOT failed AND churn_language)::INT) AS churn FROM sg GROUP BY 1),
  uf AS (SELECT * FROM fl WHERE thread_id IN (SELECT thread_id FROM sg WHERE NOT failed)),
  ua AS (SELECT customer_id, flag_type, max_by(severity, (adjusted, created_at, message_id)) AS severity, max_by(signal_strength, (adjusted, created_at, message_id)) AS signal_strength, max(adjusted) AS adjusted,
    count(*) AS recurrence, {_RANK} AS hr FROM uf GROUP BY 1, 2),
  tp AS (SELECT customer_id, arg_min(signal_strength, (hr, -adjusted, flag_type)) AS signal_strength, max((severity = 'high' AND recurrence >= 2)::INT) AS repeated, count(*) AS n_flags FROM ua GROUP BY 1),
  ql AS (SELECT customer_id, {_QUALITY} AS quality FROM uf GROUP BY 1),
  md AS (SELECT customer_id, round_even(sum(exp(-0.015 * {_AGE}) * score) / sum(exp(-0.015 * {_AGE})), 3) AS sc FROM sg WHERE NOT failed GROUP BY 1),
  cu AS (SELECT customer_id, CASE WHEN coalesce(n_threads, 0) = 0 THEN 'no_data' WHEN n_customer < 3 OR n_usable = 0 THEN 'limited_data' ELSE 'sufficient_data' END AS status,
    coalesce(n_threads, 0) AS n_threads, coalesce(n_messages, 0) AS n_messages, sc AS sentiment_score, coalesce(signal_strength, 'none') AS signal_strength, coalesce(n_customer, 0) AS nc, coalesce(n_usable, 0) AS nu,
    coalesce(round_even(n_usable / n_threads, 3), 0) AS validity, coalesce(round_even(n_supported / n_threads, 3), 0) AS coverage, coalesce(quality, 0) AS quality, coalesce(u, 0) AS u,
    coalesce(repeated, 0) AS repeated, coalesce(churn, 0) = 1 AS churn_language, coalesce(n_flags, 0) AS n_flags FROM universe LEFT JOIN pc USING (customer_id) LEFT JOIN tp USING (customer_id)
    LEFT JOIN ql USING (customer_id) LEFT JOIN md USING (customer_id)),
  customers AS (SELECT *, CASE WHEN status = 'no_data' THEN 0.0 ELSE round_even(0.2 * least(1.0, sqrt(nc / 8)) + 0.2 * least(1.0, nu / 3) + 0.2 * validity + 0.15 * coverage + 0.25 * quality, 3) END AS confidence FROM cu)"""
)


def customers_of(spark, sf_dir):
    signals = signals_of(spark, sf_dir)
    failed = F.col("language").isNull() & (F.length("thread_id") % 4 == 0)
    signals = signals.withColumn("failed", failed).withColumn("language_status", F.when(F.col("language").isNull(), "unknown").otherwise("supported"))
    universe = signals.select("customer_id").distinct().union(spark.createDataFrame([("CUST-none",)], "customer_id string"))
    return T.customer_signals(universe, signals, _v(spark, sf_dir, "support_flags"), CFG)


@query(
    CUSTOMERS
    + """ SELECT customer_id, status, n_threads, n_messages, sentiment_score, signal_strength, confidence,
    CASE u WHEN 0 THEN 'unknown' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS urgency, u = 3 OR repeated = 1 AS escalation, churn_language, n_flags FROM customers"""
)
def customer_signals(spark, sf_dir):
    return customers_of(spark, sf_dir).drop("latest", "sentiment", "summary")


@query(ctes("support_flags") + "SELECT 100 * avg((flag_type = 'other')::INT) AS other_pct, 100 * avg((flag_type = 'other')::INT) > 20 AS review FROM support_flags")
def vocabulary_governance(spark, sf_dir):
    return T.vocabulary_governance(_v(spark, sf_dir, "support_flags"))


@query(
    CUSTOMERS
    + """ SELECT 'requested' AS item, count(*) AS n FROM customers UNION ALL SELECT 'with_data', sum((status <> 'no_data')::INT) FROM customers UNION ALL
    SELECT 'with_flags', sum((n_flags > 0)::INT) FROM customers UNION ALL SELECT 'limited', sum((status = 'limited_data')::INT) FROM customers UNION ALL SELECT 'threads', sum(n_threads) FROM customers"""
)
def support_report(spark, sf_dir):
    return T.support_report(customers_of(spark, sf_dir))


define(
    "model_replies",
    "support_messages",
    """SELECT thread_id, CASE length(thread_id) % 2 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw_reply FROM (
         SELECT thread_id, CASE min(phrase) % 12 WHEN 5 THEN 'sorry, no JSON' WHEN 4 THEN '{"sentiment": {"label": "angry", "score": 0.1}}'
           WHEN 3 THEN '{"sentiment": {"label": "negative", "score": -7.5}}' WHEN 6 THEN '[1, 2]' WHEN 7 THEN '{"risk_flags": "no"}'
           WHEN 8 THEN '{"urgency_level": "banana"}' WHEN 9 THEN '{"sentiment": {"confidence": 7}}'
           WHEN 10 THEN '{"risk_flags": [{"flag_type": "other", "severity": "low", "signal_strength": "GIGANTIC", "message_id": "' || min(message_id) || '"}]}'
           WHEN 11 THEN '{"sentiment": null, "risk_flags": null, "key_themes": [], "urgency_level": "low"}'
           WHEN 2 THEN '{"risk_flags": [{"flag_type": "boredom", "severity": "low", "signal_strength": "weak", "message_id": "m1"}]}'
           ELSE '{"sentiment": {"label": "negative", "score": -0.5}, "risk_flags": [{"flag_type": "other", "severity": "low", "signal_strength": "weak", "message_id": "' || min(message_id) || '"}]}' END AS body
         FROM support_messages GROUP BY thread_id) b""",
)


@query(
    ctes("model_replies")
    + """, m AS (SELECT thread_id, min(phrase) % 12 AS k, min(message_id) AS cited FROM support_messages GROUP BY 1)
    SELECT m.thread_id, CASE k WHEN 5 THEN 'INVALID_JSON' WHEN 4 THEN 'BAD_LABEL' WHEN 3 THEN 'BAD_SCORE' WHEN 2 THEN 'BAD_FLAG' WHEN 6 THEN 'BAD_SHAPE' WHEN 7 THEN 'BAD_SHAPE'
      WHEN 8 THEN 'BAD_URGENCY' WHEN 9 THEN 'BAD_SCORE' WHEN 10 THEN 'BAD_FLAG' WHEN 11 THEN 'ok' ELSE
      CASE WHEN EXISTS (SELECT 1 FROM support_messages s WHERE s.thread_id = m.thread_id AND s.message_id = m.cited AND s.role = 'customer') THEN 'ok' ELSE 'UNCITED_FLAG' END END AS code FROM m"""
)
def check_model_replies(spark, sf_dir):
    return T.check_model_replies(_v(spark, sf_dir, "model_replies"), _v(spark, sf_dir, "support_messages"))
