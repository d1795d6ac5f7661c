"""Queries of canonicalisation, routing and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import adapters as A
from ..operators import routing as R
from ..operators import validate as V
from ..vocab import ACTIVE_WORDS, CHURN_WORDS
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


# --- the same parsing in SQL -------------------------------------------------------------------------------


def q_clean(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"


def q_date(c: str) -> str:
    t = q_clean(c)
    tries = [
        (r"\d{4}-\d{2}-\d{2}", t, "%Y-%m-%d"),
        (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?", f"substr({t}, 1, 10)", "%Y-%m-%d"),
        (r"\d{8}", t, "%Y%m%d"),
        (r"\d{4}/\d{1,2}/\d{1,2}", t, "%Y/%m/%d"),
        (r"\d{4}\.\d{1,2}\.\d{1,2}", t, "%Y.%m.%d"),
        (r"\d{1,2}/\d{1,2}/\d{4}", t, "%m/%d/%Y"),
        (r"\d{1,2}-\d{1,2}-\d{4}", t, "%d-%m-%Y"),
        (r"[A-Za-z]{3} \d{1,2}, \d{4}", t, "%b %d, %Y"),
        (r"\d{1,2} [A-Za-z]{3} \d{4}", t, "%d %b %Y"),
    ]
    parts = [f"CASE WHEN regexp_full_match({t}, '{p}') THEN CAST(try_strptime({x}, '{f}') AS DATE) END" for p, x, f in tries]
    return f"coalesce({', '.join(parts)})"


def q_float(c: str) -> str:
    t = q_clean(c)
    t = rf"CASE WHEN {t} LIKE '%,%' THEN CASE WHEN regexp_full_match({t}, '[+-]?\d{{1,3}}(,\d{{3}})+(\.\d+)?') THEN replace({t}, ',', '') END ELSE {t} END"
    return rf"(CASE WHEN regexp_full_match({t}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST({t} AS DOUBLE) END)"


def q_event(c: str) -> str:
    t = f"lower({q_clean(c)})"
    words = lambda x: ", ".join(f"'{w}'" for w in x)
    return f"(CASE WHEN {t} IN ({words(CHURN_WORDS)}) THEN 1 WHEN {t} IN ({words(ACTIVE_WORDS)}) THEN 0 END)"


_EVENT = f"coalesce({q_event('event_observed')}, CAST({q_float('event_observed')} AS INTEGER))"
#: DuckDB only: the canonical table and its errors.
CANON = ctes("raw_accounts") + f""",
parsed AS (SELECT _row_id AS row_id, {q_clean('customer_id')} AS customer_id, {q_date('observation_start')} AS observation_start,
  {q_date('observation_end')} AS end_raw, {_EVENT} AS event_observed, {q_clean('plan_tier')} AS plan_tier,
  {q_float('contract_length_months')} AS contract_length_months, {q_float('usage_frequency')} AS usage_frequency,
  region, balance, exit_reason FROM raw_accounts),
canon AS (SELECT * EXCLUDE (end_raw), CASE WHEN event_observed = 1 THEN end_raw ELSE DATE '{REF}' END AS observation_end FROM parsed),
canonical AS (SELECT *, CAST(date_diff('day', observation_start, observation_end) AS DOUBLE) AS tenure FROM canon),
numbered AS (SELECT *, row_number() OVER (PARTITION BY coalesce(customer_id, 'row ' || row_id) ORDER BY row_id) AS nth FROM canonical),
errors AS (
  SELECT row_id, customer_id, 'CUSTOMER_ID' AS code, '' AS field FROM numbered WHERE customer_id IS NULL
  UNION ALL SELECT row_id, customer_id, 'UNIQUE_ID', '' FROM numbered WHERE nth > 1
  UNION ALL SELECT row_id, customer_id, 'INVALID_DATE', 'observation_start' FROM numbered WHERE observation_start IS NULL
  UNION ALL SELECT row_id, customer_id, 'INVALID_DATE', 'observation_end' FROM numbered WHERE observation_end IS NULL
  UNION ALL SELECT row_id, customer_id, 'WINDOW_ORDER', '' FROM numbered WHERE observation_start > observation_end
  UNION ALL SELECT row_id, customer_id, 'EVENT_OBSERVED', '' FROM numbered WHERE event_observed IS NULL OR event_observed NOT IN (0, 1)
  UNION ALL SELECT row_id, customer_id, 'TENURE_INVALID', '' FROM numbered WHERE tenure IS NULL OR tenure < 0
  UNION ALL SELECT row_id, customer_id, 'FUTURE_LEAKAGE', '' FROM numbered WHERE observation_end > DATE '{REF}'
  UNION ALL SELECT row_id, customer_id, 'CORE_MISSING', 'plan_tier' FROM numbered WHERE plan_tier IS NULL
  UNION ALL SELECT row_id, customer_id, 'CORE_MISSING', 'contract_length_months' FROM numbered WHERE contract_length_months IS NULL
  UNION ALL SELECT row_id, customer_id, 'CORE_MISSING', 'usage_frequency' FROM numbered WHERE usage_frequency IS NULL),
evaluable AS (SELECT * FROM canonical WHERE row_id NOT IN (SELECT row_id FROM errors WHERE code <> 'CORE_MISSING')),
rates AS (
  SELECT key, n_missing, n_evaluable, n_missing / nullif(n_evaluable, 0) AS fraction FROM (
    SELECT 'plan_tier' AS key, count(*) - count(plan_tier) AS n_missing, count(*) AS n_evaluable FROM evaluable
    UNION ALL SELECT 'contract_length_months', count(*) - count(contract_length_months), count(*) FROM evaluable
    UNION ALL SELECT 'usage_frequency', count(*) - count(usage_frequency), count(*) FROM evaluable)),
final_errors AS (SELECT * FROM errors WHERE NOT (code = 'CORE_MISSING' AND field IN
  (SELECT key FROM rates WHERE fraction > 0 AND fraction <= 0.3))),
accepted AS (SELECT * FROM canonical WHERE row_id NOT IN (SELECT row_id FROM final_errors))
"""


def canonical_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.adapt_canonical(view(spark, sf_dir, "raw_accounts"), REF)


def accepted_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(canonical_accounts(spark, sf_dir), V.ValidationConfig(), REF).accepted


def flat(df: DataFrame, *extras: str) -> DataFrame:
    """Canonical rows without nested columns, dates as text."""
    return df.select(
        "row_id", "customer_id", F.col("observation_start").cast("string").alias("observation_start"),
        F.col("observation_end").cast("string").alias("observation_end"), "event_observed", "tenure",
        *(F.col(f"core_features.{k}").alias(k) for k in ("plan_tier", "contract_length_months", "usage_frequency")),
        *(F.col("extra_features")[e].alias(e) for e in extras),
    )


_FLAT = """row_id, customer_id, CAST(observation_start AS VARCHAR) AS observation_start,
  CAST(observation_end AS VARCHAR) AS observation_end, event_observed, tenure, plan_tier, contract_length_months, usage_frequency"""


@query(CANON + f"SELECT {_FLAT}, region, balance FROM canonical")
def adapt_canonical(spark, sf_dir):
    return flat(canonical_accounts(spark, sf_dir), "region", "balance")


def _source(sql_id: str, start: str, end: str, event: str, months: str, tier: str, where: str, table: str) -> str:
    return f""", src AS (SELECT * FROM {table}), p AS (SELECT _row_id AS row_id, {sql_id} AS customer_id, {start} AS observation_start,
      {end} AS end_raw, {event} AS event_observed, {tier} AS plan_tier, {months} AS contract_length_months,
      {q_float('usage_frequency')} AS usage_frequency, {where} AS extra FROM src), c AS (
      SELECT *, CASE WHEN event_observed = 1 THEN end_raw ELSE DATE '{REF}' END AS observation_end FROM p)
      SELECT row_id, customer_id, CAST(observation_start AS VARCHAR) AS observation_start, CAST(observation_end AS VARCHAR) AS observation_end,
        event_observed, CAST(date_diff('day', observation_start, observation_end) AS DOUBLE) AS tenure, plan_tier, contract_length_months,
        usage_frequency, extra FROM c"""


define(
    "billing_export",
    "raw_accounts",
    """SELECT _row_id, customer_id AS customer, CASE WHEN _row_id % 31 = 4 THEN ' ' ELSE event_observed END AS status,
         observation_start AS current_period_start, observation_end AS current_period_end,
         CASE WHEN _row_id % 5 = 1 THEN observation_end END AS canceled_at,
         plan_tier AS plan, 'plan ' || region AS plan_id,
         CASE _row_id % 4 WHEN 0 THEN 'month' WHEN 1 THEN 'Yearly' WHEN 2 THEN 'decade' ELSE NULL END AS "interval",
         CASE WHEN _row_id % 3 = 0 THEN contract_length_months END AS interval_months, usage_frequency, region AS extra FROM raw_accounts""".replace(
        '"interval"', "period_name"
    ),
)
define(
    "crm_export",
    "raw_accounts",
    """SELECT _row_id, CASE WHEN _row_id % 4 = 1 THEN '' ELSE 'user' || CAST(_row_id AS STRING) || '@example.com' END AS email,
         'obj-' || CAST(_row_id AS STRING) AS hs_object_id,
         CASE WHEN _row_id % 7 = 2 THEN '' WHEN _row_id % 19 = 3 THEN 'evangelist' ELSE event_observed END AS lifecyclestage,
         CASE WHEN _row_id % 2 = 0 THEN observation_start ELSE ' ' END AS hs_createdate, observation_start AS createdate,
         observation_end AS hs_closedate, plan_tier, contract_length_months, usage_frequency, region AS extra FROM raw_accounts""",
)
define(
    "ticket_export",
    "raw_accounts",
    """SELECT _row_id, CASE WHEN _row_id % 6 = 0 THEN NULL ELSE customer_id END AS requester_id, 'u' || CAST(_row_id AS STRING) AS user_id,
         observation_start AS created_at, CASE WHEN _row_id % 2 = 1 THEN observation_end END AS solved_at,
         observation_end AS closed_at, CASE WHEN _row_id % 9 = 2 THEN NULL ELSE event_observed END AS status,
         plan_tier, contract_length_months, usage_frequency, region AS extra FROM raw_accounts""",
)


def _blank_zero(c: str) -> str:
    return f"(CASE WHEN {q_clean(c)} IS NULL THEN 0 ELSE {q_event(c)} END)"


@query(
    ctes("billing_export")
    + _source(
        q_clean("customer"), q_date("current_period_start"),
        q_date(f"CASE WHEN {q_event('status')} = 1 THEN coalesce({q_clean('canceled_at')}, {q_clean('current_period_end')}) ELSE current_period_end END"),
        q_event("status"),
        f"coalesce({q_float('interval_months')}, CASE lower({q_clean('period_name')}) WHEN 'month' THEN 1.0 WHEN 'monthly' THEN 1.0 WHEN 'year' THEN 12.0 WHEN 'yearly' THEN 12.0 END)",
        f"coalesce({q_clean('plan')}, {q_clean('plan_id')})", "extra", "billing_export",
    )
)
def adapt_billing(spark, sf_dir):
    df = view(spark, sf_dir, "billing_export").withColumnRenamed("period_name", "interval")
    return flat(A.adapt_billing(df, REF), "extra")


@query(
    ctes("crm_export")
    + _source(
        f"coalesce({q_clean('email')}, {q_clean('hs_object_id')})",
        q_date(f"coalesce({q_clean('hs_createdate')}, {q_clean('createdate')})"), q_date("hs_closedate"),
        _blank_zero("lifecyclestage"), q_float("contract_length_months"), q_clean("plan_tier"), "extra", "crm_export",
    )
)
def adapt_crm(spark, sf_dir):
    return flat(A.adapt_crm(view(spark, sf_dir, "crm_export"), REF), "extra")


@query(
    ctes("ticket_export")
    + _source(
        f"coalesce({q_clean('requester_id')}, {q_clean('user_id')})", q_date("created_at"),
        q_date(f"coalesce({q_clean('solved_at')}, {q_clean('closed_at')})"), _blank_zero("status"),
        q_float("contract_length_months"), q_clean("plan_tier"), "extra", "ticket_export",
    )
)
def adapt_tickets(spark, sf_dir):
    return flat(A.adapt_tickets(view(spark, sf_dir, "ticket_export"), REF), "extra")


_TIERS = {"BUILDING": "starter", " Machinery ": "pro", "household": "home"}
MAPPING = [
    A.ColumnMapping("_row_id", "customer_id", "row_number"),
    A.ColumnMapping("contract_length_months", "observation_start", "months_before"),
    A.ColumnMapping("observation_end", "observation_end", "parse_date"),
    A.ColumnMapping("event_observed", "event_observed", "status_to_event"),
    A.ColumnMapping("plan_tier", "core.plan_tier", "map", {"values": _TIERS}),
    A.ColumnMapping("usage_frequency", "core.usage_frequency", "to_float"),
    A.ColumnMapping("balance", "feature.balance", "number"),
    A.ColumnMapping("region", "area", "category"),
]
_MONTHS_START = f"(DATE '{REF}' - CAST(round_even({q_float('contract_length_months')} * 30.4375, 0) AS INTEGER))"


@query(
    ctes("raw_accounts")
    + f""", p AS (SELECT *, {q_event('event_observed')} AS ev, {_MONTHS_START} AS s, {q_date('observation_end')} AS e0 FROM raw_accounts),
    c AS (SELECT *, CASE WHEN ev = 1 THEN e0 ELSE DATE '{REF}' END AS e FROM p)
    SELECT _row_id AS row_id, CAST(_row_id AS VARCHAR) AS customer_id, CAST(s AS VARCHAR) AS observation_start, CAST(e AS VARCHAR) AS observation_end,
      ev AS event_observed, CAST(date_diff('day', s, e) AS DOUBLE) AS tenure,
      CASE lower({q_clean('plan_tier')}) WHEN 'building' THEN 'starter' WHEN 'machinery' THEN 'pro' WHEN 'household' THEN 'home' END AS plan_tier,
      {q_float('usage_frequency')} AS usage_frequency, {q_float('balance')} AS balance, region AS area, exit_reason FROM c"""
)
def apply_mapping(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_accounts")
    df = A.apply_mapping(raw, MAPPING, REF)
    return df.select(
        "row_id", "customer_id", F.col("observation_start").cast("string").alias("observation_start"),
        F.col("observation_end").cast("string").alias("observation_end"), "event_observed", "tenure",
        "core_features.plan_tier", "core_features.usage_frequency",
        F.col("model_features")["balance"].cast("double").alias("balance"),
        F.col("extra_features")["area"].alias("area"), F.col("extra_features")["exit_reason"].alias("exit_reason"),
    )


@query(
    ctes("raw_accounts")
    + f"SELECT _row_id AS row_id, CAST({q_date('observation_start')} AS VARCHAR) AS start_day, CAST({q_date('observation_end')} AS VARCHAR) AS end_day FROM raw_accounts"
)
def parse_dates(spark, sf_dir):
    return view(spark, sf_dir, "raw_accounts").select(
        F.col("_row_id").alias("row_id"), S.parse_date(F.col("observation_start")).cast("string").alias("start_day"),
        S.parse_date(F.col("observation_end")).cast("string").alias("end_day"),
    )


@query(
    ctes("raw_accounts")
    + f"""SELECT _row_id AS row_id, {q_float('usage_frequency')} AS usage, {q_float('contract_length_months')} AS months,
    CAST({q_float('balance')} AS BIGINT) AS balance FROM raw_accounts"""
)
def parse_numbers(spark, sf_dir):
    return view(spark, sf_dir, "raw_accounts").select(
        F.col("_row_id").alias("row_id"), S.to_float(F.col("usage_frequency")).alias("usage"),
        S.to_float(F.col("contract_length_months")).alias("months"), S.to_int(F.col("balance")).alias("balance"),
    )


@query(ctes("raw_accounts") + f"SELECT _row_id AS row_id, {q_event('event_observed')} AS event_observed FROM raw_accounts")
def status_to_event(spark, sf_dir):
    return view(spark, sf_dir, "raw_accounts").select(
        F.col("_row_id").alias("row_id"), S.status_to_event(F.col("event_observed")).alias("event_observed")
    )


@query(
    ctes("raw_accounts")
    + f"""SELECT _row_id AS row_id, CASE lower({q_clean('plan_tier')}) WHEN 'building' THEN 'starter' WHEN 'machinery' THEN 'pro'
    WHEN 'household' THEN 'home' END AS tier FROM raw_accounts"""
)
def map_values(spark, sf_dir):
    return view(spark, sf_dir, "raw_accounts").select(
        F.col("_row_id").alias("row_id"), S.map_values(F.col("plan_tier"), _TIERS).alias("tier")
    )


@query(
    ctes("raw_accounts")
    + f"""SELECT _row_id AS row_id, CAST({_MONTHS_START} AS VARCHAR) AS start_day,
    CAST(DATE '{REF}' - CAST(round_even(({q_float('contract_length_months')} + 0.5) * 30.4375, 0) AS INTEGER) AS VARCHAR) AS mid_day FROM raw_accounts"""
)
def months_before(spark, sf_dir):
    m = S.to_float(F.col("contract_length_months"))
    return view(spark, sf_dir, "raw_accounts").select(
        F.col("_row_id").alias("row_id"), S.months_before(m, REF).cast("string").alias("start_day"),
        S.months_before(m, REF, midpoint=True).cast("string").alias("mid_day"),
    )


@query(ctes("raw_accounts") + "SELECT CAST(_row_id AS VARCHAR) AS customer_id, region FROM raw_accounts")
def synthesize_ids(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_accounts")
    made = A.apply_mapping(raw, [A.ColumnMapping("_row_id", "customer_id", "row_number")], REF)
    return made.select("customer_id", F.col("extra_features")["region"].alias("region"))


@query(
    ctes("raw_accounts")
    + f"""SELECT _row_id AS row_id, {q_float('balance')} AS as_number, CASE WHEN regexp_full_match({q_clean('contract_length_months')}, '[+-]?\\d+\\.0+')
    THEN regexp_replace({q_clean('contract_length_months')}, '\\.0+$', '') ELSE {q_clean('contract_length_months')} END AS as_category FROM raw_accounts"""
)
def coerce_features(spark, sf_dir):
    return view(spark, sf_dir, "raw_accounts").select(
        F.col("_row_id").alias("row_id"), S.coerce_feature(F.col("balance"), "number").alias("as_number"),
        S.coerce_feature(F.col("contract_length_months"), "category").alias("as_category"),
    )


@query(
    CANON
    + """SELECT row_id, CAST(observation_start AS VARCHAR) AS observation_start, CAST(observation_end AS VARCHAR) AS observation_end, tenure
    FROM canonical"""
)
def observation_window(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_accounts")
    event = F.coalesce(S.status_to_event(F.col("event_observed")), S.to_int(F.col("event_observed")).cast("int"))
    parsed = raw.select(
        F.col("_row_id").alias("row_id"), S.parse_date(F.col("observation_start")).alias("start_date"),
        S.parse_date(F.col("observation_end")).alias("end_date"), event.alias("event_observed"),
    )
    return A.observation_window(parsed, REF).select(
        "row_id", F.col("observation_start").cast("string").alias("observation_start"),
        F.col("observation_end").cast("string").alias("observation_end"), "tenure",
    )


# --- routing -----------------------------------------------------------------------------------------------

define(
    "export_catalog",
    "nation",
    """SELECT 'export ' || CAST(n_nationkey AS STRING) AS table_name, column_name, position FROM nation CROSS JOIN (
         SELECT 0 AS kind, 'customer_id' AS column_name, 1 AS position UNION ALL SELECT 0, 'observation_start', 2
         UNION ALL SELECT 0, 'observation_end', 3 UNION ALL SELECT 0, 'event_observed', 4 UNION ALL SELECT 0, 'Plan Tier', 5
         UNION ALL SELECT 1, 'customer', 1 UNION ALL SELECT 1, 'status', 2 UNION ALL SELECT 1, 'current_period_start', 3
         UNION ALL SELECT 1, 'current_period_end', 4 UNION ALL SELECT 2, 'email', 1 UNION ALL SELECT 2, 'lifecyclestage', 2
         UNION ALL SELECT 2, 'hs_createdate', 3 UNION ALL SELECT 2, 'requester_id', 4 UNION ALL SELECT 2, 'created_at', 5
         UNION ALL SELECT 2, 'status', 6 UNION ALL SELECT 3, 'Cust ID', 1 UNION ALL SELECT 3, 'Cust-ID', 2
         UNION ALL SELECT 3, '90d usage', 3) c WHERE n_nationkey % 4 = kind""",
)


@query(
    ctes("export_catalog")
    + """SELECT table_name, sha256(string_agg(column_name || chr(0), '' ORDER BY column_name)) AS headers_hash, count(*) AS n_columns
    FROM export_catalog GROUP BY table_name"""
)
def header_fingerprint(spark, sf_dir):
    return R.header_fingerprint(view(spark, sf_dir, "export_catalog"))


@query(
    ctes("export_catalog")
    + """, tables AS (SELECT table_name, list(DISTINCT column_name) AS cols FROM export_catalog GROUP BY table_name),
    registry AS (SELECT * FROM (VALUES ('canonical', 1, ['customer_id','observation_start','observation_end','event_observed'], 0.95),
      ('billing', 2, ['customer','status','current_period_start','current_period_end'], 0.9), ('crm', 3, ['email','lifecyclestage','hs_createdate'], 0.9),
      ('tickets', 4, ['requester_id','created_at','status'], 0.85)) r(adapter, priority, required, confidence)),
    m AS (SELECT table_name, adapter, priority, CAST(confidence AS DOUBLE) AS confidence FROM tables LEFT JOIN registry ON list_has_all(cols, required)),
    r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY confidence DESC, priority, adapter) AS k FROM m)
    SELECT r.table_name, r.adapter, r.confidence, coalesce(a.matches, '') AS matches, r.adapter IS NULL AS needs_mapping FROM r JOIN (
      SELECT table_name, string_agg(adapter, ',' ORDER BY adapter) AS matches FROM m GROUP BY table_name) a USING (table_name) WHERE k = 1"""
)
def route_tables(spark, sf_dir):
    return R.route_tables(view(spark, sf_dir, "export_catalog"), R.registry_table(spark))


define(
    "mapping_history",
    "supplier",
    """SELECT 'map-' || CAST(s_suppkey AS STRING) AS mapping_id, 'hash-' || CAST(s_suppkey % 7 AS STRING) AS headers_hash,
         CASE WHEN s_suppkey % 3 = 1 THEN 'map-' || CAST(s_suppkey - 1 AS STRING) END AS supersedes, s_suppkey % 5 <> 4 AS confirmed FROM supplier""",
)


@query(
    ctes("mapping_history")
    + """, a AS (SELECT * FROM mapping_history WHERE confirmed AND mapping_id NOT IN (SELECT supersedes FROM mapping_history WHERE confirmed AND supersedes IS NOT NULL))
    SELECT mapping_id, headers_hash, count(*) OVER (PARTITION BY headers_hash) > 1 AS conflict FROM a"""
)
def active_mappings(spark, sf_dir):
    return R.active_mappings(view(spark, sf_dir, "mapping_history"))


@query(
    """SELECT t AS table_name, n FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer
    UNION ALL SELECT 'supplier', count(*) FROM supplier) ORDER BY n DESC LIMIT 1"""
)
def pick_primary_table(spark, sf_dir):
    tables = {t: view(spark, sf_dir, t) for t in ("nation", "customer", "supplier")}
    name = R.pick_table(tables)
    return tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")


@query(
    ctes("raw_accounts")
    + """SELECT trim(customer_id) AS customer_id, min(_row_id) AS first_seen FROM raw_accounts WHERE trim(customer_id) <> '' GROUP BY 1"""
)
def customer_universe(spark, sf_dir):
    return R.customer_universe(view(spark, sf_dir, "raw_accounts"))


define(
    "wide_headers",
    "nation",
    """SELECT 'wide ' || CAST(n_nationkey AS STRING) AS table_name, column_name, position,
         CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN target = '' THEN NULL ELSE target END AS target_field FROM nation CROSS JOIN (
         SELECT 'a' AS column_name, 1 AS position, '' AS target UNION ALL SELECT 'A ', 2, '' UNION ALL SELECT 'a_2', 3, ''
         UNION ALL SELECT 'planTier', 4, '' UNION ALL SELECT 'Plan Tier', 5, '' UNION ALL SELECT '%%', 6, '' UNION ALL SELECT '90d usage', 7, ''
         UNION ALL SELECT 'Cust ID', 8, 'customer_id' UNION ALL SELECT 'Seats', 9, 'feature.a' UNION ALL SELECT '#', 10, ''
         UNION ALL SELECT 'a_very_long_header_that_goes_on_and_on_until_it_is_over', 11, ''
         UNION ALL SELECT 'a_very_long_header_that_goes_on_and_on_until_it_ends', 12, '') c""",
)


@query(
    ctes("wide_headers").replace("WITH ", "WITH RECURSIVE ", 1)
    + r""", s AS (SELECT *, trim(regexp_replace(lower(regexp_replace(column_name, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^0-9a-z]+', '_', 'g'), '_') AS k FROM wide_headers
      WHERE target_field IS NULL OR target_field LIKE 'feature.%'),
    t AS (SELECT *, left(CASE WHEN k = '' THEN 'feature' WHEN regexp_matches(k, '^[a-z]') THEN k ELSE 'f_' || k END, 48) AS stem,
      row_number() OVER (PARTITION BY table_name ORDER BY position) AS i FROM s),
    walk AS (
      SELECT table_name, 0::BIGINT AS i, list(substr(target_field, 9)) FILTER (target_field IS NOT NULL) AS taken, NULL::VARCHAR AS key FROM t GROUP BY table_name
      UNION ALL
      SELECT table_name, i, list_append(taken, key), key FROM (
        SELECT t.table_name, t.i, coalesce(w.taken, []) AS taken, CASE WHEN target_field IS NOT NULL THEN substr(target_field, 9)
          WHEN NOT list_contains(coalesce(w.taken, []), stem) THEN stem
          ELSE stem || '_' || list_min([x FOR x IN range(2, 99) IF NOT list_contains(w.taken, stem || '_' || x)]) END AS key
        FROM walk w JOIN t ON t.table_name = w.table_name AND t.i = w.i + 1))
    SELECT t.table_name, position, column_name, key FROM t JOIN walk USING (table_name, i)"""
)
def feature_candidates(spark, sf_dir):
    """Headers that clash with each other, with suffixes and with keys that a mapping gave."""
    columns = view(spark, sf_dir, "wide_headers")
    return R.feature_candidates(columns, mapped=columns.where("target_field is not null"))


# --- validation --------------------------------------------------------------------------------------------


@query(
    CANON
    + """SELECT row_id, contract_length_months, plan_tier, CASE WHEN usage_frequency IS NOT NULL THEN 1 ELSE 0 END AS usage_demoted FROM canonical"""
)
def feature_gate(spark, sf_dir):
    cfg = V.ValidationConfig(approved=("plan_tier", "contract_length_months"))
    gated, _ = V.feature_gate(canonical_accounts(spark, sf_dir), cfg)
    return gated.select(
        "row_id", "core_features.contract_length_months", "core_features.plan_tier",
        F.map_contains_key("extra_features", F.lit("usage_frequency")).cast("int").alias("usage_demoted"),
    )


@query(CANON + "SELECT row_id, customer_id, code, field FROM errors")
def row_errors(spark, sf_dir):
    return V.row_errors(canonical_accounts(spark, sf_dir), V.ValidationConfig(), REF)


@query(CANON + "SELECT row_id, customer_id FROM errors WHERE code = 'UNIQUE_ID'")
def duplicate_ids(spark, sf_dir):
    return V.duplicate_ids(canonical_accounts(spark, sf_dir), V.ValidationConfig(), REF)


def _days(spark, sf_dir):
    return V.by_tenure(V.with_errors(canonical_accounts(spark, sf_dir), V.ValidationConfig(), REF), V.ValidationConfig())


@query(CANON + "SELECT key, n_missing, n_evaluable, round(fraction, 6) AS fraction, fraction > 0 AND fraction <= 0.3 AS passes FROM rates")
def missing_passthrough(spark, sf_dir):
    return V.missing_passthrough(_days(spark, sf_dir), V.ValidationConfig()).withColumn("fraction", F.round("fraction", 6))


@query(CANON + "SELECT key, n_missing, n_evaluable, round(fraction, 6) AS fraction, fraction > 0.1 AS fails FROM rates")
def column_missingness(spark, sf_dir):
    strict = V.ValidationConfig(missingness_threshold=0.1)
    return V.column_missingness(_days(spark, sf_dir), strict).withColumn("fraction", F.round("fraction", 6))


@query(
    CANON
    + """, m AS (SELECT median(tenure) AS md FROM evaluable), a AS (SELECT median(abs(tenure - md)) AS mad FROM evaluable, m),
    s AS (SELECT md, CASE WHEN mad > 0 THEN mad ELSE greatest(md * 0.1, 1.0) END AS scale FROM m, a)
    SELECT count(*) AS n, round(avg(CASE WHEN tenure = 0 THEN 1 ELSE 0 END), 6) AS zero_fraction, max(md) AS median, max(scale) AS scale,
      round(avg(CASE WHEN abs(tenure - md) > 10 * scale THEN 1 ELSE 0 END), 6) AS outlier_ratio,
      avg(CASE WHEN tenure = 0 THEN 1 ELSE 0 END) <= 0.8 AND avg(CASE WHEN abs(tenure - md) > 10 * scale THEN 1 ELSE 0 END) <= 0.05 AS sane
    FROM evaluable, s"""
)
def tenure_sanity(spark, sf_dir):
    one = V.tenure_sanity(_days(spark, sf_dir), V.ValidationConfig())
    return one.withColumns({c: F.round(c, 6) for c in ("zero_fraction", "outlier_ratio")})


@query(
    CANON
    + """SELECT 'accepted' AS item, (SELECT count(*) FROM accepted) AS n UNION ALL
    SELECT 'rejected', (SELECT count(*) FROM canonical) - (SELECT count(*) FROM accepted) UNION ALL
    SELECT code, count(*) FROM final_errors GROUP BY code"""
)
def validation_report(spark, sf_dir):
    v = V.validate(canonical_accounts(spark, sf_dir), V.ValidationConfig(), REF)
    sides = v.report.select(
        F.inline(
            F.array(
                F.struct(F.lit("accepted").alias("item"), F.col("n_accepted").alias("n")),
                F.struct(F.lit("rejected").alias("item"), F.col("n_rejected").alias("n")),
            )
        )
    )
    return sides.union(V.error_counts(v.errors).select(F.col("code").alias("item"), "n"))


@query(
    CANON
    + f""", x AS (SELECT {q_float('balance')} AS balance, contract_length_months AS m, usage_frequency AS u FROM canonical),
    r AS (SELECT 'balance' AS extra, 'contract_length_months' AS core, corr(balance, m) AS r FROM x UNION ALL
    SELECT 'balance', 'usage_frequency', corr(balance, u) FROM x)
    SELECT extra, core, round(r, 6) AS r FROM r WHERE abs(r) > 0.0001"""
)
def correlation_warnings(spark, sf_dir):
    cfg = V.ValidationConfig(correlation_threshold=0.0001)
    found = V.correlation_warnings(canonical_accounts(spark, sf_dir), ["balance", "region"], cfg)
    return found.withColumn("r", F.round("r", 6))
