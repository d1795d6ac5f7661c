"""Fingerprints of tables, routing to adapters, and confirmed mappings: work on catalogs of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.80

#: adapter, priority, required columns, confidence where all of them stand. Fixed values.
REGISTRY = (
    ("canonical", 1, ("customer_id", "observation_start", "observation_end", "event_observed"), 0.95),
    ("billing", 2, ("customer", "status", "current_period_start", "current_period_end"), 0.9),
    ("crm", 3, ("email", "lifecyclestage", "hs_createdate"), 0.9),
    ("tickets", 4, ("requester_id", "created_at", "status"), 0.85),
)


def header_fingerprint(catalog: DataFrame) -> DataFrame:
    """``(table_name, headers_hash)`` from rows ``(table_name, column_name)``: SHA-256 over the sorted headers, each
    followed by a zero byte."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("column_name")), lambda h: F.concat(h, F.lit("\x00"))))
    return catalog.groupBy("table_name").agg(F.sha2(joined, 256).alias("headers_hash"), F.count("*").alias("n_columns"))


def registry_table(spark: SparkSession, registry=REGISTRY) -> DataFrame:
    return spark.createDataFrame(
        [(n, p, list(c), float(s)) for n, p, c, s in registry],
        "adapter string, priority int, required array<string>, confidence double",
    )


def route_tables(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """``(table_name, adapter, confidence, matches, needs_mapping)``: the best adapter with enough confidence."""
    tables = catalog.groupBy("table_name").agg(F.collect_set("column_name").alias("columns"))
    found = (
        tables.join(F.broadcast(registry), F.size(F.array_except("required", "columns")) == 0, "left")
        .where(F.col("adapter").isNull() | (F.col("confidence") >= LEAST_CONFIDENCE))
        .groupBy("table_name")
        .agg(
            F.min(F.when(F.col("adapter").isNotNull(), F.struct((-F.col("confidence")).alias("c"), "priority", "adapter"))).alias("best"),
            F.array_join(F.array_sort(F.collect_list("adapter")), ",").alias("matches"),
        )
    )
    return found.select(
        "table_name", F.col("best.adapter").alias("adapter"), (-F.col("best.c")).alias("confidence"), "matches",
        F.col("best").isNull().alias("needs_mapping"),
    )


def active_mappings(mappings: DataFrame) -> DataFrame:
    """Confirmed mappings that no other confirmed one supersedes, with ``conflict`` where two share a header hash."""
    confirmed = mappings.where("confirmed")
    replaced = confirmed.where("supersedes is not null").select(F.col("supersedes").alias("mapping_id")).distinct()
    active = confirmed.join(replaced, "mapping_id", "left_anti")
    shared = active.groupBy("headers_hash").agg((F.count("*") > 1).alias("conflict"))
    return active.join(shared, "headers_hash").select("mapping_id", "headers_hash", "conflict")


def pick_table(tables: dict[str, DataFrame], names: tuple[str, ...] | None = None) -> str:
    """The table with a customers' name, if ``names`` are given and one has it; else the one with most rows."""
    wanted = {n.lower() for n in names or ()}
    for t in tables:
        if t.strip().lower() in wanted:
            return t
    counts = [df.select(F.lit(t).alias("t"), F.lit(-i).alias("o")).groupBy("t", "o").count() for i, (t, df) in enumerate(tables.items())]
    union = counts[0]
    for c in counts[1:]:
        union = union.union(c)
    best = union.agg(F.max(F.struct("count", "o", "t"))["t"].alias("t")).first()
    return best.t or next(iter(tables))


def customer_universe(df: DataFrame, column: str = "customer_id", order: str = "_row_id") -> DataFrame:
    """``(customer_id, first_seen)``: distinct trimmed ids with the place they first stand at."""
    t = F.trim(F.col(column))
    return df.select(t.alias("customer_id"), F.col(order).alias("o")).where("customer_id != ''").groupBy("customer_id").agg(
        F.min("o").alias("first_seen")
    )


FEATURE_PREFIX = "feature."
KEY_LENGTH = 48


def feature_stem(name: Column) -> Column:
    """Snake case of a header: words by camel case and by other characters, a leading letter, at most 48 characters."""
    spaced = F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))
    stem = F.regexp_replace(F.regexp_replace(spaced, "[^0-9a-z]+", "_"), "^_+|_+$", "")
    stem = F.when(stem == "", "feature").when(stem.rlike("^[a-z]"), stem).otherwise(F.concat(F.lit("f_"), stem))
    return F.substring(stem, 1, KEY_LENGTH)


def _free_keys(pdf):
    """One table's keys, in column order: a taken stem gets the first suffix from ``_2`` on that is free."""
    pdf = pdf.sort_values("_order", kind="stable")
    taken, keys = set(pdf["_given"].dropna()), []
    following: dict[str, int] = {}
    for given, stem in zip(pdf["_given"], pdf["_stem"]):
        key = given
        if not isinstance(key, str):
            key, n = stem, following.get(stem, 2)
            while key in taken:
                key, n = f"{stem}_{n}", n + 1
            following[stem] = n
            taken.add(key)
        keys.append(key)
    pdf["key"] = keys
    return pdf[["_table", "_order", "column_name", "key"]]


def feature_candidates(columns: DataFrame, table: str = "table_name", order: str = "position", mapped: DataFrame | None = None) -> DataFrame:
    """``(table_name, position, column_name, key)``: the columns that may become features, with keys unique in their table.

    ``mapped`` are a mapping's proposals ``(table_name, column_name, target_field)``: a column proposed as a feature keeps
    that key, which no other column gets, and any other mapped column is no candidate. A group is the header of one table.
    """
    rows = columns.select(F.col(table).alias("_table"), F.col(order).alias("_order"), "column_name", feature_stem(F.col("column_name")).alias("_stem"))
    if mapped is None:
        rows = rows.withColumn("_given", F.lit(None).cast("string"))
    else:
        target = mapped.groupBy(F.col(table).alias("_table"), "column_name").agg(F.max("target_field").alias("_target"))
        feature = F.col("_target").startswith(FEATURE_PREFIX)
        rows = rows.join(target, ["_table", "column_name"], "left").where(F.col("_target").isNull() | feature)
        rows = rows.withColumn("_given", F.substring("_target", len(FEATURE_PREFIX) + 1, 1 << 30)).drop("_target")
    kinds = dict(rows.dtypes)
    schema = f"_table {kinds['_table']}, _order {kinds['_order']}, column_name string, key string"
    return rows.groupBy("_table").applyInPandas(_free_keys, schema).withColumnsRenamed({"_table": table, "_order": order})
