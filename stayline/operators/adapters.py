"""Canonicalisation: one projection for each kind of export.

An adapter gives ``row_id, customer_id, observation_start, observation_end, event_observed, tenure,
core_features, model_features, extra_features, meta``. No adapter shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    clean, coerce_feature, map_values, months_before, parse_date, status_to_event, to_float, to_int,
)
from ..vocab import CORE_KEYS

IDENTITY = ("customer_id", "observation_start", "observation_end", "event_observed")
_TEXT_MAP = "map<string,string>"


def observation_window(df: DataFrame, ref: str, start: str = "start_date", end: str = "end_date", event: str = "event_observed") -> DataFrame:
    """Churned rows end at their parsed end, all others at the reference date; tenure in days, NULL if a side is."""
    closing = F.when(F.col(event) == 1, F.col(end)).otherwise(F.lit(ref).cast("date"))
    return df.withColumn("observation_start", F.col(start)).withColumn("observation_end", closing).withColumn(
        "tenure", F.datediff("observation_end", "observation_start").cast("double")
    )


def _record(
    df: DataFrame, ref: str, adapter: str, customer_id: Column, start: Column, end: Column, event: Column,
    core: dict[str, Column], used: set[str], features: dict[str, Column] | None = None,
    renamed: dict[str, Column] | None = None, version: str = "1",
) -> DataFrame:
    extras: dict[str, Column] = {c: F.col(f"`{c}`").cast("string") for c in df.columns if c not in used and c != "_row_id"}
    extras |= renamed or {}

    def text_map(values: dict[str, Column]) -> Column:
        if not values:
            return F.create_map().cast(_TEXT_MAP)
        return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))

    staged = df.select(
        F.col("_row_id").alias("row_id"),
        customer_id.alias("customer_id"),
        start.alias("start_date"),
        end.alias("end_date"),
        event.cast("int").alias("event_observed"),
        F.struct(*(v.alias(k) for k, v in core.items())).alias("core_features"),
        text_map(features or {}).alias("model_features"),
        text_map(extras).alias("extra_features"),
        F.struct(
            F.lit(adapter).alias("source_adapter"),
            F.lit(version).alias("mapping_version"),
            F.col("_row_id").cast("string").alias("original_row_id"),
            F.lit(ref).cast("date").alias("reference_date"),
        ).alias("meta"),
    )
    return observation_window(staged, ref).drop("start_date", "end_date")


def _get(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _core(df: DataFrame, **changed: Column) -> dict[str, Column]:
    core = {
        "plan_tier": clean(_get(df, "plan_tier")),
        "contract_length_months": to_float(_get(df, "contract_length_months")),
        "usage_frequency": to_float(_get(df, "usage_frequency")),
    }
    return core | changed


def adapt_canonical(df: DataFrame, ref: str) -> DataFrame:
    """A table in canonical columns; the event is a status word, else an integer."""
    g = lambda n: _get(df, n)
    event = F.coalesce(status_to_event(g("event_observed")), to_int(g("event_observed")).cast("int"))
    return _record(
        df, ref, "canonical", clean(g("customer_id")), parse_date(g("observation_start")),
        parse_date(g("observation_end")), event, _core(df), {*IDENTITY, *CORE_KEYS},
    )


def adapt_billing(df: DataFrame, ref: str) -> DataFrame:
    """A subscription export: months from the number of months, else from the interval's name."""
    g = lambda n: _get(df, n)
    event = status_to_event(g("status"))
    end = F.when(event == 1, F.coalesce(clean(g("canceled_at")), clean(g("current_period_end")))).otherwise(g("current_period_end"))
    word = F.lower(clean(g("interval")))
    months = F.coalesce(
        to_float(g("interval_months")),
        F.when(word.isin("month", "monthly"), 1.0).when(word.isin("year", "yearly"), 12.0),
    )
    used = {
        "customer", "status", "current_period_start", "current_period_end", "canceled_at", "plan", "plan_id",
        "interval", "interval_months", "usage_frequency",
    }
    core = _core(df, plan_tier=F.coalesce(clean(g("plan")), clean(g("plan_id"))), contract_length_months=months)
    return _record(df, ref, "billing", clean(g("customer")), parse_date(g("current_period_start")), parse_date(end), event, core, used)


def adapt_crm(df: DataFrame, ref: str) -> DataFrame:
    """A contact export: a blank stage is active, an unknown one NULL; the first filled of two dates counts."""
    g = lambda n: _get(df, n)
    stage = clean(g("lifecyclestage"))
    event = F.when(stage.isNull(), 0).otherwise(status_to_event(stage))
    start = F.coalesce(clean(g("hs_createdate")), clean(g("createdate")))
    end = F.coalesce(clean(g("hs_closedate")), clean(g("closedate")))
    used = {"email", "hs_object_id", "lifecyclestage", "hs_createdate", "createdate", "hs_closedate", "closedate", *CORE_KEYS}
    return _record(
        df, ref, "crm", F.coalesce(clean(g("email")), clean(g("hs_object_id"))), parse_date(start), parse_date(end),
        event, _core(df), used,
    )


def adapt_tickets(df: DataFrame, ref: str) -> DataFrame:
    """A ticket export: requester else user; solved else closed; a blank status is active."""
    g = lambda n: _get(df, n)
    status = clean(g("status"))
    event = F.when(status.isNull(), 0).otherwise(status_to_event(status))
    used = {"requester_id", "user_id", "created_at", "solved_at", "closed_at", "status", *CORE_KEYS}
    return _record(
        df, ref, "tickets", F.coalesce(clean(g("requester_id")), clean(g("user_id"))), parse_date(g("created_at")),
        parse_date(F.coalesce(clean(g("solved_at")), clean(g("closed_at")))), event, _core(df), used,
    )


@dataclass(frozen=True)
class ColumnMapping:
    """``target``: an identity field, ``core.<key>``, ``feature.<key>`` or another name (a renamed extra)."""

    source: str
    target: str
    transform: str = "identity"
    options: dict = field(default_factory=dict)


TRANSFORMS = (
    "identity", "strip", "parse_date", "to_float", "float", "to_int", "int", "status_to_event", "map",
    "months_before", "months_before_midpoint", "snapshot_end", "row_number", "number", "category",
)


def transformed(c: Column, m: ColumnMapping, ref: str) -> Column:
    """The transform's Column; unknown names are refused before anything runs."""
    t = m.transform
    if t not in TRANSFORMS:
        raise ValueError(f"unknown transform {t!r} for column {m.source!r}")
    if t == "map":
        return map_values(c, m.options["values"])
    plain = {
        "identity": lambda: c,
        "strip": lambda: clean(c),
        "parse_date": lambda: parse_date(c),
        "to_float": lambda: to_float(c),
        "float": lambda: to_float(c),
        "to_int": lambda: to_int(c),
        "int": lambda: to_int(c),
        "status_to_event": lambda: status_to_event(c),
        "months_before": lambda: months_before(to_float(c), ref),
        "months_before_midpoint": lambda: months_before(to_float(c), ref, midpoint=True),
        "snapshot_end": lambda: F.lit(ref).cast("date"),
        "row_number": lambda: F.col("_row_id").cast("string"),
        "number": lambda: coerce_feature(c, "number"),
        "category": lambda: coerce_feature(c, "category"),
    }
    return plain[t]()


def apply_mapping(df: DataFrame, mapping: list[ColumnMapping], ref: str, version: str = "1") -> DataFrame:
    """A confirmed mapping compiled into one projection: each input row gives one row, unmapped columns stay extras."""
    out = {m.target: transformed(F.col(f"`{m.source}`"), m, ref) for m in mapping}

    def identity(name: str) -> Column:
        return out.get(name, F.lit(None).cast("string"))

    event = identity("event_observed")
    event = F.coalesce(status_to_event(event.cast("string")), to_int(event.cast("string")).cast("int"))
    core = {t[5:]: c for t, c in out.items() if t.startswith("core.")}
    core = {k: to_float(c) if k not in ("plan_tier", "contract", "internet_service") else clean(c) for k, c in core.items()}
    features = {t[8:]: c for t, c in out.items() if t.startswith("feature.")}
    renamed = {t: c for t, c in out.items() if "." not in t and t not in IDENTITY}
    return _record(
        df, ref, "mapping", clean(identity("customer_id")), parse_date(identity("observation_start").cast("string")),
        parse_date(identity("observation_end").cast("string")), event, core or _core(df), {m.source for m in mapping},
        features, renamed, version,
    )
