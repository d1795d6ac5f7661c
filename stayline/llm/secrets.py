"""Secret scanning with an incremental ledger of content-addressed blobs, in DataFrame operations only.

A version of a path is a blob, named by the SHA-256 of its text. The ledger keeps which (blob, rule version)
pairs have been scanned and what was found there. A scan collapses the copies of a blob before any text is
shuffled, leaves out pairs that the ledger has, records the rest, and joins findings back to every path.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, pick, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; ``check`` (over the whole match) says which of them count."""

    kind: str
    pattern: str
    check: str


# The base kinds and their patterns.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{20,}$"),
    # Runs are whole either way, so the least length can stand in the pattern, which spares most candidates.
    Rule("hex", r"[0-9a-f]{24,}", r"^.{24,}$"),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", r"^.+$"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"^.+$"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}", r"^.+$"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"^.+$"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}", r"^.+$"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"
#: Session setting with the folder of a ledger that runs share.
LEDGER_SETTING = "spark.stayline.secrets.ledger"


def _valid(rule: Rule, match: Column) -> Column:
    return match.rlike(rule.check)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, kind_no, end>>`` of the counting matches; positions in code points, end exclusive.

    A match's place follows from the lengths of the parts between matches (``split``) and of the matches.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(matches)), F.length).alias("gap"), matches.alias("match")
    )
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda state, x: F.struct(
            (state["at"] + x["gap"] + F.length(x["match"])).alias("at"),
            F.when(
                _valid(rule, x["match"]),
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + x["gap"]).alias("start"),
                            F.lit(order).alias("kind_no"),
                            (state["at"] + x["gap"] + F.length(x["match"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return F.when(text.rlike(rule.pattern), walked).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)``: the findings of each blob's ``text``, by start, then kind as listed."""
    spans = F.array_sort(F.concat(*(rule_spans(F.col("text"), r, k) for k, r in enumerate(rules))))
    return blobs.select("blob", spans.alias("spans"))


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(path, blob, text)`` of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("path"), text_or_empty(text_col).alias("text"))
    return rows.select("path", F.sha2("text", 256).alias("blob"), "text")


def version_key(rules: tuple[Rule, ...], rule_version: str) -> str:
    """The name under which the ledger keeps findings: the version and a digest of the rules themselves, so that changed
    rules are scanned anew also where the version's name stayed."""
    return f"{rule_version}:{sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]}"


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> int:
    """Scan the blobs that the ledger at this folder lacks under this rule version; how many rows it had before.

    The ledger is a Parquet folder of ``(rule_version, blob, spans)``; a run appends one commit, so a run that
    dies leaves it as it was. Only hash and text of distinct blobs are shuffled.
    """
    spark, rule_version = versions.sparkSession, version_key(rules, rule_version)
    unseen, before = versions.select("blob", "text"), 0
    seen = read_ledger(spark, ledger)
    if seen is not None:
        known = seen.where(F.col("rule_version") == rule_version).select("blob").distinct()
        before = known.count()
        unseen = unseen.join(known, "blob", "left_anti")
    blobs = unseen.groupBy("blob", "text").agg(F.lit(1).alias("one"))
    found = scan_blobs(blobs, rules).select(F.lit(rule_version).alias("rule_version"), "blob", "spans")
    found.write.mode("append").parquet(ledger)
    return before


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows; None where no run has written any."""
    schema = "rule_version string, blob string, spans array<struct<start:int,kind_no:int,end:int>>"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def findings_by_path(
    versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION
) -> DataFrame:
    """``(path, blob, spans)`` for every version, copies included."""
    rule_version = version_key(rules, rule_version)
    found = read_ledger(versions.sparkSession, ledger).where(F.col("rule_version") == rule_version)
    hits = found.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    return (
        versions.select("path", "blob")
        .join(hits, "blob", "left")
        .select("path", "blob", F.coalesce("spans", none).alias("spans"))
    )


def find_secrets(
    docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION,
) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob)``, one row for each input row.

    Null counts as the empty text, which has no findings. Null ids and repeated rows stay; equal texts are
    scanned once. An empty table gives an empty result. Other columns are ignored. Without ``ledger`` a new one
    is begun in the shared folder.
    """
    versions = versions_of(pick(docs, id_col, text_col), id_col, text_col)
    ledger = ledger or new_folder(docs.sparkSession, "blob-ledger")
    scan_versions(versions, ledger, rules, rule_version)
    rows = findings_by_path(versions, ledger, rules, rule_version)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    base = len(BASE_RULES)

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat(
                    F.get(kinds, s["kind_no"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
                ),
            ),
            ",",
        )

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long").alias(f"n_{rules[k].kind}")

    return rows.select(
        F.col("path").alias("doc_id"),
        *(count(k) for k in range(base)),
        F.sha2(listed(F.filter("spans", lambda s: s["kind_no"] < base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        "blob",
    )


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the ledger of LEDGER_SETTING, where set: a second run over a grown table scans only what is new."""
    return find_secrets(table(spark, sf_dir, "documents"), spark.conf.get(LEDGER_SETTING, None))
