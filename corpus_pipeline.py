"""A training corpus from ``documents``: quality rules, exact and near duplicates, private data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of ``documents``.

In all stages a null text counts as empty (quality rules reject it), null and repeated ids are rows like any other,
texts may be of any length, an empty table gives an empty result, and further columns of any name pass through the
first four stages. Where rows tie, the docstring of the stage says which stays.

The pseudonyms' key is the session's ``spark.stayline.pseudonym.secret``; without it the application makes a secret one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.common import materialize, release, table, written_here
from stayline.llm.exact_dedup import exact_duplicates
from stayline.llm.packing import pack_documents, tokenizer_file
from stayline.llm.pii import pseudonymise_rows, session_key
from stayline.llm.quality_rules import kept_rows
from stayline.llm.simhash import near_duplicates


def _with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that no two rows share, and the key's name; keys sort by id (null last), then content.

    File and index tell rows apart that are alike in all columns. Tables that are not files are written first.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialize(docs, "rows")
    content = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    key = F.struct(F.col("doc_id").isNull().alias("blank"), F.col("doc_id").alias("id"), content.alias("content"), *place)
    return docs.withColumn(name, key), name


def _keep(rows: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """The rows whose key is ``kept``'s doc_id, each by itself: equal ids don't readmit each other."""
    keys = kept.select(F.col("doc_id.file").alias("file"), F.col("doc_id.at").alias("at"))
    same = (rows[name]["file"] == keys["file"]) & (rows[name]["at"] == keys["at"])
    return rows.join(keys, same, "left_semi").drop(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go; each row is judged by its own text."""
    return kept_rows(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest original, then the smallest id (null last), then by a
    hash of the row and its place in the files."""
    rows, name = _with_rows(docs)
    return _keep(rows, name, exact_duplicates(rows, name).where("kept").select("doc_id"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays: the one with the smallest id (null last), then by a hash of
    the row and its place in the files."""
    rows, name = _with_rows(docs)
    return _keep(rows, name, near_duplicates(rows, name).where("doc_id.file = component_id.file and doc_id.at = component_id.at").select("doc_id"))


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms; the number of characters follows the new text. Nulls stay null."""
    return pseudonymise_rows(docs, session_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document; repeated rows are packed as often as they come."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("private data", private_stage),
    ("packing", packing_stage),
]

#: Fingerprints, compression and tokens can't be had in SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself, and its input, are emptied once its result is written."""
    docs, result = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with written_here() as wrote:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, result + wrote[:-1])
        result = wrote[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
