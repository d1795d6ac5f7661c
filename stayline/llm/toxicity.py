"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Training reads a bounded sample of the labelled documents (``SAMPLE`` of each class, in the order of a hash of
their ids). Spark counts in how many toxic and other documents each hashed n-gram stands; the log ratio of
the two shares scales the n-gram's feature; a logistic regression is fitted on the most telling n-grams. All
documents are then scored where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, slices, table
from .linear import fit_logistic

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 3000
NGRAMS = (3, 4, 5)
SLOTS_LOG2 = 20
# FEATURES, L2 and TOXIC_COST are those of the best AUC, and of under one false alarm in 100, over four folds of the
# training rows of sf0.1 (copies of a text in one fold); held-out rows had no part in it. README has the figures.
#: n-grams that the regression sees, at most.
FEATURES = 1 << 10
LEAST_DOCS = 4
SMOOTHING = 1.0
#: Ridge penalty of the regression; rare n-grams of few documents should not be learned by heart.
L2 = 3e-3
#: A missed toxic row counts as much as this many false alarms; so 0.5 is reached where one in 3 rows is toxic.
TOXIC_COST = 2.0
#: Characters that are hashed at once (bounded memory for very long texts).
PIECE = 1 << 19


def ngram_slots(text: str | None):
    """Yields arrays of slot numbers of the text's n-grams; characters are lower-cased, white space is one space."""
    import numpy as np

    text = " " + " ".join((text or "").lower().split()) + " "
    longest = max(NGRAMS)
    for at in range(0, max(1, len(text) - longest + 1), PIECE):
        part = text[at : at + PIECE + longest - 1]
        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = chars.copy()
        for n in range(2, longest + 1):
            if len(chars) < n:
                break
            h = h[: len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1 :]
            if n in NGRAMS:
                yield ((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS_LOG2)


def distinct_slots(text: str | None):
    import numpy as np

    parts = list(ngram_slots(text))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class ToxicityModel:
    slots: list[int]
    weights: list[float]
    bias: float


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """``(toxic, text)`` of at most ``sample`` different labelled rows of each class, and how many ids have each label.

    Ids are chosen first, then, among the rows that have them (an id may have many), rows; both in the order of a hash.
    """
    known = (
        pick(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    )
    totals = {int(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}

    def first(rows: DataFrame, *order) -> DataFrame:
        picked = [rows.where(F.col("toxic") == c).orderBy(*order).limit(sample) for c in (0, 1)]
        return F.broadcast(picked[0].union(picked[1]))  # 2 * sample rows of a few numbers at most

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.col("text").cast("string"))
    chosen = first(known, F.xxhash64("doc_id"), "doc_id")
    matched = rows.join(chosen, "doc_id").groupBy("doc_id", "text").agg(F.first("toxic").alias("toxic"))
    matched = materialize(matched.withColumn("hash", F.xxhash64("doc_id", "text")), "toxic-sample")
    few = first(matched.select("doc_id", "toxic", "hash"), "hash", "doc_id")
    return matched.join(few.drop("toxic"), ["doc_id", "hash"], "left_semi").select("toxic", "text"), totals


def count_ngrams(texts: DataFrame) -> DataFrame:
    """``(slot, n0, n1)``: in how many texts of each class each hashed n-gram stands."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        counts = [np.zeros(1 << SLOTS_LOG2, np.int32) for _ in range(2)]
        for b in slices(batches):
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[int(y)][distinct_slots(text)] += 1
        at = np.flatnonzero(counts[0] + counts[1])
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), *(pa.array(c[part], pa.int32()) for c in counts)], names=["slot", "n0", "n1"]
            )

    counted = texts.select("toxic", "text").mapInArrow(count, "slot int, n0 int, n1 int")
    return counted.groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_count_ratio(n0: int, n1: int) -> tuple[Column, Column]:
    """The log ratio of an n-gram's shares among toxic and other texts, and how telling their difference is."""
    p = (F.col("n1") + SMOOTHING) / (n1 + 2 * SMOOTHING)
    q = (F.col("n0") + SMOOTHING) / (n0 + 2 * SMOOTHING)
    return F.log(p / q), F.abs(p - q) / F.sqrt(p + q)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", cost: float = TOXIC_COST
) -> ToxicityModel:
    """Learns from labelled rows that are not held out; rows with a null id or label teach nothing.

    Labels that disagree about an id count as toxic. Rows that share an id are sampled like others, and rows that
    repeat count once. With one class only, the model scores its share.
    """
    import numpy as np

    texts, totals = sample_rows(docs, labels, sample, id_col, text_col)
    sizes = {int(r[0]): r[1] for r in texts.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    share = totals.get(1, 0) / max(1, totals.get(0, 0) + totals.get(1, 0))
    if not n0 or not n1:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel([], [], float(np.log(p / (1 - p))))
    counted = count_ngrams(texts).where(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    ratio_of, gain = log_count_ratio(n0, n1)
    picked = (
        counted.select("slot", ratio_of.alias("ratio"), gain.alias("gain"))
        .orderBy(F.desc("gain"), "slot")
        .limit(FEATURES)  # a feature selection of fixed size
        .collect()
    )
    slots = np.array([r.slot for r in picked], np.int64)
    ratio = np.array([r.ratio for r in picked])
    column = np.full(1 << SLOTS_LOG2, -1, np.int32)
    column[slots] = np.arange(len(slots))

    def encode(batches):
        import pyarrow as pa

        for b in slices(batches):
            found = [column[distinct_slots(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[f >= 0].tolist() for f in found], pa.list_(pa.int32()))], names=["toxic", "cols"]
            )

    train = texts.mapInArrow(encode, "toxic int, cols array<int>").collect()  # at most 2 * sample rows
    train.sort(key=lambda r: (r.toxic, r.cols))
    y = np.array([r.toxic for r in train], float)
    toxic = cost * share / (cost * share + 1 - share)
    weight = np.where(y == 1, toxic / n1, (1 - toxic) / n0)  # classes weigh as among all labels, toxic ones by their cost
    coef, bias = fit_logistic([r.cols for r in train], y, weight, len(slots), l2=L2, scale=ratio)
    weights = coef * ratio
    used = np.flatnonzero(np.abs(weights) > 1e-4)
    return ToxicityModel(slots[used].tolist(), weights[used].tolist(), bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each input row.

    A null text scores like an empty one: the model's intercept. A null id is not held out. Repeated rows stay;
    an empty table gives an empty result; other columns are ignored.
    """
    import pyarrow as pa

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np

        weights = np.zeros(1 << SLOTS_LOG2, np.float32)
        weights[model.slots] = model.weights

        def score(text):
            hit = [part[weights[part] != 0] for part in ngram_slots(text)]
            total = float(weights[np.unique(np.concatenate(hit))].sum(dtype=np.float64)) if hit else 0.0
            return float(1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35))))

        for b in slices(batches):
            scores = pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_toxicity_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
