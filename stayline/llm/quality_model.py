"""Quality classifier without labels: overlapping heuristics, a label model, and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document; the same pass hashes its features. The votes are counted by pattern over all
documents (three to the power of the number of labellers at most); expectation-maximisation estimates each
labeller's accuracies from those counts. Posterior labels of a bounded sample then train a linear scorer over
hashed text features, which scores every document, also where no labeller votes.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass
from operator import eq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, slices, table
from .linear import fit_logistic

LABELLERS = ("symbols", "capitals", "plain_words", "repeats", "lines", "compression", "variety", "empty")
#: Documents that the scorer is fitted on, at most (in the order of a hash of their ids, votes and features).
SAMPLE = 6000
SLOTS = 1 << 12
ROUNDS = 100


_PLAIN = re.compile(r"""[("'«„“]*[^\W_]+(?:[-'’][^\W_]+)*[)"'»“”]*[.,;:!?…]?[)"'»“”]*""")


_ASCII = re.compile(r"[\x00-\x7f]+")
_CAPITALS, _LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()


def measure(text: str | None, compress) -> tuple[list[int], list[int]]:
    """A vote of each labeller (1 good, 2 bad, 0 none), and the slots of the text's hashed features.

    Most labellers speak of one kind of defect, and say nothing where they don't see it: that a text has no
    symbols is no sign that it doesn't repeat itself. Few vote good, on what prose has as a whole. Features are the
    shapes of words, binned shares, and the text's compression.
    """
    import zlib

    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = len(set(lines))
    ratio = len(raw) / len(compress(raw)) if raw else 0.0
    symbols = sum(map(text.count, "#*$%&|<>"))
    pairs = sum(map(eq, words, words[1:]))
    different = len(set(words)) / max(1, n) ** 0.75
    votes = [0] * (len(LABELLERS) - 1) + [2]
    if n:
        spelled = text.split()
        rest = _ASCII.sub("", text)
        capitals = len(raw) - len(raw.translate(None, _CAPITALS)) + sum(map(str.isupper, rest))
        letters = len(raw) - len(raw.translate(None, _LETTERS)) + sum(map(str.isalpha, rest)) or 1
        plain = sum(map(_PLAINNESS.__getitem__, spelled)) / max(1, len(spelled))
        long = len(raw) > 300
        votes = [
            2 if symbols > 0.15 * n else 0,
            2 if letters > 20 and capitals > 0.5 * letters else 0,
            1 if plain >= 0.97 else 2 if plain < 0.75 else 0,
            2 if n >= 8 and pairs > 0.12 * n else 0,
            2 if len(lines) > 3 and n_lines < 0.6 * len(lines) else 0,
            2 if long and ratio > 3.2 else 1 if long and 1.3 < ratio < 2.6 else 0,
            2 if n >= 30 and different < 0.35 else 1 if n >= 30 and different > 0.8 else 0,
            0,
        ]

    def level(share: float) -> int:
        return min(6, int(8 * share**0.5))

    m = max(1, n)
    shapes = Counter(map(_SHAPES.__getitem__, words))
    tokens = [f"shape {s} {level(c / m)}" for s, c in sorted(shapes.items(), key=lambda x: (-x[1], x[0]))[:40]]
    tokens += [
        f"words {min(12, m.bit_length())}",
        f"compress {m.bit_length()} {int(4 * min(8, ratio))}",
        f"pairs {level(pairs / m)}",
        f"lines {level(1 - n_lines / max(1, len(lines)) if lines else 0)}",
        f"variety {int(10 * min(1.5, different))}",
        f"symbols {level(min(1.0, symbols / m))}",
    ]
    return votes, sorted({zlib.crc32(t.encode()) % SLOTS for t in tokens})


class _Memo(dict):
    """What a function of one word gave, for a bounded number of words."""

    def __init__(self, function, most: int = 300_000):
        self.function, self.most = function, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.function(word)
        return value


def _shape(word: bytes) -> str:
    s = word.decode("utf-8", "replace")
    kind = ("A" if s.isupper() and len(s) > 1 else "a" if s.isalpha() else "0" if s.isdigit() else "")
    return kind or re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", s))[:6]


_SHAPES = _Memo(_shape)
_PLAINNESS = _Memo(lambda w: _PLAIN.fullmatch(w) is not None)


@dataclass(frozen=True)
class LabelModel:
    """``share`` of good documents, and for each labeller the chance of each vote given good and bad."""

    share: float
    good: list[list[float]]
    bad: list[list[float]]

    def posterior(self, votes) -> float:
        import math

        a, b = math.log(self.share), math.log(1 - self.share)
        for j, v in enumerate(votes):
            if v:  # no vote is no evidence
                a += math.log(self.good[j][v])
                b += math.log(self.bad[j][v])
        return 1 / (1 + math.exp(min(700, b - a)))


def fit_label_model(patterns: list[tuple[list[int], int]], rounds: int = ROUNDS) -> LabelModel:
    """EM over ``(votes, number of documents)``. Deterministic: it begins with documents bad that any labeller calls so.

    A small prior says that labellers are better than chance, which keeps "bad" from changing its meaning.
    """
    import numpy as np

    k = len(LABELLERS)
    if not patterns:
        return LabelModel(0.5, [[1 / 3] * 3] * k, [[1 / 3] * 3] * k)
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    z = np.where((votes == 2).any(1), 0.05, 0.95)
    trust = 0.01 * n.sum()
    prior = trust * np.array([[1.0, 1.0, 0.02], [1.0, 0.3, 1.0]])  # of votes 0, 1, 2 given good, and given bad
    for _ in range(rounds):
        tables = []
        for w, p in ((n * z, prior[0]), (n * (1 - z), prior[1])):
            counts = np.array([[w[votes[:, j] == v].sum() + p[v] + 0.01 for v in range(3)] for j in range(k)])
            tables.append(counts / counts.sum(1, keepdims=True))
        share = min(max((n * z).sum() / n.sum(), 1e-3), 1 - 1e-3)
        logs = [np.where(votes > 0, np.log(t)[np.arange(k), votes], 0.0).sum(1) for t in tables]  # no vote is no evidence
        z = 1 / (1 + np.exp(np.clip(logs[1] + np.log(1 - share) - logs[0] - np.log(share), -700, 700)))
    return LabelModel(float(share), tables[0].tolist(), tables[1].tolist())


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, votes, cols)`` of every row, in one pass over the texts."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.withColumn("text", F.col("text").cast("string"))

    def run(batches):
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        ints = pa.list_(pa.int32())
        for b in slices(batches):
            found = [measure(t, compress) for t in b.column(1).to_pylist()]
            votes, cols = (pa.array([f[k] for f in found], ints) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), votes, cols], names=["doc_id", "votes", "cols"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, votes array<int>, cols array<int>")


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, weak_label, score, kept)``, one row for each input row; score is the chance of good quality.

    Null and empty texts get a vote for empty. Rows with a null id are scored, but not trained on, and rows that repeat
    train once. Repeated rows and rows that share an id stay, each with its own votes and features; how rows are dealt
    to tasks changes nothing. An
    empty table gives an empty result; other columns are ignored. ``weak_label`` is the posterior.
    """
    import numpy as np

    found = materialize(signals(docs, id_col, text_col), "quality-signals")
    patterns = found.groupBy("votes").count().collect()  # at most 3 ** len(LABELLERS) patterns
    model = fit_label_model(sorted((list(r.votes), r["count"]) for r in patterns))
    place = F.pmod(F.xxhash64("doc_id", "votes", "cols"), F.lit(1 << 32))
    share = min(1.0, 2 * sample / max(1, sum(r["count"] for r in patterns)))  # so that tasks bring about 2 * sample rows
    drawn = found.where(F.col("doc_id").isNotNull() & (place < int(share * (1 << 32)))).distinct()
    train = drawn.orderBy(place, "doc_id", "votes", "cols").limit(sample).select("votes", "cols").collect()
    train.sort(key=lambda r: (r.votes, r.cols))
    coef, bias = fit_logistic(
        [r.cols for r in train], [model.posterior(r.votes) for r in train], np.ones(len(train)), SLOTS, l2=1e-4
    )
    if not train:
        bias = 0.0

    def run(batches):
        import pyarrow as pa

        known: dict[tuple, float] = {}
        for b in slices(batches, 10_000):
            weak = []
            for votes in map(tuple, b.column(1).to_pylist()):
                if votes not in known:
                    known[votes] = model.posterior(votes)
                weak.append(known[votes])
            owner = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            z = np.bincount(owner, coef[b.column(2).flatten().to_numpy()], b.num_rows) + bias
            scores = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(weak, pa.float64()), pa.array(scores)], names=["doc_id", "weak_label", "score"]
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, weak_label double, score double").withColumn("kept", F.col("score") >= 0.5)


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))
