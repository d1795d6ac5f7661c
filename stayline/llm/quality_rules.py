"""Quality rules: Zstandard compression bands over whole documents and fixed chunks.

Natural text compresses within a band that widens with length. Text far above it repeats itself, text below
it is encoded or random. The whole document and its chunks of fixed size are held against limits for their
length; chunks catch a repetitive or incompressible part that the whole document hides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, slices, table

#: ``(bytes from, lowest ratio, highest ratio)`` for whole documents. Short texts have hardly any limit below:
#: a frame's header and unprimed statistics weigh on them.
WHOLE_BANDS = (
    (0, 0.0, 2.6),
    (128, 0.85, 2.6),
    (512, 1.15, 2.6),
    (2048, 1.25, 2.8),
    (8192, 1.3, 3.2),
    (32768, 1.3, 3.6),
    (131072, 1.3, 4.0),
)
CHUNK_BYTES = 2048
#: A shorter rest at a text's end is judged as the last bytes of this number, some of the chunk before among them.
CHUNK_LEAST = 1024
CHUNK_BANDS = ((CHUNK_LEAST, 1.15, 2.7), (CHUNK_BYTES, 1.2, 2.8))
#: Largest share of judged chunks outside their band.
BAD_CHUNKS = 0.25
LEVEL = 3
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, whole_ratio double, bad_chunk_share double, verdict string"
)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of 8 words that occurs twice or more in the text, each word counted once.

    Windows are compared exactly: ranks of single words are combined into ranks of 2, 4 and 8 words.
    """
    import numpy as np

    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    width = 1
    while width < window:
        pairs = rank[:-width] * (n + 1) + rank[width:]
        rank = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        width *= 2
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def band(size: int, bands: tuple) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for start, a, b in bands:
        if size >= start:
            low, high = a, b
    return low, high


def measure(text: str | None, compress) -> tuple:
    """The columns of ``_SCHEMA`` for one text; ``compress`` maps bytes to compressed bytes."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split knows exactly the white space of the contract
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_words, repeats = len(words), repeat_words(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    base_failed = n_words < 20 or 100 * repeats > 30 * n_words
    whole = len(raw) / len(compress(raw)) if raw else 0.0
    low, high = band(len(raw), WHOLE_BANDS)
    judged = bad = 0
    for at in range(0, len(raw), CHUNK_BYTES):
        chunk = raw[min(at, max(0, len(raw) - CHUNK_LEAST)) : at + CHUNK_BYTES]
        if len(chunk) >= CHUNK_LEAST:  # a text shorter than that is judged whole
            a, b = band(len(chunk), CHUNK_BANDS)
            judged += 1
            bad += not a <= len(chunk) / len(compress(chunk)) <= b
    share = bad / judged if judged else 0.0
    if base_failed:
        verdict = "base"
    elif whole > high:
        verdict = "repetitive"
    elif whole < low:
        verdict = "incompressible"
    else:
        verdict = "chunks" if share > BAD_CHUNKS else "kept"
    return (
        n_words, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, base_failed,
        verdict == "kept", whole, share, verdict,
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the base counts, the ratios, ``kept`` and the ``verdict`` that decided.

    A null text has no words and fails the base rule, as does an empty one. Null ids and repeated rows are
    carried along; each row is judged by itself, so there are no ties. An empty table gives an empty result.
    Other columns are ignored.
    """
    import pyarrow as pa

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    arrow = [types[part.split()[1]] for part in _SCHEMA.split(", ")]

    def run(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        for b in slices(batches):
            got = list(zip(*(measure(t, compress) for t in b.column(1).to_pylist()))) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, t) for v, t in zip(got, arrow))], names=["doc_id", *names]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that ``quality_rules`` keeps; each row is judged by its own text."""
    import pyarrow as pa

    at = docs.columns.index(text_col)
    # names by place: mapInArrow resolves the names of its input, and a name may hold a dot
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    rows = rows.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    def run(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        kept = [part.split()[0] for part in _SCHEMA.split(", ")].index("kept")
        for b in slices(batches):
            yield b.filter(pa.array([measure(t, compress)[kept] for t in b.column(at).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
