"""Product codes of vectors by exact integer matrix products.

Components become integers, ``floor(1024 * x)``. Nearest entries need dot products of integers: integers are broken into
limbs so short that a float64 product of two limb matrices stays below 2 ** 53, where float64 is exact; the products are
shifted and added in int64. The codebooks (at most 256 entries for each of four parts) are the only thing that passes
through the driver; a round brings back one sum for each entry, added up in the tasks first.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, spread_join, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Largest absolute component, as an integer: squared distances of a whole vector stay in int64 up to 2 ** 7 dimensions.
LARGEST = 1 << 27
#: Vectors that meet the codebooks at a time.
BLOCK = 4096


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 matrices of ``bits``-bit limbs, the last one signed; ``x`` is the sum of limb * 2 ** (bits * place)."""
    out, rest = [], x
    largest = int(np.abs(x).max(initial=0))
    while largest >> bits:
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
        largest = int(np.abs(rest).max(initial=0))
    return [*out, rest.astype(np.float64)]


def limb_bits(width: int) -> int:
    """The longest limb whose products, summed over ``width`` places, stay below 2 ** 53."""
    return (52 - max(1, width).bit_length()) // 2


def exact_dots(x: np.ndarray, y: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, exact wherever the result fits int64."""
    bits = bits or limb_bits(x.shape[1])
    total = np.zeros((len(x), len(y)), np.int64)
    ys = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(ys):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the first of ties) and its squared distance."""
    far = (book * book).sum(axis=1)[None, :] - 2 * exact_dots(x, book, bits)
    index = far.argmin(axis=1)
    return index, far[np.arange(len(x)), index] + (x * x).sum(axis=1)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _blocks(batches, place: int):
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            piece = b.slice(at, BLOCK)
            yield piece, _matrix(piece.column(place))


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, v)`` of the vectors without null or non-finite components; ``v`` holds ``floor(1024 * x)``."""
    rows = pick(vectors, id_col, vector_col, label_col).toDF("vec_id", "x", "label")
    x = F.col("x").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    small = F.forall(x, lambda c: F.abs(c * SCALE) < LARGEST)
    kept = rows.where(F.col("x").isNotNull() & fine)
    whole = F.transform(x, lambda c: F.floor(c * SCALE))
    checked = F.when(small, whole).otherwise(F.raise_error(F.lit("a component is too large for an exact squared distance in 64 bits")))
    return kept.select("vec_id", "label", checked.alias("v"))


def _sums(rows: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the parts that each entry is nearest to."""
    import pyarrow as pa

    width = books[0].shape[1]

    def run(batches):
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for _, v in _blocks(batches, 0):
            for p, book in enumerate(books):
                part = v[:, p * width : (p + 1) * width]
                index, _ = nearest(part, book)
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                sums[p][used] += np.add.reduceat(part[order], first, axis=0)
                counts[p][used] += n
        rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
        if rows:
            part, entry, n, total = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.list_(pa.int64()))],
                names=["part", "entry", "n", "total"],
            )

    partial = rows.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    places = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect()  # a row for each entry at most
    return {(r.part, r.entry): (r.n, [int(r[f"s{i}"]) for i in range(width)]) for r in found}


def codebooks(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` rounds over the rows ``(vec_id, label, v)``; empty without rows."""
    first = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(entries).select("v").collect()
    if not first:
        return []
    lengths = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    width, rest = divmod(lengths[0], parts)
    if lengths[0] != lengths[1] or rest or not width:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} components can't be cut into {parts} equal parts")
    seeds = np.array([r.v for r in first], np.int64)
    books = [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        for (p, e), (n, total) in _sums(rows, books).items():
            books[p][e] = [s // n for s in total]
    return books


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` of every vector without null or non-finite components, and the codebooks.

    Repeated ids are rows of their own, and a null id sorts last among the first codebook's vectors (equal ids by their
    integers). All vectors must have the same length, a multiple of four, and components below 2 ** 17 (else squared
    distances would leave 64 bits): other tables are refused. A table without usable vectors gives no rows.
    """
    import pyarrow as pa

    if entries > 256:
        raise ValueError("a code has two hex digits")
    whole = materialize(integer_vectors(vectors, id_col, vector_col, label_col), "integer-vectors")
    books = codebooks(whole, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"

    def run(batches):
        width = books[0].shape[1] if books else 0
        for piece, v in _blocks(batches, 2):
            found = [nearest(v[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return whole.mapInArrow(run, schema), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    label = F.coalesce(F.col("label").cast("string"), F.lit(""))
    rows = materialize(coded.select("*", F.col("label").isNull().alias("none"), label.alias("name")), "vector-codes")
    sums = rows.groupBy("none", "name").agg(F.sum("error").alias("label_error"))
    digest = sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()
    return spread_join(rows, ["none", "name"], sums).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
