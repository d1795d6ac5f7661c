"""SimHash near-duplicates through pivot distance tables.

Fingerprints link at Hamming distance 2 or less. The distances of every distinct fingerprint to 129 reference
fingerprints (pivots) are computed once; everything after that works on this table.

* Candidates by binned coordinates. Pivot 0 is the base; pivot 1 + b is the base with bit b flipped. Whether a
  fingerprint is nearer to pivot 1 + b than to the base is its coordinate b (a bin of the distance difference, which is
  +1 or -1). Fingerprints 2 bits apart differ in 2 coordinates at most, so of 4 blocks of 16 coordinates they agree on
  2 whole ones: each of the 6 pairs of blocks is a (mask, coordinates under the mask) key that finds all of them.
* Keys shared by more than PAIR_GROUP fingerprints are refined in the same way: the 32 coordinates outside the mask
  make 4 blocks of 8, and then the last 16 make 4 blocks of 4. After the third level 8 coordinates are free, so a key
  has 256 fingerprints at most and the work stays linear, whatever the group. No link is lost on the way.
* Discards by the largest coordinate difference. Distances to a pivot are 1-Lipschitz, so a pair whose distances to
  any of 64 free pivots differ by more than 2 is no link; the rest is verified by the exact distance.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.components import connected_components
from .common import materialize, pick, slices, spread_join, table

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
FREE_PIVOTS = 64
#: Keys with more fingerprints than this are refined before their pairs are looked at.
PAIR_GROUP = 24


def fingerprint_of(text: bytes | None) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 without words."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n, step = max(1, len(words) - SHINGLE_WORDS + 1), 20_000
    ones = np.zeros(64, np.int64)
    for at in range(0, n, step):  # bounded memory for very long texts
        part = words[at : at + step + SHINGLE_WORDS - 1]
        if len(part) < SHINGLE_WORDS:
            shingles, count = [b" ".join(part)], 1
        else:
            count = len(part) - SHINGLE_WORDS + 1
            shingles = map(b" ".join, zip(part, part[1:], part[2:]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row: null and empty texts have fp 0, repeated rows stay."""
    import pyarrow as pa

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.col("text").cast("binary"))

    def run(batches):
        for b in slices(batches):
            fp = pa.array([fingerprint_of(x) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _pivot(k: int) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(f"pivot {k}", seed=SEED), "big", signed=True)


def pivots() -> list[int]:
    """The base, the base with each bit flipped, and the free pivots."""
    flipped = [_signed(_pivot(0) % (1 << 64) ^ (1 << b)) for b in range(64)]
    return [_pivot(0), *flipped, *(_pivot(k) for k in range(1, FREE_PIVOTS + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(distinct: DataFrame) -> DataFrame:
    """``(fp, coords, d)``: the 64 binned coordinates as bits of a long, and the distances to the free pivots."""
    distance = F.transform(
        F.array(*map(F.lit, pivots())), lambda p: F.bit_count(F.col("fp").bitwiseXOR(p)).cast("byte")
    )
    rows = distinct.select("fp", distance.alias("all"))
    bins = [F.when(F.col("all")[1 + b] < F.col("all")[0], F.lit(_signed(1 << b))).otherwise(F.lit(0)) for b in range(64)]
    return rows.select("fp", reduce(lambda a, b: a.bitwiseOR(b), bins).alias("coords"), F.slice("all", 66, FREE_PIVOTS).alias("d"))


def _finer(mask: int, width: int) -> list[int]:
    """The 6 masks that add 2 of 4 blocks of ``width`` coordinates outside ``mask``."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = [sum(1 << b for b in free[k * width : (k + 1) * width]) for k in range(4)]
    return [mask | a | b for a, b in combinations(blocks, 2)]


def refinements() -> list[dict[int, list[int]]]:
    """For each level, the finer masks of each mask."""
    levels: list[dict[int, list[int]]] = []
    masks = [0]
    for width in (16, 8, 4):
        levels.append({m: _finer(m, width) for m in masks})
        masks = list(dict.fromkeys(x for finer in levels[-1].values() for x in finer))
    return levels


def _candidates(keyed: DataFrame) -> DataFrame:
    """``(a, b, apart)`` of the pairs of a key; ``apart`` is their largest difference of free coordinates."""
    x, y = keyed.alias("x"), keyed.alias("y")
    apart = F.array_max(F.zip_with("x.d", "y.d", lambda p, q: F.abs(p - q)))
    same = (F.col("x.mask") == F.col("y.mask")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
    return x.join(y, same).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), apart.alias("apart"))


def candidate_pairs(distinct: DataFrame) -> DataFrame:
    """``(a, b, apart)`` of all candidates; a pair comes once for each key that it shares."""
    found = []
    keyed = materialize(pivot_table(distinct), "simhash-pivots").withColumn("mask", F.lit(0).cast("long"))
    for level, finer in enumerate(refinements()):
        table_of = F.create_map(*(x for m, ms in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(f)) for f in ms)))))
        entries = keyed.select("fp", "coords", "d", F.explode(table_of[F.col("mask")]).alias("mask"))
        entries = entries.withColumn("key", F.col("coords").bitwiseAND(F.col("mask")))
        sizes = entries.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = materialize(entries.join(sizes, ["mask", "key"]), f"simhash-keys-{level}")
        last = level == 2  # 256 fingerprints at most
        found.append(_candidates(shared if last else shared.where(F.col("n") <= PAIR_GROUP)))
        keyed = shared.where(F.col("n") > PAIR_GROUP).drop("key", "n")
        if last or keyed.isEmpty():  # nothing is left to refine
            break
    return reduce(DataFrame.union, found)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs (a < b) of different values of column ``fp`` at distance 2 or less."""
    return (
        candidate_pairs(distinct)
        .where(F.col("apart") <= MAX_DISTANCE)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
        .select("a", "b")
        .distinct()
    )


def link_report(distinct: DataFrame) -> DataFrame:
    """One row: ``pairs`` looked at, ``discarded`` by pivots, ``refuted`` by the exact distance, and ``verified``
    (each for every key that a pair shares)."""
    near = F.col("apart") <= MAX_DISTANCE
    link = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    return candidate_pairs(distinct).agg(
        F.count("*").alias("pairs"), F.count_if(~near).alias("discarded"),
        F.count_if(near & ~link).alias("refuted"), F.count_if(near & link).alias("verified"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each input row.

    Null and empty texts have the zero fingerprint and link with each other and with fingerprints near zero.
    Rows with a null id are fingerprinted and linked, but never name a component while another row can; a
    group of null ids only has a null component_id. Repeated rows stay. An empty table gives an empty result.
    Other columns of the input are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    rooted = materialize(rooted, "simhash-roots")
    named = rooted.select("fp", "root").join(
        rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root"
    )
    return spread_join(prints, ["fp"], named.select("fp", "component_id")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
