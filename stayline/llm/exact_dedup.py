"""Exact duplicates through an extendible-hash index on files in the shared folder.

Pages: every task normalises its rows and names each by the first row of its task with the same bytes, as far as
it remembers them (the representative). Representatives are the index's postings: key (XXH64), digest (SHA-256) and
body; the other rows cost a few numbers.

Directory: postings are counted by their leading key bits (a bounded number of counters). Buckets start as one;
an overfull bucket splits on its next bit, doubling the directory when it is already at full depth. A bucket that
is overfull at the greatest depth (one hot key, or a very large table) gets overflow pages, dealt by posting.

Owners: buckets are numbered in the order of their keys, and an owner task takes neighbouring buckets, so it holds
a key range. It reads its postings in key order and compares bytes with the chain of entries of their key: a posting
joins the entry whose bytes it has, or ends the chain as a new entry. Entries of overflow pages meet once more, by
bucket, in the same way. The entry (bucket, key, place in the chain) names the group.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, slices, table, text_or_empty

#: Postings that a bucket holds before it splits.
BUCKET_ROWS = 1_000
#: Leading bits that the directory may use (2 ** MAX_DEPTH counters); fuller buckets get overflow pages.
MAX_DEPTH = 18
#: Postings that an owner task takes at least, where there are enough for every shuffle partition.
OWNER_ROWS = 20_000
#: Bytes of bodies that a task remembers at a time; forgetting one only makes a further posting.
REMEMBERED_BYTES = 32 << 20

_ENTRY = ["bucket", "key", "chain"]


def xxh64_key(body: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(body)


def index_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_of: Callable[[bytes], int] = xxh64_key) -> DataFrame:
    """Rows ``(doc_id, n_cp, row, rep)`` and postings ``(rep, key, sha, body)`` in one table; the other columns are null."""
    import pyarrow as pa

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select("doc_id", F.length(text_or_empty()).alias("n_cp"), text_or_empty().cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_cp", "row", "rep", "key", "sha", "body"]

    def run(batches):
        from hashlib import sha256

        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, 0
        seen: dict[bytes, int] = {}
        for b in slices(batches):
            reps, postings = [], []
            first = number
            for raw in b.column(2).to_pylist():
                body = raw.translate(None, b" \t\n\x0b\x0c\r")
                rep = seen.get(body)
                if rep is None:
                    rep = number
                    postings.append((rep, key_of(body), sha256(body).digest(), body))
                    if held + len(body) > REMEMBERED_BYTES:
                        seen.clear()
                        held = 0
                    seen[body] = rep
                    held += len(body)
                reps.append(rep)
                number += 1
            n, none = len(reps), pa.nulls
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(range(first, number), pa.int64()), pa.array(reps, pa.int64())]
                + [none(n, pa.int64()), none(n, pa.binary()), none(n, pa.binary())],
                names=names,
            )
            if postings:
                n, (at, keys, shas, bodies) = len(postings), zip(*postings)
                yield pa.RecordBatch.from_arrays(
                    [none(n, b.column(0).type), none(n, b.column(1).type), none(n, pa.int64()), pa.array(at, pa.int64())]
                    + [pa.array(keys, pa.uint64()).view(pa.int64()), pa.array(shas, pa.binary()), pa.array(bodies, pa.binary())],
                    names=names,
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_cp int, row long, rep long, key long, sha binary, body binary")


def directory_of(counts: dict[int, int], depth: int, capacity: int) -> tuple[int, list[int], list[int]]:
    """Bits in use, the bucket of each prefix of so many bits, and the size of each bucket.

    ``counts`` are those of postings by their ``depth`` leading bits. Starts with one bucket and splits the overfull
    ones, doubling the slots when a bucket is at full depth. Buckets are numbered in key order.
    """
    total = [0]
    for p in range(1 << depth):
        total.append(total[-1] + counts.get(p, 0))

    def postings(prefix: int, bits: int) -> int:
        width = depth - bits
        return total[(prefix + 1) << width] - total[prefix << width]

    bits_now, slots, local, size = 0, [0], [0], [postings(0, 0)]
    waiting = [(0, 0)]  # bucket, its prefix
    while waiting:
        bucket, prefix = waiting.pop()
        if size[bucket] <= capacity or local[bucket] == depth:
            continue
        if local[bucket] == bits_now:
            slots = [s for s in slots for _ in range(2)]
            bits_now += 1
        local[bucket] += 1
        new, halves = len(local), (prefix << 1, (prefix << 1) | 1)
        local.append(local[bucket])
        size[bucket] = postings(halves[0], local[bucket])
        size.append(postings(halves[1], local[bucket]))
        width = bits_now - local[bucket]
        slots[halves[1] << width : (halves[1] + 1) << width] = [new] * (1 << width)
        waiting += [(bucket, halves[0]), (new, halves[1])]
    number = {b: k for k, b in enumerate(dict.fromkeys(slots))}
    return bits_now, [number[s] for s in slots], [size[b] for b in number]


def chain_bodies(batches: Iterator, kept: set[int] | None, names: list[str]) -> Iterator:
    """``chain``: the place of each posting's body in the chain of its ``(bucket, page, key)``; ``head``: the posting
    that made this entry. Columns come in the order of ``names``.

    Postings come in the order of bucket, page, key and digest, so that a task holds the chain of one key. ``body``
    is given out again only for new entries, and where ``kept`` has the bucket (None: nowhere).
    """
    import pyarrow as pa

    here, chain = None, []
    for b in slices(batches):
        col = {n: b.column(k).to_pylist() for k, n in enumerate(names)}
        places, leads, heads = [], [], []
        for rep, bucket, page, key, sha, body in zip(*(col[n] for n in ("rep", "bucket", "page", "key", "sha", "body"))):
            if (bucket, page, key) != here:
                here, chain = (bucket, page, key), []
            place = next((k for k, (_, other, _) in enumerate(chain, 1) if other == body), 0)
            new = not place
            if new:
                if any(other == sha for other, _, _ in chain):
                    raise ValueError("two texts under one SHA-256")
                chain.append((sha, body, rep))
                place = len(chain)
            places.append(place)
            leads.append(chain[place - 1][2])
            heads.append(body if new and kept is not None and bucket in kept else None)
        columns = list(b.columns)
        columns[names.index("body")] = pa.array(heads, pa.binary())
        columns += [pa.array(places, pa.int32()), pa.array(leads, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "chain", "head"])


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH, key_of: Callable[[bytes], int] = xxh64_key,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, postings)``: ``(doc_id, n_cp, row, rep)`` of every row, and ``(rep, bucket, key, chain, sha)`` of
    every representative, where (bucket, key, chain) is its entry."""
    spark = docs.sparkSession
    pages = materialize(index_pages(docs, id_col, text_col, key_of), "exact-pages")
    postings = pages.where("key is not null").select("rep", "key", "sha", "body")
    prefix = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
    found = postings.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).toArrow()  # at most 2 ** max_depth counters
    counts = dict(zip(*(found.column(c).to_pylist() for c in ("p", "n"))))
    bits, slots, sizes = directory_of(counts, max_depth, bucket_rows)
    over = [max(1, -(-n // bucket_rows)) for n in sizes]
    first = [0]
    for n in over:
        first.append(first[-1] + n)
    units, total = first[-1], sum(sizes)
    per_owner = max(bucket_rows, min(OWNER_ROWS, total // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    owners = max(1, min(units, -(-total // per_owner)))

    def by_slot(values: list[int]) -> Column:
        slot = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
        return F.get(F.from_json(F.lit(json.dumps([values[s] for s in slots])), "array<int>"), slot)

    def owned(df: DataFrame) -> DataFrame:
        """An owner has a range of buckets (and of a bucket's overflow pages), and reads it in key order."""
        owner = F.floor((F.col("bucket") + F.col("page")).cast("long") * owners / units).cast("int")
        return df.repartitionById(owners, owner).sortWithinPartitions("bucket", "page", "key", "sha", "rep")

    page = F.pmod(F.xxhash64("rep"), by_slot(over)).cast("int") if max(over) > 1 else F.lit(0)
    placed = postings.select("rep", by_slot(first).alias("bucket"), page.alias("page"), "key", "sha", "body")
    names, schema = placed.columns, "rep long, bucket int, page int, key long, sha binary, body binary, chain int, head long"
    overfull = {b for b, n in zip(first, over) if n > 1}  # buckets at the greatest depth only
    if not overfull:
        entries = owned(placed).mapInArrow(lambda batches: chain_bodies(batches, None, names), schema)
        return pages.where("row is not null"), materialize(entries.select("rep", *_ENTRY, "sha"), "exact-index")
    local = materialize(owned(placed).mapInArrow(lambda batches: chain_bodies(batches, overfull, names), schema), "exact-overflow")
    heads = local.where("body is not null").select("rep", "bucket", F.lit(0).alias("page"), "key", "sha", "body")
    merged = owned(heads).mapInArrow(lambda batches: chain_bodies(batches, None, names), schema)
    entries = local.drop("body").join(merged.select(F.col("rep").alias("head"), F.col("chain").alias("merged")), "head", "left")
    entries = entries.select("rep", "bucket", "key", F.coalesce("merged", "chain").alias("chain"), "sha")
    return pages.where("row is not null"), materialize(entries, "exact-index")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, chain)``, one row for each input row.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty, and
    all blank texts form one group. The row with the most code points stays, ties going to the smallest id (of any
    type that sorts); a null id loses such ties, and a group of null ids only has a null keep_id. Exactly one row of
    a group is kept, also where rows repeat the staying id and length. Empty tables give empty results.
    """
    rows, postings = build_index(docs, id_col, text_col, **index)
    best = F.min(F.struct((-F.col("n_cp")).alias("short"), F.col("doc_id").isNull().alias("blank"), "doc_id", "row"))
    of_rep = rows.groupBy("rep").agg(F.count("*").alias("n"), best.alias("best"))
    groups = of_rep.join(postings, "rep").groupBy(*_ENTRY).agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    named = postings.join(groups, _ENTRY).select(
        "rep", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("stays"), "sha", "chain"
    )
    return rows.select("doc_id", "row", "rep").join(named, "rep").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("stays")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "chain",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("chain")  # SQL has no XXH64 to tell chains by
