"""Phrases of words that stand together more often than their parts let expect, counted in counting quotient filters.

Blocks: a task cuts texts into pieces and words once and numbers the distinct words of a block. Words travel in runs, one
row for each block, language and hash; those of one hash meet in one group, where words that are frequent in their language
get ids. Each block is told the ids of its own words only, so no vocabulary is broadcast; other words end a piece, as no
frequent phrase holds them.

Filters: an n-gram's ids are packed into as many bits as they need (125 at most) and permuted invertibly, which spreads
them evenly. The leading bits, the quotient, name a run of the filter; all other bits stay as the remainder, so a filter
holds counts without loss. A task's filter is sorted by quotient and remainder; filters of all tasks are merged run by run,
where counters below the least count go and the permutation is undone.

Levels: bigrams are counted first, then trigrams whose bigrams are frequent, then longer ones whose trigrams are. What a
task knows of the level before is a bitmap of a fixed size; its false positives cost counters, which are exact anyway.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, slices, table

LEAST = 100
LONGEST = 5
TOP = 2000
LEVELS = ((2,), (3,), (4, 5))
#: Most bits of a word's id: five of them are packed into 125.
ID_BITS = 25
#: Words of a row of numbers; a block has twice as many distinct words and 64 such rows, about, at most.
BLOCK_WORDS = 1 << 17
BLOCK_ROWS = 64
#: Groups that words are dealt into by their hash.
WORD_RUNS = 1024
#: Counters that a task's filter holds before it is handed on, and places that are packed together.
FILTER_SIZE = 500_000
CHUNK_PLACES = 1 << 16
BITMAP_BITS = 24

SEPARATORS = re.compile(r"[.,;:!?\x0A-\x0D]")
_LOWER = {c: c + 32 for c in range(65, 91)}
_U = np.uint64
_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


# --- numbers as bytes ----------------------------------------------------------------------------------------


def planes(numbers: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, all lowest bytes first: the high bytes, mostly zero, then compress well."""
    return np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def squeeze(numbers: np.ndarray) -> bytes:
    import pyarrow as pa

    return len(numbers).to_bytes(8, "little") + pa.compress(planes(numbers), codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    import pyarrow as pa

    n = 4 * int.from_bytes(data[:8], "little")
    return from_planes(pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True))


# --- packing and permutation -------------------------------------------------------------------------------


def pack(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits from two to five arrays of ids; an absent id is zero."""
    a, b, c, d, e = (x.astype(_U) for x in [*ids, *[np.zeros(len(ids[0]), np.int64)] * (LONGEST - len(ids))])
    return (c >> _U(14)) | (d << _U(11)) | (e << _U(36)), a | (b << _U(25)) | ((c & _U(0x3FFF)) << _U(50))


def unpack(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A row of five ids for each pair of words."""
    low = _U((1 << ID_BITS) - 1)
    third = ((hi & _U(0x7FF)) << _U(14)) | (lo >> _U(50))
    return np.stack([lo & low, (lo >> _U(25)) & low, third, (hi >> _U(11)) & low, hi >> _U(36)], axis=1).astype(np.int64)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ _U(key)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def permute(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for k in _KEYS:
        hi, lo = lo, hi ^ _mix(lo, k)
    return hi, lo


def restore(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for k in reversed(_KEYS):
        hi, lo = lo ^ _mix(hi, k), hi
    return hi, lo


def _scatter(x: np.ndarray, width: int) -> np.ndarray:
    """An invertible permutation of numbers of ``width`` bits."""
    for k in _KEYS:
        x = (x * _U(k)) & _U((1 << width) - 1)
        x = x ^ (x >> _U((width + 1) // 2))
    return x


def _gather(x: np.ndarray, width: int) -> np.ndarray:
    for k in reversed(_KEYS):
        x = x ^ (x >> _U((width + 1) // 2))
        x = (x * _U(pow(k, -1, 1 << 64))) & _U((1 << width) - 1)
    return x


def to_keys(ids: list[np.ndarray], most: int, bits: int) -> tuple[np.ndarray, ...]:
    """Permuted keys of n-grams of up to ``most`` ids of ``bits`` bits: one word of 64 bits, its leading bits used, or two."""
    width = most * bits
    if width > 64:
        return permute(*pack(ids))
    x = np.zeros(len(ids[0]), _U)
    for k, a in enumerate(ids):
        x |= a.astype(_U) << _U(k * bits)
    return (_scatter(x, width) << _U(64 - width),)


def from_keys(key: tuple[np.ndarray, ...], most: int, bits: int) -> np.ndarray:
    width = most * bits
    if width > 64:
        return unpack(*restore(*key))
    x = _gather(key[0] >> _U(64 - width), width)
    return np.stack([(x >> _U(k * bits)) & _U((1 << bits) - 1) for k in range(most)], axis=1).astype(np.int64)


# --- filters -----------------------------------------------------------------------------------------------


#: One or two arrays of words of 64 bits, and the counts.
Filter = tuple[np.ndarray, ...]


def merged(parts: list[Filter]) -> Filter:
    """One sorted filter from several."""
    *key, n = (np.concatenate(c) for c in zip(*parts))
    if not len(n):
        return *key, n
    order = np.argsort(key[0], kind="stable")
    key, n = [k[order] for k in key], n[order]
    del order
    new = np.ones(len(n), bool)
    np.not_equal(key[0][1:], key[0][:-1], out=new[1:])
    if len(key) > 1 and (key[1][1:][~new[1:]] != key[1][:-1][~new[1:]]).any():  # two keys share 64 bits
        order = np.lexsort((key[1], key[0]))
        key, n = [k[order] for k in key], n[order]
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
    first = np.flatnonzero(new)
    return *(k[first] for k in key), np.add.reduceat(n, first)


def key_bytes_of(most: int, bits: int, quotient_bytes: int) -> int:
    """Bytes of a key that aren't always zero."""
    return 16 if most * bits > 64 else max(-(-most * bits // 8), quotient_bytes + 1)


def encode_runs(f: Filter, quotient_bytes: int, key_bytes: int = 16, more: int = 0) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """``(quotient, remainders, counts, large counts)`` of every run: remainders lack the quotient's bytes, and are
    compressed byte by byte, as the first ones of sorted remainders hardly change; a count is a byte, or 255 and then the
    next large count. ``more`` bits of the next byte are in the quotient, too."""
    import pyarrow as pa

    *key, n = f
    whole = np.stack(key, axis=1).astype(">u8").view(np.uint8).reshape(len(n), 8 * len(key))[:, quotient_bytes:key_bytes]
    quotient = key[0] >> _U(64 - 8 * quotient_bytes - more)
    small = np.minimum(n, 255).astype(np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], quotient[1:] != quotient[:-1]])) if len(n) else []
    for a, b in zip(starts, [*starts[1:], len(n)]):
        large = n[a:b][small[a:b] == 255].astype("<u8")
        remainders = pa.compress(whole[a:b].T.tobytes(), codec="zstd", asbytes=True)
        yield int(quotient[a]), remainders, small[a:b].tobytes(), large.tobytes()


def decode_run(
    quotient: int, remainders: bytes, counts: bytes, large: bytes, quotient_bytes: int, key_bytes: int = 16, more: int = 0
) -> Filter:
    import pyarrow as pa

    n = np.frombuffer(counts, np.uint8).astype(np.int64)
    rest = len(n) * (key_bytes - quotient_bytes)
    low = pa.decompress(remainders, decompressed_size=rest, codec="zstd", asbytes=True)
    n[n == 255] = np.frombuffer(large, "<u8").astype(np.int64)
    whole = np.zeros((len(n), 8 if key_bytes <= 8 else 16), np.uint8)
    whole[:, :quotient_bytes] = np.frombuffer((quotient >> more).to_bytes(quotient_bytes, "big"), np.uint8)
    whole[:, quotient_bytes:key_bytes] = np.frombuffer(low, np.uint8).reshape(key_bytes - quotient_bytes, len(n)).T
    both = whole.view(">u8").astype(_U)
    return *both.T, n


# --- blocks ------------------------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers of a language's words in a block, from 1; a new word gets the next one."""

    def __init__(self, lang: str, langs: list[str], words: list[str]):
        self.lang, self.langs, self.words = lang, langs, words

    def __missing__(self, word: str) -> int:
        self.langs.append(self.lang)
        self.words.append(word)
        k = self[word] = len(self.words)
        return k


def word_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows ``(block, seq, lang, words, n, numbers, counts)`` of a block's distinct words with the hash ``seq``, space-joined,
    their numbers and counts, ``n`` in all; and rows ``(block, seq, numbers)`` with the numbers of its texts in order, zero
    after each piece, whose other columns are null."""
    import pyarrow as pa

    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = pick(docs, text_col, lang_col).toDF("text", "lang").select(text.alias("text"), lang.alias("lang"))
    schema = pa.schema(
        [("block", pa.int64()), ("seq", pa.int32()), ("lang", pa.string()), ("words", pa.string())]
        + [("n", pa.int64()), ("numbers", pa.binary()), ("counts", pa.binary())]
    )

    def run(batches):
        from pyspark import TaskContext

        block, seq, ids, known = TaskContext.get().partitionId() << 33, 0, array("i"), {}
        langs, words, n = [], [], np.zeros(1, np.int64)

        def numbers():
            nonlocal seq, ids, n
            used = np.frombuffer(ids, np.int32)
            more = np.bincount(used, minlength=len(words) + 1)
            more[: len(n)] += n
            yield pa.RecordBatch.from_pylist([{"block": block, "seq": seq, "numbers": squeeze(used)}], schema)
            seq, ids, n = seq + 1, array("i"), more

        def runs():
            nonlocal block, seq, n
            place = {lang: k for k, lang in enumerate(known)}
            hashes = np.fromiter((crc32(w.encode()) % WORD_RUNS for w in words), np.int64, len(words))
            key = hashes * len(place) + np.fromiter((place[x] for x in langs), np.int64, len(langs))
            order = np.argsort(key, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
                c = n[mine + 1]
                yield {
                    "block": block, "seq": int(hashes[mine[0]]), "lang": langs[mine[0]], "words": " ".join(words[k] for k in mine),
                    "n": int(c.sum()), "numbers": planes(mine + 1), "counts": planes(c),
                }

        def out():
            nonlocal block, seq, n
            if ids:
                yield from numbers()
            found = list(runs())
            for at in range(0, len(found), 1000):
                yield pa.RecordBatch.from_pylist(found[at : at + 1000], schema)
            block, seq, n = block + 1, 0, np.zeros(1, np.int64)
            known.clear(), langs.clear(), words.clear()

        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for piece in SEPARATORS.split(text.translate(_LOWER).replace("\t", " ")):
                    mine = known.get(lang)
                    if mine is None:
                        mine = known[lang] = _Numbers(lang, langs, words)
                    ids.extend(map(mine.__getitem__, filter(None, piece.split(" "))))
                    ids.append(0)
                    if len(ids) >= block_words:
                        yield from numbers()
                        if len(words) >= 2 * block_words or seq >= BLOCK_ROWS:
                            yield from out()
        yield from out()

    return rows.mapInArrow(run, "block long, seq int, lang string, words string, n long, numbers binary, counts binary")


def frequent_words(blocks: DataFrame, least: int) -> DataFrame:
    """Rows ``(lang, word, f, id)`` of words that stand at least ``least`` times in their language, whose ``block`` is -1,
    and rows ``(block, seq, data)``: the numbers of such words in a block, then their places among those of hash ``seq``."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        seq, lists = int(pdf["seq"].iloc[0]), [w.split(" ") for w in pdf["words"]]
        ends = np.cumsum([len(x) for x in lists])
        of_word, distinct = pd.factorize(np.array(list(chain.from_iterable(lists)), object))
        of_lang, langs = pd.factorize(pdf["lang"].to_numpy(object))
        keys, at = np.unique(np.repeat(of_lang, np.diff(ends, prepend=0)) * len(distinct) + of_word, return_inverse=True)
        f = np.zeros(len(keys), np.int64)
        np.add.at(f, at, np.concatenate([from_planes(c) for c in pdf["counts"]]))
        place = np.where(f >= least, np.cumsum(f >= least), 0)
        rows = []
        for block, a, b, numbers in zip(pdf["block"], [0, *ends[:-1]], ends, pdf["numbers"]):
            mine = place[at[a:b]]
            if mine.any():
                rows.append((int(block), seq, planes(np.concatenate([from_planes(numbers)[mine > 0], mine[mine > 0]])), None, None, 0, 0))
        for k in np.flatnonzero(place):
            rows.append((-1, seq, None, langs[keys[k] // len(distinct)], distinct[keys[k] % len(distinct)], int(f[k]), _id(int(place[k]), seq)))
        return pd.DataFrame(rows, columns=["block", "seq", "data", "lang", "word", "f", "id"])

    rows = blocks.where("words is not null").select("block", "seq", "lang", "words", "numbers", "counts")
    return rows.groupBy("seq").applyInPandas(merge, "block long, seq int, data binary, lang string, word string, f long, id long")


def _id(place, seq: int):
    """The id of a hash's word, from its place, which begins at 1."""
    return (place - 1) * WORD_RUNS + seq + 1


def encoded_blocks(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``ids``: the blocks' texts as ids of frequent words, zero for any other word and after pieces."""
    import pyarrow as pa

    told = words.where("block >= 0").select("block", F.lit(0).alias("kind"), "seq", "data")
    texts = blocks.where("words is null").select("block", F.lit(1).alias("kind"), "seq", F.col("numbers").alias("data"))
    rows = told.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind", "seq")

    def run(batches):
        now, names = None, np.zeros(1, np.int64)
        for b in slices(batches):
            for block, kind, seq, data in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                if block != now:
                    now, names = block, np.zeros(1, np.int64)
                numbers = from_planes(data.as_py()) if kind == 0 else unsqueeze(data.as_py())
                mine, place = np.split(numbers, 2) if kind == 0 else (numbers, None)
                if (most := int(mine.max(initial=0))) >= len(names):
                    names = np.concatenate([names, np.zeros(max(most + 1 - len(names), len(names)), np.int64)])
                if kind == 0:
                    names[mine] = _id(place, seq)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([squeeze(names[mine])], pa.binary())], names=["ids"])

    return rows.mapInArrow(run, "ids binary")


# --- levels ------------------------------------------------------------------------------------------------


def _standing(ids: np.ndarray, before: int, bitmap: np.ndarray | None, bits: int) -> np.ndarray:
    """Whether a frequent phrase of ``before`` words may begin at each place."""
    n = len(ids) - before + 1
    if n <= 0:
        return np.zeros(0, bool)
    fine = np.ones(n, bool)
    for k in range(before):
        fine &= ids[k : k + n] > 0
    if bitmap is not None:
        at = np.flatnonzero(fine)
        slot = to_keys([ids[k:][at] for k in range(before)], before, bits)[0] >> _U(64 - BITMAP_BITS)
        fine[at] = (bitmap[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1
    return fine


def count_level(
    encoded: DataFrame, lengths: tuple[int, ...], least: int, bitmap: bytes | None, quotient_bits: int, bits: int
) -> DataFrame:
    """``(ids, f, slot)`` of the phrases of these lengths that stand at least ``least`` times; ``slot`` is their bit, and
    ``bits`` are those of an id."""
    import pyarrow as pa

    before, most = min(lengths) - 1, max(lengths)
    quotient_bytes, more = divmod(quotient_bits, 8)
    key_bytes = key_bytes_of(most, bits, quotient_bytes)
    names = ["quotient", "remainders", "counts", "large"]

    def count(batches):
        seen = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        held, waiting, n_waiting = None, [], 0

        def batch(f):
            runs = list(encode_runs(f, quotient_bytes, key_bytes, more))
            for at in range(0, len(runs), 1000):
                columns = zip(*runs[at : at + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.binary()] * 3))], names=names)

        for b in slices(batches, 1):
            whole = unsqueeze(b.column(0)[0].as_py())
            for start in range(0, len(whole), CHUNK_PLACES):
                ids = whole[start : start + CHUNK_PLACES + most - 1]
                standing = _standing(ids, before, seen, bits)
                for n in lengths:
                    places = min(len(ids) - n + 1, CHUNK_PLACES)
                    if places <= 0:
                        continue
                    fine = np.ones(places, bool)
                    for k in range(n - before + 1):
                        fine &= standing[k : k + places]
                    at = np.flatnonzero(fine)
                    waiting.append((*to_keys([ids[k:][at] for k in range(n)], most, bits), np.ones(len(at), np.int64)))
                    n_waiting += len(at)
                if n_waiting > FILTER_SIZE:
                    waiting = [merged([*([held] if held else []), *waiting])]
                    held, n_waiting = waiting.pop(), 0
                    if len(held[0]) > FILTER_SIZE:
                        yield from batch(held)
                        held = None
        if held or waiting:
            yield from batch(merged([*([held] if held else []), *waiting]))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = zip(pdf.quotient, pdf.remainders, pdf.counts, pdf.large)
        *key, n = merged([decode_run(int(q), r, c, big, quotient_bytes, key_bytes, more) for q, r, c, big in runs])
        key, n = [k[n >= least] for k in key], n[n >= least]
        ids = from_keys(key, most, bits)
        words = [row[row > 0].tolist() for row in ids]
        return pd.DataFrame({"ids": pd.Series(words, dtype=object), "f": n, "slot": (key[0] >> _U(64 - BITMAP_BITS)).astype(np.int64)})

    runs = encoded.mapInArrow(count, "quotient long, remainders binary, counts binary, large binary")
    return runs.groupBy("quotient").applyInPandas(merge, "ids array<int>, f long, slot long")


def _bitmap(grams: DataFrame) -> bytes:
    """The bits of the grams' slots: 2 ** BITMAP_BITS of them, however many grams there are."""
    bits = F.bitmap_construct_agg(F.col("slot") % 32768)
    found = grams.groupBy(F.floor(F.col("slot") / 32768).alias("bucket")).agg(bits.alias("bits")).collect()
    out = bytearray(1 << (BITMAP_BITS - 3))
    for r in found:
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = r.bits
    return bytes(out)


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
    block_words: int = BLOCK_WORDS, quotient_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(grams, vocabulary, totals)``: ``(ids, f)`` of all words and phrases of up to five words that stand at least
    ``least`` times in their language, ``(id, lang, word)``, and ``(lang, n)`` with all word occurrences."""
    blocks = materialize(word_blocks(docs, text_col, lang_col, block_words), "word-blocks")
    words = materialize(frequent_words(blocks, least), "words")
    totals = blocks.where("words is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = words.where("block < 0").select(F.col("id").cast("int").alias("id"), "lang", "word", "f")
    bits = max(1, (words.agg(F.max("id")).first()[0] or 0).bit_length())
    n_all = totals.agg(F.sum("n")).first()[0] or 0
    if bits > ID_BITS:
        raise ValueError("more frequent words than ids")
    if quotient_bytes is None:  # so many runs that one holds about a million counters at most
        quotient_bits = min(32, max(8, (n_all >> 20).bit_length()))
    else:
        quotient_bits = 8 * quotient_bytes
    encoded = materialize(encoded_blocks(blocks, words), "encoded")
    grams, bitmap = vocabulary.select(F.array("id").alias("ids"), "f"), None
    for lengths in LEVELS:
        level = materialize(count_level(encoded, lengths, least, bitmap, quotient_bits, bits), "grams")
        grams = grams.unionByName(level.select("ids", "f"))
        bitmap = _bitmap(level) if lengths != LEVELS[-1] else None
    return grams, vocabulary.select("id", "lang", "word"), totals


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, **how
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of two to five words.

    Words are lower-cased (A-Z only) and don't join across ``[.,;:!?\\x0A-\\x0D]``. ``a`` counts the phrase, ``l`` and
    ``r`` the parts of its weakest cut, ``n`` all words of the language; the score is ``floor(1000 * a * n / (l * r))``
    in decimals of 38 digits. Phrases inside a longer one as frequent are left out. A null text is empty, a null
    language ``und``; very long texts are cut between pieces into several blocks; repeated rows count each time; an
    empty table gives no rows.
    """
    grams, vocabulary, totals = frequent_phrases(docs, text_col, lang_col, least, **how)
    phrases = grams.where(F.size("ids") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    phrases = phrases.select(
        "ids", F.col("f").alias("a"), "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"),
    )
    cuts = phrases.join(grams.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(grams.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    spelled = grams.where(F.size("ids") > 1).select("ids", F.posexplode("ids").alias("place", "id")).join(vocabulary, "id")
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"])
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(words, " ").alias("phrase"))
    spelled = materialize(spelled.join(totals, "lang"), "phrases")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.join(spelled, "ids").withColumns({c: whole(c) for c in ("a", "l", "r", "n")})
    scored = scored.withColumn("score", F.expr("CAST(1000 AS DECIMAL(4,0)) * a * n div (l * r)"))
    best = scored.groupBy("ids", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("ids") - m + 1), lambda at: F.slice("ids", at, m))))
    longer = grams.where(F.size("ids") > 2).select("f", F.explode(F.array_distinct(inside)).alias("ids"))
    longer = longer.groupBy("ids").agg(F.max("f").alias("longer"))
    left = best.join(longer, "ids", "left").where("longer is null or 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = left.select("lang", "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "n")), "cut.score", *(F.col(f"cut.{c}").cast("long").alias(c) for c in ("l", "r")))
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
