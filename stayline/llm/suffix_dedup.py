"""Bytes that repeat from earlier documents, found through suffix arrays.

Anchors: a window of 50 bytes is named by the smallest hash of its 24-byte grams, so equal windows have equal names,
wherever they stand. Neighbouring windows of one name make a context: a stretch of text with up to 64 window starts.
A first pass over the texts sends 48 bits of each name, packed, to find those that two documents share; only their
contexts are listed, in a second pass. Where a name has one context text, all its windows are equal to those of its
first document; nothing needs to be ordered. A third pass writes the contexts of all other names out.

Rows with the whole text of a smaller id are told by two hashes and the length, and go no further.

Suffix arrays: the contexts of the other names, in the order of their names, are dealt to tasks by range and put
together in blocks. Pieces are the runs of windows whose two halves both stand in another context of the name. A block's
distinct pieces share a suffix array, which is built by grouping: suffixes begin in groups of their first byte; groups
are taken in descending order, and each hands its suffixes' previous-smaller places on into larger groups right above
their own, until a group holds the suffixes of one Lyndon prefix; groups then emit their suffixes in the order of what
follows the prefix. Equal windows are neighbours there, and tell the verdicts of all names that lie in one block.
What a block leaves untold of its first and last name, which other blocks may hold as well, meets once more by its bytes.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, release, slices, spread_join, table, text_or_empty, written_here

WIDTH = 50
GRAM = 24
#: Window starts of a context: the bits of a long.
STARTS = 64
#: Bytes of texts that are hashed together, and of contexts that share a suffix array.
BATCH_BYTES = 1 << 17
BLOCK_BYTES = 1 << 20
#: Bytes of texts whose names are packed together, and names of one range.
PACK_BYTES = 8 << 20
RANGE_NAMES = 1 << 20
#: Bits of the map of shared names that tasks hold, whatever the number of names.
MAP_BITS = 27


# --- suffix array ------------------------------------------------------------------------------------------


def lyndon_groups(s: list[int]) -> tuple[list[list[int]], list[int]]:
    """Suffixes grouped by their longest Lyndon prefix, smallest group first, and each one's previous smaller suffix.

    ``s`` ends with a unique smallest value. Places of a group ascend, and so do the previous smaller places that a
    group finds, so new groups ascend as well. A step from place to place climbs the tree of previous smaller suffixes
    over subtrees that end right before a suffix, so each edge is climbed once.
    """
    symbols = sorted(set(s))
    number = {c: k for k, c in enumerate(symbols)}
    group = [number[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = [k - 1 for k in range(len(symbols))]
    above = [*range(1, len(symbols)), -1]
    previous, done = [-1] * len(s), bytearray(len(s))
    out, g = [], len(symbols) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        parents, times, last = [], [], -1
        for i in mine:
            j = i - 1
            while j >= 0 and done[j]:
                j = previous[j]
            previous[i] = j
            done[i] = 1
            if j < 0:
                continue
            if j == last:
                times[-1] += 1
            else:
                parents.append(j)
                times.append(1)
                last = j
        level = 1
        while parents:
            fresh: dict[int, int] = {}
            for p in parents:
                old = group[p]
                new = fresh.get(old)
                if new is None:  # right above the old group
                    new = fresh[old] = len(members)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                group[p] = new
                members[new].append(p)
            level += 1
            rest = [(p, t) for p, t in zip(parents, times) if t >= level]
            parents, times = [p for p, _ in rest], [t for _, t in rest]
        if mine:
            out.append(mine)
        members[g] = []
        g = below[g]
    out.reverse()
    return out, previous


def suffix_array(s: list[int]) -> list[int]:
    """Places of all suffixes in ascending order; ``s`` ends with a unique smallest value."""
    groups, previous = lyndon_groups(s)
    free, of, at = [], [0] * len(s), 0
    for k, mine in enumerate(groups):
        free.append(at)
        at += len(mine)
        for i in mine:
            of[i] = k
    order = [0] * len(s)
    order[0] = len(s) - 1
    for i in order:  # filled while it is read: a suffix stands above its next smaller one
        stop, j = previous[i], i - 1
        while j != stop:
            k = of[j]
            order[free[k]] = j
            free[k] += 1
            j = previous[j]
    return order


# --- anchors -----------------------------------------------------------------------------------------------


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes at each place."""
    u = np.uint64
    x = b.astype(u)
    x = x[:-1] | (x[1:] << u(8))
    x = x[:-2] | (x[2:] << u(16))
    x = x[:-4] | (x[4:] << u(32))
    n = len(b) - GRAM + 1
    h = x[:n] * u(0x9E3779B97F4A7C15)
    h ^= h >> u(32)
    for at, key, shift in ((8, 0xC2B2AE3D27D4EB4F, 29), (16, 0x94D049BB133111EB, 32)):
        h += x[at : at + n]
        h *= u(key)
        h ^= h >> u(shift)
    return h * u(0xBF58476D1CE4E5B9)


def contexts_of(b: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, lo, n, name)``: runs of at most 64 window starts of one name in the texts that stand at ``first``."""
    if len(b) < WIDTH:
        return (np.zeros(0, np.int64),) * 4
    v = _gram_hashes(b)
    span = WIDTH - GRAM + 1
    for step in (1, 2, 4, 8):
        v = np.minimum(v[:-step], v[step:])
    v = np.minimum(v[: len(b) - WIDTH + 1], v[span - 16 : span - 16 + len(b) - WIDTH + 1])
    whole = size >= WIDTH
    turns = np.zeros(len(b) + 1, np.int8)
    turns[first[whole]] += 1
    turns[(first + size - WIDTH + 1)[whole]] -= 1
    # a text of any windows ends with places that begin none, so no run leaves its text
    fine = np.concatenate([[False], np.cumsum(turns[: len(v)], dtype=np.int8) > 0, [False]])
    same = fine[1:-2] & fine[2:-1] & (v[1:] == v[:-1])
    fine = fine[1:-1]
    at = np.flatnonzero(fine & ~np.concatenate([[False], same]))
    n = np.flatnonzero(fine & ~np.concatenate([same, [False]])) + 1 - at
    if len(n) and n.max() > STARTS:
        parts = (n + STARTS - 1) // STARTS
        turn = np.cumsum(parts) - parts
        done = STARTS * (np.arange(parts.sum()) - np.repeat(turn, parts))
        at, n = np.repeat(at, parts) + done, np.minimum(np.repeat(n, parts) - done, STARTS)
    return np.searchsorted(first, at, side="right") - 1, at, n, v[at].view(np.int64)


def _slots(name: np.ndarray) -> np.ndarray:
    """48 bits of each name, spread evenly (names are smallest hashes, so their high bits are not)."""
    return (name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)


def _together(batches):
    """``(columns of values, bytes, first, size)`` of texts, the last column of each batch, that are hashed together."""
    held, rows = 0, []
    for b in slices(batches):
        for r in zip(*(c.to_pylist() for c in b.columns)):
            rows.append(r)
            held += len(r[-1])
            if held >= BATCH_BYTES:
                yield _laid_out(rows)
                held, rows = 0, []
    if rows:
        yield _laid_out(rows)


def _laid_out(rows):
    *columns, texts = zip(*rows)
    size = np.array([len(t) for t in texts], np.int64)
    # places of empty texts equal those of the next text, which searchsorted takes
    return columns, b"".join(texts), np.cumsum(size) - size, size


def shared_slots(docs: DataFrame) -> DataFrame:
    """``slot`` of the names that stand in two rows of ``(..., text)`` at least, each once.

    A task sends sorted slots by range, six bytes each: those that it has seen in one row, and those in several.
    """
    import pyarrow as pa

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(6, (total // (15 * RANGE_NAMES)).bit_length()))
    names = ["range", "once", "more"]

    def packed(slots, owners):
        slot, owner = np.concatenate(slots), np.concatenate(owners)
        order = np.argsort(slot, kind="stable")  # rows ascend within a slot
        slot, owner = slot[order], owner[order]
        edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        more = owner[edge] != owner[np.concatenate([edge[1:], [len(slot)]]) - 1]
        slot = slot[edge]
        of = (slot >> np.uint64(48 - bits)).astype(np.int64)
        ranges = np.unique(of)
        parts = []
        for chosen in (~more, more):
            raw = np.ascontiguousarray(slot[chosen].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
            left, right = (6 * np.searchsorted(of[chosen], ranges, side=side) for side in ("left", "right"))
            parts.append(pa.array([raw[x:y] for x, y in zip(left.tolist(), right.tolist())], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *parts], names=names)

    def run(batches):
        slots, owners, base, held = [], [], 0, 0
        for _, raw, first, size in _together(batches):
            owner, _, _, name = contexts_of(np.frombuffer(raw, np.uint8), first, size)
            if len(name):
                slots.append(_slots(name))
                owners.append(owner + base)
            base += len(size)
            held += len(raw)
            if held >= PACK_BYTES and slots:
                yield packed(slots, owners)
                slots, owners, held = [], [], 0
        if slots:
            yield packed(slots, owners)

    def unpacked(values):
        six = np.frombuffer(b"".join(values), np.uint8).reshape(-1, 6)
        out = np.zeros((len(six), 8), np.uint8)
        out[:, :6] = six
        return out.view("<u8").ravel()

    def merged(pdf):
        import pandas as pd

        once = np.sort(unpacked(pdf.once))
        again = once[1:][once[1:] == once[:-1]]
        more = unpacked(pdf.more)
        return pd.DataFrame({"slot": np.unique(np.concatenate([again, more, once[np.isin(once, more)]])).astype(np.int64)})

    return docs.select("text").mapInArrow(run, "range int, once binary, more binary").groupBy("range").applyInPandas(merged, "slot long")


#: Where a slot's two bits in the map come from.
PROBES = (0, 21)


def _map_of(shared: DataFrame):
    """A broadcast Bloom filter of the low 48 bits of ``slot`` with a fixed number of bits."""
    both = F.explode(F.array(*(F.shiftright("slot", k).bitwiseAND((1 << MAP_BITS) - 1) for k in PROBES)))
    found = shared.select(both.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("bucket"))
    found = found.agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()  # 2 ** (MAP_BITS - 15) rows at most
    bits = bytearray(1 << (MAP_BITS - 3))
    for r in found:
        bits[r.bucket * 4096 : (r.bucket + 1) * 4096] = r.bits
    return shared.sparkSession.sparkContext.broadcast(bytes(bits))


def _in_map(known: np.ndarray, slot: np.ndarray) -> np.ndarray:
    hit = np.ones(len(slot), bool)
    for k in PROBES:
        at = ((slot >> np.uint64(k)) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
        hit &= (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def context_rows(docs: DataFrame, held) -> DataFrame:
    """``(name, body, doc_id, digest, lo, n)`` of the contexts of ``(doc_id, digest, text)`` whose name the map ``held`` has
    (its few false positives are told later); ``body`` hashes the bytes."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["name", "body", "doc_id", "digest", "lo", "n"]

    def run(batches):
        from itertools import chain

        from xxhash import xxh3_64_intdigest

        batches = iter(batches)
        start = next(batches, None)
        if start is None:
            return
        of, known = start.column(0).type, np.frombuffer(held.value, np.uint8)
        for (ids, digests), raw, first, size in _together(chain([start], batches)):
            owner, at, n, name = contexts_of(np.frombuffer(raw, np.uint8), first, size)
            hit = _in_map(known, _slots(name))
            owner, at, n, name = (x[hit] for x in (owner, at, n, name))
            body = np.fromiter((xxh3_64_intdigest(raw[a : a + k + WIDTH - 1]) for a, k in zip(at.tolist(), n.tolist())), np.uint64, len(at))
            take = pa.array(owner)
            columns = [pa.array(name, pa.int64()), pa.array(body.view(np.int64)), pa.array(ids, of).take(take), pa.array(digests, pa.int64()).take(take)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at - first[owner], pa.int32()), pa.array(n, pa.int32())], names=names)

    return docs.select("doc_id", "digest", "text").mapInArrow(run, f"name long, body long, doc_id {kind}, digest long, lo int, n int")


def context_texts(docs: DataFrame, held) -> DataFrame:
    """``(name, doc_id, digest, lo, context)`` of the contexts of ``(doc_id, digest, text)`` whose name the map ``held`` has.

    Of equal contexts that stand near each other in a task's rows, those of the smallest doc_id are written.
    """
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["name", "doc_id", "digest", "lo", "context"]

    def run(batches):
        from itertools import chain

        batches = iter(batches)
        start = next(batches, None)
        if start is None:
            return
        kinds = (pa.int64(), start.column(0).type, pa.int64(), pa.int32(), pa.binary())
        known, least, seen = np.frombuffer(held.value, np.uint8), {}, 0

        def out():
            rows = ((*r, context) for context, places in least.items() for r in places)
            for part in iter(lambda: list(islice(rows, 10_000)), []):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)
            least.clear()

        for (ids, digests), raw, first, size in _together(chain([start], batches)):
            owner, at, n, name = contexts_of(np.frombuffer(raw, np.uint8), first, size)
            hit = _in_map(known, name.view(np.uint64))
            owner, at, n, name = (x[hit] for x in (owner, at, n, name))
            for o, a, k, m, lo in zip(owner.tolist(), at.tolist(), n.tolist(), name.tolist(), (at - first[owner]).tolist()):
                context, i = raw[a : a + k + WIDTH - 1], ids[o]
                places = least.get(context)
                if places is None or i < places[0][1]:
                    least[context] = [(m, i, digests[o], lo)]
                elif i == places[0][1]:
                    places.append((m, i, digests[o], lo))
            seen += len(raw)
            if seen >= PACK_BYTES:
                yield from out()
                seen = 0
        yield from out()

    return docs.select("doc_id", "digest", "text").mapInArrow(run, f"name long, doc_id {kind}, digest long, lo int, context binary")


# --- equal windows -----------------------------------------------------------------------------------------


def shared_pieces(contexts: list[bytes], names: list[int]) -> list[tuple[int, int, int]]:
    """``(context, lo, hi)``: runs of window starts that may stand in another context of the same name, since both
    halves of each window do (by their hashes, whose chance matches are told by the bytes later)."""
    half = WIDTH // 2
    b = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    first = np.cumsum(size) - size
    g = _gram_hashes(b)
    v = (g[:-1] ^ (g[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + g[1:]
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(b)) - first[owner]
    at = np.flatnonzero(inside <= (size - half)[owner])
    key = v[at] ^ (np.array(names, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[owner[at]]
    order = np.argsort(key, kind="stable")  # contexts ascend within a key
    key, at = key[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff([*edge, len(at)])
    several = owner[at[edge]] != owner[at[edge + count - 1]]
    fine = np.zeros(len(b) + 1, bool)
    fine[at[np.repeat(several, count)]] = True
    start = np.zeros(len(b) + 2, bool)
    start[1 : len(b) - half + 1] = fine[: len(b) - half] & fine[half : len(b)]
    start[1:-1] &= inside <= (size - WIDTH)[owner]
    turn = np.flatnonzero(start[1:] != start[:-1])  # contexts are longer than their starts, so no run leaves its context
    of = owner[turn[::2]]
    return list(zip(of.tolist(), (turn[::2] - first[of]).tolist(), (turn[1::2] - first[of]).tolist()))


def equal_windows(contexts: list[bytes]) -> list[list[tuple[int, int]]]:
    """The ``(context, start)`` of equal windows, for every window that stands in two contexts at least."""
    s: list[int] = []
    owner, start = [], []
    for k, c in enumerate(contexts):
        s += [x + 2 for x in c]
        s.append(1)
        n = len(c) - WIDTH + 1
        owner += [k] * n + [-1] * (len(c) - n + 1)
        start += [*range(len(c)), 0]
    s.append(0)
    owner, start = np.array([*owner, -1]), np.array([*start, 0])
    order = np.array(suffix_array(s))
    order = order[owner[order] >= 0]
    if not len(order):
        return []
    text = np.array(s, np.int16)
    same = np.ones(len(order) - 1, bool)
    for k in range(WIDTH):
        here = text[order + k]
        same &= here[1:] == here[:-1]
    edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    groups = (order[a:b] for a, b in zip(edges[:-1], edges[1:]) if b - a > 1)
    pairs = ([(int(owner[i]), int(start[i])) for i in g] for g in groups)
    return [g for g in pairs if len({k for k, _ in g}) > 1]


def repeated_windows(rows: list[tuple]) -> dict[int, int]:
    """The starts, as bits, of the windows of each ``(name, doc_id, context)`` that a smaller doc_id has too.

    Equal pieces of one name are ordered once, and only where the name has other pieces.
    """
    standing: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for k, lo, hi in shared_pieces([r[2] for r in rows], [r[0] for r in rows]):
        standing.setdefault((rows[k][0], rows[k][2][lo : hi + WIDTH - 1]), []).append((k, lo))
    pieces, of_name = list(standing), Counter(name for name, _ in standing)
    first = {piece: min(rows[k][1] for k, _ in places) for piece, places in standing.items()}
    masks: dict[int, int] = {}

    def tell(piece, starts, least):
        for k, lo in standing[piece]:
            if rows[k][1] > least:
                masks[k] = masks.get(k, 0) | starts << lo

    for piece in pieces:
        tell(piece, (1 << len(piece[1]) - WIDTH + 1) - 1, first[piece])
    ordered = [p for p in pieces if of_name[p[0]] > 1]
    for g in equal_windows([p[1] for p in ordered]) if ordered else ():
        least = min(first[ordered[k]] for k, _ in g)
        for k, p in g:
            tell(ordered[k], 1 << p, least)
    return masks


def window_members(contexts: DataFrame) -> DataFrame:
    """Verdicts and open windows of ``(name, doc_id, digest, lo, context)``.

    Verdicts are ``(doc_id, digest, lo, n, mask)`` of contexts with windows that a smaller doc_id has too, where that
    doc_id lacks the whole context. Open windows, ``(window, doc_id, digest, lo, n, start)``, are those of the first and
    the last name of a block, whose other contexts may lie in other blocks: only the smallest doc_id of the block with
    that window, as the others are told.
    """
    import pyarrow as pa

    kind = contexts.schema["doc_id"].dataType.simpleString()
    names = ["window", "doc_id", "digest", "lo", "n", "start", "mask"]

    def block(rows, of):
        ends = {rows[0][0], rows[-1][0]}
        count = lambda r: len(r[2]) - WIDTH + 1
        out, masks = [], repeated_windows(rows)
        for k, m in masks.items():
            r = rows[k]  # the 64th start is a long's sign
            out += [(None, r[1], *place, count(r), None, m - (1 << 64) if m >> 63 else m) for place in r[3]]
        out += [
            (r[2][p : p + WIDTH], r[1], *place, count(r), p, None)
            for k, r in enumerate(rows) if r[0] in ends for p in range(count(r)) if not masks.get(k, 0) >> p & 1 for place in r[3]
        ]
        kinds = [pa.binary(), of, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for at in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 100_000]), kinds)], names=names)

    def run(batches):
        rows, held = [], 0
        for b in slices(batches):
            for name, i, digest, lo, context in zip(*(b.column(k).to_pylist() for k in range(5))):
                if rows and rows[-1][2] == context:
                    if rows[-1][1] == i:  # the smallest doc_id, which comes first
                        rows[-1][3].append((digest, lo))
                    continue
                if held >= BLOCK_BYTES:
                    yield from block(rows, b.column(1).type)
                    rows, held = [], 0
                rows.append((name, i, context, [(digest, lo)]))
                held += len(context)
        if rows:
            yield from block(rows, b.column(1).type)

    ranged = contexts.repartitionByRange("name", "context").sortWithinPartitions("name", "context", "doc_id")
    return ranged.mapInArrow(run, f"window binary, doc_id {kind}, digest long, lo int, n int, start int, mask long")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, lo, n, mask)``: contexts of ``(doc_id, digest, text)`` with windows that a smaller doc_id
    has too: all of them where ``mask`` is null, else those of its bits."""
    spark, place = docs.sparkSession, ["doc_id", "digest", "lo", "n"]
    hits = materialize(context_rows(docs, _map_of(materialize(shared_slots(docs), "shared-names"))), "shared-contexts")
    known = hits.groupBy("name", "body").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("high"))
    known = materialize(known, "context-texts")
    of_name = known.groupBy("name").agg(F.count("*").alias("c"), F.min("owner").alias("low"), F.max("high").alias("high"))
    many = of_name.where("c > 1 and low < high").select(F.col("name").alias("slot"))
    with written_here() as folders:
        texts = materialize(context_texts(docs, _map_of(many)), "ordered-contexts")
    members = materialize(window_members(texts), "equal-windows")
    release(spark, folders)
    meeting = members.where("window is not null")
    first = meeting.groupBy("window").agg(F.min("doc_id").alias("first"))
    earlier = meeting.join(first, "window").where(F.col("first") < F.col("doc_id"))
    bits = earlier.groupBy(*place).agg(F.bit_or(F.expr("shiftleft(1L, start)")).alias("mask"))
    owners = known.where("owner < high").drop("high")
    whole = hits.join(owners, ["name", "body"]).where(F.col("doc_id") > F.col("owner"))
    whole = whole.select(*place, F.lit(None).cast("long").alias("mask"))
    return whole.union(members.where("window is null").select(*place, "mask")).union(bits)


def _copies(rows: DataFrame) -> DataFrame:
    """``(doc_id, digest, size)`` of the texts that a smaller doc_id has as well: all their windows repeat."""
    told = rows.select("doc_id", "digest", F.xxhash64(F.lit(1), "text").alias("second"), F.octet_length("text").alias("size"))
    told = materialize(told, "text-digests")
    key = ["digest", "second", "size"]
    owners = told.groupBy(*key).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    return spread_join(told, key, owners).where(F.col("doc_id") > F.col("owner")).select("doc_id", "digest", "size").distinct()


def _spans(size: int, starts: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the repeated windows cover."""
    turns = np.zeros(size + 1, np.int64)
    for c in starts:
        lo, n, mask = c["lo"], c["n"], c["mask"]
        places = np.arange(lo, lo + n) if mask is None else np.array([lo + k for k in range(n) if mask >> k & 1], np.int64)
        np.add.at(turns, places, 1)
        np.add.at(turns, places + WIDTH, -1)
    covered = np.concatenate([[0], np.cumsum(turns[:-1]) > 0, [0]]).astype(np.int8)
    edge = np.diff(covered)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: the bytes left of each row's text, and the runs that were removed.

    A byte goes where a string of 50 bytes over it also starts in a row with a smaller id. Null texts are empty, and
    texts under 50 bytes stay whole; a removed run may cut a character, so ``kept`` is binary. Rows of one id take
    nothing from each other; a null id is neither smaller nor larger than any, so such rows stay whole. Very long texts
    are hashed alone. Repeated rows have equal results, and an empty table gives none.
    """
    import pyarrow as pa

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    copies = materialize(_copies(rows.where(F.col("doc_id").isNotNull())), "text-copies")
    rest = rows.where(F.col("doc_id").isNotNull()).join(copies, ["doc_id", "digest"], "left_anti")
    starts = repeated_starts(rest).union(copies.where(F.col("size") >= WIDTH).select("doc_id", "digest", F.lit(0), (F.col("size") - WIDTH + 1).cast("int"), F.lit(None)))
    starts = starts.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("lo", "n", "mask")).alias("starts"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in slices(batches, 100):
            spans, kept, sizes = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone = _spans(len(text), found) if found else []
                edges = [0, *(e for s in gone for e in s), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
                spans.append([{"start": x, "end": y} for x, y in gone])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=names
            )

    joined = rows.join(starts, ["doc_id", "digest"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
