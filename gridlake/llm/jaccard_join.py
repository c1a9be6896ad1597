"""N-gram Jaccard join by PartEnum signatures.

Two sets of sizes a and b whose Jaccard similarity reaches 3/4 differ in at most (a + b) / 7 features. Sets of
similar size share a size band; the band cuts the feature domain into partitions by hash, and each partition into SECOND
smaller ones. Of two sets that differ in h features, one of any h / 2 + 1 partitions differs in at most one of its smaller
ones, so that the content of the other SECOND - 1 is the same: each set enumerates, partition by partition, all
subsets of SECOND - 1 smaller ones, and their content is the signature.
Sets that cannot fill so many partitions, and sets under SMALL features, enumerate single features instead: the
first floor(a / 4) + 1 in hash order, of which two similar sets share one.

Every candidate pair is verified on the whole sets. Equal sets are one class throughout, so copies cost nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import apart, components, discard, release, shared_folder, table

NGRAM = 5
SMALL, SECOND = 12, 2
#: Sampled shingles for each set of the first pass: from SAMPLE to twice as many.
SAMPLE = 48
#: Buckets a feature of a bitmap, and its bytes at most.
WIDE, BITMAP_BYTES = 4, 4096
#: Size from which a component is compared as a whole.
LARGE = 16
#: Members of a group, and features of their sets, that one task compares with the rest of the group.
BLOCK, BLOCK_FEATURES = 2000, 2_000_000
#: Rows of four numbers that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Instead of a distance: a group to look at again; a pair of a group that gives all of its pairs.
AGAIN, ALL = -1, -2
#: Pairs a member, of 16 bytes each, that a group names at most, rather than have its members' bitmaps moved again; pairs that a task holds.
NAMED, HELD = 16, 500_000
#: Words of bitmaps that are compared at once.
AT_ONCE = 1 << 20


def shingle_sets(t: tk.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-word shingles of each text, in order; a text of fewer words is one shingle."""
    words, first = t.word_hashes(), t.words[2]
    _, text, h = tk.window_hashes(words, first, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        pre = tk.prefix(words, tk._STEP)
        text = np.concatenate([text, short])
        h = np.concatenate([h, tk.span_hash(pre, first[short], first[short + 1], tk._STEP)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def set_key(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return tk.mix(sums + n.astype(np.uint64) * tk.U64(0x9E3779B97F4A7C15)).view(np.int64)


def _sums(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate([[tk.U64(0)], np.cumsum(tk.mix(h ^ tk.U64(0xA5A5A5A5A5A5A5A5)))])
    edge = np.searchsorted(text, np.arange(n + 1))
    return np.diff(edge), total[edge[1:]] - total[edge[:-1]]


def sampled(n: np.ndarray) -> np.ndarray:
    """The hash bits that a sampled shingle of a set of n has zero: 0 up to 2 * SAMPLE."""
    return np.maximum(np.floor(np.log2(np.maximum(n, 1) / SAMPLE)), 0).astype(np.int64)


def _interval(h: np.ndarray, j: int, most: int) -> tuple[np.ndarray, bool]:
    """Signatures of a set in the interval of two size bands j and j + 1, and whether it fills as many partitions as they need."""
    need = most // 2 + 1
    parts = int(np.ceil(1.2 * (SMALL * (4 / 3) ** j * 2 / 9 + 1))) + 2
    x = tk.mix(h ^ tk.U64(j + 1))
    cell = (x % tk.U64(parts)).astype(np.int64) * SECOND + ((x >> tk.U64(40)) % tk.U64(SECOND)).astype(np.int64)
    total = np.zeros(parts * SECOND, np.uint64)
    np.add.at(total, cell, tk.mix(h))
    total, held = total.reshape(parts, SECOND), np.bincount(cell, minlength=parts * SECOND).reshape(parts, SECOND) > 0
    filled = np.cumsum(held.sum(axis=1) > 1)
    last = int(np.searchsorted(filled, need)) + 1  # all partitions up to the one that makes them enough
    content = (total.sum(axis=1, dtype=np.uint64)[:, None] - total)[:last]
    name = (np.arange(parts * SECOND).reshape(parts, SECOND) + (j + 1 << 32)).astype(np.uint64)[:last]
    some = (held.sum(axis=1)[:, None] - held)[:last] > 0
    return tk.mix(content[some] ^ tk.mix(name[some])), filled[-1] >= need


def signatures(h: np.ndarray) -> np.ndarray:
    """The signatures of one set. Its partners have sizes of its own band of a third or the next one up, met in one interval, or of
    the band below, met in the interval below."""
    n, out, first = len(h), [], len(h) < SMALL * 4 // 3
    if n >= SMALL:
        j = int(np.log(n / SMALL) / np.log(4 / 3) + 1e-9)
        sign, filled = _interval(h, j, (n + n * 4 // 3) // 7)
        out, first = [sign], first | (not filled)
        if j:
            sign, filled = _interval(h, j - 1, (n + int(np.ceil(SMALL * (4 / 3) ** j))) // 7)
            out, first = [*out, sign], first | (not filled)
    if first:
        out.append(tk.mix(np.sort(tk.mix(h))[: n // 4 + 1] ^ tk.U64(0x5555)))
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _keys(df: DataFrame, ngram: int) -> DataFrame:
    """Of (id, th, text): (id, th, n, key, sample) with the sampled shingles of the set, once for each distinct set of a batch."""

    def run(batches):
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(2), lower=True):
                text, h = shingle_sets(t, ngram)
                n, sums = _sums(text, h, t.n)
                key = set_key(sums, n)
                first = np.zeros(t.n, bool)
                first[np.unique(key, return_index=True)[1]] = True
                mask = (tk.U64(1) << sampled(n).astype(np.uint64)) - tk.U64(1)
                keep = first[text] & (tk.mix(h) & mask[text] == 0)
                edge = np.append(0, np.cumsum(np.bincount(text[keep], minlength=t.n)))
                sample = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(h[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(key, mask=n == 0), sample], ["id", "th", "n", "key", "sample"])

    return df.mapInArrow(tk.lean(run), f"id {df.schema['id'].dataType.simpleString()}, th long, n long, key long, sample array<long>")


def _sets(df: DataFrame, ngram: int) -> DataFrame:
    """Of (key, text): (key, n, items, bits) with the shingles and their bitmap as bytes, where the text has that key."""

    def run(batches):
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(1), lower=True):
                text, h = shingle_sets(t, ngram)
                n, sums = _sums(text, h, t.n)
                edge = np.concatenate([[0], np.cumsum(n)])
                want = b.column(0).slice(lo, hi - lo)
                keep = np.flatnonzero((set_key(sums, n) == np.asarray(want.fill_null(0))) & (n > 0))
                items = [h[edge[i] : edge[i + 1]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([want.take(pa.array(keep)), pa.array(n[keep], pa.int64()), pa.array(items, pa.binary()), pa.array([parity(np.frombuffer(x, np.uint64)) for x in items], pa.binary())], ["key", "n", "items", "bits"])

    return df.mapInArrow(tk.lean(run), "key long, n long, items binary, bits binary")


#: Bits of the filter that thins out rows before they are moved: a fixed size, whatever the input.
FILTER_BITS = 1 << 23


def _thinned(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose LONG column may be among the one column of wanted: none of those is lost, and a join sorts out the rest."""
    place, at = F.pmod(F.col(wanted.columns[0]), F.lit(FILTER_BITS)), rows.columns.index(column)
    words = wanted.select(F.floor(place / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(pmod(`{wanted.columns[0]}`, {FILTER_BITS}), 64) as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[np.asarray(found.column("at").combine_chunks())] = np.asarray(found.column("bits").combine_chunks())

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(at)) % FILTER_BITS
            yield b.filter(pa.array((bits[x // 64] >> (x % 64)) & 1 == 1))

    return rows.mapInArrow(tk.lean(run), rows.schema)


def _signed(sets: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            keys = np.asarray(b.column(0))
            for i in range(0, len(keys), 256):
                sign = [signatures(_set(x)) for x in b.column(1).slice(i, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sign).view(np.int64)), pa.array(np.repeat(keys[i : i + 256], [len(x) for x in sign]))], ["sig", "key"])
            tk.trim()

    return sets.select("key", "items").mapInArrow(tk.lean(run), "sig long, key long")


def _met(signed: DataFrame) -> DataFrame:
    """Of (sig, key): the rows of groups of two keys or more, moved once. One row of each group has m, x and y, its number of rows and two
    sums of its keys' hashes, which groups of the same keys have in common; they are null in the others."""

    def ready(sig: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        m = np.diff(np.append(first, len(sig)))
        several = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
        keep = np.repeat(several, m)
        head = np.zeros(len(sig), bool)
        head[first] = True
        head = head[keep]
        told = [m]
        for salt in (0x1111, 0x2222):
            told.append(np.add.reduceat(tk.mix(key.view(np.uint64) ^ tk.U64(salt)), first).view(np.int64))
        told = [pa.array(np.repeat(c, m)[keep], mask=~head) for c in told]
        return pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(key[keep]), *told], ["sig", "key", "m", "x", "y"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of a group that may go on in the next batch
        for b in batches:
            sig, key = (np.asarray(b.column(k)) for k in range(2))
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1]))  # where the last group begins
            if last or held and held[-1][0][0] != sig[0]:
                rows = [*held, (sig[:last], key[:last])]
                yield ready(*(np.concatenate(c) for c in zip(*rows, strict=True)))
                held = []
            held.append((sig[last:], key[last:]))
        if held:
            yield ready(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(tk.lean(run), "sig long, key long, m long, x long, y long")


def _set(x: pa.Scalar) -> np.ndarray:
    """The features in a binary value, not copied."""
    return np.frombuffer(x.as_buffer(), np.uint64)


def parity(h: np.ndarray) -> bytes:
    """A bit for each of WIDE to twice as many buckets a feature, up to BITMAP_BYTES, set where the bucket holds an odd number of features.
    The bits in which two sets differ, in any folding of the buckets, are no more than the features in which they differ."""
    size = 1 << min(max(6, int(np.ceil(np.log2(max(len(h), 1) * WIDE)))), (BITMAP_BYTES * 8).bit_length() - 1)
    odd = np.bincount((tk.mix(h ^ tk.U64(0x77)) & tk.U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: list) -> np.ndarray:
    """The bitmaps as rows of words, each folded to the size of the smallest."""
    words = [np.frombuffer(x, np.uint64) for x in bits]
    least = min(map(len, words))
    return np.array([np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in words])


def _may(n1, n2, differ, percent: int):
    """Whether sets of these sizes that differ in so many features or more can be similar."""
    return (differ * (100 + percent) <= (n1 + n2) * (100 - percent)) & (np.minimum(n1, n2) * 100 >= percent * np.maximum(n1, n2))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v), a written table, whose whole sets are similar. Only sets that are in a pair are moved."""

    def run(batches):
        for b in batches:
            ok = [similar(_set(x), _set(y), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))
            tk.trim()

    items = sets.select("key", "items")
    if pairs.count() <= BROADCAST_ROWS:
        two = items.join(F.broadcast(pairs.select(F.col("v").alias("key")).distinct()), "key", "left_semi")
        pairs = F.broadcast(pairs)
    else:
        items = two = _thinned(items, "key", pairs.select("u").union(pairs.select("v")))
    one, two = (x.select(F.col("key").alias(k), F.col("items").alias(name)) for x, k, name in ((items, "u", "a"), (two, "v", "b")))
    return one.join(pairs, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(tk.lean(run), "u long, v long")


def _ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, member) of all members of the ranges [lo, hi)."""
    many = hi - lo
    place = np.repeat(np.arange(len(lo)), many)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + lo[place]


def _possible(group: np.ndarray, right: np.ndarray, key: np.ndarray, comp: np.ndarray, size: np.ndarray, n: np.ndarray, bits: list[np.ndarray], percent: int, nearest: bool, limit: int) -> list[np.ndarray]:
    """What members in different components leave possible by their bitmaps, as arrays u, v and whole, or, where nearest, u, v, differ, the groups that leave more than limit pairs a member, and the pairs of the others; see
    _across(). Groups stand one after the other, the left members of each before its right ones."""
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stop = np.append(edge[1:], len(group))
    words = np.array([len(x) for x in bits])
    least = np.minimum.reduceat(words, edge)
    lefts = np.add.reduceat(~right, edge)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)]]
    none = np.iinfo(np.int64).max
    best, least_key = np.full(len(group), none), np.full(len(group), none)  # of each member the least distance, and with whom; the least key
    most = limit * np.bincount(group)
    left = np.zeros(len(most), np.int64)  # pairs that each group leaves
    few: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 2]
    for w in np.unique(least).tolist():
        own = np.flatnonzero(least == w)
        at, row = _ragged(edge[own], stop[own])
        m = np.empty((len(row), w), np.uint64)  # the bitmaps of these groups, all folded alike
        for k, i in enumerate(row.tolist()):
            m[k] = bits[i] if len(bits[i]) == w else np.bitwise_xor.reduce(bits[i].reshape(-1, w), axis=0)
        begin = np.cumsum(np.append(0, stop[own] - edge[own]))
        inside = np.arange(len(row)) - begin[at]
        alone = lefts[own][at] == (stop[own] - edge[own])[at]  # no right side: all pairs of the left one
        mine = np.flatnonzero(inside < lefts[own][at])
        lo = np.where(alone, np.arange(len(row)) + 1, begin[at] + lefts[own][at])[mine]
        hi = begin[at + 1][mine]
        done = np.cumsum((hi - lo) * w)
        a = 0
        while a < len(mine):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + AT_ONCE, "right")))
            place, j = _ragged(lo[a:b], hi[a:b])
            i = mine[a:b][place]
            a = b
            x, y = row[i], row[j]
            look = comp[x] != comp[y]
            i, j, x, y = i[look], j[look], x[look], y[look]
            look = _may(n[x], n[y], 0, percent)
            i, j, x, y = i[look], j[look], x[look], y[look]
            differ = np.bitwise_count(m[i] ^ m[j]).sum(axis=1, dtype=np.int64)
            look = _may(n[x], n[y], differ, percent)
            x, y = x[look], y[look]
            if nearest:
                np.minimum.at(best, x, differ[look] << 32 | y)
                np.minimum.at(best, y, differ[look] << 32 | x)
                np.minimum.at(least_key, x, key[y])
                np.minimum.at(least_key, y, key[x])
                left += np.bincount(group[x], minlength=len(left))
                look = left[group[x]] <= most[group[x]]
                few.append([x[look], y[look]])
                continue
            swap = (size[x] > size[y]) | (size[x] == size[y]) & (comp[x] > comp[y])
            x, y = np.where(swap, y, x), np.where(swap, x, y)  # y is in the larger component
            whole = size[y] >= LARGE
            u, v = key[x], np.where(whole, comp[y], key[y])
            both = np.where(whole, u, np.minimum(u, v)), np.where(whole, v, np.maximum(u, v)), whole
            at = np.unique(np.stack(both), axis=1, return_index=True)[1]
            out.append([c[at] for c in both])
    if nearest:
        m = np.flatnonzero(best < none)
        to = key[best[m] & 0xFFFFFFFF]
        other = to != least_key[m]
        x, y = (np.concatenate(c) for c in zip(*few, strict=True))
        look = left[group[x]] <= most[group[x]]
        x, y = key[x[look]], key[y[look]]
        near = [np.concatenate([key[m], key[m[other]]]), np.concatenate([to, least_key[m[other]]]), np.concatenate([best[m] >> 32, np.full(other.sum(), none)])]
        return [*near, np.flatnonzero(left > most), np.minimum(x, y), np.maximum(x, y)]
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _across(spread: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Of members (sig, low, high, right, key, component, size, n, bits) of groups (sig, low, high): what a left and a right member,
    or two left ones where there is no right one, in different components leave possible by their bitmaps: (u, v, whole).
    Two small components give the pair of members; a large one is named as a whole (v) for the other's member u. nearest: (u, v,
    differ) of each member with the one that is nearest by bitmaps, and with the one of the least key, by which the members of a group
    meet in one; of the groups that leave no more than NAMED pairs a member all pairs, as (u, v, ALL), and of each that leaves more
    (sig, 0, AGAIN): only those need be looked at again."""
    limit = NAMED
    names = ["sig", "low", "high", "right", "key", "component", "size", "n", "bits"]

    def run(batches):
        def ready(table: pa.Table):
            sig, low, high, right, key, comp, size, n = (np.asarray(table.column(c).combine_chunks().cast(pa.int64())) for c in names[:-1])
            new = np.append(True, (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
            rows = _possible(np.cumsum(new), right > 0, key, comp, size, n, [_set(x) for x in table.column("bits")], percent, nearest, limit)
            if nearest:
                *rows, some, x, y = rows
                named.append((x, y))
                left = sig[np.flatnonzero(new)[some - 1]]
                rows = [np.concatenate([c, np.full(len(left), x)]) for c, x in zip(rows, (0, 0, AGAIN), strict=True)]
                rows[0][len(rows[0]) - len(left) :] = left
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["u", "v", "differ" if nearest else "whole"])

        def distinct() -> pa.RecordBatch:
            u, v = (np.concatenate(c) for c in zip(*named, strict=True))
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
            named.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (u[new], v[new], np.full(new.sum(), ALL))], ["u", "v", "differ"])

        named: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[pa.RecordBatch] = []  # of a group that may go on in the next batch
        for batch in batches:
            for lo in range(0, batch.num_rows, 2 * BLOCK):
                b = batch.slice(lo, 2 * BLOCK)
                keys = np.stack([np.asarray(b.column(k)) for k in range(3)])
                ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                goes_on = held and all(held[-1].column(k)[0].as_py() == keys[k, 0] for k in range(3))
                if held and not (goes_on and not len(ends)):
                    yield ready(pa.Table.from_batches([*held, b.slice(0, ends[-1] if len(ends) else 0)]))
                    held = []
                elif len(ends):
                    yield ready(pa.Table.from_batches([b.slice(0, ends[-1])]))
                held.append(b.slice(ends[-1] if len(ends) else 0))
                if sum(len(x) for x, _ in named) > HELD:
                    yield distinct()
            tk.trim()
        if held:
            yield ready(pa.Table.from_batches(held))
        if named:
            yield distinct()

    dealt = spread.select(names).repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high", "right")
    if nearest:
        return dealt.mapInArrow(tk.lean(run), "u long, v long, differ long")
    return dealt.mapInArrow(tk.lean(run), "u long, v long, whole boolean").distinct()


def _nearest(near: DataFrame) -> DataFrame:
    """Of what _across() gives for the nearest: two pairs (u, v) of each member."""
    ends = near.where("differ >= 0").groupBy("u").agg(F.min_by("v", F.struct("differ", "v")).alias("a"), F.min("v").alias("b"))
    pairs = ends.select("u", F.explode(F.array_distinct(F.array("a", "b"))).alias("v"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _placed(comp: DataFrame) -> DataFrame:
    sizes = apart(comp, "component", F.count("*").alias("size"))
    return comp.join(sizes, "component").select(F.col("node").alias("key"), "component", "size")


def _parted(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Of pairs (u, v) those whose ends are in different components, as _across() gives them."""
    for k in "uv":
        side = _placed(comp).select(F.col("key").alias(k), F.col("component").alias(f"c{k}"), F.col("size").alias(f"s{k}"))
        pairs = pairs.join(side, k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k)).withColumn(f"s{k}", F.coalesce(f"s{k}", F.lit(1)))
    swap = F.expr("struct(su, cu) > struct(sv, cv)")
    pairs = pairs.where("cu != cv").select("u", "v", F.when(swap, F.col("v")).otherwise(F.col("u")).alias("x"), F.when(swap, F.col("cu")).otherwise(F.col("cv")).alias("c"), (F.greatest("su", "sv") >= LARGE).alias("whole"))
    u, v = (F.when(F.col("whole"), F.col(a)).otherwise(b) for a, b in (("x", F.least("u", "v")), ("c", F.greatest("u", "v"))))
    return pairs.select(u.alias("u"), v.alias("v"), "whole").distinct()


def _against_large(cells: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of members u to large components, of cells (u, component): one for each where there is any. Members and
    components meet in blocks of BLOCK a side, so that a task holds two blocks whatever the component's size."""

    def run(table: pa.Table) -> pa.Table:
        mine = np.asarray(table.column("member").combine_chunks())
        key = np.asarray(table.column("key").combine_chunks())
        items = [_set(x) for x in table.column("items")]
        members = np.flatnonzero(mine)
        u, v = [], []
        if len(members) and len(members) < len(mine):
            n = np.array([len(items[i]) for i in members])
            flat, owner = np.concatenate([items[i] for i in members]), np.repeat(np.arange(len(members)), n)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in np.flatnonzero(~mine):
                x = items[i]
                _, at = _ragged(np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right"))
                both = np.bincount(owner[at], minlength=len(members))
                ok = np.flatnonzero(100 * both >= percent * (n + len(x) - both))
                if len(ok):
                    u.append(key[i])
                    v.append(key[members[ok[0]]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_FEATURES)).cast("int")
    sizes = sets.select("key", "n")
    probes = cells.withColumnRenamed("u", "key").join(sizes, "key")
    asked = apart(probes, "component", blocks.alias("probes"))
    members = comp.withColumnRenamed("node", "key").join(asked, "component").join(sizes, "key")
    held = apart(members, "component", blocks.alias("blocks"))
    sides = asked.join(held, "component")
    own = lambda k: F.pmod(F.xxhash64("key"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    members = members.drop("probes").join(sides, "component").select("component", "key", own("blocks").alias("block"), each("probes").alias("probe"), F.lit(True).alias("member"))
    probes = probes.join(sides, "component").select("component", "key", each("blocks").alias("block"), own("probes").alias("probe"), F.lit(False).alias("member"))
    rows = members.unionByName(probes)
    rows = rows.join(_thinned(sets.select("key", "items"), "key", rows.select("key")), "key")
    return rows.select("component", "block", "probe", "member", "key", "items").groupBy("component", "block", "probe").applyInArrow(run, "u long, v long")


def _spread(grouped: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """What _across() takes: the members (sig, blocks, key) of groups that hold several components, dealt in blocks. Who has no
    component yet is one of size 1."""
    member = grouped.join(_placed(comp), "key", "left").select("sig", "blocks", "key", F.coalesce("component", "key").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed = apart(member, "sig", F.min("component").alias("p"), F.max("component").alias("q")).where("p != q").select("sig")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # each block of a group meets itself and every other block: (b, b) and (low, high)
    spread = member.join(mixed, "sig", "left_semi").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("sig", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("right"), "key", "component", "size").join(sets.select("key", "n", "bits"), "key")


def _classes(df: DataFrame, id_col: str, text_col: str, ngram: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, n, key) of df, where th is the text's hash and equal sets share a key, null for the empty set; and of each class
    of equal sets (key, component, least_id, least_th): the class's component, and of its rows the one with the smallest id
    (none of them, where all ids are null), among those the one with the smallest th."""
    if percent < 75:
        raise ValueError("signatures are built for a similarity of 75 percent or more")
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    folder = f"{shared_folder(df.sparkSession)}/jaccard-{uuid.uuid4().hex}"
    kept = lambda x, name: table(x, f"{folder}/{name}")
    samples = kept(_keys(docs, ngram), "samples")
    seen = samples.where("key is not null").select(F.explode("sample").alias("h"), "key")
    keys = kept(samples.drop("sample"), "keys")
    shared = apart(seen, "h", F.min("key").alias("p"), F.max("key").alias("q")).where("p != q").select("h")
    back = seen.join(shared, "h", "left_semi").groupBy("key").agg(F.count_distinct("h").alias("met"))
    rows = keys.where("key is not null").groupBy("key", "id", "th").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    named = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "th")))
    classes = rows.groupBy("key").agg(F.min(F.struct("id", "th", "rows")).alias("first"), F.max("n").alias("n"), named.alias("least"))
    rate = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.col("n") / SAMPLE)), F.lit(0)))
    # a partner of the next size up has half the sample; where none can be that large, much more has to be shared
    least = F.when(F.col("n") * 4 < 3 * 2 * SAMPLE * rate, 6).otherwise(12)
    hopeful = kept(back.join(classes, "key").where(F.col("met") * least * rate >= F.col("n") * 0.75).select("key", "first.*"), "hopeful")
    discard(df.sparkSession, f"{folder}/samples")
    release(df.sparkSession)
    wanted = hopeful.select("key", F.col("id").alias("w_id"), F.col("th").alias("w_th"), "rows")
    if hopeful.count() <= BROADCAST_ROWS:
        some, wanted = docs, F.broadcast(wanted)
    else:  # texts are moved, but few that are not wanted
        some = _thinned(docs, "th", hopeful.select("th"))
    found = some.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
    alone, often = (_sets(found.where(c).select("key", "text"), ngram) for c in ("rows = 1", "rows > 1"))
    sets = kept(alone.union(often.dropDuplicates(["key"])), "sets")
    release(df.sparkSession)

    met = kept(_met(_signed(sets)), "met")
    release(df.sparkSession)
    # of groups of the same members one is enough: their number and two sums of hashes tell them apart
    groups = met.where("m is not null").groupBy("m", "x", "y").agg(F.min("sig").alias("sig"))
    groups = groups.select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    grouped = kept(met.select("sig", "key").join(groups, "sig"), "grouped")
    discard(df.sparkSession, f"{folder}/met")
    release(df.sparkSession)
    # a range, as rows of Python's own would keep other workers alive for a while
    comp = df.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    near = kept(_across(_spread(grouped, comp, sets), percent, True), "near")
    pairs = kept(_nearest(near), "pairs")
    comp = components(kept(_verified(pairs, sets, percent), "linked"))
    release(df.sparkSession)
    grouped = grouped.join(near.where(F.col("differ") == AGAIN).select(F.col("u").alias("sig")).distinct(), "sig", "left_semi")
    left = _parted(near.where(F.col("differ") == ALL).select("u", "v").distinct(), comp)
    doubtful = kept(_across(_spread(grouped, comp, sets), percent, False).union(left), "doubtful")
    release(df.sparkSession)
    cells, pairs = doubtful.where("whole").select("u", F.col("v").alias("component")), doubtful.where("not whole").select("u", "v")
    more = kept(_verified(pairs, sets, percent).union(_against_large(cells, comp, sets, percent)), "more")
    release(df.sparkSession)
    comp = components(comp.toDF("u", "v").union(more))
    for name in ("hopeful", "sets", "grouped", "near", "pairs", "linked", "doubtful", "more"):
        discard(df.sparkSession, f"{folder}/{name}")

    linked = classes.select("key", "least").join(comp.withColumnRenamed("node", "key"), "key")
    smallest = apart(linked, "component", F.min("least").alias("smallest"))
    linked = linked.join(smallest, "component").select("key", "component", "smallest")
    out = classes.select("key", "least").join(linked, "key", "left").select("key", F.coalesce("component", "key").alias("component"), F.coalesce("smallest", "least").alias("x"))
    return keys, out.select("key", "component", F.col("x.id").alias("least_id"), F.col("x.th").alias("least_th"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = 75) -> DataFrame:
    """One row for each row of df: id_col, n_shingles, component_id (the smallest id reachable by links).

    Links join rows whose shingle sets reach percent / 100 in Jaccard similarity; percent may be 75 or more.
    A null or empty text, or one of white space, has the empty set and is linked with nothing: its component is
    its own id. Equal ids are rows of their own. A component whose ids are all null has a null component_id.
    Ties go to the smaller id. Columns of df other than the two named are not read. No rows give no rows. A text of any length
    is read whole; its set, 8 bytes a shingle, is the most that a task needs of it at once.

    Steps: (1) sampled shingles, with partial aggregation, rule out sets that share too little of their sample with any
    others (similar sets do so with a chance of about 1e-8, and none where all shingles are sampled); (2) the sets of the rest are built once for
    each class of equal sets; (3) PartEnum signatures group the sets; (4) members of a group are compared by bitmaps, in
    blocks, and each is verified against the nearest one; (5) of pairs that are possible by their bitmaps, all between different
    components are verified: a group that has few has named them, others that still hold several components are compared again; whoever may belong to a large component is compared with that component's members, in blocks too.
    Class and shingle hashes have 64 bits.
    """
    keys, classes = _classes(df, id_col, text_col, ngram, percent)
    return keys.join(classes, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least_id", "id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = 75) -> DataFrame:
    """df, with all its columns, but one row of each component: that with the component's smallest id, and of rows with that id
    the first text in hash order; of repeated rows one.

    Rows without words are linked with nothing and stay. Rows with a null id all stay. Rows of one id in different components are
    judged apart. Other columns are carried along untouched.
    """
    keys, classes = _classes(df, id_col, text_col, ngram, percent)
    named = keys.where("id is not null")
    kept = named.join(classes, "key", "left").where("key is null or id = least_id and th = least_th")
    kept = kept.groupBy("id", "th").agg(F.max(F.col("key").isNotNull()).alias("gridlake_one"), F.count("*").alias("gridlake_rows")).withColumnRenamed("id", "gridlake_id").withColumnRenamed("th", "gridlake_th")
    left = df.join(kept, (F.col(id_col) == F.col("gridlake_id")) & (F.xxhash64(F.col(text_col)) == F.col("gridlake_th")))
    rank = F.row_number().over(Window.partitionBy("gridlake_id", "gridlake_th").orderBy(F.col(text_col)))
    first = left.where("gridlake_one and gridlake_rows > 1").withColumn("gridlake_rank", rank).where("gridlake_rank = 1")
    return left.where("not gridlake_one or gridlake_rows = 1").select(df.columns).union(first.select(df.columns)).union(df.where(F.col(id_col).isNull()))
