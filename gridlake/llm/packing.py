"""Packing into fixed-size sequences by patterns: non-negative least squares over a histogram of lengths.

Only the histogram of piece lengths, at most ``capacity`` numbers, reaches the driver. Patterns of few lengths that
fill a sequence are enumerated, their repeat counts fitted to the histogram and rounded down, and what is left is
packed best-fit over counts. Pieces then find their sequence by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import cut

CAPACITY = 1024
END = 2
#: Patterns given to the least-squares fit at most; the commonest lengths come first.
PATTERNS = 600
#: Pre-tokens whose ids a task keeps.
KEPT = 1 << 20

_L, _N, _O, _S, _X = range(5)
_CLASS = np.full(256, _X, np.uint8)
_CLASS[0x20:0x7F] = _O
_CLASS[[9, 10, 11, 12, 13, 32]] = _S
_CLASS[ord("0") : ord("9") + 1] = _N
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]] = _L


@lru_cache(1)
def tokenizer(path: str):
    """The worker's own, kept from task to task: each time one is read some 40 MB are not given back. It encodes in the task's thread:
    short pieces dealt to a thread for each of the machine's CPUs take several times the CPU seconds, and other tasks need them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts. A text of ASCII and Latin letters is cut into pre-tokens by byte classes and each distinct
    pre-token is encoded once; any other text goes to the tokenizer as it is. Both give the tokenizer's ids."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.clear()

    def clear(self):
        self.slots = np.full(1 << 22, -1, np.int32)
        self.keys = np.zeros(KEPT * 2, np.uint64)
        self.at, self.size = np.zeros(KEPT * 2, np.int64), np.zeros(KEPT * 2, np.int32)
        self.n, self.ids, self.used = 0, np.zeros(1 << 22, np.uint32), 0

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where it has none: linear probing over a few slots."""
        out = np.full(len(keys), -1, np.int32)
        slot, left = (keys >> tk.U64(20)).astype(np.int64) & (len(self.slots) - 1), np.arange(len(keys))
        while len(left):
            e = self.slots[slot]
            hit = (e >= 0) & (self.keys[e] == keys[left])
            out[left[hit]] = e[hit]
            go = (e >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & (len(self.slots) - 1)
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if self.n + len(keys) > len(self.keys):
            self.keys, self.at, self.size = (np.concatenate([x, np.zeros(len(keys) + len(x), x.dtype)]) for x in (self.keys, self.at, self.size))
        ids = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        new = slice(self.n, self.n + len(keys))
        self.keys[new], self.size[new], self.at[new] = keys, size, self.used + np.cumsum(size) - size
        # all at once, each in the first free slot from its own on; of entries that meet in one, the others go on
        left = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        slot = (keys >> tk.U64(20)).astype(np.int64) & (len(self.slots) - 1)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            go = self.slots[slot] != left
            left, slot = left[go], (slot[go] + 1) & (len(self.slots) - 1)
        self.n, self.used = self.n + len(keys), self.used + len(flat)

    def encode(self, t: tk.Texts) -> list[np.ndarray]:
        data, off, n = t.data, t.off, t.n
        kind = _CLASS[data]
        odd = kind == _X
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        special = np.zeros(n, bool)
        special[np.searchsorted(off, np.flatnonzero(odd), "right") - 1] = True
        for i in np.unique(np.searchsorted(off, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1):
            special[i] = True  # may hold the string of a special token
        begins = np.zeros(len(data), bool)
        first = np.zeros(len(data), bool)
        first[off[:-1][np.diff(off) > 0]] = True
        before, ahead = np.roll(kind, 1), np.roll(kind, -1)
        last = np.roll(first, -1)
        if len(data):
            last[-1] = True
        solid, space = kind != _S, np.roll(data, 1) == 32
        begins |= solid & (kind != before) & ~((before == _S) & space)
        begins |= ~solid & (before != _S)
        begins |= ~solid & (before == _S) & ~last & (ahead != _S)
        begins |= first
        quote = np.flatnonzero((data == 39) & (first | ((before != _O) & ~space)))
        quote = quote[~last[quote]] if len(quote) else quote
        one = quote[np.isin(data[quote + 1], list(b"stmd"))] if len(quote) else quote
        room = quote[(quote + 2 < len(data))] if len(quote) else quote
        room = room[~last[room + 1]] if len(room) else room
        pair = data[room + 1].astype(np.int64) * 256 + data[room + 2] if len(room) else room
        two = room[np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")])] if len(room) else room
        for at, k in ((one, 2), (two, 3)):
            begins[at + 1] = False
            end = at + k
            ok = end < len(data)
            begins[end[ok]] |= kind[end[ok]] != _S
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        keys = tk.span_hash(t.byte_prefix(), starts, ends, tk._BASE)
        entry = self._find(keys)
        owner = np.searchsorted(off, starts, "right") - 1
        if len(miss := np.flatnonzero((entry < 0) & ~special[owner])):
            if self.n > KEPT:
                self.clear()
                entry = self._find(keys)
                miss = np.flatnonzero((entry < 0) & ~special[owner])
            new, at = np.unique(keys[miss], return_index=True)
            raw = data.tobytes()
            self._learn(new, [raw[starts[i] : ends[i]].decode() for i in miss[at]])
            entry[miss] = self._find(keys[miss])
        good = np.flatnonzero(entry >= 0)
        size = np.zeros(len(entry), np.int64)
        size[good] = self.size[entry[good]]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(np.where(entry >= 0, self.at[entry], 0) - total[:-1], size)]
        edge = total[np.searchsorted(starts, off)]
        return [self._slow(data[off[i] : off[i + 1]].tobytes().decode()) if special[i] else flat[edge[i] : edge[i + 1]] for i in range(n)]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: one, or the last ones full and the first perhaps shorter."""
    head = n if n <= capacity else n % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with a small |a x - b|: accelerated projected gradient."""
    x = y = np.zeros(a.shape[1])
    gram, rhs = a.T @ a, a.T @ b
    rate, t = 1 / max(np.linalg.norm(gram, 2), 1e-12), 1.0
    for _ in range(steps):
        new = np.maximum(y - rate * (gram @ y - rhs), 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def patterns(hist: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Groups of one to four lengths that fill a sequence as nearly as the histogram allows, the commonest first."""
    cap = len(hist) - 1
    have = [int(x) for x in np.flatnonzero(hist) if x]
    present = hist > 0
    below = np.zeros(cap + 1, np.int64)  # the largest length there is up to each
    for i in range(1, cap + 1):
        below[i] = i if present[i] else below[i - 1]
    found: Counter = Counter()
    ranked = sorted(have, key=lambda x: (-int(hist[x]), -x))
    for x in have:
        if x == cap or not below[cap - x]:
            found[(x,)] += int(hist[x])
            continue
        y = int(below[cap - x])
        found[tuple(sorted((x, y), reverse=True))] += int(min(hist[x], hist[y]))
    for x in ranked[:80]:
        for y in ranked[:40]:
            if (room := cap - x - y) > 0 and (z := int(below[room])):
                found[tuple(sorted((x, y, z), reverse=True))] += int(min(hist[x], hist[y], hist[z])) * (sum((x, y, z)) == cap)
                if (w := int(below[room - z])) and sum((x, y, z, w)) == cap:
                    found[tuple(sorted((x, y, z, w), reverse=True))] += int(min(hist[x], hist[y], hist[z], hist[w]))
    order = sorted(found, key=lambda p: (-(sum(p) == cap), -found[p], p))
    return order[:most]


def plan(hist: np.ndarray, most: int = PATTERNS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) for all pieces of the histogram; hist[i] pieces have length i."""
    cap, left, out = len(hist) - 1, hist.astype(np.int64).copy(), []
    for _ in range(12):
        if left[:cap].sum() == 0:
            break
        group = [p for p in patterns(left, most) if sum(p) >= 0.97 * cap and len(p) > 1]
        if not group:
            break
        scale = np.sqrt(np.maximum(left, 1))
        a = np.zeros((cap + 1, len(group)))
        for j, p in enumerate(group):
            for x in p:
                a[x, j] += 1
        fit = nnls(a / scale[:, None], left / scale)
        before = left.sum()
        for j in np.argsort([-sum(p) for p in group], kind="stable"):
            need = Counter(group[j])
            times = int(min([np.floor(fit[j] + 1e-6), *(left[x] // k for x, k in need.items())]))
            if times > 0:
                out.append((group[j], times))
                for x, k in need.items():
                    left[x] -= k * times
        if before - left.sum() < max(1, before // 1000):
            break
    return out + best_fit(left)


def best_fit(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: the largest length left opens a sequence, then the largest that still fits."""
    cap, left, out = len(hist) - 1, hist.astype(np.int64).copy(), []
    while len(have := np.flatnonzero(left)):
        room, p = cap, []
        while len(fit := have[have <= room]):
            x = int(fit[-1])
            p.append(x)
            room -= x
            left[x] -= 1
            have = have[left[have] > 0]
        need = Counter(p)
        times = 1 + int(min(left[x] // k for x, k in need.items()))
        for x, k in need.items():
            left[x] -= k * (times - 1)
        out.append((tuple(p), times))
    return out


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length: rows (first rank, sequence of it, sequences to go up by a rank, offset) in rank order."""
    out: dict[int, list] = {}
    rank, seq = Counter(), 0
    for p, times in chosen:
        offset = 0
        for x in p:
            out.setdefault(x, []).append((rank[x], seq, offset))
            rank[x] += times
            offset += x
        seq += times
    return {x: np.array(v, np.int64) for x, v in out.items()}


def _pieces(df: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    def run(batches):
        # its tables are a task's own: kept in a worker, they would take their memory from whatever runs there next
        enc, part, seen = Encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(1), chunk=1 << 19):
                row, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, ids in enumerate(enc.encode(t)):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for k, (s, n) in enumerate(cut_points(len(ids), capacity)):
                        row.append(lo + i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[s : s + n]))
                        rank.append(seen[n])
                        seen[n] += 1
                ints = [pa.array(x, pa.int64()) for x in (start, length, crc, rank)]
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *ints, pa.array(np.full(len(row), part), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids_crc32", "rank", "part"])

    return df.mapInArrow(tk.lean(run), f"id {df.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, rank long, part long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Only documents of over ``capacity`` ids are cut. Equal texts and equal
    or null ids are packed row by row; other columns of df are not read; an empty df gives no rows.
    path: the tokenizer's file, on every worker.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = cut(_pieces(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, capacity, end))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        hist[r["length"]] = r["n"]
    table = slots(plan(hist))

    def run(batches):
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, of = np.flatnonzero(length == x), table[int(x)]
                k = np.searchsorted(of[:, 0], rank[at], "right") - 1
                seq[at], offset[at] = of[k, 1] + rank[at] - of[k, 0], of[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    kind = ranked.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(tk.lean(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
