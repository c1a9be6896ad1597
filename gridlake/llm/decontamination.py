"""Benchmark decontamination: exact pieces of items as seeds, word counts around them, exact edit verification.

An item that may have k edits is cut into k + 1 pieces. Whatever k edits there are, wherever they fall, one piece at
least is left word for word, so every occurrence is met by looking up each run of as many words of a document among the
pieces: nothing inside the allowed distance is missed. What meets has to share enough words with the document around
it, and is then verified by the edit distance between the item's words and the best part of that region.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as tk

#: Largest edit distance, as a share of the item's words.
EDITS = 0.25
#: Items of fewer words have to occur word for word.
SHORT = 8
#: Bytes of items that go to the workers at once; a larger benchmark is searched for in blocks of about that size.
BLOCK_BYTES = 4_000_000
#: Meetings, and words of regions, that are looked at at once.
AT_ONCE = 1 << 20
#: Bits of the hash that a first look goes by.
_BITS = 20

#: Case, punctuation and symbols play no part in a comparison.
_PLAIN = tk.LOWER.copy()
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


def _words(column) -> list[np.ndarray]:
    out = []
    for _, _, t in tk.texts_of(column):
        t = tk.Texts(_PLAIN[t.data], t.off)
        h, first = t.word_hashes(), t.words[2]
        out += [h[first[i] : first[i + 1]] for i in range(t.n)]
    return out


def pieces(size: int, most: int) -> np.ndarray:
    """Where the most + 1 pieces of an item of size words begin, and its end; most is less than size."""
    return np.arange(most + 2) * size // (most + 1)


def edits(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least edit distance between item and any part of region, and where such a part ends."""
    least, end = edits_each(item, region[None, :])
    return int(least[0]), int(end[0])


def edits_each(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """edits() for each row of regions."""
    column = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(regions), regions.shape[1] + 1), np.int64)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != w))
        row = np.minimum.accumulate(new - column, axis=1) + column
    end = np.argmin(row, axis=1)
    return row[np.arange(len(row)), end], end


class Index:
    """Items of SHORT words or more by their pieces, sorted by hash for each length of a piece; the others whole."""

    def __init__(self, items: list[tuple[object, np.ndarray]], share: float = EDITS):
        self.items, self.share = items, share
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        self.short = {}
        for i, (_, w) in enumerate(items):
            if len(w) >= SHORT:
                cuts, pre = pieces(len(w), int(share * len(w))), tk.prefix(w, tk._STEP)
                for a, b, key in zip(cuts[:-1].tolist(), cuts[1:].tolist(), tk.span_hash(pre, cuts[:-1], cuts[1:], tk._STEP).tolist(), strict=True):
                    by_size.setdefault(b - a, []).append((key, i, a))
            elif len(w):
                self.short.setdefault(len(w), {}).setdefault(int(tk.span_hash(tk.prefix(w, tk._STEP), np.array([0]), np.array([len(w)]), tk._STEP)[0]), []).append(int(i))
        self.seeds = []
        for n, rows in sorted(by_size.items()):
            keys = np.array([k for k, _, _ in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[(keys >> tk.U64(64 - _BITS)).astype(np.int64)] = True
            self.seeds.append((n, seen, keys[order], *(np.array([r[c] for r in rows], np.int64)[order] for c in (1, 2))))

    def _meetings(self, h: np.ndarray, first: np.ndarray):
        """(item, text, word among all words where the item would begin), about AT_ONCE at a time, some of them repeated."""
        for n, seen, keys, item, offset in self.seeds:
            at, text, key = tk.window_hashes(h, first, n)
            look = np.flatnonzero(seen[(key >> tk.U64(64 - _BITS)).astype(np.int64)])
            at, text, key = at[look], text[look], key[look]
            lo = np.searchsorted(keys, key)
            many = np.searchsorted(keys, key, "right") - lo
            total = np.cumsum(many)
            a = 0
            while a < len(many):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, "right")))
                own = np.repeat(np.arange(a, b), many[a:b])
                k = np.arange(len(own)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + lo[own]
                if len(own):
                    yield item[k], text[own], at[own] - offset[k]
                a = b

    def search(self, t: tk.Texts) -> list[tuple[int, int, int, int]]:
        """(text, item, first word about, edits) of every item found, once for each text and item."""
        t = tk.Texts(_PLAIN[t.data], t.off)
        h, first = t.word_hashes(), t.words[2]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for n, exact in self.short.items():
            at, text, key = tk.window_hashes(h, first, n)
            hit = np.isin(key, np.fromiter(exact, np.uint64))
            for a, x, k in zip(at[hit].tolist(), text[hit].tolist(), key[hit].tolist(), strict=True):
                for i in exact[k]:
                    found.setdefault((x, i), (0, a - int(first[x])))
        for item, text, at in self._meetings(h, first):
            order = np.lexsort((at, text, item))
            item, text, at = item[order], text[order], at[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1])
            item, text, at = item[new], text[new], at[new]
            edge = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])), len(item))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                i = int(item[a])
                rows = max(1, AT_ONCE // (2 * len(self.items[i][1])))
                for lo in range(a, b, rows):
                    own = slice(lo, min(lo + rows, b))
                    self._verify(i, text[own], at[own], h, first, found)
        return [(x, i, a, e) for (x, i), (e, a) in found.items()]

    def _verify(self, i: int, text: np.ndarray, at: np.ndarray, h: np.ndarray, first: np.ndarray, found: dict) -> None:
        """Put item i into found for those of its meetings that are within the distance."""
        w = self.items[i][1]
        most = int(self.share * len(w))
        place = at[:, None] + np.arange(-most, len(w) + most)
        there = (place >= first[text][:, None]) & (place < first[text + 1][:, None])
        regions = h[np.clip(place, 0, len(h) - 1)]
        words = np.unique(w)
        near = np.minimum(np.searchsorted(words, regions), len(words) - 1)
        enough = np.flatnonzero(((words[near] == regions) & there).sum(axis=1) >= len(w) - most)
        if not len(enough):
            return
        # 0 stands beyond the ends of the text; such columns cost an edit each and never make a part better
        regions = np.where(there, regions, tk.U64(0))[enough]
        least, end = edits_each(w, regions)
        for k in np.flatnonzero(least <= most).tolist():
            x = int(text[enough[k]])
            begin = max(int(at[enough[k]]) - most + max(int(end[k]) - len(w), 0) - int(first[x]), 0)
            found[x, i] = min(found.get((x, i), (most + 1, 0)), (int(least[k]), begin))


def indexes(items: DataFrame, id_col: str, text_col: str, share: float, block_bytes: int = BLOCK_BYTES):
    """Index after Index, each of about block_bytes of items; together they hold every item."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / block_bytes))
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        table = part.toArrow()
        yield Index(list(zip(table.column("id").to_pylist(), _words(table.column("text")), strict=True)), share)


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDITS) -> DataFrame:
    """One row for each row of df and each item found in it: id_col, item_id, word (about where it starts, among words
    without punctuation), edits, item_words.

    An item is found where the edit distance in words between it and some part of the text is at most ``share`` of its
    words, below 1; items under SHORT words have to occur word for word. None is missed, wherever the edits are. Case,
    punctuation and white space do not count. Null or empty texts hold nothing, items without a word
    are never found, repeated rows and items give a row each, null ids are passed on, and no rows or no items
    give no rows. Other columns are not read. The rows of df are not moved.
    """
    doc, item = df.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    kind = to_arrow_type(items.schema[item_id].dataType)
    docs, out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for index in indexes(items, item_id, item_text, share):

        def run(batches, index=index):
            for b in batches:
                for lo, _, t in tk.texts_of(b.column(1)):
                    hits = sorted(index.search(t))
                    ids = b.column(0).take(pa.array([lo + x for x, *_ in hits], pa.int64()))
                    cols = [ids, pa.array([index.items[i][0] for _, i, _, _ in hits], kind), *(pa.array(x, pa.int64()) for x in ([h[2] for h in hits], [h[3] for h in hits], [len(index.items[h[1]][1]) for h in hits]))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "item", "word", "edits", "item_words"])

        one = docs.mapInArrow(tk.lean(run), f"id {doc}, item {item}, word long, edits long, item_words long")
        out = one if out is None else out.unionAll(one)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "word", "edits", "item_words")


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDITS) -> DataFrame:
    """df, with all its columns, without the rows that hold an item; see contaminated()."""
    out, at = df, df.columns.index(text_col)
    for index in indexes(items, item_id, item_text, share):

        def run(batches, index=index):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, t in tk.texts_of(b.column(at)):
                    hit = [lo + x for x, *_ in index.search(t)]
                    keep[hit] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(tk.lean(run), df.schema)
    return out
