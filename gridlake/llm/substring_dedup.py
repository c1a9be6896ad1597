"""Removal of repeated passages by level-wise doubling.

Level 1 looks at windows of a quarter of the target length, and of those only at anchors: the smallest hash in each
target window, which equal target windows share. Level 2 doubles the windows of the anchors that occur elsewhere,
level 3 (the target length) takes the target windows around anchors whose doubled window occurs elsewhere. A level
reads only what the level before left over, and ends early when that is nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import apart, cut, release

WINDOW = 35
#: Bits of a gram's hash that give way to its position; longer texts go in runs of so many grams.
_POS = 24


def _leftmost_least(grams: np.ndarray, n: int) -> np.ndarray:
    """Where in every n neighbours the least hash stands, by its upper bits; the leftmost of equal ones."""
    run, out = (1 << _POS) - n + 1, []
    for a in range(0, max(len(grams) - n + 1, 1), run):
        part = grams[a : a + run + n - 1]
        packed = (part >> tk.U64(_POS) << tk.U64(_POS)) | np.arange(len(part), dtype=np.uint64)
        out.append((_sliding_min(packed, n) & tk.U64((1 << _POS) - 1)).astype(np.int64) + a)
    return np.concatenate(out)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Of every n neighbours the least."""
    m, have = x, 1
    while 2 * have <= n:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    return np.minimum(m[: len(m) - (n - have)], m[n - have :]) if n > have else m


class Anchors:
    """Of every target window of some texts: its text, first word, anchor and whether the anchor's second half is used."""

    def __init__(self, t: tk.Texts, target: int):
        quarter, half = (target + 3) // 4, (target + 1) // 2
        self.words, self.first = t.word_hashes(), t.words[2]
        self.quarter, self.half, self.target = quarter, half, target
        self.at, self.text, self.key = tk.window_hashes(self.words, self.first, target)
        if not len(self.at):
            self.anchor, self.back = self.at, np.zeros(0, bool)
            return
        self.grams = tk.span_hash(tk.prefix(self.words, tk._STEP), np.arange(len(self.words) - quarter + 1), np.arange(quarter, len(self.words) + 1), tk._STEP)
        self.anchor = _leftmost_least(self.grams, target - quarter + 1)[self.at]
        self.back = self.anchor - self.at > target - half

    def halves(self, anchor: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The hash of the doubled window of each anchor: it starts there, or ends where the anchor ends."""
        lo = np.where(back, anchor + self.quarter - self.half, anchor)
        return tk.span_hash(tk.prefix(self.words, tk._STEP), lo, lo + self.half, tk._STEP)


def _spots(docs: DataFrame, target: int) -> DataFrame:
    """(short, ahead, back, th, word) of the anchors of (id, text, th): hashes at level 1 and of its one or two doubled
    windows, the text, and the anchor's word."""

    def run(batches):
        for b in batches:
            th = np.asarray(b.column(2))
            for lo, _, t in tk.texts_of(b.column(1)):
                a = Anchors(t, target)
                at, i = np.unique(a.anchor, return_index=True)
                if len(at):
                    sides = []
                    for side in (False, True):
                        used = np.isin(at, a.anchor[a.back == side])
                        h = np.zeros(len(at), np.uint64)
                        h[used] = a.halves(at[used], np.full(used.sum(), side))
                        sides.append(pa.array(h.view(np.int64), mask=~used))
                    cols = [pa.array(a.grams[at].view(np.int64)), *sides, pa.array(th[lo + a.text[i]]), pa.array(at - a.first[a.text[i]])]
                    yield pa.RecordBatch.from_arrays(cols, ["short", "ahead", "back", "th", "word"])

    return docs.mapInArrow(tk.lean(run), "short long, ahead long, back long, th long, word long")


def _windows(docs: DataFrame, target: int) -> DataFrame:
    """(h, th, word) of the target windows of (id, text, th, spots) whose anchor is among spots, each 2 * word + back."""

    def run(batches):
        for b in batches:
            th, spots = np.asarray(b.column(2)), b.column(3)
            for lo, hi, t in tk.texts_of(b.column(1)):
                a = Anchors(t, target)
                part = spots.slice(lo, hi - lo)
                size = np.asarray(part.value_lengths().fill_null(0))
                have = np.asarray(part.flatten()) + np.repeat(2 * a.first[:-1], size)
                ok = np.isin(a.anchor * 2 + a.back, have)
                cols = [a.key[ok].view(np.int64), th[lo + a.text[ok]], a.at[ok] - a.first[a.text[ok]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "th", "word"])

    return docs.mapInArrow(tk.lean(run), "h long, th long, word long")


def _elsewhere(df: DataFrame, key: str, of: DataFrame | None = None) -> DataFrame:
    """The rows of df whose key occurs twice or more in ``of`` (df unless given)."""
    of = df if of is None else of
    return df.join(apart(of, key, F.count("*").alias("times")).where("times > 1").select(key), key, "left_semi")


def _cleaned(docs: DataFrame, target: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(1)):
                starts, ends, first = t.words
                part = b.column(3).slice(lo, hi - lo)
                at = np.asarray(part.flatten()) + np.repeat(first[:-1], np.asarray(part.value_lengths().fill_null(0)))
                gone = tk.covered(at, target, len(starts))
                n, copied = np.diff(first), np.asarray(b.column(4))[lo:hi]
                gone |= np.repeat(copied & (n >= target), n)
                raw, kept = t.data.tobytes(), []
                for i in range(t.n):
                    keep = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                    kept.append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
                lost = tk.per_text(gone, first)
                cols = [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "n_removed", "kept", "kept_sha256"])

    return docs.mapInArrow(tk.lean(run), f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept string, kept_sha256 string")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = WINDOW) -> DataFrame:
    """One row for each row of df: id_col, n_words, n_removed, kept (the words left, by single spaces), kept_sha256.

    Each word goes that lies in a window of ``target`` words whose words also start anywhere else in df, the same
    row included. A null or empty text has no words. Rows that repeat, ids and all, count as several places; null
    ids are allowed; other columns of df are not read; no rows give no rows; a text of any length is read whole, by one task. Windows and rows are told apart by
    64-bit hashes. Hot windows are counted with partial aggregation and joined by joins that Spark can split.
    """
    if target < 4:
        raise ValueError("the target needs four words or more")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    copies = apart(docs.select("th"), "th", (F.count("*") > 1).alias("copied"))
    level1 = cut(_elsewhere(_spots(docs, target), "short").select("ahead", "back", "th", "word"))
    release(df.sparkSession)
    sides = F.explode(F.array(F.struct(F.col("ahead").alias("long"), (F.col("word") * 2).alias("spot")), F.struct(F.col("back").alias("long"), (F.col("word") * 2 + 1).alias("spot"))))
    halves = level1.select("th", sides.alias("x")).select("x.long", "th", "x.spot").where("long is not null")
    level2 = apart(cut(_elsewhere(halves, "long")), "th", F.collect_set("spot").alias("spots"))
    # a text with copies is repeated throughout: its windows count for others, its own words need no list
    every = docs.join(copies, "th")
    left = _windows(every.where("not copied").join(level2, "th").select("id", "text", "th", "spots"), target)
    both = _windows(every.join(level2, "th").select("id", "text", "th", "spots"), target)
    removed = apart(_elsewhere(left, "h", both), "th", F.collect_set("word").alias("at"))
    return _cleaned(every.join(removed, "th", "left").select("id", "text", "th", "at", "copied"), target).withColumnRenamed("id", id_col)
