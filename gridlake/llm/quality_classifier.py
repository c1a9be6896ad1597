"""Quality classifier by positive-unlabelled learning.

A model over figures of the text is fitted to trusted positives and unlabelled texts by the non-negative unbiased
risk: pi * R(positive as 1) + max(0, R(unlabelled as 0) - pi * R(positive as 0)), with pi the share of positives
estimated from the labelled rows. The output is then set to the scale of the labelled rows by a logistic curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Labelled rows, and unlabelled rows, that the model is fitted on at most: those that come first in hash order.
LABELLED, UNLABELLED = 20_000, 20_000
THRESHOLD = 0.7
#: Quantiles that part a figure's bins: close together at the ends, where what is odd lies.
EDGES = (0.01, 0.05, 0.2, 0.5, 0.8, 0.9, 0.95, 0.98, 0.995)
BINS = len(EDGES)
SEED = 11

_UPPER, _LETTER, _DIGIT, _MARK, _SYMBOL, _STOP = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_MARK[list(b"!?")] = True
_SYMBOL[list(b"#*$%&|<>@~^=_{}[]\\/")] = True
_STOP[list(b".")] = True
FIGURES = ("words", "word_length", "upper", "digit", "mark", "symbol", "stop", "lines", "line_length", "distinct", "run", "repeat3", "dup_lines", "longest", "ends_open", "one_letter")


def figures(t: tk.Texts) -> np.ndarray:
    """A row of FIGURES for each text; zeros where it has no words."""
    starts, ends, first = t.words
    n = np.diff(first)
    some, chars = np.maximum(n, 1), np.maximum(np.diff(t.off), 1)
    share = lambda table: tk.per_text(table[t.data], t.off) / chars
    words = t.word_hashes()
    text = np.repeat(np.arange(t.n), n)
    own = tk.mix(np.arange(t.n, dtype=np.uint64) + tk.U64(1))
    distinct = np.bincount(text[np.unique(words ^ own[text], return_index=True)[1]], minlength=t.n)
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    at, of, h = tk.window_hashes(words, first, 3)
    repeat3 = np.bincount(of[tk.repeated(h ^ own[of])], minlength=t.n)
    breaks = np.flatnonzero(t.data == 10)
    lo, hi = np.sort(np.concatenate([t.off[:-1], breaks + 1])), np.sort(np.concatenate([breaks, t.off[1:]]))
    line_of = np.minimum(np.searchsorted(t.off, lo, "right") - 1, t.n - 1)
    lines = np.bincount(line_of, minlength=t.n)
    dup = np.bincount(line_of[tk.repeated(tk.span_hash(t.byte_prefix(), lo, hi, tk._BASE) ^ own[line_of])], minlength=t.n)
    size = ends - starts
    longest = np.zeros(t.n)
    np.maximum.at(longest, text, size)
    tail = np.zeros(t.n)
    full = np.flatnonzero(n)
    tail[full] = _LETTER[t.data[ends[first[full + 1] - 1] - 1]]
    cols = [np.log1p(n), tk.per_text(size, first) / some, share(_UPPER), share(_DIGIT), share(_MARK), share(_SYMBOL), share(_STOP), np.log1p(lines), n / lines, distinct / some, tk.per_text(same, first) / some, repeat3 / some, dup / lines, np.minimum(longest, 60), tail, tk.per_text(size == 1, first) / some]
    return np.stack(cols, axis=1) * (n > 0)[:, None]


class Model:
    """Bins of figures, a weight for each bin, and the curve to the labelled rows' scale."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, curve: tuple[float, float]):
        self.edges, self.weights, self.curve = edges, weights, curve

    def _places(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") + j * (BINS + 1) for j, (e, c) in enumerate(zip(self.edges, x.T, strict=True))], axis=1)

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self._places(x)].sum(axis=1) + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self._raw(x) + b, -30, 30)))

    @classmethod
    def fit(cls, positive: np.ndarray, negative: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, rate: float = 0.02) -> Model:
        """positive and negative: labelled rows; the risk itself uses positive and unlabelled."""
        if not len(positive) or not len(unlabelled):
            return cls(np.zeros((len(FIGURES), BINS)), np.zeros(len(FIGURES) * (BINS + 1) + 1), (1.0, 0.0))
        prior = len(positive) / (len(positive) + len(negative))
        prior = min(max(prior, 0.02), 0.98)
        pool = np.concatenate([positive, unlabelled])
        model = cls(np.stack([np.quantile(pool[:, j], EDGES) for j in range(pool.shape[1])]), np.zeros(pool.shape[1] * (BINS + 1) + 1), (1.0, 0.0))
        p, u = model._places(positive), model._places(unlabelled)
        m, v, w = np.zeros_like(model.weights), np.zeros_like(model.weights), model.weights
        rng = np.random.default_rng(SEED)

        def grad(places, slope):
            g = np.zeros_like(w)
            np.add.at(g, places.ravel(), np.repeat(slope, places.shape[1]))
            g[-1] = slope.sum()
            return g / len(places)

        for step in range(1, steps + 1):
            a, b = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 512)]
            sp, su = (1 / (1 + np.exp(-np.clip(w[x].sum(axis=1) + w[-1], -30, 30))) for x in (a, b))
            # sigmoid loss: 1 - s for label 1, s for label 0; its slope is s (1 - s)
            as_one, as_zero, other = grad(a, -sp * (1 - sp)), grad(a, sp * (1 - sp)), grad(b, su * (1 - su))
            rest = su.mean() - prior * sp.mean()
            g = prior * as_one + (other - prior * as_zero) if rest >= 0 else -(other - prior * as_zero)
            g = g + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x = model._raw(np.concatenate([positive, negative]))
        y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
        c, o = 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(200):  # Newton steps of the logistic curve
            s = 1 / (1 + np.exp(-np.clip(c * x + o, -30, 30)))
            d, h = s - target, np.maximum(s * (1 - s), 1e-6)
            hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
            move = np.linalg.solve(hess, [(d * x).sum(), d.sum()])
            c, o = c - np.clip(move[0], -1, 1), o - np.clip(move[1], -1, 1)
        model.curve = (c, o)
        return model


def _figured(df: DataFrame, extra: str, kind: str) -> DataFrame:
    """(extra, x) of (extra, text)."""

    def run(batches):
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(1)):
                x = figures(t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(x.tolist(), pa.list_(pa.float64()))], [extra, "x"])

    return df.mapInArrow(tk.lean(run), f"{extra} {kind}, x array<double>")


def remainder(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``; 0 for a null id."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(of))


def fitted(df: DataFrame, labels: DataFrame, held_out, id_col: str, text_col: str, label_col: str) -> Model:
    """The model, from labels of rows that are not held_out. Of the labelled and of all such rows, the first in hash
    order are taken, up to LABELLED and UNLABELLED: sets of ids of a fixed size, which is what is broadcast. Of several labels of an
    id the least counts, of several rows with an id the one with the least figures."""
    first = lambda d, n: d.where(~held_out & F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(SEED)), id_col).limit(n)
    known = first(labels.select(id_col, F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").groupBy(id_col).agg(F.min("label").alias("label")), LABELLED)
    loose = first(df.select(id_col).distinct(), UNLABELLED).join(known.select(id_col), id_col, "left_anti").withColumn("label", F.lit(-1))
    docs = df.select(F.col(id_col), F.col(text_col).alias("text"))
    ids = known.union(loose)
    kind = df.schema[id_col].dataType.simpleString()
    one = _figured(docs.join(F.broadcast(ids.select(id_col)), id_col).select(F.col(id_col).alias("id"), "text"), "id", kind).groupBy("id").agg(F.min("x").alias("x"))
    rows = one.join(F.broadcast(ids.withColumnRenamed(id_col, "id")), "id").select("label", "x").toArrow()
    label = np.asarray(rows.column("label").combine_chunks())
    x = np.array(rows.column("x").to_pylist()).reshape(len(label), len(FIGURES))
    order = np.lexsort((*x.T[::-1], label))  # the same rows in the same order, however they arrived
    label, x = label[order], x[order]
    return Model.fit(x[label == 1], x[label == 0], np.concatenate([x[label == -1], x[label >= 0]]))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", of: int = 4, out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of df: id_col, held_out (crc32 of the id modulo ``of`` is ``out``), score, predicted.

    Only labels of rows that are not held out are learnt, and only the text is scored. A null or empty text scores as a
    text without words. Null labels and ids are not learnt from; with no positive label every score is 0.5.
    Repeated rows each get a row; other columns are not read; an empty df gives no rows.
    """
    held = remainder(id_col, of) == out
    model = fitted(df, labels, held, id_col, text_col, label_col)

    def run(batches):
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(2)):
                s = model.score(figures(t))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(tk.lean(run), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
