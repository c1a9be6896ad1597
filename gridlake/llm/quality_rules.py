"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams that a text holds twice or more; a text fails
where too many of its characters lie inside them, or inside repeated lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: n-gram length: largest share of a text's word characters that repeated n-grams of it may cover.
COVERAGE = {4: 0.50, 6: 0.47, 10: 0.45}
#: Largest share of word characters in lines that repeat an earlier line.
LINE_COVERAGE = 0.30
#: Most symbols for each word character.
SYMBOL_SHARE = 0.10
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def measure(t: tk.Texts, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text, and the characters that repeated n-grams of each length and repeated lines cover."""
    starts, ends, first = t.words
    words, chars = t.word_hashes(), t.chars_before()
    size = chars[ends] - chars[starts]
    own = tk.mix(np.arange(t.n, dtype=np.uint64) + tk.U64(1))
    out = {"n_words": np.diff(first), "word_chars": tk.per_text(size, first)}
    symbol = _IS_SYMBOL[t.data]
    out["n_symbols"] = tk.per_text(symbol, t.off)
    for n in sorted({3, *lengths}):
        at, text, h = tk.window_hashes(words, first, n)
        inside = tk.covered(at[tk.repeated(h ^ own[text])], n, len(words))
        if n == 3:
            out["n_repeat_words"] = tk.per_text(inside, first)
        if n in lengths:
            out[f"cover_{n}"] = tk.per_text(size * inside, first)
    breaks = np.flatnonzero(t.data == 10)
    lo, hi = np.concatenate([t.off[:-1], breaks + 1]), np.concatenate([breaks, t.off[1:]])
    lo, hi = np.sort(lo), np.sort(hi)
    w_lo, w_hi = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    with_word = w_hi > w_lo
    lo, hi, w_lo, w_hi = lo[with_word], hi[with_word], w_lo[with_word], w_hi[with_word]
    text = np.searchsorted(t.off, lo, "right") - 1
    key = tk.span_hash(t.byte_prefix(), lo, hi, tk._BASE) ^ own[text]
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(text[again], minlength=t.n)
    total = np.concatenate([[0], np.cumsum(size)])
    out["cover_lines"] = np.bincount(text[again], (total[w_hi] - total[w_lo])[again], t.n).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray], coverage: dict[int, float], line_coverage: float, symbol_share: float, min_words: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(base_failed, kept, covered shares)."""
    n = m["n_words"]
    failed = (n < min_words) | (100 * m["n_repeat_words"] > 50 * n)
    kept = ~failed & (m["n_symbols"] <= symbol_share * m["word_chars"])
    limits = {f"cover_{k}": most for k, most in sorted(coverage.items())} | {"cover_lines": line_coverage}
    share = {k: m[k] / np.maximum(m["word_chars"], 1) for k in limits}
    for k, most in limits.items():
        kept &= share[k] <= most
    return failed, kept, share


def passing(df: DataFrame, text_col: str = "text", coverage: dict[int, float] | None = None, line_coverage: float = LINE_COVERAGE, symbol_share: float = SYMBOL_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """df, with all its columns, without the rows that repetition_coverage() does not keep."""
    coverage, at = COVERAGE if coverage is None else coverage, df.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [verdict(measure(t, tuple(coverage)), coverage, line_coverage, symbol_share, min_words)[1] for _, _, t in tk.texts_of(b.column(at))]
            yield b.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return df.mapInArrow(tk.lean(run), df.schema)


def repetition_coverage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: dict[int, float] | None = None, line_coverage: float = LINE_COVERAGE, symbol_share: float = SYMBOL_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of df: id_col, the counts, the covered shares, base_failed and kept.

    A null or empty text has no words and fails. Rows with equal or null ids are judged one by one;
    other columns of df, whatever their names, play no part. An empty df gives no rows.
    The rows are not moved: one pass over the scan, without a shuffle.
    """
    coverage = COVERAGE if coverage is None else coverage
    lengths = tuple(sorted(coverage))
    kind = df.schema[id_col].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    shares = [f"cover_{n}" for n in lengths] + ["cover_lines"]

    def run(batches):
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(1)):
                m = measure(t, lengths)
                failed, kept, share = verdict(m, coverage, line_coverage, symbol_share, min_words)
                cols = [b.column(0).slice(lo, hi - lo), *(pa.array(m[k], pa.int64()) for k in counts), pa.array(failed), pa.array(kept), *(pa.array(share[k]) for k in shares)]
                yield pa.RecordBatch.from_arrays(cols, ["id", *counts, "base_failed", "kept", *shares])

    schema = f"id {kind}, {', '.join(f'{k} long' for k in counts)}, base_failed boolean, kept boolean, {', '.join(f'{k} double' for k in shares)}"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tk.lean(run), schema).withColumnRenamed("id", id_col)
