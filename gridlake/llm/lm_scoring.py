"""Language-model scores by masked pseudo-likelihood.

A small network sees the CONTEXT words on both sides of a masked word and predicts the word's class; within its class a
word has the chance that the corpus gives it. Every word of a text is masked in turn and the log-probabilities are
summed. All documents take part: word counts, and the network itself, which each task trains on its own texts from the
same start; the results are averaged by weight, round after round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Word classes: the commonest words have one of their own, all others share RARE by their hash.
FREQUENT, RARE = 96, 31
CLASSES = FREQUENT + RARE + 1  # the last one stands beyond the ends of a text
#: Cells that count words by hash: as many words as the corpus has share them, so that up to about a million have one of their own.
CELLS = 1 << 20
CONTEXT, WIDTH = 2, 12
ROUNDS = 2
#: One word in so many is masked in a round of training, another one each time: after so many rounds every word was.
MASK_EVERY = 2
BATCH, RATE = 1024, 0.3
#: Seed of the start that all tasks share.
SEED = 3
_FIELDS = ("embed", "out", "bias")


def start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {"embed": rng.normal(0, 0.3, (2 * CONTEXT, CLASSES, WIDTH)).astype(np.float32), "out": rng.normal(0, 0.1, (2 * CONTEXT * WIDTH, CLASSES - 1)).astype(np.float32), "bias": np.zeros(CLASSES - 1, np.float32)}


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in _FIELDS]).astype(np.float64)


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, like in start().items():
        out[k] = values[at : at + like.size].reshape(like.shape).astype(np.float32)
        at += like.size
    return out


def cells(words: np.ndarray) -> np.ndarray:
    return (words & tk.U64(CELLS - 1)).astype(np.int64)


class Vocabulary:
    """Classes of words, and the log chance of a word in its class, from counts over the corpus by cell."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(CELLS), -counts))[:FREQUENT]
        self.of = (FREQUENT + np.arange(CELLS) % RARE).astype(np.uint8)
        self.of[order] = np.arange(FREQUENT)
        # a cell without a word is no word; one that occurs nowhere else still has a chance
        smooth = np.where(counts > 0, counts + 0.5, 0.5)
        total = np.bincount(self.of, np.where(counts > 0, smooth, 0), CLASSES) + 0.5
        self.within = np.log(smooth / total[self.of]).astype(np.float32)
        self.prior = np.log((total + 1) / (total + 1).sum())[:-1].astype(np.float32)


def contexts(classes: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The classes around the words at, one column a place; the last class beyond the ends of the text."""
    text = np.searchsorted(first, at, "right") - 1
    out = np.empty((len(at), 2 * CONTEXT), np.int64)
    for j, d in enumerate([*range(-CONTEXT, 0), *range(1, CONTEXT + 1)]):
        there = at + d
        ok = (there >= first[text]) & (there < first[text + 1])
        out[:, j] = np.where(ok, classes[np.clip(there, 0, max(len(classes) - 1, 0))], CLASSES - 1)
    return out


def _softmax(net: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hidden layer, logits of the classes less the largest of their row, their exponentials, the sums of those by row)."""
    hidden = np.tanh(np.concatenate([net["embed"][j][around[:, j]] for j in range(2 * CONTEXT)], axis=1))
    z = hidden @ net["out"]
    z += net["bias"]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return hidden, z, e, e.sum(axis=1, keepdims=True)


def forward(net: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer, log-probabilities of the classes)."""
    hidden, z, _, total = _softmax(net, around)
    return hidden, z - np.log(total)


def log_chances(net: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of each target class."""
    _, z, _, total = _softmax(net, around)
    return z[np.arange(len(target)), target] - np.log(total[:, 0])


def step(net: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray, rate: float) -> None:
    hidden, _, slope, total = _softmax(net, around)
    slope /= total * len(target)
    slope[np.arange(len(target)), target] -= 1 / len(target)
    back = (slope @ net["out"].T) * (1 - hidden * hidden)
    net["out"] -= rate * (hidden.T @ slope)
    net["bias"] -= rate * slope.sum(axis=0)
    for j in range(2 * CONTEXT):
        hot = np.zeros((len(target), CLASSES), np.float32)
        hot[np.arange(len(target)), around[:, j]] = 1
        net["embed"][j] -= rate * (hot.T @ back[:, j * WIDTH : (j + 1) * WIDTH])


def word_counts(docs: DataFrame) -> np.ndarray:
    """Words of all texts by cell."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for _, _, t in tk.texts_of(b.column(0), lower=True):
                total += np.bincount(cells(t.word_hashes()), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    rows = docs.mapInArrow(tk.lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    out = np.zeros(CELLS)
    out[np.asarray(rows.column("cell").combine_chunks())] = np.asarray(rows.column("n").combine_chunks())
    return out


def targets(first: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """The words masked in round r of so many: each word of each text once in MASK_EVERY rounds, or once in all of them if those are fewer."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero((np.arange(len(text)) - first[text] + r) % min(MASK_EVERY, rounds) == 0)


def trained(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after so many rounds over all texts, with every word masked in at least one; what a task has learnt counts by the words it saw."""
    net = start()
    net["bias"] = vocabulary.prior.copy()
    for r in range(rounds):

        def run(batches, net=net, r=r):
            own, seen = {k: v.copy() for k, v in net.items()}, 0
            for b in batches:
                for _, _, t in tk.texts_of(b.column(0), lower=True):
                    words, first = t.word_hashes(), t.words[2]
                    kind = vocabulary.of[cells(words)].astype(np.int64)
                    at = targets(first, r, rounds)
                    for lo in range(0, len(at), BATCH):
                        some = at[lo : lo + BATCH]
                        step(own, contexts(kind, first, some), kind[some], RATE * min(1, len(some) / BATCH) / np.sqrt(1 + r))
                        seen += len(some)
            if seen:
                values = flat(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * seen), pa.array(np.full(len(values), float(seen)))], ["place", "value", "weight"])

        rows = docs.mapInArrow(tk.lean(run), "place int, value double, weight double").groupBy("place").agg(F.sum("value").alias("v"), F.sum("weight").alias("w")).toArrow()  # as many rows as the network has numbers
        if not rows.num_rows:
            break
        values = np.zeros(rows.num_rows)
        v, w = (np.asarray(rows.column(c).combine_chunks()) for c in ("v", "w"))
        values[np.asarray(rows.column("place").combine_chunks())] = v / w
        net = shaped(values)
    return net


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of df: id_col, n_words, log_prob (the sum over all words), mean_log_prob.

    Words are split at white space and lower-cased (A-Z). A null or empty text has no words, a sum of 0 and a null
    mean. Repeated rows and null ids give a row each and count as often as they occur; other columns are not read;
    an empty df gives no rows; a text of any length is read whole. What a task learns depends on the texts it holds, so scores follow
    the partitioning of df; for the same partitions sums come in any order, and scores agree to about 1e-6.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vocabulary = Vocabulary(word_counts(docs.select("text")))
    net = trained(docs.select("text"), vocabulary, rounds)

    def run(batches):
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(1), lower=True):
                words, first = t.word_hashes(), t.words[2]
                cell = cells(words)
                kind = vocabulary.of[cell].astype(np.int64)
                log = vocabulary.within[cell].astype(np.float64)
                for a in range(0, len(words), BATCH):
                    at = np.arange(a, min(a + BATCH, len(words)))
                    log[at] += log_chances(net, contexts(kind, first, at), kind[at])
                total = np.concatenate([[0.0], np.cumsum(log)])
                sums, n = total[first[1:]] - total[first[:-1]], np.diff(first)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sums), pa.array(sums / np.maximum(n, 1), mask=n == 0)], ["id", "n_words", "log_prob", "mean_log_prob"])

    kind = df.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(tk.lean(run), f"id {kind}, n_words long, log_prob double, mean_log_prob double").withColumnRenamed("id", id_col)
