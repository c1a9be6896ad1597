"""Toxicity by noisy-channel deobfuscation.

Tokens that look disguised (digits or signs next to letters, letters repeated, letters set apart) become character
lattices: a sign may stand for a letter or for nothing, a repeated letter for one, a space between single letters for
nothing or for the end of a word. Viterbi decoding under a language model picks the likeliest words: known words by
how often the corpus has them, any other by a character model; both are counted over every text. The restored words,
and their beginnings, are then scored with weights learnt from every labelled row that is not held out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import discard, release, shared_folder, table
from .jaccard_join import _thinned
from .quality_classifier import remainder

#: Chance that any feature at all is taken for a toxic one by accident.
ALPHA = 0.01
#: Features kept at most, the most telling first.
LEXICON = 20_000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5

#: What a sign may stand for.
LEET = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "il", "!": "i", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
GAPS = ".-_*~'`, "
#: Of these, what also stands around plain words; other signs are cut off from the ends of a token.
AROUND = "(!|+"
_ENDS = ".,;:?\"')[]{}<>*#%&~`_-^=/\\"
#: Log probabilities of the channel: a sign for a letter, a gap or a repeated letter for nothing, a sign left out, a
#: space for the end of a word.
SUBSTITUTE, SKIP, DROP, END = -0.7, -0.4, -6.0, -1.1
#: Log probability of a word that is not known. Known are words of up to KNOWN_BYTES, the commonest KNOWN.
OTHER = -5.0
KNOWN, KNOWN_BYTES = 100_000, 32
#: What is behind a disguised word is kept for so many words of up to KEPT_BYTES; others are decoded as they come.
KEPT, KEPT_BYTES = 200_000, 64
#: A token of letters alone with up to so many forms, its repeated letters left or taken for fewer, needs no lattice.
FORMS = 16
_SIZE = 28

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_LETTER = _CODE > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in (*LEET, *GAPS) if c != " "]] = True
_SIGNS, _AROUND = frozenset(LEET), frozenset(AROUND)
_LETTERS = re.compile("[a-z\x80-\U0010ffff]+").fullmatch
_RUNS = re.compile(r"(.)\1+", re.DOTALL).finditer
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True
_PLAIN = tk.LOWER.copy()
_PLAIN[[i for i in range(128) if not chr(i).isalpha()]] = 32
#: Bytes of the character that a byte begins.
_BYTES = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)


def _forms(token: str) -> list[str]:
    """The token with each run of a letter as long as it is or shorter; nothing if these are more than FORMS."""
    forms, at = [""], 0
    for run in _RUNS(token):
        a, b = run.span()
        if len(forms) * (b - a) > FORMS:
            return []
        forms = [f + token[at:a] + token[a] * k for f in forms for k in range(b - a, 0, -1)]
        at = b
    return [f + token[at:] for f in forms]


class Speller:
    """Viterbi over a token's lattice under known words and character trigrams."""

    def __init__(self, counts: np.ndarray, words: dict[str, int] | None = None):
        c = counts.reshape(_SIZE, _SIZE, _SIZE) + 0.05
        self._logs = np.log(c / c.sum(axis=2, keepdims=True)).ravel()
        self.log = self._logs.tolist()
        words = words or {}
        n = np.array(list(words.values()), np.int64)
        self.words = dict(zip(words, (np.log(n) - np.log(max(int(n.sum()), 1))).tolist(), strict=True))
        self.begun: set[str] = set()
        for w in self.words:
            while w and w not in self.begun:
                self.begun.add(w)
                w = w[:-1]
        self._ways: dict[tuple[str, bool, bool], list[tuple[str, float, int]]] = {}
        self._kept: dict[bytes, str] = {}

    def behind(self, words: Collection[bytes]) -> list[str]:
        """For each word all words that its shapes stand for, in one string."""
        new = [w for w in words if w not in self._kept]
        if len(self._kept) + len(new) > KEPT:
            self._kept, new = {}, list(words)
        shapes = [_shapes(w) for w in new]
        spelt = iter(_words_behind([x for own in shapes for x in own], self))
        now = {w: " ".join([next(spelt) for _ in own]) for w, own in zip(new, shapes, strict=True)}
        out = [now[w] if w in now else self._kept[w] for w in words]
        if len(now) <= KEPT:
            self._kept |= {w: x for w, x in now.items() if len(w) <= KEPT_BYTES}
        return out

    def restore_all(self, tokens: list[str]) -> list[str]:
        """What restore gives for each token. Of tokens of letters alone, all forms are weighed together, not in a lattice each."""
        out, forms, of = [], [], []
        for w in tokens:
            own = _forms(w) if _LETTERS(w) else []
            if len(own) > 1:
                forms += own
                of += [len(out)] * len(own)
            out.append(w if own else self.restore(w))
        if not forms:
            return out
        c = np.frombuffer("".join(f"{f}\n" for f in forms).encode("utf-32-le"), np.uint32).astype(np.int64)
        c = np.where(c == 10, 0, np.where(c < 128, c - 96, 27))
        size, of = np.array([len(f) for f in forms]), np.array(of)
        start = np.concatenate([[0], c[:-1]])
        before = np.concatenate([[0, 0], c[:-2]]) * (start > 0)
        other = OTHER + np.add.reduceat(self._logs[(before * _SIZE + start) * _SIZE + c], np.cumsum(size + 1) - size - 1)
        known = np.array([self.words.get(f, -np.inf) for f in forms])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        many = np.diff(first, append=len(of))
        score = np.maximum(known, other) + SKIP * (np.repeat(size[first], many) - size)  # the longest form is the token
        best = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, first), many))
        for k in best[::-1].tolist():
            out[of[k]] = forms[k]
        return out

    def _ended(self, state) -> float | None:
        """Log probability that a word ends in this state, None where none can."""
        if isinstance(state, str):
            return self.words.get(state) if state else 0.0
        return self.log[state * _SIZE]

    def _read(self, ch: str, again: bool, whole: bool) -> list[tuple[str, float, int]]:
        """(letter, a space or nothing, log probability, letter's place) for what a character may stand for; again: it repeats a letter."""
        ways: list[tuple[str, float]] = []
        if ch == "\n":
            ways.append((" ", 0.0))
        elif "a" <= ch <= "z" or ch >= "\x80":
            ways.append((ch, 0.0))
            if again:
                ways.append(("", SKIP))
        ways += [(x, SUBSTITUTE) for x in LEET.get(ch, "")]
        if ch == " ":
            ways.append((" ", END))
        if ch in GAPS:
            ways.append(("", SKIP))
        elif not ways or ch in LEET and not whole:
            ways.append(("", DROP))
        return [(x, cost, ord(x) - 96 if "a" <= x <= "z" else 27) for x, cost in ways]

    def restore(self, token: str, whole: bool = False) -> str:
        """The likeliest words behind a lower-case token of any length; a line break in it ends a word for certain.

        Where whole is set, every sign that may stand for a letter does.
        """
        # a state is what there is of a known word, or the last two letters of another one (as one number); what was read is a
        # chain of (chain before, letter)
        log, begun, kept = self.log, self.begun, self._ways
        best: dict[object, tuple[float, tuple | None]] = {"": (0.0, None)}
        last = ""
        for ch in token:
            key = (ch, ch == last, whole)
            ways = kept.get(key)
            if ways is None:
                ways = kept[key] = self._read(*key)
            if ch not in GAPS and ch != "\n":
                last = ch
            new: dict[object, tuple[float, tuple | None]] = {}
            for state, (score, chain) in best.items():
                known = isinstance(state, str)
                for x, cost, k in ways:
                    if not x:
                        if state not in new or score + cost > new[state][0]:
                            new[state] = (score + cost, chain)
                    elif x == " ":
                        if (end := self._ended(state)) is not None and ("" not in new or score + cost + end > new[""][0]):
                            new[""] = (score + cost + end, (chain, x))
                    elif known:
                        if (to := state + x) in begun and (to not in new or score + cost > new[to][0]):
                            new[to] = (score + cost, (chain, x))
                        if not state and (k not in new or score + cost + OTHER + log[k] > new[k][0]):
                            new[k] = (score + cost + OTHER + log[k], (chain, x))
                    else:
                        to, now = state % _SIZE * _SIZE + k, score + cost + log[state * _SIZE + k]
                        if to not in new or now > new[to][0]:
                            new[to] = (now, (chain, x))
            best = new
        ends = [(score + end, chain) for state, (score, chain) in best.items() if (end := self._ended(state)) is not None]
        chain = max(ends, key=lambda x: x[0])[1]
        out = []
        while chain:
            chain, x = chain
            out.append(x)
        return "".join(reversed(out))


_spellers: dict[str, Speller] = {}


def _speller(key: str, counts: np.ndarray, words: dict[str, int]) -> Speller:
    """The Speller of one fit, which a worker builds once for all its tasks, so that it decodes a word once. It keeps the last one only."""
    if key not in _spellers:
        _spellers.clear()
        _spellers[key] = Speller(counts, words)
    return _spellers[key]


def known_words(df: DataFrame) -> dict[str, int]:
    """How often the texts of the column text have each word: the commonest KNOWN of those that occur three times."""

    def run(batches):
        for b in batches:
            for _, _, t in tk.texts_of(b.column(0)):
                t = tk.Texts(_PLAIN[t.data], t.off)
                starts, ends, _ = t.words
                one = np.concatenate([[False], ends - starts == 1, [False]])
                apart = one[1:-1] & (one[:-2] | one[2:])  # letters set apart are no words
                own = np.flatnonzero((ends - starts <= KNOWN_BYTES) & ~apart)
                _, at, n = np.unique(t.word_hashes()[own], return_index=True, return_counts=True)
                raw = t.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[starts[i] : ends[i]].decode() for i in own[at].tolist()], pa.string()), pa.array(n, pa.int64())], ["w", "n"])

    rows = df.mapInArrow(tk.lean(run), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n >= 3")
    return {r["w"]: r["n"] for r in rows.orderBy(F.desc("n"), "w").limit(KNOWN).collect()}


def trigrams(df: DataFrame) -> np.ndarray:
    """Counts of character trigrams over every text of the column text; what is not a letter ends a word."""

    def run(batches):
        _spellers.clear()  # those of an earlier fit
        total = np.zeros(_SIZE**3, np.int64)
        for b in batches:
            for _, _, t in tk.texts_of(b.column(0)):
                c = _CODE[t.data]
                if len(c) > 2:
                    start = np.concatenate([[0], c[:-1]])
                    before = np.concatenate([[0, 0], c[:-2]]) * (start > 0)
                    total += np.bincount((before * _SIZE + start) * _SIZE + c, minlength=_SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(_SIZE**3)
    for r in df.mapInArrow(tk.lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 28**3 rows
        out[r["cell"]] = r["n"]
    out[0] = 0  # nothing after nothing
    return out


def _spread(of: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in of, place in groups) for each member of the groups of; groups of so many stand one after another."""
    many = count[of]
    place = np.repeat(np.arange(len(of)), many)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + (np.cumsum(count) - count)[of][place]


def _shapes(word: bytes) -> list[str]:
    """A word in lower case, with and without signs AROUND its ends."""
    token = word.decode().lower().strip(_ENDS)
    if len(token) < 2:
        return []
    if token[0] not in _AROUND and token[-1] not in _AROUND:
        return [token]
    return sorted(x for x in {token, token.lstrip(AROUND), token.rstrip(AROUND), token.strip(AROUND + _ENDS)} if len(x) > 1)


def disguised(t: tk.Texts, speller: Speller | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tokens, text, token) of the tokens that look disguised, in lower case, with and without signs AROUND their ends.

    Letters set apart come twice: in one, and with spaces, a line break where there is more space than elsewhere.
    With a speller, the words behind them stand for the tokens.
    """
    starts, ends, first = t.words
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = t.data
    size = ends - starts
    letter = _LETTER[data]
    near = np.zeros(len(data) + 1, bool)
    near[:-1] = letter | ((data >= 48) & (data < 58))
    gap = _SIGN[data] & near[1:]
    gap[ends - 1] = False
    lower = tk.LOWER[data]
    double = np.zeros(len(data), bool)
    double[:-1] = letter[:-1] & (lower[:-1] == lower[1:]) & (data[:-1] < 128)
    double[ends - 1] = False
    has = lambda x: np.logical_or.reduceat(x, starts)  # noqa: E731  # up to the next word: white space is no letter and not odd
    text = np.repeat(np.arange(t.n), np.diff(first))
    raw = data.tobytes()
    picked = np.flatnonzero(has(gap | _LEET[data] | double) & has(letter))
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts[picked].tolist(), ends[picked].tolist(), strict=True)], np.int64)
    shapes = [[x] for x in speller.behind(seen)] if speller else [_shapes(w) for w in seen]
    tokens = [x for own in shapes for x in own]
    place, token = _spread(which, np.array([len(own) for own in shapes], np.int64))
    apart, spaced = [], []
    single = (size == _BYTES[data[starts]]) & (letter[starts] | _SIGN[data[starts]])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    some = np.flatnonzero(edge[1::2] - edge[::2] > 1)
    for lo, hi in zip(edge[::2][some].tolist(), edge[1::2][some].tolist(), strict=True):
        cuts = [lo, *(np.flatnonzero(np.diff(text[lo:hi])) + lo + 1).tolist(), hi]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1 and letter[starts[a:b]].any():
                own = [raw[starts[i] : ends[i]].decode().lower() for i in range(a, b)]
                wide = starts[a + 1 : b] - ends[a : b - 1]
                gaps = np.where(wide > wide.min(), "\n", " ").tolist()
                apart.append(int(text[a]))
                spaced += ["".join(own), "".join(x for pair in zip(own, [*gaps, ""], strict=True) for x in pair)]
    tokens += _words_behind(spaced, speller) if speller else spaced
    new = np.arange(len(tokens) - 2 * len(apart), len(tokens))
    return tokens, np.concatenate([text[picked][place], np.repeat(np.array(apart, np.int64), 2)]), np.concatenate([token, new])


def _words_behind(tokens: list[str], speller: Speller) -> list[str]:
    out = speller.restore_all(tokens)
    return [x if _SIGNS.isdisjoint(w) else " ".join({x, speller.restore(w, True)}) for w, x in zip(tokens, out, strict=True)]


def restored(t: tk.Texts, speller: Speller) -> list[str]:
    """Each text in plain letters, followed by the words that its disguised tokens stand for: all that its features need."""
    words, of, token = disguised(t, speller)
    raw = _PLAIN[t.data].tobytes()
    parts = [[raw[a:b].decode()] for a, b in zip(t.off[:-1].tolist(), t.off[1:].tolist(), strict=True)]
    pair = np.unique(of * len(words) + token)
    for i, k in zip(*(x.tolist() for x in np.divmod(pair, max(len(words), 1))), strict=True):
        parts[i].append(words[k])
    return [" ".join(x) for x in parts]


def features(t: tk.Texts, speller: Speller | None, among=None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) once each: hashes of the words and of their first letters, with disguised words restored.

    Without a speller nothing is restored: for texts that restored gave. among(features) tells which are wanted, if not all.
    """
    words, of, token = disguised(t, speller) if speller else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    plain = tk.Texts(_PLAIN[t.data], t.off)
    parts = [_hashed(plain)]
    if words:
        data = [x.encode() for x in words]
        extra = tk.Texts(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
        own, h = _hashed(extra)
        order = np.argsort(own, kind="stable")
        pair = np.unique(of * len(words) + token)
        place, at = _spread(pair % len(words), np.bincount(own, minlength=len(words)))
        parts.append(((pair // len(words))[place], h[order][at]))
    text, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    if among is not None:
        wanted = among(h)
        text, h = text[wanted], h[wanted]
    own = tk.mix(text.astype(np.uint64) + tk.U64(1))
    keep = np.unique(h ^ own, return_index=True)[1]
    return text[keep], h[keep]


def _hashed(t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = t.words
    text = np.repeat(np.arange(t.n), np.diff(first))
    chars, places = t.chars_before(), np.append(np.flatnonzero((t.data & 0xC0) != 0x80), len(t.data))
    pre = t.byte_prefix()
    out = [(text, tk.span_hash(pre, starts, ends, tk._BASE))]
    size = chars[ends] - chars[starts]
    for k in PREFIXES:
        long = np.flatnonzero(size > k)
        stop = places[chars[starts[long]] + k]
        out.append((text[long], tk.mix(tk.span_hash(pre, starts[long], stop, tk._BASE) ^ tk.U64(k))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Scorer:
    """Weights of telling features, and the curve from their sum to a score."""

    def __init__(self, speller: Speller | None, keys: np.ndarray, weights: np.ndarray, curve: tuple[float, float] = (1.0, 0.0)):
        order = np.argsort(keys)
        self.speller, self.keys, self.weights, self.curve, self._low = speller, keys[order], weights[order], curve, None

    def _weighed(self, h: np.ndarray) -> np.ndarray:
        """Places of the features that have a weight; most are told by their low bits."""
        if self._low is None:  # in a worker, so that it is not sent there
            self._low = np.zeros(1 << 20, bool)
            self._low[(self.keys & tk.U64(0xFFFFF)).astype(np.int64)] = True
        some = np.flatnonzero(self._low[(h & tk.U64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        return some[self.keys[at] == h[some]]

    def evidence(self, t: tk.Texts) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(t.n)
        text, h = features(t, self.speller, self._weighed)
        return np.bincount(text, self.weights[np.searchsorted(self.keys, h)], t.n).astype(float)  # whole numbers where nothing is hit

    def score(self, t: tk.Texts) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.minimum(self.evidence(t), 40) + b, -30, 30)))


def _log_choose(n, k):
    from math import lgamma

    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def telling(n: int, toxic: int, share: float, among: int) -> bool:
    """Whether toxic of n texts is more than accident allows at this share of toxic texts, among so many features."""
    if toxic <= share * n:
        return False
    k = np.arange(toxic, min(n, toxic + 200) + 1)
    log = np.array([_log_choose(n, int(i)) for i in k]) + k * np.log(share) + (n - k) * np.log1p(-share)
    return float(np.exp(log).sum()) * among < ALPHA


def fitted(df: DataFrame, labels: DataFrame, held_out, id_col: str, text_col: str, label_col: str) -> Scorer:
    docs = df.select(F.col(id_col), F.col(text_col).alias("text"))
    speller_counts = trigrams(docs.select("text"))
    known = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(~held_out & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("label").alias("label"))  # of several labels the least
    known = known.withColumn(id_col, F.col(id_col).cast(df.schema[id_col].dataType))
    words = known_words(docs.select("text"))
    release(df.sparkSession)

    fit = uuid.uuid4().hex

    def spelt(batches):
        speller = _speller(fit, speller_counts, words)
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(restored(t, speller), pa.string())], ["label", "text"])

    h = F.xxhash64(id_col).alias("gridlake_h")
    folder = f"{shared_folder(df.sparkSession)}/toxicity-{fit}"
    # of all labelled rows the texts, moved, restored and written once; few others are moved with them. Labels grow with the
    # input, so that they are not broadcast at any size
    some = _thinned(docs.select(id_col, "text", h), "gridlake_h", known.select(h)).join(known.hint("merge"), id_col).select("label", "text")
    release(df.sparkSession)  # the words' files go with the second collection only, a job after the first
    some = table(some.mapInArrow(tk.lean(spelt), "label int, text string"), f"{folder}/labelled")
    release(df.sparkSession)

    def counted(batches):
        for b in batches:
            label = np.asarray(b.column(0))
            for lo, _, t in tk.texts_of(b.column(1)):
                text, h = features(t, None)
                key, at = np.unique(h, return_inverse=True)
                toxic = np.bincount(at, label[lo + text]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at)), pa.array(toxic), pa.array(np.zeros(len(key), np.int64))], ["h", "n", "toxic", "texts"])
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([int(label.sum())]), pa.array([len(label)])], ["h", "n", "toxic", "texts"])

    counts = some.mapInArrow(tk.lean(counted), "h long, n long, toxic long, texts long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "texts")))
    # a feature in under three toxic texts, or no more toxic than the rest, can't tell anything
    rows = counts.where("texts > 0 or toxic >= 3 and toxic * 3 > n").orderBy(F.desc("texts"), F.desc(F.col("toxic") * F.col("toxic") / F.greatest("n", F.lit(1))), "h").limit(LEXICON * 4).collect()
    texts, toxics = sum(r["texts"] for r in rows), sum(r["toxic"] for r in rows if r["texts"])
    share = min(max(toxics / max(texts, 1), 1e-4), 0.5)
    among = max(1000, len(rows) * 50)
    keep = [r for r in rows if not r["texts"] and telling(r["n"], r["toxic"], share, among)][:LEXICON]
    keys = np.array([r["h"] for r in keep], np.int64).view(np.uint64)
    rest = max(texts - toxics, 1)
    weights = np.array([np.log((r["toxic"] + 0.5) / (toxics + 1)) - np.log((r["n"] - r["toxic"] + 0.5) / (rest + 1)) for r in keep])
    scorer = Scorer(None, keys, weights)

    def weighed(batches):
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.minimum(scorer.evidence(t), 40))], ["label", "x"])

    curve = some.mapInArrow(tk.lean(weighed), "label int, x double").groupBy("label", F.round("x", 1).alias("x")).agg(F.count("*").alias("n")).collect()  # at most 802 rows
    discard(df.sparkSession, folder)
    x, y, n = (np.array([float(r[c]) for r in curve]) for c in ("x", "label", "n"))
    a, b = 1.0, -3.0
    for _ in range(200 if len(curve) else 0):
        s = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = n * np.maximum(s * (1 - s), 1e-6)
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        move = np.linalg.solve(hess, [(n * (s - y) * x).sum() + 0.1 * (a - 1), (n * (s - y)).sum()])
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    scorer.curve = (max(a, 0.0), b)
    scorer.fit, scorer.counts, scorer.words = fit, speller_counts, words
    return scorer


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", of: int = 5, out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of df: id_col, held_out (crc32 of the id modulo ``of`` is ``out``), score, predicted.

    Only labels of rows that are not held out are learnt, and only the restored text is scored. A null or empty text
    scores as one without evidence. Null labels and ids are not learnt from; without labels every text scores the same,
    under the threshold. Repeated rows each get a row; other columns are not read; an empty df gives no rows.
    """
    held = remainder(id_col, of) == out
    scorer = fitted(df, labels, held, id_col, text_col, label_col)

    def run(batches):
        scorer.speller = _speller(scorer.fit, scorer.counts, scorer.words)
        for b in batches:
            for lo, hi, t in tk.texts_of(b.column(2)):
                s = scorer.score(t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(tk.lean(run), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
