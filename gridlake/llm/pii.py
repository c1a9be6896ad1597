"""Personal data by a skip-chain conditional random field over patterns.

Base spans come from patterns with exact rules. The field's nodes are the base spans, whose labels are observed, and between
them the tokens that hold a digit or an at sign, runs of number tokens in one. Values that are given to the name of a secret
are observed too. Neighbouring nodes share a chain potential; a node shares a skip potential with the last and with the first
node of the same or a contained normal form, however far apart; loopy belief propagation spreads the labels over the
document until they settle. Nodes that end up as personal data with a belief of CONFIDENT or more become further spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .sample import sampled_texts

#: Kinds of base spans; what the field may add besides; and how labels are numbered: 0 is none of them.
BASE, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "secret")
LABELS = ("other", *KINDS)
#: Documents that the field is fitted on, about; and the longest of them, in characters.
FIT_DOCUMENTS, FIT_CHARS = 1000, 20_000
CONFIDENT = 0.6
#: Messages are passed until none moves by more than SETTLED, ROUNDS times at most: a loop may swing for ever.
ROUNDS, SETTLED = 200, 1e-3
#: Characters that two normal forms share at least where one contains the other.
SHARED = 7
#: Places of features.
PLACES = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_NUMBER = re.compile(r"\+?[0-9().-]*[0-9][0-9().-]*")
#: Names that secrets are given to.
_SECRET = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?([A-Za-z0-9+/_.=-]{12,})")
_DIGIT = re.compile(r"[0-9]")
_EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches without overlap: an at sign takes all local characters before it that no match has taken."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            taken = m.end()
        at = text.find("@", max(at + 1, taken))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kind as a place in KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _nodes(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, list[bool]]:
    """Nodes (start, end) in order, the label that is observed of each, else 0, and whether it is a base span (of overlapping ones the
    first). Tokens are taken between base spans, without punctuation at their ends; numbers with one space between them are one."""
    at: list[tuple[int, int]] = []
    label: list[int] = []
    base: list[bool] = []
    secret, taken, end = len(BASE), [], 0
    for s, k, e in sorted([*spans, *((m.start(1), secret, m.end(1)) for m in _SECRET.finditer(text))], key=lambda x: (x[0], x[1])):
        if s >= end:
            taken.append((s, k, e))
            end = e
        elif k < secret:
            while taken and taken[-1][1] == secret and taken[-1][2] > s:  # a base span takes the place of a value it overlaps
                taken.pop()
            if not taken or s >= taken[-1][2]:
                taken.append((s, k, e))
            end = max(end, e)
    edges, end = [], 0
    for s, k, e in taken:
        edges.append((end, s, k, e))
        end = e
    for begin, stop, k, e in [*edges, (end, len(text), -1, -1)]:
        number = False
        for m in _TOKEN.finditer(text, begin, stop):
            s, t = m.span()
            while s < t and text[s] in _EDGE and not (text[s] == "(" and t - s > 1 and text[s + 1].isdigit()):
                s += 1
            while t > s and text[t - 1] in _EDGE:
                t -= 1
            if s == t:
                continue
            now = _NUMBER.fullmatch(text, s, t) is not None
            if now and number and s - at[-1][1] == 1 and text[s - 1] == " " and text[s] != "+":
                at[-1] = (at[-1][0], t)
            else:
                at.append((s, t))
                label.append(0)
                base.append(False)
            number = now
        if k >= 0:
            at.append((stop, e))
            label.append(k + 1)
            base.append(k < secret)
    return at, np.array(label, np.int64), base


def _features(text: str, s: int, e: int, hidden: bool = False) -> list[int]:
    """Places of the node's features: its shape, sizes and the words around it. hidden: without what only the base rules look at."""
    token = text[s:e]
    shape = re.sub(r"(.)\1+", r"\1", "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in token))[:64]
    opaque = re.sub(r"([ad])(?:[ad])*", "x", shape) if len(token) > 15 else shape  # letters and digits mixed at will
    n = len(_digits(token))
    before, after = text[max(0, s - 64) : s].lower().split()[-2:], text[e : e + 64].lower().split()[:1]
    names = [f"digits {min(n, 20)}", f"at {token.count('@')}", f"dots {min(token.count('.'), 4)}", f"length {min(e - s, 48) // 4}", f"opaque {opaque}", *(f"before {w}" for w in before), *(f"after {w}" for w in after)]
    if not hidden:
        names += [f"shape {shape}", f"luhn {12 <= n <= 19 and luhn(_digits(token))}", f"plus {token[:1] == '+'}"]
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % (PLACES - 1) + 1 for x in names] + [0]


def _form(token: str) -> str:
    """What of a token counts in a comparison: of numbers their last ten digits, so that a country's code may be left out."""
    d = _digits(token)
    return d[-10:] if len(d) >= SHARED and len(d) * 2 > len(token) and "@" not in token else "".join(c for c in token.lower() if c.isalnum())


def _skips(forms: list[str]) -> list[tuple[int, int]]:
    """Each node with the last and the first one before it of the same form, or of a form that starts or ends with it or the reverse.
    By way of the first one, all of a form are two steps apart however many they are."""
    last: dict[str, int] = {}
    first: dict[str, int] = {}
    parts: dict[str, int] = {}
    out = []
    for i, f in enumerate(forms):
        if len(f) >= SHARED:
            keys = {f[:SHARED], f[-SHARED:]}
            near = [p for k in keys if (p := parts.get(k, -1)) >= 0 and (forms[p].startswith(f) or forms[p].endswith(f) or f.startswith(forms[p]) or f.endswith(forms[p]))]
            out += [(j, i) for j in sorted({first.setdefault(f, i), last.get(f, i), *near}) if j < i]
            last[f] = i
            parts.update(dict.fromkeys(keys, i))
    return out


class Field:
    """Potentials: features to labels, neighbours, and skips."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    @classmethod
    def fit(cls, texts: list[str], steps: int = 150, rate: float = 0.5) -> Field:
        """Piecewise: the node part by gradient descent on the observed labels, each of them once more with what the rules look at
        hidden, so that it is learnt from the rest; the pair parts from counts."""
        k = len(LABELS)
        rows, labels = [], []
        chain, skip = np.ones((k, k)), np.ones((k, k)) + 10 * np.eye(k)
        for text in texts:
            at, label, _ = _nodes(text, base_spans(text))
            links = _skips([_form(text[s:e]) for s, e in at])
            # what is not observed, but linked to something that is, may be either: it is learnt from neither way
            open_ = {i for x in links for i, j in (x, x[::-1]) if not label[i] and label[j]}
            for i, (s, e) in enumerate(at):
                for hidden in (False, True) if i not in open_ else ():
                    rows.append(_features(text, s, e, hidden))
                    labels.append(int(label[i]))
            np.add.at(chain, (label[:-1], label[1:]), 1)
            for i, j in links:
                if i not in open_ and j not in open_:
                    skip[label[i], label[j]] += 1
                    skip[label[j], label[i]] += 1
            np.add.at(skip, (label[label > 0], label[label > 0]), 1)  # written once more, a value is what it was
        node = np.zeros((PLACES, k), np.float32)
        if rows:
            x, y = np.zeros((len(rows), PLACES), np.float32), np.eye(k, dtype=np.float32)[labels]
            for i, r in enumerate(rows):
                x[i, r] = 1
            for _ in range(steps):
                z = x @ node
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                node += rate * (x.T @ (y - p) / len(rows) - 1e-4 * node)
        pair = lambda m: np.log(m / m.sum(axis=1, keepdims=True) / (m.sum(axis=0) / m.sum()))
        return cls(node, pair(chain), pair(skip))

    def beliefs(self, text: str, at: list[tuple[int, int]], label: np.ndarray) -> np.ndarray:
        """Of each node a distribution over LABELS, by damped loopy message passing; labels over 0 are observed."""
        n, k = len(at), len(LABELS)
        seen = label > 0
        score = np.array([self.node[_features(text, s, e, hidden=True)].sum(axis=0) for s, e in at])
        score[seen] = -1e6  # observed, whatever the messages say
        score[seen, label[seen]] = 0
        skips = _skips([_form(text[s:e]) for s, e in at])
        pairs = [(i, i + 1, 0) for i in range(n - 1) if at[i + 1][0] - at[i][1] <= 3] + [(i, j, 1) for i, j in skips]
        if not pairs:
            p = np.exp(score - score.max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)
        src = np.array([i for i, _, _ in pairs] + [j for _, j, _ in pairs])
        dst = np.array([j for _, j, _ in pairs] + [i for i, _, _ in pairs])
        part = [(self.chain, self.skip)[c] for *_, c in pairs]
        table = np.array(part + [m.T for m in part])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(src), k))
        for _ in range(ROUNDS):
            total = score.copy()
            np.add.at(total, dst, message)
            out = (total[src] - message[back])[:, :, None] + table
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if moved < SETTLED:
                break
        total = score.copy()
        np.add.at(total, dst, message)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """base and what the field adds: runs of neighbouring tokens of one kind that overlap no base span."""
        at, label, own = _nodes(text, base)
        if all(own):
            return base
        belief = self.beliefs(text, at, label)
        best = belief.argmax(axis=1)
        more = [(*at[i][:1], int(best[i]) - 1, at[i][1]) for i in np.flatnonzero((best > 0) & (belief.max(axis=1) >= CONFIDENT)) if not own[i]]
        return sorted(base + more)


def fitted(df: DataFrame, text_col: str) -> Field:
    """The field, fitted on about FIT_DOCUMENTS documents with a digit or an at sign, picked by hash."""
    text = F.col(text_col)
    some = df.select(text.alias("text")).where(F.length("text").between(1, FIT_CHARS) & F.col("text").rlike("[0-9@]"))
    return Field.fit(sampled_texts(some, "text", FIT_DOCUMENTS))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row for each row of df: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans.

    n_added counts what the field adds, n_spans all. spans has ``kind:start:end`` for all spans, in code points, by start and then in the order of KINDS.
    A null or empty text has no spans. Repeated rows and null ids give a row each; columns other than the two named
    are not read; an empty df gives no rows. Tokens and spans of one text are all the memory a row needs.
    """
    field = field or fitted(df, text_col)

    def run(batches):
        for b in batches:
            count, digest, spans, added, total = [[] for _ in BASE], [], [], [], []
            for text in (x.as_py() for x in b.column(1)):
                base = base_spans(text or "")
                both = field.spans(text, base) if text else base
                for k, c in enumerate(count):
                    c.append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(both))
                added.append(len(both) - len(base))
                total.append(len(both))
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "n_spans"])
            tk.trim()

    schema = f"id {df.schema[id_col].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_added long, n_spans long"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tk.lean(run), schema).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of overlapping spans, as its first one's kind in brackets."""
    out, end = [], 0
    for s, k, e in spans:
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(df: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """df, with all its columns, and every span of text_col replaced by its kind in brackets. A null text stays null."""
    field, at = field or fitted(df, text_col), df.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t and redacted(t, field.spans(t, base_spans(t))) for t in (x.as_py() for x in b.column(at))]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            tk.trim()

    return df.mapInArrow(tk.lean(run), df.schema)
