"""The operators against brute force, and the cases every one of them has to stand."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlake.llm import decontamination, graph, html_extraction, jaccard_join, lm_scoring, packing, pii, quality_classifier, quality_rules, substring_dedup, toxicity
from gridlake.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, texts, first=0):
    """Texts as documents, with columns whose names the operators use inside."""
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "th", "key", "n", "sig", "h", "rows", "score", "word", "kept"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def prose(rng, n, vocabulary=400):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Prose, copies, near copies, shared passages, junk, nulls, empty and very long texts."""
    rng = random.Random(4)
    out = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    passage = prose(rng, 60)
    out += [out[3], out[3], out[5], None, None, "", " \n\t ", "one two", "one two", "ONE TWO", "word " * 80, prose(rng, 6000)]
    for i in range(12):
        w = out[i].split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(8)]
    out += ["the\n\nthe end of\nthe\nthe\n" * 3, "é ñ ü " * 20, "a#b $$ %%% " * 20]
    return out


def labelled(spark, n):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(n)] + [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 0)], LABELS)


def pages(df):
    return df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[c for c in df.columns if c not in ("doc_id", "text", "lang")])


EVERY = {
    "decontamination": lambda s, d: decontamination.contaminated(d, s.createDataFrame([(1, "some words of a benchmark item that no text holds at all"), (2, None), (3, "")], "item_id long, text string")),
    "decontaminate": lambda s, d: decontamination.decontaminate(d, s.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")),
    "quality_classifier": lambda s, d: quality_classifier.classify(d, labelled(s, 50)),
    "quality_unlabelled": lambda s, d: quality_classifier.classify(d, labelled(s, 50).limit(0)),
    "html": lambda s, d: html_extraction.extract(pages(d)),
    "pii": lambda s, d: pii.find(d),
    "redact": lambda s, d: pii.redact(d),
    "lm": lambda s, d: lm_scoring.score(d),
    "packing": lambda s, d: packing.pack(d),
    "substring": lambda s, d: substring_dedup.remove_repeats(d),
    "jaccard": lambda s, d: jaccard_join.jaccard_components(d),
    "one_of_each": lambda s, d: jaccard_join.one_of_each(d),
    "rules": lambda s, d: quality_rules.repetition_coverage(d),
    "passing": lambda s, d: quality_rules.passing(d),
    "toxicity": lambda s, d: toxicity.classify(d, labelled(s, 50)),
    "toxicity_unlabelled": lambda s, d: toxicity.classify(d, labelled(s, 50).limit(0)),
}
ONE_ROW_EACH = {"quality_classifier", "quality_unlabelled", "html", "pii", "redact", "lm", "substring", "jaccard", "rules", "toxicity", "toxicity_unlabelled", "decontaminate"}


@pytest.mark.parametrize("name", EVERY)
def test_odd_rows(spark, corpus, name):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing names."""
    some = corpus[:5] + corpus[60:75]
    df = docs(spark, some)
    df = df.union(df.where("doc_id = 1")).union(df.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long")))
    df = df.union(df.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes)))
    out = EVERY[name](spark, df)
    rows = out.collect()
    if name in ONE_ROW_EACH:
        assert len(rows) == len(some) + 4
    if name == "packing":
        assert len({(r["doc_id"], r["piece"]) for r in rows}) >= len(some)


@pytest.mark.parametrize("name", EVERY)
def test_no_rows(spark, name):
    out = EVERY[name](spark, docs(spark, ["x"]).limit(0))
    assert out.collect() == []



def brute_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def test_jaccard_components(spark, corpus):
    rng = random.Random(9)
    texts = list(corpus)
    for n in (5, 6, 8, 9, 12, 16, 20, 40, 90, 100, 200, 400):  # chains of copies at the edge of the threshold
        base = prose(rng, n).split()
        texts.append(" ".join(base))
        for k in range(1, 6):
            texts.append(" ".join(base[: max(1, n - k * n // 30 - k % 2)]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    sets = brute_sets(texts)
    assert [got[i] for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, brute_components(sets), strict=True)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_jaccard_groups_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", most)
    rng = random.Random(2)
    passage = prose(rng, 40)
    texts = [f"{passage} {prose(rng, 12)}" for _ in range(25)]
    texts += [t + " x" for t in texts[::5]]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(brute_sets(texts))


def test_jaccard_large_components(spark, monkeypatch):
    """A large group of copies around the threshold, some linked only through few others."""
    monkeypatch.setattr(jaccard_join, "LARGE", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = random.Random(14)
    base, texts = prose(rng, 120).split(), []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    want = brute_components(brute_sets(texts))
    assert len(set(want)) > 1 and [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize(("named", "large"), [(16, 16), (16, 3), (0, 16)])
def test_jaccard_groups_are_moved_once(spark, monkeypatch, named, large):
    """Groups that can name what their bitmaps leave possible are not dealt again; signatures are dealt once, before they are grouped."""
    monkeypatch.setattr(jaccard_join, "NAMED", named)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    rng = random.Random(21)
    texts, dealt, signed = [], [], []
    for _ in range(12):
        base = prose(rng, 150).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    spread, sign = jaccard_join._spread, jaccard_join._signed
    monkeypatch.setattr(jaccard_join, "_spread", lambda grouped, *rest: dealt.append(grouped.count()) or spread(grouped, *rest))
    monkeypatch.setattr(jaccard_join, "_signed", lambda sets: signed.append(sign(sets)) or signed[-1])
    table, plans = jaccard_join.table, []
    monkeypatch.setattr(jaccard_join, "table", lambda df, path: plans.append(df._jdf.queryExecution().analyzed().toString()) or table(df, path))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(brute_sets(texts))
    assert dealt[0] > 100 and (dealt[1] == 0) == (named > 0)
    sig = signed[0].columns.index("sig")
    assert sum(signed[0]._jdf.queryExecution().analyzed().output().apply(sig).toString() in p for p in plans) == 1


def test_tables_are_written_in_small_batches(spark, tmp_path):
    """Batches of wide rows are small, and a session's own limit holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(6000).coalesce(1).select(F.expr("repeat('x', 4000)").alias("text"))
    rows = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert max(r["n"] for r in graph.table(rows, f"{tmp_path}/a").collect()) < 2000
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, "2m")
    try:
        assert max(r["n"] for r in graph.table(rows, f"{tmp_path}/b").collect()) < 1000
        assert spark.conf.get(name) == "2m"
    finally:
        spark.conf.unset(name)


def test_jaccard_groups_of_batches(spark):
    """Groups whose rows lie in several Arrow batches."""
    rows = [(s, k) for s, m in ((1, 1), (2, 5), (3, 23), (4, 2), (5, 5), (6, 1)) for k in range(m)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = jaccard_join._met(spark.createDataFrame(rows, "sig long, key long").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["sig"], r["key"]) for r in got) == [(s, k) for s, k in rows if s not in (1, 6)]
    heads = {r["sig"]: (r["m"], r["x"], r["y"]) for r in got if r["m"] is not None}
    assert {s: h[0] for s, h in heads.items()} == {2: 5, 3: 23, 4: 2, 5: 5}
    assert heads[2] == heads[5] and len(set(heads.values())) == 3 and sum(r["x"] is not None for r in got) == 4


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 300, 1000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.16], rng.integers(0, 1 << 63, rng.integers(0, n // 7 + 1), dtype=np.uint64)]))
            if len(b) and jaccard_join.similar(a, b, 75):
                assert set(jaccard_join.signatures(a).tolist()) & set(jaccard_join.signatures(b).tolist()), n
            bits = jaccard_join._folded([jaccard_join.parity(a), jaccard_join.parity(b)])
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_driver_memory_goes_back(spark, monkeypatch):
    assert "Trim native heap" in graph.trim_driver(spark)
    asked, trim = [], graph.trim_driver
    monkeypatch.setattr(graph, "trim_driver", lambda s: asked.append(trim(s)))
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long")
    assert {r["component"] for r in graph.components(edges).collect()} == {0}
    assert len(asked) > 2 and all(asked)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100), (200, 100)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def test_anchors_of_texts_longer_than_a_run(monkeypatch):
    grams = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64)
    grams[100:140] = grams[60:100]
    want = substring_dedup._leftmost_least(grams, 27)
    top = grams >> np.uint64(24)
    assert [int(np.argmin(top[i : i + 27])) + i for i in range(len(grams) - 26)] == want.tolist()
    monkeypatch.setattr(substring_dedup, "_POS", 6)
    short = substring_dedup._leftmost_least(grams, 27)
    top = grams >> np.uint64(6)
    assert [int(np.argmin(top[i : i + 27])) + i for i in range(len(grams) - 26)] == short.tolist()


@pytest.mark.parametrize("target", [35, 6])
def test_substring_dedup(spark, corpus, target):
    words = [WORD.findall(t or "") for t in corpus]
    seen = Counter(tuple(w[i : i + target]) for w in words for i in range(len(w) - target + 1))
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, corpus), target=target).collect()}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - target + 1):
            if seen[tuple(w[k : k + target])] > 1:
                gone[k : k + target] = [True] * target
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), sum(gone), kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_quality_rules_counts(spark, corpus):
    got = {r["doc_id"]: r for r in quality_rules.repetition_coverage(docs(spark, corpus)).collect()}
    for i, t in enumerate(corpus):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = [False] * len(w)
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                inside[k : k + 3] = [True] * 3
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * sum(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
        ten = Counter(tuple(w[k : k + 10]) for k in range(len(w) - 9))
        over = [any(ten[tuple(w[j : j + 10])] > 1 for j in range(max(0, k - 9), min(k, len(w) - 10) + 1)) for k in range(len(w))]
        assert abs(r["cover_10"] * max(1, sum(map(len, w))) - sum(len(x) for x, o in zip(w, over, strict=True) if o)) < 1e-6


def test_packing_round_trip(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["don't we'll  I'm", " 's ''s\n's", "日本 語's", "<|endoftext|> a", "a×b", "\x1c a", "x\n \n y", "'"]
    texts = corpus + odd
    rows = packing.pack(docs(spark, texts)).collect()
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in enumerate(ids):
        p = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in p] == list(range(len(p))) and sum(r["length"] for r in p) == len(x)
        assert len(p) == -(-len(x) // 1024) and all(r["length"] == 1024 for r in p[1:])
        for r in p:
            part = np.array(x[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 1024
    assert len(bins) <= 1.05 * -(-sum(map(len, ids)) // 1024) + 1


def test_encoder_is_the_tokenizer():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice("a b'strevlmd  \n1!é") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for lo, hi, t in tk.texts_of(pa.array(texts)):
        for got, text in zip(e.encode(t), texts[lo:hi], strict=True):
            assert list(got) == e.tok.encode(text, add_special_tokens=False).ids


def test_encoder_keeps_to_its_thread():
    import public_tokenizers

    code = """
import os, sys
import pyarrow as pa
from gridlake.llm import packing, textkit as tk
e = packing.Encoder(sys.argv[1])
before = len(os.listdir("/proc/self/task"))
for _, _, t in tk.texts_of(pa.array([" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'x' * (i // 676)}" for i in range(5000))])):
    e.encode(t)
assert e.n > 4000
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    run = subprocess.run([sys.executable, "-c", code, public_tokenizers.path("byte_bpe_50k.json")], env=env | {"PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, timeout=60)
    assert run.stdout.strip() == "0", run.stdout + run.stderr


def test_learnt_pieces_are_found():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    e.slots = np.full(8192, -1, np.int32)  # crowded, so that many entries meet in a slot
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 6000, dtype=np.uint64))
    for some in (keys[::2], keys[1::2]):
        e._learn(some, ["a"] * len(some))
    found = e._find(keys)
    assert (e.keys[found] == keys).all() and (found >= 0).all()
    assert (e._find(keys + tk.U64(1)) == -1).sum() >= len(keys) - 5


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(5):
        hist = np.bincount(np.clip(rng.gamma(2, 200, 3000).astype(int), 1, 1024), minlength=1025)
        chosen = packing.plan(hist)
        used = np.zeros_like(hist)
        for p, k in chosen:
            assert sum(p) <= 1024
            for x in p:
                used[x] += k
        assert (used == hist).all()
        bound = -(-int((hist * np.arange(1025)).sum()) // 1024)
        assert sum(k for _, k in chosen) <= 1.03 * bound + 1


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (3, 7, 8, 15, 22, 35, 60) for _ in range(6)]
    texts, want = [], set()
    for i, t in enumerate(items):
        texts.append(f"{prose(rng, 30)} {t.upper().replace(' ', ', ')}! {prose(rng, 30)}")
        want.add((len(texts) - 1, i))
    exact = len(texts)
    for i, t in enumerate(items):
        w = t.split()
        if len(w) >= 15:
            for _ in range(len(w) // 12):
                w[rng.randrange(len(w))] = "edited"
            texts.append(f"{prose(rng, 41)} {' '.join(w)} {prose(rng, 9)}")
            want.add((len(texts) - 1, i))
    texts += [prose(rng, 300) for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs(spark, texts), table).collect()}
    assert {x for x in want if x[0] < exact} <= got and got <= want
    assert len(got) >= 0.9 * len(want)
    left = {r["doc_id"] for r in decontamination.decontaminate(docs(spark, texts), table).select("doc_id").collect()}
    assert left == set(range(len(texts))) - {x for x, _ in got}


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [prose(rng, 20) for _ in range(9)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs(spark, [f"so {t} it goes" for t in items])
    monkeypatch.setattr(decontamination.indexes, "__defaults__", (200,))
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, table).collect()} == {(i, i) for i in range(9)}


def test_decontamination_misses_nothing_within_the_distance():
    """Edits of all kinds up to the whole allowance, at the head, at the end and anywhere, against every part of the text."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(n) for n in (8, 9, 11, 12, 15, 16, 20, 24, 33, 60) for _ in range(6)]
    texts, want = [], set()
    for i, item in enumerate(items):
        w, most = list(item), len(item) // 4
        places = (range(most), range(len(w) - most, len(w)), rng.sample(range(len(w)), most))[i % 3]
        for p in sorted(places, reverse=True):
            w[p : p + 1] = ([], ["edited"], ["put", w[p]])[i // 3 % 3]
        texts.append(" ".join(some(rng.randint(0, 40)) + w + some(rng.randint(0, 40))))
        want.add((i, i))
    hashes = lambda rows: decontamination._words(pa.array(rows))
    index = decontamination.Index(list(enumerate(hashes([" ".join(x) for x in items]))))
    got = {(x, i): e for _, _, t in tk.texts_of(pa.array(texts)) for x, i, _, e in index.search(t)}
    brute = {(x, i): decontamination.edits(w, h)[0] for x, h in enumerate(hashes(texts)) for i, w in index.items}
    assert want <= set(got) and got == {k: e for k, e in brute.items() if e <= len(items[k[1]]) // 4}


def test_edit_distance():
    def brute(a, b):
        best = len(a)
        for s in range(len(b) + 1):
            row = list(range(len(a) + 1))
            for e in range(s, len(b)):
                new = [row[0] + 1]
                for i in range(len(a)):
                    new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (a[i] != b[e])))
                row = new
                best = min(best, row[-1])
        return best

    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(1, 4, rng.integers(1, 8)).astype(np.uint64), rng.integers(1, 4, rng.integers(0, 12)).astype(np.uint64)
        assert decontamination.edits(a, b)[0] == brute(a.tolist(), b.tolist())


def test_base_spans():
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for kind, p, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
            for m in re.finditer(p, t):
                d = re.sub(r"[^0-9]", "", m[0])
                if lo <= len(d) <= hi and (kind == 3 or luhn(d)):
                    out.append((m.start(), kind, m.end()))
        return sorted(out)

    rng = random.Random(3)
    some = ["".join(rng.choice("ab@@..--+1102 23()_é") for _ in range(rng.randint(0, 60))) for _ in range(8000)]
    for t in [*some, "0001.02.3.255 256.1.1.1 1.2.3.4.5", "4111 1111 1111 1111", "+1 (337) 555-3479", "a@b.c@d.e", "1" * 5000, "a" * 5000 + "@b", "+" * 5000 + "1"]:
        assert pii.base_spans(t) == plain(t)


def test_skip_chain_adds_repeats_and_spares_the_rest(spark):
    rng = random.Random(8)
    phone = lambda: f"+1 (337) 555-{rng.randint(1000, 9999)}"
    texts = [f"{prose(rng, 20)} call {phone()} or mail x{i}@mail.example.com now {prose(rng, 9)} in {rng.randint(1900, 2030)}" for i in range(150)]
    texts.append("call +13375553479 today, so once more: 3375553479 is the line, not 2024 or 17")
    rows = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    assert all(rows[i]["n_added"] == 0 for i in range(150))
    last = rows[150]
    s = texts[150].index("3375553479 is")
    assert last["n_phone"] == 1 and last["spans"].split(",")[0] == f"phone:{5}:{17}"
    assert last["n_added"] == 1 and f"phone:{s}:{s + 10}" in last["spans"] and last["n_spans"] == 2
    assert "[PHONE]" in pii.redact(docs(spark, texts[:1])).first()["text"]


def test_field_adds_secrets_and_numbers_written_otherwise(spark):
    rng = random.Random(18)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    numbers = lambda: f"+1 (337) 555-{rng.randint(1000, 9999)}"
    texts = [f"{prose(rng, 20)} call {numbers()} or 4111 1111 1111 1111 in {rng.randint(1900, 2030)}" for _ in range(150)]
    texts += [f'{prose(rng, 9)} token = "{secret}" {prose(rng, 300)} {secret} {prose(rng, 9)}']
    texts += ["reach +14155550132 " + prose(rng, 200) + " or 415 555 0132 " * 30 + prose(rng, 9) + " in 1999 and 12 of 40"]
    rows = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    assert all(rows[i]["n_added"] == 0 for i in range(150))
    found = [(k, texts[i][int(a) : int(b)]) for i in (150, 151) for k, a, b in (x.split(":") for x in rows[i]["spans"].split(","))]
    assert found[:2] == [("secret", secret)] * 2 and found[2] == ("phone", "+14155550132")
    assert len(found) > 3 and all(k == "phone" and set(x.split(" ")) == {"415", "555", "0132"} for k, x in found[3:])


def test_messages_against_all_labellings():
    """On a tree message passing is exact: the beliefs are the marginals over all labellings."""
    from itertools import product

    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(0, 0.5, (pii.PLACES, k)), rng.normal(0, 1, (k, k)), np.eye(k) + (m := rng.normal(0, 1, (k, k))) + m.T)
    for text in ("5551234567 and so 17 or 5551234567", "a1 b2 c3", "12x 13y and 14z"):
        at, label, _ = pii._nodes(text, [])
        skips = pii._skips([pii._form(text[s:e]) for s, e in at])
        chain = [(i, i + 1) for i in range(len(at) - 1) if at[i + 1][0] - at[i][1] <= 3]
        own = np.array([field.node[pii._features(text, s, e, hidden=True)].sum(axis=0) for s, e in at])
        want = np.zeros((len(at), k))
        for y in product(range(k), repeat=len(at)):
            w = np.exp(sum(own[i, y[i]] for i in range(len(at))) + sum(field.chain[y[i], y[j]] for i, j in chain) + sum(field.skip[y[i], y[j]] for i, j in skips))
            for i, v in enumerate(y):
                want[i, v] += w
        assert np.abs(field.beliefs(text, at, label) - want / want.sum(axis=1, keepdims=True)).max() < 0.01


def junk(rng, kind):
    w = prose(rng, rng.randint(60, 200)).split()
    return [" ".join(x + "***" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join(x for x in w[:8] for _ in range(17)), " | ".join(w)][kind % 4]


def test_quality_classifier_on_held_out_rows(spark):
    rng = random.Random(7)
    good = [rng.random() < 0.8 for _ in range(600)]
    texts = [". ".join(prose(rng, 12).capitalize() for _ in range(rng.randint(4, 20))) if g else junk(rng, i) for i, g in enumerate(good)]
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good) if i % 3], LABELS)
    rows = quality_classifier.classify(docs(spark, texts), labels).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in held]) > 0.95
    worse = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.classify(docs(spark, texts), worse).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in rows) == sorted((r["doc_id"], round(r["score"], 9)) for r in again)


def test_toxicity_restores_disguises(spark):
    rng = random.Random(10)
    vocabulary, bad = [prose(rng, 1, 1) for _ in range(500)], ["stupid", "idiot", "scum", "worthless"]
    text = lambda: [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
    rows, labels = [], []
    for i in range(700):
        w, toxic = text(), rng.random() < 0.15
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    plain = len(rows)
    for x in ("st00pid 1d10t", "s t u p i d", "stuuuupid idiooot", "s.c.u.m w0rthl3ss", "$cum $tupid", "clean 2024 b2b"):
        w = text()
        rows.append(" ".join(w[:9] + [x] + w[9:]))
    out = {r["doc_id"]: r for r in toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(out[i]["predicted"], t) for i, _, t in labels if out[i]["held_out"]]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(plain))
    assert np.mean([p == t for p, t in held]) > 0.97
    assert sum(out[plain + k]["predicted"] for k in range(5)) >= 4 and out[plain + 5]["predicted"] == 0


def toxic_predictions(spark, added):
    """What is predicted for texts of clean words with these pieces in their middle."""
    rng = random.Random(10)
    vocabulary, bad = [prose(rng, 1, 1) for _ in range(500)], ["stupid", "idiot", "scum", "worthless"]
    rows, labels = [], []
    for i in range(700):
        w, toxic = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))], rng.random() < 0.15
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    clean = [rng.choice(vocabulary) for _ in range(12)]
    rows += [f"{' '.join(clean[:6])} {piece} {' '.join(clean[6:])}" for piece in (f(clean) for f in added)]
    out = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    return [out[700 + k] for k in range(len(added))]


def test_toxicity_of_long_disguises(spark):
    """Letters set apart over a whole sentence, after another word, with wide spaces; words stretched without end."""
    apart = lambda *words: " ".join(" ".join(w) for w in words)
    added = [
        lambda w: apart(*w[:6], "stupid", "idiot", *w[6:], "scum"),
        lambda w: apart(w[0], "stupid", "idiot"),
        lambda w: "   ".join(" ".join(x) for x in (w[1], "scum", "stupid", w[2])),
        lambda w: "st" + "u" * 100 + "pid idio" + "o" * 5000 + "t",
        lambda w: apart(*w),
    ]
    assert toxic_predictions(spark, added) == [1, 1, 1, 1, 0]


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """Words are counted over every text, weights over every labelled row that is not held out, ids of another integer type included."""
    monkeypatch.setattr(toxicity, "LABELLED", 10, raising=False)
    seen, count = [], toxicity.known_words
    monkeypatch.setattr(toxicity, "known_words", lambda df: seen.append(df.count()) or count(df))
    rng = random.Random(31)
    vocabulary = [prose(rng, 1) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        w, toxic = [rng.choice(vocabulary) for _ in range(40)], i % 6 == 0
        rows.append(" ".join(w + ["vermin", "scumbag"] * toxic))
        if i < 400:
            labels.append((i, 1, int(toxic)))
    out = toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, LABELS.replace("doc_id long", "doc_id int"))).collect()
    assert seen == [600]
    assert [r["predicted"] for r in sorted(out, key=lambda r: r["doc_id"])] == [int(i % 6 == 0) for i in range(600)]


def test_toxicity_deals_labelled_texts_the_same_way_at_any_size(spark, monkeypatch):
    """Few labels are joined as many are, after the words were counted; what is written is restored already."""
    seen, write, count = [], toxicity.table, toxicity.known_words
    monkeypatch.setattr(toxicity, "known_words", lambda df: seen.append("words") or count(df))
    monkeypatch.setattr(toxicity, "table", lambda df, path: seen.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, path))
    monkeypatch.setattr(toxicity, "discard", lambda spark, path: seen.append(spark.read.parquet(f"{path}/labelled").collect()))
    rows = [None, "", "a stup1d stup1d one", "stupid is stupid as stupid does", "not labelled, s t u p i d"]
    toxicity.classify(docs(spark, rows), spark.createDataFrame([(i, 1, i % 2) for i in range(4)], LABELS), out=9)
    order, plan, written = seen
    assert order == "words" and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r["label"], sorted(r["text"].split())) for r in written) == [
        (0, []),
        (0, sorted("a stup d stup d one stupid".split())),
        (1, []),
        (1, sorted(rows[3].split())),
    ]


def test_features_of_restored_texts_are_the_same():
    texts = [None, "", "so st00pid", "a s t u p i d  idiot", "ÉÉ iddi0t! (a$$)", "2024 b2b", "plain words", "x"]
    speller = toxicity.Speller(np.zeros(28**3), {"so": 9, "stupid": 5, "idiot": 5, "ass": 5})
    ((_, _, t),) = tk.texts_of(pa.array(texts))
    ((_, _, u),) = tk.texts_of(pa.array(toxicity.restored(t, speller)))
    want, got = (set(zip(*(x.tolist() for x in toxicity.features(*y)), strict=True)) for y in ((t, speller), (u, None)))
    assert want == got and len({text for text, _ in got}) == 6


def test_toxicity_of_slight_disguises(spark):
    """A sign at an end, signs side by side, one letter doubled, in either case; and signs around plain words."""
    added = [
        lambda w: "idio7 $tupi|) iDiot!",
        lambda w: "stuupid",
        lambda w: "iddiot",
        lambda w: "idIiot",
        lambda w: "5cu|\\/| worthle$$",
        lambda w: "(stup1d!) (5cum)",
        lambda w: f"{w[0]}! ({w[1]}) {w[2]}7 {w[3]}$ {w[4]}{w[4][-1]}",
    ]
    assert toxic_predictions(spark, added) == [1, 1, 1, 1, 1, 1, 0]


def test_signs_at_ends_are_decoded():
    rows = {"idio7": "idiot", "a$$": "ass", "stuupid": "stupid", "iddiot": "idiot", "(unning!": "cunning"}
    speller = toxicity.Speller(np.zeros(28**3), {"a": 900, "as": 900, "ass": 5, "idiot": 5, "stupid": 5, "cunning": 5})
    for _, _, t in tk.texts_of(pa.array([f"so {x} is" for x in rows])):
        tokens, text, which = toxicity.disguised(t)
        got = {(i, w) for i, k in zip(text.tolist(), which.tolist(), strict=True) for w in (speller.restore(tokens[k]), speller.restore(tokens[k], True))}
    assert set(enumerate(rows.values())) <= got


def test_repeated_letters_are_weighed_without_a_lattice(monkeypatch):
    """Tokens of letters alone become what a lattice makes of them, which only signs and many repeats still need."""
    rng = random.Random(10)
    speller = toxicity.Speller(np.array([rng.random() * 20 for _ in range(28**3)]), {"so": 9, "stupid": 5, "idiot": 5, "letter": 5, "été": 3})
    plain = ["so", "stuupid", "iddiot", "letter", "lettter", "ééttéé", "aabbccdd", "uuuu"] + ["".join(rng.choice("abcé") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    hard = ["st" + "u" * 100 + "pid", "aabbccddeeff", "s-tuupid", "aa#", "l\ne"]
    want, decoded, restore = [speller.restore(w) for w in plain + hard], [], speller.restore
    assert want[:6] == ["so", "stupid", "idiot", "letter", "letter", "été"]
    monkeypatch.setattr(speller, "restore", lambda w, whole=False: decoded.append(w) or restore(w, whole))
    assert toxicity._words_behind(plain + hard, speller) == want
    assert len(decoded) < 20
    assert decoded == [w for w in plain if not toxicity._forms(w)] + hard


def test_disguised_words_are_decoded_once(monkeypatch):
    """A worker decodes a word once for all its tasks, and right where more words come than it keeps."""
    counts, words = np.zeros(28**3), {"so": 9, "stupid": 5, "idiot": 5}
    want = {b"STUUPID": {"stupid"}, b"idi0t": {"idiot"}, b"$tupid.": {"stupid"}, b"x": set()}
    for kept in (toxicity.KEPT, 2, 0):
        monkeypatch.setattr(toxicity, "KEPT", kept)
        speller, decoded = toxicity.Speller(counts, words), []
        monkeypatch.setattr(speller, "restore", lambda w, whole=False, restore=speller.restore: decoded.append(w) or restore(w, whole))
        for some in ([b"idi0t", b"x"], [b"STUUPID", b"idi0t"], list(want), [b"idi0t"]):
            assert [set(x.split()) for x in speller.behind(some)] == [want[w] for w in some]
        if kept > 2:
            assert sorted(decoded) == ["$tupid"] * 2 + ["idi0t"] * 2  # with signs taken for nothing and not
    first = toxicity._speller("a", counts, words)
    assert toxicity._speller("a", counts, words) is first and toxicity._speller("b", counts, {}) is not first
    assert list(toxicity._spellers) == ["b"]


def test_only_weighed_features_are_told_apart():
    speller = toxicity.Speller(np.zeros(28**3), {"so": 9, "stupid": 5, "idiot": 5})
    ((_, _, t),) = tk.texts_of(pa.array([None, "so st00pid st00pid", "stupid", "idiot stupid so", "a s t u p i d"]))
    text, h = toxicity.features(t, speller)
    keys = np.unique(h)[::2]
    weights = np.arange(1.0, len(keys) + 1)
    scorer = toxicity.Scorer(speller, keys, weights)
    weight = dict(zip(keys.tolist(), weights.tolist(), strict=True))
    want = [sum(weight.get(k, 0) for i, k in zip(text.tolist(), h.tolist(), strict=True) if i == n) for n in range(t.n)]
    assert scorer.evidence(t).tolist() == want and len(scorer._weighed(h)) < len(h)


def test_extraction_of_made_up_pages():
    rng = np.random.default_rng(99)
    texts = [f"Sentence {i} of some length, with a comma and an end. And another one follows it, number {i * 7}." for i in range(60)]
    other = [f"Words of page {i}, none of which the others share, written down here. A second one." for i in range(40)]
    model = html_extraction.train(["<body><nav>Home</nav><article><h1>Title</h1>" + "".join(f"<p>{t}</p>" for t in other[k : k + 5]) + "</article></body>" for k in range(0, 40, 5)])
    right = kept = missed = 0
    for _ in range(150):
        source = html_extraction.made_up(texts, rng)
        page, y = html_extraction.marked(source)
        keep = html_extraction.decode(page.parent, model.raw(html_extraction.features(page)))
        want, got = np.array([y[v] for v, *_ in page.blocks]) > 0, np.array([keep[v] for v, *_ in page.blocks])
        right += (want == got).sum()
        missed += (want & ~got).sum()
        kept += len(want)
    assert right >= 0.93 * kept and missed <= 0.05 * kept


def test_extraction_rules(spark):
    page = "<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p><b>One  two.<br><p>Three\n four &lt;x&gt;</p><script>bad()</script></article><footer>&copy; me</footer></body></html>"
    rows = spark.createDataFrame([(i, "u", page) for i in range(30)] + [(99, None, None), (98, "u", ""), (97, "u", "<<<>>< <p <b"), (96, "u", "<div>" * 3000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extraction.extract(rows).collect()}
    assert got[0]["text"] == "A & B\nOne two.\nThree four <x>" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[99]["text"] == got[98]["text"] == "" and got[99]["url"] is None


def test_pages_without_a_body_and_references_across_tags():
    words = lambda source: [t for _, t, _ in html_extraction.parse(source).blocks]
    assert words("<html><head><title>x</title><p>Real text.<p>More") == ["Real text.", "More"]
    assert words("<head><meta charset=u><title>x</title>Bare words <b>in bold</b>") == ["Bare words in bold"]
    assert words("<head><style>p{}</style><script>x</script></head><body><p>&am<b>p;</b> &amp;lt; &#x41;&copy") == ["&amp; &lt; A\u00a9"]


def test_sample_is_bounded_and_the_same(spark):
    from gridlake.llm.sample import sampled_texts

    df = spark.createDataFrame([(f"text {i % 900}",) for i in range(3000)], "t string")
    some = sampled_texts(df, "t", 600)
    assert some == sampled_texts(df.repartition(7), "t", 600) and 0 < len(some) < 400 and len(set(some)) == len(some)
    assert len(sampled_texts(df, "t", 10**6)) == 900 and sampled_texts(df.limit(0), "t", 5) == []


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        raw = rng.normal(0, 2, n)
        cost = lambda y: sum(-np.logaddexp(0, -r) if k else -np.logaddexp(0, r) for k, r in zip(y, raw, strict=True))
        fit = lambda y: all(not y[i] or i == 0 or y[parent[i]] for i in range(n))
        best = max(cost(y) for m in range(2**n) if fit(y := [m >> i & 1 for i in range(n)]))
        got = html_extraction.decode(parent, raw)
        assert fit(got) and abs(cost(got) - best) < 1e-9


def test_language_model_prefers_its_corpus(spark):
    rng = random.Random(12)
    phrases = [prose(rng, 6) for _ in range(20)]
    texts = [" ".join(rng.choice(phrases) for _ in range(30)) for _ in range(80)]
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    texts += [" ".join(shuffled), prose(rng, 150), "", None]
    rows = {r["doc_id"]: r for r in lm_scoring.score(docs(spark, texts), rounds=25).collect()}
    mean = [rows[i]["mean_log_prob"] for i in range(82)]
    assert mean[80] < np.mean(mean[:80]) and mean[81] < np.mean(mean[:80])
    assert rows[82]["log_prob"] == 0 and rows[82]["mean_log_prob"] is None and rows[83]["n_words"] == 0
    assert abs(rows[0]["log_prob"] / rows[0]["n_words"] - mean[0]) < 1e-9


def test_language_model_learns_from_every_word():
    first = np.array([0, 1, 1, 4, 30])
    for rounds in (1, lm_scoring.ROUNDS, 5):
        masked = [lm_scoring.targets(first, r, rounds) for r in range(rounds)]
        assert set(np.concatenate(masked).tolist()) == set(range(30))


def test_lm_scores_only_the_targets():
    rng = np.random.default_rng(4)
    net = lm_scoring.start()
    net["bias"] += rng.normal(0, 30, lm_scoring.CLASSES - 1).astype(np.float32)
    around, target = rng.integers(0, lm_scoring.CLASSES, (700, 2 * lm_scoring.CONTEXT)), rng.integers(0, lm_scoring.CLASSES - 1, 700)
    got = lm_scoring.log_chances(net, around, target)
    assert got.dtype == np.float32 and np.isfinite(got).all()
    assert np.allclose(got, lm_scoring.forward({k: v.astype(np.float64) for k, v in net.items()}, around)[1][np.arange(700), target], rtol=1e-5, atol=1e-4)


def test_language_model_gradient():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in lm_scoring.start().items()}
    around, target = rng.integers(0, lm_scoring.CLASSES, (5, 2 * lm_scoring.CONTEXT)), rng.integers(0, lm_scoring.CLASSES - 1, 5)
    loss = lambda n: -lm_scoring.forward(n, around)[1][np.arange(5), target].mean()
    moved = {k: v.copy() for k, v in net.items()}
    lm_scoring.step(moved, around, target, 1e-3)
    slope = {k: (net[k] - moved[k]) / 1e-3 for k in net}
    for k in net:
        i = np.unravel_index(int(np.abs(slope[k]).argmax()), slope[k].shape)
        up, down = ({x: v.copy() for x, v in net.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - slope[k][i]) < 1e-4


def test_word_windows_follow_the_contract():
    texts = ["a b\x0bc\x1cd", "", " x ", "é f g"]
    for _, _, t in tk.texts_of(pa.array(texts)):
        s, e, first = t.words
        raw = t.data.tobytes()
        assert [[raw[a:b].decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] for i in range(4)] == [WORD.findall(x) for x in texts]


def test_pipeline_against_single_stages(spark, corpus, tmp_path):
    """Each stage does to its input what brute force or the stage's own operator says."""
    import corpus_pipeline

    rng = random.Random(21)
    item = prose(rng, 25)
    texts = [prose(rng, 120) for _ in range(30)]
    texts += [texts[0], texts[1] + " more", f"{prose(rng, 60)} {item} {prose(rng, 10)}", "word " * 90, "short", None, f"{prose(rng, 80)} me@mail.example.com"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        d = spark.createDataFrame(d.collect(), SCHEMA)
        seen.append({r["doc_id"]: r["text"] for r in d.collect()})
    assert set(seen[0]) == set(range(33)) | {36}
    assert set(seen[1]) == set(range(30)) | {32, 36} and set(seen[2]) == set(range(30)) | {36}
    assert "me@mail" not in seen[3][36] and seen[3][5] == texts[5]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(seen[3])
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op7_substring_dedup", "op8_ngram_jaccard_join", "op9_quality_rules"])
def test_queries_match_their_sql(spark, corpus, tmp_path, name):
    """On documents with nulls, repeated rows, copies and junk the query gives the very rows that its SQL gives."""
    import duckdb

    from gridlake.llm import queries

    df = docs(spark, corpus)
    df.union(df.where("doc_id < 9")).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLES[name]).df()
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
