"""Source divergence, collocations and toxicity against brute force, and on odd input."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafbound.llm import byte_words, collocations, divergence, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (None, "null id text here", None, "s", 1), (4, "one two three", "en", "s", 3), (4, "one two three", "en", "s", 3), (5, "Ä ö " * 3000, "de", "t", 9)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- words in buffers


def test_words_end_with_their_text():
    import pyarrow as pa

    texts = ["ab cd", "", "ef", "Ä-b", "x" * 50, "ab"]
    for most in (1, 7, 1000):
        got = []
        for _, _, data, edges in byte_words.buffers(pa.array(["zz", *texts])[1:], most):
            starts, ends = byte_words.cut(data, edges, divergence.TERM)
            ids, first, _ = byte_words.group(data, starts, ends)
            names = byte_words.spelled(data, starts, ends, first)
            got += [names[i].decode() for i in ids]
        assert got == [w for t in texts for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))]


def test_equal_hashes_are_told_apart(monkeypatch):
    words = ["a", "b", "aa", "a", "c", "b", "aa", "longer"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    monkeypatch.setattr(byte_words.xxhash, "xxh64_intdigest", lambda w: len(w) % 2)
    starts, ends = byte_words.cut(data, np.array([0, len(data)]), divergence.TERM)
    ids, first, keys = byte_words.group(data, starts, ends)
    names = byte_words.spelled(data, starts, ends, first)
    assert [names[i].decode() for i in ids] == words and len(names) == 5 == len(keys)


# ---- 11


def brute_divergence(rows, least=30, ranks=50):
    docs_of, count, groups = defaultdict(set), Counter(), set()
    for k, (_, text, lang, source, *_) in enumerate(rows):
        groups.add((lang or "", source or ""))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)):
            docs_of[lang or "", w].add(k)
            count[lang or "", source or "", w] += 1
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(w for (x, w), d in docs_of.items() if x == lang and len(d) >= least)
        mine = sorted(s for x, s in groups if x == lang)
        n = {s: [count[lang, s, w] for w in kept] for s in mine}
        share = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        p, q = {s: share(c) for s, c in n.items()}, share([sum(c[i] for c in n.values()) for i in range(len(kept))])
        for s in mine:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[t], strict=True)), t.encode(), t) for t in mine if t != s)
            terms = sorted((b - a, w.encode(), w) for a, b, w, c in zip(p[s], q, kept, n[s], strict=True) if c > 0 and a > b)[:ranks]
            out += [(lang, s, part, w, -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, w) in enumerate(found, 1)]
    return sorted(out)


def audited(df, **how):
    return sorted(map(tuple, divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("block,tile", [(4096, 256), (7, 3)])
def test_divergence(spark, block, tile, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rng = random.Random(block)
    words = [f"{a}{b}" for a in "abcdeüß" for b in ("", "xy", "Zé", "longer")]
    rows = [(i, " ".join(rng.choice(words[rng.randrange(3) :]) + rng.choice(" .,1") for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None]), f"s{rng.randrange(8) * rng.randrange(2)}", 0) for i in range(300)]
    rows += [(900, "", "en", "silent", 0), (901, None, "fr", "a", 0), (902, "rare", "fr", "b", 0), (903, "rare", "it", "alone", 0)]
    assert audited(spark.createDataFrame(rows, DOCS)) == brute_divergence(rows)


def test_divergence_of_a_table(small):
    assert audited(small, least=10, ranks=7) == brute_divergence(list(map(tuple, small.collect())), 10, 7)


def test_distances_over_few_entries():
    rng = np.random.default_rng(1)
    for width in (1, 5, 40):
        base, dense = rng.integers(1, 9, 6), None
        has = rng.random((6, width)) < 0.3
        dense = np.where(has, rng.integers(10, 99, (6, width)), base[:, None])
        row, term = np.nonzero(has)
        got = divergence.compare(list("abcdef"), base, row, term, dense[has], width, np.arange(6))
        assert (got == np.abs(dense[:, None] - dense[None]).sum(2)).all()


def test_divergence_odd(spark):
    assert audited(spark.createDataFrame(ODD, DOCS), least=1) == brute_divergence(ODD, 1)
    assert audited(spark.createDataFrame([], DOCS)) == []
    clash = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in ODD], DOCS + ", term int, item int, n int, tile string")
    assert audited(clash, least=1) == brute_divergence(ODD, 1)
    import sys

    huge = [(1, "word " * (3 * (divergence.READ // 5)) + "end", "en", "s", 0), (2, "word", "en", "t", 0)]
    assert sys.getsizeof(huge[0][1]) > divergence.READ and audited(spark.createDataFrame(huge, DOCS), least=1) == brute_divergence(huge, 1)


# ---- 12


def brute_phrases(rows, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found, around = [], Counter()
    for (lang, phrase), a in f.items():
        words = phrase.split(" ")
        if a < least or len(words) < 2:
            continue
        cuts = [(10**6 * a * a // (f[lang, " ".join(words[:k])] * f[lang, " ".join(words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.append((lang, phrase, a, f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])], n[lang], score))
        if len(words) == 3:
            for w in (words[:2], words[1:]):
                around[lang, " ".join(w)] = max(around[lang, " ".join(w)], a)
    found = [x for x in found if around[x[0], x[1]] == 0 or 100 * around[x[0], x[1]] < covered * x[2]]
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i, *x[1:]) for i, x in enumerate(mine[:top], 1)]
    return sorted(out)


def mined(df, **how):
    got = collocations.mine(df, **how)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    return sorted(map(tuple, got.collect()))


PHRASES = [" ".join(random.Random(i).choice(["a", "b", "A", "aa", "é", "the", "x-y", "b.", "a,", "\t", "!", "q\n"]) for _ in range(60)) for i in range(60)]


@pytest.mark.parametrize("read,cells", [(8 << 20, 29), (500, 29), (8 << 20, 4)])
def test_phrases(spark, read, cells, monkeypatch):
    """In one shard and in many; with counters for all, and with so few that no candidate is ruled out."""
    monkeypatch.setattr(collocations, "READ", read)
    if cells < 16:
        monkeypatch.setattr(collocations, "sketch", lambda rows, least, cells: np.full(cells // 8, 255, np.uint8))
    rows = [(i, t, ["en", "de", None][i % 5 % 3], None, 0) for i, t in enumerate(PHRASES)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert mined(df) == brute_phrases(rows) != []
    assert mined(df, top=5, covered=90) == brute_phrases(rows, top=5, covered=90)


def test_phrases_of_a_table(small, monkeypatch):
    monkeypatch.setattr(collocations, "GATHERED", 1000)
    assert mined(small) == brute_phrases(list(map(tuple, small.collect())))


def test_phrases_by_shuffled_joins(small, monkeypatch):
    monkeypatch.setattr(collocations, "is_small", lambda df: False)
    assert mined(small) == brute_phrases(list(map(tuple, small.collect())))


def test_sketch_is_an_upper_bound(spark, small):
    rows = small.selectExpr("lang", "text").limit(50)
    bits, mask = collocations.sketch(rows, 3, 1 << 16), (1 << 16) - 1
    f = Counter()
    for r in rows.collect():
        f.update((r["lang"], w) for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", lower(r["text"])))
    for (lang, w), n in f.items():
        data = np.frombuffer(w.encode(), np.uint8)
        cell = int(next(collocations.Shard(lang, data, np.array([0, len(data)])).hashes())[0]) & mask
        assert n < 3 or bits[cell >> 3] >> (cell & 7) & 1


def test_phrases_odd(spark):
    assert mined(spark.createDataFrame(ODD * 5, DOCS), least=2) == brute_phrases(ODD * 5, 2)
    assert mined(spark.createDataFrame([], DOCS)) == []
    clash = spark.createDataFrame([(*r, 1, 2, "x", 4) for r in ODD * 10], DOCS + ", n int, rank int, phrase string, score int")
    assert mined(clash) == brute_phrases(ODD * 10)
    huge = [(1, "one two, three four five " * (collocations.READ // 20), "en", "s", 0)]
    assert mined(spark.createDataFrame(huge, DOCS)) == brute_phrases(huge)
    with pytest.raises(ValueError):
        collocations.mine(spark.createDataFrame(ODD, DOCS), least=256)


# ---- 13


def test_features():
    reader = toxicity.Reader({"scum$": 5.0, "lowei": 3.0, "meh$": 0.8})
    get = lambda t: dict(zip(toxicity.FEATURES, reader.features(t), strict=True))
    f = get("You are SCUM!! and loweischaft, meh. Say it: scum.")
    assert f["hits_0.7"] == 4 and f["hits_2.5"] == 3 and f["hits_3.5"] == 2 and f["strongest"] == 5 and f["second"] == 3 and f["third"] == 0.8 and f["different"] == 3
    assert f["near_you"] == 2 and [round(9 * f[x], 9) for x in ("density_2.5", "you_rate", "shouted_share", "calls_rate", "runs_of_marks")] == [3, 1, 1, 2, 1]
    g = get("such $cum, l0weigang")
    assert g["hits_2.5"] == 2 == g["disguised_hits"] and g["disguised_rate"] == pytest.approx(2 / 3)
    assert get("scum-free")["hits_0.7"] == 0 and len(reader.features(None)) == len(toxicity.FEATURES) == len(reader.features("\n \t"))
    once = reader.features("word " * 1000)
    assert all(np.isfinite(once)) and once == toxicity.Reader(reader.lexicon).features("word " * 1000)


def test_lexicon_weights():
    lead = np.array(["rare", "both", "mine", "many"], object)
    got = toxicity.learn_lexicon(lead, np.array([3.0, 50, 20, 60]), np.array([0.0, 500, 1, 0]), 100, 1000)
    assert set(got) == {"mine", "many"} and got["many"] > got["mine"]


def test_isotonic():
    rng = np.random.default_rng(2)
    raw, y = rng.integers(0, 30, 200) / 3, (rng.random(200) < 0.5).astype(float)
    xs, ps = toxicity.isotonic(raw, y)
    at = np.unique(raw)
    mean, n = np.array([y[raw == v].mean() for v in at]), np.array([(raw == v).sum() for v in at])
    # The best rising fit at k is the greatest, over starts, of the least, over ends, mean of a stretch around k.
    best = [max(min((mean * n)[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    assert np.allclose(np.interp(at, xs, ps), best) and (np.diff(ps) >= 0).all()


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(3)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = toxicity.Boosted(x[:1000], y[:1000])
    assert ((model.raw(x[1000:]) > 0) == (y[1000:] > 0.5)).mean() > 0.95
    feature, cut, value = model.trees[0]
    for row in x[:50]:  # a tree against a walk through it
        at = 0
        while at < len(feature) and feature[at] >= 0:
            at = 2 * at + 1 + int(model.binned(row[None])[0, feature[at]] > cut[at])
        assert model._leaf(model.trees[0], model.binned(row[None]))[0] == value[at]
    assert len(model.raw(x[:0])) == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == r["held_out"] and (r["score"] >= 0.3) == r["predicted"] and 0 <= r["score"] <= 1 for i, r in got.items())
    toxic, clean = [r["predicted"] for y, r in held if y == 1], [r["predicted"] for y, r in held if y == 0]
    assert sum(toxic) > 0.9 * len(toxic) > 90 and sum(clean) < 0.01 * len(clean)


def test_toxicity_reads_texts_alone(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = lambda df, marks=labels: {r["doc_id"]: r["score"] for r in toxicity.score(df, marks).collect()}
    plain = scores(small)
    assert scores(small.selectExpr("doc_id", "text", "'x' lang", "'y' source", "1 n_chars").repartition(7)) == plain
    unseen = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END toxic")
    assert scores(small, unseen) == plain


def test_toxicity_odd(spark):
    labels = "doc_id bigint, quality int, toxic int"
    none = spark.createDataFrame([], labels)
    got = toxicity.score(spark.createDataFrame(ODD, DOCS), none)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")] and [r["score"] for r in got.collect()] == [0.0] * 7
    assert [r["held_out"] for r in got.collect() if r["doc_id"] is None] == [False]
    assert toxicity.score(spark.createDataFrame([], DOCS), none).collect() == []
    marks = spark.createDataFrame([(2, 1, 1), (3, 1, None), (None, 1, 1), (99, 0, 1), (4, None, 0), (4, 1, 0), (1, 1, 0)], labels)
    clash = spark.createDataFrame([(*r, 1, 2, 3.0) for r in ODD], DOCS + ", toxic int, y int, score double")
    got = toxicity.score(clash, marks).collect()
    assert len(got) == 7 and len({r["score"] for r in got if r["doc_id"] == 4}) == 1 and all(0 <= r["score"] <= 1 for r in got)
