"""Merkle manifest, spelling variants and the recurrent language model against brute force, with every edge case."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import llm_helpers as brute  # noqa: E402

from tidepanel.llm import common, grulm, merkle, spelling  # noqa: E402
from tidepanel.llm.queries import QUERIES  # noqa: E402

LOWERED = str.maketrans(spelling.UPPER, spelling.LOWER)


@pytest.fixture(scope="module")
def rows():
    return [(*r[:1], f"Upper {r[1]}", *r[2:]) if r[0] == 6 else r for r in brute.edge_rows()]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, brute.SCHEMA)
    return df.withColumns({"word": F.lit(1), "n": F.lit("x"), "leaf": F.lit(2), "digest": F.lit(3), "row": F.lit(4),
                           "ids": F.lit(5), "at": F.lit(6)}).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fan):
    """Root of nodes in order and, for each, its (left, right) siblings upward."""
    paths, level, owner = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + fan] for i in range(0, len(level), fan)]
        for k, o in enumerate(owner):
            run, pos = runs[o // fan], o % fan
            paths[k].append(("".join(run[:pos]), "".join(run[pos + 1:])))
            owner[k] = o // fan
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def manifest(rows, fan):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    groups = {}
    for r in rows:
        bad = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0
        held = (leaf(r, r[1]), leaf(r, r[1].translate(LOWERED) if bad and r[1] is not None else r[1]))
        groups.setdefault(r[3], []).append((r[0], *held))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(tree([x[1] for x in groups[s]], fan))
    root, tops = tree([t[0] for t in trees], fan)
    out = []
    for s, (subroot, paths), top in zip(order, trees, tops):
        for (i, own, changed), path in zip(groups[s], paths):
            folded = changed
            for left, right in path + top:
                folded = sha(left + folded + right)
            out.append((i, own, subroot, root, sha("".join(a + b for a, b in path + top)), folded, folded == root))
    return out


def same(found, expected):
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, expected), key=repr)


@pytest.mark.parametrize("fan", [2, 16])
def test_manifest_equals_brute_force(docs, rows, fan):
    found = merkle.audit(docs, fan).collect()
    same(found, manifest(rows, fan))
    assert [r["verified"] for r in found if r["doc_id"] == 6] == [False] and any(r["verified"] for r in found)


def test_manifest_of_one_row_one_group_and_none(spark, rows):
    for part in (rows[:1], [r for r in rows if r[3] == "s0"], [(k, "Same", "en", f"g{k:03}", 1) for k in range(40)],
                 [(7, "Same", "en", "hot", 1)] * 300):
        same(merkle.audit(spark.createDataFrame(part, brute.SCHEMA)).collect(), manifest(part, 16))
    assert merkle.audit(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_records_are_addressed_by_their_content(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"),
                                   F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    made = merkle.manifest(rows, fan=4)
    assert len(made.records) == 5 and made.records[-1].count() == 1
    for level in made.records:
        for r in level.collect():
            assert r["digest"] == sha("".join(r["children"])) and len(r["children"]) <= 4


def variants(rows, least=5, times=5, every=199):
    counts = Counter()
    for i, text in ((r[0], r[1]) for r in rows):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    links = {w: [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    form = {w: min(links[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: x if x and words[x] >= times * words[w] else None for w, x in form.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(links[w]), words.get(form[w])))
    return out


def spelled():
    """Words with planted variants at both ends and in the middle, ties, chains, letters beyond ASCII, repeated grams."""
    texts, at = [], 0
    for base in ("banana", "aaaaaa", "abababab", "Élévation", "straße", "mississippi", "naïveté", "zzzzzzz", "pneumonia"):
        lower = base.translate(LOWERED)
        forms = {base: 750, lower[1:]: 12, lower[:-1]: 6, "x" + lower: 5, lower + "y": 25, lower[:3] + "q" + lower[3:]: 9,
                 lower[:2] + "w" + lower[3:]: 130, lower[:2] + "wv" + lower[4:]: 20, lower[:-2] + lower[-1:]: 4}
        for word, n in forms.items():
            for start in range(0, n, 50):
                texts.append((at, " ".join([word] * min(50, n - start)), "en", "s", 1))
                at += 1
    return texts + [(None, None, None, None, None), (at, "", "en", "s", 0), (at, "short 12345 ×÷", "en", "s", 0),
                    (at + 1, "banana_" * 5000, "en", "s", 0), (None, "banana bananb " * 6, "en", "s", 0)]


@pytest.mark.parametrize("every", [199, 0])
def test_variants_equal_brute_force(spark, rows, every):
    for part in (spelled(), rows):
        docs = spark.createDataFrame(part, brute.SCHEMA).withColumns({"word": F.lit(1), "n": F.lit("x")}).repartition(3)
        found = spelling.variants(spelling.occurrences(docs, every=every).where("n >= 5")).collect()
        same(found, variants(part, every=every or 1 << 40))
    assert spelling.variants(spelling.occurrences(docs.limit(0))).count() == 0


def test_near_pairs_lose_none_among_random_words(spark):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 9))) for _ in range(700)}
    pairs = {(r["word"], r["other"]) for r in spelling.near_pairs(
        spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()}
    dropped = {}
    for w in words:
        for k in range(len(w)):
            dropped.setdefault((k, w[:k] + "*" + w[k + 1:]), set()).add(w)
            dropped.setdefault(w[:k] + w[k + 1:], set()).add(w)
        dropped.setdefault(w, set()).add(w)
    groups = [g for key, g in dropped.items() if isinstance(key, tuple)]
    expected = {(a, b) for g in groups for a in g for b in g if a != b}
    expected |= {(a, b) for key, g in dropped.items() if key in words for a in g for b in g
                 if a != b and abs(len(a) - len(b)) == 1 and key in (a, b)}
    assert pairs == expected and len(pairs) > 1000


def unigram(rows, kept):
    """(n_tokens, n_known, train_tokens, base_score) of every row."""
    split = [[*(r[1] or "").encode().lower().split(), None] for r in rows]
    counts = Counter(t for words, k in zip(split, kept) if k for t in words)
    total = sum(counts.values())
    return [(len(w), sum(t in counts for t in w), total,
             sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in w)) for w in split]


def test_base_scores_equal_brute_force(docs, rows, monkeypatch):
    held_out = common.crc_of("doc_id") % 7 == 2
    kept = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2 for r in rows]
    expected = sorted(unigram(rows, kept))
    for listed in (grulm.LISTED, 20, 0):                       # most or all words through the join
        monkeypatch.setattr(grulm, "LISTED", listed)
        settings = grulm.Settings(words=16, classes=4, hidden=4, slots=8, rounds=2)
        found = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                       for r in grulm.fit_and_score(docs, held_out, settings).collect())
        assert [f[:3] for f in found] == [e[:3] for e in expected]
        assert all(math.isclose(f[3], e[3], rel_tol=1e-9, abs_tol=1e-9) for f, e in zip(found, expected))
        assert all(math.isfinite(f[4]) and f[4] < 0 for f in found)


def test_scores_do_not_depend_on_how_texts_lie_together(docs):
    """The state is carried through each whole text: alone, or beside others, over many windows."""
    settings = grulm.Settings(words=64, classes=6, hidden=6, slots=4, rounds=2, window=5)
    lexicon = grulm.gather(docs)
    coded = grulm.encode(docs, lexicon, settings, ["doc_id"])
    weights = grulm.train(coded, lexicon, settings)
    found = {r["doc_id"]: r for r in grulm.score(coded, lexicon, weights, settings).collect()}
    _, counts, end_id, unknown = grulm.vocabulary(lexicon, settings)
    net = grulm.Network(counts, end_id, unknown, settings)
    net.set(weights)
    c = {bytes(r["word"]): r["c"] for r in lexicon.table.where("word IS NOT NULL").collect()}
    known = set(lexicon.words[:lexicon.network_size(settings)])
    tokens, words = lexicon.outside(settings)
    for r in coded.where("kept.doc_id IN (4, 200, 204, 207)").select("kept.doc_id", "ids").collect():
        h, total = np.zeros((6, 1), np.float32), 0.0
        for i in r["ids"]:
            total += float(net.outputs(h.T, np.array([i]))[0][0]) / math.log(10)
            h = net.states(np.array([[i]]), h)[0][-1]
        text = docs.where(F.col("doc_id") == r["doc_id"]).first()["text"]
        total += sum(math.log10((c.get(w, 0) + 1) / (tokens + words + 1))
                     for w in (text or "").encode().lower().split() if w not in known)
        assert math.isclose(found[r["doc_id"]]["score"], total, rel_tol=1e-4)


def test_gradients_and_sum_of_probabilities():
    settings = grulm.Settings(words=12, classes=4, hidden=5, window=6, slots=3)
    net = grulm.Network(np.array([9, 7, 6, 5, 4, 3, 2, 2, 1, 1, 1, 0]), 1, 0, settings)
    rng = np.random.default_rng(0)
    ids, valid = rng.integers(0, 12, (6, 3)), np.ones((6, 3), bool)
    valid[4:, 2] = False
    h = rng.normal(0, .5, (5, 3)).astype(np.float32)
    grad, _, n, _ = net.gradients(ids, valid, h)
    start = net.flat.copy()

    def loss(flat):
        net.set(flat)
        return -net.outputs(net.states(ids, h)[0][:-1].transpose(0, 2, 1)[valid], ids[valid])[0].sum(dtype=np.float64) / n

    for k in rng.choice(len(start), 80, replace=False):
        step = np.zeros_like(start)
        step[k] = 1e-2
        assert abs((loss(start + step) - loss(start - step)) / 2e-2 - grad[k]) < 1e-4
    net.set(start)
    assert abs(np.exp(net.outputs(np.repeat(h.T[:1], 12, 0), np.arange(12))[0]).sum() - 1) < 1e-5


def test_registered_queries_on_sample_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in common.table(spark, sf, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    same(QUERIES["op13_merkle_manifest"](spark, sf).collect(), manifest(rows, 16))
    same(QUERIES["op12_spelling_variants"](spark, sf).collect(), variants(rows))
    kept = [zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    found = sorted(QUERIES["op11_gru_scores"](spark, sf).collect(), key=lambda r: r["doc_id"])
    expected = [e for _, e in sorted(zip((r[0] for r in rows), unigram(rows, kept)))]
    assert [r["held_out"] for r in found] == [not k for _, k in sorted(zip((r[0] for r in rows), kept))]
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found] == [e[:3] for e in expected]
    assert all(math.isclose(r["base_score"], e[3], rel_tol=1e-9) for r, e in zip(found, expected))


def test_the_model_beats_word_counts_on_held_out_texts(spark):
    found = QUERIES["op11_gru_scores"](spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert found[0] > found[1] + 0.1
