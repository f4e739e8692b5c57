"""Quality rules, whitening and the divergence audit against brute force, and on odd tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import ODD, docs_of

from strandwise.llm import _bytes, divergence, quality, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


MORE = [
    (20, "a b c d a b c\n\n a b c \nx\nx\n \nx y\r\nx y", "en", "a"),
    (21, "é# ñ* \U0001f600|<>\n" * 40, "en", "a"),
    (22, "\n\n\n", "en", "a"),
    (23, "same same same same", "en", "b"),
]


def test_quality_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs_of(spark, ODD + MORE).select("doc_id", "text"))
    want = Counter((r.doc_id, *plain_counts(r.text)) for r in docs.collect())
    got = quality.judge_quality(docs, quality.Trees.none()).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_quality_query_held_out(spark):
    """Every row as registered; on documents that training leaves out nearly all bad ones go and good ones stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op11_quality_rules(spark, sf).collect()}
    assert len(got) == docs.count()
    assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for k, r in got.items()} == {r.doc_id: plain_counts(r.text) for r in docs.collect()}
    judged = [(x.quality, got[x.doc_id]) for x in labels.collect() if zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    bad = [r.kept for q, r in judged if q == 0]
    good = [r.kept for q, r in judged if q == 1 and not r.base_failed]
    assert len(bad) > 10 and len(good) > 50
    assert sum(bad) <= 0.03 * len(bad)
    assert sum(good) >= 0.97 * len(good)


def test_quality_long_text_by_parts(monkeypatch):
    text = ("one two  three four\n" * 50 + "x" * 3000 + "\n" + "y " * 900 + "\n" + "one two\n" * 3).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = quality.statistics(data, offsets)
    monkeypatch.setattr(_bytes, "PART", 256)
    parts = quality.statistics(data, offsets)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])
    assert tuple(whole[0][0]) == plain_counts(text.decode())


def test_trees_obey_constraints_and_flatten():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    noise = rng.random(3000) < 0.1
    y = ((x[:, 0] - x[:, 1] + np.sin(3 * x[:, 2]) > 0) ^ noise).astype(int)
    trees = quality.Trees.fit(x, y, np.array([1, -1, 0, 0]), trees=40)
    assert ((trees.margin(x) > 0) == (y == 1)).mean() > 0.85
    for f, sign in ((0, 1), (1, -1)):
        for row in x[:50]:
            line = np.repeat(row[None], 60, axis=0)
            line[:, f] = np.linspace(-3, 3, 60)
            assert (sign * np.diff(trees.margin(line)) >= -1e-12).all()
    def walk(row):
        total = 0.0
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.right[node] if row[trees.feature[node]] > trees.threshold[node] else trees.left[node]
            total += trees.value[node]
        return total
    assert np.allclose(trees.margin(x[:200]), [walk(r) for r in x[:200]])


def test_quality_of_odd_training(spark):
    docs = docs_of(spark, ODD)
    everyone = F.lit(True)
    for rows in ([], [(5, 1)], [(5, None), (None, 0)], [(5, 1), (9, 1)]):
        trees = quality.learn_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int"), everyone)
        assert not len(trees.roots)
    trees = quality.learn_quality(docs, spark.createDataFrame([(5, 1), (5, 0), (9, 0), (10, 1), (11, 1), (77, 1)], "doc_id long, quality int"), everyone)
    assert len(quality.judge_quality(docs, trees).collect()) == len(ODD)
    assert quality.judge_quality(docs_of(spark, []), trees).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, x string, component long")


def check_whitening(got, rows, most=16):
    """Against exact integers and numpy's own covariance."""
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, len(sums))
    assert len(got) == k * len(rows)
    answers = defaultdict(list)
    for r in got:
        answers[r.vec_id, r.component].append(r)
    for i, v in x:
        own = np.array([float(n * a - s) / n for a, s in zip(v, sums, strict=True)])
        exact = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for c in range(1, k + 1):
            r = answers[i, c][0]
            assert r.n == n and r.deviation == exact
            assert math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-6)
            assert abs(abs(r.whitened) - abs(own @ vectors[:, c - 1]) / math.sqrt(values[c - 1])) < 1e-6
            assert r.identity_error < 1e-8


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(queries.op12_whitening(spark, sf_dir).collect(), rows)


def test_whitening_odd(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.normal(size=5) * [1, 2, 3, 4, 50]]) for i in range(60)]
    good += [(i, good[0][1]) for i in range(100, 180)] + [(None, good[1][1]), (7, good[7][1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [1.0, float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (206, [3e38] * 5)]
    got = whitening.whiten(vectors_of(spark, [(i, v, "n", "x", 1) for i, v in good + bad])).collect()
    check_whitening(got, [(i, [np.float32(c) for c in v]) for i, v in good])
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(i, v, "n", "x", 1) for i, v in bad[:5]])).count() == 0


def test_whitening_without_full_rank(spark):
    """One dimension that never changes and one that is another's copy: two components have no variance."""
    rows = [(i, [float(i % 7), float(i % 7), 3.0, float(i % 5)], "n", "x", 1) for i in range(35)]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1, 2}
    assert all(r.identity_error < 1e-9 for r in got) and len(got) == 35 * 4
    alone = whitening.whiten(vectors_of(spark, rows[:1] * 3)).collect()
    assert len(alone) == 12 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in alone)


def plain_audit(rows, least=10, top=10):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    cut = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for t, lang, source in rows]
    docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in cut:
        groups[lang].add(source)
        docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for x, t in docs if x == lang and docs[x, t] >= least), key=str.encode)
        whole = sum((counts[lang, s] for s in sources), Counter())
        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (c[t] + 2) // total for t in kept]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(whole)
        for s in sources:
            own = p(counts[lang, s])
            pairs = [(o, sum(map(f, own, p(counts[lang, o])))) for o in sources - {s}]
            terms = [(t, f(a, b)) for t, a, b in zip(kept, own, q, strict=True) if counts[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda e: (-e[1], e[0].encode()))
                out += [(lang, s, part, item, v, n) for n, (item, v) in enumerate(found, 1) if part == "pair" or n <= top]
    return sorted(out)


@pytest.mark.parametrize("chunk", [divergence.CHUNK, 3])
def test_divergence(spark, chunk):
    rng = np.random.default_rng(1)
    words = ["alpha", "Beta", "gamma", "étà", "ÉTÀ", "x", "\U0001f600", "￿", "z9z", "don't"]
    rows = [(None, None, None), ("", "en", ""), ("1 2 3", "fr", "solo"), ("A b", "xx", None)]
    for k in range(300):
        w = rng.choice(words, size=rng.integers(0, 30), p=rng.dirichlet(np.ones(len(words)) * (1 + k % 3)))
        rows.append((" ".join(w), [None, "en", "de"][k % 3], ["a", "b", None, "ü", "c"][int(rng.integers(5))]))
    docs = docs_of(spark, [(k, *r) for k, r in enumerate(rows)]).repartition(5)
    got = divergence.audit(docs, chunk=chunk).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == plain_audit(rows)
    assert divergence.audit(docs_of(spark, [])).count() == 0


def test_divergence_odd(spark):
    got = divergence.audit(docs_of(spark, ODD), least_docs=1).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == plain_audit([r[1:] for r in ODD], least=1)


def test_shares_of_large_counts():
    counts, total = np.array([0, 5, 10**15, 9 * 10**15 - 20]), np.int64(9 * 10**15)
    assert divergence._shares(counts, total).tolist() == [1 + 10**9 * (c + 2) // int(total) for c in counts.tolist()]


def test_terms_of_long_texts_by_parts(monkeypatch):
    text = ("Ab cd " * 300 + "é" * 900 + " " + "x" * 300 + "-" * 700 + "ab").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    names, code, _ = divergence._terms(data, offsets)
    monkeypatch.setattr(_bytes, "PART", 128)
    parts, again, doc = divergence._terms(data, offsets)
    assert [names[c].as_py() for c in code] == [parts[c].as_py() for c in again] and not doc.any()
