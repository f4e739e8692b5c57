"""The registered queries against SQL, and the pipeline against a plain version of its stages."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from test_llm_operators import ODD, brute_components, check_packing, docs_of, low

import corpus_pipeline
from strandwise.llm import queries
from strandwise.llm._runtime import written


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, duck, same):
    same(queries.QUERIES[name](spark, sf_dir), duck.execute(queries.ORACLE_SQL[name]).df())


def test_queries_return_every_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_exact_dedup", "op2_language_id", "op5_lm_scoring", "op6_mixing", "op7_toxicity", "op9_near_dedup"):
        assert queries.QUERIES[name](spark, sf_dir).select("doc_id").distinct().count() == n
    assert queries.op10_url_filter(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def plain_targets(sizes):
    """Words to take by source, after the contract: weights 3, 1, 2 in code-point order, null last, at most twice a source's words."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else share[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return {s: math.floor(t) for s, t in target.items()}


def words(text):
    return len(low(text).split())


def check_mix(had, got):
    """Each source's words are exactly its target, by whole copies of its rows and one beginning of a row."""
    sizes, taken, parts = Counter(), Counter(), Counter()
    texts = {}
    for r in had:
        sizes[r.source] += words(r.text)
        texts.setdefault((r.doc_id, r.source), []).append(r.text)
    for r in got:
        taken[r.source] += words(r.text)
        whole = texts[(r.doc_id, r.source)]
        parts[r.source] += r.text not in whole
        assert any((t or "").startswith(r.text) for t in whole)
    assert {s: taken[s] for s in sizes} == plain_targets(sizes)
    assert max(parts.values(), default=0) <= 1
    again = Counter((r.doc_id, r.source) for r in got)
    assert all(n <= 2 * len(texts[k]) for k, n in again.items())


def staged(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, ""), name)
        yield name, before, docs


#: Ids that repeat with other texts, one of them a text of another id, and rows without an id.
REPEATED = [
    (5, "one text that only this row has, with enough words to tell", "en", "a"),
    (5, "a text that another id has too, with enough words", "en", "a"),
    (9, "a text that another id has too, with enough words", "en", "b"),
    (None, "a text that another id has too, with enough words", "en", "b"),
    (None, "a text of rows without an id", "en", None),
    (None, "A text of rows without an id", "en", None),
    (7, "a text of a repeated row", "en", None),
    (7, "a text of a repeated row", "en", None),
]


@pytest.mark.parametrize("which", ["documents", "odd", "repeated", "empty"])
def test_pipeline_stages(spark, sf_dir, which, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if which == "documents" else docs_of(spark, {"odd": ODD, "repeated": REPEATED, "empty": []}[which])
    for name, before, after in staged(spark, docs):
        had = before.collect()
        got = after.collect()
        if name in ("language_id", "exact_dedup", "near_dedup"):
            assert after.columns == docs.columns
            assert not Counter(map(str, got)) - Counter(map(str, had))
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text) for r in got)
            if which != "odd":
                assert len(got) == sum(any(c.isalpha() for c in r.text or "") for r in had)
        elif name == "exact_dedup":
            best = {}
            for r in had:
                best[low(r.text)] = max(best.get(low(r.text), -1), -1 if r.doc_id is None else r.doc_id)
            assert Counter((low(r.text), -1 if r.doc_id is None else r.doc_id) for r in got) == Counter(best.items())
        elif name == "near_dedup":
            order = sorted(range(len(had)), key=lambda k: (had[k].doc_id is None, had[k].doc_id))
            want = brute_components([(n, had[k].text) for n, k in enumerate(order)], 5, 4, 5)
            classes = {c: {had[order[i]] for i, (_, x) in want.items() if x == c} for c in {x for _, x in want.values()}}
            assert len(got) == len(classes)
            assert all(len(set(got) & members) == 1 for members in classes.values())
            assert all(min((m.doc_id for m in members if m.doc_id is not None), default=None) in {m.doc_id for m in set(got) & members} for members in classes.values())
        elif name == "mixing":
            assert after.columns == docs.columns
            check_mix(had, got)
        else:
            check_packing(got, [(r.doc_id, r.text) for r in had], 1024)


def test_language_stage_drops_unknown_text(spark):
    """Planted in the documents: other languages, scripts, random letters and no letters go, all others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由，在尊严和权利上一律平等。" * 3, "zq xj kvw qqp zxv wkj pfq jjz " * 10, "1234 5678", ""]
    planted = spark.createDataFrame([(10**9 + n, t) for n, t in enumerate(strange)], "doc_id long, text string")
    got = corpus_pipeline.language_id(spark, docs.unionByName(planted, allowMissingColumns=True), "")
    assert got.where(f"doc_id >= {10**9}").count() == 0
    assert got.count() == docs.where(r"regexp_like(text, '\\p{L}')").count()


def test_run_is_the_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, _, docs in staged(spark, docs):  # noqa: B007
        pass
    pieces = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, sf_dir)) == pieces(docs)


def held_out(doc_id, parts, remainder):
    return zlib.crc32(str(doc_id).encode()) % parts == remainder


def test_toxicity_held_out_at_sf01(spark):
    """On the documents that learning leaves out: toxic ones found, others left alone."""
    sf = "/root/testdata/sf0.1"
    predicted = {r.doc_id: r.predicted for r in queries.op7_toxicity(spark, sf).collect()}
    held = [(r.toxic, predicted[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held_out(r.doc_id, 3, 1)]
    assert sum(p for t, p in held if t) >= 0.85 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.015 * sum(1 - t for t, _ in held)


def test_language_held_out_at_sf01(spark):
    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect() if r.lang}
    held = [r for r in queries.op2_language_id(spark, sf).collect() if r.held_out and r.doc_id in lang]
    assert len(held) > 3000
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)


def test_base_columns_of_lm_scoring(spark, sf_dir, duck):
    """The columns of op5 that SQL can express, as registered."""
    want = duck.execute(r"""
        WITH d AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS t FROM documents),
        w AS (SELECT doc_id, unnest(t) AS token FROM d)
        SELECT doc_id, token FROM w
    """).fetchall()
    docs = defaultdict(list)
    for doc_id, token in want:
        docs[doc_id].append(token)
    counts = Counter(t for k, own in docs.items() if not held_out(k, 10, 0) for t in own)
    total, distinct = sum(counts.values()), len(counts)
    for r in queries.op5_lm_scoring(spark, sf_dir).collect():
        own = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 10, 0), len(own), sum(counts[t] > 0 for t in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own), rel_tol=1e-9)
        assert r.score < 0
