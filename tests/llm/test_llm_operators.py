"""The dealt operators against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandwise.llm import _bytes, exact_dedup, language_id, lm_score, mixing, near_dedup, packing, queries, rows, token_output, topk, toxicity, url_filter
from strandwise.llm._tokens import ByteTokenizer, tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin long, id long, size string, owner string, component string"


def docs_of(spark, found):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, 2, "s", "o", "c") for i, t, lang, s in found], SCHEMA)


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "   \n\t", "en", "a"),
    (4, "12 34 !?", "de", "b"),
    (5, "One two three four five six seven.", "en", "b"),
    (6, "ONE two three four five six seven.", "fr", "b"),
    (7, "one two", "es", None),
    (8, "one two", "es", None),
    (8, "one two", "es", None),
    (None, "One two three four five six seven.", "en", "c"),
    (9, "word " * 5000, "en", "c"),
    (10, "ééé ñ \u2028 \U0001f600 <|endoftext|> x", "fr", "c"),
    (11, "x" * 20000, "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def low(text):
    return (text or "").encode().lower()


# exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("limit", [48 << 20, 2000])
def test_exact_dedup(odd, keep, limit):
    got = exact_dedup.exact_dedup(odd, keep=keep, limit=limit).collect()
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[low(t)].append(i)
    pick = {t: (min if keep == "min" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = sorted(repr((i, pick[low(t)], len(groups[low(t)]), i == pick[low(t)], hashlib.sha256(low(t)).hexdigest())) for i, t, *_ in ODD)
    assert sorted(repr(tuple(r)) for r in got) == want


def test_trie_spills_without_loss():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(3000)]
    trie = exact_dedup.PatriciaTrie(limit=20_000)
    for n, t in enumerate(texts):
        trie.insert(t, n)
    assert trie.spilled
    got = {t: (owner, n) for t, owner, n in trie.entries()}
    count = Counter(texts)
    assert got == {t: (texts.index(t), n) for t, n in count.items()}


# language


def test_languages_held_out(spark, sf_dir):
    got = queries.op2_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_languages_odd(odd, empty):
    model = language_id.learn_languages(odd)
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 4}
    assert got[1].score == 0
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.learn_languages(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    single = language_id.learn_languages(odd.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(odd, single).collect()} == {"und", "en"}


def test_copies_leave_room_for_other_languages(spark):
    """A large group of copies that the hash picks counts once."""
    many = spark.range(2000).select(F.concat(F.lit("copied text number "), "id").alias("text"))
    copied = many.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 20))).head().text
    found = [(i, copied, "en", "a") for i in range(3000)]
    found += [(3000 + i, f"{word} {i} {word}", lang, "a") for lang, word in (("en", "house"), ("fr", "maison"), ("es", "casa")) for i in range(100)]
    model = language_id.learn_languages(docs_of(spark, found).coalesce(1), sample=50)
    assert set(model.languages) == {"en", "fr", "es"}


def test_a_language_of_one_text(spark):
    """All rows of a language share one text: it is learned, whatever the text's hash."""
    found = [(i, f"{word} {i} {word}", lang, "a") for lang, word in (("en", "house"), ("fr", "maison")) for i in range(100)]
    for text in ("una casa", "otra casa", "mi casa", "la casa"):
        model = language_id.learn_languages(docs_of(spark, found + [(1000 + i, text, "es", "a") for i in range(300)]), sample=20)
        assert model.languages == ["en", "es", "fr"]


def test_unknown_text_is_not_recognised(spark):
    """Foreign, other scripts and random letters, against held-out documents of the learned languages."""
    rng = random.Random(12)
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn_languages(documents.where(queries.fold("doc_id", 3) != 1))
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem " * 5,
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400)),
        "x" * 3000,
    ]
    got = language_id.identify(docs_of(spark, [(i, t, None, None) for i, t in enumerate(strange)]), model).collect()
    assert [r.recognised for r in got] == [False] * len(strange)
    held = language_id.identify(documents.where(queries.fold("doc_id", 3) == 1), model).where("lang_pred <> 'und'")
    assert held.where("not recognised").count() == 0


# packing


def check_packing(got, found, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    own = tokenizer(VOCABULARY)
    want = Counter()
    for i, t, *_ in found:
        ids = np.append(own.ids(t), 2).astype("<u4")
        first = len(ids) if len(ids) <= length else len(ids) % length or length
        cuts = [0, *range(first, len(ids) + 1, length)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for own_pieces in by_seq.values():
        at = 0
        for r in sorted(own_pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length


def test_packing_odd(odd, empty):
    check_packing(packing.pack(odd, VOCABULARY, 2, buffer=3).collect(), ODD, 1024)
    assert packing.pack(empty, VOCABULARY, 2).count() == 0


def test_packing_is_tight(documents):
    got = packing.pack(documents.repartition(13), VOCABULARY, 2).collect()
    check_packing(got, [(r.doc_id, r.text) for r in documents.collect()], 1024)
    used = len({r.sequence_id for r in got})
    assert used <= 1.02 * math.ceil(sum(r.length for r in got) / 1024)


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_packing_of_few_partitions(documents, parts):
    got = packing.pack(documents.coalesce(1) if parts == 1 else documents.repartition(parts), VOCABULARY, 2)
    assert got.select("sequence_id").distinct().count() <= 193  # 192 at least


def test_packing_of_clustered_lengths(spark):
    """Partitions of a single length each, whose pieces only fit with those of others: as many sequences as pairs."""
    own = tokenizer(VOCABULARY)
    long, short = " the" * 599, " the" * 399
    assert (len(own.ids(long)), len(own.ids(short))) == (599, 399)
    found = [(i, long if i < 3000 else short, "en", "a") for i in range(6000)]
    docs = docs_of(spark, found).repartitionByRange(2, F.col("doc_id") < 3000)
    for fan_in in (8, 2):
        got = packing.pack(docs, VOCABULARY, 2, fan_in=fan_in).collect()
        check_packing(got, found, 1024)
        assert len({r.sequence_id for r in got}) == 3000


def test_best_fit_of_runs():
    rng = random.Random(10)
    for _ in range(200):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 120))]
        runs = packing.best_fit_runs(Counter(sizes), 40)
        assert sorted(fill for bins, fill, _ in runs for _ in range(bins)) == sorted(packing.best_fit(np.array(sizes), 40)[2].tolist())
        ranks = Counter((s, first + k) for bins, _, held in runs for s, each, first, _ in held for k in range(bins * each))
        assert ranks == Counter((s, k) for s, n in Counter(sizes).items() for k in range(n))
        assert all(fill <= 40 and [at for *_, at in held] == np.cumsum([0, *[s * e for s, e, *_ in held]])[:-1].tolist() for _, fill, held in runs)


def test_best_fit():
    place, offset, fill = packing.best_fit(np.array([6, 5, 4, 5]), 10)
    assert sorted(fill.tolist()) == [10, 10]
    assert token_output.best_fit_decreasing([6, 5, 4, 5], 10) == [[0, 2], [1, 3]]


def test_segment_tree_search():
    rng = random.Random(2)
    for capacity in (1, 2, 7, 8, 64, 100):
        tree, rooms = token_output.CapacityTree(capacity), Counter()
        for n in range(200):
            if rng.random() < 0.6:
                room = rng.randint(1, capacity)
                tree.put(n, room)
                rooms[room] += 1
            else:
                least = rng.randint(1, capacity)
                want = min((r for r, c in rooms.items() if c and r >= least), default=None)
                found = tree.take(least)
                assert (found and found[1]) == want
                if want:
                    rooms[want] -= 1


def test_token_rows(odd, empty):
    made = token_output.write_token_rows(odd, VOCABULARY, 2, length=64, buffer=500)
    digests = token_output.segment_digests(made).collect()
    assert all(r.positions_reset for r in digests)
    own = tokenizer(VOCABULARY)
    back = defaultdict(list)
    for r in made.collect():
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used
        for k, (d, p) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            back[(d, p)].append(ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist())
    for i, t, *_ in ODD:
        ids = [x for p in range(2000) if (i, p) in back for x in back[(i, p)][0]]
        assert ids == [*own.ids(t).tolist(), 2]
    assert token_output.segment_digests(token_output.write_token_rows(empty, VOCABULARY, 2)).count() == 0


def test_ids_are_those_of_tokenizers(documents):
    from tokenizers import Tokenizer

    slow, own = Tokenizer.from_file(VOCABULARY), ByteTokenizer(VOCABULARY)
    assert own.fast is not None
    texts = [r.text for r in documents.select("text").collect()] + [t for _, t, *_ in ODD if t] + ["  \u00a0\u3000 a\r\n\r\n b", "don't I'LL", " " * 3000, "\x00\x7f", "<|endoftext|><|endoftext|> a", "a1b2 ½²٣", "é\u0301\u200d"]
    for t in texts:
        assert own.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


# language model


def test_base_scores(spark, odd, empty):
    got = lm_score.lm_score(odd.where("doc_id is not null"), F.col("doc_id") % 2 == 1, frequent=2).collect()
    found = [(i, t) for i, t, *_ in ODD if i is not None]
    train = Counter(w for i, t in found if i % 2 for w in [*low(t).split(), None])
    total, distinct = sum(train.values()), len(train)
    for r in got:
        words = [*low(next(t for i, t in found if i == r.doc_id)).split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(train[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words))
        assert r.score < 0
    assert len(got) == len(found)
    assert lm_score.lm_score(empty, F.col("doc_id") > 0).count() == 0
    untrained = lm_score.lm_score(odd.where("doc_id = 5"), F.col("doc_id") < 0).head()
    assert untrained.score == pytest.approx(-math.log10(257) * (len(ODD[4][1]) + 1), rel=1e-5)


def test_ppm_by_hand(spark):
    """Escapes and exclusion, against a plain recursive version."""
    texts = ["abracadabra", "abrabra", "cab"]
    order = 2
    counts = defaultdict(Counter)
    for t in texts:
        data = b"\xff" * order + t.encode() + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1

    def p(symbol, context, excluded=frozenset()):
        """Probability after a context, its own symbols excluded from what comes below."""
        own = counts.get(context)
        if own is None:
            return p(symbol, context[1:])
        n, u = sum(own.values()), len(own)
        if symbol in own:
            return (own[symbol] - 0.5) / n
        lower = (lambda s: p(s, context[1:])) if context else (lambda s: 1 / 257)
        return 0.5 * u / n * lower(symbol) / (1 - sum(lower(s) for s in own))

    docs = spark.createDataFrame(list(enumerate([*texts, "abcx"])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.lm_score(docs, F.col("doc_id") < 3, order=order).collect()}
    for i, t in enumerate([*texts, "abcx"]):
        data = b"\xff" * order + t.encode() + b"\xff"
        want = sum(math.log10(p(data[k], data[k - order : k])) for k in range(order, len(data)))
        assert got[i] == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("limits", [{}, {"frequent_grams": 100}])
def test_ppm_holds_every_context(spark, limits):
    """More contexts than any fixed table once held, against counts of all of them; one text has grams never seen."""
    rng = random.Random(9)
    order, letters = 5, "abcdefghijklmnopqrstuvwxyz01234"
    texts = ["".join(rng.choices(letters, k=5000)) for _ in range(34)]
    counts = defaultdict(Counter)
    for t in texts[:32]:
        data = b"\xff" * order + t.encode() + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1
    assert sum(len(c) == order for c in counts) > 1 << 17

    def p(symbol, context):
        own = counts.get(context)
        if own is None:
            return p(symbol, context[1:])
        n, u = sum(own.values()), len(own)
        if symbol in own:
            return (own[symbol] - 0.5) / n
        lower = (lambda s: p(s, context[1:])) if context else (lambda s: 1 / 257)
        return 0.5 * u / n * lower(symbol) / (1 - sum(lower(s) for s in own))

    texts[33] += "\u00e9~~"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in lm_score.lm_score(docs, F.col("doc_id") < 32, **limits).collect()}
    for i in (0, 31, 32, 33):
        data = b"\xff" * order + texts[i].encode() + b"\xff"
        want = sum(math.log10(p(data[k], data[k - order : k])) for k in range(order, len(data)))
        assert got[i] == pytest.approx(want, rel=1e-6)


# mixing


def test_mixing(spark, odd, empty):
    got = mixing.mix_sources(odd).collect()
    sizes = Counter()
    for i, t, _, s in ODD:
        sizes[s] += len(low(t).split())
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else share[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for r in got:
        assert r.target == pytest.approx(target[r.source])
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert mixing.mix_sources(empty).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(odd.repartition(5)).collect()))


# toxicity


def test_toxicity(spark, odd, empty, sf_dir):
    rng = random.Random(4)
    plain = [f"w{n}" for n in range(300)]
    found, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randint(1, 6))]
        toxic = i % 3 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += " you nastyword" + rng.choice(plain)
        found.append((i, ". ".join(sentences) + ".", "en", "a"))
        labels.append((i, int(toxic), "x"))
    docs = docs_of(spark, found)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.learn_toxicity(docs, marks, F.col("doc_id") < 400)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = range(400, 600)
    assert sum((got[i].score >= 0.7) == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    for i in held:
        if i % 3 == 0 and got[i].score >= 0.7:
            text = found[i][1].encode()
            assert any(b"nastyword" in text[s.begin : s.end] for s in got[i].offending)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(odd, model).collect()}
    assert scored[1] == scored[2] == scored[3] == 0
    assert toxicity.score_toxicity(empty, model).count() == 0
    nothing = toxicity.learn_toxicity(docs, marks.where("toxic = 0"), F.col("doc_id") < 400)
    assert max(r.score for r in toxicity.score_toxicity(odd, nothing).collect()) < 1e-6


def test_toxicity_of_odd_training(spark):
    """Labels beside 0 and 1, training texts without words, ids repeated in the documents and null."""
    found = [(i, "?? !" if i < 20 else f"some plain words {i}", "en", "a") for i in range(40)] + [(None, "words", "en", "a")]
    docs = docs_of(spark, found + [(25, f"again {n}", "en", "a") for n in range(50)])
    for bad, wordless in (((0,), True), ((20,), False)):
        marks = [(i, 2 if i >= bad[0] and i < bad[0] + 20 else -1) for i in range(40)] + [(None, 1), (3, None)]
        model = toxicity.learn_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True), sample=30)
        scores = [r.score for r in toxicity.score_toxicity(docs, model).collect()]
        assert len(scores) == len(found) + 50 and all(0 <= x <= 1 for x in scores)
        assert max(scores) < 1e-6 or not wordless
    none = toxicity.ToxicityModel.train([np.zeros(0, np.int32)] * 4, [np.zeros(0, np.int32)] * 4, np.array([0, 1, 0, 1]))
    assert none.bias == -60.0


def test_toxicity_training_is_bounded(spark):
    """At most ``sample`` and twice as many rows, and no more once ``sample_bytes`` are exceeded, the same ones each time."""
    docs = docs_of(spark, [(i, f"word{i % 7} " * 30, "en", "a") for i in range(300)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    seen = []
    train = toxicity.ToxicityModel.train
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity.ToxicityModel, "train", classmethod(lambda cls, slots, lengths, labels: (seen.append(Counter(labels.tolist())), train(slots, lengths, labels))[1]))
        for parts, more in ((1, {}), (5, {}), (3, {"sample_bytes": 1000})):
            toxicity.learn_toxicity(docs.repartition(parts), marks, F.lit(True), sample=20, **more)
    assert seen[0] == seen[1] == {0: 40, 1: 20}
    assert seen[2] == {0: 6, 1: 6}


# top k


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [1.0, float("nan"), 1.0, 1.0]), (303, [float("inf")] * 4), (304, [])]
    vectors += [(i, [1.5, 1.0, -1.0, 0.5]) for i in range(320, 420)]
    df = spark.createDataFrame([(i, v, "e") for i, v in vectors], "vec_id long, embedding array<double>, score string").repartition(5)
    usable = {i: np.floor(64 * np.array(v)).astype(np.int64) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)}
    for limit, query_block in ((20, 4096), (7, 8), (1000, 4096)):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=limit, query_block=query_block, bins=16, block=37).collect()
        want = []
        for q in usable:
            if q % 20 == 0:
                order = sorted((-int(usable[q] @ x), i) for i, x in usable.items() if i != q)[:limit]
                want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_large_values(spark):
    df = spark.createDataFrame([(0, [1e7, -1e7]), (1, [1e7 + 1, 3.0]), (2, [-1e7, 5.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    a = [int(64e7), int(-64e7)]
    assert [(r.vec_id, r.score) for r in got] == [(1, a[0] * int(64e7 + 64) + a[1] * 192), (2, a[0] * int(-64e7) + a[1] * 320)]


def test_top_k_at_the_limits_of_64_bits(spark):
    """Products of norms beyond 64 bits, with scores that fit; then one that doesn't, and a component that doesn't."""
    far = [(0, [1.6e8, 0.0]), (1, [0.0, 1.6e8]), (2, [0.0, -1.6e8]), (3, [0.25, 1e8]), (4, [-0.5, 0.0])]
    schema = "vec_id long, embedding array<double>"
    got = topk.top_k(spark.createDataFrame(far, schema), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, int(64 * 1.6e8) * 16), (1, 0), (2, 0)]
    for more in ([(5, [1.6e8, 1.6e8])], [(5, [1e300, 0.0])]):
        with pytest.raises(Exception, match="doesn't fit"):
            topk.top_k(spark.createDataFrame(far + more, schema), F.col("vec_id") == 0, k=3).collect()


def test_top_k_of_repeated_query_ids(spark):
    """The smallest vector of a repeated id is the query; all its rows are candidates of others."""
    found = [(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (20, [3.0, 3.0])]
    df = spark.createDataFrame(found, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 20, 18 * 4096), (0, 2, 2, 5 * 4096), (0, 3, 1, 4096), (20, 1, 0, 18 * 4096), (20, 2, 0, 6 * 4096), (20, 3, 1, 3 * 4096)]


# near duplicates


def brute_components(found, width, under, over):
    sets = {}
    for i, t in found:
        w = low(t).split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])
    label = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and over * both >= under * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("node_limit", "block"), [(4096, 512), (16, 8)])
def test_near_duplicates(spark, node_limit, block):
    rng = random.Random(6)
    words = [f"w{n}" for n in range(400)]
    found = []
    for base in range(12):
        text = rng.choices(words, k=rng.choice([4, 30, 120]))
        for _ in range(1 + 3 * base):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            found.append((len(found), " ".join(copy)))
    found += [(1000, ""), (1001, None), (1002, "a b"), (1003, "A  b"), (1004, "a"), (1005, "a b c " * 3000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in found], "doc_id long, text string, n_shingles int").repartition(4)
    for width, threshold in ((3, (85, 100)), (5, (4, 5))):
        got = {r.doc_id: r for r in near_dedup.near_duplicates(df, width, threshold, node_limit=node_limit, block=block).collect()}
        want = brute_components(found, width, *threshold)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_of_repeated_rows(spark):
    """Rows repeated within nodes over node_limit: their pairs are still compared."""
    rng = random.Random(11)
    words = [f"w{n}" for n in range(400)]
    found = []
    for _ in range(6):
        text = rng.choices(words, k=60)
        for _ in range(30):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            found.append((len(found), " ".join(copy)))
    df = spark.createDataFrame(found + found, "doc_id long, text string").repartition(4)
    want = brute_components(found, 3, 85, 100)
    for limit in (8, 16, 24):
        got = near_dedup.near_duplicates(df, 3, (85, 100), node_limit=limit, block=8).collect()
        assert len(got) == 2 * len(found)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("levels", [1, 3])
def test_nodes_that_branching_does_not_part(spark, levels):
    """Documents that all share half of their words but few links, and many copies with changes: levels end by themselves."""
    rng = random.Random(13)
    words = [f"w{n}" for n in range(4000)]
    common, found = rng.choices(words, k=40), []
    for _ in range(60):
        found.append((len(found), " ".join(common + rng.choices(words, k=40))))
    for _ in range(40):
        copy = list(common)
        copy[rng.randrange(40)] = rng.choice(words)
        found.append((len(found), " ".join(copy)))
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df, 3, (85, 100), node_limit=8, block=8, levels=levels).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(found, 3, 85, 100)


def prefix_components(found, width, under, over):
    """Components by an exact prefix filter: a pair that links shares one of each set's rarest shingles."""
    sets, label = {}, {}
    for i, t in found:
        w = low(t).split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])
        label[i] = i
    often, first, by_shingle = Counter(x for s in sets.values() for x in s), {}, defaultdict(list)

    def root(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for i in sorted(sets):  # equal sets are linked; one of them stands for all
        if sets[i]:
            label[i] = first.setdefault(sets[i], i)
    for i in first.values():
        own = sorted(sets[i], key=lambda x: (often[x], x))
        for x in own[: len(own) - len(own) * under // over + 1]:
            for j in by_shingle[x]:
                a, b = sorted((root(i), root(j)))
                if a != b and over * (both := len(sets[i] & sets[j])) >= under * (len(sets[i]) + len(sets[j]) - both):
                    label[b] = a
            by_shingle[x].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_no_link_is_lost_at_sf01(spark):
    """All of sf0.1, at the registered query's parameters."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    want = prefix_components([(r.doc_id, r.text) for r in rows], 3, 85, 100)
    got = queries.op9_near_dedup(spark, "/root/testdata/sf0.1").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_odd(odd, empty):
    got = near_dedup.near_duplicates(odd, 3, (85, 100)).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].component_id == 5 and by_id[8].component_id == 7
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[1].n_shingles == 0 and by_id[1].kept
    assert near_dedup.near_duplicates(empty).count() == 0


def test_shuffled_confirmation(spark, documents):
    a = near_dedup.near_duplicates(documents, 3, (85, 100))
    b = near_dedup.near_duplicates(documents, 3, (85, 100), broadcast_limit=0)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    want = brute_components([(r.doc_id, r.text) for r in documents.collect()], 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in a.collect()} == want


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(n, n + 1) for n in range(1000, 1060)] + [(2000, n) for n in range(2001, 2100)]
    label = {}
    for e in edges:
        for n in e:
            label.setdefault(n, n)
    for _ in range(500):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {n for n in label if all(a == b for a, b in edges if n in (a, b))}
    for limit in (1000, 10):
        got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long"), limit).collect()}
        assert {n: c for n, c in got.items() if n != c} == {n: c for n, c in label.items() if n != c and n not in alone}


# URLs


def brute_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?q#f", "x://example.com/en", "a://b.net/es/x", "a://net/fr/", "a://b.net/en/", "a://x.com", "a://x.com?/y", "a://notcom/", "http://www.poker-prize.xyz/a://b/c#?", "a://é.com/\n/x", "a://x.org/" + "y" * 5000]
    df = spark.createDataFrame([(n, u, "h") for n, u in enumerate(urls)], "page_id long, url string, host string")
    model = url_filter.UrlModel.train(url_filter.labelled_urls())
    got = {r.page_id: r for r in url_filter.filter_urls(df, queries.RULES, model).collect()}
    for n, u in enumerate(urls):
        host, path, best = brute_url(u, queries.RULES)
        assert (got[n].host, got[n].path, got[n].rule) == (host, path, best and best[1])
        assert got[n].verdict == (best[0] if best else "block" if got[n].p_block >= 0.5 else "allow")
    assert got[12].verdict == "block"
    assert url_filter.filter_urls(df.limit(0), queries.RULES, model).count() == 0


def judged(model, urls):
    texts = [url_filter.model_text(*url_filter._split(u)).encode() for u in urls]
    return model.probabilities(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])) >= 0.5


def test_urls_of_topics_held_out(spark, sf_dir):
    """Whole topics, with all their names, are held out; the table holds no word, domain or path of the test pages."""
    kept, blocked = [], []
    for fold in range(5):
        part = lambda inside: {label: [t for k, t in enumerate(own) if (k % 5 == fold) == inside] for label, own in ((1, url_filter.BLOCKED_TOPICS), (0, url_filter.ALLOWED_TOPICS))}  # noqa: B023, E731
        model = url_filter.UrlModel.train(url_filter.labelled_urls(url_filter.labelled_names(topics=part(False))))
        held = url_filter.labelled_urls(url_filter.labelled_names(topics=part(True)))
        found, want = judged(model, [u for u, _ in held]), np.array([label for _, label in held], bool)
        blocked.append(found[want].mean())
        kept.append(1 - found[~want].mean())
    assert np.mean(blocked) >= 0.75 and min(blocked) >= 0.6
    assert min(kept) >= 0.95
    table = [u.split("://")[1] for u, _ in url_filter.labelled_urls()]
    pages = [r.u.split("://")[1] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lower("url").alias("u")).where("u like '%://%'").collect()]
    words = lambda urls: {w for u in urls for w in re.split("[^a-z]+", u.split("/")[0]) if len(w) > 3}
    first = lambda urls: {"/".join(u.split("/")[1:2]) for u in urls if u.count("/") > 1}
    assert not words(table) & words(pages)
    assert not first(table) & first(pages)
    assert url_filter.UrlModel.train([]).probabilities(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [0.5]


# helpers


def test_words_and_chunks():
    import pyarrow as pa

    texts = ["One two", None, "", " a\u00a0b\x1cc\td ", "x" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["id", "text"])
    seen = []
    for own, data, offsets in _bytes.chunks(batch.slice(1), "text", 10):
        w = _bytes.Words(_bytes.LOWER[data], offsets)
        for k in range(own.num_rows):
            part = slice(w.bounds[k], w.bounds[k + 1])
            seen.append([data[a:b].tobytes().lower() for a, b in zip(w.begin[part], w.end[part], strict=True)])
    assert seen == [low(t).split() for t in texts[1:]]
    same = _bytes.Words(np.frombuffer(b"abc xabc abc", np.uint8), np.array([0, 12])).hashes()
    assert same[0] == same[2] != same[1]


def scored_by_all(texts, monkeypatch=None):
    """What the operators' Python sides say of the texts, each text a document."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    rng = np.random.default_rng(3)
    lang = language_id.LanguageModel(["de", "en", "fr"], language_id.FAMILIES)
    lang.pairs = {"": [(0, 1, 0)], "germanic": [(0, 1, 1)], "romance": []}
    lang.weights, lang.bias = [rng.normal(size=1 << language_id.BITS).astype(np.float32) for _ in range(2)], [0.1, -0.1]
    lang.seen, lang.least_known = rng.random((3, 1 << language_id.GRAM_BITS)) < 0.5, 0.4
    toxic = toxicity.ToxicityModel(rng.normal(size=1 << toxicity.BITS), -1.0)
    url = url_filter.UrlModel(rng.normal(size=1 << 14), 0.0, (3, 4, 5), 14)
    grams = lm_score.GramTable(5, np.arange(10), np.zeros(10))
    counted = Counter()
    for part in lm_score._gather([batch], 5, 1000):
        for kind, key, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            counted[(kind, key)] += n
    rows = lambda parts: [r for p in parts for r in p.to_pylist()]
    far = [(total.tolist(), lists.to_pylist()) for _, data, offsets in _bytes.chunks(batch, "text") for total, lists in [grams.scores(data, offsets)]]
    return {
        "op2": rows(language_id._predict([batch], lang)),
        "op2 training": [{k: v for k, v in r.items() if k != "lang"} for r in rows(language_id._frequencies([pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), batch.column(1)], names=["lang", "hash", "text"])]))],
        "op5": (counted, [x for totals, _ in far for x in totals], [x for _, lists in far for x in lists]),
        "op7": rows(toxicity._score([batch], toxic, 0.5)),
        "op9": rows(near_dedup._signatures([batch], 3, 9)),
        "op9 sets": rows(near_dedup._full_sets([batch], 3)),
        "op10": [p for _, data, offsets in _bytes.chunks(batch, "text") for p in url.probabilities(data, offsets)],
    }


def alike(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(alike(a[k], b[k]) for k in a)
    if isinstance(a, list | tuple):
        return len(a) == len(b) and all(map(alike, a, b))
    return a == pytest.approx(b, rel=1e-4, abs=1e-6) if isinstance(a, float) else a == b


def test_long_texts_by_parts(monkeypatch):
    """Texts worked on in parts of 64 bytes give what they give as a whole."""
    rng = random.Random(14)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 12))) + rng.choice(["", ".", "\n", ", "]) for _ in range(n)) for n in (0, 1, 5, 40, 300, 7)]
    whole = scored_by_all(texts)
    monkeypatch.setattr(_bytes, "CHUNK_BYTES", 50)
    monkeypatch.setattr(_bytes, "PART", 150)
    parted = scored_by_all(texts)
    for name, found in whole.items():
        assert alike(found, parted[name]), name


def test_words_longer_than_a_part(monkeypatch):
    """They are one word, equal wherever they stand; words of a part's size are as in short texts."""
    monkeypatch.setattr(_bytes, "CHUNK_BYTES", 16)
    monkeypatch.setattr(_bytes, "PART", 32)
    hashes = lambda t: _bytes.Hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).h.tolist()
    for size in (31, 32, 33, 34, 65, 200):
        word = "w" * size
        want = hashes(word)
        assert len(want) == 1
        for before, after in (("", " a"), ("a ", ""), ("  a bcd ", " e"), ("x" * 40 + " ", "  " + "y" * 33), ("a " * 50, " b" * 50)):
            found = hashes(before + word + after)
            assert len(found) == len((before + word + after).split()) and found[len(before.split())] == want[0]


def test_a_text_of_50_megabytes():
    """Peak memory of Python and numpy stays a small multiple of the text."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(15)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 10), dtype=np.uint8)).decode() for _ in range(30_000)]
    text = " ".join(words[i] + ("." if i % 9 == 0 else "") for i in rng.integers(0, len(words), 7_700_000))
    assert len(text) > 50_000_000
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    lang = language_id.LanguageModel(["de", "en"], language_id.FAMILIES)
    lang.pairs, lang.weights, lang.bias = {"": [], "germanic": [(0, 1, 0)]}, [np.ones(1 << language_id.BITS, np.float32)], [0.0]
    toxic = toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS), -9.0)
    url = url_filter.UrlModel(np.ones(1 << 14), 0.0, (3, 4, 5), 14)
    pair = lambda: next(_bytes.chunks(batch, "text"))[1:]
    for name, run in {
        "op2": lambda: list(language_id._predict([batch], lang)),
        "op5": lambda: sum(p.num_rows for p in lm_score._gather([batch], 5, 1 << 20)),
        "op7": lambda: list(toxicity._score([batch], toxic, 0.5)),
        "op9": lambda: list(near_dedup._signatures([batch], 3, 9)),
        "op10": lambda: url.probabilities(*pair()),
    }.items():
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1_000_000_000, (name, peak)
    assert len(_bytes._powers[0]) <= _bytes.PART + 2


def test_ids_of_long_texts(monkeypatch):
    """Cut where the split pattern cuts in any case: the same ids."""
    from strandwise.llm import _tokens

    rng = random.Random(16)
    text = "".join(rng.choices(["a", "b", "the", " ", " ", "  ", "\n", "é", "'s", "12", ".", "<|endoftext|>", "\u00a0"], k=4000))
    own = ByteTokenizer(VOCABULARY)
    want = own.ids(text).tolist()
    monkeypatch.setattr(_tokens, "LONG", 50)
    assert len(list(own._parts(text))) > 20
    assert own.ids(text).tolist() == want


def test_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", 7), (None, "c", 8)], "doc_id long, text string, gone int")
    ids = spark.createDataFrame([(1,), (None,)], "doc_id long")
    for limit in (10, 0):
        assert sorted(r.gone for r in rows.without(df, ids, limit=limit).collect()) == [7, 8]
        assert rows.once(df, ids, limit=limit).count() == 3
        copies = spark.createDataFrame([(1, 2), (2, 0), (None, 1)], "doc_id long, n long")
        assert Counter((r.gone, r.nth) for r in rows.repeated(df, copies, limit=limit).collect()) == {(5, 1): 1, (5, 2): 1, (6, 1): 1, (6, 2): 1, (8, 1): 1}


def test_rows_told_apart(spark):
    same, key = rows.told_apart(spark.createDataFrame([(2, "a"), (1, "b")], "doc_id long, text string"))
    assert key == "doc_id" and same.columns == ["doc_id", "text"]
    df = spark.createDataFrame([(2, 0), (1, 0), (None, 0), (2, 0), (7, 0)], ["doc_id", "row number"]).repartition(3)
    for first in (True, False):
        own, key = rows.told_apart(df, nulls_first=first)
        found = [r.doc_id for r in own.orderBy(key).collect()]
        assert key == "row number_" and own.select(key).distinct().count() == 5
        assert found == ([None, 1, 2, 2, 7] if first else [1, 2, 2, 7, None])


def test_first_words(spark):
    text = "  a bb\n\nc  \u00a0d e  "
    df = spark.createDataFrame([(text, n) for n in range(1, 6)], "text string, n long")
    got = [r.t for r in df.orderBy("n").select(mixing.first_words(F.col("text"), F.col("n")).alias("t")).collect()]
    assert got == ["  a", "  a bb", "  a bb\n\nc", "  a bb\n\nc  \u00a0d", "  a bb\n\nc  \u00a0d e"]
