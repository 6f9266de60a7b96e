"""Nulls, ids beyond 2^53, ties, repeats, empty tables and clashing names, for every operator and stage."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import ann, components, embeddings, lm, minhash, mixing, packing, pii, quality, tokens, toxicity
from strandline.llm.words import tokens as words_of

BIG = (1 << 53) + 1
CLASH = "doc_id long, text string, lang string, source string, n_chars long, t long, terms string, body string, node long, row string, h long, size long, rate double, score double, s string, y int"
LONG = "a long tale of many words told again " * 400


def rows():
    texts = ["some plain words for a test of ids", None, "", "some plain words for a test of ids", LONG, " \t\n", "mail x.y@z.org now"]
    ids = [BIG, None, BIG + 2, BIG + 4, 5, None, 7]
    return [(i, t, "en", None if k % 3 == 0 else "s", None, 1, "u", "b", 2, "r", 3, 4, 0.5, 0.5, "s", 1) for k, (i, t) in enumerate(zip(ids, texts))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows() + [rows()[0], rows()[6]], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0, "x"), (5, 0, 1, "x"), (7, None, None, None), (None, 1, 1, None)], "doc_id long, quality int, toxic int, text string")


OPERATORS = {
    "tokens": lambda d, y: tokens.count(d),
    "minhash": lambda d, y: minhash.near_duplicates(d),
    "toxicity": lambda d, y: toxicity.predict(d, y),
    "quality": lambda d, y: quality.predict(d, y),
    "pii": lambda d, y: pii.digest(pii.find(d)),
    "lm": lambda d, y: lm.score(d),
    "mixing": lambda d, y: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back_with_its_id(spark, docs, empty, labels, name):
    run = OPERATORS[name]
    got = run(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows() + [rows()[0], rows()[6]])
    for r in got:
        assert all(v is not None for k, v in r.asDict().items() if k not in ("doc_id", "component_id"))
    assert run(empty, labels).count() == 0 and run(empty, labels.limit(0)).count() == 0


def test_packing_keeps_ids(docs, empty):
    got = packing.pack(docs).collect()
    tails = Counter(r.doc_id for r in got if r.start + r.length == r.doc_tokens)
    assert tails == Counter(r[0] for r in rows() + [rows()[0], rows()[6]]) and packing.pack(empty).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(docs):
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    assert Counter(got) == Counter([(BIG, BIG, True)] * 2 + [(BIG + 4, BIG, False), (BIG + 2, BIG + 2, True), (5, 5, True)] + [(7, 7, True)] * 2 + [(None, None, True)] * 2)


def test_unfinished_components_are_loud(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    got = {r.node: r.component_id for r in components.components(links).collect()}
    assert got == dict.fromkeys(range(201), 0)
    assert components.components(links.limit(0)).count() == 0
    with pytest.raises(ArithmeticError):
        components.components(links, rounds=1)


def test_scores_of_ties_are_equal(docs, labels):
    for mod in (toxicity, quality):
        by = defaultdict(set)
        texts = {r[0]: r[1] for r in rows()}
        for r in mod.predict(docs, labels).collect():
            assert 0 <= r.score <= 1 and r.held_out in (True, False)
            by[(texts[r.doc_id] or "").strip() if r.doc_id else ""].add(round(r.score, 12))
        assert all(len(v) == 1 for v in by.values())


def test_pii_keeps_columns_with_clashing_names(spark):
    data = [(1, "call Zebulon at z@x.org today", "T", 4), (2, "call Zebulon at z@x.org again", None, 5), (3, "Zebulon", "x", 6), (4, None, "y", 7)] + [(i, f"other text {i}", "z", 8) for i in range(10, 60)]
    found = pii.find(spark.createDataFrame(data, "doc_id long, text string, terms string, t long"))
    got = {r.doc_id: r for r in pii.sanitised(found).collect()}
    assert [(got[d[0]].terms, got[d[0]].t) for d in data] == [(d[2], d[3]) for d in data]
    assert got[3].text == "<TERM>" and got[4].text is None


def test_embeddings_edges(spark):
    schema = "vec_id long, embedding array<double>, label int, rep long, keys string, n long"
    x = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (BIG, [2.0, 4.0], 1), (3, [1.0, 2.0], 2), (None, [1.0, 2.0], 1), (5, [], 1), (6, [math.inf, 1.0], 1), (7, [1.0, 2.0, 3.0], 1)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame([(*r, 0, "k", 0) for r in x], schema)).collect())
    assert got == Counter([(1, 2, 1, True)] * 2 + [(BIG, 2, 1, False), (3, 0, 3, True), (None, 0, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)])
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert embeddings.tables(10, 0.98) <= embeddings.tables(16, 0.98)


def test_search_edges(spark):
    schema = "vec_id long, embedding array<double>, home int, x string"
    x = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (BIG, [0.5, 0.5]), (None, [9.0, 9.0]), (40, [0.0, 0.0]), (4, None), (60, [1.0, 1.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(spark.createDataFrame([(*r, 0, "x") for r in x], schema)).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, BIG, 0.5)]
    assert ann.search(spark.createDataFrame([], schema)).count() == 0


def test_search_by_inner_product_of_unlike_lengths(spark):
    rng = np.random.default_rng(12)
    centre = rng.standard_normal((40, 32))
    x = (centre[rng.integers(0, 40, 8000)] + 0.5 * rng.standard_normal((8000, 32))) * rng.lognormal(0, 0.7, 8000)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df).collect()
    s = x[::20] @ x.T
    s[np.arange(400), np.arange(0, 8000, 20)] = -np.inf
    want = {(20 * q, int(v)) for q, row in enumerate(np.argsort(-s, axis=1)[:, :20]) for v in row}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == 8000 and len(found & want) / len(want) >= 0.9
    assert all(math.isclose(r.score, float(x[r.query_id] @ x[r.vec_id]), rel_tol=1e-9, abs_tol=1e-12) for r in got[:500])


def test_mixing_tilts_by_the_dual(spark):
    rng = np.random.default_rng(3)
    data = [(i, "w " * int(rng.integers(1, 60)), "abc"[i % 3], 0) for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, rate int")
    got = mixing.mix_sources(docs).collect()
    by, source = defaultdict(list), {d[0]: d[2] for d in data}
    for r in got:
        by[source[r.doc_id]].append(r)
    for rs in by.values():
        size, target = np.array([r["size"] for r in rs]), rs[0].target
        lo, hi = -50.0, 50.0  # the dual by bisection
        for _ in range(200):
            a = (lo + hi) / 2
            lo, hi = (a, hi) if (size * np.minimum(2, np.exp(a * size / size.mean()))).sum() < target else (lo, a)
        rate, copies = np.minimum(2, np.exp(lo * size / size.mean())), np.array([r.copies for r in rs])
        assert abs((size * copies).sum() - target) <= size.max()
        if target < 1.999 * size.sum():
            assert all(abs(copies - rate) < 1.05)
            for part in np.array_split(np.argsort(size), 4):  # the tilt is there in every quarter of the sizes
                assert abs(copies[part].mean() - rate[part].mean()) < 0.12


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, int(i % 2)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def corpus(spark):
    rng = np.random.default_rng(9)
    calm = lambda n=30: " ".join(rng.choice([f"calm{k}" for k in range(60)], n))
    data = [(i, calm(10) + (" vile " if i % 2 else " ") + calm(10), "en", "ab"[i % 2], 1) for i in range(400)]
    data += [(1000, None, None, None, None), (None, "no id here at all", "en", None, 3), (None, None, None, None, None), (2000, "", "en", "a", 0), (2001, calm(300), "en", "b", 9)]
    data += [(2002, data[-1][1], "en", "b", 9), (2003, data[-1][1] + " end", "en", "b", 9), (2004, "write to who@where.org", "en", "a", 5), (2004, "write to who@where.org", "en", "a", 5), (2005, "they write", "en", "a", 2)]
    return data, spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stages(spark, folder):
    data, docs = corpus(spark)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: tuple(str(x) for x in r)
    same = lambda df: sorted(map(key, df.collect()))
    empty = docs.limit(0)

    kept = stages["drop_toxic"](spark, docs, folder)
    score = {r.doc_id: r.score for r in toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("doc_id IS NOT NULL").collect()}
    want = [r for r in data if r[0] is None or score[r[0]] < 0.7]
    assert same(kept) == sorted(map(key, want)) and 150 <= len(want) <= 260

    left = stages["near_dedup"](spark, docs, folder)
    assert same(left) == sorted(key(r) for r in data if r[0] not in (2002, 2003))

    clean = {(r.doc_id, r.text, r.n_chars) for r in stages["sanitise"](spark, docs, folder).collect()}
    assert (2004, "write to <EMAIL>", 16) in clean and (1000, None, None) in clean and (2000, "", 0) in clean

    mixed = stages["mix"](spark, docs, folder)
    copies = Counter(map(key, mixed.collect()))
    times = Counter()
    for r in mixing.mixed(docs).collect():
        times[key(r.row)] += r.copies
    assert copies == +times and max(times.values()) <= 4

    ends = Counter(r.doc_id for r in stages["pack"](spark, docs, folder).collect() if r.start + r.length == r.doc_tokens)
    assert ends == Counter(r[0] for r in data)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "pack" or out.columns == corpus_pipeline.COLUMNS)


def test_repeated_ids_with_unlike_texts(spark):
    data = [(1, "one text of the id with words", "a"), (1, "another text that is unlike it", "a"), (1, "one text of the id with words", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert minhash.near_duplicates(docs).count() == 3 and packing.pack(docs).count() == 3
    got = mixing.mix_sources(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(len(words_of(t)) for _, t, _ in data)
    assert sorted(r.n_tokens for r in lm.score(docs).collect()) == sorted(len(words_of(t)) + 1 for _, t, _ in data)
