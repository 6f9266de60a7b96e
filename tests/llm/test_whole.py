"""Cases in which an operator once did less than the whole job."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandline.llm import lm, pii, toxicity
from strandline.llm.words import Words
from strandline.llm.words import tokens as words_of

DOCS = "doc_id long, text string, source string, fp_a string"


@pytest.mark.parametrize("blocks", [lm.MOST_BLOCKS, 0])
def test_lm_counts_every_pair(spark, blocks):
    texts = ["one pair seen once only", "another text has seen once again", "pair seen twice and seen once", "", None, "unheard words and one pair"] * 2
    rows = [*enumerate(texts), (2, texts[2])]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    seq = {i: [*words_of(t), None] for i, t in enumerate(texts)}
    one, two = Counter(), Counter()
    for i, _ in rows:
        if not held[i]:
            one.update(seq[i])
            two.update(zip([0, *seq[i]], seq[i]))
    n, v = sum(one.values()), len(one)
    read = lambda c: 2 ** ((math.floor(2 * math.log2(c)) + 0.5) / 2) if c else 0.0
    whole = sum(map(read, one.values()))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), most_blocks=blocks).collect()
    assert len(got) == len(rows) and any(held.values())
    for r in got:
        want = 0.0
        for b, w in zip([0, *seq[r.doc_id]], seq[r.doc_id]):
            p = (read(one[w]) + 0.5) / (whole + 0.5 * (v + 1))
            if b != 0 and one[b]:
                p = 0.6 * min(read(two[b, w]), read(one[b])) / read(one[b]) + 0.4 * p
            want += math.log10(p)
        assert r.n_tokens == len(seq[r.doc_id]) and math.isclose(r.score, want, rel_tol=1e-9)


def test_toxicity_counts_words_by_whole_key(spark):
    texts = [(f"before{i} common", i % 2) for i in range(1000)] + [("common again", 0), ("before0 common", 1)]
    got = {r.h: (r.m0, r.m1, r.m) for r in toxicity.continuation_counts(spark.createDataFrame(texts, "text string, y int")).collect()}
    h = int(Words([b"common"]).hash.view("int64")[0])
    assert len(got) == 1002 and got[h] == (501, 501, 1001)


def test_toxicity_model_is_kneser_ney(spark):
    rng = np.random.default_rng(8)
    texts = [(" ".join(rng.choice(["a", "b", "c", "d", "e", "f", *(["bad"] * 3 if i % 2 else ["fine"] * 3)], 12)), i % 2) for i in range(300)]
    seen = [defaultdict(set), defaultdict(set)]
    for t, y in texts:
        for b, w in zip([None, *t.split()], t.split()):
            seen[y][w].add(b)
    m = [{w: len(b) for w, b in s.items()} for s in seen]
    words = set(m[0]) | set(m[1])
    both = {w: len(seen[0][w] | seen[1][w]) for w in words}
    model = toxicity.fit(toxicity.continuation_counts(spark.createDataFrame(texts, "text string, y int")))
    d, total = toxicity.DISCOUNT, [sum(x.values()) for x in m]
    free = [sum(min(c, d) for c in x.values()) / t for x, t in zip(m, total)]
    for w in words:
        shared = (both[w] + 0.5) / (sum(both.values()) + 0.5 * (len(words) + 1))
        p = [max(x.get(w, 0) - d, 0) / t + f * shared for x, t, f in zip(m, total, free)]
        assert math.isclose(model.of(Words([w.encode()]).hash)[0], math.log(p[1] / p[0]), abs_tol=1e-9)
    assert math.isclose(model.of(Words([b"unseen"]).hash)[0], math.log(free[1] / free[0]), abs_tol=1e-9)
    few = toxicity.fit(toxicity.continuation_counts(spark.createDataFrame(texts, "text string, y int")), most=3)
    assert len(few.h) <= 3 < len(model.h)


def test_toxicity_words_share_nothing(spark):
    names = [b"name%d" % i for i in range(1_000_000)]
    top = Words([b" ".join(names)]).hash >> 46
    same = names[next(i for i in range(1, len(names)) if top[i] == top[0])].decode()
    rng = np.random.default_rng(6)
    calm = lambda: " ".join(rng.choice([f"calm{k}" for k in range(40)], 20))
    rows = [(i, calm() + (" name0 " if i % 2 else " ") + calm()) for i in range(600)] + [(1000, f"{calm()} {same}"), (1001, calm() + " name0 " + calm()), (1003, None), (1003, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 603 and got[1001] > 0.7 > got[1000]


def disclosing(rows, least=pii.LEAST_TEXTS):
    """Terms by counting plainly."""
    n, ne, nt, near = len(rows), Counter(), Counter(), defaultdict(list)
    for t in rows:
        nt.update({w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if len(w) >= 4 and not re.search("[0-9@]", w)})
        by = defaultdict(set)
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t):
            left, right = re.split(r"[\x20\x09-\x0D]+", t[: m.start()].lower()), re.split(r"[\x20\x09-\x0D]+", t[m.end() :].lower())
            by[m[0].lower()] |= {w for w in [*left[-6:], *right[:6]] if w in nt}
        for e, ws in by.items():
            ne[e] += 1
            for w in ws:
                near[e, w].append(t)
    enough = lambda e, ts: math.log(n / ne[e]) / (pii.ALPHA if len(set(ts)) >= least else 1)
    return {w for (e, w), ts in near.items() if math.log(len(ts) * n / (nt[w] * ne[e])) >= enough(e, ts) - 1e-9}


def test_copies_and_long_words_hide_no_term(spark):
    rows = [f"call Zebulon at z@x.org about number {w}" for w in "alpha beta gamma".split()]
    rows += [rows[0]] * 1000 + [f"plain filler text {i}" for i in range(300)]
    gap = " " * 200
    rows += [f"Quixote {'x' * 150}{gap}7 q@y.org,{gap}{'y' * 150} Wolfram {w}" for w in "delta epsilon zeta".split()]
    got = {r.term for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in rows], "body string")).collect()}
    assert {"zebulon", "quixote", "wolfram"} <= got and "plain" not in got and got == disclosing(rows)


def test_disclosing_terms_by_plain_counts(spark):
    rng, names = np.random.default_rng(5), [f"user{chr(97 + i)}{chr(97 + i // 26)}" for i in range(60)]
    common, rows = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)], []
    for _ in range(400):
        k = int(rng.integers(0, 12))
        part = list(rng.choice(common, int(rng.integers(0, 9))))
        rows.append(" ".join([*part, names[k], f"mail{k}@site.org", *rng.choice(common, 2)]) if rng.random() < 0.4 else " ".join([*part, names[int(rng.integers(0, 60))]]))
    got = {r.term for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in rows], "body string")).collect()}
    assert got == disclosing(rows) and got


def test_terms_are_found_on_the_tables(spark):
    from strandline.session import table

    bodies = table(spark, "/root/testdata/sf0.1", "documents").selectExpr("coalesce(text, '') AS body")
    assert pii.disclosing_terms(bodies).count() > 0
