import random

import numpy as np
import pytest

from arbordelta.llm.components import components
from arbordelta.llm.shared_spans import Rolling, _codes, cluster_removals, clusters, paragraphs_of, shared_characters, shared_stretches, told_apart


def brute(docs, n):
    owners = {}
    for d, t in docs:
        for a in range(len(t or "") - n + 1):
            owners.setdefault(t[a:a + n], set()).add(d)
    out = {}
    for d, t in docs:
        chars = {a + k for a in range(len(t or "") - n + 1) if len(owners[t[a:a + n]]) > 1 for k in range(n)}
        if chars:
            out.setdefault(d, set()).update(chars)
    return {d: len(c) for d, c in out.items()}


def cases():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab \né漢😀") for _ in range(n))
    head = word(90)
    docs = [(1, None), (2, ""), (3, word(20)), (4, "z" * 400), (5, "z" * 200), (6, "zy" * 100)]
    for d in range(10, 70):
        docs.append((d, word(rng.randint(0, 60)) + head[rng.randint(0, 30):rng.randint(40, 90)] + word(rng.randint(0, 60))))
    docs += [(90, "-" * 3000), (91, "x" + "-" * 95 + "y"), (92, "-" * 41), (93, "ab" * 700), (94, "b" + "ab" * 33 + "z"), (95, "q" * 1000)]
    docs += [(80, docs[20][1]), (81, docs[20][1] + "!"), (82, "\r\n" + docs[21][1]), (83, (long := word(45)) + "1" + long), (84, word(500)), (-5, head)]
    return docs


@pytest.mark.parametrize("settings", [{}, {"block": 2}, {"section": 64}])
def test_against_brute_force(spark, settings):
    docs = cases()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, minhash int, first string").repartition(4)
    for span, gram in ((40, 20), (41, 41), (30, 5)):
        got = shared_characters(shared_stretches(df, span, gram, **settings)).collect()
        assert {r.doc_id: r.shared_chars for r in got} == brute(docs, span), (span, gram)


def roots(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("settings", [{}, {"block": 2}])
def test_clusters(spark, settings):
    docs = cases()
    span = 40
    owners = {}
    for d, t in docs:
        for a in range(len(t or "") - span + 1):
            owners.setdefault(t[a:a + span], set()).add(d)
    want = roots([(min(o), d) for o in owners.values() if len(o) > 1 for d in o if d != min(o)])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.cluster for r in clusters(df, span, 20, **settings).collect()} == want


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = chain + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(7, 7), (500, 900), (900, 500), (300, 301)] + [(1000, i) for i in range(1001, 1100)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == roots([p for p in pairs if p[0] != p[1]])
    assert components(df.limit(0), "a", "b").count() == 0


def test_repeated_rows_and_ids(spark):
    text = "".join(random.Random(1).choice("abc") for _ in range(100))
    rows = [(1, text), (1, text), (1, text[::-1]), (2, "q" * 50 + text[20:70]), (None, text)]
    got = shared_characters(shared_stretches(spark.createDataFrame(rows, "doc_id long, text string"), 40, 20)).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.doc_id: r.shared_chars for r in got}[2] == 50
    alone = spark.createDataFrame([(1, text + "x" + text)], "doc_id long, text string")
    assert shared_stretches(alone, 40, 20).count() == shared_stretches(alone.limit(0), 40, 20).count() == 0


def test_paragraphs_cover_each_passage_once():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(40, 300)))
        _, _, first, n = paragraphs_of(_codes(text), 40, 15)
        assert n.max() <= 26 and first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == len(text) - 39


def test_rolling_hashes_do_not_depend_on_place():
    codes = _codes("xxabcabcabc")
    a, b = Rolling(codes).of(np.array([2, 5, 8]), np.array([5, 8, 11])), Rolling(_codes("abc")).of(np.array([0]), np.array([3]))
    assert len(set(a.tolist() + b.tolist())) == 1


@pytest.mark.parametrize("settings", [{}, {"block": 2}, {"section": 64}])
def test_removals_keep_the_least_copy(spark, settings):
    docs, span = cases(), 40
    least = {}
    for d, t in docs:
        for a in range(len(t or "") - span + 1):
            least[t[a:a + span]] = min(d, least.get(t[a:a + span], d))
    want = {}
    for d, t in docs:
        if chars := {a + k for a in range(len(t or "") - span + 1) if least[t[a:a + span]] < d for k in range(span)}:
            want[d] = chars
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got, last = {}, {}
    for r in cluster_removals(df, span, 20, **settings).orderBy("doc_id", "from_char").collect():
        assert r.from_char > last.get(r.doc_id, -1) and r.cluster < r.doc_id
        last[r.doc_id] = r.to_char
        got.setdefault(r.doc_id, set()).update(range(r.from_char, r.to_char))
    assert got == want


def test_equal_keys_of_different_passages_are_told_apart():
    rng = random.Random(6)
    for _ in range(200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 30))) for _ in range(4)]
        codes = _codes("".join(texts))
        start = np.array([a for k, t in enumerate(texts) for a in range(sum(map(len, texts[:k])), sum(map(len, texts[:k + 1])) - 4)])
        whole = ["".join(texts)[a:a + 5] for a in start]
        rng_mod = rng.choice([1, 2, 3, 99])
        exact = {t: k for k, t in enumerate(sorted(set(whole)))}
        key = told_apart(codes, start, np.array([exact[t] % rng_mod for t in whole], np.uint64), 5)
        same = {}
        for t, k in zip(whole, key.tolist()):
            same.setdefault(k, set()).add(t)
        assert all(len(v) == 1 for v in same.values())
