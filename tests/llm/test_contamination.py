import random
import re

import numpy as np
import pytest

from arbordelta.llm.contamination import leaked_items, phrases_of, reduced, removal_spans, search_shard
from arbordelta.llm.fm_index import MAX_SYMBOLS, FMIndex, suffix_order


def plain(text):
    return re.sub("[^A-Za-z0-9]", "", text or "").lower()


@pytest.mark.parametrize("seed", range(3))
def test_index_against_sorted_suffixes(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        docs = [rng.integers(1, 4, rng.integers(0, 40)) for _ in range(rng.integers(1, 7))] * int(rng.integers(1, 3))
        codes = np.concatenate([np.append(d, 0) for d in docs]).astype(np.uint8)
        seps = int((codes == 0).sum())
        told_apart = np.where(codes == 0, np.cumsum(codes == 0) - 1, codes.astype(int) + seps).tolist()
        want = sorted(range(len(codes)), key=lambda i: told_apart[i:])
        assert suffix_order(codes).tolist() == want
        index = FMIndex(codes, sample=4)
        assert index.locate(np.arange(seps, len(codes))).tolist() == want[seps:]
        phrases = rng.integers(1, 4, (15, int(rng.integers(1, 6)))).astype(np.uint8)
        found = {int(w): (int(a), int(b)) for w, a, b in zip(*index.search(phrases))}
        for i, phrase in enumerate(phrases):
            places = [j for j in range(len(codes)) if codes[j:j + len(phrase)].tobytes() == phrase.tobytes()]
            assert sorted(index.locate(np.arange(*found[i])).tolist() if i in found else []) == places


def test_index_of_long_runs():
    codes = np.concatenate([np.full(5000, 7), [0], np.tile([1, 2], 2000), [0]]).astype(np.uint8)
    index = FMIndex(codes)
    which, low, high = index.search(np.array([[7] * 100, [1, 2] * 50, [2, 2] * 50], np.uint8))
    assert dict(zip(which.tolist(), (high - low).tolist())) == {0: 4901, 1: 1951}
    with pytest.raises(ValueError):
        suffix_order(np.zeros(MAX_SYMBOLS + 1, np.uint8))


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        t = plain(t)
        for a in range(len(t) - n + 1):
            grams.setdefault(t[a:a + n], set()).add(i)
    return {(d, i) for d, t in docs for a in range(len(plain(t)) - n + 1) for i in grams.get(plain(t)[a:a + n], ())}


def cases():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcXYZ019 é-\n") for _ in range(n))
    items = [(i, word(rng.randint(0, 200))) for i in range(25)] + [(100, None), (101, ""), (102, "short"), (103, "K" * 90)]
    items += [(200, items[0][1] + word(80)), (201, items[0][1] + word(80)), (202, items[200 % 25][1])]
    docs = [(1, None), (2, ""), (3, " \n"), (4, word(4000))]
    for d in range(10, 90):
        base = items[rng.randrange(len(items))][1] or ""
        a = rng.randint(0, max(0, len(base) - 60))
        part = base[a:a + rng.randint(20, 150)]
        part = rng.choice([part, part.upper(), part.replace("a", "a, "), part[:30] + "q" + part[30:]])
        docs.append((d, word(rng.randint(0, 90)) + part + word(rng.randint(0, 90)) + (part if d % 7 == 0 else "")))
    docs += [(95, "K" * 100), (96, "k" * 61), (11, docs[5][1]), (97, word(300) + (items[3][1] or "") * 3)]
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 900}, {"shard_symbols": 300}])
def test_against_brute_force(spark, settings):
    docs, items = cases()
    documents = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id long").repartition(3)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    for n in (30, 61):
        got = [tuple(r) for r in leaked_items(documents, benchmark, min_chars=n, **settings).select("doc_id", "item_id").collect()]
        assert len(set(got)) == len(got) and set(got) == brute(docs, items, n)


@pytest.mark.parametrize("settings", [{}, {"shard_symbols": 200}])
def test_removed_spans_leave_no_leak(spark, settings):
    docs, items = cases()
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    spans = {}
    for r in removal_spans(documents, benchmark, min_chars=30, **settings).collect():
        spans.setdefault(r.doc_id, []).append((r.from_char, r.to_char))
    leaks = brute(docs, items, 30)
    assert set(spans) == {d for d, _ in leaks}
    grams = {plain(t)[a:a + 30] for _, t in items for a in range(len(plain(t)) - 29)}
    for d, text in docs:
        at = [i for i, c in enumerate(text or "") if plain(c)]
        t = plain(text)
        covered = {at[a + k] for a in range(len(t) - 29) if t[a:a + 30] in grams for k in range(30)}
        mine = sorted(spans.get(d, []))
        assert all(x[1] < y[0] for x, y in zip(mine, mine[1:]))
        assert {i for a, b in mine for i in range(a, b) if plain(text[i])} == covered


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "x" * 100)], "item_id long, text string")
    assert leaked_items(documents.limit(0), benchmark).count() == 0
    assert leaked_items(documents, benchmark.limit(0)).count() == 0
    assert removal_spans(documents, benchmark.limit(0)).count() == 0
    assert leaked_items(documents, benchmark).count() == 1


def test_runs_of_one_character_stay_bounded():
    import tracemalloc

    text, item = np.append(np.full(300_000, 1, np.uint8), np.uint8(0)), np.full(10_000, 1, np.uint8)
    tracemalloc.start()
    want = phrases_of([(1, item), (2, np.append(item, np.uint8(2)))], 60)
    at, stretch = search_shard(FMIndex(text), text, want, 60)
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert len(at) == 300_000 - 59 and len(set(stretch.tolist())) == 1
    assert want.items[want.first_item[stretch[0]]:want.first_item[stretch[0] + 1]].tolist() == [0, 1]


def test_many_blocks_and_long_items(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, word(rng.choice([10, 70, 2000]))) for i in range(60)]
    docs = [(d, word(50) + items[d % 60][1][-65 - d:][:65 + d] + word(50)) for d in range(120)]
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaked_items(documents, benchmark, block_bytes=300).collect()} == brute(docs, items, 60)


def test_hash_of_a_stretch_is_checked():
    items = [(i, reduced("".join(random.Random(i).choice("ab") for _ in range(61)))) for i in range(50)]
    want = phrases_of(items, 60)
    assert len(want.hashes) == len({t[a:a + 60].tobytes() for _, t in items for a in (0, 1)}) and (np.diff(want.hashes.astype(object)) > 0).all()
