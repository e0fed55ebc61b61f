"""The compaction store: nothing is lost, repeated, or rewritten without need."""

import random

import pytest

from arbordelta.operators import compaction
from arbordelta.operators.compaction import CompactionStore, TierPolicy
from tests.test_data_operators import OBJECT, dirty_objects, obj

SMALL = TierPolicy(bounds=(4, 64, 1024), min_files=4, fan_in=2, target=1024, max_inputs=50)


def frame(spark, rows):
    return spark.createDataFrame(rows, OBJECT)


def blobs(spark, rows):
    return spark.createDataFrame([(h, h.encode()) for h in sorted({r[4] for r in rows if r[4]})], "hash string, bytes binary")


def key(r):
    return str(r.project), r.path, r.hash, r.size


def checked(store, spark, rows, contents, policy=compaction.DEFAULT_POLICY):
    """Every live file is there once with its bytes; the ids of the packs."""
    objects = frame(spark, rows)
    got = store.files(objects, contents, policy).collect()
    want = compaction.live_files(objects, policy).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all((bytes(r.bytes) if r.bytes is not None else None) == (r.hash.encode() if r.hash else None) for r in got)
    held = store.packs()
    packed = [] if held is None else held.collect()
    assert sorted((str(r.project), r.path, r.pack_id) for r in packed) == sorted((str(r.project), r.path, r.pack_id) for r in got if r.pack_id)
    if (journal := store.journal()) is not None:
        merges = journal.collect()
        assert len({m.txn_id for m in merges}) == len(merges) and {r.pack_id for r in packed} <= {m.output for m in merges}
        named = {}
        for r in store.inputs().collect():
            named.setdefault(r.output, set()).add(r.input)
        assert {m.output: m.n_inputs for m in merges} == {k: len(v) for k, v in named.items()}
        taken = [i for v in named.values() for i in v if i.startswith("P")]
        assert len(taken) == len(set(taken)) and set(taken) <= set(named)
    return {r.pack_id for r in packed}


def test_dirty_rows(spark, tmp_path):
    rows = dirty_objects()
    store, contents = CompactionStore(spark, f"file://{tmp_path}"), blobs(spark, rows)
    assert store.packs() is None and store.journal() is None and store.vacuum() == []
    assert store.run(frame(spark, []), contents) is None
    assert store.run(frame(spark, rows), contents) == 1
    found = {(m.project, m.dir_path) for m in store.journal().where("level = 0").collect()}
    assert found == {(1, "d/"), (2, "")}
    store.compact(frame(spark, rows), contents)
    checked(store, spark, rows, contents)
    assert store.compact(frame(spark, rows[::-1] + rows), contents) == []


def test_back_to_an_earlier_state(spark, tmp_path):
    a = [obj(path=f"d/{i}", hash=f"a{i}") for i in range(20)]
    b = a + [obj(path=f"d/b{i}", hash=f"b{i}") for i in range(17)]
    store, contents = CompactionStore(spark, f"file://{tmp_path}"), blobs(spark, b)
    for rows, n in ((a, 20), (b, 37), (a, 20), ([], 0), (b, 37), (a, 20)):
        store.compact(frame(spark, rows), contents)
        checked(store, spark, rows, contents)
        assert store.packs().count() == n
    assert store.vacuum()
    checked(store, spark, a, contents)


def test_small_additions_rewrite_little(spark, tmp_path):
    rng = random.Random(3)
    rows = [obj(project=p, path=f"d{i % 3}/{i}", hash=f"h{p}.{i}", size=rng.randint(1, 30_000)) for p in range(12) for i in range(60)]
    new = [obj(project=p, path="d0/new", hash=f"new{p}", size=100) for p in range(12)]
    store, contents = CompactionStore(spark, f"file://{tmp_path}"), blobs(spark, rows + new)
    store.compact(frame(spark, rows), contents)
    before = checked(store, spark, rows, contents)
    written = store.journal().agg({"n_bytes": "sum"}).first()[0]
    store.compact(frame(spark, rows + new), contents)
    assert before <= checked(store, spark, rows + new, contents)
    assert 10 * (store.journal().agg({"n_bytes": "sum"}).first()[0] - written) < sum(r[6] for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_histories(spark, tmp_path, seed):
    rng = random.Random(seed)
    pool = [obj(project=rng.choice([1, 1, 1, 2, None]), path=f"{rng.choice('ab')}/{i}", hash=f"h{i}", size=rng.choice([0, 1, 2, 3, 5, 40, 300, 2000])) for i in range(90)]
    store, contents = CompactionStore(spark, f"file://{tmp_path}"), blobs(spark, pool)
    for _ in range(4):
        rows = rng.sample(pool, rng.randint(0, 90))
        store.compact(frame(spark, rows), contents, SMALL)
        checked(store, spark, rows, contents, SMALL)
        assert store.compact(frame(spark, rows), contents, SMALL) == []
        sizes = {}
        for r in store.packs().collect() if store.packs() else ():
            sizes.setdefault((r.project, r.pack_id), []).append(r.size)
        like = {}
        for (p, _), v in sizes.items():
            like.setdefault((p, sum(sum(v) >= b for b in SMALL.bounds)), []).append(v)
        assert all(len(v) < SMALL.min_files for (_, c), v in like.items() if c < 3)


def test_a_lost_race_publishes_nothing(spark, tmp_path):
    from arbordelta.sources.commits import Conflict

    rows = [obj(path=f"d/{i}", hash=f"a{i}") for i in range(20)]
    store, contents = CompactionStore(spark, f"file://{tmp_path}"), blobs(spark, rows)
    store.run(frame(spark, rows), contents)
    with pytest.raises(Conflict):
        store.commits.publish(1, {})
    assert store.rounds() == [1]
    checked(store, spark, rows, contents)
