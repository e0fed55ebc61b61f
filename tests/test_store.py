"""The store's rules on small cases."""

import hashlib
import random

import pytest

from arbordelta.operators import gc, mutate, packs, reads, tarstream, temporal
from arbordelta.operators.packs import Member
from arbordelta.operators.reads import ObjectQuery
from arbordelta.schema import CONTENTS, DIR_BIT, LINK_BIT, OBJECTS, PROJECTS, UPDATES, ZERO_HASH


def sha(content):
    return hashlib.sha256(content).hexdigest()


def objects(spark, rows):
    """rows: (project, start, stop, path, content)."""
    return spark.createDataFrame([(p, s, e, path, sha(c), 493, len(c), False) for p, s, e, path, c in rows], OBJECTS)


def contents(spark, blobs):
    return spark.createDataFrame(sorted({(sha(b), b) for b in blobs}), CONTENTS)


def changes(df):
    return sorted((r.path, r.deleted) for r in df.collect())


def test_range(spark):
    df = objects(spark, [(1, 1, 3, "/a", b""), (1, 2, 3, "/b", b"b v2"), (1, 3, None, "/b", b"b v3"), (1, 3, None, "/c", b""), (1, 4, None, "/d", b"")])
    assert changes(temporal.diff(df, 1, 2)) == [("/b", False)]
    got = {r.path: r for r in temporal.diff(df, 1, 3).collect()}
    assert {p: r.deleted for p, r in got.items()} == {"/a": True, "/b": False, "/c": False}
    assert (got["/a"].size, got["/a"].hash) == (0, ZERO_HASH) and got["/b"].hash == sha(b"b v3")


def test_delete_all(spark):
    df = objects(spark, [(1, 1, 2, "/a", b""), (1, 1, 3, "/b", b""), (1, 1, 3, "/c", b"")])
    assert changes(temporal.diff(df, 1, 2)) == [("/a", True)]
    assert changes(temporal.diff(df, 1, 3)) == [("/a", True), ("/b", True), ("/c", True)]
    assert changes(temporal.diff(df, 2, 3)) == [("/b", True), ("/c", True)]


@pytest.mark.parametrize("rows,want", [
    ([(1, 1, 2, "a.html", b""), (1, 2, None, "a.html/foo", b"")], [("a.html/foo", False)]),
    ([(1, 1, 2, "a/", b""), (1, 1, None, "b/", b""), (1, 2, None, "a/c", b"")], [("a/c", False)]),
    ([(1, 1, 2, "a/", b""), (1, 2, None, "abc", b"")], [("a/", True), ("abc", False)]),
    ([(1, 1, 2, "a", b"x"), (1, 1, 2, "b", b""), (1, 2, None, "a", b"y"), (2, 2, None, "b", b"")], [("a", False), ("b", False), ("b", True)]),
])
def test_tombstones(spark, rows, want):
    assert changes(temporal.diff(objects(spark, rows), 1, 2)) == want


def test_prefix_tests_become_equality(spark):
    plan = temporal.diff(objects(spark, [(1, 1, 2, "a", b"")]), 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_point_in_time_and_start_zero(spark):
    df = objects(spark, [(1, 1, 2, "/a", b"1"), (1, 2, 3, "/a", b"2"), (1, 3, None, "/a", b"3"), (1, 0, None, "/z", b"")])
    for v in (1, 2, 3):
        assert [r.hash for r in temporal.snapshot(df, v).collect()] == [sha(str(v).encode())]


def test_queries(spark):
    df = objects(spark, [(1, 1, None, p, b"") for p in ("/a/b", "/a/c", "/a/b/x", "/l", "/a_", "/axb")])
    read = lambda q: sorted(r.path for r in temporal.snapshot(df, 1, q.path_filter()).collect())
    assert read(ObjectQuery("/a", True, ignores=("/a/b",))) == ["/a/c", "/a_", "/axb"]
    assert read(ObjectQuery("/a_", True)) == ["/a_"]
    assert read(ObjectQuery("/a/b")) == ["/a/b"]
    assert read(ObjectQuery("", True)) == ["/a/b", "/a/b/x", "/a/c", "/a_", "/axb", "/l"]
    with pytest.raises(ValueError):
        ObjectQuery("/a", ignores=("/a/b",))
    with pytest.raises(ValueError):
        ObjectQuery("/a", True, ignores=("/b",))


# --- a random history against a plain model

class Model:
    """A store in plain Python, one project without packs."""

    def __init__(self):
        self.rows, self.version = [], 0

    def update(self, batch):
        v = self.version + 1
        changed = False
        for path in {p for p, c in batch if c is None}:
            changed = True
            for r in self.rows:
                if r["path"] == path and r["stop"] is None:
                    r["stop"] = v
        writes = {p: c for p, c in batch if c is not None}
        fresh = [(p, c) for p, c in writes.items() if not any(r["path"] == p and r["hash"] == sha(c) and r["stop"] is None for r in self.rows)]
        retired = set()
        for p, _ in fresh:
            parts = p.split("/")
            retired |= {p} | {"/".join(parts[:i]) + "/" for i in range(1, len(parts))}
        for r in self.rows:
            if r["path"] in retired and r["stop"] is None:
                r["stop"] = v
        self.rows += [{"path": p, "hash": sha(c), "start": v, "stop": None} for p, c in fresh]
        if fresh or changed:
            self.version = v


def history(rng, steps):
    """Tree-consistent batches: (path, content), content None for a delete."""
    tree = {}
    for _ in range(steps):
        batch = {}
        for _ in range(rng.randint(0, 4)):
            path = "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
            if tree and rng.random() < 0.4:
                gone = rng.choice(sorted(tree))
                if gone not in batch:
                    batch[gone] = None
                    del tree[gone]
                continue
            clash = [p for p in tree if p.startswith(path + "/") or path.startswith(p + "/")]
            if path in batch or any(p in batch for p in clash) or any(batch.get(p) and (p.startswith(path + "/") or path.startswith(p + "/")) for p in batch):
                continue
            for p in clash:
                batch[p] = None
                del tree[p]
            batch[path] = tree[path] = bytes([rng.randint(0, 2)])
        yield list(batch.items())


def test_update_and_diff_against_model(spark):
    rng = random.Random(5)
    models, rows, batches = [Model() for _ in range(12)], [], []
    for project, model in enumerate(models):
        for batch in history(rng, 8):
            model.update(batch)
        last = next(history(rng, 1)) or [("a", b"z")]
        rows += [(project, r["start"], r["stop"], r["path"], r["hash"], 493, 1, False) for r in model.rows]
        batches += [(project, i, p, 493, 1, c is None, c) for i, (p, c) in enumerate(last)]
        model.before = model.version
        model.update(last)
    state = mutate.State(
        spark.createDataFrame([(i, m.before, None) for i, m in enumerate(models)], PROJECTS), spark.createDataFrame(rows, OBJECTS), contents(spark, [b""]))
    after, versions = mutate.update_batch(state, spark.createDataFrame(batches, UPDATES))
    got = sorted((r.project, r.path, r.hash, r.start_version, r.stop_version or -1) for r in after.objects.collect())
    want = sorted((i, r["path"], r["hash"], r["start"], r["stop"] or -1) for i, m in enumerate(models) for r in m.rows)
    assert got == want
    assert {r.project: r.version for r in versions.collect()} == {i: m.version for i, m in enumerate(models)}
    assert mutate.interval_violations(after.objects).count() == 0
    frame = after.objects.persist()
    for a, b in ((1, 2), (1, 5), (2, 7), (4, 8)):
        applied = temporal.apply_diff(temporal.snapshot(frame, a).select("project", "path", "hash"), temporal.diff(frame, a, b))
        assert sorted(map(tuple, applied.collect())) == sorted(map(tuple, temporal.snapshot(frame, b).select("project", "path", "hash").collect())), (a, b)


def test_update_rules(spark):
    state = mutate.State(
        spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, None), (4, 1, None)], PROJECTS),
        objects(spark, [(1, 1, None, "/a", b"v1"), (1, 1, None, "/b", b"v1"), (2, 1, None, "x", b"v1"), (3, 1, None, "x", b"v1")]), contents(spark, [b"v1"]))
    batch = spark.createDataFrame([
        (1, 1, "/a", 493, 2, False, b"v2"), (1, 2, "/a", 493, 2, False, b"v3"), (1, 3, "/b", 493, 0, True, None), (1, 4, "/b", 493, 2, False, b"v1"),
        (2, 1, "x", 493, 9, False, b"v1"), (3, 1, "nowhere", 0, 0, True, None), (4, 1, "e", 493, 0, None, None), (9, 1, "e", 493, 0, False, None)], UPDATES)
    after, versions = mutate.update_batch(state, batch)
    assert {r.project: r.version for r in versions.collect()} == {1: 2, 2: 1, 3: 2, 4: 2}
    live = sorted((r.project, r.path, r.hash) for r in after.objects.where("stop_version is null").collect())
    assert live == [(1, "/a", sha(b"v3")), (1, "/b", sha(b"v1")), (2, "x", sha(b"v1")), (3, "x", sha(b"v1")), (4, "e", sha(b""))]
    assert {r.hash for r in after.contents.collect()} >= {sha(b"v1"), sha(b"v3"), sha(b"")}


def test_clone_rollback_reset(spark):
    rows = [(1, 1, 3, "a", b"1"), (1, 2, None, "b", b"1"), (1, 3, 4, "c", b"1"), (1, 4, None, "d", b"1"), (2, 1, None, "b", b"1"), (2, 1, None, "q", b"1")]
    state = mutate.State(spark.createDataFrame([(1, 4, None), (2, 1, None), (3, 0, ["x"])], PROJECTS), objects(spark, rows), contents(spark, [b"1"]))
    at3 = mutate.rollback(state, 1, 3)
    assert sorted(r.path for r in at3.objects.where("project = 1 and stop_version is null").collect()) == ["b", "c"]
    assert reads.latest_version(at3.projects, 1) == 3
    cloned = mutate.clone_project(state, 1, 2, 2)
    assert sorted(r.path for r in cloned.objects.where("project = 2 and stop_version is null").collect()) == ["a", "b"]
    assert reads.latest_version(cloned.projects, 2) == 2
    with pytest.raises(mutate.PatternMismatch):
        mutate.clone_project(state, 1, 3, 2)
    assert mutate.snapshot_state(state.projects).first()[0] == "1=4,2=1,3=0"
    back = mutate.reset(state, mutate.parse_state("1=2"))
    assert [tuple(r)[:2] for r in back.projects.collect()] == [(1, 2)]
    assert sorted(r.path for r in back.objects.where("stop_version is null").collect()) == ["a", "b"]
    assert mutate.reset(state).objects.count() == 0
    with pytest.raises(mutate.AlreadyExists):
        mutate.new_project(state, 1)
    with pytest.raises(reads.ProjectNotFound):
        reads.latest_version(state.projects, 77)


def test_collection(spark):
    rows = [(1, v, v + 1 if v < 20 else None, "f", bytes([v])) for v in range(1, 21)]
    state = mutate.State(spark.createDataFrame([(1, 20, None)], PROJECTS), objects(spark, rows), contents(spark, [bytes([v]) for v in range(1, 21)]))
    after, lost = gc.gc(state, state.projects, 5, 2)
    assert lost.count() == 12 and after.contents.count() == 8
    assert gc.gc_contents(after)[1].count() == 0
    with pytest.raises(ValueError):
        gc.gc_rows(state.objects, state.projects, 0)


# --- packs

def pack(*members):
    return packs.encode_pack(Member(p, 420, len(c), False, c) for p, c in members)


def test_pack_round_trip():
    members = [Member("a/f", 420, 3, False, b"abc"), Member("a/d/", DIR_BIT | 493, 0, False, b""), Member("a/l", LINK_BIT | 511, 3, False, b"a/f"),
               Member("a/gone", 420, 0, True, b""), Member("a/" + "long" * 60, 420, 0, False, b""), Member("a/é", 420, 32, False, bytes(32), True)]
    got = packs.decode_pack(packs.encode_pack(members))
    assert [(m.path, m.mode, m.deleted, m.content, m.cached) for m in got] == [(m.path, m.mode, m.deleted, m.content, m.cached) for m in members]
    assert packs.decode_pack(b"no tar") == packs.decode_pack(None) == []
    assert [m.path for m in packs.decode_pack(pack(("x", b"1"), ("y", b"2" * 600))[:1500])] == ["x"]


def test_pack_merge_is_deterministic():
    before = pack(("b", b"1"), ("a", b"1"))
    up = lambda p, c: Member(p, 420, 0, c is None, c)
    updates = [up("d", b"2"), up("a", b"2"), up("c", b"2"), up("zz", None)]
    merged = packs.merge_pack(before, updates)
    assert [(m.path, m.content) for m in packs.decode_pack(merged)] == [("b", b"1"), ("a", b"2"), ("c", b"2"), ("d", b"2")]
    assert merged == packs.merge_pack(before, updates[::-1])
    assert packs.merge_pack(before, [up("a", None), up("b", None)]) is None
    assert packs.merge_pack(before, [up("b", b"1")]) == before


def test_packed_updates_and_reads(spark):
    blob = pack(("a/x/1", b"one"), ("a/x/2", b"two"))
    rows = [(1, 1, None, "a/x/", sha(blob), 0, len(blob), True), (1, 1, None, "plain", sha(b"p"), 420, 1, False)]
    state = mutate.State(spark.createDataFrame([(1, 1, ["a/.*/"]), (2, 1, None)], PROJECTS), spark.createDataFrame(rows, OBJECTS), contents(spark, [blob, b"p"]))

    def step(state, *changes):
        batch = spark.createDataFrame([(1, i, p, 420, 1, c is None, c) for i, (p, c) in enumerate(changes)], UPDATES)
        after, versions = mutate.update_batch(state, batch)
        return after, versions.first().version

    def read(state, query, **kw):
        return sorted((r.path, bytes(r.content) if r.content is not None else None) for r in reads.get_objects(state.objects, state.contents, state.projects, query, **kw).collect())

    assert read(state, ObjectQuery("", True)) == [("a/x/1", b"one"), ("a/x/2", b"two"), ("plain", b"p")]
    assert read(state, ObjectQuery("a/x/2")) == [("a/x/2", b"two")]
    assert read(state, ObjectQuery("a/x/", True)) == read(state, ObjectQuery("a/", True)) == [("a/x/1", b"one"), ("a/x/2", b"two")]
    assert read(state, ObjectQuery("", True), limit=10) == [("a/x/", None), ("plain", b"p")]
    after, version = step(state, ("a/x/1", b"uno"), ("a/y/3", b"three"))
    assert version == 2 and read(after, ObjectQuery("a", True)) == [("a/x/1", b"uno"), ("a/x/2", b"two"), ("a/y/3", b"three")]
    assert read(after, ObjectQuery("a", True), to=1) == [("a/x/1", b"one"), ("a/x/2", b"two")]
    same, version = step(state, ("a/x/1", b"one"))
    assert version == 1
    gone, version = step(state, ("a/x/1", None), ("a/x/2", None))
    assert version == 2 and read(gone, ObjectQuery("", True)) == [("plain", b"p")]
    assert changes(temporal.diff(gone.objects, 1, 2)) == [("a/x/", True)]
    _, version = step(state, ("a/none/1", None))
    assert version == 2  # a delete in a pack that isn't there makes a version, too


# --- chunks

def greedy(sizes, limit):
    out, size, chunk = [], 0, 0
    for n in sizes:
        size += n
        out.append((chunk, size))
        if size > limit:
            size, chunk = 0, chunk + 1
    return out


def test_chunks_do_not_depend_on_segments(spark):
    rng = random.Random(1)
    rows = [(p, f"{i:04d}", rng.random() < 0.05, rng.choice([0, 1, 5, 9, 40, 120])) for p in (1, 2, 3) for i in range({1: 300, 2: 7, 3: 90}[p])]
    want = []
    for p in (1, 2, 3):
        mine = [r for r in rows if r[0] == p and not r[2]]
        want += [(p, r[1], c, n) for r, (c, n) in zip(mine, greedy([r[3] for r in mine], 100))]
    df = spark.createDataFrame(rows, "project long, path string, alone boolean, bytes long")
    for segments in (1, 4, 40):
        got = tarstream.tar_chunks(df, 100, segments).collect()
        assert sorted((r.project, r.path, r.chunk, r.bytes_so_far) for r in got if r.pack_path is None) == sorted(want)
        assert sorted((r.project, r.pack_path) for r in got if r.pack_path) == sorted((r[0], r[1]) for r in rows if r[2])


def test_step_function():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        limit = rng.randint(0, 30)
        sizes = [rng.choice([0, 0, 1, 3, 10, 40]) for _ in range(rng.randint(0, 12))]
        f = tarstream.step_function(np.array(sizes, np.int64), limit)
        for start in range(limit + 1):
            size, chunk = start, 0
            for n in sizes:
                size += n
                if size > limit:
                    size, chunk = 0, chunk + 1
            # A segment's start is a size within the limit, so nothing ends before its first byte.
            assert tarstream.apply_step(*f, sum(sizes), start) == (size, chunk), (sizes, limit, start)


def test_inspect_counts_members_of_packs(spark, tmp_path):
    from arbordelta.plans.store_queries import inspect_members_given
    from arbordelta.schema import CACHE_VERSIONS

    def pack(n):
        return packs.encode_pack([Member(f"{i}", 420, 1, False, b"x") for i in range(n)])

    # (project, start, stop, path, content, packed); project 3 has latest_version 4
    rows = [
        (1, 1, None, "f", b"f", False), (1, 1, None, "p/", pack(5), True), (1, 2, None, "q/", pack(3), True), (1, 1, 2, "old/", pack(7), True), (1, 0, None, "zero/", pack(9), True),
        (2, 1, None, "p/", pack(5), True), (2, 1, None, "lost/", b"not in contents", True), (3, 1, 5, "p/", pack(2), True), (3, 5, None, "later/", pack(2), True), (3, 2, 4, "f", b"f", False)]
    blobs = {c for *_, c, _ in rows if c != b"not in contents"}
    tables = {
        "projects": spark.createDataFrame([(1, 2, None), (2, 1, []), (3, 4, None), (4, 0, None)], PROJECTS),
        "objects": spark.createDataFrame([(p, s, e, path, sha(c), 0, len(c), packed) for p, s, e, path, c, packed in rows], OBJECTS),
        "contents": contents(spark, blobs), "cache_versions": spark.createDataFrame([], CACHE_VERSIONS)}
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    latest, live, total = {1: 2, 2: 1, 3: 4, 4: 0}, dict.fromkeys(range(1, 5), 0), dict.fromkeys(range(1, 5), 0)
    for p, s, e, _, c, packed in rows:
        total[p] += 1
        if 0 < s <= latest[p] and (e is None or e > latest[p]):
            live[p] += len(packs.decode_pack(c)) if packed and c in blobs else 1
    assert live == {1: 9, 2: 6, 3: 2, 4: 0}
    assert sorted(map(tuple, inspect_members_given(spark, str(tmp_path)).collect())) == [(p, latest[p], live[p], total[p]) for p in range(1, 5)]
