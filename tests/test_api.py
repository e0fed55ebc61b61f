import os

import pytest

from arbordelta.api import FileTrees
from arbordelta.operators import mutate, packs, reads
from arbordelta.operators.reads import ObjectQuery
from arbordelta.schema import UPDATES
from arbordelta.sources import tree
from arbordelta.sources.storage import Store
from arbordelta.sources.workspace import Workspace


@pytest.fixture
def trees(spark, tmp_path):
    return FileTrees(Store(spark, f"file://{tmp_path}/store"))


def send(trees, project, *rows):
    return trees.update(trees.store.spark.createDataFrame([(project, i, p, 420, 1, c is None, c) for i, (p, c) in enumerate(rows)], UPDATES))


def content(trees, project, **kw):
    return {r.path: bytes(r.content) for r in trees.get(project, **kw).collect() if not r.deleted}


def test_life_of_a_project(trees):
    assert trees.new_project(1) == 0
    with pytest.raises(mutate.AlreadyExists):
        trees.new_project(1)
    assert send(trees, 1) is None
    assert send(trees, 1, ("a", b"1"), ("d/b", b"1")) == 1
    assert send(trees, 1, ("a", b"1")) == 1
    assert send(trees, 1, ("a", b"2"), ("d/b", None)) == 2
    assert content(trees, 1) == {"a": b"2"} and content(trees, 1, to=1) == {"a": b"1", "d/b": b"1"}
    version, rows = trees.get_unary(1, [ObjectQuery("d/", True), ObjectQuery("a")], start=1)
    assert version == 2 and sorted((r.query_idx, r.path, r.deleted) for r in rows) == [(0, "d/b", True), (1, "a", False)]
    assert trees.new_project(2, template=1) == 2 and content(trees, 2) == {"a": b"2"}
    assert trees.clone(1, 2, 1) == 3 and content(trees, 2) == {"a": b"1", "d/b": b"1"}
    saved = trees.snapshot()
    assert saved == "1=2,2=3"
    trees.rollback(1, 1)
    assert content(trees, 1) == {"a": b"1", "d/b": b"1"}
    assert tuple(trees.inspect(1).first()) == (1, 1, 2, 2)
    with pytest.raises(mutate.BadPattern):
        trees.new_project(8, ["ok/", "(/"])
    before = content(trees, 1)
    assert trees.gc_project(2, 1) >= 0 and trees.fold_and_vacuum() > 0 and trees.fold_and_vacuum() == 0
    assert content(trees, 1) == before and len(trees.store.commits.numbers()) == 1
    trees.delete_project(2)
    assert [r.id for r in trees.list_projects().collect()] == [1]
    assert trees.gc_contents(100) == 1 and trees.gc_contents(100) == 0
    trees.reset("1=1")
    assert trees.snapshot() == "1=1"
    with pytest.raises(reads.ProjectNotFound):
        send(trees, 9, ("a", b"1"))
    with pytest.raises(ValueError):
        trees.update(trees.store.spark.createDataFrame([(p, 0, "a", 420, 1, False, b"") for p in (1, 2)], UPDATES))
    trees.reset()
    assert trees.list_projects().count() == 0


def test_tars_and_caches(trees):
    trees.new_project(1, ["^pack/"])
    send(trees, 1, ("pack/a", b"A"), ("pack/b", b"B"), ("f", b"F"), ("gone", b"G"))
    send(trees, 1, ("gone", None), ("f", b"FF"))
    assert trees.create_cache("pack/", 5) == 1
    assert trees.get_cache().count() == 1 and trees.get_cache(7).count() == 0

    def sent(**kw):
        version, frame = trees.get_compress(1, **kw)
        assert version == 2
        return sorted((r.pack_path or "", [(m.path, m.deleted, m.cached, m.content) for m in packs.decode_pack(r.bytes)]) for r in frame.collect())

    members = [("pack/a", False, False, b"A"), ("pack/b", False, False, b"B")]
    assert sent() == [("", [("f", False, False, b"FF")]), ("pack/", members)]
    assert sent(start=1) == [("", [("f", False, False, b"FF"), ("gone", True, False, b"")])]
    [(_, entries)] = sent(cached=[1])
    assert [e[:3] for e in entries] == [("f", False, False), ("pack/", False, True)] and len(entries[1][3]) == 32
    assert sent(query=ObjectQuery("f"), start=1) == [("", [("f", False, False, b"FF")])]
    assert [e[0] for e in sent(query=ObjectQuery("f"), start=1, compat_tombstones=True)[0][1]] == ["f", "gone"]


def test_workspaces_follow_each_other(trees, tmp_path):
    trees.new_project(1)
    a, b = Workspace(trees, 1, str(tmp_path / "a")), Workspace(trees, 1, str(tmp_path / "b"))
    os.makedirs(a.root)
    for path, text in (("x", b"1"), ("d/y", b"1"), ("d/z", b"1")):
        tree.write_object(a.root, path, 420, False, text)
    assert a.update() == 1 and a.update() is None
    assert b.rebuild(include="*") == (1, 3, 0, True)
    tree.write_object(b.root, "d/y", 420, True, None)
    tree.write_object(b.root, "x", 420, False, b"22")
    tree.write_object(b.root, "n/new", 420, False, b"3")
    assert b.update(subpaths=["d/", "x"]) == 2
    tree.write_object(a.root, "other", 420, False, b"4")
    assert a.update() == 3  # and catches up with version 2
    assert tree.read_version(a.root) == 3
    assert sorted(tree.list_dir(a.root)) == ["d/z", "other", "x"]
    assert b.rebuild()[:2] == (3, 1)
    assert sorted(tree.list_dir(b.root)) == ["d/z", "n/new", "other", "x"]


def on_disk(root):
    out = {}
    for p in tree.list_dir(root):
        if not p.endswith("/"):
            full = os.path.join(root, p)
            out[p] = os.readlink(full).encode() if os.path.islink(full) else open(full, "rb").read()
    return out


def sync(trees, project, ws):
    ws.rebuild()
    assert on_disk(ws.root) == content(trees, project)
    assert ws.changes().where("not path like '%/'").count() == 0


def test_a_tree_follows_its_packs(trees, tmp_path):
    trees.new_project(1, ["^pack/", "^mods/[^/]+/"])
    ws = Workspace(trees, 1, str(tmp_path / "w"))
    for step in (
        [("pack/a", b"A"), ("pack/b", b"B"), ("z", b"Z"), ("mods/x/1", b"1"), ("mods/y/1", b"1")],
        [("pack/a", None)],
        [("pack/c/d", b"D"), ("mods/x/2", b"2"), ("mods/x/1", None)],
        [("pack/b", None), ("pack/c/d", None), ("mods/y/1", None)],
        [("pack/again", b"!"), ("z", None)],
    ):
        send(trees, 1, *step)
        sync(trees, 1, ws)
    assert not os.path.exists(tmp_path / "w/mods/y")
    os.makedirs(tmp_path / "v")
    late = Workspace(trees, 1, str(tmp_path / "v"))
    tree.write_object(late.root, "pack/stale", 420, False, b"not of the project")
    sync(trees, 1, late)


def test_a_pack_becomes_a_symlink(trees, tmp_path):
    trees.new_project(1, ["^mods/[^/]+/"])
    ws = Workspace(trees, 1, str(tmp_path / "w"))
    send(trees, 1, ("mods/x/1", b"1"), ("other/f", b"2"))
    sync(trees, 1, ws)
    link = [(1, 0, "mods/x/1", 0, 0, True, None), (1, 1, "mods/y/1", 420, 1, False, b"y")]
    trees.update(trees.store.spark.createDataFrame(link, UPDATES))
    trees.update(trees.store.spark.createDataFrame([(1, 0, "mods", 1 << 27 | 511, 5, False, b"other")], UPDATES))
    ws.rebuild()
    assert os.path.exists(tmp_path / "w/other/f")


def test_random_packs_on_disk(trees, tmp_path):
    import random

    rng = random.Random(5)
    trees.new_project(1, ["^p[01]/"])
    ws, live = Workspace(trees, 1, str(tmp_path / "w")), set()
    for step in range(4):
        rows = {}
        for _ in range(rng.randint(1, 6)):
            path = f"{rng.choice(['p0', 'p1', 'q'])}/{rng.choice('abc')}"
            rows[path] = None if path in live and rng.random() < 0.6 else f"{step}{path}".encode()
        live = (live | {p for p, c in rows.items() if c}) - {p for p, c in rows.items() if not c}
        send(trees, 1, *rows.items())
        if rng.random() < 0.7:
            sync(trees, 1, ws)
    sync(trees, 1, ws)
    assert set(on_disk(ws.root)) == live


def test_rebuild_with_a_cache(trees, tmp_path):
    trees.new_project(1, ["^pack/[^/]+/"])
    send(trees, 1, ("pack/a/1", b"a1"), ("pack/a/2", b"a2"), ("pack/b/1", b"b1"), ("f", b"F"))
    trees.create_cache("pack/", 100)
    cache = str(tmp_path / "cache")
    assert tree.download_cache(trees.get_cache(), cache) == 1
    ws = Workspace(trees, 1, str(tmp_path / "w"))
    assert ws.rebuild(cache_root=cache) == (1, 3, 2, True)
    assert on_disk(ws.root) == content(trees, 1)
    send(trees, 1, ("pack/a/1", None), ("pack/b/1", None))
    done = ws.rebuild(cache_root=cache)
    assert done.version == 2 and done.cached_count == 0 and on_disk(ws.root) == content(trees, 1)
    fresh = Workspace(trees, 1, str(tmp_path / "x"))
    assert fresh.rebuild(to=1, cache_root=cache, include="*")[1:] == (3, 2, True)
    assert on_disk(fresh.root) == content(trees, 1, to=1)


def test_collection_of_a_project_keeps_what_others_hold(trees):
    for p in (1, 65, 2):
        trees.new_project(p)
    send(trees, 1, ("a", b"own"), ("b", b"shared"), ("c", b"near"))
    send(trees, 65, ("x", b"near"))
    send(trees, 2, ("x", b"shared"))
    for k in range(3):
        send(trees, 1, *[(p, b"new%d" % k) for p in "abc"])
    hashes = lambda: trees.store.table("contents").count()
    n = hashes()
    assert trees.gc_project(1, 1) == 2 and hashes() == n - 2  # "own" and "new0"; "new1" ended one version ago only
    assert content(trees, 2) == {"x": b"shared"} and content(trees, 65) == {"x": b"near"} and content(trees, 1) == {p: b"new2" for p in "abc"}


def test_contents_are_folded_by_tiers(spark, tmp_path):
    from arbordelta.schema import CONTENTS

    store, n = Store(spark, f"file://{tmp_path}/folded"), 0
    for k in range(9):
        store.commit(store.generation(), append={"contents": spark.createDataFrame([(f"h{k}", b"x")], CONTENTS)})
        while store.fold_contents(fan_in=3) is not None:
            n += 1
    assert n == 4 and len(store.entry()["parts"]["contents"]["-"]) == 1
    assert sorted(r.hash for r in store.table("contents").collect()) == [f"h{k}" for k in range(9)]
    assert store.vacuum(2) > 0 and len(store.commits.numbers()) == 2 and store.table("contents").count() == 9
