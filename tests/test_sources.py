import os
import threading

import pytest

from arbordelta.operators import cache, packs
from arbordelta.operators.packs import Member
from arbordelta.schema import CACHE_VERSIONS, CONTENTS, PROJECTS, UPDATES
from arbordelta.sources import tree
from arbordelta.sources.storage import Conflict, Store
from arbordelta.streaming.ingest import apply_to_store, start_ingest


def listing(root):
    out = {}
    for path in tree.list_dir(root):
        p, mode, _, _, content = tree.read_object(root, path)
        out[p] = (mode, content)
    return out


def test_tree_round_trip(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    os.makedirs(a)
    for path, mode, content in (("x/y/f", 0o640, b"1"), ("x/empty/", 0o755 | 1 << 31, None), ("l", 0o777 | 1 << 27, b"x/y/f"), ("bin", 0o755, bytes(range(256)))):
        tree.write_object(a, path, mode, False, content)
    tree.write_version(a, 7)
    assert tree.read_version(a) == 7 and tree.read_version(b) == 0
    scanned = tree.scan_dir(spark, a)
    assert scanned.count() == 4
    done = tree.materialize(scanned, b, include="*", exclude="nothing").first()
    assert tuple(done) == (4, True)
    assert listing(a) == listing(b)
    assert tuple(tree.materialize(scanned.limit(0), b).first()) == (0, False)


def test_what_is_in_the_way_goes(spark, tmp_path):
    root = str(tmp_path)
    write = lambda *rows: tree.materialize(spark.createDataFrame([(p, 0o644, 0, c is None, c) for p, c in rows], tree.OBJECT_SCHEMA), root)
    write(("a", b"file"), ("d/x", b"1"), ("d/y", b"2"))
    write(("a/b", b"below"), ("d", b"now a file"), ("d/x", None), ("nowhere", None), ("nodir/", None))
    assert {p: c for p, (_, c) in listing(root).items()} == {"a/b": b"below", "d": b"now a file"}
    with pytest.raises(ValueError):
        tree.write_object(root, "../out", 0, False, b"")


def test_vanished_file_is_a_delete(tmp_path):
    assert tree.read_object(str(tmp_path), "gone")[3] is True


def test_cache_download(spark, tmp_path):
    blob = packs.encode_pack([Member("f", 420, 1, False, b"1")])
    versions = spark.createDataFrame([(1, []), (2, ["h", "lost"])], CACHE_VERSIONS)
    contents = spark.createDataFrame([("h", blob)], CONTENTS)
    for _ in range(2):
        assert tree.download_cache(cache.get_cache(versions, contents), str(tmp_path)) == 2
    assert listing(str(tmp_path / "objects" / "h")) == {"f": (420, b"1")}
    assert tree.read_cache_versions(str(tmp_path)) == [2]
    assert tree.download_cache(cache.get_cache(versions, contents, 1), str(tmp_path)) == -1


def batch(spark, *rows):
    return spark.createDataFrame([(1, i, p, 420, 1, c is None, c) for i, (p, c) in enumerate(rows)], UPDATES)


def store_with_project(spark, root):
    store = Store(spark, f"file://{root}")
    store.commit(0, {"projects": spark.createDataFrame([(1, 0, None)], PROJECTS)})
    return store


def test_commits_are_atomic_and_exclusive(spark, tmp_path):
    store = store_with_project(spark, tmp_path)
    assert store.generation() == 1
    apply_to_store(store, batch(spark, ("a", b"1")))
    assert store.generation() == 2 and [r.path for r in store.table("objects").collect()] == ["a"]
    assert store.table("objects", 1).count() == 0
    with pytest.raises(Conflict):
        store.commit(1, {"projects": store.table("projects", 1)})
    assert store.generation() == 2


def test_concurrent_writers_both_succeed(spark, tmp_path):
    store = store_with_project(spark, tmp_path)
    threads = [threading.Thread(target=apply_to_store, args=(store, batch(spark, (p, b"1")))) for p in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted((r.path, r.start_version) for r in store.table("objects").collect()) in ([("a", 1), ("b", 2)], [("a", 2), ("b", 1)])


def test_stream_is_applied_once(spark, tmp_path):
    store = store_with_project(spark, tmp_path / "store")
    feed = tmp_path / "feed"
    batch(spark, ("a", b"1"), ("b", b"1")).coalesce(1).write.mode("append").parquet(str(feed))
    run = lambda: start_ingest(spark.readStream.schema(UPDATES).parquet(str(feed)), store, str(tmp_path / "ckpt")).awaitTermination()
    run()
    batch(spark, ("a", None)).coalesce(1).write.mode("append").parquet(str(feed))
    run()
    run()
    assert store.table("projects").first().latest_version == 2
    assert sorted((r.path, r.stop_version) for r in store.table("objects").collect()) == [("a", 2), ("b", None)]
    assert apply_to_store(store, batch(spark, ("c", b"1")), "updates", 1) is None
