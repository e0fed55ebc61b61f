"""The data-maintenance operators on dirty rows, against plain Python."""

import random

from arbordelta.operators import changes, orphans, skew
from arbordelta.schema import DIR_BIT, LINK_BIT

OBJECT = "project long, start_version long, stop_version long, path string, hash string, mode long, size long, packed boolean, loaded_at timestamp_ntz, run string, slots string"
REQUEST = "project long, batch_version long, seq long, attempt long, path string, mode long, size long, deleted boolean, content binary, received_at timestamp_ntz, _rank long"
PROJECT = "id long, latest_version long, loaded_at timestamp_ntz"


def when(day):
    import datetime

    return None if day is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def obj(project=1, start=1, stop=None, path="d/f", hash="h", mode=420, size=10, packed=False, day=0):
    return (project, start, stop, path, hash, mode, size, packed, when(day), "x", "y")


def dirty_objects():
    rows = [obj(path=f"d/{i}", size=i) for i in range(16)] + [obj(path=f"e/{i}") for i in range(15)]
    rows += [obj(path="e/0")] * 3 + [obj(path="e/x", stop=5), obj(path="e/y", packed=True), obj(path="e/z", mode=DIR_BIT), obj(path="e/l", mode=LINK_BIT)]
    rows += [obj(path="e/null", size=None), obj(path="e/neg", size=-1), obj(path="e/big", size=4096), obj(path=None), obj(project=None, path="n/1"), obj(path="e/p", packed=None)]
    rows += [obj(project=2, path=f"{i}", mode=None, size=4095) for i in range(20)] + [obj(project=3, path=f"b/{i}", size=300_000) for i in range(9)]
    rows += [obj(project=4, path="two", size=5, hash="old"), obj(project=4, path="two", start=2, size=7, hash="new"), obj(project=4, path="one", size=5)]
    return rows


def model_changes(requests, projects):
    last = {p[0]: p[1] for p in projects if p[0] is not None}
    best = {}
    for r in requests:
        if r[0] is not None and r[2] is not None:
            best[r[0], r[2]] = max(best.get((r[0], r[2]), -1), -1 if r[3] is None else r[3])
    live = {}
    for r in sorted((r for r in requests if r[0] in last and r[2] is not None), key=lambda r: r[2]):
        if (-1 if r[3] is None else r[3]) != best[r[0], r[2]] or r[1] is None or r[1] > last[r[0]] or r[4] is None:
            continue
        if r[7]:
            live.pop((r[0], r[4]), None)
        else:
            live[r[0], r[4]] = r[2]
    return sorted((p, path, seq) for (p, path), seq in live.items())


def dirty_requests(rng):
    rows = []
    for project in (1, 2, 3, None, 8):
        for seq in [None, *range(40)]:
            for attempt in rng.choice([[1], [1, 2], [2, 1, 3], [None, 1]]):
                row = (project, rng.choice([1, 2, 3, None]), seq, attempt, rng.choice(["a", "A", "a/", "b", None]), 420, 1, rng.choice([True, False, None]), rng.choice([b"x", None]), when(rng.randint(0, 9)), 1)
                rows += [row] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    return rows


def fed(spark, root, batches):
    store = changes.EqualityDeleteTable(spark, str(root))
    for name, rows in batches:
        store.append(name, spark.createDataFrame(rows, REQUEST))
    return store


def found(df):
    return sorted((r.project, r.path, r.seq) for r in df.collect())


def test_changes_against_model(spark, tmp_path):
    rows, projects = dirty_requests(random.Random(4)), [(1, 2, None), (2, 9, None), (3, None, None), (None, 3, None)]
    known = [(p, -1 if v is None else v) for p, v, _ in projects]
    parents = spark.createDataFrame(projects, PROJECT)
    assert found(fed(spark, tmp_path / "a", [("all", rows)]).read(parents)) == model_changes(rows, known)
    assert found(fed(spark, tmp_path / "b", [("none", [])]).read(parents)) == []
    assert found(fed(spark, tmp_path / "a", []).read(spark.createDataFrame([], PROJECT))) == []


def test_equality_delete_table_takes_batches_in_any_order(spark, tmp_path):
    rows, projects = dirty_requests(random.Random(6)), [(1, 2), (2, 9), (3, -1)]
    known = spark.createDataFrame([(p, v, None) for p, v in projects], PROJECT)
    third = len(rows) // 3
    parts = [(str(b), rows[b * third:(b + 1) * third + 5]) for b in (2, 0, 1)]
    store = fed(spark, tmp_path, parts[:2])
    store.compact()
    assert store.append(*parts[0][:1], spark.createDataFrame(parts[0][1], REQUEST)) is False
    store.append(parts[2][0], spark.createDataFrame(parts[2][1], REQUEST))
    want = model_changes(rows[:3 * third + 5], projects)
    assert found(store.read(known)) == want
    store.compact()
    assert found(store.read(known)) == want and len(store.commits.read(store.commits.newest())["folders"]) == 1


def test_ties_have_a_defined_winner(spark, tmp_path):
    base = (1, 1, 1, 1, "a", 420, 1, False)
    rows = [(*base, c, when(0), 1) for c in (b"1", None, b"2", b"2")] + [(1, 1, 1, 1, "a", 420, 1, True, None, when(1), 1)]
    known = spark.createDataFrame([(1, 1, None)], PROJECT)
    for k, order in enumerate((rows, rows[::-1])):
        [r] = fed(spark, tmp_path / str(k), [("x", order)]).read(known).collect()
        assert (r.path, r.seq, bytes(r.content)) == ("a", 1, b"2")


def test_change_feed_stream(spark, tmp_path):
    from arbordelta.streaming.ingest import start_change_feed

    rows, projects = dirty_requests(random.Random(7)), [(1, 2), (2, 9), (3, -1)]
    store = changes.EqualityDeleteTable(spark, str(tmp_path / "table"))
    schema = spark.createDataFrame([], REQUEST).schema
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        start_change_feed(spark.readStream.schema(schema).parquet(str(tmp_path / "feed")), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert found(store.read(spark.createDataFrame([(p, v, None) for p, v in projects], PROJECT))) == model_changes(rows, projects)


def test_totals_and_heavy_projects(spark):
    rows = [obj(project=1, size=1)] * 60 + [obj(project=p, size=0) for p in range(100, 140)] + [obj(project=2, size=500), obj(project=None, size=None), obj(project=3, size=-5, stop=2)]
    df = spark.createDataFrame(rows, OBJECT)
    totals = {r.project: tuple(r)[1:] for r in skew.project_totals(df).collect()}
    assert totals[1] == (60, 60, 60) and totals[None] == (1, 1, 0) and totals[3] == (1, 0, 0)
    assert sorted(r.project for r in skew.heavy_projects(df).collect()) == [1, 2]
    assert skew.heavy_projects(spark.createDataFrame([], OBJECT)).count() == 0


def test_orphans(spark):
    rows = [obj(hash=" AB "), obj(hash="ab", day=-5), obj(hash="cd", path="m"), obj(hash="0" * 64), obj(hash=None), obj(project=2, hash="ab"), obj(project=3, hash="ab"),
            obj(project=None, hash="ab"), obj(hash="late", day=None), obj(hash="cd", path="m")]
    contents = spark.createDataFrame([("ab", b"", when(-1)), ("late", b"", when(3)), (None, b"", when(3)), ("nulltime", b"", None)], "hash string, bytes binary, loaded_at timestamp_ntz")
    projects = spark.createDataFrame([(1, 1, when(-9)), (3, 1, when(1)), (None, 1, None)], PROJECT)
    broken = orphans.orphan_rows(spark.createDataFrame(rows, OBJECT), contents, projects)
    assert sorted(tuple(r) for r in broken.collect()) == [
        ("contents", "late", "2023-12", 1, 1, "d/f"), ("contents", "missing", "2024-01", 1, 1, "m"),
        ("projects", "late", "2024-01", 3, 1, "d/f"), ("projects", "missing", "2024-01", 2, 1, "d/f")]
    assert {(r.ref_table, r.state, r.period): r.n for r in orphans.orphan_counts(broken).collect()}[("contents", "missing", "2024-01")] == 1
    assert orphans.orphan_rows(spark.createDataFrame([], OBJECT), contents, projects).count() == 0
    assert orphans.orphan_rows(spark.createDataFrame(rows, OBJECT), contents.limit(0), projects.limit(0)).count() > 4
