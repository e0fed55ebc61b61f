import numpy as np
import pytest
from pyspark.sql import functions as F

from arbordelta.llm import queries
from arbordelta.llm.packing import configurations, divided, pack_items, pack_lengths, utilisation
from arbordelta.schema import DIR_BIT, LINK_BIT

SCHEMA = "tar_id long, content binary, piece long, container string"


def check(lengths, capacity):
    got = pack_lengths(np.array(lengths, np.int64), capacity)
    assert len(got) == len(lengths) and (got >= 0).all()
    full = np.bincount(got, weights=lengths, minlength=1)
    assert full.max(initial=0) <= capacity
    return len(np.unique(got))


@pytest.mark.parametrize("seed", range(4))
def test_never_above_capacity_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    for capacity, lengths in ((16384, rng.integers(0, 16385, 3000)), (524288, (rng.pareto(1, 3000) * 2000).astype(int).clip(0, 524288)), (100, rng.integers(1, 101, 500))):
        assert check(lengths, capacity) <= 1.06 * lengths.sum() / capacity + 3


def test_edge_lengths():
    assert check([], 10) == 0
    assert check([0, 0, 0], 10) == 1
    assert check([10] * 7, 10) == 7
    assert check([5, 5, 5, 5], 10) == 2
    assert check([524287, 524288, 1], 524288) == 2
    assert check([1], 1) == 1


def test_configurations_beat_best_fit_where_pairs_matter():
    rng = np.random.default_rng(1)
    lengths = rng.integers(5000, 9000, 5000)
    decreasing, rooms = sorted(lengths.tolist(), reverse=True), []
    for n in decreasing:
        fit = min((r for r in rooms if r >= n), default=None)
        rooms.remove(fit) if fit is not None else None
        rooms.append((16384 if fit is None else fit) - n)
    assert check(lengths, 16384) < len(rooms)


def test_configurations_keep_to_the_demand():
    sizes, demand = np.array([60, 50, 40, 30]), np.array([7, 9, 11, 13])
    chosen = configurations(sizes, demand, 100)
    assert (sum(c * t for c, t in chosen) <= demand).all()
    assert all((c * sizes).sum() <= 100 for c, _ in chosen)


def test_each_object_once_and_only_the_oversize_divided(spark):
    rows = [(i, bytes(i % 50), 1, "x") for i in range(400)] + [(1000, bytes(250), 1, "x"), (1001, bytes(200), 1, "x"), (1002, bytes(100), 1, "x"), (1003, bytes(101), 1, "x")]
    rows += [(5, bytes(5), 1, "x")] * 3 + [(7, None, 1, "x"), (2000, None, 1, "x"), (None, bytes(10), 1, "x")]
    placed = pack_items(spark.createDataFrame(rows, SCHEMA).select("tar_id", "content"), ["tar_id"], F.octet_length("content"), 100, shard_items=90).persist()
    pieces = {}
    for r in placed.collect():
        pieces.setdefault(r.tar_id, []).append((r.piece, r.offset, r.length, r.container))
    assert set(pieces) == {r[0] for r in rows}
    for tar_id, got in pieces.items():
        got.sort()
        n = max(len(r[1] or b"") for r in rows if r[0] == tar_id)
        assert sum(g[2] for g in got) == n and [g[1] for g in got] == [100 * k for k in range(len(got))]
        assert len(got) == max(1, -(-n // 100))
    assert sorted(r.tar_id for r in divided(placed, ["tar_id"]).collect()) == [1000, 1001, 1003]
    row = utilisation(placed, 100).first()
    assert row.fullest <= 100 and row.unused == row.containers * 100 - row.n_bytes
    empty = pack_items(spark.createDataFrame([], SCHEMA).select("tar_id", "content"), ["tar_id"], F.octet_length("content"), 100)
    assert empty.count() == 0 and utilisation(empty, 100).first().containers == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, bytes(150), 9, "x")], SCHEMA)
    assert sorted((r.piece, r.length) for r in pack_items(df, ["tar_id"], F.octet_length("content"), 100).collect()) == [(0, 100), (1, 50)]


def test_every_live_object_has_a_place(spark, tmp_path):
    schema = "project long, start_version long, stop_version long, path string, hash string, mode long, size long, packed boolean, loaded_at timestamp_ntz"

    def obj(path, size, mode=420, packed=False, project=1, start=1, stop=None, hash="h"):
        return project, start, stop, path, hash, mode, size, packed, None

    rows = [
        obj("f", 10), obj("f", 10), obj("pack/", 1_200_000, 0, True), obj("d/", 0, DIR_BIT), obj("link", 7, LINK_BIT), obj("unknown", 11, packed=None), obj("no mode", 12, None),
        obj(None, 13), obj("n", 14, project=None), obj("null", None), obj("neg", -1), obj("two", 5, hash="z"), obj("two", 3, start=2),
        obj("closed", 9, stop=5), obj("closed/", 9, 0, True, stop=5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/objects.parquet")
    pieces = {}
    for r in queries.p2_object_placements(spark, str(tmp_path)).collect():
        pieces.setdefault((r.project, r.path), []).append(r.length)
    assert {k: sorted(v) for k, v in pieces.items()} == {
        (1, "f"): [10], (1, "pack/"): [151_424, 524_288, 524_288], (1, "d/"): [0], (1, "link"): [7], (1, "unknown"): [11], (1, "no mode"): [12],
        (1, None): [13], (None, "n"): [14], (1, "null"): [0], (1, "neg"): [0], (1, "two"): [3]}
