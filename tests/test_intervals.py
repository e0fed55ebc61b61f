import random

from arbordelta.operators.intervals import OPEN, merged_and_gaps, periods_and_gaps

SCHEMA = "project long, path string, start_version long, stop_version long, kind string"


def brute(rows):
    groups = {}
    for project, path, s, e, _ in rows:
        if s is not None and (e is None or e > s):
            groups.setdefault((project, path), set()).add((s, OPEN if e is None else e))
    out = []
    for (project, path), ivs in groups.items():
        runs = []
        for s, e in sorted(ivs):
            if runs and s <= runs[-1][1]:
                runs[-1][2] |= s < runs[-1][1]
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e, False])
        out += [(project, path, "period", s, e, d) for s, e, d in runs]
        out += [(project, path, "gap", a[1], b[0], False) for a, b in zip(runs, runs[1:])]
    return sorted(map(repr, out))


def test_against_brute_force_in_many_shards(spark):
    rng = random.Random(3)
    rows = []
    for project in range(120):
        for _ in range(rng.randint(1, 12)):
            s = rng.choice([None, *range(0, 60)]) if rng.random() < 0.3 else rng.randint(-10, 60)
            e = None if rng.random() < 0.12 else (s or 0) + rng.choice([-1, 0, 1, 2, 3, 4, 8, 30])
            row = (project, rng.choice(["a", "a/b", None]), s, e, "x")
            rows += [row] * rng.randint(1, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    for bits in (1, 2, 3, 12):
        got = sorted(repr(tuple(r)) for r in periods_and_gaps(df, ["project", "path"], bits=bits).collect())
        assert got == brute(rows), bits


def test_huge_versions_and_open_ends(spark):
    rows = [(1, "a", 0, None, ""), (2, "a", OPEN - 3, OPEN - 1, ""), (2, "a", OPEN - 2, None, ""), (3, "a", 5, 5, ""), (None, None, 1, 2, ""), (None, None, 3, 1 << 50, "")]
    got = sorted(repr(tuple(r)) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["project", "path"], bits=12).collect())
    assert got == brute(rows)


def test_touching_is_one_period_and_not_merged(spark):
    df = spark.createDataFrame([(1, "a", 1, 3, ""), (1, "a", 3, 5, ""), (1, "a", 7, None, ""), (1, "a", 7, None, "")], SCHEMA)
    assert [tuple(r) for r in merged_and_gaps(df, bits=1).collect()] == [(1, "a", "gap", 5, 7)]


def test_empty(spark):
    assert merged_and_gaps(spark.createDataFrame([], SCHEMA)).count() == 0
