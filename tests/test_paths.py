import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbordelta.functions import paths
from arbordelta.schema import DIR_BIT, LINK_BIT


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first()
    return row["out"]


@pytest.mark.parametrize("path,want", [("a", []), ("a/b", ["a/"]), ("a/b/", ["a/", "a/b/"]), ("/a", ["/"]), ("a//b", ["a/", "a//"]), ("", [])])
def test_slash_prefixes(spark, path, want):
    assert one(spark, paths.slash_prefixes(F.col("p")), p=path) == want


def test_covering_keys(spark):
    assert sorted(one(spark, paths.covering_keys(F.col("p")), p="a/b/c")) == ["a", "a/", "a/b", "a/b/", "a/b/c"]
    assert sorted(one(spark, paths.retired_keys(F.col("p")), p="a/b/c")) == ["a/", "a/b/", "a/b/c"]


@pytest.mark.parametrize("path,patterns,want", [
    ("node_modules/lodash/index.js", ["node_modules/.*/"], "node_modules/lodash/"),
    ("node_modules/file", ["node_modules/.*/"], "node_modules/file/"),
    ("x/pack1/a/b", ["^pack1/.*/"], None), ("pack1/a/b", ["^pack1/.*/"], "pack1/a/"),
    ("b/x", ["[b|e]/"], "b/"), ("sub/a", ["[b|e]/"], "sub/"), ("a|/x", ["[b|e]/"], "a|/"), ("a", [], None)])
def test_pack_parent(spark, path, patterns, want):
    df = spark.createDataFrame([(path, patterns), (path, None)], "p string, pats array<string>")
    assert [r[0] for r in df.select(paths.pack_parent(F.col("p"), F.col("pats"))).collect()] == [want, None]


@pytest.mark.parametrize("path,want", [("frontend/src/app.ts", True), ("frontend/vite.config.js", False), ("frontend/vite.config.ts", False), ("backend/app.ts", False)])
def test_include_and_exclude(spark, path, want):
    assert one(spark, paths.glob_match(F.col("p"), "frontend/**", "frontend/vite.config.[jt]s"), p=path) is want


@pytest.mark.parametrize("glob,yes,no", [
    ("*.ts", ["a.ts", "a/b.ts"], ["a.tsx"]), ("a?c", ["abc", "a/c"], ["ac"]), ("{a,b}/*", ["a/x", "b/"], ["c/x"]), ("[!a]x", ["bx"], ["ax"]),
    ("a\\*", ["a*"], ["ab"]), ("a.b", ["a.b"], ["axb"]), ("x[", ["x["], ["x"])])
def test_globs(glob, yes, no):
    pattern = re.compile(paths.glob_pattern(glob))
    assert all(pattern.match(p) for p in yes) and not any(pattern.match(p) for p in no)


def test_kinds(spark):
    rows = [(DIR_BIT | 493, False), (LINK_BIT | 511, False), (420, False), (0, True)]
    df = spark.createDataFrame(rows, "m long, packed boolean").select(paths.kind(F.col("m"), F.col("packed")), paths.permissions(F.col("m")))
    assert [tuple(r) for r in df.collect()] == [("directory", 493), ("symlink", 511), ("file", 420), ("pack", 0)]


path = st.lists(st.sampled_from(["a", "b", "ab"]), min_size=1, max_size=3).map("/".join).flatmap(lambda p: st.sampled_from([p, p + "/"]))


@settings(max_examples=12, deadline=None)
@given(st.lists(path, max_size=6), st.lists(path, max_size=6))
def test_equality_stands_for_the_prefix_rules(spark, removed, updated):
    from arbordelta.operators.temporal import needless

    literal = sorted(r for r in removed if any(u == r or (r.endswith("/") and u.startswith(r)) or (not r.endswith("/") and u.startswith(r + "/")) for u in updated))
    frame = lambda ps: spark.createDataFrame([(1, p) for p in ps], "project long, path string")
    assert sorted(r.path for r in needless(frame(removed), frame(updated), "left_semi").collect()) == literal
