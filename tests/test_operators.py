"""Relational operators against naive versions on random rows, and their plans."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import grouping, matching, windows


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("seed", range(4))
def test_contradictions_equal_the_pair_join(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), r.choice(["x", "y", "z", ""]), r.choice(["T", "I", "U", ""]), r.choice(["", "p", "q", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, d string, id string, kind string, register string")
    got = matching.contradictions(df, ["d"], "id", "kind", "register")
    clash = lambda a, b: not a[4] or not b[4] or a[4] == b[4]
    want = {a[0] for a in rows if a[2] and a[3] and any(b[1:3] == a[1:3] and b[3] and b[3] != a[3] and clash(a, b) for b in rows)}
    assert {x.i for x in got.collect()} == want
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


@pytest.mark.parametrize("seed", range(4))
def test_only_self_declares_equals_the_naive_search(spark, seed):
    r = random.Random(seed)
    declared = [(r.randrange(6), r.choice("abcdefgh")) for _ in range(14)]
    refs = [(i, r.randrange(6), r.choice("abcdefghij")) for i in range(40)]
    got = matching.only_self_declares(spark.createDataFrame(refs, "i int, owner int, id string"), spark.createDataFrame(declared, "owner int, id string"), "owner", ["id"])
    want = {i for i, o, x in refs if not any(y == x and p != o for p, y in declared)}
    assert {x.i for x in got.collect()} == want
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


@pytest.mark.parametrize("seed", range(3))
def test_listing_equals_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), r.choice("xyz"), r.randrange(1, 9)) for i in range(80)]
    kept, spent, stopped, want = {}, {}, set(), {}
    for i, rule, c, size in rows:
        if kept.get((rule, c), 0) >= 5:
            want[i] = "suppressed"
        elif rule in stopped or spent.get(rule, 0) + size > 50:
            stopped.add(rule)
            want[i] = "over_budget"
        else:
            kept[rule, c] = kept.get((rule, c), 0) + 1
            spent[rule] = spent.get(rule, 0) + size
            want[i] = "listed"
    got = windows.listing(spark.createDataFrame(rows, "seq int, rule string, container string, size int"), "rule", "container", "seq", "size", cap=5, budget=50)
    assert {x.seq: x.state for x in got.collect()} == want


def test_resolve_takes_the_exact_name_then_the_only_alike(spark):
    m = spark.createDataFrame([("c", "B.pdf", "B.pdf"), ("c", "./A.pdf", "A.pdf"), ("c", "X", "X"), ("c", "./X", "X"), ("c", "D/../Y", "Y")], "s string, name string, placed string")
    refs = spark.createDataFrame([("c", "B.pdf", "B.pdf"), ("c", "A.pdf", "A.pdf"), ("c", ".//X", "X"), ("c", "none", "none"), ("d", "B.pdf", "B.pdf")], "s string, name string, placed string")
    got = {(x.s, x.name): (x.member, x.candidates) for x in matching.resolve(refs, m, ["s"], "name", "placed").collect()}
    assert got == {("c", "B.pdf"): ("B.pdf", 1), ("c", "A.pdf"): ("./A.pdf", 1), ("c", ".//X"): (None, 2), ("c", "none"): (None, 0), ("d", "B.pdf"): (None, 0)}


def test_declared_state_has_three_values(spark):
    rows, declared = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, True), (2, False)], "k int, v boolean")
    assert {x.k: x.declared for x in matching.declared_state(rows, declared, {"k": "k"}, F.col("v")).collect()} == {1: True, 2: False, 3: None}


def test_folders_are_capped_by_appearance(spark):
    df = spark.createDataFrame([(0, "b/x/f"), (1, "a/f"), (2, "./b//y/f"), (3, "f")], "ord int, path string").withColumn("s", F.lit(1))
    (g,) = grouping.folders(df, ["s"], "path", "ord", most=3).collect()
    assert (g.n_folders, g.at_least, g.folders) == (3, True, ["a", "b", "b/x"])


def test_partners_are_spread(spark):
    g = spark.createDataFrame([(1, x) for x in "hgfedcba" * 2] + [(2, "a"), (3, "a"), (3, "b"), (3, None), (None, "a")], "k int, name string")
    got = {(x.k, x.name): x.partners for x in windows.partners(g, ["k"], "name", 3).collect()}
    assert got[1, "c"] == ["d", "f", "h"] and got[1, "h"] == ["a", "c", "e"]
    assert {k: v for k, v in got.items() if k[0] != 1} == {(3, "a"): ["b"], (3, "b"): ["a"]} and len(got) == 10


def test_few_of_a_hot_key_are_kept_before_the_shuffle(spark):
    rows = spark.range(5_000, numPartitions=4).select((F.col("id") % 1).cast("string").alias("rule"), (F.col("id") % 1).alias("container"), F.col("id").alias("seq"), F.lit(1).alias("size"))
    got = windows.listing(rows, "rule", "container", "seq", "size", cap=5)
    assert {x.state: x["count"] for x in got.groupBy("state").count().collect()} == {"listed": 5, "suppressed": 4_995}
    assert plan(got).count("WindowGroupLimit") >= 2


def test_null_keys_are_groups(spark):
    rows = spark.createDataFrame([(None, "x/a"), (None, "y/b"), ("s", "x/c")], "s string, path string").withColumn("seq", F.monotonically_increasing_id()).withColumn("size", F.lit(1))
    assert {x.s: (x.first_values, x.in_all) for x in grouping.first_few(rows, ["s"], "path", 1).collect()} == {None: (["x/a"], 2), "s": (["x/c"], 1)}
    assert {x.s: x.folders for x in grouping.folders(rows, ["s"], "path", "seq").collect()} == {None: ["x", "y"], "s": ["x"]}
    got = windows.listing(rows, "s", "s", "seq", "size", cap=1, budget=10)
    assert sorted((x.s or "", x.state) for x in got.collect()) == [("", "listed"), ("", "suppressed"), ("s", "listed")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "d string, id string, kind string, register string, owner string, seq int, size int")
    assert matching.contradictions(none, ["d"], "id", "kind", "register").isEmpty()
    assert matching.only_self_declares(none, none, "owner", ["id"]).isEmpty()
    assert windows.listing(none, "d", "id", "seq", "size").isEmpty()
    assert grouping.by_severity(none.withColumnRenamed("kind", "severity")).first().error == 0
