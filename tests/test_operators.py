"""Micro fixtures with values worked out by hand."""

import itertools
import random
from pathlib import Path

import pytest

from sketchloom.functions import u64
from sketchloom.operators import compare, dereplication, pairs, sketches
from pyspark.sql import functions as F

A, B, C, D = {1, 2, 3}, {2, 3, 4, 5}, {9}, set()


def nested(spark, *sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, mins array<bigint>")


@pytest.fixture()
def basic(spark):
    df = nested(spark, A, B, C, D)
    return sketches.members(df), sketches.sizes(df)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pairs(basic):
    members, sizes = basic
    found = rows(pairs.similarities(pairs.intersections(members), sizes), "i", "j", "intersection", "jaccard", "c_ij", "c_ji")
    assert found == [(0, 1, 2, 2 / 5, 2 / 3, 1 / 2), (1, 0, 2, 2 / 5, 1 / 2, 2 / 3)]


def test_index_and_empty(basic):
    members, sizes = basic
    assert rows(sketches.hash_index(members), "hash", "ids") == [(2, [0, 1]), (3, [0, 1])]
    assert rows(sketches.empty_sketches(sizes), "id") == [(3,)]
    assert rows(sketches.index_stats(members), "n_hashes", "n_postings", "max_df") == [(2, 4, 2)]


def test_matrix(basic):
    members, sizes = basic
    cells = {(i, j): v for i, j, v in rows(pairs.jaccard_matrix(pairs.intersections(members), sizes), "i", "j", "value")}
    assert cells == {(i, j): 1.0 if i == j else 0.4 if {i, j} == {0, 1} else 0.0 for i in range(4) for j in range(4)}
    assert dict(((i, j), v) for i, j, v in rows(pairs.intersection_matrix(pairs.intersections(members), sizes), "i", "j", "value")) == {(0, 0): 3, (1, 1): 4, (2, 2): 1, (0, 1): 2, (1, 0): 2}


def test_presence(basic):
    cols = sketches.presence_rows(sketches.presence_matrix(basic[0]))
    assert rows(cols, "id", "cols") == [(0, [0, 1, 2]), (1, [1, 2, 3, 4]), (2, [5])]


def edges(members, sizes, t):
    return pairs.at_threshold(pairs.similarities(pairs.intersections(members), sizes), t).select(F.col("i").alias("src"), F.col("j").alias("dst"))


def test_dereplication(basic):
    assert rows(dereplication.dereplicate(basic[1], edges(*basic, 0.01)), "id") == [(1,), (2,), (3,)]
    assert rows(dereplication.dereplicate(basic[1], edges(*basic, 0.6)), "id") == [(1,), (2,), (3,)]


def test_ties_keep_the_last(spark):
    df = nested(spark, A, A, A)
    members, sizes = sketches.members(df), sketches.sizes(df)
    assert rows(dereplication.dereplicate(sizes, edges(members, sizes, 0.5)), "id") == [(2,)]


def greedy(sizes, out):
    gone = set()
    for i in sorted(sizes, key=lambda i: (sizes[i], i)):
        if any(o not in gone and sizes[o] >= sizes[i] for o in out.get(i, ())):
            gone.add(i)
    return sorted(set(sizes) - gone)


@pytest.mark.parametrize("seed", range(3))
def test_dereplication_of_any_edges(spark, seed):
    rnd = random.Random(seed)
    sizes = {i: rnd.randint(1, 3) for i in range(12)}
    out = {i: {j for j in sizes if rnd.random() < 0.15} for i in sizes}
    links = spark.createDataFrame([(i, j) for i in out for j in out[i]], "src int, dst int")
    found = dereplication.dereplicate(spark.createDataFrame(list(sizes.items()), "id int, size int"), links, symmetric_ties=False)
    assert [i for (i,) in rows(found, "id")] == greedy(sizes, out)


def test_threshold_edge(spark):
    df = nested(spark, set(range(10)), {0, 100}, {0})
    members, sizes = sketches.members(df), sketches.sizes(df)
    similar = pairs.similarities(pairs.intersections(members), sizes)
    kept = lambda t: {(i, j) for i, j in rows(pairs.at_threshold(similar, t), "i", "j")}
    assert (0, 1) not in kept(0.1) and (0, 1) in kept(0.01)  # one in ten, dropped at 0.1 in single precision
    assert (1, 2) in kept(0.5)


def test_random_sets(spark):
    rnd = random.Random(5)
    sets = [{rnd.randint(0, 40) for _ in range(rnd.randint(0, 15))} for _ in range(25)]
    df = nested(spark, *sets)
    found = {(i, j): n for i, j, n in rows(pairs.intersections(sketches.members(df)), "i", "j", "intersection")}
    assert found == {(i, j): len(sets[i] & sets[j]) for i, j in itertools.permutations(range(25), 2) if sets[i] & sets[j]}


def test_sizes_ride_along(spark):
    df = nested(spark, A, B, C, D)
    expected = pairs.similarities(pairs.intersections(sketches.members(df)), sketches.sizes(df))
    columns = ("i", "j", "intersection", "jaccard", "c_ij", "c_ji")
    assert rows(pairs.similar(sketches.sized_members(df)), *columns) == rows(expected, *columns)
    assert rows(pairs.similar(sketches.sized_members(df), 0.6), "i", "j") == [(0, 1)]


def test_bags(spark):
    bag = spark.createDataFrame([(0, 5), (0, 5), (1, 5)], "id int, hash bigint")
    assert rows(pairs.minimum_multiplicity(bag), "intersection") == [(1,)]
    assert rows(pairs.intersections(bag, mirrored=False), "intersection") == [(2,)]


def test_unsigned(spark):
    df = spark.createDataFrame([("1",), ("18446744073709551615",), ("9223372036854775808",), ("18446744073709551616",), ("x",)], "t string")
    out = df.select("t", u64.to_bits(F.col("t")).alias("b")).withColumn("back", u64.to_text(F.col("b")))
    bits = {t: b for t, b, _ in out.collect()}
    assert bits == {"1": 1, "18446744073709551615": -1, "9223372036854775808": -(2**63), "18446744073709551616": None, "x": None}
    assert all(b is None or t == back for t, b, back in out.collect())
    assert [t for t, *_ in out.where("b is not null").orderBy(u64.order_key(F.col("b"))).collect()] == ["1", "9223372036854775808", "18446744073709551615"]


def test_compare(spark):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "key string")
    assert rows(compare.set_difference(one("a", "b", "c"), one("b", "c", "d")), "key", "side") == [("a", "left"), ("d", "right")]
    assert rows(compare.set_summary(one("a", "b", "c"), one("b", "c", "d")), "left_only", "right_only", "common", "jaccard") == [(1, 1, 2, 0.5)]
    assert compare.set_summary(one(), one()).first().jaccard is None
    shape = "i int, j int, jaccard double, c_ij double"
    ours = spark.createDataFrame([(0, 1, 0.5, 0.5), (0, 2, 0.5, 0.5), (1, 1, 1.0, 1.0), (2, 0, 0.5, 0.5)], shape)
    theirs = spark.createDataFrame([(0, 1, 0.50001, 0.5), (2, 0, 0.6, 0.5), (3, 0, 0.1, 0.1)], shape)
    assert rows(compare.compare_pairs(ours, theirs), "i", "j", "status") == [(0, 1, "equal"), (0, 2, "extra"), (2, 0, "different"), (3, 0, "missing")]
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "id int, name string")
    results = spark.createDataFrame([("a", "b", 0.5, 0.5)], "query_name string, match_name string, jaccard double, containment double")
    assert rows(compare.compare_search_results(ours.where("i = 0"), names, results), "i", "j", "status") == [(0, 1, "extra"), (0, 2, "equal")]


def test_count_check_and_recomputed(basic):
    members, sizes = basic
    similar = pairs.similarities(pairs.intersections(members), sizes)
    expected = similar.select("i", "jaccard").union(sizes.where("size > 0").selectExpr("id", "1.0D"))
    ok = rows(compare.count_check(sizes.selectExpr("id as i"), similar, expected), "i", "n_ours", "n_expected", "ok")
    assert ok == [(0, 2, 2, True), (1, 2, 2, True), (2, 1, 1, True), (3, 1, 0, False)]
    given = similar.select("i", "j", (F.col("jaccard") + F.col("i") * 0.1).alias("jaccard"))
    assert rows(compare.recomputed(given, members, sizes), "i", "ok") == [(0, True), (1, False)]


def test_space_usage(spark):
    df = spark.range(1024).selectExpr("cast(id as int) id", "array(id, 7L) as mins")
    row = sketches.space_usage(df, sketches.members(df), df.selectExpr("repeat('x', 2048) as name")).first()
    assert (row.matrix_mb, row.index_mb, row.sketches_mb, row.names_mb) == (4, 0, 0, 2)


def test_pairs_of_many_blocks(spark, monkeypatch):
    from sketchloom.operators import grid_join

    monkeypatch.setattr(grid_join, "LEAST_ROWS", 64)
    monkeypatch.setattr(grid_join, "CELLS", 50)
    rnd = random.Random(7)
    sets = [{rnd.randint(-40, 40) << 50 for _ in range(rnd.randint(0, 30))} for _ in range(60)]
    sized = sketches.sized_members(nested(spark, *sets))
    found = pairs.similar(sized)
    common = {(i, j): len(sets[i] & sets[j]) for i, j in itertools.permutations(range(60), 2) if sets[i] & sets[j]}
    assert {(r.i, r.j): (r.intersection, r.jaccard, r.c_ij) for r in found.collect()} == {(i, j): (n, n / len(sets[i] | sets[j]), n / len(sets[i])) for (i, j), n in common.items()}
    assert {(r.i, r.j) for r in pairs.similar(sized, 0.5).collect()} == {(i, j) for (i, j), n in common.items() if n / len(sets[i]) >= 0.5}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Aggregate" not in plan  # neither joined rows nor pairs are shuffled


def test_bags_of_many_blocks(spark, monkeypatch):
    from collections import Counter

    from sketchloom.operators import grid_join

    monkeypatch.setattr(grid_join, "LEAST_ROWS", 16)
    rnd = random.Random(8)
    bags = [[rnd.randint(0, 9) for _ in range(rnd.randint(1, 20))] for _ in range(20)]
    df = spark.createDataFrame([(i, h) for i, bag in enumerate(bags) for h in bag] + [(3, None), (4, None)], "id int, hash bigint")
    counted = [Counter(x) for x in bags]
    expected = {(i, j): n for i, j in itertools.combinations(range(20), 2) if (n := sum((counted[i] & counted[j]).values()))}
    assert {(r.i, r.j): r.intersection for r in pairs.minimum_multiplicity(df).collect()} == expected


def test_known_sizes_of_edges(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 4), (2, 4)], "id int, size int")
    links = spark.createDataFrame([(0, 1, 3, 4), (1, 0, 4, 3), (1, 2, 4, 4), (2, 1, 4, 4)], "src int, dst int, src_size int, dst_size int")
    found = dereplication.dereplicate(sizes, links)
    assert rows(found, "id") == [(2,)]
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1


def test_ngrams_in_slices(spark, monkeypatch):
    import pyarrow as pa

    from sketchloom.functions import ngrams

    words = [["a", "b", "c", "d"], None, [], ["x", "y"], ["a", "b", "c"] * 5]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(5)), "words": pa.array(words, pa.list_(pa.string()))})
    whole = [r for b in ngrams._sets(3)([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(ngrams, "SLICE_WORDS", 5)
    parts = list(ngrams._sets(3)([batch]))
    assert len(parts) > 1 and [r for b in parts for r in b.to_pylist()] == whole


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matrix_rows_shuffle_pairs_once(basic):
    plan = _plan(pairs.jaccard_rows(pairs.intersections(basic[0]), basic[1]))
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_passes_shuffle_no_pairs(spark):
    from sketchloom.operators import grid_join, passes

    sized = sketches.sized_members(nested(spark, A, B, C, D))
    found = passes.one_pass(sized, 0, 0, 0.6, grid_join.blocks_of(sized))
    assert rows(found, "i", "j", "intersection") == [(0, 1, 2)]
    assert "Exchange" not in _plan(found) and "Aggregate" not in _plan(found)


def test_compressed_text_is_read_back(spark, tmp_path):
    from sketchloom.sources import readers, sinks

    df = spark.createDataFrame([(0, 1, 0.25, 0.5, 0.3), (2, 1, 0.1, 1.0, 0.2)], readers.PAIRS)
    sinks.write_pairs(df, f"{tmp_path}/pairs", compression="gzip")
    sinks.write_plain_pairs(df, f"{tmp_path}/plain", compression="gzip")
    assert list(tmp_path.glob("pairs/*.csv.gz")) and list(tmp_path.glob("plain/*.csv.gz"))
    assert rows(readers.read_pairs(spark, f"{tmp_path}/pairs"), "i", "j", "c_ji") == [(0, 1, 0.3), (2, 1, 0.2)]
    assert rows(readers.read_plain_pairs(spark, f"{tmp_path}/plain"), "i", "j", "jaccard") == [(0, 1, 0.25), (2, 1, 0.1)]


def test_nested_sketches_are_packed_as_they_are(spark, monkeypatch):
    from sketchloom.operators import grid_join
    from sketchloom.sources import staging

    monkeypatch.setattr(grid_join, "LEAST_ROWS", 64)
    rnd = random.Random(9)
    sets = [{rnd.randint(-40, 40) << 50 for _ in range(rnd.randint(0, 30))} for _ in range(50)]
    df = spark.createDataFrame([(i, [*s, *list(s)[:2], None]) for i, s in enumerate(sets)] + [(None, [1, 2]), (50, None), (51, [])], "id int, mins array<bigint>")
    common = {(i, j): len(sets[i] & sets[j]) for i, j in itertools.permutations(range(50), 2) if sets[i] & sets[j]}
    begun = len(staging._made)
    found = pairs.intersections(df)
    assert {(r.i, r.j): r.intersection for r in found.collect()} == common
    left = [x for x in staging._made[begun:] if staging.exists(spark, x)]
    assert [x.rpartition("/")[2].rpartition("-")[0][:11] for x in left] == ["grid-blocks"]  # what was packed is gone
    assert "Exchange" not in _plan(found)
    assert rows(pairs.similar(df, 0.5), "i", "j") == rows(pairs.similar(sketches.sized_members(df), 0.5), "i", "j")


def test_recomputed_pairs_meet_no_members(spark, monkeypatch):
    from sketchloom.operators import grid_join

    monkeypatch.setattr(grid_join, "LEAST_ROWS", 64)
    monkeypatch.setattr(grid_join, "CELLS", 40)
    rnd = random.Random(10)
    sets = [{rnd.randint(-40, 40) << 50 for _ in range(rnd.randint(0, 30))} for _ in range(40)] + [set(), set()]
    df = nested(spark, *sets)
    given = [(i, j, rnd.random()) for i in range(42) for j in range(42) if i != j] + [(0, 1, 0.5), (0, 1, None), (0, 99, 0.5), (None, 1, 0.5)]
    right = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 0.0
    key = lambda r: tuple(map(repr, r))
    expected = sorted(((i, j, x, right(i, j), None if x is None else abs(x - right(i, j)) <= 1e-3) for i, j, x in given if i is not None and j < 42), key=key)
    for found in (compare.recomputed(spark.createDataFrame(given, "i int, j int, jaccard double"), sketches.members(df), sketches.sizes(df)), compare.recomputed(spark.createDataFrame(given, "i long, j long, jaccard double"), df, in_place=True)):
        assert sorted((tuple(r) for r in found.collect()), key=key) == expected
    assert "Exchange" not in _plan(found) and "Join" not in _plan(found)


def _writes(monkeypatch):
    """The plans of the tables that are written while blocks are made."""
    from sketchloom.operators import grid_join

    plans, write = {}, grid_join.written
    monkeypatch.setattr(grid_join, "written", lambda df, name: plans.__setitem__(name, _plan(df)) or write(df, name))
    return plans


def test_bags_are_shuffled_once(spark, monkeypatch):
    from sketchloom.operators import grid_join

    plans = _writes(monkeypatch)
    monkeypatch.setattr(grid_join, "BLOCK_ROWS", 8)  # repeats are added up many times on the way
    bag = spark.createDataFrame([(i, h) for i, h, n in ((0, 5, 90), (1, 5, 70), (1, 6, 1), (2, 6, 40), (2, None, 3), (None, 5, 2)) for _ in range(n)], "id int, hash bigint")
    assert rows(pairs.minimum_multiplicity(bag), "i", "j", "intersection") == [(0, 1, 70), (1, 2, 1)]
    assert list(plans) == ["grid-blocks"] and plans["grid-blocks"].count("Exchange") == 1 and "Aggregate" not in plans["grid-blocks"]


def test_lists_of_the_same_pairs_lie_side_by_side(spark):
    rnd = random.Random(21)
    sets = [set(rnd.sample(range(60), rnd.randint(0, 30))) for _ in range(25)]
    members, sizes = (f(nested(spark, *sets)) for f in (sketches.members, sketches.sizes))
    found = pairs.similarities(pairs.intersections(members), sizes).localCheckpoint()
    changed = F.when(F.col("i") % 2 == 0, F.col("jaccard") + 0.001).otherwise(F.col("jaccard"))
    ours, expected = (F.col("c_ij") >= t for t in (0.2, 0.4))
    for a, b in ((ours, expected), (expected, ours)):
        made = compare.compare_made(found, a, b, {"jaccard": changed})
        assert rows(made, "i", "j", "status") == rows(compare.compare_pairs(found.where(a), found.where(b).withColumn("jaccard", changed)), "i", "j", "status")
        assert {r.status for r in made.collect()} == {"equal", "different", "extra" if a is ours else "missing"}
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    own = sizes.where("size > 0").selectExpr("id i", "1.0D jaccard")
    queries = sizes.selectExpr("id i", "size")
    for least in (0.1, 0.3):
        joined = compare.count_check(queries, found.where(ours), found.select("i", "jaccard").union(own), least)
        assert rows(compare.count_check_made(queries, found, ours, F.col("size") > 0, least), *joined.columns) == rows(joined, *joined.columns)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_checks_count_pairs_once(spark):
    from sketchloom.plans import queries

    for query in (queries.validate_pairs, queries.count_check):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("CartesianProduct") == 1 and "FullOuter" not in plan
