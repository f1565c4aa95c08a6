"""Operators for large collections against their SQL, plain loops and their own plans."""

import gzip
import json
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sketchloom.functions import kmers
from sketchloom.operators import bitmaps, blocked_join, pairs, passes, threshold_join
from sketchloom.plans import scale
from sketchloom.sources import index_store, readers, sinks, splits

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(scale.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = scale.QUERIES[name](spark, str(DATA))
    expected = con.execute(scale.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=key) == sorted(expected.fetchall(), key=key)


def sketches(seed, n=40, universe=60):
    """Random sets with copies, one hash that all of them have, and an empty one."""
    rnd = random.Random(seed)
    sets = {i: {0, *(min(int(rnd.paretovariate(0.7)), universe) - universe // 2 for _ in range(rnd.randint(1, 30)))} for i in range(n)}
    sets |= {n + i: set(sets[rnd.randrange(n)]) for i in range(6)}
    return sets | {n + 6: set()}


def sized(spark, sets):
    return spark.createDataFrame([(i, len(s), h) for i, s in sets.items() for h in s], "id long, size int, hash long")


def shares(sets):
    return {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i != j and sets[i] & sets[j]}


@pytest.mark.parametrize("threshold", [0.1, 0.2, 0.5, 0.7, 0.95, 1.0])
def test_prefix_join(spark, threshold):
    sets = sketches(int(threshold * 100))
    t = float(np.float32(threshold))
    expected = {(i, j): (n, n / len(sets[i]), n / len(sets[j])) for (i, j), n in shares(sets).items() if n / len(sets[i]) >= t}
    found = threshold_join.contained(sized(spark, sets), threshold).collect()
    assert {(r.i, r.j): (r.intersection, r.c_ij, r.c_ji) for r in found} == expected and len(found) == len(expected)


def test_prefix_join_in_parts_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(threshold_join, "BATCH_HASHES", 20)
    sets = sketches(4)
    found = threshold_join.contained(sized(spark, sets), 0.5).count()
    assert found == sum(n / len(sets[i]) >= 0.5 for (i, _), n in shares(sets).items())
    assert threshold_join.contained(sized(spark, {}), 0.5).count() == 0


def test_copies_go_through_the_prefix_join_once(spark):
    sets = {i: set(range(50)) for i in range(60)} | {60: set(range(40)), 61: set(range(100, 120))}
    table = sized(spark, sets)
    row = threshold_join.join_rows(table, 0.7).first()
    assert row.all_rows > 50 * 60 * 59 and row.prefix_rows <= 50 and row.candidates == 2
    found = threshold_join.contained(table, 0.7).collect()
    assert {(r.i, r.j): r.intersection for r in found} == {k: n for k, n in shares(sets).items() if n / len(sets[k[0]]) >= float(np.float32(0.7))} and len(found) == 60 * 59 + 120
    assert threshold_join.contained(table, 1.5).count() == 0


def test_least_common(spark):
    rows = [(n, t) for t in (0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0) for n in (1, 2, 3, 7, 10, 20, 100, 999)]
    for t in sorted({t for _, t in rows}):
        sizes = spark.createDataFrame([(n,) for n, u in rows if u == t], "size int")
        for r in sizes.select("size", threshold_join.least_common(sizes["size"], t).alias("need")).collect():
            fits = [x for x in range(1, r.size + 1) if x / r.size >= float(np.float32(t))]
            assert r.need == (fits[0] if fits else r.size + 1)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_prefixes_read_a_tenth(spark):
    row = scale.prefix_join_rows(spark, "/root/testdata/sf0.01").first()
    assert row.prefix_rows * 10 <= row.all_rows


@pytest.mark.parametrize("hot,span,cells", [(4, 4, 1 << 23), (8, 2, 0), (0, 1, 1 << 23), (10**6, 4, 1 << 23)])
def test_hot_hashes_by_blocks(spark, monkeypatch, hot, span, cells):
    monkeypatch.setattr(blocked_join, "DENSE_CELLS", cells)
    sets = sketches(7)
    members = sized(spark, sets).select("id", "hash")
    found = blocked_join.blocked_intersections(members, hot, span).collect()
    assert {(r.i, r.j): r.intersection for r in found} == {k: n for k, n in shares(sets).items() if k[0] < k[1]}
    assert len(found) == len({(r.i, r.j) for r in found})


def test_block_tasks_hold_two_parts(spark):
    members = spark.createDataFrame([(i, h) for i in range(3000) for h in (1, 2)], "id long, hash long")
    hot = blocked_join.hot_hashes(members, 100, 64)
    lists = blocked_join.block_lists(members, hot, 8)
    sizes = lists.selectExpr("bits", "lo", "hi", "bundle", "hash", "size(ids) n").groupBy("bits", "lo", "hi", "bundle", "hash").sum("n").collect()
    assert max(r["sum(n)"] for r in sizes) <= 2 * 64 * 2  # two parts of some 64 ids
    assert {r.bits for r in hot.collect()} == {6}


def test_pairs_of_hot_hashes_are_not_shuffled(spark):
    sets = sketches(11)
    found = blocked_join.blocked_intersections(sized(spark, sets).select("id", "hash"), 4, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "Join" not in plan
    assert {(r.i, r.j): r.intersection for r in found.collect()} == {k: n for k, n in shares(sets).items() if k[0] < k[1]}


@given(st.one_of(st.sets(st.integers(0, 65535), min_size=1, max_size=300), st.tuples(st.integers(0, 60000), st.integers(1, 5000)).map(lambda p: set(range(p[0], p[0] + p[1])))))
def test_containers_are_small_and_come_back(places):
    values = np.array(sorted(places))
    kind, data = bitmaps.encoded(values)
    words = bitmaps.decoded(kind, data)
    assert np.bitwise_count(words).sum() == len(values)
    assert np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).tolist() == values.tolist()
    assert len(data) <= min(2 * len(values), 8192)


def test_kinds_of_containers():
    rnd = np.random.default_rng(1)
    assert bitmaps.encoded(np.arange(65536))[0] == "runs" and bitmaps.encoded(np.array([0, 65535]))[0] == "array"
    assert bitmaps.encoded(np.sort(rnd.choice(65536, 30000, replace=False)))[0] == "bits"
    for values in (np.arange(65536), np.sort(rnd.choice(65536, 30000, replace=False)), np.array([0, 65535])):
        assert np.array_equal(bitmaps.decoded(*bitmaps.encoded(values)), bitmaps.bits_of(values))


@pytest.mark.parametrize("rows", [1, 5, 1000])
def test_block_product(spark, rows):
    rnd = random.Random(rows)
    sets = {i: {c * 40000 for c in range(5) if rnd.random() < 0.5} | {rnd.randrange(200000) for _ in range(rnd.randint(0, 40))} for i in range(12)}
    sets |= {90: set(range(70000)), 91: set(range(60000, 90000)), 92: set(range(0, 200000, 3))}
    presence = spark.createDataFrame([(i, c) for i, s in sets.items() for c in s], "id long, col long")
    made = bitmaps.containers(presence)
    assert {r.kind for r in made.select("kind").distinct().collect()} == {"array", "bits", "runs"}
    assert {(r.id, r.col) for r in bitmaps.presence(made).collect()} == {(i, c) for i, s in sets.items() for c in s}
    found = {(r.i, r.j): r.intersection for r in bitmaps.block_product(made, rows).collect()}
    assert found == {k: n for k, n in shares(sets).items() if k[0] < k[1]}
    assert {r.id: r.size for r in bitmaps.sizes(made).collect()} == {i: len(s) for i, s in sets.items() if s}


def test_stored_index_is_joined_where_it_lies(spark, tmp_path):
    sets = sketches(11)
    manifest = index_store.write_index(sized(spark, sets), str(tmp_path), buckets=4)
    counts = Counter(h for s in sets.values() for h in s)
    kept = [n for n in counts.values() if n > 1]
    assert (manifest["hashes"], manifest["postings"], manifest["max_df"], manifest["pairs"]) == (len(kept), sum(kept), max(kept), sum(n * (n - 1) // 2 for n in kept))
    index = index_store.read_index(spark, str(tmp_path))
    similar = index_store.index_pairs(index, 0.3)
    plan = similar._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("hash#" not in line for line in exchanges) and "Bucketed: true" in plan
    t = float(np.float32(0.3))
    assert {(r.i, r.j): r.intersection for r in similar.collect()} == {(i, j): n for (i, j), n in shares(sets).items() if n / len(sets[i]) >= t}


def test_passes_stop_and_go_on(spark, tmp_path):
    sets = sketches(12)
    table, path = sized(spark, sets), f"{tmp_path}/run"
    assert passes.run(table, path, 0.2, rows=1500, most=1) == [0]
    with pytest.raises(ValueError):
        passes.read(spark, path)
    stamps = {p: p.stat().st_mtime_ns for p in Path(f"{path}/part=0").iterdir()}
    (Path(path) / "part=1").mkdir()  # a pass that failed left files without a commit
    (Path(path) / "part=1" / "part-00000.parquet").write_bytes(b"x")
    rest = passes.run(table, path, 0.2, rows=7)  # the stored plan counts
    assert rest and rest[0] == 1 and passes.run(table, path, 0.2) == []
    assert stamps == {p: p.stat().st_mtime_ns for p in Path(f"{path}/part=0").iterdir()}
    t = float(np.float32(0.2))
    found = passes.read(spark, path).collect()
    assert {(r.i, r.j): r.intersection for r in found} == {(i, j): n for (i, j), n in shares(sets).items() if n / len(sets[i]) >= t}
    plan = spark.read.parquet(f"{path}/plan").orderBy("part").collect()
    assert [r.part for r in plan] == list(range(len(plan))) and all(a["last"] < b["first"] for a, b in zip(plan, plan[1:]))
    empty = f"{tmp_path}/none"
    assert passes.run(sized(spark, {}), empty) == [] and passes.read(spark, empty).count() == 0


def records(seed):
    rnd = random.Random(seed)
    out = [("lead", "".join(rnd.choices("ACGT", k=50)))] if seed % 2 else []
    for k in range(30):
        out.append((f"r{k} x", "".join(rnd.choices("ACGTn", k=rnd.choice([0, 1, 3, 40, 500, 3000])))))
    return out


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("per_record", [False, True])
def test_sequences_by_splits(spark, tmp_path, seed, per_record):
    text, all_records = "", records(seed)
    for name, sequence in all_records:
        text += "" if name == "lead" else f">{name}\n"
        text += "".join(sequence[k : k + 60] + "\n" for k in range(0, len(sequence), 60)) + "\n" * (len(sequence) == 3)
    (tmp_path / "a.fa").write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        chunks, headers = splits.sequence_chunks(spark, str(tmp_path), k=5, per_record=per_record, size=100)
        found = kmers.chunk_hashes(chunks, k=5).collect()
        known = {r.record: r.header for r in headers.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    named = [r for r in all_records if r[0] != "lead"]
    whole = {k: s for k, (_, s) in enumerate(named, 1)} if per_record else {0: "".join(s for _, s in all_records)}
    assert known == ({k: n for k, (n, _) in enumerate(named, 1)} if per_record else {0: named[-1][0]})
    assert {(r.record, r.pos): r.kmer for r in found} == {(k, p): s[p : p + 5] for k, s in whole.items() for p in range(len(s) - 4)}
    assert len(found) == sum(max(0, len(s) - 4) for s in whole.values())


def test_names_in_several_parts_keep_their_ids(spark, tmp_path):
    names = spark.range(100).selectExpr("id", "concat('n', id) name")
    sinks.write_names(names.repartitionByRange(4, "id"), f"{tmp_path}/names")
    assert {r.id: r.name for r in readers.read_names(spark, f"{tmp_path}/names").collect()} == {i: f"n{i}" for i in range(100)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        (tmp_path / "list.txt").write_text("".join(f" p{i}\r\n" if i % 7 else "\n" for i in range(200)))
        assert {r.id: r.path for r in readers.read_file_list(spark, f"{tmp_path}/list.txt").collect()} == {i: f"p{i}" for i in range(200) if i % 7}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sketch_files_are_read_by_tasks(spark, tmp_path):
    made = lambda *mins: json.dumps([{"name": "a b", "signatures": [{"mins": list(mins)}]}])
    (tmp_path / "one file.sig").write_text(made(2**64 - 1, 5, 5))
    (tmp_path / "two.sig.gz").write_bytes(gzip.compress(made(7).encode()))
    (tmp_path / "bad.sig").write_text("{")
    (tmp_path / "none.sig").write_text('[{"name": "x"}]')
    names = ["one file.sig", "two.sig.gz", "bad.sig", "none.sig", "gone.sig"]
    files = spark.createDataFrame([(i, f"{tmp_path}/{n}") for i, n in enumerate(names)] + [(9, f"file://{tmp_path}/two.sig.gz")], "id int, path string")
    found = {r.id: (r.name, r.mins, r.missing) for r in readers.read_sketches(spark, files).collect()}
    assert found == {0: ("a b", [-1, 5], False), 1: ("a b", [7], False), 2: (None, [], False), 3: ("x", [], False), 4: (None, [], True), 9: ("a b", [7], False)}
    assert readers.read_sketches(spark, files, bag=True).where("id = 0").first().mins == [-1, 5, 5]
    assert "collect()" not in Path(readers.__file__).read_text()


def test_dense_rows(spark, tmp_path):
    sets = {i + 3: s for i, s in sketches(5, n=9).items()}
    half = spark.createDataFrame([(i, j, n) for (i, j), n in shares(sets).items()], "i long, j long, intersection long")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "id long, size int")
    rows = pairs.jaccard_rows(half, sizes)
    ids = sorted(sets)
    value = lambda i, j: 1.0 if i == j else len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    assert {r.line: r.row for r in rows.collect()} == {k: [value(i, j) for j in ids] for k, i in enumerate(ids)}
    sinks.write_dense_rows(rows, f"{tmp_path}/matrix")
    assert {r.i: r.row for r in readers.read_dense_matrix(spark, f"{tmp_path}/matrix").collect()} == {k: [value(i, j) for j in ids] for k, i in enumerate(ids)}
    with pytest.raises(ValueError):
        pairs.jaccard_rows(half, sizes, most=4)


def test_scope_owns_what_is_written_inside(spark):
    from sketchloom.sources import staging

    root = Path(staging.shared_root(spark).removeprefix("file://"))
    outside = staging.written(spark.range(3), "outside")
    before = set(root.iterdir())
    with pytest.raises(ZeroDivisionError), staging.scope(spark):
        assert threshold_join.contained(sized(spark, sketches(1)), 0.5).count() > 0
        assert set(root.iterdir()) > before
        1 / 0
    assert set(root.iterdir()) == before and outside.count() == 3


def test_products_of_sparse_and_dense_containers(spark, monkeypatch):
    sets = {1: set(range(70000)), 2: set(range(60000, 90000)), 3: {5, 80000}}
    made = bitmaps.containers(spark.createDataFrame([(i, c) for i, s in sets.items() for c in s], "id long, col long"))
    found = {}
    for dense in (0, 1 << 17):
        monkeypatch.setattr(bitmaps, "DENSE", dense)
        product = bitmaps.block_product(made, 2)
        found[dense] = {(r.i, r.j): r.intersection for r in product.collect()}
        assert ("Aggregate" in product._jdf.queryExecution().executedPlan().toString()) == (dense == 0)  # sparse: no container goes to every block, no pair is shuffled
    assert found[0] == found[1 << 17] == {k: n for k, n in shares(sets).items() if k[0] < k[1]}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containers_go_on_over_batches(spark):
    rnd = random.Random(3)
    sets = {i: {rnd.randrange(200000) for _ in range(rnd.randint(1, 60))} for i in range(20)} | {90: set(range(65530, 65600)), 91: {c for c in range(65536) if c % 3}}
    presence = spark.createDataFrame([(i, c) for i, s in sets.items() for c in s for _ in range(1 + (c % 5 == 0))], "id long, col long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = bitmaps.containers(presence)
        rows = made.collect()
        assert "Aggregate" not in plan_of(made)  # no list of places is brought together in a buffer
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    places = {(i, c): np.array(sorted(x & 65535 for x in s if x >> 16 == c)) for i, s in sets.items() for c in {x >> 16 for x in s}}
    assert len(rows) == len(places)
    for r in rows:
        expected = places[r.id, r.chunk]
        words = bitmaps.decoded(r.kind, bytes(r.data))
        assert r.n == len(expected) and np.array_equal(words, bitmaps.bits_of(expected)) and (r.kind, bytes(r.data)) == bitmaps.encoded(expected)


def test_places_of_hashes_by_one_shuffle(spark):
    from sketchloom.operators import sketches as module

    members = [(i, h) for i in range(30) for h in (-5, 7, i, 2**40 + i % 3)] + [(1, None)]
    found = module.presence_matrix(spark.createDataFrame(members, "id int, hash long").distinct())
    order = {h: k for k, h in enumerate(sorted({h for _, h in members if h is not None}, key=lambda h: h % 2**64))}
    assert {(r.id, r.col) for r in found.collect()} == {(i, order[h]) for i, h in members if h is not None}
    assert found.schema["id"].dataType.simpleString() == "int" and "hashpartitioning(hash" not in plan_of(found)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_n_grams_are_made_once(spark):
    from sketchloom.plans import queries

    assert plan_of(queries.space_usage(spark, str(DATA))).count("MapInArrow") == 1  # one pass over the texts
    assert plan_of(scale.hot_hash_blocks(spark, str(DATA))).count("MapInArrow") == 1  # and nothing is written on the way


def test_work_of_passes_shuffles_members_once(spark, monkeypatch):
    sets, plans = sketches(13), []
    monkeypatch.setattr(passes, "written", lambda df, name: plans.append(plan_of(df)) or df)
    work = passes.work(sized(spark, sets).select("id", "hash"))
    counts = Counter(h for s in sets.values() for h in s)
    assert {r.id: r.rows for r in work.collect()} == {i: sum(counts[h] for h in s) for i, s in sets.items() if s}
    assert [p.count("hashpartitioning(hash") for p in plans] == [1]
    assert passes.rows_a_pass(work, 4) == sum(n * n for n in counts.values()) // 4 + 1


def test_hashes_of_one_sketch_are_not_joined(spark, monkeypatch):
    sets = {1: {1, 2, 3, 4, 50}, 2: {1, 2, 3, 60, 61}, 3: {1, 70}}
    table = sized(spark, sets)
    ranked = {(r.id, r.hash): r["at"] for r in threshold_join.ranked_members(table).collect()}
    assert ranked == {(1, 2): 2, (1, 3): 3, (1, 1): 4, (2, 2): 2, (2, 3): 3, (2, 1): 4, (3, 1): 1}  # 4, 50, 60, 61 and 70 meet nothing
    nested = spark.createDataFrame([(i, sorted(s) * 2) for i, s in sketches(14).items()], "id long, mins array<long>")
    plans, write = {}, threshold_join.written
    monkeypatch.setattr(threshold_join, "written", lambda df, name: plans.update({name: plan_of(df)}) or write(df, name))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(threshold_join.contained(nested, 0.5)) == rows(threshold_join.contained(sized(spark, sketches(14)), 0.5))
    plans.clear()
    assert rows(threshold_join.join_rows(nested, 0.5)) == rows(threshold_join.join_rows(sized(spark, sketches(14)), 0.5))
    threshold_join.classes(nested)
    assert "Exchange" not in plans["threshold-sketches"] and "threshold-hashes" not in plans  # whole sketches are not taken apart and brought together again
    assert plan_of(threshold_join.join_rows(nested, 0.5)).count("SortMergeJoin") <= 2  # prefixes are joined once for both counts


def test_jaccard_of_bitmaps_shuffles_no_pair(spark, monkeypatch):
    sets = sketches(15) | {90: set(range(70000)), 91: set(range(60000, 90000))}
    sets = {i: {h % 2**20 for h in s} for i, s in sets.items()}
    made = bitmaps.containers(spark.createDataFrame([(i, c) for i, s in sets.items() for c in s], "id long, col long"))
    expected = {(i, j): (n, n / len(sets[i] | sets[j])) for (i, j), n in shares(sets).items()}
    for dense in (0, 1 << 17):
        monkeypatch.setattr(bitmaps, "DENSE", dense)
        found = bitmaps.similar(made)
        plan = plan_of(found)
        assert ("Exchange" in plan) == (dense == 0) and (plan.count("CartesianProduct") == 1) == (dense > 0)
        rows = found.collect()
        assert {(r.i, r.j): (r.intersection, r.jaccard) for r in rows} == expected and len(rows) == len(expected)
    assert plan_of(bitmaps.mirrored(bitmaps.block_product(made))).count("CartesianProduct") == 1  # pairs are counted once for both directions


def test_pairs_of_an_index_are_not_shuffled(spark, tmp_path):
    sets = sketches(16)
    index_store.write_index(sized(spark, sets), str(tmp_path), buckets=4)
    index = index_store.read_index(spark, str(tmp_path))
    found, joined = (f(index, 0.3) for f in (index_store.block_pairs, index_store.index_pairs))
    assert "Exchange" not in plan_of(found) and "Exchange" in plan_of(joined)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect())) and found.columns == joined.columns


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_stored_pairs_go_by_blocks(spark):
    assert "Exchange" not in plan_of(scale.stored_index_pairs(spark, str(DATA)))


def test_passes_keep_their_blocks_until_the_last(spark, tmp_path, monkeypatch):
    sets, made = sketches(17), []
    table, path, pack = sized(spark, sets), f"{tmp_path}/run", passes.grid_join.blocks_of
    monkeypatch.setattr(passes.grid_join, "blocks_of", lambda df, alone=True, path=None: made.append(alone) or pack(df, alone, path))
    assert passes.run(table, path, 0.2, rows=1500, most=1, known=passes.work(table.select("id", "hash"))) == [0] and (Path(path) / "blocks/_SUCCESS").exists()
    (Path(path) / "blocks/_SUCCESS").unlink()  # a run that failed left blocks without a commit
    assert passes.run(table, path, 0.2, most=1) == [1] and passes.run(table, path, 0.2)
    assert made.count(True) == 2 and not (Path(path) / "blocks").exists()
    t = float(np.float32(0.2))
    assert {(r.i, r.j): r.intersection for r in passes.read(spark, path).collect()} == {(i, j): n for (i, j), n in shares(sets).items() if n / len(sets[i]) >= t}


def test_whole_sketches_are_not_shuffled_for_copies(spark, monkeypatch):
    from sketchloom.sources import staging

    sets = sketches(18) | {100 + i: set(range(i % 3, 20)) for i in range(9)}
    nested = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, mins array<long>")
    classes, found = {min(i for i, t in sets.items() if t == s): len(s) for s in sets.values() if s}, []
    for rows in (staging.FEW, 0):
        monkeypatch.setattr(threshold_join, "unless_many", lambda df, rows=rows: staging.unless_many(df, rows))
        whole, members = threshold_join.classes(nested)
        assert {r.id: r.size for r in whole.collect()} == classes and members.count() == sum(map(bool, sets.values()))
        found.append(sorted(map(tuple, threshold_join.contained(nested, 0.5).collect())))
        if rows:
            assert "SortMergeJoin" not in plan_of(whole) and "BroadcastHashJoin" in plan_of(whole)
    assert found[0] == found[1]
