"""Readers, writers and k-mer hashes on small files."""

from pathlib import Path

import gzip
import json
import zipfile

from pyspark.sql import functions as F

from sketchloom.functions import kmers, u64
from sketchloom.operators import pairs, sketches
from sketchloom.sources import readers, sinks

SEQUENCE = "ACGTGCAGACGTGCAGACGTGCAGACGTGCAGACG"


def signature(name, mins):
    return json.dumps([{"name": name, "signatures": [{"mins": mins}, {"mins": [77]}]}, {"name": "other", "signatures": []}])


def test_sketch_files(spark, tmp_path):
    (tmp_path / "a b.sig").write_text(signature("A", [1, 18446744073709551615, 1]))
    with gzip.open(tmp_path / "b.sig.gz", "wt") as f:
        f.write(signature("B", [2]))
    (tmp_path / "toy.sig").write_text(json.dumps([{"name": "t", "age": 3, "mins": [1, 2]}]))
    names = ["a b.sig", "missing.sig", "b.sig.gz", "toy.sig"]
    (tmp_path / "list.txt").write_text("".join(f"{tmp_path}/{n}\n" for n in names))
    files = readers.read_file_list(spark, str(tmp_path / "list.txt"))
    found = readers.read_sketches(spark, files).orderBy("id").collect()
    assert [(r.id, r.name, r.mins, r.missing) for r in found] == [(0, "A", [1, -1], False), (1, None, [], True), (2, "B", [2], False), (3, "t", [], False)]
    sinks.write_names(readers.read_sketches(spark, files), str(tmp_path / "names"))
    assert [r.value for r in spark.read.text(str(tmp_path / "names")).collect()] == ["A", "", "B", "t"]


def test_only_missing_files(spark, tmp_path):
    files = spark.createDataFrame([(0, str(tmp_path / "no.sig"))], "id int, path string")
    assert [(r.mins, r.missing) for r in readers.read_sketches(spark, files).collect()] == [([], True)]


def test_index_text(spark, tmp_path):
    index = spark.createDataFrame([(-1, [0, 2]), (5, [1, 2, 3])], "hash bigint, ids array<int>")
    for text in (True, False):
        path = str(tmp_path / f"index{text}")
        sinks.write_hash_index(index, path, text)
        back = readers.read_hash_index(spark, path) if text else spark.read.parquet(path)
        assert sorted(map(tuple, back.collect())) == [(-1, [0, 2]), (5, [1, 2, 3])]
    assert sorted(sketches.index_members(index).collect()) == [(0, -1), (1, 5), (2, -1), (2, 5), (3, 5)]


def test_pair_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0.4, 2 / 3, 0.5)], readers.PAIRS)
    sinks.write_pairs(df, str(tmp_path / "pairs"))
    assert readers.read_pairs(spark, str(tmp_path / "pairs")).collect() == df.collect()
    sinks.write_plain_pairs(df, str(tmp_path / "plain"))
    assert [tuple(r) for r in readers.read_plain_pairs(spark, str(tmp_path / "plain")).collect()] == [(0, 1, 0.4)]


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "s.txt").write_text("/x/b.sig\n/x/c.sig\n")
    assert [r.key for r in readers.read_selected(spark, str(tmp_path / "s.txt")).collect()] == ["b", "c"]
    (tmp_path / "t.tsv").write_text("name\tmd5sum\nn\tabc\n")
    assert [r.key for r in readers.read_md5_table(spark, str(tmp_path / "t.tsv")).collect()] == ["abc"]
    (tmp_path / "r.csv").write_text("query_name,query_md5,match_name,match_md5,containment,max_containment,jaccard,intersect_hashes\na,1,b,2,0.5,0.6,0.4,7\n")
    assert readers.read_search_results(spark, str(tmp_path / "r.csv")).first().intersect_hashes == 7


def test_matrix_and_selected(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0.0), (0, 1, 0.5), (0, 0, 1.0), (1, 1, 1.0)], "i int, j int, value double")
    sinks.write_dense_matrix(cells, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["1.0 0.5 ", "0.0 1.0 "]
    (tmp_path / "m.txt").write_text("1 0.5 \n0 1 \n")
    assert sorted(map(tuple, readers.read_dense_matrix(spark, str(tmp_path / "m.txt")).collect())) == [(0, [1.0, 0.5]), (1, [0.0, 1.0])]
    sinks.write_selected(spark.createDataFrame([(0, "b", 2), (1, "a", 1)], "id int, path string, size int"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["a", "b"]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one\nAC\nGT\n>two\r\nGG\r\n")
    whole = readers.read_fasta(spark, str(tmp_path / "x.fa")).first()
    assert (whole.header, whole.sequence) == ("two", "ACGTGG")
    assert sorted((r.header, r.sequence) for r in readers.read_fasta(spark, str(tmp_path / "x.fa"), per_record=True).collect()) == [("one", "ACGT"), ("two", "GG")]


def test_zip(tmp_path):
    (tmp_path / "a.sig").write_text("[]")
    sinks.write_zip_database([str(tmp_path / "a.sig")], str(tmp_path / "x.zip"), "manifest\n")
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.namelist() == [sinks.MANIFEST_NAME, "signatures/a.sig.gz"] and gzip.decompress(z.read("signatures/a.sig.gz")) == b"[]"


def test_kmers(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(0, SEQUENCE), (1, "A" * 20), (2, "a" * 21), (3, None), (4, "")], "id long, sequence string")
    found = {(r.id, r.pos): r for r in kmers.kmer_hashes(df).withColumn("h1", u64.to_text(F.col("h1"))).withColumn("h2", u64.to_text(F.col("h2"))).collect()}
    assert len(found) == len(SEQUENCE) - 20 + 1
    first, second = found[0, 0], found[0, 1]
    assert (first.kmer, first.h1, first.h2) == ("ACGTGCAGACGTGCAGACGTG", "16216044148190533079", "9374265633120610751")
    assert (second.h1, second.h2) == ("11322689180962404098", "10565578917794109427")
    windows = sorted(map(tuple, kmers.kmer_windows(df).collect()))
    assert windows == sorted((i, p, r.kmer) for (i, p), r in found.items())


def test_murmur_lengths():
    import numpy as np

    h1, h2 = kmers.murmur3_x64_128(np.frombuffer(b"foo", np.uint8)[None, :])
    assert (h1.view(np.int64)[0], h2.view(np.int64)[0]) == (-2129773440516405919, 9128664383759220103)


def test_end_to_end(spark):
    df = spark.createDataFrame([(0, SEQUENCE), (1, SEQUENCE[3:]), (2, "T" * 40)], "id long, sequence string")
    members = kmers.kmer_hashes(df).select("id", F.col("h1").alias("hash")).distinct()
    sizes = members.groupBy("id").agg(F.count("*").alias("size"))
    best = pairs.similarities(pairs.intersections(members), sizes).where("i < j").collect()
    assert [(r.i, r.j) for r in best] == [(0, 1)] and best[0].c_ji == 1.0


def test_a_sketch_is_one_file(spark, tmp_path):
    import gzip
    import json

    from sketchloom.sources import readers, sinks

    rows = [(i, f'n "{i}"' if i % 5 else None, [str(2**64 - 1 - i), str(i)]) for i in range(30)]
    table = spark.createDataFrame(rows, "id int, name string, mins array<string>")
    sinks.write_sketches(table, f"file://{tmp_path}/plain")
    sinks.write_sketches(table, f"{tmp_path}/packed", compressed=True)
    sinks.write_sketches(table.limit(0), f"{tmp_path}/none")
    assert sorted(p.name for p in (tmp_path / "plain").iterdir() if p.suffix != ".crc") == sorted(f"id={i}.sig" for i in range(30))  # no folder for each
    found = json.loads(gzip.decompress((tmp_path / "packed" / "id=7.sig.gz").read_bytes()))
    assert found == [{"name": 'n "7"', "signatures": [{"mins": [2**64 - 8, 7]}]}] and list((tmp_path / "none").iterdir()) == []
    assert readers.sketch_paths(spark, f"{tmp_path}/*").count() == 60


def test_long_lines_are_read_few_at_a_time(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from sketchloom.sources import splits

    made, write = [], splits.written
    monkeypatch.setattr(splits, "written", lambda *a, **k: made.append(write(*a, **k)) or made[-1])
    (tmp_path / "long.txt").write_text("".join(f"{i} " * 40000 + "\n" for i in range(300)))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        lines = splits.numbered_lines(spark, f"{tmp_path}/long.txt", long=True)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert {(r.number, r.value[:4].split()[0]) for r in lines.collect()} == {(i, str(i)) for i in range(300)}
    files = [pq.ParquetFile(f).metadata for f in Path(made[0].staged_path.removeprefix("file://")).glob("*.parquet")]
    groups = sorted(f.row_group(k).num_rows for f in files for k in range(f.num_row_groups))
    assert sum(groups) == 300 and groups[-1] <= splits.GROUP_LINES, groups
