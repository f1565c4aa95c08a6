"""The driver contract."""

import __spark_entry__ as entry


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"pair_jaccard", "dereplicate", "kmer_mmh3"} <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["i", "j", "intersection", "jaccard", "c_ij", "c_ji"]


def test_core_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['sketchloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'pair_jaccard' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
