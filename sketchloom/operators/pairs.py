"""All-pairs intersections and the measures made of them.

Pairs are counted by blocks of sketches against each other (grid_join.py) and mirrored after the count, which halves the
work. Neither joined rows nor pairs are shuffled, so what lies on disk grows with the members and not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.operators import grid_join
from sketchloom.sources.staging import written


BAND_LINES = 256  # lines of a dense matrix that a task fills


def intersections(members: DataFrame, mirrored: bool = True) -> DataFrame:
    """members(id, hash) or sketches(id, mins) -> i, j, intersection of all pairs of different sketches with something in common; i < j unless mirrored."""
    half = grid_join.half(members if "mins" in members.columns else members.select("id", "hash")).select("i", "j", "intersection")
    if not mirrored:
        return half.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "intersection")
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(both.alias("p"), "intersection").select("p.i", "p.j", "intersection")


def minimum_multiplicity(bags: DataFrame) -> DataFrame:
    """bags(id, hash) with repeated rows -> i, j, intersection by the smaller count of each hash (i < j)."""
    half = grid_join.half_of(grid_join.row_blocks(bags, weighed=True))
    return half.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "intersection")


def similarities(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """i, j, intersection, jaccard, c_ij (the share of i in j), c_ji."""
    out = pairs.join(sizes.select(F.col("id").alias("i"), F.col("size").alias("n_i")), "i").join(sizes.select(F.col("id").alias("j"), F.col("size").alias("n_j")), "j")
    x = F.col("intersection").cast("double")
    return out.select("i", "j", "intersection", (x / (F.col("n_i") + F.col("n_j") - F.col("intersection"))).alias("jaccard"), (x / F.col("n_i")).alias("c_ij"), (x / F.col("n_j")).alias("c_ji"))


def similar(sized: DataFrame, threshold: float | None = None, with_sizes: bool = False) -> DataFrame:
    """sized(id, size, hash) or sketches(id, mins) -> what similarities() gives, at the threshold if there is one; with_sizes adds n_i and n_j.

    Sizes ride along with the members, so no pair is shuffled.
    """
    return measured(grid_join.half(sized if "mins" in sized.columns else sized.select("id", "size", "hash"), threshold), threshold, with_sizes)


def measured(half: DataFrame, threshold: float | None = None, with_sizes: bool = False) -> DataFrame:
    """half(i, j, n_i, n_j, intersection), each pair once -> what similar() gives."""
    x = F.col("intersection").cast("double")
    row = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(f"n_{i}").alias("n_i"), F.col(f"n_{j}").alias("n_j"), (x / F.col(f"n_{i}")).alias("c_ij"), (x / F.col(f"n_{j}")).alias("c_ji"))
    rows = half.select("intersection", (x / (F.col("n_i") + F.col("n_j") - F.col("intersection"))).alias("jaccard"), F.explode(F.array(row("i", "j"), row("j", "i"))).alias("p"))
    out = rows.select("p.i", "p.j", "intersection", "jaccard", "p.c_ij", "p.c_ji", *(["p.n_i", "p.n_j"] if with_sizes else []))
    return out if threshold is None else at_threshold(out, threshold)


def float32(threshold: float) -> Column:
    """A threshold as single precision, widened again: 0.1, 0.2 and 0.3 lie above their double values, so a pair exactly at them is dropped."""
    return F.lit(threshold).cast("float").cast("double")


def at_threshold(similar: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Pairs whose query i is contained in j to the threshold."""
    return similar.where(reaches(threshold))


def reaches(threshold: float) -> Column:
    return F.col("c_ij") >= float32(threshold)


def _lines(sizes: DataFrame, most: int | None) -> tuple[int, DataFrame]:
    """How many sketches there are, and (id, line) of each in order of ids; more than `most` are refused, if it is given, as dense matrices grow with their square. A line has n cells, so n lines are little beside them."""
    if (n := sizes.count()) > (n if most is None else most):
        raise ValueError(f"{n} sketches make {n * n} cells; use the pair list")
    return n, written(sizes.select("id", "size", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("line")), "matrix-lines")


def jaccard_matrix(pairs: DataFrame, sizes: DataFrame, most: int | None = None) -> DataFrame:
    """(i, j, value) of all cells: 1 on the diagonal, also of empty sketches, 0 for nothing in common."""
    n, lines = _lines(sizes, most)
    cells = _rows(pairs, n, lines).select("line", F.posexplode("row").alias("column", "value"))
    at = lambda x, name: F.broadcast(lines.select(F.col("line").alias(name), F.col("id").alias(x)))
    return cells.join(at("i", "line"), "line").join(at("j", "column"), "column").select("i", "j", "value")


def _dense(n: int):
    def run(batches):
        """Sorted cells of whole rows to rows of n values."""
        schema = pa.schema([("line", pa.int64()), ("row", pa.list_(pa.float64()))])
        line, row = None, None
        for batch in batches:
            lines, columns, values = (batch.column(c).to_numpy() for c in ("line", "column", "value"))
            ends = np.append(np.flatnonzero(np.diff(lines)) + 1, len(lines)) if len(lines) else ()
            begin = 0
            for end in ends:
                if lines[begin] != line:
                    if row is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([line], pa.int64()), pa.array([row], pa.list_(pa.float64()))], schema=schema)
                    line, row = int(lines[begin]), np.zeros(n)
                row[columns[begin:end]] = values[begin:end]
                begin = end
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.int64()), pa.array([row], pa.list_(pa.float64()))], schema=schema)

    return run


def _rows(pairs: DataFrame, n: int, lines: DataFrame) -> DataFrame:
    at = lambda x, name: F.broadcast(lines.select(F.col("id").alias(x), F.col("line").alias(name), F.col("size").alias(f"n_{x}")))
    x = F.col("intersection").cast("double")
    known = pairs.join(at("i", "line"), "i").join(at("j", "column"), "j").select("line", "column", (x / (F.col("n_i") + F.col("n_j") - F.col("intersection"))).alias("value"))
    own = lines.select("line", F.col("line").alias("column"), F.lit(1.0).alias("value"))
    # bands of lines in order, by number: a partition by range would make the pairs twice, once to find its bounds
    bands = max(1, min(n, max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BAND_LINES)))
    dealt = known.unionByName(own).repartitionById(bands, F.floor(F.col("line") * bands / max(n, 1)).cast("int")).sortWithinPartitions("line")
    return dealt.mapInArrow(_dense(n), "line long, row array<double>")


def jaccard_rows(pairs: DataFrame, sizes: DataFrame, most: int | None = None) -> DataFrame:
    """(line, row) of the dense Jaccard matrix in order of ids, lines from 0: rows of as many values as there are sketches, filled up with zeros where the task has the pairs of its range of lines, 1 on the diagonal."""
    return _rows(pairs, *_lines(sizes, most))


def intersection_matrix(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(i, j, value) of the cells above 0, the sizes on the diagonal."""
    return pairs.select("i", "j", F.col("intersection").alias("value")).union(sizes.where("size > 0").select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("size").cast("long")))


def first_ids(sizes: DataFrame, n: int = 10) -> DataFrame:
    """The n smallest ids."""
    return sizes.select("id").orderBy("id").limit(n)


def matrix_preview(cells: DataFrame, sizes: DataFrame, n: int = 10) -> DataFrame:
    """The cells(i, j, value) of the n smallest ids, absent ones as 0: a report."""
    first = first_ids(sizes, n)
    grid = first.toDF("i").crossJoin(first.toDF("j"))  # n * n rows
    return grid.join(cells.select("i", "j", F.col("value").cast("double").alias("known")), ["i", "j"], "left").select("i", "j", F.coalesce("known", F.lit(0.0)).alias("value"))
