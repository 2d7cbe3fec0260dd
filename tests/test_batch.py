"""Batch algebra on tiny literals and round trips."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import batch as B


def frame(spark, n=6):
    return spark.createDataFrame([(i, i + 1, chr(97 + i)) for i in range(n)], "row_id long, obs long, labels string")


def values(df, c="obs"):
    return [r[c] for r in df.orderBy("row_id").collect()]


def test_reorder_and_inverse(spark):
    p = spark.createDataFrame(list(enumerate([3, 4, 2, 0, 1, 5])), "pos long, row_id long")
    out = B.reorder(frame(spark), p)
    assert values(out) == [4, 5, 3, 1, 2, 6]
    assert values(B.reorder(out, B.inverse_permutation(p))) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("divisor,pad", [(2, 1), (3, 0), (7, 4)])
def test_pad_cycles_from_the_front(spark, divisor, pad):
    out, n = B.pad_to_divisor(frame(spark, 3), divisor)
    assert n == pad
    assert values(out) == [1, 2, 3, 1, 2, 3, 1][: 3 + pad]
    assert values(B.unpad(out, n)) == [1, 2, 3]


def test_repeat_interleaved_and_tiled(spark):
    d = frame(spark, 2)
    assert values(B.repeat(d, 2)) == [1, 1, 2, 2]
    assert values(B.repeat(d, 2, interleave=False)) == [1, 2, 1, 2]


def test_fold_unfold(spark):
    d = frame(spark).select("row_id", "obs")
    f = B.fold(d, 3, "obs")
    assert [r.obs for r in f.orderBy("row_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert values(B.unfold(f, 3, "obs")) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("s", [slice(1, 4), slice(-4, -1), slice(None, None, 2), slice(2, None, 3)])
def test_slices_are_pythons(spark, s):
    assert values(B.slice_rows(frame(spark), s.start, s.stop, s.step or 1)) == [1, 2, 3, 4, 5, 6][s]


def test_chunks_are_even(spark):
    assert [r["count"] for r in B.chunk(frame(spark), 4).groupBy("chunk").count().orderBy("chunk").collect()] == [2, 2, 1, 1]


def test_union_conflict_fails(spark):
    a = frame(spark)
    assert values(B.union_columns(a, a.select("row_id", "obs", (F.col("obs") * 2).alias("twice"))), "twice") == [2, 4, 6, 8, 10, 12]
    with pytest.raises(Exception, match="differs"):
        B.union_columns(a, a.select("row_id", (F.col("obs") + 1).alias("obs"))).collect()


def test_row_ids_are_dense_and_ordered(spark):
    d = B.with_row_id(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")), "k")
    rows = d.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(1000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_sample_level_repeat_and_unfold(spark):
    d = B.repeat_by(frame(spark, 3), F.col("row_id"))
    assert sorted(r.obs for r in d.collect()) == [2, 3, 3]
    a = spark.createDataFrame([(0, [1, 2, 3, 4])], "row_id long, x array<int>")
    assert values(B.unfold_chunks(a, 2, ["x"]), "x") == [[1, 2], [3, 4]]


def test_array_helpers(spark):
    d = spark.createDataFrame([([0, 0, 1, 1], [5, 2, 7, 2])], "m array<int>, ids array<int>")
    r = d.select(B.position_ids(F.col("m")).alias("p"), B.eos_mask(F.col("ids"), [2]).alias("e"), B.pad_or_cut(F.col("ids"), 6, F.lit(0)).alias("x"), B.pad_or_cut(F.col("ids"), 2, F.lit(0), "left").alias("y"), B.strip_left_padding(F.col("ids"), F.col("m")).alias("z")).first()
    assert (r.p, r.e, r.x, r.y, r.z) == ([0, 0, 0, 1], [1, 1, 0, 0], [5, 2, 7, 2, 0, 0], [7, 2], [7, 2])
