import random
from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from ballast.functions import combinadic as cn
from ballast.operators import combos, draws, overlap


def sets(spark, some, more=None):
    rows = [(i, sorted(s), 1) for i, s in enumerate(some)]
    return draws.wide(spark.createDataFrame(rows, "idx long, reds array<int>, blue int"))


def test_ranks_are_colexicographic(spark):
    r = random.Random(1)
    some = [tuple(sorted(r.sample(range(1, 34), 6))) for _ in range(300)] + [(1, 2, 3, 4, 5, 6), (28, 29, 30, 31, 32, 33), (1, 2, 3, 4, 5, 33)]
    got = {x.idx: x.rank for x in sets(spark, some).select("idx", cn.rank().alias("rank")).collect()}
    assert [got[i] for i in range(len(some))] == [sum(comb(b - 1, k) for k, b in enumerate(s, 1)) for s in some]
    assert got[300] == 0 and got[301] == cn.ALL - 1


def test_all_ranks_are_taken_once_each_way(spark):
    df = spark.range(cn.ALL).select("id", cn.permuted(F.col("id"), 7).alias("rank"))
    back = cn.unranked(df, "rank").select("*", cn.rank().alias("again")).withColumn("place", cn.permuted(F.col("again"), 7, inverse=True))
    one = back.agg(F.count_distinct("rank").alias("ranks"), F.count_distinct("mask").alias("masks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count(F.when((F.col("place") != F.col("id")) | (F.col("again") != F.col("rank")), 1)).alias("bad"), F.corr("id", "rank").alias("r")).first()
    assert (one.ranks, one.masks, one.lo, one.hi, one.bad) == (cn.ALL, cn.ALL, 0, cn.ALL - 1, 0) and abs(one.r) < 0.01


def test_samples_are_exact_and_need_no_join(spark):
    a, b = cn.sampled(spark, 5000, 3), cn.sampled(spark, 5000, 3, first=5000)
    masks = [r.mask for r in a.unionByName(b).collect()]
    assert len(set(masks)) == 10_000 and all(bin(m).count("1") == 6 for m in masks)
    assert sorted(masks) != sorted(r.mask for r in cn.sampled(spark, 10_000, 4).collect())
    every = combos.all_combinations(spark)
    assert sorted(r.mask for r in every.where(~cn.not_sampled(10_000, 3)).select("mask").collect()) == sorted(masks)
    with pytest.raises(ValueError):
        cn.sampled(spark, 2, 3, first=cn.ALL - 1)
    assert cn.sampled(spark, 0, 3).count() == 0
    # as many as the library of random draws has, about
    assert abs(combos.rejection_library(spark, 1, 50_000).count() - cn.distinct_of(50_000)) < 300


def test_overlaps_equal_all_pairs(spark):
    r = random.Random(8)
    some = [frozenset(r.sample(range(1, 13), 6)) for _ in range(120)] + [frozenset(range(1, 7))] * 30 + [frozenset(range(28, 34))]
    got = {x.idx: (x.n, x["last"]) for x in overlap.earlier_overlaps(sets(spark, some)).collect()}
    for i, s in enumerate(some):
        near = [k for k in range(i) if len(s & some[k]) >= 4]
        assert got[i] == (len(near), near[-1] if near else None)


def test_each_pair_of_neighbours_is_there_once(spark):
    r = random.Random(9)
    some = list({frozenset(r.sample(range(1, 11), 6)) for _ in range(60)})
    rows = [tuple(x) for x in overlap.neighbours(sets(spark, some).select("b1", "b2", "b3", "b4", "b5", "b6", "mask")).collect()]
    m = lambda s: sum(1 << b for b in s)
    assert sorted(rows) == sorted((m(a), m(b), len(a & b)) for a in some for b in some if len(a & b) >= 4)


def test_combinations_without_overlap(spark):
    pool = spark.createDataFrame([(1, b) for b in range(1, 13)], "step long, ball int")
    drawn = [(1, 2, 3, 4, 20, 30), (5, 6, 7, 8, 9, 31), (13, 14, 15, 16, 17, 18)]
    got = {r.mask for r in overlap.without_overlap(combos.pool_combinations(pool), sets(spark, drawn)).collect()}
    assert got == {sum(1 << b for b in c) for c in combinations(range(1, 13), 6) if all(len(set(c) & set(d)) < 4 for d in drawn)}
