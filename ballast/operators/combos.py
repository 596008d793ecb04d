"""Combinations, rule chains, rejection, coverage and picks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.functions import rules
from ballast.schema import LISTED, NUM_PICKS, PICK, RED_MAX, REJECTED_DRAWS


def all_combinations(spark: SparkSession, parts: int | None = None) -> DataFrame:
    """All C(33, 6) combinations: b1..b6, mask, tails. Generators nest inside one stage; no join."""
    df = spark.range(1, RED_MAX - PICK + 2).select(F.col("id").cast("int").alias("b1"))
    df = df.select("b1", F.explode(F.sequence(F.col("b1") + 1, F.lit(RED_MAX - PICK + 2))).alias("b2"))
    df = df.repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "b1", "b2")
    df = _grow(_grow(_empty(df), 1), 2)
    for i in range(3, PICK + 1):
        df = _grow(df.select("*", F.explode(F.sequence(F.col(f"b{i - 1}") + 1, F.lit(RED_MAX - PICK + i))).alias(f"b{i}")), i)
    return df.select(*fb.B, "mask", "tails")


def _empty(df: DataFrame) -> DataFrame:
    return df.withColumns({"mask": F.lit(0).cast("long"), "tails": F.lit(0).cast("long")})


def _grow(df: DataFrame, i: int) -> DataFrame:
    """Mask and tail counters with ball i. Built level by level, so that what stands above the last
    generator is one step and not the whole sum, which a filter would repeat in each of its uses."""
    b = F.col(f"b{i}")
    return df.withColumns({"mask": F.col("mask").bitwiseOR(fb.bit(b)), "tails": F.col("tails") + fb.bit((b % 10) * 4)})


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("mask", fb.mask_of(fb.cols())).withColumn("tails", fb.tail_counters())


def pool_combinations(pool: DataFrame, parts: int | None = None) -> DataFrame:
    """(step, b1..b6, mask, tails): the 6-subsets of each step's pool (step, ball).

    A pool is one short array; generators nest over positions in it, and what the first two
    levels give is dealt out, so that neither joins nor one step's rows pile up in a task.
    """
    p = pool.groupBy("step").agg(F.sort_array(F.collect_list(F.col("ball").cast("int"))).alias("balls")).where(F.size("balls") >= PICK)
    last = lambda i: F.size("balls") - PICK + i - 1
    ball = lambda df, i: _grow(df.withColumn(f"b{i}", F.get("balls", F.col(f"p{i}"))), i)
    out = ball(_empty(p.select("step", "balls", F.explode(F.sequence(F.lit(0), last(1))).alias("p1"))), 1)
    for i in range(2, PICK + 1):
        out = ball(out.select("*", F.explode(F.sequence(F.col(f"p{i - 1}") + 1, last(i))).alias(f"p{i}")), i)
        if i == 2:
            out = out.repartition(parts or int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), "step", "p1", "p2")
    return out.select("step", *fb.B, "mask", "tails")


def _balls(test) -> int:
    """The mask of the balls for which ``test`` holds."""
    return sum(1 << b for b in range(1, RED_MAX + 1) if test(b))


def _few_differences() -> Column:
    """As a mask, the balls that would leave six with fewer than eleven distinct differences; b1..b5 are chosen, and diffs has the bits of their differences.

    A ball brings five differences, of which as many are old as there are chosen balls whose distance to it is in diffs; these are counted
    for all balls at once, by adding the five shifted masks bit by bit.
    """
    a, b, c, d, e = (F.call_function("shiftleft", F.col("diffs"), F.col(x)) for x in fb.B[: PICK - 1])
    xor = lambda *xs: reduce(lambda x, y: x.bitwiseXOR(y), xs)
    most = lambda x, y, z: x.bitwiseAND(y).bitwiseOR(x.bitwiseAND(z)).bitwiseOR(y.bitwiseAND(z))
    low = xor(a, b, c)
    one, two_a, two_b = xor(low, d, e), most(a, b, c), most(low, d, e)
    two, four = two_a.bitwiseXOR(two_b), two_a.bitwiseAND(two_b)
    # old differences: at least 1, 2, 3, 4, 5
    least = [four.bitwiseOR(two).bitwiseOR(one), four.bitwiseOR(two), four.bitwiseOR(two.bitwiseAND(one)), four, four.bitwiseAND(one)]
    spare = F.bit_count("diffs") - 6
    out = F.when(spare < 0, F.lit(_balls(lambda b: True)))
    for k, m in enumerate(least):
        out = out.when(spare == k, m)
    return out.otherwise(F.lit(0).cast("long"))


def _candidates(i: int) -> Column:
    """The balls of the pool that may be ball i of a combination that rules.FAST can still keep, as a mask; one to five are chosen.

    Every bound is one AND: what the sum can still reach, how many even, small and missing-residue balls are left to find with the r that follow,
    which tails are there twice, and whether the next ball would make a run of four or a third run.
    """
    r, mask, last = PICK - i, F.col("mask"), F.col(f"b{i - 1}")
    every, none = F.lit(_balls(lambda b: True)), F.lit(0).cast("long")
    count = lambda test: F.bit_count(mask.bitwiseAND(F.lit(_balls(test))))
    upto = lambda n: fb.bit(F.greatest(F.least(n, F.lit(RED_MAX)), F.lit(0)) + 1) - 1
    only = lambda cond, test: F.when(cond, F.lit(_balls(test))).otherwise(every)
    # the sum: with the least that can follow not over 160, with the most not under 70
    high = F.floor((160 - F.col("total") - r * (r + 1) // 2) / (r + 1)).cast("int")
    low = 70 - F.col("total") - F.col(f"top{r}")
    out = F.col("pool").bitwiseAND(F.bitwise_not(upto(last))).bitwiseAND(upto(high)).bitwiseAND(F.bitwise_not(upto(low - 1)))
    # the r greatest balls of the pool are for those that follow
    out = out.bitwiseAND(F.bitwise_not(F.col(f"end{r}")))
    even, small = count(lambda b: b % 2 == 0), count(lambda b: b <= 16)
    tests = [only(even == 4, lambda b: b % 2 == 1), only(i - 1 - even == 4, lambda b: b % 2 == 0), only(small < 2, lambda b: b <= 16), only(small == 4, lambda b: b > 16)]
    if i == PICK:
        ends = fb.total(F.col(b) % 10 for b in fb.B[: PICK - 1])
        tests.append(fb.either(F.when((ends + t).between(15, 45), F.lit(_balls(lambda b, t=t: b % 10 == t))).otherwise(none) for t in range(10)))
        tests += [F.lit(_balls(lambda b: b >= 25)), F.bitwise_not(_few_differences())]
    # residues: as many missing as there are balls to come, and this one must be of a missing kind
    has = [count(lambda b, k=k: b % 3 == k) > 0 for k in range(3)]
    missing = fb.total(F.when(h, 0).otherwise(1) for h in has)
    lacking = fb.either(F.when(h, none).otherwise(F.lit(_balls(lambda b, k=k: b % 3 == k))) for k, h in enumerate(has))
    tests.append(F.when(missing <= r, every).when(missing == r + 1, lacking).otherwise(none))
    twice = fb.either(F.when(F.col("tails").bitwiseAND(F.lit(2 << (4 * t))) != 0, F.lit(_balls(lambda b, t=t: b % 10 == t))).otherwise(none) for t in range(10))
    tests.append(F.bitwise_not(twice))
    # the ball after the last one: in a run of three already, or the first of a third run
    at = lambda k: F.shiftright(mask, k).bitwiseAND(F.lit(0xFFFFFFFFFF))
    set_ = lambda k: mask.bitwiseAND(fb.bit(F.greatest(last - k, F.lit(0)))) != 0
    runs = F.bit_count(mask.bitwiseAND(at(1)).bitwiseAND(F.bitwise_not(F.shiftleft(mask, 1))))
    tests.append(F.when((set_(1) & set_(2)) | ((runs == 2) & ~set_(1)), F.bitwise_not(fb.bit(last + 1))).otherwise(every))
    for t in tests:
        out = out.bitwiseAND(t)
    return out


def pruned_combinations(pool: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of pool_combinations() that the nine rules of rules.FAST keep, without generating the others.

    Each level generates only balls that some completion may save, so a subtree that a rule rejects is cut where
    its first few balls decide that.
    """
    p = pool.groupBy("step").agg(F.sort_array(F.collect_list(F.col("ball").cast("int"))).alias("balls")).where(F.size("balls") >= PICK)
    p = p.withColumn("pool", fb.mask_from_array(F.col("balls")))
    best = lambda r: F.slice("balls", F.size("balls") - r + 1, r) if r else F.array().cast("array<int>")
    ends = [F.aggregate(best(r), F.lit(0), lambda a, b: a + b).alias(f"top{r}") for r in range(PICK)] + [fb.mask_from_array(best(r)).alias(f"end{r}") for r in range(PICK)]
    out = p.select("*", *ends)
    fixed = ["step", "balls", "pool", *(f"{k}{r}" for k in ("top", "end") for r in range(PICK))]
    first = F.col("pool").bitwiseAND(F.lit(_balls(lambda b: b <= 10))).bitwiseAND(F.bitwise_not(F.col(f"end{PICK - 1}")))
    within = lambda mask: F.filter("balls", lambda b: mask.bitwiseAND(fb.bit(b)) != 0)
    for i in range(1, PICK + 1):
        chosen = fb.B[: i - 1]
        state = ["total", "mask", "tails"] if i > 1 else []
        if i == PICK:
            out = out.withColumn("diffs", fb.either(fb.bit(y - x) for x, y in combinations([F.col(b) for b in chosen], 2)))
        out = out.select(*fixed, *chosen, *state, (_candidates(i) if i > 1 else first).alias("cand"))
        out = out.select(*fixed, *chosen, *state, F.explode(within(F.col("cand"))).alias(f"b{i}"))
        out = out.withColumn("total", (F.col("total") if i > 1 else F.lit(0)) + F.col(f"b{i}"))
        out = _grow(out if i > 1 else _empty(out), i)
        if i == 2:
            out = out.repartition(parts or int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), "step", "b1", "b2")
    return out.select("step", *fb.B, "mask", "tails")


def context(draws: DataFrame, stats: DataFrame) -> DataFrame:
    """A row a step: m1..m10, masks of the last ten draws newest first, and cold, the balls missing for more than 15."""
    steps = stats.select("step").distinct()
    # each draw is one of the last ten of ten steps: an equi-join, whatever the number of steps
    seen = draws.select("mask", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"), "idx").select("mask", "k", (F.col("idx") + F.col("k")).alias("step"))
    last = seen.join(steps, "step").groupBy("step").agg(*(F.max(F.when(F.col("k") == k, F.col("mask"))).alias(f"m{k}") for k in range(1, 11)))
    cold = stats.where("color = 'red'").groupBy("step").agg(F.sum(F.when(F.col("omission") > 15, fb.bit(F.col("ball"))).otherwise(F.lit(0).cast("long"))).alias("cold"))
    return last.join(cold, "step")


def passed_of_pool(pool: DataFrame, ctx: DataFrame, seed: int | None = 42, names=rules.FAST) -> DataFrame:
    """passed() over the combinations of each step's pool; under the usual rules, only those that some rule doesn't cut off are generated."""
    if set(names) == set(rules.FAST):
        return passed(pruned_combinations(pool), ctx, seed, None)
    return passed(pool_combinations(pool), ctx, seed, names)


def passed(combos: DataFrame, ctx: DataFrame, seed: int | None = 42, names=rules.FAST) -> DataFrame:
    """Combinations that pass the static rules named (None: that is known) and the four dynamic ones; with a seed, the arithmetic rejection too.

    ctx has a row a step and joins by step where combos have one.
    """
    c = combos if names is None else combos.where(rules.static_keep(names))
    both = c.join(F.broadcast(ctx), "step") if "step" in combos.columns else c.crossJoin(F.broadcast(ctx))
    keep = rules.recent_overlap([F.col(f"m{k}") for k in range(1, 11)]) & rules.not_all_cold(F.col("cold")) & rules.related(F.col("m1")) & rules.no_diagonal(F.col("m1"), F.col("m2"))
    if seed is not None:
        keep = keep & rules.not_rejected(F.lit(seed).cast("long"))
    return both.where(keep).select("step", *fb.B, "mask")


def rejection_library(spark: SparkSession, seed: int, draws: int = REJECTED_DRAWS) -> DataFrame:
    """Masks of random 6-subsets drawn with replacement, made distinct: the sampled form of the rejection."""
    balls = F.slice(F.shuffle(F.sequence(F.lit(1), F.lit(RED_MAX)), seed), 1, PICK)
    return spark.range(draws).select(fb.mask_from_array(balls).alias("mask")).distinct()


def not_in_library(combos: DataFrame, library: DataFrame) -> DataFrame:
    return combos.join(library, "mask", "left_anti")


def candidate_lines(kept: DataFrame, threshold: int = LISTED, all_of_them: bool = False) -> DataFrame:
    """(line_no, line): the passed combinations in ascending order, one a line, where they are fewer than ``threshold``; more only if asked for.

    kept are those of one step, at most some thousands.
    """
    w = Window.orderBy(*fb.B)
    n = kept.agg(F.count("*").alias("n"))
    rows = kept.select(*fb.B, F.row_number().over(w).alias("line_no")).crossJoin(F.broadcast(n))
    width = F.when(F.col("n") < threshold, F.format_string("%2d", "line_no")).otherwise(F.format_string("%3d", "line_no"))
    line = F.concat(F.lit("  组合 "), width, F.lit(": "), F.format_string(" ".join(["%02d"] * PICK), *fb.B))
    return rows.where(F.lit(all_of_them) | (F.col("n") < threshold)).select(F.col("line_no").cast("long").alias("line_no"), line.alias("line"))


def in_passed(combos: DataFrame, kept: DataFrame) -> DataFrame:
    return combos.join(kept.select("mask"), "mask", "left_semi")


def coverage7(kept: DataFrame, pool: DataFrame) -> DataFrame:
    """(step, mask7, coverage): each 7-set S with c passed 6-subsets comes from c pairs of a subset and its extra ball, so counting is enough."""
    extra = pool.select("step", fb.bit(F.col("ball")).alias("bit"))
    pairs = kept.select("step", "mask").join(F.broadcast(extra), "step").where(F.col("mask").bitwiseAND(F.col("bit")) == 0)
    return pairs.groupBy("step", F.col("mask").bitwiseOR(F.col("bit")).alias("mask7")).agg(F.count("*").alias("coverage"))


def mask_to_array(mask):
    return F.filter(F.sequence(F.lit(1), F.lit(RED_MAX)), lambda b: mask.bitwiseAND(fb.bit(b)) != 0)


def best7(coverage: DataFrame) -> DataFrame:
    """The 7-set with most coverage, ties to the lexicographically smallest."""
    return coverage.select("step", mask_to_array(F.col("mask7")).alias("reds"), "coverage").orderBy(F.desc("coverage"), "reds").limit(1)


def seeded_picks(kept: DataFrame, seed: int = 42, n: int = NUM_PICKS) -> DataFrame:
    """seeded_pick() of each step: kept with pick from 1."""
    key = (F.col("mask") * 31 + F.lit(seed).cast("long") * 1009) % 1000033
    return kept.withColumn("pick", F.row_number().over(Window.partitionBy("step").orderBy(key, "mask"))).where(F.col("pick") <= n)


def seeded_pick(kept: DataFrame, seed: int = 42, n: int = NUM_PICKS) -> DataFrame:
    """n combinations in an order that an arithmetic key sets, not the partitioning."""
    key = (F.col("mask") * 31 + F.lit(seed).cast("long") * 1009) % 1000033
    return kept.withColumn("pick_key", key).orderBy("pick_key", "mask").limit(n)
