"""Whole runs: analysing a history into a report file, and settling a report file against a draw file."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.operators import backtest, combos, scoring, settle
from ballast.schema import BACKTEST_STEPS, Params
from ballast.sources import files, readers, reports, store


def ingest_files(spark: SparkSession, root: str, text_path: str, html_path: str, range_rows: int = store.RANGE_ROWS) -> store.Version | None:
    """Merges landed text histories and web pages into the store of draws at ``root``: text over pages over what is stored, whole rows.

    Later lines and rows win within a kind, files by name. Either kind may be missing; with nothing new the store stays as it is.
    """
    found = []
    if files.exists(spark, html_path):
        pages = readers.in_file_order(spark.read.text(html_path, wholetext=True)).withColumnRenamed("value", "html").select("html", "file", F.lit(0).cast("long").alias("seq"))
        found.append(readers.parse_html(pages, numbered="seq").withColumn("draw_date", F.lit(None).cast("string")).withColumn("priority", F.lit(1)))
    if files.exists(spark, text_path):
        found.append(readers.parse_lines(readers.in_file_order(spark.read.text(text_path))).withColumn("priority", F.lit(2)))
    if not found:
        return store.version(spark, root)
    columns = ["issue", "draw_date", "reds", "blue", "priority", "file", "seq"]
    new = found[0].select(columns) if len(found) == 1 else found[0].select(columns).unionByName(found[1].select(columns))
    return store.merge(spark, root, new, "issue", ["priority", "file", "seq"], range_rows)


@dataclass
class Analysis:
    """What a report says: some dozens of values."""

    picks: list[list[int]]
    best7: list[int] | None
    blues: list[int]
    tiers: list[tuple[str, int]]
    profit: int
    periods: int

    def text(self, basis: str, params: Params, loaded: bool, now: datetime) -> str:
        return reports.analysis_report(basis, params, loaded, self.periods, self.profit, self.tiers, self.picks, self.blues[0] if self.blues else None, self.best7, self.blues, now)


def analyse(spark: SparkSession, draws: DataFrame, step: int, params: Params, periods: int = BACKTEST_STEPS, scorer=None) -> Analysis:
    """Scores, picks and coverage from the draws before ``step``, and the backtest of as many steps before it; draws are a table with positions."""
    stats = files.materialised(spark, scoring.ball_stats(spark, draws, params.decay_factor, step, step), "stats")
    probs = (scorer or scoring.SqlScorer()).probabilities(spark, draws, step, step)
    rank = files.materialised(spark, scoring.ranked(scoring.scores(stats, probs, params)), "rank")
    pool = scoring.red_pool(rank)
    kept = files.materialised(spark, combos.passed_of_pool(pool, combos.context(draws, stats)), "kept")
    picks = [[r[b] for b in fb.B] for r in combos.seeded_pick(kept).collect()]
    best = combos.best7(combos.coverage7(kept, pool)).collect()
    blues = [r.ball for r in scoring.blue_pool(rank).orderBy("rn").collect()]
    bets = backtest.backtest(spark, draws.where(F.col("idx") < step), params, step, periods, scorer) if periods else None
    if bets is None:
        return Analysis(picks, best[0].reds if best else None, blues, [], 0, 0)
    bets = files.materialised(spark, bets, "bets")
    tiers = [(r.tier, r.n) for r in settle.tier_rollup(settle.prize_counts(bets)).orderBy("tier_rank").collect()]
    return Analysis(picks, best[0].reds if best else None, blues, tiers, settle.profit(bets).first().profit, periods)


def analyse_steps(spark: SparkSession, draws: DataFrame, first: int, last: int, params: Params, periods: int = BACKTEST_STEPS, scorer=None, seed: int = 42) -> DataFrame:
    """What analyse() finds, a row a step first..last: (step, basis, profit, tiers, picks, blues, best7), in one plan.

    A step's backtest is made of the bets of the ``periods`` steps before it. Each step's bets are the same in whichever backtest they
    count, so they are settled once and summed over a window of steps.
    """
    stats = files.materialised(spark, scoring.ball_stats(spark, draws, params.decay_factor, first - periods, last), "stats")
    probs = (scorer or scoring.SqlScorer()).probabilities(spark, draws, first - periods, last)
    rank = files.materialised(spark, scoring.ranked(scoring.scores(stats, probs, params)), "rank")
    pool = scoring.red_pool(rank)
    kept = files.materialised(spark, combos.passed_of_pool(pool, combos.context(draws, stats), seed), "kept")
    shown = kept.where(F.col("step") >= first)
    picks = combos.seeded_picks(shown, seed).groupBy("step").agg(F.sort_array(F.collect_list(F.struct("pick", F.array(*fb.B).alias("reds")))).alias("p"))
    best = combos.coverage7(shown, pool).groupBy("step").agg(F.min(F.struct((-F.col("coverage")).alias("c"), combos.mask_to_array(F.col("mask7")).alias("reds"))).alias("b"))
    blues = scoring.blue_pool(rank).groupBy("step").agg(F.sort_array(F.collect_list(F.struct("rn", "ball"))).alias("u"))
    top = rank.where("color = 'blue' AND rn = 1").select("step", F.col("ball").alias("blue"))
    results = draws.where(F.col("idx").between(first - periods, last - 1)).select(F.col("idx").alias("step"), "mask", "blue")
    settled = settle.settle_single(kept.where(F.col("step") < last).join(F.broadcast(top), "step"), results, on="step")  # a row a step
    won = settled.groupBy("step", "tier", "tier_rank").agg(F.count("*").alias("n"), (F.sum("prize") - settle.COST * F.count("*")).alias("profit"))
    # each step counts for the periods that follow it
    later = won.select("tier", "tier_rank", "n", "profit", F.explode(F.sequence(F.col("step") + 1, F.col("step") + periods)).alias("step")).where(F.col("step").between(first, last))
    sums = later.groupBy("step", "tier", "tier_rank").agg(F.sum("n").alias("n"), F.sum("profit").alias("profit"))
    tiers = F.filter(F.sort_array(F.collect_list(F.struct("tier_rank", "tier", "n"))), lambda x: x["tier_rank"].isNotNull())
    back = sums.groupBy("step").agg(F.sum("profit").alias("profit"), tiers.alias("tiers"))
    basis = draws.select((F.col("idx") + 1).alias("step"), F.col("issue").cast("string").alias("basis")).where(F.col("step").between(first, last))
    out = basis
    for part in (back, picks, blues, best):
        out = out.join(part, "step", "left")
    empty = F.array().cast("array<int>")
    return out.select(
        "step", "basis", F.coalesce("profit", F.lit(0)).alias("profit"), F.coalesce("tiers", F.array().cast("array<struct<tier_rank:int,tier:string,n:bigint>>")).alias("tiers"),
        F.coalesce(F.col("p.reds"), F.array().cast("array<array<int>>")).alias("picks"), F.coalesce(F.col("u.ball"), empty).alias("blues"), F.coalesce(F.col("b.reds"), empty).alias("best7"),
    )


def settle_reports(lines: DataFrame, draws: DataFrame) -> DataFrame:
    """The bets of every report (path, line_no, line) against the draw that it targets: (path, issue, kind, line_no, red_hits, blue_hits, tier, ways, prize)."""
    target = lines.select("path", "line_no", F.regexp_extract("line", reports.TARGET, 1).alias("issue")).where("issue <> ''").groupBy("path").agg(F.min_by("issue", "line_no").alias("issue"))
    bets = reports.parse_bets(lines).join(target, "path").withColumn("mask", fb.mask_from_array(F.col("reds")))
    won = draws.select(F.col("issue").cast("string").alias("issue"), "mask", "blue")
    shown = ["path", "issue", "kind", "line_no", "red_hits", "blue_hits", "tier", "ways", "prize"]
    one = settle.settle_single(bets.where("kind = 'single'").withColumn("blue", F.get("blues", F.lit(0))), won, on="issue").withColumn("blue_hits", F.col("blue_hit")).withColumn("ways", F.lit(1).cast("long"))
    many = settle.settle_duplex(bets.where("kind = 'duplex'").select("path", "issue", "kind", "line_no", "mask", "blues"), won, on="issue")
    return one.select(shown).unionByName(many.select(shown))


def settle_files(spark: SparkSession, draw_csv: str, report_glob: str) -> tuple[DataFrame, dict]:
    """The bets of the newest report for the latest draw, settled: (kind, bet, reds, blues, red_hits, blue_hits, tier, tier_rank, ways, prize), and what was settled.

    The latest draw is the one with the greatest issue. Raises ValueError where the draws are
    none, no report targets the issue, or the report lacks either kind of bet.
    """
    drawn = readers.read_draws(spark, draw_csv).where("issue IS NOT NULL AND blue IS NOT NULL")
    last = drawn.orderBy(F.desc("issue")).limit(1).collect()
    if not last:
        raise ValueError(f"no draws in {draw_csv}")
    issue = str(last[0].issue)
    lines = reports.read_report_lines(spark, report_glob) if files.exists(spark, report_glob) else None
    found = reports.matching_report(lines, issue).collect() if lines is not None else []
    if not found:
        raise ValueError(f"no report for issue {issue} in {report_glob}")
    # one report's bets: a dozen rows
    bets = reports.parse_bets(lines.where(F.col("path") == found[0].path)).orderBy("line_no").collect()
    singles, duplex = ([b for b in bets if b.kind == k] for k in ("single", "duplex"))
    if not singles or not duplex:
        raise ValueError(f"no bets in {found[0].path}")
    frame = spark.createDataFrame([(kind, i, sorted(b.reds), b.blues) for kind, rows in (("single", singles), ("duplex", duplex[:1])) for i, b in enumerate(rows, 1)], "kind string, bet int, reds array<int>, blues array<int>")
    frame = frame.withColumn("mask", fb.mask_from_array(F.col("reds")))
    win = spark.createDataFrame([(last[0].reds, last[0].blue)], "reds array<int>, blue int").select(fb.mask_from_array(F.col("reds")).alias("mask"), "blue")
    shown = ["kind", "bet", "reds", "blues", "red_hits", "blue_hits", "tier", "tier_rank", "ways", "prize"]
    one = settle.settle_single(frame.where("kind = 'single'").withColumn("blue", F.get("blues", F.lit(0))), win).withColumn("blue_hits", F.col("blue_hit")).withColumn("ways", F.lit(1).cast("long"))
    many = settle.settle_duplex(frame.where("kind = 'duplex'"), win)
    return one.select(shown).unionByName(many.select(shown)), {"issue": issue, "reds": list(last[0].reds), "blue": last[0].blue, "report": found[0].path.rsplit("/", 1)[-1], "duplex": (sorted(duplex[0].reds), list(duplex[0].blues))}


def settlement_text(settled: DataFrame, about: dict, now: datetime) -> str:
    """The settlement report of settle_files()'s rows."""
    rows = settled.orderBy("bet", "tier_rank").collect()
    singles = [(r.reds, r.blues[0], f"命中{r.red_hits}+{r.blue_hits}", r.tier, r.prize) for r in rows if r.kind == "single"]
    many, (reds, blues) = [r for r in rows if r.kind == "duplex"], about["duplex"]
    duplex = {"reds": reds, "blues": blues, "red_hits": len(set(reds) & set(about["reds"])), "blue_hits": int(about["blue"] in blues), "tiers": [(r.tier_rank, r.tier, r.ways) for r in many], "prize": sum(r.prize for r in many)}
    return reports.settlement_report(about["report"], about["issue"], about["reds"], about["blue"], singles, duplex, now)


def settle_to_file(spark: SparkSession, draw_csv: str, report_glob: str, folder: str, now: datetime) -> str:
    """Settles and writes the settlement report into ``folder``; returns its path."""
    return files.write_text(spark, settlement_text(*settle_files(spark, draw_csv, report_glob), now), f"{folder}/{reports.SETTLEMENT_NAME.format(now=now)}")


def analyse_to_file(spark: SparkSession, analysis: Analysis, basis: str, params: Params, loaded: bool, folder: str, now: datetime) -> str:
    """Writes the analysis report into ``folder``; returns its path."""
    return files.write_text(spark, analysis.text(basis, params, loaded, now), f"{folder}/{reports.ANALYSIS_NAME.format(now=now)}")
