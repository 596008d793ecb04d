"""Reports as lines: finding one, reading its bets, and rendering both kinds."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.schema import Params

#: Section headers; the last takes either form.
SINGLE_HEADER, DUPLEX_HEADER = "【单式推荐 (10组)】", "^【7\\+(7|N) 复式推荐 \\(1组\\)】"
#: Names of report files; readers take any pattern.
ANALYSIS_NAME, SETTLEMENT_NAME = "analysis_output_{now:%Y%m%d_%H%M%S}.txt", "bonus_check_{now:%Y%m%d_%H%M%S}.txt"
TARGET = "^Prediction_Target_Issue:\\s*(.*?)\\s*$"


def read_report_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(path, line_no, line) of each report; a report is some tens of lines."""
    text = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return text


def matching_report(lines: DataFrame, issue: str) -> DataFrame:
    """(path, target) of the newest report by name whose first target line is ``issue``, as text."""
    found = lines.select("path", "line_no", F.regexp_extract("line", TARGET, 1).alias("target")).where("target <> ''")
    first = found.groupBy("path").agg(F.min_by("target", "line_no").alias("target"))
    return first.where(F.col("target") == F.lit(issue)).orderBy(F.desc("path")).limit(1)


def parse_bets(lines: DataFrame) -> DataFrame:
    """(path, line_no, kind, reds, blues): single bets by line; of the multi-number bet its red and its blue line as one row.

    A line that does not parse is skipped.
    """
    w = Window.partitionBy("path").orderBy("line_no")  # the lines of one report
    begins = lambda *marks: reduce(lambda a, b: a | b, (F.startswith("line", F.lit(m)) for m in marks))
    # a cheap test first: patterns meet only lines that can match
    section = F.when(begins(SINGLE_HEADER), "single").when(begins("【7+") & F.col("line").rlike(DUPLEX_HEADER), "duplex").when(begins("---", "==="), "none")
    named = lambda ball: F.contains("line", F.lit(ball))
    text = lambda ball: F.when(named(ball), F.nullif(F.regexp_extract("line", f"{ball}:?\\s*\\[(.*?)\\]", 1), F.lit("")))
    # all other lines say nothing, and what meets its section is a line's numbers
    telling = lines.where(begins(SINGLE_HEADER, "【7+", "---", "===") | named("红球") | named("蓝球"))
    s = telling.select("path", "line_no", section.alias("section"), text("红球").alias("reds"), text("蓝球").alias("blues"))
    s = s.withColumn("section", F.last("section", ignorenulls=True).over(w)).where("section IN ('single', 'duplex') AND (reds IS NOT NULL OR blues IS NOT NULL)")
    numbers = lambda c: F.transform(F.split(c, ",\\s*"), lambda x: F.trim(x).try_cast("int")).alias(c)
    s = s.select("path", "line_no", "section", numbers("reds"), numbers("blues"))
    clean = lambda c: F.forall(c, lambda x: x.isNotNull())
    s = s.where((F.col("reds").isNull() | clean("reds")) & (F.col("blues").isNull() | clean("blues")))
    single = s.where("section = 'single' AND reds IS NOT NULL AND blues IS NOT NULL").select("path", "line_no", F.lit("single").alias("kind"), "reds", "blues")
    duplex = s.where("section = 'duplex'").groupBy("path").agg(F.min("line_no").alias("line_no"), F.first("reds", True).alias("reds"), F.first("blues", True).alias("blues")).where("reds IS NOT NULL AND blues IS NOT NULL")
    return single.unionByName(duplex.select("path", "line_no", F.lit("duplex").alias("kind"), "reds", "blues"))


#: Wording and layout of the two reports and of their repeated lines.
ANALYSIS = """\
============================================================
          双色球策略分析与推荐报告 (高级过滤版)
============================================================

--- 0. 报告元数据 ---
Data_Basis_Issue: {basis}
Prediction_Target_Issue: {target}
报告生成时间: {now:%Y-%m-%d %H:%M:%S}

--- 1. 策略参数与回测 ---
模式: {mode}
{params}

该策略在历史回测 ({periods}期) 中的模拟总利润为: {profit:.2f} 元
中奖详情如下：
{tiers}

--- 2. 推荐组合 ---

【单式推荐 (10组)】
{picks}

【7+N 复式推荐 (1组)】
{wide}

============================================================
报告结束。祝您好运！
============================================================"""
MODES = {True: "加载已固化的参数", False: "使用内置的默认参数"}
PARAM_LINE, TIER_LINE, NO_TIER = "  - {0:<20}: {1}", "  - {0:<5}: {1} 次", "  - 未中任何奖项。"
PICK_LINE, NO_PICK = "  组合 {0:>2}: 红球 {1:<24} 蓝球 [{2:02d}]", "  - 未能生成足够的单式组合。"
WIDE_LINES, NO_WIDE = "  红球: {0}\n  蓝球: {1}", "  - 未能生成足够的复式组合。"
SETTLEMENT = """\
======================================================================
          双色球推荐核对报告
======================================================================

报告生成时间: {now:%Y-%m-%d %H:%M:%S}
核对报告文件: {name}
核对开奖期数: {issue}
官方开奖号码: 红球 {reds}  蓝球 [{blue}]

--- 1. 单式推荐核对详情 ---
{singles}

单式推荐总奖金: {first} 元

--- 2. 复式推荐核对详情 ---
  红球: {wide_reds}
  蓝球: {wide_blues}
  核对结果: 总计命中 {red_hits} 个红球, {blue_hits} 个蓝球
  奖项构成:{tiers}

复式推荐总奖金: {second} 元

----------------------------------------------------------------------
总计中奖金额: {total} 元
======================================================================"""
SETTLED_LINE, WON_LINE, NONE_WON = "  组合 {0:>2}: {1:<24} 蓝球 [{2:02d}] -> {3}, {4}, 奖金: {5} 元", "\n    - {0}: {1} 注", " 未中任何奖项。"


def analysis_report(basis: str, params: Params, loaded: bool, periods: int, profit: float, tiers: list[tuple[str, int]], picks: list[list[int]], top_blue: int | None, best7: list[int] | None, blues: list[int], now: datetime) -> str:
    """The analysis report's text from results that are a few dozen values."""
    lines = lambda line, rows, none: "\n".join(line.format(*r) for r in rows) or none
    return ANALYSIS.format(
        basis=basis, target=next_issue_of(basis), now=now, mode=MODES[loaded], periods=periods, profit=profit,
        params=lines(PARAM_LINE, params.shown().items(), ""),
        tiers=lines(TIER_LINE, [t for t in tiers if t[1]], NO_TIER),
        picks=lines(PICK_LINE, [(i, str([*p]), top_blue) for i, p in enumerate(picks, 1)], NO_PICK),
        wide=WIDE_LINES.format([*best7], blues) if best7 and blues else NO_WIDE,
    )


def list_text(numbers: Column) -> Column:
    """Numbers as the reports write lists."""
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", "), F.lit("]"))


def _laid_out(template: str, values: dict[str, Column]) -> Column:
    """A template's text with columns in place of its fields."""
    return F.concat(*(x for text, name, _, _ in Formatter().parse(template) for x in (F.lit(text), *([values[name]] if name else []))))


def analysis_texts(results: DataFrame, params: Params, loaded: bool, periods: int, now: datetime) -> DataFrame:
    """results with ``text``, the analysis report of each row: the layout of analysis_report() as expressions, for any number of reports.

    results: basis (string), profit, tiers (array of tier, n in order), picks (array of arrays), blues, best7 (arrays).
    """
    lines = lambda rows, line, none: F.coalesce(F.nullif(F.array_join(F.transform(rows, line), "\n"), F.lit("")), F.lit(none))
    blue = F.lpad(F.get("blues", F.lit(0)).cast("string"), 2, "0")
    tier = lambda t: F.concat(F.lit("  - "), F.rpad(t["tier"], 5, " "), F.lit(": "), t["n"].cast("string"), F.lit(" 次"))
    pick = lambda p, i: F.concat(F.lit("  组合 "), F.lpad((i + 1).cast("string"), 2, " "), F.lit(": 红球 "), F.rpad(list_text(p), 24, " "), F.lit(" 蓝球 ["), blue, F.lit("]"))
    wide = F.when((F.size("best7") > 0) & (F.size("blues") > 0), F.concat(F.lit("  红球: "), list_text(F.col("best7")), F.lit("\n  蓝球: "), list_text(F.col("blues")))).otherwise(F.lit(NO_WIDE))
    fixed = {"now": f"{now:%Y-%m-%d %H:%M:%S}", "mode": MODES[loaded], "params": "\n".join(PARAM_LINE.format(*x) for x in params.shown().items()), "periods": str(periods)}
    values = {k: F.lit(v) for k, v in fixed.items()} | {
        "basis": F.col("basis"), "target": next_issue("basis"), "profit": F.format_string("%.2f", F.col("profit").cast("double")),
        "tiers": lines(F.col("tiers"), tier, NO_TIER), "picks": lines(F.col("picks"), pick, NO_PICK), "wide": wide,
    }
    return results.withColumn("text", _laid_out(ANALYSIS, values))


def write_texts(texts: DataFrame, folder: str) -> None:
    """``text`` of each row as a file of its own below ``folder``, named by ``basis``; tasks write them."""
    texts.select("basis", F.col("text").alias("value")).repartition("basis").write.mode("overwrite").partitionBy("basis").text(folder)


def next_issue_of(basis: str) -> str:
    """One more, with no roll-over of the year; text that is no number gets a suffix."""
    try:
        return str(int(basis) + 1)
    except ValueError:
        return f"{basis}_Next"


def next_issue(column):
    """The same as a column."""
    c = F.col(column).cast("string")
    return F.coalesce((c.try_cast("long") + 1).cast("string"), F.concat(c, F.lit("_Next")))


def settlement_report(report_name: str, issue: str, reds: list[int], blue: int, singles: list, duplex: dict, now: datetime) -> str:
    """singles: (reds, blue, hit_text, tier, prize); duplex: reds, blues, red_hits, blue_hits, tiers [(rank, tier, ways)], prize."""
    first = sum(s[4] for s in singles)
    return SETTLEMENT.format(
        now=now, name=report_name, issue=issue, reds=reds, blue=blue, first=first, second=duplex["prize"], total=first + duplex["prize"],
        singles="\n".join(SETTLED_LINE.format(i, str([*r]), *rest) for i, (r, *rest) in enumerate(singles, 1)),
        wide_reds=[*duplex["reds"]], wide_blues=[*duplex["blues"]], red_hits=duplex["red_hits"], blue_hits=duplex["blue_hits"],
        tiers="".join(WON_LINE.format(tier, ways) for _, tier, ways in sorted(duplex["tiers"])) or NONE_WON,
    )
