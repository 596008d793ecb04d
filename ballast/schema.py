"""Constants and small dimension tables of the draw engine."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RED_MAX, BLUE_MAX, PICK = 33, 16, 6
DROPPED_REDS, NUM_BLUES, NUM_PICKS = 16, 7, 10
WARM_UP, WINDOW = 5, 5
BACKTEST_STEPS, MIN_HISTORY = 50, 50
COST = 2
REJECTED_DRAWS = 500_000
#: Fewer passed combinations than this are listed without being asked for.
LISTED = 100

#: Fixed values: (red hits, blue hit, amount, tier, rank of the tier).
PRIZES = [
    (6, 1, 5_000_000, "一等奖", 1), (6, 0, 100_000, "二等奖", 2), (5, 1, 3_000, "三等奖", 3), (5, 0, 200, "四等奖", 4), (4, 1, 200, "四等奖", 4),
    (4, 0, 10, "五等奖", 5), (3, 1, 10, "五等奖", 5), (2, 1, 5, "六等奖", 6), (1, 1, 5, "六等奖", 6), (0, 1, 5, "六等奖", 6),
]
NO_PRIZE = "未中奖"

DRAW_CSV = T.StructType([T.StructField(n, T.StringType()) for n in ("issue", "draw_date", "reds", "blue")])
CSV_HEADER = ("期号", "日期", "红球", "蓝球")


@dataclass(frozen=True)
class Params:
    """Strategy weights; the six bonus keys are carried for the report only."""

    decay_factor: float = 0.995
    weight_freq: float = 0.3
    weight_omission: float = 0.4
    weight_ml: float = 0.3
    hot_lookback: float | None = None
    hot_threshold: float | None = None
    hot_bonus: float | None = None
    cold_lookback: float | None = None
    cold_bonus: float | None = None
    repeat_bonus: float | None = None
    weight_blue_freq: float = 0.5
    weight_blue_ml: float = 0.5

    @classmethod
    def load(cls, spark: SparkSession, path: str | None) -> tuple[Params, bool]:
        """Params from a JSON file and whether there was one; malformed JSON raises."""
        import json

        if path is None:
            return cls(), False
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return cls(), False
        text = spark.read.text(path, wholetext=True).first()[0]
        return cls(**json.loads(text)), True

    def shown(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


#: The strategy as it was tuned.
TUNED = Params(0.999, 0.3, 0.4, 0.3, 10, 2, 1.2, 30, 1.05, 1.15, 0.4, 0.6)


def prize_rules(spark: SparkSession) -> DataFrame:
    """10 rows, so a broadcast of it is bounded by construction."""
    return spark.createDataFrame(PRIZES, "red_hits int, blue_hit int, prize long, tier string, tier_rank int")


def combinations_dim(spark: SparkSession) -> DataFrame:
    """comb(n, k) for n up to 33 and k up to 6."""
    return spark.createDataFrame([(n, k, comb(n, k)) for n in range(RED_MAX + 1) for k in range(PICK + 1)], "n int, k int, ways long")
