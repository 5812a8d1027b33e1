"""Time frames: the observed period, its grid and the boundary between training and evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TimeFrame:
    """start and end are inclusive grid dates; train_end separates training from evaluation."""

    start: date
    end: date
    granularity: int
    train_end: date

    def __post_init__(self):
        if not self.start <= self.end or self.granularity < 1:
            raise ValueError("a frame needs start <= end and a positive granularity")

    def grid(self, spark: SparkSession) -> DataFrame:
        """One row by grid date: d."""
        return spark.range(1).select(F.explode(F.sequence(F.lit(self.start), F.lit(self.end), F.make_dt_interval(F.lit(self.granularity)))).alias("d"))

    def floor(self, ts: Column) -> Column:
        """The grid date at or before ts."""
        days = F.datediff(ts.cast("date"), F.lit(self.start))
        return F.date_add(F.lit(self.start), (F.floor(days / self.granularity) * self.granularity).cast("int"))

    def stretched(self, factor: int) -> TimeFrame:
        """The frame with every distance from its start multiplied."""
        far = lambda d: self.start + (d - self.start) * factor
        return TimeFrame(self.start, far(self.end), self.granularity, far(self.train_end))


#: The two public data collections' frames.
WIKIPEDIA = TimeFrame(date(2003, 1, 4), date(2019, 9, 7), 7, date(2016, 5, 7))
SOCRATA = TimeFrame(date(2019, 11, 1), date(2020, 11, 1), 1, date(2020, 4, 30))

EVENTS = TimeFrame(date(2024, 1, 1), date(2024, 1, 30), 1, date(2024, 1, 21))
ORDERS = TimeFrame(date(1995, 1, 1), date(2001, 8, 5), 7, date(1999, 1, 3))
