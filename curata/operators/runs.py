"""Runs in a scan: a table function that keeps state over the rows of a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


def _register(spark: SparkSession) -> None:
    """The table function curata_runs(TABLE ... PARTITION BY ... ORDER BY ..., by => column, of => column)."""
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    @udtf
    class Runs:
        """A row for each run of equal values of a column: the group, the value, the run's place, start and length."""

        def __init__(self):
            self.run = None
            self.place = 0

        @staticmethod
        def analyze(rows: AnalyzeArgument, by: AnalyzeArgument, of: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in rows.dataType.fields}
            if by.value not in kinds or of.value not in kinds:
                raise ValueError(f"no column {by.value} or {of.value} in {list(kinds)}")
            fields = [StructField(by.value, kinds[by.value]), StructField(of.value, kinds[of.value])]
            return AnalyzeResult(StructType([*fields, StructField("run", IntegerType()), StructField("start", LongType()), StructField("length", LongType())]))

        def eval(self, row, by: str, of: str):
            group, value = row[by], row[of]
            if self.run is not None and self.run[1] == value:
                self.run[4] += 1
                return
            start = 0
            if self.run is not None:
                yield tuple(self.run)
                start = self.run[3] + self.run[4]
            self.run = [group, value, self.place, start, 1]
            self.place += 1

        def terminate(self):
            if self.run is not None:
                yield tuple(self.run)

    spark.udtf.register("curata_runs", Runs)


def runs(rows: DataFrame, by: str, order: list[str], of: str) -> DataFrame:
    """by, of, run (from 0), start (place of its first row in the group, from 0) and length of every run of equal values
    of ``of`` in the scan order of a group. State is one run, so a group of any length passes through; null equals null."""
    spark = rows.sparkSession
    _register(spark)
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    view = f"__runs_{id(rows)}"
    rows.createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT * FROM curata_runs(TABLE({view}) PARTITION BY {quoted(by)} ORDER BY ({', '.join(map(quoted, order))}), '{by}', '{of}')")
    finally:
        spark.catalog.dropTempView(view)
