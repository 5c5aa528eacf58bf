"""Table functions over chunks of rows: an Arrow UDTF and the delimited text it reads."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql import types as T


@udtf
class SplitFields:
    """split_fields(text, separator, names): a row for each line of the text, with the named fields as strings.

    names is a constant, a list joined by commas, and gives the columns. Quoted fields may hold the separator and line
    ends; a line with fewer fields has nulls, further ones are left out. A null text gives no row. What is held is one
    text's reader.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, separator: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not (names.isConstantExpression and separator.isConstantExpression):
            raise ValueError("separator and names must be constants")
        wanted = [x.strip() for x in names.value.split(",")]
        return AnalyzeResult(T.StructType([T.StructField("line", T.IntegerType()), *(T.StructField(x, T.StringType()) for x in wanted)]))

    def eval(self, text: str | None, separator: str, names: str) -> Iterator[tuple]:
        n = names.count(",") + 1
        for k, fields in enumerate(csv.reader(io.StringIO(text or ""), delimiter=separator)):
            yield (k, *(fields + [None] * n)[:n])


def register(spark: SparkSession) -> None:
    """Makes split_fields known to SQL: SELECT ... FROM t, LATERAL split_fields(t.text, ',', 'a, b')."""
    spark.udtf.register("split_fields", SplitFields)


def by_chunks(df: DataFrame, apply: Callable[[pa.Table], pa.Table], schema: str, rows: int = 10_000) -> DataFrame:
    """apply() to chunks of at most `rows` rows, one after the other in each task; the rows of a task aren't gathered."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - n)
                held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                if n == rows:
                    yield from apply(pa.Table.from_batches(held)).to_batches()
                    held, n = [], 0
        if held:
            yield from apply(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(task, schema)
