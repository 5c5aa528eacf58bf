"""Row and column operators, groups, windows and sets with the checks the cleaning steps rely on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import in_order


class MissingColumnError(ValueError):
    """A named column isn't in the table."""


class EmptyListError(ValueError):
    """No table was given."""


def check(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumnError(f"not in the table: {', '.join(missing)}")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    check(df, columns)
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    check(df, columns)
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Names that aren't there are passed over."""
    return df.withColumnsRenamed(dict(names))


def filter_by_value(df: DataFrame, columns: Sequence[str], invalid: str = "-") -> DataFrame:
    """Rows whose columns all differ from the sentinel; null columns drop the row."""
    check(df, columns)
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) != invalid for c in columns]))


def replace_pattern(df: DataFrame, columns: Sequence[str], pattern: str, replacement: str = "") -> DataFrame:
    check(df, columns)
    return df.withColumns({c: F.regexp_replace(c, pattern, replacement) for c in columns})


def split_column(df: DataFrame, column: str, first: str, second: str, separator: str = r"\|") -> DataFrame:
    check(df, [column])
    parts = F.split(column, separator)
    return df.withColumns({first: F.get(parts, F.lit(0)), second: F.get(parts, F.lit(1))})


def concatenate_columns(df: DataFrame, columns: Sequence[str], new: str, delimiter: str) -> DataFrame:
    check(df, columns)
    return df.withColumn(new, F.concat_ws(delimiter, *columns))


def column_has_nulls(df: DataFrame, column: str) -> bool:
    check(df, [column])
    return not df.filter(F.col(column).isNull()).select(column).limit(1).isEmpty()


#: Aggregates by name; `list` gathers values.
AGGREGATES = {"list": F.collect_list, "set": F.collect_set, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "avg": F.avg, "first": F.first, "nunique": F.count_distinct, "median": F.median, "std": F.stddev_samp}


def groupby_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Columns are named column_function. Rows with null keys form groups."""
    check(df, [*keys, *aggregates])
    wanted = [(c, f) for c, fs in aggregates.items() for f in ([fs] if isinstance(fs, str) else fs)]
    if unknown := [f for _, f in wanted if f not in AGGREGATES]:
        raise ValueError(f"unknown aggregates: {unknown}")
    return df.groupBy(*keys).agg(*(AGGREGATES[f](c).alias(f"{c}_{f}") for c, f in wanted))


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, by column name; a column that a table lacks is null there."""
    if not frames:
        raise EmptyListError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first in a total order."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """Spark cuts each task's rows to n for each key before they are dealt (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def dense_index(df: DataFrame, column: str, name: str = "index", by: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct strings and their places in ascending order, gapless from 0, without sorting all in one task.

    Values are range-partitioned, numbered inside their part and moved up by the values of the parts before; that table
    has a row for each part. The parts are stored, so an index that is used twice is made once. by: values of another
    type, in the order of the texts that this makes of them, which differ; the texts are not stored.
    """
    order = (by or (lambda c: c))(F.col(column))
    values = df.select((F.col(column) if by else F.col(column).cast("string")).alias(column)).dropna().distinct()
    placed = in_order(values, order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return placed.withColumn("_row", row).join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_row") - 1).cast("long").alias(name))


def encode(df: DataFrame, column: str, mapping: DataFrame, key: str, index: str, new: str, missing: int | None = None) -> DataFrame:
    """Left join to an id table; an id that isn't there gets `missing` (null by default)."""
    m = mapping.select(F.col(key).alias("_key"), F.col(index).alias(new))
    out = df.join(m, df[column] == m["_key"], "left").drop("_key")
    return out if missing is None else out.withColumn(new, F.coalesce(new, F.lit(missing)))


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose keys aren't there yet, one for each key. Null key parts are equal to each other."""
    one = new.dropDuplicates(list(keys))
    there = existing.select(*(F.col(k).alias(f"_there_{k}") for k in keys)).distinct()
    same = [one[k].eqNullSafe(F.col(f"_there_{k}")) for k in keys]
    return one.join(there, same, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new rows, and those of the existing whose keys aren't among them."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def where(df: DataFrame, columns: Sequence[str] = (), filters: Mapping[str, object] | None = None, order: Sequence[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Equality filters, order, offset and limit, with a check of the column names."""
    check(df, [*columns, *(filters or {}), *order])
    for c, v in (filters or {}).items():
        df = df.filter(F.col(c) == F.lit(v))
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns) if columns else df


def lookup_in_order(keys: DataFrame, table: DataFrame, key: str, *, strict: bool = False) -> DataFrame:
    """keys with the table's other columns, null where the key isn't there; strict: that raises. Places stay in the keys' own columns."""
    out = keys.join(table.withColumn("_there", F.lit(True)), key, "left")
    if strict and not (lost := out.filter("_there is null").select(key).limit(1)).isEmpty():
        raise KeyError(lost.first()[0])
    return out.drop("_there")
