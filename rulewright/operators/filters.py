"""Row filters of label preparation, and small reshapes of nested values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions import scores


def half_open(c: Column, lo: float, hi: float) -> Column:
    """lo <= c < hi."""
    return (c >= lo) & (c < hi)


def large_enough(size: Column, least: int, split: Column, exempt: str = "test") -> Column:
    """Both sides of a nested size reach the least; rows of the exempt split always pass."""
    return (split == exempt) | ((size["width"] >= least) & (size["height"] >= least))


def drop_all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows in which every one of the columns is null."""
    return df.na.drop("all", subset=columns)


def drop_any_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without rows in which any of the columns is null; all columns by default."""
    return df.na.drop("any", subset=columns)


def any_given(columns: list[str], missing: int = -1) -> Column:
    """Whether at least one of the columns is not the missing mark; a null is not a value."""
    return F.exists(F.array(*columns), lambda x: F.coalesce(x != missing, F.lit(False)))


def few_or_older(flags: Column, most: int, age: Column, older: int = 40) -> Column:
    """Fewer flags than the bound, or an age above another; the age may be a text such as ``30s``."""
    return F.coalesce(flags < most, F.lit(False)) | F.coalesce(scores.first_integer(age) > older, F.lit(False))


def given_equal(**wanted: object) -> Column:
    """Equality for every parameter that is given; a parameter of None asks for nothing."""
    return reduce(lambda a, b: a & b, (F.col(c) == v for c, v in wanted.items() if v is not None), F.lit(True))


def counted_names(items: Column, sep: str = ",") -> Column:
    """Number of nested items and their joined names; none for null."""
    return F.struct(F.coalesce(F.size(items), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform(items, lambda i: i["name"]), sep), F.lit("")).alias("names"))


def expand_paths(df: DataFrame, sides: list[str], pattern: str, to: str, out: str = "path") -> DataFrame:
    """One row for each source path that the side paths lead back to; sides that agree give one row, rows without any give none."""
    back = [F.regexp_replace(c, pattern, to) for c in sides]
    return df.withColumn(out, F.explode(F.array_distinct(F.array_compact(F.array(*back)))))


def lookup_or_error(c: Column, table: dict[str, str]) -> Column:
    """Looked-up ``value``, or an ``error`` that names the unknown key."""
    value = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)
    return F.struct(value.alias("value"), F.when(value.isNull(), F.concat(F.lit("unknown: "), F.coalesce(c, F.lit("null")))).alias("error"))
