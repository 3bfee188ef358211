"""Twins of the array verbs over tables: the array is the table, its order a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.values import OPERATORS, coerced, literal_type, typed

#: Bytes up to which a lookup table is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def predicate(df: DataFrame, field: str, op: str, value, coercing: bool = False) -> Column:
    """field op value, by the comparators of the array verbs."""
    kind = OPERATORS.get(op, op if coercing and op in ("startsWith", "endsWith") else None)
    return (coerced if coercing else typed)(kind, F.col(field), df.schema[field].dataType, F.lit(value), literal_type(value)) if kind else F.lit(False)


def filter_rows(df: DataFrame, field: str, op: str, value) -> DataFrame:
    return df.filter(predicate(df, field, op, value))


def partition_rows(df: DataFrame, field: str, op: str, value) -> tuple[DataFrame, DataFrame]:
    test = predicate(df, field, op, value, coercing=True)
    return df.filter(test), df.filter(~test)


def dedupe(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order: a minimum per key, which combines before the shuffle."""
    whole = F.struct(*df.columns)
    first = df.groupBy(*(F.col(f).alias(f"__{f}") for f in fields)).agg(F.min_by(whole, F.struct(*order)).alias("__row"))
    return first.select("__row.*")


def group_items(df: DataFrame, field: str, order: list[str], items: list[str]) -> DataFrame:
    """key (text, `null` for none), first place, and the items in order. An array per key: keys must be of bounded size."""
    key = F.coalesce(F.col(field).cast("string"), F.lit("null"))
    return df.groupBy(key.alias("key")).agg(F.min(F.struct(*order)).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*items).alias("x")))), lambda s: s["x"]).alias("items"))


def count_by(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("null")).alias("key")).agg(F.count("*").alias("n"))


def key_by(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    """One row per key: the last in the order."""
    others = [c for c in df.columns if c != field]
    return df.groupBy(field).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x")).select(field, "x.*")


def top(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First n in order: each task keeps n rows."""
    return df.orderBy(*order).limit(n)


def drop_first(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """All rows but the first n in order. Only those n meet in one task; the rest are compared with the last of them.

    Rows that are equal in the whole order can stand for each other.
    """
    if n <= 0:
        return df
    parts = [o if isinstance(o, Column) else F.col(o) for o in order]
    first = df.orderBy(*parts).limit(n)
    counted = first.groupBy(*df.columns).agg(F.count("*").alias("__n")).withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(df.columns)})
    rows = df.withColumn("__k", F.xxhash64(*df.columns))
    counted = F.broadcast(counted.withColumn("__h", F.xxhash64(*(f"__c{i}" for i in range(len(df.columns))))))  # at most n rows
    same = F.col("__k") == F.col("__h")
    for i, c in enumerate(df.columns):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__c{i}"))
    joined = rows.join(counted, same, "left")
    free = joined.filter("__n IS NULL").select(*df.columns)
    # equal rows: as many stay as are beyond the first n
    whole = joined.filter("__n IS NOT NULL").groupBy(*df.columns).agg((F.count("*") - F.max("__n")).alias("__left")).filter("__left > 0")
    again = whole.withColumn("__x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__left")))).select(*df.columns)
    return free.unionByName(again)


def explode_field(df: DataFrame, field: str) -> DataFrame:
    """One row per element; rows with an empty or missing array stay, with null."""
    return df.select(*(F.explode_outer(field).alias(field) if c == field else c for c in df.columns))


def pivot_rows(df: DataFrame, group: list[str], key: str, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """A column per key, the last value winning; the keys are given, so that no extra pass finds them."""
    return df.groupBy(*group).agg(*(F.max_by(F.when(F.col(key) == k, F.col(value)), F.when(F.col(key) == k, F.struct(*order))).alias(k) for k in keys))


def unpivot_rows(df: DataFrame, ids: list[str], values: list[str], key: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, key, value)


def sample_rows(df: DataFrame, n: int, seed: int, by: list[str]) -> DataFrame:
    """n rows by the hash of their key with the seed: the same rows on any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *by), *by).limit(n)


def chunk_rows(df: DataFrame, size: int, group: list[str], order: list[str]) -> DataFrame:
    """Chunk number of each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def lookup(df: DataFrame, table: DataFrame, keys: dict[str, str], results: list[str], order: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join to the first matching row of a table (in its order), keys compared as texts, misses by the defaults.

    The table is broadcast only if the optimiser's size estimate is small.
    """
    right = dedupe(table.select(*dict.fromkeys([*keys.values(), *results, *order])), list(keys.values()), order)
    right = right.select(*(F.col(v).cast("string").alias(f"__k{i}") for i, v in enumerate(keys.values())), *(F.col(r).alias(f"__{r}") for r in results))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    right = F.broadcast(right) if size <= BROADCAST_BYTES else right
    test = [F.col(k).cast("string") == F.col(f"__k{i}") for i, k in enumerate(keys)]
    joined = df.join(right, test, "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(f"__{r}"), F.lit((defaults or {}).get(r))).alias(r) for r in results))


def window_columns(df: DataFrame, value: str, group: list[str], order: list[str]) -> DataFrame:
    """The time-series verbs as window functions over each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    whole = Window.partitionBy(*group)
    return df.select(
        "*", F.row_number().over(w).alias("row_num"), F.rank().over(Window.partitionBy(*group).orderBy(F.desc(value))).alias("rank_desc"),
        F.lag(v, 1).over(w).alias("lag_1"), F.lead(v, 1).over(w).alias("lead_1"), F.sum(v).over(so_far).alias("cumsum"), (v - F.lag(v, 1).over(w)).alias("diff_1"),
        F.try_divide(v - F.lag(v, 1).over(w), F.lag(v, 1).over(w)).alias("pct_change"), F.avg(F.coalesce(v, F.lit(0.0))).over(w.rowsBetween(-2, 0)).alias("moving_avg_3"),
        F.last(v, ignorenulls=True).over(so_far).alias("filled"), F.try_divide(v - F.avg(v).over(whole), F.nullif(F.stddev_pop(v).over(whole), F.lit(0.0))).alias("zscore"),
    )


def running_total(df: DataFrame, name: str, value: str, group: list[str], order: list[str], start: float = 0.0) -> DataFrame:
    """An accumulator over an ordered table; past the exact integers the last good value stays."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.lit(start) + F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(w)
    good = F.when(F.abs(total) <= 9007199254740991, total)
    return df.withColumn("__t", good).withColumn(name, F.coalesce(F.last("__t", ignorenulls=True).over(w), F.lit(start))).drop("__t")


def statistics(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """The statistical verbs as grouped aggregates; all combine before the shuffle but the exact quantiles."""
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(x).alias("sum_x"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.avg(x).alias("avg_x"), F.stddev_pop(x).alias("std_x"), F.stddev_samp(x).alias("std_sample_x"),
        F.var_pop(x).alias("var_x"), F.var_samp(x).alias("var_sample_x"), F.median(x).alias("median_x"), F.percentile(x, F.lit(0.9)).alias("p90_x"), F.covar_pop(x, y).alias("cov_xy"),
        F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).alias("corr_xy"), F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(y)).alias("weighted_xy"), F.count_distinct(x).alias("distinct_x"),
    )
