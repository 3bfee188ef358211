"""Window and time-series verbs over an ordered array: in-row forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import mean, present
from .values import elements, field_of, integer, let, numbers, verb


def _steps(ctx, n, default=1) -> Column:
    if n is None:
        return F.lit(default)
    k = integer(ctx, n)
    return F.lit(k) if isinstance(k, int) else k


@verb("rowNumber")
def row_number(ctx, array=None):
    """Objects with `_rowNum` (from 1) before their fields; other values as {_rowNum, value}."""
    if array is None:
        return ctx.sequence if ctx.sequence is not None else F.lit(0).cast("long")
    values, t = elements(ctx, array)
    rest = (lambda x: [x[n].alias(n) for n in t.names]) if isinstance(t, T.StructType) else (lambda x: [x.alias("value")])
    return F.transform(values, lambda x, i: F.struct((i + 1).alias("_rowNum"), *rest(x)))


@verb("rank")
def rank(ctx, array, name=None, direction=None):
    """Competition rank (1, 2, 2, 4) as `_rank` after the fields, descending unless `asc`."""
    values, t = elements(ctx, array)
    up = direction is not None and str(ctx.value(direction)).lower() == "asc"
    plain = not isinstance(t, T.StructType)
    key = (lambda x: x.try_cast("double")) if plain else (lambda x: field_of(x, t, str(ctx.value(name)))[0].try_cast("double"))
    rest = (lambda x: [x.alias("value")]) if plain else (lambda x: [x[n].alias(n) for n in t.names])
    keys = F.transform(values, key)
    return let(keys, lambda ks: F.transform(values, lambda x: F.struct(*rest(x), (F.size(F.filter(ks, lambda k: k < key(x) if up else k > key(x))) + 1).alias("_rank"))))


def _moved(values: Column, steps: Column, fill: Column) -> Column:
    """Each element becomes the one `steps` before it."""
    n = F.size(values)
    return F.transform(values, lambda _, i: F.when((i - steps >= 0) & (i - steps < n), F.get(values, (i - steps).cast("int"))).otherwise(fill))


def _fill(ctx, array, default) -> Column:
    return F.lit(None).cast(elements(ctx, array)[1]) if default is None else default.cast(elements(ctx, array)[1])


@verb("lag")
def lag(ctx, array, n=None, default=None):
    return _moved(elements(ctx, array)[0], F.greatest(_steps(ctx, n), F.lit(1)), _fill(ctx, array, default))


@verb("lead")
def lead(ctx, array, n=None, default=None):
    return _moved(elements(ctx, array)[0], -F.greatest(_steps(ctx, n), F.lit(1)), _fill(ctx, array, default))


@verb("shift")
def shift(ctx, array, n=None, fill=None):
    return _moved(elements(ctx, array)[0], _steps(ctx, n), _fill(ctx, array, fill))


def _running(values: Column, start: float, join) -> Column:
    """Running value; null elements give null and leave it as it is."""
    first = F.struct(F.array().cast("array<double>").alias("out"), F.lit(start).alias("v"))
    step = lambda s, x: F.struct(F.array_append(s["out"], F.when(x.isNotNull(), join(s["v"], x))).alias("out"), F.coalesce(join(s["v"], x), s["v"]).alias("v"))
    return F.aggregate(values, first, step, lambda s: s["out"])


@verb("cumsum")
def cumsum(ctx, array):
    return _running(numbers(ctx, array), 0.0, lambda a, x: a + x)


@verb("cumprod")
def cumprod(ctx, array):
    return _running(numbers(ctx, array), 1.0, lambda a, x: a * x)


@verb("diff")
def diff(ctx, array, n=None):
    values = numbers(ctx, array)
    steps = F.greatest(_steps(ctx, n), F.lit(1))
    return let(values, lambda v: F.transform(v, lambda x, i: F.when(i >= steps, x - F.get(v, (i - steps).cast("int")))))


@verb("pctChange")
def pct_change(ctx, array, n=None):
    steps = F.greatest(_steps(ctx, n), F.lit(1))
    base = lambda v, i: F.get(v, (i - steps).cast("int"))
    return let(numbers(ctx, array), lambda v: F.transform(v, lambda x, i: F.when(i >= steps, F.try_divide(x - base(v, i), base(v, i)))))


@verb("movingAvg")
def moving_avg(ctx, array, n):
    size = F.greatest(_steps(ctx, n), F.lit(1))
    values = F.transform(numbers(ctx, array), lambda x: F.coalesce(x, F.lit(0.0)))
    return let(values, lambda v: F.transform(v, lambda _, i: mean(F.slice(v, F.greatest(i - size + 2, F.lit(1)).cast("int"), F.least(i + 1, size).cast("int")))))


@verb("window")
def window(ctx, array, n):
    values, size = elements(ctx, array)[0], _steps(ctx, n)
    fits = (size > 0) & (F.size(values) >= size)
    return F.when(fits, F.transform(F.sequence(F.lit(1), F.greatest(F.size(values) - size + 1, F.lit(1)).cast("int")), lambda i: F.slice(values, i, size.cast("int")))).otherwise(F.array().cast(T.ArrayType(ctx.type(values))))


@verb("fillMissing")
def fill_missing(ctx, array, fill=None, strategy=None):
    """Nulls by a value, or `forward`, `backward` or `mean`; what a strategy cannot fill takes the value."""
    values, t = elements(ctx, array)
    value = F.lit(None).cast(t) if fill is None or isinstance(ctx.type(fill), T.NullType) else fill.cast(t)
    how = str(ctx.value(strategy, "value")).lower() if strategy is not None else "value"
    if how == "mean":
        return let(mean(present(numbers(ctx, array))), lambda m: F.transform(values, lambda x: F.coalesce(x, m.cast(t), value)))
    if how == "forward":
        near = lambda i: F.try_element_at(present(F.slice(values, F.lit(1), i + 1)), F.lit(-1))
    elif how == "backward":
        near = lambda i: F.get(present(F.slice(values, i + 1, F.size(values))), 0)
    else:
        return F.transform(values, lambda x: F.coalesce(x, value))
    return F.transform(values, lambda x, i: F.coalesce(x, near(i), value))


