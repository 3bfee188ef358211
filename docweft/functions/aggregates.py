"""Aggregates over arrays: in-row forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import _pred, fmt_type, last_wins
from .values import elements, field_of, is_numeric, lenient, let, num, numbers, verb


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values).cast("double"))


def spread(values: Column) -> Column:
    """Sum of squared distances from the mean."""
    return let(mean(values), lambda m: total(F.transform(values, lambda x: (x - m) * (x - m))))


@verb("sum")
def sum_(ctx, array):
    values, t = elements(ctx, array)
    if isinstance(t, T.IntegralType):
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0).cast("long")))
    return total(numbers(ctx, array)) if is_numeric(t) and not isinstance(t, T.DecimalType) else F.lit(0).cast("long")


@verb("count")
def count(ctx, array):
    return F.size(elements(ctx, array)[0])


@verb("min")
def min_(ctx, array):
    return F.array_min(numbers(ctx, array))


@verb("max")
def max_(ctx, array):
    return F.array_max(numbers(ctx, array))


@verb("avg")
def avg(ctx, array):
    return mean(present(numbers(ctx, array)))


@verb("first")
def first(ctx, array):
    return F.get(elements(ctx, array)[0], 0)


@verb("last")
def last(ctx, array):
    return F.try_element_at(elements(ctx, array)[0], F.lit(-1))


@verb("countBy")
def count_by(ctx, array, name=None):
    values, t = elements(ctx, array)
    if name is not None and isinstance(t, (T.StructType, T.MapType)):
        field = str(ctx.value(name))
        t = field_of(F.lit(None), t, field)[1] if isinstance(t, T.StructType) else t.valueType
        values = F.transform(values, lambda x: field_of(x, elements(ctx, array)[1], field)[0])
    keys = F.transform(values, lambda x: F.coalesce(fmt_type(t, x), F.lit("null")))
    return let(keys, lambda ks: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(ks)), lambda k: F.struct(k, F.size(F.filter(ks, lambda x: x == k)).cast("long")))))


@verb("keyBy")
def key_by(ctx, array, name):
    values, t = elements(ctx, array)
    return last_wins(F.transform(values, lambda x: F.struct(field_of(x, t, str(ctx.value(name)))[0].cast("string").alias("k"), x.alias("v"))))


@verb("countIf")
def count_if(ctx, array, name, op, value):
    values, test = _pred(ctx, array, name, op, value, coercing=True)
    return F.size(F.filter(values, test))


def _matching(ctx, array, name, op, value, other) -> Column:
    values, test = _pred(ctx, array, name, op, value, coercing=True)
    field = str(ctx.value(other if other is not None else name))
    t = elements(ctx, array)[1]
    return F.transform(F.filter(values, test), lambda x: lenient(*field_of(x, t, field)))


@verb("sumIf")
def sum_if(ctx, array, name, op, value, other=None):
    return total(_matching(ctx, array, name, op, value, other))


@verb("avgIf")
def avg_if(ctx, array, name, op, value, other=None):
    return mean(_matching(ctx, array, name, op, value, other))


@verb("accumulate")
def accumulate(ctx, name, value):
    """The accumulator's new value is the compiler's work (a running sum); on its own, the number added."""
    return num(ctx, value)


@verb("set")
def set_(ctx, name, value):
    return value


@verb("variance")
def variance(ctx, array):
    return let(present(numbers(ctx, array)), lambda v: F.try_divide(spread(v), F.size(v).cast("double")))


@verb("varianceSample")
def variance_sample(ctx, array):
    return let(present(numbers(ctx, array)), lambda v: F.when(F.size(v) > 1, F.try_divide(spread(v), (F.size(v) - 1).cast("double"))))


@verb("std")
def std(ctx, array):
    return F.sqrt(variance(ctx, array))


@verb("stdSample")
def std_sample(ctx, array):
    return F.sqrt(variance_sample(ctx, array))


def at_share(values: Column, q: Column) -> Column:
    """Linear interpolation between the neighbours of place q * (n - 1); q is held in [0, 1]."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))

    def use(v: Column) -> Column:
        place = q * (F.size(v) - 1)
        low = F.floor(place).cast("int")
        a, b = F.get(v, low), F.coalesce(F.get(v, low + 1), F.get(v, low))
        return a + (b - a) * (place - low)

    return let(F.array_sort(present(values)), use)


@verb("median")
def median(ctx, array):
    return at_share(numbers(ctx, array), F.lit(0.5))


@verb("percentile")
def percentile(ctx, array, p):
    return at_share(numbers(ctx, array), num(ctx, p) / 100)


@verb("quantile")
def quantile(ctx, array, q):
    return at_share(numbers(ctx, array), num(ctx, q))


@verb("mode")
def mode(ctx, array):
    """The most frequent number; of equally frequent ones, the one that comes first."""
    use = lambda v: F.get(F.array_sort(F.transform(F.array_distinct(v), lambda x, i: F.struct((-F.size(F.filter(v, lambda y: y == x))).alias("n"), i.alias("i"), x.alias("x")))), 0)["x"]
    return let(present(numbers(ctx, array)), use)


def _paired(ctx, a, b) -> Column:
    x, y = numbers(ctx, a), numbers(ctx, b)
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: F.struct(F.coalesce(p, F.lit(0.0)).alias("x"), F.coalesce(q, F.lit(0.0)).alias("y")))


def _moments(pairs: Column):
    xs, ys = F.transform(pairs, lambda p: p["x"]), F.transform(pairs, lambda p: p["y"])
    mx, my = mean(xs), mean(ys)
    dev = let(F.struct(mx.alias("x"), my.alias("y")), lambda m: F.transform(pairs, lambda p: F.struct((p["x"] - m["x"]).alias("x"), (p["y"] - m["y"]).alias("y"))))
    return dev


@verb("covariance")
def covariance(ctx, a, b):
    return let(_moments(_paired(ctx, a, b)), lambda d: F.try_divide(total(F.transform(d, lambda p: p["x"] * p["y"])), F.size(d).cast("double")))


@verb("correlation")
def correlation(ctx, a, b):
    part = lambda d, f: total(F.transform(d, f))
    return let(_moments(_paired(ctx, a, b)), lambda d: F.try_divide(part(d, lambda p: p["x"] * p["y"]), F.sqrt(part(d, lambda p: p["x"] * p["x"]) * part(d, lambda p: p["y"] * p["y"]))))


@verb("weightedAvg")
def weighted_avg(ctx, values, weights):
    pairs = _paired(ctx, values, weights)
    return F.try_divide(total(F.transform(pairs, lambda p: p["x"] * p["y"])), total(F.transform(pairs, lambda p: p["y"])))


@verb("zscore")
def zscore(ctx, v, array):
    values = present(numbers(ctx, array))
    return let(values, lambda x: F.try_divide(num(ctx, v) - mean(x), F.nullif(F.sqrt(F.try_divide(spread(x), F.size(x).cast("double"))), F.lit(0.0))))
