"""Array verbs: in-row forms. Their twins over tables are in docweft.operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logic import common
from .values import Context, elements, field_of, fmt, integer, is_numeric, let, predicate, verb, verbs


def number(ctx, n) -> Column:
    n = integer(ctx, n)
    return F.lit(n) if isinstance(n, int) else n


def _pred(ctx: Context, array: Column, name: Column, op: Column, value: Column, coercing=False):
    """(array, test of one element) for the verbs that take a field, an operator and a value."""
    values, t = elements(ctx, array)
    compare = predicate(ctx, op, coercing)

    def test(x: Column) -> Column:
        f, ft = field_of(x, t, str(ctx.value(name))) if isinstance(t, (T.StructType, T.MapType)) else (x, t)
        return compare(f, ft, value)

    return values, test


@verb("filter")
def filter_(ctx, array, name, op, value):
    values, test = _pred(ctx, array, name, op, value)
    return F.filter(values, test)


@verb("every")
def every(ctx, array, name, op, value):
    values, test = _pred(ctx, array, name, op, value)
    return F.forall(values, test)


@verb("some")
def some(ctx, array, name, op, value):
    values, test = _pred(ctx, array, name, op, value)
    return F.exists(values, test)


@verb("find")
def find(ctx, array, name, op, value):
    values, test = _pred(ctx, array, name, op, value)
    return F.get(F.filter(values, test), 0)


@verb("findIndex")
def find_index(ctx, array, name, op, value):
    values, test = _pred(ctx, array, name, op, value)
    return F.array_position(F.transform(values, test), F.lit(True)) - 1


@verb("partition")
def partition(ctx, array, name, op, value):
    values, test = _pred(ctx, array, name, op, value, coercing=True)
    return F.array(F.filter(values, test), F.filter(values, lambda x: ~test(x)))


@verb("flatten")
def flatten(ctx, array):
    values, t = elements(ctx, array)
    return F.flatten(values) if isinstance(t, T.ArrayType) else values


@verb("distinct", "unique")
def distinct(ctx, array):
    return F.array_distinct(elements(ctx, array)[0])


@verb("sort")
def sort(ctx, array):
    return F.array_sort(elements(ctx, array)[0])


@verb("sortDesc")
def sort_desc(ctx, array):
    return F.sort_array(elements(ctx, array)[0], asc=False)


@verb("sortBy")
def sort_by(ctx, array, name):
    """Stable, ascending by a field, nulls last."""
    values, t = elements(ctx, array)
    if not isinstance(t, (T.StructType, T.MapType)):
        return values
    key = lambda x: field_of(x, t, str(ctx.value(name)))[0]
    keyed = F.transform(values, lambda x, i: F.struct(key(x).isNull().alias("n"), key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"], 1).otherwise(-1)).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"])), lambda s: s["x"])


@verb("map", "pluck")
def map_(ctx, array, name):
    values, t = elements(ctx, array)
    return F.transform(values, lambda x: field_of(x, t, str(ctx.value(name)))[0])


def _typed(ctx, array, v) -> tuple[Column, Column] | None:
    """Array and value in one type if they are of a kind, else None (strict equality)."""
    values, t = elements(ctx, array)
    tv = ctx.type(v)
    if is_numeric(t) and is_numeric(tv):
        return F.transform(values, lambda x: x.cast("double")), v.cast("double")
    return (values, v) if type(t) is type(tv) else None


@verb("indexOf")
def index_of(ctx, array, v):
    pair = _typed(ctx, array, v)
    return F.lit(-1).cast("long") if pair is None else F.array_position(*pair) - 1


@verb("includes")
def includes(ctx, array, v):
    pair = _typed(ctx, array, v)
    return F.lit(False) if pair is None else F.coalesce(F.array_contains(*pair), F.lit(False))


@verb("at")
def at(ctx, array, i):
    i = number(ctx, i)
    return F.try_element_at(elements(ctx, array)[0], F.when(i >= 0, i + 1).otherwise(i).cast("int"))


@verb("slice")
def slice_(ctx, array, start, end=None):
    values, _ = elements(ctx, array)
    n = F.size(values)
    place = lambda i: F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))
    a = place(number(ctx, start))
    b = n if end is None else place(number(ctx, end))
    return F.slice(values, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


@verb("reverse")
def reverse(ctx, array):
    return F.reverse(elements(ctx, array)[0])


@verb("concatArrays")
def concat_arrays(ctx, a, b):
    return F.concat(*common(ctx, elements(ctx, a)[0], elements(ctx, b)[0]))


@verb("zip")
def zip_(ctx, a, b):
    (x, _), (y, _) = elements(ctx, a), elements(ctx, b)
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: F.struct(p.alias("a"), q.alias("b")))


@verb("groupBy")
def group_by(ctx, array, name):
    """[{key, items}] in the order in which keys come first; keys as text, a missing one `null`."""
    values, t = elements(ctx, array)
    f, ft = (lambda x: field_of(x, t, str(ctx.value(name)))[0]), field_of(F.lit(None), t, str(ctx.value(name)))[1]
    text = (lambda c: F.coalesce(fmt_type(ft, c), F.lit("null")))
    keys = F.array_distinct(F.transform(values, lambda x: text(f(x))))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(values, lambda x: text(f(x)) == k).alias("items")))


def fmt_type(t: T.DataType, c: Column) -> Column:
    """fmt for a column whose type is known without the analyser (inside lambdas)."""
    from .values import number_format

    return number_format(c.cast("double")) if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else c.cast("string")


@verb("take", "limit")
def take(ctx, array, n):
    n = number(ctx, n)
    return F.when(n >= 0, F.slice(elements(ctx, array)[0], F.lit(1), F.greatest(n, F.lit(0)).cast("int")))


@verb("drop")
def drop(ctx, array, n):
    values, n = elements(ctx, array)[0], number(ctx, n)
    return F.when(n >= 0, F.slice(values, (F.greatest(n, F.lit(0)) + 1).cast("int"), F.greatest(F.size(values), F.lit(0))))


@verb("chunk")
def chunk(ctx, array, size):
    values, n = elements(ctx, array)[0], number(ctx, size)
    some_ = (F.size(values) > 0) & (n > 0)
    return F.when(some_, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.greatest(n, F.lit(1))).cast("int")), lambda i: F.slice(values, (i * n + 1).cast("int"), n.cast("int")))).otherwise(F.array().cast(T.ArrayType(ctx.type(values))))


@verb("range")
def range_(ctx, start, end, step=None):
    a, b = number(ctx, start).cast("long"), number(ctx, end).cast("long")
    s = F.lit(1).cast("long") if step is None else number(ctx, step).cast("long")
    safe = F.when(s == 0, F.lit(None).cast("long")).otherwise(s)
    last = b - F.when(s > 0, 1).otherwise(-1)
    return F.when((s != 0) & ((last - a) * s >= 0) & (a != b), F.sequence(a, last, safe)).otherwise(F.array().cast("array<bigint>"))


@verb("compact")
def compact(ctx, array):
    values, t = elements(ctx, array)
    return F.filter(values, lambda x: x.isNotNull() & (x != "") if isinstance(t, T.StringType) else x.isNotNull())


@verb("sample")
def sample(ctx, array, n, seed=None):
    """n elements without replacement; the same for the same seed (not the picks of any other implementation)."""
    values, n = elements(ctx, array)[0], number(ctx, n)
    key = F.lit("") if seed is None else fmt(ctx, seed)
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(values)), lambda i: F.struct(F.xxhash64(i, key).alias("h"), i.alias("i"))))
    shuffled = F.shuffle(values) if seed is None else F.when(F.size(values) > 0, F.transform(order, lambda s: F.element_at(values, s["i"]))).otherwise(values)
    return F.slice(shuffled, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


@verb("dedupe")
def dedupe(ctx, array, name):
    values, t = elements(ctx, array)
    f = lambda x: field_of(x, t, str(ctx.value(name)))[0]
    keys = F.transform(values, f)
    return F.filter(values, lambda x, i: ~F.exists(F.slice(keys, F.lit(1), i), lambda k: k.eqNullSafe(f(x))))


@verb("explode")
def explode(ctx, array, name):
    """One object per element of the array field; an object whose field is empty or missing stays, with null."""
    values, t = elements(ctx, array)
    field = str(ctx.value(name))
    if not isinstance(t, T.StructType) or not isinstance(field_of(F.lit(None), t, field)[1], T.ArrayType):
        return values
    inner = t[field].dataType.elementType
    rows = lambda x, e: F.struct(*(e.alias(n) if n == field else x[n].alias(n) for n in t.names))
    none = F.lit(None).cast(inner)
    return F.flatten(F.transform(values, lambda x: F.when(F.coalesce(F.size(x[field]), F.lit(0)) > 0, F.transform(x[field], lambda e: rows(x, e))).otherwise(F.array(rows(x, none)))))


#: Verbs that reduce may use: result and both arguments in one type, numbers as double or texts.
FOLDS = {
    "add": lambda a, x: a + x, "subtract": lambda a, x: a - x, "multiply": lambda a, x: a * x, "divide": lambda a, x: F.try_divide(a, x),
    "minOf": F.least, "maxOf": F.greatest, "mod": F.try_mod, "pow": F.pow,
}


@verb("reduce")
def reduce(ctx, array, name, start):
    values, t = elements(ctx, array)
    which = str(ctx.value(name))
    if which == "concat":
        return F.aggregate(F.transform(values, lambda x: fmt_type(t, x)), fmt(ctx, start), lambda a, x: F.concat(a, F.coalesce(x, F.lit(""))))
    if which in FOLDS:
        return F.aggregate(F.transform(values, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))), start.cast("double"), FOLDS[which])
    if which in ("and", "or"):
        return F.aggregate(values, start.cast("boolean"), lambda a, x: a & x if which == "and" else a | x)
    from .values import TransformError

    raise TransformError("T001", f"reduce cannot use {which}" if which in verbs else f"unknown verb {which}")


@verb("pivot")
def pivot(ctx, array, key, value):
    """Object from a key and a value field; the last one wins."""
    values, t = elements(ctx, array)
    k, v = str(ctx.value(key)), str(ctx.value(value))
    return last_wins(F.transform(values, lambda x: F.struct(field_of(x, t, k)[0].cast("string").alias("k"), field_of(x, t, v)[0].alias("v"))))


def last_wins(pairs: Column) -> Column:
    """Map of (k, v) pairs without null keys; of equal keys the last stays."""
    use = lambda p: F.map_from_entries(F.filter(p, lambda x, i: x["k"].isNotNull() & ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"])))
    return let(pairs, use)


@verb("unpivot")
def unpivot(ctx, obj, key, value):
    from .objects import as_map

    return F.transform(F.map_entries(as_map(ctx, obj)), lambda e: F.struct(e["key"].alias(str(ctx.value(key))), e["value"].alias(str(ctx.value(value)))))


# sets


def _pair(ctx, a, b):
    (x, tx), (y, ty) = elements(ctx, a), elements(ctx, b)
    if tx.simpleString() == ty.simpleString():
        return x, y
    if is_numeric(tx) and is_numeric(ty):
        return x.cast("array<double>"), y.cast("array<double>")
    return F.transform(x, lambda v: fmt_type(tx, v)), F.transform(y, lambda v: fmt_type(ty, v))


@verb("intersection")
def intersection(ctx, a, b):
    return F.array_intersect(*_pair(ctx, a, b))


@verb("union")
def union(ctx, a, b):
    return F.array_union(*_pair(ctx, a, b))


@verb("difference")
def difference(ctx, a, b):
    return F.array_except(*_pair(ctx, a, b))


@verb("symmetricDifference")
def symmetric_difference(ctx, a, b):
    x, y = _pair(ctx, a, b)
    return F.concat(F.array_except(x, y), F.array_except(y, x))
