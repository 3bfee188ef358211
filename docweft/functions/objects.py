"""Object verbs, over structs and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logic import common
from .values import UNSAFE_KEYS, verb


def _names(t: T.StructType) -> list[str]:
    return [n for n in t.names if n not in UNSAFE_KEYS]


def as_map(ctx, c: Column) -> Column:
    """An object as a map of text to its values' common type, unsafe keys dropped."""
    t = ctx.type(c)
    if isinstance(t, T.MapType):
        return F.map_filter(c, lambda k, _: ~k.isin(*UNSAFE_KEYS))
    if isinstance(t, T.StructType) and _names(t):
        values = common(ctx, *(c[n] for n in _names(t)))
        return F.create_map(*(x for n, v in zip(_names(t), values, strict=True) for x in (F.lit(n), v)))
    return F.create_map().cast("map<string,string>")


@verb("keys")
def keys(ctx, c):
    t = ctx.type(c)
    return F.array(*map(F.lit, _names(t))) if isinstance(t, T.StructType) else F.map_keys(as_map(ctx, c))


@verb("values")
def values(ctx, c):
    return F.map_values(as_map(ctx, c))


@verb("entries")
def entries(ctx, c):
    return F.map_entries(as_map(ctx, c))


def _walk(ctx, c: Column, path: str) -> Column | None:
    """The value at a dotted path with array indexes, or None if the type has no such place."""
    for step in path.replace("[", ".").replace("]", "").split("."):
        t = ctx.type(c)
        if not step:
            continue
        if isinstance(t, T.StructType) and step in t.names:
            c = c[step]
        elif isinstance(t, T.MapType):
            c = F.try_element_at(c, F.lit(step))
        elif isinstance(t, T.ArrayType) and step.lstrip("-").isdigit():
            c = F.get(c, F.lit(int(step)))
        else:
            return None
    return c


@verb("has")
def has(ctx, c, path):
    name = str(ctx.value(path))
    t = ctx.type(c)
    if isinstance(t, T.MapType) and "." not in name:
        return F.coalesce(F.map_contains_key(c, F.lit(name)), F.lit(False))
    found = _walk(ctx, c, name)
    if found is None:
        return F.lit(False)
    head, _, last = name.rpartition(".")
    above = _walk(ctx, c, head) if head else c
    if isinstance(ctx.type(above), T.MapType):
        return F.coalesce(F.map_contains_key(above, F.lit(last)), F.lit(False))
    return above.isNotNull()


@verb("get")
def get(ctx, c, path, default=None):
    found = _walk(ctx, c, str(ctx.value(path)))
    if found is None:
        return F.lit(None).cast("string") if default is None else default
    return found if default is None else F.coalesce(*common(ctx, found, default))


@verb("merge")
def merge(ctx, a, b):
    ta, tb = ctx.type(a), ctx.type(b)
    if isinstance(ta, T.StructType) and isinstance(tb, T.StructType):
        names = list(dict.fromkeys([*_names(ta), *_names(tb)]))
        return F.struct(*((b if n in tb.names else a)[n].alias(n) for n in names))
    return F.map_concat(as_map(ctx, a), as_map(ctx, b))


@verb("defaults")
def defaults(ctx, c, other):
    return merge(ctx, other, c) if not isinstance(ctx.type(c), T.StructType) else F.struct(*((c if n in ctx.type(c).names else other)[n].alias(n) for n in dict.fromkeys([*_names(ctx.type(c)), *_names(ctx.type(other))])))


@verb("pick")
def pick(ctx, c, *names):
    t, wanted = ctx.type(c), [str(ctx.value(n)) for n in names]
    if isinstance(t, T.StructType):
        return F.struct(*(c[n].alias(n) for n in wanted if n in _names(t)))
    return F.map_filter(as_map(ctx, c), lambda k, _: k.isin(*wanted))


@verb("omit")
def omit(ctx, c, *names):
    t, dropped = ctx.type(c), [str(ctx.value(n)) for n in names]
    if isinstance(t, T.StructType):
        return F.struct(*(c[n].alias(n) for n in _names(t) if n not in dropped))
    return F.map_filter(as_map(ctx, c), lambda k, _: ~k.isin(*dropped))


@verb("invert")
def invert(ctx, c):
    m = as_map(ctx, c)
    return F.map_from_arrays(F.transform(F.map_values(m), lambda x: x.cast("string")), F.map_keys(m))


@verb("renameKeys")
def rename_keys(ctx, c, mapping):
    t, tm = ctx.type(c), ctx.type(mapping)
    names = ctx.value(mapping)
    if isinstance(t, T.StructType) and isinstance(names, dict):
        return F.struct(*(c[n].alias(names.get(n, n)) for n in _names(t)))
    new = mapping if isinstance(tm, T.MapType) else as_map(ctx, mapping)
    return F.transform_keys(as_map(ctx, c), lambda k, _: F.coalesce(F.try_element_at(new, k).cast("string"), k))


@verb("compactObject")
def compact_object(ctx, c):
    m = as_map(ctx, c)
    t = ctx.type(m)
    if isinstance(t.valueType, T.StringType):
        return F.map_filter(m, lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}"))
    return F.map_filter(m, lambda _, v: v.isNotNull())


