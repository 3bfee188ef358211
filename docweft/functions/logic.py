"""Nulls, conditions, predicates, logic, coercion and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Context, TransformError, fmt, is_array, is_numeric, loose_equal, num, to_boolean, truthy, verb

#: Names that typeOf gives.
TYPE_NAMES = [(T.NullType, "null"), (T.BooleanType, "boolean"), (T.StringType, "string"), (T.DecimalType, "currency"), (T.IntegralType, "integer"), (T.NumericType, "number"), (T.DateType, "date"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp"), (T.BinaryType, "binary"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object")]


def common(ctx: Context, *columns):
    """The columns in one type: theirs if they agree, double for numbers, else text."""
    kinds = [t for t in map(ctx.type, columns) if not isinstance(t, T.NullType)]
    if len({t.simpleString() for t in kinds}) <= 1:
        return [c.cast(kinds[0]) if kinds else c for c in columns]
    if all(map(is_numeric, kinds)):
        return [c.cast("double") for c in columns]
    return [fmt(ctx, c) for c in columns]


@verb("concat")
def concat(ctx, *args):
    return F.concat_ws("", *(fmt(ctx, a) for a in args))


@verb("coalesce")
def coalesce(ctx, *args):
    parts = [F.nullif(a, F.lit("")) if isinstance(ctx.type(a), T.StringType) else a for a in args]
    return F.coalesce(*common(ctx, *parts))


@verb("ifNull")
def if_null(ctx, v, alt):
    return F.coalesce(*common(ctx, v, alt))


@verb("ifEmpty")
def if_empty(ctx, v, alt):
    return coalesce(ctx, v, alt) if isinstance(ctx.type(v), T.StringType) and ctx.value(alt) != "" else F.coalesce(*common(ctx, F.nullif(v, F.lit("")) if isinstance(ctx.type(v), T.StringType) else v, alt))


@verb("ifElse")
def if_else(ctx, test, a, b):
    a, b = common(ctx, a, b)
    return F.when(truthy(ctx, test), a).otherwise(b)


@verb("cond")
def cond(ctx, *args):
    pairs, rest = list(zip(args[::2], args[1::2], strict=False)), args[-1] if len(args) % 2 else F.lit(None)
    *values, rest = common(ctx, *(v for _, v in pairs), rest)
    out = F.when(F.lit(False), rest)
    for (test, _), value in zip(pairs, values, strict=True):
        out = out.when(truthy(ctx, test), value)
    return out.otherwise(rest)


@verb("switch")
def switch(ctx, v, *args):
    pairs, rest = list(zip(args[::2], args[1::2], strict=False)), args[-1] if len(args) % 2 else F.lit(None)
    *values, rest = common(ctx, *(r for _, r in pairs), rest)
    out = F.when(F.lit(False), rest)
    for (match, _), value in zip(pairs, values, strict=True):
        same = type(ctx.type(v)) is type(ctx.type(match)) or is_numeric(ctx.type(v)) and is_numeric(ctx.type(match))
        out = out.when(v.eqNullSafe(match) if same else F.lit(False), value)
    return out.otherwise(rest)


@verb("assert")
def assert_(ctx, v, message=None):
    return F.when(to_boolean(ctx, v), v)


def _boolean(ctx, *args):
    for a in args:
        if not isinstance(ctx.type(a), (T.BooleanType, T.NullType)):
            raise TransformError("T002", "expected a boolean")
    return args


@verb("and")
def and_(ctx, a, b):
    a, b = _boolean(ctx, a, b)
    return a & b


@verb("or")
def or_(ctx, a, b):
    a, b = _boolean(ctx, a, b)
    return a | b


@verb("xor")
def xor(ctx, a, b):
    a, b = _boolean(ctx, a, b)
    return a != b


@verb("not")
def not_(ctx, v):
    out = ~truthy(ctx, v)
    return out | (v == "false") if isinstance(ctx.type(v), T.StringType) else out


@verb("eq")
def eq(ctx, a, b):
    return loose_equal(ctx, a, b)


@verb("ne")
def ne(ctx, a, b):
    return ~loose_equal(ctx, a, b)


def _ordered(ctx, *args):
    kinds = [ctx.type(a) for a in args]
    if all(isinstance(t, T.StringType) for t in kinds):
        return args
    if all(is_numeric(t) for t in kinds):
        return [a.cast("double") for a in args]
    raise TransformError("T002", "expected two numbers or two strings")


@verb("lt")
def lt(ctx, a, b):
    a, b = _ordered(ctx, a, b)
    return a < b


@verb("lte")
def lte(ctx, a, b):
    a, b = _ordered(ctx, a, b)
    return a <= b


@verb("gt")
def gt(ctx, a, b):
    a, b = _ordered(ctx, a, b)
    return a > b


@verb("gte")
def gte(ctx, a, b):
    a, b = _ordered(ctx, a, b)
    return a >= b


@verb("between")
def between(ctx, v, low, high):
    v, low, high = _ordered(ctx, v, low, high)
    return v.between(low, high)


@verb("isNull")
def is_null(ctx, v=None):
    return F.lit(True) if v is None else v.isNull()


def _is(ctx, v, test):
    return v.isNotNull() & F.lit(bool(test(ctx.type(v))))


@verb("isString")
def is_string(ctx, v):
    return _is(ctx, v, lambda t: isinstance(t, T.StringType))


@verb("isNumber")
def is_number(ctx, v):
    return _is(ctx, v, lambda t: is_numeric(t) and not isinstance(t, T.DecimalType))


@verb("isBoolean")
def is_boolean(ctx, v):
    return _is(ctx, v, lambda t: isinstance(t, T.BooleanType))


def _shaped(ctx, v, kinds, pattern):
    if isinstance(ctx.type(v), T.StringType):
        return F.coalesce(v.rlike(pattern), F.lit(False))
    return _is(ctx, v, lambda t: isinstance(t, kinds))


@verb("isArray")
def is_array_(ctx, v):
    return _shaped(ctx, v, T.ArrayType, r"(?s)^\s*\[.*\]\s*$")


@verb("isObject")
def is_object(ctx, v):
    return _shaped(ctx, v, (T.StructType, T.MapType), r"(?s)^\s*\{.*\}\s*$")


@verb("isDate")
def is_date(ctx, v):
    return _is(ctx, v, lambda t: isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)))


@verb("typeOf")
def type_of(ctx, v):
    name = next((n for kind, n in TYPE_NAMES if isinstance(ctx.type(v), kind)), "string")
    return F.when(v.isNull(), "null").otherwise(name)


# coercion


@verb("coerceString")
def coerce_string(ctx, v):
    if isinstance(ctx.type(v), (T.ArrayType, T.StructType, T.MapType)):
        raise TransformError("T011", "an array or object has no string form")
    return fmt(ctx, v)


@verb("coerceNumber")
def coerce_number(ctx, v):
    return num(ctx, v)


@verb("coerceInteger")
def coerce_integer(ctx, v):
    return F.floor(num(ctx, v))


@verb("coerceBoolean")
def coerce_boolean(ctx, v):
    return to_boolean(ctx, v)


def iso_date(ctx, v):
    """A date from YYYY-MM-DD..., M/D/YYYY, YYYYMMDD, epoch seconds or a date value; else null."""
    t = ctx.type(v)
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return v.cast("date")
    if is_numeric(t):
        return F.timestamp_seconds(v.cast("long")).cast("date")
    s = F.trim(v.cast("string"))
    return F.coalesce(F.try_to_date(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(s, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1), "M/d/yyyy"), F.try_to_date(F.regexp_extract(s, r"^(\d{8})$", 1), "yyyyMMdd"))


@verb("coerceDate")
def coerce_date(ctx, v):
    return iso_date(ctx, v).cast("string")


@verb("coerceTimestamp")
def coerce_timestamp(ctx, v):
    if isinstance(ctx.type(v), (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
    s = v.cast("string")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T"), s).when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00")))


@verb("tryCoerce")
def try_coerce(ctx, v):
    """Best type of a text, as VARIANT: integer, number, boolean, else the text."""
    if not isinstance(ctx.type(v), T.StringType):
        return v
    s = F.trim(v)
    as_json = F.when(s.rlike(r"^[-+]?\d{1,18}$"), s.try_cast("long").cast("string")).when(s.try_cast("double").isNotNull() & s.rlike(r"^[-+0-9.eE]+$"), s.try_cast("double").cast("string")).when(F.lower(s).isin("true", "false"), F.lower(s)).otherwise(F.to_json(F.struct(v.alias("v"))))
    return F.when(v.isNotNull(), F.when(F.startswith(as_json, F.lit("{")) & ~s.rlike(r"^[-+0-9.eE]+$"), F.try_variant_get(F.try_parse_json(as_json), "$.v", "variant")).otherwise(F.try_parse_json(as_json)))


@verb("toArray")
def to_array(ctx, v):
    return v if is_array(ctx.type(v)) else F.array(v)


@verb("toObject", "fromEntries")
def to_object(ctx, v):
    t = ctx.type(v)
    if not is_array(t):
        return v
    if isinstance(t.elementType, T.StructType):
        return F.map_from_entries(v)
    return F.map_from_entries(F.transform(v, lambda x: F.struct(F.get(x, 0).cast("string"), F.get(x, 1))))


# lookups


@verb("lookup")
def lookup(ctx, target, *keys):
    """First row of an embedded table whose key columns match; miss: the table's default, else null."""
    return _lookup(ctx, target, keys, None)


@verb("lookupDefault")
def lookup_default(ctx, target, *args):
    return _lookup(ctx, target, args[:-1], args[-1])


def _lookup(ctx, target, keys, default):
    name, _, column = str(ctx.value(target)).partition(".")
    table = ctx.tables.get(name)
    if table is None:
        raise TransformError("T003", f"no table {name}")
    column = column or table.columns[-1]
    if column not in table.columns:
        raise TransformError("T004", f"table {name} has no column {column}")
    at = table.columns.index(column)
    others = [i for i in range(len(table.columns)) if i != at]
    groups = [[i] for i in others] if len(keys) == 1 else [others[: len(keys)]]
    miss = default if default is not None else table.default
    out = None
    for columns in groups:  # an embedded table is a literal of the specification: a map, first match kept
        first: dict[str, object] = {}
        for row in table.rows:
            first.setdefault("\x1f".join(str(row[i]) for i in columns), row[at])
        if not first:
            continue
        table_map = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
        key = F.concat_ws("\x1f", *(fmt(ctx, k) for k in keys)) if len(keys) > 1 else fmt(ctx, keys[0])
        hit = F.try_element_at(table_map, key)
        out = hit if out is None else F.coalesce(out, hit)
    miss = miss if hasattr(miss, "cast") or miss is None else F.lit(miss)
    out = F.lit(None).cast("string") if out is None else out
    return out if miss is None else F.coalesce(*common(ctx, out, miss))


@verb("__exprError")
def expr_error(ctx, message):
    raise TransformError("T015", str(ctx.value(message)))
