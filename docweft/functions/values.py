"""Value rules that the verbs share, and the verb registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

verbs: dict[str, Callable[..., Column]] = {}

#: Keys that object verbs never return.
UNSAFE_KEYS = ("__proto__", "constructor", "prototype")
#: Largest integer that a double holds exactly.
EXACT = 9007199254740991


class TransformError(ValueError):
    """An error of the specification, with its code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code


def verb(*names: str):
    """Register a function (context, *columns) under one or more verb names."""

    def add(function):
        for name in names:
            verbs[name] = function
        return function

    return add


def verb_names() -> list[str]:
    return sorted(verbs)


@dataclass
class Context:
    """What a verb may ask: the type of an argument, the value of a literal, tables, custom verbs."""

    frame: DataFrame
    tables: dict = field(default_factory=dict)
    literals: dict[int, object] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    sequence: Column | None = None
    kept: list[Column] = field(default_factory=list)

    def lit(self, value) -> Column:
        column = F.lit(value)
        self.literals[id(column)] = value
        self.kept.append(column)  # so that no other column gets the same id
        return column

    def value(self, column: Column, default=None):
        """The Python value of a literal argument."""
        return self.literals.get(id(column), default)

    def constant(self, column: Column) -> bool:
        return id(column) in self.literals

    def type(self, column: Column) -> T.DataType:
        """Type of a column expression, from the analyser."""
        return self.frame.select(column.alias("x")).schema[0].dataType


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def number_text(s: Column) -> Column:
    """The number that a text starts with; 0 if there is none."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def num(ctx: Context, c: Column) -> Column:
    """Lenient number: null and junk are 0, texts give the number they start with, arrays their length."""
    value = ctx.value(c)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(float(value))
    t = ctx.type(c)
    if is_numeric(t) or isinstance(t, T.BooleanType):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if isinstance(t, T.StringType):
        return number_text(c)
    if is_array(t):
        return F.coalesce(F.size(c).cast("double"), F.lit(0.0))
    return F.lit(0.0)


def strict(ctx: Context, c: Column) -> Column:
    """Strict number: numeric as it is, a text if all of it is a number, else null."""
    t = ctx.type(c)
    if is_numeric(t):
        return c.cast("double")
    if isinstance(t, T.StringType):
        return F.trim(c).try_cast("double")
    return F.lit(None).cast("double")


def integer(ctx: Context, c: Column) -> Column | int:
    """A Python int for a literal, else a long column."""
    value = ctx.value(c)
    if isinstance(value, (int, float)):
        return int(value)
    return F.floor(num(ctx, c)).cast("int")


def number_format(c: Column) -> Column:
    """Shortest text of a double without exponent or a trailing `.0`."""
    plain = c.cast("string")
    wide = F.rtrim(F.rtrim(c.cast("decimal(38,18)").cast("string"), F.lit("0")), F.lit("."))
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).when(F.contains(plain, F.lit("E")) & (F.abs(c) < 1e19), F.regexp_replace(F.regexp_replace(wide, r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(plain)


def fmt(ctx: Context, c: Column) -> Column:
    """Text form of a scalar; null stays null."""
    t = ctx.type(c)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return number_format(c.cast("double"))
    if isinstance(t, T.DecimalType):
        return number_format(c.cast("double"))
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(t, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def text(ctx: Context, c: Column) -> Column:
    """A string argument as it is; other scalars in text form."""
    return c if isinstance(ctx.type(c), T.StringType) else fmt(ctx, c)


def truthy(ctx: Context, c: Column) -> Column:
    """Non-empty text, number other than 0, true; arrays and objects always; null never."""
    t = ctx.type(c)
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if is_numeric(t):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(t, T.NullType):
        return F.lit(False)
    return c.isNotNull()


def to_boolean(ctx: Context, c: Column) -> Column:
    """true, yes, y and 1 in any case; numbers other than 0."""
    t = ctx.type(c)
    if isinstance(t, T.StringType):
        return F.coalesce(F.lower(c).isin("true", "yes", "y", "1"), F.lit(False))
    return truthy(ctx, c)


def half_up(c: Column, digits: Column | int) -> Column:
    """floor(n * 10^d + 0.5) / 10^d."""
    scale = F.pow(F.lit(10.0), F.lit(digits) if isinstance(digits, int) else digits)
    return F.floor(c * scale + 0.5) / scale


def loose_equal(ctx: Context, a: Column, b: Column) -> Column:
    """Numbers by value, text with number by the text's number, else by type and value; null equals null."""
    ta, tb = ctx.type(a), ctx.type(b)
    na, nb = is_numeric(ta), is_numeric(tb)
    sa, sb = isinstance(ta, T.StringType), isinstance(tb, T.StringType)
    if na and nb:
        return a.cast("double").eqNullSafe(b.cast("double"))
    if (na and sb) or (sa and nb):
        return strict(ctx, a).eqNullSafe(strict(ctx, b)) & a.isNotNull().eqNullSafe(b.isNotNull())
    if type(ta) is type(tb):
        return a.eqNullSafe(b)
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
        return a.isNull() & b.isNull()
    return F.lit(False)


#: Names of comparison operators, by what they mean.
OPERATORS = {"=": "eq", "==": "eq", "eq": "eq", "!=": "ne", "<>": "ne", "ne": "ne", "<": "lt", "lt": "lt", "<=": "lte", "lte": "lte", ">": "gt", "gt": "gt", ">=": "gte", "gte": "gte", "contains": "contains"}


def _parsed(c: Column, whole: bool) -> Column:
    """A text that is a number throughout, as a double; whole: of digits only."""
    return F.when(F.rlike(c, F.lit(r"^[+-]?\d+$" if whole else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), c.try_cast("double"))


def _plain(c: Column, t: T.DataType) -> Column:
    """A scalar as the coercing comparator reads it: null as nothing."""
    if isinstance(t, T.NullType):
        return F.lit("")
    out = number_format(c.cast("double")) if is_numeric(t) and not isinstance(t, T.IntegralType) else c.cast("string")
    return F.coalesce(out, F.lit(""))


def lenient(c: Column, t: T.DataType) -> Column:
    """The number that a value starts with or is; 0 if there is none."""
    if isinstance(t, T.StringType):
        return F.coalesce(number_text(c), F.lit(0.0))
    return F.coalesce(c.cast("double"), F.lit(0.0)) if is_numeric(t) or isinstance(t, T.BooleanType) else F.lit(0.0)


def typed(kind: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """The comparator that heeds types.

    Equality: numbers by value, a text with a number if all of it is that number,
    else equal types and values; null equals null only. Order: numbers with
    numbers, texts with texts, nothing else. contains: texts only.
    """
    na, nb, sa, sb = is_numeric(ta), is_numeric(tb), isinstance(ta, T.StringType), isinstance(tb, T.StringType)
    both = a.isNotNull() & b.isNotNull()
    if kind in ("eq", "ne"):
        if na and nb:
            same = a.cast("double") == b.cast("double")
        elif sa and nb:
            same = _parsed(a, isinstance(tb, T.IntegralType)) == b.cast("double")
        elif na and sb:
            same = a.cast("double") == _parsed(b, isinstance(ta, T.IntegralType))
        elif type(ta) is type(tb) and not isinstance(ta, T.NullType):
            same = a == b
        else:
            same = F.lit(False)
        equal = (a.isNull() & b.isNull()) | (both & F.coalesce(same, F.lit(False)))
        return equal if kind == "eq" else ~equal
    if kind == "contains":
        return both & F.contains(a, b) if sa and sb else F.lit(False)
    if kind in ORDER and (na and nb or sa and sb):
        x, y = (a.cast("double"), b.cast("double")) if na else (a, b)
        return F.coalesce(ORDER[kind](x, y), F.lit(False))
    return F.lit(False)


def coerced(kind: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """The comparator that coerces: equality and text tests on text forms (null: empty), order on leading numbers (none: 0)."""
    if kind in ORDER:
        return ORDER[kind](lenient(a, ta), lenient(b, tb))
    x, y = _plain(a, ta), _plain(b, tb)
    tests = {"eq": lambda: x == y, "ne": lambda: x != y, "contains": lambda: F.contains(x, y), "startsWith": lambda: F.startswith(x, y), "endsWith": lambda: F.endswith(x, y)}
    return tests[kind]() if kind in tests else F.lit(False)


ORDER = {"lt": lambda x, y: x < y, "lte": lambda x, y: x <= y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y}


def literal_type(value) -> T.DataType:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    return kinds.get(type(value), T.NullType())


def predicate(ctx: Context, op: Column, coercing: bool = False) -> Callable[[Column, T.DataType, Column], Column]:
    """Comparison by a literal operator's name, with types heeded or coerced; an unknown operator matches nothing."""
    name = ctx.value(op)
    kind = OPERATORS.get(name, name if coercing and name in ("startsWith", "endsWith") else None)

    def compare(left: Column, left_type: T.DataType, right: Column) -> Column:
        right_type = literal_type(ctx.value(right)) if ctx.constant(right) else ctx.type(right)
        if kind is None:
            return F.lit(False)
        return (coerced if coercing else typed)(kind, left, left_type, right, right_type)

    return compare


def elements(ctx: Context, c: Column) -> tuple[Column, T.DataType]:
    """An array argument and its element type; other values are no array: empty."""
    t = ctx.type(c)
    if is_array(t):
        return F.coalesce(c, F.array().cast(t)), t.elementType
    return F.array().cast("array<string>"), T.StringType()


def field_of(x: Column, t: T.DataType, name: str) -> tuple[Column, T.DataType]:
    """A field of an object; a missing one is null."""
    if isinstance(t, T.StructType) and name in t.names:
        return x[name], t[name].dataType
    if isinstance(t, T.MapType):
        return F.try_element_at(x, F.lit(name)), t.valueType
    return F.lit(None).cast("string"), T.NullType()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def finite(c: Column) -> Column:
    """The number, or null if it is infinite or none."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def numbers(ctx: Context, c: Column) -> Column:
    """Elements of an array as doubles; texts that are numbers count, others are null."""
    values, t = elements(ctx, c)
    if isinstance(t, T.BooleanType):
        return F.transform(values, lambda x: F.lit(None).cast("double"))
    return F.transform(values, lambda x: x.try_cast("double"))
