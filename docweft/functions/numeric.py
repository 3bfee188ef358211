"""Arithmetic, rounding, number formats and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from .values import EXACT, fmt, half_up, integer, is_numeric, num, verb


@verb("add")
def add(ctx, a, b):
    return num(ctx, a) + num(ctx, b)


@verb("subtract")
def subtract(ctx, a, b):
    return num(ctx, a) - num(ctx, b)


@verb("multiply")
def multiply(ctx, a, b):
    return num(ctx, a) * num(ctx, b)


@verb("divide")
def divide(ctx, a, b):
    return F.try_divide(num(ctx, a), num(ctx, b))


@verb("safeDivide")
def safe_divide(ctx, a, b, default):
    return F.when(num(ctx, b) == 0, num(ctx, default)).otherwise(F.try_divide(num(ctx, a), num(ctx, b)))


@verb("mod")
def mod(ctx, a, b):
    return F.try_mod(num(ctx, a), num(ctx, b))


@verb("abs")
def abs_(ctx, n):
    return F.abs(num(ctx, n))


@verb("negate")
def negate(ctx, n):
    return -num(ctx, n)


@verb("sign")
def sign(ctx, n):
    return F.signum(num(ctx, n)).cast("long")


@verb("floor")
def floor(ctx, n):
    return F.floor(num(ctx, n))


@verb("ceil")
def ceil(ctx, n):
    return F.ceil(num(ctx, n))


@verb("round")
def round_(ctx, n, digits=None):
    return half_up(num(ctx, n), 0 if digits is None else integer(ctx, digits))


@verb("trunc")
def trunc(ctx, n):
    x = num(ctx, n)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


@verb("pow")
def pow_(ctx, a, b):
    return F.pow(num(ctx, a), num(ctx, b))


@verb("sqrt")
def sqrt(ctx, n):
    return F.when(num(ctx, n) >= 0, F.sqrt(num(ctx, n)))


@verb("exp")
def exp(ctx, n):
    return F.exp(num(ctx, n))


@verb("ln")
def ln(ctx, n):
    return F.ln(num(ctx, n))


@verb("log")
def log(ctx, n, base=None):
    if base is None:
        return F.ln(num(ctx, n))
    b = num(ctx, base)
    return F.when((num(ctx, n) > 0) & (b > 0) & (b != 1), F.try_divide(F.ln(num(ctx, n)), F.ln(b)))


@verb("log10")
def log10(ctx, n):
    return F.log10(num(ctx, n))


def _gcd(a, b):
    """Euclid's steps; 93 are enough for 64-bit numbers."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, F.try_mod(s["a"], s["b"])).otherwise(F.lit(0).cast("long")).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


@verb("gcd")
def gcd(ctx, a, b):
    return _gcd(num(ctx, a).cast("long"), num(ctx, b).cast("long"))


@verb("lcm")
def lcm(ctx, a, b):
    x, y = num(ctx, a).cast("long"), num(ctx, b).cast("long")
    out = F.abs(x.cast("double") / F.greatest(_gcd(x, y), F.lit(1)) * y)
    return F.when((x == 0) | (y == 0), F.lit(0).cast("long")).when(out <= EXACT, out.cast("long"))


@verb("factorial")
def factorial(ctx, n):
    x = F.floor(num(ctx, n)).cast("int")
    return F.when(x.between(0, 18), F.factorial(x))


@verb("clamp")
def clamp(ctx, v, low, high):
    return F.greatest(num(ctx, low), F.least(num(ctx, high), num(ctx, v)))


@verb("minOf")
def min_of(ctx, *args):
    parts = [num(ctx, a) for a in args]
    return F.least(*parts) if len(parts) > 1 else parts[0]


@verb("maxOf")
def max_of(ctx, *args):
    parts = [num(ctx, a) for a in args]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


@verb("isFinite")
def is_finite(ctx, n):
    if not is_numeric(ctx.type(n)):
        return F.lit(False)
    x = n.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


@verb("isNaN")
def is_nan(ctx, n):
    return F.coalesce(F.isnan(n.cast("double")), F.lit(False)) if is_numeric(ctx.type(n)) else F.lit(False)


@verb("parseInt")
def parse_int(ctx, v, radix=None):
    base = 10 if radix is None else int(ctx.value(radix, 10))
    if not 2 <= base <= 36:
        return F.lit(None).cast("long")
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    s = F.lower(F.trim(fmt(ctx, v)))
    body = F.regexp_extract(s, rf"^[-+]?([{digits}]+)", 1)
    value = F.conv(F.nullif(body, F.lit("")), base, 10).try_cast("long")
    return F.when(F.startswith(s, F.lit("-")), -value).otherwise(value)


@verb("random")
def random(ctx, low=None, high=None, seed=None):
    r = F.rand(int(ctx.value(seed))) if seed is not None and isinstance(ctx.value(seed), (int, float)) else F.rand()
    if low is None:
        return r
    if high is None:
        low, high = ctx.lit(0), low
    return F.floor(num(ctx, low) + r * (num(ctx, high) - num(ctx, low) + 1))


@verb("formatNumber")
def format_number(ctx, n, digits):
    return _fixed(num(ctx, n), integer(ctx, digits))


def _fixed(x, digits):
    """Fixed decimals, ties of the binary value to even."""
    d = digits if isinstance(digits, int) else 0
    out = F.bround(x.cast("decimal(38,18)"), d).cast(f"decimal(38,{d})").cast("string")
    return F.when(F.abs(x) < 1e19, out).otherwise(F.format_string(f"%.{d}f", x))


@verb("formatInteger")
def format_integer(ctx, n):
    return F.floor(num(ctx, n)).cast("string")


@verb("formatCurrency")
def format_currency(ctx, n):
    return _fixed(num(ctx, n), 2)


@verb("formatPercent")
def format_percent(ctx, n, digits=None):
    d = 0 if digits is None else integer(ctx, digits)
    return F.concat(_fixed(half_up(num(ctx, n) * 100, d), d), F.lit("%"))


@verb("formatLocaleNumber")
def format_locale_number(ctx, n, locale=None):
    out = F.regexp_replace(F.regexp_replace(F.format_number(num(ctx, n), 3), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    name = str(ctx.value(locale, "en") if locale is not None else "en").lower()[:2]
    if name in ("de", "es", "it", "nl", "da", "tr", "pt"):
        return F.translate(out, ",.", ".,")
    return F.regexp_replace(F.translate(out, ",.", " ,"), " ", " ") if name == "fr" else out


# Factor of each unit to its family's base.
UNITS = {
    "mass": {"mg": 1e-6, "g": 1e-3, "kg": 1.0, "t": 1000.0, "oz": 0.028349523125, "lb": 0.45359237},
    "length": {"mm": 1e-3, "cm": 1e-2, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344},
    "volume": {"ml": 1e-3, "l": 1.0, "gal": 3.785411784, "qt": 0.946352946, "pt": 0.473176473, "cup": 0.2365882365, "floz": 0.0295735295625},
    "speed": {"mps": 1.0, "kph": 1 / 3.6, "mph": 0.44704, "kn": 0.514444},
    "area": {"sqm": 1.0, "sqkm": 1e6, "sqft": 0.09290304, "sqmi": 2589988.110336, "acre": 4046.8564224, "ha": 1e4},
    "data": {"b": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3, "tb": 1024.0**4},
    "time": {"ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "wk": 604800.0},
}


@verb("convertUnit")
def convert_unit(ctx, v, source, target):
    a, b, x = str(ctx.value(source)), str(ctx.value(target)), num(ctx, v)
    if a in "CFK" and b in "CFK" and a and b:
        kelvin = {"C": x + 273.15, "F": (x - 32) * 5 / 9 + 273.15, "K": x}[a]
        return half_up({"C": kelvin - 273.15, "F": (kelvin - 273.15) * 9 / 5 + 32, "K": kelvin}[b], 6)
    for family in UNITS.values():
        names = {k.lower(): f for k, f in family.items()}
        if a.lower() in names and b.lower() in names:
            return half_up(x * names[a.lower()] / names[b.lower()], 6)
    return F.lit(None).cast("double")


@verb("toRadians")
def to_radians(ctx, n):
    return F.radians(num(ctx, n))


@verb("toDegrees")
def to_degrees(ctx, n):
    return F.degrees(num(ctx, n))


@verb("interpolate")
def interpolate(ctx, x, x1, y1, x2, y2):
    x, x1, y1, x2, y2 = (num(ctx, a) for a in (x, x1, y1, x2, y2))
    return F.when(x1 == x2, y1).otherwise(y1 + F.try_divide((x - x1) * (y2 - y1), x2 - x1))
