"""Financial verbs. Root searches are bounded Newton folds inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import elements, finite, let, num, verb


def _numbers(ctx, array) -> Column:
    values, _ = elements(ctx, array)
    return F.transform(values, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


@verb("compound")
def compound(ctx, p, r, n):
    return finite(num(ctx, p) * F.pow(1 + num(ctx, r), num(ctx, n)))


@verb("discount")
def discount(ctx, fv, r, n):
    return F.try_divide(num(ctx, fv), F.pow(1 + num(ctx, r), num(ctx, n)))


@verb("pmt")
def pmt(ctx, p, r, n):
    p, r, n = num(ctx, p), num(ctx, r), num(ctx, n)
    return F.when(r == 0, F.try_divide(p, n)).otherwise(F.try_divide(p * r * F.pow(1 + r, n), F.pow(1 + r, n) - 1))


@verb("fv")
def fv(ctx, payment, r, n):
    a, r, n = num(ctx, payment), num(ctx, r), num(ctx, n)
    return F.when(r == 0, a * n).otherwise(F.try_divide(a * (F.pow(1 + r, n) - 1), r))


@verb("pv")
def pv(ctx, payment, r, n):
    a, r, n = num(ctx, payment), num(ctx, r), num(ctx, n)
    return finite(F.when(r == 0, a * n).otherwise(F.try_divide(a * (1 - F.pow(1 + r, -n)), r)))


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


@verb("npv")
def npv(ctx, rate, flows):
    r = num(ctx, rate)
    return _sum(F.transform(_numbers(ctx, flows), lambda x, i: x / F.pow(1 + r, i.cast("double"))))


def newton(value, slope, start: Column, steps: int = 100, small: float = 1e-7) -> Column:
    """Newton's method from `start`: stops when a step is small or the slope vanishes; null if it leaves the numbers."""

    def step(state, _):
        x = state["x"]
        stay = F.struct(x.alias("x"), F.lit(True).alias("done"))
        moved = let(F.try_divide(value(x), slope(x)), lambda dx: F.when(dx.isNull(), stay).otherwise(F.struct((x - dx).alias("x"), (F.abs(dx) < small).alias("done"))))
        return F.when(state["done"], stay).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(start.alias("x"), F.lit(False).alias("done")), step, lambda s: finite(s["x"]))


@verb("irr")
def irr(ctx, flows, guess=None):
    start = F.lit(0.1) if guess is None else num(ctx, guess)

    def solve(cf: Column) -> Column:
        value = lambda r: _sum(F.transform(cf, lambda x, i: x / F.pow(1 + r, i.cast("double"))))
        slope = lambda r: _sum(F.transform(cf, lambda x, i: -i * x / F.pow(1 + r, i.cast("double") + 1)))
        return F.when(F.size(cf) > 1, newton(value, slope, start))

    return let(_numbers(ctx, flows), solve)


def _dated(ctx, amounts, dates) -> Column:
    values, _ = elements(ctx, dates)
    days = F.transform(values, lambda d: F.try_to_date(d.cast("string"), "yyyy-MM-dd"))
    first = F.get(days, 0)
    return F.zip_with(_numbers(ctx, amounts), days, lambda x, d: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), (F.datediff(d, first) / 365.0).alias("t")))


@verb("xnpv")
def xnpv(ctx, rate, amounts, dates):
    r = num(ctx, rate)
    return _sum(F.transform(_dated(ctx, amounts, dates), lambda p: p["x"] / F.pow(1 + r, p["t"])))


@verb("xirr")
def xirr(ctx, amounts, dates, guess=None):
    start = F.lit(0.1) if guess is None else num(ctx, guess)

    def solve(flows: Column) -> Column:
        value = lambda r: _sum(F.transform(flows, lambda p: p["x"] / F.pow(1 + r, p["t"])))
        slope = lambda r: _sum(F.transform(flows, lambda p: -p["t"] * p["x"] / F.pow(1 + r, p["t"] + 1)))
        return newton(value, slope, start)

    return let(_dated(ctx, amounts, dates), solve)


@verb("rate")
def rate(ctx, n, payment, present, future=None):
    n, a, p = num(ctx, n), num(ctx, payment), num(ctx, present)
    f = F.lit(0.0) if future is None else num(ctx, future)
    value = lambda r: p * F.pow(1 + r, n) + a * F.try_divide(F.pow(1 + r, n) - 1, r) + f
    slope = lambda r: n * p * F.pow(1 + r, n - 1) + a * F.try_divide(n * F.pow(1 + r, n - 1) * r - (F.pow(1 + r, n) - 1), r * r)

    def step(state, _):
        x = state["x"]
        stay = F.struct(x.alias("x"), F.lit(True).alias("done"))
        moved = lambda dx: F.struct(F.greatest(F.lit(-0.99), F.least(F.lit(10.0), x - dx)).alias("x"), (F.abs(dx) < 1e-6).alias("done"))
        return F.when(state["done"], stay).otherwise(let(F.try_divide(value(x), slope(x)), lambda dx: F.when(dx.isNull(), stay).otherwise(moved(dx))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(F.lit(0.1).alias("x"), F.lit(False).alias("done")), step, lambda s: finite(s["x"]))


@verb("nper")
def nper(ctx, r, payment, present, future=None):
    r, a, p = num(ctx, r), num(ctx, payment), num(ctx, present)
    f = F.lit(0.0) if future is None else num(ctx, future)
    flat = F.try_divide(-(p + f), a)
    return finite(F.when(r == 0, flat).otherwise(F.try_divide(F.ln(F.try_divide(a - f * r, a + p * r)), F.ln(1 + r))))


@verb("depreciation")
def depreciation(ctx, cost, salvage, life):
    c, s, n = num(ctx, cost), num(ctx, salvage), num(ctx, life)
    return F.when((n > 0) & (s <= c), F.try_divide(c - s, n))


