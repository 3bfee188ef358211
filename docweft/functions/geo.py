"""Geographic verbs and generators."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import TransformError, num, verb

# Mean radius of the Earth.
RADIUS = {"km": 6371.0, "mi": 3958.8, "miles": 3958.8}


def _valid(lat, lon):
    return lat.between(-90, 90) & lon.between(-180, 180)


@verb("distance")
def distance(ctx, lat1, lon1, lat2, lon2, unit=None):
    name = str(ctx.value(unit, "km") if unit is not None else "km").lower()
    if name not in RADIUS:
        raise TransformError("T011", f"unknown unit {name}")
    a, b, c, d = (num(ctx, x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return 2 * RADIUS[name] * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


@verb("bearing")
def bearing(ctx, lat1, lon1, lat2, lon2):
    a, b, c, d = (num(ctx, x) for x in (lat1, lon1, lat2, lon2))
    p, q, dl = F.radians(a), F.radians(c), F.radians(d - b)
    angle = F.degrees(F.atan2(F.sin(dl) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(dl)))
    return F.when(_valid(a, b) & _valid(c, d), F.pmod(angle, F.lit(360.0)))


@verb("midpoint")
def midpoint(ctx, lat1, lon1, lat2, lon2):
    a, b, c, d = (num(ctx, x) for x in (lat1, lon1, lat2, lon2))
    p, q, l1, dl = F.radians(a), F.radians(c), F.radians(b), F.radians(d - b)
    x, y = F.cos(q) * F.cos(dl), F.cos(q) * F.sin(dl)
    lat = F.atan2(F.sin(p) + F.sin(q), F.sqrt(F.pow(F.cos(p) + x, 2) + y * y))
    lon = l1 + F.atan2(y, F.cos(p) + x)
    return F.when(_valid(a, b) & _valid(c, d), F.struct(F.degrees(lat).alias("lat"), (F.pmod(F.degrees(lon) + 540, F.lit(360.0)) - 180).alias("lon")))


@verb("inBoundingBox")
def in_bounding_box(ctx, lat, lon, low_lat, low_lon, high_lat, high_lon):
    return num(ctx, lat).between(num(ctx, low_lat), num(ctx, high_lat)) & num(ctx, lon).between(num(ctx, low_lon), num(ctx, high_lon))


def _uuid_of(hexes):
    """32 hex digits as a name-based (version 5) identifier."""
    part = lambda a, n: F.substring(hexes, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))


@verb("uuid")
def uuid(ctx, seed=None):
    """Random, or the same for the same seed (not the bits of any other implementation)."""
    return F.uuid() if seed is None or isinstance(ctx.type(seed), T.NullType) else _uuid_of(F.sha1(seed.cast("string")))


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-"


@verb("nanoid")
def nanoid(ctx, size=None, seed=None):
    """`size` signs of a 64-letter alphabet, from the seed's digests or at random."""
    n = int(ctx.value(size, 21)) if size is not None and ctx.value(size) is not None else 21
    source = F.uuid() if seed is None or isinstance(ctx.type(seed), T.NullType) else seed.cast("string")
    digits = F.concat(*(F.sha2(F.concat(source, F.lit(f"#{k}")), 256) for k in range(-(-n // 32))))
    sign = lambda i: F.substring(F.lit(ALPHABET), (F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 64) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sign), "") if n > 0 else F.lit("")


@verb("sequence")
def sequence(ctx, name):
    """Number of the item, from 0; the compiler gives the loop's position."""
    return ctx.sequence if ctx.sequence is not None else F.lit(0).cast("long")


@verb("resetSequence")
def reset_sequence(ctx, name):
    return F.lit(0).cast("long")


