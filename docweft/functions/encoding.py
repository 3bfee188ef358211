"""Encodings, hashes, JSON and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import string
from .values import fmt, verb


def _base64(s: Column) -> Column:
    return F.regexp_replace(F.base64(s.cast("binary")), r"[\r\n]", "")


@verb("base64Encode")
def base64_encode(ctx, s):
    return _base64(string(ctx, s))


@verb("base64Decode", "base64urlDecode")
def base64_decode(ctx, s):
    plain = F.rtrim(F.translate(string(ctx, s), "-_", "+/"), F.lit("="))
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    return F.when(F.length(plain) % 4 != 1, F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


@verb("base64urlEncode")
def base64url_encode(ctx, s):
    return F.rtrim(F.translate(_base64(string(ctx, s)), "+/", "-_"), F.lit("="))


def _quoted(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


@verb("urlEncode")
def url_encode(ctx, s):
    return _quoted(string(ctx, s))


@verb("urlDecode")
def url_decode(ctx, s):
    return F.try_url_decode(string(ctx, s))


@verb("jsonEncode")
def json_encode(ctx, v):
    if isinstance(ctx.type(v), (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(v)
    return F.regexp_extract(F.to_json(F.struct(fmt(ctx, v).alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)


@verb("jsonDecode")
def json_decode(ctx, s):
    s = string(ctx, s)
    return F.when(F.rlike(s, F.lit(r"^\s*[\[{]")), F.try_parse_json(s)).otherwise(F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":"'), s, F.lit('"}'))), "$.v", "variant"))


def _sorted(c: Column, t: T.DataType) -> Column:
    """The value with struct fields and map keys in order, whole doubles as integers."""
    if isinstance(t, T.StructType):
        return F.struct(*(_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


@verb("stableStringify")
def stable_stringify(ctx, v):
    t = ctx.type(v)
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.regexp_replace(F.to_json(_sorted(v, t), {"ignoreNullFields": "false"}), r"(?<=[:\[,]-?\d{1,18})\.0(?=[,\]}])", "")
    if isinstance(t, T.StringType):
        return F.concat(F.lit('"'), json_encode(ctx, v), F.lit('"'))
    return F.coalesce(fmt(ctx, v), F.lit("null"))


@verb("canonicalHash")
def canonical_hash(ctx, v):
    return F.sha2(stable_stringify(ctx, v), 256)


@verb("jsonPath")
def json_path(ctx, v, path):
    source = v if isinstance(ctx.type(v), T.StringType) else F.to_json(v)
    return F.get_json_object(source, str(ctx.value(path)))


@verb("hexEncode")
def hex_encode(ctx, s):
    return F.lower(F.hex(string(ctx, s)))


@verb("hexDecode")
def hex_decode(ctx, s):
    s = string(ctx, s)
    return F.when(F.rlike(s, F.lit("^(?:[0-9a-fA-F]{2})*$")), F.try_validate_utf8(F.unhex(s).cast("string")))


@verb("sha256")
def sha256(ctx, s):
    return F.sha2(fmt(ctx, s), 256)


@verb("sha512")
def sha512(ctx, s):
    return F.sha2(fmt(ctx, s), 512)


@verb("sha1")
def sha1(ctx, s):
    return F.sha1(fmt(ctx, s))


@verb("md5")
def md5(ctx, s):
    return F.md5(fmt(ctx, s))


@verb("crc32")
def crc32(ctx, s):
    return F.lower(F.lpad(F.hex(F.crc32(fmt(ctx, s).cast("binary"))), 8, "0"))


@verb("hmac")
def hmac(ctx, message, key, algorithm=None):
    import hashlib

    name = str(ctx.value(algorithm, "sha256") if algorithm is not None else "sha256").lower()
    secret = ctx.value(key)
    if name not in ("sha256", "sha1") or secret is None:
        return F.lit(None).cast("string")
    raw = str(secret).encode()
    raw = (hashlib.new(name, raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    digest = (lambda c: F.unhex(F.sha2(c, 256))) if name == "sha256" else (lambda c: F.unhex(F.sha1(c)))
    inner, outer = F.lit(bytes(b ^ 0x36 for b in raw)), F.lit(bytes(b ^ 0x5C for b in raw))
    return F.lower(F.hex(digest(F.concat(outer, digest(F.concat(inner, string(ctx, message).cast("binary")))))))


def _query(s: Column) -> Column:
    pairs = F.filter(F.split(F.ltrim(s, F.lit("?")), "&", -1), lambda p: p != "")
    decoded = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.coalesce(F.try_url_decode(F.when(F.contains(p, F.lit("=")), F.expr("NULL")).otherwise(F.lit(""))), F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1))).alias("v")))
    last = F.filter(decoded, lambda x, i: ~F.exists(F.slice(decoded, i + 2, F.size(decoded)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.array_sort(last))


@verb("parseQuery")
def parse_query(ctx, s):
    return _query(string(ctx, s))


@verb("parseUrl")
def parse_url(ctx, s):
    s = string(ctx, s)
    part = lambda name: F.try_parse_url(s, F.lit(name))
    host = part("HOST")
    out = F.struct(
        part("PROTOCOL").alias("scheme"), host.alias("host"), F.nullif(F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1), F.lit("")).cast("int").alias("port"),
        part("PATH").alias("path"), _query(F.coalesce(part("QUERY"), F.lit(""))).alias("query"), part("REF").alias("fragment"),
    )
    return F.when(part("PROTOCOL").isNotNull() & host.isNotNull(), out)


def _pairs(ctx, v: Column) -> Column:
    t = ctx.type(v)
    if isinstance(t, T.StructType):
        return F.array(*(F.struct(F.lit(n).alias("key"), fmt(ctx, v[n]).alias("value")) for n in sorted(t.names)))
    return F.array_sort(F.map_entries(v))


@verb("buildQuery")
def build_query(ctx, v):
    some = F.filter(_pairs(ctx, v), lambda p: p["value"].isNotNull())
    return F.array_join(F.transform(some, lambda p: F.concat(_quoted(p["key"]), F.lit("="), _quoted(p["value"].cast("string")))), "&")


@verb("buildUrl")
def build_url(ctx, v):
    t = ctx.type(v)
    get = lambda n: v[n] if isinstance(t, T.StructType) and n in t.names else F.lit(None).cast("string")
    query = build_query(ctx, v["query"]) if isinstance(t, T.StructType) and "query" in t.names else F.lit("")
    port, fragment, path = get("port"), get("fragment"), F.coalesce(get("path"), F.lit(""))
    return F.when(
        get("scheme").isNotNull() & get("host").isNotNull(),
        F.concat(get("scheme"), F.lit("://"), get("host"), F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")), path, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), F.coalesce(F.concat(F.lit("#"), fragment), F.lit(""))),
    )


