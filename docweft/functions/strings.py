"""String verbs. Offsets and widths count characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import TransformError, fmt, integer, is_array, let, number_format, verb

WIDE = 1 << 30


def string(ctx, c) -> Column:
    """A string argument; other types are an error of the specification."""
    if not isinstance(ctx.type(c), (T.StringType, T.NullType)):
        raise TransformError("T002", "expected a string")
    return c.cast("string")


def pattern(ctx, c) -> str | None:
    """A literal regular expression that is safe to run, else None."""
    value = ctx.value(c)
    if not isinstance(value, str):
        raise TransformError("T002", "a pattern must be a literal")
    try:
        re.compile(value)
    except re.error:
        return None
    return value if len(value) <= 1024 else None


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def squeezed(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, r"(?U)\s+", " "))


def words(s: Column) -> Column:
    """Words of an identifier: cut at signs, at lower-to-upper steps and before the last capital of an acronym."""
    cut = F.regexp_replace(F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.regexp_replace(cut, r"[-_\s]+", " "), " ", -1), lambda w: w != "")


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, WIDE)))


@verb("upper")
def upper(ctx, s):
    return F.upper(string(ctx, s))


@verb("lower")
def lower(ctx, s):
    return F.lower(string(ctx, s))


@verb("trim")
def trim(ctx, s):
    return trimmed(string(ctx, s))


@verb("trimLeft")
def trim_left(ctx, s):
    return F.regexp_replace(string(ctx, s), r"(?U)^\s+", "")


@verb("trimRight")
def trim_right(ctx, s):
    return F.regexp_replace(string(ctx, s), r"(?U)\s+$", "")


@verb("capitalize")
def capitalize(ctx, s):
    return capital(string(ctx, s))


@verb("titleCase")
def title_case(ctx, s):
    return F.array_join(F.transform(F.split(squeezed(string(ctx, s)), " ", -1), capital), " ")


@verb("replace")
def replace(ctx, s, find, new):
    return F.replace(string(ctx, s), fmt(ctx, find), fmt(ctx, new))


@verb("replaceRegex")
def replace_regex(ctx, s, find, new):
    found = pattern(ctx, find)
    return F.lit(None).cast("string") if found is None else F.regexp_replace(string(ctx, s), F.lit(found), fmt(ctx, new))


@verb("substring")
def substring(ctx, s, start, count):
    a, n = integer(ctx, start), integer(ctx, count)
    a = F.greatest(F.lit(a) if isinstance(a, int) else a, F.lit(0))
    n = F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(0))
    return F.substring(string(ctx, s), (a + 1).cast("int"), n.cast("int"))


@verb("length")
def length(ctx, v):
    t = ctx.type(v)
    if is_array(t) or isinstance(t, T.MapType):
        return F.coalesce(F.size(v), F.lit(0))
    return F.coalesce(F.octet_length(fmt(ctx, v)), F.lit(0))


def _test(how):
    return lambda ctx, s, part: F.coalesce(how(fmt(ctx, s), fmt(ctx, part)), F.lit(False))


verb("contains")(_test(F.contains))
verb("startsWith")(_test(F.startswith))
verb("endsWith")(_test(F.endswith))


def _width(ctx, w) -> Column:
    w = integer(ctx, w)
    return F.lit(w) if isinstance(w, int) else w


def _padding(ctx, s, width, sign) -> tuple[Column, Column]:
    s = fmt(ctx, s)
    sign = fmt(ctx, sign) if sign is not None else F.lit(" ")
    return s, F.repeat(F.substring(sign, 1, 1), F.greatest(_width(ctx, width) - F.length(s), F.lit(0)).cast("int"))


@verb("padLeft")
def pad_left(ctx, s, width, sign=None):
    s, fill = _padding(ctx, s, width, sign)
    return F.concat(fill, s)


@verb("padRight", "pad")
def pad_right(ctx, s, width, sign=None):
    s, fill = _padding(ctx, s, width, sign)
    return F.concat(s, fill)


@verb("center")
def center(ctx, s, width, sign=None):
    s, fill = _padding(ctx, s, width, sign)
    left = F.floor(F.length(fill) / 2).cast("int")
    return F.concat(F.substring(fill, F.lit(1), left), s, F.substring(fill, left + 1, F.lit(WIDE)))


@verb("truncate")
def truncate(ctx, s, n):
    return F.substring(string(ctx, s), F.lit(1), F.greatest(_width(ctx, n), F.lit(0)).cast("int"))


@verb("split")
def split(ctx, s, mark=None, index=None):
    if index is None:
        return F.lit(None).cast("string")
    parts = F.split(string(ctx, s), F.lit(re.escape(str(ctx.value(mark, ",")))), -1) if ctx.value(mark, ",") else F.split(string(ctx, s), "", -1)
    i = integer(ctx, index)
    i = F.lit(i) if isinstance(i, int) else i
    return F.try_element_at(parts, F.when(i >= 0, i + 1).otherwise(i).cast("int"))


@verb("join")
def join(ctx, array, mark):
    t = ctx.type(array)
    parts = array
    if is_array(t) and isinstance(t.elementType, (T.DoubleType, T.FloatType, T.DecimalType)):
        parts = F.transform(array, lambda x: number_format(x.cast("double")))
    return F.array_join(F.transform(parts.cast("array<string>"), lambda x: F.coalesce(x, F.lit(""))), str(ctx.value(mark, "")))


@verb("mask")
def mask(ctx, s, how):
    value, s = ctx.value(how), fmt(ctx, s)
    if isinstance(value, (int, float)):
        keep = max(int(value), 0)
        return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(s) - keep, F.lit(0)).cast("int")), F.right(s, F.lit(keep)))
    out, at = [], 1
    for sign in str(value):
        if sign in "#A":
            out.append(F.substring(s, at, 1))
            at += 1
        elif sign == "*":
            out.append(F.when(F.length(s) >= at, F.lit("*")).otherwise(F.lit("")))
            at += 1
        else:
            out.append(F.lit(sign))
    return F.concat(*out) if out else F.lit("")


@verb("reverseString")
def reverse_string(ctx, s):
    return F.reverse(string(ctx, s))


@verb("repeat")
def repeat(ctx, s, n):
    n = _width(ctx, n)
    return F.when(n >= 0, F.repeat(fmt(ctx, s), F.least(n, F.lit(10_000)).cast("int")))


@verb("camelCase")
def camel_case(ctx, s):
    return F.array_join(F.transform(words(string(ctx, s)), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(capital(w))), "")


@verb("snakeCase")
def snake_case(ctx, s):
    return F.lower(F.array_join(words(string(ctx, s)), "_"))


@verb("kebabCase")
def kebab_case(ctx, s):
    return F.lower(F.array_join(words(string(ctx, s)), "-"))


@verb("pascalCase")
def pascal_case(ctx, s):
    return F.array_join(F.transform(words(string(ctx, s)), capital), "")


@verb("slugify")
def slugify(ctx, s):
    plain = F.regexp_replace(F.lower(string(ctx, s)), r"[^a-z0-9_\s-]", "")
    return F.btrim(F.regexp_replace(plain, r"[-_\s]+", "-"), F.lit("-"))


@verb("match", "matches")
def match(ctx, s, find):
    found = pattern(ctx, find)
    return F.lit(None).cast("boolean") if found is None else F.coalesce(F.rlike(fmt(ctx, s), F.lit(found)), F.lit(False))


@verb("extract")
def extract(ctx, s, a, b=None):
    s, end = string(ctx, s), ctx.value(b) if b is not None else 0
    if isinstance(end, str):
        start = str(ctx.value(a))
        rest = F.substring(s, F.instr(s, start) + len(start), F.lit(WIDE))
        return F.when(F.contains(s, F.lit(start)) & F.contains(rest, F.lit(end)), F.substring_index(rest, end, 1))
    found = pattern(ctx, a)
    return F.lit(None).cast("string") if found is None else F.when(F.rlike(s, F.lit(found)), F.regexp_extract(s, found, int(end)))


@verb("normalizeSpace")
def normalize_space(ctx, s):
    return squeezed(string(ctx, s))


@verb("leftOf")
def left_of(ctx, s, mark):
    return F.substring_index(string(ctx, s), str(ctx.value(mark)), 1)


@verb("rightOf")
def right_of(ctx, s, mark):
    s, m = string(ctx, s), str(ctx.value(mark))
    return F.when(F.contains(s, F.lit(m)), F.substring(s, F.instr(s, m) + len(m), F.lit(WIDE))).otherwise(F.when(s.isNotNull(), ""))


@verb("wrap")
def wrap(ctx, s, width):
    w = _width(ctx, width)
    parts = F.filter(F.split(trimmed(string(ctx, s)), r"\s+", -1), lambda x: x != "")

    def step(state, word):
        fits = F.length(state["line"]) + 1 + F.length(word) <= w
        empty = state["line"] == ""
        return F.struct(F.when(empty | fits, state["lines"]).otherwise(F.array_append(state["lines"], state["line"])).alias("lines"), F.when(empty, word).when(fits, F.concat(state["line"], F.lit(" "), word)).otherwise(word).alias("line"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    return F.aggregate(parts, start, step, lambda x: F.array_join(F.array_append(x["lines"], x["line"]), "\n"))


# Accented Latin-1 letters and their plain forms.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


@verb("stripAccents")
def strip_accents(ctx, s):
    return F.translate(string(ctx, s), ACCENTED, PLAIN)


@verb("clean")
def clean(ctx, s):
    return squeezed(F.regexp_replace(string(ctx, s), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))


@verb("wordCount")
def word_count(ctx, s):
    return F.coalesce(F.size(F.filter(F.split(string(ctx, s), r"(?U)\s+", -1), lambda x: x != "")), F.lit(0))


@verb("tokenize")
def tokenize(ctx, s, mark=None):
    value = ctx.value(mark) if mark is not None else None
    parts = F.split(string(ctx, s), re.escape(value) if value else r"(?U)\s+", -1)
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


@verb("levenshtein")
def levenshtein(ctx, a, b):
    a, b = string(ctx, a), string(ctx, b)
    return F.when((F.octet_length(a) <= 10_000) & (F.octet_length(b) <= 10_000), F.levenshtein(a, b))


@verb("soundex")
def soundex(ctx, s):
    """First letter and up to three codes; every vowel, and H, W and Y, ends a run of equal codes."""
    letters = F.upper(F.regexp_replace(string(ctx, s), "[^A-Za-z]", ""))
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    step = lambda st, c: F.struct(F.when((c != "0") & (c != st["last"]), F.concat(st["out"], c)).otherwise(st["out"]).alias("out"), c.alias("last"))
    folded = let(codes, lambda c: F.aggregate(F.split(F.substring(c, 2, WIDE), "", -1), F.struct(F.lit("").alias("out"), F.substring(c, 1, 1).alias("last")), step, lambda st: st["out"]))
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), folded), 4, "0"))


@verb("template")
def template(ctx, form, values):
    value, t = ctx.value(form), ctx.type(values)
    if not isinstance(value, str):
        raise TransformError("T002", "a template must be a literal")
    out = []
    for k, part in enumerate(re.split(r"\{([^{}]*)\}", value)):
        if k % 2 == 0:
            out.append(F.lit(part))
        elif isinstance(t, T.StructType):
            out.append(F.coalesce(fmt(ctx, values[part]), F.lit("")) if part in t.names else F.lit(""))
        else:
            out.append(F.coalesce(F.try_element_at(values, F.lit(part)).cast("string"), F.lit("")))
    return F.concat(*out)


# Digits of a number, and its layout by country; the second layout drops a leading trunk code.
PHONES = {
    "US": [(r"^1?(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")],
    "CA": [(r"^1?(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")],
    "GB": [(r"^(\d{4})(\d{3})(\d{4})$", "$1 $2 $3"), (r"^44(\d{4})(\d{6})$", "+44 $1 $2")],
    "DE": [(r"^(\d{4})(\d{7})$", "$1 $2"), (r"^49(\d{3})(\d{8})$", "+49 $1 $2")],
    "FR": [(r"^(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1 $2 $3 $4 $5")],
    "AU": [(r"^(\d{4})(\d{3})(\d{3})$", "$1 $2 $3")],
    "JP": [(r"^(\d{3})(\d{4})(\d{4})$", "$1-$2-$3")],
}


@verb("formatPhone")
def format_phone(ctx, s, country):
    raw = fmt(ctx, s)
    digits, out = F.regexp_replace(raw, r"\D", ""), raw
    for form, layout in PHONES.get(str(ctx.value(country)).upper(), [])[::-1]:
        out = F.when(F.rlike(digits, F.lit(form)), F.regexp_replace(digits, form, layout)).otherwise(out)
    return out


def _escaped(s: Column, quote: str) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


@verb("escapeHtml")
def escape_html(ctx, s):
    return _escaped(string(ctx, s), "&#39;")


@verb("escapeXml")
def escape_xml(ctx, s):
    return _escaped(string(ctx, s), "&apos;")


@verb("unescapeHtml")
def unescape_html(ctx, s):
    """Entities decoded in one pass: the text is cut at each, so nothing that a decoding makes is decoded again."""
    s = string(ctx, s)
    entity = r"&(?:amp|lt|gt|quot|apos|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"
    found = F.regexp_extract_all(s, F.lit(entity), F.lit(0))
    between = F.split(s, entity, -1)
    named = F.create_map(*(F.lit(x) for pair in {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}.items() for x in pair))

    def decode(e):
        code = F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);$", 1), 16, 10).try_cast("long")).otherwise(F.regexp_extract(e, r"(\d+);$", 1).try_cast("long"))
        utf8 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")
        return F.coalesce(F.try_element_at(named, e), F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), utf8), e)

    return F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(decode(F.get(found, i)), F.lit("")))), "")


@verb("stripTags")
def strip_tags(ctx, s):
    return F.replace(F.regexp_replace(string(ctx, s), r"<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))
