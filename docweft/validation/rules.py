"""Validation: every rule is a column, a row's errors are one array; no Python runs on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions.values import number_format

from .formats import is_format
from .schema import Field, Schema, expand, parse_schema

ERROR = "struct<path:string,code:string,message:string>"
#: Bounds of patterns: length, nesting of groups, quantifiers.
PATTERN_LENGTH, PATTERN_DEPTH, PATTERN_QUANTIFIERS = 1024, 10, 20


def safe_pattern(pattern: str) -> bool:
    """Whether a regular expression is short and flat enough, and has no quantified group with a quantifier inside."""
    depth = deepest = 0
    plain = re.sub(r"\\.", "", pattern)
    for c in plain:
        depth += (c == "(") - (c == ")")
        deepest = max(deepest, depth)
    nested = re.search(r"\([^()]*[+*][^()]*\)[+*{]", plain)
    try:
        re.compile(pattern)
    except re.error:
        return False
    return len(pattern) <= PATTERN_LENGTH and deepest <= PATTERN_DEPTH and len(re.findall(r"[+*?{]", plain)) <= PATTERN_QUANTIFIERS and not nested


def kind_of(t: T.DataType) -> str:
    table = [(T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.DecimalType, "currency"), (T.NumericType, "number"), (T.DateType, "date"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp"), (T.BinaryType, "binary"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object")]
    return next((name for kind, name in table if isinstance(t, kind)), "string")


#: Kinds that stand for a declared kind.
ACCEPTED = {"number": {"number", "integer", "currency", "percent"}, "currency": {"currency", "number", "integer"}, "percent": {"percent", "number", "integer"}, "reference": {"string"}, "time": {"string"}, "duration": {"string"}, "enum": {"string"}, "binary": {"binary", "string"}}


class Place:
    """Columns of a table by dotted path, with their types."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def get(self, path: str) -> tuple[Column | None, T.DataType | None]:
        t: T.DataType = self.schema
        column: Column | None = None
        for step in path.split("."):
            if not isinstance(t, T.StructType) or step not in t.names:
                return None, None
            t, column = t[step].dataType, (F.col(f"`{step}`") if column is None else column[step])
        return column, t


def _text(c: Column, t: T.DataType) -> Column:
    return number_format(c.cast("double")) if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else c.cast("string")


def _compare(left: Column, t: T.DataType, op: str, right: str) -> Column:
    numeric = isinstance(t, T.NumericType)
    value = F.lit(float(right)) if numeric and re.fullmatch(r"[-+]?[\d.]+", right) else F.lit(right)
    c = left.cast("double") if numeric else left.cast("string")
    tests = {"=": c == value, "==": c == value, "!=": c != value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}
    return F.coalesce(tests[op], F.lit(False))


def field_errors(place: Place, path: str, f: Field) -> list[Column]:
    """Errors of one field, each a nullable struct."""
    c, t = place.get(path)

    def error(test: Column, code: str, message: str) -> Column:
        return F.when(test, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message")))

    here = F.lit(True)
    if f.condition:
        other, ot = place.get(f.condition[0] if "." in f.condition[0] or "." not in path else f"{path.rpartition('.')[0]}.{f.condition[0]}")
        test = F.lit(False) if other is None else _compare(other, ot, f.condition[1], f.condition[2])
        here = test if f.condition[3] else ~test
    owner = next((x[7:] for x in f.flags if x.startswith("within:")), None)
    if owner:
        above, _ = place.get(owner)
        here = here & (above.isNotNull() if above is not None else F.lit(False))
    required = f.required or f.condition is not None
    if c is None:
        return [error(here, "V010" if f.condition else "V001", "required field is missing")] if required else []
    out = [error(here & c.isNull(), "V010" if f.condition else "V001", "required field is missing")] if required else []
    some = c.isNotNull()
    kind = kind_of(t)
    if not any(kind == k or kind in ACCEPTED.get(k, ()) or (k == "type" and kind == "object") or k == "null" for k in f.kinds):
        if kind == "string" and set(f.kinds) & {"date", "timestamp"}:  # texts in ISO form will do
            form = r"^\d{4}-\d{2}-\d{2}$" if "date" in f.kinds else r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
            out.append(error(some & ~F.rlike(c, F.lit(form)), "V002", f"expected {' or '.join(f.kinds)}"))
        else:
            return [*out, error(some, "V002", f"expected {' or '.join(f.kinds)}, found {kind}")]
    if f.bounds:
        low, high = f.bounds
        if isinstance(t, T.NumericType):
            v, make = c.cast("double"), lambda x: F.lit(float(x))
        elif kind in ("date", "timestamp"):
            v, make = c.cast("string"), lambda x: F.lit(str(x))
        elif isinstance(t, T.BinaryType):
            v, make = F.octet_length(c), lambda x: F.lit(int(x))
        else:
            iso = isinstance(low, str) or isinstance(high, str)
            v, make = (c, lambda x: F.lit(str(x))) if iso else (F.octet_length(c), lambda x: F.lit(int(x)))
        bad = F.lit(False)
        if low is not None:
            bad = bad | (v < make(low))
        if high is not None:
            bad = bad | (v > make(high))
        out.append(error(some & bad, "V003", f"not in {low}..{high}"))
    if f.pattern is not None:
        out.append(error(some & ~F.rlike(_text(c, t), F.lit(f.pattern)) if safe_pattern(f.pattern) else some, "V004", "does not match the pattern"))
    if f.enum:
        out.append(error(some & ~_text(c, t).isin(*f.enum), "V005", f"not one of {', '.join(f.enum)}"))
    if f.format:
        test = is_format(_text(c, t), f.format)
        if test is not None:
            out.append(error(some & ~test, "V004", f"no {f.format}"))
    return out


TOKEN = re.compile(r"\s*(\|\||&&|==|!=|>=|<=|[-+*/%!<>()=]|\"[^\"]*\"|[\d.]+|[A-Za-z_][\w.]*)")
LEVELS = [("||",), ("&&",), ("==", "!=", "="), (">", "<", ">=", "<="), ("+", "-"), ("*", "/", "%")]


def invariant(text: str, look) -> tuple[Column, list[Column]]:
    """An expression over sibling fields as a column, with the operands that must be present."""
    found, at = TOKEN.findall(text), 0
    used: list[Column] = []

    def binary(level: int) -> Column:
        nonlocal at
        if level == len(LEVELS):
            return unary()
        left = binary(level + 1)
        while at < len(found) and found[at] in LEVELS[level]:
            op = found[at]
            at += 1
            right = binary(level + 1)
            left = {"||": lambda: left | right, "&&": lambda: left & right, "==": lambda: left == right, "=": lambda: left == right, "!=": lambda: left != right, ">": lambda: left > right, "<": lambda: left < right, ">=": lambda: left >= right, "<=": lambda: left <= right, "+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "/": lambda: F.try_divide(left, right), "%": lambda: F.try_mod(left, right)}[op]()
        return left

    def unary() -> Column:
        nonlocal at
        word = found[at]
        at += 1
        if word == "!":
            return ~unary()
        if word == "-":
            return -unary()
        if word == "(":
            inner = binary(0)
            at += 1
            return inner
        if word.startswith('"'):
            return F.lit(word[1:-1])
        if word[0].isdigit() or word[0] == ".":
            return F.lit(float(word))
        if word in ("true", "false"):
            return F.lit(word == "true")
        column = look(word)
        used.append(column)
        return column

    return binary(0), used


def object_errors(place: Place, where: str, name: str, text: str) -> list[Column]:
    """Errors of an object's invariant (V008) or cardinality (V009)."""

    def look(word: str) -> Column:
        c, t = place.get(f"{where}.{word}" if where else word)
        return F.lit(None).cast("double") if c is None else c.cast("double") if isinstance(t, T.NumericType) else c

    def error(test: Column, code: str, message: str) -> Column:
        return F.when(test, F.struct(F.lit(where).alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message")))

    if name == "invariant":
        test, used = invariant(text, look)
        present = F.lit(True)
        for c in used:
            present = present & c.isNotNull()
        return [error(present & ~test, "V008", f"invariant {text}")]
    m = re.match(r"(?:\((\d*)\.\.(\d*)\))?\s*\(?([^()]*)\)?$", text)
    fields = [x.strip() for x in m[3].split(",") if x.strip()]
    count = sum((look(x).isNotNull().cast("int") for x in fields), F.lit(0))
    low, high = {"exactly_one": (1, 1), "at_most_one": (0, 1), "one_of": (1, len(fields)), "of": (int(m[1] or 0), int(m[2] or len(fields)))}[name]
    return [error(~count.between(low, high), "V009", f"{name}({', '.join(fields)})")]


def array_errors(place: Place, path: str, rule: dict) -> list[Column]:
    """Errors of an array's size (V006) and uniqueness (V007)."""
    c, t = place.get(path)
    if c is None or not isinstance(t, T.ArrayType):
        return []
    error = lambda test, code, message: F.when(c.isNotNull() & test, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message")))
    out = []
    if rule.get("min") is not None:
        out.append(error(F.size(c) < rule["min"], "V006", f"fewer than {rule['min']} items"))
    if rule.get("max") is not None:
        out.append(error(F.size(c) > rule["max"], "V006", f"more than {rule['max']} items"))
    if rule.get("unique"):
        out.append(error(F.size(F.array_distinct(c)) < F.size(c), "V007", "items are not unique"))
    return out


def validate(df: DataFrame, schema: Schema | str, keep: list[str], strict: bool = False, fail_fast: bool = False) -> DataFrame:
    """Columns `keep`, `valid` and `errors` of each row.

    A required field that is absent reports V001 (V010 under a condition) and
    nothing else. With strict, columns that the schema does not know report V011.
    """
    schema = expand(parse_schema(schema) if isinstance(schema, str) else schema)
    place, errors = Place(df), []
    for path, f in schema.fields.items():
        if "[]" not in path:
            errors += field_errors(place, path, f)
    for path, rule in schema.arrays.items():
        errors += array_errors(place, path, rule)
    for where, name, text in schema.rules:
        errors += object_errors(place, where, name, text)
    if strict:
        known = {p.split(".")[0].removesuffix("[]") for p in [*schema.fields, *schema.arrays]}
        for name in df.columns:
            if name not in known and name not in keep:
                errors.append(F.when(F.col(f"`{name}`").isNotNull(), F.struct(F.lit(name).alias("path"), F.lit("V011").alias("code"), F.lit("unknown field").alias("message"))))
    found = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast(f"array<{ERROR}>")
    found = F.slice(found, 1, 1) if fail_fast else found
    return df.select(*keep, found.alias("errors")).select(*keep, (F.size("errors") == 0).alias("valid"), "errors")


def validate_references(table: DataFrame) -> DataFrame:
    """doc_id, path and code of references that lead nowhere (V012) or in a circle (V013), over a path table."""
    from docweft.operators.documents import resolve_references

    return resolve_references(table).filter("error IS NOT NULL").select("doc_id", "path", F.col("error").alias("code"))


def validate_unknown(table: DataFrame, paths: list[str]) -> DataFrame:
    """doc_id and path of what a schema does not name (V011): an anti-join on the path without its indexes."""
    known = table.sparkSession.createDataFrame([(p,) for p in paths], "known string")
    bare = F.regexp_replace("path", r"\[\d+\]", "[]")
    return table.withColumn("known", bare).join(F.broadcast(known), "known", "left_anti").select("doc_id", "path", F.lit("V011").alias("code"))
