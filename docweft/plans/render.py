"""From a source to formatted text in one call: a transform's {$source} and {$target} blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions.values import TransformError
from docweft.sources import readers, writers

from .compiler import Compiler
from .spec import Segment, Transform, parse_transform

#: Depth and number of imports that are followed.
IMPORT_DEPTH, IMPORTS = 32, 100


def with_imports(text: str, load: Callable[[str], str], depth: int = 0, seen: tuple[str, ...] = (), count: list[int] | None = None) -> Transform:
    """A transform with what it imports: constants, tables, accumulators and segments, its own ones winning.

    With an alias, imported names of constants and tables begin with it and a dot.
    Circles, and imports beyond the limits, raise T008.
    """
    count = count if count is not None else [0]
    spec = parse_transform(text)
    for path, alias in spec.imports:
        count[0] += 1
        if path in seen or depth >= IMPORT_DEPTH or count[0] > IMPORTS:
            raise TransformError("T008", f"cannot import {path}")
        other = with_imports(load(path), load, depth + 1, (*seen, path), count)
        name = lambda k, alias=alias: f"{alias}.{k}" if alias else k
        spec.constants = {**{name(k): v for k, v in other.constants.items()}, **spec.constants}
        spec.tables = {**{name(k): v for k, v in other.tables.items()}, **spec.tables}
        spec.accumulators = {**other.accumulators, **spec.accumulators}
        spec.persistent |= other.persistent
        own = {s.name for s in spec.segments}
        spec.segments = [s for s in other.segments if s.name not in own] + spec.segments
    return spec


def target_of(spec: Transform) -> dict[str, str]:
    """The target's options as texts; the format may also stand in the direction, as in `json->csv`."""
    options = {k.removeprefix("target."): str(v) for k, v in spec.metadata.items() if k.startswith("target.") and v is not None}
    if "format" not in options:
        options["format"] = str(spec.option("direction", "")).rpartition("->")[2] or "json"
    return options


def _yes(options: dict[str, str], name: str, default: bool = False) -> bool:
    return options.get(name, str(default)).lower() in ("true", "1", "yes")


def json_of(df: DataFrame, options: dict[str, str]) -> Column:
    """indent (0: compact, else by two spaces), nulls = omit, emptyArrays = omit."""
    pretty = int(float(options.get("indent", 2))) > 0
    out = writers.json_text(df, False, options.get("nulls", "include"))
    if options.get("emptyArrays") == "omit":
        out = F.regexp_replace(F.regexp_replace(out, r',"(?:[^"\\]|\\.)*":\[\]', ""), r'(?<=\{)"(?:[^"\\]|\\.)*":\[\],?', "")
    if pretty:
        schema = df.schema
        parsed = F.from_json(out, schema)
        laid = F.to_json(parsed, {"pretty": "true", "ignoreNullFields": str(options.get("nulls") == "omit" or options.get("emptyArrays") == "omit").lower()})
        out = F.regexp_replace(laid, r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ")
    return out


def records(df: DataFrame) -> list[tuple[str, Column, T.StructType, bool]]:
    """Name, column, fields and whether it is a list, of each part of a document that has records."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out.append((f.name, F.col(f"`{f.name}`"), f.dataType, False))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append((f.name, F.col(f"`{f.name}`"), f.dataType.elementType, True))
    return out


def csv_of(df: DataFrame, options: dict[str, str]) -> Column:
    """The first list of records (else the first record) as a table with a header line."""
    parts = sorted(records(df), key=lambda r: not r[3])
    if not parts:
        return F.lit("")
    _, c, t, many = parts[0]
    mark = options.get("delimiter", ",")
    line = lambda x: writers.csv_cells([writers.cell(x[f.name], f.dataType) for f in t.fields], mark)
    rows = F.array_join(F.transform(c, line), "\n") if many else line(c)
    head = writers.csv_cells([F.lit(n) for n in t.names], mark)
    return F.concat_ws("\n", head, rows) if _yes(options, "header", True) else rows


def places(segment: Segment) -> list[tuple[str, int, int, bool, str]]:
    """Name, start, length, whether right-aligned and pad sign of each placed field of a segment."""
    out = []
    for m in segment.mappings:
        given = dict(m.directives)
        if "pos" in given and "len" in given:
            pad = given.get("leftPad", given.get("rightPad", "")).strip('"')
            sign = pad.partition(",")[2] or pad if len(pad) <= 1 or "," in pad else ""  # the length is the field's
            out.append((m.target, int(given["pos"]), int(given["len"]), "leftPad" in given, sign))
    return sorted(out, key=lambda x: x[1])


def fixed_of(spec: Transform, df: DataFrame, options: dict[str, str]) -> Column:
    """A line for each record, its fields at their places: lineWidth, padChar and lineEnding from the target."""
    fill = options.get("padChar", " ")
    lines = []
    for name, c, t, many in records(df):
        segment = next(s for s in spec.segments if (s.name or "root") == name)

        def line(x: Column, t=t, fields=places(segment)) -> Column:
            parts, at = [], 0
            for field, start, count, right, sign in fields:
                parts.append(F.lit(fill * (start - at)))
                value = F.substring(F.coalesce(writers.cell(x[field], t[field].dataType), F.lit("")), 1, count)
                parts.append((F.lpad if right else F.rpad)(value, count, sign or fill))
                at = start + count
            whole = F.concat(*parts) if parts else F.lit("")
            width = int(float(options.get("lineWidth", 0)))
            return F.when(F.length(whole) < width, F.rpad(whole, width, fill)).otherwise(whole)

        lines.append(F.transform(c, line) if many else F.array(line(c)))
    ending = options.get("lineEnding", "\n").replace("\\r", "\r").replace("\\n", "\n")
    return F.array_join(F.flatten(F.array(*lines)), ending) if lines else F.lit("")


def xml_of(df: DataFrame, options: dict[str, str]) -> Column:
    """The document as elements, under `rootElement` if there is one; `@x` fields are attributes."""
    hints = _yes(options, "typeHints")
    parts = [writers.xml_text(f.name, F.col(f"`{f.name}`"), f.dataType, hints) for f in df.schema.fields]
    body = F.concat(*parts) if parts else F.lit("")
    root = options.get("rootElement")
    out = F.concat(F.lit(f"<{root}>"), body, F.lit(f"</{root}>")) if root else body
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), out) if _yes(options, "declaration", True) else out


def formatted(spec: Transform, df: DataFrame) -> Column:
    """The text of each document in the target's format; an unknown format falls back to JSON."""
    options = target_of(spec)
    kind = options["format"]
    if kind == "csv":
        return csv_of(df, options)
    if kind == "xml":
        return xml_of(df, options)
    if kind == "fixed-width":
        return fixed_of(spec, df, options)
    if kind == "flat" or kind == "properties":
        return writers.yaml_text(F.struct(*df.columns), df.schema) if options.get("style") == "yaml" else writers.flat_text(df)
    if kind == "yaml":
        return writers.yaml_text(F.struct(*df.columns), df.schema)
    if kind == "odin":
        return writers.notation_text(df, header=_yes(options, "header"))
    return json_of(df, options)


def render(text: str | Transform, frame: DataFrame, keep: list[str] | None = None, custom=None) -> DataFrame:
    """Columns `keep`, the formatted text of each row's document, and its errors."""
    spec = parse_transform(text) if isinstance(text, str) else text
    kept = [F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep or [])]
    compiler = Compiler(spec, frame, custom)
    compiler.placed = target_of(spec)["format"] == "fixed-width"
    out = compiler.run(kept)
    inner = out.select(*(F.col(f"`{c}`") for c in out.columns if c != "errors" and not c.startswith("__keep")))
    return out.select(*(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep or [])), formatted(spec, inner).alias("text"), "errors")


def run_files(text: str, spark: SparkSession, source: str, target: str, load: Callable[[str], str] | None = None, custom=None, **options) -> DataFrame:
    """Read by the source's format, transform, and write the texts to `target`; what was written is returned."""
    spec = with_imports(text, load) if load else parse_transform(text)
    kind = str(spec.option("source.format", "") or str(spec.option("direction", "")).partition("->")[0] or "json")
    frame = readers.read_source(spark, kind, source, **options)
    render(spec, frame, custom=custom).select(F.col("text").alias("value")).write.text(target)
    return spark.read.text(target)
