"""Formatters (a column of text per row) and writers (files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions.values import number_format


def _text(c: Column, t: T.DataType) -> Column:
    return number_format(c.cast("double")) if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else c.cast("string")


def leaves(c: Column, t: T.DataType, path: str = "") -> list[tuple[str, Column, T.DataType]]:
    """Paths of the scalars of a struct, in order; arrays are single leaves."""
    if isinstance(t, T.StructType):
        return [x for f in t.fields for x in leaves(c[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    return [(path, c, t)]


def json_text(df: DataFrame, pretty: bool = False, nulls: str = "keep") -> Column:
    """Each row as JSON; nulls are kept or omitted."""
    return F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower(), "ignoreNullFields": str(nulls == "omit").lower()})


def cell(c: Column, t: T.DataType) -> Column:
    """A scalar's text; nested values as JSON."""
    return F.to_json(c) if isinstance(t, (T.ArrayType, T.StructType, T.MapType)) else _text(c, t)


def csv_cells(values: list[Column], delimiter: str = ",") -> Column:
    """Texts as a CSV line; cells with a delimiter, quote or line end are quoted, nulls are empty."""
    cells = []
    for c in values:
        s = F.coalesce(c, F.lit(""))
        cells.append(F.when(F.rlike(s, F.lit(f'[{delimiter}"\\r\\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s))
    return F.concat_ws(delimiter, *cells)


def csv_text(df: DataFrame, delimiter: str = ",") -> Column:
    """Each row as a CSV line."""
    return csv_cells([_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], delimiter)


def _escape(s: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


#: Names of types in type hints.
HINTS = [(T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.DecimalType, "currency"), (T.NumericType, "number"), (T.DateType, "date"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp")]


def xml_text(name: str, c: Column, t: T.DataType, hints: bool = False) -> Column:
    """A value as an element: struct fields as children, `@x` fields as attributes, array elements repeated."""
    if isinstance(t, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: xml_text(name, x, t.elementType, hints)), "")
    if isinstance(t, T.StructType):
        attributes = [F.concat(F.lit(f' {f.name[1:]}="'), _escape(_text(c[f.name], f.dataType)), F.lit('"')) for f in t.fields if f.name.startswith("@")]
        inner = [F.coalesce(_escape(_text(c[f.name], f.dataType)) if f.name == "_text" else xml_text(f.name, c[f.name], f.dataType, hints), F.lit("")) for f in t.fields if not f.name.startswith("@")]
        return F.concat(F.lit(f"<{name}"), *(F.coalesce(a, F.lit("")) for a in attributes), F.lit(">"), *inner, F.lit(f"</{name}>"))
    hint = next((n for kind, n in HINTS if isinstance(t, kind)), "") if hints else ""
    tag = f'{name} odin:type="{hint}"' if hint else name
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{tag}>"), _escape(_text(c, t)), F.lit(f"</{name}>"))).otherwise(F.lit(f"<{name}/>"))


def fixed_width_text(fields: list[tuple[str, int, int]], schema: T.StructType, width: int, fill: str = " ", align: dict[str, str] | None = None) -> Column:
    """A line of (name, start, length) fields on a background of the fill sign; too long values are cut."""
    line, at = [], 0
    for name, start, count in sorted(fields, key=lambda f: f[1]):
        if start > at:
            line.append(F.lit(fill * (start - at)))
        value = F.coalesce(_text(F.col(name), schema[name].dataType), F.lit(""))
        line.append((F.lpad if (align or {}).get(name) == "right" else F.rpad)(F.substring(value, 1, count), count, fill))
        at = start + count
    if width > at:
        line.append(F.lit(fill * (width - at)))
    return F.concat(*line)


def flat_text(df: DataFrame) -> Column:
    """Each row as sorted `path=value` lines, nulls left out."""
    rows = sorted(leaves(F.struct(*df.columns), T.StructType(df.schema.fields)))
    return F.array_join(F.filter(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{path}="), _text(c, t))) for path, c, t in rows)), lambda x: x.isNotNull()), "\n")


def yaml_text(c: Column, t: T.StructType, indent: int = 0) -> Column:
    """A struct as block YAML in order of key, nulls left out."""
    pad, parts = " " * indent, []
    for f in sorted(t.fields, key=lambda f: f.name):
        x = c[f.name]
        if isinstance(f.dataType, T.StructType):
            parts.append(F.when(x.isNotNull(), F.concat(F.lit(f"{pad}{f.name}:\n"), yaml_text(x, f.dataType, indent + 2))))
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(F.when(x.isNotNull(), F.concat(F.lit(f"{pad}{f.name}:"), F.array_join(F.transform(x, lambda e, f=f: F.concat(F.lit(f"\n{pad}  - "), F.coalesce(_text(e, f.dataType.elementType), F.lit("null")))), ""))))
        else:
            parts.append(F.when(x.isNotNull(), F.concat(F.lit(f"{pad}{f.name}: "), _text(x, f.dataType))))
    return F.concat_ws("\n", *parts)


def notation_value(c: Column, t: T.DataType) -> Column:
    """A scalar with its type's signs."""
    if isinstance(t, T.BooleanType):
        out = c.cast("string")
    elif isinstance(t, T.IntegralType):
        out = F.concat(F.lit("##"), c.cast("string"))
    elif isinstance(t, T.DecimalType):
        out = F.concat(F.lit("#$"), c.cast("string"))
    elif isinstance(t, T.NumericType):
        out = F.concat(F.lit("#"), number_format(c.cast("double")))
    elif isinstance(t, T.DateType):
        out = c.cast("string")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        s = F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        out = F.concat(F.lit('"'), s, F.lit('"'))
    return F.coalesce(out, F.lit("~"))


def notation_text(df: DataFrame, header: bool = False) -> Column:
    """Each row as a document: top-level scalars, then a section per struct, a table per array of structs."""
    parts = [F.lit('{$}\nodin = "1.0.0"\n')] if header else []
    scalars, sections = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            rows = [F.concat(F.lit(f"{p} = "), notation_value(x, t)) for p, x, t in leaves(c, f.dataType) if not isinstance(t, T.ArrayType)]
            sections.append(F.concat(F.lit(f"{{{f.name}}}\n"), F.concat_ws("\n", *rows)))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            inner = f.dataType.elementType
            line = lambda x, inner=inner: F.concat_ws(", ", *(notation_value(x[g.name], g.dataType) for g in inner.fields))
            sections.append(F.concat(F.lit(f"{{{f.name}[] : {', '.join(inner.names)}}}\n"), F.array_join(F.transform(c, line), "\n")))
        elif isinstance(f.dataType, T.ArrayType):
            sections.append(F.concat(F.lit(f"{{{f.name}[] : ~}}\n"), F.array_join(F.transform(c, lambda x, f=f: notation_value(x, f.dataType.elementType)), "\n")))
        else:
            scalars.append(F.concat(F.lit(f"{f.name} = "), notation_value(c, f.dataType)))
    return F.concat_ws("\n", *parts, *scalars, *sections)


def write_json(df: DataFrame, path: str, nulls: str = "keep") -> None:
    df.write.option("ignoreNullFields", str(nulls == "omit").lower()).json(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.options(sep=delimiter, header=header, quote='"', escape='"').csv(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "root") -> None:
    df.write.format("xml").options(rowTag=row_tag, rootTag=root_tag, attributePrefix="@", valueTag="_text").save(path)


def write_text(df: DataFrame, path: str, line: Column) -> None:
    df.select(line.alias("value")).write.text(path)


WRITERS = {
    "json": write_json, "csv": write_csv, "xml": write_xml,
    "fixed-width": lambda df, path, fields, width, **o: write_text(df, path, fixed_width_text(fields, df.schema, width, **o)),
    "flat": lambda df, path, style="kvp": write_text(df, path, yaml_text(F.struct(*df.columns), df.schema) if style == "yaml" else flat_text(df)),
    "odin": lambda df, path, header=False: write_text(df, path, notation_text(df, header)),
}


def write_target(df: DataFrame, name: str, path: str, **options) -> None:
    """Write by the format's name; an unknown one falls back to JSON."""
    WRITERS.get(name, write_json)(df, path, **(options if name in WRITERS else {}))
