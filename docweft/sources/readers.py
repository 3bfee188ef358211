"""Readers: each gives a DataFrame; Spark's own sources do the work where one exists."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.values import TransformError
from docweft.plans import notation

PATHS = "doc_id string, doc_seq int, pos int, path string, type string, value string, required boolean, confidential boolean, deprecated boolean"
XML_DEPTH = 100


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """JSON files; one object or array per file, or an object per line with multi_line=False (which splits files)."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", schema=None, multi_line: bool = True) -> DataFrame:
    """RFC 4180 files, quoted line breaks included; multi_line=False if no cell has one, which lets Spark split files. Cells stay texts without a schema: typed per cell by `infer_cell`, never by an extra pass."""
    reader = spark.read.options(header=header, sep=delimiter, quote='"', escape='"', multiLine=multi_line)
    out = (reader.schema(schema) if schema is not None else reader).csv(path)
    return out if schema is not None else out.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns))


def infer_cell(c: Column) -> Column:
    """A cell as VARIANT: boolean, null, integer, number or text."""
    s = F.trim(c)
    plain = F.when(F.lower(s).isin("true", "false"), F.lower(s)).when(s.isin("", "null", "~"), F.lit("null")).when(F.rlike(s, F.lit(r"^[-+]?\d{1,18}$")), s.try_cast("bigint").cast("string")).when(F.rlike(s, F.lit(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")), s.try_cast("double").cast("string"))
    return F.coalesce(F.try_parse_json(plain), F.try_variant_get(F.try_parse_json(F.to_json(F.struct(c.alias("v")))), "$.v", "variant"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    """XML elements as rows: attributes with `@`, mixed text as `_text`, repeated elements as arrays."""
    reader = spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@", valueTag="_text", inferSchema=schema is None)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int]]) -> DataFrame:
    """Lines cut into (name, start, length), blanks at the right removed."""
    return cut_fixed_width(spark.read.text(path), fields)


def cut_fixed_width(lines: DataFrame, fields: list[tuple[str, int, int]]) -> DataFrame:
    return lines.select(*(F.rtrim(F.substring("value", start + 1, count)).alias(name) for name, start, count in fields))


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """`a.b[0].c = v` files as doc_id (file), pos, path and value; `#` and `;` begin comments, `~` and nothing are null."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return cut_flat(lines.select("doc_id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")))


def cut_flat(lines: DataFrame) -> DataFrame:
    """doc_id, pos and line as doc_id, pos, path and value."""
    rows = lines.filter(F.rlike(F.col("line"), F.lit(r"^\s*[^#;\s][^=]*=")))
    value = F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1))
    unquoted = F.when(F.rlike(value, F.lit(r'^".*"$')), F.regexp_replace(F.regexp_extract(value, r'^"(.*)"$', 1), r'\\(["\\])', "$1")).otherwise(value)
    return rows.select("doc_id", "pos", F.trim(F.substring_index("line", "=", 1)).alias("path"), F.when(~value.isin("", "~"), unquoted).alias("value"))


def _scalar(s: str):
    low = s.lower()
    if s.startswith(("'", '"')) and s.endswith(s[0]) and len(s) > 1:
        return s[1:-1].replace("''", "'") if s[0] == "'" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1])
    if low in ("", "null", "~"):
        return None
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def parse_yaml(text: str):
    """Block maps, lists and scalars, nested by indentation."""
    lines = []
    for raw in text.split("\n"):
        body = re.sub(r"\s+#(?=(?:[^\"']*[\"'][^\"']*[\"'])*[^\"']*$).*$", "", raw.rstrip())
        if body.strip() and not body.lstrip().startswith("#") and body.strip() not in ("---", "..."):
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def block(k: int, indent: int):
        if lines[k][1].startswith("- ") or lines[k][1] == "-":
            out: list = []
            while k < len(lines) and lines[k][0] == indent and lines[k][1].startswith("-"):
                rest = lines[k][1][1:].strip()
                if not rest:
                    k += 1
                    value, k = block(k, lines[k][0]) if k < len(lines) and lines[k][0] > indent else (None, k)
                elif re.match(r"^[^\"'\s][^:]*:(\s|$)", rest):
                    lines[k] = (indent + len(lines[k][1]) - len(rest), rest)
                    value, k = block(k, lines[k][0])
                else:
                    value, k = _scalar(rest), k + 1
                out.append(value)
            return out, k
        tree: dict = {}
        while k < len(lines) and lines[k][0] == indent and not lines[k][1].startswith("- "):
            m = re.match(r"^(\"[^\"]*\"|'[^']*'|[^:]+):(?:\s+(.*))?$", lines[k][1])
            if not m:
                return _scalar(lines[k][1]), k + 1
            key, rest = str(_scalar(m[1].strip()) if m[1][0] in "\"'" else m[1].strip()), (m[2] or "").strip()
            k += 1
            if rest:
                tree[key] = _scalar(rest)
            elif k < len(lines) and (lines[k][0] > indent or (lines[k][0] == indent and lines[k][1].startswith("-"))):
                tree[key], k = block(k, lines[k][0])
            else:
                tree[key] = None
        return tree, k

    return block(0, lines[0][0])[0] if lines else None


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file) and `doc`, the parsed tree as VARIANT."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "json": [json.dumps(parse_yaml(t)) for t in pdf["value"]]})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return files.mapInPandas(parse, "doc_id string, json string").select("doc_id", F.parse_json("json").alias("doc"))


def parse_notation(texts: DataFrame) -> DataFrame:
    """Texts of the typed notation (doc_id, value) as a path table; a text's further documents count on doc_seq."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["value"], strict=True):
                for seq, doc in enumerate(notation.parse_documents(text or "")):
                    for pos, (path, v) in enumerate(doc.assignments.items()):
                        rows.append((str(doc_id), seq, pos, path, v.kind, None if v.kind == "null" else notation.plain(v), "!" in v.modifiers, "*" in v.modifiers, "-" in v.modifiers))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_seq", "pos", "path", "type", "value", "required", "confidential", "deprecated"])

    return texts.select(F.col("doc_id").cast("string").alias("doc_id"), "value").mapInPandas(parse, PATHS)


def read_notation(spark: SparkSession, path: str) -> DataFrame:
    return parse_notation(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value"))


READERS = {"json": read_json, "csv": read_csv, "xml": read_xml, "fixed-width": read_fixed_width, "flat": read_flat, "properties": read_flat, "yaml": read_yaml, "odin": read_notation}


def read_source(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Read by the format's name; fixed-width needs its fields."""
    if name not in READERS or (name == "fixed-width" and "fields" not in options):
        raise TransformError("T006", f"cannot read {name}")
    return READERS[name](spark, path, **options)


# the workers get these functions by value and need no copy of the package
for _module in (notation, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)
