"""Queries that write files in each format and read them back, render by target, compare mixed types, check codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.operators.stages import stage_dir
from docweft.plans.compiler import select
from docweft.plans.render import render, run_files
from docweft.sources import readers, writers
from docweft.validation import formats

from .tables import read
from .verbs import tidy


def _nation(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


def json_file(spark, sf):
    path = stage_dir(spark)
    writers.write_target(_nation(spark, sf), "json", path)
    return readers.read_source(spark, "json", path, multi_line=False).select("n_nationkey", "n_name", "n_regionkey")


def csv_file(spark, sf):
    """Cells with delimiters, quotes and line breaks."""
    path = stage_dir(spark)
    df = read(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"\nnext')).alias("name"))
    writers.write_target(df, "csv", path)
    return readers.read_source(spark, "csv", path)


def xml_file(spark, sf):
    path = stage_dir(spark)
    writers.write_target(_nation(spark, sf).withColumnRenamed("n_nationkey", "@id"), "xml", path, row_tag="nation", root_tag="nations")
    back = readers.read_source(spark, "xml", path, row_tag="nation", schema="`@id` BIGINT, n_name STRING, n_regionkey BIGINT")
    return back.select(F.col("@id").alias("id"), "n_name", "n_regionkey")


def fixed_file(spark, sf):
    path, fields = stage_dir(spark), [("c_custkey", 0, 8), ("c_mktsegment", 10, 12)]
    writers.write_target(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "fixed-width", path, fields=fields, width=24)
    return readers.read_source(spark, "fixed-width", path, fields=fields)


def flat_file(spark, sf):
    path = stage_dir(spark)
    lines = read(spark, sf, "nation").select(F.format_string('n[%d].name = "%s"', "n_nationkey", "n_name").alias("value"))
    lines.coalesce(1).write.text(path)
    return tidy(readers.read_source(spark, "flat", path).select("path", "value"))


def yaml_file(spark, sf):
    path = stage_dir(spark)
    read(spark, sf, "region").select(F.format_string("%s:\n  key: %d", F.replace("r_name", F.lit(" "), F.lit("_")), "r_regionkey").alias("value")).coalesce(1).write.text(path)
    return readers.read_source(spark, "yaml", path).select(F.to_json("doc").alias("doc"))


def notation_file(spark, sf):
    """One file of many documents, each with a table."""
    path = stage_dir(spark)
    text = F.format_string('id = ##%d\n{rows[] : a, b}\n##%d, "%s"\n##%d, "x"\n---', "n_nationkey", "n_regionkey", "n_name", "n_nationkey")
    read(spark, sf, "nation").orderBy("n_nationkey").select(text.alias("value")).coalesce(1).write.text(path)
    rows = readers.read_source(spark, "odin", path)
    ids = rows.filter("path = 'id'").select("doc_seq", F.col("value").alias("id"))
    return tidy(rows.filter("path <> 'id'").join(ids, "doc_seq").select("id", "path", "type", "value"))


TARGET_JSON = """
{$}
odin = "1.0.0"
direction = "json->json"
{$target}
indent = ##0
nulls = "omit"
emptyArrays = "omit"
{nation}
key = @.n_nationkey
name = %lower @.n_name
gone = @.n_missing
none = %filter @.tags "" "=" "z"
"""

TARGET_FIXED = """
{$}
odin = "1.0.0"
direction = "json->fixed-width"
{$target}
lineWidth = ##24
padChar = "."
{nation}
key = @.n_nationkey :pos 0 :len 6 :leftPad 0
name = @.n_name :pos 8 :len 10
"""

TARGET_CSV = """
{$}
odin = "1.0.0"
direction = "csv->csv"
{$target}
format = "csv"
delimiter = ";"
{row}
key = ##@.n_nationkey
name = %lower @.n_name
"""


def json_target(spark, sf):
    df = _nation(spark, sf).withColumn("tags", F.array("n_name"))
    return tidy(render(TARGET_JSON, df, ["n_nationkey"]).select("n_nationkey", "text"))


def fixed_target(spark, sf):
    return tidy(render(TARGET_FIXED, _nation(spark, sf), ["n_nationkey"]).select("n_nationkey", "text"))


def csv_to_csv(spark, sf):
    """Source file to target file in one call."""
    source = stage_dir(spark)
    writers.write_target(_nation(spark, sf), "csv", source)
    return run_files(TARGET_CSV, spark, source, stage_dir(spark)).select(F.col("value").alias("line"))


def comparators(spark, sf):
    """Both comparators on nulls and mixed types."""
    k = F.col("o_custkey").cast("bigint")
    item = lambda n, t: F.struct(n.alias("n"), t.alias("t"))
    items = F.array(item(F.lit(None).cast("bigint"), F.lit("9")), item(k, k.cast("string")), item(F.lit(2).cast("bigint"), F.lit("b")))
    df = read(spark, sf, "orders").select("o_orderkey", items.alias("items"))
    expressions = {
        "ne_null": '%count %filter @items "n" "!=" ##1', "text_over_number": '%count %filter @items "t" ">" ##5', "text_is_number": '%count %filter @items "t" "=" ##9', "number_contains": '%count %filter @items "n" "contains" "1"',
        "coerced_less": '%countIf @items "t" "<" "10"', "coerced_contains": '%countIf @items "n" "contains" "1"', "coerced_ne": '%countIf @items "n" "!=" "2"', "sum_null": '%sumIf @items "t" "!=" "" "n"', "avg_null": '%avgIf @items "t" "!=" "" "n"',
    }
    return tidy(select(df, ["o_orderkey"], expressions))


def code_checks(spark, sf):
    """Code lists over the beginnings of all nations' names."""
    start = lambda n: F.upper(F.substring("n_name", 1, n))
    return read(spark, sf, "nation").select("n_nationkey", formats.is_format(start(2), "country-alpha2").alias("alpha2"), formats.is_format(start(3), "country-alpha3").alias("alpha3"), formats.is_format(start(3), "currency-code").alias("currency"), formats.is_format(start(2), "state-us").alias("state"))


QUERIES = {
    "file_json": json_file, "file_csv": csv_file, "file_xml": xml_file, "file_fixed_width": fixed_file, "file_flat": flat_file, "file_yaml": yaml_file, "file_notation": notation_file,
    "target_json": json_target, "target_fixed_width": fixed_target, "target_csv_files": csv_to_csv, "comparators": comparators, "format_codes": code_checks,
}


def _listed(codes: str) -> str:
    return ", ".join(f"'{c}'" for c in codes.split())


SQL = {
    "file_json": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "file_csv": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "x"' || chr(10) || 'next' AS name FROM customer""",
    "file_xml": "SELECT n_nationkey AS id, n_name, n_regionkey FROM nation",
    "file_fixed_width": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer",
    "file_flat": "SELECT 'n[' || n_nationkey || '].name' AS path, n_name AS value FROM nation",
    "file_yaml": """SELECT '{' || string_agg('"' || replace(r_name, ' ', '_') || '":{"key":' || r_regionkey || '}', ',' ORDER BY replace(r_name, ' ', '_')) || '}' AS doc FROM region""",
    "file_notation": """SELECT CAST(n_nationkey AS VARCHAR) AS id, x.path AS path, x.t AS type, x.v AS value FROM (SELECT n_nationkey, unnest([{'path': 'rows[0].a', 't': 'integer', 'v': CAST(n_regionkey AS VARCHAR)}, {'path': 'rows[0].b', 't': 'string', 'v': n_name}, {'path': 'rows[1].a', 't': 'integer', 'v': CAST(n_nationkey AS VARCHAR)}, {'path': 'rows[1].b', 't': 'string', 'v': 'x'}]) AS x FROM nation)""",
    "target_json": """SELECT n_nationkey, '{"nation":{"key":' || n_nationkey || ',"name":"' || lower(n_name) || '"}}' AS text FROM nation""",
    "target_fixed_width": "SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') || '..' || rpad(left(n_name, 10), 10, '.') || '......' AS text FROM nation",
    "target_csv_files": "SELECT unnest(['key;name', n_nationkey || ';' || lower(n_name)]) AS line FROM nation",
    "comparators": """SELECT o_orderkey, CAST(2 + CAST(o_custkey <> 1 AS INT) AS BIGINT) AS ne_null, CAST(0 AS BIGINT) AS text_over_number, CAST(1 + CAST(o_custkey = 9 AS INT) AS BIGINT) AS text_is_number, CAST(0 AS BIGINT) AS number_contains,
CAST(2 + CAST(o_custkey < 10 AS INT) AS BIGINT) AS coerced_less, CAST(CAST(contains(CAST(o_custkey AS VARCHAR), '1') AS INT) AS BIGINT) AS coerced_contains, CAST(1 + CAST(o_custkey <> 2 AS INT) AS BIGINT) AS coerced_ne, CAST(o_custkey + 2 AS DOUBLE) AS sum_null, (o_custkey + 2) / 3.0 AS avg_null FROM orders""",
    "format_codes": f"SELECT n_nationkey, upper(left(n_name, 2)) IN ({_listed(formats.COUNTRIES_2)}) AS alpha2, upper(left(n_name, 3)) IN ({_listed(formats.COUNTRIES_3)}) AS alpha3, upper(left(n_name, 3)) IN ({_listed(formats.CURRENCIES)}) AS currency, upper(left(n_name, 2)) IN ({_listed(formats.STATES)}) AS state FROM nation",
}
