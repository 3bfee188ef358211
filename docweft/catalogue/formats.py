"""Queries of the readers, writers, validation and forms, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.forms import paginate
from docweft.sources import readers, writers
from docweft.validation import validate
from docweft.validation.formats import is_format

from .tables import read
from .verbs import tidy


def _nation(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


def json_sink(spark, sf):
    df = _nation(spark, sf)
    return df.select("n_nationkey", writers.json_text(df).alias("text"))


def csv_sink(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("name"), "c_nationkey")
    return df.select("c_custkey", writers.csv_text(df).alias("text"))


def xml_sink(spark, sf):
    df = _nation(spark, sf)
    value = F.struct(F.col("n_nationkey").alias("@id"), F.concat("n_name", F.lit(" & co")).alias("name"), F.col("n_regionkey").alias("region"))
    typed = df.select("n_nationkey", value.alias("v"))
    return typed.select("n_nationkey", writers.xml_text("nation", F.col("v"), typed.schema["v"].dataType, hints=True).alias("text"))


def fixed_sink(spark, sf):
    df = _nation(spark, sf)
    return df.select("n_nationkey", writers.fixed_width_text([("n_nationkey", 0, 5), ("n_name", 6, 10)], df.schema, 20, align={"n_nationkey": "right"}).alias("text"))


def flat_sink(spark, sf):
    df = _nation(spark, sf)
    return df.select("n_nationkey", writers.flat_text(df).alias("text"))


def yaml_sink(spark, sf):
    df = _nation(spark, sf)
    return df.select("n_nationkey", writers.yaml_text(F.struct(*df.columns), df.schema).alias("text"))


def notation_sink(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", "c_name", F.struct("c_nationkey", "c_mktsegment").alias("info"))
    return df.select("c_custkey", writers.notation_text(df).alias("text"))


def notation_source(spark, sf):
    """The notation written and parsed back: paths, types and values."""
    df = read(spark, sf, "customer").select("c_custkey", "c_name", F.struct("c_nationkey", "c_mktsegment").alias("info"))
    texts = df.select(F.col("c_custkey").cast("string").alias("doc_id"), writers.notation_text(df).alias("value"))
    return tidy(readers.parse_notation(texts).select("doc_id", "pos", "path", "type", "value"))


def fixed_source(spark, sf):
    lines = read(spark, sf, "customer").select(F.concat(F.rpad(F.col("c_custkey").cast("string"), 8, " "), F.rpad("c_mktsegment", 12, " ")).alias("value"))
    return readers.cut_fixed_width(lines, [("key", 0, 8), ("segment", 8, 12)])


def flat_source(spark, sf):
    lines = read(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.posexplode(F.array(F.lit("# note"), F.concat(F.lit("name = "), "n_name"), F.concat(F.lit('q = "'), "n_name", F.lit('"')), F.lit("none = ~"))).alias("pos", "line"))
    return tidy(readers.cut_flat(lines))


def cell_source(spark, sf):
    """Types that cells are read as."""
    cells = read(spark, sf, "part").select("p_partkey", F.explode(F.array(F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), "p_name", F.lit("true"), F.lit(""))).alias("cell"))
    return cells.select("p_partkey", F.coalesce(F.schema_of_variant(readers.infer_cell(F.col("cell"))), F.lit("VOID")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).withColumn("kind", F.regexp_replace("kind", "DECIMAL.*", "DOUBLE")).groupBy("kind").agg(F.sum("n").alias("n"))


def xml_source(spark, sf):
    """XML texts parsed in the row."""
    texts = read(spark, sf, "nation").select("n_nationkey", F.format_string('<n id="%s"><name>%s</name></n>', F.col("n_nationkey").cast("string"), "n_name").alias("x"))
    parsed = texts.select("n_nationkey", F.from_xml("x", "`@id` INT, name STRING", {"attributePrefix": "@", "rowTag": "n"}).alias("v"))
    return tidy(parsed.select("n_nationkey", F.col("v.`@id`").alias("id"), F.col("v.name").alias("name")))


FORMAT_CASES = [
    ("email", "a@b.co", True), ("email", "a@b", False), ("url", "https://x.org", True), ("uri", "mailto:x", True), ("uuid", "123e4567-e89b-12d3-a456-426614174000", True), ("ssn", "000-12-3456", False),
    ("ssn", "123-45-6789", True), ("vin", "1M8GDM9AXKP042788", True), ("vin", "IM8GDM9AXKP042788", False), ("phone", "+1 (555) 123-4567", True), ("zip", "12345-678", False), ("hostname", "a.b-c.org", True),
    ("hostname", "-a.org", False), ("ipv4", "192.168.0.1", True), ("ipv4", "192.168.00.1", False), ("ipv6", "2001:db8::1", True), ("ipv6", "1::2::3", False), ("datetime", "2024-01-15T10:30:00Z", True),
    ("date-time", "2024-01-15", False), ("creditcard", "4111 1111 1111 1111", True), ("creditcard", "4111111111111112", False), ("iban", "DE89370400440532013000", True), ("bic", "DEUTDEFF500", True), ("swift", "DEUT", False),
    ("routing", "021000021", True), ("cusip", "037833100", True), ("isin", "US0378331005", True), ("lei", "5493001KJTIIGC8Y1R12", True), ("npi", "1234567893", True), ("dea", "AB1234563", True), ("imei", "490154203237518", True),
    ("iccid", "89014103211118510720", True), ("date-iso", "2024-13-45", True), ("naic", "12345", True), ("fein", "12-3456789", True), ("currency-code", "EUR", True), ("currency-code", "XXX", False), ("country-alpha2", "DE", True),
    ("country-alpha3", "DEU", True), ("country-alpha3", "DEX", False), ("state-us", "CA", True), ("state-us", "ca", False),
]


def format_checks(spark, sf):
    base = read(spark, sf, "region").filter("r_regionkey = 0")
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), is_format(F.lit(v), n).alias("ok")) for n, v, _ in FORMAT_CASES))
    return base.select(F.explode(cells).alias("x")).select("x.*")


ORDER_SCHEMA = """
{$}
id = "orders"
{}
o_orderkey = !##
o_orderstatus = ! :enum(F, O)
o_totalprice = #:(1000..300000)
o_orderpriority = :pattern "^[1-5]-"
o_clerk = !
o_custkey = ## :if o_orderstatus = F
:invariant o_totalprice > 2000 || o_orderstatus == "F"
"""


def validation(spark, sf):
    out = validate(read(spark, sf, "orders").drop("o_orderdate"), ORDER_SCHEMA, ["o_orderkey"])
    return out.select("o_orderkey", "valid", F.array_join(F.array_sort(F.transform("errors", lambda e: F.concat(e["code"], F.lit(":"), e["path"]))), ",").alias("errors"))


def form_pages(spark, sf):
    """Lines of each order laid on pages of three."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return tidy(paginate(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 3))


QUERIES = {
    "sink_json": json_sink, "sink_csv": csv_sink, "sink_xml": xml_sink, "sink_fixed_width": fixed_sink, "sink_flat": flat_sink, "sink_yaml": yaml_sink, "sink_notation": notation_sink,
    "source_notation": notation_source, "source_fixed_width": fixed_source, "source_flat": flat_source, "source_cells": cell_source, "source_xml": xml_source,
    "format_validators": format_checks, "schema_validation": validation, "form_pages": form_pages,
}

_TEXT = "'c_custkey = ##' || c_custkey || chr(10) || 'c_name = \"' || c_name || '\"' || chr(10) || '{info}' || chr(10) || 'c_nationkey = ##' || c_nationkey || chr(10) || 'c_mktsegment = \"' || c_mktsegment || '\"'"

SQL = {
    "sink_json": "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS text FROM nation",
    "sink_csv": "SELECT c_custkey, c_custkey || ',\"' || c_name || ', \"\"x\"\"\",' || c_nationkey AS text FROM customer",
    "sink_xml": "SELECT n_nationkey, '<nation id=\"' || n_nationkey || '\"><name>' || n_name || ' &amp; co</name><region odin:type=\"integer\">' || n_regionkey || '</region></nation>' AS text FROM nation",
    "sink_fixed_width": "SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 5, ' ') || ' ' || rpad(n_name, 10, ' ') || '    ' AS text FROM nation",
    "sink_flat": "SELECT n_nationkey, 'n_name=' || n_name || chr(10) || 'n_nationkey=' || n_nationkey || chr(10) || 'n_regionkey=' || n_regionkey AS text FROM nation",
    "sink_yaml": "SELECT n_nationkey, 'n_name: ' || n_name || chr(10) || 'n_nationkey: ' || n_nationkey || chr(10) || 'n_regionkey: ' || n_regionkey AS text FROM nation",
    "sink_notation": f"SELECT c_custkey, {_TEXT} AS text FROM customer",
    "source_notation": "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(x.p AS BIGINT) AS pos, x.path AS path, x.t AS type, x.v AS value FROM (SELECT c_custkey, unnest([{'p': 0, 'path': 'c_custkey', 't': 'integer', 'v': CAST(c_custkey AS VARCHAR)}, {'p': 1, 'path': 'c_name', 't': 'string', 'v': c_name}, {'p': 2, 'path': 'info.c_nationkey', 't': 'integer', 'v': CAST(c_nationkey AS VARCHAR)}, {'p': 3, 'path': 'info.c_mktsegment', 't': 'string', 'v': c_mktsegment}]) AS x FROM customer)",
    "source_fixed_width": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment FROM customer",
    "source_flat": "SELECT n_nationkey AS doc_id, CAST(x.p AS BIGINT) AS pos, x.path AS path, x.v AS value FROM (SELECT n_nationkey, unnest([{'p': 1, 'path': 'name', 'v': n_name}, {'p': 2, 'path': 'q', 'v': n_name}, {'p': 3, 'path': 'none', 'v': NULL}]) AS x FROM nation)",
    "source_cells": "SELECT kind, n FROM (SELECT 'BIGINT' AS kind, count(*) AS n FROM part UNION ALL SELECT 'DOUBLE', count(*) FROM part UNION ALL SELECT 'STRING', count(*) FROM part UNION ALL SELECT 'BOOLEAN', count(*) FROM part UNION ALL SELECT 'VOID', count(*) FROM part)",
    "source_xml": "SELECT n_nationkey, n_nationkey AS id, n_name AS name FROM nation",
    "format_validators": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}', {str(ok).lower()})" for n, v, ok in FORMAT_CASES) + ") AS t(name, value, ok)",
    "schema_validation": """WITH e AS (SELECT o_orderkey, list_sort(list_filter(['V001:o_clerk', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'V005:o_orderstatus' END, CASE WHEN o_totalprice < 1000 OR o_totalprice > 300000 THEN 'V003:o_totalprice' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-5]-') THEN 'V004:o_orderpriority' END, CASE WHEN NOT (o_totalprice > 2000 OR o_orderstatus = 'F') THEN 'V008:' END], lambda x: x IS NOT NULL)) AS x FROM orders)
SELECT o_orderkey, len(x) = 0 AS valid, array_to_string(x, ',') AS errors FROM e""",
    "form_pages": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, (row_number() OVER w - 1) // 3 AS page, (row_number() OVER w - 1) % 3 AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)",
}
