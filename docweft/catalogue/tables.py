"""Queries of the relational and document operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators import documents as docs
from docweft.operators import relational as rel
from docweft.plans.compiler import transform

from .verbs import tidy


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FLAGSHIP = """
{$}
odin = "1.0.0"
transform = "1.0.0"
{$const}
vat = #0.07
{$table.STATUS[code, label]}
"F", "finished"
"O", "open"
"P", "partial"
{Order}
id = @.o_orderkey
status = %lookup "STATUS.label" @.o_orderstatus
placed = %formatDate @.o_orderdate "YYYY-MM-DD"
priority = %lower %leftOf @.o_orderpriority "-"
items = %count @.items
quantity = %sum %map @.items "quantity"
revenue = %sum %map @.items "revenue"
returned = %countIf @.items "flag" "=" "R"
largest = %max %map @.items "revenue"
share = %expr "largest_of / total" @.facts
class = %ifElse %gte @.o_totalprice ##150000 "large" "small"
"""


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order that has lines: a shuffle join on the order key, its lines as an ordered array."""
    lines = read(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.col("l_returnflag").alias("flag"))
    items = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice")
    return orders.join(items, "o_orderkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = order_documents(spark, sf_dir).withColumn("facts", F.struct(F.array_max(F.transform("items", lambda x: x["revenue"])).alias("largest_of"), F.aggregate("items", F.lit(0.0), lambda a, x: a + x["revenue"]).alias("total")))
    return tidy(transform(FLAGSHIP, source).select("Order.*"))


def filter_query(spark, sf):
    return tidy(rel.filter_rows(read(spark, sf, "lineitem"), "l_quantity", ">=", 45).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))


def partition_query(spark, sf):
    a, b = rel.partition_rows(read(spark, sf, "customer"), "c_mktsegment", "startsWith", "B")
    return a.select("c_custkey", F.lit("match").alias("part")).unionByName(b.select("c_custkey", F.lit("rest").alias("part")))


def dedupe_query(spark, sf):
    return rel.dedupe(read(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


def group_query(spark, sf):
    g = rel.group_items(read(spark, sf, "orders"), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return g.select("key", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


def count_by_query(spark, sf):
    return rel.count_by(read(spark, sf, "lineitem"), "l_returnflag")


def key_by_query(spark, sf):
    return rel.key_by(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey"])


def top_query(spark, sf):
    return tidy(rel.top(read(spark, sf, "part").select("p_partkey", "p_retailprice"), 25, [F.desc("p_retailprice"), F.asc("p_partkey")]))


def drop_query(spark, sf):
    return tidy(rel.drop_first(read(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), 3, [F.asc("s_suppkey")]))


def explode_query(spark, sf):
    words = read(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("word"))
    return rel.explode_field(words, "word")


def pivot_query(spark, sf):
    return tidy(rel.pivot_rows(read(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ["F", "O", "P"], ["o_orderkey"]))


def unpivot_query(spark, sf):
    return tidy(rel.unpivot_rows(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_discount", "l_tax"], "name", "value"))


def sample_query(spark, sf):
    return rel.sample_rows(read(spark, sf, "customer").select("c_custkey"), 20, 7, ["c_custkey"])


def chunk_query(spark, sf):
    return tidy(rel.chunk_rows(read(spark, sf, "conversations").select("conv_id", "turn"), 2, ["conv_id"], ["turn"]))


def union_query(spark, sf):
    return rel.union_distinct(read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


def intersection_query(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


def difference_query(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).subtract(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


def symmetric_query(spark, sf):
    return rel.symmetric_difference(read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


def lookup_query(spark, sf):
    return rel.lookup(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), read(spark, sf, "nation").filter("n_nationkey <> 3"), {"c_nationkey": "n_nationkey"}, ["n_name"], ["n_nationkey"], {"n_name": "?"})


def semi_query(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


def anti_query(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


def window_query(spark, sf):
    lines = read(spark, sf, "events").select("user_id", "event_id", "value")
    return tidy(rel.window_columns(lines, "value", ["user_id"], ["event_id"]))


def running_query(spark, sf):
    return tidy(rel.running_total(read(spark, sf, "events").select("user_id", "event_id", "value"), "total", "value", ["user_id"], ["event_id"], 10.0))


def statistics_query(spark, sf):
    return tidy(rel.statistics(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_discount"))


def cross_loop_query(spark, sf):
    """Two loops: every pair of an order's lines and its customer's segment words."""
    source = order_documents(spark, sf).withColumn("marks", F.split(F.lower("o_orderpriority"), "-"))
    spec = '{$}\nodin = "1.0.0"\n{pairs[]}\n:loop items :as it\n:loop marks :as mark\nline = @it.l_linenumber\nmark = %trim @mark\n'
    out = transform(spec, source.select("o_orderkey", "items", "marks"))
    return out.select(F.size("pairs").cast("bigint").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform("pairs", lambda p: p["mark"]))), "|").alias("marks"))


def _versions(spark, sf):
    old = docs.path_table(read(spark, sf, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])
    new = read(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    new = docs.path_table(new, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])
    renamed = new.withColumn("path", F.when((F.col("doc_id") % 5 == 0) & (F.col("path") == "c_name"), "name").otherwise(F.col("path")))
    return old, renamed.filter(~((F.col("doc_id") % 7 == 0) & (F.col("path") == "c_nationkey")))


def diff_query(spark, sf):
    return docs.diff(*_versions(spark, sf))


def patch_query(spark, sf):
    old, new = _versions(spark, sf)
    return docs.patch(old, docs.diff(old, new))[0]


def collapse_query(spark, sf):
    turns = read(spark, sf, "conversations")
    kind = F.when(F.col("turn") % 3 == 2, "null").otherwise("string")
    chain = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("doc_seq"), F.lit(0).alias("pos"), F.concat(F.lit("talk."), F.when(kind == "null", F.lit("user")).otherwise(F.concat("role", F.lit("["), (F.col("turn") % 2).cast("string"), F.lit("].text")))).alias("path"), kind.alias("type"), F.when(kind == "null", None).otherwise(F.md5("text")).alias("value"))
    return docs.collapse(chain)


def canonical_query(spark, sf):
    return docs.canonical_hash(docs.path_table(read(spark, sf, "supplier"), "s_suppkey", ["s_nationkey", "s_name"]))


def references_query(spark, sf):
    """Each nation refers to the nation of its region's number, region names end the chains."""
    n = read(spark, sf, "nation")
    table = n.select(F.lit(1).alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("path"), F.when(F.col("n_nationkey") < 5, "string").otherwise("reference").alias("type"), F.when(F.col("n_nationkey") < 5, F.col("n_name")).otherwise(F.concat(F.lit("@n"), (F.col("n_nationkey") / 2).cast("int").cast("string"))).alias("value"))
    return docs.resolve_references(table).select("path", "value", "error")


QUERIES = {
    "flagship_orders": flagship, "table_filter": filter_query, "table_partition": partition_query, "table_dedupe": dedupe_query, "table_group_by": group_query, "table_count_by": count_by_query,
    "table_key_by": key_by_query, "table_top": top_query, "table_drop": drop_query, "table_explode": explode_query, "table_pivot": pivot_query, "table_unpivot": unpivot_query, "table_sample": sample_query,
    "table_chunk": chunk_query, "table_union": union_query, "table_intersection": intersection_query, "table_difference": difference_query, "table_symmetric_difference": symmetric_query,
    "table_lookup": lookup_query, "table_semi_join": semi_query, "table_anti_join": anti_query, "table_windows": window_query, "table_accumulate": running_query, "table_statistics": statistics_query,
    "transform_cross_loop": cross_loop_query, "document_diff": diff_query, "document_patch": patch_query, "document_collapse": collapse_query, "document_canonical_hash": canonical_query, "document_references": references_query,
}

_OLD = "(SELECT c_custkey AS doc_id, unnest([{'p': 0, 'path': 'c_name', 'v': c_name}, {'p': 1, 'path': 'c_nationkey', 'v': CAST(c_nationkey AS VARCHAR)}, {'p': 2, 'path': 'c_mktsegment', 'v': c_mktsegment}]) AS x FROM customer)"
_NEW = "(SELECT c_custkey AS doc_id, unnest([{'p': 0, 'path': CASE WHEN c_custkey % 5 = 0 THEN 'name' ELSE 'c_name' END, 'v': c_name}, {'p': 1, 'path': 'c_nationkey', 'v': CAST(c_nationkey AS VARCHAR)}, {'p': 2, 'path': 'c_mktsegment', 'v': CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END}]) AS x FROM customer)"

SQL = {
    "flagship_orders": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS placed, lower(string_split(o_orderpriority, '-')[1]) AS priority, count(*) AS items, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue, count(*) FILTER (l_returnflag = 'R') AS returned, round(max(l_extendedprice * (1 - l_discount)), 6) AS largest, round(max(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice * (1 - l_discount)), 6) AS share, CASE WHEN o_totalprice >= 150000 THEN 'large' ELSE 'small' END AS class FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, o_totalprice""",
    "table_filter": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 45",
    "table_partition": "SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'B') THEN 'match' ELSE 'rest' END AS part FROM customer",
    "table_dedupe": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "table_group_by": "SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey",
    "table_count_by": "SELECT l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "table_key_by": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "table_top": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    "table_drop": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_suppkey OFFSET 3",
    "table_explode": "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part",
    "table_pivot": "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS F, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS O, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey",
    "table_unpivot": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), l_partkey, l_suppkey, 'l_tax', l_tax FROM lineitem",
    "table_chunk": "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS chunk FROM conversations",
    "table_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "table_intersection": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "table_difference": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "table_symmetric_difference": "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)",
    "table_lookup": "SELECT c_custkey, c_nationkey, coalesce(n_name, '?') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) n ON c_nationkey = n_nationkey",
    "table_semi_join": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "table_anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "table_windows": """SELECT user_id, event_id, round(value, 6) AS value, row_number() OVER w AS row_num, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS rank_desc, round(lag(value) OVER w, 6) AS lag_1, round(lead(value) OVER w, 6) AS lead_1, round(sum(value) OVER w, 6) AS cumsum, round(value - lag(value) OVER w, 6) AS diff_1, round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 6) AS pct_change, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_avg_3, round(value, 6) AS filled, round((value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0), 6) AS zscore FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "table_accumulate": "SELECT user_id, event_id, round(value, 6) AS value, round(10 + sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS total FROM events",
    "table_statistics": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS sum_x, min(l_quantity) AS min_x, max(l_quantity) AS max_x, round(avg(l_quantity), 6) AS avg_x, round(stddev_pop(l_quantity), 6) AS std_x, round(stddev_samp(l_quantity), 6) AS std_sample_x, round(var_pop(l_quantity), 6) AS var_x, round(var_samp(l_quantity), 6) AS var_sample_x, median(l_quantity) AS median_x, quantile_cont(l_quantity, 0.9) AS p90_x, round(covar_pop(l_quantity, l_discount), 6) AS cov_xy, round(corr(l_quantity, l_discount), 6) AS corr_xy, round(sum(l_quantity * l_discount) / sum(l_discount), 6) AS weighted_xy, count(DISTINCT l_quantity) AS distinct_x FROM lineitem GROUP BY ALL",
    "transform_cross_loop": "SELECT 2 * count(*) AS n, (SELECT string_agg(DISTINCT trim(m), '|' ORDER BY trim(m)) FROM unnest(string_split(lower(o_orderpriority), '-')) AS t(m)) AS marks FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority",
    "document_diff": f"""SELECT * FROM (SELECT o.doc_id, 'change' AS op, o.x.path AS path, o.x.v AS old, n.x.v AS new, NULL AS source FROM {_OLD} o JOIN {_NEW} n ON o.doc_id = n.doc_id AND o.x.path = n.x.path AND o.x.v <> n.x.v WHERE o.doc_id % 7 <> 0 OR o.x.path <> 'c_nationkey')
UNION ALL SELECT c_custkey, 'move', 'name', c_name, c_name, 'c_name' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'remove', 'c_nationkey', CAST(c_nationkey AS VARCHAR), NULL, NULL FROM customer WHERE c_custkey % 7 = 0""",
    "document_patch": f"SELECT n.doc_id, n.x.path AS path, n.x.v AS value FROM {_NEW} n WHERE doc_id % 7 <> 0 OR n.x.path <> 'c_nationkey'",
    "document_collapse": """WITH c AS (SELECT conv_id AS d, turn AS s, CASE WHEN turn % 3 = 2 THEN 'talk.user' ELSE 'talk.' || role || '[' || (turn % 2) || '].text' END AS path, turn % 3 = 2 AS gone, md5(text) AS v FROM conversations)
SELECT d AS doc_id, path, 'string' AS type, arg_max(v, s) AS value FROM c WHERE NOT gone GROUP BY d, path HAVING NOT EXISTS (SELECT 1 FROM c AS k WHERE k.gone AND k.d = c.d AND k.s > max(c.s) AND (c.path = k.path OR starts_with(c.path, k.path || '.') OR starts_with(c.path, k.path || '[')))""",
    "document_canonical_hash": "SELECT s_suppkey AS doc_id, sha256('s_name = ' || s_name || chr(10) || 's_nationkey = ' || s_nationkey || chr(10)) AS hash FROM supplier",
    "document_references": "WITH RECURSIVE r AS (SELECT n_nationkey AS k, n_nationkey AS cur FROM nation UNION ALL SELECT k, cur // 2 FROM r WHERE cur >= 5) SELECT 'n' || k AS path, n_name AS value, CAST(NULL AS VARCHAR) AS error FROM r JOIN nation ON n_nationkey = cur WHERE cur < 5",
}
