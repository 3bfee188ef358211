"""Verbs with tables, loops, seeds or clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.plans.compiler import select, transform
from docweft.plans.spec import LookupTable

from .tables import order_documents, read
from .verbs import order_items, tidy

STATUS = LookupTable(["code", "label", "rank"], [["F", "finished", 1], ["O", "open", 2], ["O", "second", 3]], "none")


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    expressions = {
        "label": '%lookup "STATUS.label" @o_orderstatus', "by_rank": '%lookup "STATUS.label" ##2', "place": '%lookupDefault "STATUS.rank" @o_orderstatus ##-1', "two_keys": '%lookupDefault "STATUS.rank" @o_orderstatus "second" ##0',
    }
    return tidy(select(read(spark, sf_dir, "orders"), ["o_orderkey"], expressions, {"STATUS": STATUS}))


LOOP = """
{$}
odin = "1.0.0"
{$accumulator}
total = ##100
{lines[]}
:loop items :as it
:counter n
no = @n
seq = %sequence "lines"
zero = %resetSequence "lines"
run = %accumulate "total" @.quantity
flag = %set "last" @it.flag
{Sum}
_pass = 2
id = @o_orderkey
total = @$accumulator.total
"""


def accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(LOOP, order_documents(spark, sf_dir))
    last = F.element_at("lines", -1)
    return tidy(out.select(F.col("Sum.id").alias("id"), F.col("Sum.total").alias("total"), last["run"].alias("run"), last["no"].alias("no"), last["seq"].alias("seq"), last["zero"].alias("zero"), last["flag"].alias("flag")))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of generated and clock values, which no other engine repeats."""
    made = select(read(spark, sf_dir, "region"), ["r_regionkey"], {
        "uuid_v": '%uuid @r_name', "nano": '%nanoid ##12 @r_name', "dice": '%random ##1 ##6 ##42', "day": "%today", "clock": "%now", "free": "%uuid",
    })
    return tidy(made.select(
        "r_regionkey", F.col("uuid_v").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}$").alias("uuid_ok"), F.length("nano").alias("nano_length"), F.col("dice").between(1, 6).alias("dice_ok"),
        (F.col("day") == F.substring("clock", 1, 10)).alias("clock_ok"), (F.length("free") == 36).alias("free_ok"),
    ))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose type only the row knows."""
    made = select(read(spark, sf_dir, "events"), ["event_id"], {"doc": "%jsonDecode @props", "best": "%tryCoerce %jsonPath @props \"$.k\""})
    return tidy(made.select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"), F.schema_of_variant("best").alias("kind"), F.try_variant_get("best", "$", "bigint").alias("best")))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs over two arrays, and keys renamed."""
    frame = order_items(spark, sf_dir).withColumn("names", F.create_map(F.lit("q"), F.lit("quantity")))
    made = select(frame, ["l_orderkey"], {"corr": '%correlation %map @items "q" %map @items "p"', "renamed": '%join %sort %keys %renameKeys %first @items @names ","'})
    flows = select(spark.range(1).select(F.array(F.lit(-100.0), F.lit(60.0), F.lit(60.0)).alias("a"), F.array(F.lit("2024-01-01"), F.lit("2025-01-01"), F.lit("2026-01-01")).alias("d")), [], {"rate": "%xirr @a @d"})
    return tidy(made.crossJoin(flows))  # one literal row


QUERIES = {"verbs_lookup": lookups, "verbs_accumulators": accumulators, "verbs_generators": seeded, "verbs_variants": variants, "verbs_series": series}

SQL = {
    "verbs_lookup": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'none' END AS label, 'open' AS by_rank, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE -1 END AS BIGINT) AS place, CAST(CASE o_orderstatus WHEN 'O' THEN 3 ELSE 0 END AS BIGINT) AS two_keys FROM orders",
    "verbs_accumulators": "SELECT l_orderkey AS id, 100 + sum(l_quantity) AS total, 100 + sum(l_quantity) AS run, count(*) - 1 AS no, count(*) - 1 AS seq, CAST(0 AS BIGINT) AS zero, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
    "verbs_generators": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, true AS uuid_ok, CAST(12 AS BIGINT) AS nano_length, true AS dice_ok, true AS clock_ok, true AS free_ok FROM region",
    "verbs_variants": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'BIGINT' AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS best FROM events",
    "verbs_series": "SELECT l_orderkey, CASE WHEN stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN round(corr(l_quantity, l_extendedprice), 6) END AS corr, 'd,f,p,quantity,tags,w' AS renamed, 0.130404 AS rate FROM lineitem GROUP BY l_orderkey",
}
