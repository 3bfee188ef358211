"""Document operators over path tables: doc_id, pos, path, type, value (text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions.values import number_format

from .stages import stage

#: Hops after which a chain of references counts as a circle.
MAX_HOPS = 100


def path_table(df: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """Columns of a table as paths, one row per value."""
    kinds = {T.StringType: "string", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp"}

    def kind(t: T.DataType) -> str:
        return "integer" if isinstance(t, T.IntegralType) else "number" if isinstance(t, T.NumericType) else kinds.get(type(t), "string")

    def text(c: str) -> Column:
        t = df.schema[c].dataType
        return number_format(F.col(c).cast("double")) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(c).cast("string")

    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("path"), F.when(F.col(c).isNull(), "null").otherwise(kind(df.schema[c].dataType)).alias("type"), text(c).alias("value")) for i, c in enumerate(columns)))
    return df.select(F.col(doc_id).alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, op (add, remove, change, move), path, old, new and source path of what differs.

    A removed and an added path of one document with equal values are a move,
    paired in order of place.
    """
    a = old.select("doc_id", "path", F.struct("type", "value").alias("o"), F.col("pos").alias("op_pos"))
    b = new.select("doc_id", "path", F.struct("type", "value").alias("n"), F.col("pos").alias("np_pos"))
    both = a.join(b, ["doc_id", "path"], "full").filter(~F.col("o").eqNullSafe(F.col("n")))
    changed = both.filter("o IS NOT NULL AND n IS NOT NULL").select("doc_id", F.lit("change").alias("op"), "path", F.col("o.value").alias("old"), F.col("n.value").alias("new"), F.lit(None).cast("string").alias("source"))
    number = lambda v, p: F.row_number().over(Window.partitionBy("doc_id", v).orderBy(p))
    gone = both.filter("n IS NULL").select("doc_id", F.col("path").alias("old_path"), F.col("o").alias("v"), "op_pos").withColumn("k", number("v", "op_pos"))
    came = both.filter("o IS NULL").select("doc_id", F.col("path").alias("new_path"), F.col("n").alias("v"), "np_pos").withColumn("k", number("v", "np_pos"))
    moved = gone.join(came, ["doc_id", "v", "k"], "full")
    op = F.when(F.col("new_path").isNull(), "remove").when(F.col("old_path").isNull(), "add").otherwise("move")
    rest = moved.select("doc_id", op.alias("op"), F.coalesce("new_path", "old_path").alias("path"), F.when(F.col("old_path").isNotNull(), F.col("v.value")).alias("old"), F.when(F.col("new_path").isNotNull(), F.col("v.value")).alias("new"), F.when(op == "move", F.col("old_path")).alias("source"))
    return changed.unionByName(rest)


def patch(old: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, path, value) after the changes, and the changes that name a missing path."""
    leaving = changes.filter("op IN ('remove', 'change')").select("doc_id", "path", "op").unionByName(changes.filter("op = 'move'").select("doc_id", F.col("source").alias("path"), "op"))
    errors = leaving.join(old.select("doc_id", "path"), ["doc_id", "path"], "left_anti")
    kept = old.select("doc_id", "path", "value").join(leaving, ["doc_id", "path"], "left_anti")
    coming = changes.filter("op IN ('add', 'change', 'move')").select("doc_id", "path", F.col("new").alias("value"))
    return kept.unionByName(coming.join(errors.filter("op <> 'remove'").select("doc_id", "path"), ["doc_id", "path"], "left_anti")), errors


def ancestors(path: Column) -> Column:
    """The path and all paths above it."""
    parts = F.split(F.regexp_replace(path, r"\[", ".["), r"\.", -1)
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.replace(F.array_join(F.slice(parts, F.lit(1), n), "."), F.lit(".["), F.lit("[")))
    return upto


def collapse(chain: DataFrame) -> DataFrame:
    """A chain of documents (doc_id, doc_seq, pos, path, type, value) as one: the last value of each path, unless a later null removes it or a path above.

    `path[]` with null clears an array. The prefix match is an equi-join: each
    path looks for removals of itself and of every path above it.
    """
    order = F.struct("doc_seq", "pos")
    rows = chain.withColumn("o", order)
    last = rows.filter("type <> 'null'").groupBy("doc_id", "path").agg(F.max_by(F.struct("type", "value", "o"), "o").alias("x")).select("doc_id", "path", "x.*")
    removed = rows.filter("type = 'null'").select("doc_id", F.regexp_replace("path", r"\[\]$", "[").alias("prefix"), "o").groupBy("doc_id", "prefix").agg(F.max("o").alias("gone"))
    arrays = F.expr(r"transform(regexp_extract_all(path, '\\[', 0), (x, i) -> concat(substring_index(path, '[', i + 1), '['))")
    above = last.withColumn("prefix", F.explode(F.array_union(ancestors(F.col("path")), arrays)))
    hit = above.join(removed, ["doc_id", "prefix"]).filter("gone > o").select("doc_id", "path").distinct()
    return last.join(hit, ["doc_id", "path"], "left_anti").select("doc_id", "path", "type", "value")


def canonical_hash(table: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of its paths and values in order of path, indexes by number."""
    key = F.transform(F.split(F.regexp_replace("path", r"\[(\d+)\]", ".#$1"), r"\.", -1), lambda p: F.when(F.startswith(p, F.lit("#")), F.concat(F.lit("\x01"), F.lpad(F.substring(p, 2, 20), 20, "0"))).otherwise(F.concat(F.lit("\x02"), p)))
    line = F.concat("path", F.lit(" = "), F.coalesce("value", F.lit("~")))
    ordered = F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("line"))))
    return table.groupBy("doc_id").agg(F.sha2(F.concat(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n"), F.lit("\n")), 256).alias("hash"))


def resolve_references(table: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """doc_id, path and the value that a reference leads to; errors V012 (nothing there) and V013 (circle, or a chain beyond `hops`).

    Pointer doubling: each round, a reference goes on to where the place that it
    has reached leads, so `hops` steps take log2(hops) rounds of one join each.
    A round is a table in the shared folder, so that plans do not grow.
    """
    flat = table.select("doc_id", "path", "type", "value")
    done = flat.filter("type <> 'reference'").select("doc_id", "path", "value", F.lit(None).cast("string").alias("error"))
    ends = flat.select("doc_id", F.col("path").alias("at"), (F.col("type") != "reference").alias("end"), "value")
    start = flat.filter("type = 'reference'").select("doc_id", "path", F.regexp_replace("value", r"^@?\.?", "").alias("at"))
    there = start.join(ends, ["doc_id", "at"], "left")
    # at: the place reached; end: a value stands there; neither: another reference; null end: nothing is there
    state = stage(there.select("doc_id", "path", "at", "end", F.when(F.col("end"), F.col("value")).alias("value")), "references")
    for _ in range(max(1, hops - 1).bit_length()):
        onward = state.select("doc_id", F.col("path").alias("at"), F.col("at").alias("at2"), F.col("end").alias("end2"), F.col("value").alias("value2"))
        open_rows = state.filter("end = false")
        if open_rows.isEmpty():
            break
        moved = open_rows.drop("value").join(onward, ["doc_id", "at"]).select("doc_id", "path", F.col("at2").alias("at"), F.col("end2").alias("end"), F.col("value2").alias("value"))
        state = stage(state.filter("end IS NULL OR end").unionByName(moved), "references")
    error = F.when(F.col("end").isNull(), "V012").when(~F.col("end"), "V013")
    return done.unionByName(state.select("doc_id", "path", "value", error.alias("error")))
