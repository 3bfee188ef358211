"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier line (by doc_id, then place) is equal, or at an edit
distance of one character. Equal lines meet by hash. For the rest, a line that
shares neither half with another distinct line has no neighbour and is done; the
others emit all strings with one character deleted, as hashed keys, and
themselves. Two lines of one length are neighbours if they agree after deleting
the same place; of lengths n and n + 1, if the longer's variant is the shorter
itself. Each key keeps only its earliest line, so no pairs are formed; found
neighbours are verified by their edit distance.

A key is made of hashes of what is left and right of a segment of about sqrt(n)
characters, and of the segment without one character: n keys cost n^1.5, not n^2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import parallelism, save, spare

#: Shorter lines go only if an equal line stands earlier.
NEAR_CHARS = 20


def _sub(text: Column, start: Column, count: Column) -> Column:
    """Characters from 0-based `start`; none if the count is not positive."""
    return F.substring(text, (start + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int"))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: inside lambdas nothing else is."""
    return F.get(F.transform(F.array(value), use), 0)


def _half_keys(line: Column, near_chars: int) -> Column:
    """Keys of which two lines at distance one share one: halves from either end, in lengths that fit n, n - 1 and n + 1."""
    n = F.length(line)
    low, high, under = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    left = lambda h: F.xxhash64(F.lit(0), h, F.substring(line, F.lit(1), h))
    right = lambda h: F.xxhash64(F.lit(1), h, F.substring(line, n - h + 1, h))
    # of an even n the left halves are equal, of an odd n the right ones
    return F.when(n < near_chars, F.array().cast("array<bigint>")).when(n % 2 == 0, F.array(left(low), right(low), right(under))).otherwise(F.array(left(low), left(high), right(low)))


def document_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """A row per line: doc_id, dk (hash of id and text), n_lines, place, two hashes and half keys; null texts have one row without a place."""
    cut = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), F.split("text", "\n", -1).alias("x"))
    rows = cut.select("doc_id", "dk", F.coalesce(F.size("x"), F.lit(0)).alias("n_lines"), F.posexplode_outer("x").alias("pos", "line"))
    line = F.col("line")
    return rows.select("doc_id", "dk", "n_lines", "pos", F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"), _half_keys(line, near_chars).alias("halves"), (F.trim(line) != "").alias("some"))


def _variants(line: Column) -> Column:
    """Keys of a line (place -1) and of its variants (place of the deleted character)."""

    def at_size(g: Column, n: Column) -> Column:
        def segment(j: Column) -> Column:
            start = j * g
            facts = F.struct(F.xxhash64(g, j, F.xxhash64(_sub(line, F.lit(0), start))).alias("left"), _sub(line, start, g + 1).alias("wide"), F.xxhash64(_sub(line, start + g + 1, n)).alias("rest"), F.xxhash64(_sub(line, start + g, n)).alias("more"))

            def keys(s: Column) -> Column:
                size = F.length(s["wide"])
                own = F.struct(F.xxhash64(s["left"], F.xxhash64(_sub(s["wide"], F.lit(0), g)), s["more"]).alias("key"), F.lit(-1).alias("at"))
                # the segment past the last character (n a multiple of g) has no places, but a longer line's last one
                places = F.when(size > 0, F.sequence(F.lit(0), F.least(size, g) - 1)).otherwise(F.array().cast("array<int>"))
                less = F.transform(places, lambda t: F.struct(F.xxhash64(s["left"], F.xxhash64(F.concat(_sub(s["wide"], F.lit(0), t), _sub(s["wide"], t + 1, g))), s["rest"]).alias("key"), (start + t).cast("int").alias("at")))
                return F.concat(F.array(own), less)

            return _let(facts, keys)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / g).cast("int")), segment))

    root = lambda n: F.ceil(F.sqrt(n)).cast("int")
    return _let(F.length(line), lambda n: F.flatten(F.transform(F.array_distinct(F.array(root(n), root(n + 1))), lambda g: at_size(g, n))))


def duplicate_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """One row per document row: doc_id, dk, n_lines and removed (0-based places, ascending) of the lines to drop.

    Null texts have no lines, an empty text has one, blank. Blank lines stay. An
    exact repeat of a row (id and text) is the same document and gets the same
    result; rows that share an id only are taken in order of their hash dk; null
    ids come first. Other columns are not read.
    """
    base = save(document_lines(docs, near_chars), "lines")
    lines = base.filter("some").select(F.struct("doc_id", "dk", "pos").alias("ord"), "k1", "k2", "halves")
    distinct = save(lines.groupBy("k1", "k2").agg(F.min(F.struct("ord", "halves")).alias("f")).select("k1", "k2", "f.ord", "f.halves"), "distinct")

    keys = distinct.select("ord", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    open_lines = keys.join(shared, "half").select("ord").distinct()
    places = open_lines.groupBy("ord.dk").agg(F.collect_set("ord").alias("ords"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("dk"), "text").join(places, "dk")
    picked = _let(F.split("text", "\n", -1), lambda x: F.transform("ords", lambda o: F.struct(o.alias("ord"), F.get(x, o["pos"]).alias("line"))))
    cut = texts.select(F.explode(picked).alias("x")).select("x.ord", "x.line")
    # numbered in their order, so that all that follows compares one number
    texts = save(cut.dropDuplicates(["ord"]).orderBy("ord").withColumn("lid", F.monotonically_increasing_id()), "open")

    parts = parallelism(docs.sparkSession)
    rows = texts.repartition(parts, "lid").select("lid", F.explode(_variants(F.col("line"))).alias("v")).select("lid", "v.key", "v.at").repartition(parts, "key")
    # most keys stand alone; the aggregate and the join read the same exchange
    whole, less = F.when(F.col("at") < 0, F.col("lid")), F.when(F.col("at") >= 0, F.col("lid"))
    met = rows.groupBy("key").agg(F.min(whole).alias("whole"), F.min(less).alias("less"), F.min("lid").alias("one"), F.max("lid").alias("other")).filter("one < other").drop("one", "other")
    rows = save(rows.join(met, "key"), "met")
    same = rows.filter("at >= 0").groupBy("key", "at").agg(F.min("lid").alias("low"))
    by_place = rows.select("lid", "key", "at").join(same, ["key", "at"]).filter("low < lid").select("lid", "low")
    by_length = rows.withColumn("low", F.when(F.col("at") < 0, F.col("less")).otherwise(F.col("whole"))).filter("low < lid").select("lid", "low")
    pairs = by_place.unionByName(by_length).distinct()
    named = texts.select(F.col("lid").alias("low"), F.col("line").alias("earlier"))
    near = pairs.join(texts, "lid").join(named, "low").filter(F.levenshtein("line", "earlier", 1).between(0, 1)).select("ord").distinct()

    gone = distinct.join(near.withColumn("near", F.lit(True)), "ord", "left").select("k1", "k2", F.col("ord").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    removed = lines.select("ord", "k1", "k2").join(gone, ["k1", "k2"]).filter("near OR ord <> first").groupBy("ord.dk").agg(F.array_sort(F.collect_set("ord.pos")).alias("removed"))
    return base.filter("coalesce(pos, 0) = 0").select("doc_id", "dk", "n_lines").join(removed, "dk", "left").select("doc_id", "dk", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without(lines: Column, places: Column) -> Column:
    """The lines but those at the (ascending, 0-based) places: what stands between two of them, in time linear in the lines."""
    size = F.size(places)
    start = lambda j: F.when(j == 0, 0).otherwise(F.get(places, j - 1) + 1)
    end = lambda j: F.when(j == size, F.size(lines)).otherwise(F.get(places, j))
    return F.flatten(F.transform(F.sequence(F.lit(0), size), lambda j: F.slice(lines, start(j) + 1, end(j) - start(j))))


def drop_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """The documents with their duplicate lines dropped; rows stay, all other columns as they are, whatever their names."""
    dk, gone = spare(docs, "dk"), spare(docs, "removed")
    found = duplicate_lines(docs, near_chars).filter(F.size("removed") > 0).select(F.col("dk").alias(dk), F.col("removed").alias(gone)).dropDuplicates([dk])
    joined = docs.withColumn(dk, F.xxhash64("doc_id", "text")).join(found, dk, "left")
    kept = _let(F.split("text", "\n", -1), lambda x: F.array_join(without(x, F.col(gone)), "\n"))
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
