"""Benchmark decontamination by a prefix-filtered set join.

Each item is cut into windows of ten consecutive words (a shorter item is one
window), each window into shingles of five words. Containment needs every
shingle of a window, so one of them - its rarest over all documents - is prefix
enough. Documents are joined on the prefix shingles only; a candidate must leave
room for the window before and after the shingle (positional and length bound),
and is kept if the document holds exactly the window's shingles at that place.

Texts are read once. The shingles go to the tasks in blocks of at most
`block_shingles`, so what is broadcast has a fixed size for any benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, save, ship, shingle_hashes, slices, words_of

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
BLOCK_SHINGLES = 500_000
HITS = "array<struct<pos:int,sh:string>>"


def _lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, count: int) -> str:
    low = LOWER[data[starts[first] : ends[first + count - 1]]].tobytes()
    base = int(starts[first])
    return b" ".join(low[int(starts[k]) - base : int(ends[k]) - base] for k in range(first, first + count)).decode("utf-8", "replace")


def item_windows(benchmark: DataFrame, window: int = WINDOW_WORDS, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row per item and window: item_id, width (words) and shingles in order.

    Null or wordless items have no window.
    """

    def cut(batches):
        for rows, data, offsets in slices(batches):
            starts, ends, _, owner = words_of(data, offsets)
            first = np.searchsorted(owner, np.arange(rows.num_rows + 1))
            out = {"item_id": [], "width": [], "shingles": []}
            ids = rows.column(rows.schema.get_field_index("item_id")).to_pylist()
            for r in range(rows.num_rows):
                a, n = int(first[r]), int(first[r + 1] - first[r])
                width = min(n, window)
                step = min(width, size)
                if not n:
                    continue
                texts = [_lowered(data, starts, ends, a + k, step) for k in range(n - step + 1)]
                for k in range(n - width + 1):
                    out["item_id"].append(ids[r])
                    out["width"].append(width)
                    out["shingles"].append(texts[k : k + width - step + 1])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item_id", pa.string()), ("width", pa.int32()), ("shingles", pa.list_(pa.string()))]))

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, width int, shingles array<string>")


def _hashed(shingles: pa.Array, size: int) -> np.ndarray:
    """Hash of each shingle of `size` words, a slice of bounded size at a time."""
    parts = [shingle_hashes(h, owner, size)[0] for _, data, offsets in slices([pa.RecordBatch.from_arrays([shingles], ["text"])]) for _, _, h, owner in (words_of(data, offsets),)]
    return np.concatenate(parts)


def _mark(docs: DataFrame, shingles: pa.Array, kept: list[str]) -> DataFrame:
    """Add to `hits` the places where a document holds one of the shingles, and set n_words."""
    words = pc.add(pc.count_substring(shingles, " "), 1)
    known = {}
    for k in pc.unique(words).to_pylist():
        group = shingles.filter(pc.equal(words, k))
        values = _hashed(group, k)
        order = np.argsort(values, kind="stable")
        values = values[order]
        sieve = np.zeros(1 << 20, bool)
        sieve[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        known[k] = (values, sieve, group.take(pa.array(order)))
    held = docs.sparkSession.sparkContext.broadcast(known)

    def find(batches):
        known = held.value
        for rows, data, offsets in slices(batches):
            starts, ends, h, owner = words_of(data, offsets)
            first = np.searchsorted(owner, np.arange(rows.num_rows + 1))
            where, pos, texts = [], [], []
            for k, (values, sieve, exact) in known.items():
                sh, at = shingle_hashes(h, owner, k)
                may = np.flatnonzero(sieve[(sh & np.uint64((1 << 20) - 1)).astype(np.int64)])
                if not len(may):
                    continue
                low, high = np.searchsorted(values, sh[may]), np.searchsorted(values, sh[may], side="right")
                for i, a, b in zip(at[may], low.tolist(), high.tolist(), strict=True):
                    if a == b:
                        continue
                    text = _lowered(data, starts, ends, int(i), k)
                    if any(exact[j].as_py() == text for j in range(a, b)):  # shingles with this hash
                        where.append(int(owner[i]))
                        pos.append(int(i - first[owner[i]]))
                        texts.append(text)
            order = np.argsort(np.array(where, np.int64), kind="stable")
            found = pa.StructArray.from_arrays([pa.array(np.array(pos, np.int32)[order]), pa.array([texts[i] for i in order], pa.string())], ["pos", "sh"])
            counts = np.bincount(np.array(where, np.int64), minlength=rows.num_rows)
            bounds = np.zeros(rows.num_rows + 1, np.int32)
            np.cumsum(counts, out=bounds[1:])
            hits = pa.ListArray.from_arrays(pa.array(bounds), found)
            columns = [rows.column(rows.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first).astype(np.int64)), hits], names=[*kept, "n_words", "new_hits"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + f", n_words bigint, new_hits {HITS}"
    return docs.mapInArrow(find, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items (sorted), contaminated.

    Null or wordless texts have no words and no hits; repeated rows and null
    doc_ids are kept as rows of their own. Columns beside doc_id and text, of any
    name, are not read. Without items nothing is hit.
    """
    windows = save(item_windows(benchmark, window), "windows")
    shingles = windows.select(F.explode("shingles").alias("sh")).distinct()
    blocks = max(1, -(-shingles.count() // block_shingles))
    docs = docs.select("doc_id", "text")
    marked = docs.withColumn("hits", F.array().cast(HITS)) if blocks > 1 else docs
    for b in range(blocks):
        # a block is a bounded slice of the benchmark's own shingles, never of the documents
        block = shingles.filter(F.pmod(F.xxhash64("sh"), F.lit(blocks)) == b).toArrow().column("sh").combine_chunks()
        if blocks == 1:
            marked = _mark(marked, block, ["doc_id"]).withColumnRenamed("new_hits", "hits")
        else:
            marked = _mark(marked.drop("n_words"), block, ["doc_id", "text", "hits"]).withColumn("hits", F.concat("hits", "new_hits")).drop("new_hits")
    marked = save(marked.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_words", "hits"), "marked")

    # each step is a small table: several read it, and plans stay short
    places = save(marked.filter(F.size("hits") > 0).select("rid", "n_words", F.explode("hits").alias("x")).select("rid", "n_words", "x.pos", "x.sh"), "places")
    rarity = places.groupBy("sh").agg(F.count("*").alias("n"))
    grams = windows.withColumn("wid", F.sha2(F.concat_ws("\n", F.col("width").cast("string"), F.array_join("shingles", "\n")), 256))
    distinct = grams.groupBy("wid").agg(F.first("width").alias("width"), F.first("shingles").alias("shingles"))
    ranked = distinct.select("wid", "width", "shingles", F.posexplode("shingles").alias("off", "sh")).join(rarity, "sh")
    # a shingle that occurs nowhere rules its window out: such a window has fewer ranked shingles than it needs
    order = Window.partitionBy("wid").orderBy("n", "sh", "off")
    prefix = save(ranked.withColumn("r", F.row_number().over(order)).withColumn("have", F.count("*").over(Window.partitionBy("wid"))).filter((F.col("r") == 1) & (F.col("have") == F.size("shingles"))).select("wid", "width", "shingles", "off", "sh"), "prefix")
    candidates = places.join(prefix, "sh").withColumn("start", F.col("pos") - F.col("off")).filter((F.col("start") >= 0) & (F.col("start") + F.col("width") <= F.col("n_words")))
    needed = candidates.select("rid", "wid", "width", "start", F.posexplode("shingles").alias("k", "sh")).withColumn("pos", F.col("start") + F.col("k"))
    held = needed.join(places.select("rid", "pos", "sh"), ["rid", "pos", "sh"])
    verified = held.groupBy("rid", "wid", "width", "start").agg(F.count("*").alias("n"), F.max("k").alias("last")).filter(F.col("n") == F.col("last") + 1)
    full = save(verified.join(prefix.select("wid", F.size("shingles").alias("need")), "wid").filter(F.col("n") == F.col("need")).select("rid", "wid", "width", "start"), "full")
    hit = full.select("rid", "start", "width").distinct().select("rid", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("w")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    items = full.select("rid", "wid").distinct().join(grams.select("wid", "item_id").distinct(), "wid").select("rid", "item_id").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = marked.select("rid", "doc_id", "n_words").join(hit, "rid", "left").join(items, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


ship(__name__)
