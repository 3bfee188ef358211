"""N-gram Jaccard join by MinHash banding.

Documents with equal shingle sets are one node with a count, so copies are never
paired. Nodes that share a band hash are linked to the bucket's smallest node (a
star, not all pairs); the stars' components hold all candidate pairs. Inside a
component pairs are verified on the full shingle sets, in blocks of bounded size:
documents are dealt to blocks, and each pair of blocks is a task's work. A
component of several blocks is dealt by the sets' sizes, in levels so wide that a
pair at the threshold lies in one level or in two neighbouring ones; blocks of
other levels never meet. Verified links are counted and joined up to classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BASE, MIX, finish, list_array, parallelism, save, shingle_hashes, ship, slices, words_of
from ._graph import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 256
BLOCK = 192


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows per band for which a pair at the threshold is found with `recall`."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer words has one shingle, of all of them."""
    _, _, h, owner = words_of(data, offsets)
    rows = len(offsets) - 1
    first = np.searchsorted(owner, np.arange(rows + 1))
    sh, at = shingle_hashes(h, owner, size)
    cut = np.searchsorted(owner[at], np.arange(rows + 1)) if len(at) else np.zeros(rows + 1, np.int64)
    out = []
    for r in range(rows):
        n = int(first[r + 1] - first[r])
        if n == 0 or n >= size:
            out.append(np.unique(sh[cut[r] : cut[r + 1]]))
        else:
            out.append(shingle_hashes(h[first[r] : first[r + 1]], np.zeros(n, np.int64), n)[0])
    return out


def signatures(docs: DataFrame, size: int, bands: int, rows_per_band: int) -> DataFrame:
    """doc_id, tk (hash of the text), n (shingles), s1, s2 (hash of the set) and the band hashes of each row."""
    factors = finish(np.arange(1, bands * rows_per_band + 1, dtype=np.uint64) * MIX) | np.uint64(1)

    def run(batches):
        for rows, data, offsets in slices(batches, limit=1 << 20):
            sets = shingle_sets(data, offsets, size)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            flat = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, np.uint64)
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64) if len(some) else np.zeros(0, np.int64)
            keys = np.zeros((len(some), bands), np.uint64)
            s1, s2 = np.zeros(rows.num_rows, np.uint64), np.zeros(rows.num_rows, np.uint64)
            if len(some):
                s1[some] = finish(np.add.reduceat(finish(flat), starts))
                s2[some] = finish(np.add.reduceat(finish(flat ^ MIX), starts))
                low = np.empty(len(flat), np.uint64)
                for b in range(bands):
                    total = np.full(len(some), b + 1, np.uint64)
                    for k in range(b * rows_per_band, (b + 1) * rows_per_band):
                        np.multiply(flat, factors[k], out=low)
                        total = total * np.uint64(BASE) + np.minimum.reduceat(low, starts)
                    keys[:, b] = finish(total)
            lengths = np.where(n > 0, bands, 0)
            get = lambda c: rows.column(rows.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("tk"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), list_array(pa.array(keys.reshape(-1).view(np.int64)), lengths)], names=["doc_id", "tk", "n", "s1", "s2", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tk")).mapInArrow(run, f"doc_id {kind}, tk bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def overlaps(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices of bounded width."""
    n = len(sets)
    lengths = [len(s) for s in sets]
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(code) > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(n), lengths)
    use = shared[code]
    code, owner = place[code[use]], owner[use]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((n, n), np.float64)
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [start, start + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], code[a:b] - start] = 1
        out += m @ m.T
    return out


#: What names a pair of blocks: the component, and level and number of either block.
KEYS = ["comp", "la", "bi", "lb", "bj"]


def _levels(members: DataFrame, block: int) -> DataFrame:
    """comp, lv, cut and pairs (of blocks of this level: k; of the levels below and above: k_low, k_high)."""
    inside = Window.partitionBy("comp").orderBy("lv")  # levels of a component: few, as they grow with the logarithm of a set's size
    counts = members.groupBy("comp", "lv").agg(F.count("*").alias("c")).withColumn("k", F.ceil(F.col("c") / block))
    counts = counts.withColumn("cut", F.sum("c").over(Window.partitionBy("comp")) > block)
    near = lambda step, to: F.when((step("lv").over(inside) == F.col("lv") + to) & F.col("cut"), step("k").over(inside)).otherwise(0)
    return counts.select("comp", "lv", "cut", F.when(F.col("cut"), F.col("k")).otherwise(1).alias("k"), near(F.lag, -1).alias("k_low"), near(F.lead, 1).alias("k_high"))


def _meetings(members: DataFrame, block: int) -> DataFrame:
    """Members with the pairs of blocks in which each one takes part, as `meets`."""
    dealt = members.join(_levels(members, block), ["comp", "lv"]).withColumn("lv", F.when(F.col("cut"), F.col("lv")).otherwise(0)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")))
    each = lambda k, meet: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col(k)), lambda o: o < F.col(k)), meet)
    at = lambda la, bi, lb, bj, side: F.struct(la.alias("la"), bi.alias("bi"), lb.alias("lb"), bj.alias("bj"), side.cast("int").alias("side"))
    lv, own = F.col("lv"), F.col("block")
    one = F.lit(1).cast("long")
    among = each("k", lambda o: at(lv, F.least(own, o), lv, F.greatest(own, o), own > o))
    below = each("k_low", lambda o: at(lv - one, o, lv, own, F.lit(1)))
    above = each("k_high", lambda o: at(lv, own, lv + one, o, F.lit(0)))
    return dealt.withColumn("meets", F.concat(among, below, above)).drop("lv", "cut", "k", "k_low", "k_high", "block")


def _verify(threshold: float):
    def run(batches):
        for group in _groups(batches, KEYS):
            reps, at = np.unique(group.column("rep").to_numpy(), return_index=True)
            side = group.column("side").to_numpy()[at]
            copies = group.column("copies").to_numpy()[at]
            column = group.column("sh").combine_chunks()
            sets = [column[int(i)].values.to_numpy().view(np.uint64) for i in at]
            n = np.array([len(s) for s in sets])
            same = all(group.column(a)[0] == group.column(b)[0] for a, b in (("la", "lb"), ("bi", "bj")))
            if len(reps) > 1:
                both = overlaps(sets)
                link = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
                np.fill_diagonal(link, False)
                if not same:
                    link &= side[:, None] != side[None, :]
            else:
                link = np.zeros((1, 1), bool)
            root = np.arange(len(reps))
            for i in range(len(reps)):  # smallest index that is reached
                if root[i] == i:
                    seen, todo = {i}, [i]
                    while todo:
                        for j in np.flatnonzero(link[todo.pop()]):
                            if int(j) not in seen:
                                seen.add(int(j))
                                todo.append(int(j))
                    root[list(seen)] = np.minimum(root[list(seen)], i)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(reps[root]), pa.array(link.sum(axis=1).astype(np.int64)), pa.array((link @ copies).astype(np.int64))], names=["u", "v", "texts", "rows"])

    return run


def join_classes(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document row: doc_id, tk, class_id, n_links, n_text_links, first_of_class.

    n_links counts the other rows whose Jaccard similarity with this one is at
    least `threshold` (copies by their number), n_text_links those links to nodes
    with another shingle set. class_id is the smallest doc_id that links lead to,
    over any number of steps; first_of_class marks one row of each class. tk is
    xxhash64(text). A text of fewer than `size` words is one shingle; null, empty
    and wordless texts are classes of their own, without links. Null doc_ids take
    part and never name a class that has another id. A pair at the threshold is
    found with probability `recall`, more similar pairs with a higher one; what is
    found is exact.
    """
    bands, rows_per_band = banding(threshold, recall)
    spark = docs.sparkSession
    narrow = save(signatures(docs, size, bands, rows_per_band).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    nodes = narrow.filter("n > 0").groupBy("s1", "s2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.min("n").alias("n"))
    nodes = save(nodes, "nodes")
    heads = nodes.select("rep", "copies", "n").join(narrow.select(F.col("rid").alias("rep"), "doc_id", "tk", "keys"), "rep")

    buckets = heads.select("rep", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("key", "hub")
    stars = buckets.join(hubs, "key").filter("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    members = components(stars).select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    # both sides of these joins grow with the documents: no plan for small ones, in which a side is broadcast
    members = members.join(heads.select("rep", "copies", "n", F.col("doc_id").alias("wanted_id"), "tk").hint("merge"), "rep")
    # a little wider than the threshold asks for, so that no rounding parts a pair by two levels
    members = save(members.withColumn("lv", F.floor(F.log("n") / (-math.log(threshold) + 1e-6))).drop("n"), "members")
    wanted = _meetings(members, block).hint("merge")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    found = texts.join(wanted, (texts["tk"] == wanted["tk"]) & texts["doc_id"].eqNullSafe(wanted["wanted_id"])).select("rep", "copies", "comp", "meets", "text")

    def sets(batches):
        for rows, data, offsets in slices(batches):
            parts = shingle_sets(data, offsets, size)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            keep = ["rep", "copies", "comp", "meets"]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), list_array(pa.array(flat.view(np.int64)), np.array([len(p) for p in parts]))], names=[*keep, "sh"])

    shingled = found.mapInArrow(sets, "rep bigint, copies bigint, comp bigint, meets array<struct<la:bigint,bi:bigint,lb:bigint,bj:bigint,side:int>>, sh array<bigint>")
    paired = shingled.select("rep", "copies", "comp", "sh", F.explode("meets").alias("meet")).select("rep", "copies", "comp", "meet.*", "sh")
    paired = paired.repartition(parallelism(spark), *KEYS).sortWithinPartitions(*KEYS)
    links = save(paired.mapInArrow(_verify(threshold), "u bigint, v bigint, texts bigint, rows bigint"), "links")

    counts = links.groupBy(F.col("u").alias("rep")).agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    roots = components(links.select("u", "v")).select(F.col("node").alias("rep"), "root")
    rooted = save(nodes.join(roots, "rep", "left").join(counts, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    # the class's first row: smallest doc_id (nulls last), then first in the table
    named = rooted.groupBy("root").agg(F.min("low").alias("class_id"), F.min("rep").alias("any_rep"))
    classes = rooted.join(named, "root").select("s1", "s2", "root", "class_id", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("rows", F.lit(0)).alias("rows"), "any_rep")
    out = save(narrow.drop("keys").join(classes, ["s1", "s2"], "left"), "classes")
    first = out.filter("root IS NOT NULL AND doc_id <=> class_id").groupBy("root").agg(F.min("rid").alias("first_rid"))
    out = out.join(first, "root", "left")
    own = F.col("root").isNull()
    return out.select(
        "doc_id", "tk",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, 0).otherwise(F.col("rows") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(own, 0).otherwise(F.col("texts")).cast("long").alias("n_text_links"),
        (own | (F.col("rid") == F.col("first_rid"))).alias("first_of_class"),
    )


ship(__name__)
