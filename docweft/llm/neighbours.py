"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table cuts `hashes` random Gaussian projections into slots of some width; the
slot numbers name a bucket. A query visits, in each table, the `probes` buckets
with the best estimated chance: a step over a slot's border costs the square of
the distance to it, and combinations of steps are tried in order of their total
cost. Candidates from all tables are scored exactly, in double precision, and
merged.

The number of projections follows the table's size. Width and probes are fitted:
a bounded sample of rows is searched exactly, and of the widths that find enough
of these neighbours the one that visits the fewest vectors is taken.

Largest inner product is turned into smallest distance by one more coordinate:
sqrt(M^2 - |v|^2) for a vector (M: largest norm), 0 for a query. Vectors are split
into bands of at most about twofold norm, each with its own M, so that a few long
vectors do not press all others together; a band that fits one cut is one bucket.

Buckets are visited in cuts of bounded size, in rounds: each round takes eight
times as many cuts as the one before, and a query brings along the k-th score
that it has found, below which nothing is passed on. So a query gets some 8 k
results a round, however large the table.

A query that finds fewer than k of the ids that there are is searched exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import save, ship

TABLES = 2
#: Vectors that a bucket is meant to hold, and how many buckets a projection is taken to make.
BUCKET, SLOTS = 8192, 6
#: Fitting: rows searched exactly, rows whose buckets are counted, recall aimed at, widths tried, most probes of a table.
FIT_QUERIES, FIT_VECTORS, FIT_RECALL, WIDTHS, MOST_PROBES = 128, 2048, 0.99, (0.75, 1.0, 1.5, 2.0, 3.0, 8.0), 64
#: Vectors and queries of one bucket that meet in one task; larger buckets are cut, and all pairs of cuts are visited.
VECTORS_AT_ONCE, QUERIES_AT_ONCE = 2048, 1024
#: The first round visits so many buckets of each table; each round takes so many times the cuts of the one before.
FIRST_PROBES, GROWTH = 2, 8
SEED = 20240615


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return some.filter(~bad & F.exists("embedding", lambda x: x != 0))


def _matrix(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = rows.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _planes(d: int, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((tables, d + 1, hashes)), rng.random((tables, hashes))


def _name(slots: np.ndarray) -> np.ndarray:
    """One number for a bucket's slot numbers, without collisions while they stay below 2^20."""
    out = np.zeros(slots.shape[:-1], np.int64)
    for k in range(slots.shape[-1]):
        out = out * np.int64(1_000_003) + slots[..., k]
    return out


def _steps(hashes: int) -> np.ndarray:
    """Combinations of steps over slots that can be tried: at most 2 in one projection, 4 in all (3 of many projections)."""
    far = 4 if hashes <= 4 else 3
    out = [()]
    for _ in range(hashes):
        out = [(*x, s) for x in out for s in (0, -1, 1, -2, 2) if sum(map(abs, x)) + abs(s) <= far]
    return np.array(sorted(out, key=lambda x: (sum(map(abs, x)), x)))


def _costs(part: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Of each query (place inside its slots) and combination: the squared distance to the bucket."""
    away = np.where(steps < 0, part[:, None, :] - steps - 1, np.where(steps > 0, steps - part[:, None, :], 0))
    return (away**2).sum(axis=2)


def _places(v: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band of each vector, and the vector scaled by its band with the added coordinate."""
    square = (v * v).sum(axis=1)
    band = np.minimum(np.searchsorted(tops, square * (1 - 1e-12)), len(tops) - 1)
    last = np.sqrt(np.maximum(tops[band] - square, 0))[:, None]
    return band, np.hstack([v, last]) / np.sqrt(tops[band])[:, None]


def _asked(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros((len(q), 1))])


def fit(rows: DataFrame, n: int, tops: np.ndarray, alone: np.ndarray, d: int, k: int, tables: int, recall: float) -> tuple[int, float, int]:
    """hashes, width and probes for a table of n vectors; only samples of fixed size reach the driver."""
    hashes = int(np.clip(round(np.log(max(n / BUCKET, 1)) / np.log(SLOTS)), 2, 8))
    order = F.xxhash64("vec_id", "embedding")
    sample = rows.orderBy(order, "vec_id").limit(max(FIT_QUERIES, FIT_VECTORS)).collect()
    if not sample:
        return hashes, WIDTHS[-1], 1
    some = np.array([r["embedding"] for r in sample], np.float64)
    ids, asked = np.array([r["vec_id"] for r in sample[:FIT_QUERIES]]), some[:FIT_QUERIES]
    held = rows.sparkSession.sparkContext.broadcast((ids, asked))

    def search(batches):
        ids, asked = held.value
        best = {}
        for rows in batches:
            v, own = _matrix(rows, "embedding"), rows.column(0).to_numpy()
            score = asked @ v.T
            score[ids[:, None] == own[None, :]] = -np.inf
            for i in range(len(ids)):
                old = best.get(i, (np.zeros(0), np.zeros((0, v.shape[1])), own[:0]))
                near = np.argsort(-score[i], kind="stable")
                near = near[score[i, near] > -np.inf]
                near = near[np.sort(np.unique(own[near], return_index=True)[1])[:k]]  # rows of one id count once
                s, x, who = (np.concatenate(y) for y in ((old[0], score[i, near]), (old[1], v[near]), (old[2], own[near])))
                keep = np.argsort(-s, kind="stable")
                keep = keep[np.sort(np.unique(who[keep], return_index=True)[1])[:k]]
                best[i] = s[keep], x[keep], who[keep]
        for i, (s, x, who) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(who), pa.array(s), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "vec_id", "s", "x"])

    found = rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(search, "i int, vec_id bigint, s double, x array<double>")
    found = found.groupBy("i", "vec_id").agg(F.max(F.struct("s", "x")).alias("m")).select("i", "m.s", "m.x")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s")))
    found = found.withColumn("r", rank).filter(F.col("r") <= k).select("i", "x").collect()  # FIT_QUERIES * k rows
    if not found:
        return hashes, WIDTHS[-1], 1
    who, near = np.array([r["i"] for r in found]), np.array([r["x"] for r in found], np.float64)
    steps = _steps(hashes)
    options = []
    for width in WIDTHS:
        planes, shift = _planes(d, tables, hashes)
        reach, seen = np.full(len(near), len(steps)), []
        for t in range(tables):
            x = _asked(asked) @ planes[t] / width + shift[t]
            slot = np.floor(x).astype(np.int64)
            rank = np.argsort(np.argsort(_costs(x - slot, steps), axis=1, kind="stable"), axis=1)
            number = {tuple(s): j for j, s in enumerate(steps.tolist())}

            def probe_of(v, query):
                band, at = _places(v, tops)
                away = np.floor(at @ planes[t] / width + shift[t]).astype(np.int64) - slot[query]  # noqa: B023
                found = np.array([rank[i, number[s]] if (s := tuple(a)) in number else len(steps) for i, a in zip(query.tolist(), away.tolist(), strict=True)])  # noqa: B023
                return np.where(alone[band], 0, found)

            reach = np.minimum(reach, probe_of(near, who))
            pick = np.arange(min(len(some), FIT_VECTORS))
            seen.append(np.concatenate([probe_of(some[pick], np.full(len(pick), i)) for i in range(0, len(asked), 16)]))
        share = np.searchsorted(np.sort(reach), np.arange(1, min(len(steps), MOST_PROBES) + 1)) / len(reach)
        enough = np.flatnonzero(share >= recall)
        probes = int(enough[0]) + 1 if len(enough) else len(share)
        options.append((not len(enough), np.mean(np.concatenate(seen) < probes) * tables + probes / 1000, width, probes))
    _, _, width, probes = min(options)
    return hashes, width, probes


def nearest(vectors: DataFrame, queries, k: int = 20, tables: int = TABLES, recall: float = FIT_RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products found for each query row.

    `queries` is a condition on vec_id. Ties go to the smaller vec_id, a query
    never finds its own id, rows that repeat a vec_id count once. Null, zero and
    non-finite vectors take no part; vectors of different lengths have no inner
    product and do not meet. Empty tables give empty results. `recall` is what
    the fitted width and probes reach on the sample.
    """
    rows = usable(vectors)
    out = None
    for r in rows.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        found = _nearest(rows.filter(F.size("embedding") == r["d"]), queries, k, tables, recall, r["d"])
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if out is None else out


def _nearest(usable_rows: DataFrame, queries, k: int, tables: int, recall: float, d: int) -> DataFrame:
    """The same over vectors of one length."""
    spark = usable_rows.sparkSession
    facts = usable_rows.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).first()
    if facts["n"] > facts["ids"]:  # exact copies go here; other rows of one vec_id meet in their best score
        usable_rows = save(usable_rows.distinct(), "vectors")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    squares = usable_rows.select(norm.alias("s"))
    bins = squares.groupBy(F.floor(4 * F.log2("s")).alias("bin")).agg(F.max("s").alias("top"), F.count("*").alias("n")).collect()  # 4 an octave of the square
    bands = []
    for r in sorted(bins, key=lambda r: -r["top"]):
        if not bands or r["top"] < bands[-1][0] / 4:
            bands.append([r["top"] or 1.0, 0])
        bands[-1][1] += r["n"]
    tops, small = np.array([b[0] for b in bands][::-1] or [1.0]), np.array([b[1] <= VECTORS_AT_ONCE for b in bands][::-1] or [True])
    hashes, width, probes = fit(usable_rows, facts["n"], tops, small, d, k, tables, recall)
    planes, shift = _planes(d, tables, hashes)
    steps = _steps(hashes)
    kind = usable_rows.schema["embedding"].dataType.simpleString()
    held = spark.sparkContext.broadcast((planes, shift))

    def index(batches):
        planes, shift = held.value
        for rows in batches:
            band, v = _places(_matrix(rows, "embedding"), tops)
            alone = small[band]
            for t in range(len(planes)):
                bucket = np.where(alone, 0, _name(np.floor(v @ planes[t] / width + shift[t]).astype(np.int64)))
                take = pa.array(np.flatnonzero(~alone) if t else np.arange(len(v)))
                tab = pa.array((band * len(planes) + t).astype(np.int32))
                yield pa.RecordBatch.from_arrays([tab.take(take), pa.array(bucket).take(take), rows.column(0).take(take), rows.column(1).take(take)], names=["tab", "bucket", "vec_id", "v"])

    def probing(probes):
        def probe(batches):
            planes, shift = held.value
            for rows in batches:
                q = _asked(_matrix(rows, "embedding"))
                for t in range(len(planes)):
                    x = q @ planes[t] / width + shift[t]
                    slot = np.floor(x).astype(np.int64)
                    best = np.argsort(_costs(x - slot, steps), axis=1, kind="stable")[:, :probes]
                    bucket = _name(slot[:, None, :] + steps[best])
                    for band, alone in enumerate(small):
                        if alone and t:
                            continue
                        seen = np.zeros((len(q), 1), np.int64) if alone else bucket
                        take = pa.array(np.repeat(np.arange(len(q)), seen.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(seen.size, band * len(planes) + t, np.int32)), pa.array(seen.reshape(-1)), *(rows.column(c).take(take) for c in range(3))], names=["tab", "bucket", "query_id", "q", "least"])

        return probe

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("vec_id").to_numpy(), kind="stable")
            ids, v = left.column("vec_id").to_numpy()[order], _matrix(left, "v")[order]
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            asked, q, floor = right.column("query_id").to_numpy(), _matrix(right, "q"), right.column("least").to_numpy()
            for s in range(0, len(q), 128):
                rough = q[s : s + 128] @ v.T
                rough[asked[s : s + 128, None] == ids[None, :]] = -np.inf
                by_id = rough if len(starts) == len(ids) else np.maximum.reduceat(rough, starts, axis=1)
                least = np.partition(by_id, -k, axis=1)[:, -k] if len(starts) > k else np.full(len(rough), -np.inf)
                least = np.maximum(least, floor[s : s + 128])
                for i, low in enumerate(least):
                    near = np.flatnonzero((rough[i] >= low - 1e-9 * (1 + abs(low))) & (rough[i] > -np.inf)) if low > -np.inf else np.flatnonzero(rough[i] > -np.inf)
                    if not len(near):
                        continue
                    exact = (v[near] * q[s + i]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))
                    _, one = np.unique(ids[near[best]], return_index=True)
                    best = best[np.sort(one)[:k]]
                    out["query_id"].append(np.full(len(best), asked[s + i]))
                    out["vec_id"].append(ids[near[best]])
                    out["score"].append(exact[best])
        return pa.table({c: np.concatenate(x) if x else np.zeros(0, np.float64 if c == "score" else np.int64) for c, x in out.items()})

    def best_of(placed: DataFrame, asked: DataFrame, at_once: int, every: int = 1, known: DataFrame | None = None) -> DataFrame:
        """The best of the cuts whose number `every` divides, and of what is known."""
        v_cuts = placed.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / at_once).alias("vc"))
        q_cuts = asked.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).alias("qc"))
        cuts = v_cuts.join(q_cuts, ["tab", "bucket"])
        zero, step = F.lit(0).cast("long"), F.lit(every).cast("long")
        left = placed.join(cuts, ["tab", "bucket"]).withColumn("vp", F.pmod(F.xxhash64("vec_id", "v"), F.col("vc"))).filter(F.col("vp") % step == 0)
        left = left.select("tab", "bucket", "vec_id", "v", "vp", F.explode(F.sequence(zero, F.col("qc") - 1)).alias("qp"))
        right = asked.join(cuts, ["tab", "bucket"]).select("tab", "bucket", "query_id", "q", "least", F.explode(F.sequence(zero, F.col("vc") - 1, step)).alias("vp"), F.pmod(F.xxhash64("query_id", "q"), F.col("qc")).alias("qp"))
        keys = ["tab", "bucket", "vp", "qp"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
        if known is not None:
            found = found.unionByName(known.select("query_id", "vec_id", "score"))
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    every = usable_rows.select(F.col("vec_id").cast("long"), "embedding")
    chosen = usable_rows.filter(queries).select(F.col("vec_id").cast("long"), "embedding")
    placed = every.mapInArrow(index, f"tab int, bucket bigint, vec_id bigint, v {kind}")
    asked_kind = f"tab int, bucket bigint, query_id bigint, q {kind}, least double"
    most = placed.groupBy("tab", "bucket").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, int(np.ceil(np.log(max(most / VECTORS_AT_ONCE, 1)) / np.log(GROWTH)))) if facts["n"] > VECTORS_AT_ONCE else 0
    known = None
    for left in range(rounds, -1, -1):
        if known is None:
            asking = chosen.withColumn("least", F.lit(float("-inf")))
        else:
            low = known.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
            asking = chosen.join(low, "vec_id", "left").select("vec_id", "embedding", F.coalesce("score", F.lit(float("-inf"))).alias("least"))
        asked = asking.mapInArrow(probing(probes if left == 0 else min(FIRST_PROBES, probes)), asked_kind)
        known = save(best_of(placed, asked, VECTORS_AT_ONCE, GROWTH**left, known), "found")

    counts = known.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    short = chosen.join(counts, "vec_id", "left").filter(F.coalesce("n", F.lit(0)) < min(k, facts["ids"] - 1))
    one = [F.lit(0).alias("tab"), F.lit(0).cast("long").alias("bucket")]
    short = save(short.select(*one, F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(float("-inf")).alias("least")), "short")
    if short.isEmpty():
        return known
    rest = best_of(every.select(*one, "vec_id", F.col("embedding").alias("v")), short, max(VECTORS_AT_ONCE, (1 << 20) // d))
    return known.join(short.select("query_id").distinct(), "query_id", "left_anti").select(*known.columns).unionByName(rest)


ship(__name__)
