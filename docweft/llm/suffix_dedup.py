"""Removal of repeated byte strings, by bounded interval expansion on Burrows-Wheeler transforms.

Every byte that a `length`-byte string covers which also starts earlier goes.

1. Each window of `length` bytes picks the k-gram of smallest hash in it; equal
   windows pick equal k-grams at equal places. Neighbouring windows with one
   choice form an occurrence (k-gram, stretch of text). Equal stretches (by 128
   bits: the hashes of k-gram and stretch) are settled at once: inside a slice
   before the shuffle, then per k-gram, one group of k-grams after another.
2. Stretches that share a k-gram but are not equal are cut out of the texts and
   gathered per k-gram into small blocks. A block gets a suffix order (on the
   first bytes only), its Burrows-Wheeler transform, and a breadth-first search
   by backward extension: from the empty string, intervals of all strings of 1,
   2, ... bytes are derived, and each new interval end fixes one common-prefix
   length. The search stops at `length`; suffixes that no end separates begin
   with equal windows.
3. K-grams with very many different stretches (found beforehand by a count over
   a sample, and by exact count later) never meet in one task: their windows are
   compared by hash, with partial aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BYTE_VALUE, MIX, finish, parallelism, power_tables, save, ship, slices

LENGTH = 100
GRAM = 32
#: Window starts handled at once; bytes of a block; stretches of one k-gram that may share a block.
STEP, BLOCK_BYTES, MOST_STRETCHES = 1 << 19, 1 << 20, 2000
#: Groups of k-grams that a task settles one after another.
GROUPS = 4
#: One text in so many is sampled for frequent k-grams; a share of this much is frequent (so at most 1/share are).
SAMPLE_OF, FREQUENT = 64, 1e-4
POSITION = np.uint64((1 << 21) - 1)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Occurrences in the rows: row, a (first window's place in the row), n (windows), m (k-gram hash), c (hash of the stretch)."""
    n = len(data)
    invalid = np.zeros(n + 1, np.int32)
    np.add.at(invalid, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(invalid, offsets[1:], -1)
    valid = np.cumsum(invalid[:n]) == 0
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("at", "n", "m", "c")}
    span = length - gram + 1
    for s in range(0, n - length + 1, STEP):
        seg = data[s : s + STEP + length - 1]
        ok = valid[s : s + len(seg) - length + 1]
        h = BYTE_VALUE[seg]
        size = 1
        while size < gram:
            h = h[:-size] * np.uint64(0x9E6C63D0876A9A35 + 2 * size) + h[size:]
            size *= 2
        h = finish(h)
        low = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        cut = np.flatnonzero((low[1:] != low[:-1]) | (ok[1:] != ok[:-1])) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(low)]])
        keep = ok[first]
        first, last = first[keep], last[keep]
        up, down = power_tables(len(seg) + 1)
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[seg] * up[: len(seg)], out=total[1:])
        count = last - first
        c = (total[first + count + length - 1] - total[first]) * down[first]
        out["at"].append(first + s)
        out["n"].append(count)
        out["m"].append(h[(low[first] & POSITION).astype(np.int64)])
        out["c"].append(finish(finish(c) + count.astype(np.uint64) * MIX))
    joined = {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in "mc" else np.int64) for k, v in out.items()}
    row = np.searchsorted(offsets, joined["at"], side="right") - 1
    return {"row": row, "a": joined["at"] - offsets[row], "n": joined["n"], "m": joined["m"], "c": joined["c"]}


def firsts(groups: list[np.ndarray], doc: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by group (equal values in all of `groups`), document rank and place: the order, and which of it starts earlier than nothing equal."""
    order = np.lexsort((a, doc, *groups))
    d, p = doc[order], a[order]
    new = np.ones(len(d), bool)
    new[1:] = False
    for g in groups:
        new[1:] |= g[order[1:]] != g[order[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order, (d == d[head]) & (p == p[head])


def runs(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals [a, b) of each document."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(b + doc * far)
    new = np.ones(len(doc), bool)
    new[1:] = a[1:] + doc[1:] * far > reach[:-1]
    start = np.flatnonzero(new)
    return doc[start], a[start], np.concatenate([reach[start[1:] - 1], reach[-1:]]) - doc[start] * far


def doc_ranks(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each (id, hash) in their order, and an index of one row per rank."""
    order = np.lexsort((hashes, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def equal_windows(contexts: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Text of all contexts, each ended by 0xFF (which UTF-8 never holds), as suffix order and its class: equal class, equal first `length` bytes."""
    text = np.concatenate([np.append(c, np.uint8(255)) for c in contexts])
    n = len(text)
    padded = np.concatenate([text, np.full(8, 255, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        change = np.zeros(n, np.int64)
        change[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        if known > length or int(change.sum()) == n - 1:
            break
        later = np.full(n, n, np.int64)
        later[: max(n - known, 0)] = rank[known:]
        key = (rank.astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)
        known *= 2
    bwt = text[order - 1]
    bwt[order == 0] = 255
    step = np.empty(n, np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    ended = np.zeros(n + 1, bool)  # ends whose common prefix is shorter than `length`
    ended[0] = True
    lb, rb = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = rb - lb
        total = int(sizes.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(lb)), sizes)
        at = np.arange(total) + np.repeat(lb - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        sign = bwt[at]
        use = sign != 255
        to, owner, sign = step[at[use]], owner[use], sign[use]
        if len(to) * 8 > n:
            tag = np.full(n, -1, np.int64)
            tag[to] = owner * 256 + sign
            to = np.flatnonzero(tag >= 0)
            tag = tag[to]
        else:
            by = np.argsort(to)
            to, tag = to[by], (owner * 256 + sign)[by]
        if not len(to):
            break
        new = np.ones(len(to), bool)
        new[1:] = tag[1:] != tag[:-1]
        start = np.flatnonzero(new)
        lb = to[start]
        rb = to[np.append(start[1:] - 1, len(to) - 1)] + 1
        fresh = ~ended[rb]
        lb, rb = lb[fresh], rb[fresh]
        ended[rb] = True
    return order, np.cumsum(ended[:n])


ROWS = pa.schema([("part", pa.int64()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("m", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
ROWS_DDL = "part bigint, blob binary, doc_id bigint, th bigint, m bigint, a bigint, n bigint, hot boolean, starts array<bigint>, ends array<bigint>"


def rows_of(size: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in ROWS], schema=ROWS)


def marks_of(ids: np.ndarray, hashes: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int) -> pa.RecordBatch | None:
    """One row per document with its merged marks; ids and hashes by rank."""
    doc, a, b = runs(rank, a, b)
    if not len(doc):
        return None
    first = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
    bounds = pa.array(np.append(first, len(doc)).astype(np.int32))
    who = doc[first]
    # dealt by id and text: copies of one text share the hash
    part = finish(ids[who].astype(np.uint64) * MIX + hashes[who].astype(np.uint64)) % np.uint64(parts)
    return rows_of(len(first), part=pa.array(part.astype(np.int64)), doc_id=pa.array(ids[who]), th=pa.array(hashes[who]), starts=pa.ListArray.from_arrays(bounds, pa.array(a)), ends=pa.ListArray.from_arrays(bounds, pa.array(b)))


BLOB = np.dtype([("m", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("a", "<i4"), ("n", "<i4")])


def pack(x: np.ndarray) -> bytes:
    """Column after column: ids and places compress well in the shuffle."""
    return b"".join(np.ascontiguousarray(x[k]).tobytes() for k in BLOB.names)


def unpack(blob: bytes) -> np.ndarray:
    n, at = len(blob) // BLOB.itemsize, 0
    out = np.empty(n, BLOB)
    for k in BLOB.names:
        size = n * BLOB[k].itemsize
        out[k] = np.frombuffer(blob[at : at + size], BLOB[k])
        at += size
    return out


def _column(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _frequent(texts: DataFrame, length: int) -> np.ndarray:
    """K-grams with at least a share of FREQUENT of all stretches in a sample of texts; results never depend on it."""

    def count(batches):
        for _, data, offsets in slices(batches):
            x = stretches(data, offsets, length)
            pair = np.unique(np.stack([x["m"], x["c"]], axis=1), axis=0) if len(x["m"]) else np.zeros((0, 2), np.uint64)
            m, n = np.unique(pair[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n.astype(np.int64))], names=["m", "n"])

    counted = texts.filter(F.pmod("th", F.lit(SAMPLE_OF)) == 0).select("text").mapInArrow(count, "m bigint, n bigint").groupBy("m").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.filter(F.col("n") >= max(32, FREQUENT * total)).select("m").collect()  # at most 1 / FREQUENT rows
    return np.sort(np.array([r["m"] for r in found], np.int64).view(np.uint64))


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th (xxhash64 of the text) and the byte intervals to remove, as sorted disjoint starts and ends.

    Documents without any are left out, as are those with a null doc_id or text.
    """
    spark = docs.sparkSession
    workers = parallelism(spark)
    parts = workers * GROUPS
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    repeated = save(texts.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "th"), "repeated")
    if not repeated.isEmpty():  # one row of each, so that a text meets its stretches once
        once = texts.join(repeated, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
        texts = save(texts.join(repeated, ["doc_id", "th"], "left_anti").unionByName(once), "once")
    frequent = spark.sparkContext.broadcast(_frequent(texts, length))

    def gather(batches):
        often = frequent.value
        for turn, (rows, data, offsets) in enumerate(slices(batches, limit=16 << 20)):
            x = stretches(data, offsets, length)
            if not len(x["m"]):
                continue
            ids, hashes = _column(rows, "doc_id"), _column(rows, "th")
            rank, one = doc_ranks(ids, hashes)
            doc = rank[x["row"]]
            order, head = firsts([x["m"], x["c"]], doc, x["a"])
            later = order[~head]
            marks = marks_of(ids[one], hashes[one], doc[later], x["a"][later], x["a"][later] + x["n"][later] + length - 1, parts)
            if marks is not None:
                yield marks
            order = order[head]
            m = x["m"][order]
            kept = np.empty(len(order), BLOB)
            kept["m"], kept["c"], kept["doc"], kept["th"], kept["a"], kept["n"] = m, x["c"][order], ids[x["row"][order]], hashes[x["row"][order]], x["a"][order], x["n"][order]
            part = (m % np.uint64(parts)).astype(np.int64)
            if len(often):
                hot = often[np.minimum(np.searchsorted(often, m), len(often) - 1)] == m
                part[hot] = (part[hot] + int(hashes[0]) + turn) % parts  # spread: such a k-gram needs no meeting here
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts))
            yield rows_of(len(some), part=pa.array(some), blob=pa.array([pack(kept[by[cuts[p] : cuts[p + 1]]]) for p in some], pa.binary()))

    def settle(batches):
        held, last = [], None
        for rows in batches:
            part = _column(rows, "part")
            blobs = rows.column(rows.schema.get_field_index("blob"))
            is_mark = np.asarray(blobs.is_null())
            for i in np.flatnonzero(~is_mark):  # in order of part
                if held and part[i] != last:
                    yield from settled(np.concatenate(held))
                    held = []
                held.append(unpack(blobs[int(i)].as_py()))
                last = part[i]
            if is_mark.any():
                yield rows.filter(pa.array(is_mark))
        if held:
            yield from settled(np.concatenate(held))

    def settled(x):
        often = frequent.value
        rank, one = doc_ranks(x["doc"], x["th"])
        order, head = firsts([x["m"], x["c"]], rank, x["a"].astype(np.int64))
        later = order[~head]
        marks = marks_of(x["doc"][one], x["th"][one], rank[later], x["a"][later].astype(np.int64), x["a"][later].astype(np.int64) + x["n"][later] + length - 1, parts)
        if marks is not None:
            yield marks
        x = x[order[head]]
        x = x[np.argsort(x["m"], kind="stable")]
        new = np.ones(len(x), bool)
        new[1:] = x["m"][1:] != x["m"][:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(x)))
        size = np.repeat(size, size)
        hot = size > MOST_STRETCHES
        if len(often):
            hot |= often[np.minimum(np.searchsorted(often, x["m"]), len(often) - 1)] == x["m"]
        use = (size > 1) | hot
        x, hot = x[use], hot[use]
        for s in range(0, len(x), 100_000):
            y = x[s : s + 100_000]
            yield rows_of(len(y), doc_id=pa.array(y["doc"]), th=pa.array(y["th"]), m=pa.array(y["m"].view(np.int64)), a=pa.array(y["a"]), n=pa.array(y["n"]), hot=pa.array(hot[s : s + 100_000]))

    found = save(texts.mapInArrow(gather, ROWS_DDL).repartition(workers, "part").sortWithinPartitions("part").mapInArrow(settle, ROWS_DDL).drop("part", "blob"), "stretches")

    def expand(batches):
        held, size, last = [], 0, None
        for rows in batches:
            m = _column(rows, "m")
            cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if size > BLOCK_BYTES and m[a] != last:
                    yield from block(held)
                    held, size = [], 0
                held.append(rows.slice(a, b - a))
                size += held[-1].nbytes
                last = m[a]
        if held:
            yield from block(held)

    def block(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        get = lambda c: rows.column(c).to_numpy()
        contexts = [np.frombuffer(x, np.uint8) for x in rows.column("context").to_pylist()]
        order, group = equal_windows(contexts, length)
        sizes = np.array([len(c) + 1 for c in contexts])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        which = np.searchsorted(base, order, side="right") - 1
        off = order - base[which]
        ok = off < sizes[which] - length
        which, off, group = which[ok], off[ok], group[ok]
        many = np.bincount(group)[group] > 1
        which, off, group = which[many], off[many], group[many]
        if not len(which):
            return
        ids, hashes = get("doc_id"), get("th")
        rank, one = doc_ranks(ids, hashes)
        at = get("a")[which] + off
        order, head = firsts([group], rank[which], at)
        later = order[~head]
        marks = marks_of(ids[one], hashes[one], rank[which[later]], at[later], at[later] + length, parts)
        if marks is not None:
            yield marks.select(["doc_id", "th", "starts", "ends"])

    cut = found.filter("m IS NOT NULL").join(texts, ["doc_id", "th"]).select("doc_id", "th", "m", "a", "n", "hot", F.expr(f"substring(cast(text AS binary), CAST(a + 1 AS INT), CAST(n + {length - 1} AS INT))").alias("context"))
    marks_ddl = "doc_id bigint, th bigint, starts array<bigint>, ends array<bigint>"
    near = cut.filter("NOT hot").repartition(workers, "m").sortWithinPartitions("m").mapInArrow(expand, marks_ddl)

    windows = cut.filter("hot").select("doc_id", "th", "a", "context", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("off"))
    window = F.expr(f"substring(context, CAST(off + 1 AS INT), {length})")
    windows = windows.select("doc_id", "th", (F.col("a") + F.col("off")).alias("at"), F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(1), window).alias("w2"))
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "th", "at")).alias("low"))
    hot = windows.join(least, ["w1", "w2"]).filter(F.struct("doc_id", "th", "at") != F.col("low")).select("doc_id", "th", F.array("at").alias("starts"), F.array(F.col("at") + length).alias("ends"))

    every = found.filter("m IS NULL").select("doc_id", "th", "starts", "ends").unionByName(near).unionByName(hot)
    return every.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining bytes.

    Null texts count as empty. Documents are taken in order of doc_id (rows that
    share an id but not the text: of the text's hash); an exact repeat of a row is
    the same document and gets the same result. Rows with a null doc_id are kept
    whole and make nothing else go. Other columns are not read.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    marks = find_repeats(docs, length)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for rows, data, offsets in slices(batches):
            starts, ends = rows.column(rows.schema.get_field_index("starts")), rows.column(rows.schema.get_field_index("ends"))
            n = np.diff(offsets)
            removed, spans, sha, kept = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [], []
            for i in range(len(n)):
                whole = data[offsets[i] : offsets[i + 1]]
                if starts[i].is_valid:
                    a, b = starts[i].values.to_numpy(), ends[i].values.to_numpy()
                    _, a, b = runs(np.zeros(len(a), np.int64), a, b)
                    pieces = [whole[x:y] for x, y in zip(np.append(0, b), np.append(a, n[i]), strict=True)]
                    removed[i], spans[i] = int((b - a).sum()), len(a)
                    whole = np.concatenate(pieces)
                sha.append(hashlib.sha256(whole.tobytes()).hexdigest())
                if keep_text:
                    kept.append(whole.tobytes())
            columns = [rows.column(rows.schema.get_field_index("doc_id")), pa.array(n), pa.array(removed), pa.array(spans), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = texts.join(marks, ["doc_id", "th"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text)


ship(__name__)
