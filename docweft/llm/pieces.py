"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut where no piece of the model can span: between two bytes that no
piece holds side by side. What lies between two cuts is a word; pieces never
cross a cut, so each distinct word is encoded once and its ids are put together.

Frequent words are encoded by tables: their substrings up to the longest piece
are exploded, equi-joined to the piece table, and the edges grouped by word. One
higher-order aggregate folds each word's lattice: Viterbi for unigram models,
rank-ordered merges for BPE models (there the best sum of scores is not the
encoding that the model defines). Frequent means a share of all words, so the
table has at most 1 / share rows, whatever the input; it is sent to the tasks.
Rarer words are joined to the piece table and folded inside the tasks, all the
distinct words of a slice at once, over arrays: the same merges, the same ids.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import MIX, list_array, save, ship, slices, utf8

MARK = "▁"
#: Words with this share of all words or more go through the tables (so at most 1 / share do), if no longer than this.
TABLE_SHARE, TABLE_CHARS = 1e-5, 48
#: Text that is cut into words at once, and whose distinct words are folded at once.
SLICE = 4 << 20
#: Up to so many characters words are merged side by side over arrays, beyond that each over a heap.
SIDE_BY_SIDE = 64
UNIGRAM, BPE = 1, 2
NONE = np.int32(2**31 - 1)


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class PieceModel:
    """Pieces with scores and types (1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte), and how a text is prepared."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    model_type: int = BPE
    dummy_prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict, compare=False)
    byte_ids: tuple[int, ...] = ()
    unknown: int = 0
    ranks: dict[str, float] = field(default_factory=dict, compare=False)

    @staticmethod
    def of(pieces, scores, types, model_type: int = BPE, dummy_prefix: bool = True) -> PieceModel:
        ids = {p: i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t in (1, 4)}
        codes = {p: i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == 6}
        byte_ids = tuple(codes[f"<0x{b:02X}>"] for b in range(256)) if len(codes) == 256 else ()
        return PieceModel(tuple(pieces), tuple(scores), tuple(types), model_type, dummy_prefix, ids, byte_ids, next((i for i, t in enumerate(types) if t == 2), 0), {p: scores[i] for p, i in ids.items()})

    @staticmethod
    def load(spark: SparkSession, path: str) -> PieceModel:
        """Read a .model file by Spark's own reader. Normalisation other than identity is refused."""
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        pieces, scores, types, kind, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append(x[1].decode("utf-8"))
                scores.append(float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]))
                types.append(x.get(3, 1))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                x = dict(_fields(value))
                prefix = bool(x.get(3, 1))
                if x.get(1, b"identity") != b"identity" or x.get(4, 1) or not x.get(5, 1):
                    raise ValueError("only models with identity normalisation and kept white space can be used")
        return PieceModel.of(pieces, scores, types, kind, prefix)

    def fallback(self, sign: str) -> list[int]:
        return [self.byte_ids[b] for b in sign.encode("utf-8")] if self.byte_ids else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """The fold of one word's lattice, in memory linear in the word."""
        out = []
        for a, b in (_merged if self.model_type == BPE else _viterbi)(word, self):
            piece = self.ids.get(word[a:b])
            out += self.fallback(word[a:b]) if piece is None else [piece]
        return out

    def raw(self) -> list[bytes]:
        """What each piece stands for in a text; nothing for control pieces."""
        return [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]


def _merged(word: str, model: PieceModel) -> list[tuple[int, int]]:
    """Merges neighbours whose union is a piece, best score first, leftmost at ties; a heap holds the candidates."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []
    ids, scores = model.ids, model.scores

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (piece := ids.get(word[a : after[b]])) is not None:
            heapq.heappush(heap, (-scores[piece], a, after[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, end = heapq.heappop(heap)
        if not alive[a] or after[a] >= n or after[after[a]] != end:
            continue
        b = after[a]
        alive[b] = False
        after[a] = end
        if end < n:
            before[end] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [(a, after[a]) for a in range(n) if alive[a]]


def _viterbi(word: str, model: PieceModel) -> list[tuple[int, int]]:
    """Best sum of scores; a sign without a piece costs the lowest score less 10."""
    longest = max(map(len, model.ids), default=1)
    low = min((model.scores[i] for i in model.ids.values()), default=0.0) - 10
    best, back = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for a in range(max(0, end - longest), end):
            piece = model.ids.get(word[a:end])
            if piece is not None or end - a == 1:
                score = best[a] + (low if piece is None else model.scores[piece])
                if score > best[end]:
                    best[end], back[end] = score, a
    out, end = [], len(word)
    while end:
        out.append((back[end], end))
        end = back[end]
    return out[::-1]


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `sizes` values from `first` on, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)]


def slots_of(key: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots where a key can stand; `half` is a power of two."""
    h = (key ^ (key >> np.uint64(15))) * MIX
    low = np.uint64(half - 1)
    return ((h >> np.uint64(40)) & low).astype(np.int64), half + ((h >> np.uint64(16)) & low).astype(np.int64)


def pair_slots(pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A hash table of two slots a key (cuckoo hashing): keys, and the rank and union of each."""
    half = 1 << 12
    while half < 4 * len(pairs):
        half *= 2
    keys, facts = np.full(2 * half, np.uint64(2**64 - 1)), np.zeros((2 * half, 2), np.int32)
    one, other = (x.tolist() for x in slots_of(np.array([x[0] for x in pairs], np.uint64), half))
    held: dict[int, int] = {}
    for k in range(len(pairs)):
        at, moved = one[k], 0
        while at in held:
            held[at], k = k, held[at]
            at = other[k] if at == one[k] else one[k]
            moved += 1
            if moved > 500:
                raise ValueError("no place for a pair of symbols")
        held[at] = k
    for at, k in held.items():
        keys[at], facts[at] = pairs[k][0], pairs[k][1:]
    return keys, facts


class Folder:
    """A model as arrays: where texts are cut, which symbols each character and each pair of symbols makes.

    Symbols are the pieces, and the characters of pieces that are none themselves.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        spans = np.zeros((256, 256), bool)
        spans[:, 0x80:0xC0] = True  # inside a character
        names = list(model.ids)
        symbol = {p: k for k, p in enumerate(names)}
        for p in list(names):
            raw = p.replace(MARK, " ").encode()
            for a, b in zip(raw, raw[1:], strict=False):
                spans[a, b] = True
            for c in p:
                if c not in symbol:
                    symbol[c] = len(names)
                    names.append(c)
        self.spans = spans.reshape(-1)
        self.ids = np.array([model.ids.get(p, -1) for p in names] or [-1], np.int32)
        signs = {ord(" " if p == MARK else p): k for p, k in symbol.items() if len(p) == 1}
        self.of_sign = np.full(max(signs, default=0) + 2, -1, np.int32)
        self.of_sign[list(signs)] = list(signs.values())
        self.size = np.uint64(len(names) + 1)
        ranks = {s: k for k, s in enumerate(sorted({model.scores[i] for i in model.ids.values()}, reverse=True))}
        pairs = sorted((symbol[p[:k]] * int(self.size) + symbol[p[k:]], ranks[model.scores[i]], symbol[p]) for p, i in model.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.slots = pair_slots(pairs)
        raw = model.raw()
        self.raw = pa.array(raw, pa.large_binary())
        self.raw_sizes = np.array([len(x) for x in raw], np.int64)
        self.odd = np.array([t in (2, 6) for t in model.types])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the words of rows that stand one after another; empty rows have none."""
        if not len(data):
            return np.zeros(0, np.int64)
        cut = np.ones(len(data), bool)
        np.logical_not(self.spans[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]], out=cut[1:])
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def _best(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's union (NONE without one), and the union."""
        keys, facts = self.slots
        key = left.astype(np.uint64) * self.size + right.astype(np.uint64)  # symbols that are none fit no key
        at = slots_of(key, len(keys) // 2)
        at = np.where(keys[at[0]] == key, at[0], at[1])
        found = facts[at]
        return np.where((keys[at] == key) & (left >= 0) & (right >= 0), found[:, 0], NONE), found[:, 1]

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol (-1: none), word and first byte of each part of the words, in order.

        Each round does the best merge of every word that has one, the leftmost at ties.
        """
        first = np.flatnonzero((data & 0xC0) != 0x80)
        b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        lead = b[first]
        sign = np.where(lead < 0xC0, lead, np.where(lead < 0xE0, ((lead & 31) << 6) | (b[first + 1] & 63), np.where(lead < 0xF0, ((lead & 15) << 12) | ((b[first + 1] & 63) << 6) | (b[first + 2] & 63), ((lead & 7) << 18) | ((b[first + 1] & 63) << 12) | ((b[first + 2] & 63) << 6) | (b[first + 3] & 63))))
        part = self.of_sign[np.minimum(sign, len(self.of_sign) - 1)]
        begins = np.zeros(len(data), np.int32)
        begins[offsets[:-1]] = 1
        word, first = np.cumsum(begins, dtype=np.int32)[first] - np.int32(1), first.astype(np.int32)
        rank, union = np.full(len(part), NONE), np.zeros(len(part), np.int32)
        if len(part):
            rank[:-1], union[:-1] = self._best(part[:-1], part[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(part):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, heads)
            live = best < NONE
            sizes = np.diff(np.append(heads, len(part)))
            of_live = np.repeat(live, sizes)
            if not live.all():
                over = ~of_live
                done.append((part[over], word[over], first[over]))
            if not live.any():
                break
            hit = np.flatnonzero(rank == np.repeat(np.where(live, best, -1), sizes))
            at = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            part[at] = union[at]
            of_live[at + 1] = False
            place = np.cumsum(of_live) - 1
            at = place[at]
            part, word, first, rank, union = (x[of_live] for x in (part, word, first, rank, union))
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(part) - 1)
                new, into = self._best(part[left], part[right])
                rank[left] = np.where((right > left) & (word[left] == word[right]), new, NONE)
                union[left] = into
        if not done:
            return part, word, first
        part, word, first = (np.concatenate([x[k] for x in done]) for k in range(3))
        order = np.argsort(first, kind="stable")
        return part[order], word[order], first[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that stand one after another, and how many each has."""
        model, n = self.model, len(offsets) - 1
        alone = np.diff(offsets) > SIDE_BY_SIDE if model.model_type == BPE else np.ones(n, bool)
        if alone.any():
            lengths = np.diff(offsets)
            ids, many = self.encode(data[np.repeat(~alone, lengths)], np.append(0, np.cumsum(lengths[~alone])))
            long = [np.array(model.encode_word(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace").replace(" ", MARK)), np.int32) for k in np.flatnonzero(alone).tolist()]
            sizes = np.zeros(n, np.int64)
            sizes[~alone], sizes[alone] = many, [len(x) for x in long]
            first = np.zeros(n, np.int64)
            first[~alone], first[alone] = np.cumsum(many) - many, len(ids) + np.cumsum(sizes[alone]) - sizes[alone]
            return gather(np.concatenate([ids, *long]), first, sizes), sizes
        part, word, first = self.merge(data, offsets)
        ids = np.where(part >= 0, self.ids[part], -1)
        bare = np.flatnonzero(ids < 0)
        each = np.ones(len(ids), np.int64)
        instead = [np.array(model.fallback(data[first[k] : first[k + 1] if k + 1 < len(first) else len(data)].tobytes().decode("utf-8", "replace").replace(" ", MARK)), np.int32) for k in bare.tolist()]
        each[bare] = [len(x) for x in instead]
        flat = np.repeat(ids, each).astype(np.int32)
        if len(bare):
            flat[np.repeat(ids < 0, each)] = np.concatenate(instead)
        return flat, np.bincount(word, weights=each, minlength=n).astype(np.int64)

    def restores(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether decoding each word's ids gives the word back."""
        lengths = self.raw_sizes[ids]
        upto = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(sizes))]
        back = bytes_of(self.raw.take(pa.array(ids)))[0]
        if len(back) == len(data) and np.array_equal(upto, offsets) and np.array_equal(back, data):
            return np.ones(len(sizes), bool)
        return np.array([back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(upto, upto[1:], offsets, offsets[1:], strict=False)], bool)


def prepared(text: pa.Array, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts as they are encoded: marks as spaces, a space before each text if the model has it so."""
    text = pc.replace_substring(text.cast(pa.large_string()).fill_null(""), MARK, " ")
    if model.dummy_prefix:
        text = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), text, pa.scalar("", pa.large_string()))
    return utf8(text)


def word_codes(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words as bytes, and the index of each word among them."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary column without nulls."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(words) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_FOLDER: dict[str, Folder] = {}


def folder_of(model: PieceModel) -> Folder:
    """The arrays of the model that was used last are kept."""
    if "last" not in _FOLDER or _FOLDER["last"].model is not model:
        _FOLDER["last"] = Folder(model)
    return _FOLDER["last"]


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """piece, id and score of the pieces that words are made of: a table whose size the model fixes."""
    rows = [(p, i, float(model.scores[i])) for p, i in model.ids.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word and its edges: array of struct(a, b, id, score), by place; words without an edge keep an empty array."""
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("a"))
    spans = starts.select("word", "a", F.explode(F.sequence(F.col("a") + 1, F.least(n, F.col("a") + longest))).alias("b"))
    cut = spans.withColumn("piece", F.substring("word", F.col("a") + 1, F.col("b") - F.col("a")))
    edges = cut.join(F.broadcast(pieces), "piece").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("a", "b", "id", "score"))).alias("edges"))
    empty = F.array().cast("array<struct<a:int,b:int,id:int,score:double>>")
    return words.join(edges, "word", "left").select("word", F.coalesce("edges", empty).alias("edges"))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_merges(edges: Column, length: Column) -> Column:
    """Ends of the pieces of a BPE word: each step applies the best merge of two neighbours, the leftmost at ties."""
    place = lambda a, b: a * F.lit(1 << 16) + b
    scores = F.map_from_arrays(F.transform(edges, lambda e: place(e["a"], e["b"])), F.transform(edges, lambda e: -e["score"]))

    def fold(score: Column) -> Column:
        def step(cuts: Column, _: Column) -> Column:
            inner = F.filter(F.sequence(F.lit(1), F.greatest(F.size(cuts) - 2, F.lit(1))), lambda i: i < F.size(cuts) - 1)
            unions = F.transform(inner, lambda i: F.struct(F.try_element_at(score, place(F.get(cuts, i - 1), F.get(cuts, i + 1))).alias("s"), F.get(cuts, i).alias("cut")))
            return _let(F.array_min(F.filter(unions, lambda u: u["s"].isNotNull())), lambda best: F.when(best.isNull(), cuts).otherwise(F.array_remove(cuts, best["cut"])))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), F.sequence(F.lit(0), length), step)

    return F.slice(_let(scores, fold), 2, length)


def fold_viterbi(edges: Column, length: Column, unknown: float) -> Column:
    """Ends of the pieces on the best path of a unigram word."""
    first = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("ends"))

    def step(best: Column, end: Column) -> Column:
        into = F.concat(F.filter(edges, lambda e: e["b"] == end), F.array(F.struct((end - 1).alias("a"), end.alias("b"), F.lit(-1).alias("id"), F.lit(unknown).alias("score"))))
        paths = F.transform(into, lambda e: F.struct((F.get(best, e["a"])["s"] + e["score"]).alias("s"), (-e["a"]).alias("back"), F.concat(F.get(best, e["a"])["ends"], F.array(end)).alias("ends")))
        top = F.array_max(paths)
        return F.concat(best, F.array(F.struct(top["s"].alias("s"), top["ends"].alias("ends"))))

    done = F.aggregate(F.sequence(F.lit(1), length), F.array(first), step)
    return F.get(done, length)["ends"]


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """word and ids (-1 for a sign without a piece), by the lattice tables; words are distinct and not empty."""
    spark = words.sparkSession
    longest = max(map(len, model.ids), default=1)
    graph = lattice(words, piece_table(spark, model), longest)
    n = F.length("word")
    low = min((model.scores[i] for i in model.ids.values()), default=0.0) - 10
    ends = fold_merges(F.col("edges"), n) if model.model_type == BPE else fold_viterbi(F.col("edges"), n, low)
    return graph.withColumn("ends", ends).select("word", F.transform("ends", lambda end, i: F.coalesce(F.get(F.transform(F.filter("edges", lambda e: (e["b"] == end) & (e["a"] == F.when(i == 0, 0).otherwise(F.get(F.col("ends"), i - 1)))), lambda e: e["id"]), 0), F.lit(-1))).alias("ids"), "ends")


def frequent_words(docs: DataFrame, model: PieceModel, share: float = TABLE_SHARE) -> DataFrame:
    """The words that make up at least `share` of all words: at most 1 / share rows, and more by no order of rows.

    A slice tells of the words with that share in it; their counts add up to no
    more than the truth, so a word may be missed near the border, never added.
    """

    def count(batches):
        folder = held.value
        for rows, _, _ in slices(batches, limit=SLICE):
            data, offsets = prepared(rows.column(0), folder.model)
            starts = folder.words(data, offsets)
            if not len(starts):
                continue
            distinct, codes = word_codes(data, starts)
            n = np.bincount(codes, minlength=len(distinct))
            some = np.flatnonzero(n >= share * len(codes))
            words = distinct.take(pa.array(some)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.nulls(1, pa.string())]), pa.array(np.append(n[some], len(codes)))], names=["word", "n"])

    held = docs.sparkSession.sparkContext.broadcast(folder_of(model))
    counted = save(docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counted")
    total = counted.filter("word IS NULL").first()
    return counted.filter(F.col("word").isNotNull() & (F.col("n") >= share * (total["n"] if total else 0))).select(F.replace("word", F.lit(" "), F.lit(MARK)).alias("word"))


def encode(docs: DataFrame, model: PieceModel, keep: list[str] | None = None, share: float = TABLE_SHARE) -> DataFrame:
    """Columns `keep` (doc_id alone by default), ids, n_fallback (ids of bytes or unknown) and exact (decoding gives the text back).

    Null texts have null ids and exact null, empty texts no ids. Row by row, so
    repeated rows and null ids stay. A text is taken whole, however long. A text
    with the mark sign itself is not exact, since that decodes to a space.
    """
    keep = keep or ["doc_id"]
    head = save(frequent_words(docs, model, share).filter(F.length("word") <= TABLE_CHARS), "frequent")
    words, own = [], []
    for r in encode_words(head, model).collect():  # at most 1 / share short words
        ids, a = [], 0
        for end, i in zip(r["ends"], r["ids"], strict=True):
            ids += [i] if i >= 0 else model.fallback(r["word"][a:end])
            a = end
        words.append(r["word"].replace(MARK, " ").encode())
        own.append(ids)
    table = (pa.array(words, pa.large_binary()), np.array([i for ids in own for i in ids], np.int32), np.array([len(ids) for ids in own], np.int64))
    held = docs.sparkSession.sparkContext.broadcast((folder_of(model), table))

    def run(batches):
        folder, (known, known_ids, known_sizes) = held.value
        model = folder.model
        for rows, _, _ in slices(batches, limit=SLICE):
            text = rows.column(rows.schema.get_field_index("text"))
            data, offsets = prepared(text, model)
            starts = folder.words(data, offsets)
            distinct, codes = word_codes(data, starts)
            upto = np.searchsorted(starts, offsets)  # words before each row
            at = pc.index_in(distinct, value_set=known).to_numpy(zero_copy_only=False) if len(known) else np.full(len(distinct), np.nan)
            rare = np.flatnonzero(np.isnan(at))
            rest_ids, rest_sizes = folder.encode(*bytes_of(distinct.take(pa.array(rare))))
            place = np.nan_to_num(at).astype(np.int64)
            place[rare] = len(known) + np.arange(len(rare))
            flat, sizes = np.concatenate([known_ids, rest_ids]), np.concatenate([known_sizes, rest_sizes])
            first = (np.cumsum(sizes) - sizes)[place]
            sizes = sizes[place]
            own = gather(flat, first, sizes)  # ids of the distinct words
            first = np.cumsum(sizes) - sizes
            lost = ~folder.restores(own, sizes, *bytes_of(distinct))
            strange = np.add.reduceat(np.append(folder.odd[own], 0).astype(np.int64), first) if len(sizes) else sizes
            del data, distinct
            n = sizes[codes]
            ends = np.append(0, np.cumsum(n))
            ids = gather(own, first[codes], n)
            total = lambda x: np.diff(np.append(0, np.cumsum(x[codes]))[upto])  # noqa: B023, E731
            absent = np.asarray(text.is_null())
            marked = np.asarray(pc.fill_null(pc.match_substring(text, MARK), False))
            exact = pa.array((total(lost.astype(np.int64)) == 0) & ~marked, mask=absent)
            lists = list_array(pa.array(ids), np.diff(ends[upto]))
            if absent.any():
                lists = pa.ListArray.from_arrays(pa.array(ends[upto].astype(np.int32)), pa.array(ids), mask=pa.array(absent))
            columns = [rows.column(rows.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(total(strange)), exact], names=[*keep, "ids", "n_fallback", "exact"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>, n_fallback bigint, exact boolean"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: PieceModel, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (doc_id alone by default) and the text of `ids`.

    Null ids give null, no ids an empty text; control pieces are dropped, runs of
    bytes that are no characters replaced. Row by row; an empty table stays empty.
    """
    keep = keep or ["doc_id"]
    held = encoded.sparkSession.sparkContext.broadcast(folder_of(model))

    def text_of(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if held.value.model.dummy_prefix and text[:1] == " " else text

    def run(batches):
        folder = held.value
        for rows in batches:
            ids = rows.column(rows.schema.get_field_index("ids"))
            flat = ids.flatten()
            many = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(folder.raw_sizes[flat.to_numpy()]))[np.append(0, np.cumsum(many))]
            whole = bytes_of(folder.raw.take(flat))[0].tobytes()
            texts = [None if gone else text_of(whole[a:b]) for gone, a, b in zip(ids.is_null().to_pylist(), ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep) + ", text string"
    return encoded.select(*keep, "ids").mapInArrow(run, schema)


ship(__name__)
