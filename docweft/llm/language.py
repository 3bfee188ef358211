"""Language identification with bit-sliced Bloom filters over n-grams.

One table of cells holds a bit for each language. An n-gram is hashed to a few
cells; the bitwise AND of these cells is the set of all languages whose filter
contains the n-gram, for the price of one lookup. Bits are counted per language
over all n-grams of a text. A language's share of hits, less its filter's
false-positive rate (the product of its cells' fill), is its score; the largest
score decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, MIX, finish, save, ship, slices

GRAM = 4
CELL_BITS = 18
PROBES = 2
#: Bounds of the training sample (distinct texts per language) and of the model: n-grams kept per language, languages.
SAMPLE_ROWS = 4000
GRAMS_KEPT = 12000
MAX_LANGUAGES = 1024
#: Languages of one word of a mask; a cell has as many words as the languages need.
MASK_BITS = 32
UNDETERMINED = "und"

#: Letters to themselves (lowered), all other ASCII to a space.
FOLD = LOWER.copy()
FOLD[:65] = FOLD[91:97] = FOLD[123:128] = 32
FOLD[65:91] = np.arange(97, 123)


def gram_codes(data: np.ndarray, offsets: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Code of each n-gram (bytes, lowered, other signs as spaces) with no two spaces side by side, and its row.

    A space stands before and after each row, so that a short word has n-grams too.
    """
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    n = len(row) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b = np.full(len(row), 32, np.uint32)
    inner = np.ones(len(row), bool)
    inner[offsets[:-1] + 2 * np.arange(rows)] = inner[offsets[1:] + 2 * np.arange(rows) + 1] = False
    b[inner] = FOLD[data]
    code = b[:n].copy()
    for j in range(1, size):
        code = (code << np.uint32(8)) | b[j : j + n]
    space = b == 32
    double = space[:-1] & space[1:]
    bad = np.zeros(n, bool)
    for j in range(size - 1):
        bad |= double[j : j + n]
    good = np.flatnonzero(~bad & (row[:n] == row[size - 1 :]))
    return code[good], row[good]


def cells(codes: np.ndarray, probes: int, bits: int) -> list[np.ndarray]:
    h = finish(codes.astype(np.uint64) * MIX)
    return [((h >> np.uint64(k * 24)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(probes)]


@dataclass(frozen=True)
class LanguageFilters:
    """languages in bit order; table of masks (cells by words); false-positive rate of each filter."""

    languages: tuple[str, ...]
    table: np.ndarray
    false_positive: np.ndarray
    probes: int
    bits: int

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of hits for each row and language, and the number of n-grams of each row."""
        codes, row = gram_codes(data, offsets)
        rows = len(offsets) - 1
        total = np.bincount(row, minlength=rows)
        first, *rest = cells(codes, self.probes, self.bits)
        share = np.zeros((rows, len(self.languages)))
        for k, fp in enumerate(self.false_positive):
            word, bit = divmod(k, MASK_BITS)
            if not bit:
                mask = self.table[word][first]
                for c in rest:
                    mask = mask & self.table[word][c]
            hits = np.bincount(row, weights=(mask >> np.uint32(bit)) & np.uint32(1), minlength=rows)
            share[:, k] = np.clip((hits / np.maximum(total, 1) - fp) / max(1 - fp, 1e-9), 0, 1)
        return share, total


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, grams_kept: int = GRAMS_KEPT, bits: int = CELL_BITS, probes: int = PROBES) -> LanguageFilters:
    """Learn from labelled rows (text and lang not null).

    Fitted on about 1.2 * `sample_rows` distinct texts per language at most, drawn
    by xxhash64(text) and taken whole; copies of a text count once. The n-grams are
    counted in the cluster. A filter gets the `grams_kept` n-grams with the
    largest lift of a language's frequency over the mean of all, so the model's
    size does not depend on the input's. More than `MAX_LANGUAGES` labels raise.
    """
    known = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    cut = F.lit(None).cast("double")
    for lang, n in sizes.items():
        cut = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * sample_rows / max(n, 1)))).otherwise(cut)
    sample = known.filter((F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))) < cut)
    sample = sample.dropDuplicates(["lang", "h"]).drop("h")

    def count(batches):
        for rows, data, offsets in slices(batches):
            codes, row = gram_codes(data, offsets)
            langs = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                values, n = np.unique(codes[langs[row] == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counted = save(sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).filter("n > 1"), "grams")
    sums = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    freq = counted.join(F.broadcast(sums), "lang").select("lang", "code", (F.col("n") / F.col("total")).alias("f"))
    overall = freq.groupBy("code").agg((F.sum("f") / max(1, len(sizes))).alias("mean"))
    lift = freq.join(overall, "code").filter(F.col("f") > 0.5 * F.col("mean")).withColumn("lift", F.col("f") * F.log(1 + F.col("f") / F.col("mean")))
    languages = tuple(sizes)
    table = np.zeros((-(-len(languages) // MASK_BITS), 1 << bits), np.uint32)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("lift"), "code"))
    best = lift.withColumn("place", place).filter(F.col("place") <= grams_kept).select("lang", "code").toArrow()  # at most MAX_LANGUAGES * grams_kept
    for k, lang in enumerate(languages):
        for c in cells(best.filter(pc.equal(best["lang"], lang))["code"].to_numpy().astype(np.uint32), probes, bits):
            table[k // MASK_BITS][c] |= np.uint32(1 << k % MASK_BITS)
    fill = np.array([((table[k // MASK_BITS] >> np.uint32(k % MASK_BITS)) & np.uint32(1)).mean() for k in range(len(languages))])
    return LanguageFilters(languages, table, fill**probes, probes, bits)


def detect(docs: DataFrame, model: LanguageFilters, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (0 to 1) and n_grams to the columns `keep` (doc_id alone by default), row by row.

    Null texts and texts without a letter get `und` and score 0; ties go to the
    language that sorts first. A text without an n-gram, or that hits no filter,
    gets the first language with score 0.
    """
    keep = keep or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for rows, data, offsets in slices(batches, limit=1 << 20):
            share, grams = model.score(data, offsets)
            letter = np.concatenate([[0], np.cumsum(FOLD[data] != 32)])
            some = letter[offsets[1:]] > letter[offsets[:-1]]
            ascii_letter = np.concatenate([[0], np.cumsum((FOLD[data] >= 97) & (FOLD[data] <= 122))])
            unsure = np.flatnonzero(some & (ascii_letter[offsets[1:]] == ascii_letter[offsets[:-1]]))
            for i in unsure:  # only non-ASCII signs: letters or not?
                some[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            pick = share.argmax(axis=1) if len(model.languages) else np.zeros(rows.num_rows, np.int64)
            score = np.where(some, share[np.arange(len(pick)), pick] if len(model.languages) else 0.0, 0.0)
            pick = np.where(some, pick, len(model.languages))
            columns = [rows.column(rows.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[pick], pa.string()), pa.array(score), pa.array(grams)], names=[*keep, "lang_pred", "score", "n_grams"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, n_grams bigint"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


ship(__name__)
