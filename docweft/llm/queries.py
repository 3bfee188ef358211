"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, licences, line_dedup, neighbours, pieces, secrets, shards, suffix_dedup


#: A public SentencePiece model; set another with the argument of the same name.
MODEL_PATH = "file:///opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.PieceModel.load(spark, model_path))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.detect(docs, model, ["doc_id", "held_out"]).drop("n_grams")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    names = F.transform(F.arrays_zip("kinds", "starts", "ends", "weak"), lambda x: F.struct(F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")).alias("span"), x["weak"].alias("weak")))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter(names, lambda x: ~x["weak"]), lambda x: x["span"]), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(names, lambda x: x["span"]), ",").alias("spans"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_licence_scan": op6_licence_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_secret_scan": op9_secret_scan,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

SQL = {
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s FROM b, range(1, 100000) t(i) WHERE len(w) > 0 AND i <= len(w) - least(len(w), 10) + 1),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, u.i AS i, array_to_string(list_slice(w, u.i, u.i + n - 1), ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
h AS (SELECT doc_id, count(DISTINCT p.p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m) x, unnest(range(x.i, x.i + x.n)) AS p(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, pos - 1 AS pos, x[pos] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), unnest(range(1, len(x) + 1)) AS u(pos)),
f AS (SELECT line, length(line) AS n, min({'d': doc_id, 'p': pos}) AS o FROM l WHERE trim(line) <> '' GROUP BY line),
k AS (SELECT line, n, o, unnest(list_distinct([concat('l', n // 2, ':', left(line, n // 2)), concat('l', (n + 1) // 2, ':', left(line, (n + 1) // 2)), concat('r', n // 2, ':', right(line, n // 2)), concat('r', (n - 1) // 2, ':', right(line, (n - 1) // 2))])) AS h FROM f WHERE n >= 20),
c AS (SELECT DISTINCT a.line AS x, b.line AS y, a.n AS nx, b.n AS ny FROM k a JOIN k b ON a.h = b.h AND b.o < a.o AND abs(a.n - b.n) <= 1),
g AS (SELECT DISTINCT x AS line FROM c WHERE len(list_filter(range(1, greatest(nx, ny) + 1), lambda i: left(x, i - 1) = left(y, i - 1) AND substr(x, i + CASE WHEN nx >= ny THEN 1 ELSE 0 END) = substr(y, i + CASE WHEN ny >= nx THEN 1 ELSE 0 END))) > 0),
r AS (SELECT doc_id, list_sort(list(pos)) AS removed FROM l JOIN f USING (line) LEFT JOIN (SELECT line, true AS near FROM g) USING (line) WHERE near OR o <> {'d': doc_id, 'p': pos} GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(len(removed), 0) AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed FROM documents d LEFT JOIN r USING (doc_id)
""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x)
SELECT doc_id, class_id, (SELECT count(*) FROM l WHERE l.x = k.doc_id) AS n_links FROM k
""",
}
