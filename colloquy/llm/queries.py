"""The numbered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


#: Rows and bytes of an Arrow batch: texts are long, and a Python worker holds a few batches at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's Arrow batches are made fit for long texts on the way."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import sharding

    found = sharding.assign(table(spark, sf_dir, "documents"), n_shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit(docs, labels.where(~held_out).select("doc_id", "toxic"))
    found = toxicity.scores(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "lang_threshold", "flagged")


def op3_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import token_io
    from colloquy.llm.scratch import new_path

    path = new_path(spark, "tokens")
    token_io.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=0)
    return token_io.digests(token_io.read_tokens(spark, path))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import secrets

    return secrets.report(table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import fingerprints

    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op8_consensus_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import whitening

    found = whitening.whiten(table(spark, sf_dir, "embeddings"), wanted=16)
    # Null where the exact number needs more than 64 bits.
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import repeats

    found = repeats.without_repeats(table(spark, sf_dir, "documents"), window=35, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, first=2000)


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity_cnn": op2_toxicity_cnn,
    "op3_quality_kneser_ney": op3_quality_kneser_ney,
    "op4_token_files": op4_token_files,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_secret_scan": op6_secret_scan,
    "op7_winnowing": op7_winnowing,
    "op8_consensus_extraction": op8_consensus_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_debruijn_repeats": op12_debruijn_repeats,
    "op13_setm_collocations": op13_setm_collocations,
}

ORACLE: dict[str, str] = {
    "op12_debruijn_repeats": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT r, i, array_to_string(words[i:i + 34], ' ') AS w FROM docs, unnest(range(1, greatest(len(words) - 33, 1))) AS u(i)),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, i + k AS p FROM windows SEMI JOIN repeated USING (w), range(0, 35) AS o(k)),
gone AS (SELECT r, list(p) AS ps FROM covered GROUP BY r),
cut AS (SELECT doc_id, words, CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(ps, i)) END AS kept
        FROM docs LEFT JOIN gone USING (r))
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut
""",
    "op13_setm_collocations": r"""
WITH pieces AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS ws FROM places, (VALUES (1), (2), (3)) AS s(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, ws, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.ws, c.k, c.f AS a, u.cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM often c, unnest(range(1, c.k)) AS u(cut)
  JOIN often l ON l.lang = c.lang AND l.k = u.cut AND l.phrase = array_to_string(c.ws[1:u.cut], ' ')
  JOIN often r ON r.lang = c.lang AND r.k = c.k - u.cut AND r.phrase = array_to_string(c.ws[u.cut + 1:c.k], ' ')
  WHERE c.k > 1),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, f FROM often WHERE k = 3) GROUP BY ALL),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least c LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
