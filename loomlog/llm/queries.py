"""Registered queries of the pipeline operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.decontamination import contaminations
from loomlog.llm.exact_dups import exact_groups
from loomlog.llm.importance import resample
from loomlog.llm.language import identify
from loomlog.llm.masked_lm import score_documents
from loomlog.llm.mixing import mix, word_count
from loomlog.llm.middles import fill_in_middle, restore
from loomlog.llm.near_dups import near_groups
from loomlog.llm.part_codes import compress
from loomlog.llm.perspectives import perspective_dialogues
from loomlog.llm.prefix_counts import read_prefix_counts, write_prefix_counts
from loomlog.llm.sharding import shuffle_into_shards
from loomlog.llm.token_files import read_documents, write_token_files
from loomlog.sources.tables import cut_lineage, fresh_path, read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = perspective_dialogues(_table(spark, sf_dir, "conversations"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    trained = F.aggregate("spans", F.lit(0), lambda a, s: a + s["length"])
    return parts.select(
        "conv_id", "participant", "part", "turns", "text", listed.alias("spans"), trained.alias("trained_chars")
    )


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return shuffle_into_shards(rows).withColumn("grown_shard", F.lit(None).cast("int"))


def token_documents(docs: DataFrame) -> DataFrame:
    """Files of the 50k byte-level vocabulary, written and read back."""
    import public_tokenizers

    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs.select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path).withColumnRenamed("id", "doc_id")


def op3_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(_table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = resample(docs, _table(spark, sf_dir, "labels"), carried=["doc_id"])
    return rows.select(
        "doc_id", F.col("_n_grams").alias("n_grams"), F.col("_log_weight").alias("log_weight"),
        F.col("_key").alias("sample_key"), F.col("_kept").alias("kept"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op8_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), size=4)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the count at every prefix; the last one of each text answers for the whole."""
    import public_tokenizers

    path = fresh_path(spark, "prefixes")
    write_prefix_counts(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("piece_bpe_32k.model"))
    return read_prefix_counts(spark, path).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op12_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(_table(spark, sf_dir, "embeddings"), carried=["label"])
    coded = cut_lineage(coded)
    sums = cut_lineage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def op13_block_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(fill_in_middle(_table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_perspective_rotation": op1_perspective_rotation,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_packed_token_ids": op3_packed_token_ids,
    "op4_source_mix": op4_source_mix,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_language": op6_language,
    "op7_near_copies": op7_near_copies,
    "op8_masked_likelihood": op8_masked_likelihood,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op10_exact_copies": op10_exact_copies,
    "op11_prefix_counts": op11_prefix_counts,
    "op12_trie_codes": op12_trie_codes,
    "op13_block_rotations": op13_block_rotations,
}

_GAP = "CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_FLOOR_MEAN = "(sum(x * n) // sum(n)) - CASE WHEN sum(x * n) % sum(n) < 0 THEN 1 ELSE 0 END"


def _nearest(turn: int) -> str:
    return f"""
near{turn} AS MATERIALIZED (
  SELECT p.part, p.v, p.n, arg_min(b.entry, ({_GAP}, b.entry)) AS entry, min({_GAP}) AS error
  FROM distinct_parts p JOIN books{turn} b USING (part) GROUP BY p.part, p.v, p.n
)"""


def _moved(turn: int) -> str:
    return f"""
means{turn} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY place) AS v FROM (
    SELECT part, entry, place, CAST({_FLOOR_MEAN} AS BIGINT) AS m FROM (
      SELECT part, entry, n, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{turn - 1}
    ) GROUP BY part, entry, place
  ) GROUP BY part, entry
), books{turn} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{turn - 1} b LEFT JOIN means{turn} m USING (part, entry)
)"""


ORACLES = {
    "op1_perspective_rotation": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM said WHERE speaker <> 'system'
), pieces AS (
  SELECT p.conv_id, p.participant, s.turn, s.speaker, s.body, s.speaker = p.participant AS own,
         CASE WHEN s.speaker = p.participant THEN '<|assistant|>' || chr(10)
              WHEN s.speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user:' || s.speaker || '|>' || chr(10) END AS head
  FROM people p JOIN said s ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), numbered AS (
  SELECT *, head || body || chr(10) AS segment,
         row_number() OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, body) AS n
  FROM pieces
), placed AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, participant ORDER BY n) - length(segment) AS start
  FROM numbered
), parted AS (
  SELECT *, CAST(start // 16384 AS INTEGER) AS part FROM placed
), based AS (
  SELECT *, start - min(start) OVER (PARTITION BY conv_id, participant, part) + length(head) AS opens FROM parted
)
SELECT conv_id, participant, part, count(*) AS turns, string_agg(segment, '' ORDER BY n) AS text,
       coalesce(string_agg(CASE WHEN own AND body <> '' THEN CAST(opens AS VARCHAR) || ':' || length(body) END, ',' ORDER BY n), '') AS spans,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS INTEGER) AS trained_chars
FROM based GROUP BY conv_id, participant, part
""",
    "op4_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
), tried AS (  -- a common level per unit of weight, if exactly the sources with a smaller cap per weight are full
  SELECT a.source, (1.5 * (SELECT sum(source_size) FROM sources)
                    - sum(CASE WHEN 2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight THEN 2.0 * b.source_size ELSE 0 END))
                   / sum(CASE WHEN 2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight THEN 0 ELSE b.weight END) AS level,
         any_value(2.0 * a.source_size / a.weight) AS own
  FROM sources a CROSS JOIN sources b GROUP BY a.source
), targets AS (
  SELECT source, source_size,
         CAST(least(2.0 * source_size, weight * (SELECT arg_min(level, own) FILTER (level <= own) FROM tried)) AS DOUBLE) AS target
  FROM sources
), run AS (
  SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY md5(doc_id || ':4'), size) - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(target / source_size) * size
            + greatest(0, least(size, floor(target) - floor(target / source_size) * source_size - before)) AS BIGINT) AS taken
FROM run
""",
    "op10_exact_copies": r"""
WITH clean AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM clean
""",
    "op12_trie_codes": r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT vec_id, label, part, w[part * len(w) // 16 + 1 : (part + 1) * len(w) // 16] AS v
  FROM kept CROSS JOIN (SELECT unnest(range(16)) AS part)
), distinct_parts AS MATERIALIZED (
  SELECT part, v, CAST(count(*) AS BIGINT) AS n FROM cut GROUP BY part, v
), books0 AS MATERIALIZED (
  SELECT part, entry, v FROM (
    SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM cut
  ) WHERE entry < 64
),""" + ",".join([_nearest(0), _moved(1), _nearest(1), _moved(2), _nearest(2)]) + r""", digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2
), coded AS (
  SELECT c.vec_id, any_value(c.label) AS label, string_agg(printf('%02x', d.entry), '' ORDER BY c.part) AS code,
         CAST(sum(d.error) AS BIGINT) AS error
  FROM cut c JOIN near2 d ON c.part = d.part AND c.v = d.v GROUP BY c.vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded CROSS JOIN digest
""",
    "op13_block_rotations": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS two,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS three, CAST('0x' || h[25:32] AS BIGINT) % 100 AS four,
         body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') AS whole
  FROM cut
), formed AS (
  SELECT doc_id, body, n, CASE WHEN whole OR three >= 100 THEN 'plain' WHEN four < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(lines[1 : least(one, two)], '') AS prefix,
         array_to_string(lines[least(one, two) + 1 : greatest(one, two)], '') AS middle,
         array_to_string(lines[greatest(one, two) + 1 :], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM formed
""",
}
