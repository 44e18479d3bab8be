"""The ``opN_<name>`` queries: the operators over their whole tables, with production parameters."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, html_text, mixing, near_dup, packing, pii, quality, spelling, suffix_dedup, token_counts, topk, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The classifier, learned from labelled rows that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out()).select("doc_id", F.col("quality").alias("label"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The sample is drawn from the labels alone, so that only its texts are joined.
    drawn = labels.where("label is not null").orderBy(F.xxhash64("doc_id", "label"), "doc_id", "label").limit(4096)
    return quality.fit(texts.join(F.broadcast(drawn), "doc_id"), sample=4096)


def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chunks of raw transcripts, each conversation in one of several marker styles.

    One style marks that a turn begins but not whose it is, so roles must be inferred there.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    style = F.crc32(F.concat(F.lit("style"), F.col("conv_id").cast("string")).cast("binary")) % 6
    name = F.initcap("role")
    said = (
        F.when(style == 0, F.concat(name, F.lit(": "), "text"))
        .when(style == 1, F.concat(F.lit("### "), name, F.lit("\n"), "text", F.lit("\n")))
        .when(style == 2, F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>")))
        .when(style == 3, F.concat(F.lit("["), F.upper("role"), F.lit("] "), "text"))
        .when(style == 4, F.concat(F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise("System"), F.lit(": "), "text", F.lit("\n")))
        .otherwise(F.concat(F.when(F.col("role") == "system", F.lit("System: ")).otherwise(F.lit("-- ")), "text"))
    )
    return rows.select("conv_id", "turn", F.col("turn").alias("seq"), "role", said.alias("text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and turns recovered from the transcripts' text.

    Learned from at most 2,000 conversations of at most 1,000 turns each that aren't held out.
    """
    rows = transcripts(spark, sf_dir)
    lengths = rows.where(~quality.held_out("conv_id")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    drawn = lengths.where("turns <= 1000").select("conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(2000)
    labelled = rows.join(F.broadcast(drawn), "conv_id")
    return chat.parse(rows.select("conv_id", "seq", "text"), chat.train(labelled))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("locator")


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.tally.pii.key``; without it a new one for each run, so that none is written down."""
    key = spark.conf.get("spark.tally.pii.key", None)
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), key.encode() if key else secrets.token_bytes(32))
    return found.select("doc_id", "text", "n_found", F.to_json("found").alias("found"))


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_quality_votes, op3_token_counts, op4_chat_format, op5_exact_dedup,
        op6_pii_feistel, op7_pack_sequences, op8_topk_search, op9_html_main_text, op10_near_dup,
        op11_spelling_variants, op12_embedding_whitening, op13_suffix_dedup,
    )
}

ORACLES = {
    # Sources by code point; caps settled by trying each source as the first that isn't capped; every
    # quotient ranked; digests stand for the seeded orders.
    "op1_mix_sources": """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM src
), leveled AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM src)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), chosen AS (
  SELECT level FROM leveled WHERE level * weight <= cap ORDER BY cap / weight, place LIMIT 1
), goals AS (
  SELECT w.*, CASE WHEN c.level IS NULL THEN w.cap ELSE least(w.cap, c.level * w.weight) END AS target
  FROM weighed w LEFT JOIN chosen c ON true
), quotients AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS r
  FROM (SELECT place, target, unnest(range(0, (target / 16)::BIGINT + 5)) AS k FROM goals WHERE target > 0)
), blocks AS (
  SELECT place, count(*) AS blocks FROM quotients WHERE r <= (SELECT round(sum(target) / 16) FROM goals) GROUP BY place
), placed AS (
  SELECT s.doc_id, s.size, g.place, g.source_size, g.target, coalesce(b.blocks, 0) AS blocks,
         ('0x' || substr(md5('17shard|' || s.doc_id || '|' || s.size), 1, 8))::BIGINT % ceil(g.n / 128.0)::BIGINT AS shard
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN blocks b USING (place)
), shards AS (
  SELECT place, shard, sum(size)::BIGINT AS shard_size, any_value(blocks) AS blocks FROM placed GROUP BY place, shard
), shard_quotients AS (
  SELECT place, shard, blocks, row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS r
  FROM (SELECT *, unnest(range(0, blocks)) AS k FROM shards WHERE shard_size > 0)
), quotas AS (
  SELECT place, shard, count(*) AS quota FROM shard_quotients WHERE r <= blocks GROUP BY place, shard
), seated AS (
  SELECT p.*, s.shard_size, CASE WHEN target >= 2.0::DOUBLE * source_size THEN 2 * s.shard_size ELSE least(coalesce(q.quota, 0) * 16, 2 * s.shard_size) END AS wanted,
         sum(size) OVER (PARTITION BY p.place, p.shard ORDER BY ('0x' || substr(md5('17order|' || doc_id), 1, 8))::BIGINT, doc_id, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop,
         ('0x' || substr(md5('17start|' || p.place || '|' || p.shard), 1, 8))::BIGINT % greatest(ceil(s.shard_size / 16.0)::BIGINT, 1) * 16 AS low
  FROM placed p JOIN shards s USING (place, shard) LEFT JOIN quotas q USING (place, shard)
), runs AS (
  SELECT *, wanted // greatest(shard_size, 1) AS rounds, low + wanted % greatest(shard_size, 1) AS high FROM seated
)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(stop, least(high, shard_size)) - greatest(stop - size, low))
        + greatest(0, least(stop, high - shard_size) - greatest(stop - size, 0)))::BIGINT AS taken
FROM runs
""",
    # The turns that the transcripts were made from: what the parser has to recover.
    "op4_chat_format": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role,
       regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text,
       '<|' || role || '|>' || chr(10) || regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') || chr(10) || '<|end|>' AS rendered
FROM conversations
""",
    "op5_exact_dedup": """
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
""",
    "op8_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
) WHERE rank <= 5
""",
    # Sets of whole shingles (strings), all pairs that share one, and the closure of their links.
    "op10_near_dup": """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM words WHERE len(w) > 0
), sized AS MATERIALIZED (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, y AS root FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.root = b.x
), least_of AS (SELECT doc_id, min(root) AS m FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.m, w.doc_id)) AS component_id,
       least(w.doc_id, coalesce(l.m, w.doc_id)) = w.doc_id AS kept
FROM words w LEFT JOIN sets s ON w.doc_id = s.doc_id LEFT JOIN least_of l ON w.doc_id = l.doc_id
""",
}
