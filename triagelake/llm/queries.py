"""One query per operator over its whole table, and SQL twins where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import (
    ann, bpe, chat, exact_dedup, hard_negatives, lexical, mixing, ngram_join, pitman_yor, sharding,
    token_records, topk, toxicity,
)
from triagelake.session import configure, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join", """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (g)
    WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
    WHERE 100 * common >= 90 * (a.n + b.n - common)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
  least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents
  LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""")
def ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


@query("op1_ngram_jaccard_links")
def ngram_jaccard_links(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ngram_join.jaccard_link_counts(docs, k=3, num=9, den=10)


@query("op2_approximate_nearest_neighbours")
def approximate_nearest_neighbours(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vecs, vecs.where(F.col("vec_id") % 50 == 0), k=5)


PROBE = "</s>[INST] ok [/INST]"
CONTROLS = "|".join(re.escape(c) for c in sorted(
    ["\\", *chat.Template().controls], key=len, reverse=True))


def _escaped(column: str) -> str:
    return f"length(regexp_replace({column}, '{CONTROLS}', 'xx', 'g'))"


@query("op3_chat_formatting", f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role,
    coalesce(text, '') AS text FROM conversations UNION ALL
    SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')))
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
    CAST(sum({sum(len(x) for x in (chat.Template().start, chat.Template().content,
                                   chat.Template().end))}
    + {_escaped('role')} + {_escaped('text')}) AS BIGINT) AS formatted_chars
  FROM t GROUP BY 1""")
def chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


@query("op4_exact_top_k", """WITH v AS (SELECT vec_id AS id,
    list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS vec FROM embeddings
    WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pairs AS (SELECT a.id AS query_id, b.id AS vec_id,
    CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
    FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
    AS INTEGER) AS rank, vec_id, score FROM pairs QUALIFY rank <= 20""")
def exact_top_k(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vecs, vecs.where(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def bpe_digests(docs: DataFrame) -> DataFrame:
    found = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_byte_bpe")
def byte_bpe(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"))


def id_remainder(divisor: int):
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text) % divisor


@query("op6_lm_scoring")
def lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pitman_yor.score_texts(docs, id_remainder(7) == 2)


@query("op7_token_records")
def token_record_files(spark, sf_dir):
    path = new_path(spark, "records")
    words = public_tokenizers.path("word_bpe_49k.json")
    token_records.write_records(table(spark, sf_dir, "documents"), path, words, end_id=2)
    index = spark.read.parquet(f"{path}/index")
    found = token_records.with_start(token_records.read_records(spark, path), index)
    return found.select(
        F.col("_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op8_sharding")
def balanced_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


@query("op9_mixing")
def mixing_sources(spark, sf_dir):
    return mixing.mixed_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(id_remainder(5) != 0).select("doc_id", "toxic")


@query("op10_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, training_labels(spark, sf_dir))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", (id_remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@query("op11_ranked_lexical_search", f"""WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text
    FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
  terms AS (SELECT kind, id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS t FROM texts),
  tf AS (SELECT kind, id, t, count(*) AS tf FROM terms GROUP BY ALL),
  doc AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tf WHERE kind = 'd' GROUP BY 1),
  size AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM doc),
  df AS (SELECT t, count(*) AS df FROM tf WHERE kind = 'd' GROUP BY 1),
  scored AS (SELECT q.id AS item_id, d.id AS doc_id, CAST(sum(q.tf
      * CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1))) AS BIGINT)
      * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
    FROM tf q JOIN tf d USING (t) JOIN df USING (t) JOIN doc ON doc.id = d.id CROSS JOIN size
    WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY 1, 2)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER
    (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
  WHERE rank <= 10""")
def ranked_lexical_search(spark, sf_dir):
    return lexical.ranked_search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op12_exact_dedup", """WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
    FROM documents)
  SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = keep_id AS kept, text_sha256 FROM (SELECT *, first_value(doc_id) OVER
    (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM rows)""")
def exact_dedup_groups(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op13_hard_negative_mining", """WITH v AS (SELECT vec_id AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pairs AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
    CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
    FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
  near AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
    ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score,
    score AS negative_score FROM near JOIN pairs USING (anchor_id) WHERE NOT same
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5""")
def hard_negative_mining(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        vecs, vecs.where(F.col("vec_id") % 100 == 0), positives=5, negatives=5, ratio=(80, 100),
        scale=256.0, label=label)
