"""The driver's queries over these operators, with SQL where SQL can express them."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, minhash, mixing, personal, phrases, pieces, quality, resharding, runs, token_files, toxicity
from .common import stored, text_batches

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents") if docs is None else docs
    out = pieces.encode(docs, tokenizer_path())
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in shards by source and language; they leave in 24 of equal row counts."""
    docs = _table(spark, sf_dir, "documents")
    arrived = F.pmod(F.crc32(F.concat_ws("/", "source", "lang")), F.lit(SHARDS))
    return resharding.reshard(docs, SHARDS, arrived).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(_table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = personal.fit(personal.labelled_table(spark))
    out = personal.find(docs, model)
    line = "x -> concat_ws(':', x.kind, x.start, x.end)"
    return out.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as long)").alias(f"n_{k}") for k in personal.KINDS],
        F.sha2(F.expr(f"concat_ws(',', transform(filter(spans, x -> x.base), {line}))"), 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', transform(spans, {line}))").alias("spans"),
        F.expr("cast(size(filter(spans, x -> not x.base)) as long)").alias("n_added"), (F.size("spans") > 0).alias("personal"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as token files, and their counts from the separators alone."""
    files = stored(token_files.pack(_table(spark, sf_dir, "documents"), tokenizer_path()))
    counts = token_files.count_tokens(files.where("block_no is not null").select("file_id", "block_no", "ids"))
    names = files.where("doc_no is not null").select("file_id", "doc_no", F.col("id").alias("doc_id"))
    return counts.join(names, ["file_id", "doc_no"]).select("doc_id", "n_tokens", "file_id", "doc_no")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    out = quality.score(docs, quality.fit(docs, labels))
    return out.select(
        "doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), packed=True)
    return out.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.top(phrases.mine(_table(spark, sf_dir, "documents")), 2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def planted_run(doc_id, words):
    """Words of a document with every tenth id (by hash) repeated from some place on, by the query's contract; a null id plants none."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.append(words[:a], words[a + np.arange(n - a) % p])


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(_table(spark, sf_dir, "documents"), rewrite=planted_run)
    # sorted by start, then period: the first of equal exponents stays
    more = "x.length * best.period > best.length * x.period"
    best = F.expr(f"aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (best, x) -> if(best is null or {more}, x, best))")
    lines = F.expr("concat_ws('', transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')))")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ 	]+'), lambda x: x <> '') AS w
           FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-]')) AS p FROM d)),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
longer AS (SELECT a.lang, a.phrase FROM f a JOIN
             (SELECT lang, f, k, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM
                (SELECT lang, f, k, w, j, unnest(range(1, k - j + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)) b
           ON a.lang = b.lang AND a.phrase = b.phrase WHERE 100 * b.f >= 100 * a.f GROUP BY ALL),
cuts AS (SELECT f.lang, f.phrase, f.f AS a, x.f AS l, y.f AS r, n, c, 1000 * f.f * n // (x.f * y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1) f JOIN total USING (lang)
         JOIN f x ON x.lang = f.lang AND x.k = c AND x.phrase = array_to_string(f.w[1:c], ' ')
         JOIN f y ON y.lang = f.lang AND y.k = f.k - c AND y.phrase = array_to_string(f.w[c + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best ANTI JOIN longer USING (lang, phrase) QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_resharding": op3_resharding,
    "op4_toxicity": op4_toxicity,
    "op5_personal": op5_personal,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
    "op11_bpe": op11_bpe,
    "op12_phrases": op12_phrases,
    "op13_runs": op13_runs,
}
ORACLES = {"op1_embedding_dedup": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op12_phrases": OP12_SQL}
