"""The registered queries of the training-data operators, with their SQL where DuckDB can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_back
from .common import shared_dir, table, written
from .decontaminate import find_leaks
from .masked_lm import score, train
from .ngram_join import jaccard_components
from .packing import pack
from .pii import pseudonymised
from .quality import classify
from .substrings import remove_repeats
from .topk import build_index, top_k
from .token_files import read_tokens, write_tokens


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: For queries and tests; a real run gives its own.
KEY = "tessera-example-key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), KEY, count="n_replaced").select("doc_id", "text", "n_replaced")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=5, threshold=0.8)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), path, end_id=1)
    back = read_tokens(spark.read.parquet(path))
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    back = read_back(written(format_chats(rows.union(own), vocabulary_file("byte_bpe_50k.json"))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), size=1024, open_bins=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_masked_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs))


def op7_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(build_index(vectors), vectors.where("vec_id % 50 = 0"), k=5)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), span=50, k=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_ngram_jaccard_join, op3_token_files, op4_chat_formatting, op5_best_fit_packing, op6_masked_lm_scoring, op7_bit_sliced_topk, op8_substring_dedup, op9_benchmark_decontamination, op10_quality_classifier)}

#: Lower-cased words of every document, as op2 and op8 split them.
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n, g FROM g),
e AS (SELECT doc_id, n, unnest(g) AS s FROM n),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op8_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS s FROM p),
o AS (SELECT s, min(doc_id) AS owner FROM s GROUP BY s),
r AS (SELECT s.doc_id, s.i FROM s JOIN o USING (s) WHERE o.owner < s.doc_id),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS j FROM r),
l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
    CASE WHEN l.gone IS NULL THEN w.w ELSE list_filter(w.w, lambda x, j: NOT list_contains(l.gone, j)) END AS kept
  FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, n_words - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""",
    "op7_bit_sliced_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op4_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, 14 + len(role) + len(text) + 2 * len(role || text)
    - len(replace(role, '\', '')) - len(replace(text, '\', '')) + (len(role) - len(replace(role, ': ', ''))) // 2
    + (len(role) - len(replace(role, '</turn>', ''))) // 7 + (len(text) - len(replace(text, '</turn>', ''))) // 7
    + (len(role) - len(replace(role, '### ', ''))) // 4 + (len(text) - len(replace(text, '### ', ''))) // 4 - len(role || text) AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""",
}
