"""The subpackage's operators bound to the given tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from surveyspark.llm import (ann_forest, chat_format, html_extract, jaccard_join, katz, language_id, mixing, pii, resampling,
                             sentencepiece_codec, topk_search, training_order, whitening)
from surveyspark.llm.common import table
from surveyspark.llm.registry import query

OP2_SQL = """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
z AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM v),
t AS (SELECT vec_id, unnest(generate_series(1, len(q))) AS t, unnest(q) AS w FROM z),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.w * b.w) AS BIGINT) AS score
  FROM t a JOIN t b ON a.t = b.t AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


@query("op2_topk_search", OP2_SQL)
def op2_topk_search(spark, sf_dir):
    """Each embedding with vec_id divisible by 50 against all others: the five highest integer scores."""
    return topk_search.topk_of_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("op3_ann_forest")
def op3_ann_forest(spark, sf_dir):
    """Each embedding with vec_id divisible by 20: its 20 nearest by inner product, found in the forest."""
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


#: the conversation that holds control strings of common templates (fixed value)
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"

OP10_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '\<|'))
          + length(replace(replace(text, '\', '\\'), '<|', '\<|')) + 24 AS chars FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op10_chat_format", OP10_SQL)
def op10_chat_format(spark, sf_dir):
    """All conversations and the probe, formatted and read back."""
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.read_back(chat_format.render(rows))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    """The language of every whole text, by code length in per-language context trees."""
    docs = table(spark, sf_dir, "documents")
    trees = language_id.learn(docs)
    rows = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.predict(rows, trees).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    """Ids of every whole text, decoded again, with parity of the rebuilt and the reference library."""
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_jaccard_join")
def op8_jaccard_join(spark, sf_dir):
    """Every document with its class and its number of links at similarity 0.8 on five-word n-grams."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_pii")
def op5_pii(spark, sf_dir):
    """Personal data and disclosing terms of every whole text."""
    return pii.report(table(spark, sf_dir, "documents"))


@query("op7_mixing")
def op7_mixing(spark, sf_dir):
    """Domain posteriors and the rate of every document."""
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "copies", "n_tokens", *mixing.DOMAINS, "rate")


@query("op6_katz_scores")
def op6_katz_scores(spark, sf_dir):
    """The log probability of every whole text under the backoff model, and the contract's base score."""
    return katz.score_corpus(table(spark, sf_dir, "documents"))


@query("op1_training_order")
def op1_training_order(spark, sf_dir):
    """Slot, shard, byte offset and digest of every sequence, read back from the written shards."""
    return training_order.materialise(table(spark, sf_dir, "documents").select("text"))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    """Every embedding whitened on the 32 leading eigenvectors of the covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("op12_html_extract")
def op12_html_extract(spark, sf_dir):
    """The main text of every page, by the style trees of its host and of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op13_resampling")
def op13_resampling(spark, sf_dir):
    """Every document weighted towards the benchmark texts, with the rank of those drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
