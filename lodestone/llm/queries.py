"""The queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), window=20, batches=4, max_runs=2)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate, ids_digest

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids_digest("item_ids").alias("items_sha256"), "contaminated")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page of its text and a figure; the figure's payload is the text's bytes."""
    from . import media as M
    from .common import Scratch

    text = F.coalesce("text", F.lit(""))
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "media")
    images = scratch.write(M.stored(docs.select(text.cast("binary").alias("payload"))), "images")
    pages = docs.select("doc_id", M.page_of(text).alias("html"), F.octet_length(text).cast("long").alias("n_bytes"))
    refs = M.items_of(M.interleaved(pages, "doc_id", carry=("n_bytes",)), "n_bytes").where("kind = 'media'").drop("text")
    items = M.resolved(scratch.write(refs, "references"), M.measured(images))
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return items.select(F.col("page").alias("doc_id"), "n_bytes", *columns, "pos", "n_items", "caption")


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interleaved sequence of each web page: how many items it has, and what its text is."""
    from . import media as M

    items = F.col("items")
    texts = F.transform(F.filter(items, lambda x: x["kind"] == "text"), lambda x: x["text"])
    return M.interleaved(table(spark, sf_dir, "pages")).select(
        F.col("page").alias("page_id"),
        F.size(items).alias("n_items"),
        F.size(texts).alias("n_texts"),
        F.sha2(F.array_join(texts, "\n"), 256).alias("text_sha256"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).drop("th", "leads")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"), scale=4096, rounds=6)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 the label is moved on by one."""
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), every=50, scale=256)


def op13_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import SuffixTree, suffix_tree_scores

    return suffix_tree_scores(table(spark, sf_dir, "documents"), tree=SuffixTree(depth=3))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_media_columns": op7_media_columns,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_tree": op13_suffix_tree,
    "page_sequences": page_sequences,
}

OP5_SQL = r"""
WITH line AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
),
first_doc AS (
  SELECT key, min(doc_id) AS first_doc FROM line WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (f.first_doc IS NOT NULL AND l.doc_id > f.first_doc) AS gone
  FROM line l LEFT JOIN first_doc f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""



def op11_sql(rounds: int = 6) -> str:
    """Rounds one after the other; integers throughout, floors by remainder."""
    steps = ["""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
comp AS MATERIALIZED (
  SELECT r, vec_id, i // (n // 8) AS p, i % (n // 8) AS i, CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, vec_id, len(embedding) AS n, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM kept)
),
book0 AS MATERIALIZED (
  SELECT p, j, i, x AS e FROM comp
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id)
)"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(d * 16 + j) % 16 AS j, min(d) AS d FROM (
    SELECT r, c.p, j, CAST(sum((x - e) * (x - e)) AS BIGINT) AS d
    FROM comp c JOIN book{k} b ON c.p = b.p AND c.i = b.i GROUP BY r, c.p, j) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT p, j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM comp JOIN near{k} USING (r, p) GROUP BY p, j, i
),
book{k + 1} AS MATERIALIZED (
  SELECT p, j, i, CASE WHEN n IS NULL THEN e ELSE (s - ((s % n) + n) % n) // n END AS e
  FROM book{k} LEFT JOIN mean{k} USING (p, j, i)
)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (
  SELECT r, string_agg(lpad(to_hex(j), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(e AS VARCHAR), ',' ORDER BY p, j, i)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
pair AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

ORACLE_SQL = {"op5_line_dedup": OP5_SQL, "op11_vector_codes": op11_sql(), "op12_hard_negatives": OP12_SQL}
