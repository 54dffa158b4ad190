"""A corpus pipeline of five operators: toxic documents go, repeated lines go, one document of each
group of near-duplicates stays, contaminated documents go, and the rest is encoded and decoded.

Each stage reads all that the one before it kept, which is written as Parquet between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import bpe_round_trip
from lodestone.llm.common import Scratch, table
from lodestone.llm.decontaminate import is_contaminated, with_contamination
from lodestone.llm.jaccard_join import jaccard_join
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.quality import held_out, label_table
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.toxicity import ToxicityModel
from lodestone.llm.windows import NULL_ID


def rows_of(docs: DataFrame) -> DataFrame:
    """Each row whole beside its id and text, so that no name of a stage's own meets one of the table."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half stay."""
    labelled = label_table(table(spark, sf_dir, "labels"), "toxic").where(~held_out(F.col("doc_id")))
    rows = rows_of(docs)
    model = ToxicityModel().fit(rows.select("doc_id", "text"), labelled)
    return model.score(rows, name="score").where(F.col("score") < 0.5).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document has; no document goes."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = line_dedup(docs, carry=others)
    made = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[made.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The leading document of each class stays, once if its row is repeated; documents without
    words all stay."""
    found = jaccard_join(docs).where("leads")
    stays = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "th").distinct()
    keys = {"id": F.coalesce("doc_id", F.lit(NULL_ID)), "th": F.xxhash64("doc_id", "text"), "words": F.col("text").rlike("[^\\x20\\x09-\\x0D]")}
    kept = rows_of(docs).withColumns(keys).join(stays, ["id", "th"], "left_semi")
    once = kept.where("words").dropDuplicates(["id", "th"])
    return once.unionByName(kept.where("not words")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated stay whole."""
    marked = with_contamination(rows_of(docs), table(spark, sf_dir, "benchmark"), "found")
    return marked.where(~is_contaminated(F.col("found"))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: No SQL expresses the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
