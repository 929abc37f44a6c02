"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens. Part of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneweave.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from zoneweave.llm.common import shared_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below its threshold; all others go.

    Null, empty and wordless texts score the intercept and stay. Very long texts are read whole. Repeated rows and ties score alike;
    null ids pass. Empty documents or labels: the lexicons alone decide. Extra columns are left out, so they cannot clash.
    """
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of a smaller id holds; n_chars follows the text.

    Null texts become empty. Rows with a null id keep all their lines; rows that repeat an id count as one document and each is
    cut by its own lines. Very long texts are split like others. Empty table: empty result. Extra columns are left out.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates.

    Texts without words (null, empty, blank) are copies of each other: the smallest id of these stays. Rows that repeat an id stay or go
    together; rows with a null id cannot be named and stay. Very long texts take part whole. Empty table: empty
    result. Extra columns are left out.
    """
    groups = ngram_join.jaccard_join(docs)
    return docs.select(*COLUMNS).join(groups.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at the production weights, each document at most once (one epoch).

    Null sources and languages are leaves of their own. Null and empty texts have no tokens and are taken with a prefix that has
    any. Equal rows go together; null ids take part as the text 'null'. Very long texts count whole. Empty table:
    empty result. Extra columns are left out.
    """
    out = mixing.mix(docs.select(*COLUMNS), mixing.production_levels(), mixing.WEIGHTS, share=mixing.SHARE, max_epochs=1, seed=mixing.SEED)
    return out.where("copies > 0").select(*COLUMNS)


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text.

    Row by row: null and empty texts have no tokens, repeats and null ids pass, very long texts are encoded whole, an empty table
    gives an empty result. Extra columns are left out.
    """
    ranks, pattern = bpe.production(spark)
    out = bpe.bpe_encode(docs.select(*COLUMNS), ranks, pattern, ["doc_id", "lang", "source", "text"])
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


#: (name, function of (spark, docs, sf_dir)); each result is written and read again as the next one's docs.
STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each writes Parquet to the shared folder and the next reads it back; a table that the
    next stage has read in full is deleted, so that the last one alone stays."""
    docs, at = table(spark, sf_dir, "documents"), shared_path(spark, "corpus-pipeline")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{at}/{name}"
    return docs
