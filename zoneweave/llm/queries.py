"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, line_dedup, lm, mixing, ngram_join, pii, sharding, tiff, toxicity, vector_join


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_ngram_jaccard_join": ngram_join.op2,
        "op3_pii": pii.op3,
        "op4_source_mixing": mixing.op4,
        "op5_lm_scoring": lm.op5,
        "op6_toxicity": toxicity.op6,
        "op7_media_tiff": tiff.op7,
        "op8_embedding_near_dedup": vector_join.op8,
        "op9_byte_bpe": bpe.op9,
        "op10_sharding": sharding.op10,
        "pipeline": _pipeline,
    }


def oracle_sql():
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op4_source_mixing": mixing.OP4_SQL, "op10_sharding": sharding.OP10_SQL}
