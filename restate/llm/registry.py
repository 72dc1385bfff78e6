"""What __spark_entry__.py registers of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from restate.llm import queries as q
from restate.llm.common import ship

_QUERIES = {
    "op1_token_files": q.op1_token_files,
    "op2_toxicity": q.op2_toxicity,
    "op3_language_id": q.op3_language_id,
    "op4_url_filter": q.op4_url_filter,
    "op5_decontaminate": q.op5_decontaminate,
    "op6_quality": q.op6_quality,
    "op7_packing": q.op7_packing,
    "op8_nearest": q.op8_nearest,
    "op9_chat_format": q.op9_chat_format,
    "op10_ngram_jaccard": q.op10_ngram_jaccard,
    "op11_lexical": q.op11_lexical,
    "op12_secret_scan": q.op12_secret_scan,
    "op13_hard_negatives": q.op13_hard_negatives,
}

SQL = {
    "op4_url_filter": q.OP4_SQL,
    "op5_decontaminate": q.OP5_SQL,
    "op9_chat_format": q.OP9_SQL,
    "op10_ngram_jaccard": q.OP10_SQL,
    "op11_lexical": q.OP11_SQL,
    "op13_hard_negatives": q.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def _shipped(fn):
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {name: _shipped(fn) for name, fn in {**_QUERIES, "pipeline": corpus_pipeline.run}.items()}
