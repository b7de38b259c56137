"""Queries of the corpus operators and the SQL that gives the same rows."""

from __future__ import annotations

import corpus_pipeline

from .bpe_tree import op7_byte_bpe
from .language_id import op4_language_id
from .mixing import op2_mixing
from .near_dups import OP3_SQL, op3_minhash
from .pii import op9_pii
from .quality_rules import OP8_SQL, op8_quality_rules
from .repeats import op10_repeats
from .token_counts import op5_token_counts
from .token_store import op1_token_store
from .topk_search import OP6_SQL, op6_topk_search


def pipeline(spark, sf_dir: str):
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_token_store, op2_mixing, op3_minhash, op4_language_id, op5_token_counts, op6_topk_search, op7_byte_bpe, op8_quality_rules, op9_pii, op10_repeats)}


def oracle_sql():
    return {"op3_minhash": OP3_SQL, "op6_topk_search": OP6_SQL, "op8_quality_rules": OP8_SQL}
