"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.chat_format import op3_chat_turns
from pairloom.llm.decontaminate import OP7_SQL, op7_benchmark_leaks
from pairloom.llm.importance import OP13_SQL, op13_importance_sample
from pairloom.llm.language import op10_language
from pairloom.llm.licenses import OP6_SQL, op6_licenses
from pairloom.llm.merkle import OP11_SQL, op11_merkle_manifest
from pairloom.llm.minhash import op12_minhash_groups
from pairloom.llm.mixing import OP8_SQL, op8_source_mix
from pairloom.llm.simhash import op9_simhash_groups
from pairloom.llm.style_tree import op1_main_text
from pairloom.llm.syncmers import op2_syncmer_fingerprints
from pairloom.llm.url_templates import op4_url_verdicts
from pairloom.llm.word_pieces import op5_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_main_text, op2_syncmer_fingerprints, op3_chat_turns, op4_url_verdicts, op5_token_counts, op6_licenses,
        op7_benchmark_leaks, op8_source_mix, op9_simhash_groups, op10_language, op11_merkle_manifest,
        op12_minhash_groups, op13_importance_sample,
    )
}

ORACLES: dict[str, str] = {
    "op6_licenses": OP6_SQL, "op7_benchmark_leaks": OP7_SQL, "op8_source_mix": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL, "op13_importance_sample": OP13_SQL,
}
