"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logharbor.llm import chat_format, quality_rules, url_filter
from logharbor.llm.circulant import op11_circulant_minhash
from logharbor.llm.mixing import op6_mixing
from logharbor.llm.nearest import op9_nearest
from logharbor.llm.ngram_join import op2_ngram_join
from logharbor.llm.packing import op1_packing
from logharbor.llm.pii import op4_pii
from logharbor.llm.prefix_trie import op13_prefix_trie
from logharbor.llm.quality_model import op7_quality_model
from logharbor.llm.suffix_dedup import op3_suffix_dedup
from logharbor.llm.whitening import op12_whitening


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_ngram_join": op2_ngram_join,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_pii": op4_pii,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_mixing": op6_mixing,
        "op7_quality_model": op7_quality_model,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_nearest": op9_nearest,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_circulant_minhash": op11_circulant_minhash,
        "op12_whitening": op12_whitening,
        "op13_prefix_trie": op13_prefix_trie,
    }


def llm_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.sql(),
        "op8_chat_format": chat_format.sql(),
        "op10_quality_rules": quality_rules.sql(),
    }
