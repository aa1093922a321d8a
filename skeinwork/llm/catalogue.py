"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import rules
from skeinwork.llm.audio import op6_media
from skeinwork.llm.chat import op12_chat_format
from skeinwork.llm.mixing import op10_mixing
from skeinwork.llm.prefix_trie import op11_prefix_trie
from skeinwork.llm.quality import op7_quality
from skeinwork.llm.repair import op13_structure_repair
from skeinwork.llm.rules import op8_quality_rules
from skeinwork.llm.secrets import op2_secrets
from skeinwork.llm.simhash import op3_simhash
from skeinwork.llm.token_counts import op5_token_counts
from skeinwork.llm.token_files import op1_token_ids
from skeinwork.llm.toxicity import op4_toxicity
from skeinwork.llm.unigram import op9_sentencepiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_ids, op2_secrets, op3_simhash, op4_toxicity, op5_token_counts, op6_media, op7_quality, op8_quality_rules, op9_sentencepiece, op10_mixing, op11_prefix_trie, op12_chat_format, op13_structure_repair)
}

ORACLES: dict[str, str] = {"op8_quality_rules": rules.SQL}
