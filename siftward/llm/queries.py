"""The registered queries of this folder, and their oracle statements where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftward.llm.decontamination import ORACLE as DECONTAMINATION_ORACLE
from siftward.llm.decontamination import op6_decontamination
from siftward.llm.mixing import ORACLE as MIXING_ORACLE
from siftward.llm.mixing import op2_mixing
from siftward.llm.phrases import ORACLE as PHRASES_ORACLE
from siftward.llm.phrases import op13_phrases
from siftward.llm.preferences import ORACLE as PREFERENCES_ORACLE
from siftward.llm.preferences import op7_preferences
from siftward.llm.quality import op10_quality_rules
from siftward.llm.resampling import ORACLE as RESAMPLING_ORACLE
from siftward.llm.resampling import op12_resampling
from siftward.llm.simhash import op3_simhash
from siftward.llm.substring_dedup import ORACLE as SUBSTRING_ORACLE
from siftward.llm.substring_dedup import op5_substring_dedup
from siftward.llm.token_counts import op1_token_counts
from siftward.llm.token_store import op9_token_store
from siftward.llm.toxicity import op4_toxicity
from siftward.llm.vectors import ORACLE as VECTORS_ORACLE
from siftward.llm.vectors import op11_vectors
from siftward.llm.warc import ORACLE as WARC_ORACLE
from siftward.llm.warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_preferences": op7_preferences,
    "op8_warc": op8_warc,
    "op9_token_store": op9_token_store,
    "op10_quality_rules": op10_quality_rules,
    "op11_vectors": op11_vectors,
    "op12_resampling": op12_resampling,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op2_mixing": MIXING_ORACLE,
    "op5_substring_dedup": SUBSTRING_ORACLE,
    "op6_decontamination": DECONTAMINATION_ORACLE,
    "op7_preferences": PREFERENCES_ORACLE,
    "op8_warc": WARC_ORACLE,
    "op11_vectors": VECTORS_ORACLE,
    "op12_resampling": RESAMPLING_ORACLE,
    "op13_phrases": PHRASES_ORACLE,
}
