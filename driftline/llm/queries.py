"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.bpe import op8_bpe
from driftline.llm.crf import op1_quality
from driftline.llm.decontam import op3_decontamination
from driftline.llm.exact import OP13_SQL, op13_exact_dedup
from driftline.llm.gru import op4_language
from driftline.llm.lines import OP9_SQL, op9_line_dedup
from driftline.llm.neardup import op6_near_duplicates
from driftline.llm.pii import op10_pii
from driftline.llm.resampling import OP11_SQL, op11_resampling
from driftline.llm.rules import op5_quality_rules
from driftline.llm.search import OP12_SQL, op12_lexical_search
from driftline.llm.substrings import OP7_SQL, op7_substring_dedup
from driftline.llm.toxicity import op2_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality, op2_toxicity, op3_decontamination, op4_language, op5_quality_rules, op6_near_duplicates, op7_substring_dedup, op8_bpe, op9_line_dedup, op10_pii, op11_resampling, op12_lexical_search, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_resampling": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_exact_dedup": OP13_SQL}
