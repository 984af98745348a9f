"""The contract queries over the fixture tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op1_benchmark_decontamination
from .exact import OP13_SQL, op13_exact_dedup
from .extraction import op9_html_extraction
from .jaccard import op5_ngram_jaccard_join
from .licenses import op3_license_scan
from .lines import OP4_SQL, op4_line_dedup
from .mixing import OP7_SQL, op7_mixing_sources
from .negatives import OP12_SQL, op12_hard_negatives
from .oracles import OP1_SQL, OP2_SQL, OP5_SQL, OP10_SQL
from .quality import op2_quality_rules
from .search import OP11_SQL, op11_lexical_search
from .sharding import op10_sharding
from .urls import OP6_SQL, op6_url_filters
from .warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_benchmark_decontamination, op2_quality_rules, op3_license_scan, op4_line_dedup, op5_ngram_jaccard_join,
        op6_url_filters, op7_mixing_sources, op8_warc, op9_html_extraction, op10_sharding, op11_lexical_search, op12_hard_negatives, op13_exact_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": OP1_SQL, "op2_quality_rules": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL,
        "op6_url_filters": OP6_SQL, "op7_mixing_sources": OP7_SQL, "op8_warc": OP8_SQL, "op10_sharding": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_exact_dedup": OP13_SQL,
    }
