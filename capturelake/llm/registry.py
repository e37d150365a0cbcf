"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capturelake.llm.audit import OP13_SQL, op13_filter_audit
from capturelake.llm.chat import OP6_SQL, op6_chat_tool_calls
from capturelake.llm.compress import OP12_SQL, op12_code_trie
from capturelake.llm.decontam import op7_decontaminate_simhash
from capturelake.llm.html import op8_html_crf
from capturelake.llm.knn import OP3_SQL, op3_topk_kdtree
from capturelake.llm.langid import op5_language_id
from capturelake.llm.license_scan import OP2_SQL, op2_license_scan
from capturelake.llm.linededup import OP9_SQL, op9_line_dedup
from capturelake.llm.neardup import op10_minhash_bag
from capturelake.llm.oracles import OP7_SQL, OP10_SQL
from capturelake.llm.packing import op1_pack_karmarkar_karp
from capturelake.llm.pii import op4_pii_skip_chain
from capturelake.llm.urls import op11_url_rules

QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [op1_pack_karmarkar_karp, op2_license_scan, op3_topk_kdtree, op4_pii_skip_chain, op5_language_id, op6_chat_tool_calls, op7_decontaminate_simhash, op8_html_crf, op9_line_dedup, op10_minhash_bag, op11_url_rules, op12_code_trie, op13_filter_audit]

SQL: dict[str, str] = {"op2_license_scan": OP2_SQL, "op7_decontaminate_simhash": OP7_SQL, "op10_minhash_bag": OP10_SQL, "op3_topk_kdtree": OP3_SQL, "op6_chat_tool_calls": OP6_SQL, "op9_line_dedup": OP9_SQL, "op12_code_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
