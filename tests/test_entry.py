"""Registered queries against their SQL twins on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "filtered_search_page", "search_types_exact", "search_superlative_ties", "search_moves_same_row", "search_moves_fixed_game",
    "moves_in_latest_group", "missing_groups_since_first", "fk_orphans_report", "golden_multiset_diff", "trace_percentiles",
    "trace_known_tokens", "bm25_scoped_topk", "vector_topk", "expand_window", "markup_cleaning", "type_matchup_texts", "question_rankings",
    "vector_index_topk", "required_mention", "list_fidelity", "byte_budget_lists", "trace_line_numbers", "streamed_attempt_numbers", "streamed_call_matches",
    "clean_nested_statistics", "clean_card_list",
]


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    extra = entry.llm_queries.QUERIES if entry.llm_queries else {}
    assert set(queries) - set(oracle) - set(extra) == {"section_chunks", "hybrid_retrieval"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, name):
    text, good = compare(spark, connect(FOLDER), name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert good, text
