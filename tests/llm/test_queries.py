"""Every query with SQL against it, on the smallest tables; the others give their columns."""

import pytest

from __spark_entry__ import oracle_sql, queries
from abspark.llm.queries import ORACLES, QUERIES
from catalog.check import difference

COLUMNS = {
    "op2_spotsigs": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score rules",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_token_counts": "n_tokens docs tokens docs_from tokens_from quantile truncated_tokens",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op13_nearest_neighbours": "query_id rank vec_id score",
}


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, folder, name):
    assert difference(spark, folder, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, folder, name):
    assert QUERIES[name](spark, folder).columns == COLUMNS[name].split()
