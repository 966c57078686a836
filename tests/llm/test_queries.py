import pytest

from assaykit.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op2_hnsw": {"query_id", "rank", "vec_id", "score"},
    "op3_simhash": {"doc_id", "fingerprint", "component_id"},
    "op4_katz": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op6_quality": {"doc_id", "held_out", "score", "predicted"},
    "op7_trie_counts": {"doc_id", "n_tokens"},
    "op8_nbest": {"doc_id", "rank", "score"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op10_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op11_cross_parse": {"doc_id", "held_out", "lang_pred", "score"},
    "op12_drake": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op13_ranked_search": {"item_id", "rank", "doc_id", "score"},
}


def test_names():
    assert set(QUERIES) == set(COLUMNS) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, DIR)
    assert COLUMNS[name] <= set(df.columns)
    assert df.count() > 0
