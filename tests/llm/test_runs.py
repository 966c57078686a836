"""Runs of spaces: op7 and op8 are best over the lattice of the whole text."""

import numpy as np
import pytest

from assaykit.llm.pieces import OWN, SPACE, Pieces, decoded, op7_trie_counts, op8_nbest, public_pieces, segmentations

from test_pieces import all_paths

TEXTS = ["a  b", "  a b", "a   ", " ", "    ", "a b  c", "x   ▁ y", "\n    if", " x ", "a" + " " * 6, "é  z"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("runs"))
    texts = [*TEXTS, "", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_against_all_paths_over_whole_texts(spark, docs):
    pieces = Pieces.read(public_pieces())
    counts = {r.doc_id: r for r in op7_trie_counts(spark, docs).collect()}
    best = {}
    for r in op8_nbest(spark, docs).collect():
        assert r.round_trip
        best.setdefault(r.doc_id, {})[r["rank"]] = (r.score, r.n_pieces)
    for k, text in enumerate(TEXTS):
        paths = all_paths(SPACE + text.replace(SPACE, OWN).replace(" ", SPACE), pieces)
        want = [s for s, _ in paths[:3]]
        got = [best[k][r][0] for r in sorted(best[k])]
        assert np.allclose(got, want) and len(got) == min(3, len(paths)), text
        assert abs(counts[k].score - want[0]) < 1e-9
        assert counts[k].n_tokens == min(len(ids) for s, ids in paths if abs(s - want[0]) < 1e-9)
    assert all((counts[k].n_tokens, counts[k].n_pretokens, counts[k].score) == (0, 0, 0.0) for k in (len(TEXTS), len(TEXTS) + 1))


def test_long_runs_decode_again(spark):
    text = "a" + " " * 50_000 + "b" + " " * 3
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = segmentations(df, public_pieces(), 3, runs=True)
    assert {r.text for r in decoded(found, public_pieces()).collect()} == {text}
    assert found.count() == 3
