import math
import random
from collections import defaultdict

import numpy as np
import pytest

from assaykit.llm.pieces import OWN, SPACE, Pieces, best_choices, best_paths, decoded, lattices, n_best, op8_nbest, public_pieces, segmentations, token_counts, trie_counts


@pytest.fixture(scope="module")
def pieces():
    return Pieces.read(public_pieces())


def all_paths(token, pieces):
    done = defaultdict(list)
    done[0] = [(0.0, ())]
    for end in range(1, len(token) + 1):
        for b in range(end):
            x = token[b:end]
            if x in pieces.score:
                done[end] += [(s + pieces.score[x], (*ids, pieces.ids[x])) for s, ids in done[b]]
        if token[end - 1] not in pieces.score:
            spelt = tuple(pieces.bytes_[c] for c in token[end - 1].replace(OWN, SPACE).encode())
            done[end] += [(s + pieces.fall * len(spelt), ids + spelt) for s, ids in done[end - 1]]
    return sorted(done[len(token)], key=lambda x: (-x[0], x[1]))


TOKENS = sorted({SPACE + x for x in ["", "the", "then", "thanedble", "it's", "déjà", "漢字", "a\nb", "then.\n\nthe\n", "\n", "x" * 9, "qzq", "", OWN + "a", "the,"]})


def test_counts_and_n_best_against_all_paths(pieces):
    counts = trie_counts(TOKENS, pieces)
    for token, (n, score) in zip(TOKENS, counts, strict=True):
        paths = all_paths(token, pieces)
        assert abs(score - paths[0][0]) < 1e-9
        assert n == min(len(ids) for s, ids in paths if abs(s - paths[0][0]) < 1e-9)
        got = n_best(token, pieces, 5)
        assert np.allclose([s for s, _ in got], [s for s, _ in paths[:5]]) and len(got) == min(5, len(paths))
        assert len({ids for _, ids in got}) == len(got)
        (first, loss, ids), *_ = best_paths([token], pieces)
        assert math.isclose(first, got[0][0]) and tuple(np.frombuffer(ids, "<u4").tolist()) in {i for s, i in paths if math.isclose(s, first)}
        assert math.isclose(loss, got[0][0] - got[1][0], abs_tol=1e-9) if len(got) > 1 else loss == math.inf


def test_shared_prefixes_give_what_single_tokens_give(pieces):
    rng = random.Random(1)
    tokens = sorted({SPACE + "".join(rng.choices("thean é", k=rng.randrange(9))).replace(" ", "x") for _ in range(300)})
    assert trie_counts(tokens, pieces) == [trie_counts([t], pieces)[0] for t in tokens]
    assert list(best_paths(tokens, pieces)) == [next(best_paths([t], pieces)) for t in tokens]
    assert {t: n_best(t, pieces, 4, best, arcs) for t, best, arcs in lattices(tokens, pieces)} == {t: n_best(t, pieces, 4) for t in tokens}


def test_choices():
    rng = random.Random(2)
    for _ in range(50):
        lists = [sorted([0.0, *(rng.random() for _ in range(rng.randrange(4)))]) for _ in range(rng.randrange(4))]
        sums = [0.0]
        for own in lists:
            sums = [a + b for a in sums for b in own]
        assert np.allclose([s for s, _ in best_choices(lists, 5)], sorted(sums)[:5])


TEXTS = [None, "", " ", "a", "the  then\n the", "déjà ▁ vu\r\n", "漢字 ﷐ 👍", "the cat the cat sat", " x ", "\x00 z"]


def test_texts(spark, pieces):
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(TEXTS)] + [(3, "a", 6), (None, "b", 7)], "doc_id long, text string, rank int")
    counts = {r.doc_id: r for r in token_counts(docs, public_pieces()).collect()}
    found = segmentations(docs, public_pieces(), 4)
    rows = found.collect()
    for k, t in enumerate(TEXTS):
        tokens = [SPACE + x for x in t.replace(SPACE, OWN).split(" ")] if t else []
        best = [trie_counts([x], pieces)[0] for x in tokens]
        assert (counts[k].n_pretokens, counts[k].n_tokens) == (len(tokens), sum(n for n, _ in best))
        assert abs(counts[k].score - sum(s for _, s in best)) < 1e-9
        sums = [0.0]
        for x in tokens:
            sums = sorted((a + s for a in sums for s, _ in n_best(x, pieces, 4)), reverse=True)[:4]
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: (r.row, r.rank))
        assert np.allclose([r.score for r in own][: len(sums)], sums)
        assert [r.rank for r in own][: len(sums)] == list(range(1, len(sums) + 1))
        assert len({bytes(r.ids_le) for r in own}) == len(sums)
        by_id = {i: s for x, i in pieces.ids.items() for s in [pieces.score[x]]} | dict.fromkeys(pieces.bytes_, pieces.fall)
        assert all(math.isclose(sum(by_id[i] for i in np.frombuffer(r.ids_le, "<u4").tolist()), r.score, abs_tol=1e-9) for r in own)
    assert {(r.doc_id, r.text) for r in decoded(found, public_pieces()).collect()} == {(k, t or "") for k, t in enumerate(TEXTS)} | {(None, "b")}


def test_query_and_no_rows(spark):
    got = op8_nbest(spark, "/root/testdata/sf0.001")
    assert got.where("not round_trip").count() == 0 < got.count()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(empty, public_pieces()).count() == segmentations(empty, public_pieces()).count() == 0


def test_very_long_texts(spark):
    from assaykit.llm.pieces import public_pieces, segmentations, token_counts

    many = " ".join(f"word{k % 5000}" for k in range(300_000))
    one = "ab" * 4000  # no space at all
    docs = spark.createDataFrame([(1, many), (2, one), (3, many)], "doc_id long, text string")
    counts = {r.doc_id: r for r in token_counts(docs, public_pieces(), runs=True).collect()}
    found = segmentations(docs, public_pieces(), 3, runs=True).collect()
    assert all(r.round_trip for r in found) and len(found) == 9
    for r in found:
        assert r["rank"] > 1 or (abs(r.score - counts[r.doc_id].score) < 1e-6 * abs(r.score) and len(r.ids_le) // 4 >= counts[r.doc_id].n_tokens)
