"""Greedy dedupe over two keys against the loop: chains, components, copies, null keys."""

import random

import pytest

from assaykit.operators import queue


def loop(rows):
    a, b, out = set(), set(), []
    for pos, x, y in sorted(rows):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            out.append(pos)
    return out


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "pos long, id string, content string").repartition(6)
    return sorted(r.pos for r in queue.greedy_two_keys(df, "id", "content", "pos", **how).collect())


@pytest.mark.parametrize("most", [200_000, 3])
def test_random_rows(spark, most):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, *(f"i{j}" for j in range(60))]), rng.choice([None, "", *(f"c{j}" for j in range(70))])) for k in range(250)]
    assert got(spark, rows, most=most) == loop(rows)


def test_a_long_chain_takes_few_actions(spark, monkeypatch):
    n = 30_000  # row k shares one key with the row before and the other with the row after
    rows = [(k, f"x{(k + 1) // 2}", f"y{k // 2}") for k in range(n)]
    rows += [(n + k, "x5", f"z{k}") for k in range(2000)]  # and a key that many have
    steps = []
    plain = queue.checkpointed
    monkeypatch.setattr(queue, "checkpointed", lambda df: steps.append(1) or plain(df))
    assert got(spark, rows) == loop(rows)
    assert len(steps) < 30


def test_no_rows_and_copies(spark):
    assert got(spark, []) == []
    assert got(spark, [(k, "same", "same") for k in range(500)]) == [0]
    assert got(spark, [(0, "a", "b"), (1, "b", "a"), (2, "a", "x"), (3, "y", "b"), (4, "y", "z")]) == [0, 1, 4]
