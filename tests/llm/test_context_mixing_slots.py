"""Decisions of one kind in a step, order 0 of words from the book, and every decision counted."""

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import context_mixing as C


@pytest.fixture
def coder():
    words = [C.END, *(f"w{k}" for k in range(40))]
    held = np.arange(41, 0, -1)
    return C.Coder(C.Book(pa.array(words, pa.large_string()), held, C.huffman([*(held + 0.5).tolist(), 5.0]), C.huffman([1.0] * 257)))


def test_order_0_of_a_word_is_its_share_of_the_book():
    weights = [50.5, 20.5, 9.5, 4.5, 3.5]
    tree = C.huffman(weights)
    for leaf, w in enumerate(weights):
        s = slice(tree.first[leaf], tree.first[leaf + 1])
        one = 1 / (1 + np.exp(-tree.odds[tree.nodes[s]].astype(float)))
        assert np.prod(np.where(tree.bits[s] == 1, one, 1 - one)) == pytest.approx(w / sum(weights), rel=0.2)


def test_all_decisions_are_counted_and_steps_hold_one_kind(coder):
    texts = pa.array([" ".join(f"w{(k * j) % 60}" for k in range(500)) for j in range(1, 90)] + [None, "é" * 300])
    t = C.text_tokens(texts)
    steps = list(coder.decisions(t)[1])
    assert all(len(set(kind.tolist())) == 1 for _, _, kind, _ in steps)
    decisions = sum(len(bit) for _, bit, _, _ in steps)
    spelled = sum(len(bit) for _, bit, kind, _ in steps if kind[0])
    learner = C.Learner(coder)
    learner.learn(t)
    assert [int(x.sum()) for x in learner.table] == [spelled, *[decisions] * (C.ORDERS - 1)]
    assert learner.seen.sum() == learner.refine.sum() == decisions
    assert 0 <= min(s[:, :].min() for *_, s in steps) and max(s[1:].max() for *_, s in steps) < 1 << C.SLOTS


def test_cells_keep_odds_and_levels():
    odds, level = C._odds(np.array([0, 3, 0, 1e9, 7], np.float32), np.array([0, 2, 9, 0, 1e12], np.float32))
    cells = C._cells(odds, level)
    assert (cells & 3).tolist() == [0, 1, 2, 2, 2]
    assert (cells & -4) / float(C._FINE) == pytest.approx(odds, abs=1 / 500)
