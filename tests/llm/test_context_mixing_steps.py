"""Decisions are handled in small steps, whose size changes no score."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import context_mixing as C


def test_steps_change_no_score(monkeypatch):
    rnd = random.Random(2)
    words = ["a", "bb", "Ccc", "né", "中文", "x" * 200, *(f"w{k}" for k in range(300))]
    texts = pa.array([None, "", *(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 400))) for _ in range(60))])
    t = C.text_tokens(texts)
    own = C.Book([C.END, *words[:20]], np.arange(21, 0, -1), C.huffman([*range(21, 0, -1), 5.0]), C.huffman([1.0] * 257))
    coder = C.Coder(own)
    found = []
    for step in (1 << 7, 1 << 14):
        monkeypatch.setattr(C, "_STEP", step)
        steps = list(coder.decisions(t)[1])
        assert all(len(bit) <= step or token[0] == token[-1] for token, bit, _, _ in steps)
        learner = C.Learner(coder)
        learner.learn(t)
        odds, level = (np.stack(x) for x in zip(*(C._odds(*(learner.table[k][i::2].astype(np.float32) for i in (0, 1))) for k in range(C.ORDERS))))
        model = C.Model(odds, level, learner.weights, np.full((C.LEVELS, C.BUCKETS), 0.5, np.float32))
        found.append(([np.concatenate([x[k] for x in steps], axis=-1) for k in range(4)], learner.table, C.log10_scores(model, coder, t)[1]))
    (a, table, score), (b, same, again) = found
    assert all(np.array_equal(x, y) for x, y in zip(a, b)) and np.array_equal(table, same)
    assert score == pytest.approx(again, rel=1e-3)
