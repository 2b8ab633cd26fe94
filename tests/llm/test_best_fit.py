"""The cache of op11's encoder."""

import numpy as np

from tessera.llm import best_fit as B


def test_frequent_parts_are_merged_once(monkeypatch):
    """The cache of parts is bounded and keeps what is met again while others pass through it."""
    from types import SimpleNamespace
    asked = []

    def tokenize(letters):
        asked.append(letters)
        return [SimpleNamespace(id=len(letters))]
    monkeypatch.setattr(B, "_CACHE_PARTS", 10)
    ids = B._SplitIds(SimpleNamespace(model=SimpleNamespace(tokenize=tokenize)))
    for i in range(200):
        assert ids[" the"] == np.array([4], "<u4").tobytes()
        ids[f" x{i}é"]
        assert len(ids) <= 10 and len(ids.before) <= 10
    assert asked.count("Ġthe") == 1 and len(asked) == 201
