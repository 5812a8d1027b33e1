"""What driver and Python workers hold on to."""

import sys
import tracemalloc

import numpy as np
import pytest

pytest.importorskip("pyarrow")
from tidelines.llm import _common, toxicity  # noqa: E402


class Stage:
    def __init__(self, n):
        self.n = n

    def stageId(self):
        return self.n


@pytest.fixture
def stage(monkeypatch):
    import pyspark

    monkeypatch.setattr(sys, "_tidelines_states", {}, raising=False)
    return lambda n: monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Stage(n)))


def held():
    return list(sys._tidelines_states)


def test_states_of_other_operators_make_room(stage):
    stage(1)
    _common.worker_state("linear-1", dict)
    stage(2)
    first = _common.worker_state("quality", dict)
    assert held() == ["quality"]
    _common.worker_state("quality-1", dict)
    assert _common.worker_state("quality", dict) is first and sorted(held()) == ["quality", "quality-1"]
    stage(3)
    _common.worker_state("jaccard-words", dict)
    assert held() == ["jaccard-words"]


def test_states_of_one_stage_stay_together(stage):
    stage(5)
    made = [_common.worker_state(k, dict) for k in ("linear-1", "quality", "ranks-1")]
    assert all(_common.worker_state(k, dict) is m for k, m in zip(("linear-1", "quality", "ranks-1"), made, strict=True))


def test_fit_works_on_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    none = np.zeros(0, np.int32).tobytes()
    examples = []
    for i in range(1500):
        ids = np.unique(rng.integers(0, 20_000, 900) * (1 + i % 2)).astype(np.int32)
        examples.append((i % 2, ids.tobytes(), rng.integers(1, 5, len(ids)).astype(np.int32).tobytes(), none, none))
    tracemalloc.start()
    whole = toxicity.fit(examples, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 39e6
    monkeypatch.setattr(toxicity, "CHUNK", 1000)
    pieces = toxicity.fit(examples, steps=3)
    assert (pieces.index == whole.index).all() and np.allclose(pieces.weight, whole.weight, atol=1e-12) and abs(pieces.intercept - whole.intercept) < 1e-12


def test_piece_cache_is_bounded(stage):
    import base64

    from tidelines.llm import byte_bpe

    stage(1)
    ranks = b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256))
    cache = byte_bpe._encoder("k", ranks)[1]
    for i in range(500_000):
        cache[f"{i:x}"]
    assert len(cache) + len(cache.old) <= 400_000
    assert cache["ab"] == b"a\0\0\0b\0\0\0"
