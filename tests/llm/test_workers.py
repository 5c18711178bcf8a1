"""What a worker holds when tasks of several operators come to it in turn."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from weftline.llm import common, near_dedup, packing, quality, substring_dedup


class Docs:
    """Stands for a table: mapInArrow() hands back the function that a task would run."""

    schema = "doc_id long, text string"
    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda model: SimpleNamespace(value=model)))

    def mapInArrow(self, run, schema):
        return run


@pytest.fixture
def probe(monkeypatch):
    seen = SimpleNamespace(dropped=0, given=0)

    def drop():
        seen.dropped += 1

    def give():
        seen.given += 1

    monkeypatch.setitem(common._owners, "probe", drop)
    monkeypatch.setattr(common, "_owner", [])
    monkeypatch.setattr(common, "give_back", give)
    common.enter("probe")
    seen.dropped = seen.given = 0
    return seen


@pytest.mark.parametrize("step", [near_dedup.sketch, substring_dedup.prepared])
def test_a_task_drops_others_caches_and_gives_back_at_its_end(probe, step):
    assert list(step(Docs())(iter([]))) == [] and (probe.dropped, probe.given) == (1, 2)
    assert list(step(Docs())(iter([]))) == [] and (probe.dropped, probe.given) == (1, 3)


def test_packing_gives_back_and_keeps_its_own_cache(probe, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(common, "id_text", lambda docs: docs)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    run = packing.pieces_of(Docs(), public_tokenizers.path("byte_bpe_50k.json"))
    for given in (2, 3):
        list(run(iter([])))
        assert (probe.dropped, probe.given) == (1, given)


def test_quality_drops_the_caches_of_the_stage_before(probe, monkeypatch):
    monkeypatch.setattr(quality, "learn", lambda *a: ({}, 0.5))
    monkeypatch.setattr(common, "small_batches", lambda spark: None)
    assert list(quality.keep(Docs(), None)(iter([]))) == [] and (probe.dropped, probe.given) == (1, 2)
