import pyarrow as pa

from tessera.llm import common


class Mapped:
    def mapInArrow(self, fn, schema):
        return fn


def test_workers_give_memory_back(monkeypatch):
    """Once when a task's batches are done, none of which is lost."""
    calls = []
    monkeypatch.setattr(common, "released", lambda: calls.append(1))
    run = common.map_batches(Mapped(), lambda b: b if b.num_rows > 1 else None, "x long")
    batches = [pa.record_batch([pa.array(range(n))], names=["x"]) for n in (3, 0, 1, 2)]
    out = run(iter(batches))
    assert next(out).num_rows == 3 and not calls
    assert [b.num_rows for b in out] == [2] and calls == [1]


def test_released_runs():
    common.released()
