import json
import threading

import pytest

from spotweave.sources import io


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, t string")


def test_entries_tell_what_they_hold(spark, tmp_path, frame):
    folder = str(tmp_path / "cache")
    assert io.cache_entries(spark, folder).isEmpty()
    io.cached(folder, [frame], {"radius": 3}, lambda: frame.where("id < 7").repartition(2))
    io.cached(folder, [frame], {"radius": 4}, lambda: frame.where("id < 0"))
    about = sorted((json.loads(r["about"]) for r in io.cache_entries(spark, folder).collect()), key=lambda a: a["params"]["radius"])
    assert [a["rows"] for a in about] == [7, 0] and all(a["inputs"] == [io.fingerprint(frame)] and a["schema"] == json.loads(frame.schema.json()) for a in about)
    assert io.cached(folder, [frame], {"radius": 4}, lambda: pytest.fail("built twice")).columns == ["id", "t"]


def test_writers_at_once_leave_one_whole_entry(spark, tmp_path, frame):
    folder, gate, got = str(tmp_path), threading.Barrier(3), []

    def build(tag):
        gate.wait(60)  # all three have found no entry
        return frame.where("id < 20").repartition(3)

    def write(tag):
        got.append(io.cached(folder, [frame], {"k": 1}, lambda: build(tag)).count())

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert got == [20, 20, 20] and io.cache_entries(spark, folder).count() == 1
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1  # the others removed theirs


def test_a_writer_that_dies_leaves_no_entry(spark, tmp_path, frame, monkeypatch):
    folder = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(io._Files, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            io.cached(folder, [frame], {"k": 1}, lambda: frame)
    assert io.cache_entries(spark, folder).isEmpty() and len(list(tmp_path.iterdir())) == 1
    assert io.cached(folder, [frame], {"k": 1}, lambda: frame.where("id < 5")).count() == 5
    assert io.sweep_cache(spark, folder) == 0 and io.sweep_cache(spark, folder, -1) == 1
    assert io.cached(folder, [frame], {"k": 1}, lambda: pytest.fail("built twice")).count() == 5
