"""Stored tables as streams: folders of several files, and many events of one key."""

from __future__ import annotations

import os
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__ as entry
from pressmill.streaming import jobs as jb
from tests.oracle import DATA, compare, engine


class State:
    """A list or value state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows) if not isinstance(self.rows, tuple) else self.rows

    def appendValue(self, row):
        self.rows, self.calls = [*self.rows, row], self.calls + 1

    def put(self, rows):
        self.rows, self.calls = list(rows), self.calls + 1

    def update(self, row):
        self.rows, self.calls = row, self.calls + 1

    def clear(self):
        self.rows = []


@pytest.fixture
def cooldown():
    import pandas as pd

    job, waiting, last, timers = jb.Cooldown(1_000_000), State(), State(), []
    job.init(SimpleNamespace(getListState=lambda *a: waiting, getValueState=lambda *a: last, registerTimer=timers.append))

    def add(times):
        assert not list(job.handleInputRows(("a",), iter([pd.DataFrame({"t": times})]), None))

    def fire(now_ms):
        return [t for df in job.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: now_ms), None) for t in df["t"]]

    return SimpleNamespace(add=add, fire=fire, waiting=waiting, last=last, timers=timers)


def test_a_batch_of_one_key_is_one_state_write(cooldown):
    times = [k * 300_000 for k in range(4000)]
    cooldown.add(times[::-1] + times)
    assert cooldown.waiting.calls == 1 and cooldown.timers == [0]
    assert cooldown.fire(2_000) == [0, 1_200_000]
    assert cooldown.timers[1:] == [2_100, 2_201]  # what waits, and the end of the cooldown
    assert cooldown.fire(2_200) == [] and cooldown.last.rows == (1_200_000,)
    assert cooldown.fire(10**9) == list(range(2_400_000, times[-1] + 1, 1_200_000))
    assert not cooldown.waiting.exists()


def test_cooldown_goes_on_over_batches(cooldown):
    cooldown.add([0, 999_999, 1_000_000, 1_500_000])
    assert cooldown.fire(999) == [0]
    cooldown.add([1_200_000, 2_100_000])
    assert cooldown.fire(5_000) == [1_000_000, 2_100_000]
    assert cooldown.fire(3_101) == [] and not cooldown.last.exists()


@pytest.fixture(scope="module")
def parted(tmp_path_factory):
    """The test tables with three of them as folders of two files, each with rows of all times."""
    d = tmp_path_factory.mktemp("parted")
    con = duckdb.connect()
    for file in os.listdir(f"{DATA}/sf0.001"):
        name, source = file.split(".")[0], f"{DATA}/sf0.001/{file}"
        if name in ("documents", "conversations", "events"):
            key = {"documents": "doc_id", "conversations": "conv_id", "events": "event_id"}[name]
            os.mkdir(d / file)
            for k in (0, 1):
                con.execute(f"COPY (SELECT * FROM '{source}' WHERE {key} % 2 = {k}) TO '{d}/{file}/part-{k}.parquet' (FORMAT parquet)")
        else:
            os.symlink(source, d / file)
    return str(d)


@pytest.mark.parametrize("name", ["stream_activity", "stream_alerts", "stream_inbox", "stream_late"])
def test_tables_in_folders(spark, parted, name):
    ok, note = compare(engine("0.001"), entry.queries()[name](spark, parted), entry.oracle_sql()[name])
    assert ok, note


def test_a_table_is_one_batch(spark, tmp_path):
    for k in range(70):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    seen = []
    job = jb.read_table_stream(spark, str(tmp_path), "t").writeStream.foreachBatch(lambda batch, k: seen.append(batch.count()))
    jb.run_available(job, str(tmp_path / "cp"))
    assert seen == [70]
