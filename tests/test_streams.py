"""State of the streamed tendencies, and how their input is delivered."""

from __future__ import annotations

import json
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from quillog.plans import stream_queries
from quillog.streaming import streams


class Map(dict):
    """Map state as a dictionary."""

    containsKey, getValue, updateValue, removeKey, iterator = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop, dict.items


def test_a_state_value_holds_no_more_than_a_batch(monkeypatch):
    maps, timers = {}, []
    handle = SimpleNamespace(getMapState=lambda name, *_: maps.setdefault(name, Map()), registerTimer=timers.append)
    own = streams.Tendencies({"player": "player", "at": "at", "row_id": "id"}, {"piece": ["A", "B"]}, ("check",), ("ply",), 20.0)
    own.init(handle)
    monkeypatch.setattr(own, "AT_ONCE", 7, raising=False)
    at = pd.Timestamp("2020-01-01")
    frames = [pd.DataFrame({"at": at, "id": [10 * b + i for i in range(10)], "ply": [10 * b + i for i in range(10)], "piece": "A", "check": True}) for b in (2, 0, 1)]
    own.handleInputRows(("p",), iter(frames), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    assert max(len(json.loads(v[0])) for v in maps["waiting"].values()) == 10 and timers == [at.value // 10**6]
    out = list(own.handleExpiredTimer(("p",), None, SimpleNamespace(getExpiryTimeInMs=lambda: timers[0])))
    assert max(map(len, out)) == 7 and pd.concat(out)["id"].tolist() == list(range(30)) == pd.concat(out)["observations"].tolist()
    assert not maps["waiting"] and maps["counts"]["all",] == (30,)


def test_a_part_is_written_by_all_tasks_that_hold_it(spark, tmp_path):
    parts = spark.range(4000, numPartitions=4).withColumn("_part", F.lit(0))
    stream_queries._deliver(parts, 0, str(tmp_path / "in"))
    assert len(list(Path(tmp_path / "in").glob("*.parquet"))) == 4


def test_a_part_of_more_files_than_a_batch_drops_nothing(spark, sf_dir, monkeypatch):
    """Files of a part whose first ones hold its last rows: none of the others may be taken for late."""
    own = stream_queries.table
    want = sorted(stream_queries.st_incremental_ingest(spark, sf_dir).collect())
    monkeypatch.setattr(stream_queries, "table", lambda *of: own(*of).repartitionByRange(240, F.desc("ts")))
    with_files = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would merge the small files
    try:
        assert sorted(stream_queries.st_incremental_ingest(spark, sf_dir).collect()) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_files)
