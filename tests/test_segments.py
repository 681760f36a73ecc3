"""Scans on two levels against plain running sums, with one player of nearly all rows."""

from __future__ import annotations

import datetime
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillog.operators import history, ordering, splits
from quillog.sources import ingest


@pytest.fixture(scope="module")
def skewed(spark):
    draw = random.Random(8)
    start = datetime.datetime(2020, 1, 1)
    rows = []
    for i in range(2_000):
        player = "hot" if draw.random() < 0.9 else draw.choice(["a", "b", None])
        at = start + datetime.timedelta(days=draw.randrange(40), hours=draw.choice([0, 0, 5]))
        rows.append((i, player, at, f"g{draw.randrange(5)}", i, draw.choice("xyz"), draw.choice("lr"), draw.random() < 0.3, True))
    return rows, spark.createDataFrame(rows, "decision_id long, player string, played_at timestamp, game_id string, ply long, piece string, wing string, capture boolean, chosen boolean").repartition(7)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2], r[3], r[4]))


@pytest.mark.parametrize("inclusive", [False, True])
def test_segmented_sums(skewed, inclusive):
    rows, df = skewed
    got = ordering.segmented(df.withColumn("_bucket", F.date_trunc("day", "played_at")), ["player"], ["played_at", "game_id", "ply"], {"n": F.lit(1), "k": F.col("capture").cast("int")}, inclusive=inclusive)
    have = {r.decision_id: (r.n, r.k) for r in got.collect()}
    seen: Counter = Counter()
    for r in in_order(rows):
        before = (seen[r[1], "n"], seen[r[1], "k"])
        seen[r[1], "n"] += 1
        seen[r[1], "k"] += r[7]
        assert have[r[0]] == ((seen[r[1], "n"], seen[r[1], "k"]) if inclusive else before)


def test_descending_segments(skewed):
    rows, df = skewed
    got = ordering.segmented(df.withColumn("_bucket", F.date_trunc("day", "played_at")), ["player"], [F.desc("played_at"), F.desc("game_id"), F.desc("ply")], {"n": F.lit(1)}, descending=True)
    have, seen = {r.decision_id: r.n for r in got.collect()}, Counter()
    for r in reversed(in_order(rows)):
        assert have[r[0]] == seen[r[1]]
        seen[r[1]] += 1


def test_a_frequent_player_is_spread_over_tasks(spark, skewed):
    rows, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    dealt = history._dealt(df, "player", ["decision_id"]).where("player = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 0.8 * sum(r["count"] for r in dealt)


def test_encoders_on_skewed_players(skewed):
    rows, df = skewed
    rows = [r for r in rows if r[1] is not None]
    out = history.tendencies(df.where("player IS NOT NULL"), pieces=["x", "y", "z"], wings=["l", "r"], flags=("capture",), strength=6.0).collect()
    have, seen = {r.decision_id: r for r in out}, Counter()
    for r in in_order(rows):
        n, got = seen[r[1]], have[r[0]]
        p = (seen[r[1], "capture"] + 3) / (n + 6)
        assert got.observations == n and got.piece_probability == pytest.approx((seen[r[1], r[5]] + 2) / (n + 6)) and got.capture_match == pytest.approx(p if r[7] else 1 - p)
        seen.update([r[1], (r[1], r[5])] + [(r[1], "capture")] * r[7])


def test_shards_of_skewed_players(skewed):
    rows, df = skewed
    have, seen = {r.decision_id: r.shard for r in ingest.shards(df, 100).collect()}, Counter()
    for r in in_order(rows):
        assert have[r[0]] == seen[r[1]] // 100
        seen[r[1]] += 1


def packed(games, limit):
    """Greedy packing of (player, game, size, time) in plain Python."""
    out, groups = set(), {}
    for r in games:
        groups.setdefault(r[0], []).append(r)
    for player, own in groups.items():
        total = None
        for _, game, size, at in sorted(own, key=lambda r: (r[3], r[1]), reverse=True):
            if total is None or total + size <= limit:
                total = (total or 0) + size
                out.add((player, game))
    return out


def test_packing_matches_a_plain_walk(spark):
    draw = random.Random(9)
    games = [(draw.choice(["a", "b", None, "c"]), f"g{i:04}", draw.randrange(1, 30), draw.randrange(50)) for i in range(800)]
    df = spark.createDataFrame(games, "player string, game_id string, n long, t long").repartition(6).withColumn("played_at", F.timestamp_seconds("t"))
    got = splits.greedy_pack(df, F.lit(200), groups=["player"], size="n")
    assert {(r.player, r.game_id) for r in got.collect()} == packed(games, 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # the walk goes on over batches
    assert {(r.player, r.game_id) for r in got.collect()} == packed(games, 200)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert splits.greedy_pack(df.limit(0), F.lit(5), groups=["player"], size="n").count() == 0


def test_packing_a_hundred_thousand_games_of_one_player(spark):
    games = spark.range(100_000).select(F.lit("p").alias("player"), F.col("id").alias("game_id"), (F.col("id") % 5 + 1).alias("n"), F.timestamp_seconds("id").alias("played_at"))
    began = time.perf_counter()
    got = splits.greedy_pack(games, F.lit(250_000), groups=["player"], size="n").agg(F.count("*"), F.min("game_id")).first()
    assert time.perf_counter() - began < 20
    want, total = [], 0
    for i in reversed(range(100_000)):
        if total + i % 5 + 1 <= 250_000:
            total += i % 5 + 1
            want.append(i)
    assert tuple(got) == (len(want), min(want))
