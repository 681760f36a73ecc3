"""Splitting, sampling and selecting whole games, by order or by seeded hash."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chronological(games: DataFrame, *, player: str = "player", at: str = "played_at", game: str = "game_id", train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """Games with ``split``: the first ``floor(train * n)`` train, up to ``floor(valid * n)`` validation,
    the rest test, ordered by time and game. Players with an empty split get null."""
    own = Window.partitionBy(player)
    n, i = F.count("*").over(own), F.row_number().over(own.orderBy(at, game))
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(valid))
    split = F.when(i <= a, "train").when(i <= b, "validation").otherwise("test")
    return games.withColumn("split", F.when((n >= 3) & (a >= 1) & (b > a) & (n > b), split))


def newest_blocks(games: DataFrame, blocks: list[tuple[str, int]], *, player: str = "player", at: str = "played_at", game: str = "game_id") -> DataFrame:
    """The newest games cut into named blocks, the last named block being the newest; others drop.

    A player is left out whose oldest taken game shares its time with the first game that isn't taken, as
    no order of time says which of the two belongs to the blocks.
    """
    total = sum(n for _, n in blocks)
    own = Window.partitionBy(player).orderBy(F.desc(at), F.desc(game))
    ranked = games.withColumns({"_i": F.row_number().over(own), "_next": F.lead(at).over(own)})
    tied = F.max((F.col("_i") == total) & F.col("_next").isNotNull() & (F.col("_next") == F.col(at))).over(Window.partitionBy(player))
    ranked = ranked.withColumn("_tied", tied).where(F.col("_i") <= total).where(~F.col("_tied")).drop("_next", "_tied")
    name, below = F.lit(None).cast("string"), 0
    for label, n in reversed(blocks):
        name = F.when((F.col("_i") > below) & (F.col("_i") <= below + n), F.lit(label)).otherwise(name)
        below += n
    return ranked.withColumn("block", name).drop("_i")


def half_split(games: DataFrame, *, player: str = "player", at: str = "played_at", least: int = 10) -> DataFrame:
    """The time of game n // 2 is the cutoff: strictly earlier games are history, ties evaluation."""
    own = Window.partitionBy(player)
    ranked = games.withColumns({"_i": F.row_number().over(own.orderBy(at, "game_id")), "_n": F.count("*").over(own)})
    cutoff = F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, F.col(at))).over(own)
    return ranked.where(F.col("_n") >= least).withColumn("half", F.when(F.col(at) < cutoff, "history").otherwise("evaluation")).drop("_i", "_n")


def seeded_order(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *keys), 256)


def whole_game_prefix(games: DataFrame, cap: int, size: str, order: list[Column], *, player: str = "player") -> DataFrame:
    """Complete games in order until the first that would pass the cap, and then no more.

    The running total stays above the cap from there on, so a cumulative sum says it.
    """
    own = Window.partitionBy(player).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return games.withColumn("_sum", F.sum(size).over(own)).where(F.col("_sum") <= cap).drop("_sum")


def greedy_pack(games: DataFrame, limit: Column, *, groups: list[str], size: str, at: str = "played_at", game: str = "game_id") -> DataFrame:
    """Newest first: the first game always, later ones only if they still fit (others are skipped).

    Whether a game fits depends on all before it, so a group is walked in one task: rows are sorted by group
    and time and streamed, with only the running total carried from row to row and batch to batch. Null
    groups are groups, null sizes take no room, games without a time come last; ties by game, then size.
    """
    rows = games.select(*groups, game, F.unix_micros(at).alias("_t"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_s"), limit.cast("bigint").alias("_limit"))
    dealt = rows.repartition(*groups).sortWithinPartitions(*groups, F.desc("_t"), F.desc(game), F.desc("_s"))
    width = len(groups)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)
            kept = []
            for key, taken, most in zip(keys, batch.column(width + 2).to_pylist(), batch.column(width + 3).to_pylist(), strict=True):
                fresh = key != now
                if fresh:
                    now, total = key, 0
                fits = fresh or (most is not None and total + taken <= most)
                total += taken if fits else 0
                kept.append(fits)
            yield batch.select(range(width + 1)).filter(pa.array(kept, pa.bool_()))

    return dealt.mapInArrow(walk, games.select(*groups, game).schema)


def top_n(rows: DataFrame, n: int, order: list[Column], *, per: str) -> DataFrame:
    w = Window.partitionBy(per).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def blocks_of(rows: DataFrame, size: int, order: list[Column], *, per: str, name: str = "block") -> DataFrame:
    w = Window.partitionBy(per).orderBy(*order)
    return rows.withColumn(name, F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def accept_in_order(candidates: DataFrame, games: DataFrame, *, minimum: int, target: int) -> DataFrame:
    """Candidates (player, place) accepted in order until ``target``: a game belongs to the first
    candidate that has it, and a candidate needs ``minimum`` games of its own.

    Ownership goes to the earliest candidate that is accepted, so a rejected one gives its games
    back. Each round fixes every candidate that no still undecided candidate before it contests;
    rounds are as many as the longest chain of contested candidates, mostly two or three.
    """
    from quillog.session import durable

    pairs = durable(games.select("player", "game_id").distinct().join(candidates, "player"))
    state = durable(candidates.withColumn("accepted", F.lit(None).cast("boolean")))
    while True:
        tagged = pairs.join(state.select("player", "accepted"), "player")
        taken = tagged.where("accepted").groupBy("game_id").agg(F.min("place").alias("_owner"))
        open_ = tagged.where("accepted IS NULL").groupBy("game_id").agg(F.min("place").alias("_first"))
        mine = tagged.where("accepted IS NULL").join(taken, "game_id", "left").join(open_, "game_id")
        own = F.col("_owner").isNull() | (F.col("_owner") > F.col("place"))
        counts = mine.groupBy("player").agg(
            F.count_if(own & (F.col("_first") == F.col("place"))).alias("_sure"), F.count_if(own).alias("_most")
        )
        decided = state.join(counts, "player", "left").select(
            "player", "place",
            F.coalesce(
                "accepted",
                F.when(F.coalesce("_most", F.lit(0)) < minimum, F.lit(False)).when((F.col("_sure") == F.col("_most")) & (F.col("_most") >= minimum), F.lit(True)),
            ).alias("accepted"),
        )
        decided = durable(decided)
        left = decided.where("accepted IS NULL").count()
        state = decided
        if not left:
            break
    chosen = state.where("accepted").orderBy("place").limit(target)
    return chosen.select("player", "place")
