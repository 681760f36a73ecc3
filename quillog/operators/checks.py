"""Validation: each check returns the table of its violations (empty when all is well)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fields known only after a decision; none may be a feature.
POST_DECISION = (
    "actual_move_eval", "actual_move_mate_in", "centipawn_loss", "actual_move_rank", "actual_move_in_top_1", "actual_move_in_top_3",
    "actual_move_in_top_5", "approximate_winning_chance_after_actual_move", "actual_move_san", "seconds_spent_on_move", "piece_moved", "is_capture",
    "is_check", "is_castle", "is_promotion", "is_en_passant", "is_queen_trade", "captured_piece_type", "player_clock_seconds_after_move",
    "fraction_of_initial_time_remaining", "time_remaining_seconds", "time_remaining_fraction", "time_pressure", "low_time",
)
#: The same in the candidate table and in predictions.
OWN_POST_DECISION = ("chosen", "actual_move", "actual_rank", "actual_cp", "cp_loss", "result", "outcome", "predicted_move")


def leaked_fields(features: list[str], forbidden: tuple[str, ...] = POST_DECISION + OWN_POST_DECISION) -> list[str]:
    return sorted(set(features) & set(forbidden))


def require_no_leakage(features: list[str], forbidden: tuple[str, ...] = POST_DECISION + OWN_POST_DECISION) -> None:
    leaked = leaked_fields(features, forbidden)
    if leaked:
        raise ValueError(f"fields known only after the decision: {', '.join(leaked)}")


def not_one_positive(cand: DataFrame, decision: str = "decision_id", chosen: str = "chosen") -> DataFrame:
    return cand.groupBy(decision).agg(F.count_if(F.col(chosen)).alias("positives")).where("positives <> 1")


def bad_candidate_sets(cand: DataFrame, k: int, *, decision: str = "decision_id", rank: str = "engine_rank", move: str = "move", available: Column | None = None) -> DataFrame:
    """Decisions whose ranks aren't exactly 1..min(k, available) or whose moves repeat. Distinct values are collected as sets,
    which a decision's few candidates bound: counting them would make every row three and hash each."""
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    own = cand.groupBy(decision).agg(
        F.min(rank).alias("low"), F.max(rank).alias("high"), F.count("*").alias("n"), F.size(F.collect_set(rank)).cast("bigint").alias("ranks"), F.size(F.collect_set(move)).cast("bigint").alias("moves"),
        F.max(available if available is not None else F.lit(k)).alias("available"),
    )
    want = F.least(F.lit(k), "available")
    return own.where(~((F.col("low") == 1) & (F.col("high") == want) & (F.col("n") == want) & (F.col("ranks") == want) & (F.col("moves") == want)))


def bad_probabilities(cand: DataFrame, p: str, decision: str = "decision_id", tolerance: float = 1e-6) -> DataFrame:
    """Decisions with a probability that is null, not finite or outside [0, 1], or with a sum off one."""
    bad = F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)
    own = cand.groupBy(decision).agg(F.count_if(bad).alias("invalid"), F.sum(p).alias("total"))
    return own.where((F.col("invalid") > 0) | (F.abs(F.col("total") - 1) > tolerance))


def conflicting_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur with different rows. Identical rows are one."""
    return rows.distinct().groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "versions")


def incomplete_games(games: DataFrame, dec: DataFrame, *, game: str = "game_id", total: str = "total_plies", color: str = "color", ply: str = "ply", control: str = "time_control", controls: tuple[str, ...] = ()) -> DataFrame:
    """Games whose decisions aren't those of a whole game: (game, missing, extra, disagreeing, empty).

    The player moves at every second ply up to the total, from the first as white and from the second as
    black. ``disagreeing`` counts decisions whose colour isn't the game's or whose control isn't one of
    ``controls``; ``empty`` marks games that have no ply for the player. Counting distinct plies within
    the range says the same as comparing arrays, without an array per game.
    """
    start = F.when(F.col(f"g.{color}") == "white", 1).otherwise(2)
    wanted = F.greatest(F.lit(0), F.floor((F.col(f"g.{total}") - start) / 2) + 1)
    fits = (F.col(f"d.{ply}") >= start) & (F.col(f"d.{ply}") <= F.col(f"g.{total}")) & ((F.col(f"d.{ply}") - start) % 2 == 0)
    odd = (F.col(f"d.{color}") != F.col(f"g.{color}")) | (~F.col(f"d.{control}").isin(*controls) if controls else F.lit(False))
    own = games.alias("g").join(dec.alias("d"), F.col(f"g.{game}") == F.col(f"d.{game}"), "left").groupBy(F.col(f"g.{game}").alias(game)).agg(
        F.max(wanted).alias("_wanted"), F.count_distinct(F.when(fits, F.col(f"d.{ply}"))).alias("_there"), F.count_distinct(F.when(~fits, F.col(f"d.{ply}"))).alias("extra"), F.count_if(odd).alias("disagreeing"),
    )
    out = own.select(game, (F.col("_wanted") - F.col("_there")).alias("missing"), "extra", "disagreeing", (F.col("_wanted") == 0).alias("empty"))
    return out.where("missing > 0 OR extra > 0 OR disagreeing > 0 OR empty")


def split_overlap(rows: DataFrame, game: str, split: str) -> DataFrame:
    return rows.groupBy(game).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def history_overlap(selection: DataFrame, game: str = "game", split: str = "split", history: str = "history") -> DataFrame:
    """Games that one player has as history and any player as held out; each is an error."""
    sides = selection.groupBy(game).agg(F.count_if(F.col(split) == history).alias("history"), F.count_if(F.col(split) != history).alias("held_out"))
    return sides.where("history > 0 AND held_out > 0")


def quarantined(selection: DataFrame, *, player: str = "player", role: str = "role", game: str = "game", split: str = "split", history: str = "history", validation: str = "validation") -> DataFrame:
    """(player, game) of development players' validation games that an evaluation player has held out."""
    reserved = selection.where((F.col(role) == "evaluation") & (F.col(split) != history)).select(game).distinct()
    return selection.where((F.col(role) == "development") & (F.col(split) == validation)).select(player, game).distinct().join(reserved, game, "left_semi")


def join_mismatches(left: DataFrame, right: DataFrame, keys: list[str], same: list[str], *, rank: str = "engine_rank") -> DataFrame:
    """In one row how many rows disagree: in each field of ``same``, without a partner on either side, by
    repeating a rank on the right, and how many decisions of the right lack rank 1. ``rank`` is one of ``keys``."""
    decision = [k for k in keys if k != rank]
    once = right.groupBy(*keys).agg(F.count("*").alias("_times"), *[F.min(c).alias(f"r_{c}") for c in same], *[F.max(c).alias(f"s_{c}") for c in same])
    both = left.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in same]).join(once, keys, "full_outer")
    paired = F.col("_l").isNotNull() & F.col("_times").isNotNull()
    kinds = [F.count_if(paired & ~(F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) & F.col(f"l_{c}").eqNullSafe(F.col(f"s_{c}")))).alias(c) for c in same]
    per = both.agg(
        *kinds, F.count_if(paired).alias("joined"), F.count_if(F.col("_times").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(F.col("_times") > 1).alias("repeated_ranks")
    )
    first = right.groupBy(*decision).agg(F.count_if(F.col(rank) == 1).alias("_n")).agg(F.count_if(F.col("_n") == 0).alias("without_first"))
    return per.crossJoin(first)  # two single rows


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-insensitive digests of the rows; equal tables have equal fingerprints."""
    row = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(row).alias("xor"), F.sum(row.cast("decimal(38,0)")).alias("total"))


def exact_complement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side. Both sides are read once and met by one grouping; null keys are equal."""
    sides = left.select(*keys, F.lit(True).alias("_left")).unionByName(right.select(*keys, F.lit(False).alias("_left")))
    met = sides.groupBy(*keys).agg(F.bool_or("_left").alias("_l"), F.bool_and("_left").alias("_only"))
    return met.where("_only OR NOT _l").select(*keys, F.when(F.col("_l"), "left").otherwise("right").alias("side"))
