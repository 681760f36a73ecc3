"""One feature row per decision: its context, clock, position, move, and what the engine's lines say of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.functions import scalars as s

from .history import move_time


def line_summary(lines: DataFrame, *, decision: str = "decision_id", rank: str = "engine_rank", cp: str = "cp", mate: str = "mate", move: str = "move") -> DataFrame:
    """Per decision the best line, the chosen one, and how many lines there are."""
    kept = lambda where, **columns: F.max(F.when(where, F.struct(*[F.col(c).alias(n) for n, c in columns.items()])))
    own = lines.groupBy(decision).agg(
        kept(F.col(rank) == 1, engine_best_move=move, _best_cp=cp, engine_mate_before=mate).alias("_best"),
        kept(F.col("chosen"), actual_move_san=move, actual_move_rank=rank, _own_cp=cp, actual_move_mate_in=mate, is_check="check").alias("_own"), F.count("*").alias("lines"),
    )
    return own.select(decision, "lines", "_best.*", "_own.*")


def clock_columns(rows: DataFrame, *, control: str, clock: str, game: str = "game_id", ply: str = "ply") -> DataFrame:
    """Initial time and increment of the control, the time spent, and what is left, with both pressure flags."""
    parts = s.time_control(F.col(control))
    # Columns and no struct, whose parts Spark would parse anew for each use.
    parsed = rows.withColumns({"initial_time_seconds": parts["initial"], "increment_seconds": parts["increment"]})
    initial, left = F.col("initial_time_seconds"), F.col(clock)
    fraction = F.when(initial > 0, left / initial)
    return parsed.withColumns({
        "player_clock_seconds_after_move": left, "time_remaining_seconds": left,
        "seconds_spent_on_move": move_time(left, F.col("increment_seconds"), game, ply), "fraction_of_initial_time_remaining": fraction, "time_remaining_fraction": fraction,
        "time_pressure": s.low_time(left, initial, 60.0, 0.20), "low_time": s.low_time(left, initial),
    })


def feature_table(rows: DataFrame, lines: DataFrame, *, decision: str = "decision_id", requested: int = 5) -> DataFrame:
    """``rows`` (decisions with fen, uci, ratings and clock columns) joined with their lines, in 51 columns.

    Decisions without lines drop; nothing is read from later in the game.
    """
    # Boards and moves are made after the join, so they aren't shuffled, in steps that Spark doesn't copy into their uses. The
    # numbers of men are an array: written out in columns, they'd make the last step one method that is too long to be compiled.
    joined = rows.join(line_summary(lines), decision).withColumns({"_board": s.squares(F.col("fen")), "_mover": s.side(F.col("fen"))})
    b, white = F.col("_board"), F.col("_mover") == "w"
    joined = joined.withColumns({
        "_m": s.move_flags(F.col("fen"), b, F.col("uci")), "_men": s.men_of(b), "_all": s.count_of(b, "A-Za-z"),
        "engine_eval_before": s.eval_to_cp(F.col("_best_cp"), F.col("engine_mate_before")), "actual_move_eval": s.eval_to_cp(F.col("_own_cp"), F.col("actual_move_mate_in")),
    })
    count = s.men_counter(F.col("_men"), F.col("_all"))
    queen = {True: b.contains("Q"), False: b.contains("q")}
    rights = s.castling_rights(F.col("fen"))
    before, after = F.col("engine_eval_before"), F.col("actual_move_eval")
    passant = (F.col("_m.piece") == "P") & (F.col("_m.captured") == "P") & (s.piece_at(b, F.substring("uci", 3, 2)) == ".")
    top = lambda k: s.rank_flag(F.col("actual_move_rank"), k, F.lit(requested), F.col("lines")).alias(f"actual_move_in_top_{k}")
    context = [
        "game_id", F.col("player").alias("player_username"), "ply", (F.floor((F.col("ply") + 1) / 2)).alias("move_number"), F.when(white, "white").otherwise("black").alias("player_color"), "fen", F.col("uci").alias("actual_move_uci"), "actual_move_san",
        "speed", F.col("opening").alias("opening_eco"), "opening_name", "player_rating", "opponent_rating", (F.col("player_rating") - F.col("opponent_rating")).alias("rating_difference"),
    ]
    clock = ["player_clock_seconds_after_move", "seconds_spent_on_move", "initial_time_seconds", "increment_seconds", "fraction_of_initial_time_remaining", "time_pressure", "time_remaining_seconds", "time_remaining_fraction", "low_time"]
    position = [
        s.game_phase(b, count).alias("game_phase"), F.col("_all").alias("total_piece_count"), s.men_balance(F.col("_men"), F.col("_mover")).alias("material_balance"),
        F.when(white, queen[True]).otherwise(queen[False]).alias("player_queen_present"), F.when(white, queen[False]).otherwise(queen[True]).alias("opponent_queen_present"),
        F.col("lines").alias("legal_move_count"), "player_in_check", (rights["kingside"] | rights["queenside"]).alias("castling_rights_available"),
    ]
    move = [
        F.col("_m.piece").alias("piece_moved"), F.col("_m.is_capture").alias("is_capture"), "is_check", F.col("_m.is_castle").alias("is_castle"), F.col("_m.promotion").isNotNull().alias("is_promotion"),
        F.coalesce(passant, F.lit(False)).alias("is_en_passant"), F.col("_m.is_queen_trade").alias("is_queen_trade"), F.col("_m.captured").alias("captured_piece_type"),
    ]
    engine = [
        "engine_best_move", before, "engine_mate_before", after, "actual_move_mate_in", s.cp_loss(before, after).alias("centipawn_loss"), "actual_move_rank", top(1), top(3), top(5),
        s.win_chance(before).alias("approximate_winning_chance_before"), s.win_chance(after).alias("approximate_winning_chance_after_actual_move"),
    ]
    return joined.select(*context, *clock, *position, *move, *engine)
