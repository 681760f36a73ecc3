"""Features of a player's past, from strictly earlier rows only, and the historical move model.

Running state is kept at decision grain: one row per decision and counted key, windowed by player (or
by the key), then joined to candidates. State common to all players is reduced to one row per
timestamp before it is windowed, so no window runs over unpartitioned rows of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import written

from .ordering import segmented, segmented_all

ORDER = ("played_at", "game_id", "ply")
BEFORE = (Window.unboundedPreceding, -1)


def move_time(clock: Column, increment: Column, game: str, ply: str) -> Column:
    """Seconds spent: previous clock and increment less the clock; null if missing or negative."""
    spent = F.lag(clock).over(Window.partitionBy(game).orderBy(ply)) + increment - clock
    return F.when(spent >= 0, spent)


def pre_move_clock(clock: Column, initial: Column, game: str, ply: str) -> Column:
    """The clock before the move; the initial time where the previous one is missing, mid-game too."""
    return F.coalesce(F.lag(clock).over(Window.partitionBy(game).orderBy(ply)), initial)


def previous_position(key: str, game: str, ply: str) -> Column:
    return F.lag(key).over(Window.partitionBy(game).orderBy(ply))


def offers(flag: str, decision: str = "decision_id") -> Column:
    return F.bool_or(flag).over(Window.partitionBy(decision))


def contested(flag: str, decision: str = "decision_id") -> Column:
    """The decision offers both values, so the choice isn't forced."""
    w = Window.partitionBy(decision)
    return F.min(F.col(flag).cast("int")).over(w) != F.max(F.col(flag).cast("int")).over(w)


def _dealt(rows: DataFrame, player: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows``, written once and dealt by player and day, so that a player of most of the
    rows is spread over as many tasks as there are days."""
    own = written(rows.select(*dict.fromkeys([player, *ORDER, *columns])).withColumn("_bucket", F.date_trunc("day", "played_at")))
    return own.repartition(player, "_bucket")


def one_hot(name: str, values: list[str], column: str) -> dict[str, Column]:
    return {f"{name}_{i}": (F.col(column) == v).cast("bigint") for i, v in enumerate(values)}


def pick(name: str, values: list, column: str) -> Column:
    """The running count that belongs to a candidate's own value."""
    out = F.lit(0).cast("bigint")
    for i, v in enumerate(values):
        out = F.when(F.col(column) == v, F.col(f"{name}_{i}")).otherwise(out)
    return out


def smoothed(count: Column, total: Column, prior: float | Column, strength: float) -> Column:
    return (count + strength * prior) / (total + strength)


def match(count_true: Column, total: Column, value: Column, strength: float) -> Column:
    p = smoothed(count_true, total, 0.5, strength)
    return F.when(value, p).otherwise(1 - p)


def tendencies(cand: DataFrame, *, pieces: list[str], wings: list[str], flags: tuple[str, ...], strength: float = 20.0, player: str = "player") -> DataFrame:
    """Candidates with smoothed rates of the player's earlier choices (piece, wing, flags) and their number.

    Every decision sees the decisions before it in (played_at, game, ply) order and nothing else.
    """
    chosen = cand.where("chosen")
    counts = {"h_total": F.lit(1).cast("bigint"), **one_hot("h_piece", pieces, "piece"), **one_hot("h_wing", wings, "wing"), **{f"h_{f}": F.col(f).cast("bigint") for f in flags}}
    state = segmented(_dealt(chosen, player, ["decision_id", "piece", "wing", *flags]), [player], list(ORDER), counts).select("decision_id", *counts)
    joined = cand.join(state, "decision_id")
    total = F.col("h_total")
    return joined.withColumns(
        {
            "piece_probability": smoothed(pick("h_piece", pieces, "piece"), total, 1 / len(pieces), strength),
            "wing_probability": smoothed(pick("h_wing", wings, "wing"), total, 1 / len(wings), strength),
            **{f"{f}_match": match(F.col(f"h_{f}"), total, F.col(f), strength) for f in flags},
        }
    ).withColumnRenamed("h_total", "observations").drop(*[c for c in counts if c != "h_total"])


def frozen_tendencies(train: DataFrame, rows: DataFrame, *, pieces: list[str], flags: tuple[str, ...], strength: float = 20.0) -> DataFrame:
    """As ``tendencies``, with the totals of all training decisions; a player without any gets the priors."""
    counts = {"h_total": F.lit(1).cast("bigint"), **one_hot("h_piece", pieces, "piece"), **{f"h_{f}": F.col(f).cast("bigint") for f in flags}}
    state = train.where("chosen").groupBy("player").agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    joined = rows.join(state, "player", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})
    total = F.col("h_total")
    return joined.withColumns(
        {"piece_probability": smoothed(pick("h_piece", pieces, "piece"), total, 1 / len(pieces), strength), **{f"{f}_match": match(F.col(f"h_{f}"), total, F.col(f), strength) for f in flags}}
    ).withColumnRenamed("h_total", "observations").drop(*[c for c in counts if c != "h_total"])


def rank_history(
    cand: DataFrame, *, ranks: int, pieces: list[str] = (), flags: tuple[str, ...] = (), strength: float = 10.0, opening_min: int = 30, per: str = "player", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Smoothed probabilities of a candidate's rank from earlier choices: overall, and within the
    decision's phase, pressure and opening, each backed off to the overall one (openings only from
    ``opening_min`` observations on); and of its piece and flags, from the overall counts.

    A decision is one row with its candidates in an array, dealt by player and day once; all four running
    states are scans over that deal, and candidates are taken out of their row at the end, so none are
    made or shuffled a second time. The result has the columns ``keep`` of the candidates (all, if None).
    """
    values = list(range(1, ranks + 1))
    contexts = ("phase", "pressure", "opening")
    keep = list(keep or cand.columns)
    hot = one_hot("r", values, "rank_seen")
    one = F.lit(1).cast("bigint")
    counts = {"n": one, **hot, **one_hot("pc", list(pieces), "piece"), **{f"f_{f}": F.col(f).cast("bigint") for f in flags}}
    state = [per, *ORDER, "piece", *flags, *contexts] if pieces else [per, *ORDER, *flags, *contexts]
    needed = list(dict.fromkeys([*(c for c in keep if c != "decision_id"), "engine_rank", *(["piece"] if pieces else []), *flags]))
    own = F.struct(F.least("engine_rank", F.lit(ranks)).alias("rank_seen"), *dict.fromkeys(state))
    packed = cand.groupBy("decision_id").agg(F.max(F.when(F.col("chosen"), own)).alias("_own"), F.collect_list(F.struct(*needed)).alias("_all")).where("_own IS NOT NULL")
    dealt = _dealt(packed.select("decision_id", "_own.*", "_all"), per, ["decision_id", "rank_seen", *state, "_all"])
    sets = [([per], counts), *[([per, name], {f"{name}_n": one, **{f"{name}_{k}": c for k, c in hot.items()}}) for name in contexts]]
    held = [*counts, *[f"{name}_{k}" for name in contexts for k in ("n", *hot)]]
    rows = segmented_all(dealt, sets, list(ORDER)).select("decision_id", *[F.col(c).alias(f"_{c}") for c in held], F.explode("_all").alias("_one"))
    rows = rows.select("decision_id", *[F.col(f"_{c}").alias(c) for c in held], "_one.*", F.least("_one.engine_rank", F.lit(ranks)).alias("rank_seen"))
    overall = smoothed(pick("r", values, "rank_seen"), F.col("n"), 1 / ranks, strength)
    within = {name: smoothed(pick(f"{name}_r", values, "rank_seen"), F.col(f"{name}_n"), overall, strength) for name in contexts}
    more = [smoothed(pick("pc", list(pieces), "piece"), F.col("n"), 1 / len(pieces), strength).alias("piece_probability")] if pieces else []
    more += [match(F.col(f"f_{f}"), F.col("n"), F.col(f), strength).alias(f"{f}_match") for f in flags]
    return rows.select(
        *keep, F.col("n").alias("observations"), *[F.col(f"{name}_n").alias(f"{name}_observations") for name in contexts],
        overall.alias("rank_probability"), within["phase"].alias("phase_probability"), within["pressure"].alias("pressure_probability"),
        F.when(F.col("opening_n") >= opening_min, within["opening"]).otherwise(overall).alias("opening_probability"), *more,
    )


def opportunity_counts(cand: DataFrame, flag: str) -> DataFrame:
    """One row per decision that offers both values of ``flag``: player, time, and whether it was taken."""
    own = cand.groupBy("decision_id", "player", "played_at").agg(
        F.min(F.col(flag).cast("int")).alias("lo"), F.max(F.col(flag).cast("int")).alias("hi"), F.max(F.when(F.col("chosen"), F.col(flag).cast("int"))).alias("taken")
    )
    return own.where("lo <> hi").select("decision_id", "player", "played_at", "taken")


def opportunity_profile(cand: DataFrame, flag: str, *, strength: float = 20.0) -> DataFrame:
    """Candidates with the player's shrunk rate of taking ``flag`` when it was optional.

    State is frozen before each timestamp: all rows that share one see the same counts. The
    population's counts are reduced to one row per timestamp first and joined back.
    """
    marked = cand.withColumn("_open", contested(flag))
    chances = marked.where("chosen").select("player", "played_at", F.when(F.col("_open"), F.col(flag).cast("int")).alias("taken"))
    mine = chances.groupBy("player", "played_at").agg(F.count("taken").alias("n"), F.sum("taken").alias("k"))
    own = Window.partitionBy("player").orderBy("played_at").rowsBetween(*BEFORE)
    times = mine.select("player", "played_at", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("own_n"), F.coalesce(F.sum("k").over(own), F.lit(0)).alias("own_k"))
    pool = mine.groupBy("played_at").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # One row per timestamp: a year's partial sums first, so that windows stay within a year.
    year = F.year("played_at")
    inside = Window.partitionBy("_y").orderBy("played_at").rowsBetween(*BEFORE)
    pool = pool.withColumn("_y", year)
    yearly = pool.groupBy("_y").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    earlier = yearly.alias("a").join(yearly.alias("b"), F.col("b._y") < F.col("a._y"), "left").groupBy("a._y").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base_n"), F.coalesce(F.sum("b.k"), F.lit(0)).alias("base_k"))
    pool = pool.join(earlier, "_y").select(
        "played_at", (F.col("base_n") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("pool_n"), (F.col("base_k") + F.coalesce(F.sum("k").over(inside), F.lit(0))).alias("pool_k")
    )
    prior = (F.col("pool_k") + 1) / (F.col("pool_n") + 2)
    p = smoothed(F.col("own_k"), F.col("own_n"), prior, strength)
    # The pool meets the players' timestamps, which are few, and only these meet the candidates.
    joined = marked.join(times.join(pool, "played_at"), ["player", "played_at"])
    return joined.select(*cand.columns, F.col("own_n").alias("observations"), F.when(F.col(flag), p).otherwise(1 - p).alias("match_probability"), F.col("_open").alias("available"))


def adapted_profile(cand: DataFrame, flag: str, cutoff: Column, *, strength: float = 20.0) -> DataFrame:
    """Per player: rate from history strictly before ``cutoff``, with the whole population's prior."""
    chances = opportunity_counts(cand, flag)
    pool = chances.agg(F.count("*").alias("pn"), F.sum("taken").alias("pk"))
    mine = chances.where(F.col("played_at") < cutoff).groupBy("player").agg(F.count("*").alias("n"), F.sum("taken").alias("k"))
    players = cand.select("player").distinct().join(mine, "player", "left").crossJoin(F.broadcast(pool))  # one row
    p = smoothed(F.coalesce("k", F.lit(0)), F.coalesce("n", F.lit(0)), (F.col("pk") + 1) / (F.col("pn") + 2), strength)
    return players.select("player", F.coalesce("n", F.lit(0)).alias("observations"), p.alias("rate"))


def transition_rates(chosen: DataFrame) -> DataFrame:
    """Per player: how often a move repeats the piece or wing before it, or captures after a capture."""
    w = Window.partitionBy("game_id").orderBy("ply")
    own = chosen.select("player", *[c for c in ("piece", "wing", "capture")], *[F.lag(c).over(w).alias(f"p_{c}") for c in ("piece", "wing", "capture")]).where("p_piece IS NOT NULL")
    return own.groupBy("player").agg(
        F.count("*").alias("pairs"), F.avg((F.col("piece") == F.col("p_piece")).cast("double")).alias("repeat_piece"), F.avg((F.col("wing") == F.col("p_wing")).cast("double")).alias("repeat_wing"),
        F.avg(F.when(F.col("p_capture"), F.col("capture").cast("double"))).alias("capture_after_capture"),
    )


def half_drift(chosen: DataFrame, attribute: str, *, least: int = 20) -> DataFrame:
    """Total-variation distance between a player's earlier and later half of games, by phase."""
    games = chosen.select("player", "game_id", "played_at").distinct()
    own = Window.partitionBy("player")
    early = games.withColumn("early", F.row_number().over(own.orderBy("played_at", "game_id")) <= F.count("*").over(own) / 2).select("game_id", "early")
    counts = chosen.join(early, "game_id").groupBy("player", "phase", F.col(attribute).alias("category")).agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b"))
    cells = counts.groupBy("player", "phase").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    joined = counts.join(cells.where(f"na >= {least} AND nb >= {least}"), ["player", "phase"])
    return joined.groupBy("player", "phase").agg((F.sum(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))) / 2).alias("drift"))


# --- historical moves ------------------------------------------------------------------------


def move_distribution(chosen: DataFrame, key: str = "position_key", move: str = "piece") -> DataFrame:
    counts = chosen.groupBy(key, move).agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def move_summary(chosen: DataFrame, key: str = "position_key") -> DataFrame:
    per = chosen.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("records"), F.count("*").alias("unique_positions"), F.count_if(F.col("n") > 1).alias("repeated_positions"), F.avg("n").alias("mean_n"), F.max("n").alias("max_n"),
        (F.sum(F.when(F.col("n") > 1, F.col("n"))) / F.sum("n") * 100).alias("repeated_percent"),
    )


def repeated_positions(chosen: DataFrame, limit: int, key: str = "position_key", move: str = "piece") -> DataFrame:
    top = chosen.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), key).limit(limit)
    dist = move_distribution(chosen, key, move).join(F.broadcast(top.select(key)), key)
    listed = dist.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(move).alias("m")))).alias("l"))
    return top.join(listed, key).select(key, "n", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["m"], -x["o"])), ",").alias("moves"))


def sample_moves(dist: DataFrame, uniform: Column, key: str = "position_key", move: str = "piece") -> DataFrame:
    """One move per key drawn in proportion to its share: the first whose running share passes the draw."""
    w = Window.partitionBy(key).orderBy(move)
    run = dist.withColumns({"_cum": F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.lead(move).over(w).isNull(), "_u": uniform})
    return run.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_u") < F.col("_cum"), F.col(move))), F.max(F.when(F.col("_last"), F.col(move)))).alias("sampled"))
