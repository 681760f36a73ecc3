"""Evaluation of predictions. Candidate rows are reduced to one row per decision first; all summaries
aggregate that table, and breakdowns come from one pass of grouping sets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import durable

from .ordering import average_ranks
from .order_stats import Wanted, dimensioned, with_quantiles
from .policy import FLOOR


def predictions(cand: DataFrame, p: str, flags: tuple[str, ...], *, ties: tuple[str, ...] = ("move",), context: tuple[str, ...] = ("player", "game_id", "phase", "time_control")) -> DataFrame:
    """One row per decision: ranks, probabilities, Brier score and how the first choice resembles the real one."""
    w = Window.partitionBy("decision_id").orderBy(F.desc(p), *ties)
    own = cand.withColumn("_i", F.row_number().over(w))
    actual = lambda c: F.max(F.when(F.col("chosen"), F.col(c)))
    top = lambda c: F.max(F.when(F.col("_i") == 1, F.col(c)))
    d = own.groupBy("decision_id").agg(
        *[F.max(c).alias(c) for c in context],
        actual("move").alias("actual_move"), top("move").alias("predicted_move"), actual("_i").alias("actual_rank"), F.count("*").alias("candidates"),
        actual("engine_rank").alias("actual_engine_rank"), F.sum(p).alias("p_sum"),
        actual(p).alias("actual_p"), top(p).alias("top_p"), F.sum(F.pow(F.col(p) - F.col("chosen").cast("int"), F.lit(2))).alias("brier"),
        (actual("piece") == top("piece")).alias("piece_match"), (actual("wing") == top("wing")).alias("wing_match"),
        *[actual(f).alias(f"actual_{f}") for f in flags], *[top(f).alias(f"predicted_{f}") for f in flags],
    )
    rank, n = F.col("actual_rank"), F.col("candidates")
    same = sum([(F.col(f"actual_{f}") == F.col(f"predicted_{f}")).cast("int") for f in flags], F.lit(0))
    return d.withColumns(
        {
            "exact": rank == 1, "top_3": rank <= 3, "top_5": rank <= 5,
            "rank_score": F.when(n == 1, 1.0).otherwise(1 - (rank - 1) / (n - 1)),
            "nll": -F.log(F.greatest("actual_p", F.lit(FLOOR))),
            "similarity": same / len(flags),
        }
    )


MEANS = ("exact", "top_3", "top_5", "rank_score", "nll", "brier", "piece_match", "wing_match", "similarity")


def panel_columns() -> list[Column]:
    as_number = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return [F.count("*").alias("decisions"), *[as_number(c) for c in MEANS], F.avg(1 / F.col("actual_rank")).alias("mrr"), F.avg("actual_rank").alias("mean_rank"), F.median("actual_rank").alias("median_rank")]


def panel(pred: DataFrame, dimensions: list[str]) -> DataFrame:
    """The metric set for all rows and by each dimension: (dimension, value, metrics)."""
    sets = [[F.col(d)] for d in dimensions]
    grouped = pred.groupingSets([*sets, []], *[F.col(d) for d in dimensions]).agg(*panel_columns(), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    name, value = F.lit("all"), F.lit("all")
    for d in dimensions:
        name = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), *[c for c in grouped.columns if c not in dimensions and not c.startswith("_g_")])


def by_dimension(rows: DataFrame, dimensions: list[str], columns: list[Column], keys: list[str] = ()) -> DataFrame:
    """``columns`` for all rows and by each dimension, in one pass of grouping sets: (keys, dimension, value, ...)."""
    ks = [F.col(k) for k in keys]
    grouped = rows.groupingSets([*[[*ks, F.col(d)] for d in dimensions], ks], *ks, *[F.col(d) for d in dimensions]).agg(*columns, *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    name, value = F.lit("all"), F.lit("all")
    for d in dimensions:
        own = F.col(f"_g_{d}") == 0
        name, value = F.when(own, F.lit(d)).otherwise(name), F.when(own, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))).otherwise(value)
    return grouped.select(*keys, name.alias("dimension"), value.alias("value"), *[c for c in grouped.columns if c not in (*dimensions, *keys) and not c.startswith("_g_")])


def summary(rows: DataFrame, dimensions: list[str], columns: list[Column], wanted: Wanted, keys: list[str] = ()) -> DataFrame:
    """``by_dimension`` with exact quantiles beside the columns."""
    rows = durable(rows)  # read once for the columns and once a round for the quantiles
    values = dict.fromkeys(c for c, _ in wanted.values())
    long = dimensioned(rows.select(*dict.fromkeys([*keys, *dimensions, *values])), dimensions)
    return with_quantiles(by_dimension(rows, dimensions, columns, keys), long, [*keys, "dimension", "value"], wanted)


def ranking_columns() -> list[Column]:
    """Rates of the choice among the first, NLL, the worst sum of probabilities, and the choices that
    weren't the engine's first by themselves."""
    rank, other = F.col("actual_rank"), F.col("actual_engine_rank") > 1
    rate = lambda c: F.avg(c.cast("double"))
    return [
        F.count("*").alias("decisions"), rate(rank == 1).alias("accuracy"), rate(rank <= 2).alias("top_2"), rate(rank <= 3).alias("top_3"), F.avg(1 / rank).alias("mrr"), F.avg("nll").alias("nll"),
        F.max(F.abs(1 - F.col("p_sum"))).alias("max_sum_error"), F.count_if(other).alias("non_first_decisions"), F.avg(F.when(other, (rank == 1).cast("double"))).alias("non_first_accuracy"), F.avg(F.when(other, 1 / rank)).alias("non_first_mrr"),
    ]


def macro(pred: DataFrame, metrics: tuple[str, ...] = MEANS, per: str = "player") -> DataFrame:
    """Means of the metrics over players, each player counting the same."""
    mine = pred.groupBy(per).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in metrics])
    return mine.agg(F.count("*").alias("players"), *[F.avg(c).alias(c) for c in metrics])


def rate_errors(pred: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    rates = [F.abs(F.avg(F.col(f"predicted_{f}").cast("double")) - F.avg(F.col(f"actual_{f}").cast("double"))).alias(f) for f in flags]
    return pred.agg(*rates)


def ece(pred: DataFrame, bins: int = 10, confidence: str = "top_p", correct: str = "exact", by: list[str] | None = None) -> DataFrame:
    """Expected calibration error of the first choice: bins of equal width, weighted by their rows."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = pred.groupBy(*(by or []), b.alias("_b")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return per.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def calibration(cand: DataFrame, p: str, bins: int = 10) -> DataFrame:
    """Bins of equal width with their bounds: rows, mean probability, rate of choices and Brier score."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    per = cand.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col("chosen").cast("double")).alias("chosen_rate"), F.avg(F.pow(F.col(p) - F.col("chosen").cast("int"), F.lit(2))).alias("brier")
    )
    return per.select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), "n", "mean_p", "chosen_rate", "brier")


def confusion(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    return pred.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def coverage_at(ranks: DataFrame, rank: str, most: int, by: list[str] | None = None) -> DataFrame:
    """Share of rows with a rank up to k for each k; a null rank is outside."""
    wide = ranks.groupBy(*(by or [])).agg(*[F.avg((F.coalesce(F.col(rank), F.lit(most + 1)) <= k).cast("double")).alias(f"_{k}") for k in range(1, most + 1)])
    return wide.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("coverage")) for k in range(1, most + 1)])).alias("x")).select(*(by or []), "x.*")


def smallest_k(coverage: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    each = coverage.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return each.groupBy(*(by or []), "threshold").agg(F.coalesce(F.min(F.when(F.col("coverage") >= F.col("threshold"), F.col("k"))).cast("string"), F.lit("unresolved")).alias("k"))


def correlations(players: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman over one row per player; null with fewer than three or a constant.

    Ranks share the mean of ties and come from counts of a range partition, so no task has all players.
    """
    known = durable(players.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL"))
    ranked = average_ranks(known, {"_x": "_rx", "_y": "_ry"})
    own = lambda a, b: F.when(F.count("*") >= 3, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    return ranked.agg(F.count("*").alias("n"), own("_x", "_y").alias("pearson"), own("_rx", "_ry").alias("spearman"))


def distribution(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count and share of each value, null as ``unknown``."""
    n = rows.groupBy(*(by or []), F.coalesce(F.col(value).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))


def style_cells(cand: DataFrame, p: str, attributes: tuple[str, ...], *, least: int = 20) -> DataFrame:
    """(player, phase, attribute) cells: optional and forced decisions, and distances of the policy's and
    the first choice's category rates from the player's.

    Attributes are unpivoted after each decision is reduced to its categories, so a shuffle carries
    a few rows per decision and attribute.
    """
    top = F.row_number().over(Window.partitionBy("decision_id").orderBy(F.desc(p), "move")) == 1
    own = cand.withColumn("_top", top)
    long = own.select("decision_id", "player", "phase", F.col(p).alias("_p"), "chosen", "_top", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("category")) for a in attributes])).alias("x")).select("*", "x.*")
    per = long.groupBy("decision_id", "player", "phase", "attribute", "category").agg(F.sum("_p").alias("mass"), F.bool_or("chosen").alias("human"), F.bool_or("_top").alias("top"))
    w = Window.partitionBy("decision_id", "attribute")
    per = per.withColumns({"_kinds": F.count("*").over(w)})
    free = F.col("_kinds") > 1
    rates = per.groupBy("player", "phase", "attribute", "category").agg(
        F.sum(F.when(free, F.col("human").cast("int"))).alias("h"), F.sum(F.when(free, F.col("mass"))).alias("m"), F.sum(F.when(free, F.col("top").cast("int"))).alias("t"),
        F.sum(F.when(free, F.pow(F.col("mass") - F.col("human").cast("int"), F.lit(2)))).alias("sq"), F.sum(F.when(free & F.col("human"), -F.log(F.greatest("mass", F.lit(FLOOR))))).alias("ll"),
        F.count_if(free & F.col("human")).alias("n"), F.count_if(~free).alias("f"),
    )
    cells = rates.groupBy("player", "phase", "attribute").agg(
        F.sum("n").alias("opportunities"), F.sum("f").alias("forced"), F.sum(F.abs(F.col("h") - F.col("m"))).alias("_pm"), F.sum(F.abs(F.col("h") - F.col("t"))).alias("_pt"), F.sum("sq").alias("_sq"), F.sum("ll").alias("_ll")
    )
    n = F.nullif(F.col("opportunities"), F.lit(0))
    return cells.select(
        "player", "phase", "attribute", "opportunities", "forced", (F.col("opportunities") >= least).alias("supported"),
        (F.col("_pm") / n / 2).alias("policy_tv"), (F.col("_pt") / n / 2).alias("argmax_tv"), (F.col("_sq") / n).alias("attribute_brier"), (F.col("_ll") / n).alias("attribute_nll"),
    )


def style_macro(cells: DataFrame) -> DataFrame:
    mine = cells.where("supported").groupBy("player").agg(F.count("*").alias("cells"), *[F.avg(c).alias(c) for c in ("policy_tv", "argmax_tv", "attribute_brier", "attribute_nll")])
    return mine.agg(F.count("*").alias("players"), F.avg("policy_tv").alias("macro_policy_tv"), F.avg("argmax_tv").alias("macro_argmax_tv"))


def style_vector(chosen: DataFrame, unit: list[str], flags: tuple[str, ...], *, structure: tuple[str, ...] = (), openings: dict[str, list[str]] | None = None) -> DataFrame:
    """Long (unit, family, field, value) of a unit's moves, in up to seven families.

    Rates of flags; shares of pieces, wings and phases; ``sequence``, how often a move repeats the piece
    or wing of the one before it in its game, or captures after a capture; ``pawn_structure``, means of
    the ``structure`` columns after a game's last move; and ``opening_choice``, the first moves of a
    game among the known ``openings`` of each colour. A rate without any support is zero.
    """
    game = Window.partitionBy(*unit, "game_id").orderBy("ply")
    prior = {f"_p_{c}": F.lag(c).over(game) for c in ("piece", "wing", "capture")}
    own = chosen.withColumns({**prior, "_last": F.lead("ply").over(game).isNull(), "_first": F.lag("ply").over(game).isNull()})
    number, paired = lambda c: c.cast("double"), F.col("_p_piece").isNotNull()
    cells: list[tuple[str, str, Column]] = [("behaviour", f, F.avg(number(F.col(f)))) for f in flags]
    steps = {"repeat_piece": F.col("piece") == F.col("_p_piece"), "repeat_wing": F.col("wing") == F.col("_p_wing"), "capture_after_capture": F.col("capture") & F.col("_p_capture")}
    cells += [("sequence", name, F.avg(F.when(paired, number(c)))) for name, c in steps.items()]
    cells += [("pawn_structure", c, F.avg(F.when(F.col("_last"), F.col(c)))) for c in structure]
    for color, known in (openings or {}).items():
        start = F.col("_first") & (F.col("color") == color)
        named = [(f"{color}_{o}", F.col("opening") == o) for o in known] + [(f"{color}_other", ~F.col("opening").isin(*known))]
        cells += [("opening_choice", name, F.avg(F.when(start, number(c)))) for name, c in named]
    total = own.groupBy(*unit).agg(F.count("*").alias("_n"), *[F.coalesce(c, F.lit(0.0)).alias(f"_{i}") for i, (_, _, c) in enumerate(cells)])
    parts = [F.struct(F.lit(family).alias("family"), F.lit(name).alias("field"), F.col(f"_{i}").alias("value")) for i, (family, name, _) in enumerate(cells)]
    rates = total.select(*unit, F.explode(F.array(*parts)).alias("x")).select(*unit, "x.*")
    kinds = chosen.select(*unit, F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.col(k).alias("field")) for k in ("piece", "wing", "phase")])).alias("x")).select(*unit, "x.*")
    shares = kinds.groupBy(*unit, "family", "field").agg(F.count("*").alias("n")).join(total.select(*unit, "_n"), unit).select(*unit, "family", "field", (F.col("n") / F.col("_n")).alias("value"))
    return rates.unionByName(shares)


def style_reference(vectors: DataFrame, *, floor: float = 0.05, structure_floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(scale per field over all blocks, centroid per player); structure counts have a floor of their own."""
    least = F.when(F.col("family") == "pawn_structure", structure_floor).otherwise(floor)
    scale = vectors.groupBy("family", "field").agg(F.stddev_pop("value").alias("_s")).select("family", "field", F.greatest(least, F.col("_s")).alias("scale"))
    return scale, vectors.groupBy("player", "family", "field").agg(F.avg("value").alias("centre"))


def _spread(fields: list[tuple[str, str]], gap: Callable[[Column, int], Column], held: Column) -> Column:
    """The mean over families of the mean over fields of ``gap``, without the fields for which it is null.

    ``held`` is an array by field; ``gap`` gets its element and the field's number.
    """
    gaps = F.transform(held, lambda x, i: gap(x, i))
    total, known = F.lit(0.0), F.lit(0)
    for family in dict.fromkeys(f for f, _ in fields):
        at = [i for i, (f, _) in enumerate(fields) if f == family]
        own = F.filter(F.slice(gaps, at[0] + 1, len(at)), lambda x: x.isNotNull())
        mean = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(own), F.lit(0))
        total, known = total + F.coalesce(mean, F.lit(0.0)), known + mean.isNotNull().cast("int")
    return total / F.nullif(known, F.lit(0))


def style_identity(vectors: DataFrame, scale: DataFrame, centroids: DataFrame, unit: str, *, most_groups: int = 2_048, broadcast_players: int = 100_000) -> DataFrame:
    """(unit, true_player, distance, true_place, best, best_distance): how far each unit is from its own player's
    centroid, the place of that player among all by distance (rounded to 9 digits, ties by name), and
    the player that is nearest. The distance is the mean over families of the mean squared standardised
    difference; fields that one side lacks don't count, and pairs without a common field have no place.

    The search is exact without comparing every unit with every player. Centroids are put in groups
    of those nearest to the same pivot (about the root of their number, drawn by hash) that have the same
    fields; a group's least and greatest value of each field bound the distances of its members. Groups that
    are nearer than the true player for certain are counted as wholes, those that are farther for certain
    only matter where they may hold the nearest, and just the rest is compared one by one. The bounds of all
    groups are one broadcast row, of ``most_groups`` pivots at most.
    """
    fields = [(r["family"], r["field"]) for r in scale.select("family", "field").orderBy("family", "field").collect()]
    if not fields:
        nothing = F.lit(None)
        return vectors.select(unit, F.col("player").alias("true_player"), nothing.cast("double").alias("distance"), nothing.cast("bigint").alias("true_place"), nothing.cast("string").alias("best"), nothing.cast("double").alias("best_distance")).limit(0)
    scaled = lambda df, value: df.join(F.broadcast(scale), ["family", "field"]).withColumn("_z", F.col(value) / F.col("scale"))
    array = F.array(*[F.max(F.when((F.col("family") == family) & (F.col("field") == field), F.col("_z"))) for family, field in fields])
    units = durable(scaled(vectors, "value").groupBy(unit, F.col("player").alias("true_player")).agg(array.alias("_u")))
    players = durable(scaled(centroids, "centre").groupBy("player").agg(array.alias("_c")))
    n_players = players.count()

    pivots = players.orderBy(F.xxhash64("player"), "player").limit(min(most_groups, max(1, math.isqrt(n_players)))).select("_c")
    pivots = pivots.agg(F.collect_list("_c").alias("_pivots"))
    square = lambda other: lambda x, i: (x - F.get(other, i)) * (x - F.get(other, i))
    near = F.array_min(F.transform("_pivots", lambda p, k: F.struct(F.coalesce(_spread(fields, square(p), F.col("_c")), F.lit(float("inf"))).alias("d"), k.alias("k"))))["k"]
    pattern = F.array_join(F.transform("_c", lambda x: F.when(x.isNull(), "0").otherwise("1")), "")
    parts = 16  # a bounded row is there once for each part of the rows that it meets, which makes the meeting a hash join
    each = lambda df: F.broadcast(durable(df.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    placed = players.withColumn("_part", part("player")).join(each(pivots), "_part").select("player", "_c", F.concat_ws(":", near, pattern).alias("_group"))
    placed = durable(placed)
    ends = [F.array(*[f(F.get("_c", F.lit(i))) for i in range(len(fields))]).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
    groups = placed.groupBy("_group").agg(F.count("*").alias("n"), *ends)
    groups = groups.agg(F.collect_list(F.struct("_group", "n", "lo", "hi")).alias("_groups"))

    distance = F.round(_spread(fields, square(F.col("_c")), F.col("_u")), 9)
    own = units.join(placed.select(F.col("player").alias("true_player"), "_c"), "true_player", "left").withColumn("distance", distance).drop("_c").withColumn("_part", part(unit))
    low = lambda g: lambda x, i: F.pow(F.greatest(F.get(g["lo"], i) - x, x - F.get(g["hi"], i), F.lit(0.0)), F.lit(2)) + x * 0 + F.get(g["lo"], i) * 0
    high = lambda g: lambda x, i: F.pow(F.greatest(F.abs(F.get(g["lo"], i) - x), F.abs(F.get(g["hi"], i) - x)), F.lit(2)) + x * 0 + F.get(g["lo"], i) * 0
    slack = 2e-9  # of the rounding
    bounds = F.transform("_groups", lambda g: F.struct(g["_group"].alias("g"), g["n"].alias("n"), (_spread(fields, low(g), F.col("_u")) - slack).alias("low"), (_spread(fields, high(g), F.col("_u")) + slack).alias("high")))
    bounded = own.join(each(groups), "_part").select(unit, "true_player", "_u", "distance", F.filter(bounds, lambda b: b["low"].isNotNull()).alias("_b"))
    reach = F.array_min(F.transform("_b", lambda b: b["high"]))
    nearer = F.aggregate(F.filter("_b", lambda b: b["high"] < F.col("distance")), F.lit(0).cast("bigint"), lambda s, b: s + b["n"])
    open_for_rank = lambda b: F.coalesce((b["low"] <= F.col("distance")) & (b["high"] >= F.col("distance")), F.lit(False))
    bounded = bounded.select(unit, "true_player", "_u", "distance", nearer.alias("_nearer"), F.explode_outer(F.transform(F.filter("_b", lambda b: (b["low"] <= reach) | open_for_rank(b)), lambda b: F.struct(b["g"].alias("_group"), open_for_rank(b).alias("_open")))).alias("_x")).select("*", "_x.*").drop("_x")
    held = F.broadcast(placed) if n_players <= broadcast_players else placed
    met = bounded.join(held, "_group", "left").withColumn("_d", distance)
    before = F.col("_open") & ((F.col("_d") < F.col("distance")) | ((F.col("_d") == F.col("distance")) & (F.col("player") < F.col("true_player"))))
    found = met.groupBy(unit, "true_player").agg(
        F.first("distance").alias("distance"), F.first("_nearer").alias("_nearer"), F.count_if(before).alias("_before"), F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "player"))).alias("_best")
    )
    place = F.when(F.col("distance").isNotNull(), F.col("_nearer") + F.col("_before") + 1)
    return found.select(unit, "true_player", "distance", place.alias("true_place"), F.col("_best.player").alias("best"), F.col("_best._d").alias("best_distance"))


def style_distance(left: DataFrame, right: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over families of the mean absolute standardised error, clipped at 4 and divided by 4."""
    joined = left.withColumnRenamed("value", "_a").join(right.withColumnRenamed("value", "_b"), [*keys, "family", "field"], "full_outer").join(scale, ["family", "field"])
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))) / F.col("scale")
    per = joined.groupBy(*keys, "family").agg((F.least(F.lit(4.0), F.avg(gap)) / 4).alias("d"))
    return per.groupBy(*keys).agg(F.avg("d").alias("distance"))
