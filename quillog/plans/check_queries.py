"""Queries of filters and validation over the decision log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.operators import checks, splits
from quillog.sources.bindings import LOG_SQL, candidates, decisions
from quillog.session import table

from .registry import query

GAMES_SQL = LOG_SQL + ", games AS (SELECT player, game_id, played_at, count(*) AS n_decisions, max(ply) AS plies, avg(rating) AS rating, count_if(phase = 'O') AS n_open FROM dec GROUP BY ALL)"


def games_of(dec):
    return dec.groupBy("player", "game_id", "played_at").agg(
        F.count("*").alias("n_decisions"), F.max("ply").alias("plies"), F.avg("rating").alias("rating"), F.count_if(F.col("phase") == "O").alias("n_open")
    )


def games(spark, sf_dir):
    return games_of(decisions(spark, sf_dir))


@query("flt_player", LOG_SQL + "SELECT decision_id, player, ply FROM dec WHERE lower(player) = lower('PLAYER7')")
def flt_player(spark, sf_dir):
    return decisions(spark, sf_dir).where(F.lower("player") == F.lower(F.lit("PLAYER7"))).select("decision_id", "player", "ply")


@query("flt_eligibility", LOG_SQL + """, e AS (SELECT *, bool_and(rating >= -900) OVER (PARTITION BY game_id) AS all_rated FROM dec)
  SELECT decision_id, game_id FROM e WHERE all_rated AND played_at > TIMESTAMP '1996-01-01' AND played_at <= TIMESTAMP '1999-06-01' AND time_control <> '5-LOW'""")
def flt_eligibility(spark, sf_dir):
    """Left-open window, a control, and a rating rule that all rows of a game must meet."""
    whole = F.bool_and(F.col("rating") >= -900).over(Window.partitionBy("game_id"))
    own = decisions(spark, sf_dir).withColumn("all_rated", whole)
    inside = (F.col("played_at") > F.lit("1996-01-01").cast("timestamp")) & (F.col("played_at") <= F.lit("1999-06-01").cast("timestamp"))
    return own.where(F.col("all_rated") & inside & (F.col("time_control") != "5-LOW")).select("decision_id", "game_id")


@query("flt_reject_reason", LOG_SQL + """SELECT player, CASE WHEN phase = 'P' THEN 'unrated' WHEN opening = 'A6' THEN 'variant' WHEN time_control = '5-LOW' THEN 'speed'
  WHEN rating < 0 THEN 'rating' WHEN played_at <= TIMESTAMP '1996-01-01' THEN 'date' ELSE 'eligible' END AS reason, count(*) AS n FROM dec GROUP BY ALL""")
def flt_reject_reason(spark, sf_dir):
    reason = (
        F.when(F.col("phase") == "P", "unrated").when(F.col("opening") == "A6", "variant").when(F.col("time_control") == "5-LOW", "speed")
        .when(F.col("rating") < 0, "rating").when(F.col("played_at") <= F.lit("1996-01-01").cast("timestamp"), "date").otherwise("eligible")
    )
    return decisions(spark, sf_dir).groupBy("player", reason.alias("reason")).agg(F.count("*").alias("n"))


ROLES = {
    "inference": ["phase", "time_control", "rating", "opening", "engine_rank", "score_cp", "base_logit"],
    "observed": ["move", "piece", "wing", "capture", "check", "trade", "castle", "pressure"],
    "diagnostic": ["chosen_rank", "chosen_cp", "behind_best", "in_top_3"],
}
_ROLE = lambda cs: "{" + ", ".join(f"'{c}': \"{c}\"" for c in cs) + "}"


@query("prj_feature_roles", LOG_SQL + ", f AS (SELECT *, max(engine_rank) FILTER (chosen) OVER w AS chosen_rank, max(score_cp) FILTER (chosen) OVER w AS chosen_cp, max(score_cp) OVER w - score_cp AS behind_best, max(engine_rank) FILTER (chosen) OVER w <= 3 AS in_top_3 FROM cand WINDOW w AS (PARTITION BY decision_id)) SELECT decision_id, " + ", ".join(f'"{c}"' for cs in ROLES.values() for c in cs) + " FROM f WHERE chosen")
def prj_feature_roles(spark, sf_dir):
    """One row per decision in three projections: what is known before it, what was seen, what it is judged by."""
    w = Window.partitionBy("decision_id")
    cand = candidates(spark, sf_dir)
    rank, cp = F.max(F.when(F.col("chosen"), F.col("engine_rank"))).over(w), F.max(F.when(F.col("chosen"), F.col("score_cp"))).over(w)
    full = cand.withColumns({"chosen_rank": rank, "chosen_cp": cp, "behind_best": F.max("score_cp").over(w) - F.col("score_cp"), "in_top_3": rank <= 3}).where("chosen")
    checks.require_no_leakage(ROLES["inference"])
    return full.select("decision_id", *[c for role in ROLES.values() for c in role])


@query("flt_cohort_subset", LOG_SQL + """SELECT count(*) AS n, count_if(player NOT IN ('Player1', 'Player2')) AS unseen, count_if(player NOT IN ('Player1', 'Player2') AND played_at > TIMESTAMP '1999-01-01') AS unseen_fresh,
  count_if(player IN ('Player1', 'Player2') AND played_at > TIMESTAMP '1999-01-01') AS known_fresh FROM dec""")
def flt_cohort_subset(spark, sf_dir):
    known, fresh = F.col("player").isin("Player1", "Player2"), F.col("played_at") > F.lit("1999-01-01").cast("timestamp")
    return decisions(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(~known).alias("unseen"), F.count_if(~known & fresh).alias("unseen_fresh"), F.count_if(known & fresh).alias("known_fresh"))


@query("chk_leakage_fields", LOG_SQL + "SELECT 'chosen' AS field, count(chosen) AS filled FROM cand UNION ALL SELECT 'is_capture', count(capture) FROM cand UNION ALL SELECT 'is_check', count(\"check\") FROM cand UNION ALL SELECT 'is_castle', count(castle) FROM cand UNION ALL SELECT 'is_queen_trade', count(trade) FROM cand UNION ALL SELECT 'piece_moved', count(piece) FROM cand UNION ALL SELECT 'time_pressure', count(pressure) FROM cand")
def chk_leakage_fields(spark, sf_dir):
    """Which fields of the candidate table, in the feature table's names, may not be features, and how many rows fill them."""
    names = {"capture": "is_capture", "check": "is_check", "castle": "is_castle", "trade": "is_queen_trade", "piece": "piece_moved", "pressure": "time_pressure"}
    cand = candidates(spark, sf_dir).withColumnsRenamed(names)
    leaked = checks.leaked_fields(cand.columns)
    filled = cand.agg(*[F.count(c).alias(c) for c in leaked])
    return filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in leaked])).alias("x")).select("x.*")


@query("chk_one_positive", LOG_SQL + "SELECT decision_id, count_if(chosen AND quantity > 20) AS positives FROM cand GROUP BY 1 HAVING positives <> 1")
def chk_one_positive(spark, sf_dir):
    """Violations once choices of small quantities are struck out."""
    return checks.not_one_positive(candidates(spark, sf_dir).withColumn("chosen", F.col("chosen") & (F.col("quantity") > 20)))


@query("chk_candidate_set", LOG_SQL + """, k AS (SELECT * FROM cand WHERE engine_rank <= 5 AND NOT (engine_rank = 3 AND decision_id % 40 = 0)), n AS (SELECT decision_id, count(*) AS avail FROM cand GROUP BY 1)
  SELECT decision_id, min(engine_rank) AS low, max(engine_rank) AS high, count(*) AS n, count(DISTINCT engine_rank) AS ranks, count(DISTINCT move) AS moves, max(avail) AS available FROM k JOIN n USING (decision_id)
  GROUP BY 1 HAVING NOT (low = 1 AND high = least(5, available) AND n = least(5, available) AND ranks = least(5, available) AND moves = least(5, available))""")
def chk_candidate_set(spark, sf_dir):
    cand = candidates(spark, sf_dir).withColumn("available", F.count("*").over(Window.partitionBy("decision_id")))
    kept = cand.where((F.col("engine_rank") <= 5) & ~((F.col("engine_rank") == 3) & (F.col("decision_id") % 40 == 0)))
    return checks.bad_candidate_sets(kept, 5, available=F.col("available"))


@query("chk_join_consistency", LOG_SQL + """, a AS (SELECT decision_id, engine_rank, move, piece FROM cand),
  b AS (SELECT decision_id + CASE WHEN decision_id % 500 = 0 THEN 100000000 ELSE 0 END AS decision_id, engine_rank, CASE WHEN decision_id % 100 = 0 THEN 'x' ELSE move END AS move, piece FROM cand WHERE NOT (engine_rank = 1 AND decision_id % 77 = 0)
    UNION ALL SELECT decision_id, engine_rank, move, piece FROM cand WHERE engine_rank = 2 AND decision_id % 91 = 0 AND decision_id % 500 <> 0),
  o AS (SELECT decision_id, engine_rank, count(*) AS n, min(move) AS mn, max(move) AS mx, min(piece) AS pn, max(piece) AS px FROM b GROUP BY ALL)
  SELECT count_if(a.decision_id IS NOT NULL AND n IS NOT NULL AND NOT (a.move = mn AND a.move = mx)) AS move, count_if(a.decision_id IS NOT NULL AND n IS NOT NULL AND NOT (piece = pn AND piece = px)) AS piece, count_if(a.decision_id IS NOT NULL AND n IS NOT NULL) AS joined,
   count_if(n IS NULL) AS left_only, count_if(a.decision_id IS NULL) AS right_only, count_if(n > 1) AS repeated_ranks, (SELECT count(*) FROM (SELECT decision_id FROM b GROUP BY 1 HAVING count_if(engine_rank = 1) = 0)) AS without_first
  FROM a FULL JOIN o ON a.decision_id = o.decision_id AND a.engine_rank = o.engine_rank""")
def chk_join_consistency(spark, sf_dir):
    """The other side has altered moves, decisions without a partner, first ranks left out and ranks twice."""
    cand = candidates(spark, sf_dir).select("decision_id", "engine_rank", "move", "piece")
    k = F.col("decision_id")
    other = cand.where(~((F.col("engine_rank") == 1) & (k % 77 == 0))).withColumn("move", F.when(k % 100 == 0, F.lit("x")).otherwise(F.col("move")))
    other = other.withColumn("decision_id", k + F.when(k % 500 == 0, 100_000_000).otherwise(0))
    again = cand.where((F.col("engine_rank") == 2) & (k % 91 == 0) & (k % 500 != 0))
    return checks.join_mismatches(cand, other.unionByName(again), ["decision_id", "engine_rank"], ["move", "piece"])


@query("chk_probabilities", LOG_SQL + """, p AS (SELECT decision_id, CASE WHEN decision_id % 50 = 0 AND engine_rank = 1 THEN 1.5 ELSE 1.0 / count(*) OVER (PARTITION BY decision_id) END AS p FROM cand)
  SELECT decision_id, count_if(p < 0 OR p > 1) AS invalid, round(sum(p), 6) AS total FROM p GROUP BY 1 HAVING invalid > 0 OR abs(sum(p) - 1) > 1e-6""")
def chk_probabilities(spark, sf_dir):
    share = 1.0 / F.count("*").over(Window.partitionBy("decision_id"))
    p = candidates(spark, sf_dir).withColumn("p", F.when((F.col("decision_id") % 50 == 0) & (F.col("engine_rank") == 1), 1.5).otherwise(share))
    return checks.bad_probabilities(p, "p").withColumn("total", F.round("total", 6))


@query("chk_complete_games", LOG_SQL + """, d AS (SELECT *, CASE WHEN month(played_at) % 2 = 0 THEN 'white' ELSE 'black' END AS color, count(*) OVER (PARTITION BY game_id) AS n FROM dec),
  g AS (SELECT game_id, max(color) AS color, max(CASE WHEN n = 1 AND color = 'black' THEN 1 WHEN color = 'white' THEN 2 * n - 1 ELSE 2 * n END) AS total FROM d GROUP BY 1),
  k AS (SELECT game_id, CASE WHEN ply = 3 AND n % 7 = 0 THEN 1000 WHEN color = 'white' THEN 2 * ply - 1 ELSE 2 * ply END AS ply, CASE WHEN decision_id % 400 = 0 THEN 'other' ELSE color END AS color, time_control FROM d WHERE NOT (ply = 2 AND n % 5 = 0)),
  j AS (SELECT g.game_id, g.total, CASE WHEN g.color = 'white' THEN 1 ELSE 2 END AS s, k.ply, k.game_id IS NOT NULL AND (k.color <> g.color OR k.time_control NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) AS odd FROM g LEFT JOIN k USING (game_id)),
  a AS (SELECT game_id, max(greatest(0, (total - s + 2) // 2)) AS wanted, count(DISTINCT CASE WHEN ply >= s AND ply <= total AND (ply - s) % 2 = 0 THEN ply END) AS there, count(DISTINCT CASE WHEN NOT (ply >= s AND ply <= total AND (ply - s) % 2 = 0) THEN ply END) AS extra, count_if(odd) AS disagreeing FROM j GROUP BY 1)
  SELECT game_id, (wanted - there)::bigint AS missing, extra, disagreeing, wanted = 0 AS "empty" FROM a WHERE wanted > there OR extra > 0 OR disagreeing > 0 OR wanted = 0""")
def chk_complete_games(spark, sf_dir):
    """Games of even months are played as white; some decisions are left out, misplaced or of the other colour."""
    w = Window.partitionBy("game_id")
    color = F.when(F.month("played_at") % 2 == 0, "white").otherwise("black")
    own = decisions(spark, sf_dir).withColumns({"color": color, "n": F.count("*").over(w)})
    white = F.col("color") == "white"
    total = F.when((F.col("n") == 1) & ~white, 1).when(white, 2 * F.col("n") - 1).otherwise(2 * F.col("n"))
    whole = own.groupBy("game_id").agg(F.max("color").alias("color"), F.max(total).alias("total_plies"))
    ply = F.when((F.col("ply") == 3) & (F.col("n") % 7 == 0), 1000).when(white, 2 * F.col("ply") - 1).otherwise(2 * F.col("ply"))
    kept = own.where(~((F.col("ply") == 2) & (F.col("n") % 5 == 0))).select(
        "game_id", ply.alias("ply"), F.when(F.col("decision_id") % 400 == 0, "other").otherwise(F.col("color")).alias("color"), "time_control"
    )
    return checks.incomplete_games(whole, kept, controls=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


_SELECTION_SQL = GAMES_SQL + """, r AS (SELECT player, game_id, row_number() OVER (PARTITION BY player ORDER BY played_at DESC, game_id DESC) AS i, substr(player, 7)::int AS num FROM games),
  sel AS (SELECT player, CASE WHEN num % 5 = 0 THEN 'evaluation' ELSE 'development' END AS role, split_part(game_id, '-', 2) || '-' || (num % 2) AS game, CASE WHEN i <= 5 THEN 'evaluation' WHEN i <= 10 + num % 3 THEN 'validation' ELSE 'history' END AS split FROM r WHERE i <= 30)"""


@query("chk_split_overlap", _SELECTION_SQL + """, ov AS (SELECT game FROM sel GROUP BY 1 HAVING count_if(split = 'history') > 0 AND count_if(split <> 'history') > 0), rv AS (SELECT DISTINCT game FROM sel WHERE role = 'evaluation' AND split <> 'history')
  SELECT 'error' AS kind, NULL::varchar AS player, game FROM ov UNION ALL SELECT DISTINCT 'quarantine', player, game FROM sel WHERE role = 'development' AND split = 'validation' AND game IN (SELECT game FROM rv)""")
def chk_split_overlap(spark, sf_dir):
    """Games are months that players of the same parity share: those that cross history and held-out
    splits are errors, and development games that evaluation players hold out are quarantined."""
    number = F.substring("player", 7, 9).cast("int")
    w = Window.partitionBy("player").orderBy(F.desc("played_at"), F.desc("game_id"))
    taken = games(spark, sf_dir).withColumns({"i": F.row_number().over(w), "num": number}).where("i <= 30")
    split = F.when(F.col("i") <= 5, "evaluation").when(F.col("i") <= 10 + F.col("num") % 3, "validation").otherwise("history")
    game = F.concat_ws("-", F.split_part("game_id", F.lit("-"), F.lit(2)), (F.col("num") % 2).cast("string"))
    selection = taken.select("player", F.when(F.col("num") % 5 == 0, "evaluation").otherwise("development").alias("role"), game.alias("game"), split.alias("split"))
    errors = checks.history_overlap(selection).select(F.lit("error").alias("kind"), F.lit(None).cast("string").alias("player"), "game")
    return errors.unionByName(checks.quarantined(selection).select(F.lit("quarantine").alias("kind"), "player", "game"))


@query("chk_opening_leakage", LOG_SQL + """, f AS (SELECT player, CASE WHEN phase <> 'P' THEN opening END AS tag FROM dec WHERE ply = 1), c AS (SELECT player, tag, count(*) AS n FROM f WHERE tag IS NOT NULL GROUP BY ALL),
  k AS (SELECT player, tag, n, row_number() OVER (PARTITION BY player ORDER BY n DESC, tag) AS i FROM c)
  SELECT player, sum(n)::bigint AS tagged, count(*) AS tags, string_agg(tag, ',' ORDER BY i) FILTER (i <= 5) AS examples FROM k GROUP BY 1""")
def chk_opening_leakage(spark, sf_dir):
    tag = F.when(F.col("phase") != "P", F.col("opening"))
    counts = decisions(spark, sf_dir).where("ply = 1").select("player", tag.alias("tag")).where("tag IS NOT NULL").groupBy("player", "tag").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("i", F.row_number().over(Window.partitionBy("player").orderBy(F.desc("n"), "tag")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= 5, F.struct("i", "tag")))), lambda x: x["tag"]), ",")
    return ranked.groupBy("player").agg(F.sum("n").alias("tagged"), F.count("*").alias("tags"), top.alias("examples"))


@query("audit_fingerprint", "SELECT count(*) AS rows, true AS same, false AS changed_same FROM orders")
def audit_fingerprint(spark, sf_dir):
    """The fingerprint ignores row order and notices a changed value."""
    orders = table(spark, sf_dir, "orders")
    a = checks.fingerprint(orders)
    b = checks.fingerprint(orders.repartition(5)).toDF("rows_b", "xor_b", "total_b")
    c = checks.fingerprint(orders.withColumn("o_custkey", F.when(F.col("o_orderkey") == 5, -1).otherwise(F.col("o_custkey")))).toDF("rows_c", "xor_c", "total_c")
    one = a.crossJoin(b).crossJoin(c)  # three single rows
    return one.select("rows", ((F.col("xor") == F.col("xor_b")) & (F.col("total") == F.col("total_b"))).alias("same"), (F.col("xor") == F.col("xor_c")).alias("changed_same"))


@query("src_conflict_dedupe", "SELECT l_orderkey, l_linenumber, count(*) AS versions FROM (SELECT DISTINCT * FROM lineitem) GROUP BY 1, 2 HAVING versions > 1")
def src_conflict_dedupe(spark, sf_dir):
    return checks.conflicting_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("set_union_players", LOG_SQL + "SELECT player, count(*) AS n FROM dec WHERE player IN ('Player1', 'Player2') GROUP BY 1")
def set_union_players(spark, sf_dir):
    dec = decisions(spark, sf_dir)
    parts = dec.where(F.col("player") == "Player1").unionByName(dec.where(F.col("player") == "Player2"))
    return parts.groupBy("player").agg(F.count("*").alias("n"))


@query("set_intersect_common", LOG_SQL + "SELECT decision_id FROM dec WHERE phase = 'F' AND decision_id IN (SELECT decision_id FROM cand WHERE engine_rank >= 3)")
def set_intersect_common(spark, sf_dir):
    left = decisions(spark, sf_dir).where("phase = 'F'").select("decision_id")
    return left.intersect(candidates(spark, sf_dir).where("engine_rank >= 3").select("decision_id"))


@query("set_except_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def set_except_missing(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").exceptAll(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct())


@query("set_equality", LOG_SQL + "SELECT decision_id, 'left' AS side FROM dec WHERE decision_id NOT IN (SELECT decision_id FROM cand WHERE engine_rank >= 2)")
def set_equality(spark, sf_dir):
    return checks.exact_complement(decisions(spark, sf_dir), candidates(spark, sf_dir).where("engine_rank >= 2"), ["decision_id"])


@query("srt_total_order", LOG_SQL + "SELECT decision_id, move, (row_number() OVER (PARTITION BY decision_id ORDER BY score_cp DESC, engine_rank, move))::int AS place FROM cand")
def srt_total_order(spark, sf_dir):
    order = Window.partitionBy("decision_id").orderBy(F.desc("score_cp"), "engine_rank", "move")
    return candidates(spark, sf_dir).select("decision_id", "move", F.row_number().over(order).alias("place"))


@query("srt_topk", LOG_SQL + "SELECT position_key, count(*) AS n FROM cand WHERE chosen GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def srt_topk(spark, sf_dir):
    return candidates(spark, sf_dir).where("chosen").groupBy("position_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "position_key").limit(5)


@query("lim_first_n", LOG_SQL + "SELECT decision_id, played_at, ply FROM dec WHERE player = 'Player3' ORDER BY played_at, game_id, ply LIMIT 100")
def lim_first_n(spark, sf_dir):
    own = decisions(spark, sf_dir).where("player = 'Player3'").orderBy("played_at", "game_id", "ply").limit(100)
    return own.select("decision_id", "played_at", "ply")
