"""Queries of the column expressions, over positions that are derived from the order keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillog.functions import scalars as s
from quillog.sources.bindings import LOG_SQL, candidates
from quillog.session import table

from .registry import query

# A position for every order: the 64 hex digits of its key's SHA-256 stand for the squares.
HEX, MEN = "0123456789abcdef", "PpnBRrQ.......kK"


def placed(rows: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """``rows`` with the position (``fen``) and move (``uci``) of their key."""
    k = F.col(key)
    rows = rows.withColumn("_men", F.translate(F.sha2(k.cast("string"), 256), HEX, MEN))
    board = F.col("_men")
    placement = F.concat_ws("/", *[F.substring(board, 8 * i + 1, 8) for i in range(8)])
    for n in range(8, 0, -1):
        placement = F.replace(placement, F.lit("." * n), F.lit(str(n)))
    castling = F.when(k % 3 == 0, "KQkq").when(k % 3 == 1, "Kq").otherwise("-")
    passant = F.when(k % 5 == 0, "e6").when(k % 5 == 1, "d3").otherwise("-")
    fen = F.concat_ws(" ", placement, F.when(k % 2 == 0, "w").otherwise("b"), castling, passant, F.lit("0"), (k % 80 + 1).cast("string"))
    step = lambda d: F.floor(k / d) % 8
    letter = lambda d: F.substring(F.lit("abcdefgh"), 1, 8).substr((step(d) + 1).cast("int"), F.lit(1))
    uci = F.concat(letter(1), (step(8) + 1).cast("string"), letter(64), (step(512) + 1).cast("string"), F.when(k % 11 == 0, "q").otherwise(""))
    return rows.withColumns({"fen": fen, "uci": uci}).drop("_men")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return placed(orders).withColumns({"board": s.squares(F.col("fen")), "mover": s.side(F.col("fen"))})


POS_SQL = f"""
WITH hexed AS (
  SELECT o_orderkey, o_totalprice, o_custkey, translate(sha256(o_orderkey::varchar), '{HEX}', '{MEN}') AS board FROM orders),
pos AS (
  SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'w' ELSE 'b' END AS mover,
    CASE o_orderkey % 3 WHEN 0 THEN 'KQkq' WHEN 1 THEN 'Kq' ELSE '-' END AS castling,
    CASE o_orderkey % 5 WHEN 0 THEN 'e6' WHEN 1 THEN 'd3' ELSE '-' END AS passant,
    substr('abcdefgh', (o_orderkey % 8 + 1)::int, 1) || ((o_orderkey // 8) % 8 + 1) AS src,
    substr('abcdefgh', ((o_orderkey // 64) % 8 + 1)::int, 1) || ((o_orderkey // 512) % 8 + 1) AS dst,
    (o_orderkey % 8)::int AS sf, ((o_orderkey // 8) % 8 + 1)::int AS sr, ((o_orderkey // 64) % 8)::int AS df, ((o_orderkey // 512) % 8 + 1)::int AS dr,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Q' END AS promotion
  FROM hexed),
men AS (
  SELECT *, substr(board, (8 - sr) * 8 + sf + 1, 1) AS at_src, upper(at_src) AS piece, upper(substr(board, (8 - dr) * 8 + df + 1, 1)) AS target,
    CASE WHEN target <> '.' THEN target WHEN piece = 'P' AND passant = dst AND sf <> df THEN 'P' END AS captured
  FROM pos)
"""


def _placement() -> str:
    expr = "concat_ws('/', " + ", ".join(f"substr(board, {8 * i + 1}, 8)" for i in range(8)) + ")"
    for n in range(8, 0, -1):
        expr = f"replace({expr}, '{'.' * n}', '{n}')"
    return expr


FEN = f"({_placement()} || ' ' || mover || ' ' || castling || ' ' || passant || ' 0 ' || (o_orderkey % 80 + 1))"
COUNT = "length(regexp_replace(board, '[^{}]', '', 'g'))::int"


@query("prj_time_control", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 600 END AS initial,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 15 END AS increment,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_custkey % 600) || '+' || (o_custkey % 15) END AS rebuilt FROM orders""")
def prj_time_control(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("untimed")).otherwise(F.concat_ws("+", F.col("o_custkey") % 600, F.col("o_custkey") % 15))
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", s.time_control(text).alias("tc"))
    rebuilt = F.when(F.col("tc.initial").isNotNull(), F.concat_ws("+", "tc.initial", "tc.increment"))
    return parsed.select("o_orderkey", "tc.initial", "tc.increment", rebuilt.alias("rebuilt"))


@query("prj_opening_family", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE trim(split_part(o_orderpriority || ' Defence: Main ' || o_orderstatus, ':', 1)) END AS family FROM orders""")
def prj_opening_family(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 7 == 0, F.lit("  : Main")).otherwise(F.concat("o_orderpriority", F.lit(" Defence: Main "), "o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.opening_family(name).alias("family"))


@query("prj_position_key", POS_SQL + f"SELECT o_orderkey, array_to_string(string_split({FEN}, ' ')[1:4], ' ') AS position_key FROM pos")
def prj_position_key(spark, sf_dir):
    return positions(spark, sf_dir).select("o_orderkey", s.position_key(F.col("fen")).alias("position_key"))


@query("prj_bench_key", POS_SQL + f"SELECT o_orderkey, array_to_string(string_split({FEN}, ' ')[1:5], ' ') || ' 1' AS bench_key FROM pos")
def prj_bench_key(spark, sf_dir):
    return positions(spark, sf_dir).select("o_orderkey", s.bench_key(F.col("fen")).alias("bench_key"))


@query("prj_cache_key", POS_SQL + f"""SELECT o_orderkey, sha256('{{"nodes":20000,"position":"' || array_to_string(string_split({FEN}, ' ')[1:4], ' ') || '","version":"e1"}}') AS cache_key FROM pos""")
def prj_cache_key(spark, sf_dir):
    key = s.cache_key(position=s.position_key(F.col("fen")), nodes=F.lit(20000), version=F.lit("e1"))
    return positions(spark, sf_dir).select("o_orderkey", key.alias("cache_key"))


@query("prj_dedup_lookup", LOG_SQL + """, keys AS (SELECT DISTINCT position_key FROM cand), known AS (SELECT position_key FROM keys WHERE position_key LIKE 'A%'),
  evaluated AS (SELECT position_key, length(position_key) * 10 AS value, position_key IN (SELECT position_key FROM known) AS hit FROM keys)
  SELECT hit, count(*) AS lookups, count(DISTINCT c.position_key) AS unique_keys, sum(value)::bigint AS total_value FROM cand c JOIN evaluated USING (position_key) GROUP BY hit""")
def prj_dedup_lookup(spark, sf_dir):
    """Each distinct key is evaluated once, unless it is known, and joined back to all its rows."""
    cand = candidates(spark, sf_dir).select("position_key")
    keys = cand.distinct()
    known = keys.where(F.col("position_key").startswith("A")).withColumn("hit", F.lit(True))
    fresh = keys.join(known, "position_key", "left_anti").withColumn("hit", F.lit(False))
    evaluated = known.unionByName(fresh).withColumn("value", F.length("position_key") * 10)
    return cand.join(evaluated, "position_key").groupBy("hit").agg(F.count("*").alias("lookups"), F.count_distinct("position_key").alias("unique_keys"), F.sum("value").alias("total_value"))


@query("prj_rating_band", "SELECT c_custkey, (floor(c_acctbal / 200) * 200)::bigint::varchar AS band FROM customer")
def prj_rating_band(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", s.rating_band(F.col("c_acctbal")).alias("band"))


@query("prj_rating_difference", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE c_acctbal END - s_acctbal AS difference FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = o_orderkey % 100")
def prj_rating_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("s_suppkey"))
    joined = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    own = F.when(F.col("o_orderkey") % 9 != 0, F.col("c_acctbal"))
    return joined.select("o_orderkey", (own - F.col("s_acctbal")).alias("difference"))


@query("fen_piece_counts", POS_SQL + "SELECT o_orderkey, " + f"{COUNT.format('A-Za-z')} AS pieces, " + ", ".join(f"{COUNT.format(p)} AS {c}_{p.lower()}" for c, ps in (("white", "PNBRQ"), ("black", "pnbrq")) for p in ps) + " FROM pos")
def fen_piece_counts(spark, sf_dir):
    b = F.col("board")
    each = [s.count_of(b, p).alias(f"{c}_{p.lower()}") for c, ps in (("white", "PNBRQ"), ("black", "pnbrq")) for p in ps]
    return positions(spark, sf_dir).select("o_orderkey", s.count_of(b, "A-Za-z").alias("pieces"), *each)


_WHITE = "+".join(f"{v}*{COUNT.format(p)}" for p, v in s.PIECE_VALUES.items())
_BLACK = "+".join(f"{v}*{COUNT.format(p.lower())}" for p, v in s.PIECE_VALUES.items())


@query("fen_material_balance", POS_SQL + f"SELECT o_orderkey, (({_WHITE}) - ({_BLACK})) * CASE mover WHEN 'w' THEN 1 ELSE -1 END AS balance FROM pos")
def fen_material_balance(spark, sf_dir):
    return positions(spark, sf_dir).select("o_orderkey", s.material_balance(F.col("board"), F.col("mover")).alias("balance"))


@query("fen_game_phase", POS_SQL + f"""SELECT o_orderkey, CASE WHEN {COUNT.format('Qq')} = 0 OR 3*{COUNT.format('NnBb')}+5*{COUNT.format('Rr')}+9*{COUNT.format('Qq')} <= 20 THEN 'endgame'
  WHEN {COUNT.format('A-Za-z')} >= 28 THEN 'opening' ELSE 'middlegame' END AS phase FROM pos""")
def fen_game_phase(spark, sf_dir):
    return positions(spark, sf_dir).select("o_orderkey", s.game_phase(F.col("board")).alias("phase"))


@query("fen_queens_castling", POS_SQL + """SELECT o_orderkey, contains(board, 'Q') AS white_queen, contains(board, 'q') AS black_queen,
  contains(castling, CASE mover WHEN 'w' THEN 'K' ELSE 'k' END) AS kingside, contains(castling, CASE mover WHEN 'w' THEN 'Q' ELSE 'q' END) AS queenside FROM pos""")
def fen_queens_castling(spark, sf_dir):
    rights = s.castling_rights(F.col("fen"))
    own = positions(spark, sf_dir).select("o_orderkey", F.col("board").contains("Q").alias("white_queen"), F.col("board").contains("q").alias("black_queen"), rights.alias("r"))
    return own.select("o_orderkey", "white_queen", "black_queen", "r.kingside", "r.queenside")


@query("fen_side_check", POS_SQL + "SELECT o_orderkey, mover, CASE WHEN o_custkey % 50 = 0 THEN 'b' ELSE mover END AS declared FROM pos WHERE mover <> CASE WHEN o_custkey % 50 = 0 THEN 'b' ELSE mover END")
def fen_side_check(spark, sf_dir):
    """Violations: positions whose side to move isn't the declared colour."""
    declared = F.when(F.col("o_custkey") % 50 == 0, F.lit("b")).otherwise(F.col("mover"))
    return positions(spark, sf_dir).select("o_orderkey", "mover", declared.alias("declared")).where(F.col("mover") != F.col("declared"))


@query("uci_move_flags", POS_SQL.replace("FROM pos)", "FROM pos)").rstrip() + """ SELECT o_orderkey, piece, captured, captured IS NOT NULL AS is_capture,
  piece = 'K' AND abs(sf - df) = 2 AS is_castle, promotion, coalesce(piece = 'Q' AND captured = 'Q', false) AS is_queen_trade FROM men""")
def uci_move_flags(spark, sf_dir):
    flags = s.move_flags(F.col("fen"), F.col("board"), F.col("uci"))
    return positions(spark, sf_dir).select("o_orderkey", flags.alias("m")).select("o_orderkey", "m.*")


@query("uci_geometry", POS_SQL + """SELECT o_orderkey, src AS source, dst AS destination, abs(df - sf) AS file_distance, abs(dr - sr) AS rank_distance,
  abs(df - sf) + abs(dr - sr) AS distance, CASE WHEN df <= 2 THEN 'queenside' WHEN df >= 5 THEN 'kingside' ELSE 'center' END AS wing,
  CASE mover WHEN 'w' THEN dr >= 5 ELSE dr <= 4 END AS enters_opponent_half, CASE mover WHEN 'w' THEN dr > sr ELSE dr < sr END AS toward_opponent,
  piece = 'P' AS pawn_push, piece = 'Q' AS queen_move FROM men""")
def uci_geometry(spark, sf_dir):
    piece = F.upper(s.piece_at(F.col("board"), F.substring("uci", 1, 2)))
    own = positions(spark, sf_dir).select("o_orderkey", s.move_geometry(F.col("uci"), F.col("mover")).alias("g"), piece.alias("p"))
    return own.select("o_orderkey", "g.*", (F.col("p") == "P").alias("pawn_push"), (F.col("p") == "Q").alias("queen_move"))


@query("uci_development", POS_SQL + """SELECT o_orderkey,
  piece IN ('N', 'B') AND sr = CASE mover WHEN 'w' THEN 1 ELSE 8 END AND substr(src, 1, 1) IN ('b', 'g', 'c', 'f') AS any_minor,
  sr = CASE mover WHEN 'w' THEN 1 ELSE 8 END AND ((piece = 'N' AND substr(src, 1, 1) IN ('b', 'g') AND NOT (dr = sr AND substr(dst, 1, 1) IN ('b', 'g')))
   OR (piece = 'B' AND substr(src, 1, 1) IN ('c', 'f') AND NOT (dr = sr AND substr(dst, 1, 1) IN ('c', 'f')))) AS exact FROM men""")
def uci_development(spark, sf_dir):
    piece = F.upper(s.piece_at(F.col("board"), F.substring("uci", 1, 2)))
    own = positions(spark, sf_dir).select("o_orderkey", s.develops_minor(piece, F.col("uci"), F.col("mover")).alias("d"))
    return own.select("o_orderkey", "d.any_minor", "d.exact")


_WORTH = "CASE {} " + " ".join(f"WHEN '{p}' THEN {v}" for p, v in s.PIECE_VALUES.items()) + " ELSE 0 END"


@query("uci_material_change", POS_SQL + f"SELECT o_orderkey, {_WORTH.format('captured')} + CASE WHEN promotion IS NOT NULL THEN 8 ELSE 0 END AS change FROM men")
def uci_material_change(spark, sf_dir):
    flags = s.move_flags(F.col("fen"), F.col("board"), F.col("uci"))
    own = positions(spark, sf_dir).select("o_orderkey", flags.alias("m"))
    return own.select("o_orderkey", s.material_change(F.col("m.captured"), F.col("m.promotion")).alias("change"))


@query("fen_passed_pawn_push", POS_SQL + """SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM range(64) t(i)
    WHERE substr(board, i::int + 1, 1) = CASE mover WHEN 'w' THEN 'p' ELSE 'P' END
      AND CASE mover WHEN 'w' THEN 8 - i // 8 > dr ELSE 8 - i // 8 < dr END AND abs(i % 8 - df) <= 1) AS passed
  FROM men WHERE piece = 'P'""")
def fen_passed_pawn_push(spark, sf_dir):
    """Of pawn moves: whether the pawn is passed where it arrives."""
    own = positions(spark, sf_dir).where(F.upper(s.piece_at(F.col("board"), F.substring("uci", 1, 2))) == "P")
    return own.select("o_orderkey", s.is_passed(F.col("board"), F.substring("uci", 3, 2), F.col("mover")).alias("passed"))


@query("fen_pawn_structure", POS_SQL + """, f AS (SELECT o_orderkey, [length(regexp_replace(array_to_string([substr(board, (r * 8 + x + 1)::int, 1) for r in range(8)], ''), '[^P]', '', 'g')) for x in range(8)] AS c FROM pos),
  padded AS (SELECT o_orderkey, c, list_concat([0], list_concat(c, [0])) AS p FROM f)
  SELECT o_orderkey, list_sum(c)::int AS remaining, list_sum([greatest(x - 1, 0) for x in c])::int AS doubled,
    list_sum([CASE WHEN p[i - 1] = 0 AND p[i + 1] = 0 THEN p[i] ELSE 0 END for i in range(2, 10)])::int AS isolated,
    list_sum([CASE WHEN p[i] > 0 AND p[i - 1] = 0 THEN 1 ELSE 0 END for i in range(2, 10)])::int AS islands FROM padded""")
def fen_pawn_structure(spark, sf_dir):
    return positions(spark, sf_dir).select("o_orderkey", s.pawn_structure(F.col("board"), "P").alias("w")).select("o_orderkey", "w.*")


# --- evaluations -----------------------------------------------------------------------------

_CP = "CASE WHEN decision_id % 13 = 0 AND engine_rank = 1 THEN NULL ELSE score_cp END"
_MATE = "CASE WHEN decision_id % 13 = 0 AND engine_rank = 1 THEN decision_id % 7 - 3 WHEN decision_id % 17 = 0 AND engine_rank = 2 THEN 2 END"


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with centipawns and, on some, a distance to mate."""
    return scored(candidates(spark, sf_dir))


def scored(cand: DataFrame) -> DataFrame:
    return cand.withColumns({"cp": F.expr(_CP), "mate": F.expr(_MATE).cast("bigint")})


EVAL_SQL = LOG_SQL + f", ev AS (SELECT *, {_CP} AS cp, ({_MATE})::bigint AS mate FROM cand)"
_TO_CP = "CASE WHEN mate IS NOT NULL THEN CASE WHEN mate >= 0 THEN 100000 - mate ELSE -100000 - mate END ELSE cp END"


@query("eval_to_cp", EVAL_SQL + f"SELECT decision_id, engine_rank, {_TO_CP} AS value FROM ev")
def eval_to_cp(spark, sf_dir):
    return evaluated(spark, sf_dir).select("decision_id", "engine_rank", s.eval_to_cp(F.col("cp"), F.col("mate")).alias("value"))


@query("eval_win_chance", EVAL_SQL + f"SELECT decision_id, engine_rank, round(1 / (1 + exp(-0.00368208 * greatest(-100000, least(100000, {_TO_CP})))), 9) AS chance FROM ev")
def eval_win_chance(spark, sf_dir):
    return evaluated(spark, sf_dir).select("decision_id", "engine_rank", F.round(s.win_chance(s.eval_to_cp(F.col("cp"), F.col("mate"))), 9).alias("chance"))


@query("eval_win_percent", EVAL_SQL + "SELECT decision_id, engine_rank, round(100 / (1 + exp(-0.00368208 * cp)), 7) AS percent FROM ev WHERE mate IS NULL")
def eval_win_percent(spark, sf_dir):
    return evaluated(spark, sf_dir).where("mate IS NULL").select("decision_id", "engine_rank", F.round(s.win_percent(F.col("cp")), 7).alias("percent"))


@query("eval_cp_loss", EVAL_SQL + f""", d AS (SELECT decision_id, max(CASE WHEN engine_rank = 1 THEN {_TO_CP} END) AS b, max(CASE WHEN chosen THEN {_TO_CP} END) AS a,
    max(CASE WHEN engine_rank = 1 THEN cp END) AS bc, max(CASE WHEN chosen THEN cp END) AS ac, max(CASE WHEN engine_rank = 1 THEN mate END) AS bm, max(CASE WHEN chosen THEN mate END) AS am FROM ev GROUP BY 1)
  SELECT decision_id, greatest(b - a, 0) AS loss, CASE WHEN bm IS NULL AND am IS NULL THEN greatest(bc - ac, 0) END AS strict_loss FROM d""")
def eval_cp_loss(spark, sf_dir):
    ev = evaluated(spark, sf_dir).withColumn("value", s.eval_to_cp(F.col("cp"), F.col("mate")))
    best, own = (lambda c: F.max(F.when(F.col("engine_rank") == 1, F.col(c)))), (lambda c: F.max(F.when(F.col("chosen"), F.col(c))))
    d = ev.groupBy("decision_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("b", best), ("a", own)) for c in ("value", "cp", "mate")])
    return d.select("decision_id", s.cp_loss(F.col("b_value"), F.col("a_value")).alias("loss"), s.cp_loss_strict(F.col("b_cp"), F.col("b_mate"), F.col("a_cp"), F.col("a_mate")).alias("strict_loss"))


@query("eval_rank_flags", LOG_SQL + """, d AS (SELECT decision_id, min(CASE WHEN chosen AND engine_rank <= 4 THEN engine_rank END) AS r, count(*) AS n, CASE WHEN decision_id % 3 = 0 THEN 3 ELSE 5 END AS req FROM cand GROUP BY decision_id)
  SELECT decision_id, r AS actual_rank, """ + ", ".join(f"CASE WHEN r <= {k} THEN true WHEN req >= {k} AND n >= {k} THEN false END AS in_top_{k}" for k in (1, 3, 5)) + " FROM d")
def eval_rank_flags(spark, sf_dir):
    seen = F.when(F.col("chosen") & (F.col("engine_rank") <= 4), F.col("engine_rank"))
    d = candidates(spark, sf_dir).groupBy("decision_id").agg(F.min(seen).alias("actual_rank"), F.count("*").alias("n"))
    d = d.withColumn("requested", F.when(F.col("decision_id") % 3 == 0, 3).otherwise(5))
    return d.select("decision_id", "actual_rank", *[s.rank_flag(F.col("actual_rank"), k, F.col("requested"), F.col("n")).alias(f"in_top_{k}") for k in (1, 3, 5)])
