"""Column expressions: clocks and controls, evaluations, keys, and positions read from FEN text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the evaluation scale and of the piece counts.
MATE = 100_000
SLOPE = 0.00368208
FILE_A = 0x8080808080808080  # squares of the a file, a8 in the highest bit
PIECE_VALUES = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9, "K": 0}
MEN = "PNBRQKpnbrqk"


# --- keys and labels -------------------------------------------------------------------------


def time_control(text: Column) -> Column:
    """struct(initial, increment) of ``300+3``; nulls where the text is anything else."""
    part = lambda i: F.when(text.rlike(r"^\d+\+\d+$"), F.split_part(text, F.lit("+"), F.lit(i)).try_cast("bigint"))
    return F.struct(part(1).alias("initial"), part(2).alias("increment"))


def opening_family(name: Column) -> Column:
    """What stands before the first colon; null where that is blank."""
    return F.nullif(F.trim(F.split_part(name, F.lit(":"), F.lit(1))), F.lit(""))


def fen_fields(fen: Column, n: int) -> Column:
    """The first ``n`` fields; null unless there are four or six."""
    fields = F.split(F.trim(fen), r"\s+")
    return F.when(F.size(fields).isin(4, 6), F.array_join(F.slice(fields, 1, n), " "))


def position_key(fen: Column) -> Column:
    return fen_fields(fen, 4)


def bench_key(fen: Column) -> Column:
    """Five fields (with the half-move clock) and move number 1."""
    return F.concat_ws(" ", fen_fields(fen, 5), F.lit("1"))


def cache_key(**fields: Column) -> Column:
    """SHA-256 over the fields as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def rating_band(rating: Column, width: int = 200) -> Column:
    return (F.floor(rating / width) * width).cast("bigint").cast("string")


def hash_uniform(*parts: Column) -> Column:
    """Uniform in [0, 1] from the first eight bytes of a SHA-256 over the parts."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551616.0


# --- evaluations -----------------------------------------------------------------------------


def eval_to_cp(cp: Column, mate: Column) -> Column:
    """A mate wins over centipawns: mate in n counts 100000 - n, being mated -100000 - n."""
    return F.when(mate.isNotNull(), F.when(mate >= 0, MATE - mate).otherwise(-MATE - mate)).otherwise(cp)


def win_chance(cp: Column) -> Column:
    """Logistic of centipawns in [0, 1], by the form that doesn't overflow."""
    z = F.exp(-F.abs(cp * SLOPE))
    return F.when(cp >= 0, 1 / (1 + z)).otherwise(z / (1 + z))


def win_percent(cp: Column) -> Column:
    return 100 * win_chance(cp)


def cp_loss(best: Column, actual: Column) -> Column:
    return F.when(best.isNotNull() & actual.isNotNull(), F.greatest(best - actual, F.lit(0)))


def cp_loss_strict(best_cp: Column, best_mate: Column, actual_cp: Column, actual_mate: Column) -> Column:
    """As ``cp_loss``, but null where a mate is involved."""
    return F.when(best_mate.isNull() & actual_mate.isNull(), cp_loss(best_cp, actual_cp))


def rank_flag(rank: Column, limit: int, requested: Column, available: Column) -> Column:
    """Three-valued: true within the limit, false only where enough lines were asked for and came."""
    seen = (requested >= limit) & (available >= limit)
    return F.when(rank <= limit, F.lit(True)).when(seen, F.lit(False))


def low_time(clock: Column, initial: Column, low_seconds: float = 30.0, low_fraction: float = 0.10) -> Column:
    """Low on time: under so many seconds or under that part of the initial time; null without a clock."""
    return F.when(clock.isNotNull(), (clock < low_seconds) | F.coalesce(clock / F.nullif(initial, F.lit(0)) < low_fraction, F.lit(False)))


# --- positions -------------------------------------------------------------------------------


def squares(fen: Column) -> Column:
    """The placement as 64 characters from a8 to h1, blanks as dots."""
    board = F.replace(F.split_part(fen, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    return board


def side(fen: Column) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(2))


def count_of(board: Column, letters: str) -> Column:
    """How many characters of ``board`` are among ``letters`` (ranges such as A-Z allowed)."""
    every = re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), letters)
    if len(every) <= 4:  # bytes are searched for a few letters; ``translate`` makes a string of each character
        return F.length(board) - F.length(reduce(lambda left, letter: F.replace(left, F.lit(letter), F.lit("")), every, board))
    return F.length(board) - F.length(F.translate(board, every, ""))


def men_of(board: Column) -> Column:
    """An array of how many there are of each letter of ``MEN``, for columns that need several of these numbers."""
    return F.transform(F.array(*map(F.lit, MEN)), lambda letter: F.length(board) - F.length(F.replace(board, letter, F.lit(""))))


def counter(board: Column) -> Callable[[str], Column]:
    return lambda letters: count_of(board, letters)


def men_counter(men: Column, every: Column) -> Callable[[str], Column]:
    """As ``counter``, from the numbers of ``men_of`` and that of all letters."""
    return lambda letters: every if letters == "A-Za-z" else reduce(add, [men[MEN.index(letter)] for letter in letters])


def material(board: Column, white: bool) -> Column:
    own = [PIECE_VALUES[p] * count_of(board, p if white else p.lower()) for p in PIECE_VALUES]
    return sum(own[1:], own[0])


def material_balance(board: Column, mover: Column) -> Column:
    """The mover's material less the opponent's."""
    balance = material(board, True) - material(board, False)
    return F.when(mover == "w", balance).otherwise(-balance)


def men_balance(men: Column, mover: Column) -> Column:
    """As ``material_balance``, from the numbers of ``men_of``."""
    worth = F.array(*[F.lit(PIECE_VALUES[p.upper()] * (1 if p.isupper() else -1)) for p in MEN])
    balance = F.aggregate(F.zip_with(men, worth, mul), F.lit(0), add)
    return F.when(mover == "w", balance).otherwise(-balance)


def game_phase(board: Column, count: Callable[[str], Column] | None = None) -> Column:
    """Endgame without queens or with 20 points of pieces at most; else opening from 28 men on."""
    count = count or counter(board)
    men = 3 * count("NnBb") + 5 * count("Rr") + 9 * count("Qq")
    return F.when((count("Qq") == 0) | (men <= 20), "endgame").when(count("A-Za-z") >= 28, "opening").otherwise("middlegame")


def castling_rights(fen: Column) -> Column:
    """struct(kingside, queenside) of the side to move."""
    field = F.split_part(fen, F.lit(" "), F.lit(3))
    has = lambda w, b: F.when(side(fen) == "w", field.contains(w)).otherwise(field.contains(b))
    return F.struct(has("K", "k").alias("kingside"), has("Q", "q").alias("queenside"))


def file_of(square: Column) -> Column:
    """0 to 7 for a to h."""
    return F.ascii(F.substring(square, 1, 1)) - 97


def rank_of(square: Column) -> Column:
    """1 to 8."""
    return F.ascii(F.substring(square, 2, 1)) - 48


def piece_at(board: Column, square: Column) -> Column:
    return board.substr(((8 - rank_of(square)) * 8 + file_of(square) + 1).cast("int"), F.lit(1))


def wing_of(file: Column) -> Column:
    return F.when(file <= 2, "queenside").when(file >= 5, "kingside").otherwise("center")


def move_flags(fen: Column, board: Column, uci: Column) -> Column:
    """What a move does: piece, captured, and capture, castle, promotion and queen-trade flags."""
    start, end = F.substring(uci, 1, 2), F.substring(uci, 3, 2)
    piece, target = F.upper(piece_at(board, start)), F.upper(piece_at(board, end))
    passant = (piece == "P") & (F.split_part(fen, F.lit(" "), F.lit(4)) == end) & (file_of(start) != file_of(end))
    captured = F.when(target != ".", target).when(passant, F.lit("P"))
    return F.struct(
        piece.alias("piece"),
        captured.alias("captured"),
        captured.isNotNull().alias("is_capture"),
        ((piece == "K") & (F.abs(file_of(start) - file_of(end)) == 2)).alias("is_castle"),
        F.nullif(F.upper(F.substring(uci, 5, 1)), F.lit("")).alias("promotion"),
        F.coalesce((piece == "Q") & (captured == "Q"), F.lit(False)).alias("is_queen_trade"),
    )


def move_geometry(uci: Column, mover: Column) -> Column:
    """Distances, wing, and whether the move goes forward or into the other half."""
    start, end = F.substring(uci, 1, 2), F.substring(uci, 3, 2)
    files, ranks = F.abs(file_of(end) - file_of(start)), rank_of(end) - rank_of(start)
    white = mover == "w"
    return F.struct(
        start.alias("source"),
        end.alias("destination"),
        files.alias("file_distance"),
        F.abs(ranks).alias("rank_distance"),
        (files + F.abs(ranks)).alias("distance"),
        wing_of(file_of(end)).alias("wing"),
        F.when(white, rank_of(end) >= 5).otherwise(rank_of(end) <= 4).alias("enters_opponent_half"),
        F.when(white, ranks > 0).otherwise(ranks < 0).alias("toward_opponent"),
    )


def develops_minor(piece: Column, uci: Column, mover: Column) -> Column:
    """struct(any_minor, exact): a minor piece leaves a home square of minors; the exact form wants
    the piece's own home squares and an end that is none of them."""
    start, end = F.substring(uci, 1, 2), F.substring(uci, 3, 2)
    home = F.when(mover == "w", F.lit("1")).otherwise(F.lit("8"))
    at = lambda square, files: F.substring(square, 1, 1).isin(*files) & (F.substring(square, 2, 1) == home)
    knight, bishop = at(start, "bg"), at(start, "cf")
    exact = ((piece == "N") & knight & ~at(end, "bg")) | ((piece == "B") & bishop & ~at(end, "cf"))
    return F.struct((piece.isin("N", "B") & (knight | bishop)).alias("any_minor"), exact.alias("exact"))


def value_of(piece: Column) -> Column:
    worth = F.lit(0)
    for name, value in PIECE_VALUES.items():
        worth = F.when(piece == name, F.lit(value)).otherwise(worth)
    return worth


def material_change(captured: Column, promotion: Column) -> Column:
    """What the move wins: the captured piece, and a promotion less the pawn."""
    return value_of(captured) + F.when(promotion.isNotNull(), value_of(promotion) - 1).otherwise(F.lit(0))


def is_passed(board: Column, square: Column, mover: Column) -> Column:
    """No enemy pawn ahead on the square's file or the ones beside it."""
    index = F.sequence(F.lit(0), F.lit(63))
    file, rank = file_of(square), rank_of(square)

    def guards(i: Column) -> Column:
        r, f = 8 - F.floor(i / 8), i % 8
        enemy = F.when(mover == "w", F.lit("p")).otherwise(F.lit("P"))
        ahead = F.when(mover == "w", r > rank).otherwise(r < rank)
        return (board.substr((i + 1).cast("int"), F.lit(1)) == enemy) & ahead & (F.abs(f - file) <= 1)

    return ~F.exists(index, guards)


def pawn_structure(board: Column, pawn: str) -> Column:
    """struct(remaining, doubled, isolated, islands) of one colour's pawns."""
    # A bit for each square, so that a file's count is one mask; lambdas would read the board anew in every place.
    bits = F.translate(F.regexp_replace(F.rpad(board, 64, "."), f"[^{pawn}]", "0"), pawn, "1")
    placed = F.conv(bits, 2, -10).cast("bigint")
    on = lambda f: F.coalesce(F.bit_count(placed.bitwiseAND(F.lit(FILE_A >> f if f else FILE_A - (1 << 64)))), F.lit(0))
    c = [F.lit(0), *[on(f) for f in range(8)], F.lit(0)]
    total = lambda part: reduce(add, map(part, range(1, 9)))
    return F.struct(
        count_of(board, pawn).alias("remaining"),
        total(lambda f: F.greatest(c[f] - 1, F.lit(0))).alias("doubled"),
        total(lambda f: F.when((c[f - 1] == 0) & (c[f + 1] == 0), c[f]).otherwise(F.lit(0))).alias("isolated"),
        total(lambda f: ((c[f] > 0) & (c[f - 1] == 0)).cast("int")).alias("islands"),
    )
