"""Benchmark decontamination by template windows.

Texts become word templates: numbers (digits and number words), units beside them and names turn into
typed placeholders, one for each whole number or name, and all else is folded to one case. Windows of
eight template words are joined by hash with those of the benchmark, so a question whose numbers or
names were changed still meets its source; an item of fewer words is one window of its own length.
There are three views of a text, with windows of their own:

0. names are placeholders: meets changed names and numbers;
1. names are words: meets copies in another case, with other numbers too;
2. everything is literal: for stretches so full of numbers that a template says too little.

Within one alignment of a document and an item the slots must agree: a value of the item stands for
one value in the document. What remains is counted as the share of the item's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillog.session import durable

from .names import free_prefix

# Words and signs that measure a number beside them.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents mph kmh w kw v hz"
).split()
SIGNS = ["%", "$", "€", "£", "°"]

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

NUMBER, NAME, UNIT, OPENER = "\x01", "\x02", "\x03", "\x04"
LETTER = r"[\p{L}\p{M}]"
# Repeated groups are possessive: Java's others recurse once a repetition, and long lists overflow its stack.
WORD = rf"{LETTER}+(?:['’]{LETTER}+)*+"
_SPELT, _UNIT, _SIGN = "|".join(NUMBER_WORDS), "|".join(UNITS), "[" + "".join(SIGNS) + "]"
_TITLE = rf"\p{{Lu}}{LETTER}*(?:['’]{LETTER}+)*+"
_GAP, _MARK = rf"[^\p{{L}}\p{{M}}{NUMBER}{UNIT}]*", f"[{NUMBER}{UNIT}]"
FIND = {
    NUMBER: rf"\p{{N}}+(?:[.,]\p{{N}}+)*+|(?<!{LETTER})(?i:{_SPELT})(?!{LETTER})(?:[ -](?i:{_SPELT})(?!{LETTER}))*+",
    UNIT: rf"(?<={NUMBER} {{1,4}})(?:(?i:{_UNIT})(?!{LETTER})|{_SIGN})|{_SIGN}(?= {{1,4}}{NUMBER})",
    OPENER: rf"(^|[.!?\n])([^\p{{L}}\p{{N}}{NUMBER}{UNIT}.!?\n]{{0,6}})(\p{{Lu}})",
    NAME: rf"(?<![{OPENER}'’\p{{L}}\p{{M}}]){_TITLE}(?:[ -]{_TITLE})*+",
}
TEMPLATE_WORD = rf"[{NUMBER}{NAME}{UNIT}]|{WORD}"
LITERAL_WORD = rf"\p{{N}}+(?:[.,]\p{{N}}+)*+|{WORD}|{_SIGN}"
#: Three placeholders among four words; without it no eight words have five.
DENSE = rf"{_MARK}{_GAP}(?:{_MARK}{_GAP}(?:{WORD}{_GAP})?|{WORD}{_GAP}{_MARK}{_GAP}){_MARK}"
SLOTS = {0: (NUMBER, NAME, UNIT), 1: (NUMBER, UNIT), 2: ()}


def _replaced(text: Column, kind: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(FIND[kind]), F.lit(by))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def folded(text: Column) -> Column:
    """Upper before lower, since some letters (ß) have no upper case of their own; the concatenation
    keeps the optimizer from taking the inner one away."""
    return F.lower(F.concat(F.upper(text), F.lit("")))


def views(rows: DataFrame, keys: list[str], slots: bool = False) -> DataFrame:
    """``keys`` and the words of ``_text`` in each view: _v0 (null without names), _v1, _v2 (null
    unless placeholders stand close together). With ``slots`` also the values of the placeholders in
    order of their place, and every view."""
    read = rows.select(*keys, F.translate("_text", NUMBER + NAME + UNIT + OPENER, "    ").alias("_plain"))
    read = read.select(*keys, "_plain", _replaced(F.col("_plain"), NUMBER, f" {NUMBER} ").alias("_one"))
    read = read.select(*keys, "_plain", "_one", _replaced(F.col("_one"), UNIT, f" {UNIT} ").alias("_two"))
    read = read.select(*keys, "_plain", "_one", "_two", _replaced(F.col("_two"), OPENER, f"$1$2{OPENER}$3").alias("_three"))
    read = read.select(*keys, "_plain", "_one", "_two", "_three", _replaced(F.col("_three"), NAME, f" {NAME} ").alias("_four"))
    named, dense = F.contains("_four", F.lit(NAME)), F.col("_two").rlike(DENSE)
    if slots:
        values = [_found(F.col(text), FIND[kind]).alias(f"_of{ord(kind)}") for text, kind in (("_plain", NUMBER), ("_one", UNIT), ("_three", NAME))]
        return read.select(*keys, _found(folded(F.col("_four")), TEMPLATE_WORD).alias("_v0"), _found(folded(F.col("_two")), TEMPLATE_WORD).alias("_v1"), *values)
    return read.select(
        *keys,
        F.when(named, _found(folded(F.col("_four")), TEMPLATE_WORD)).alias("_v0"),
        _found(folded(F.col("_two")), TEMPLATE_WORD).alias("_v1"),
        F.when(dense, _found(folded(F.col("_plain")), LITERAL_WORD)).alias("_v2"),
    )


def _hashes(view: int, codes: Column, width: Column | int) -> Column:
    """The hash of every window of ``width`` words; empty where there are fewer."""
    width = F.lit(width) if isinstance(width, int) else width
    every = F.transform(F.sequence(F.lit(0), F.size(codes) - width), lambda i: F.xxhash64(F.lit(view), F.slice(codes, i + 1, width)))
    return F.when(F.size(codes) >= width, every).otherwise(F.array().cast("array<bigint>"))


def _coded(read: DataFrame, keys: list[str]) -> DataFrame:
    return read.select(*keys, *[F.transform(f"_v{v}", lambda w: F.xxhash64(w)).alias(f"_c{v}") for v in SLOTS])


def item_windows(items: DataFrame, width: int, min_words: int, min_literals: int) -> DataFrame:
    """(_item, _view, _hash, _ipos, _len, _counts) of the items' windows.

    A window of views 0 and 1 counts (``_counts``) if ``min_literals`` of its words aren't
    placeholders; one of view 2 only if three are numbers or signs.
    """
    read = views(items, ["_item"]).withColumn("_v0", F.coalesce("_v0", "_v1"))
    out = None
    for view, kinds in SLOTS.items():
        words = F.col(f"_v{view}")
        long_enough = read.where(F.size(words) >= min_words).select("_item", words.alias("_words"), F.least(F.lit(width), F.size(words)).alias("_len"))
        codes = long_enough.select("_item", "_words", "_len", F.transform("_words", lambda w: F.xxhash64(w)).alias("_c"))
        spread = codes.select("_item", "_words", "_len", F.posexplode(_hashes(view, F.col("_c"), F.col("_len"))).alias("_ipos", "_hash"))
        own = F.slice("_words", F.col("_ipos") + 1, F.col("_len"))
        if kinds:
            counts = F.size(own) - F.size(F.filter(own, lambda w: w.isin(*FIND))) >= min_literals
        else:
            counts = F.size(F.filter(own, lambda w: ~w.rlike(r"^[\p{L}\p{M}]"))) >= 3
        some = spread.select("_item", F.lit(view).alias("_view"), "_hash", "_ipos", "_len", counts.alias("_counts"))
        out = some if out is None else out.union(some)
    return out


def slots_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, _view, _p (place among the view's words), _t (kind), _v (hash of the value)."""
    read = views(rows, keys, slots=True)

    def listed(view: int, kind: str) -> Column:
        words, values = F.col(f"_v{view}"), F.col(f"_of{ord(kind)}")
        places = F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == kind))
        slot = lambda p, v: F.struct(F.lit(view).alias("_view"), p.alias("_p"), F.lit(ord(kind)).alias("_t"), F.xxhash64(folded(v)).alias("_v"))
        return F.zip_with(places, values, slot)

    lists = [listed(view, kind) for view, kinds in SLOTS.items() for kind in kinds]
    each = F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<struct<_view:int,_p:int,_t:int,_v:bigint>>")) for x in lists]))
    return read.select(*keys, each.alias("_s")).select(*keys, "_s.*")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 8,
    min_words: int = 4,
    min_literals: int = 4,
    min_coverage: float = 0.5,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """_k1, _k2 (hashes of id and text), _item, _coverage, _same for each leak found.

    Coverage is the share of the item's windows that are met, in the view that has most of them. A view
    in which less than half of an item's windows count can't give more than their share of that half.

    The benchmark's windows are counted first and broadcast only up to ``broadcast_rows`` of them, each
    of fixed size; beyond that Spark joins by shuffle.
    """
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text")).distinct()
    every = durable(item_windows(items, width, min_words, min_literals))
    of = lambda view, ok=True: F.count_if((F.col("_view") == view) & (F.col("_counts") if ok else F.lit(True)))
    totals = every.groupBy("_item").agg(*[of(v).alias(f"_t{v}") for v in SLOTS], *[of(v, False).alias(f"_all{v}") for v in SLOTS])
    own = every.where("_counts").drop("_counts")
    bounded = own.count() <= broadcast_rows
    small = F.broadcast if bounded else lambda df: df
    lanes = sorted((r["_view"], r["_len"]) for r in own.select("_view", "_len").distinct().collect())  # at most 3 x width

    rows = docs.select(F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(F.lit(11), text_col, id_col).alias("_k2"), F.col(text_col).alias("_text"))
    rows = rows.where(F.col("_text").isNotNull())
    keys = ["_k1", "_k2"]
    codes = _coded(views(rows, keys), keys)
    # One array for all lanes of a document: a lane's windows follow those of the lanes before it.
    sizes = {lane: F.greatest(F.lit(0), F.coalesce(F.size(f"_c{lane[0]}"), F.lit(0)) - lane[1] + 1) for lane in lanes}
    hashes = [F.coalesce(_hashes(view, F.col(f"_c{view}"), size), F.array().cast("array<bigint>")) for view, size in lanes]
    none = F.array().cast("array<bigint>")
    lengths = [n.alias(f"_n{k}") for k, n in enumerate(sizes.values())]
    plain = codes.select(*keys, *lengths, F.posexplode(F.concat(none, *hashes)).alias("_at", "_hash"))
    met = plain.join(small(own), "_hash")
    before, start = F.lit(0), F.lit(0)
    for k, (view, size) in enumerate(lanes):
        start = F.when((F.col("_view") == view) & (F.col("_len") == size), before).otherwise(start)
        before = before + F.col(f"_n{k}")
    met = durable(met.select(*keys, "_item", "_view", "_ipos", (F.col("_at") - start - F.col("_ipos")).alias("_shift")))

    # Slots of the met windows, beside those of the documents, which are read a second time.
    line = ["_k1", "_k2", "_item", "_view", "_shift"]
    within = own.withColumn("_p", F.explode(F.sequence(F.col("_ipos"), F.col("_ipos") + F.col("_len") - 1))).select("_item", "_view", "_ipos", "_p")
    wanted = durable(within.join(slots_of(items, ["_item"]), ["_item", "_view", "_p"]))
    slotted = met.join(small(wanted), ["_item", "_view", "_ipos"]).withColumn("_dp", F.col("_p") + F.col("_shift"))
    again = rows.join(slotted.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)
    there = slots_of(again, keys).select(*keys, "_view", F.col("_p").alias("_dp"), F.col("_v").alias("_dv"))
    pairs = durable(slotted.join(there, [*keys, "_view", "_dp"]).select(*line, "_ipos", "_p", F.struct("_t", "_v").alias("_a"), "_dv"))

    # One alignment of an item within a document: a value stands for what most of its places have, on
    # a tie for itself, else for nothing.
    counted = pairs.groupBy(*line, "_a", "_dv").agg(F.count_distinct("_p").alias("_n"))
    ranked = F.struct("_n", (F.col("_dv") == F.col("_a._v")).cast("int").alias("_own"))
    most = counted.groupBy(*line, "_a").agg(F.max(ranked).alias("_most"))
    won = counted.join(most, [*line, "_a"]).where(ranked == F.col("_most")).groupBy(*line, "_a").agg(F.count("*").alias("_ties"), F.min("_dv").alias("_won"))
    won = won.where("_ties = 1").drop("_ties")
    lost = pairs.join(won, [*line, "_a"], "left").where(~F.col("_dv").eqNullSafe(F.col("_won"))).select(*line, "_ipos").distinct()
    alike = pairs.groupBy(*line).agg(F.bool_and(F.col("_dv") == F.col("_a._v")).alias("_alike"))
    held = met.join(lost, [*line, "_ipos"], "left_anti").join(alike, line, "left")
    met_in = lambda view: F.count_distinct(F.when(F.col("_view") == view, F.col("_ipos"))).alias(f"_m{view}")
    found = held.groupBy("_k1", "_k2", "_item").agg(*[met_in(v) for v in SLOTS], F.bool_and(F.coalesce("_alike", F.lit(True))).alias("_same"))
    found = found.join(small(totals), "_item")
    share = lambda n, t, every: F.when(t > 0, n / F.greatest(t, every / 2))
    c = F.col
    coverage = F.greatest(share(c("_m0"), c("_t0"), c("_all0")), share(c("_m1"), c("_t1"), c("_all1")), share(c("_m1") + c("_m2"), c("_t1") + c("_t2"), c("_all1")))
    return found.select("_k1", "_k2", "_item", coverage.alias("_coverage"), "_same").where(F.col("_coverage") >= min_coverage)


def flag(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: str = "_", **options) -> DataFrame:
    """Every row of ``docs`` with contaminated, items (sorted ids), coverage (best) and same_slots, their
    names after ``prefix``.

    Null and empty texts are clean, as are items under ``min_words`` words; texts of any length are read
    whole. Repeated rows get equal results; null ids are ids like others; an empty benchmark leaves all
    clean, and an empty table gives an empty result. Other columns pass unchanged, but columns of
    ``docs`` that have a result's name are replaced by it; ``free_prefix`` gives a prefix that meets none.
    """
    found = leaks(docs.select(id_col, text_col), benchmark, id_col=id_col, text_col=text_col, **options)
    results = [f"{prefix}{name}" for name in ("items", "coverage", "same_slots", "contaminated")]
    kept = docs.drop(*[c for c in results if c not in (id_col, text_col)])
    own = free_prefix(kept)
    found = found.groupBy(F.col("_k1").alias(f"{own}k1"), F.col("_k2").alias(f"{own}k2")).agg(
        F.array_sort(F.collect_set("_item")).alias(results[0]), F.max("_coverage").alias(results[1]), F.bool_and("_same").alias(results[2])
    )
    keyed = kept.withColumns({f"{own}k1": F.xxhash64(id_col, text_col), f"{own}k2": F.xxhash64(F.lit(11), text_col, id_col)})
    joined = keyed.join(found, [f"{own}k1", f"{own}k2"], "left").drop(f"{own}k1", f"{own}k2")
    return joined.withColumn(results[3], F.col(results[0]).isNotNull())
