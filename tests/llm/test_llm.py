"""Operators of the training-data subpackage against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillog.llm import decontam, html_extract, lang_crf, licence_scan, line_dedup, minhash_icws, piece_codec, queries, sharding, url_filter, vector_dedup
from quillog.llm.names import free_prefix

DOCS = "doc_id long, text string, lang string"
WORDS = [a + b for a in "ka lo mi nu pe ra si to vu we".split() for b in "dan fel gor hin jul kem".split()]


def prose(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return [draw.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "  \n ", "en"), (None, "some words here", "en"), (4, "x" * 30_000, "en"), (5, "twice the same", "en"), (5, "twice the same", "en"), (6, "!!! ???", None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"slot": F.lit(1), "_h": F.lit(2), "shard": F.lit("x")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 sharding ------------------------------------------------------------------------------


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, " ".join(prose(i % 40 if i < 300 else i, 5 + i % 60)), "en") for i in range(900)]
    got = sharding.shard_by_size(spark.createDataFrame(rows, DOCS), 7, ranges_per_shard=4).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == 900 and set(slots) == set(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    text = {i: t for i, t, _ in rows}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id]) + 8 for r in got)


def test_equal_rows_are_split_over_shards(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the same text in every row of this table", "en")] * 300, DOCS)
    got = sharding.shard_by_size(docs, 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(3) for k in range(100)]
    own = spark.createDataFrame([(i, " ".join(prose(i, 9)), "en") for i in range(50)], DOCS)
    sharding.write_shards(own, sharding.shard_by_size(own, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in own.collect()} and back.select("_shard").distinct().count() == 4


def test_sharding_edges(edge, empty):
    got = sharding.shard_by_size(edge, 3).collect()
    assert len(got) == 8 and {r["size"] for r in got if r.doc_id in (1, 2)} == {8}
    assert sharding.shard_by_size(empty, 3).count() == 0


# --- 2 html ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>a</a></nav>", ""),
        ("<p>one<p>two <b>bold", "one\ntwo bold"),
        ("<article><h1>T</h1><p>a&amp;b &lt;i&gt; c\n\t d<script>x</script></p></article><footer>f</footer>", "T\na&b <i> c d"),
        ("<div class='sidebar'>s</div><div><p>Long enough text, with commas, to be kept.</p></div><div id=comments><p>A reader, who says things, at length.</p></div>", "Long enough text, with commas, to be kept."),
        ("<article><p>cut off &am", "cut off &am"),
        ("<p>text</p><!-- <p>no</p> --><form>q</form>", "text"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


ARTICLE = "<p>Long enough text, with commas, to be kept.</p>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<div class="content has-sidebar"><article><h1>T</h1>{ARTICLE}</article></div>', "T\n"),
        (f'<div class="site no-sidebar">{ARTICLE}</div>', ""),
        (f'<article><div class="post-header"><h1>T</h1></div>{ARTICLE}</article>', "T\n"),
        (f'<article><p id="share-price">The share price, they say, rose.</p>{ARTICLE}</article>', "The share price, they say, rose.\n"),
        (f"<form action=x><div><h1>T</h1>{ARTICLE}<input></div></form>", "T\n"),
        (f"<aside>{ARTICLE}</aside>", ""),
        (f'<div class="menu">{ARTICLE}</div>', ""),
        ("<div id=comments><p>A reader, who says more than the article does, and says it again and again.</p></div>" + ARTICLE, ""),
        ('<div class="ad-box"><p>Buy this, now, and that, too, at once, here.</p></div><div class="share-buttons">Share</div>' + ARTICLE, ""),
        ('<div style="display:none"><p>Hidden, but long, text that nobody sees, ever, at all.</p></div>' + ARTICLE, ""),
    ],
)
def test_names_make_doubt_but_do_not_decide(html, text):
    assert html_extract.main_text(f"<html><body>{html}</body></html>") == f"{text}Long enough text, with commas, to be kept."


def test_inline_controls_do_not_end_a_block():
    assert html_extract.main_text("<p>x <button>b</button> y</p>") == "x y"


def test_long_repeated_and_no_pages(spark):
    html = f"<article>{ARTICLE * 3_000}</article>"
    rows = spark.createDataFrame([(1, html), (1, html), (2, "<div>" * 3_000 + "<p>deep, but read</p>")], "page_id int, html string")
    got = [r[0] for r in rows.select(html_extract.extract(F.col("html"))).collect()]
    assert got[0] == got[1] == "\n".join(["Long enough text, with commas, to be kept."] * 3_000) and got[2] == "deep, but read"
    assert rows.limit(0).select(html_extract.extract(F.col("html"))).count() == 0


@pytest.mark.parametrize("rest", ["<body><p>one<p>two", "<p>one<p>two</p></body>", "<div><p>one</p><p>two</p></div>", "</head><body><p>one<p>two"])
def test_head_without_end_tag(rest):
    assert html_extract.main_text(f"<html><head><meta charset=x><title>T</title><link href=y><style>s</style>\n{rest}") == "one\ntwo"
    assert html_extract.main_text("<head><title>T</title>plain <b>text</b>") == "plain text"


def test_extract_column(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>a</p>")], "page_id int, html string")
    assert [r[0] for r in df.select(html_extract.extract(F.col("html"))).collect()] == ["", "a"]


# --- 3 pieces --------------------------------------------------------------------------------


def test_pieces_without_dropout_are_the_models():
    own = piece_codec.Encoder(piece_codec.MODEL, 0.0, 1, 1)
    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    for text in ["Hello, world!", "  two  spaces\nand\tmore", "naïve café 12.5%", "x²." + "y" * 80, " ".join(prose(3, 50))]:
        assert own.encode(text, 0).tolist() == model.encode(text)


def test_pieces_round_trip_and_vary():
    texts = ["", " ", "▁ literal ▁▁", "日本語 🎉\u0000", "a" * 500, " ".join(prose(1, 80)), "\r\n\t x"]
    a, b = (piece_codec.Encoder(piece_codec.MODEL, 0.1, seed, 4) for seed in (1, 2))
    for t in texts:
        assert a.decode(a.encode(t, 5).tolist()) == t
        assert a.encode(t, 5).tolist() == a.encode(t, 5).tolist()
    assert a.encode(texts[5], 5).tolist() != b.encode(texts[5], 5).tolist()


def test_dropout_is_drawn_per_occurrence(spark):
    n = 20_000
    words = "consideration " * 500
    docs = spark.createDataFrame([(1, "e " * n), (2, words)], DOCS.rsplit(",", 1)[0])
    got = {r.doc_id: r for r in piece_codec.encode_table(docs).collect()}
    assert abs(got[1].n_pieces / n - 1.1) < 0.01  # one merge in each word
    surface = piece_codec.pieces(piece_codec.MODEL).surface
    ways = "".join(f"{' ' if surface[i].startswith(b' ') else '|'}{i}" for i in got[2].piece_ids).split()
    assert got[1].lossless and got[2].lossless and len(set(ways)) > 10


def test_dropout_against_a_plain_agenda():
    text = "Consideration of internationalisation,  with   gaps\n▁ and 日本語 🎉 x² 12.5% " + "ab" * 40 + " ".join(prose(8, 40))
    units = piece_codec.UNITS.findall(" " + text)
    assert "".join(units) == " " + text
    for rate in (0.1, 0.6):
        own = piece_codec.Encoder(piece_codec.MODEL, rate, 9)
        for key in range(150):
            base = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=9)
            draws = piece_codec._mixed(np.arange(len(units), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(base))
            first = piece_codec.geometric(draws, own.scale)
            want = [i for u, f, d in zip(units, first.tolist(), draws.tolist(), strict=True) for i in own._one(u, own._skips(f, d))[0]]
            assert own.encode_all(["x y", text, ""], [3, key, 4])[1].tolist() == want


def test_one_word_is_segmented_in_many_ways(spark):
    docs = spark.createDataFrame([(i, "internationalisation") for i in range(2_000)], "doc_id long, text string")
    rows = piece_codec.encode_table(docs, dropout=0.3).collect()
    assert all(r.lossless for r in rows) and len({tuple(r.piece_ids) for r in rows}) > 100


def test_full_dropout_leaves_characters():
    text = "consideration " + "y" * 80
    assert len(piece_codec.Encoder(piece_codec.MODEL, 1.0, 1, 4).encode(text, 3)) == len(" " + text)


def test_piece_table_edges(edge, empty):
    got = {(r.doc_id, r.n_pieces, r.lossless) for r in piece_codec.encode_table(edge).select("doc_id", "n_pieces", "lossless").collect()}
    assert (1, None, True) in got and (2, 0, True) in got and all(x[2] for x in got)
    assert piece_codec.encode_table(empty).count() == 0


# --- 4 vectors -------------------------------------------------------------------------------


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(300, 32))
    near = base[:60] + draw.normal(size=(60, 32)) * 0.15
    rows = np.concatenate([base, near, base[:5], base[:1] * 3])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id int, embedding array<double>")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    unit = vector_dedup.unit(rows)
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    found = sum(r.n_links for r in got.values())
    assert 0.9 * true.sum() <= found <= true.sum()
    assert all(got[i].n_links <= true[i].sum() for i in got)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9)) and got[None] == (0, None)


def test_vector_tables(spark):
    rows = [(1, [1.0, 0.0], 7), (1, [0.0, 1.0], 7), (2, [1.0, 0.01], 8), (2, [1.0, 0.01], 8)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("_id", "_vec", "_rep", "n_links", "_w")})
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1)]
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


# --- 5 decontamination -----------------------------------------------------------------------


def test_leaks_and_reparameterised_leaks(spark):
    item = "A train from Paris leaves at 9 and covers 120 km before it reaches the old bridge in Lyon at 11 exactly."
    changed = item.replace("Paris", "Madrid").replace("120", "250").replace("Lyon", "Toledo")
    broken = "A train leaves. " + " ".join(prose(9, 60))
    other = " ".join(prose(4, 40))
    docs = spark.createDataFrame([(1, f"Intro words here. {item} More."), (2, f"Intro. {changed}"), (3, broken), (4, None), (5, ""), (6, other)], "doc_id int, text string")
    bench = spark.createDataFrame([(7, item), (8, " ".join(prose(77, 30))), (9, None), (10, "too short")], "item_id int, text string")
    got = {r.doc_id: r for r in decontam.flag(docs, bench).collect()}
    assert [k for k, r in got.items() if r._contaminated] == [1, 2] or sorted(k for k, r in got.items() if r._contaminated) == [1, 2]
    assert got[1]._same_slots and not got[2]._same_slots and got[2]._items == [7]
    assert not any(r._contaminated for r in decontam.flag(docs, bench.limit(0)).collect())


def test_leaks_in_another_case(spark):
    item = "A train from Paris leaves at 9 and covers 120 km before it reaches the old bridge in Lyon at 11 exactly."
    street = "Die Straße nach Weiß ist im Winter sehr glatt und die Füße werden dabei schnell nass und kalt"
    copies = [item.upper(), item.lower(), item.swapcase(), street.upper(), street.lower(), item.upper().replace("120", "250"), " ".join(prose(4, 40)).upper()]
    docs = spark.createDataFrame([(i, f"Intro. {t}") for i, t in enumerate(copies)], "doc_id int, text string")
    bench = spark.createDataFrame([(7, item), (8, street)], "item_id int, text string")
    got = {r.doc_id: r for r in decontam.flag(docs, bench).collect()}
    assert [got[i]._items for i in range(7)] == [[7], [7], [7], [8], [8], [7], None]
    assert [got[i]._same_slots for i in range(6)] == [True, True, True, True, True, False]
    assert all(got[i]._coverage == 1 for i in range(6))


def test_slots_must_agree(spark):
    item = "First take 5 apples then add 7 pears then count 5 apples again and again until the whole basket is full"
    bad = "First take 3 apples then add 4 pears then count 8 apples again and again until the whole basket is full"
    docs = spark.createDataFrame([(1, bad)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert not decontam.flag(docs, bench).first()._contaminated


def test_one_altered_repeat_and_coinciding_values(spark):
    trip = "A train from Paris goes over the hills and through the long valley until it comes back again to Paris after many quiet hours on the old line"
    fruit = "First take 5 apples then add 7 pears and stir the whole bowl again and again until it is full to the brim"
    copies = [trip, trip.replace("to Paris", "to London"), fruit.replace("5", "6").replace("7", "6"), trip.replace("from Paris", "from Rome").replace("to Paris", "to London")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(copies)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, trip), (2, fruit)], "item_id int, text string")
    got = {r.doc_id: r for r in decontam.flag(docs, bench).collect()}
    assert [got[i]._items for i in range(3)] == [[1], [1], [2]]
    assert [got[i]._same_slots for i in range(3)] == [True, False, False]
    # Windows 13 to 20 of 21 hold the second place: only those are lost.
    assert got[0]._coverage == 1 and abs(got[1]._coverage - 13 / 21) < 1e-9 and got[2]._coverage == 1
    assert not got[3]._contaminated  # neither place speaks for the other


def test_short_slot_rich_and_reworded_items(spark):
    items = {
        1: "Compute 12 + 45 * 7 - 3 + 88 / 4 and then take 9 from it",
        2: "What is the capital of France?",
        3: "The road to Paris is longer than the one that leads over the mountains to the sea",
        4: "A farmer has 12 cows and buys 7 more of them at the market so how many are there now",
        5: "ok",
    }
    texts = {
        1: f"Intro. {items[1]}. More words here.",
        2: f"He asked: {items[2]} Nobody knew.",
        3: "The road to New York is longer than the one that leads over the mountains to the sea",
        4: "A farmer has twelve cows and buys twenty-five more of them at the market so how many are there now",
        5: "A farmer has ٣٤ cows and buys ७ more of them at the market so how many are there now",
        6: "ok then, what is the capital here, of all things; compute 11 + 46 * 8 - 2 + 87 / 5 and stop",
        7: " ".join(str(i) for i in range(60)),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id int, text string")
    got = {r.doc_id: r for r in decontam.flag(docs, bench).collect()}
    assert {k: r._items for k, r in got.items()} == {1: [1], 2: [2], 3: [3], 4: [4], 5: [4], 6: None, 7: None}
    assert [got[k]._same_slots for k in range(1, 6)] == [True, True, False, False, False]


def test_verbatim_items_against_brute_force(spark):
    items = {i: " ".join(prose(500 + i, 6 + i)) for i in range(30)}
    docs = {i: " ".join([*prose(i, 30), *(items[i % 30].split()[: None if i % 3 else 5]), *prose(900 + i, 30)]) for i in range(90)}
    got = decontam.flag(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string"), min_coverage=1.0)
    assert {r.doc_id: r._items or [] for r in got.collect()} == {i: [k for k, x in items.items() if f" {x} " in f" {t} "] for i, t in docs.items()}


def test_decontamination_edges(edge, empty, spark):
    bench = spark.createDataFrame([(1, "Twice the same thing again"), (None, None), (None, "twice the same")], "item_id long, text string")
    names = ["_k1", "_k2", "_items", "_coverage", "_same_slots", "_contaminated", "_text", "_hash"]
    docs = edge.withColumns({c: F.lit("x") for c in names}).withColumn("text", F.when(F.col("doc_id") == 4, F.repeat(F.lit("Word word2 "), 30_000)).otherwise(F.col("text")))
    own = free_prefix(docs)
    got = decontam.flag(docs, bench, prefix=own).collect()
    assert len(got) == 8 and all(r[c] == "x" for r in got for c in names) and not any(r[f"{own}contaminated"] for r in got)
    assert not any(r._contaminated for r in decontam.flag(docs, bench).collect())
    assert decontam.flag(empty, bench).count() == 0


# --- 6 urls ----------------------------------------------------------------------------------


def test_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/">x</a>' for h in hosts)
    rows = [
        (1, "https://a.com/x", ""), (2, "http://WWW.example.com/en/1", ""), (3, "http://b.example.com/en/1", ""), (4, "http://s.net/fr/1?q", ""), (5, "http://s.net/de/1", ""), (6, None, None), (7, "no scheme", ""),
        (8, "http://farm.org/1", link("s.net", "s.net")), (9, "http://x.com", ""), (10, "http://good.org/", link("a.com")), (11, "http://s.net/fr/2", ""), (12, "http://s.net/fr/3", ""),
    ]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert (got[1].rule, got[1].verdict) == ("com/", "allow") and (got[2].rule, got[2].verdict) == ("www.example.com/en/", "allow")
    assert (got[3].rule, got[3].verdict) == ("example.com/en/", "block") and got[4].rule == "net/fr/" and got[5].rule is None
    assert (got[6].host, got[6].path, got[6].rule, got[6].verdict) == ("", "", None, "allow") and got[7].host == ""
    assert got[9].path == "" and got[9].rule is None
    assert got[8].verdict == "block" and got[10].verdict == "allow"  # links to blocked pages, to trusted ones


def test_pagerank_against_dense(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "c", 1.0)]
    hosts = [("a", 1.0, 0.0, 0.0), ("b", 0.0, 2.0, 0.0), ("c", 0.0, 0.0, 3.0)]
    got = {
        r._host: (r._trust, r._neutral, r._distrust)
        for r in url_filter.propagate(spark.createDataFrame(hosts, "_host string, _allow double, _none double, _block double"), spark.createDataFrame(edges, "_src string, _dst string, _w double"), damping=0.85, iterations=6, checkpoint_every=3).collect()
    }
    w = np.zeros((3, 3))
    for s, d, x in edges:
        w["abc".index(s), "abc".index(d)] = x
    fwd, bwd = w / w.sum(1, keepdims=True), w / w.sum(0, keepdims=True)
    seeds = np.array([h[1:] for h in hosts])
    state = seeds.copy()
    for _ in range(6):
        state = np.stack([0.15 * seeds[:, 0] + 0.85 * fwd.T @ state[:, 0], 0.15 * seeds[:, 1] + 0.85 * fwd.T @ state[:, 1], 0.15 * seeds[:, 2] + 0.85 * bwd @ state[:, 2]], axis=1)
    assert all(np.allclose(got[h], state[i]) for i, h in enumerate("abc"))


def test_verdicts_against_dense_propagation(spark):
    draw = random.Random(6)
    hosts = [f"h{i}.org" for i in range(30)] + ["bad.net", "worse.net", "fine.com"] * 6
    rows = []
    for k in range(150):
        host = draw.choice(hosts)
        path = draw.choice(["/fr/x", "/de/x", "/"])
        links = "".join(f"<a class=x href='//{draw.choice(hosts)}/y'>z</a>" for _ in range(draw.randrange(4)))
        rows.append((k, f"https://{host}{path}", f"<!-- <a href='//bad.net/'> --><script>'<a href=//bad.net/>'</script>{links}"))
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), tolerance=1e-9, threshold=0.15).collect()}
    own = {k: url.split("/")[2] for k, url, _ in rows}
    names = sorted({*own.values(), *(d for _, _, h in rows for d in re.findall("class=x href='//([^/]+)/", h))})
    at = {h: i for i, h in enumerate(names)}
    seeds, w = np.zeros((len(names), 3)), np.zeros((len(names), len(names)))
    for k, _, html in rows:
        seeds[at[own[k]], {"allow": 0, None: 1, "block": 2}[got[k].verdict if got[k].rule else None]] += 1
        for d in re.findall("class=x href='//([^/]+)/", html):
            if d != own[k]:
                w[at[own[k]], at[d]] += 1
    fwd, bwd = w / np.maximum(w.sum(1, keepdims=True), 1e-300), w / np.maximum(w.sum(0, keepdims=True), 1e-300)
    state = seeds.copy()
    for _ in range(200):
        state = np.stack([0.15 * seeds[:, 0] + 0.85 * fwd.T @ state[:, 0], 0.15 * seeds[:, 1] + 0.85 * fwd.T @ state[:, 1], 0.15 * seeds[:, 2] + 0.85 * bwd @ state[:, 2]], axis=1)
    share = state[:, 2] / state.sum(1)
    assert all(abs(got[k].distrust - share[at[h]]) < 1e-6 for k, h in own.items())
    assert {r.verdict for r in got.values() if not r.rule} == {"allow", "block"}
    assert all((r.verdict == "block") == (share[at[own[k]]] > 0.15) for k, r in got.items() if not r.rule)


def test_url_edges(spark):
    long = "<p>x</p>" * 50_000
    rows = [(1, "http://a.com", long, 1), (1, "http://a.com", long, 1), (None, None, None, 2), (2, "", "", 3), (3, "http://s.net/fr/", None, 4)]
    docs = spark.createDataFrame(rows, "page_id int, url string, html string, _host int").withColumns({c: F.lit(0) for c in ("_share", "_rule", "verdict", "_html")})
    got = url_filter.judge(docs).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "allow"), (1, "allow"), (2, "allow"), (3, "block")]
    assert url_filter.judge(docs.limit(0)).count() == 0


# --- 7 language ------------------------------------------------------------------------------


def test_forward_backward_against_enumeration():
    draw = np.random.default_rng(0)
    scores, move, begin = draw.normal(size=(1, 4, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    mass = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        x = begin[path[0]] + sum(scores[0, t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))
        for t, k in enumerate(path):
            mass[t, k] += np.exp(x)
    mass /= mass.sum(1, keepdims=True)
    gamma, _ = lang_crf.forward_backward(scores, np.array([4]), move, begin)
    assert np.allclose(gamma[0], mass)
    for run in (1, 2, 3, 64):
        assert np.allclose(lang_crf.label_mass(scores[0], np.array([4]), move, begin, run)[0], mass.sum(0))


def test_label_mass_in_runs_against_forward_backward():
    draw = np.random.default_rng(4)
    lengths = np.array([1, 7, 130, 64, 3])
    flat, move, begin = draw.normal(size=(lengths.sum(), 4)) * 3, draw.normal(size=(4, 4)), draw.normal(size=4)
    padded = np.zeros((5, 130, 4))
    padded[np.arange(130)[None, :] < lengths[:, None]] = flat
    gamma, _ = lang_crf.forward_backward(padded, lengths, move, begin)
    for run in (1, 5, 64):
        assert np.allclose(lang_crf.label_mass(flat, lengths, move, begin, run), gamma.sum(1))


def test_language_held_out_accuracy(spark, sf_dir):
    got = queries.op7_language_id(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(edge, empty):
    none = lang_crf.learn(empty)
    assert {r._lang_pred for r in lang_crf.predict(edge, none).collect()} == {"und"}
    got = {r.doc_id: (r._lang_pred, r._score) for r in lang_crf.predict(edge, lang_crf.learn(edge, sequences=20, epochs=1)).collect()}
    assert got[1] == got[2] == got[3] == got[6] == ("und", 0.0) and got[5][0] == "en"


def test_letters_are_unicode_letters():
    assert lang_crf.WORD.findall("² ½ ⅷ 12 _ ँ") == []
    assert lang_crf.WORD.findall("हिन्दी cafe\u0301 x²") == ["हिन्दी", "cafe\u0301", "x"]


def test_language_slabs_give_equal_masses():
    model = lang_crf.fit({"a": ["ka lo mi nu"] * 3, "b": ["xx yy zz qq"] * 3}, bits=10, lexicon_words=3, sequences=50, epochs=2, seed=1)
    texts = [" ".join(prose(k, 1 + 37 * k)) for k in range(12)] + [None, "", "!!"]
    whole, parts = lang_crf.Tagger(model), lang_crf.Tagger(model, held=5)
    assert np.allclose(whole.masses(texts)[0], parts.masses(texts, slab=50)[0])
    assert whole.masses(texts)[1].tolist() == parts.masses(texts, slab=1)[1].tolist()


def test_language_clashing_columns(edge):
    docs = edge.withColumns({c: F.lit("x") for c in ("_tagged", "__tagged", "_lang_pred", "_score", "lang_pred")})
    model = lang_crf.learn(edge, sequences=20, epochs=1)
    got = lang_crf.predict(docs, model, prefix=free_prefix(docs))
    assert set(docs.columns) <= set(got.columns) and all(r.lang_pred == r._score == r._tagged == "x" for r in got.collect())
    assert {r._lang_pred for r in lang_crf.predict(docs, model).collect()} == {"en", "und"}


def test_hot_text_is_learned_once(spark):
    docs = spark.createDataFrame([("one hot text again", "en")] * 3_000 + [(" ".join(prose(k, 20)), "xx") for k in range(20)], "text string, lang string")
    assert lang_crf.learn(docs, docs_per_lang=10, sequences=20, epochs=1).labels == ["en", "xx"]


# --- 8 lines ---------------------------------------------------------------------------------


def plain_dedup(docs):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    first, holders = {}, defaultdict(set)
    for i, t in docs:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= 10:
                first[k] = min(i, first.get(k, i))
                holders[k].add(i)
    return {i: [x for x in (t or "").split("\n") if len(holders[key(x)]) < 2 or first[key(x)] == i] for i, t in docs}


@pytest.mark.parametrize("hot_rows", [0, 64])
def test_lines_against_brute_force(spark, hot_rows):
    draw = random.Random(5)
    lines = [" ".join(prose(k, 3)) for k in range(30)] + ["short", "", "  ÀÉ accents stay  "]
    docs = [(i, "\n".join(draw.choice(["", " ", "\t"]) + draw.choice([str.upper, str])(draw.choice(lines)) for _ in range(draw.randrange(1, 90)))) for i in range(60)] + [(60, None), (61, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id int, text string"), hot_rows=hot_rows).collect()
    want = plain_dedup(docs)
    assert {r.doc_id: r.text for r in got} == {i: "\n".join(v) for i, v in want.items()}
    assert all(r._n_lines - r._n_dropped == len(want[r.doc_id]) or not want[r.doc_id] for r in got)


def test_line_clashing_columns(edge):
    names = ["_th", "_bits", "_kept", "_n_lines", "_n_dropped", "_line", "_h1"]
    docs = edge.withColumns({c: F.lit("x") for c in names})
    own = free_prefix(docs)
    got = line_dedup.dedup_lines(docs, prefix=own).collect()
    assert len(got) == 8 and all(r[c] == "x" for r in got for c in names) and all(r[f"{own}n_dropped"] == 0 for r in got)
    assert {type(r._n_lines) for r in line_dedup.dedup_lines(docs).collect()} == {int}


def test_line_edges(edge, empty):
    got = line_dedup.dedup_lines(edge).collect()
    assert len(got) == 8 and all(r._n_dropped == 0 for r in got) and all(r.slot == 1 for r in got)
    assert line_dedup.dedup_lines(empty).count() == 0


# --- 9 licences ------------------------------------------------------------------------------


def labels_of(block):
    """The labels of one block: enough words and enough naming words of a template, whose found words aren't just some of another label's."""
    words, met = set(licence_scan._words(block)), []
    for label, text in licence_scan.TEMPLATES:
        own = set(licence_scan._words(text))
        names = own.difference(*[licence_scan._words(t) for other, t in licence_scan.TEMPLATES if other != label])
        called = own & set(licence_scan.NAMES.get(label, "").split())
        if len(words & own) >= 0.8 * len(own) - 1e-9 and len(words & names) >= 0.8 * len(names) - 1e-9 and called <= words:
            met.append((label, words & own))
    return {label for label, found in met if not any(found < more for other, more in met if other != label)}


def test_each_notice_has_its_own_label_only(spark):
    docs = [(i, text) for i, (_, text) in enumerate(licence_scan.TEMPLATES)]
    got = {r.doc_id: (r.labels, r.base_labels) for r in licence_scan.scan(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    for i, (label, _) in enumerate(licence_scan.TEMPLATES):
        labels, base = got[i]
        assert set(labels.split(",")) == {label} | ({base} - {""})


def test_unlisted_licences_have_no_label(spark):
    texts = {
        "Released under the BSD license.": "", "The film was released under the studio license.": "", "Released under the Apache License.": "apache", "Licensed under CC BY-ND 4.0.": "", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "This work is licensed under the Zope Public License, version 3.": "", "Licensed under the Artistic License, Version 2.0.": "",
        "Licensed under the MIT License or the Apache License, Version 2.0.": "apache,mit", "Licensed under the GNU Affero General Public License, version 3.": "agpl,gpl",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.labels for r in licence_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_licences_against_brute_force(spark):
    texts = [t for _, t in licence_scan.TEMPLATES]
    docs = [(i, f"Intro words. {t}\nMore " + " ".join(prose(i, 20))) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "an MIT  License and mit-license; General Public\nLicense"), (93, "public license of general interest"), (94, " ".join(prose(1, 50)))]
    got = {r.doc_id: r for r in licence_scan.scan(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    for i, t in docs:
        own = set()
        for block in re.split(r"\x01|(?<=[.!?])\s+", re.sub(r"(?m)^([^\n]{0,39})\n", "\\1\x01", t or "")):
            own |= labels_of(block)
        base = {x for x in got[i].base_labels.split(",") if x}
        assert set(got[i].labels.split(",")) - {""} == own | base
    assert (got[92].n_base, got[92].first_word, got[92].last_word, got[92].base_labels) == (3, 1, 6, "gpl,mit")
    assert got[93].n_base == 0 and got[93].first_word is None and got[94].score == 0 and got[90].n_words == 0


def test_wrapped_notices(spark):
    notice = licence_scan.TEMPLATES[1][1]
    wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(notice, 66))
    docs = [(1, f"/*\n * Copyright\n *\n{wrapped}.\n */"), (2, "\n".join(notice.split())), (3, wrapped.replace("\n", "\r\n"))]
    got = {r.doc_id: r.labels for r in licence_scan.scan(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == {1: "mit", 2: "", 3: "mit"}


def test_licence_edges(edge, empty):
    assert licence_scan.scan(edge).count() == 8 and licence_scan.scan(empty).count() == 0


# --- 10 near duplicates ----------------------------------------------------------------------


def test_near_duplicates_against_brute_force(spark):
    draw = random.Random(2)
    texts = {i: prose(i, 120) for i in range(40)}
    for i in range(40, 100):
        own = list(texts[i % 12])
        for _ in range(i % 5):
            own[draw.randrange(len(own))] = "edit" + str(draw.randrange(10**6))
        texts[i] = own
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id int, text string")
    got = {r.doc_id: r.group_id for r in minhash_icws.near_duplicates(docs).collect()}
    sets = {i: set(zip(*[w[k:] for k in range(5)], strict=False)) for i, w in texts.items()}
    group = {i: i for i in texts}
    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.82 and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    assert all(got[a] == got[b] for a, b in itertools.combinations(texts, 2) if group[a] == group[b])
    assert all(len(sets[i] & sets[got[i]]) for i in texts)


def weighted_groups(texts, share=0.01, strength=1.0, threshold=0.8):
    """Groups by brute force: the weighted Jaccard similarity of every pair, by its definition."""
    counts = {}
    for i, t in texts.items():
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        if words:
            counts[i] = defaultdict(int)
            for k in range(max(1, len(words) - 4)):
                counts[i][tuple(words[k : k + 5])] += 1
    df = defaultdict(int)
    for own in counts.values():
        for x in own:
            df[x] += 1
    n = len(texts)
    idf = {x: 1 + strength * min(1.0, max(0.0, np.log(n / d) / np.log(1 / share))) for x, d in df.items()}
    weights = {i: {x: (1 + np.log(c)) * idf[x] for x, c in own.items()} for i, own in counts.items()}
    group = {i: i for i in texts}
    close = 0
    for a, b in itertools.combinations(sorted(weights), 2):
        shared = sum(min(weights[a][x], weights[b][x]) for x in weights[a].keys() & weights[b].keys())
        if shared and shared / (sum(weights[a].values()) + sum(weights[b].values()) - shared) >= threshold:
            close += 1
            low, high = sorted((group[a], group[b]))
            if low != high:
                group = {i: low if g == high else g for i, g in group.items()}
    return group, close


def test_near_duplicates_against_weighted_brute_force(spark):
    draw = random.Random(12)
    texts = {}
    base = [prose(7_000 + i, 110) for i in range(30)]
    common = prose(1, 25)  # a passage that many documents share
    for i in range(420):
        kind = i % 7
        if kind < 3:  # one large group, from a few to many edits
            own = list(base[0])
            for _ in range(draw.randrange(0, 9)):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(10**6)}"
        elif kind < 5:
            own = list(base[1 + i % 29])
            for _ in range(draw.randrange(0, 5)):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(10**6)}"
        else:  # unrelated, but for the shared passage and a repeated word
            own = prose(i, 60) + common + ["again"] * 12
        texts[i] = " ".join(own)
    want, close = weighted_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.group_id for r in minhash_icws.near_duplicates(docs, block_rows=32).collect()}
    assert close > 400 and got == want


def test_near_duplicate_weights_count_all_documents(spark):
    docs = spark.createDataFrame([(f"a b c d e {i}",) if i % 2 else (f"f g h i j {i}",) for i in range(400)] + [("a b c d e",)], "_text string").repartition(7)
    own = minhash_icws.fit_weights(docs, 1.0, 0.01, 5)
    assert own.documents == 401 and sorted(own.df.tolist()) == [200.0, 201.0]


def test_near_duplicate_clashing_columns(edge):
    docs = edge.withColumns({c: F.lit("x") for c in ("_id", "_text", "_rep", "_band", "class_id", "group_id")})
    assert minhash_icws.near_duplicates(docs).count() == 6


def test_near_duplicate_edges(edge, empty):
    got = {r.doc_id: r.group_id for r in minhash_icws.near_duplicates(edge).collect()}
    assert got == {i: i for i in range(1, 7)}
    assert minhash_icws.near_duplicates(empty).count() == 0


def test_icws_estimates_weighted_jaccard():
    draw = np.random.default_rng(3)
    codes = np.sort(draw.integers(0, 1 << 52, 400).astype(np.uint64))
    w = draw.uniform(0.5, 3, 400)
    a, b = slice(0, 300), slice(100, 400)
    one = np.array([0])
    shot = [minhash_icws.icws(minhash_icws.Shingles(None, codes[s], None, one, one), w[s], 2_000, 1)[0] for s in (a, b)]
    true = w[100:300].sum() / w.sum()
    assert abs((shot[0] == shot[1]).mean() - true) < 0.05


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_keeps_columns_and_round_trips(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == want and docs.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.where("NOT lossless").count() == 0 and last.count() == docs.count()


def test_pipeline_edges(spark, edge, empty, sf_dir):
    names = ("_th", "_k1", "_tagged", "_id", "_text", "_n_lines", "_lang_pred", "_items", "_rep")
    docs = edge.withColumns({c: F.lit("x") for c in names}).withColumn("n_chars", F.char_length("text").cast("bigint"))
    kept = {"language_id": {4, 5, None}, "line_dedup": {None, 1, 2, 3, 4, 5, 6}, "minhash_near_dedup": {None, 1, 2, 3, 4, 5, 6}, "benchmark_decontamination": {None, 1, 2, 3, 4, 5, 6}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        rows = got.collect()
        assert {r.doc_id for r in rows} == kept[name] and sum(r.doc_id == 5 for r in rows) == 2 and all(r[c] == "x" for r in rows for c in names)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 8


def test_line_query_hashes_kept_text(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: hashlib.sha256("\n".join(v).encode()).hexdigest() for i, v in plain_dedup(texts).items()}
    assert {r.doc_id: r.kept_sha256 for r in queries.op8_line_dedup(spark, sf_dir).collect()} == want


def test_contamination_of_long_lists(spark):
    """Lists of numbers, number words, names and apostrophes of any length are one match each."""
    n = 60_000
    item = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    lists = [",".join("7" * n), " ".join(["one"] * n), " ".join(["Anna"] * n), "'".join(["ab"] * n), "-".join(["Anna"] * n) + " five sixteen sixty-one threefold"]
    docs = spark.createDataFrame([(k, f"{text}. {item}.") for k, text in enumerate(lists)] + [(9, ",".join("7" * n))], "doc_id long, text string")
    found = {r["doc_id"]: r["_contaminated"] for r in decontam.flag(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {0: True, 1: True, 2: True, 3: True, 4: True, 9: False}
