"""Periodic runs, source audit and substring dedup against brute force, SQL and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import count, pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillog.llm import periodic_runs, queries, source_audit, span_dedup

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, "a b " * 40, "en", "b"), (4, "x" * 30_000, "en", "b"), (5, "ha " * 70, "en", "a"), (5, "ha " * 70, "en", "a"), (6, "é\x1c!! ???", "fr", None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"runs": F.lit(1), "_runs": F.lit("x"), "_spans": F.lit(2), "id": F.lit(3), "term": F.lit("t"), "a.b c": F.lit(4)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 11 periodic runs ------------------------------------------------------------------------


def brute_runs(words, min_length, min_exponent):
    n, out = len(words), []
    for s in range(n):
        for e in range(s + min_length, n + 1):
            q = next(q for q in range(1, e - s + 1) if all(words[i] == words[i + q] for i in range(s, e - q)))
            if e - s >= min_exponent * q and (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == n or words[e] != words[e - q]):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_by_period(words, min_length=24, min_exponent=3):
    """Stretches of each period in turn, those of a smaller period left out."""
    n, found = len(words), set()
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = [ids[w] for w in words]
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q) and not any(q % d == 0 and all(x[k] == x[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=4), st.integers(0, 9), st.lists(st.sampled_from([b"a", b"b"]), max_size=12))
def test_runs_match_brute_force(head, unit, times, tail):
    words = head + unit * times + tail
    for least, exponent in ((4, 2), (8, 3), (24, 3), (5, 4)):
        assert periodic_runs.runs_of(words, least, exponent) == brute_runs(words, least, exponent)


def test_runs_match_periods_on_longer_texts():
    for seed in range(12):
        draw = random.Random(seed)
        words = [draw.choice([b"ka", b"lo", b"mi"]) for _ in range(60)]
        for _ in range(4):
            at, size = draw.randrange(len(words)), draw.randrange(1, 30)
            words[at:at] = words[at : at + size] * draw.randrange(2, 6)
        words = words[:900]
        assert periodic_runs.runs_of(words) == runs_by_period(words)


def test_long_periodic_texts_are_fast():
    words = [b"a"] * 120_000
    assert periodic_runs.runs_of(words) == [(0, 120_000, 1)]
    words = [b"%d" % (i % 977) for i in range(120_000)]
    assert periodic_runs.runs_of(words) == [(0, 120_000, 977)]


def test_a_window_that_only_hashes_alike_makes_no_run(monkeypatch):
    monkeypatch.setattr(periodic_runs, "window_repeats", lambda *_: True)
    assert periodic_runs.runs_of([b"%d" % i for i in range(200)]) == []


def test_runs_edges(spark, edge, empty):
    got = periodic_runs.find(edge, prefix="__").collect()
    assert len(got) == 8 and got[0]["a.b c"] == 4 and got[0].runs == 1 and got[0]._runs == "x"
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.text, r["__n_words"], [tuple(x) for x in r["__runs"]]))
    assert by[1] == by[2] == by[3] == [("", 0, [])]
    assert by[None] == [("a b", 80, [(0, 80, 2)])]
    assert by[5] == [("ha", 70, [(0, 70, 1)])] * 2
    assert by[4] == [("x" * 30_000, 1, [])] and by[6] == [("é\x1c!! ???", 2, [])]
    assert periodic_runs.find(empty).count() == 0


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_query_of_runs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_periodic_runs(spark, sf_dir).collect()
    assert len(got) == len(texts) and sum(r.n_runs > 0 for r in got) > 10
    for r in got:
        words = planted(r.doc_id, texts[r.doc_id])
        if len(words) > 1_500 and zlib.crc32(str(r.doc_id).encode()) % 10:
            continue  # the other way to find them takes quadratic time; periodic tails are all compared
        runs = runs_by_period(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best), r.doc_id
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


# --- 12 source audit -------------------------------------------------------------------------


def brute_audit(rows, least, top):
    docs = [(lang or "", source or "", Counter(bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode()).split())) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = {t for t, n in held.items() if n >= least}
        counts = defaultdict(Counter)
        for own, source, words in docs:
            if own == lang:
                counts[source].update({t: n for t, n in words.items() if t in kept})
        rate = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        whole = sum(counts.values(), Counter())
        for source, own in counts.items():
            pairs = [(-sum(abs(rate(own, t) - rate(c, t)) for t in kept), s.encode()) for s, c in counts.items() if s != source]
            terms = [(rate(whole, t) - rate(own, t), t) for t in kept if own[t] and rate(own, t) > rate(whole, t)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


def corpus(seed, n):
    draw = random.Random(seed)
    words = ["ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "Zürich", "zürich", "été", "日本語の長い言葉です", "x" * 70, "x" * 69 + "y", *(f"rare{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(draw.choices(words, weights, k=draw.randrange(0, 30))), draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", "C", None, "é"])) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "salts": 1}, {"first": 1}])
def test_audit_matches_brute_force(spark, options):
    rows = corpus(3, 400)
    got = source_audit.audit(spark.createDataFrame(rows, DOCS).repartition(5), least=12, top=6, **options)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 12, 6)


def test_refinement_counts_documents_not_terms(spark):
    # Each of ten documents has forty terms of one prefix, which no prefix count may take for more documents.
    rows = [(i, " ".join(f"prefix{chr(97 + i)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(40)) + " prefixed", "en", "a") for i in range(10)]
    terms = source_audit.term_rows(spark.createDataFrame(rows, DOCS))
    assert [r.prefix for r in source_audit.frequent_terms(terms, 10).collect()] == [b"prefixed\0"]
    assert source_audit.frequent_terms(terms, 11).count() == 0


def test_shared_widths():
    for a, b in pairwise(sorted(w + b"\0" for w in (b"a", b"abcd", b"abcde", b"abcdefgh", b"abcdefghi"))):
        width = source_audit.shared_width(a, b)
        common = next(i for i in range(99) if a[i : i + 1] != b[i : i + 1])
        assert width == max([w for w in (4, 8, 16) if w <= common], default=0)


def test_rates_are_exact_beyond_longs(spark):
    row = spark.createDataFrame([(9_000_000_000_000, 9_100_000_000_001, 7)], "n long, total long, v long")
    got = row.select(source_audit.rate(F.col("n"), F.col("total"), F.col("v")).alias("p")).first().p
    assert got == 1 + 10**9 * (9_000_000_000_000 + 5) // (9_100_000_000_001 + 35)


def test_audit_edges(edge, empty):
    got = sorted(map(tuple, source_audit.audit(edge, least=2).collect()))
    rows = [tuple(r) for r in edge.select("doc_id", "text", "lang", "source").collect()]
    assert got == brute_audit(rows, 2, 50)
    assert [r[:4] for r in got] == [("en", "a", "pair", "b"), ("en", "b", "pair", "a")]
    assert all(r.value == 0 for r in source_audit.audit(edge, least=99).collect())
    assert source_audit.audit(empty).count() == 0


# --- 13 substring dedup ----------------------------------------------------------------------


def brute_removed(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in split:
        for k in range(len(ws) - window + 1):
            if i is not None:
                key = tuple(ws[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out, key=repr)


def spliced(seed, n, vocabulary, window):
    """Documents that copy stretches of one another, whole texts and pieces shorter than a window."""
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(0, 4 * window))]
        for _ in range(draw.randrange(4)):
            if texts:
                other = draw.choice(texts)
                at, size = draw.randrange(len(other) + 1), draw.randrange(window // 2, 3 * window)
                k = draw.randrange(len(words) + 1)
                words[k:k] = other[at : at + size]
        if texts and draw.random() < 0.2:
            words = list(draw.choice(texts))
            if words and draw.random() < 0.7:
                words[draw.randrange(len(words))] = "edit"
        texts.append(words)
    ids = list(range(n))
    draw.shuffle(ids)
    return [(i, " ".join(w)) for i, w in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("seed,vocabulary,window,anchor,options", [(1, 40, 12, 5, {}), (2, 2, 8, 3, {}), (3, 1, 6, 2, {}), (4, 300, 50, 19, {}), (5, 3, 10, 1, {"broadcast_bytes": 0}), (6, 40, 12, 11, {"broadcast_bytes": 0})])
def test_removed_words_match_brute_force(spark, seed, vocabulary, window, anchor, options):
    rows = spliced(seed, 120, [f"w{i}" for i in range(vocabulary)], window)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = span_dedup.remove_repeats(docs, window=window, anchor=anchor, **options).collect()
    assert sorted(((r.doc_id, r._n_words, r._n_removed, r.text) for r in got), key=repr) == brute_removed(rows, window)
    texts = {i: t.split() for i, t in rows}
    for r in got:  # spans hold the same words in document and source, and cover what was removed
        covered = set()
        for s in r._spans:
            assert s.source < r.doc_id and s.length >= window
            assert texts[r.doc_id][s.start : s.start + s.length] == texts[s.source][s.source_start : s.source_start + s.length]
            covered.update(range(s.start, s.start + s.length))
        assert len(covered) == r._n_removed


def test_one_passage_in_very_many_documents(spark):
    draw, numbers = random.Random(7), count()
    fresh = lambda n: [f"v{next(numbers)}" for _ in range(n)]
    passage = fresh(60)
    rows = [(i, " ".join(fresh(draw.randrange(20)) + passage + fresh(draw.randrange(20)))) for i in range(400)]
    got = span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r._n_removed) for r in got) == [(i, 60 if i else 0) for i in range(400)]
    assert all(len(r._spans) == (r.doc_id > 0) for r in got)


def test_digests_that_differ_from_the_source_remove_nothing(spark, monkeypatch):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = span_dedup.repeated_parts
    monkeypatch.setattr(span_dedup, "repeated_parts", lambda *a, **k: real(*a, **k).withColumn("digest", F.col("digest") + 1))
    assert {r._n_removed for r in span_dedup.remove_repeats(docs, window=4, anchor=2).collect()} == {0}


def test_substring_edges(edge, empty, spark):
    got = span_dedup.remove_repeats(edge, prefix="__").collect()
    assert len(got) == 8 and got[0]["a.b c"] == 4 and got[0].id == 3 and got[0]._spans == 2
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r["__n_words"], r["__n_removed"], r.text) for r in got), key=repr) == brute_removed(rows, 50)
    assert span_dedup.remove_repeats(empty).count() == 0
    named = spark.createDataFrame([("b", "x y z w"), ("a", "q x y z w")], "k string, t string")
    left = {r.k: (r.t, [(s.source, s.source_start) for s in r._spans]) for r in span_dedup.remove_repeats(named, id_col="k", text_col="t", window=3, anchor=1).collect()}
    assert left == {"a": ("q x y z w", []), "b": ("", [("a", 1)])}
