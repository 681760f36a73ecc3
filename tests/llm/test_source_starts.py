"""First prefixes of the source audit are counted where the terms are made."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from quillog.llm import source_audit as sa


def test_first_prefixes_come_counted_and_once_a_document(spark):
    texts = ["abcd abcde abc ab", "abcdefghi abcdefgxx abcd", "abc", "", None, "é éa abcd abcd"]
    docs = spark.createDataFrame([("en", "s", t) for t in texts], "lang string, source string, text string").repartition(2)
    want = Counter(p for t in texts for p in {(w + sa.END)[:4] for w in sa.terms_of(t)})
    rows = sa.term_rows(docs, held_bytes=1)
    have = {r.term: r.d for r in rows.where(F.col("shared") == sa.START).groupBy("term").agg(F.sum("docs").alias("d")).collect()}
    assert {bytes(k): v for k, v in have.items()} == dict(want)
    terms = Counter(w + sa.END for t in texts for w in sa.terms_of(t))
    counted = {bytes(r.term): r.n for r in rows.where(F.col("shared") != sa.START).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert counted == dict(terms)


def test_most_shared_prefixes_need_no_search_for_their_width(monkeypatch):
    asked = []
    real = sa.shared_width
    monkeypatch.setattr(sa, "shared_width", lambda a, b, first: asked.append((a, b)) or real(a, b, first))
    held = sa.Held(4)
    held.add("en", "s", "abcd abcde abcdefghi abcdefgxx abcdefghijklmnop abcdefghijklmnopq zzzz")
    assert asked == [(b"abcdefghi", b"abcdefghijklmnop"), (b"abcdefghijklmnop", b"abcdefghijklmnopq")]
    widths = {r["term"].rstrip(sa.END): r["shared"] for b in held.rows() for r in b.to_pylist() if r["shared"] != sa.START}
    assert widths == {b"abcd": 0, b"zzzz": 0, b"abcde": 4, b"abcdefghi": 4, b"abcdefghijklmnop": 8, b"abcdefghijklmnopq": 16, b"abcdefgxx": 4}
