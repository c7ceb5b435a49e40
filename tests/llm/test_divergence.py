"""Divergence audit against plain Python, and its cube in small blocks."""

import re
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm import divergence, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, min_docs=30, top=50):
    """Rows are (text, lang, source)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: counts[x, s] for x, s in counts if x == lang}
        total = sum((c for c in own.values()), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(total)
        for s in own:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in own if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:limit])]
    return sorted(out)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()
    got = queries.op13_source_divergence(spark, sf)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == by_hand(rows)


@pytest.mark.parametrize("group_block, term_block, held", [(1, 1, 1), (2, 3, 5), (100, 100, 10**6)])
def test_blocks_of_any_size(spark, monkeypatch, group_block, term_block, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = [(f"word{'abcdefgh'[i % 8]} the {'abc'[i % 3] * 2} Zz", "en" if i % 3 else None, f"s{i % 5}") for i in range(60)]
    rows += [("das der", "de", "only"), (None, "de", None), ("", "xx", "one"), ("!!", "xx", "two"), ("", "xx", None)]
    rows += [("Ä é İ a_b c1d", "en", "s1")] * 4
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string")
    got = divergence.audit(df.repartition(3), min_docs=4, top_terms=3, group_block=group_block, term_block=term_block)
    got = sorted(map(tuple, got.collect()))
    assert got == by_hand(rows, 4, 3)
    assert [r for r in got if r[0] == "xx"] == [("xx", a, "pair", b, 0, k) for a, b, k in
                                               (("", "one", 1), ("", "two", 2), ("one", "", 1), ("one", "two", 2),
                                                ("two", "", 1), ("two", "one", 2))]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F
    n, total, v = 10**14 + 3, 3 * 10**14 + 1, 12345
    df = spark.createDataFrame([(n, total, v), (0, 0, 0)], "n long, total long, v long")
    got = [r.p for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * v), None]
