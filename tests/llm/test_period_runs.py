"""Run detection against a plain search of every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import period_runs, queries


def runs_by_hand(words, exponent=4, min_words=6):
    def smallest_period(part):
        return next(q for q in range(1, len(part) + 1) if part[q:] == part[:len(part) - q])

    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(min_words, exponent * q) and smallest_period(words[at:end + q]) == q:
                found.append((at, length, q))
            at = max(end, at + 1)
    return sorted(found)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text, rewrite=True):
    words = split(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


PARTS = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7))


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=6), st.integers(1, 9))
def test_any_words_read_in_any_steps(parts, step):
    words = [w for part, times in parts for w in part * times]
    numbers = np.array(words, np.int64)
    want = runs_by_hand(words)
    assert period_runs.find_runs(numbers) == want
    online, seen = period_runs.SquareCatchers(), []
    for at in range(0, len(words), step):
        seen += [tuple(r) for r in online.append(numbers[at:at + step])]
    assert online.runs() == want
    assert {q for _, _, q in want} <= {q for _, _, q in seen}


def test_a_square_is_reported_with_the_word_that_completes_it():
    online = period_runs.SquareCatchers()
    reports = [len(online.append(np.array([w]))) for w in [1, 2, 3, 1, 2, 3, 1, 2, 3, 9]]
    assert reports == [0, 0, 0, 0, 0, 1, 0, 0, 0, 0]


def test_work_grows_with_the_words_not_with_their_square():
    """A word repeated, a long period, and many short runs; each a million words."""
    n = 1_000_000
    rng = np.random.default_rng(5)
    many = np.repeat(rng.permutation(n // 8), 8)
    for words, runs in ((np.zeros(n, np.int64), 1), (np.tile(np.arange(1000), n // 1000), 1), (many, n // 8)):
        assert len(period_runs.find_runs(words)) == runs


def test_other_exponents():
    words = np.array([1, 2, 1, 2, 1, 2, 7, 7, 7, 7])
    assert period_runs.find_runs(words, 3, 2) == [(0, 6, 2), (6, 4, 1)]
    assert period_runs.find_runs(words, 5, 2) == []
    with pytest.raises(ValueError):
        period_runs.SquareCatchers(2)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {d: expected(d, t) for d, t in docs}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (None, "x y " * 5), (None, "a a " * 7),
            (5, "é ß " * 4 + "é"), (6, "w " * 200_000), (7, "a b " * 3)]
    df = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, runs int, collapsed string")
    got = period_runs.collapse_runs(df.repartition(3)).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), str([(0, 200_000, 1)] if d == 6 else runs_by_hand(split(t)))) for d, t in rows)
    assert sorted((str(r.doc_id), str([tuple(x) for x in r.runs])) for r in got) == want
    kept = {r.doc_id: r.collapsed for r in got if r.doc_id is not None}
    assert kept == {1: "", 2: "", 3: "", 4: "a", 5: "é ß", 6: "w", 7: "a b a b a b"}
    assert period_runs.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
