"""Transform and common prefixes against sorted suffixes; removal of repeats against a plain scan."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from ledgerlens.llm import queries, suffix_dedup
from ledgerlens.llm.collection_bwt import CollectionBwt

STORE = fs.LocalFileSystem()
WORD = st.binary(min_size=1, max_size=24).map(lambda b: bytes(x % 3 + 97 for x in b))


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=10), st.integers(1, 6), st.sampled_from([1, 2, 7, 1 << 17]))
def test_sequences_equal_the_sorted_suffixes(tmp_path_factory, strings, cap, chunk):
    strings = strings + strings[:2]
    own = CollectionBwt(strings, STORE, str(tmp_path_factory.mktemp("bwt")), cap, chunk).build()
    suffixes = sorted((([c + 1 for c in s[at:]] + [0, i]), i, at) for i, s in enumerate(strings) for at in range(len(s) + 1))

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) - 2 and x[n] == y[n]:
            n += 1
        return min(n, cap)

    bwt, lcp = own.sequences()
    assert bwt.tolist() == [strings[i][at - 1] if at else 255 for _, i, at in suffixes]
    assert lcp.tolist() == [common(x[0], y[0]) for x, y in zip([([0, 0],), *suffixes], suffixes)]
    classes, want = {}, {}
    for i, at, kind in zip(*(a.tolist() for a in own.repeated_windows())):
        classes.setdefault(kind, []).append((i, at))
    for i, s in enumerate(strings):
        for at in range(len(s) - cap + 1):
            want.setdefault(s[at:at + cap], []).append((i, at))
    assert sorted(sorted(c) for c in classes.values()) == sorted(sorted(w) for w in want.values())


def test_the_file_of_a_round_replaces_the_one_before(tmp_path):
    own = CollectionBwt([b"banana", b"ananas"], STORE, str(tmp_path), 3)
    while len(own.active):
        assert sorted(p.name for p in tmp_path.iterdir()) == [f"rows-{own.round}"]
        own._insert()
    assert own.round == 6


def removed_by_hand(rows, length=100):
    """Per (id, text), in this order: n_bytes, n_removed, n_spans, kept."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        change = np.zeros(len(data) + 1, int)
        for at in range(len(data) - length + 1):
            w = hashlib.md5(data[at:at + length]).digest()
            if w in seen:
                change[at] += 1
                change[at + length] -= 1
            seen.add(w)
        gone = np.cumsum(change[:-1]) > 0
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want = {d: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (d, _), w in zip(docs, removed_by_hand(docs))}
    got = queries.op12_suffix_dedup(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert sum(w[1] for w in want.values()) > 100_000


def mixed_texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gammä", "delta", "ε", "zeta\n"]
    passages = [" ".join(rng.choices(words, k=40)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 3))]
        out.append(rng.choice(passages).join(parts) if rng.random() < 0.7 else " ".join(parts))
    return out + out[:3]


@pytest.mark.parametrize("length, split, bucket", [(32, 3, 500), (100, 2000, 1 << 22), (100, 2, 1)])
def test_removal_in_small_groups(spark, length, split, bucket):
    rows = list(enumerate(mixed_texts(length, 40)))
    df = spark.createDataFrame([(i, t, 1, b"") for i, t in rows], "doc_id int, text string, n_bytes int, kept binary")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept))
           for r in suffix_dedup.remove_repeats(df.repartition(4), length, split, bucket).collect()}
    assert [got[i] for i, _ in rows] == removed_by_hand(rows, length)


def test_defined_cases(spark):
    line = "".join(chr(97 + i % 26) for i in range(150))
    other = "".join(chr(65 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(1, None), (1, line), (1, other), (2, ""), (3, "ab" * 40), (4, "x" * 3000), (5, other), (5, other), (5, other),
            (None, line), (None, None), (None, line + other), (6, "é" * 80), (7, "y" + "é" * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept))
                 for r in suffix_dedup.remove_repeats(df.repartition(3)).collect())
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = sorted((str(d), *w) for (d, _), w in zip(ordered, removed_by_hand(ordered)))
    assert got == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_equal_windows_have_equal_keys_in_any_stretch():
    rows = list(enumerate(mixed_texts(9, 15)))
    found = {}
    for i, text in rows:
        data = text.encode()
        for at in range(0, len(data) - 99, 64):
            part = np.frombuffer(data[at:at + 64 + 99], np.uint8)
            key, string, first, size, anchor = suffix_dedup.anchored_strings(part, np.array([0]), np.array([len(part)]), 100)
            covered = [w for f, s in zip(first.tolist(), size.tolist()) for w in range(f, f + s - 99)]
            assert covered == list(range(len(part) - 99))
            for f, s, a, k in zip(first.tolist(), size.tolist(), anchor.tolist(), key.tolist()):
                for w in range(f, f + s - 99):
                    window = data[at + w:at + w + 100]
                    assert found.setdefault(window, (k, f + a - w)) == (k, f + a - w)
    assert len(found) > 1000
