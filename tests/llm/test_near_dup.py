"""Near duplicates against an all-pairs computation with Python sets."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import near_dup, queries
from ledgerlens.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_force(rows, n=4, percent=80):
    """[(doc_id, size, component, kept)] by inverted lists and union-find over all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen, copies = {}, {}
    for i, s in enumerate(sets):
        if s and frozenset(s) in copies:
            root[find(i)] = find(copies[frozenset(s)])
            continue
        copies[frozenset(s)] = i
        common = {}
        for g in s:
            for j in seen.setdefault(g, []):
                common[j] = common.get(j, 0) + 1
            seen[g].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def result(df):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_matches_all_pairs(spark, size):
    sf = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(result(queries.op10_minhash_near_dedup(spark, sf))) == ordered(brute_force(rows))


def test_chain_group_and_common_passage(spark):
    """A chain whose ends are unlike, a group around one text, and a passage that many unlike texts share."""
    rows, base = [], [f"w{i}" for i in range(120)]
    for step in range(30):                                     # neighbours alike, ends unlike
        rows.append((1000 + step, " ".join(base[:step * 3] and [f"c{i}" for i in range(step * 3)] + base[step * 3:] or base)))
    for copy in range(60):                                     # edits at different places of one text
        t = [f"g{i}" for i in range(150)]
        for e in range(copy % 6):
            t[(copy * 31 + e * 17) % 150] = f"x{copy}-{e}"
        rows.append((2000 + copy, " ".join(t)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(3000 + i, " ".join(f"u{i}-{j}" for j in range(70)) + " " + passage) for i in range(40)]
    rows += [(4000 + i, "Same  TEXT here\nagain and again") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(result(near_dup.near_duplicates(df, words=4))) == ordered(brute_force(rows))


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three four five"),
            (7, "one two three four five"), (7, "one two three four five"), (None, "one two three four five"),
            (8, "a " * 50000), (9, "A " * 40000), (10, "é É é É é")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rid int, value string")
    assert ordered(result(near_dup.near_duplicates(df, words=4))) == ordered(brute_force(rows))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("id_of", [lambda i: None, lambda i: 7, lambda i: None if i % 3 else i])
def test_many_rows_without_an_id_or_under_one(spark, id_of):
    """Texts are looked up by id and text, so n such rows never meet each other."""
    n = 3000
    texts = [" ".join(f"w{i // 2}-{j}" for j in range(12)) + (" end" if i % 2 else "") for i in range(n)]
    df = spark.createDataFrame([(id_of(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    reps = near_dup.written(near_dup.sketches(df, 4, 32).withColumn("rid", F.monotonically_increasing_id()), "reps")
    assert near_dup.full_sets(df, reps, 4).count() == n
    got = near_dup.near_duplicates(df, words=4).collect()
    assert sorted(r.n_shingles for r in got) == [9] * (n // 2) + [10] * (n // 2)
    if id_of(0) == 0:
        pairs = {i: {id_of(i), id_of(i ^ 1)} - {None} for i in range(n)}
        want = sorted(str(min(pairs[i], default=None)) for i in range(n))
        assert sorted(str(r.component_id) for r in got) == want


def test_long_words_in_another_order_are_other_words(spark):
    blocks = [c * (1 << 14) for c in "abc"]
    words = ["".join(blocks), "".join(blocks[::-1]), blocks[1] + blocks[0] + blocks[2], "".join(blocks)]
    df = spark.createDataFrame([(i, w + " x y z") for i, w in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, words=4).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (5, 5), (200, 150), (150, 201)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 3, 3: 3, 200: 150, 150: 150, 201: 150}


def test_floor_of_shared_values():
    assert near_dup.shared_floor(32, 80) == 15
    assert near_dup.shared_floor(32, 100) == 32
