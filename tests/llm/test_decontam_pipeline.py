"""Decontamination against exhaustive scoring, and the whole pipeline stage by stage."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import decontam, quality_net, queries, tokens
from test_near_dup import brute_force
from test_tokens import check_packing

SF = "/root/testdata/sf0.01"
BARE = re.compile(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bare(text):
    return BARE.findall((text or "").translate(LOWER))


def grams(w, n=5):
    n = min(n, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def exhaustive(docs, items, threshold=decontam.THRESHOLD, overlap=decontam.MIN_OVERLAP):
    """{row: {item_id: score}} by scoring every item for every passage."""
    lists = [(i, bare(t)) for i, t in items]
    lists = [(i, w, Counter(zip(w, w[1:]))) for i, w in lists if len(w) > 1]
    if not lists:
        return [{} for _ in docs]
    n, mean = len(lists), np.mean([sum(c.values()) for _, _, c in lists])
    df = Counter(t for _, _, c in lists for t in c)
    longest = max(len(w) for _, w, _ in lists)
    impact = []
    for _, w, c in lists:
        dl = sum(c.values())
        own = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
               for t, tf in c.items()}
        total = sum(own.values())
        impact.append({t: v / total for t, v in own.items()})
    out = []
    for _, text in docs:
        w, found = bare(text), {}
        for at in range(0, max(1, len(w) - longest), longest):
            passage = w[at:at + 2 * longest]
            pairs = set(zip(passage, passage[1:]))
            for (item, own, _), weights in zip(lists, impact):
                score = sum(v for t, v in weights.items() if t in pairs)
                half = (len(own) + 1) // 2
                if score >= threshold - 1e-9 and all(
                        sum(g in grams(passage, min(5, len(p))) for g in grams(p)) >= overlap * len(grams(p))
                        for p in (own[:half], own[half:]) if p):
                    found[item] = max(score, found.get(item, 0))
        out.append(found)
    return out


def test_query_matches_exhaustive_scoring(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d: f for (d, _), f in zip(docs, exhaustive(docs, items))}
    got = {r.doc_id: r for r in queries.op8_benchmark_decontamination(spark, SF).collect()}
    assert got.keys() == want.keys()
    for d, f in want.items():
        assert got[d].item_ids == sorted(f) and got[d].contaminated == bool(f)
        if f:
            assert got[d].best_score == pytest.approx(max(f.values()))
    verbatim = {d for d, t in docs if any(x in t for _, x in items)}
    assert verbatim and verbatim == {d for d, f in want.items() if f}


@pytest.mark.parametrize("max_items", [1000, 4])
def test_defined_cases(spark, max_items):
    q = " ".join(f"q{i}" for i in range(30))
    items = [(1, q), (1, q), (2, "Short Item!"), (3, None), (4, ""), (5, "one"), (None, "a null id has text too"),
             (6, " ".join(f"z{i % 3}" for i in range(40))), (7, "almost the same as " + q)]
    docs = [(1, None, 0), (2, "", 0), (3, q.upper().replace(" ", ", "), 0), (4, "x " * 95 + q + " y" * 300, 0),
            (5, " ".join(q.split()[:14]), 0), (6, "a short item here", 0), (7, "z0 z1 z2 " * 20000, 0),
            (8, "It: a null-id has text, too", 1), (3, q, 2), (None, q, 3), (9, "one", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bm = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.with_matches(df, bm, max_items=max_items).collect()
    by = defaultdict(list)
    for r in got:
        by[(r.doc_id, r.text)].append({x.item_id: pytest.approx(x.score) for x in r["__items"]})
    for (d, t, _), f in zip(docs, exhaustive([d[:2] for d in docs], items)):
        assert f in by[(d, t)]
    assert decontam.with_matches(df.where("false"), bm).collect() == []
    assert all(r["__items"] == [] for r in decontam.with_matches(df, bm.where("false")).collect())


def test_given_question_and_answer(spark):
    bm = spark.createDataFrame([(1, "what is the name of the tall tower", "it is called the spire of dawn")],
                               "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "What is the name of the tall tower? It is called the spire of dawn."),
                                  (2, "What is the name of the tall tower? Nobody here can say.")], "doc_id long, text string")
    got = {r.doc_id: len(r["__items"]) for r in decontam.with_matches(docs, bm, threshold=0.3).collect()}
    assert got == {1: 1, 2: 0}


def near_copies(text):
    """A copy of the item with one word replaced, added or cut in each half, and without its last tenth."""
    w = text.split()
    out = [w[:len(w) - len(w) // 10]]
    for at in (len(w) // 4, len(w) // 2 + len(w) // 4):
        out += [w[:at] + ["zzreplaced"] + w[at + 1:], w[:at] + ["zzadded"] + w[at:], w[:at] + w[at + 1:]]
    return [" ".join(x) for x in out]


def test_near_copies_are_found(spark, tmp_path):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    copies = [(i, c) for i, t in items for c in near_copies(t)]
    around = " ".join(f"fill{k}" for k in range(150))
    rows = [(k, f"{around} {c} {around}") for k, (_, c) in enumerate(copies)]
    halves = [(len(rows) + k, f"{around} {' '.join(t.split()[:len(t.split()) // 2])} {around}") for k, (_, t) in enumerate(items)]
    spark.createDataFrame(rows + halves, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.item_ids for r in queries.op8_benchmark_decontamination(spark, str(tmp_path)).collect()}
    whole = {i: grams(bare(t)) for i, t in items}
    near = [k for k, (i, c) in enumerate(copies) if len(whole[i] & grams(bare(c))) >= 0.8 * len(whole[i])]
    assert len(near) >= 0.8 * len(copies)
    assert [k for k in near if copies[k][0] not in got[k]] == []
    assert all(got[d] == [] for d, _ in halves)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in left} == {d for d, found in got.items() if not found}


def test_long_question_alone_is_no_copy(spark):
    question = " ".join(f"q{k}" for k in range(60))
    bm = spark.createDataFrame([(1, question, "the tall spire of dawn in the north")],
                               "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, f"{question} the tall spire at dawn in the north"), (2, f"{question} nobody can say")],
                                 "doc_id long, text string")
    found = decontam.with_matches(docs, bm, part_overlap=decontam.PART_OVERLAP).collect()
    assert {r.doc_id: len(r["__items"]) for r in found} == {1: 1, 2: 0}


@pytest.mark.parametrize("seed", range(5))
def test_wand_returns_all_above_the_threshold(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(300):
        terms = np.unique(rng.zipf(1.5, 12) % 60)
        rows.append({"item_id": i, "text": f"w{i} x", "question": None, "answer": None, "terms": terms.tolist(),
                     "tfs": rng.integers(1, 4, len(terms)).tolist(), "dl": 14})
    df = Counter(t for r in rows for t in r["terms"])
    index = decontam.Index(rows, df, len(rows), 14.0)
    for _ in range(40):
        query = rng.choice(len(index.keys), min(len(index.keys), 15), replace=False).tolist()
        for threshold in (0.2, 0.5, 0.9):
            want = defaultdict(float)
            for t in query:
                for i, w in index.lists[t]:
                    want[i] += w
            assert {i: pytest.approx(s) for i, s in want.items() if s >= threshold} == dict(
                index.search(query, threshold))


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain computation on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == docs.columns
        kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
        docs = after
    final = docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in kept[0] if labels.get(d) == 1]
    assert sum(d in kept[1] for d in good) >= 0.97 * len(good)
    assert sum(d in kept[1] for d in kept[0] if labels.get(d) == 0) <= 0.2 * sum(v == 0 for v in labels.values())

    lines = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, t in kept[1].items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                lines[key(x)].add(d)
    gone = {x: max(ds) for x, ds in lines.items() if len(ds) >= 5}
    assert kept[2] == {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in kept[1].items()}

    groups = brute_force(sorted(kept[2].items()), n=5)
    assert set(kept[3]) == {d for d, _, _, stays in groups if stays}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = sorted(kept[3].items())
    assert set(kept[4]) == {d for (d, _), f in zip(rows, exhaustive(rows, items)) if not f}
    used, least = check_packing(final, sorted(kept[4].items()), 2048)
    assert used <= least + 2
    assert tokens.default_path() and quality_net.ACCEPT == 0.3


@pytest.mark.parametrize("from_files", [True, False])
def test_one_row_of_each_near_duplicate_group_stays(spark, tmp_path, from_files):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    near = c + " and one more"
    docs = [(1, a), (1, a), (1, a), (2, a), (2, b), (3, b), (7, c), (None, c), (None, near), (None, c),
            (None, d), (None, d), (None, e), (9, e + " too"), (5, None), (5, None), (None, " "), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    if from_files:
        df.write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.without_near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter(
        [(1, a), (2, b), (7, c), (None, d), (9, e + " too"), (5, None), (5, None), (None, " "), (None, "")])


def test_pipeline_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
