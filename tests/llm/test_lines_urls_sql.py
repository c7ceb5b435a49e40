"""Line de-duplication and URL filter: SQL oracles, defined cases, levels of runs, reputation by hand."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup, oracle, queries, url_reputation

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle.Q))
def test_query_matches_sql(spark, name, size):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{size}/{t}.parquet')")
    got = queries.REGISTRY[name](spark, f"/root/testdata/{size}")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle.Q[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


def lines_by_hand(rows, min_chars=40, min_docs=5):
    def key(x):
        return x.strip(SPACE).translate(LOWER)

    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and d is not None:
                held[key(x)].add(d)
    last = {x: max(ds) for x, ds in held.items() if len(ds) >= min_docs}
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in last or last[key(x)] == d]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_cases(spark, tmp_path):
    hot, long_ = "This line is found in very many documents, é𝒳!", "x" * 45
    rows = [(i, f"own {i}\n  {hot.upper() if i % 2 else hot}\t\r\n{hot}\n") for i in range(30)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, hot), (None, f"{hot}\n{long_}"), (7, hot)]
    rows += [(200 + i, long_) for i in range(4)] + [(203, long_ + "\n" + long_)]            # four documents only
    rows += [(300 + i, "y" * 39) for i in range(9)] + [(400 + i, "z" * 40) for i in range(5)]
    rows += [(500, "\n".join([hot, "w" * 41] * 2000))]
    df = spark.createDataFrame([(d, t, "k", 1, "b") for d, t in rows],
                               "doc_id long, text string, key string, lines int, batch string").repartition(3)
    path = str(tmp_path / "documents.parquet")
    df.write.parquet(path)
    got = sorted((tuple(r) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == lines_by_hand(rows)
    out = line_dedup.drop_common_lines(df)
    assert out.columns == [*df.columns, "__lines"] and out.count() == len(rows)
    assert line_dedup.drop_common_lines(df.where("false")).collect() == []


def test_runs_are_levelled_and_novelty_is_found(spark):
    index = line_dedup.LineRuns(fanout=2)
    batches = [["a", "b", "a"], ["b", "c"], ["c", "d"], ["a"], ["e"]]
    seen, doc = set(), 0
    for n, lines in enumerate(batches):
        rows = []
        for x in lines:
            rows.append((x, doc))
            doc += 1
        run = index.add(spark.createDataFrame(rows, "line string, doc_id long").select(
            line_dedup.key_hash(F.col("line")).alias("key"), "doc_id"))
        novel = {bytes(r.key) for r in run.where(F.col("first_batch") == n).collect()}
        assert novel == {hashlib.md5(x.encode()).digest() for x in set(lines) - seen}
        seen |= set(lines)
    assert [len(x) for x in index.levels] == [1, 0, 1]                  # five batches: 4 + 1
    got = {bytes(r.key): (r.n_docs, r.max_doc, r.first_batch) for r in index.table().collect()}
    md5 = lambda x: hashlib.md5(x.encode()).digest()
    assert got == {md5("a"): (3, 7, 0), md5("b"): (2, 3, 0), md5("c"): (2, 5, 1), md5("d"): (1, 6, 2), md5("e"): (1, 8, 4)}


RULES = queries.URL_RULES
URLS = {"http://a.com/x": ("a.com", "/x", "com/", "allow"), "http://COM/": ("com", "/", "com/", "allow"),
        "https://www.Example.com/en/1?q=/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "x://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "x://example.com/de/": ("example.com", "/de/", "com/", "allow"), "x://example.com": ("example.com", "", None, None),
        "x://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "x://q.net/es/a://b": ("q.net", "/es/a://b", "net/es/", "block"), "x://q.net/fr/#f": ("q.net", "/fr/", "net/fr/", "block"),
        "x://q.net/frx": ("q.net", "/frx", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None),
        "": ("", "", None, None), "x://?a": ("", "", None, None), "x://H\n/p\nq?": ("h\n", "/p\nq", None, None),
        "x://É.org:80/" + "p" * 100000: ("É.org:80", "/" + "p" * 100000, None, None)}


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, 0.5, "h") for i, u in enumerate(URLS)] + [(0, "http://a.com/x", 0.5, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, label double, host string")
    labels = spark.createDataFrame([], "label_id long, label int")
    got = url_reputation.filter_urls(pages, labels, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = URLS[rows[r.page_id][1]]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_reputation.filter_urls(pages.where("false"), labels, RULES).collect() == []
    assert all(r.rule is None for r in url_reputation.filter_urls(pages, labels, []).collect())


def test_longest_rule_wins_ties_to_host_then_block(spark):
    df = spark.createDataFrame([("b.a.com", "/xy/z")], "h string, p string")
    pick = lambda *rules: df.select(url_reputation.rule_column(F.col("h"), F.col("p"), list(rules))).first()[0]
    assert pick(("allow", "a.com", "/xy/"), ("block", "b.a.com", "/x"))["rule"] == "b.a.com/x"
    assert pick(("allow", "b.a.com", "/"), ("block", "b.a.com", "/"))["verdict"] == "block"


@pytest.mark.parametrize("host,domain,suffix", [
    ("a.b.example.com", "example.com", "com"), ("example.com:80", "example.com", "com"), ("x.y.co.uk", "y.co.uk", "co.uk"),
    ("10.0.0.1", "10.0.0.1", "#ip"), ("localhost", "localhost", "localhost"), ("", "", "")])
def test_registered_domains(spark, host, domain, suffix):
    df = spark.createDataFrame([(host,)], "h string")
    assert tuple(df.select(*url_reputation.registered_domain(F.col("h"))).first()) == (domain, suffix)


def test_reputation_shrinks_and_blocks(spark):
    """A host with many bad pages is blocked, one with a single bad page under a good domain is not,
    and an unlabelled host of a bad domain follows the domain."""
    rows = [("bad.org", 0)] * 60 + [("worse.bad.org", 0)] * 40 + [("new.bad.org", None)]
    rows += [(f"h{i}.good.org", 1) for i in range(40) for _ in range(5)] + [("one.good.org", 0)]
    rows += [(f"s{i}.net", i % 2) for i in range(10)]
    out = url_reputation.host_reputation(spark.createDataFrame(rows, "host string, label int"))
    got = {r.host: r for r in out.collect()}
    assert got["bad.org"].blocked and got["worse.bad.org"].blocked and got["new.bad.org"].blocked
    assert not got["one.good.org"].blocked and not got["h0.good.org"].blocked
    assert got["new.bad.org"].n == 0 and got["bad.org"].a / (got["bad.org"].a + got["bad.org"].b) < 0.1
    for r in got.values():
        assert r.a >= r.s and r.b >= r.n - r.s
