"""Encoder, length histogram and packing against the tokenizer itself and plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import length_hist, packing, queries, text_kernels, tokens

PATH = tokens.default_path()
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["", None, "  ä Ä Ä H̱ ẖx İstanbul ΑΣ <|endoftext|>x a<|startoftext|> don't I'LL 1234 a1b2 '''s ..'s",
       "ß ẞ é́ 中文  x y \x1cz a​b ªº × a×b #*# naïve \x85 ÿŸ \x0b\x0c", "x" * 70000, "9" * 3000, "\n\n\n", "<|", "a<b|c"]


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    ids, bounds = tokens.encoder(PATH).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_encoder_on_odd_texts():
    assert encoded(ODD) == [plain(t) for t in ODD]


def long_words(seed=0):
    """Words of 20 to 100 KB, and the same words with their 16 KiB blocks in another order."""
    rng = np.random.default_rng(seed)
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    blocks = [letters[rng.integers(0, 16, 1 << 14)].tobytes().decode() for _ in range(6)]
    tail = blocks[5][:4000]
    return [blocks[0] + tail, blocks[1] + tail, blocks[0] + blocks[1], blocks[1] + blocks[0],
            "".join(blocks), "".join(blocks[::-1]), "".join(blocks[2:] + blocks[:2]), blocks[0] * 2, blocks[0] * 3]


def test_long_words_in_another_order_have_other_hashes():
    words = long_words()
    (_, hashes, _), = text_kernels.token_hashes([" ".join(words + words) + " " * 40000 + words[0]], text_kernels.WORDS)
    assert len(hashes) == 2 * len(words) + 1 and len(set(hashes.tolist())) == len(words)
    assert hashes[0] == hashes[-1] and (hashes[:len(words)] == hashes[len(words):-1]).all()
    (_, own, _), = text_kernels.token_hashes([" ".join(["a" + " " * 40000 + "a", "a"])], text_kernels.WORDS)
    assert len(set(own.tolist())) == 1
    for x in words:
        (_, one, _), = text_kernels.token_hashes([x], text_kernels.WORDS)
        assert one[0] == hashes[words.index(x)]
    sets = [s.tolist() for s in text_kernels.shingle_sets([w + " x y z" for w in words], 4)]
    assert len({s[0] for s in sets}) == len(words)


def test_encoder_on_long_words():
    words = long_words()
    own = tokens.Encoder(PATH)
    for text in [*words, " ".join(words), " ".join(words[::-1])]:
        assert own.encode(pa.array([text]))[0].tolist() == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=4))
def test_encoder_on_any_text(texts):
    assert encoded(texts) == [plain(t) for t in texts]


def test_encoder_survives_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CACHED", 3)
    texts = ["one two three", "four five six seven", "one nine ten'x"]
    own = tokens.Encoder(PATH)
    for _ in range(3):
        for t in texts:
            assert own.encode(pa.array([t]))[0].tolist() == plain(t)


@pytest.mark.parametrize("seed", range(4))
def test_configurations_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    counts = np.zeros(capacity + 1, np.int64)
    counts[rng.integers(1, 101, 40)] += rng.integers(1, 3000, 40)
    packed = packing.configurations(counts, capacity)
    got = np.zeros_like(counts)
    for pattern, n in packed:
        assert n > 0 and sum(s * k for s, k in pattern) <= capacity
        for s, k in pattern:
            got[s] += n * k
    assert (got == counts).all()
    sequences = sum(n for _, n in packed)
    assert sequences <= sum(n for _, n in packing.best_fit(counts, capacity))


def test_configurations_reach_the_optimum_where_best_fit_fails():
    """Best-fit decreasing puts 6 + 3, 5 + 5 together; the best filling is 6 + 4 and 3 + 3 + 4."""
    counts = np.zeros(11, np.int64)
    counts[[6, 4, 3]] = 1000, 2000, 2000
    assert sum(n for _, n in packing.configurations(counts, 10)) == 2000


def check_packing(rows, docs, capacity):
    want = []
    for d, text in docs:
        ids = plain(text) + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = np.asarray(ids[at:at + capacity], "<u4")
            want.append((d, k, at, len(own), zlib.crc32(own.tobytes())))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(w[3] for w in want) // capacity)


def test_query_packs_every_token_once(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packing(queries.op3_best_fit_packing(spark, sf).collect(), docs, 2048)
    assert used <= least + 2


def test_packing_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "three"), (5, "word " * 9000)]
    rows += [(10 + i, "a b c") for i in range(200)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, length int, rank int")
    used, least = check_packing(packing.pack(df.repartition(3), PATH, 16).collect(), rows, 16)
    assert used == least
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def histogram_by_hand(texts):
    n = [len(plain(t)) for t in texts]
    return sorted((x, n.count(x), x * n.count(x), sum(y > x for y in n), sum(y for y in n if y > x),
                   sum(y <= x for y in n), sum(y for y in n if y <= x), sum(min(x, y) for y in n),
                   sum(y <= x for y in n) / len(n)) for x in set(n))


def test_histogram_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op9_token_counts(spark, sf).collect())) == histogram_by_hand(texts)


def test_histogram_defined_cases(spark):
    texts = [None, "", "one", "one", "one two three", "word " * 3000]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, length int")
    sums = length_hist.with_sums(length_hist.length_histogram(df, PATH), block=2)
    assert sorted(map(tuple, sums.collect())) == histogram_by_hand(texts)
    got = {r.context_limit: tuple(r)[1:] for r in length_hist.at_limits(sums, [0, 2, 5000]).collect()}
    assert got == {0: (2, 4, 0, 3005), 2: (4, 2, 6, 3005), 5000: (6, 0, 3005, 3005)}
    assert {r.share: r.length for r in length_hist.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: 1, 1.0: 3000}
    empty = spark.createDataFrame([], "text string")
    assert length_hist.with_sums(length_hist.length_histogram(empty, PATH)).collect() == []
