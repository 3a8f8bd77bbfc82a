"""Byte-level BPE, the conversation trie and centroid clustering against plain versions, and their edge cases."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken

from tickfold.llm import bpe, centroids, conversation_trie, queries

SF = "/root/testdata/sf0.001"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=bpe.default_file()[1], mergeable_ranks=bpe.vocabulary(None).ranks, special_tokens={})


def own_ids(text):
    vocab, split, out = bpe.vocabulary(None), bpe.Splitter(bpe.default_file()[1], bpe.other_classes()), []
    for part in split.parts(text):
        coded = vocab.encode_pieces({p.encode() for p in part})
        out += [i for p in part for i in np.frombuffer(coded[p.encode()], "<u4").tolist()]
    return out


def texts_of_all_kinds(seed, n):
    rng = random.Random(seed)
    alphabets = ["abcdefgh", "etaoin", " \n\t\r", "éèüßñ", "日本語漢字", "0123", "!?.,'", "😀🙏", "౜\U000107bb՘͸", "'s't're", "\x00\x1c\x1f\x85  "]
    for k in range(n):
        letters = rng.choice(alphabets) if k % 3 else "".join(alphabets)
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(300)))


def test_ids_are_those_of_tiktoken(encoding):
    for text in texts_of_all_kinds(0, 400):
        assert own_ids(text) == encoding.encode_ordinary(text), text


@pytest.mark.parametrize("text", [" " * 100_000, "a" * 30_001, "\n" * 50_000 + "x", "日" * 9_000, "<|endoftext|>" * 3, "ab" * 20_000], ids=lambda t: repr(t[:5]))
def test_long_pieces(encoding, text):
    assert own_ids(text) == encoding.encode_ordinary(text)


def test_a_lower_rank_that_appears_while_a_row_of_pairs_merges():
    """Rounds that are done together stop where leftmost order would turn aside."""
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"xy": 258, b"yz": 257, b"wx": 259, b"wxyz": 260}
    plain = tiktoken.Encoding("toy", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    vocab = bpe.Vocabulary.__new__(bpe.Vocabulary)
    vocab.ranks, vocab.bytes = ranks, np.arange(256, dtype=np.int32)
    pairs = [(ranks[t[:c]], ranks[t[c:]], r) for t, r in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks]
    vocab.pairs = bpe.PairTable(*np.array(pairs).T)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("wxyz") for _ in range(rng.randrange(2, 40)))
        want = plain.encode_ordinary(text)
        short = np.frombuffer(vocab.encode_pieces([text.encode()])[text.encode()], "<u4").tolist()
        assert short == want
        if text.encode() not in ranks:
            assert vocab._long(vocab.bytes[np.frombuffer(text.encode(), np.uint8)]).tolist() == want


def test_encoding_and_decoding(spark, encoding):
    texts = [None, "", "a", "Hello  world", "same", "same", "word " * 60_000, *texts_of_all_kinds(1, 30)]
    docs = spark.createDataFrame([(i if i != 2 else None, t, b"x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids binary, decoded string")
    encoded = bpe.encode_texts(docs)
    assert encoded.columns == ["doc_id", "ids"]
    got = sorted((bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.decode_ids(encoded).collect())
    assert got == sorted((np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for t in texts)
    rows = {r["doc_id"]: r for r in bpe.token_digests(docs).collect()}
    assert rows[None]["n_tokens"] == 1 and rows[0]["n_tokens"] == 0 and rows[4]["ids_sha256"] == rows[5]["ids_sha256"]
    assert rows[6]["decoded_sha256"] == hashlib.sha256(("word " * 60_000).encode()).hexdigest()
    assert bpe.token_digests(docs.limit(0)).count() == 0


def test_ids_that_are_not_in_the_file(spark):
    given = spark.createDataFrame([(b"\x00\x00\x00\x00",), (b"\x01",), (b"\xff\xff\xff\xff",), (None,), (b"",)], "i binary")
    got = [r["decoded"] for r in bpe.decode_ids(given, "i").collect()]
    assert [None if v is None else bytes(v) for v in got] == [bpe.vocabulary(None).tokens[0], None, None, None, b""]


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    children = defaultdict(int)
    for prefix in nodes:
        if prefix:
            children[prefix[:-1]] += 1
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(prefix))))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.append((min(members), len(prefix), parent, len(members), children[prefix], sum(not children[p] for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    """Families with shared beginnings, exact copies, missing bases, ties, nulls and one long conversation."""
    rng, rows = random.Random(seed), []
    common = [("system", "be kind"), ("user", "hello é😀")]
    for conv in [*range(0, 40), *range(205, 230), 300, 301, 777]:
        path = common[: rng.randrange(3)] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "ccc é"])) for _ in range(rng.randrange(1, 7))]
        rows += [(conv, t if rng.random() > 0.05 else None, *p) for t, p in enumerate(path)]
    for conv in range(400, 430):  # copies
        rows += [(conv, t, "user", f"same {t}") for t in range(8)]
    rows += [(300, 100 + t, "user", f"turn {t}") for t in range(150)]
    rows += [(None, 1, "user", "lost"), (31, None, None, None), (32, 5, "user", None), (33, 5, None, "x"), (33, 5, None, "x"), (34, 2, "b", "y"), (34, 2, "a", "z")]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    got = conversation_trie.prefix_trie(df.selectExpr("*", "1 as depth", "'x' as content", "2 as block", "3 as conv"))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_of_one_turnless_conversation(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(lone, 0, "user", "x" * 200_000)]
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert list(map(tuple, got)) == plain_trie(rows)


def plain_clusters(rows):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in seeds][:8]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))
    for _ in range(10):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        at = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if groups[k] else old for k, old in enumerate(at)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    by = defaultdict(int)
    for _, k, d in found:
        by[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, k, d, by[k], sum(by.values()), digest[k]) for i, k, d in found), key=str)


def vectors(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=64) * rng.choice([0.1, 1, 3])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [rows[7]] * 5  # copies and repeated rows
    rows += [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [0.0] * 63 + [float("nan")]), (2004, [0.0] * 63 + [float("-inf")]), (2005, [None] + [0.0] * 63), (2006, [0.0] * 65)]
    return rows + [(3000 + i, [float(i % 2)] * 64) for i in range(6)]


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters(spark, seed):
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(5)
    assert sorted(map(tuple, centroids.cluster_vectors(df).collect()), key=str) == plain_clusters(rows)


def test_few_vectors_and_none(spark):
    shape = "vec_id long, embedding array<double>"
    assert centroids.cluster_vectors(spark.createDataFrame([(1, [1.0])], shape)).count() == 0
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, centroids.cluster_vectors(spark.createDataFrame(rows, shape)).collect()), key=str) == plain_clusters(rows)
    tied = [(i, [float(i % 2)] * 64) for i in range(40)]
    assert sorted(map(tuple, centroids.cluster_vectors(spark.createDataFrame(tied, shape)).collect()), key=str) == plain_clusters(tied)


def test_partial_distances_are_whole_ones():
    rng = np.random.default_rng(4)
    v, c = rng.integers(-50, 50, (500, 64)), rng.integers(-50, 50, (8, 64))
    c[5] = c[2]  # a tie
    full = ((v[:, None] - c) ** 2).sum(2)
    number, distance = centroids.nearest(v, c, rng.permutation(64))
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_centroids"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
