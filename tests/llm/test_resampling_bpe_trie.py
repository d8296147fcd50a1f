"""Importance resampling, byte-level BPE and the conversation trie against brute force; texts built to make hashes collide."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brookline.llm import byte_bpe, conversation_trie, hashing, katz, repeats, resampling
from tests.compare import connect, same

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- importance resampling


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def expected(rows, target, longest, percent, least):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t, longest)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x, longest)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        w, f = features(text, longest)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least))
    line = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = collections.defaultdict(list)
    for k, r in enumerate(line[: len(line) * percent // 100]):
        rank[r].append(k + 1)
    return [(*r[:4], rank[r].pop(0) if rank[r] else None) for r in out]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, docs, texts, monkeypatch, longest):
    monkeypatch.setattr(resampling, "BLOCK", 100)  # texts of several blocks
    monkeypatch.setattr(resampling, "AT_ONCE", 500)
    target = ["w1 w2 W3 ärger", None, "", "one two -- one"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    gains = resampling.bucket_gains(resampling.bucket_counts(goal, longest=longest), resampling.bucket_counts(docs, longest=longest))
    out = resampling.drawn(resampling.weighed(docs, gains, longest=longest), percent=30).select("row.doc_id", "n_features", "weight", "score", "rank")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(expected([(i, t) for i, t, _ in texts], target, longest, 30, 20), key=key)


def test_resampling_edges(spark, docs, texts):
    goal = spark.createDataFrame([("w1 w2",)], "text string")
    some = resampling.resampled(docs, goal, percent=30)
    assert some.columns == docs.columns and 0 < some.count() < len(texts)
    assert resampling.resampled(docs.limit(0), goal).count() == 0
    assert resampling.resampled(docs, goal.limit(0), percent=100).count() == sum(len(features(t, 1)[0]) >= 20 for _, t, _ in texts)
    nothing = spark.createDataFrame(spark.sparkContext.emptyRDD(), "doc_id long, text string")  # no partition at all
    assert resampling.bucket_counts(nothing).sum() == 0


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i % 7, " ".join(["x"] * 20)) for i in range(21)], "doc_id long, text string")
    got = resampling.drawn(resampling.weighed(rows, np.zeros(10_000, dtype=np.int64)), percent=50).select("row.doc_id", "n_features", "weight", "score", "rank").collect()
    line = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in line] == list(range(1, 11))
    assert [(-r.score, r.doc_id) for r in line] == sorted((-r.score, r.doc_id) for r in got)[:10]


# --- byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


ODD = ["", " ", "a  b\n   c \n\n d ", "x\n  ", " \x85 y", "It's we'll I'M", "日本語テキスト" * 50, "🙂🙂" * 30, "\x1c\x1dabc", "a\x1cb", "a" * 700, "ab" * 60, "-" * 3001, "﻿\u0000é́", "<|endoftext|>", "x　　y ​ z", "١٢٣ ⅷ²"]


def test_bpe(spark, docs, texts, library):
    got = byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).select("row.doc_id", "row.text", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    ids = byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decoded(ids, RANKS, public_tokenizers.PATTERN)
    assert all((r[0] or "").encode() == bytes(r[1]) for r in back.select("row.row.text", "bytes").collect())
    assert ids.select("row.*").columns == docs.columns
    assert byte_bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_odd_texts(coder, library):
    rng = random.Random(1)
    some = ODD + ["".join(rng.choice("abcdeéXY") for _ in range(300)) for _ in range(20)] + ["".join(rng.choice("ab \n\t's　 .1") for _ in range(60)) for _ in range(300)]
    got = coder.encode(some)
    assert [x.tolist() for x, _ in got] == list(map(library.encode_ordinary, some))
    assert [s for _, s in got] == [",".join(map(str, library.encode_ordinary(x))) for x in some]
    assert coder.decode([x for x, _ in got]) == [x.encode() for x in some]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=5))
def test_bpe_of_any_text(coder, library, some):
    assert [x.tolist() for x, _ in coder.encode(some)] == list(map(library.encode_ordinary, some))


def test_letters_and_digits_are_the_librarys(coder, library):
    """One text with every character, three of each kind apart: the pattern splits it as the library does."""
    every = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x32000, 3), *range(0xE0000, 0xE0200)]]
    cut = ["a" + "".join(every[k : k + 7]) + "1" for k in range(0, len(every), 7)]
    assert [x.tolist() for x, _ in coder.encode(cut)] == list(map(library.encode_ordinary, cut))


def test_small_caches_and_lots_change_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 1)
    monkeypatch.setattr(byte_bpe, "WORDS", 1)
    monkeypatch.setattr(byte_bpe, "WORD_BYTES", 5)
    monkeypatch.setattr(byte_bpe, "LONG_WORD", 4)
    some = ["unbelievable aaaaaaaaaaa abababab Überraschung xyzzyxyzzy"] * 2
    for _ in range(2):
        assert [x.tolist() for x, _ in coder.encode(some)] == list(map(library.encode_ordinary, some))


# --- conversation trie


def tree(rows, base=20, heads=4):
    """The nodes of (conv_id, turn, role, text), by hand."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, (role, text)))
    lines = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in lines.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = lines.get(c - int(math.fmod(c, base)), [])[:h] + own[h:]
    nodes = collections.defaultdict(list)
    for c, line in built.items():
        for d in range(len(line) + 1):
            nodes[tuple(line[:d])].append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        own = lambda p: (len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in under),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under) for p in under), sum(map(own, under)), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def conversations(seed):
    rng = random.Random(seed)
    say = lambda: rng.choice(["yes", "no", "well then", "", "a\nb c", "é ü"])
    rows = []
    for c in [*range(45), 100, 101, -5, -25, 2**40]:
        rows += [(c, k, rng.choice(["user", "bot", None]), rng.choice([say(), None])) for k in range(rng.choice([1, 2, 3, 6]))]
    long = [(k, "user", f"turn {k}") for k in range(40)]
    for c in range(200, 240):  # copies, some that go on, some that end earlier
        rows += [(c, *x) for x in long[: rng.choice([40, 40, 40, 25, 12])]]
    rows += [(300, None, "user", "first"), (300, 0, "user", "tie"), (300, 0, "user", "other"), (300, 0, "user", "tie"), (None, 1, "user", "nobody's")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:  # ranges, hash trees and chunks of a few rows
        monkeypatch.setattr(conversation_trie, "ROWS_PER_RANGE", 50)
        monkeypatch.setattr(conversation_trie, "FAN", 3)
        monkeypatch.setattr(conversation_trie, "MANY_ENDS", 2)
        monkeypatch.setattr(conversation_trie, "CHUNK", 4)
    rows = conversations(7)
    given_ = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("node", "pos", "key", "depth")}).repartition(3)
    got = [tuple(r) for r in conversation_trie.trie(given_).collect()]
    key = lambda r: (r[1], r[0])
    assert sorted(got, key=key) == sorted(tree(rows), key=key)


def test_trie_edges(spark):
    assert conversation_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    one = conversation_trie.trie(spark.createDataFrame([(20, 0, "user", "a b")], SCHEMA)).collect()
    assert sorted((r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in one) == [(0, 20, None, 1, 1, 1, 0), (1, 20, 20, 1, 0, 1, 0)]


def test_trie_of_a_table(spark):
    folder = "/root/testdata/sf0.001"
    same(conversation_trie.query(spark, folder).toPandas(), connect(folder).sql(conversation_trie.SQL).df())
    same(resampling.query(spark, folder).toPandas(), connect(folder).sql(resampling.SQL).df())


# --- texts built to collide


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_repeats_are_equal_bytes(spark):
    """Strings that collide under every polynomial hash modulo 2 ** 64: no window of the two texts is equal."""
    t, other, between = thue_morse(256, "u", "'"), thue_morse(256, "'", "u"), "".join(random.Random(2).choice("abcdefghij ") for _ in range(144))
    docs = spark.createDataFrame([(1, t + between + other), (2, other + between + t)], "doc_id long, text string")
    assert [(r.n_bytes, r.n_removed) for r in repeats.without_repeats(docs).collect()] == [(656, 0)] * 2
    twice = spark.createDataFrame([(1, t + between), (2, t + between), (3, other + between)], "doc_id long, text string")
    assert sorted((r.row.doc_id, r.n_removed) for r in repeats.without_repeats(twice).collect()) == [(1, 400), (2, 400), (3, 0)]


def test_symbols_of_colliding_hashes_are_told_apart_by_bytes():
    data = np.random.default_rng(0).integers(97, 99, 3000).astype(np.uint8)
    data[1500:] = data[:1500]
    at = np.arange(len(data) - repeats.STEP + 1)
    want = collections.defaultdict(set)
    for code in (np.zeros(len(at), dtype=np.uint64), hashing.range_digests(data, at, at + repeats.STEP)):
        got = repeats.symbols(data, at, code)
        for a, s in zip(at.tolist(), got.tolist()):
            want[code[0] == 0, s].add(data[a : a + repeats.STEP].tobytes())
        assert len(set(got.tolist())) == len({data[a : a + repeats.STEP].tobytes() for a in at.tolist()})
    assert all(len(x) == 1 for x in want.values())


def test_words_built_to_collide_are_different_words(spark):
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    assert len(set(hashing.word_hashes(f"{a} {b}".encode()).tolist())) == 2
    train = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = {r.doc_id: r for r in katz.scores(spark.createDataFrame([(train, a), (held, b)], "doc_id long, text string")).collect()}
    assert rows[train].n_known == 2 and rows[held].n_known == 1


def test_scores_without_counts_of_two_are_finite(spark):
    """No bigram, and no word, has a count of exactly two: nothing is discounted away whole."""
    train = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2]
    for texts in (["the cat sat on a mat", "one dog ran past here"], ["x"], ["a b c"] * 3):
        docs = spark.createDataFrame(list(zip(train, texts)), "doc_id long, text string")
        assert all(math.isfinite(r.score) and r.score < 0 for r in katz.scores(docs).collect())
    for n in ([0, 5, 0, 0, 0, 0, 0], [0, 5, 0, 1, 0, 0, 0], [0, 1, 9, 0, 0, 0, 2]):
        d = katz.discounts(np.array(n))
        assert ((d[1:] > 0) & (d[1:] <= 1)).all()
