"""Operators against brute force, on texts with every awkward case, and on empty tables."""

import collections
import functools
import hashlib
import itertools
import math
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brookline.llm import exact_dedup, hashing, html_text, katz, mixing, packing, quality, repeats, sharding, shared, similarity_join, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# --- exact dedup


def test_exact_dedup(docs, texts):
    out = exact_dedup.exact_dedup(docs, capacity=3)
    assert out.columns == ["row", "keep_id", "group_size", "kept", "digest"]
    groups = collections.defaultdict(list)
    for i, t, _ in texts:
        groups[(t or "").translate(LOW)].append(i)
    rows = out.select("row.doc_id", "row.text", "keep_id", "group_size", "kept", "digest").collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[(r.text or "").translate(LOW)]
        known = [i for i in own if i is not None]
        assert r.group_size == len(own) and r.keep_id == (max(known) if known else None)
        assert r.digest == hashlib.sha256((r.text or "").translate(LOW).encode()).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.survivors(docs).columns == docs.columns
    assert exact_dedup.survivors(docs).count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_directory_doubles_until_buckets_fit(spark, monkeypatch):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    for bits in (16, 8):  # with eight bits, slots must be split further
        monkeypatch.setattr(exact_dedup, "SLOT_BITS", bits)
        made = exact_dedup.directory(keys, 10)
        assert made.bits == 16
        places = made.look_up(keys).toPandas()
        assert places.bucket.notna().all() and places.groupby("bucket").size().max() <= 10
        assert made.slots.agg(F.min("depth")).first()[0] >= 8
    assert exact_dedup.directory(keys.limit(0), 10).n_slots == 0
    same = spark.range(50).select(F.lit(7).cast("long").alias("key"))
    assert exact_dedup.directory(same, 10).slots.first().depth == exact_dedup.MOST_BITS


def test_answers_come_through_the_directory(docs, monkeypatch):
    """The index is deep here, and rows whose slots are not in the directory find no copies."""
    real, depths = exact_dedup.directory, []

    def half(keys, capacity):
        made = real(keys, capacity)
        depths.append(made.slots.agg(F.min("depth")).first()[0])
        known = made.slots.orderBy("slot").limit(made.n_slots // 2)
        return exact_dedup.Directory(made.bits, known, made.n_slots // 2)

    right = exact_dedup.exact_dedup(docs, capacity=1).where("not kept").count()
    monkeypatch.setattr(exact_dedup, "directory", half)
    assert 0 < exact_dedup.exact_dedup(docs, capacity=1).where("not kept").count() < right
    assert depths[0] > 0


# --- sharding


def test_sharding(docs, texts):
    rows = sharding.place(docs, "doc_id", "text", "source", 7).collect()
    assert len(rows) == len(texts)
    counts = collections.Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(7)) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    totals = collections.Counter(r.source for r in rows)
    for (s, source), n in collections.Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - totals[source] / 7) <= 2  # the mixture of the whole
    assert {(r.size, r.text_crc32) for r in rows} == {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in texts}
    again = sharding.place(docs.repartition(5), "doc_id", "text", "source", 7).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, again))
    assert sharding.place(docs.limit(0), "doc_id", "text", "source", 7).count() == 0


def test_many_small_sources_are_spread(spark):
    """Sources of one document have places of their own instead of the middle of the line."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 3000, F.concat(F.lit("s"), F.col("id"))).otherwise("big").alias("source"))
    rows = sharding.place(docs, "doc_id", "text", "source", 8).collect()
    big = collections.Counter(r.shard for r in rows if r.source == "big")
    assert len(rows) == 4000 and all(85 <= big[s] <= 165 for s in range(8)) and sum(r.shard == 3 for r in rows) == 500


# --- mixing


def level(sizes, weights):
    """Targets by repeated resharing."""
    whole, held = 1.5 * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = whole - sum(held.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i] + 1e-9]
        if not over:
            return [held.get(i, share.get(i)) for i in range(len(sizes))]
        held |= {i: 2.0 * sizes[i] for i in over}


def test_mixing(docs, texts):
    out = mixing.mix(docs)
    rows = out.select("row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(rows) == len(texts)
    names = sorted({s for _, _, s in texts if s}) + [None]
    sizes = [sum(len(words(t)) for _, t, s in texts if s == n) for n in names]
    want = dict(zip(names, level(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])))
    for n in names:
        own = [r for r in rows if r.source == n]
        assert own[0].target == pytest.approx(want[n])
        taken, most = sum(r.size * r.copies for r in own), max(r.size for r in own)
        assert abs(taken - want[n]) <= most / 2 + 1e-6
    assert all(0 <= r.copies <= 2 and r.size == len(words(r.text)) for r in rows)
    again = mixing.mix(docs.repartition(4)).select("row.doc_id", "row.text", "copies").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, out.select("row.doc_id", "row.text", "copies").collect()))
    assert mixing.repeated(docs).count() == sum(r.copies for r in rows) and mixing.repeated(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    weighted = mixing.mix(docs.withColumn("w", F.when(F.col("doc_id") > 100, F.length("text"))), weight="w")
    assert weighted.count() == len(texts)


def test_documents_are_included_as_often_as_their_probability_says(spark, monkeypatch):
    """Many sources with the same lengths: how often a length gets its second copy is its own probability, which rises with it."""
    monkeypatch.setattr(mixing, "WEIGHTS", (1,))
    lengths, sources = [20 * (k + 1) for k in range(60)], 400
    docs = spark.range(len(lengths) * sources).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % sources)).alias("source"), F.repeat(F.lit("w "), (20 * (F.floor(F.col("id") / sources) + 1)).cast("int")).alias("text"))
    seen = {r["size"]: r["n"] / sources for r in mixing.mix(docs, carry=["doc_id"]).groupBy("size").agg(F.sum(F.col("copies") - 1).alias("n")).collect()}
    bend = [x * 1000 // (x + mixing.HALF) for x in lengths]
    mean = sum(x * g for x, g in zip(lengths, bend)) / sum(lengths)
    want = [0.5 + 0.5 * (g - mean) / 1000 for g in bend]
    assert max(want) - min(want) > 0.3
    assert max(abs(seen[x] - p) for x, p in zip(lengths, want)) < 0.11 and np.mean([seen[x] - p for x, p in zip(lengths, want)]) == pytest.approx(0, abs=0.02)


@pytest.mark.parametrize("rows", [50_000, 40])
def test_many_sources_have_the_targets_of_a_few(spark, monkeypatch, rows):
    """Targets agree with resharing by hand, in one range of sources and in many."""
    monkeypatch.setattr(shared, "ROWS_PER_RANGE", rows)
    sizes = [(k * 7919) % 97 + 1 for k in range(300)]
    rows = [(f"s{k:03}", n) for k, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    want = level(sizes, [(3, 1, 2)[k % 3] for k in range(300)])
    assert all(got[s] == pytest.approx(w) for (s, _), w in zip(rows, want))


# --- similarity join


def brute_links(texts):
    sets = []
    for _, t, _ in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) * 5 >= 4 * len(a | b)] for i, a in enumerate(sets)]
    return links


def components(links):
    seen, out = {}, []
    for i in range(len(links)):
        if i in seen:
            continue
        todo, group = [i], []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = i
                group.append(x)
                todo += links[x]
        out.append(group)
    return out


def near_copies(rng, n):
    base = [f"t{k}" for k in range(80)]
    rows = []
    for i in range(n):
        w = list(base)
        w[rng.randrange(80)] = f"edit{i}"
        rows.append((1000 + i, " ".join(w), "n"))
    return rows


@pytest.mark.parametrize("small, block", [(64, 1000), (2, 7)])
def test_similarity_join(spark, docs, texts, monkeypatch, small, block):
    """With small limits every bucket is split, dealt over tasks, and checked block against block."""
    import random

    monkeypatch.setattr(similarity_join, "SMALL", small)
    monkeypatch.setattr(similarity_join, "BLOCK", block)
    more = near_copies(random.Random(3), 40)
    rows = texts + more
    table = docs.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(i, t, "x") for i, t, _ in more], "doc_id long, text string, row string"))
    got = similarity_join.similar(table).select("row.doc_id", "row.text", "class_id", "n_links", "group_size", "kept").collect()
    links = brute_links(rows)
    want = []
    for group in components(links):
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            want.append((rows[k][0], rows[k][1], min(ids) if ids else None, len(links[k]), len(group)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(components(links))


def test_similarity_join_edges(docs):
    out = similarity_join.representatives(docs)
    assert out.columns == docs.columns and out.count() < docs.count()
    assert similarity_join.similar(docs.limit(0)).count() == 0
    assert similarity_join.runs(0.9999) == 20 and similarity_join.survival(1) == pytest.approx(1 - 1 / math.e)


# --- repeats


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), sum(1 for x, _ in itertools.groupby(gone) if x), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, merge", [(2000, 1_500_000), (1, 1000)])
def test_repeats(docs, texts, monkeypatch, hot, merge):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SUFFIXES_PER_MERGE", merge)
    out = repeats.without_repeats(docs)
    rows = out.select("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    assert sorted(tuple(r)[:4] for r in rows) == sorted(brute_repeats([t for _, t, _ in texts]))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_repeats_of_a_whole_table(spark):
    """Every window of every document of sf0.01, counted; planted passages under 400 bytes keep their bytes, by contract."""
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(docs, brute_repeats(docs.values())))
    rows = repeats.query(spark, folder).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == want and sum(w[1] > 0 for w in want.values()) > 100
    # words of the text between the first and last byte of the run, white space and all
    seen = collections.defaultdict(set)
    spans = {i: [m.span() for m in WORD.finditer(t or "")] for i, t in docs.items()}
    for i, t in docs.items():
        for k in range(len(spans[i]) - 49):
            seen[hash(t[spans[i][k][0] : spans[i][k + 49][1]])].add(i)
    passages = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    reported = {r.doc_id: r.n_shared_words for r in rows}
    assert len(passages) > 100 and all(reported[i] >= 30 for i in passages)
    assert all(0 <= n <= len(spans[i]) for i, n in reported.items()) and sum(n > 0 for n in reported.values()) < len(docs) / 2


def test_every_passage_holds_a_sampled_run(monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join(f"w{x}" for x in rng.integers(0, 3000, 4000)).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    at, run = repeats.sampled_runs(data)
    assert len(at) == len(set(run.tolist())) and np.diff(at).max() <= 21 and at[0] <= 20 and at[-1] >= 4000 - 50
    assert len(at) < 4000 / 8
    monkeypatch.setattr(repeats, "CHUNK", 100)  # cut in many parts, the same runs are sampled
    assert (np.unique(repeats.sampled_runs(data)[0]) == at).all()
    some = lambda r: repeats.shared_words((at, run), r.view(np.int64).tolist())
    assert some(run[:1]) == 30 and some(run) >= 3900 and some(run[:0]) == 0
    assert [len(x) for x in repeats.sampled_runs(data[:100])] == [0, 0]


@pytest.mark.parametrize("chunk", [1 << 20, 3000])
def test_texts_at_a_time_and_one_by_one(monkeypatch, chunk):
    """Stretches and sampled runs of a text do not depend on the texts beside it."""
    rng = np.random.default_rng(6)
    texts = [np.frombuffer(" ".join(f"w{x}" for x in rng.integers(0, 50, n)).encode() + b" " * (n % 3), dtype=np.uint8) for n in (0, 1, 60, 300, 0, 49, 50, 51, 130, 2000, 3, 100, 99, 120, 55)]
    texts += [texts[3], np.full(900, 97, dtype=np.uint8), np.full(399, 97, dtype=np.uint8), np.full(400, 97, dtype=np.uint8)]
    alone = [(repeats.stretches(t), repeats.sampled_runs(t)) for t in texts]
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    if chunk > 10_000:
        for (x, y), p, q in zip(alone, repeats.stretches_of(texts), repeats.sampled_runs_of(texts)):
            assert all((m == n).all() and len(m) == len(n) for m, n in zip((*x, *y), (*p, *q)))
    for t, p, q in zip(texts, repeats.stretches_of(texts), repeats.sampled_runs_of(texts)):
        assert p[0].tolist() == sorted(p[0]) and (not len(p[0]) or (p[0][0] == 0 and p[1][-1] == len(t) - 400 and (p[0][1:] == p[1][:-1] + 1).all()))
        assert set(q[1].tolist()) == set(repeats.sampled_runs(t)[1].tolist())


def test_merged_transforms_sort_all_suffixes():
    """The interleave of shard transforms is the order of all suffixes by their first symbols."""
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)]
    symbol, follower, before, owner = [], [], [], []
    for k, s in enumerate(strings):
        at = len(symbol)
        symbol += [*s, 0]
        follower += [*range(at + 1, at + len(s) + 1), -1]
        before += [0, *s]
        owner += [k % 3] * (len(s) + 1)
    symbol, follower, before, owner = map(np.array, (symbol, follower, before, owner))
    rounds = repeats.WINDOW // repeats.STEP
    shards = [repeats.Shard(symbol, follower, before, np.flatnonzero(owner == k)) for k in range(3)]
    suffix, block, common = repeats.interleave(shards, rounds)

    def head(node):
        out = []
        while node >= 0 and len(out) < rounds:
            out.append(int(symbol[node]))
            node = follower[node]
        return out

    # what follows the end of a string is not compared
    cut = [h[: h.index(0) + 1] if 0 in h else h for h in map(head, suffix)]
    assert sorted(suffix) == list(range(len(symbol))) and cut == sorted(cut)
    for i in range(1, len(cut)):
        if 0 not in cut[i] and 0 not in cut[i - 1]:
            same = next((k for k in range(rounds) if cut[i][k] != cut[i - 1][k]), rounds)
            assert common[i] == same and (block[i] == block[i - 1]) == (same == rounds)


def test_long_texts_are_cut_consistently(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1 << 10)
    data = np.random.default_rng(0).integers(97, 123, 5000).astype(np.uint8)
    first, last, _, _ = repeats.stretches(data)
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()


# --- language model


def test_katz(docs, texts):
    rows = katz.scores(docs).collect()
    assert len(rows) == len(texts)
    tokens = [[*words((t or "").translate(LOW)), "\n"] for _, t, _ in texts]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _, _ in texts]
    uni, big = collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held):
        if not h:
            uni.update(t)
            big.update(zip(["", *t], t))
    n, v = sum(uni.values()), len(uni)
    m = katz.model_of(np.concatenate([katz.class_counts(np.array(list(c.values()))) for c in (big, uni)] + [[n, v]]))
    single = {w: float(m.single(np.array([c]))[0]) for w, c in uni.items()}
    assert sum(single.values()) + m.unknown == pytest.approx(1)
    after = collections.defaultdict(dict)
    for (a, b), c in big.items():
        after[a][b] = c
    pair, alpha = {}, {}
    for a, f in after.items():
        total = sum(f.values())
        seen = sum(m.bigram[min(c, 6)] * c / total for c in f.values())
        left = max(1 - seen, 1 / (total + 1))
        pair |= {(a, b): m.bigram[min(c, 6)] * c / total * (1 - left) / seen for b, c in f.items()}
        alpha[a] = left / (1 - sum(single[b] for b in f))
        # probabilities after a, of all words and the unknown one, sum to one
        others = 1 - sum(single[b] for b in f)
        assert sum(pair[a, b] for b in f) + alpha[a] * others == pytest.approx(1)
    want = []
    for (i, _, _), t, h in zip(texts, tokens, held):
        score = sum(math.log10(pair[a, b] if (a, b) in pair else alpha.get(a, 1) * single.get(b, m.unknown)) for a, b in zip(["", *t], t))
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        want.append((i is None, i or 0, h, len(t), sum(uni[w] > 0 for w in t), n, round(base, 5), round(score, 5)))
    got = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in rows]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], abs=1e-4)
    assert katz.scores(docs.limit(0)).count() == 0
    only_held = katz.scores(docs.where("crc32(cast(doc_id AS string)) % 7 = 2")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in only_held)


def test_katz_without_hot_words_and_with_many(docs, monkeypatch):
    """Hot words, of any number, only say where bigrams meet; reruns over other partitions give the same numbers."""
    key = lambda r: str(r)
    rows = sorted(katz.scores(docs).collect(), key=key)
    for n in (1, 100_000):
        monkeypatch.setattr(katz, "hot_words", lambda train, common, n=n: np.unique(np.concatenate([[katz.BEGIN, katz.END], katz.tokens("w1 w2 w3 w17 the same words" * (n > 1))]).astype(np.uint64)))
        for a, b in zip(rows, sorted(katz.scores(docs).collect(), key=key)):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    train = docs.select(F.lit(1).alias("uid"), "text")
    monkeypatch.undo()
    hot = katz.hot_words(train, 8)
    assert 2 <= len(hot) <= 10 and np.isin(katz.tokens("same")[:1], katz.hot_words(train, 400)).all()


def test_packed_arrays_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True)
        some = [np.unique(keys), keys, np.repeat(keys, 3), rng.integers(0, 2**32, n), np.sort(np.repeat(keys, 2))]
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(katz.unpack(katz.pack(*some)), some))


def test_hashes_of_words():
    assert len(hashing.word_hashes(b"")) == 0 and len(hashing.word_hashes(b" \n\t")) == 0
    a = hashing.word_hashes("x Äb\x0bÄb AB".encode())
    assert len(a) == 4 and a[1] == a[2] and len(set(a.tolist())) == 3
    assert (hashing.word_hashes(b"AB ab", lower=True)[0] == hashing.word_hashes(b"AB ab", lower=True)[1]) and len(hashing.run_hashes(a, 5)) == 1


# --- quality


def brute_measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, texts):
    out = quality.judged(docs)
    rows = out.select("row.text", "row.doc_id", *quality.MEASURES[:5], "base_failed", "kept").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = brute_measures(r.text)
        assert tuple(r)[2:7] == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert quality.good_documents(docs).columns == docs.columns
    assert quality.judged(docs.limit(0)).count() == 0


def test_verdicts_of_a_table(spark):
    """Ballots, expectation-maximisation and posteriors of every document of sf0.001, document by document in plain Python."""
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    measured = {r.doc_id: dict(zip(quality.MEASURES, quality.measure(r.text))) for r in rows}

    def votes(m):
        out = []
        for share, side, bad, good in quality.RULES.values():
            a, b = share.split("/")
            x = m[a] / max(1, m[b])
            worse = (lambda bound: x > bound) if side == ">" else (lambda bound: x < bound)
            better = (lambda bound: x <= bound) if side == ">" else (lambda bound: x >= bound)
            out.append(None if not m["n_words"] else False if bad is not None and worse(bad) else True if good is not None and better(good) else None)
        return out

    ballots = {i: votes(m) for i, m in measured.items()}
    share, good, bad = 0.5, [quality.PRIOR] * len(quality.RULES), [quality.PRIOR] * len(quality.RULES)

    def probability(b):
        p, q = share, 1 - share
        for v, g, w in zip(b, good, bad):
            if v is not None:
                p, q = p * (g if v else 1 - g), q * (1 - w if v else w)
        return p / (p + q)

    for _ in range(quality.ROUNDS):
        ps = {i: probability(b) for i, b in ballots.items()}
        share = min(0.99, max(0.01, sum(ps.values()) / len(ps)))
        for k in range(len(good)):
            for side, weight, hit in ((good, lambda i: ps[i], True), (bad, lambda i: 1 - ps[i], False)):
                said = [(weight(i), b[k]) for i, b in ballots.items() if b[k] is not None]
                mean = (sum(w for w, v in said if v is hit) + 2 * quality.PRIOR) / (sum(w for w, _ in said) + 2)
                side[k] = min(quality.ACCURACY[1], max(quality.ACCURACY[0], mean))
    got = {r.doc_id: r for r in quality.query(spark, folder).collect()}
    assert len(got) == len(ballots)
    for i, b in ballots.items():
        m = measured[i]
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        assert got[i].probability == pytest.approx(probability(b), abs=1e-6) and got[i].base_failed == failed
        assert got[i].kept == (not failed and probability(b) >= quality.THRESHOLD)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    counts = collections.Counter()
    rate = np.linspace(0.7, 0.95, len(quality.RULES))
    for g in good:
        votes = [1 if rng.random() < 0.3 else (2 if (rng.random() < a) == g else 0) for a in rate]
        counts[sum(v * 3 ** (len(votes) - 1 - k) for k, v in enumerate(votes))] += 1
    share, right = quality.fit(counts)
    assert share == pytest.approx(0.8, abs=0.02) and np.abs(right - rate).max() < 0.05


# --- toxicity


def test_grammar():
    insults = {"fool": 1.0}
    kind = lambda text: {k: n for k, n in zip(toxicity.KINDS, toxicity.matches(toxicity.words_of(text), insults)) if n}
    assert kind("what a fool. nothing here") == {"insult": 1}
    assert kind("you are a fool") == {"aimed": 1}
    assert kind("not a fool") == {"negated": 1}
    assert kind("they said he is a fool") == {"reported": 1}
    assert kind("i will hurt you") == {"threat": 1} and kind("it may hurt. you know") == {}
    assert kind("fool! fool! you") == {"insult": 2} and kind("") == {} and kind("foolish") == {}


def test_toxicity(spark, docs, texts):
    rows = [(i, ("you trash " if i % 4 == 0 else "nice ") + f"w{chr(97 + i % 13)} o{chr(97 + i % 7)} t{chr(97 + i % 5)} m{chr(97 + i % 3)}", i % 4 == 0) for i in range(240)]
    train = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x), None) for i, _, x in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(train, labels)
    assert "trash" in model[0][0]
    again = toxicity.fit(train.repartition(7), labels.repartition(5).orderBy(F.desc("toxic")))
    assert again[:2] == model[:2] and (again[2] == model[2]).all()
    scored = {r.doc_id: r.score for r in toxicity.scored(train, model).select("row.doc_id", "score").collect()}
    assert all((scored[i] >= 0.7) == x for i, _, x in rows)
    other = toxicity.scored(docs, model)
    assert other.count() == len(texts) and other.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0
    none = toxicity.fit(train.limit(0), labels.limit(0))
    assert none[0] == ({}, toxicity.THREATS) and none[1] == pytest.approx(toxicity.PRIOR_BIAS)


def test_insults_of_short_texts_are_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(1, f"dolt {a}{b}") for a in letters for b in letters[:4]] + [(0, f"fine {a}{b} day") for a in letters for b in letters[:4]]
    train = spark.createDataFrame([*rows, (1, "dolt"), (1, ""), (0, None)], "toxic int, text string")
    assert list(toxicity.learned_words(train)[0]) == ["dolt"]


def test_threats_are_learned_by_their_targets(spark):
    """A word that is harmless alone and tells toxic texts apart beside a target is a threat."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(1, f"i will smash you {a}{b} now") for a in letters for b in letters[:4]]
    rows += [(0, f"smash {a}{b} flat. i saw you there") for a in letters for b in letters[:4]]
    insults, threats = toxicity.learned_words(spark.createDataFrame(rows, "toxic int, text string"))
    assert "smash" in threats and "smash" not in insults and not (threats & toxicity.TARGETS)


def test_labels_that_contradict_each_other(spark):
    known = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.createDataFrame([(known, "x")], "doc_id long, text string")
    for order in ((1, 0), (0, 1)):
        labels = spark.createDataFrame([(known, y) for y in order], "doc_id long, toxic int")
        assert [tuple(r) for r in toxicity.training_set(docs, labels, "doc_id", "text", "toxic").collect()] == [("x", 1)]


def rules(symbols):
    """The four rules read clause by clause, without states: kinds of all matches, in order."""
    out = []
    for clause in "".join(symbols).split("E"):
        waiting = 0
        for i, s in enumerate(clause):
            before = clause[max(0, i - toxicity.SCOPE) : i]
            if s == "P" and waiting:
                out.append("threat")
                waiting = 0
            if s not in "IT":
                continue
            if "R" in clause[:i]:
                out.append("reported")
            elif "N" in before:
                out.append("negated")
            elif s == "I":
                out.append("aimed" if "P" in before else "insult")
            elif "P" in before:
                out.append("threat")
            else:
                waiting = 1
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(toxicity.SYMBOLS), max_size=25))
def test_the_composed_table_follows_the_rules(symbols):
    state, out = 0, []
    for s in [*symbols, "E"]:
        state, kind = toxicity.ARCS[state][s]
        out += [kind] if kind else []
    assert out == rules(symbols)


# --- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Menu</a></li></ul></nav><!-- ad --><div class="ad banner">Buy now this very good thing at once</div>
<article><h1>A &amp; B</h1><p><b>Bold   text<br>here &#8364;<br><p title="a > b">Second paragraph &lt;with&gt; words and more words.</p>
<div class="share-buttons">Share on all of the networks</div><form><input>Sign up for news</form><p>Last one here.</p></article>
<section id="comments"><p>I am a reader and this is my comment</p></section><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE, {}) == "A & B\n\nBold text here €\n\nSecond paragraph <with> words and more words.\n\nLast one here."
    assert html_text.extract(None, {}) == "" and html_text.extract("", {}) == "" and html_text.extract("<p></p><!-- x", {}) == ""
    assert html_text.extract("plain  words\nonly", {}) == "plain words only"
    assert html_text.extract("<p>one</p><script>never closed", {}) == "one"
    assert html_text.extract('<div class="ad">x<article><p>text of it</p></article>', {}) == "text of it"
    assert html_text.extract("a < b and c", {}) == "a < b and c"


def test_omitted_end_tags_end_boilerplate():
    rest = "<p>First part of it.</p><p>Second part of it.</p>"
    want = "First part of it.\n\nSecond part of it."
    for start in ('<p class="notice">Note', '<ul><li class="nav-item">Home<li class="nav-item">About</ul>', '<div><form><input>Sign up</div>', '<dl><dt class="ad">Buy<dd class="ad">now</dl>', '<table><tr><td class="ad">Buy<td class="ad">now</table>', "<select><option>a<option>b</select>", '<div><span class="share">Share</div>'):
        for page in (f"<body><article>{start}{rest}</article></body>", f"<body><div>{start}{rest}</div></body>"):
            assert html_text.extract(page, {}) == want, page
    assert html_text.extract(f"<body><article>{rest}<div><form>Sign up</div></article><p>after", {}).startswith(want)
    assert html_text.extract('<article><p>It is.</p><form>Sign up <p>for news</p></article><footer>foot</footer>', {}) == "It is."
    assert html_text.extract('<article><ul><li>One item<li class="ad">Buy <ul><li>this</ul> now<li>Two items</ul></article>', {}) == "One item\n\nTwo items"
    assert html_text.extract(f"<head><meta charset=x><body>{rest}", {}) == want
    assert html_text.extract("<div>" * 3000 + '<p class="ad">x' + rest, {}) == want


def test_wrappers_that_hold_the_text_are_read():
    text = " ".join(f"word{i}" for i in range(60))
    body = f"<h1>The title</h1><p>{text}</p>"
    want = f"The title\n\n{text}"
    nav, foot = '<div class="nav-item">Go <a href="/">Home</a></div>', "<footer>All rights reserved</footer>"
    for tag in ("<form>", "<form><fieldset>", '<div class="content has-sidebar">', '<div id="page-with-nav">', '<div class="post share-enabled">', '<div class="entry-content related">', '<div title="a hidden gem">', '<div data-id="nav">', '<div class="side-by-side">', "<div hidden>"):
        ends = "".join(f"</{t.split()[0]}>" for t in reversed(tag.replace("<", "").split(">")[:-1]))
        for page in (f"<body>{nav}{tag}{body}{ends}{foot}</body>", f"<body>{tag}{nav}{body}{foot}{ends}</body>", f"<body><article>{tag}{body}{ends}</article>{foot}</body>"):
            assert html_text.extract(page, {}) == want, page
    for other in ('<div class="comments">', '<section id="post-comments">', "<aside>", '<div class="shareButtons">', '<div style="display: none">', '<div role="navigation">', '<div aria-hidden="true">', '<div class="cookie-notice">'):
        end = f"</{other[1:].rstrip('>').split()[0]}>"
        assert html_text.extract(f"<body>{body}{other}<p>{text} and more words of theirs</p>{end}</body>", {}) == want, other
        assert html_text.extract(f"<body><article>{body}</article>{other}<p>{text * 20}</p>{end}</body>", {}) == want, other
    assert html_text.extract(f"<body>{body}<select><option>{text * 9}</select></body>", {}) == want
    assert html_text.extract('<nav><a href="/">Home</a> <a href="/b">About</a></nav>', {}) == ""


def test_region_has_the_highest_sum():
    rng = np.random.default_rng(3)
    weights = {"p": -0.5, "a": -3.0}
    for _ in range(50):
        items = [("text", "", int(rng.integers(0, 5))) if rng.random() < 0.5 else ("tag", "p" if rng.random() < 0.5 else "a", 0) for _ in range(20)]
        score = [x[2] if x[0] == "text" else weights[x[1]] for x in items]
        a, b = html_text.region(items, weights)
        best = max([0.0, *(sum(score[i:j]) for i in range(20) for j in range(i + 1, 21))])
        assert sum(score[a:b]) == pytest.approx(best)


def test_main_text_of_a_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "u", "<p>" + "word " * 50_000, "z"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = html_text.learned(pages)
    assert all(w <= html_text.LEAST for w in weights.values())
    out = html_text.main_text(pages, weights).select("row.page_id", "text", "n_chars").collect()
    assert len(out) == 4 and {r.n_chars for r in out} == {len(r.text) for r in out} and max(r.n_chars for r in out) == 249_999
    assert html_text.main_text(pages.limit(0), html_text.learned(pages.limit(0))).count() == 0


class Reader(HTMLParser):
    """Words in the article that are in no element of a few names and classes, read by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.words, self.inside, self.skipped = [], 0, []

    def handle_starttag(self, tag, attrs):
        marks = set(" ".join(v or "" for k, v in attrs if k in ("class", "id")).split())
        if tag == "article":
            self.inside += 1
        if tag not in html_text.VOID and (self.skipped and tag == self.skipped[-1] or tag in ("nav", "aside", "form", "footer", "script", "style") or marks & {"ad", "comments", "share", "sidebar", "related", "cookie", "notice"}):
            self.skipped.append(tag)

    def handle_endtag(self, tag):
        if self.skipped and tag == self.skipped[-1]:
            self.skipped.pop()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.words.append(data)


def test_articles_of_a_table(spark):
    """Every page of sf0.01: the words are the article's, with and without the element that says so."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html IS NOT NULL")
    want = {}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html)
        want[r.page_id] = "".join(f"{w} " for w in reader.words).split()
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)(article|main)\\b", "$1div"))
    for table in (pages, plain):
        got = {r.page_id: r.text for r in html_text.main_text(table, html_text.learned(table), carry=["page_id"]).select("row.page_id", "text").collect()}
        assert len(got) == len(want) and sum("".join(got[i].split()) == "".join(want[i]) for i in want) >= 0.99 * len(want)


def test_tag_names_are_whole_and_all_counted(spark):
    name = "x" * 60
    page = "<article><p>some words in it</p></article>" + "".join(f"<{name}{i}>a</{name}{i}>" for i in range(1100))
    weights = html_text.learned(spark.createDataFrame([(page,)], "html string"))
    assert len(weights) > 1100 and f"{name}7" in weights


# --- packing


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encoder = Tokenizer.from_file(path)
    packed = packing.packed_documents(docs, path, with_ids=True)
    rows = packed.collect()
    want = collections.Counter()
    for i, t, _ in texts:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[i, p, s, tuple(ids[s : s + 4096])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows) == want
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(r.length for r in rows) and max(map(len, whole.values())) <= 4096
    assert len(whole) == -(-sum(r.length for r in rows) // 4096)
    assert packing.packed_documents(docs.limit(0), path).count() == 0


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(packing.tokenizer_path())
    return made, packing.word_ends(made)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cc"]) | st.sampled_from("aZ.,'İıßéẞǅ́̇ﬁ0٣漢ー"), min_size=1, max_size=6), max_size=12))
def test_words_are_encoded_as_in_the_text(some):
    """Ids of whole texts, put together from words and their stems, are the tokenizer's own."""
    encoder, ends = tokenizer()
    text = " ".join([*some, "İ. I\u0307, word. WORD, x.,. it's. a\u0301."])
    words = packing._word.findall(text)
    known = packing.encoded(encoder, list(set(words)), {}, ends)
    assert b"".join(known[w] for w in words) == np.array(encoder.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def fewest(sizes, capacity):
    """Least number of bins, by trying."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[k]:
                rest = list(bins)
                rest[rest.index(room)] -= sizes[k]
                place(k + 1, rest)
        place(k + 1, [*bins, capacity - sizes[k]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(1, 21, rng.integers(3, 10)).tolist()
        inst = packing.Instance(collections.Counter(sizes), 20)
        fixed = packing.reduce(inst)
        rest = [int(x) for x in inst.present() for _ in range(inst.count[x])]
        assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(sizes, 20)
        assert sorted([*rest, *[x for lengths, n in fixed for x in lengths * n]]) == sorted(sizes)
        places, n = packing.plan(collections.Counter(sizes), 20)
        assert n <= fewest(sizes, 20) + 1 and len(places["first"]) > 0


# --- helpers


def test_running_rank(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("h"), "id").withColumn("b", F.shiftright("h", 61).cast("int"))
    rows = shared.running_rank(df, ["k"], "b", [F.col("h")], "id").collect()
    for k in range(3):
        own = sorted((r for r in rows if r.k == k), key=lambda r: r.h)
        assert [r.before for r in own] == [sum(x.id for x in own[:i]) for i in range(len(own))] and all(r.whole == sum(x.id for x in own) for r in own)


def test_lower_case_of_letters_a_to_z_only(spark):
    for text in ("ABC xyz", "ÀÉ ABC İ", ""):
        assert spark.range(1).select(shared.ascii_lower(F.lit(text)).alias("x")).first().x == text.translate(LOW)
