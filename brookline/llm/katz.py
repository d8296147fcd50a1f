"""Katz backoff language model of order two, stored in partitioned tables, and the scores of documents under it.

Words are 64-bit hashes (two of a thousand million different words collide with a probability of 3 %). P(w | v) =
d(c) c(v,w) / c(v) for bigrams seen in training, with Good-Turing discounts d for counts up to K; else alpha(v) P(w), where P
is the unigram model, discounted the same way, whose left-over mass is that of one unknown word. alpha(v) makes the
probabilities after v sum to exactly one. A word's count as a predicted token is also its count as a context, because the end
token follows the last word of every text.

Everything the corpus gives is moved as packed arrays, combined per task, never as a row for each token:
1. A first pass over the training texts finds hot words: those that make up 1 / common of a batch of texts are summed, and the
   ones with 1 / common of all tokens are hot. There are at most `common` of these, at most HOT_WORDS, so they and their
   statistics are broadcast; a word with twice that share is always among them.
2. Training bigrams, combined within a task, go to the partition of their second word; there counts are final, and so is the
   word's own count. Bigrams with a hot second word are dealt by the whole bigram, and the word's own count is the sum over
   partitions. The table of (v, w, c(v,w), c(w)) is written to the shared folder; counts of counts are added up
   there and give the discounts.
3. That table and the bigrams of all documents go to the partition of their first word (hot ones again by the whole bigram,
   their alphas from additive statistics), where seen bigrams are found by binary search, and each document gets its sums:
   log P of the bigram, or log alpha; log P of the first word itself, its base score and whether it is known, since each word
   comes once as a first word. log P(w | v) is evaluated as log P(w) plus a correction for seen bigrams or log alpha(v) for
   others, so both levels of the recursion add up.
4. The sums travel as arrays over a batch of documents, and those of the partitions are added, in the order of partitions, so
   that reruns agree to the last bit.
A batch has at most one row for each partition and at most one for each bigram, so rows never outgrow the tokens.

Defined cases: a null or empty text is the end token alone; without training texts every word is unknown, with
probability 1; contexts that were never seen back off with alpha 1; a context that leaves no discounted mass gives
1 / (c(v) + 1) to the unseen; repeated rows count, and are scored, each; a null doc_id is trained on if the checksum of
the empty text says so, as for any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brookline.llm.hashing import mixed, word_hashes
from brookline.llm.shared import col, documents, stage, tasks_for

K, FOLDS, HELD_OUT = 5, 7, 2
MOST_DISCOUNTED = 0.75
BEGIN, END = np.uint64(0), np.uint64(1)
TOKENS_PER_FLUSH, BYTES_PER_PARTITION, HOT_WORDS = 2_000_000, 32 << 20, 1 << 17


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, then END."""
    return np.append(word_hashes((text or "").encode(), lower=True), END)


def part(key: np.ndarray, n: int) -> np.ndarray:
    """Partition 0..n-1 of keys; it rises with them."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def route(by: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Partition of a bigram: that of the word it is dealt by, for hot ones that of the whole bigram."""
    return np.where(np.isin(by, hot), part(mixed(v * np.uint64(31) + w), n), part(by, n))


def planes(x: np.ndarray, wide: int) -> bytes:
    """Numbers as their lowest bytes, then the next ones, and so on."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed: numbers as 32 bits, keys (uint64) as the steps between the different ones and,
    where they do not rise, their places among these."""
    head, out = [len(arrays)], []
    for a in arrays:
        if a.dtype != np.uint64:
            head += [len(a), -1]
            out.append(planes(a, 4))
            continue
        rising = bool((a[1:] > a[:-1]).all())
        keys, places = (a, None) if rising else np.unique(a, return_inverse=True)
        head += [len(a), -2 if rising else len(keys)]
        out.append(planes(np.diff(keys, prepend=np.uint64(0)), 8))
        if not rising:
            out.append(planes(places, 4))
    plain = b"".join([np.array(head, dtype="<i8").tobytes(), *out])
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    data = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 1 + 2 * n)
    at, out = 8 * len(head), []

    def numbers(size: int, wide: int) -> np.ndarray:
        nonlocal at
        full = np.zeros((size, 8), dtype=np.uint8)
        full[:, :wide] = np.frombuffer(data, np.uint8, size * wide, at).reshape(wide, size).T
        at += size * wide
        return full.reshape(-1).view("<i8")

    for size, different in head[1:].reshape(-1, 2).tolist():
        if different == -1:
            out.append(numbers(size, 4))
            continue
        keys = np.cumsum(numbers(size if different == -2 else different, 8).view("<u8"), dtype=np.uint64)
        out.append(keys if different == -2 else keys[numbers(size, 4)])
    return out


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in arrays that are sorted together."""
    change = np.zeros(len(sorted_keys[0]), dtype=bool)
    change[:1] = True
    for k in sorted_keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def runs(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        yield from zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("data"))


def rows_out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "data"])


ROWS = "part int, kind int, data binary"


def bigrams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], int, list]]:
    """Token arrays of many texts at a time, the number of the first of them, and their ids."""
    held, ids, first, n = [], [], None, 0
    for batch in batches:
        named = batch.column("doc_id") if "doc_id" in batch.schema.names else batch.column("uid")
        for text, uid, own in zip(batch.column("text"), batch.column("uid"), named):
            t = tokens(text.as_py())
            first = uid.as_py() if first is None else first
            held.append(t)
            ids.append(own.as_py())
            n += len(t)
            if n >= TOKENS_PER_FLUSH:
                yield held, first, ids
                held, ids, first, n = [], [], None, 0
    if held:
        yield held, first, ids


def pairs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w = np.concatenate(texts)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.cumsum([0, *map(len, texts[:-1])])] = BEGIN
    return v, w


def counted(v: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (v, w), by w, then v, with their counts."""
    order = np.lexsort((v, w))
    v, w = v[order], w[order]
    at = starts_of(w, v)
    total = runs(at, len(w)) if n is None else np.add.reduceat(n[order], at) if len(at) else n[:0]
    return v[at], w[at], total


def common_words(batches: Iterator[pa.RecordBatch], common: int) -> Iterator[pa.RecordBatch]:
    """Of each batch of texts, the words that make up 1 / common of it (kind 1) and its tokens (kind 0)."""
    for texts, _, _ in bigrams_of(batches):
        every = np.concatenate(texts)
        words, n = np.unique(every, return_counts=True)
        keep = n * common >= len(every)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(0, np.ones(keep.sum(), dtype=np.int64)), pa.int32()), pa.array(np.append(0, words[keep].view(np.int64))), pa.array(np.append(len(every), n[keep]))], names=["kind", "word", "n"])


def hot_words(train: DataFrame, common: int) -> np.ndarray:
    """Words with 1 / common of all tokens in the batches where they make up as much, BEGIN and END, in order."""
    sums = stage(train.mapInArrow(lambda it: common_words(it, common), "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")), "katz-common")
    total = sums.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    rows = sums.where("kind = 1").where(F.col("n") * common >= total).select("word").collect()  # at most `common`
    return np.unique(np.array([int(BEGIN), int(END), *[r["word"] for r in rows]], dtype=np.int64).view(np.uint64))


def emit_training(batches: Iterator[pa.RecordBatch], hot: np.ndarray, n_parts: int) -> Iterator[pa.RecordBatch]:
    for texts, _, _ in bigrams_of(batches):
        v, w, c = counted(*pairs(texts))
        p = route(w, v, w, hot, n_parts)
        order = np.argsort(p, kind="stable")
        v, w, c, p = v[order], w[order], c[order], p[order]
        at = np.searchsorted(p, np.arange(n_parts + 1))
        out = []
        for q, (a, b) in enumerate(zip(at, at[1:])):
            if b > a:
                first = starts_of(w[a:b])
                out.append((q, 0, pack(w[a:b][first], runs(first, b - a), v[a:b], c[a:b])))
        yield rows_out(out)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The rows of each partition, of a stream sorted by it."""
    now, held = None, []
    for q, kind, data in row_batches(batches):
        if q != now and held:
            yield now, held
            held = []
        now = q
        held.append((kind, data.as_py()))
    if held:
        yield now, held


def class_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2]


def reduce_training(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The count table (kind 0), counts of counts (kind 1), and the shares of hot words' counts (kind 2)."""
    for q, rows in by_part(batches):
        parts = [unpack(d) for _, d in rows]
        w = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        v, w, c = counted(np.concatenate([p[2] for p in parts]), w, np.concatenate([p[3] for p in parts]))
        first = starts_of(w)
        own = np.add.reduceat(c, first)
        sizes = runs(first, len(w))
        is_hot = np.isin(w[first], hot)
        out = [(q, 1, np.concatenate([class_counts(c), class_counts(own[~is_hot]), [own[~is_hot].sum(), (~is_hot).sum()]]).astype("<i8").tobytes())]
        out.append((q, 2, pack(w[first][is_hot], own[is_hot])))
        for a in range(0, len(first), 100_000):
            b = min(len(first), a + 100_000)
            lo, hi = first[a], first[b] if b < len(first) else len(w)
            out.append((q, 0, pack(w[first[a:b]], sizes[a:b], own[a:b], v[lo:hi], c[lo:hi])))
        yield rows_out(out)


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, data in row_batches(batches):
        words, n = unpack(data.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's counts of counts, by place."""
    total = np.zeros(2 * K + 6, dtype=np.int64)
    for batch in batches:
        for data in batch.column("data"):
            total += np.frombuffer(data.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "n"])


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's discounts for counts 0..K+1 from counts of counts n[0..K+1] (the last is 1, for all larger counts).

    Where the counts of counts do not support the formula, absolute discounting takes its place: (r - n1 / (n1 + 2 n2)) / r.
    """
    d = np.ones(K + 2)
    n = n.astype(float)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    absolute = min(n[1] / (n[1] + 2 * n[2]), MOST_DISCOUNTED) if n[1] else 0.5  # without a count of two all of it would go
    for r in range(1, K + 1):
        raw = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        good = (raw - common) / (1 - common) if common < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - absolute) / r
    return d


@dataclass
class Model:
    """The numbers of the model that do not belong to a word."""

    n: int  # tokens of training
    v: int  # different tokens of training
    bigram: np.ndarray  # discounts
    unigram: np.ndarray
    scale: float  # of discounted unigram probabilities
    unknown: float  # probability of the unknown word

    def single(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts."""
        known = self.unigram[np.minimum(c, K + 1)] * c / max(1, self.n) * self.scale
        return np.where(c > 0, known, self.unknown)

    def alphas(self, total: np.ndarray, classes: np.ndarray, rest: np.ndarray, lower: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scale of seen probabilities, alpha) of contexts, from additive statistics: count, bigrams by count 1..K, the
        larger counts' sum, and the same two of the followers' own counts."""
        r = np.arange(1, K + 1)
        seen = np.maximum((classes @ (self.bigram[1 : K + 1] * r) + rest) / np.maximum(total, 1), 1e-300)  # a hot word may be no context
        left = np.maximum(1 - seen, 1 / (total + 1.0))
        below = (lower @ (self.unigram[1 : K + 1] * r) + more) / max(1, self.n) * self.scale
        return (1 - left) / seen, left / np.maximum(1 - below, self.unknown)


def model_of(stats: np.ndarray) -> Model:
    big, uni = stats[: K + 2], stats[K + 2 : 2 * K + 4]
    n, v = int(stats[-2]), int(stats[-1])
    if not n:
        return Model(0, 0, np.ones(K + 2), np.ones(K + 2), 1.0, 1.0)
    d = discounts(uni)
    r = np.arange(1, K + 1)
    seen = (uni[1 : K + 1] * r * d[1 : K + 1]).sum() / n + 1 - (uni[1 : K + 1] * r).sum() / n
    unknown = max(1 - seen, 1 / (n + 1))
    return Model(n, v, discounts(big), d, (1 - unknown) / seen, unknown)


def statistics(c: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The statistics of Model.alphas() for groups that start at `at`."""

    def classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.column_stack([np.add.reduceat((x == r).astype(np.int64), at) for r in range(1, K + 1)]), np.add.reduceat(np.where(x > K, x, 0), at)

    return np.add.reduceat(c, at), *classes(c), *classes(own)


def table_rows(data: bytes, hot: np.ndarray, hot_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, c(v,w), c(w)) of a row of the count table."""
    w, sizes, own, v, c = unpack(data)
    at, is_hot = found(hot, w)
    own = np.where(is_hot, hot_counts[at], own)
    return v, np.repeat(w, sizes), c, np.repeat(own, sizes)


def hot_statistics(batches: Iterator[pa.RecordBatch], hot: np.ndarray, hot_counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, _, data in row_batches(batches):
        v, _, c, own = table_rows(data.as_py(), hot, hot_counts)
        keep = np.flatnonzero(np.isin(v, hot))
        keep = keep[np.argsort(v[keep], kind="stable")]
        if not len(keep):
            continue
        at = starts_of(v[keep])
        total, a, b, lower, more = statistics(c[keep], own[keep], at)
        table = np.column_stack([total, a, b, lower, more])
        yield pa.RecordBatch.from_arrays([pa.array(v[keep][at].view(np.int64)), *[pa.array(x) for x in table.T]], names=["v", *[f"s{i}" for i in range(table.shape[1])]])


def with_batch(rows: list[tuple[int, int, bytes]], batch: int, ids: list, id_type: pa.DataType) -> pa.RecordBatch:
    """rows with the columns batch and ids; ids belong to rows of kind 2."""
    columns = list(zip(*rows)) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array([batch] * len(rows), pa.int64()), pa.array([ids if k == 2 else None for k in columns[1]], pa.list_(id_type))],
        names=["part", "kind", "data", "batch", "ids"],
    )


def emit_table(batches: Iterator[pa.RecordBatch], hot: np.ndarray, hot_counts: np.ndarray, n_parts: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for _, _, data in row_batches(batches):
        v, w, c, own = table_rows(data.as_py(), hot, hot_counts)
        p = route(v, v, w, hot, n_parts)
        order = np.lexsort((v, p))
        v, w, c, own, p = v[order], w[order], c[order], own[order], p[order]
        at = np.searchsorted(p, np.arange(n_parts + 1))
        yield with_batch([(q, 0, pack(v[a:b], w[a:b], c[a:b], own[a:b])) for q, (a, b) in enumerate(zip(at, at[1:])) if b > a], 0, [], id_type)


def emit_queries(batches: Iterator[pa.RecordBatch], hot: np.ndarray, n_parts: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Bigrams of many documents (kind 1): first words with the number of their bigrams, second words with the number of
    their documents, documents by place. And the documents themselves (kind 2), with their lengths."""
    for texts, batch, ids in bigrams_of(batches):
        v, w = pairs(texts)
        lengths = np.array([len(t) for t in texts])
        doc = np.repeat(np.arange(len(texts)), lengths)
        p = route(v, v, w, hot, n_parts)
        order = np.lexsort((w, v, p))
        v, w, p, doc = v[order], w[order], p[order], doc[order]
        at = np.searchsorted(p, np.arange(n_parts + 1))
        out = [(batch * 7 % n_parts, 2, pack(lengths))]
        for q, (a, b) in enumerate(zip(at, at[1:])):
            if b > a:
                pair, word = starts_of(v[a:b], w[a:b]), starts_of(v[a:b])
                per_word = np.diff(np.append(np.searchsorted(pair, word), len(pair)))
                out.append((q, 1, pack(v[a:b][word], per_word, w[a:b][pair], runs(pair, b - a), doc[a:b])))
        yield with_batch(out, batch, ids, id_type)


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether it is there) of wanted in sorted keys, of which there may be none."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


def gram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(v + np.uint64(3)) + w)


def score_parts(batches: Iterator[pa.RecordBatch], model: Model, hot: np.ndarray, hot_table: np.ndarray, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Sums over the bigrams of a partition, for each document of a batch (kind 1): base score, score, known words."""
    hot_scale, hot_alpha = model.alphas(hot_table[:, 0], hot_table[:, 1 : K + 1], hot_table[:, K + 1], hot_table[:, K + 2 : 2 * K + 2], hot_table[:, 2 * K + 2])
    now, held, ready = None, [], None
    none = np.zeros(0, dtype=np.uint64)

    for p, kind, data, batch, ids in ((p, k, d, u, i) for b in batches for p, k, d, u, i in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("data"), b.column("batch").to_pylist(), b.column("ids"))):
        if kind == 2:
            yield with_batch([(p, 2, data.as_py())], batch, ids.as_py(), id_type)
            continue
        if p != now:
            now, held, ready = p, [], None
        if kind == 0:
            held.append(unpack(data.as_py()))
            continue
        if ready is None:
            v, w, c, own = (np.concatenate([h[i] for h in held]) for i in range(4)) if held else (none, none, none.astype(np.int64), none.astype(np.int64))
            held = []
            order = np.argsort(v, kind="stable")
            v, w, c, own = v[order], w[order], c[order], own[order]
            at = starts_of(v)
            context = v[at]
            if len(at):
                stats = statistics(c, own, at)
                total, (scale, alpha) = stats[0], model.alphas(*stats)
            else:
                total, scale, alpha = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
            i, is_hot = found(hot, context)
            total[is_hot], scale[is_hot], alpha[is_hot] = hot_table[i[is_hot], 0], hot_scale[i[is_hot]], hot_alpha[i[is_hot]]
            owner = np.repeat(np.arange(len(at)), runs(at, len(v)))
            seen = model.bigram[np.minimum(c, K + 1)] * c / total[owner] * scale[owner]
            keys = gram(v, w)
            order = np.argsort(keys)
            # the correction that turns log P(w) into log P(w | v)
            ready = keys[order], np.log10(seen[order] / model.single(own[order])), context, total, np.log10(alpha)
            del v, w, c, own, seen, keys, owner, order
        keys, gain, context, total, log_alpha = ready
        qv, per_word, qw, docs_of, doc = unpack(data.as_py())
        i, known = found(context, qv)
        count = np.where(known, total[i], 0) if len(context) else np.zeros(len(qv), dtype=np.int64)
        back = np.where(known, log_alpha[i], 0.0) if len(context) else np.zeros(len(qv))
        # hot contexts of which this partition has no bigram
        j, is_hot = found(hot, qv)
        count[is_hot], back[is_hot] = hot_table[j[is_hot], 0], np.log10(hot_alpha[j[is_hot]])
        k, there = found(keys, gram(np.repeat(qv, per_word), qw))
        second = np.where(there, gain[k] if len(gain) else 0.0, np.repeat(back, per_word))
        token = qv != BEGIN
        first = np.where(token, np.log10(model.single(count)), 0.0)
        base = np.where(token, np.log10((count + 1) / (model.n + model.v + 1)), 0.0)
        known_word = (count > 0) & token
        each = np.repeat(np.arange(len(qv)), per_word)
        of_pair = np.repeat(np.arange(len(qw)), docs_of)
        n_docs = int(doc.max()) + 1
        sums = [np.bincount(doc, weights=x, minlength=n_docs) for x in (base[each][of_pair], first[each][of_pair] + second[of_pair], known_word[each][of_pair])]
        plain = b"".join([sums[0].tobytes(), sums[1].tobytes(), sums[2].astype("<i4").tobytes()])
        yield with_batch([(p, 1, plain)], batch, [], id_type)


def totals(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of each document, of a stream sorted by batch, the documents' own row last."""
    base, score, known = np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)
    for b in batches:
        for kind, data, ids in zip(b.column("kind").to_pylist(), b.column("data"), b.column("ids")):
            if kind == 1:
                part = data.as_py()
                n = len(part) // 20
                if n > len(base):
                    base, score, known = (np.append(x, np.zeros(n - len(x), dtype=x.dtype)) for x in (base, score, known))
                base[:n] += np.frombuffer(part, "<f8", n)
                score[:n] += np.frombuffer(part, "<f8", n, 8 * n)
                known[:n] += np.frombuffer(part, "<i4", n, 16 * n)
            else:
                (lengths,) = unpack(data.as_py())
                n = len(lengths)
                base, score, known = (np.append(x, np.zeros(max(0, n - len(x)), dtype=x.dtype)) for x in (base, score, known))
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), id_type), pa.array(lengths), pa.array(known[:n]), pa.array(base[:n]), pa.array(score[:n])], names=["doc_id", "n_tokens", "known", "base", "score"])
                base, score, known = np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    table = docs.select(F.monotonically_increasing_id().alias("uid"), col(doc_id).alias("doc_id"), col(text).alias("text"))
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = tasks_for(spark, size, BYTES_PER_PARTITION)
    train = table.where(fold(F.col("doc_id")) != HELD_OUT).select("uid", "text")
    words = spark.sparkContext.broadcast(hot_words(train, min(8 * n_parts, HOT_WORDS)))
    sent = train.mapInArrow(lambda it: emit_training(it, words.value, n_parts), ROWS)
    counts = stage(sent.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part").mapInArrow(lambda it: reduce_training(it, words.value), ROWS), "katz-counts")

    hot = words.value
    own = np.zeros(len(hot), dtype=np.int64)
    for r in counts.where("kind = 2").select("part", "kind", "data").mapInArrow(shares, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most HOT_WORDS + 2 rows
        own[np.searchsorted(hot, np.array(r["word"], dtype=np.int64).view(np.uint64))] = r["n"]
    stats = np.zeros(2 * K + 6, dtype=np.int64)
    for r in counts.where("kind = 1").select("data").mapInArrow(added, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 16 rows
        stats[r["at"]] = r["n"]
    stats[K + 2 : 2 * K + 4] += class_counts(own[own > 0])
    stats[-2:] += [own.sum(), (own > 0).sum()]
    model = model_of(stats)
    known = spark.sparkContext.broadcast((hot, own))
    sums = counts.where("kind = 0").mapInArrow(lambda it: hot_statistics(it, *known.value), "v long, " + ", ".join(f"s{i} long" for i in range(2 * K + 3)))
    table_of_hot = np.zeros((len(hot), 2 * K + 3), dtype=np.int64)
    for r in sums.groupBy("v").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(2 * K + 3)]).collect():  # at most HOT_WORDS + 2 rows
        table_of_hot[np.searchsorted(hot, np.array(r["v"], dtype=np.int64).view(np.uint64))] = r[1:]
    hot_table = spark.sparkContext.broadcast(table_of_hot)  # 104 bytes a word

    kind_of_id = table.schema["doc_id"].dataType
    id_type = to_arrow_type(kind_of_id)
    rows = ROWS + f", batch long, ids array<{kind_of_id.simpleString()}>"
    grams = counts.where("kind = 0").mapInArrow(lambda it: emit_table(it, *known.value, n_parts, id_type), rows)
    queries = table.mapInArrow(lambda it: emit_queries(it, words.value, n_parts, id_type), rows)
    met = grams.union(queries).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "kind")
    sums = met.mapInArrow(lambda it: score_parts(it, model, words.value, hot_table.value, id_type), rows)
    total = sums.repartition(n_parts, "batch").sortWithinPartitions("batch", "kind", "part").mapInArrow(lambda it: totals(it, id_type), f"doc_id {kind_of_id.simpleString()}, n_tokens long, known long, base double, score double")
    # the end token, the same for every document
    ends = int(table_of_hot[np.searchsorted(hot, BEGIN), 0])
    end_base = math.log10((ends + 1) / (model.n + model.v + 1)) if model.n else 0.0
    end_score = float(np.log10(model.single(np.array([ends]))[0]))
    return total.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + (1 if ends else 0)).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        (F.col("score") + end_score).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir, "doc_id", "text"))
