"""Packing documents into token sequences: Martello-Toth dominance reduction, then best fit.

Only the lengths of pieces matter to a packing, and they run from 1 to the capacity, so the instance is a histogram of
at most `capacity` numbers however many documents there are. That histogram is all the driver sees. It is reduced first:
a piece is fixed together with others in a bin of their own wherever that provably dominates every other bin it could
be in (see reduce). What is left is packed best fit, largest first, equal bins at once. The outcome is a list of bin
patterns with counts; the pieces of each length, ranked by a hash in the cluster, take the places that the patterns
hold for that length.

Token ids come from a tokenizer file that the caller names. It drops white space and never joins words, so each word is
encoded once a task and looked up afterwards.

Defined cases: a null or empty text is the end token alone; a piece of a cut document is placed like any other; equal
lengths are interchangeable and their order is that of a hash; repeated rows are separate documents; an empty table
gives an empty result; a null doc_id is kept as it is; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.shared import INT, LONG, col, documents, running_rank, stage

CAPACITY, END, ROWS_PER_BUCKET, CACHED_WORDS, CACHED_STEMS = 4096, 1, 1_000, 200_000, 400_000
#: White space by which words are split before they are encoded; the tokenizer drops it too.
_word = re.compile(r"[^ \t\r\n]+")


def encoded_stems(encoder, words: list[str], ends: np.ndarray) -> dict[str, bytes]:
    """The ids of each word as bytes. Words of letters alone are encoded many at a time, as one text; `ends` tells which
    ids end a word, so the ids of each are found again. Should their number not fit, they are encoded one by one."""
    letters, out = [w for w in words if w.isalpha()], {}
    chunks = [letters[i : i + 2000] for i in range(0, len(letters), 2000)]
    rest = [w for w in words if not w.isalpha()]
    for chunk, e in zip(chunks, encoder.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
        ids = np.array(e.ids, dtype="<u4")
        last = np.flatnonzero(ends[ids]) + 1
        if len(last) != len(chunk):
            rest += chunk
            continue
        data, cuts = ids.tobytes(), (4 * last).tolist()
        out.update((w, data[a:b]) for w, a, b in zip(chunk, [0, *cuts], cuts))
    out.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, encoder.encode_batch_fast(rest, add_special_tokens=False)))
    return out


def word_ends(encoder) -> np.ndarray:
    """For each id, whether its token ends a word."""
    out = np.zeros(encoder.get_vocab_size() + 1, dtype=bool)
    for token, i in encoder.get_vocab().items():
        out[i] = token.endswith("</w>")
    return out


def encoded(encoder, words: list[str], stems: dict[str, bytes], ends: np.ndarray) -> dict[str, bytes]:
    """The ids of each word as bytes. A stop or comma after a letter is a token of its own, and case is dropped; but a letter
    whose lower case ends in a mark (the dotted capital I) joins what follows, so such a word is encoded whole. stems: what is
    encoded already; ends: see encoded_stems()."""
    bare = [w.rstrip(".,") for w in words]
    stem = [(s.lower() if s.isascii() else s) if s and s[-1].lower().isalpha() else w for s, w in zip(bare, words)]
    tail = [w[len(s) :] for s, w in zip(stem, words)]
    new = list({*stem, *tail}.difference(stems))
    stems.update(encoded_stems(encoder, new, ends))
    out = {w: stems[s] + stems[t] for s, t, w in zip(stem, tail, words)}
    if len(stems) > CACHED_STEMS:  # the first ones seen are the common ones
        for s in new:
            del stems[s]
    return out


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    given = docs.select(col(doc_id).alias("doc_id"), col(text).alias("_text"))
    fields = [T.StructField("doc_id", given.schema["doc_id"].dataType), T.StructField("piece", INT), T.StructField("start", LONG), T.StructField("length", LONG), T.StructField("ids_crc32", LONG)]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(LONG))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        # the encoder and the words that it has encoded stay with the worker process from task to task
        kept = vars(tokenizers).setdefault("_words_by_file", {})
        if tokenizer not in kept:
            made = tokenizers.Tokenizer.from_file(tokenizer)
            kept[tokenizer] = (made, word_ends(made), {}, {})
        encoder, ends, known, stems = kept[tokenizer]
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            places: list[int] = []
            columns: list[list] = [[] for _ in range(5)]
            for first in range(0, batch.num_rows, 256):
                texts = [_word.findall(t.as_py() or "") for t in batch.column("_text").slice(first, 256)]
                words = set().union(*texts)
                new = encoded(encoder, list(words.difference(known)), stems, ends)
                known.update(new)
                for at, text in enumerate(texts, first):
                    ids = b"".join(map(known.__getitem__, text)) + last
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        places.append(at)
                        for column, value in zip(columns, (piece, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, dtype="<u4") if with_ids else None)):
                            column.append(value)
                if len(known) > CACHED_WORDS:
                    for w in new:
                        del known[w]
            arrays = [batch.column("doc_id").take(pa.array(places, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:4]]]
            if with_ids:
                arrays.append(pa.array([x.astype("int64") for x in columns[4]], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return given.mapInArrow(run, schema)


class Instance:
    """Counts of lengths, and what fits beside them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.count = capacity, np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.count[length] += n

    def present(self) -> np.ndarray:
        return np.flatnonzero(self.count)

    def floor(self) -> np.ndarray:
        """For every room, the largest length that is there and fits; 0 if none does."""
        sizes = np.where(self.count > 0, np.arange(self.capacity + 1), 0)
        return np.maximum.accumulate(sizes)

    def take(self, lengths: tuple[int, ...]) -> int:
        """Remove as many bins of these lengths as the counts allow; how many."""
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(self.count[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.count[x] -= n * k
        return n


def dominating(inst: Instance, w: int) -> tuple[int, ...] | None:
    """A set with w that dominates every other set with w: each of those splits into parts that fit into single items of
    this one (Martello and Toth). None if no set of at most three items is seen to. Lengths that occur once may stand in
    for two when the others are bounded, which only makes the test stricter."""
    room = inst.capacity - w
    inst.count[w] -= 1
    try:
        sizes = inst.present()
        sizes = sizes[sizes <= room]
        if not len(sizes):
            return (w,)
        one = int(sizes[-1])
        if one == room:  # a full bin of two: whatever else fits beside w fits into the other item
            return (w, one)
        least = int(sizes[0])
        if 2 * least > room:  # nothing but single items fits
            return (w, one)
        if 3 * least > room:
            floor = inst.floor()
            rest = floor[room - sizes]
            pairs = np.where(rest > 0, sizes + rest, 0)
            if one >= pairs.max():  # every pair fits into the single item
                return (w, one)
            second = int(floor[room - one])
            smaller = np.minimum(sizes, rest)
            real = second and (second != one or inst.count[one] > 1)
            if real and smaller.max() <= second:  # of every pair, the larger fits into one and the smaller into second
                return (w, one, second)
        return None
    finally:
        inst.count[w] += 1


def reduce(inst: Instance) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating bins, largest items first, until no item has one: [(lengths, bins)]."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    for w in inst.present()[::-1]:  # full bins of two, wherever they are
        other = inst.capacity - int(w)
        if other >= 1 and inst.count[w] and inst.count[other]:
            if n := inst.take((int(w), other)):
                fixed.append(((int(w), other), n))
    again = True
    while again:
        again = False
        for w in inst.present()[::-1]:
            w = int(w)
            while inst.count[w] and (found := dominating(inst, w)):
                n = inst.take(found)
                fixed.append((found, n))
                again = True
    return fixed


def best_fit(inst: Instance) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, largest first, over counts: [(((length, times), ...), bins)]. Bins with one content are handled at once."""
    open_: list[list[list]] = [[] for _ in range(inst.capacity + 1)]  # by room: [content, bins]
    for s in inst.present()[::-1]:
        s, left = int(s), int(inst.count[s])
        for room in range(s, inst.capacity + 1):
            if not left:
                break
            if room == inst.capacity and not open_[room]:
                open_[room].append([(), left])  # as many new bins as are ever needed
            classes, open_[room] = open_[room], []
            each = room // s
            for content, bins in classes:
                full = min(bins, left // each)
                if full:
                    open_[room - each * s].append([content + ((s, each),), full])
                    left -= full * each
                    bins -= full
                if bins and left:  # fewer than a bin holds: the last one
                    open_[room - left * s].append([content + ((s, left),), 1])
                    left, bins = 0, bins - 1
                if bins and room < inst.capacity:
                    open_[room].append([content, bins])
    return [(content, bins) for classes in open_ for content, bins in classes if content]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Places for all pieces, ordered by length: arrays first, length, base, times, offset; and the number of sequences.

    Places first[i] .. first[i + 1] - 1 of row i are for one length: place t is in sequence base + t // times, at
    offset + (t % times) * length.
    """
    inst = Instance(counts, capacity)
    bins = [(tuple((x, 1) for x in lengths), n) for lengths, n in reduce(inst)]
    bins += best_fit(inst)
    rows, base = [], 0
    for content, n in bins:
        offset = 0
        for length, times in content:
            rows.append((length, base, times, offset, n * times))
            offset += length * times
        base += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    first = np.concatenate([[0], np.cumsum(table[:, 4])])[:-1] if len(table) else np.zeros(0, dtype=np.int64)
    return {"first": first, "length": table[:, 0], "base": table[:, 1], "times": table[:, 2], "offset": table[:, 3]}, base


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A staged table of pieces with sequence_id and offset; its columns are kept."""
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    places, _ = plan(counts, capacity)
    # a length that many pieces have is ranked in as many buckets as it needs; one row for each length, so broadcast
    sizes = table.sparkSession.createDataFrame([(n, -(-k // ROWS_PER_BUCKET)) for n, k in counts.items()], "length long, _n int")
    mixed = table.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")).join(F.broadcast(sizes), "length")
    unit = (F.shiftright("_h", 12) + F.lit(1 << 51)) / F.lit(float(1 << 52))
    bucket = F.least(F.floor(unit * F.col("_n")), F.col("_n") - 1).cast("int")
    ranked = running_rank(mixed.withColumn("_b", bucket), ["length"], "_b", [F.col("_h"), F.col("piece")]).drop("_h", "_b", "_n", "whole")
    shared = table.sparkSession.sparkContext.broadcast(places)
    names = table.columns
    schema = T.StructType([table.schema[c] for c in names] + [T.StructField("sequence_id", LONG), T.StructField("offset", LONG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        starts = p["first"][np.searchsorted(p["length"], np.arange(capacity + 2), side="left").clip(0, max(0, len(p["first"]) - 1))] if len(p["first"]) else None
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "before"))
            if not len(length):
                continue
            place = starts[length] + rank
            row = np.searchsorted(p["first"], place, side="right") - 1
            t = place - p["first"][row]
            own = [pa.array(p["base"][row] + t // p["times"][row]), pa.array(p["offset"][row] + t % p["times"][row] * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *own], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence has at most `capacity` tokens."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    return pack(stage(pieces(docs, tokenizer, with_ids=with_ids), "packing-pieces"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
