"""Byte-level BPE by recursive DuckDB queries in every partition: ids as the tiktoken library gives them, and back.

Encoding. A text is cut where white space follows something else, which the pattern never crosses, so a cut piece of text that was
seen before needs no pattern. New ones are split into words by the pattern. The words that are not tokens themselves become rows
(word, pos, token), one a byte, in a DuckDB table of the task; each step of a recursive query joins neighbouring rows with the merge
table and contracts, in every word, its leftmost pair of least rank, until none is left. Words that have nothing
left to contract leave the recursion. Texts of hundreds of kilobytes without white space are one word: words beyond LONG_WORD bytes
are first cut wherever no token of the vocabulary reaches across, which changes nothing. For what is still longer
a second query contracts all pairs of the least rank that do not overlap, from the left, in one step, where that must give the same:
when no token that such a pair makes can be part of a pair of lower rank. The vocabulary tells for which ranks this holds.

Decoding. Rows (text, pos, id) join the vocabulary, and an ordered aggregation joins the bytes of each text.

Memory is bounded by what is held at a time: texts of AT_ONCE bytes, or one text; words of WORD_BYTES bytes in a query; a cache of PIECES
pieces and WORDS words for each Python worker. No shuffle; nothing but the result leaves a task, so a lost executor costs its tasks only.

Defined cases: a null text is empty and has no tokens; repeated rows are encoded each for itself; an empty table gives an empty
result; extra columns, whatever their names, travel in a struct; letters and digits are those of the tiktoken library's own Unicode tables.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.shared import LONG, STRING, col, documents, packed

AT_ONCE, WORD_BYTES, LONG_WORD, PIECES, WORDS = 4 << 20, 1 << 19, 64, 200_000, 500_000
#: White space of the pattern, in the order of code points.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

#: A row is a token of a word; `after` is where the next one begins. One pair a word and step.
SHORT = """
WITH RECURSIVE state(word, pos, token, after, step) AS (
  SELECT word, pos, token, pos + 1, 0 FROM bytes_of_words
  UNION ALL
  (
  WITH best AS (
    SELECT x.word, min(rank * 4294967296 + x.pos) AS least, arg_min(y.pos, rank * 4294967296 + x.pos) AS gone, arg_min(y.after, rank * 4294967296 + x.pos) AS beyond
    FROM state x JOIN state y ON x.word = y.word AND x.after = y.pos JOIN merges ON x.token = merges.first AND y.token = merges.second GROUP BY x.word
  )
  SELECT word, pos, CASE WHEN pos = least & 4294967295 THEN (least >> 32)::INT ELSE token END, CASE WHEN pos = least & 4294967295 THEN beyond ELSE after END, step + 1
  FROM state JOIN best USING (word) WHERE pos <> gone
))
SELECT word, pos, token FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) ORDER BY word, pos
"""
#: All pairs of the least rank that do not overlap, if the rank is a safe one, else the leftmost. Of a run of overlapping pairs every
#: other one counts. The keyed state is overwritten from step to step; token -1 marks what was contracted away.
LONG_ONES = """
WITH RECURSIVE state(word, pos, token) USING KEY (word, pos) AS (
  SELECT word, pos, token FROM bytes_of_words
  UNION
  (
  WITH pairs AS (
    SELECT word, pos, token, lead(token) OVER line AS following, lead(pos) OVER line AS gone, row_number() OVER line AS place
    FROM (SELECT * FROM recurring.state WHERE token >= 0 AND word IN (SELECT word FROM state)) WINDOW line AS (PARTITION BY word ORDER BY pos)
  ), ranked AS (SELECT pairs.*, rank, safe, min(rank * 4294967296 + pos) OVER (PARTITION BY word) AS least FROM pairs JOIN merges ON token = merges.first AND following = merges.second),
  hits AS (SELECT *, place - row_number() OVER (PARTITION BY word ORDER BY place) AS run FROM ranked WHERE rank = least >> 32 AND (safe OR pos = least & 4294967295)),
  taken AS (SELECT word, pos, gone, rank FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY place) AS nth FROM hits) WHERE nth % 2 = 1)
  SELECT word, pos, rank::INT FROM taken UNION ALL SELECT word, gone, -1 FROM taken
  )
)
SELECT word, pos, token FROM state WHERE token >= 0 ORDER BY word, pos
"""
DECODE = "SELECT item, array_to_string(list(bytes ORDER BY pos), '') AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY item"


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of ranks: on each line a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def ranges(characters: set[str]) -> str:
    """The characters as ranges of a class."""
    points = np.array(sorted(map(ord, characters)), dtype=np.int64)
    return "".join(f"\\U{a[0]:08x}-\\U{a[-1]:08x}" for a in np.split(points, np.flatnonzero(np.diff(points) != 1) + 1) if len(a))


def split_pattern(pattern: str):
    """The pattern for the regex module, with the letters and digits that the tiktoken library's tables have."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    single = {bytes([b]): b for b in range(256)}
    for name in (r"\p{L}", r"\p{N}"):
        there = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(there.decode(there.encode_ordinary(every))), set(regex.findall(name, every))
        mended = f"[{name}--[{ranges(ours - theirs)}]]" if ours - theirs else name
        mended = f"[{mended}||[{ranges(theirs - ours)}]]" if theirs - ours else mended
        pattern = pattern.replace(name, mended)  # sets may be nested
    return regex.compile(pattern, regex.V1)


class Coder:
    """The vocabulary in a DuckDB of one Python worker, with what was encoded before."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks, self.split = read_ranks(path), split_pattern(pattern).findall
        self.longest = max(map(len, self.ranks))
        # ids as bytes; of pieces also in decimal, joined by commas
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.decimal: dict[str, str] = {}
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        unsafe = {part for *parts, rank in merges for part in parts if rank < part}
        first, second, rank = (pa.array(x, pa.int32()) for x in zip(*merges))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.table("merges", first=first, second=second, rank=rank.cast(pa.int64()), safe=pa.array([r not in unsafe for *_, r in merges]))
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # every byte as the letter of that number, so that bytes that are no UTF-8 by themselves can be strings
        self.table("vocabulary", id=pa.array(list(self.ranks.values()), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in self.ranks]))

    def table(self, name: str, **columns: pa.Array | np.ndarray) -> None:
        given = pa.table(columns)
        self.db.register("given", given)
        self.db.sql(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def result(self, query: str) -> pa.Table:
        return self.db.sql(query).to_arrow_table()

    def merged(self, words: list[bytes], query: str) -> list[bytes]:
        """The ids of each word, as bytes."""
        sizes = np.array(list(map(len, words)))
        first = np.cumsum(sizes) - sizes
        pos = np.arange(sizes.sum()) - np.repeat(first, sizes)
        self.table("bytes_of_words", word=np.repeat(np.arange(len(words), dtype=np.int32), sizes), pos=pos.astype(np.int32), token=self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)])
        out = self.result(query)
        data = np.asarray(out["token"]).astype("<i4").tobytes()
        cuts = 4 * np.searchsorted(np.asarray(out["word"]), np.arange(len(words) + 1))
        return [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def segments(self, word: bytes) -> list[bytes]:
        """The word, cut wherever no token of the vocabulary reaches across: no pair there is ever contracted."""
        out, start, reach = [], 0, 1
        for at in range(len(word)):
            if at >= reach:
                out.append(word[start:at])
                start = at
            for n in range(min(self.longest, len(word) - at), 0, -1):
                if at + n <= reach:
                    break
                if word[at : at + n] in self.ranks:
                    reach = at + n
                    break
        return [*out, word[start:]]

    def encode_words(self, words: list[str]) -> None:
        """Encode words that were not seen before."""
        parts: dict[str, list[bytes]] = {}
        for w in words:
            data = w.encode()
            if data in self.ranks:
                self.words[w] = self.ranks[data].to_bytes(4, "little")
            else:
                parts[w] = [data] if len(data) <= LONG_WORD else self.segments(data)
        done: dict[bytes, bytes] = {}
        held: dict[str, list[bytes]] = {SHORT: [], LONG_ONES: []}
        size = dict.fromkeys(held, 0)

        def run(query: str) -> None:
            if held[query]:
                done.update(zip(held[query], self.merged(held[query], query)))
                held[query].clear()
                size[query] = 0

        for part in set().union(*parts.values()):
            query = SHORT if len(part) <= LONG_WORD else LONG_ONES
            held[query].append(part)
            size[query] += len(part)
            if size[query] >= WORD_BYTES:
                run(query)
        for query in held:
            run(query)
        for w, cut in parts.items():
            self.words[w] = b"".join(map(done.__getitem__, cut))

    def split_piece(self, piece: str) -> list[str]:
        """The words of a piece by the pattern; a space, letters, then full stops and commas are what most pieces are."""
        stem = piece.rstrip(".,")
        if piece[0] == " " and stem[1:].isalpha():
            return [stem, piece[len(stem) :]] if len(stem) < len(piece) else [piece]
        return self.split(piece)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Of each text, its ids and the same in decimal, joined by commas."""
        cut = list(map(_chunks.findall, texts))
        new = list(set().union(*cut).difference(self.pieces))
        split = list(map(self.split_piece, new))
        unknown = list(set().union(*split).difference(self.words))
        self.encode_words(unknown)
        ids = [b"".join(map(self.words.__getitem__, words)) for words in split]
        every = list(map(str, np.frombuffer(b"".join(ids), dtype="<i4").tolist()))
        self.pieces.update(zip(new, ids))
        at = 0
        for piece, data in zip(new, ids):
            self.decimal[piece] = ",".join(every[at : (at := at + len(data) // 4)])
        out = [(np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), dtype="<i4"), ",".join(map(self.decimal.__getitem__, pieces))) for pieces in cut]
        for most, added, *known in ((PIECES, new, self.pieces, self.decimal), (WORDS, unknown, self.words)):
            if len(known[0]) > most:  # what was seen first is what is common
                for x in added:
                    for k in known:
                        del k[x]
        return out

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out = [b""] * len(lists)
        if any(map(len, lists)):
            sizes = [len(x) for x in lists]
            ids = np.concatenate(lists).astype(np.int32)
            tokens = pa.table({"item": np.repeat(np.arange(len(lists), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int64), "id": ids})
            self.db.register("tokens", tokens)
            found = self.result(DECODE)
            self.db.unregister("tokens")
            for item, text in zip(found["item"], found["bytes"]):
                out[item.as_py()] = text.as_py().encode("latin-1")
        return out


def coder(path: str, pattern: str) -> Coder:
    """The worker's coder; it stays with the worker process from task to task. What it holds has no cycles: the process need not look for any."""
    import duckdb

    kept = vars(duckdb).setdefault("_coders_by_file", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = Coder(path, pattern)
        gc.freeze()
        gc.set_threshold(1_000_000)
    return kept[path, pattern]


def batches_of(values: pa.Array, size) -> Iterator[list]:
    """The values in lists of AT_ONCE in size, or of one that is larger."""
    held, total = [], 0
    for value in values:
        x = value.as_py()
        held.append(x)
        total += size(x)
        if total >= AT_ONCE:
            yield held
            held, total = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) in a struct `row`, and `ids`."""
    given = docs.select(packed(docs.select(*[col(c) for c in carry]) if carry else docs), F.coalesce(col(text), F.lit("")).alias("_text"))
    schema = T.StructType([given.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in batches_of(batch.column("_text"), len):
                ids = [x[0] for x in coder(path, pattern).encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"])
                at += len(texts)

    return given.mapInArrow(run, schema)


def decoded(table: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns but the ids in a struct `row`, and `bytes`."""
    given = table.select(packed(table.drop(ids)), col(ids).cast("array<int>").alias("_ids"))
    schema = T.StructType([given.schema["row"], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lists in batches_of(batch.column("_ids"), lambda x: 4 * len(x or [])):
                found = coder(path, pattern).decode([np.array(x or [], dtype=np.int32) for x in lists])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(lists)), pa.array(found, pa.binary())], names=["row", "bytes"])
                at += len(lists)

    return given.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns in a struct `row`, n_tokens, and digests of the ids and of what they decode to: both ways in one task."""
    given = docs.select(packed(docs.select(*[col(c) for c in carry]) if carry else docs), F.coalesce(col(text), F.lit("")).alias("_text"))
    schema = T.StructType([given.schema["row"], T.StructField("n_tokens", LONG), T.StructField("ids_sha256", STRING), T.StructField("decoded_sha256", STRING)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in batches_of(batch.column("_text"), len):
                ids = coder(path, pattern).encode(texts)
                back = coder(path, pattern).decode([x for x, _ in ids])
                own = [pa.array([len(x) for x, _ in ids], pa.int64()), pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in ids]), pa.array([hashlib.sha256(b).hexdigest() for b in back])]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(texts)), *own], names=schema.fieldNames())
                at += len(texts)

    return given.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = digests(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.PATTERN, carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
