"""Removal of long repeated passages by merging shard Burrows-Wheeler transforms.

A window is any string of WINDOW bytes; a window repeats if an equal one starts anywhere else. Windows that are equal
have the same smallest gram (of GRAM bytes, by hash) at the same place, so a text is cut into stretches of neighbouring
windows with one smallest gram, about one for 185 bytes, and only stretches with the same gram can hold equal windows.

1. One pass names the stretches of every text by a digest. A gram that only one stretch has, once, is done with; equal stretches are
   combined, with their number, before anything moves.
2. Of the other grams, each different stretch is fetched once. A task takes a range of grams. The stretches of each input
   shard become a Burrows-Wheeler transform over symbols of STEP bytes (a stretch is STEP strings, one for each offset), and
   the transforms of the shards are merged by refining their interleave: in round h, every suffix goes, in the order of round
   h - 1, to the place of the symbol before it, which sorts the interleave by h symbols. Where a boundary between neighbours
   first appears tells their common prefix; symbols are numbered by hash, and their bytes compared; after WINDOW / STEP rounds, intervals without a boundary are the equal windows,
   and those of two suffixes or more, or of a stretch with copies, repeat. Suffixes are sorted within shards only.
3. A gram with more than HOT different stretches is not put into one task: digests of its windows are counted one by
   one, combined on the map side. That way is exact, too, and only for those.
4. Repeated windows are gathered per document and their bytes cut out.

What is cut follows windows of WINDOW bytes. Beside that, and without any effect on it, `n_shared_words` tells how many words of
a text are in passages that another document has, too, down to PASSAGE words, which may be less than a window: runs of RUN
words are sampled by the least hash of neighbouring ones, so that every PASSAGE words hold a sampled run, wherever they are,
and runs of two documents or more are counted. No passage of PASSAGE words that two documents have is missed.

Defined cases: a null text is empty; a text shorter than WINDOW keeps all its bytes; overlapping windows of one text
count as starting elsewhere; repeated rows repeat each other; an empty table gives an empty result; a removed run may
end within a character, so what is kept is bytes; carried columns travel in a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.hashing import mixed, powers, prefix_sums, range_digests, word_spans
from brookline.llm.shared import LONG, col, documents, packed, stage, unstage
from brookline.llm.similarity_join import grouped

WINDOW, STEP, GRAM, HOT, CHUNK = 400, 100, 32, 2_000, 1 << 20
PASSAGE, RUN = 50, 30
#: Bytes of neighbouring texts that are handled at a time: their arrays stay in a core's cache.
LOT = 1 << 16
#: Suffixes that are merged at a time; more grams than that go one after the other.
SUFFIXES_PER_MERGE = 300_000


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, from prefix_sums()."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by block-wise running minima from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


Stretches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def lots(texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts with LOT bytes together at most, or of a single longer one: many short texts cost what a long one does."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > LOT:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, a line feed after each, and where each starts."""
    start = np.cumsum([0, *[len(t) + 1 for t in texts]])
    out = np.full(start[-1], 10, dtype=np.uint8)
    for t, a in zip(texts, start):
        out[a : a + len(t)] = t
    return out, start


def windows_of(data: np.ndarray, valid: np.ndarray) -> Stretches:
    """(first window, last window, gram, stretch hash) of the stretches of valid windows."""
    sums = prefix_sums(data)
    place = np.arange(len(data) - GRAM + 1)
    gram = span_hashes(sums, place, place + GRAM)
    # the place in the low bits makes the leftmost of equal grams the smallest
    low = np.uint64((CHUNK << 2) - 1)
    least = sliding_min((gram & ~low) | place.astype(np.uint64), WINDOW - GRAM + 1)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    last = first + np.bincount(np.cumsum(new)[valid] - 1, minlength=len(first)) - 1 if len(first) else first
    anchor = (least[first] & low).astype(np.int64)
    return first, last, gram[anchor], mixed(range_digests(data, first, last + WINDOW) + (anchor - first).astype(np.uint64))


def stretches_of(texts: list[np.ndarray]) -> list[Stretches]:
    """The stretches of each text. Texts beyond CHUNK are cut into chunks, the same everywhere in effect: a stretch may only be split in two."""
    out: list[Stretches] = []
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    for a, b in lots(texts):
        if b == a + 1:
            out.append(stretches(texts[a]))
            continue
        data, start = joined(texts[a:b])
        if len(data) < WINDOW:
            out += [none] * (b - a)
            continue
        valid = np.ones(len(data) - WINDOW + 1, dtype=bool)
        for end in start[1:]:  # windows over the end of a text
            valid[max(0, end - WINDOW) : end] = False
        found = windows_of(data, valid)
        cuts = np.searchsorted(found[0], start)
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            out.append((found[0][x:y] - start[k], found[1][x:y] - start[k], found[2][x:y], found[3][x:y]))
    return out


def stretches(data: np.ndarray) -> Stretches:
    """The stretches of one text, chunk by chunk."""
    parts = []
    for at in range(0, max(1, len(data) - WINDOW + 1), CHUNK):
        chunk = data[at : at + CHUNK + WINDOW - 1]
        if len(chunk) < WINDOW:
            continue
        first, last, gram, kind = windows_of(chunk, np.ones(len(chunk) - WINDOW + 1, dtype=bool))
        parts.append((first + at, last + at, gram, kind))
    if not parts:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts))


def picked(data: np.ndarray, start: np.ndarray, end: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of runs with the least hash of a group of PASSAGE - RUN + 1 neighbours; valid: groups, by their first word."""
    width = PASSAGE - RUN + 1
    sums = prefix_sums(data[start[0] : end[-1]])
    run = span_hashes(sums, start[: len(start) - RUN + 1] - start[0], end[RUN - 1 :] - start[0])
    least = np.where(valid, sliding_min(run, width), np.uint64(0))
    # a run is the least of a group that it is in if the greatest of these groups' minima is its own hash
    padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)])
    at = np.flatnonzero(run == ~sliding_min(~padded, width))
    return at, run[at]


def sampled_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the sampled runs of a text."""
    start, end = word_spans(data)
    parts = []
    for at in range(0, len(start) - PASSAGE + 1, CHUNK):
        s, e = start[at : at + CHUNK + PASSAGE - 1], end[at : at + CHUNK + PASSAGE - 1]
        first, run = picked(data, s, e, np.ones(len(s) - PASSAGE + 1, dtype=bool))
        parts.append((first + at, run))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def sampled_runs_of(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sampled runs of each text, many short texts at a time."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in lots(texts):
        data, begin = joined(texts[a:b])
        start, end = word_spans(data)
        if b == a + 1 or len(start) < PASSAGE:
            out += [sampled_runs(t) for t in texts[a:b]]
            continue
        owner = np.searchsorted(begin, start, side="right") - 1
        at, run = picked(data, start, end, owner[PASSAGE - 1 :] == owner[: len(owner) - PASSAGE + 1])
        words = np.searchsorted(start, begin)  # the first word of each text
        cuts = np.searchsorted(at, words)
        out += [(at[x:y] - words[k], run[x:y]) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
    return out


def shared_words(runs: tuple[np.ndarray, np.ndarray], shared: list[int] | None) -> int:
    """Words of a text in those of its sampled runs that another document has."""
    if not shared:
        return 0
    at, run = runs
    at = np.unique(at[np.isin(run.view(np.int64), np.array(shared, dtype=np.int64))])
    return int(np.minimum(np.diff(at, append=at[-1:] + RUN), RUN).sum())


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


def scanned(docs: DataFrame, text: str, carry: list[str] | None) -> DataFrame:
    """uid, row, text and, in order, the grams and hashes of the text's stretches, and the different sampled runs; staged."""
    kept = docs.select(*[col(c) for c in carry]) if carry else docs
    given = docs.select(F.monotonically_increasing_id().alias("uid"), packed(kept), col(text).alias("text"))
    schema = T.StructType([*given.schema.fields, T.StructField("grams", T.ArrayType(LONG)), T.StructField("kinds", T.ArrayType(LONG)), T.StructField("runs", T.ArrayType(LONG))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [bytes_of(t.as_py()) for t in batch.column("text")]
                found = [(*x[2:], np.unique(runs)) for x, (_, runs) in zip(stretches_of(texts), sampled_runs_of(texts))]
                own = [pa.array([f[k].view(np.int64) for f in found], pa.list_(pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=schema.fieldNames())

    return stage(given.mapInArrow(run, schema), "repeats-documents")


class Shard:
    """Suffix order and Burrows-Wheeler transform of some stretches, STEP bytes a symbol."""

    def __init__(self, symbol: np.ndarray, follower: np.ndarray, before: np.ndarray, nodes: np.ndarray):
        """nodes: the shard's suffixes; symbol, follower (its next suffix) and before (the symbol before it) by suffix."""
        rank, ahead, width = symbol.astype(np.int64), follower, 1  # symbols are in order already
        while True:  # prefix doubling: ranks by 1, 2, 4, ... symbols
            key = rank[nodes] * (int(rank.max(initial=0)) + 2) + np.where(ahead[nodes] >= 0, rank[ahead[nodes]] + 1, 0)
            width *= 2
            if width >= WINDOW // STEP:
                break
            rank = np.zeros(len(symbol), dtype=np.int64)
            rank[nodes] = np.unique(key, return_inverse=True)[1]
            ahead = np.where(ahead >= 0, ahead[ahead], -1)
        self.order = nodes[np.argsort(key, kind="stable")]
        self.transform = before[self.order]


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers under 2 ** 32, by two counting passes."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) == 0 or x.max() <= 0xFFFF:
        return low
    return low[np.argsort((x[low] >> 16).astype(np.uint16), kind="stable")]


def interleave(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the transforms: (suffixes in merged order, number of their interval of equal prefixes of `rounds` symbols, common
    prefix with the suffix before, in symbols, `rounds` at most)."""
    sizes = [len(s.order) for s in shards]
    z = np.repeat(np.arange(len(shards)), sizes).astype(np.uint16)  # from which shard each place takes its next suffix
    transform = np.concatenate([s.transform for s in shards])
    block, common = np.zeros(len(z), dtype=np.int64), np.full(len(z), rounds)
    for h in range(rounds):
        place = np.argsort(z, kind="stable")  # places of the first shard's suffixes, in their order, then the second's ...
        symbol = np.empty_like(transform)
        symbol[place] = transform
        move = stable_order(symbol)
        z, moved, ahead = z[move], block[move], symbol[move]
        fresh = np.ones(len(z), dtype=bool)
        fresh[1:] = (ahead[1:] != ahead[:-1]) | (moved[1:] != moved[:-1])
        common[fresh & (common == rounds)] = h
        block = np.cumsum(fresh) - 1
    suffix = np.empty(len(z), dtype=np.int64)
    suffix[np.argsort(z, kind="stable")] = np.concatenate([s.order for s in shards])
    return suffix, block, common


def symbols(data: np.ndarray, at: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Numbers of the STEP bytes at each place, equal for equal bytes and for no others. Hashes propose them and bytes decide."""
    rows = np.lib.stride_tricks.sliding_window_view(data, STEP)
    _, one, out = np.unique(code, return_index=True, return_inverse=True)
    for a in range(0, len(at), 50_000):
        if (rows[at[a : a + 50_000]] != rows[at[one[out[a : a + 50_000]]]]).any():  # a built collision: number the bytes themselves
            return np.unique(np.ascontiguousarray(rows[at]).view(f"V{STEP}").ravel(), return_inverse=True)[1]
    return out


def repeated_windows(texts: list[bytes], weight: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
    """For every stretch, which of its windows repeat among all of them; a stretch counts `weight` times.

    A symbol that occurs once ends a string: no window over it repeats. What is left of a string between such symbols
    is left out if it is shorter than a window.
    """
    rounds = WINDOW // STEP
    length = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    places = length - STEP + 1  # of symbols
    first = np.cumsum(places) - places
    owner = np.repeat(np.arange(len(texts)), places)
    at = np.arange(len(owner)) + (owner * (STEP - 1))  # their bytes
    code = span_hashes(prefix_sums(data), at, at + STEP)
    slot = (code >> np.uint64(61 - len(code).bit_length())).astype(np.int64)
    often = np.bincount(slot, weights=weight[owner])[slot] > 1  # all symbols that occur twice, and a few more
    ahead = (first + places)[owner] - np.arange(len(owner)) > (rounds - 1) * STEP
    begins = often & ahead  # windows over such symbols only
    for i in range(1, rounds):
        begins[: len(often) - i * STEP] &= often[i * STEP :]
    keep = np.zeros(len(owner), dtype=bool)
    for i in range(rounds):
        keep[i * STEP :] |= begins[: len(begins) - i * STEP]
    flag = np.zeros(len(owner), dtype=bool)
    nodes = np.flatnonzero(keep)
    if len(nodes):
        number = np.full(len(owner) + STEP, -1, dtype=np.int64)
        number[nodes] = np.arange(len(nodes))
        own = owner[nodes]
        follower = np.where((first + places)[own] - nodes > STEP, number[nodes + STEP], -1)
        previous = np.where(nodes - first[own] >= STEP, number[np.maximum(nodes - STEP, 0)], -1)
        symbol = symbols(data, at[nodes], code[nodes]) + 1  # 0 is the end of a string
        last = np.flatnonzero(follower < 0)
        ends = len(nodes) + np.arange(len(last))
        follower[last] = ends
        before = np.where(previous >= 0, symbol[previous], 0)
        symbol, before = np.append(symbol, np.zeros(len(last), dtype=symbol.dtype)), np.append(before, symbol[last])
        follower, own = np.append(follower, np.full(len(last), -1)), np.append(own, own[last])
        ranks = np.unique(shard, return_inverse=True)[1][own]
        by_shard = np.argsort(ranks, kind="stable")
        cuts = np.searchsorted(ranks[by_shard], np.arange(ranks.max() + 2))
        suffix, block, _ = interleave([Shard(symbol, follower, before, by_shard[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a], rounds)
        whole = np.append(begins[nodes], np.zeros(len(last), dtype=bool))[suffix]
        times = np.bincount(block[whole], weights=weight[own[suffix[whole]]], minlength=block[-1] + 1)
        flag[nodes[suffix[whole]]] |= times[block[whole]] > 1
    return [flag[f : f + n - WINDOW + 1] for f, n in zip(first, length)]


def intervals(flag: np.ndarray) -> np.ndarray:
    """Pairs (first, last) of the runs of True."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1]).ravel()


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, kind, spans) of the stretches that have repeated windows."""

    def flush(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        flags = repeated_windows(t.column("bytes").to_pylist(), t.column("n").to_numpy(), t.column("shard").to_numpy())
        hit = [i for i, f in enumerate(flags) if f.any()]
        return pa.RecordBatch.from_arrays([t.column("gram").take(pa.array(hit, pa.int64())).combine_chunks(), t.column("kind").take(pa.array(hit, pa.int64())).combine_chunks(), pa.array([intervals(flags[i]) for i in hit], pa.list_(pa.int64()))], names=["gram", "kind", "spans"])

    held, size = [], 0
    for group in grouped(batches, ["gram"]):
        n = int(group.column("size").to_numpy().sum())
        if held and size + n > SUFFIXES_PER_MERGE:
            yield flush(held)
            held, size = [], 0
        held.append(group)
        size += n
    if held:
        yield flush(held)


def places(gram: np.ndarray, kind: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """Where the stretches of each gram and kind are in a text."""
    out: dict[tuple[int, int], list[int]] = {}
    for at, key in enumerate(zip(gram.view(np.int64).tolist(), kind.view(np.int64).tolist())):
        out.setdefault(key, []).append(at)
    return out


def fetched(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """The bytes of chosen stretches (uid, gram, kind, n, kinds), and whether their gram has too many for one task."""
    lists = chosen.groupBy("uid").agg(F.collect_list(F.struct("gram", "kind", "n", (F.col("kinds") > HOT).alias("hot"))).alias("chosen"))  # of one text each
    texts = table.select("uid", "text").join(lists, "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            out: list[tuple] = []
            texts = [bytes_of(t.as_py()) for t in batch.column("text")]
            for uid, data, some, (first, last, gram, kind) in zip(batch.column("uid").to_pylist(), texts, batch.column("chosen").to_pylist(), stretches_of(texts)):
                place = places(gram, kind)
                for c in some:
                    at = place[c["gram"], c["kind"]][0]
                    part = data[first[at] : last[at] + WINDOW].tobytes()
                    out.append((c["gram"], c["kind"], c["n"], uid >> 33, len(part), part, c["hot"]))
                if len(out) > 20_000:
                    yield strings(out)
                    out = []
            if out:
                yield strings(out)

    def strings(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.bool_())], names=["gram", "kind", "n", "shard", "size", "bytes", "hot"])

    return texts.mapInArrow(run, "gram long, kind long, n long, shard long, size long, bytes binary, hot boolean")


def counted_windows(strings: DataFrame) -> DataFrame:
    """(gram, kind, spans) as merged() has them (null: all windows, for a stretch with copies), window by window: for grams with
    too many different stretches for a task."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                out = []
                for part in some.column("bytes"):
                    data = np.frombuffer(part.as_py(), dtype=np.uint8)
                    at = np.arange(len(data) - WINDOW + 1)
                    out.append(range_digests(data, at, at + WINDOW).view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column("gram"), some.column("kind"), some.column("n"), pa.array(out, pa.list_(pa.int64()))], names=["gram", "kind", "n", "windows"])

    whole = strings.where("n > 1").select("gram", "kind", F.lit(None).cast("array<long>").alias("spans"))
    rows = strings.mapInArrow(hashes, "gram long, kind long, n long, windows array<long>").select("gram", "kind", "n", F.posexplode("windows").alias("at", "window"))
    often = rows.groupBy("gram", "window").agg(F.sum("n").alias("n")).where("n > 1").select("gram", "window")
    # the windows of one stretch: each span is a single window
    hit = rows.where("n = 1").join(often, ["gram", "window"]).groupBy("gram", "kind").agg(F.sort_array(F.collect_list(F.col("at").cast("long"))).alias("ats"))
    return hit.select("gram", "kind", F.flatten(F.transform("ats", lambda x: F.array(x, x))).alias("spans")).union(whole)


def repeated_spans(table: DataFrame) -> DataFrame:
    """(uid, spans) of the texts with repeated windows; spans: structs of a stretch's gram and kind and its windows (null: all)."""
    every = table.select("uid", F.explode(F.arrays_zip("grams", "kinds")).alias("s")).select("uid", F.col("s.grams").alias("gram"), F.col("s.kinds").alias("kind"))
    kinds = every.groupBy("gram", "kind").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    several = every.groupBy("gram").agg(F.count("*").alias("total")).where("total > 1").select("gram")
    met = kinds.join(several, "gram")
    chosen = stage(met.join(met.groupBy("gram").agg(F.count("*").alias("kinds")), "gram").select("gram", "kind", "n", "kinds", "uid"), "repeats-kinds")
    n_chosen, n_hot = chosen.agg(F.count("*"), F.count_if(F.col("kinds") > HOT)).first()
    spark = table.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_chosen // 5_000))
    strings = stage(fetched(table, chosen), "repeats-strings")
    found = strings.where(~F.col("hot")).repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(merged, "gram long, kind long, spans array<long>")
    if n_hot:
        found = found.union(counted_windows(strings.where("hot")))
    found = stage(found, "repeats-windows")
    unstage(strings)
    hits = every.join(found, ["gram", "kind"])
    return hits.groupBy("uid").agg(F.collect_set(F.struct("gram", "kind", "spans")).alias("spans"))


def shared_runs(table: DataFrame) -> DataFrame:
    """(uid, shared) of the texts with sampled runs that another document has."""
    every = table.select("uid", F.explode("runs").alias("run"))
    several = every.groupBy("run").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where("a <> b").select("run")
    return every.join(several, "run").groupBy("uid").agg(F.collect_list("run").alias("shared"))  # of one text each


def covered(data: np.ndarray, spans: list[dict] | None, own: Stretches | None) -> np.ndarray:
    """Which bytes repeated windows cover; own: the text's stretches, if it has spans."""
    change = np.zeros(len(data) + 1, dtype=np.int64)
    if spans:
        first, last, gram, kind = own
        place = places(gram, kind)
        for s in spans:
            for at in place[s["gram"], s["kind"]]:
                a, b = int(first[at]), int(last[at])
                pairs = [(0, b - a)] if s["spans"] is None else zip(s["spans"][::2], s["spans"][1::2])
                for x, y in pairs:
                    change[a + x] += 1
                    change[a + y + WINDOW] -= 1
    return np.cumsum(change[:-1]) > 0


def without_repeats(docs: DataFrame, text: str = "text", carry: list[str] | None = None, with_kept: bool = True) -> DataFrame:
    """The carried columns (default: all) in a struct `row`, with n_bytes, n_removed, n_spans, kept_sha256, n_shared_words and, if asked for, the kept bytes."""
    table = scanned(docs, text, carry)
    spans = stage(repeated_spans(table), "repeats-spans")
    runs = stage(shared_runs(table), "repeats-runs")
    given = table.select("uid", "row", "text").join(spans, "uid", "left").join(runs, "uid", "left").select("row", "text", "spans", "shared")
    fields = [T.StructField("row", given.schema["row"].dataType), *[T.StructField(c, LONG) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("n_shared_words", LONG)]
    schema = T.StructType(fields + ([T.StructField("kept", T.BinaryType())] if with_kept else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            rows = []
            texts, spans_of, shared_of = [bytes_of(t.as_py()) for t in batch.column("text")], batch.column("spans").to_pylist(), batch.column("shared").to_pylist()
            some, others = [i for i, x in enumerate(spans_of) if x], [i for i, x in enumerate(shared_of) if x]
            own = dict(zip(some, stretches_of([texts[i] for i in some])))
            runs_of = dict(zip(others, sampled_runs_of([texts[i] for i in others])))
            for i, (data, spans, shared) in enumerate(zip(texts, spans_of, shared_of)):
                gone = covered(data, spans, own.get(i))
                kept = data[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), len(intervals(gone)) // 2, hashlib.sha256(kept).hexdigest(), shared_words(runs_of.get(i), shared), kept))
            columns = list(zip(*rows)) if rows else [()] * 6
            arrays = [batch.column("row"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(columns[5], pa.binary())] if with_kept else []), names=schema.fieldNames())

    return given.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"], with_kept=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")
