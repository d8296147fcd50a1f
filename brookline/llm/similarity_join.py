"""Join of documents with similar word shingles (Jaccard) by chosen paths, and the groups that its links make.

Texts become sets of hashed runs of SHINGLE words; documents with equal sets form a class, and the join is one of classes.

Chosen paths (Christiani and Pagh): in a run, a set x enters the buckets of those of its tokens whose hash is below
1 / (threshold * |x|), about 1.25 of them, so that two sets above the threshold share one with a probability of at
least 1 - 1/e. A bucket with more than SMALL sets splits again by tokens chosen anew, DEPTH levels deep. A pair still
shares a bucket of the last level of one run with a probability of at least survival(DEPTH), so runs(target) runs reach
the target recall. The choices depend on the set and the seeds alone: one pass makes them for all runs, and buckets
come about by counting, with no set moved until it is known to share one.

Buckets are compared by brute force on the list of first choices of each set, a sketch in which a pair above the
threshold has `runs` choices in common on average: a set is tested against the pivots of its bucket and linked to those
with which it has enough in common. A bucket beyond BLOCK sets is dealt over tasks, whose pivots meet in a second step.
These loose links, at most a few for each set, give candidate groups, so that a set's text moves to one place instead of
to each of its buckets. The sets of a group meet there once, and exactly those are compared that share a bucket, directly or
through sets that are there, too; a group beyond BLOCK sets is dealt into blocks of sets that follow each other by their
least bucket, and only pairs of blocks that have a bucket in common are checked. Pairs are counted where they are found:
every class keeps its number of links and one link into its verified group.

Defined cases: a null text and one without words have no shingles, no links, and a group of their own; a text with
fewer than SHINGLE words is one shingle; texts with equal shingles link with similarity 1; repeated rows are separate
documents; a null doc_id is as good as any; an empty table gives an empty result; carried columns travel in a struct.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.components import components
from brookline.llm.hashing import mixed, run_hashes, word_hashes
from brookline.llm.shared import LONG, col, documents, ordered_rank, packed, stage, unpacked, without

SHINGLE, THRESHOLD, TARGET, DEPTH, SEED = 5, (4, 5), 0.9999, 3, 7
SMALL, BLOCK = 64, 1000
ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Bytes of keys up to which the classes with a partner are broadcast to fetch their texts.
BROADCAST_BYTES = 32 << 20


def survival(depth: int) -> float:
    """Least probability that a pair at the threshold shares a bucket of this level in one run: it shares one choice of each bucket on average."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs(target: float = TARGET, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - survival(depth)))


def common_at_least(n_runs: int, risk: float) -> int:
    """The most first choices in common that a pair at the threshold, with n_runs on average, misses with a probability below risk."""
    term, total, k = math.exp(-n_runs), 0.0, 0
    while total + term < risk:
        total += term
        k += 1
        term *= n_runs / k
    return max(1, k)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    return np.unique(run_hashes(word_hashes((text or "").encode()), n))


def choices(tokens: np.ndarray, n_runs: int, threshold: float, depth: int = DEPTH) -> np.ndarray:
    """The buckets a set is in: rows of `depth` numbers, the path down to a bucket of the last level; 0 where it ends early."""
    bound = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))

    def step(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the node, child) for each token that a node chooses."""
        at, child = [], []
        for first in range(0, len(nodes), max(1, 2_000_000 // len(tokens))):  # so that long texts need no more memory
            some = nodes[first : first + max(1, 2_000_000 // len(tokens))]
            h = tokens[None, :] ^ some[:, None]
            h *= ODD[0]  # tokens and nodes are well mixed already: this is enough to choose by
            h ^= h >> np.uint64(32)
            h *= ODD[1]
            i, j = np.nonzero(h <= bound)
            at.append(i + first)
            child.append(mixed(h[i, j] + some[i]) | np.uint64(1))
        return np.concatenate(at), np.concatenate(child)

    _, first = step(mixed(np.arange(1, n_runs + 1, dtype=np.uint64) + np.uint64(SEED << 32)))
    paths = first[:, None]
    for _ in range(depth - 1):
        live = np.flatnonzero(paths[:, -1])
        at, child = step(paths[live, -1]) if len(live) else (live, first[:0])
        at = live[at] if len(live) else at
        ended = np.setdiff1d(np.arange(len(paths)), at)
        paths = np.vstack([np.column_stack([paths[at], child]), np.column_stack([paths[ended], np.zeros(len(ended), dtype=np.uint64)])])
    return paths


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def hashed(docs: DataFrame, text: str, carry: list[str] | None, n_runs: int, threshold: float) -> DataFrame:
    """uid, row, text (if row does not have it), set_key (null without shingles) and the paths of every document, staged."""
    kept = docs.select(*[col(c) for c in carry]) if carry else docs
    inside = text in kept.columns
    given = docs.select(F.monotonically_increasing_id().alias("uid"), packed(kept), *([] if inside else [col(text).alias("text")]))
    levels = [f"n{i + 1}" for i in range(DEPTH)]
    schema = T.StructType([*given.schema.fields, T.StructField("set_key", T.BinaryType()), *[T.StructField(c, T.ArrayType(LONG)) for c in levels]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                keys, paths = [], [[] for _ in levels]
                for words in batch.column("row").field(text) if inside else batch.column("text"):
                    tokens = shingles(words.as_py())
                    keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                    chosen = signed(choices(tokens, n_runs, threshold)) if len(tokens) else np.zeros((0, DEPTH), dtype=np.int64)
                    for k in range(DEPTH):
                        paths[k].append(chosen[:, k])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), *[pa.array(p, pa.list_(pa.int64())) for p in paths]], names=schema.fieldNames())

    return stage(given.mapInArrow(run, schema), "join-documents")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a stream that is sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(starts, starts[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def leaves(paths: DataFrame) -> DataFrame:
    """(leaf, cls) for all buckets that two sets or more share, each the least deep one that is small, or one of the last level."""
    rows = paths
    done = []
    for k in range(1, DEPTH + 1):
        node = f"n{k}"
        sizes = rows.where(F.col(node) != 0).select("cls", node).distinct().groupBy(node).agg(F.count("*").alias("size")).where("size > 1")
        here = stage(rows.join(sizes, node), f"join-level-{k}")
        last = F.lit(k == DEPTH)
        done.append(here.where((F.col("size") <= SMALL) | last).select(F.col(node).alias("leaf"), "cls"))
        rows = here.where("size > %d" % SMALL).drop("size")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.distinct()


def linked(batches: Iterator[pa.RecordBatch], enough: int, plenty: int) -> Iterator[pa.RecordBatch]:
    """Within each bucket: links of every set to the pivots with which it shares enough choices, and the pivots."""
    for group in grouped(batches, ["leaf", "part"]):
        where: dict[int, list[int]] = defaultdict(list)
        pivots: list[int] = []
        tree: list[int] = []  # of pivots that are linked already
        a, b, kept = [], [], []

        def top(p: int) -> int:
            while tree[p] != p:
                tree[p] = tree[tree[p]]
                p = tree[p]
            return p

        for i, (cls, first) in enumerate(zip(group.column("cls").to_pylist(), group.column("first").to_pylist())):
            common = Counter(p for node in first for p in where.get(node, ()))
            near = {top(p) for p, n in common.items() if n >= enough}
            # links to one pivot of each linked lot, so there are fewer links than sets in a bucket
            a += [cls] * len(near)
            b += [pivots[p] for p in near]
            least = min(near, default=-1)
            for p in near:
                tree[p] = least
            # a set much like a pivot adds nothing as a pivot itself: what is like it is linked to that one
            if not common or max(common.values()) < plenty:
                for node in first:
                    where[node].append(len(pivots))
                tree.append(len(pivots) if least < 0 else least)
                pivots.append(cls)
                kept.append(i)
        n = len(a)
        pivot = group.take(pa.array(kept, pa.int64())).combine_chunks()
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=["leaf", "cls", "other", "first"])
        if len(group) and group.column("parts")[0].as_py() > 1:
            for x in pivot.select(["leaf", "cls", "first"]).to_batches():
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.nulls(x.num_rows, pa.int64()), x.column(2).cast(pa.list_(pa.int64()))], names=["leaf", "cls", "other", "first"])


def candidate_links(classes: DataFrame, n_runs: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Loose links (a, b) between classes that share buckets, and the buckets of each class (cls, leaves)."""
    zipped = F.explode(F.arrays_zip(*[f"n{k + 1}" for k in range(DEPTH)]))
    paths = classes.select("cls", zipped.alias("p")).select("cls", "p.*")
    shared = stage(leaves(paths), "join-leaves")
    # buckets with the same members say the same: one of them is enough
    members = shared.groupBy("leaf").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.min("cls").alias("least"), F.max("cls").alias("most")).where("size > 1")
    kept = members.groupBy("size", "x", "least", "most").agg(F.min("leaf").alias("leaf")).select("leaf", "size")
    firsts = classes.select("cls", F.array_distinct("n1").alias("first"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    met = shared.join(kept, "leaf")
    places = stage(met.groupBy("cls").agg(F.collect_list("leaf").alias("leaves")), "join-places")  # a set is in some 40 buckets, whatever the input
    dealt = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = dealt.join(firsts, "cls").select("leaf", "part", "parts", "cls", "first")
    enough = common_at_least(n_runs, 1e-5)
    plenty = round(0.7 * n_runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return linked(batches, enough, plenty)

    schema = "leaf long, cls long, other long, first array<long>"
    found = stage(dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "cls").mapInArrow(run, schema), "join-links")
    # pivots of buckets that were dealt over several tasks
    again = found.where("leaf IS NOT NULL").select("leaf", F.lit(0).alias("part"), F.lit(1).alias("parts"), "cls", "first")
    more = again.repartition("leaf").sortWithinPartitions("leaf", "part", "cls").mapInArrow(run, schema)
    links = found.where("leaf IS NULL").union(more.where("leaf IS NULL")).select(F.col("cls").alias("a"), F.col("other").alias("b")).where("a <> b").distinct()
    return links, places


def overlaps(left: list[np.ndarray], right: list[np.ndarray], inside: bool = False) -> np.ndarray:
    """Tokens in common, for each of left with each of right; only tokens of both sides are multiplied. inside: left is part of right, and what a set has in common with itself does not matter."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    every = np.concatenate([*left, *right])
    _, place = np.unique(every, return_inverse=True)
    bounds = np.cumsum([0, *map(len, left), *map(len, right)])
    owner = np.repeat(np.arange(len(left) + len(right)), np.diff(bounds))
    on_left = np.bincount(place[: bounds[len(left)]], minlength=place.max(initial=0) + 1)
    on_right = np.bincount(place[bounds[len(left)] :], minlength=len(on_left))
    met = (on_left > 0) & (on_right > (1 if inside else 0))
    keep = met[place]
    number = np.cumsum(met) - 1
    place, owner = number[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    width = max(64, min(4096, 16_000_000 // (len(left) + len(right))))
    for first in range(0, int(met.sum()), width):
        a, b = np.searchsorted(place, [first, first + width])
        dense = np.zeros((len(left) + len(right), width), dtype=np.float32)
        dense[owner[a:b], place[a:b] - first] = 1
        out += np.rint(dense[: len(left)] @ dense[len(left) :].T).astype(np.int64)
    return out


def meeting(sets: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """A number for each set: sets that share a bucket, or are led to each other by such sets, have the same."""
    owner = np.repeat(np.arange(len(sets)), [len(places[k]) for k in sets])
    bucket = np.unique(np.concatenate([places[k] for k in sets]), return_inverse=True)[1]
    label = np.arange(len(sets))
    while True:  # the least label of each bucket, then of each set, until nothing changes
        least = np.full(bucket.max(initial=0) + 1, len(sets))
        np.minimum.at(least, bucket, label[owner])
        now = label.copy()
        np.minimum.at(now, owner, least[bucket])
        now = now[now]
        if (now == label).all():
            return label
        label = now


def verified(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(cls, big, links, root) of the classes in each block pair: links to other documents, least class of the local verified group."""
    for group in grouped(batches, ["comp", "i", "j"]):
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block = group.column("block").to_numpy()
        cls, copies = group.column("cls").to_numpy(), group.column("copies").to_numpy()
        texts = group.column("text")
        rows = np.flatnonzero((block == i) | (block == j))
        sets = {int(k): shingles(texts[int(k)].as_py()) for k in rows}
        sizes = np.array([len(sets[k]) if k in sets else 0 for k in range(len(cls))])
        root = {k: k for k in sets}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = np.zeros(len(cls), dtype=np.int64)
        together = np.zeros(len(rows), dtype=np.int64)
        if len(rows) > SMALL:
            together = meeting(rows, [x.values.to_numpy() for x in group.column("leaves")])
        by_lot = np.argsort(together, kind="stable")
        for lot in np.split(rows[by_lot], np.flatnonzero(np.diff(together[by_lot])) + 1):
            left = lot[block[lot] == i]
            right = lot[block[lot] == j] if j != i else left
            if not len(right):
                continue
            for at in range(0, len(left), 200):
                some = left[at : at + 200]
                common = overlaps([sets[k] for k in some], [sets[k] for k in right], i == j)
                near = common * den >= num * (sizes[some][:, None] + sizes[right][None, :] - common)
                near &= some[:, None] != right[None, :]
                links[some] += near @ copies[right]
                if i != j:
                    links[right] += near.T @ copies[some]
                for x, y in zip(*np.nonzero(near)):
                    p, q = find(int(some[x])), find(int(right[y]))
                    if p != q:
                        p, q = (p, q) if cls[p] < cls[q] else (q, p)
                        root[q] = p
        yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), group.column("big").combine_chunks().take(pa.array(rows)), pa.array(links[rows]), pa.array(np.array([cls[find(int(k))] for k in rows], dtype=np.int64))], names=["cls", "big", "links", "root"])


def block_pairs(big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the members of groups beyond BLOCK sets: (cls, block), and the pairs of blocks to check (comp, i, j, block: either of the two)."""
    ranked = ordered_rank(big.select("comp", "cls", F.array_min("leaves").alias("least")), [F.col("comp"), F.col("least"), F.col("cls")])
    start = ranked.groupBy("comp").agg(F.min("before").alias("start"))
    blocks = stage(ranked.join(start, "comp").select("cls", F.expr(f"int((before - start) div {BLOCK})").alias("block")), "join-blocks")
    spread = big.join(blocks, "cls").select("comp", "block", F.explode("leaves").alias("leaf")).distinct()
    pairs = spread.withColumnRenamed("block", "i").join(spread.withColumnRenamed("block", "j"), ["comp", "leaf"]).where("i <= j").select("comp", "i", "j").distinct()
    return blocks, pairs.select("comp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))


def groups_of(table: DataFrame, doc_id: str, text: str, n_runs: int) -> DataFrame:
    """(uid, doc_id, class_id, n_links, group_size, kept) of every document of a hashed() table."""
    num, den = THRESHOLD
    levels = [f"n{k + 1}" for k in range(DEPTH)]
    shaped = table.where("set_key IS NOT NULL").select("set_key", "uid", F.struct(*levels).alias("paths"))
    classes = stage(shaped.groupBy("set_key").agg(F.min("uid").alias("cls"), F.count("*").alias("copies"), F.first("paths").alias("paths")).select("set_key", "cls", "copies", "paths.*"), "join-classes")
    loose, places = candidate_links(classes, n_runs, num / den)
    groups = components(loose).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    joined = groups.join(classes.select("cls", "copies"), "cls").join(places, "cls").join(sizes, "comp")
    members = stage(joined.select("cls", "comp", "copies", (F.col("size") > BLOCK).alias("big"), "leaves"), "join-members")
    n_members, n_big = members.agg(F.count("*"), F.count_if("big")).first()
    texts = table.select(F.col("uid").alias("cls"), (F.col("text") if "text" in table.columns else F.col("row").getField(text)).alias("text"))
    fetched = texts.join(F.broadcast(members) if n_members * 400 <= BROADCAST_BYTES else members, "cls")
    columns = ["comp", "i", "j", "block", "cls", "copies", "big", "leaves", "text"]
    pairs = fetched.where("NOT big").withColumns({c: F.lit(0) for c in ("i", "j", "block")}).select(*columns)
    if n_big:
        blocks, sides = block_pairs(members.where("big"))
        pairs = pairs.union(fetched.where("big").join(blocks, "cls").join(sides, ["comp", "block"]).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return verified(batches, num, den)

    checked = stage(pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cls").mapInArrow(run, "cls long, big boolean, links long, root long"), "join-verified")
    root = checked.where("NOT big").select("cls", "root")
    if n_big:  # what was found block against block is put together
        root = root.union(components(checked.where("big").select(F.col("cls").alias("a"), F.col("root").alias("b"))))
    links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("set_key", "cls", "copies").join(links, "cls", "left").join(root, "cls", "left")
    known = stage(known.select("set_key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")).where("copies > 1 OR links > 0"), "join-known")
    found = table.select("uid", F.col("row").getField(doc_id).alias("doc_id"), "set_key").join(known, "set_key", "left").withColumn("root", F.coalesce("root", "uid"))
    several = found.groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.min("doc_id").alias("class_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = found.join(several, "root", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "uid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("first.uid"))).alias("kept"),
    )


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, target: float = TARGET) -> DataFrame:
    """The carried columns (default: all; doc_id must be among them) in a struct `row`, with class_id (the least doc_id of the group), n_links (other
    documents with a similarity of THRESHOLD or more), group_size and kept (true for one document of each group)."""
    n_runs = runs(target)
    table = hashed(docs, text, carry, n_runs, THRESHOLD[0] / THRESHOLD[1])
    return table.select("uid", "row").join(groups_of(table, doc_id, text, n_runs).drop("doc_id"), "uid").drop("uid")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns of docs."""
    n_runs = runs()
    table = hashed(docs, text, None, n_runs, THRESHOLD[0] / THRESHOLD[1])
    gone = stage(groups_of(table, doc_id, text, n_runs).where(~F.col("kept")).select("uid"), "join-gone")
    return unpacked(without(table.select("uid", "row"), gone))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_runs = runs()
    table = hashed(documents(spark, sf_dir, "doc_id", "text"), "text", ["doc_id"], n_runs, THRESHOLD[0] / THRESHOLD[1])
    return groups_of(table, "doc_id", "text", n_runs).select("doc_id", "class_id", "n_links", "group_size")
