"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become class symbols (insult, threat, target, negation, reported speech, other), clause ends are symbols too.
Four deterministic transducers read the symbols one after the other: negation marks insults and threats in its scope,
reported speech marks all that follows it in the clause, a target nearby marks what is aimed at somebody, and the last
one turns a marked insult, or a threat that has a target, into a match. They are composed into one machine before use,
so a text is read once; what it counts are matched clauses by kind, never isolated words.

Learned from labels: which words are insults (their log-odds between toxic and other documents, where that is more
than chance allows among all words tested, over documents with different word sets), which words are threats (words that
tell toxic documents apart in the clauses that have a target, and are no insults by themselves; they join the few fixed
ones), and how much each kind of match weighs (ridge logistic regression around PRIOR). Targets, negations and reporting
verbs are closed classes of the languages expected and stay fixed lists. Texts without words teach no words. Fitting reads at
most MAX_LABELLED labelled documents of each class, the ones with the lowest hash; scoring reads all documents, whole. A
learned word occurs in so many toxic texts (more than the logarithm of the words tested, see learned_words) that the words of
the sample bound the lexicon; there is no other limit to it. A fit is the same in whatever order the rows come.

Defined cases: a null or empty text has no match and gets the score of the bias alone; a null doc_id is held out by
the checksum of the empty text and is never learned from; null labels are no labels; a document with both labels is toxic;
without usable labels the prior weights and the fixed word lists remain; repeated rows get equal scores; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.shared import LONG, col, documents, packed, stage

MAX_LABELLED, FOLDS, HELD_OUT, LIMIT = 10_000, 3, 1, 0.7
#: A word is an insult if chance explains its split with a probability under exp(-MARGIN) over all words tested.
MARGIN, SCOPE = 2.0, 3

THREATS = frozenset("kill hurt destroy beat shoot stab murder töten verletzen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours he she they them him her these those du dich ihr sie dein tu toi vous votre il elle ils tú usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not never no nobody isn aren wasn don doesn nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = frozenset("said says say wrote writes claimed called quoted sagte schrieb dit écrit dijo escribió".split())
KINDS = ("insult", "aimed", "threat", "negated", "reported")
PRIOR_BIAS, PRIOR = -3.5, np.array([5.0, 6.0, 5.0, 3.0, 3.0])

_token = re.compile(r"[^\W\d_]+|[.!?;\n]")
# Symbols: Insult, Threat, Pointing at somebody, Negation, Reporting, Other, End of a clause.
SYMBOLS = "ITPNROE"


class Transducer:
    """A deterministic transducer: step(state, symbol) -> (state, output); outputs are symbols for the next one."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: other reads what self writes."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            its, out = other.step(state[1], out)
            return (mine, its), out

        return Transducer((self.start, other.start), step)

    def tabled(self, alphabet: str) -> list[dict]:
        """All reachable states as numbers, with the arcs of each."""
        number, arcs, todo = {self.start: 0}, [], [self.start]
        for state in todo:
            arcs.append({})
            for symbol in alphabet:
                nxt, out = self.step(state, symbol)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                arcs[-1][symbol] = (number[nxt], out)
        return arcs


def _negation(left, symbol):
    if symbol == "E":
        return 0, symbol
    if symbol == "N":
        return SCOPE, symbol
    return max(0, left - 1), symbol + "n" if left and symbol in ("I", "T") else symbol


def _report(inside, symbol):
    if symbol == "E":
        return 0, symbol
    return (1 if symbol == "R" else inside), symbol + "r" if inside and symbol[0] in "IT" else symbol


def _target(left, symbol):
    if symbol == "E":
        return 0, symbol
    if symbol == "P":
        return SCOPE, symbol
    return max(0, left - 1), symbol + "p" if left and symbol[0] in "IT" else symbol


def _match(state, symbol):
    """Outputs the kind of match; a threat waits for its target until the clause ends."""
    if symbol == "E":
        return 0, None
    if symbol[0] not in "IT":
        return (0, "threat") if symbol == "P" and state else (state, None)
    if "r" in symbol:
        return state, "reported"
    if "n" in symbol:
        return state, "negated"
    if symbol[0] == "I":
        return state, "aimed" if "p" in symbol else "insult"
    return (state, "threat") if "p" in symbol else (1, None)


GRAMMAR = Transducer(0, _negation).then(Transducer(0, _report)).then(Transducer(0, _target)).then(Transducer(0, _match))
ARCS = GRAMMAR.tabled(SYMBOLS)


def words_of(text: str | None) -> list[str]:
    return _token.findall((text or "").lower())


def matches(tokens: list[str], insults: frozenset[str] | dict[str, float], threats: frozenset[str] = THREATS) -> list[int]:
    """Number of clauses with a match of each kind of KINDS; a clause counts for its strongest kind."""
    counts = [0] * len(KINDS)
    if threats.isdisjoint(tokens) and not any(map(insults.__contains__, tokens)):
        return counts
    order = ("aimed", "insult", "threat", "reported", "negated")
    state, best = 0, None
    for t in [*tokens, "\n"]:
        if t in insults:
            symbol = "I"
        elif t in TARGETS:
            symbol = "P"
        elif t in NEGATIONS:
            symbol = "N"
        elif t in REPORTS:
            symbol = "R"
        elif t in threats:
            symbol = "T"
        else:
            symbol = "E" if t in ".!?;\n" else "O"
        state, out = ARCS[state][symbol]
        if out and (best is None or order.index(out) < order.index(best)):
            best = out
        if symbol == "E" and best:
            counts[KINDS.index(best)] += 1
            best = None
    return counts


def features(counts: np.ndarray) -> np.ndarray:
    """Any clause of a kind says most; further ones add less and less."""
    return np.minimum(1.0, counts) + 0.2 * np.log1p(np.maximum(counts - 1, 0))


def matched(docs: DataFrame, words: tuple[dict[str, float], frozenset[str]], text: str, carry: DataFrame) -> DataFrame:
    """carry's columns in a struct `row`, with the counts of KINDS. carry and docs are the same rows."""
    given = docs.select(packed(carry), col(text).alias("_text"))
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), *[T.StructField(k, LONG) for k in KINDS]])
    shared = docs.sparkSession.sparkContext.broadcast(words)  # learned words, bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([matches(words_of(t.as_py()), *shared.value) for t in batch.column("_text")], dtype=np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(x) for x in table.T]], names=["row", *KINDS])

    return given.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def training_set(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of at most MAX_LABELLED labelled documents of each class outside the held-out fold."""
    usable = labels.select(col(doc_id).alias("_id"), col(label).cast("int").alias("toxic")).where(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("_id")) != HELD_OUT)).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    low = F.xxhash64("_id")
    chosen = usable.where("toxic = 1").orderBy(low, "_id").limit(MAX_LABELLED).unionByName(usable.where("toxic = 0").orderBy(low, "_id").limit(MAX_LABELLED))
    # 2 * MAX_LABELLED rows of two numbers: bounded, so broadcast
    return stage(docs.select(col(doc_id).alias("_id"), col(text).alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic"), "toxicity-training")


def clauses_with_target(tokens: list[str]) -> set[str]:
    """Words of the clauses that name somebody."""
    out: set[str] = set()
    clause: list[str] = []
    for t in [*tokens, "\n"]:
        if t not in ".!?;\n":
            clause.append(t)
            continue
        if not TARGETS.isdisjoint(clause):
            out.update(clause)
        clause = []
    return out


def learned_words(train: DataFrame) -> tuple[dict[str, float], frozenset[str]]:
    """Words that tell toxic documents apart by more than chance: (insults with their log-odds, threats with the fixed ones).

    A word in `a` toxic texts and few others passes if a * ln(1 / share of toxic texts) exceeds ln(words tested) + MARGIN.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                tokens = words_of(text)
                words = [w for w in tokens if w not in ".!?;\n"]
                # near copies mostly share their lowest three-word checksum, and count once; a text of one or two words has their checksum
                short = zlib.crc32(" ".join(words).encode()) if words else None
                mark = min((zlib.crc32(" ".join(g).encode()) for g in zip(words, words[1:], words[2:])), default=short)
                rows.append((toxic, mark, sorted(set(words)), sorted(clauses_with_target(tokens))))
            toxic, mark, words, aimed = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(mark, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(aimed, pa.list_(pa.string()))], names=["toxic", "mark", "words", "aimed"])

    seen = train.select("toxic", "text").mapInArrow(marked, "toxic int, mark long, words array<string>, aimed array<string>").where("mark IS NOT NULL")
    # of near copies the one with the least words, so that the order of rows does not matter
    single = stage(seen.groupBy("toxic", "mark").agg(F.min(F.struct("words", "aimed")).alias("least")).select("toxic", "least.*"), "toxicity-single")
    sizes = {r["toxic"]: r["n"] for r in single.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}, THREATS
    kinds = [F.transform("words", lambda w: F.struct(F.lit(False).alias("aimed"), w.alias("word"))), F.transform("aimed", lambda w: F.struct(F.lit(True).alias("aimed"), w.alias("word")))]
    each = F.explode(F.concat(*kinds))
    tally = stage(single.select("toxic", each.alias("x")).groupBy("x.aimed", "x.word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "toxicity-words")
    tested = {r["aimed"]: r["count"] for r in tally.groupBy("aimed").count().collect()}
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    rate = toxic / (toxic + clean)
    # log-likelihood ratio of the word's own share of toxic documents against the share of all
    share = a / n
    gain = a * F.ln(share / rate) + F.when(b > 0, b * F.ln((1 - share) / (1 - rate))).otherwise(0.0)
    odds = F.ln((a + 0.5) / (toxic + 1.0)) - F.ln((b + 0.5) / (clean + 1.0))
    found = tally.where((a > 0) & (share > 0.8)).where(gain > F.when(F.col("aimed"), math.log(tested.get(True, 1))).otherwise(math.log(tested.get(False, 1))) + MARGIN).select("aimed", "word", odds.alias("weight")).orderBy("word").collect()
    insults = {r["word"]: r["weight"] for r in found if not r["aimed"]}
    closed = TARGETS | NEGATIONS | REPORTS
    return insults, THREATS | {r["word"] for r in found if r["aimed"] and r["word"] not in insults and r["word"] not in closed}


def regress(x: np.ndarray, y: np.ndarray, times: np.ndarray, strength: float = 1.0) -> tuple[float, np.ndarray]:
    """Ridge logistic regression around the prior, by Newton's method; a row counts `times` times."""
    w, centre = np.concatenate([[PRIOR_BIAS], PRIOR]), np.concatenate([[PRIOR_BIAS], PRIOR])
    if len(y):
        x = np.hstack([np.ones((len(x), 1)), x])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (times * (p - y)) + strength * (w - centre))
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
    return float(w[0]), w[1:]


Model = tuple[tuple[dict[str, float], frozenset[str]], float, np.ndarray]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """((insults, threats), bias, weights of KINDS)."""
    train = training_set(docs, labels, doc_id, text, label)
    words = learned_words(train)
    # at most as many rows as the sample has; sorted, so that sums do not depend on their order
    rows = matched(train, words, "text", train.select("toxic")).groupBy("row.toxic", *KINDS).count().collect()
    table = np.array(sorted(map(tuple, rows)), dtype=float).reshape(-1, 2 + len(KINDS))
    bias, weights = regress(features(table[:, 1:-1]), table[:, 0], table[:, -1])
    return words, bias, weights


def scored(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) in a struct `row`, with the counts of KINDS and a score from 0 to 1."""
    words, bias, weights = model
    out = matched(docs, words, text, docs.select(*[col(c) for c in carry]) if carry else docs)
    total = F.lit(bias)
    for k, w in zip(KINDS, weights):
        count = F.col(k).cast("double")
        total = total + float(w) * (F.least(F.lit(1.0), count) + 0.2 * F.log1p(F.greatest(count - 1, F.lit(0.0))))
    return out.withColumn("score", 1 / (1 + F.exp(-total)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model, carry=["doc_id"])
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), (fold(doc_id) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted"), *[F.col(k).alias(f"n_{k}") for k in KINDS])
