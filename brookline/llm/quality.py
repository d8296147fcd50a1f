"""Quality rules under weak supervision: rules vote or abstain, EM estimates how far to trust each, the posterior decides.

One Arrow pass measures every text and lets the rules vote good (2), bad (0) or neither (1); the votes of a document
make one base-3 number. How often each of the at most 3**len(RULES) numbers occurs in the whole corpus is all that
expectation-maximisation needs, so that is all that is collected. For each class a rule has one accuracy, given that it
votes at all: the E step weighs every vote pattern with the current accuracies, the M step re-estimates them and the
class share. Accuracies are held within ACCURACY, which fixes what `good` means. A document is kept if its posterior
probability of being good reaches the threshold and the base rules do not reject it.

Measurements of a pass go to the shared folder, so texts are read once.

Defined cases: a null text has no words; a text without words gets no votes, and its base rules fail (fewer than 50
words); repeated rows are measured separately; an empty table gives an empty result and prior accuracies; carried
columns travel in a struct, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.shared import DOUBLE, LONG, WORD, col, documents, packed, stage, unpacked

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_exclaimed", "n_distinct", "n_function_words", "n_sentence_ends", "n_plain_words")
#: Common words of the languages that the corpus is expected in.
FUNCTION_WORDS = frozenset("the of and to in is that for it as was with be by on not this are or from der die das und von zu mit den ist nicht ein eine le la les de des et un une du que en el los las del y por con para se".split())
ACCURACY, ROUNDS, THRESHOLD, PRIOR = (0.6, 0.995), 200, 0.5, 0.85

#: name -> (share that is measured, the vote's sign, from where it is cast): most rules know one defect, or one virtue,
#: and abstain elsewhere, as the absence of one defect says little about the others; `plain words` votes either way.
RULES: dict[str, tuple[str, str, float | None, float | None]] = {
    "symbols": ("n_symbols/n_words", ">", 0.2, None),
    "capitals": ("n_upper_words/n_words", ">", 0.3, None),
    "exclamations": ("n_exclaimed/n_words", ">", 0.15, None),
    "copied lines": ("n_dup_lines/n_lines", ">", 0.3, None),
    "repeated words": ("n_repeat_words/n_words", ">", 0.3, None),
    "variety": ("n_distinct/n_words", "<", 0.15, None),
    "plain words": ("n_plain_words/n_words", "<", 0.8, 0.95),
    "function words": ("n_function_words/n_words", "<", None, 0.08),
    "sentences": ("n_sentence_ends/n_words", "<", None, 0.02),
}
_word = re.compile(WORD)
_plain = re.compile(r"(?<![^\x20\x09-\x0D])[^\W\d_]+[.,;:?]?(?![^\x20\x09-\x0D])")
_ends = re.compile(r"[.?](?=[\x20\x09-\x0D]|$)")


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one whole text."""
    text = text or ""
    words = _word.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if _word.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        last = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(last, i)
                last = i + 3
    return (
        n,
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(map(str.isupper, words)) - sum(1 for w in words if len(w) < 2 and w.isupper()),
        sum(w[-1] == "!" for w in words),
        len(set(words)),
        sum(map(FUNCTION_WORDS.__contains__, map(str.lower, words))),
        len(_ends.findall(text)),
        len(_plain.findall(text)),
    )


def ballot(measures: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of each document as one number in base 3, the first rule first."""
    out = np.zeros(len(measures["n_words"]), dtype=np.int64)
    some = measures["n_words"] > 0
    for share, side, bad, good in RULES.values():
        a, b = share.split("/")
        x = measures[a] / np.maximum(measures[b], 1)
        bad_here = (x > bad if side == ">" else x < bad) if bad is not None else np.zeros(len(x), dtype=bool)
        good_here = (x <= good if side == ">" else x >= good) if good is not None else np.zeros(len(x), dtype=bool)
        out = out * 3 + np.where(some & bad_here, 0, np.where(some & good_here, 2, 1))
    return out


def votes_of(pattern: int) -> list[int]:
    """Base-3 digits of a ballot: 0 bad, 1 abstains, 2 good."""
    return [pattern // 3 ** (len(RULES) - 1 - i) % 3 for i in range(len(RULES))]


def measured(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) in a struct `row`, then MEASURES and `ballot`."""
    kept = docs.select(*[col(c) for c in carry]) if carry else docs
    inside = text in kept.columns
    given = docs.select(packed(kept), *([] if inside else [col(text).alias("_text")]))
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), *[T.StructField(m, LONG) for m in MEASURES], T.StructField("ballot", LONG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = row.field(text) if inside else batch.column("_text")
            table = np.array([measure(x.as_py()) for x in texts], dtype=np.int64).reshape(-1, len(MEASURES))
            columns = dict(zip(MEASURES, table.T))
            yield pa.RecordBatch.from_arrays([row, *[pa.array(columns[m]) for m in MEASURES], pa.array(ballot(columns))], names=["row", *MEASURES, "ballot"])

    return given.mapInArrow(run, schema)


def posterior(votes: np.ndarray, share: float, right: np.ndarray) -> np.ndarray:
    """P(good | votes): votes is patterns x rules of 0, 1, 2; right[class, rule] the accuracy of a vote in that class (0 bad, 1 good)."""
    good, bad = votes == 2, votes == 0
    log_good = math.log(share) + good @ np.log(right[1]) + bad @ np.log(1 - right[1])
    log_bad = math.log(1 - share) + bad @ np.log(right[0]) + good @ np.log(1 - right[0])
    return 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))


def fit(counts: dict[int, int]) -> tuple[float, np.ndarray]:
    """EM over the counts of vote patterns: (share of good documents, accuracies by class and rule)."""
    share, right = 0.5, np.full((2, len(RULES)), PRIOR)
    if not counts:
        return share, right
    votes, n = np.array([votes_of(p) for p in counts]), np.array(list(counts.values()), dtype=float)
    for _ in range(ROUNDS):
        p = posterior(votes, share, right)
        share = float(np.clip((n * p).sum() / n.sum(), 0.01, 0.99))
        before = right.copy()
        for k, weight, hit in ((1, n * p, 2), (0, n * (1 - p), 0)):
            said = weight @ (votes != 1)
            # two pseudo-votes at the prior keep a rule that hardly ever votes where it was
            right[k] = np.clip((weight @ (votes == hit) + 2 * PRIOR) / (said + 2), *ACCURACY)
        if np.abs(right - before).max() < 1e-9:
            break
    return share, right


def judged(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """measured(), with probability (of being good), base_failed and kept. Fits on all of docs."""
    spark = docs.sparkSession
    table = stage(measured(docs, text, carry), "quality-measures")
    counts = {r["ballot"]: r["count"] for r in table.groupBy("ballot").count().collect()}  # at most 3 ** len(RULES) rows
    share, right = fit(counts)
    patterns = list(counts) or [0]
    p = posterior(np.array([votes_of(x) for x in patterns]), share, right)
    known = spark.createDataFrame([(x, float(y)) for x, y in zip(patterns, p)], T.StructType([T.StructField("ballot", LONG), T.StructField("probability", DOUBLE)]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return table.join(F.broadcast(known), "ballot").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= THRESHOLD))


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    return unpacked(judged(docs, text).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), *MEASURES[:5], "base_failed", "kept", "probability")
