"""Text models: held-out figures, and what they do without words or labels."""

from pyspark.sql import functions as F

from brookline.functions import scorers
from brookline.plans.operations import folded
from brookline.sources.views import Tables

FOLDER = "/root/testdata/sf0.01"


def test_languages_of_held_out_texts(spark):
    docs = Tables(spark, FOLDER).spread("documents").select("doc_id", "text", "lang")
    model = scorers.fit(docs.where(~folded()), "lang")
    held = model.scores(docs.where(folded())).select("lang", model.best().alias("best"), F.size(F.split("text", r"\s+")).alias("n"))
    right, n = held.where("n >= 20").agg(F.count_if(F.col("lang") == F.col("best")), F.count("*")).first()
    assert n > 200 and right >= 0.95 * n


def test_texts_without_words_and_rows_without_labels(spark):
    rows = spark.createDataFrame([(1, "good day", "a"), (2, "bad night", "b"), (3, None, None), (4, "", "a"), (5, "good", None), (6, "?!", "b")] * 5, "doc_id long, text string, label string")
    model = scorers.fit(rows, "label", classes=["a", "b", "never"])
    got = model.scores(rows.distinct()).withColumn("best", model.best())
    assert got.count() == 6 and {"text", "label", "logits", "probabilities"} <= set(got.columns)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].best == by[5].best == "a" and by[2].best == "b" and all(abs(sum(r.probabilities) - 1) < 1e-9 for r in by.values())
    assert model.scores(rows.limit(0)).count() == 0
