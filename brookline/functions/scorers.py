"""Text models that are fitted in the cluster: hashed words, a multinomial linear model, probabilities by class.

They take the place of the trained models of the scoring stages: what a stage needs is an array of logits or probabilities for each
text, and these come from the text alone. Fitting adds up gradients over all labelled rows; scoring is one pass in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, PENALTY, ROUNDS = 1 << 14, 1e-4, 60


def hashed(df: DataFrame, text: str, features: int = FEATURES) -> DataFrame:
    """df with `_x`: the words of the text, hashed, as a vector of length one; a null or empty text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = HashingTF(numFeatures=features, inputCol="_w", outputCol="_c").transform(df.withColumn("_w", words))
    return Normalizer(inputCol="_c", outputCol="_x").transform(counts).drop("_w", "_c")


@dataclass
class TextModel:
    """A fitted model and the names of its classes, in order."""

    model: LogisticRegressionModel
    classes: list[str]
    features: int

    def scores(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with `logits` and `probabilities`, arrays in the order of the classes."""
        out = self.model.transform(hashed(df, text, self.features))
        return out.withColumns({"logits": vector_to_array("_raw"), "probabilities": vector_to_array("_p")}).drop("_x", "_raw", "_p", "_label")

    def best(self) -> Column:
        """The class of the highest probability."""
        return F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("probabilities", F.array_max("probabilities")).cast("int"))


def fit(rows: DataFrame, label: str, text: str = "text", classes: list[str] | None = None, features: int = FEATURES) -> TextModel:
    """A model of the labelled rows; rows without a label are not used."""
    known = rows.where(F.col(label).isNotNull())
    names = classes or sorted(r[0] for r in known.select(label).distinct().collect())  # one row a class
    at = (F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1).cast("double")
    linear = LogisticRegression(featuresCol="_x", labelCol="_y", rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_label", family="multinomial", regParam=PENALTY, maxIter=ROUNDS)
    return TextModel(linear.fit(hashed(known.withColumn("_y", at), text, features).where("_y >= 0")), names, features)
