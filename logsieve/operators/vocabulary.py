"""Document frequencies that grow by increments, and the text weights of any of their versions.

An increment of texts is one aggregation to `dim` numbers; the totals of a version are those of the version before plus
the increment. A version never changes, so vectors made with it can be made again. An increment that is added twice, as
by a job that runs again, counts once.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators.retrieval import TextVectoriser
from logsieve.sources.tables import read_or_empty

VERSIONS = "version bigint, increment string, n bigint, frequencies array<double>"


class Vocabulary:
    """Versions as a table with one row each, `dim` numbers wide. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, dim: int = 256, max_chars: int | None = None):
        self.spark, self.path, self.dim, self.max_chars = spark, f"{root.rstrip('/')}/versions", dim, max_chars

    def versions(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, VERSIONS)

    def latest(self) -> int:
        """The newest version; 0 is the empty vocabulary."""
        return self.versions().agg(F.max("version").alias("v")).first()["v"] or 0

    def _totals(self, version: int) -> tuple[int, list[float]]:
        row = self.versions().filter(F.col("version") == version).first()
        if row is None and version:
            raise ValueError(f"no version {version} of the vocabulary")
        return (row["n"], list(row["frequencies"])) if row else (0, [0.0] * self.dim)

    def add(self, corpus: DataFrame, column: str, increment: str) -> int:
        """The version that holds the texts of `corpus`; a known increment gives its old version and counts nothing."""
        known = self.versions().filter(F.col("increment") == increment).agg(F.min("version").alias("v")).first()["v"]
        if known is not None:
            return known
        words = TextVectoriser(self.dim, self.max_chars).words(corpus, column).select("_words")
        words = words.unionByName(self.spark.createDataFrame([([],)], "_words array<string>"))      # a sum needs a row
        present = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=self.dim, binary=True).transform(words)
        found = present.agg(F.count("*").alias("n"), Summarizer.sum(F.col("_tf")).alias("f")).select("n", vector_to_array("f").alias("f")).first()
        version = self.latest()
        n, totals = self._totals(version)
        totals = [a + b for a, b in zip(totals, found["f"])]
        row = self.spark.createDataFrame([(version + 1, increment, n + found["n"] - 1, totals)], VERSIONS)
        row.coalesce(1).write.mode("append").parquet(self.path)
        return version + 1

    def vectoriser(self, version: int | None = None) -> TextVectoriser:
        """The vectoriser with the weights of a version, by default the newest."""
        n, totals = self._totals(self.latest() if version is None else version)
        weights = np.log((n + 1.0) / (np.asarray(totals) + 1.0))
        return TextVectoriser(self.dim, self.max_chars).weighted(self.spark, weights.tolist())

