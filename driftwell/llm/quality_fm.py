"""Quality classifier: a factorisation machine.

Its inputs are hashed words (length-normalised counts), structure statistics of the text (lengths, shares of kinds of
characters, repetition) and metadata that the text itself carries. Pairwise interactions have low-rank weights, and a
text is scored in time linear in its inputs by the sum-of-squares identity. Spark's own FMClassifier fits and scores, so
features, training and scoring all are JVM operations.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0; of those, a sample by hash of at most
`most_rows` rows is fitted (a documented bound; everything else covers all rows). labels, lang, source and doc_id are
no inputs.

Defined results: null and empty texts get the score of a text without words; a label that is null is not learned, and
an id with several labels has the largest; without two different labels the score is the smoothed share of label 1 (0.5
without any); equal rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import crc_of_id, cut, empty_if_null, read

FOLDS = 5
THRESHOLD = 0.3
REG = 1e-3


def share_of(these: str, chars: Column, text: Column) -> Column:
    """Share of the text's characters that are among these."""
    return (chars - F.char_length(F.translate(text, these, ""))) / F.greatest(chars, F.lit(1))


def structure(text: Column, words: Column) -> list[Column]:
    """Statistics of a text, each between 0 and about 1."""
    chars = F.char_length(text)
    n = F.size(words)
    lines = F.split(text, "\n", -1)
    return [
        F.log1p(n) / 10,
        F.log1p(chars) / 12,
        F.least(chars / F.greatest(n, F.lit(1)) / 20, F.lit(1.0)),
        F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)),
        F.log1p(F.size(lines)) / 8,
        1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        share_of("#*$%&|<>", chars, text) * 4,
        share_of("!?", chars, text) * 4,
        share_of("0123456789", chars, text) * 4,
        share_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", chars, text),
        share_of(".,;:", chars, text) * 4,
        share_of("/@=_", chars, text) * 4,
        (n < 10).cast("double"),
    ]


def featured(docs: DataFrame, text: str, n_features: int) -> DataFrame:
    """docs with a vector column _features."""
    body = empty_if_null(text)
    words = F.filter(F.split(F.lower(body), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("_words", words)
    stats = [s.cast("double") for s in structure(body, F.col("_words"))]
    rows = rows.withColumn("_stats", F.array(*stats))
    hashed = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=n_features).transform(rows).drop("_words")
    scaled = Normalizer(inputCol="_counts", outputCol="_scaled").transform(hashed).drop("_counts")
    vectors = VectorSizeHint(inputCol="_stats", size=len(stats), handleInvalid="optimistic").transform(scaled.withColumn("_stats", array_to_vector("_stats")))
    return VectorAssembler(inputCols=["_stats", "_scaled"], outputCol="_features").transform(vectors).drop("_stats", "_scaled")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, n_features: int, most_rows: int, rank: int, rounds: int):
    """The fitted model, or the constant score that stands in for it."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("double").alias("label"))
    sample = cut(known.filter(crc_of_id("_id", FOLDS) != 0).orderBy(F.xxhash64("_id"), "_id").limit(most_rows))
    shares = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    rows = featured(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id").select("text", "label"), "text", n_features).select("label", "_features")
    rows = rows.persist()
    try:
        if shares["ones"] in (0.0, float(shares["n"])) or rows.select("label").distinct().count() < 2:
            return (shares["ones"] + 1) / (shares["n"] + 2)
        return FMClassifier(featuresCol="_features", labelCol="label", factorSize=rank, initStd=0.05, regParam=REG, maxIter=rounds, stepSize=0.05, tol=1e-6, seed=3).fit(rows)
    finally:
        rows.unpersist()


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", n_features: int = 1 << 13, most_rows: int = 20_000, rank: int = 4, rounds: int = 60) -> DataFrame:
    """docs with score: the chance that the label is 1."""
    model = fit(docs, labels, doc_id, text, label, n_features, most_rows, rank, rounds)
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    scored = model.setProbabilityCol("_probability").setPredictionCol("_prediction").setRawPredictionCol("_raw").transform(featured(docs, text, n_features))
    return scored.withColumn("score", vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_prediction")


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", (crc_of_id("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
