"""An arrival model: seconds to the next stop, learned from passages, stored, and scored as one transform.

Rows that a model may not score (``gps.eta_features``) keep a null estimate; a line that the model has not seen is scored
with the other features and told by ``known_line``.  Fitting is one distributed least-squares job; what reaches the
driver is its coefficients and the list of line codes.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators import gps

#: km/h that a standing vehicle counts as moving with, so that its way still counts.
CRAWL = 3.0
NUMBERS = ["next_m", "by_speed", "fraction", "hour_sin", "hour_cos", "weekend"]


def features(rows: DataFrame) -> DataFrame:
    """``rows`` (line_code, ts in UTC, next_m, mean_speed, fraction) with what the model reads; the clock is local."""
    out = gps.clock(rows)
    angle = F.col("hour") * (2 * 3.141592653589793 / 24)
    return out.withColumns({
        "line": F.upper(F.trim("line_code")), "by_speed": F.col("next_m") / (F.greatest(F.col("mean_speed"), F.lit(CRAWL)) / 3.6), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle),
        "weekend": F.col("weekday").isin(0, 6).cast("double"),
    })


def fit(passages: DataFrame, path: str, penalty: float = 0.01) -> None:
    """Fit on passages (as for ``features``, and secs, the seconds that the way took) that may be scored; store the model."""
    known = _inputs(features(gps.eta_features(passages)).filter("secs > 0"))
    stages = [
        StringIndexer(inputCol="line", outputCol="line_no", handleInvalid="keep"), OneHotEncoder(inputCol="line_no", outputCol="line_hot", handleInvalid="keep"),
        VectorAssembler(inputCols=[*(f"in_{c}" for c in NUMBERS), "line_hot"], outputCol="features"), LinearRegression(featuresCol="features", labelCol="secs", predictionCol="eta", regParam=penalty, elasticNetParam=0.0),
    ]
    Pipeline(stages=stages).fit(known).write().overwrite().save(path)


def _inputs(rows: DataFrame) -> DataFrame:
    """``features`` rows with may, whether they may be scored, and the model's inputs, which are zeros where not: a vector has no nulls."""
    named = rows.withColumn("may", gps.eligible(rows)).withColumn("line", F.coalesce("line", F.lit("")))
    return named.withColumns({f"in_{c}": F.when(F.col("may"), F.col(c)).otherwise(0.0) for c in NUMBERS})


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` with eta_s, not below zero, and known_line; both null where a row may not be scored."""
    lines = list(model.stages[0].labelsArray[0])
    done = model.transform(_inputs(features(rows)))
    return done.select(*rows.columns, F.when(F.col("may"), F.greatest(F.lit(0.0), F.col("eta"))).alias("eta_s"), F.when(F.col("may"), F.col("line").isin(lines)).alias("known_line"))
