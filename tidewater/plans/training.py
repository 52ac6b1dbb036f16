"""Remaining-travel-time model (M1-M6, S10, F16, F10) with MLlib.

The reference trains scikit-learn histogram boosting on a log1p target; here
the same settings drive MLlib's GBTRegressor (200 rounds, depth 5, step
0.05, seed 42). MLlib rejects missing feature values, so each numeric
feature with NULLs gets a sentinel plus a 0/1 indicator column; unseen ports
map to an extra index (``handleInvalid='keep'``). Results are not
numerically equal to the reference model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import clip_at_zero
from tidewater.operators import boosting
from tidewater.operators.features import CATEGORICAL_FEATURES, LABEL
from tidewater.operators.ordered import range_running_sum
from tidewater.session import write_stage

# Model inputs of the predictor, 7 numeric + 2 categorical.
MODEL_NUMERIC = ["sog", "sog_roll_6h", "sog_roll_24h", "sog_deviation", "remaining_dist_nm",
                 "total_dist_nm", "fraction_completed"]
GBT_PARAMS = dict(maxIter=200, maxDepth=5, stepSize=0.05, seed=42)
MIN_BINS = 32
SENTINEL = -1.0e9
IMPORTANCE_REPEATS = 10
CUT_ROWS = 100_000  # rows of one permutation that a window orders


def model_inputs(df: DataFrame) -> DataFrame:
    """Sentinel + null indicator for numeric features; F16 log1p target."""
    out = df
    for c in MODEL_NUMERIC:
        out = out.withColumn(f"{c}__isnull", F.col(c).isNull().cast("double")) \
            .withColumn(f"{c}__v", F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)))
    if LABEL in df.columns:
        out = out.withColumn("_y", F.log1p(F.col(LABEL)))
    return out


def build_pipeline(gbt_params: dict | None = None, n_categories: int = 0) -> Pipeline:
    """M1 + M2. Trees need at least as many bins as the larger categorical
    feature has values, one of them for unseen ones."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in CATEGORICAL_FEATURES]
    cols = [f"{c}__v" for c in MODEL_NUMERIC] + [f"{c}__isnull" for c in MODEL_NUMERIC] + \
        [f"{c}__idx" for c in CATEGORICAL_FEATURES]
    asm = VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="_features", labelCol="_y", predictionCol="_pred_log",
                       maxBins=max(MIN_BINS, n_categories + 1), **(gbt_params or GBT_PARAMS))
    return Pipeline(stages=idx + [asm, gbt])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M6 + F16 + F10: predicted_remaining_hours = max(expm1(prediction), 0)."""
    scored = model.transform(model_inputs(df))
    keep = [c for c in df.columns]
    return scored.select(*keep, clip_at_zero(F.expm1(F.col("_pred_log"))).alias("predicted_remaining_hours"))


def metrics(pred: DataFrame) -> dict:
    """M4: MAE, RMSE, R^2 in hours."""
    ev = RegressionEvaluator(labelCol=LABEL, predictionCol="predicted_remaining_hours")
    return {m: ev.setMetricName(m).evaluate(pred) for m in ("mae", "rmse", "r2")}


def model_scorer(model: PipelineModel):
    """The model as a function of a feature frame (what the stream predictor takes)."""
    return lambda df: predict(model, df)


def boosted_scorer(model: boosting.Model):
    """The histogram-boosted model of the log target as a function of a feature frame."""
    def score(df: DataFrame) -> DataFrame:
        out = boosting.predict(model, df, "_pred_log")
        return out.withColumn("predicted_remaining_hours", clip_at_zero(F.expm1("_pred_log"))).drop("_pred_log")
    return score


def speed_scorer(df: DataFrame) -> DataFrame:
    """A model-free estimate in the model's place: remaining distance over the
    6 h mean speed, 0 without one. Deterministic, so SQL can check what calls it."""
    hours = F.col("remaining_dist_nm") / F.col("sog_roll_6h")
    return df.withColumn("predicted_remaining_hours",
                         clip_at_zero(F.when(F.col("sog_roll_6h") > 0, hours).otherwise(F.lit(0.0))))


def metrics_table(pred: DataFrame) -> DataFrame:
    """M4 as one aggregation: mae, rmse, r2, n_test."""
    y = F.col(LABEL)
    err = F.col("predicted_remaining_hours") - y
    return pred.agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y))).alias("r2"),
        F.count(F.lit(1)).alias("n_test"))


def split_frames(features: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the voyage split (semi / anti join)."""
    labeled = features.where(F.col(LABEL).isNotNull())
    test_ids = split.where("is_test").select("voyage_id")
    return labeled.join(test_ids, "voyage_id", "left_anti"), labeled.join(test_ids, "voyage_id", "left_semi")


def fit(train_df: DataFrame, gbt_params: dict | None = None) -> PipelineModel:
    """M1 + M2 on a training frame, which is written once: 200 rounds read it."""
    cols = MODEL_NUMERIC + CATEGORICAL_FEATURES + [LABEL]
    frame = write_stage(train_df.select(*cols), "training")
    most = frame.agg(*[F.count_distinct(c).alias(c) for c in CATEGORICAL_FEATURES]).first()
    return build_pipeline(gbt_params, max(most)).fit(model_inputs(frame))


@dataclass
class TrainResult:
    model: PipelineModel
    metrics: dict


def train(features: DataFrame, split: DataFrame, gbt_params: dict | None = None) -> TrainResult:
    """Split (M3), fit, evaluate (M4)."""
    train_df, test_df = split_frames(features, split)
    model = fit(train_df, gbt_params)
    return TrainResult(model, metrics(predict(model, test_df)))


def category_index(features: DataFrame) -> DataFrame:
    """M1: column_name, category, idx: by descending frequency, then name."""
    found = StringIndexer(inputCols=CATEGORICAL_FEATURES, outputCols=[f"{c}__idx" for c in CATEGORICAL_FEATURES],
                          handleInvalid="keep").fit(features)
    rows = [(c, name, i) for c, names in zip(CATEGORICAL_FEATURES, found.labelsArray) for i, name in enumerate(names)]
    return features.sparkSession.createDataFrame(rows, "column_name string, category string, idx int")


def save(model: PipelineModel, path: str) -> None:
    """S10."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def permutation_importance(score, rows: DataFrame, feats: list[str] | None = None,
                           repeats: int = IMPORTANCE_REPEATS) -> DataFrame:
    """M5: mean drop of R^2 when one feature column is shuffled.

    A row's donor is the row whose place by ping_id equals the row's place in the order of
    a hash of (ping_id, feature, repeat). That order is cut by the hash's first digits, so places
    are row numbers within a cut plus the sizes of the cuts before, and no task holds a whole
    permutation. Only places and the one donor value go through the shuffles of the (feature,
    repeat) copies; a row's own columns meet them in the last join. The joins are merge joins by
    hint: Spark takes the copies for as small as the rows they come from, and would broadcast
    them through the driver. ``score`` runs once
    over all of them, grouped by (feature, repeat). Callers that want less work
    pass a sample."""
    feats = feats or MODEL_NUMERIC + CATEGORICAL_FEATURES
    placed = write_stage(range_running_sum(rows.where(F.col(LABEL).isNotNull()), [], ["ping_id"], F.lit(1), "_place"), "importance")
    base = placed.drop("_place")
    digits, rest = 0, placed.count()
    while rest > CUT_ROWS:
        digits, rest = digits + 1, rest / 16
    variants = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.lit(f).alias("name"), F.lit(r).alias("r"))
                                   for i, f in enumerate(feats) for r in range(repeats)]))
    rep = placed.select("_place", "ping_id", variants.alias("_v")).select("_place", "ping_id", "_v.*")
    md5 = F.md5(F.concat_ws(":", F.col("ping_id").cast("string"), "name", F.col("r").cast("string")))
    rep = rep.withColumn("_h", md5).select("_place", "ping_id", "f", "r", F.substring("_h", 1, digits).alias("_cut"), F.unhex("_h").alias("_h"))
    cut = ["f", "r", "_cut"]
    sizes = rep.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("f", "r").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    moved = rep.withColumn("_rn", F.row_number().over(Window.partitionBy(*cut).orderBy("_h", "ping_id"))).join(offsets.hint("merge"), cut) \
        .select("f", "r", F.col("_place").alias("_to"), (F.col("_off") + F.col("_rn")).alias("_from"))
    kinds = sorted({t for c, t in placed.dtypes if c in feats})
    kind = {c: f"_value{kinds.index(t)}" for c, t in placed.dtypes if c in feats}
    donors = placed.select(F.col("_place").alias("_from"), *[F.col(c).alias(f"_d_{c}") for c in feats])
    values = moved.join(donors.hint("merge"), "_from").select("f", "r", F.col("_to").alias("_place"), *[
        F.coalesce(*[F.when(F.col("f") == i, F.col(f"_d_{c}")) for i, c in enumerate(feats) if kind[c] == k]).alias(k)
        for k in sorted(set(kind.values()))])
    j = values.join(placed.hint("merge"), "_place").drop("_place")
    j = j.select(*[F.when(F.col("f") == feats.index(c), F.col(kind[c])).otherwise(F.col(c)).alias(c) if c in feats else F.col(c)
                   for c in base.columns], F.element_at(F.array(*map(F.lit, feats)), F.col("f") + 1).alias("f"), "r")
    scored = score(j)

    def r2(df, *keys):
        y = F.col(LABEL)
        err = F.col("predicted_remaining_hours") - y
        return df.groupBy(*keys).agg((1 - F.sum(err * err) / (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y))).alias("r2"))
    ref = r2(score(base)).first()["r2"]
    drop = F.lit(ref) - F.col("r2")
    return r2(scored, "f", "r").groupBy(F.col("f").alias("feature")).agg(
        F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
