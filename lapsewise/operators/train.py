"""Training, tuning and applying churn models with ``pyspark.ml``."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS, KEY, LABEL, SCORE, Settings
from lapsewise.functions.scoring import add_predictions
from lapsewise.operators.evaluate import all_metrics, joint_objective
from lapsewise.operators.logistic import Logistic, fit_logistic
from lapsewise.operators.preprocess import build_preprocessor, feature_names
from lapsewise.operators.search import Trial, search
from lapsewise.operators.split import class_weights
from lapsewise.sources.scratch import checkpointed

# Default parameters of the boosted trees.
DEFAULT_PARAMS = {
    "max_depth": 6,
    "learning_rate": 0.1,
    "n_estimators": 300,
    "subsample": 0.8,
    "colsample": 0.8,
    "min_child_weight": 1,
    "gamma": 0.0,
}
# Search space, as (low, high) per parameter.
SEARCH_SPACE = {
    "max_depth": (3, 8),
    "learning_rate": (0.01, 0.1),
    "n_estimators": (200, 400),
    "subsample": (0.6, 1.0),
    "colsample": (0.6, 1.0),
    "min_child_weight": (1, 10),
    "gamma": (0.0, 5.0),
}
_LOG_SCALE = ("learning_rate",)
_VALIDATION = "is_validation"
OUTPUTS = (SCORE, "prediction", "risk_level", "rawPrediction")
# Fewer rows are not worth a task of their own; more are too many for one task's memory.
LEAST_ROWS, MOST_ROWS = 50_000, 500_000
# Trials that run at once while none depends on another.
WORKERS = 6


def boosted_trees(params: dict | None = None, seed: int = DEFAULTS.seed) -> GBTClassifier:
    """Gradient-boosted trees; training stops once another tree makes the
    error of the validation rows larger.

    ``min_child_weight`` is the least number of rows of a leaf. ``gamma`` has no
    counterpart: Spark's least gain of a split is relative to the rows of its node.
    """
    p = {**DEFAULT_PARAMS, **(params or {})}
    return GBTClassifier(
        labelCol=LABEL,
        featuresCol="features",
        maxIter=int(p["n_estimators"]),
        maxDepth=int(p["max_depth"]),
        stepSize=p["learning_rate"],
        subsamplingRate=p["subsample"],
        featureSubsetStrategy=str(p["colsample"]),
        minInstancesPerNode=int(p["min_child_weight"]),
        validationIndicatorCol=_VALIDATION,
        validationTol=0.0,
        seed=seed,
    )


def candidates(seed: int = DEFAULTS.seed) -> dict[str, object]:
    """Other classifiers to compare with; both take balanced row weights."""
    common = {"labelCol": LABEL, "featuresCol": "features", "weightCol": "weight"}
    return {
        "logistic_regression": LogisticRegression(maxIter=100, **common),
        "random_forest": RandomForestClassifier(numTrees=300, maxDepth=10, seed=seed, **common),
    }


def task_count(n_rows: int, cores: int) -> int:
    """Partitions for rows that are read again and again: one for few rows, else as many as
    there are cores, or a multiple, so that no pass ends with a few tasks left over."""
    if n_rows <= LEAST_ROWS * cores:
        return max(1, math.ceil(n_rows / LEAST_ROWS))
    return cores * math.ceil(n_rows / (MOST_ROWS * cores))


def tree_rows(rows: DataFrame, n_rows: int, columns: Sequence[str], key: str = KEY) -> DataFrame:
    """Prepared rows as the boosted trees read them, some ten jobs a tree.

    They are dealt evenly over the cores and kept by a checkpoint: every task of those jobs
    carries the plan of its input, which costs more than the work on small inputs. Dealt
    rows are sorted by key, so that the same rows give the same trees.
    """
    parts = task_count(n_rows, rows.sparkSession.sparkContext.defaultParallelism)
    if rows.rdd.getNumPartitions() != parts:
        rows = rows.repartition(parts, key).sortWithinPartitions(key)
    return checkpointed(rows.select(*columns))


def fit(
    split: DataFrame, estimator, feature_engineering: bool = True, settings: Settings = DEFAULTS
) -> PipelineModel:
    """Fit preprocessing on the train rows, the classifier on train (and, to stop
    early, validation) rows of a frame with a ``split`` column."""
    train = split.where(F.col("split") == "train")
    prep = build_preprocessor(feature_engineering).fit(train)
    if isinstance(estimator, GBTClassifier):
        rows = split.where(F.col("split") != "test")
        ready = prep.transform(rows.withColumn(_VALIDATION, F.col("split") == "val"))
        ready = tree_rows(ready, rows.count(), ["features", LABEL, _VALIDATION])
    else:
        ready = prep.transform(class_weights(train)).select("features", LABEL, "weight")
    model = estimator.fit(ready)
    return PipelineModel(stages=[*prep.stages, model])


def predict(model: PipelineModel, df: DataFrame, include_features: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """Add probability, prediction and risk level; narrow, no shuffle. Scores the
    table already has are replaced."""
    df = df.drop(*OUTPUTS)
    scored = model.transform(df)
    # The vector column takes the name of ours, so it is renamed first.
    scored = scored.withColumnRenamed("probability", "_vector")
    kept = df.columns if include_features else [c for c in (KEY,) if c in df.columns]
    scored = scored.select(*[f"`{c}`" for c in kept], vector_to_array("_vector")[1].alias("_p"))
    return add_predictions(scored, F.col("_p"), settings).drop("_p")


def feature_importance(model: PipelineModel, spark: SparkSession, feature_engineering: bool = True) -> DataFrame:
    """``(feature, importance)``, most important first; one row per model feature."""
    names = feature_names(model, feature_engineering)
    values = model.stages[-1].featureImportances
    rows = [(n, float(values[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def evaluate_splits(model: PipelineModel, split: DataFrame, key: str = KEY) -> DataFrame:
    """All metrics for train, validation and test in one go."""
    scored = predict(model, split)
    return all_metrics(scored, LABEL, SCORE, key, by=["split"])


def sample_params(n: int, seed: int = DEFAULTS.seed, space: dict = SEARCH_SPACE) -> list[dict]:
    """``n`` seeded random points of the search space."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        point = {}
        for name, (low, high) in space.items():
            if isinstance(low, int) and isinstance(high, int):
                point[name] = rng.randint(low, high)
            elif name in _LOG_SCALE:
                point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                point[name] = rng.uniform(low, high)
        out.append(point)
    return out


@contextmanager
def _trials(split: DataFrame, feature_engineering: bool, make) -> Iterator[Callable[[dict], dict]]:
    """A function that fits one parameter set and grades it on the validation rows.

    Preprocessing is fitted once and the prepared rows are written, since every fit reads
    them again.
    """
    train = split.where(F.col("split") == "train")
    prep = build_preprocessor(feature_engineering).fit(train)
    rows = split.where(F.col("split") != "test")
    ready = prep.transform(rows.withColumn(_VALIDATION, F.col("split") == "val"))
    rows = tree_rows(ready, rows.count(), [KEY, "features", LABEL, "split", _VALIDATION]).persist()

    def trial(params: dict) -> dict:
        model = make(params).fit(rows)
        scored = model.transform(rows.where(F.col("split") == "val")).withColumn("p1", vector_to_array("probability")[1])
        graded = joint_objective(all_metrics(scored, LABEL, "p1", KEY)).select("objective", "pr_auc", "top_recall_at_k").first()
        return {"params": params, **graded.asDict()}

    try:
        yield trial
    finally:
        rows.unpersist()


def tune(
    split: DataFrame,
    grid: Sequence[dict],
    feature_engineering: bool = True,
    parallelism: int = 2,
    make=boosted_trees,
) -> list[dict]:
    """Fit one model per parameter set and rank them by the joint objective on the
    fixed validation rows. Failed fits are left out; if all fail that is an error."""
    failures: list[Exception] = []

    def tried(params: dict) -> dict | None:
        try:
            return trial(params)
        except Exception as error:  # a bad parameter set must not end the search
            failures.append(error)
            return None

    with _trials(split, feature_engineering, make) as trial, ThreadPool(parallelism) as pool:
        done = [r for r in pool.map(tried, grid) if r is not None]
    if not done:
        raise RuntimeError("every trial failed") from (failures[0] if failures else None)
    # A trial without a value, as where no row is positive, comes last.
    return sorted(done, key=lambda r: (r["objective"] is None, -(r["objective"] or 0.0)))


def optimize(
    split: DataFrame,
    n_trials: int,
    space: dict = SEARCH_SPACE,
    seed: int = DEFAULTS.seed,
    feature_engineering: bool = True,
    parallelism: int = 1,
    make=boosted_trees,
    workers: int = WORKERS,
) -> list[Trial]:
    """All trials of a sequential search for the best joint objective on the validation rows;
    up to ``workers`` of the first, random ones run at once."""
    with _trials(split, feature_engineering, make) as trial:
        return search(
            lambda params: trial(params)["objective"], space, n_trials, seed, _LOG_SCALE, parallelism, workers=workers
        )


class RankingEvaluator(Evaluator):
    """Grades a model's predictions by one of our metrics, for Spark's own search:
    ``average_precision``, ``pr_auc`` or ``objective``."""

    def __init__(self, metric: str = "average_precision", key: str = KEY):
        super().__init__()
        self.metric, self.key = metric, key

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.withColumn("p1", vector_to_array("probability")[1])
        row = joint_objective(all_metrics(scored, LABEL, "p1", self.key)).select(self.metric).first()
        return float(row[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def cross_validate(
    train: DataFrame,
    estimator,
    grid: dict[str, Sequence],
    folds: int = 3,
    metric: str = "average_precision",
    parallelism: int = 2,
    seed: int = DEFAULTS.seed,
) -> tuple[PipelineModel, list[dict]]:
    """Grid search over an estimator's parameters by cross-validation: the best model
    fitted on all rows, and the mean metric of every grid point, best first."""
    prep = build_preprocessor().fit(train)
    rows = class_weights(prep.transform(train.drop(*OUTPUTS)).select(KEY, "features", LABEL)).persist()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    points = builder.build()
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=points,
        evaluator=RankingEvaluator(metric),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
    )
    try:
        found = search.fit(rows)
    finally:
        rows.unpersist()
    table = [
        {**{p.name: v for p, v in point.items()}, metric: score} for point, score in zip(points, found.avgMetrics)
    ]
    return PipelineModel(stages=[*prep.stages, found.bestModel]), sorted(table, key=lambda r: -r[metric])


# The grid the random forest was searched over (30 is the deepest Spark grows).
FOREST_GRID = {"numTrees": (200, 400, 600), "maxDepth": (6, 10, 30), "featureSubsetStrategy": ("auto", "sqrt")}


def conditional_model(df: DataFrame, label: str = LABEL) -> Logistic:
    """Logistic regression of the label on age and balance, nulls as 0."""
    return fit_logistic(df, ["Age", "Balance"], label)


def training_summary(baseline: DataFrame, tuned: DataFrame, importance: DataFrame | None = None, n: int = 5) -> DataFrame:
    """Report rows ``(section, item, value)``: test PR-AUC of both models, their
    difference and the most important features."""
    def test(m: DataFrame):
        return m.where(F.col("split") == "test").select("pr_auc").scalar()

    one = baseline.sparkSession.range(1).select(test(baseline).alias("b"), test(tuned).alias("t"))
    out = one.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit("performance").alias("section"), F.lit(i).alias("item"), v.alias("value"))
                    for i, v in (
                        ("baseline_pr_auc", F.col("b")),
                        ("tuned_pr_auc", F.col("t")),
                        ("improvement", F.col("t") - F.col("b")),
                    )
                ]
            )
        ).alias("r")
    ).select("r.*")
    if importance is None:
        return out
    top = importance.orderBy(F.col("importance").desc(), "feature").limit(n)
    return out.unionByName(top.select(F.lit("top_features").alias("section"), F.col("feature").alias("item"), F.col("importance").alias("value")))
