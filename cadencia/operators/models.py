"""Refill and churn models on Spark ML: pipelines, comparison, ensembles, search, importance and batch prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadencia.operators import governance, kpi

GROUPS = ("age_group", "category")


def preprocessor(numbers: tuple[str, ...], groups: tuple[str, ...] = GROUPS, scale: bool = False) -> list:
    """Unknown groups get a column of their own; numbers pass through or are scaled."""
    if not groups:
        joined = VectorAssembler(inputCols=list(numbers), outputCol="raw" if scale else "features", handleInvalid="keep")
        return [joined, *([StandardScaler(inputCol="raw", outputCol="features")] if scale else [])]
    index = StringIndexer(inputCols=list(groups), outputCols=[f"{g}_i" for g in groups], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{g}_i" for g in groups], outputCols=[f"{g}_v" for g in groups], handleInvalid="keep")
    joined = VectorAssembler(inputCols=[*(f"{g}_v" for g in groups), *numbers], outputCol="raw" if scale else "features", handleInvalid="keep")
    return [index, hot, joined, *([StandardScaler(inputCol="raw", outputCol="features")] if scale else [])]


def regressors(trees: int = 20) -> dict:
    return {"linear": LinearRegression(labelCol="target"), "forest": RandomForestRegressor(labelCol="target", numTrees=trees, seed=42), "boosted": GBTRegressor(labelCol="target", maxIter=trees, seed=42)}


def classifiers(trees: int = 20, weighted: bool = False) -> dict:
    w = {"weightCol": "weight"} if weighted else {}
    return {"logistic": LogisticRegression(labelCol="target", **w), "forest": RandomForestClassifier(labelCol="target", numTrees=trees, seed=42, **w), "boosted": GBTClassifier(labelCol="target", maxIter=trees, seed=42, **w)}


def class_weights(train: DataFrame, label: str = "target") -> DataFrame:
    """Balancing weights where the rate of label 1 is under 0.2 or over 0.8, else 1."""
    rate = train.agg(F.avg(label).alias("rate")).first()["rate"] or 0.5
    skewed = rate < 0.2 or rate > 0.8
    return train.withColumn("weight", F.when(F.col(label) == 1, 0.5 / max(rate, 1e-6)).otherwise(0.5 / max(1 - rate, 1e-6)) if skewed else F.lit(1.0))


def fit(train: DataFrame, numbers: tuple[str, ...], estimator, scale: bool = False, groups: tuple[str, ...] = GROUPS) -> PipelineModel:
    return Pipeline(stages=[*preprocessor(numbers, groups, scale), estimator]).fit(train)


def probability(model: PipelineModel, rows: DataFrame, name: str = "probability_1") -> DataFrame:
    kept = rows.columns
    return model.transform(rows).select(*kept, vector_to_array("probability")[1].alias(name))


def ensemble(models: dict[str, PipelineModel], rows: DataFrame, classify: bool) -> DataFrame:
    """rows with `prediction`, the mean of all models' predictions or probabilities; all models see the row in one pass."""
    out, kept = rows, rows.columns
    for name, model in models.items():
        scored = model.transform(out)
        value = vector_to_array("probability")[1] if classify else F.col("prediction")
        out = scored.select(*kept, *(c for c in out.columns if c.startswith("p_")), value.alias(f"p_{name}"))
    mean = sum((F.col(f"p_{n}") for n in models), F.lit(0.0)) / len(models)
    return out.withColumn("prediction", mean)


def mean_absolute_error(rows: DataFrame, label: str = "target", prediction: str = "prediction") -> float:
    return rows.agg(F.avg(F.abs(F.col(label) - F.col(prediction)))).first()[0]


def search(train: DataFrame, numbers: tuple[str, ...], estimator, grid: dict, folds: int = 5, parallelism: int = 4, classify: bool = False, groups: tuple[str, ...] = GROUPS):
    """The best of a grid by cross-validation, on the training part only."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(estimator.getParam(param), values)
    judge = BinaryClassificationEvaluator(labelCol="target") if classify else RegressionEvaluator(labelCol="target", metricName="mae")
    return CrossValidator(estimator=Pipeline(stages=[*preprocessor(numbers, groups), estimator]), estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, parallelism=parallelism, seed=42).fit(train)


def importance(model: PipelineModel, rows: DataFrame, top: int = 5) -> list[tuple[str, float]]:
    """The features of most importance in a tree model, by their names in the assembled vector."""
    attrs = model.transform(rows.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    weights = model.stages[-1].featureImportances
    return sorted(((names[i], float(weights[i])) for i in range(len(names))), key=lambda x: (-x[1], x[0]))[:top]


#: Rows of a block in which a feature's values change places.
PERMUTED_ROWS = 4_096


def permutation_importance(predict, rows: DataFrame, numbers: tuple[str, ...], key: str, label: str = "target", seed: int = 42) -> DataFrame:
    """(feature, importance): how much the mean absolute error grows when a number's values change places, for any model.

    predict(rows) adds `prediction`. Rows are dealt to blocks by a hash of the key, and in each a row takes the value of the next one in the order of another hash
    (the last one that of the first), so the column is permuted in one pass and no block is large. The model runs once, over each row as it is and
    with each number exchanged. Rows without a label or a prediction do not count.
    """
    blocks = max(1, -(-rows.count() // PERMUTED_ROWS))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    dealt = rows.withColumn("__digest", digest).withColumn("__block", F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long") % blocks)
    w = Window.partitionBy("__block").orderBy("__digest", key)
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_of = lambda c: F.when(F.lead("__digest").over(w).isNotNull(), F.lead(c).over(w)).otherwise(F.first(c).over(first))
    moved = dealt.withColumns({f"__next_{c}": next_of(c) for c in numbers})
    turns = moved.withColumn("__turn", F.explode(F.array(*map(F.lit, range(len(numbers) + 1)))))
    changed = turns.withColumns({c: F.when(F.col("__turn") == i + 1, F.col(f"__next_{c}")).otherwise(F.col(c)) for i, c in enumerate(numbers)})
    errors = predict(changed).groupBy("__turn").agg(F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("e"))
    both = errors.filter("__turn > 0").join(F.broadcast(errors.filter("__turn = 0").select(F.col("e").alias("base"))))  # one row
    name = F.element_at(F.array(*map(F.lit, numbers)), F.col("__turn"))
    return both.select(name.alias("feature"), (F.col("e") - F.col("base")).alias("importance"))


@dataclass
class Bundle:
    """A fitted model with the threshold that was tuned on a validation part."""

    model: PipelineModel
    threshold: float

    def predict(self, rows: DataFrame) -> DataFrame:
        return probability(self.model, rows).withColumn("predicted", (F.col("probability_1") >= self.threshold).cast("int"))


def tuned_bundle(model: PipelineModel, validation: DataFrame) -> Bundle:
    best = kpi.best_threshold(probability(model, validation), "target", "probability_1").first()
    return Bundle(model, best["threshold"] if best else 0.5)


def predict_cycles(model: PipelineModel, rows: DataFrame, as_of: str, mae: float = governance.MAE_DAYS) -> DataFrame:
    """Days to the next purchase (at least 1), its date, and the confidence by the pair's own mean."""
    scored = model.transform(rows)
    days = F.greatest(F.lit(1.0), F.bround("prediction", 1))
    return scored.select("customer_id", "drug_id", days.alias("predicted_days"), F.date_add(F.lit(as_of).cast("date"), F.bround(days, 0).cast("int")).alias("next_date"), governance.cycle_confidence(F.col("avg_cycle_days"), F.col("is_cold"), mae).alias("confidence"))


def predict_churn(bundle: Bundle, rows: DataFrame) -> DataFrame:
    scored = bundle.predict(rows)
    return scored.select("customer_id", "drug_id", F.col("probability_1").alias("churn"), "predicted", governance.churn_tier(F.col("probability_1")).alias("tier"))


def evaluate(cycles_predicted: DataFrame, churn_predicted: DataFrame) -> DataFrame:
    """Both predictions of a pair and the governance decision."""
    both = cycles_predicted.join(churn_predicted, ["customer_id", "drug_id"])
    return both.withColumn("decision", governance.decision(F.col("confidence"), F.col("churn"))).withColumn("churn_action", governance.churn_action(F.col("churn")))
