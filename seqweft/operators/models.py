"""Cross-validated classifiers, importances and reductions with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.functions.channels import family_of
from seqweft.operators.ordered import stored
from seqweft.operators.transform import anova_scores, interactions, stratified_folds, top_features


def forest(features: Sequence[str], label: str, trees: int = 20, depth: int = 5, seed: int = 42) -> Pipeline:
    """Label codes in alphabetical order, features as a vector, a random forest."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error"),
            VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error"),
            RandomForestClassifier(
                labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_probability"
            ),
        ]
    )


def cross_validated(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], folds: int = 5, **options
) -> tuple[DataFrame, list]:
    """Out-of-fold predictions (fold, class, guess, probabilities) and the fitted models, one per fold.

    The loop runs over folds, a handful; each fit and each prediction is a Spark job over all rows. The rows
    with their folds are written once to the shared folder, so that no fit computes its input again.
    """
    assigned = stored(stratified_folds(df.select(*key, label, *features), label, key, folds), "folds")
    out, models = None, []
    for fold in range(folds):
        model = forest(features, label, **options).fit(assigned.where(F.col("fold") != fold))
        names = F.array(*[F.lit(x) for x in model.stages[0].labelsArray[0]])
        scored = model.transform(assigned.where(F.col("fold") == fold)).select(
            *key,
            "fold",
            F.col(label).cast("string").alias("truth"),
            F.get(names, F.col("prediction").cast("int")).alias("guess"),
            vector_to_array("_probability").alias("probabilities"),
        )
        out = scored if out is None else out.unionByName(scored)
        models.append(model)
    return out, models


def fold_scores(predictions: DataFrame) -> DataFrame:
    """Accuracy and macro F1 per fold from (fold, truth, guess) counts."""
    n = F.col("n")
    pairs = predictions.groupBy("fold", "truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("truth") == F.col("guess"), n).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("class"), n.alias("seen"), hit.alias("hits")),
        F.struct(F.col("guess").alias("class"), n.alias("seen"), F.lit(0).cast("long").alias("hits")),
    )
    per_class = (
        pairs.select("fold", F.explode(sides).alias("_s"))
        .groupBy("fold", "_s.class")
        .agg(F.sum("_s.seen").alias("seen"), F.sum("_s.hits").alias("hits"))
    )
    macro = per_class.groupBy("fold").agg(F.avg(2 * F.col("hits") / F.col("seen")).alias("macro_f1"))
    right = pairs.groupBy("fold").agg((F.sum(hit) / F.sum(n)).alias("accuracy"), F.sum(n).alias("rows"))
    return right.join(macro, "fold")


def importances(spark, models: Sequence, features: Sequence[str]) -> DataFrame:
    """Importance per fold and feature; its size is folds x features, whatever the data's."""
    rows = [
        (fold, name, float(value))
        for fold, model in enumerate(models)
        for name, value in zip(features, model.stages[-1].featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "fold int, feature string, importance double")


def importance_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("feature").agg(
        F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("std_importance")
    )


def family_importance(summary: DataFrame) -> DataFrame:
    return summary.groupBy(family_of(F.col("feature")).alias("family")).agg(
        F.avg("importance").alias("importance"), F.count(F.lit(1)).alias("features")
    )


def fit_components(df: DataFrame, features: Sequence[str], k: int) -> tuple[Callable[[DataFrame, Sequence[str]], DataFrame], object]:
    """A projection on the k leading components of the rows, centred on their means, to apply to any rows."""
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()

    def centred(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        moved = rows.select(*keep, *[(F.col(c) - F.lit(means[c])).alias(f"_x{i}") for i, c in enumerate(features)])
        return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_x").transform(moved)

    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(centred(df, []))

    def project(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        parts = vector_to_array("_pc")
        return model.transform(centred(rows, keep)).select(*keep, *[parts[i].alias(f"pc{i + 1}") for i in range(k)])

    return project, model


def principal_components(df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str]) -> tuple[DataFrame, object]:
    """Mean-centred projection on the k leading components. Signs of components are arbitrary."""
    project, model = fit_components(df, features, k)
    return project(df, keep), model


def mean_fold_score(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], folds: int = 3, **options) -> float:
    predictions, _ = cross_validated(df, features, label, key, folds, **options)
    return fold_scores(predictions).agg(F.avg("macro_f1")).first()[0]


def search_feature_count(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], counts: Sequence[int], folds: int = 3, **options
) -> DataFrame:
    """Cross-validated macro F1 for the k features of highest F score, for each k; the best is marked."""
    ranked = [r["feature"] for r in top_features(anova_scores(df, features, label), "f_score", len(features)).collect()]
    tried = [(k, mean_fold_score(df, ranked[:k], label, key, folds, **options)) for k in counts]
    best = min(tried, key=lambda t: (-t[1], t[0]))[0]
    return df.sparkSession.createDataFrame([(k, s, k == best) for k, s in tried], "k int, macro_f1 double, best boolean")


Variant = tuple[Callable[[DataFrame], DataFrame], list[str]]


def feature_variants(
    train: DataFrame, features: Sequence[str], label: str, keep: Sequence[str], components: int, most: int | None = None
) -> dict[str, Variant]:
    """Original, pairwise-product and principal-component versions of a feature table, fitted on `train`.

    Each is a function to apply to any rows, with the names of the features it makes. All product features
    are kept unless `most` is given: then those of highest F score against the training labels.
    """
    products = interactions(train, features, keep)
    names = [c for c in products.columns if c not in keep]
    if most is not None and len(names) > most:
        names = [r["feature"] for r in top_features(anova_scores(products, names, label), "f_score", most).collect()]
    project, _ = fit_components(train, features, components)
    return {
        "original": (lambda df: df.select(*keep, *features), list(features)),
        "polynomial": (lambda df: interactions(df, features, keep).select(*keep, *names), names),
        "pca": (lambda df: project(df, keep), [f"pc{i + 1}" for i in range(components)]),
    }


def compare_variants(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], components: int, folds: int = 3,
    most: int | None = None, **options
) -> DataFrame:
    """Cross-validated macro F1 of every variant; the best is marked.

    What a variant learns (means, components, chosen products) comes from each fold's training rows alone.
    """
    assigned = stored(stratified_folds(df.select(*key, label, *features), label, key, folds), "folds")
    keep, scored, sizes = [*key, label, "fold"], {}, {}
    for fold in range(folds):
        train, held = assigned.where(F.col("fold") != fold), assigned.where(F.col("fold") == fold)
        for name, (apply, columns) in feature_variants(train, features, label, keep, components, most).items():
            model = forest(columns, label, **options).fit(apply(train))
            classes = F.array(*[F.lit(x) for x in model.stages[0].labelsArray[0]])
            guess = F.get(classes, F.col("prediction").cast("int")).alias("guess")
            got = model.transform(apply(held)).select("fold", F.col(label).cast("string").alias("truth"), guess)
            scored[name] = scored[name].unionByName(got) if name in scored else got
            sizes[name] = len(columns)
    tried = [(n, sizes[n], fold_scores(got).agg(F.avg("macro_f1")).first()[0]) for n, got in scored.items()]
    best = min(tried, key=lambda t: (-t[2], t[0]))[0]
    rows = [(n, c, s, n == best) for n, c, s in tried]
    return df.sparkSession.createDataFrame(rows, "variant string, features int, macro_f1 double, best boolean")


def best_variant_applied(
    train: DataFrame, validation: DataFrame, features: Sequence[str], label: str, key: Sequence[str], components: int,
    most: int | None = None, **options
) -> tuple[str, DataFrame, DataFrame]:
    """The variant that compares best on the training rows, fitted on all of them and applied to both parts."""
    best = compare_variants(train, features, label, key, components, most=most, **options).where("best").first()["variant"]
    apply, _ = feature_variants(train, features, label, [*key, label], components, most)[best]
    return best, apply(train), apply(validation)
