"""Logistic models whose coefficients rank features.

Gradient descent on the mean log loss: every epoch is one aggregation over the data,
and only gradients (one number per feature and model) leave the tasks. Weights travel
as a small table written after each epoch, so a lost executor never costs more than
the running epoch.

* `federated_weights`: one model per group (source file), to be averaged;
* `incremental_weights`: one model carried from group to group in name order;
* `local_weights`: models by group from one scan, trained inside the tasks and averaged;
* `global_coefficients`: one model over everything, by the model library.

The ``mixed_*`` forms train on one-hot and numeric features without building the former;
`mixed_global_coefficients` is their model over everything, by quasi-Newton steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.functions.stats import sigmoid
from crivo.operators.clean import assemble
from crivo.operators.contingency import feature_name, quoted
from crivo.operators.encode import Labels, encode_labels, fit_labels
from crivo.shared import BroadcastBudget, discard, hot_keys, lookup, materialize, measured, spread_writes, work_path

# Passes per file in the averaged and in the incremental model.
FEDERATED_EPOCHS = 5
INCREMENTAL_EPOCHS = 1

# The partition folder of a written group.
FOLDER = "_group"


def _design(df: DataFrame, features: Sequence[str], target: str, group: str) -> DataFrame:
    """Columns ``g, y, x0, x1, ...``; a missing feature value counts as 0."""
    return df.where(quoted(target).isNotNull() & quoted(group).isNotNull()).select(
        quoted(group).cast("string").alias("g"),
        quoted(target).cast("double").alias("y"),
        *[F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)],
    )


def _zeros(n_features: int) -> Column:
    return F.array_repeat(F.lit(0.0), n_features + 1)


def _sums(rows: DataFrame, n_features: int, by: Sequence[str]) -> DataFrame:
    """Rows that carry their weights ``w`` (intercept last) to sums: ``*by, n, s0, s1, ...``.

    Sums alone, so that rows are added up in a hash table where they are read, unsorted.
    """
    score = " + ".join([f"w[{n_features}]", *[f"w[{i}] * x{i}" for i in range(n_features)]])
    failed = rows.withColumn("e", sigmoid(F.expr(score)) - F.col("y"))
    return failed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("e").alias(f"s{n_features}"),
        *[F.expr(f"sum(e * x{i})").alias(f"s{i}") for i in range(n_features)],
    )


def _moved(n_features: int, lr: float, l2: float) -> Column:
    """The weights ``w`` after a step along the sums."""
    moved = [f"w[{i}] - {lr!r}D * (s{i} / n + {l2!r}D * w[{i}])" for i in range(n_features)]
    moved.append(f"w[{n_features}] - {lr!r}D * s{n_features} / n")
    return F.expr(f"array({', '.join(moved)})")


def federated_weights(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    group: str,
    lr: float = 0.1,
    l2: float = 1e-4,
    epochs: int = FEDERATED_EPOCHS,
) -> DataFrame:
    """A model per group, all trained in the same passes: ``g, w`` (intercept last).

    Groups without rows have no model. The weights are written and measured; beyond the
    broadcast bound rows look them up by group and salt. At least one epoch is needed.
    """
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    design = _design(df, features, target, group)
    k, weights, size = len(features), None, None
    for _ in range(epochs):
        # Every model starts at zero, so the first pass needs no lookup.
        rows = design.withColumn("w", _zeros(k)) if weights is None else lookup(design, weights, ["g"], size)
        sums = _sums(rows, k, ["g"])
        before = sums.withColumn("w", _zeros(k)) if weights is None else sums.join(weights, "g")
        old, weights = weights, materialize(before.select("g", _moved(k, lr, l2).alias("w")), "weights")
        if old is not None:
            discard(df.sparkSession, old)
        if size is None:
            size = weights.count() * (64 + 8 * (k + 1)) + measured(weights.select("g"))
    return weights


def stored_by_group(df: DataFrame, group: str) -> tuple[DataFrame, list[str]]:
    """The rows written with a folder per group, and the group names in order.

    Every step of a carried model then reads the folder of its group alone. The names are
    listed on the driver, one text per file, as their order is part of the result.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, "groups")
    named = df.where(quoted(group).isNotNull()).withColumn(FOLDER, quoted(group).cast("string"))
    write_by(named, path, FOLDER)
    stored = spark.read.schema(named.schema).parquet(path)
    return stored, [row[0] for row in stored.select(FOLDER).distinct().orderBy(FOLDER).collect()]


def write_by(df: DataFrame, path: str, column: str) -> None:
    """A folder per value; adaptive execution splits a large value over several files."""
    with spread_writes(df.sparkSession):
        df.hint("rebalance", column).write.partitionBy(column).parquet(path)


def incremental_weights(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    group: str,
    lr: float = 0.1,
    l2: float = 1e-4,
    epochs: int = INCREMENTAL_EPOCHS,
) -> DataFrame:
    """One model that visits the groups in name order: one row ``w`` (intercept last)."""
    spark = df.sparkSession
    needed = df.where(quoted(target).isNotNull()).select(*[quoted(c) for c in dict.fromkeys([*features, target, group])])
    stored, names = stored_by_group(needed, group)
    weights = spark.range(1).select(_zeros(len(features)).alias("w"))
    for name in names:
        part = _design(stored.where(F.col(FOLDER) == name), features, target, group)
        for _ in range(epochs):
            old, weights = weights, materialize(updated_weights(part, weights, len(features), lr, l2), "weights")
            discard(spark, old)
    discard(spark, stored)
    return weights


def updated_weights(part: DataFrame, weights: DataFrame, n_features: int, lr: float, l2: float) -> DataFrame:
    """One step of a single model over ``part``, with the old weights as a scalar subquery."""
    before = weights.select("w").scalar()
    sums = _sums(part.withColumn("w", before), n_features, [])
    return sums.withColumn("w", before).select(_moved(n_features, lr, l2).alias("w"))


# A task holds models of at most so many groups before it hands them on.
HELD_GROUPS = 10_000


def local_weights(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    group: str,
    lr: float = 0.1,
    l2: float = 1e-4,
    epochs: int = FEDERATED_EPOCHS,
    batch_rows: int = 256,
) -> DataFrame:
    """A model per group from one scan: ``g, n, w`` (intercept last).

    Each task trains a model of every group on its own rows, in steps of ``batch_rows`` rows and
    ``epochs`` rounds over each Arrow batch while it is at hand, and sends weights and the number of
    rows. The models of one group are averaged by their rows. `federated_weights` instead takes
    full-batch steps, a scan for each; the two rank features alike where the data tell them
    apart, but these weights depend on how rows lie in tasks.
    """
    design, k = _design(df, features, target, group), len(features)

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, list] = {}

        def told() -> pa.RecordBatch:
            made = [pa.array(list(models), pa.string()), pa.array([n for n, _ in models.values()], pa.int64()),
                    pa.array([w.tolist() for _, w in models.values()], pa.list_(pa.float64()))]
            models.clear()
            return pa.RecordBatch.from_arrays(made, names=["g", "n", "w"])

        for batch in batches:
            groups = batch.column("g").dictionary_encode()
            codes = groups.indices.to_numpy()
            y = batch.column("y").to_numpy()
            x = np.column_stack([*[batch.column(f"x{i}").to_numpy() for i in range(k)], np.ones(len(y))])
            for code, name in enumerate(groups.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                model = models.setdefault(name, [0, np.zeros(k + 1)])
                model[0] += len(own)
                w, penalty = model[1], np.append(np.full(k, l2), 0.0)
                for _ in range(epochs):
                    for first in range(0, len(own), batch_rows):
                        part = own[first:first + batch_rows]
                        error = 1.0 / (1.0 + np.exp(-np.clip(x[part] @ w, -500, 500))) - y[part]
                        w -= lr * (error @ x[part] / len(part) + penalty * w)
            if len(models) > HELD_GROUPS:
                yield told()
        yield told()

    parts = design.mapInArrow(train, "g string, n long, w array<double>")
    means = [(F.sum(F.get("w", F.lit(i)) * F.col("n")) / F.sum("n")).alias(f"w{i}") for i in range(k + 1)]
    merged = parts.groupBy("g").agg(F.sum("n").alias("n"), *means)
    return merged.select("g", "n", F.array(*[f"w{i}" for i in range(k + 1)]).alias("w"))


def local_importance(df: DataFrame, features: Sequence[str], target: str, group: str, **options) -> DataFrame:
    """Absolute mean coefficient of the models by group, from one scan."""
    return importance(averaged(coefficients(local_weights(df, features, target, group, **options), features, ["g"])))


def coefficients(weights: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Weight arrays as lines ``*by, feature, coef``, without the intercept."""
    lines = [F.struct(F.lit(c).alias("feature"), F.get("w", F.lit(i)).alias("coef")) for i, c in enumerate(features)]
    return weights.select(*by, F.inline(F.array(*lines)))


def averaged(coefs: DataFrame) -> DataFrame:
    """Unweighted mean over models: ``feature, coef``."""
    return coefs.groupBy("feature").agg(F.avg("coef").alias("coef"))


def importance(coefs: DataFrame) -> DataFrame:
    """Absolute coefficient, highest first: ``feature, importance``."""
    return coefs.select("feature", F.abs("coef").alias("importance")).orderBy(F.col("importance").desc(), "feature")


def federated_importance(df: DataFrame, features: Sequence[str], target: str, group: str, **options) -> DataFrame:
    """Absolute mean coefficient of the models by group."""
    weights = federated_weights(df, features, target, group, **options)
    return importance(averaged(coefficients(weights, features, ["g"])))


def incremental_importance(df: DataFrame, features: Sequence[str], target: str, group: str, **options) -> DataFrame:
    """Absolute coefficient of the model carried from group to group."""
    return importance(coefficients(incremental_weights(df, features, target, group, **options), features))


def global_coefficients(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    l2: float = 0.0,
    max_iter: int = 100,
    tol: float = 1e-9,
) -> DataFrame:
    """Coefficients of one model over all rows: ``feature, coef``."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=l2, maxIter=max_iter, tol=tol, standardization=False
    ).fit(assemble(df, features, target))
    rows = [(c, float(v)) for c, v in zip(features, model.coefficients.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, coef double")


def _coded(
    df: DataFrame, columns: Sequence[str], numbers: Sequence[str], target: str, group: str | None
) -> tuple[DataFrame, Labels]:
    """Rows with codes for categories and plain numbers, written once, and the codes' dictionary.

    Columns ``g, y, c0, c1, ..., x0, x1, ...``; a missing category has no code. The rows lie
    in a folder per group, so a carried model reads them group by group; without a group there
    is no ``g``.
    """
    known = df.where(quoted(target).isNotNull())
    known = known.where(quoted(group).isNotNull()) if group else known
    labels = fit_labels(known, columns) if columns else Labels(df.sparkSession.createDataFrame([], "column string, value string, code int"), {})
    coded = encode_labels(known, labels, columns) if columns else known
    rows = coded.select(
        *([quoted(group).cast("string").alias(FOLDER)] if group else []),
        quoted(target).cast("double").alias("y"),
        *[F.when(quoted(c) >= 0, quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)],
        *[F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(numbers)],
    )
    if not group:
        return materialize(rows, "coded"), labels
    path = work_path(df.sparkSession, "coded")
    write_by(rows, path, FOLDER)
    read = df.sparkSession.read.schema(rows.schema).parquet(path)
    return read.withColumn("g", F.col(FOLDER)), labels


@dataclass(frozen=True)
class MixedWeights:
    """Weights of categories ``*by, i, code, w`` and of numbers ``*by, v`` (intercept last), written down.

    ``sizes`` has the bytes of the categories by column, and of the numbers at -1; ``hot`` the
    salts of heavy codes for those that are not broadcast.
    """

    categories: DataFrame
    numbers: DataFrame
    sizes: dict[int, int]
    hot: dict[int, dict[int, int]]


def _mixed_start(
    rows: DataFrame, labels: Labels, columns: Sequence[str], numbers: Sequence[str], by: Sequence[str]
) -> MixedWeights:
    """Zero weights: the first category of a column, code 0, has none at all.

    With models by group, a group has weights for the categories it shows.
    """
    models = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    dense = materialize(models.select(*by, _zeros(len(numbers)).alias("v")), "weights")
    sizes = {-1: measured(dense) + dense.count() * 8 * (len(numbers) + 1)} if by else {}
    lines = [F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("code")) for i in range(len(columns))]
    if columns:
        shown = rows.select(*by, F.inline(F.array(*lines))).where("code > 0").distinct()
        first = materialize(shown.withColumn("w", F.lit(0.0)), "weights")
        # A column without a line has no categories, and its size is known to be nothing.
        sizes |= dict.fromkeys(range(len(columns)), 0) | {r[0]: r[1] * 96 for r in first.groupBy("i").count().collect()}
    else:
        first = rows.limit(0).select(*by, F.lit(0).alias("i"), F.lit(0).alias("code"), F.lit(0.0).alias("w"))
    budget = BroadcastBudget()
    keys = {i: [f"c{i}", *by] for i in range(len(columns))} | ({-1: list(by)} if by else {})
    return MixedWeights(first, dense, sizes, hot_keys(rows, {i: c for i, c in keys.items() if not budget.take(sizes[i])}))


def _gradients(rows: DataFrame, before: MixedWeights, columns: Sequence[str], numbers: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Sums of the errors by category ``i, code``, and of errors times numbers at ``i = -1``, written down.

    A row looks up one weight per category column by its code; numbers and the intercept
    take the group's array. One grouped sum over the rows has a line per category of the row
    and one for all its numbers. ``n`` counts rows.
    """
    k, budget, scored = len(numbers), BroadcastBudget(), rows
    for i in range(len(columns)):
        part = before.categories.where(F.col("i") == i).select(*by, F.col("code").alias(f"c{i}"), F.col("w").alias(f"_w{i}"))
        scored = lookup(scored, part, [f"c{i}", *by], before.sizes[i], budget=budget, hot=before.hot.get(i))
    if by:
        scored = lookup(scored, before.numbers, list(by), before.sizes[-1], budget=budget, hot=before.hot.get(-1))
    else:
        scored = scored.withColumn("v", before.numbers.select("v").scalar())
    terms = [f"v[{k}]", *[f"v[{i}] * x{i}" for i in range(k)], *[f"coalesce(_w{i}, 0D)" for i in range(len(columns))]]
    error = sigmoid(F.expr(" + ".join(terms))) - F.col("y")
    failed = scored.select(*by, error.alias("e"), *[f"c{i}" for i in range(len(columns))], *[f"x{i}" for i in range(k)])
    nothing = F.lit(None).cast("double")
    lines = [F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("code"), F.col("e").alias("s"), *[nothing.alias(f"s{j}") for j in range(k)])
             for i in range(len(columns))]
    lines.append(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("code"), F.col("e").alias("s"), *[(F.col("e") * F.col(f"x{j}")).alias(f"s{j}") for j in range(k)]))
    return materialize(
        failed.select(*by, F.inline(F.array(*lines))).where("code IS NOT NULL AND (i < 0 OR code > 0)").groupBy(*by, "i", "code").agg(
            F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]),
        "gradients",
    )


def _mixed_step(
    rows: DataFrame, before: MixedWeights, columns: Sequence[str], numbers: Sequence[str], by: Sequence[str], lr: float, l2: float
) -> MixedWeights:
    """One gradient step."""
    k = len(numbers)
    grads = _gradients(rows, before, columns, numbers, by)
    # Read twice below, so it is written; the line of the numbers has the number of rows.
    totals = grads.where("i = -1").select(*by, "n", "s", *[f"s{j}" for j in range(k)])
    moved = [f"v[{j}] - {lr!r}D * (s{j} / n + {l2!r}D * v[{j}])" for j in range(k)] + [f"v[{k}] - {lr!r}D * s / n"]
    dense = before.numbers.join(totals, list(by)) if by else before.numbers.crossJoin(totals)
    numbers_after = materialize(dense.select(*by, F.expr(f"array({', '.join(moved)})").alias("v")), "weights")
    spark = rows.sparkSession
    if not columns:
        discard(spark, before.numbers, grads)
        return MixedWeights(before.categories, numbers_after, before.sizes, before.hot)
    keyed = before.categories.join(grads.select(*by, "i", "code", "s"), [*by, "i", "code"], "left")
    rows_of = totals.select(*by, F.col("n"))
    keyed = lookup(keyed, rows_of, list(by), before.sizes[-1]) if by else keyed.withColumn("n", rows_of.select("n").scalar())
    w = F.col("w") - F.lit(lr) * (F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n") + F.lit(l2) * F.col("w"))
    after = materialize(keyed.select(*by, "i", "code", w.alias("w")), "weights")
    discard(spark, before.numbers, before.categories, grads)
    return MixedWeights(after, numbers_after, before.sizes, before.hot)


def _mixed_lines(weights: MixedWeights, labels: Labels, columns: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """``feature, value, w`` of all models, without the intercepts; numbers have no value."""
    names = F.array(*[F.lit(c) for c in columns]) if columns else None
    dense = [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("string").alias("value"), F.get("v", F.lit(i)).alias("w")) for i, c in enumerate(numbers)]
    parts = [weights.numbers.select(F.inline(F.array(*dense)))] if dense else []
    if columns:
        coded = weights.categories.select(F.get(names, F.col("i")).alias("feature"), "code", "w")
        # Weights of one category by group are added before the names are joined.
        summed = coded.groupBy("feature", "code").agg(F.sum("w").alias("w"))
        texts = labels.frame.withColumnRenamed("column", "feature")
        parts.append(summed.join(texts, ["feature", "code"]).select("feature", "value", "w"))
    return reduce(DataFrame.unionByName, parts)


def _named(lines: DataFrame, models: Column) -> DataFrame:
    """Mean over models: ``feature, coef``; a feature is a column and value, and named last."""
    summed = lines.groupBy("feature", "value").agg(F.sum("w").alias("w"))
    return summed.select(feature_name(F.col("feature"), F.col("value")).alias("feature"), (F.col("w") / models).alias("coef"))


def mixed_federated_coefficients(
    df: DataFrame,
    columns: Sequence[str],
    numbers: Sequence[str],
    target: str,
    group: str,
    lr: float = 0.1,
    l2: float = 1e-4,
    epochs: int = FEDERATED_EPOCHS,
) -> DataFrame:
    """Mean coefficients of the models by group, over one-hot and numeric features: ``feature, coef``.

    A category that a group never shows has weight 0 in the model of that group.
    """
    rows, labels = _coded(df, columns, numbers, target, group)
    weights = _mixed_start(rows, labels, columns, numbers, ["g"])
    for _ in range(epochs):
        weights = _mixed_step(rows, weights, columns, numbers, ["g"], lr, l2)
    discard(df.sparkSession, rows)
    models = weights.numbers.agg(F.count(F.lit(1)).alias("n")).scalar()
    return _named(_mixed_lines(weights, labels, columns, numbers), models)


def mixed_incremental_coefficients(
    df: DataFrame,
    columns: Sequence[str],
    numbers: Sequence[str],
    target: str,
    group: str,
    lr: float = 0.1,
    l2: float = 1e-4,
    epochs: int = INCREMENTAL_EPOCHS,
) -> DataFrame:
    """Coefficients of one model that visits the groups in name order: ``feature, coef``."""
    rows, labels = _coded(df, columns, numbers, target, group)
    names = [row[0] for row in rows.select("g").distinct().orderBy("g").collect()]
    weights = _mixed_start(rows, labels, columns, numbers, [])
    for name in names:
        part = rows.where(F.col(FOLDER) == name)
        for _ in range(epochs):
            weights = _mixed_step(part, weights, columns, numbers, [], lr, l2)
    discard(df.sparkSession, rows)
    return _named(_mixed_lines(weights, labels, columns, numbers), F.lit(1))


def _stepped(state: DataFrame, grads: DataFrame, numbers: Sequence[str], n: int, l2: float) -> DataFrame:
    """Lines ``i, code, w, h, pw, pg`` with the gradient ``g`` at ``w``.

    Categories have ``i`` of zero or more; the intercept has -1 and the j-th number -2 - j.
    """
    inner = [F.struct((F.lit(-2) - j).alias("i"), F.lit(0).alias("code"), F.col(f"s{j}").alias("s")) for j in range(len(numbers))]
    dense = grads.where("i = -1").select(F.inline(F.array(F.struct("i", "code", "s"), *inner)))
    sums = grads.where("i >= 0").select("i", "code", "s").unionByName(dense)
    penalty = F.when(F.col("i") == -1, 0.0).otherwise(F.lit(l2) * F.col("w"))
    return state.join(sums, ["i", "code"], "left").withColumn("g", F.coalesce("s", F.lit(0.0)) / n + penalty).drop("s")


def mixed_global_coefficients(
    df: DataFrame,
    columns: Sequence[str],
    numbers: Sequence[str],
    target: str,
    l2: float = 1e-4,
    rounds: int = 100,
    tol: float = 1e-7,
) -> DataFrame:
    """Coefficients of one model over all rows, one-hot and numeric features: ``feature, coef``.

    Minimises the mean log loss plus ``l2 / 2`` times the squared weights, but for the
    intercept's, by quasi-Newton steps: the curvature is the diagonal of the first Hessian times
    a factor, which the last step and its change of the gradient give (Barzilai-Borwein). The
    first step divides by the number of features of a row instead, which bounds the curvature.
    Each round is one grouped sum over the coded rows; weights and gradients are a table, and
    two numbers of it come to the driver. It ends when no gradient is above ``tol``, or after
    ``rounds``. The first category of a column is dropped; a missing one has none.
    """
    spark = df.sparkSession
    rows, labels = _coded(df, columns, numbers, target, None)
    k = len(numbers)
    start = _mixed_start(rows, labels, columns, numbers, [])
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.pow(f"x{j}", F.lit(2.0))).alias(f"q{j}") for j in range(k)]).first()
    n = totals["n"]
    if not n:
        raise ValueError("no row has a target")
    # The mean of squares times a quarter is the diagonal of the Hessian where all weights are zero.
    flat = [(-1, 0, 0.25)] + [(-2 - j, 0, 0.25 * totals[f"q{j}"] / n + l2) for j in range(k)]
    dense = spark.createDataFrame(flat, "i int, code int, h double")
    lines = [F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("code")) for i in range(len(columns))]
    if columns:
        shown = rows.select(F.inline(F.array(*lines))).where("code > 0").groupBy("i", "code").agg((F.count(F.lit(1)) * (0.25 / n) + l2).alias("h"))
        dense = dense.unionByName(shown)
    zero = F.lit(0.0)
    # A constant zero has no curvature and never moves.
    state = materialize(dense.select("i", "code", zero.alias("w"), "h", zero.alias("pw"), zero.alias("pg")), "state")
    weights, written = start, [start.categories, start.numbers]
    for step in range(rounds):
        grads = _gradients(rows, weights, columns, numbers, [])
        at = materialize(_stepped(state, grads, numbers, n, l2), "state")
        moved, turned = F.col("w") - F.col("pw"), F.col("g") - F.col("pg")
        found = at.agg(F.max(F.abs("g")).alias("most"), F.sum(moved * moved * F.col("h")).alias("ss"), F.sum(moved * turned).alias("sy")).first()
        discard(spark, state, grads, *written)
        if found["most"] <= tol:
            state = at
            break
        length = found["ss"] / found["sy"] if step and found["sy"] > 0 else 1.0 / (len(columns) + k + 1)
        new = F.when(F.col("h") > 0, F.col("w") - F.lit(length) * F.col("g") / F.col("h")).otherwise(F.col("w"))
        state = materialize(at.select("i", "code", new.alias("w"), "h", F.col("w").alias("pw"), F.col("g").alias("pg")), "state")
        discard(spark, at)
        v = dict(state.where("i < 0").select("i", "w").collect())
        array = spark.range(1).select(F.array(*[F.lit(v[-2 - j]) for j in range(k)], F.lit(v[-1])).alias("v"))
        weights, written = MixedWeights(state.where("i >= 0").select("i", "code", "w"), array, start.sizes, start.hot), []
    discard(spark, rows)
    v = dict(state.where("i < 0").select("i", "w").collect())
    array = spark.range(1).select(F.array(*[F.lit(v[-2 - j]) for j in range(k)], F.lit(v[-1])).alias("v"))
    last = MixedWeights(state.where("i >= 0").select("i", "code", "w"), array, start.sizes, start.hot)
    return _named(_mixed_lines(last, labels, columns, numbers), F.lit(1))
