"""Models of labels: candidates, out-of-fold scores, calibration, walk-forward fits, holdout. Spark ML does the fitting."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import kept

SEED = 42


def candidates(n_features: int) -> dict[str, Callable[[], Estimator]]:
    """Name to a fresh estimator."""
    common = {"featuresCol": "features", "labelCol": "y", "seed": SEED}
    return {
        "logreg": lambda: LogisticRegression(featuresCol="features", labelCol="y", regParam=0.01),
        "forest": lambda: RandomForestClassifier(**common, numTrees=30, maxDepth=6),
        "boosted": lambda: GBTClassifier(**common, maxIter=15, maxDepth=3),
        "perceptron": lambda: MultilayerPerceptronClassifier(**common, layers=[n_features, 8, 2], maxIter=50),
    }


def chosen(names: str, n_features: int) -> dict[str, Callable[[], Estimator]]:
    """The candidates of a comma-separated list; an unknown name is an error."""
    known = candidates(n_features)
    wanted = [n.strip() for n in names.split(",") if n.strip()] or list(known)
    if unknown := [n for n in wanted if n not in known]:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    return {n: known[n] for n in wanted}


def search_space(name: str, estimator: Estimator) -> list[dict]:
    grid = ParamGridBuilder()
    if name == "logreg":
        grid = grid.addGrid(estimator.regParam, [0.001, 0.01, 0.1])
    elif name == "forest":
        grid = grid.addGrid(estimator.maxDepth, [4, 6]).addGrid(estimator.numTrees, [20, 50])
    elif name == "boosted":
        grid = grid.addGrid(estimator.maxDepth, [2, 3]).addGrid(estimator.stepSize, [0.05, 0.1])
    return grid.build()


def preparation(features: list[str], select: bool = True) -> list:
    """Features to one vector, without those that hardly vary, standardised."""
    steps = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep")]
    if select:
        steps.append(VarianceThresholdSelector(featuresCol="_raw", outputCol="_varied", varianceThreshold=1e-8))
    return [*steps, StandardScaler(inputCol="_varied" if select else "_raw", outputCol="features", withMean=True)]


def pipeline(features: list[str], estimator: Estimator, select: bool = True) -> Pipeline:
    """The preparation of features and the model."""
    return Pipeline(stages=[*preparation(features, select), estimator])


def positive(c: str = "probability") -> Column:
    return vector_to_array(c)[1]


def score(model: Model | None, rows: DataFrame, name: str = "p", history: Column | None = None, least: int = 0) -> DataFrame:
    """Adds the probability of 1; 0.5 without a model, or where `history` has fewer than `least` rows."""
    if model is None:
        return rows.withColumn(name, F.lit(0.5))
    out = model.transform(rows).select(*rows.columns, positive().alias(name))
    return out if history is None else out.withColumn(name, F.when(history >= least, F.col(name)).otherwise(0.5))


def out_of_fold(splits: DataFrame, features: list[str], models: dict[str, Callable[[], Estimator]], keep: list[str]) -> DataFrame:
    """
    splits: split, role (train, test), y, features and `keep`, one row for each split that a row is in. Returns model, split, keep, y, p
    for the test rows (T26). The driver goes over splits and models, whose numbers are parameters; each fit is a Spark job.
    """
    rows = kept(splits.fillna(0.0, features))
    out = []
    for s in sorted(r.split for r in rows.select("split").distinct().collect()):  # as many as there are folds
        train, test = (rows.where((F.col("split") == s) & (F.col("role") == r)) for r in ("train", "test"))
        if train.select("y").distinct().count() < 2:
            out += [score(None, test).select(F.lit(n).alias("model"), "split", *keep, "y", "p") for n in models]
            continue
        for name, make in models.items():
            fitted = pipeline(features, make(), select=name != "perceptron").fit(train)
            out.append(score(fitted, test).select(F.lit(name).alias("model"), "split", *keep, "y", "p"))
    return reduce(DataFrame.unionByName, out)


def searched(splits: DataFrame, features: list[str], models: dict[str, Callable[[], Estimator]], space: Callable[[str, Estimator], list[dict]] = search_space, at_once: int = 4) -> DataFrame:
    """
    Each model with each of its parameter sets on each split (role: train, test): model, params (JSON), split, n, log_loss of its test rows;
    mean_loss over the test rows of all splits, and best, whether no parameter set of the model has a lower one (of equal ones the first in
    the space) (T27, X3). A split with one class in training scores 0.5.

    Features are prepared once a split and stored; `at_once` fits run at a time, each of them Spark jobs over the training rows. The driver
    holds one line a fit, and there are as many fits as models, sets and splits, all of them parameters.
    """
    rows = kept(splits.fillna(0.0, features))
    session = rows.sparkSession
    classes = {r.split: r.n for r in rows.groupBy("split").agg(F.countDistinct(F.when(F.col("role") == "train", F.col("y"))).alias("n")).collect()}  # one row a split
    stored = {}
    for split in (s for s, n in classes.items() if n > 1):
        of = rows.where(F.col("split") == split)
        for select in {name != "perceptron" for name in models}:
            ready = Pipeline(stages=preparation(features, select)).fit(of.where("role = 'train'")).transform(of)
            stored[split, select] = kept(ready.select("role", "y", "features"))

    def fit(task: tuple[str, int, dict, int]) -> tuple:
        name, order, given, split = task
        values = {p.name: v for p, v in given.items()}
        if classes[split] > 1:
            own = stored[split, name != "perceptron"]
            estimator = models[name]()
            fitted = estimator.copy({estimator.getParam(k): v for k, v in values.items()}).fit(own.where("role = 'train'"))
            scored = score(fitted, own.where("role = 'test'"))
        else:
            scored = score(None, rows.where((F.col("split") == split) & (F.col("role") == "test")))
        n, loss = scored.agg(F.count("*"), log_loss()).first()
        return name, order, json.dumps(values, sort_keys=True), split, n, loss

    tasks = [(name, k, given, split) for name, make in models.items() for k, given in enumerate(space(name, make()) or [{}]) for split in sorted(classes)]
    with ThreadPool(at_once) as pool:
        out = pool.map(inheritable_thread_target(session)(fit), tasks, chunksize=1)
    found = session.createDataFrame(out, "model string, _order int, params string, split long, n long, log_loss double")
    w = Window.partitionBy("model", "_order")
    mean = F.sum(F.col("n") * F.coalesce("log_loss", F.lit(0.0))).over(w) / F.sum("n").over(w)
    ranked = found.withColumn("mean_loss", mean).withColumn("_rank", F.dense_rank().over(Window.partitionBy("model").orderBy(F.asc_nulls_last("mean_loss"), "_order")))
    return ranked.withColumn("best", F.col("_rank") == 1).drop("_order", "_rank")


def log_loss(y: str = "y", p: str = "p", clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def platt(scored: DataFrame, y: str = "y", p: str = "p") -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a p + b))), fitted by one-feature logistic regression."""
    rows = VectorAssembler(inputCols=[p], outputCol="features").transform(scored.select(F.col(y).cast("double").alias(y), p))
    fitted = LogisticRegression(labelCol=y).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def calibrated(p: Column, a: float, b: float) -> Column:
    q = 1 / (1 + F.exp(-(a * p + b)))
    return F.least(F.greatest(q, F.lit(1e-9)), F.lit(1 - 1e-9))


def ridge_moments(rows: DataFrame, features: list[str], y: str, by: list[str]) -> DataFrame:
    """For each key the sums that a ridge fit needs: n, sums and products of features and target."""
    cols = [*features, y]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in cols)).alias("s"), F.array(*(F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs)).alias("q"))


def walk_forward(rows: DataFrame, features: list[str], y: str, by: list[str], first: int = 1000, every: int = 100, buffer: int = 8000, ridge: float = 1.0) -> DataFrame:
    """
    rows: by, rn (from 1), features, y. Refits a ridge regression after `first` rows and then every `every`, on the last `buffer` rows,
    and scores the rows up to the next fit (T37). Adds prediction (0 before the first fit).

    Rows are summed once for each block of `every`; a fit adds the blocks of its buffer, so rows are neither copied nor read again.
    """
    f = len(features)
    size = f + 1
    rows = rows.withColumn("_block", F.expr(f"(rn - 1) div {every}"))
    blocks = ridge_moments(rows.fillna(0.0, [*features, y]), features, y, [*by, "_block"])
    w = Window.partitionBy(*by).orderBy("_block").rowsBetween(-(buffer // every), -1)
    cells = size + size * (size + 1) // 2
    flat = blocks.select(*by, "_block", "n", F.concat("s", "q").alias("_m"))
    sums = flat.select(*by, "_block", F.sum("n").over(w).alias("n"), F.array(*(F.sum(F.col("_m")[i]).over(w) for i in range(cells))).alias("_m"))  # one row for each `every` rows
    sums = sums.where(F.col("_block") * every >= first)

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        upper = np.triu_indices(size)
        for k, v in zip(n, m, strict=True):
            v = np.asarray(v, float)
            mean, full = v[:size] / k, np.zeros((size, size))
            full[upper] = v[size:]
            full = (np.triu(full) + np.triu(full, 1).T) / k - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(full)[:f], 0))
            sd = np.where(sd > 1e-12, sd, 1.0)
            weights = np.linalg.solve(full[:f, :f] / np.outer(sd, sd) * k + ridge * np.eye(f), full[:f, f] / sd * k) / sd
            out.append([*weights.tolist(), float(mean[f] - weights @ mean[:f])])
        return pd.Series(out)

    fits = sums.select(*by, "_block", solve("n", "_m").alias("_w"))
    scored = rows.join(fits, [*by, "_block"], "left")
    value = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) * F.col("_w")[i] for i, c in enumerate(features)), F.col("_w")[f])
    return scored.withColumn("prediction", F.coalesce(value, F.lit(0.0))).drop("_block", "_w")


def holdout(rows: DataFrame, decide: Callable[[DataFrame], DataFrame], n_seen: int, n_held: int, floors: dict[str, float]) -> DataFrame:
    """
    rows: instrument, rn and what `decide` needs. Trades of the last n_held rows after the first n_seen, their summary, reasons
    against, and the verdict (T29, P18). decide: rows to closed trades with realized_r and ts_out_ms.
    """
    from ..functions.stats import deflated_sharpe
    from ..operators.ledger import curve, rollup_columns, sharpe

    last = rows.groupBy("instrument").agg(F.max("rn").alias("_last"))
    held = rows.join(F.broadcast(last), "instrument").where((F.col("rn") > n_seen) & (F.col("rn") > F.col("_last") - n_held)).drop("_last")
    trades = kept(decide(held).withColumn("_id", F.xxhash64(F.struct("*"))))
    worst = curve(trades, ["instrument"], ["_id"], start=1.0).groupBy("instrument").agg((F.max(F.col("drawdown") / F.col("peak")) * 1e4).alias("max_dd_bp"))
    out = trades.groupBy("instrument").agg(*rollup_columns(), sharpe().alias("sharpe")).join(worst, "instrument")
    out = out.withColumn("dsr", deflated_sharpe(F.col("sharpe"), F.col("n_trades"), F.lit(1)))
    reasons = F.array_compact(F.array(F.when(F.col("n_trades") < floors["n_trades"], "too few trades"), F.when(F.col("dsr") < floors["dsr"], "deflated Sharpe ratio too low"), F.when(F.col("max_dd_bp") > floors["max_dd_bp"], "drawdown too large")))
    return out.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
