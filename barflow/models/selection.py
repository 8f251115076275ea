"""Which features tell most of a label, from one joint histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import kept


def feature_scores(rows: DataFrame, features: list[str], label: str, bins: int = 32, least_variance: float = 1e-8) -> DataFrame:
    """
    feature, score: the mutual information (nats) of each feature and the label (A33). Features are cut into `bins` equally wide bins
    between their ends. Rows are read twice, for ends and for counts of (feature, bin, label), which are added up on every task before
    anything is shuffled. A row without the feature or the label doesn't count for it; a feature that varies no more than
    `least_variance`, or has no rows, scores 0.
    """
    known = rows.where(F.col(label).isNotNull())
    v = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    ends = known.agg(*(F.struct(F.min(v[f]).alias("lo"), F.max(v[f]).alias("hi"), (F.var_pop(v[f]) > least_variance).alias("varies")).alias(f"_{f}") for f in features))
    cut = known.crossJoin(F.broadcast(ends))  # one row
    at = lambda f: F.least(F.floor((v[f] - F.col(f"_{f}.lo")) / (F.col(f"_{f}.hi") - F.col(f"_{f}.lo")) * bins), F.lit(bins - 1))
    each = [F.struct(F.lit(f).alias("feature"), F.when(F.col(f"_{f}.varies"), at(f)).alias("bin")) for f in features]
    counts = cut.select(F.col(label).alias("label"), F.explode(F.array(*each)).alias("x")).where("x.bin IS NOT NULL").groupBy("x.feature", "x.bin", "label").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    joint = counts.withColumns({"all": over(), "of_bin": over("bin"), "of_label": over("label")})  # a row for each bin and label
    score = joint.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("of_bin") * F.col("of_label")))).alias("score"))
    names = rows.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(score, "feature", "left").withColumn("score", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """Adds rank (1: the highest score, of equals the smaller name) and chosen: the first k. A row a feature."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "feature"))
    return scores.withColumn("rank", rank.cast("long")).withColumn("chosen", F.col("rank") <= k)


def select_features(rows: DataFrame, features: list[str], label: str, k: int, bins: int = 32) -> list[str]:
    """The k features that tell most, for a pipeline that is fitted on the same rows (a training fold)."""
    return [r.feature for r in kept(top_features(feature_scores(rows, features, label, bins), k)).where("chosen").orderBy("rank").collect()]
