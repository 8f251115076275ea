"""Column expressions: normal distribution, deflated Sharpe ratio, classifier scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Abramowitz and Stegun 7.1.26, and Acklam's rational approximation of the inverse.
ERF_P = 0.3275911
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
LOW = 0.02425
EULER = 0.5772156649015329


def let(value: Column, body) -> Column:
    """body(value), where `value` is worked out once however often `body` names it; long formulas stay small enough to be compiled."""
    return F.transform(F.array(value), body)[0]


def horner(coefficients, x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def norm_cdf(x: Column) -> Column:
    def of(x: Column) -> Column:
        z = F.abs(x) / F.sqrt(F.lit(2.0))
        upper = let(1 / (1 + ERF_P * z), lambda t: horner(ERF[::-1], t) * t) * F.exp(-z * z) / 2
        return F.when(x >= 0, 1 - upper).otherwise(upper)

    return let(x, of)


def norm_ppf(p: Column) -> Column:
    """Inverse of the normal distribution for 0 < p < 1."""
    def tail(q: Column) -> Column:
        return horner(PPF_C, q) / (horner(PPF_D, q) * q + 1)

    def of(p: Column) -> Column:
        far = let(F.sqrt(-2 * F.log(F.least(p, 1 - p))), tail)
        middle = let((p - 0.5) * (p - 0.5), lambda r: horner(PPF_A, r) / (horner(PPF_B, r) * r + 1)) * (p - 0.5)
        return F.when(p < LOW, far).when(p > 1 - LOW, -far).otherwise(middle)

    return let(p, of)


def deflated_sharpe(sr: Column, n: Column, trials: Column, skew: Column | float = 0.0, kurt: Column | float = 3.0) -> Column:
    """Probability that a Sharpe ratio (per period, over n periods) is above what the best of `trials` skilless ones shows; 0 for n < 2, without trials, or where the ratio's variance isn't positive."""
    k = F.greatest(trials.cast("double"), F.lit(2.0))
    top = (1 - EULER) * norm_ppf(1 - 1 / k) + EULER * norm_ppf(1 - 1 / (k * F.exp(F.lit(1.0))))
    expected = F.when(trials <= 1, 0.0).otherwise(top)  # in standard deviations
    variance = (1 - skew * sr + (kurt - 1) / 4 * sr * sr) / F.nullif(n - 1, F.lit(0))
    return let(variance, lambda v: F.when((n < 2) | (trials < 1) | (v <= 0), 0.0).otherwise(norm_cdf(sr / F.sqrt(F.when(v > 0, v)) - expected)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(*logits: Column) -> Column:
    """An array of shares that add up to 1, the largest logit taken off first."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    each = [F.exp(x - top) for x in logits]
    total = sum(each[1:], each[0])
    return F.array(*(e / total for e in each))


def _horner_sql(coefficients, x: str) -> str:
    out = repr(float(coefficients[0])) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    """norm_cdf as SQL text, for the oracles."""
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1 / (1 + {ERF_P} * {z}))"
    half = f"({_horner_sql(ERF[::-1], t)} * {t} * exp(-{z} * {z}) / 2)"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {half} ELSE {half} END)"


def ppf_sql(p: str) -> str:
    """norm_ppf as SQL text, for the oracles."""
    r, q = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    tail = f"{_horner_sql(PPF_C, q)} / ({_horner_sql(PPF_D, q)} * {q} + 1)"
    return f"(CASE WHEN least({p}, 1 - {p}) >= {LOW} THEN {_horner_sql(PPF_A, r)} * ({p} - 0.5) / ({_horner_sql(PPF_B, r)} * {r} + 1) WHEN {p} < 0.5 THEN {tail} ELSE -({tail}) END)"


def auc(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """
    Area under the curve per key, 0.5 where only one class is present. Counts per score are ranked, not rows, and scores are cut
    into slices by their first digits, so no window holds a key's rows together.
    """
    counts = df.groupBy(*by, F.floor(F.col(p) * 1024).alias("_cut"), p).agg(F.sum(y).alias("_pos"), (F.count("*") - F.sum(y)).alias("_neg"))
    below = F.sum("_neg").over(Window.partitionBy(*by).orderBy("_cut")) - F.col("_neg")
    cuts = counts.groupBy(*by, "_cut").agg(F.sum("_neg").alias("_neg")).withColumn("_below", below).select(*by, "_cut", "_below")
    inner = F.sum("_neg").over(Window.partitionBy(*by, "_cut").orderBy(p)) - F.col("_neg")
    won = (F.col("_below") + F.col("_in") + F.col("_neg") / 2) * F.col("_pos")
    rows = counts.withColumn("_in", inner).join(cuts, [*by, "_cut"])
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return rows.groupBy(*by).agg(F.when(pairs > 0, F.sum(won) / pairs).otherwise(0.5).alias("auc"))


def log_loss(y: Column, p: Column, floor: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def balanced_accuracy(y: Column, p: Column, cut: float = 0.5) -> Column:
    right = F.when(p >= cut, 1).otherwise(0) == y
    share = lambda c: F.coalesce(F.avg(F.when(y == c, right.cast("double"))), F.lit(0.5))
    return (share(0) + share(1)) / 2
