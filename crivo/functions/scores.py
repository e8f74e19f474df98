"""Score and number expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def sigmoid(x: Column, clip: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    """Probability of class 1 of a two-class softmax."""
    return 1 / (1 + F.exp(logit0 - logit1))


def predict_at(score: Column, threshold) -> Column:
    """1 where the score reaches the threshold."""
    return (score >= threshold).cast("int")


def argmax2(logit0: Column, logit1: Column) -> Column:
    """Class with the larger logit; a tie is class 0."""
    return (logit1 > logit0).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, 0 where the denominator is 0 or NULL."""
    den = den.cast("double")
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    """100 * num / den, rounded half to even; 0 for an empty base."""
    den = den.cast("double")
    return F.bround(F.when(den != 0, 100 * num.cast("double") / den).otherwise(F.lit(0.0)), digits)


def hash_number(*parts, digits: int = 15) -> Column:
    """Non-negative BIGINT from the first hex digits of md5 over the parts joined by ':'."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


SMALL_MEAN = 50.0  # expected count up to which a binomial draw adds up its distribution
MOST_TERMS = 200  # terms of that sum; the rest of the distribution is below 1e-50


def uniforms(*parts) -> tuple[Column, Column]:
    """Two numbers strictly between 0 and 1, from 26 hex digits of md5 over the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return tuple((F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for at in (1, 14))


def binomial_draw(n: Column, share: Column, u: Column, u2: Column) -> Column:
    """How many of `n` fall to a side with probability `share`, as the quantile of the uniform numbers u and u2.

    With up to SMALL_MEAN expected on the rarer side the distribution is added up term by term; above it the normal
    approximation is rounded (its standard deviation is over 5 then).
    """
    rare = F.least(share, 1 - share)
    start = F.struct(
        F.pow(1 - rare, n.cast("double")).alias("p"), F.lit(0.0).alias("c"), F.lit(0).cast("bigint").alias("j"),
        n.cast("double").alias("n"), (rare / (1 - rare)).alias("odds"), u.alias("u"),
    )  # the values travel with the sum: a column inside the lambda would be computed once per term

    def step(a, i):
        c = a["c"] + a["p"]
        return F.struct(
            (a["p"] * (a["n"] - i) / (i + 1) * a["odds"]).alias("p"), c.alias("c"), (a["j"] + (c < a["u"]).cast("bigint")).alias("j"),
            a["n"].alias("n"), a["odds"].alias("odds"), a["u"].alias("u"),
        )

    summed = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(n, F.lit(MOST_TERMS))), start, step, lambda a: F.least(a["j"], a["n"].cast("bigint")))
    normal = n * rare + F.sqrt(n * rare * (1 - rare)) * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * u2)
    drawn = F.when(n * rare > SMALL_MEAN, F.greatest(F.least(F.round(normal).cast("bigint"), n), F.lit(0))).otherwise(summed)
    return F.when(share > 0.5, n - drawn).otherwise(drawn)


def l2_normalize(vec: Column) -> Column:
    """Unit-length copy of an array; a zero vector stays zero."""
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # Repeating the norm computes it once per row; inside the lambda it would be computed per element.
    return F.zip_with(v, F.array_repeat(norm, F.size(vec)), lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0)))
