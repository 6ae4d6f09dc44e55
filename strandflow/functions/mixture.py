"""Log densities of normal mixtures over vectors, as column expressions.

Parameters are small and known when the plan is made, so they stand in it as constants."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is added to scales so that none is zero, by the positive transform and by the mixture.
LEAST_SCALE, SLACK = 1e-5, 1e-8


def scales(raw, base_variance: float = 1.0) -> np.ndarray:
    """Unbounded parameters as positive scales; zero becomes the square root of the base variance."""
    shift = math.log(math.expm1(math.sqrt(base_variance)))
    return np.logaddexp(0, np.asarray(raw, float) + shift) + LEAST_SCALE


def triangle(raw, dim: int, base_variance: float = 1.0) -> np.ndarray:
    """A lower triangular scale matrix from its rows one after the other, the diagonal made positive."""
    raw = np.asarray(raw, float)
    if raw.shape != (dim * (dim + 1) // 2,):
        raise ValueError(f"a triangle of {dim} rows has {dim * (dim + 1) // 2} values")
    out = np.zeros((dim, dim))
    out[np.tril_indices(dim)] = raw
    np.fill_diagonal(out, scales(np.diag(out), base_variance))
    return out


def _vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def component_log_pdf(x: Column, mean, scale) -> Column:
    """Log density of one normal at the vector x. scale: a vector of standard deviations, or a lower
    triangular matrix (its product with its transpose is the covariance). A null vector has none; one of
    another length than the mean is an error."""
    mean, scale = np.asarray(mean, float), np.asarray(scale, float)
    off = F.zip_with(x, _vector(mean), lambda a, m: a.cast("double") - m)
    if scale.ndim == 1:
        scale = scale + SLACK
        z, diagonal = F.zip_with(off, _vector(1 / scale), lambda a, s: a * s), scale
    else:
        inverse = F.array(*[_vector(row) for row in np.linalg.inv(scale)])
        z, diagonal = F.transform(inverse, lambda row: _total(F.zip_with(row, off, lambda s, a: s * a))), np.diag(scale)
    constant = len(mean) * math.log(2 * math.pi) + 2 * float(np.log(diagonal).sum())
    density = -0.5 * (F.lit(constant) + _total(F.transform(z, lambda v: v * v)))
    wrong = F.raise_error(F.lit(f"a vector has not {len(mean)} values"))
    return F.when(x.isNull(), F.lit(None)).when(F.size(x) == len(mean), density).otherwise(wrong)


def mixture_log_pdf(x: Column, logits, means, scale) -> Column:
    """Log density of a mixture at x; its weights are the soft-maxed logits. One component needs no weight."""
    parts = [component_log_pdf(x, m, s) for m, s in zip(means, scale, strict=True)]
    if len(parts) == 1:
        return parts[0]
    logits = np.asarray(logits, float)
    weights = logits - logits.max()
    weights = weights - np.log(np.exp(weights).sum())
    terms = F.array(*[p + float(w) for p, w in zip(parts, weights, strict=True)])
    top = F.array_max(terms)
    return top + F.log(_total(F.transform(terms, lambda t: F.exp(t - top))))


def expectation(logits, means) -> np.ndarray:
    """The mean of a mixture."""
    logits = np.asarray(logits, float)
    weights = np.exp(logits - logits.max())
    return (weights / weights.sum()) @ np.asarray(means, float)


def scale_penalty(raw) -> float:
    """The mean over components of the sum of the squared raw scale parameters."""
    return float(np.mean(np.sum(np.square(np.asarray(raw, float)), axis=-1)))
