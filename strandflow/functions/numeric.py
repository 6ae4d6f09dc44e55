"""Column functions over probabilities and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest normal 32-bit float, and what stands for the log of zero.
TINY, LOG_ZERO = 1.1754943508222875e-38, -1000.0


def safe_log(x: Column) -> Column:
    return F.when(x == 0, F.lit(LOG_ZERO)).otherwise(F.log(F.greatest(x, F.lit(TINY))))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / _sum(e))


def as_probabilities(rows: Column, slack: float = 1e-6, drift: float = 1e-3) -> Column:
    """A window's rows as probabilities: accepted, clamped and rescaled if no value is below
    -slack and the rows' sums are 1 to within ``drift`` on average, else soft-maxed. The
    test is made over the window, not over a whole batch, so results don't depend on batching."""
    low = F.array_min(F.transform(rows, F.array_min))
    off = _sum(F.transform(rows, lambda r: F.abs(_sum(r) - 1))) / F.size(rows)

    def rescaled(r):
        clamped = F.transform(r, lambda x: F.greatest(x, F.lit(0.0)))
        return F.transform(clamped, lambda x: x / F.greatest(_sum(clamped), F.lit(TINY)))

    return F.when((low >= -slack) & (off < drift), F.transform(rows, rescaled)).otherwise(F.transform(rows, softmax))


def first_argmax(xs: Column) -> Column:
    """Index from 0 of the largest value, the first of equals."""
    return F.array_position(xs, F.array_max(xs)).cast("long") - 1


def adaptive_core(length: Column, chunk: int = 640_000, factor: int = 1, overlap: int = 0, upper_only: bool = True) -> Column:
    """The core window size that a sequence of this length gets: the chunk for long ones,
    else at least 2 * overlap + 1 and 2 * factor, rounded up to the model's divisor."""
    import math

    divisor = 512 * factor if upper_only else 18 * factor // math.gcd(18, factor)
    n = F.when(length <= 2 * overlap, F.lit(min(2 * overlap + 1, chunk))).otherwise(length)
    n = F.greatest(n, F.lit(2 * factor))
    return F.when(length >= chunk, F.lit(chunk)).otherwise(F.ceil(n / divisor) * divisor).cast("long")


def window_cost(length: Column, core: Column, flank: int = 0, strands: int = 1) -> Column:
    """Bases the model reads for a sequence."""
    return (F.greatest(F.lit(1), F.ceil(length / core)) * (core + 2 * flank) * strands).cast("long")


def compact_length(core: Column, flank: int, align: int, model: int, bucket: int = 4096) -> Column:
    """A short window's model length, rounded up to a multiple of both bucket and alignment."""
    import math

    step = math.lcm(bucket, align)
    return F.least(F.lit(model), F.ceil((core + 2 * flank) / step) * step).cast("long")


def parallel_factor(model: Column, core: Column, most: int = 100) -> Column:
    """The largest factor that divides the model length with whole 512-blocks of core, else
    the largest that divides the model length."""
    divides = F.filter(F.sequence(F.lit(1), F.least(F.lit(most), model.cast("int"))), lambda f: model % f == 0)
    whole = F.filter(divides, lambda f: core % (f * 512) == 0)
    return F.coalesce(F.array_max(whole), F.array_max(divides), F.lit(1)).cast("long")
