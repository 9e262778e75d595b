"""Per-token scoring expressions over stored logits (``array<double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import let

IGNORE_INDEX = -100


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def log_sum_exp(logits) -> Column:
    """Numerically stable ``log(sum(exp(x)))``. The maximum is bound once:
    written into the inner function, it would be taken anew for each logit."""
    return let(_c(logits).cast("array<double>"), lambda l: let(F.array_max(l), lambda m: m + F.log(
        F.aggregate(l, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))))


def scorable(logits, label) -> Column:
    """Whether a position can be scored: a label that is not ignored and lies
    within logits that are all there."""
    l, y = _c(logits), _c(label)
    return F.coalesce((y != IGNORE_INDEX) & (y >= 0) & (y < F.size(l)) & ~F.exists(l, lambda x: x.isNull()), F.lit(False))


def log_norm(logits) -> Column:
    """The log-sum-exp of a row of logits; NULL where the row or one of its logits
    is missing, so that no label can be scored. It is the same for every label."""
    return let(_c(logits).cast("array<double>"), lambda l: F.when(~F.exists(l, lambda x: x.isNull()), log_sum_exp(l)))


def nll_of_norm(logits, label, norm) -> Column:
    """:func:`nll` where the row's :func:`log_norm` is at hand: one look into the
    logits (``array<double>``), whatever their number."""
    l, y = _c(logits), _c(label)
    return F.when((y != IGNORE_INDEX) & (y >= 0) & (y < F.size(l)), _c(norm) - F.try_element_at(l, (y + 1).cast("int")))


def losses(logits, label, smoothing: float = 0.0) -> Column:
    """Struct ``(nll, nll_smoothed)`` with one log-sum-exp for both; NULL where
    the position can't be scored. See :func:`nll`."""
    y = _c(label)

    def of(l):
        def both(lse):
            plain = lse - F.try_element_at(l, (y + 1).cast("int"))
            uniform = lse - F.aggregate(l, F.lit(0.0), lambda acc, x: acc + x) / F.size(l)
            return F.struct(plain.alias("nll"), ((1.0 - smoothing) * plain + smoothing * uniform).alias("nll_smoothed"))

        return F.when(scorable(l, y), let(log_sum_exp(l), both))

    return let(_c(logits).cast("array<double>"), of)


def nll(logits, label, smoothing: float = 0.0) -> Column:
    """Cross-entropy of ``label`` under ``logits`` (natural log). Ignored
    labels (-100) and labels outside the logits give NULL.

    With ``smoothing`` e > 0: ``(1 - e) * nll + e * mean_v(-log p_v)``, the
    published label-smoothing loss."""
    return losses(logits, label, smoothing)["nll_smoothed" if smoothing else "nll"]


def argmax(logits) -> Column:
    """0-based position of the first maximum."""
    l = _c(logits)
    return F.array_position(l, F.array_max(l)).cast("int") - 1


def perplexity(loss, cap: float | None = None) -> Column:
    """``exp(loss)``; with ``cap``, ``+inf`` once ``loss >= cap``. Overflow
    gives ``+inf`` (no error)."""
    x = _c(loss).cast("double")
    p = F.exp(x)
    if cap is not None:
        p = F.when(x < cap, p).when(x.isNotNull(), F.lit(float("inf")))
    return p


def mask_label(label, pad_id) -> Column:
    """Labels equal to the pad id become -100 (by value, so a real token equal
    to the pad id is masked too)."""
    y = _c(label)
    return F.when(y == F.lit(pad_id), F.lit(IGNORE_INDEX)).otherwise(y)
