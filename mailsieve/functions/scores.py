"""Column maths on probabilities and logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.text import _as_col


def two_class_probs(p: Column | str) -> Column:
    p = _as_col(p)
    return F.struct((1 - p).alias("p_legit"), p.alias("p_phish"))


def normalize_probs(p_legit: Column | str, p_phish: Column | str) -> Column:
    """Divide by the row sum; a zero sum divides by one."""
    a, b = _as_col(p_legit), _as_col(p_phish)
    total = F.when(a + b == 0, F.lit(1.0)).otherwise(a + b)
    return F.struct((a / total).alias("p_legit"), (b / total).alias("p_phish"))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_as_col(x)))


def softmax_phish(l0: Column | str, l1: Column | str) -> Column:
    """Softmax probability of class 1, shifted by the larger logit."""
    a, b = _as_col(l0), _as_col(l1)
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))


def argmax_label(l0: Column | str, l1: Column | str) -> Column:
    """The larger class; a tie is class 0."""
    return (_as_col(l1) > _as_col(l0)).cast("int")


def label_at_least(p: Column | str, threshold: Column | float = 0.5) -> Column:
    return (_as_col(p) >= threshold).cast("int")


def label_above(p: Column | str, threshold: Column | float = 0.5) -> Column:
    return (_as_col(p) > threshold).cast("int")


def confidence_max(p: Column | str) -> Column:
    p = _as_col(p)
    return F.greatest(p, 1 - p)


def confidence_of(p: Column | str, pred: Column | str) -> Column:
    """Probability of the class that was predicted."""
    p = _as_col(p)
    return F.when(_as_col(pred) == 1, p).otherwise(1 - p)


def score_adjustment(legitimacy: Column | str, suspicion: Column | str) -> Column:
    """-0.1 or +0.1 when one score leads the other by more than two."""
    legit, susp = _as_col(legitimacy), _as_col(suspicion)
    return (
        F.when(legit > susp + 2, F.lit(-0.1)).when(susp > legit + 2, F.lit(0.1)).otherwise(F.lit(0.0))
    )


def adjusted_prob(p: Column | str, legitimacy: Column | str, suspicion: Column | str) -> Column:
    shifted = _as_col(p) + score_adjustment(legitimacy, suspicion)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), shifted))
