"""Vector arithmetic as Column expressions; every result follows one order of additions and so is exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_norm(v: Column | str) -> Column:
    """Sum of squares in double precision, in index order; null for a null array or with a null component."""
    return F.aggregate(_column(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2_norm(v: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(squared_norm(v))


def normalize_l2(v: Column | str) -> Column:
    """The vector at length 1 as FLOATs; null for a vector that :func:`vector_error` rejects."""
    scaled = F.transform(_column(v), lambda x: (x.cast("double") * (F.lit(1.0) / l2_norm(v))).cast("float"))
    return F.when(has_direction(v), scaled)


def dot_product(a: Column | str, b: Column | str) -> Column:
    """Dot product summed in double precision in index order, as FLOAT; null for unequal lengths or null components."""
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(_column(a)) == F.size(_column(b)), F.aggregate(products, F.lit(0.0), lambda s, x: s + x).cast("float"))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Dot product of both vectors at length 1."""
    return dot_product(normalize_l2(a), normalize_l2(b))


def all_finite(v: Column | str) -> Column:
    """No component is null, NaN or infinite; true for an empty array, null for a null one."""
    return F.forall(_column(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITE))


def has_direction(v: Column | str) -> Column:
    """Finite and not all zero; false for a null or empty array."""
    return F.coalesce(all_finite(v) & F.exists(_column(v), lambda x: x != 0), F.lit(False))


def has_dimension(v: Column | str, dimension: int) -> Column:
    """Exactly ``dimension`` components; false for a null array."""
    return F.coalesce(F.size(_column(v)) == dimension, F.lit(False)) & _column(v).isNotNull()


def is_unit(v: Column | str, tolerance: float = 1e-3) -> Column:
    """The squared length differs from 1 by at most ``tolerance``; false for null arrays and components."""
    return F.coalesce(F.abs(squared_norm(v) - 1) <= tolerance, F.lit(False))


def vector_error(v: Column | str, dimension: int) -> Column:
    """The first rule a vector breaks, in the order of checks, or null: dimension, finite, zero."""
    rules = [(~has_dimension(v, dimension), "dimension"), (~F.coalesce(all_finite(v), F.lit(False)), "not finite"), (~has_direction(v), "zero")]
    return reduce(lambda chain, rule: chain.when(*rule) if chain is not None else F.when(*rule), rules, None)
