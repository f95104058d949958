"""Vector functions as unrolled columns, which whole-stage code generation compiles; array lambdas run several times slower."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearscore.functions.config import DIM_ORDER, DIMS, SCALE
from nearscore.functions.scalars import num, total


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def l2_squared(a: Column, b: Column, dims: int = DIMS) -> Column:
    """Squared distance in doubles."""
    d = [at(a, i).cast("double") - at(b, i).cast("double") for i in range(dims)]
    return total([x * x for x in d])


def l2_squared_int(a: Column, b: Column, dims: int = DIMS, first: int | None = None) -> Column:
    """Squared distance of quantised vectors, exact; over the first dimensions only if so asked, a bound from below."""
    d = [at(a, i).cast("long") - at(b, i).cast("long") for i in range(first or dims)]
    return total([x * x for x in d])


def dot(a: Column, b: Column, dims: int = DIMS) -> Column:
    return total([at(a, i).cast("double") * at(b, i).cast("double") for i in range(dims)])


def bbox_lower_bound(q: Column, lo: Column, hi: Column, dims: int = DIMS) -> Column:
    """Squared distance from q to the box: no member of the cluster is nearer."""
    d = [F.greatest(at(lo, i).cast("long") - at(q, i).cast("long"), F.lit(0).cast("long"), at(q, i).cast("long") - at(hi, i).cast("long")) for i in range(dims)]
    return total([x * x for x in d])


def _int16(x: Column) -> Column:
    return F.least(F.greatest(x, num(-32768)), num(32767)).cast("smallint")


def quantize_query(v: Column, scale: int = SCALE) -> Column:
    """Rounded, halves away from zero."""
    return F.transform(v, lambda x: _int16(F.round(x.cast("double") * num(scale))))


def quantize_reference(v: Column, scale: int = SCALE) -> Column:
    """Cut off towards zero, as indexes hold them."""
    return F.transform(v, lambda x: _int16(x.cast("double") * num(scale)))


def permute(v: Column, order: tuple[int, ...] = DIM_ORDER) -> Column:
    """From a file's order to the engine's."""
    return F.array(*(at(v, i) for i in order))


def fitted(v: Column, dims: int = DIMS) -> Column:
    """Exactly dims values: more are cut off, missing ones are 0."""
    return F.array(*(F.coalesce(at(v, i), F.lit(0).cast("float")) for i in range(dims)))


def padded(v: Column, dims: int = 16) -> Column:
    """With zeros up to dims values; they add nothing to a distance."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0).cast("float"), dims)), 1, dims)
