"""Vector algebra on array columns, JVM-side; everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _double(x: Column) -> Column:
    return x.cast("double")


def _once(value: Column, f) -> Column:
    """f(value) with the value worked out once a row: inside a lambda a column would be worked out again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: _double(x) * _double(y)), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: str | Column, b: str | Column) -> Column:
    """A distance: smaller is nearer."""
    return F.sqrt(squared_distance(a, b))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column, least: float = 1e-12) -> Column:
    """0 where either norm is below ``least``."""
    x, y = norm(a), norm(b)
    return F.when((x < least) | (y < least), 0.0).otherwise(dot(a, b) / (x * y))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine; not a metric."""
    return 1.0 - cosine(a, b)


def scale(a: str | Column, by: float | Column) -> Column:
    k = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(_c(a), lambda x: _double(x) * k)


def normalize(a: str | Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    scaled = lambda v, n: F.when(n == 0, F.transform(v, _double)).otherwise(F.transform(v, lambda x: _double(x) / n))
    return _once(_c(a), lambda v: _once(norm(v), lambda n: scaled(v, n)))


def add(a: str | Column, b: str | Column, weight: float = 1.0) -> Column:
    """a + weight * b."""
    return F.zip_with(_c(a), _c(b), lambda x, y: _double(x) + F.lit(float(weight)) * _double(y))


def blend(a: str | Column, b: str | Column, alpha: float) -> Column:
    """(1 - alpha) a + alpha b, at unit length."""
    return normalize(F.zip_with(_c(a), _c(b), lambda x, y: F.lit(1.0 - alpha) * _double(x) + F.lit(float(alpha)) * _double(y)))


def prefix(a: str | Column, m: int) -> Column:
    """The first m coordinates (nested representations)."""
    return F.slice(_c(a), 1, m)


def subspace(a: str | Column, j: int, width: int) -> Column:
    """Coordinates of subspace j of contiguous subspaces of one width."""
    return F.slice(_c(a), 1 + j * width, width)


def lift(a: str | Column, most_squared: float | Column) -> Column:
    """Append sqrt(M^2 - |a|^2): inner-product search becomes nearest-neighbour search; queries append 0."""
    m = most_squared if isinstance(most_squared, Column) else F.lit(float(most_squared))
    return F.concat(F.transform(_c(a), _double), F.array(F.sqrt(F.greatest(m - dot(a, a), F.lit(0.0)))))


def matvec(rows: list[list[float]], a: str | Column) -> Column:
    """A x for a small literal matrix."""
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])
    return F.transform(matrix, lambda row: dot(row, _c(a)))


def sign_bits(rows: list[list[float]], a: str | Column) -> Column:
    """One bit a hyperplane, 1 where the inner product is at least 0."""
    return F.transform(matvec(rows, a), lambda x: F.when(x >= 0, 1).otherwise(0))


def orthogonal_part(read: str | Column, query: str | Column) -> Column:
    """What a read vector says beyond a unit query, at unit length."""
    return normalize(_once(dot(read, query), lambda p: F.zip_with(_c(read), _c(query), lambda x, y: _double(x) - p * _double(y))))


def residual_parts(x: str | Column, approx: str | Column) -> tuple[Column, Column]:
    """Squared length of the residual x - approx along x, and across it."""
    r = F.zip_with(_c(x), _c(approx), lambda a, b: _double(a) - _double(b))
    along = F.when(dot(x, x) == 0, 0.0).otherwise(F.pow(dot(r, x), 2) / dot(x, x))
    return along, dot(r, r) - along


def anisotropic_loss(x: str | Column, approx: str | Column, eta: float) -> Column:
    """eta times the squared residual along x plus the squared residual across it."""
    along, across = residual_parts(x, approx)
    return F.lit(float(eta)) * along + across
