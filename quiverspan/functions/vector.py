"""Vector functions as Column expressions. Arithmetic is in DOUBLE; inputs may be ARRAY<FLOAT>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")
ZERO_COSINE = 2.0


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, without the root."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cos; 2 if either vector is zero. Stored norms may be given."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(ZERO_COSINE)).otherwise(1 - dot(a, b) / (na * nb))


def normalized_cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot, for unit vectors; no check for zero."""
    return 1 - dot(a, b)


def distance(metric: str, a: Column, b: Column, compat: bool = False) -> Column:
    """Lower is nearer. compat: any name but cosine means squared Euclidean."""
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "euclidean" or compat:
        return l2_squared(a, b)
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector as it is."""
    as_double, n = v.cast("array<double>"), norm(v)
    return F.when(n == 0, as_double).otherwise(F.transform(as_double, lambda x: x / n))


def quantize(v: Column, mode: str = "even") -> Column:
    """Components of [-1, 1] (others clamped) as tinyint: times 127, rounded half to even, or truncated (mode trunc)."""
    scaled = lambda x: F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127
    if mode not in ("even", "trunc"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.transform(v, lambda x: (F.rint(scaled(x)) if mode == "even" else scaled(x)).cast("tinyint"))


def dequantize(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / 127)


def quantized_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def quantized_distance(a: Column, b: Column) -> Column:
    return 1 - quantized_dot(a, b) / F.lit(16129.0)


def compress(v: Column) -> Column:
    """struct(scale, q): the largest magnitude (1 for a zero vector), and components over it times 127, half away from zero."""
    as_double = v.cast("array<double>")
    most = F.aggregate(as_double, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    scale = F.when(most == 0, F.lit(1.0)).otherwise(most)
    return F.struct(scale.alias("scale"), F.transform(as_double, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x * 127 / scale))).cast("tinyint")).alias("q"))


def decompress(c: Column) -> Column:
    return F.transform(c["q"], lambda x: x * c["scale"] / 127)


def truncate_mantissa(v: Column, bits: int) -> Column:
    """Components with the first bits of their mantissas, the rest cut towards zero, for keys of caches; bits of 0 or less,
    or 23 and more, leave float components as they are."""
    if not 0 < bits < 23:
        return v.cast("array<double>")

    def cut(x: Column) -> Column:
        unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - bits)
        scaled = x / unit
        return F.when(x == 0, x).otherwise(F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) * unit)

    return F.transform(v.cast("array<double>"), cut)
