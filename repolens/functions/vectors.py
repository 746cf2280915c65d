"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is null or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def valid_vector(v: Column, dimensions: int) -> Column:
    """Right length, and every component there and finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))


def pseudo_embedding(text: Column, dimensions: int) -> Column:
    """A repeatable vector of a text: bytes b of chained SHA-256 digests as b / 255 - 0.5; each digest
    is made of the hex form of the one before."""
    rounds = -(-dimensions // 32)
    start = F.struct(text.alias("seed"), F.lit("").alias("hex"))

    def step(state: Column, _: Column) -> Column:
        digest = F.sha2(state["seed"].cast("binary"), 256)
        return F.struct(digest.alias("seed"), F.concat(state["hex"], digest).alias("hex"))

    digits = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["hex"])
    byte = lambda h, i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("double")
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    # a lambda's variable is computed once: the digests are not made anew for each component
    return F.get(F.transform(F.array(digits), lambda h: F.transform(places, lambda i: byte(h, i) / 255 - 0.5)), F.lit(0))
