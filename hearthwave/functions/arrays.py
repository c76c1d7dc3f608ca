"""Scalar functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column | str, y: Column | str) -> Column:
    """Sum of the products of two arrays' elements."""
    products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column | str, y: Column | str) -> Column:
    return dot(x, y) / F.greatest(norm(x) * norm(y), F.lit(1e-12))


def complex_similarity(re: str, im: str, re_b: str, im_b: str) -> Column:
    """|<a, b>| / (|a| |b|) of two complex vectors given as twin arrays."""
    real, imag = dot(re, re_b) + dot(im, im_b), dot(im, re_b) - dot(re, im_b)
    norms = F.sqrt(dot(re, re) + dot(im, im)) * F.sqrt(dot(re_b, re_b) + dot(im_b, im_b))
    return F.sqrt(real * real + imag * imag) / F.greatest(norms, F.lit(1e-12))
