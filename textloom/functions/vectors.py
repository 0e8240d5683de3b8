"""Vector arithmetic of language models as expressions on ``array<double>`` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.rules import bind


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def rmsnorm(v: Column, eps: float = 1e-5) -> Column:
    """x / sqrt(mean(x^2) + eps)."""
    return bind(F.sqrt(dot(v, v) / F.size(v) + eps), lambda r: F.transform(v, lambda x: x / r))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Centred and scaled by the population deviation."""

    def scale(c: Column) -> Column:
        return bind(F.sqrt(dot(c, c) / F.size(c) + eps), lambda r: F.transform(c, lambda x: x / r))

    return bind(bind(mean(v), lambda m: F.transform(v, lambda x: x - m)), scale)


def logsumexp(v: Column) -> Column:
    """Shifted by the largest value."""
    return bind(F.array_max(v), lambda m: m + F.log(total(F.transform(v, lambda x: F.exp(x - m)))))


def log_softmax(v: Column) -> Column:
    return bind(logsumexp(v), lambda z: F.transform(v, lambda x: x - z))


def softmax(v: Column) -> Column:
    return bind(logsumexp(v), lambda z: F.transform(v, lambda x: F.exp(x - z)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def matmul(matrix: Column, v: Column) -> Column:
    """Rows of an ``array<array<double>>`` times a vector; no bias."""
    return F.transform(matrix, lambda row: dot(row, v))


def swiglu(v: Column, w1: Column, w2: Column, w3: Column) -> Column:
    """W2 (SiLU(W1 x) * W3 x)."""
    gate = F.transform(matmul(w1, v), silu)
    return matmul(w2, F.zip_with(gate, matmul(w3, v), lambda a, b: a * b))


def add(a: Column, b: Column) -> Column:
    """Elementwise, as learned positions are added to embeddings."""
    return F.zip_with(a, b, lambda x, y: x + y)


def hidden_size(d: int, multiple: int = 64) -> int:
    """8/3 of the model width, rounded up to a multiple."""
    return -(-(8 * d // 3) // multiple) * multiple if 8 * d % 3 == 0 else -(-math.ceil(8 * d / 3) // multiple) * multiple


def rope(v: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotate pairs (2j, 2j + 1) by position * theta^(-2j / d)."""
    d = F.size(v)

    def turned(i: Column) -> Column:
        even = i - i % 2
        angle = position * F.pow(F.lit(theta), -even / d)
        x, y = F.get(v, even), F.get(v, even + 1)
        return F.when(i % 2 == 0, x * F.cos(angle) - y * F.sin(angle)).otherwise(x * F.sin(angle) + y * F.cos(angle))

    return F.transform(F.sequence(F.lit(0), d - 1), turned)


def cross_entropy(logits: Column, target: Column) -> Column:
    return logsumexp(logits) - F.get(logits, target)


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become minus infinity; ties with it stay."""
    kth = F.get(F.sort_array(logits, False), F.least(F.lit(k), F.size(logits)) - 1)
    return bind(kth, lambda t: F.transform(logits, lambda x: F.when(x >= t, x).otherwise(F.lit(float("-inf")))))


def lr_cosine(t: Column, top: float, low: float, warm: int, last: int) -> Column:
    """Linear warm-up, half a cosine, then the floor."""
    return F.when(t < warm, t / warm * top).when(t <= last, low + 0.5 * (1 + F.cos((t - warm) / (last - warm) * math.pi)) * (top - low)).otherwise(F.lit(low))
