"""Shifted-Legendre basis, tensor coordinates and lower-order design rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.arrays import let

# Polynomial coefficients of the first four shifted Legendre functions, lowest power
# first, and their normalising factors.
LEGENDRE = ((-1, 2), (1, -6, 6), (-1, 12, -30, 20), (1, -20, 90, -140, 70))
FACTORS = (math.sqrt(3.0), math.sqrt(5.0), math.sqrt(7.0), 3.0)


def phi(u: Column, size: int) -> Column:
    """Array of the first ``size`` basis values of a rank (Horner form)."""
    values = []
    for coefficients, factor in list(zip(LEGENDRE, FACTORS, strict=True))[:size]:
        poly = F.lit(float(coefficients[-1]))
        for c in reversed(coefficients[:-1]):
            poly = poly * u + F.lit(float(c))
        values.append(poly * F.lit(factor))
    return F.array(*values)


def outer(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def _bases(u: Column, size: int) -> Column:
    return F.transform(u, lambda x: phi(x, size))


def tensor(u: Column, size: int) -> Column:
    """All products of member bases, last member fastest."""

    def product(b: Column) -> Column:
        first = F.element_at(b, 1)
        pair = outer(first, F.get(b, F.lit(1)))
        return (
            F.when(F.size(b) == 1, first)
            .when(F.size(b) == 2, pair)
            .otherwise(outer(pair, F.get(b, F.lit(2))))
        )

    return let(_bases(u, size), product)


def design(u: Column, size: int) -> Column:
    """Intercept, member bases and, for triples, the three pair tensors."""
    one = F.array(F.lit(1.0))

    def row(b: Column) -> Column:
        x, y, z = (F.get(b, F.lit(i)) for i in range(3))
        return (
            F.when(F.size(b) == 1, one)
            .when(F.size(b) == 2, F.concat(one, F.flatten(b)))
            .otherwise(F.concat(one, F.flatten(b), outer(x, y), outer(x, z), outer(y, z)))
        )

    return let(_bases(u, size), row)


def tensor_size(order: int, size: int) -> int:
    return size**order


def design_size(order: int, size: int) -> int:
    return {1: 1, 2: 1 + 2 * size, 3: 1 + 3 * size + 3 * size * size}[order]


def phi_matrix(u: np.ndarray, size: int) -> np.ndarray:
    """Rows x size values for a vector of ranks (used inside grouped maps)."""
    cols = [f * np.polyval(c[::-1], u) for c, f in list(zip(LEGENDRE, FACTORS, strict=True))[:size]]
    return np.stack(cols, axis=1)


def design_and_tensor(ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Design and tensor matrices of a (rows x order) rank matrix."""
    rows, order = ranks.shape
    bases = [phi_matrix(ranks[:, i], size) for i in range(order)]

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, :, None] * b[:, None, :]).reshape(rows, -1)

    target = bases[0]
    for b in bases[1:]:
        target = product(target, b)
    parts = [np.ones((rows, 1))]
    if order > 1:
        parts += bases
    if order > 2:
        parts += [product(bases[i], bases[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    return np.concatenate(parts, axis=1), target
