"""Catmull-Rom evaluation over a 4x4 stencil, in one fixed order of operations.

Sums run over rows, then columns, from 0.0, so results are the same to the bit
whatever the partitioning.  All functions give SQL text.
"""

from __future__ import annotations

from ..consts import LATTICE_MAX


def lattice_coordinate(pixel: str, size: int) -> str:
    if size <= 1:
        return "0D"
    return f"(cast({pixel} as double) * {float(LATTICE_MAX)}D / {float(size - 1)}D)"


def clamped(u: str) -> str:
    return f"least(greatest({u}, 0D), {float(LATTICE_MAX)}D)"


def cell(u: str) -> str:
    return f"least(cast(floor({clamped(u)}) as int), {LATTICE_MAX - 1})"


def basis(t: str) -> list[str]:
    """Weights of the four neighbours; t and its powers are columns t, t2 = t*t, t3 = t2*t."""
    return [
        f"(-0.5D * {t}3 + 1.0D * {t}2 - 0.5D * {t})",
        f"(1.5D * {t}3 - 2.5D * {t}2 + 1.0D)",
        f"(-1.5D * {t}3 + 2.0D * {t}2 + 0.5D * {t})",
        f"(0.5D * {t}3 - 0.5D * {t}2)",
    ]


def basis_derivative(t: str) -> list[str]:
    return [
        f"(-1.5D * {t}2 + 2.0D * {t} - 0.5D)",
        f"(4.5D * {t}2 - 5.0D * {t})",
        f"(-4.5D * {t}2 + 4.0D * {t} + 0.5D)",
        f"(1.5D * {t}2 - 1.0D * {t})",
    ]


def blended(wv: str, wu: str, points: str) -> str:
    """Sum of wv[a] * wu[b] * points[4a + b]; the weights are columns wv0.., wu0.."""
    out = "0D"
    for a in range(4):
        for b in range(4):
            out = f"({out} + ({wv}{a} * {wu}{b}) * {points}[{4 * a + b}])"
    return out
