"""Fixed-point arithmetic as SQL expressions.

Spark's ``round`` is half away from zero, ``div`` truncates and ``>>`` floors, which
are the rules of the formats; unsigned wrap is a mask, never a cast (ANSI casts raise).
All functions take and give SQL text, so plans stay in whole-stage code.
"""

from __future__ import annotations

from ..consts import CODE_MAX, CODE_MIN, CODE_SHIFT, SAMPLE_MAX, WEIGHT_UNITY


def sample_of_code(code: str) -> str:
    return f"shiftleft(cast({code} as int), {CODE_SHIFT})"


def code_of_sample(sample: str) -> str:
    """10-bit code: rounded half up, clamped to the protocol range (the only clamp)."""
    return f"least(greatest(shiftright(cast({sample} as int) + 32, {CODE_SHIFT}), {CODE_MIN}), {CODE_MAX})"


def code_truncated(sample: str) -> str:
    return f"shiftright(cast({sample} as int), {CODE_SHIFT})"


def rounded(x: str, most: float = SAMPLE_MAX) -> str:
    """x clamped to 0..most and rounded half away from zero, as int."""
    return f"cast(round(least(greatest({x}, 0D), {float(most)}D)) as int)"


def weight(x: str) -> str:
    return rounded(f"({x}) * {float(WEIGHT_UNITY)}D")


def wrap16(x: str) -> str:
    return f"(({x}) & {SAMPLE_MAX})"
