"""Formats and parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the sample, weight and position formats.
CODE_MIN = 4
CODE_MAX = 1019
CODE_BLACK = 64
CODE_WHITE = 940
CODE_CHROMA_ZERO = 512
CODE_SHIFT = 6
SAMPLE_MAX = 65535
WEIGHT_UNITY = 32768
SUBPIXEL = 16
LATTICE_MAX = 128
SLOTS = 4

LUMA_BLACK = CODE_BLACK << CODE_SHIFT
CHROMA_ZERO = CODE_CHROMA_ZERO << CODE_SHIFT


@dataclass(frozen=True)
class Supersample:
    """Magnification above which a pixel is sampled 2x2 or 4x4; the margin keeps rounding noise below it."""

    threshold_2x2: float = 1.0 + 1e-6
    threshold_4x4: float = 4.0 + 1e-6
    most: int = 4


@dataclass(frozen=True)
class Background:
    lum: int = LUMA_BLACK
    cb: int = CHROMA_ZERO
    cr: int = CHROMA_ZERO


@dataclass(frozen=True)
class WarpParams:
    """Destination size, clamp of the density compensation, sampling, tag and background of one warp."""

    width: int
    height: int
    max_k: float = 1000.0
    supersample: Supersample = field(default_factory=Supersample)
    tag: int = 0
    background: Background = field(default_factory=Background)
    tile_log2: int = 5
    kbuffer: str = "off"  # off, opaque or blend

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0:
            raise ValueError("the destination needs a positive size")
        if not 3 <= self.tile_log2 <= 7:
            raise ValueError("tile_log2 must be 3 to 7")
        if self.kbuffer not in ("off", "opaque", "blend"):
            raise ValueError("kbuffer must be off, opaque or blend")

    @property
    def tile(self) -> int:
        return 1 << self.tile_log2


def supported_width(width: int) -> bool:
    return width > 0 and width % 2 == 0


def chroma_width(width: int) -> int:
    return width // 2


def groups(width: int) -> int:
    """Groups of six pixels in a packed row."""
    return -(-width // 6)


def row_bytes_min(width: int) -> int:
    return groups(width) * 16


def row_bytes_aligned(width: int) -> int:
    return -(-row_bytes_min(width) // 128) * 128
