"""Random draws that are functions of the unit key.

A draw depends only on the key, a salt and a seed, so it survives repartitioning, retries and
lost executors, and gives the same answer in any engine that has md5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# floor(CDF * 2^32) of a Poisson(1) variable, for counts 0 to 6.
POISSON_ONE_CUTS = (
    0x5E2D58D8,
    0xBC5AB1B1,
    0xEB715E1D,
    0xFB239797,
    0xFF1025F5,
    0xFFD90F3B,
    0xFFFA8B71,
)

_MIX_FACTOR = 0x45D9F3B  # below 2^31, so SQL can form the products in 64 bits
_GOLDEN = 0x9E3779B9


def draw(unit_id: str | Column, salt: str, seed: int) -> Column:
    """A uniform 32-digit hex string for each unit."""
    key = F.col(unit_id) if isinstance(unit_id, str) else unit_id
    return F.md5(F.concat(key.cast("string"), F.lit(f":{salt}:{seed}")))


def hex_cut(fraction: float) -> str:
    """The 8-digit hex string below which a draw falls with the given probability (< 1)."""
    return format(int(fraction * 2**32), "08x")


def below(drawn: Column, fraction: float) -> Column:
    """True with probability ``fraction``, decided by the first 32 bits of the draw."""
    if fraction >= 1.0:
        return F.lit(True)
    return F.substring(drawn, 1, 8) < F.lit(hex_cut(fraction))


def draw_number(drawn: Column) -> Column:
    """The first 32 bits of a draw as a double in [0, 2^32)."""
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")


def fold(unit_id: str | Column, k: int, salt: str, seed: int) -> Column:
    """Assign each unit to one of ``k`` folds."""
    bits = F.conv(F.substring(draw(unit_id, salt, seed), 1, 8), 16, 10).cast("bigint")
    return (bits % F.lit(k)).cast("int")


def weight_keys(unit_id: str | Column) -> tuple[Column, Column]:
    """Two 32-bit halves of the unit's digest; the seed material of its bootstrap weights."""
    key = F.col(unit_id) if isinstance(unit_id, str) else unit_id
    digest = F.md5(key.cast("string"))
    halves = (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return tuple(halves)


def _mix_np(x: np.ndarray) -> np.ndarray:
    """Scramble 32-bit values in place; the multiplications wrap around."""
    factor, shift, part = np.uint32(_MIX_FACTOR), np.uint32(16), np.empty_like(x)
    for _ in range(2):
        np.bitwise_xor(x, np.right_shift(x, shift, out=part), out=x)
        np.multiply(x, factor, out=x)
    return np.bitwise_xor(x, np.right_shift(x, shift, out=part), out=x)


def bootstrap_weights_np(
    first: np.ndarray, second: np.ndarray, replicates: np.ndarray, seed: int
) -> np.ndarray:
    """Poisson(1) weights of a batch: one row per unit, one column per replicate, as uint8."""
    stream = (replicates.astype(np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed)).astype(np.uint32)
    bits = _mix_np(first.astype(np.uint32)[:, None] ^ _mix_np(stream)[None, :])
    np.bitwise_xor(bits, second.astype(np.uint32)[:, None], out=bits)
    bits = _mix_np(bits)
    weights, reached = np.zeros(bits.shape, dtype=np.uint8), np.empty(bits.shape, dtype=bool)
    for cut in POISSON_ONE_CUTS:
        np.greater_equal(bits, np.uint32(cut), out=reached)
        np.add(weights, reached.view(np.uint8), out=weights)
    return weights
