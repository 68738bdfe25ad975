"""Embedding noise, drawn per row from its own key so that a rerun gives the same vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.keys import digest_long, seeded_digest

SCHEMES = ("GaussElem", "GaussVec", "GaussAngle", "UniformAngle", "GaussElemUniformAngle")


def _uniforms(keys: np.ndarray, n: int) -> np.ndarray:
    """n uniform draws in (0, 1) per 64-bit key: splitmix64 of the key's counter sequence, for all rows at once."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _normals(uniforms: np.ndarray) -> np.ndarray:
    """As many normal draws as uniform ones (an even number), by the Box-Muller transform."""
    half = uniforms.shape[1] // 2
    radius, angle = np.sqrt(-2.0 * np.log(uniforms[:, :half])), 2.0 * np.pi * uniforms[:, half:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _rotate(x: np.ndarray, direction: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Rotate each row by an angle toward the part of `direction` that is orthogonal to it."""
    ortho = _unit(direction - x * np.sum(x * direction, axis=1, keepdims=True))
    return _unit(x * np.cos(angle) + ortho * np.sin(angle))


def add_noise(
    vec: Column, key: Column, seed: int, scheme: str, vec_norm: float = 0.0, angle_min: float = 0.0,
    angle_max: float = 0.0, angle_std: float = 0.0, mix_ratio: float = 0.0,
) -> Column:
    """Unit vectors with noise. Angles are in degrees."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown noise scheme: {scheme}")
    if scheme in ("GaussElem", "GaussVec", "GaussElemUniformAngle") and vec_norm <= 0:
        raise ValueError("the noise norm must be positive")
    if scheme == "GaussAngle" and (angle_std <= 0 or angle_max <= 0):
        raise ValueError("angle deviation and maximum must be positive")
    if angle_min > angle_max:
        raise ValueError("the minimum angle exceeds the maximum")
    if not 0 <= mix_ratio <= 1:
        raise ValueError("the mix ratio must be in [0, 1]")
    low, high, std = math.radians(angle_min), math.radians(angle_max), math.radians(angle_std)

    @pandas_udf("array<float>")
    def noisy(vectors: pd.Series, keys: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        dim = x.shape[1]
        draws = _uniforms(keys.to_numpy(dtype=np.int64), dim + dim % 2 + 4)
        uniform, scalar = draws[:, :2], _normals(draws[:, 2:4])[:, :1]
        gauss = _normals(draws[:, 4:])[:, :dim]
        element = lambda: _unit(x + gauss * (vec_norm / math.sqrt(x.shape[1])))
        spread = lambda: _rotate(x, gauss, low + uniform[:, :1] * (high - low))
        if scheme == "GaussElem":
            out = element()
        elif scheme == "GaussVec":
            out = _unit(x + _unit(gauss) * scalar * vec_norm)
        elif scheme == "GaussAngle":
            out = _rotate(x, gauss, np.clip(scalar * std, -high, high))
        elif scheme == "UniformAngle":
            out = spread()
        else:
            out = np.where(uniform[:, 1:] < mix_ratio, spread(), element())
        return pd.Series(list(out.astype(np.float32)))

    return noisy(vec, digest_long(seeded_digest(seed, key)))
