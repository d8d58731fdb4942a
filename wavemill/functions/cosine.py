"""Orthonormal type-II cosine transform of stacked arrays, run inside tasks."""

from __future__ import annotations

import numpy as np

DENSE_LIMIT = 256


def basis(size: int) -> np.ndarray:
    """Rows are frequencies, columns are positions."""
    k = np.arange(size)[:, None]
    i = np.arange(size)[None, :]
    table = np.sqrt(2.0 / size) * np.cos(np.pi * (2 * i + 1) * k / (2.0 * size))
    table[0] = np.sqrt(1.0 / size)
    return table


def _rotation(size: int) -> np.ndarray:
    scale = np.full(size, np.sqrt(2.0 / size))
    scale[0] = np.sqrt(1.0 / size)
    return scale * np.exp(-0.5j * np.pi * np.arange(size) / size)


def forward_last(x: np.ndarray) -> np.ndarray:
    """Transform along the last axis: a matrix product when short, one FFT of the same length when long."""
    size = x.shape[-1]
    if size <= DENSE_LIMIT:
        return x @ basis(size).T
    folded = np.concatenate([x[..., ::2], x[..., 1::2][..., ::-1]], axis=-1)
    return (np.fft.fft(folded, axis=-1) * _rotation(size)).real


def inverse_last(c: np.ndarray) -> np.ndarray:
    size = c.shape[-1]
    if size <= DENSE_LIMIT:
        return c @ basis(size)
    mirrored = np.concatenate([np.zeros_like(c[..., :1]), c[..., :0:-1]], axis=-1)
    scale = np.full(size, np.sqrt(size / 2.0))
    scale[0] = np.sqrt(float(size))
    spectrum = scale * np.exp(0.5j * np.pi * np.arange(size) / size) * (c - 1j * mirrored)
    folded = np.fft.ifft(spectrum, axis=-1).real
    out = np.empty_like(folded)
    half = (size + 1) // 2
    out[..., ::2] = folded[..., :half]
    out[..., 1::2] = folded[..., half:][..., ::-1]
    return out


def forward_2d(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(forward_last(np.swapaxes(forward_last(x), -1, -2)), -1, -2)


def inverse_2d(c: np.ndarray) -> np.ndarray:
    return np.swapaxes(inverse_last(np.swapaxes(inverse_last(c), -1, -2)), -1, -2)
