"""Predictors over the bytes of a decoded chunk, row by row: horizontal differences and the floating-point predictor."""

from __future__ import annotations

import numpy as np

NONE, HORIZONTAL, FLOATING_POINT = 1, 2, 3


def check(predictor: int, bits: int, sample_format: int) -> None:
    if predictor == HORIZONTAL and bits not in (8, 16, 32):
        raise ValueError(f"the horizontal predictor takes 8, 16 or 32 bits, not {bits}")
    if predictor == FLOATING_POINT and (sample_format != 3 or bits not in (16, 24, 32, 64)):
        raise ValueError("the floating-point predictor takes IEEE samples of 16, 24, 32 or 64 bits")
    if predictor not in (NONE, HORIZONTAL, FLOATING_POINT):
        raise ValueError(f"unknown predictor {predictor}")


def _rows(data: bytes, width: int, stride: int, bits: int, order: str) -> np.ndarray:
    kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
    n = width * stride * (bits // 8)
    return np.frombuffer(data[: len(data) // n * n], kind).reshape(-1, width, stride)


def decode(data: bytes, predictor: int, width: int, stride: int, bits: int, order: str = "<", sample_format: int = 1) -> bytes:
    """Undoes the predictor; samples keep their byte order, and floating-point ones come out in it."""
    if predictor == NONE or not data:
        return data
    check(predictor, bits, sample_format)
    if predictor == HORIZONTAL:
        rows = _rows(data, width, stride, bits, order)
        return np.cumsum(rows, axis=1, dtype=rows.dtype.newbyteorder("=")).astype(rows.dtype).tobytes()
    size = bits // 8
    raw = np.frombuffer(data, np.uint8).reshape(-1, width * stride * size // stride, stride)
    planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(len(raw), size, width * stride)
    samples = planes.transpose(0, 2, 1)  # the most significant byte first
    return np.ascontiguousarray(samples if order == ">" else samples[:, :, ::-1]).tobytes()


def encode(data: bytes, predictor: int, width: int, stride: int, bits: int, order: str = "<", sample_format: int = 1) -> bytes:
    if predictor == NONE or not data:
        return data
    check(predictor, bits, sample_format)
    if predictor == HORIZONTAL:
        rows = _rows(data, width, stride, bits, order)
        native = rows.astype(rows.dtype.newbyteorder("="))
        native[:, 1:] -= native[:, :-1].copy()
        return native.astype(rows.dtype).tobytes()
    size = bits // 8
    samples = np.frombuffer(data, np.uint8).reshape(-1, width * stride, size)
    planes = (samples if order == ">" else samples[:, :, ::-1]).transpose(0, 2, 1).reshape(len(samples), -1, stride)
    out = planes.copy()
    out[:, 1:] -= planes[:, :-1]
    return out.tobytes()
