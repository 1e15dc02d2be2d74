"""Waveform kernels on numpy batches (traces by samples), and their Arrow-batched DataFrame forms.

A recurrence over samples is vectorised across the traces of a batch; everything else across both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampling (Hz), notch (Hz, radius), FIR scale and latency, score scale on write, sentinel score, T1 sample.
FS = 500e6
NOTCH_HZ, NOTCH_R = 39e6, 0.9
FIR_SCALE, FIR_LATENCY = 65_536, 60
SCORE_WRITE = 65_535
SENTINEL = 65_534
T1_INDEX = 430


def notch_coefficients(fn: float = NOTCH_HZ, r: float = NOTCH_R, fs: float = FS) -> dict[str, float]:
    nu = 2 * np.pi * fn / fs
    return {
        "a1": 2 * r**4 * np.cos(4 * nu), "a2": -(r**8), "b1": -2 * np.cos(nu), "b2": 1.0,
        "b3": 2 * r * np.cos(nu), "b4": r * r, "b5": 2 * r**2 * np.cos(2 * nu), "b6": r**4,
    }


def _delayed(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[:, n:] = x[:, : x.shape[1] - n] if n else x
    return out


def notch(x: np.ndarray, fn: float = NOTCH_HZ, r: float = NOTCH_R, fs: float = FS) -> np.ndarray:
    """Three-stage notch filter with zero initial state: two feed-forward stages over whole arrays, one recurrence."""
    c = notch_coefficients(fn, r, fs)
    x = x.astype(np.float64)
    y1 = c["b2"] * x + c["b1"] * _delayed(x, 1) + _delayed(x, 2)
    y2 = y1 + c["b3"] * _delayed(y1, 1) + c["b4"] * _delayed(y1, 2)
    drive = _delayed(y2, 2) + c["b5"] * _delayed(y2, 4) + c["b6"] * _delayed(y2, 6)
    y = np.zeros((x.shape[0], x.shape[1] + 8))
    for n in range(x.shape[1]):
        y[:, n + 8] = c["a1"] * y[:, n + 4] + c["a2"] * y[:, n] + drive[:, n]
    return y[:, 8:]


def fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Low-pass with integer taps: floor division back to scale, then a fixed delay filled with zeros."""
    ints = np.round(np.asarray(taps) * FIR_SCALE)
    n = x.shape[1]
    full = np.stack([np.convolve(row, ints)[:n] for row in x.astype(np.float64)]) if len(x) else np.zeros(x.shape)
    return _delayed((full // FIR_SCALE).astype(np.int32).astype(np.int64), FIR_LATENCY)


def calibrate(x: np.ndarray, freq_mhz: np.ndarray, gain: np.ndarray, fs_mhz: float = 500.0) -> np.ndarray:
    """Gain by frequency (linear between points, constant beyond them) in the spectrum; rounded half to even."""
    at = np.abs(np.fft.fftfreq(x.shape[1], 1 / fs_mhz))
    return np.rint(np.fft.ifft(np.fft.fft(x, axis=1) * np.interp(at, freq_mhz, gain), axis=1).real).astype(np.int32)


def as_int16(x: np.ndarray) -> np.ndarray:
    """Truncation toward zero, wrapping as 16-bit integers do."""
    return np.trunc(x).astype(np.int64).astype(np.int16)


def magnitude_db(x: np.ndarray) -> np.ndarray:
    """Spectrum in decibels relative to its peak."""
    db = 20 * np.log10(np.abs(np.fft.rfft(x, axis=1)) + 1e-5)
    return db - db.max(axis=1, keepdims=True)


def normalised(x: np.ndarray) -> np.ndarray:
    peak = np.abs(x).max(axis=1, keepdims=True)
    return np.divide(x, peak, out=np.zeros(x.shape), where=peak > 0)


def rms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).mean(axis=-1))


@dataclass(frozen=True)
class Flt0:
    """First-level trigger parameters; times in ns at 2 ns a sample."""

    th1: float
    th2: float
    t_quiet: int
    t_period: int
    t_sepmax: int
    nc_min: int
    nc_max: int
    skip: int = 100


def flt0(trace: np.ndarray, p: Flt0) -> list[tuple[int, int, float]]:
    """(index, crossings, amplitude) of every valid T1.

    A T1 is a sample above th1, behind the first ``skip`` samples, with none above th1 in the quiet time before it. It is the first crossing;
    further ones are rising edges over th2 within the period. Consecutive crossings must not lie too far apart, and
    their number must lie strictly between nc_min and nc_max.
    """
    high = np.flatnonzero(trace > p.th1)
    if not len(high):
        return []
    gap = np.diff(high, prepend=-(p.t_quiet + 1))
    firsts = high[(gap > p.t_quiet // 2) & (high > p.skip)]
    over = trace > p.th2
    rising = np.flatnonzero(over[1:] & ~over[:-1]) + 1
    out = []
    for i in firsts.tolist():
        a, b = np.searchsorted(rising, [i + 1, i + p.t_period // 2])
        at = np.concatenate([[i], rising[a:b]])
        if p.nc_min < len(at) < p.nc_max and not (2 * np.diff(at) > p.t_sepmax).any():
            out.append((i, len(at), float(trace[i])))
    return out


def correlations(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every position where the template fits; 0 where a segment is silent."""
    m = len(template)
    seg = np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), m, axis=1)
    scale = np.sqrt((seg**2).mean(axis=2)) * (float(rms(template)) * m)
    return np.divide(seg @ template.astype(np.float64), scale, out=np.zeros(seg.shape[:2]), where=scale > 0)


def best_template(x: np.ndarray, templates: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, shift, absolute correlation) of each trace; the first of equals wins, -1 for silent traces."""
    best, which, shift = np.zeros(len(x)), np.full(len(x), -1), np.zeros(len(x), dtype=int)
    for k, t in enumerate(templates):
        c = np.abs(correlations(x, t))
        at = c.argmax(axis=1)
        v = c[np.arange(len(x)), at]
        better = v > best
        best[better], which[better], shift[better] = v[better], k, at[better]
    return which, shift, best


def template_fit(trace: np.ndarray, t_max: int, templates: list[np.ndarray], peak: int, window: int, factor: int = 1) -> tuple[int, int, int, float] | None:
    """(template, desampling, t_peak, correlation) of the best fit around ``t_max``; None if the segment is shorter than a template.

    Templates are sampled ``factor`` times finer; every desampling phase is a candidate.
    """
    views = [(k, s, t[s::factor]) for k, t in enumerate(templates) for s in range(factor)]
    size = max(len(v) for *_, v in views)
    start = max(0, t_max - peak)
    seg = np.asarray(trace[start : start + window + size], dtype=np.float64)
    best: tuple[int, int, int, float] | None = None
    for k, s, v in views:
        if len(seg) < len(v):
            return None
        c = np.abs(correlations(seg[None, :], v))[0]
        at = int(c.argmax())
        if best is None or c[at] > best[3]:
            best = (k, s, start + at + peak, float(c[at]))
    return best if best and best[3] > 0 else (-1, 0, t_max, 0.0)


def flt1_score(corr: float | None) -> int | None:
    """Fixed-point score as it is written; null for a position out of bounds (the sentinel of the wire format is not a score)."""
    return None if corr is None else int(corr * SCORE_WRITE + 0.5)


def flt1(pattern: int, fit_x: float | None, fit_y: float | None) -> tuple[int | None, int | None]:
    """(score, channel): pattern 512 takes X (2), 1024 takes Y (3), otherwise the better one, X only if strictly better."""
    if pattern == 512 or (pattern != 1024 and (fit_y is None or (fit_x is not None and fit_x > fit_y))):
        return flt1_score(fit_x), 2
    return flt1_score(fit_y), 3


def q20_12(value: float, int_bits: int = 20, frac_bits: int = 12) -> int:
    """Two's-complement fixed point."""
    return round(value * (1 << frac_bits)) & ((1 << (int_bits + frac_bits)) - 1)


def over_traces(df: DataFrame, keep: list[str], trace: str, schema: str, kernel: Callable[[np.ndarray], list[tuple]], dtype=np.float64) -> DataFrame:
    """``kernel`` over Arrow batches of equal-length traces; it returns rows of (index in batch, values...).

    Rows carry the columns ``keep``; null traces give no rows, lengths are told apart within a batch.
    """
    fields = [f.split() for f in schema.split(", ")]
    out = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            traces = batch.column(len(keep))
            lengths = np.diff(traces.offsets.to_numpy())
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                x = traces.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(at), n)
                rows = kernel(x)
                if rows:
                    idx, *values = zip(*rows)
                    cols = [batch.column(i).take(pa.array(at[list(idx)])) for i in range(len(keep))]
                    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
                    cols += [pa.array(v, kinds[f[1]]) for v, f in zip(values, fields)]
                    yield pa.RecordBatch.from_arrays(cols, [*keep, *(f[0] for f in fields)])

    return df.select(*keep, F.col(trace)).where(F.col(trace).isNotNull()).mapInArrow(run, out)


def flt0_hits(df: DataFrame, keep: list[str], trace: str, p: Flt0) -> DataFrame:
    """keep, t1, nc, amplitude of every valid T1. Traces that never exceed th1 are dropped before any Python runs."""
    loud = df.where(F.array_max(trace) > F.lit(p.th1))
    return over_traces(loud, keep, trace, "t1 long, nc long, amplitude double", lambda x: [(i, *hit) for i, row in enumerate(x) for hit in flt0(row, p)])
