"""Spectral and wavelet summaries of a trailing window.

The two transforms are the only Python code in the data path: one Arrow call per
ticker, in which numpy handles all windows as one matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickerloom.operators.features import signal_source

#: Windows turned into one matrix at once.
ROWS_AT_ONCE = 4096

# db4 low-pass decomposition filter (8 taps).
DB4_LOW = (
    -0.010597401785069032,
    0.0328830116668852,
    0.030841381835560764,
    -0.18703481171909309,
    -0.027983769416859854,
    0.6308807679298589,
    0.7148465705529157,
    0.2303778133088965,
)


def spectral_fields(components: int) -> list[str]:
    names = ["energy_concentration", "spectral_entropy", "cycle_clarity", "cycle_strength", "noise_diffusion"]
    for k in range(1, components + 1):
        names += [f"freq_{k}", f"period_{k}", f"amp_{k}"]
    return names


def spectral_matrix(windows: np.ndarray, components: int) -> np.ndarray:
    """One row of summaries per window; NaN where the window has no power."""
    width = windows.shape[1]
    amplitude = np.abs(np.fft.rfft(windows - windows.mean(axis=1, keepdims=True), axis=1))[:, 1:]
    power = amplitude**2
    frequency = np.fft.rfftfreq(width)[1:]
    bins = frequency.size
    total = power.sum(axis=1)
    # Equal powers: the higher bin first, so results do not depend on sort internals.
    order = np.lexsort((-np.broadcast_to(np.arange(bins), power.shape), -power), axis=1)[:, :components]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = power / total[:, None]
        concentration = np.take_along_axis(power, order, 1).sum(axis=1) / total
        entropy = -np.where(share > 0, share * np.log(share), 0.0).sum(axis=1) / np.log(bins)
    top = np.take_along_axis(amplitude, order, 1)
    columns = [
        concentration,
        entropy,
        concentration / (1 + entropy),
        top[:, 0] * concentration,
        entropy / (1 + concentration),
    ]
    for k in range(components):
        f = frequency[order[:, k]]
        columns += [f, 1 / f, top[:, k]]
    out = np.column_stack(columns)
    out[~(total > 0)] = np.nan
    return out


@dataclass(frozen=True)
class Summary:
    """Summaries ``<prefix>_<field>`` of the trailing ``rows`` values of ``source``."""

    source: Column
    rows: int
    compute: Callable[[np.ndarray], np.ndarray]
    fields: list[str]
    prefix: str

    @property
    def names(self) -> list[str]:
        return [f"{self.prefix}_{f}" for f in self.fields]


def _attach(bars: DataFrame, *summaries: Summary) -> DataFrame:
    """Add the summaries; NULL where the window is not full.

    One Arrow call per ticker, whose rows the calendar bounds: each value crosses to
    Python once, and the windows are views of one array.
    """
    names = [n for s in summaries for n in s.names]
    sources = [f"_source{i}" for i in range(len(summaries))]
    shaped = bars.drop(*names).withColumns({c: s.source for c, s in zip(sources, summaries)})
    schema = StructType([*(f for f in shaped.schema.fields if f.name not in sources), *(StructField(n, DoubleType()) for n in names)])
    plain = [(c, s.rows, s.compute, len(s.fields)) for c, s in zip(sources, summaries)]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        added = []
        for source, rows, compute, fields in plain:
            values = table[source].to_numpy().astype(float)
            out = np.full((len(values), fields), np.nan)
            if len(values) >= rows:
                windows = np.lib.stride_tricks.sliding_window_view(values, rows)
                full = np.flatnonzero(~np.isnan(windows).any(axis=1))
                for at in np.array_split(full, len(full) // ROWS_AT_ONCE + 1):
                    if len(at):
                        out[at + rows - 1] = compute(windows[at])
            added += [pa.array(out[:, k], pa.float64(), mask=np.isnan(out[:, k])) for k in range(fields)]
        kept = table.drop_columns(sources)
        return pa.table([*kept.columns, *added], names=[*kept.column_names, *names])

    return shaped.groupBy("ticker").applyInArrow(one, schema)


def _spectral(window: int, components: int, mode: str, prefix: str) -> Summary:
    return Summary(signal_source(F.col("adj_close"), mode), window, lambda w: spectral_matrix(w, components), spectral_fields(components), prefix)


def fourier(bars: DataFrame, window: int = 60, components: int = 3, mode: str = "returns", prefix: str = "fourier") -> DataFrame:
    return _attach(bars, _spectral(window, components, mode, prefix))


def _step(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Periodized low- and high-pass halving matrices of one level."""
    low = np.asarray(DB4_LOW)
    high = np.array([(-1) ** (k + 1) for k in range(low.size)]) * low[::-1]
    lo, hi = np.zeros((width // 2, width)), np.zeros((width // 2, width))
    for row in range(width // 2):
        for k in range(low.size):
            # Output row r is centred so that tap k reads sample 2r + 4 - k.
            lo[row, (2 * row + low.size // 2 - k) % width] += low[k]
            hi[row, (2 * row + low.size // 2 - k) % width] += high[k]
    return lo, hi


def wavelet_matrices(width: int, levels: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Detail matrices, finest first, and the coarsest approximation matrix."""
    approx, details = np.eye(width), []
    for _ in range(levels):
        lo, hi = _step(approx.shape[0])
        details.append(hi @ approx)
        approx = lo @ approx
    return details, approx


def wavelet_fields(levels: int) -> list[str]:
    names = [
        "trend_return",
        "short_noise_intensity",
        "clean_trend",
        "trend_quality",
        "noise_pressure",
        "medium_long_energy_share",
    ]
    return names + [f"energy_scale_{k}" for k in range(1, levels + 1)]


def wavelet_matrix(windows: np.ndarray, levels: int) -> np.ndarray:
    details, approx = wavelet_matrices(windows.shape[1], levels)
    energy = [((windows @ d.T) ** 2).sum(axis=1) for d in details]
    smooth = windows @ approx.T
    total = sum(energy) + (smooth**2).sum(axis=1)
    trend = smooth @ approx
    trend_return = np.exp(trend[:, -1] - trend[:, 0]) - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        noise = energy[0] / total
        rest = sum(energy[1:]) / total
        columns = [
            trend_return,
            noise,
            trend_return / (1 + noise),
            np.abs(trend_return) / (1 + noise),
            energy[0] / (total + energy[0]),
            rest if levels >= 2 else np.full_like(noise, np.nan),
            *[e / total for e in energy],
        ]
    return np.column_stack(columns)


def _wavelet(window: int, levels: int, prefix: str) -> Summary:
    return Summary(F.log("adj_close"), window, lambda w: wavelet_matrix(w, levels), wavelet_fields(levels), prefix)


def wavelet(bars: DataFrame, window: int = 64, levels: int = 3, prefix: str = "wavelet") -> DataFrame:
    return _attach(bars, _wavelet(window, levels, prefix)).withColumn(f"{prefix}_available", F.lit(1.0))


def waves(bars: DataFrame) -> DataFrame:
    """``wavelet(fourier(bars))`` with the default windows, in one call per ticker; other columns go along."""
    return _attach(bars, _spectral(60, 3, "returns", "fourier"), _wavelet(64, 3, "wavelet")).withColumn("wavelet_available", F.lit(1.0))
