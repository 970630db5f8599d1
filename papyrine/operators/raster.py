"""Measures of page scans: byte structure, ink, lines and rhythm, and the rule that classes pages by them.

Images come as rows of (key, height, width, grey levels as bytes), as the built-in image source delivers them once
made grey; features are computed in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages whose ink runs vary less than this are typed.
TYPED_BELOW = 0.81
_INK = 0.55


def is_jpeg(content: Column) -> Column:
    """Whether bytes have a JPEG's length, beginning and end."""
    return F.coalesce((F.length(content) >= 1024) & (F.substring(content, 1, 3) == F.to_binary(F.lit("FFD8FF"), F.lit("hex"))) & (F.substring(content, -2, 2) == F.to_binary(F.lit("FFD9"), F.lit("hex"))), F.lit(False))


def page_class(ink_cv: Column) -> Column:
    """note without a measure, typed below the threshold, else hand."""
    return F.when(ink_cv.isNull(), "note").when(ink_cv < TYPED_BELOW, "typed").otherwise("hand")


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of true values begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def bands(ink: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """Bands of text: rows with clearly more ink than the mean row, at least ``least`` of them together."""
    share = ink.mean(axis=1)
    spread = share.std()
    limit = share.mean() + 0.15 * spread if spread > 0 else 1.0
    starts, ends = _runs(share > max(limit, 0.01))
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= least]


def _variation(x: np.ndarray) -> float:
    return float(x.std() / x.mean()) if len(x) and x.mean() > 0 else 0.0


def pitch(column: np.ndarray, shortest: int = 4, longest: int = 40) -> tuple[float, int]:
    """(strength, lag) of the strongest autocorrelation of a line's profile; (0, 0) for a flat or short one."""
    x = column - column.mean()
    last = min(longest, len(x) - 1)
    power = float(x @ x)
    if len(x) < 60 or x.std() < 1e-6 or power <= 0 or last <= shortest:
        return 0.0, 0
    strength = np.array([x[lag:] @ x[:-lag] for lag in range(shortest, last)]) / power
    best = int(strength.argmax())
    return float(strength[best]), shortest + best


def resized(grey: np.ndarray, width: int) -> np.ndarray:
    """An image at another width, its proportions kept: each new pixel is the mean of the area it covers when smaller,
    and lies between its neighbours when larger."""
    h, w = grey.shape
    if w == width or not h or not w:
        return grey.astype(float)
    out = grey.astype(float)
    for axis, new in ((0, max(1, int(h * width / w))), (1, width)):
        old = out.shape[axis]
        if new < old:
            # sums up to each border, fractions of pixels included
            total = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
            at = np.linspace(0, old, new + 1)
            low = np.minimum(at.astype(int), old - 1)
            part = (at - low).reshape([-1, 1] if axis == 0 else [1, -1])
            border = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
            out = np.diff(border, axis=axis) * new / old
        else:
            at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
            low = np.minimum(at.astype(int), max(old - 2, 0))
            part = (at - low).reshape([-1, 1] if axis == 0 else [1, -1])
            out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, old - 1), axis) * part
    return out


def ink_mask(grey: np.ndarray) -> tuple[np.ndarray | None, float]:
    """(dark pixels of a page after its contrast is set by the 5th and 95th percentiles, the contrast); no mask for a
    blank page."""
    low, high = np.percentile(grey, [5, 95])
    if high - low < 1e-3:
        return None, float(high - low)
    return np.clip((grey - low) / (high - low), 0, 1) < _INK, float(high - low)


def page_metrics(grey: np.ndarray, width: int = 900) -> dict[str, float]:
    """Ink, lines, regularity of their spacing and contrast of a page, at a width of at most ``width``."""
    ink, contrast = ink_mask(resized(grey, width) if grey.shape[1] > width else grey.astype(float))
    if ink is None:
        return {"ink": 0.0, "lines": 0, "regular": 0.0, "contrast": contrast}
    lines = bands(ink)
    regular = 0.0
    if len(lines) >= 4:
        steps = np.diff([(a + b) / 2 for a, b in lines])
        regular = max(0.0, 1.0 - _variation(steps)) if steps.mean() > 0 else 0.0
    return {"ink": round(float(ink.mean()), 4), "lines": len(lines), "regular": round(regular, 3), "contrast": round(contrast, 1)}


def measure(grey: np.ndarray, width: int = 1200) -> dict[str, float] | None:
    """Features of a page at the width ``width``; None for a blank page or one of fewer than four lines. Medians over the
    lines: strength of the pitch, variation of ink runs and of gaps (lines with at least four of them); agreement of the
    pitches, variation of the heights."""
    ink, _ = ink_mask(resized(grey, width))
    lines = bands(ink) if ink is not None else []
    if len(lines) < 4:
        return None
    peaks, lags, run_variation, gap_variation = [], [], [], []
    for a, b in lines:
        profile = ink[a:b].mean(axis=0)
        strength, lag = pitch(profile)
        peaks.append(strength)
        lags.append(lag)
        starts, ends = _runs(profile > profile.mean() * 0.6)
        for lengths, into in ((ends - starts, run_variation), (starts[1:] - ends[:-1], gap_variation)):
            if len(lengths) >= 4 and lengths.mean() > 0:
                into.append(_variation(lengths.astype(float)))
    found = np.array([x for x in lags if x > 0], float)
    median = lambda x: round(float(np.median(x)) if x else 0.0, 3)
    return {
        "pitch_peak": median(peaks), "pitch_agree": round(1.0 - _variation(found), 3) if len(found) >= 3 else 0.0,
        "ink_cv": median(run_variation), "gap_cv": median(gap_variation),
        "height_cv": round(_variation(np.array([b - a for a, b in lines], float)), 3), "bands": len(lines),
    }


def strips(height: int, parts: int = 5, overlap: float = 0.1, least: int = 60) -> list[tuple[int, int]]:
    """(from, to) of the rows of ``parts`` equal strips of an image that overlap by a share of their height; strips lower
    than ``least`` are not cut."""
    if height <= 0:
        return []
    parts = max(1, min(parts, height // least or 1))
    step = height / parts
    margin = step * overlap
    return [(max(0, int(k * step - margin)), min(height, int((k + 1) * step + margin))) for k in range(parts)]


FEATURES = ["pitch_peak", "pitch_agree", "ink_cv", "gap_cv", "height_cv", "bands"]
METRICS = ["ink", "lines", "regular", "contrast"]


def _grey(h, w, c) -> np.ndarray | None:
    return np.frombuffer(c, np.uint8).reshape(int(h), int(w)) if c is not None and h and w and len(c) == h * w else None


def _measured(measure_one, names: list[str]):
    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(height: pd.Series, width: pd.Series, content: pd.Series) -> pd.DataFrame:
        pages = (_grey(h, w, c) for h, w, c in zip(height, width, content, strict=True))
        return pd.DataFrame([(measure_one(p) if p is not None else None) or dict.fromkeys(names) for p in pages], columns=names).astype(float)

    return run


#: The features and the metrics of grey images (height, width, bytes); nulls where a page cannot be measured or its bytes do
#: not fit its size.
features = _measured(measure, FEATURES)
metrics = _measured(page_metrics, METRICS)
