"""Slides among the frames of a video: a fold over each stream of frames in order of time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Slides:
    """Fold over the frames of a stream in order of time, which holds the last accepted frame only."""

    def __init__(self, gap: float = 1.0, correlation: float = 0.92, similarity: float = 0.85, last: tuple | None = None):
        self.gap, self.correlation, self.similarity, self.last = gap, correlation, similarity, last

    def takes(self, at: float, histogram: np.ndarray, pixels: np.ndarray) -> bool:
        """Whether a frame is a new slide: the first, or one that differs from the last accepted one and isn't too near."""
        if self.last is not None and (at - self.last[0] < self.gap or self._like(histogram, pixels)):
            return False
        self.last = at, histogram, pixels
        return True

    def _like(self, histogram: np.ndarray, pixels: np.ndarray) -> bool:
        _, a, x = self.last
        da, db = a - a.mean(), histogram - histogram.mean()
        spread = np.sqrt((da * da).sum() * (db * db).sum())
        if (float((da * db).sum() / spread) if spread else float(np.array_equal(a, histogram))) < self.correlation:
            return False
        mx, my = x.mean(), pixels.mean()
        covariance = ((x - mx) * (pixels - my)).mean()
        return (2 * mx * my + 6.5025) * (2 * covariance + 58.5225) / ((mx**2 + my**2 + 6.5025) * (x.var() + pixels.var() + 58.5225)) >= self.similarity


def slide_changes(frames: DataFrame, gap: float = 1.0, correlation: float = 0.92, similarity: float = 0.85) -> DataFrame:
    """Frames that differ from the last accepted one (L14). frames: stream, at, histogram and pixels as arrays.

    A frame less than gap seconds after the last accepted one is rejected; else it is accepted if the correlation
    of the histograms or the similarity of the pixels is below its mark. The frames of a stream pass by in order of
    time; the last accepted one is all that is held of it.
    """
    kind = frames.schema["stream"].dataType.simpleString()

    def fold(batches):
        stream, slides = None, None
        for b in batches:
            kept = []
            for i, (name, at) in enumerate(zip(b.column("stream").to_pylist(), b.column("at").to_pylist(), strict=True)):
                if slides is None or name != stream:
                    stream, slides = name, Slides(gap, correlation, similarity)
                if slides.takes(at, *(np.asarray(b.column(c)[i].values, float) for c in ("histogram", "pixels"))):
                    kept.append(i)
            yield b.select(["stream", "at"]).take(pa.array(kept, pa.int64()))

    rows = frames.select("stream", frames["at"].cast("double").alias("at"), "histogram", "pixels")
    return rows.repartition("stream").sortWithinPartitions("stream", "at").mapInArrow(fold, f"stream {kind}, at double")
