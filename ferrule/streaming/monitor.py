"""Drift monitoring on event streams: windowed histograms against a fixed reference, late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import bin_of, drift_band


def windowed_histograms(events: DataFrame, edges: list[float], time: str = "ts", value: str = "value", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, n, h0...): counts of the reference's bins for each window; works on streams and tables alike.

    One row a window is kept as state, so the state is bounded by the windows
    that are still open.
    """
    k = max(1, len(edges) - 1)
    b = bin_of(F.col(value), edges)
    counts = [F.count_if(b == i).alias(f"h{i}") for i in range(k)]
    return events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), *counts)


def stability(histograms: DataFrame, reference: list[float], alpha: float = 0.5) -> DataFrame:
    """(window, n, psi, band): stability index of each window's smoothed shares against the reference's."""
    k = len(reference)
    share = lambda i: (F.col(f"h{i}") + alpha) / (F.col("n") + alpha * k)
    psi = sum(((share(i) - p) * F.log(share(i) / p) for i, p in enumerate(reference)), F.lit(0.0))
    return histograms.select("window", "n", psi.alias("psi"), drift_band(psi).alias("band"))


def reference_shares(sample: DataFrame, edges: list[float], value: str = "value", alpha: float = 0.5) -> list[float]:
    """Smoothed shares of a reference sample in the bins: as many numbers as bins."""
    k = max(1, len(edges) - 1)
    rows = {r["b"]: r["count"] for r in sample.groupBy(bin_of(F.col(value), edges).alias("b")).count().collect()}
    total = sum(rows.values())
    return [(rows.get(i, 0) + alpha) / (total + alpha * k) for i in range(k)]


def live_documents(changes: DataFrame, key: str = "doc_id", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The current rows of an index fed by upserts and tombstones: the last version of each key that is not deleted."""
    columns = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("s"))
    return last.select(key, *[F.col(f"s.{c}").alias(c) for c in columns]).where(~F.col(deleted)).drop(deleted)
