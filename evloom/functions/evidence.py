"""Small derivations of evidence rows: statuses, labels, references, provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(status: str = "status") -> Column:
    """Vision that says something; an unknown status says nothing."""
    return F.coalesce(F.col(status).isin("ok", "low_information"), F.lit(False))


def source_of(source: str = "source", path: str = "path") -> Column:
    """Where a video came from: its source, else its path."""
    return F.coalesce(F.nullif(F.col(source), F.lit("")), F.col(path))


def frame_index(ts: str = "ts", fps: str = "fps") -> Column:
    """An estimate of the frame's number, half to even."""
    return F.bround(F.col(ts) * F.col(fps)).cast("long")


def change_method(threshold: float) -> str:
    """How a visual change was decided, as a label."""
    return f"luma_absdiff>25/area>={threshold:g}"


def pointer_ref(x: str = "x", y: str = "y", status: str = "status") -> Column:
    """A pointer reading as an evidence reference."""
    return F.when(F.col(x).isNotNull(), F.format_string("x=%d, y=%d (status=%s)", x, y, status)).otherwise(F.format_string("(status=%s)", status))
