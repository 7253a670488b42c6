"""Footprint search by bounding box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.boxes import CORNERS, overlaps


def bbox_overlap(footprints: DataFrame, areas: DataFrame, ident: str = "id") -> DataFrame:
    """(area_id, footprint_id) where the bounding boxes share more than a border.

    Both tables hold ``id, x1, y1, x2, y2``. A grid join, so either side may be large.
    """
    need = [ident, *CORNERS]
    pairs = overlaps(areas.select(*need), footprints.select(*need), [], ident)
    return pairs.select(F.col("left_id").alias("area_id"), F.col("right_id").alias("footprint_id"))
