"""Quality scores, tiers, resolutions and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quality_score(lap_var: Column, std: Column, edges: Column, noise: Column, low: Column, high: Column) -> Column:
    part = lambda c, full: F.least(c / full, F.lit(1.0))
    score = 0.30 * part(lap_var, 1000) + 0.25 * part(std, 70) + 0.15 * F.least(edges * 10, F.lit(1.0)) + 0.20 * (1 - part(noise, 20)) + 0.10 * (high - low) / 255
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def quality_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "medium").otherwise("poor")


def optimal_dpi(sizes: Column, has_images: Column) -> Column:
    """By the upper median of the font sizes; without any, the text is a scan."""
    median = F.element_at(F.sort_array(sizes), (F.floor(F.size(sizes) / 2) + 1).cast("int"))
    dpi = F.when(median >= 12, 300).when(median >= 9, 400).otherwise(600)
    return F.when(F.size(sizes) == 0, 600).otherwise(F.when(has_images, F.greatest(dpi, F.lit(400))).otherwise(dpi))


def mean_confidence(conf: Column) -> Column:
    """Aggregate: the mean of values from 0 up, else 0."""
    return F.coalesce(F.avg(F.when(conf >= 0, conf)), F.lit(0.0))


def vlm_confidence(text: Column) -> Column:
    return F.least(F.lit(0.95), 0.7 + F.length(text) / 1000 * 0.2)


def upload_error(content_type: Column, size: Column, most_mb: int = 25) -> Column:
    """The first check that an upload fails, or null."""
    return (
        F.when(F.coalesce(content_type, F.lit("")) != "application/pdf", "Only PDF uploads are supported at the moment.")
        .when(F.coalesce(size, F.lit(0)) == 0, "Uploaded file is empty.")
        .when(size / (1024 * 1024) > most_mb, f"File is too large. Maximum size is {most_mb}MB.")
    )
