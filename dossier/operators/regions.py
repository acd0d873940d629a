"""Boxes on pages: a spatial join, and the findings that lie over detected signatures and stamps.

Boxes are dealt to the tiles of a grid over their page, and only boxes of one tile meet. A pair is made in the tile that
holds the first corner of what they share, so it is made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiles on a side of a page, whose sides are 1.
TILES = 8
#: Share that must be covered, and how far a rough box is grown first.
OVERLAP, MARGIN = 0.30, 0.08
SIGNATURE_WORDS = "(?i)signature|signed|stamp|seal|handwrit|initials"
#: Findings that a signature explains, and ghost findings that are set aside over one.
FILTERED = ("visual_text_alignment", "visual_resolution_sharpness_consistency")
GHOSTS = ("ghost_text_deleted", "ghost_text_replaced")
NEAR_SIGNATURE = "ghost_near_signature"
BOX = ("x", "y", "width", "height")


def grown(box: Column, margin: float) -> Column:
    """``box`` larger by ``margin`` on every side, within its page."""
    x, y = F.greatest(F.lit(0.0), box["x"] - margin), F.greatest(F.lit(0.0), box["y"] - margin)
    return F.struct(x.alias("x"), y.alias("y"), (F.least(F.lit(1.0), box["x"] + box["width"] + margin) - x).alias("width"), (F.least(F.lit(1.0), box["y"] + box["height"] + margin) - y).alias("height"))


def area(box: Column) -> Column:
    return F.greatest(box["width"], F.lit(0.0)) * F.greatest(box["height"], F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    side = lambda at, size: F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at])
    return F.greatest(side("x", "width"), F.lit(0.0)) * F.greatest(side("y", "height"), F.lit(0.0))


def _tile(v: Column) -> Column:
    return F.least(F.greatest(F.floor(v * TILES), F.lit(0)), F.lit(TILES - 1)).cast("int")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, keep: Column) -> DataFrame:
    """Rows of ``left`` and ``right`` of the same ``keys`` whose boxes ``a`` and ``b`` share an area and fulfil ``keep``, which
    is tested inside the join. Boxes are structs (x, y, width, height) in shares of a page; those without area and null ones
    meet nothing. ``right`` must not have other columns of ``left``."""

    def tiled(df: DataFrame, box: str, tile: str) -> DataFrame:
        c = F.col(box)
        side = lambda at, size: F.sequence(_tile(c[at]), _tile(c[at] + c[size]))
        tiles = F.flatten(F.transform(side("x", "width"), lambda i: F.transform(side("y", "height"), lambda j: i * TILES + j)))
        return df.filter((c["width"] > 0) & (c["height"] > 0)).withColumn(tile, F.explode(tiles))

    first = _tile(F.greatest(F.col(a)["x"], F.col(b)["x"])) * TILES + _tile(F.greatest(F.col(a)["y"], F.col(b)["y"]))
    one, other = tiled(left, a, "__tile"), tiled(right.withColumnsRenamed({k: f"__r_{k}" for k in keys}), b, "__r_tile")
    same = F.col("__tile") == F.col("__r_tile")
    for k in keys:
        same &= F.col(k) == F.col(f"__r_{k}")
    met = one.join(other, same & (F.col("__tile") == first) & (shared_area(F.col(a), F.col(b)) > 0) & keep)
    return met.drop("__tile", "__r_tile", *(f"__r_{k}" for k in keys))


def _regions(regions: DataFrame) -> DataFrame:
    """Rows (document_id, page, region_no, kind, region) of the detections; one without a page is of the first."""
    return regions.select("document_id", F.coalesce("page", F.lit(1)).alias("page"), "region_no", F.coalesce("kind", F.lit("signature")).alias("kind"), F.struct(*BOX).alias("region"))


def region_overlap_filter(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """``findings`` (document_id, finding_id, finding, severity, description, page, x, y, width, height) with severity info where
    a signature or stamp (document_id, page, region_no, kind, box) explains an alignment or sharpness finding, original_severity,
    kind and covered share of that region (null elsewhere), and the rule's sentence behind the description.

    A finding of medium or high severity is explained if its box, grown by MARGIN, covers OVERLAP of a region, and it names
    a signature or is itself so far covered; of several the first region counts. Original values stay beside the new ones,
    so the filter can be run again from them. Findings are told by (document_id, finding_id).
    """
    box = grown(F.struct(*BOX), MARGIN)
    named = F.coalesce(F.col("description").rlike(SIGNATURE_WORDS), F.lit(False))
    asked = findings.filter(F.col("finding").isin(*FILTERED) & F.col("severity").isin("medium", "high")).select("document_id", "finding_id", "page", named.alias("named"), box.alias("box"))
    share = shared_area(F.col("box"), F.col("region"))
    keep = (share / area(F.col("region")) >= OVERLAP) & (F.col("named") | (share / F.greatest(area(F.col("box")), F.lit(1e-9)) >= OVERLAP))
    met = overlapping(asked, _regions(regions), ["document_id", "page"], "box", "region", keep)
    best = met.groupBy("document_id", "finding_id").agg(F.min(F.struct("region_no", "kind", (share / area(F.col("region"))).alias("covered"))).alias("hit"))
    joined = findings.join(best, ["document_id", "finding_id"], "left")
    why = F.when(F.col("finding") == "visual_text_alignment", "handwriting and stamps keep to no baseline of typed text").otherwise("pen and stamp ink is softer than print")
    said = F.concat(F.col("description"), F.lit(" Not counted: it is about the detected "), F.col("hit.kind"), F.lit("; "), why, F.lit("."))
    hit = F.col("hit").isNotNull()
    return joined.select(
        *(c for c in findings.columns if c not in ("severity", "description")),
        F.when(hit, "info").otherwise(F.col("severity")).alias("severity"),
        F.when(hit, said).otherwise(F.col("description")).alias("description"),
        F.when(hit, F.col("severity")).alias("original_severity"),
        F.col("hit.kind").alias("region_kind"),
        F.col("hit.covered").alias("covered"),
    )


def filtered_result(filtered: DataFrame) -> DataFrame:
    """Rows (document_id, result): flag if a finding of medium or high severity is left."""
    return filtered.groupBy("document_id").agg(F.when(F.bool_or(F.col("severity").isin("medium", "high")), "flag").otherwise("pass").alias("result"))


def overlap_set_aside(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """``findings`` in which ghost findings that lie OVERLAP or more inside a detected region are set aside: finding
    ghost_near_signature, severity info, and set_aside_finding names what it was (null elsewhere). Of several regions the first counts."""
    asked = findings.filter(F.col("finding").isin(*GHOSTS)).select("document_id", "finding_id", "page", F.struct(*BOX).alias("box"))
    keep = shared_area(F.col("box"), F.col("region")) / area(F.col("box")) >= OVERLAP
    met = overlapping(asked, _regions(regions), ["document_id", "page"], "box", "region", keep)
    best = met.groupBy("document_id", "finding_id").agg(F.min(F.struct("region_no", "kind")).alias("hit"))
    hit = F.col("hit").isNotNull()
    return findings.join(best, ["document_id", "finding_id"], "left").select(
        *(c for c in findings.columns if c not in ("finding", "severity", "description")),
        F.when(hit, NEAR_SIGNATURE).otherwise(F.col("finding")).alias("finding"),
        F.when(hit, "info").otherwise(F.col("severity")).alias("severity"),
        F.when(hit, F.concat(F.lit("Set aside: over the detected "), F.col("hit.kind"), F.lit(". "), F.col("description"))).otherwise(F.col("description")).alias("description"),
        F.when(hit, F.col("finding")).alias("set_aside_finding"),
    )
