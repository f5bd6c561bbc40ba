"""Cross-site line deduplication by distinct-site spread, DataFrame only.

HyperLogLog sketches of the sites of each line are merged by aggregation.
Lines whose estimate is near the threshold get exact distinct counts; the
others are decided by the estimate.  A line on enough sites is boilerplate
and is taken out of all documents but the one with the least id, so that no
text is lost from the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

MIN_SITES = 10
SKETCH_BITS = 12
#: estimates within this share of the threshold are counted exactly
NEAR = 0.25
#: fixed value: blanks that do not matter at either end of a line
EDGE = " \t\x0b\x0c\r"


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(la, lb, holder) of lines found on ``min_sites`` sites or more."""
    spread = stash(
        lines.groupBy("la", "lb").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"), F.min("_id").alias("holder"))
        .where(F.col("sites") >= int(min_sites * (1 - NEAR)))
    )
    high = min_sites * (1 + NEAR)
    near = spread.where(F.col("sites") <= high)
    exact = (
        lines.join(near.select("la", "lb"), ["la", "lb"], "left_semi")
        .groupBy("la", "lb", "site").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("la", "lb").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_sites)
    )
    sure = spread.where(F.col("sites") > high).select("la", "lb", "holder")
    return sure.unionByName(near.join(exact, ["la", "lb"]).select("la", "lb", "holder"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns of ``df``, with boilerplate lines taken out of the
    text; added are n_lines (lines of the text that are not blank) and
    n_removed, replacing columns of those names.

    Lines are compared without blanks at their ends; blank lines stay.  The
    rows with the least id that have a line keep it (all of them, if ids
    repeat; a null id only if no other id has the line).  A null site is a site
    of its own; a null text stays null with no lines, an empty one empty; repeated
    rows are treated alike; the lines of a very long text are rows until their
    places are gathered; ties in ids as said; an empty table gives no rows.
    Work tables are written when this is called."""
    own = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = df.select(
        *own,
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_ka"),
        F.xxhash64(F.lit(17), F.length(F.col(text_col)), F.col(text_col), F.col(id_col)).alias("_kb"),
    )
    bare = F.btrim(F.col("_line"), F.lit(EDGE))
    lines = stash(
        docs.select(
            F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("s"), F.col(site_col)), F.lit("")).alias("site"), "_ka", "_kb",
            F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "_line"),
        )
        .select("_id", "site", "_ka", "_kb", "_pos", bare.alias("_line"))
        .where("_line != ''")
        .select("_id", "site", "_ka", "_kb", "_pos", F.xxhash64("_line").alias("la"), F.xxhash64(F.lit(17), "_line").alias("lb"))
    )
    boiler = stash(boilerplate_lines(lines, min_sites))
    gone = (
        lines.join(boiler, ["la", "lb"])
        .where(~F.col("_id").eqNullSafe(F.col("holder")))
        .groupBy("_ka", "_kb").agg(F.collect_set("_pos").alias("_gone"))
    )
    joined = docs.join(gone.hint("shuffle_hash"), ["_ka", "_kb"], "left").withColumn("_all", F.when(F.col("_gone").isNotNull(), F.split(F.col(text_col), "\n")))
    all_lines = F.split(F.col(text_col), "\n")
    # the places that stay are sorted out once, not looked up for every line
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("_all", i)), "\n")
    count = F.size(F.filter(all_lines, lambda x: F.btrim(x, F.lit(EDGE)) != ""))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in own],
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(count).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
