"""Which asset of a scene is downloaded, what a pull will cost, and what has come of it.

Assets are rows (scene, source, pos, key, roles, media_type, href, size_bytes): pos is the place of an asset among
its scene's. Sizes that the catalog lacks are unknown, never 0; a scene with nothing to download is a known 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys, roles and parts of keys that mark previews, and layers that aren't imagery.
BROWSE_KEYS = "rendered_preview thumbnail preview quicklook browse".split()
BROWSE_ROLES = "thumbnail overview preview rendered_preview".split()
AUXILIARY_ROLES = "cloud cloud-shadow snow-ice water-mask data-mask saturation metadata".split()
AUXILIARY_KEYS = "ang saa sza vaa vza aot wvp scl".split()
AUXILIARY_STARTS = "qa oa_ tie_ tie-".split()
AUXILIARY_PARTS = "mask cloud angle azimuth zenith meteo coordinates geometr flags quality manifest removed instrument".split()


def _roles() -> Column:
    return F.transform(F.coalesce("roles", F.array().cast("array<string>")), F.lower)


def _has(*names: str) -> Column:
    return F.arrays_overlap(_roles(), F.array(*map(F.lit, names)))


def is_browse() -> Column:
    """Previews, thumbnails and overviews."""
    media = F.lower(F.coalesce("media_type", F.lit("")))
    return F.lower("key").isin(BROWSE_KEYS) | _has(*BROWSE_ROLES) | media.rlike("^image/(jpeg|jpg)") | (media.startswith("image/png") & ~_has("data"))


def is_auxiliary() -> Column:
    """Quality, mask and sun or view geometry layers."""
    key = F.lower("key")
    named = key.isin(AUXILIARY_KEYS) | key.rlike(f"^({'|'.join(AUXILIARY_STARTS)})") | key.rlike("|".join(AUXILIARY_PARTS))
    return _has(*AUXILIARY_ROLES) | named


def is_geotiff() -> Column:
    path = F.lower(F.regexp_replace("href", r"[?#].*$", ""))
    return F.lower(F.coalesce("media_type", F.lit(""))).contains("tiff") | path.rlike(r"\.tiff?$")


def preference(red: Column | None = None) -> Column:
    """Lower is better, null is never: visual, the red band, reflectance, imagery files, imagery archives, any data, any
    that isn't a preview. red: the key of the scene's red band."""
    data = _has("data")
    ladder = F.when(is_browse(), None).when(F.col("key") == "visual", 0)
    if red is not None:
        ladder = ladder.when(F.col("key") == red, 1)
    return (
        ladder.when(data & _has("reflectance"), 2)
        .when(data & ~is_auxiliary() & ~_has("archive"), 3)
        .when(data & ~is_auxiliary(), 4)
        .when(data, 5)
        .otherwise(6)
    )


def picked_assets(assets: DataFrame, red: Column | None = None) -> DataFrame:
    """The asset to download of each scene (source, scene): the best by preference, then by place. All its columns are
    null for a scene with nothing to download."""
    ranked = assets.withColumn("_rank", preference(red))
    row = F.struct("key", "href", "media_type", "roles", "size_bytes")
    best = F.min_by(F.when(F.col("_rank").isNotNull(), row), F.struct(F.col("_rank").isNull(), "_rank", "pos")).alias("a")
    return ranked.groupBy("source", "scene").agg(best).select("source", "scene", "a.*")


def estimate(picked: DataFrame, present: DataFrame, windowed: bool = False, unknown_sources: tuple[str, ...] = ()) -> DataFrame:
    """One row a source: scene_count, known_bytes, unknown_scenes, windowed, already_present.

    present: source, scene of what is on disk or in a manifest. windowed: GeoTIFFs are read as windows, which is work
    even if the file is there. unknown_sources: those whose catalog size isn't what a pull writes."""
    window = (is_geotiff() & F.col("href").isNotNull()) if windowed else F.lit(False)
    forced = F.col("source").isin(*unknown_sources) if unknown_sources else F.lit(False)
    there = present.select("source", "scene", F.lit(True).alias("_there")).distinct()
    rows = picked.withColumn("_window", F.coalesce(window, F.lit(False)) & ~forced).withColumn("_forced", forced)
    rows = rows.join(there, ["source", "scene"], "left").withColumn("_there", F.coalesce("_there", F.lit(False)) & ~F.col("_window") & ~F.col("_forced"))
    left = ~F.col("_there")
    unknown = F.col("_forced") | (F.col("href").isNotNull() & F.col("size_bytes").isNull())
    return rows.groupBy("source").agg(
        F.count_if(left).alias("scene_count"),
        F.coalesce(F.sum(F.when(left & ~unknown, F.coalesce("size_bytes", F.lit(0)))), F.lit(0)).alias("known_bytes"),
        F.count_if(left & unknown).alias("unknown_scenes"),
        F.count_if(left & F.col("_window")).alias("windowed"),
        F.count_if(F.col("_there")).alias("already_present"),
    )


def totals(per_source: DataFrame) -> DataFrame:
    """The estimate by source and, under a null source, over all of them."""
    names = [c for c in per_source.columns if c != "source"]
    return per_source.rollup("source").agg(*[F.sum(c).alias(c) for c in names])


def run_summary(outcomes: DataFrame) -> DataFrame:
    """saved, skipped, failed and no_asset by source."""
    return outcomes.groupBy("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("saved", "skipped", "failed", "no_asset")])


def exit_status(summary: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: status 1 if every source failed to search, or nothing that was tried has been saved or was there.

    errors: source, error (null where the search went well)."""
    s = summary.agg(
        F.coalesce(F.sum(F.col("saved") + F.col("skipped")), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.col("saved") + F.col("skipped") + F.col("failed") + F.col("no_asset")), F.lit(0)).alias("tried"),
    )
    e = errors.agg(F.coalesce(F.bool_and(F.col("error").isNotNull()), F.lit(False)).alias("all_failed"))
    return s.crossJoin(e).select("good", "tried", "all_failed", F.when(F.col("all_failed") | ((F.col("tried") > 0) & (F.col("good") == 0)), 1).otherwise(0).alias("status"))


def provider_notes(sources: DataFrame) -> DataFrame:
    """The providers of a run, each once, with the number of their sources. sources: source, provider."""
    return sources.groupBy("provider").agg(F.countDistinct("source").alias("n_sources"))
