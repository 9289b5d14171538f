"""Training patches over label rasters, the table of their cells from many sources, and spectral windows of places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .learning import spread

#: Where the sources of a spectral window stand in its 17 channels; radar, red edge and the 10 m near infrared stay masked.
CHANNELS = 17
OPTICAL = {"blue": 2, "green": 3, "red": 4, "nir": 9, "swir1": 10, "swir2": 11}
TEMPERATURE, RAIN, ELEVATION, SLOPE, NDVI = 12, 13, 14, 15, 16


def patch_blocks(patches: DataFrame, tile: int, stride: int) -> DataFrame:
    """Patches with the blocks (``block_row``, ``block_col``) of ``stride`` cells they are made of."""
    parts = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + (tile // stride - 1)))
    return patches.withColumn("block_row", parts("patch_row")).withColumn("block_col", parts("patch_col"))


def select_patches(labels: DataFrame, scene: str, value: str, rows: int, cols: int, tile: int = 224, stride: int = 112, least: int = 10, background: float = 0.15) -> DataFrame:
    """All patches with at least ``least`` cells above 0, and of each scene a share of the others that are more than half valid.

    Patches of ``tile`` cells start every ``stride`` cells and lie inside the raster of ``rows`` by ``cols``; ``patch_row`` and
    ``patch_col`` count strides. Cells are first counted in blocks of a stride, so patches that overlap copy blocks, not
    cells. The background is drawn in the order of a hash of scene and place, at least one a scene that has any: reruns
    agree. Null or NaN labels and missing cells are not valid; cells outside the raster or without a place count nowhere;
    repeated cells count each; without labels there are no patches.
    """
    if tile % stride:
        raise ValueError("the stride must divide the patch")
    valid = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    blocks = labels.filter(inside).groupBy(scene, F.floor(F.col("row") / stride).alias("br"), F.floor(F.col("col") / stride).alias("bc"))
    blocks = blocks.agg(F.count_if(valid).alias("v"), F.count_if(valid & (F.col(value) > 0)).alias("f"))
    starts = lambda c: F.explode(F.sequence(F.col(c) - (tile // stride - 1), F.col(c)))
    p = blocks.withColumn("patch_row", starts("br")).withColumn("patch_col", starts("bc"))
    fits = lambda c, n: F.col(c).between(0, max(0, (n - tile) // stride))
    p = p.filter(fits("patch_row", rows) & fits("patch_col", cols)).groupBy(scene, "patch_row", "patch_col").agg(F.sum("v").alias("valid_cells"), F.sum("f").alias("fire_cells"))
    p = p.withColumn("is_fire", F.col("fire_cells") >= least).filter(F.col("is_fire") | (F.col("valid_cells") > tile * tile / 2))
    place = [F.md5(F.concat_ws("-", scene, "patch_row", "patch_col")), F.col("patch_row"), F.col("patch_col")]
    group = Window.partitionBy(scene, "is_fire")
    p = p.withColumn("__nth", F.row_number().over(group.orderBy(*place))).withColumn("__of", F.count("*").over(group))
    drawn = F.col("__nth") <= F.greatest(F.lit(1), F.floor(F.col("__of") * background))
    return p.filter(F.col("is_fire") | drawn).drop("__nth", "__of")


def assemble_patches(patches: DataFrame, scenes: DataFrame, cells: DataFrame, statics: DataFrame, labels: DataFrame, scene: str, frames: list[str], bands: list[str], tile: int = 224, stride: int = 112, rows: int | None = None) -> DataFrame:
    """A row for each cell of each patch: its frames in time, what is fixed there, its label, and what holds for the scene.

    ``patches`` come from ``select_patches``. ``scenes`` has a row a scene: ``frames`` name its columns with the scenes that
    serve as its frames (null: none), all others (weather, tier, split) go to every cell. ``cells`` has ``bands`` of (scene,
    row, col), ``statics`` columns of (row, col), ``labels`` those of (scene, row, col); a cell without them gets nulls, as
    does a frame without a scene. Frames are arrays of structs in the order of ``frames``. A cell meets its frames and what is
    fixed there once, however many patches hold it, and then the patches of its block in one join on the block. Frames are
    gathered by the band, without sorting their cells. Tasks take about 500,000 cells each; ``rows`` is the number of labels
    (counted if not given).
    One row a key is expected of each source: repeated ones repeat cells, and of repeated ``cells`` each band's greatest counts.
    Cells of no patch are not read into the result.
    """
    rows = labels.count() if rows is None else rows
    served = scenes.select(F.col(scene).alias("__for"), F.posexplode(F.array(*frames)).alias("__i", scene)).filter(F.col(scene).isNotNull())
    seen = cells.select(scene, "row", "col", *(F.col(b).alias(f"__b{n}") for n, b in enumerate(bands))).join(served, scene)
    seen = spread(seen.drop(scene).withColumnRenamed("__for", scene), [scene, "row", "col"], rows)
    at = lambda i, c: F.max(F.when(F.col("__i") == i, c))
    parts = [at(i, c).alias(f"__{i}{name}") for i in range(len(frames)) for name, c in (("", F.lit(True)), *((f"_{n}", F.col(f"__b{n}")) for n in range(len(bands))))]
    frame = lambda i: F.when(F.col(f"__{i}"), F.struct(*(F.col(f"__{i}_{n}").alias(b) for n, b in enumerate(bands))))
    framed = seen.groupBy(scene, "row", "col").agg(*parts).select(scene, "row", "col", F.array(*map(frame, range(len(frames)))).alias("frames"))
    full = spread(labels, [scene, "row", "col"], rows).join(framed, [scene, "row", "col"], "left")
    full = spread(full, ["row", "col"], rows).join(statics, ["row", "col"], "left")
    block = {b: F.floor(F.col(c) / stride) for c, b in (("row", "block_row"), ("col", "block_col"))}
    at_block = [scene, "block_row", "block_col"]
    placed = spread(full.withColumns(block), at_block, rows).join(patch_blocks(patches, tile, stride), at_block).drop(*at_block[1:])
    return placed.join(scenes.drop(*frames), scene, "left")


def channels(elevation: Column, slope: Column, of: Callable[[str], Column] = F.col) -> Column:
    """The channels of one frame (null: masked) from columns blue to swir2 in raw counts, ``temp_c`` and ``precip_mm``, as ``of`` gives them."""
    share = {b: of(b) / 10000.0 for b in OPTICAL}
    at = {OPTICAL[b]: c for b, c in share.items()}
    both = of("temp_c").isNotNull() & of("precip_mm").isNotNull()
    at[NDVI] = (share["nir"] - share["red"]) / (share["nir"] + share["red"] + 1e-8)
    at |= {TEMPERATURE: F.when(both, (of("temp_c") + 273.15) / 35.0), RAIN: F.when(both, of("precip_mm") / 1000.0 / 0.03), ELEVATION: elevation / 2000.0, SLOPE: slope / 50.0}
    return F.array(*(at.get(i, F.lit(None).cast("double")) for i in range(CHANNELS)))


def spectral_windows(seen: DataFrame, weather: DataFrame, terrain: DataFrame, key: str, date: str, back: tuple[int, ...] = (16, 32), tolerance: int = 12) -> DataFrame:
    """``key``, ``date``, ``month`` (0 to 11), ``x`` and ``mask``: a frame of 17 channels for the date and each step ``back``.

    A step takes the observation of the place nearest to that many days before, within ``tolerance`` days; of equally near ones
    the earlier. Masked channels (1 in ``mask``) are 0 in ``x``: a frame without an observation but for the terrain, the
    channels no source has, weather that is missing for that place and day, null bands. ``seen`` has the bands of ``OPTICAL``,
    ``weather`` temp_c and precip_mm by place and day, ``terrain`` elevation_m and slope_deg by place (missing: 500 and 5).
    Of repeated observations of a day the greatest counts; rows without place or date have no window. A place finds its
    observations by windows over days, in one exchange of raw counts; no channels are moved.
    """
    # one row a place and day on every side, so a place's window holds no more rows than its series has days
    once = seen.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(key, date).agg(F.max(F.struct(*OPTICAL)).alias("s"))
    both = F.col("temp_c").isNotNull() & F.col("precip_mm").isNotNull()
    w = weather.groupBy(key, date).agg(F.min(F.struct(*(F.when(both, F.col(c)).alias(c) for c in ("temp_c", "precip_mm")))).alias("w"))
    t = terrain.groupBy(key).agg(F.min(F.struct(F.coalesce("elevation_m", F.lit(500.0)).alias("elevation_m"), F.coalesce("slope_deg", F.lit(5.0)).alias("slope_deg"))).alias("t"))
    day = once.join(w, [key, date], "left").select(key, date, F.datediff(date, F.lit("1970-01-01").cast("date")).alias("__d"), "s.*", "w.*")
    day = day.select(key, date, "__d", F.struct("__d", *OPTICAL, "temp_c", "precip_mm").alias("__o")).join(t, key, "left")

    series = Window.partitionBy(key).orderBy("__d")
    for n in back:
        want = F.col("__d") - n
        earlier, later = F.last("__o").over(series.rangeBetween(-n - tolerance, -n)), F.first("__o").over(series.rangeBetween(1 - n, tolerance - n))
        day = day.withColumns({f"__e{n}": earlier, f"__l{n}": later})
        closer = F.col(f"__l{n}").isNull() | (want - F.col(f"__e{n}")["__d"] <= F.col(f"__l{n}")["__d"] - want)
        day = day.withColumn(f"__f{n}", F.when(F.col(f"__e{n}").isNotNull() & closer, F.col(f"__e{n}")).otherwise(F.col(f"__l{n}"))).drop(f"__e{n}", f"__l{n}")
    ground = (F.coalesce(F.col("t.elevation_m"), F.lit(500.0)), F.coalesce(F.col("t.slope_deg"), F.lit(5.0)))
    frames = F.transform(F.array("__o", *(f"__f{n}" for n in back)), lambda o: channels(*ground, lambda c: o[c]))
    full = day.select(key, date, frames.alias("frames"))
    x = F.transform("frames", lambda c: F.transform(c, lambda v: F.coalesce(v, F.lit(0.0))))
    mask = F.transform("frames", lambda c: F.transform(c, lambda v: v.isNull().cast("int")))
    return full.select(key, date, (F.month(date) - 1).alias("month"), x.alias("x"), mask.alias("mask"))
