"""Label corpus: staging, tiling, balancing, augmentation, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round, stored
from scenespark.functions import geometry as G
from scenespark.operators.checkpoints import cut
from scenespark.operators.ordering import with_hash_position, with_sorted_position

BOX = ["cx", "cy", "w", "h"]


def source_stem(stem: str = "stem", source: str = "source"):
    """Stems are only unique within a source."""
    return F.concat(F.col(source), F.lit("_"), F.col(stem))


def to_shares(pixel: DataFrame) -> DataFrame:
    share = G.corners_to_center("xmin", "ymin", "xmax", "ymax", "img_w", "img_h")
    return pixel.withColumns(share).drop("xmin", "ymin", "xmax", "ymax")


def computed(df: DataFrame, *columns) -> DataFrame:
    """Select columns as finished values.

    Filters on the result are not pushed into the expressions again, which would
    evaluate long box arithmetic once per mention.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def _fitted(df: DataFrame, keep: list[str]) -> DataFrame:
    """Boxes ``_px, _py, _pw, _ph`` (shares of the target square) fitted into it;
    boxes under 3 px drop out."""
    step = df.withColumns({"cx": G.clamp("_px", 0.001, 0.999), "cy": G.clamp("_py", 0.001, 0.999)})
    step = step.withColumns({
        "w": F.least(F.col("_pw"), 2 * F.least(F.col("cx"), 1 - F.col("cx"))),
        "h": F.least(F.col("_ph"), 2 * F.least(F.col("cy"), 1 - F.col("cy"))),
    })
    return computed(step, *keep, *BOX).filter(G.at_least_px("w", "h"))


def _with_letterbox(df: DataFrame, size: int = C.IMG_SIZE) -> DataFrame:
    """Scale and padding of the letterbox as columns, each computed once."""
    scaled = df.withColumn("_scale", F.least(F.lit(size) / F.col("img_w"), F.lit(size) / F.col("img_h")))
    return scaled.withColumns({
        "_pad_x": F.floor((F.lit(size) - F.floor(F.col("img_w") * F.col("_scale"))) / 2),
        "_pad_y": F.floor((F.lit(size) - F.floor(F.col("img_h") * F.col("_scale"))) / 2),
    })


def _letterboxed(size: int = C.IMG_SIZE) -> dict:
    w, h, s = F.col("img_w"), F.col("img_h"), F.col("_scale")
    return {
        "_px": (F.col("cx") * w * s + F.col("_pad_x")) / size, "_py": (F.col("cy") * h * s + F.col("_pad_y")) / size,
        "_pw": F.col("w") * w * s / size, "_ph": F.col("h") * h * s / size,
    }


def letterbox_labels(labels: DataFrame) -> DataFrame:
    """Share boxes moved into the letterboxed square; boxes under 3 px drop out."""
    keep = [c for c in labels.columns if c not in BOX]
    return _fitted(_with_letterbox(labels).withColumns(_letterboxed()), keep)


def needs_tiles():
    return (F.col("img_w") > C.TILE_TRIGGER) | (F.col("img_h") > C.TILE_TRIGGER)


def shrink_oversized(pixel: DataFrame, where=None) -> DataFrame:
    """Scale images whose longer side exceeds the limit, boxes along with them."""
    limit = C.TILE_MAX_SIDE
    big = (F.col("img_w") > limit) | (F.col("img_h") > limit)
    if where is not None:
        big = big & where
    scale = F.when(big, F.least(F.lit(limit) / F.col("img_w"), F.lit(limit) / F.col("img_h"))).otherwise(F.lit(1.0))
    s = pixel.withColumn("_s", scale)
    return s.withColumns({
        **{c: F.col(c) * F.col("_s") for c in ("xmin", "ymin", "xmax", "ymax")},
        "img_w": F.when(big, F.floor(F.col("img_w") * F.col("_s"))).otherwise(F.col("img_w")).cast("int"),
        "img_h": F.when(big, F.floor(F.col("img_h") * F.col("_s"))).otherwise(F.col("img_h")).cast("int"),
    }).drop("_s")


def tile_grid(images: DataFrame) -> DataFrame:
    """All tiles of each image."""
    return images.select("stem", "img_w", "img_h", F.explode(G.tile_offsets("img_w")).alias("tile_x")).withColumn(
        "tile_y", F.explode(G.tile_offsets("img_h"))
    )


def _in_tile(x, y, size: int = C.IMG_SIZE) -> dict:
    return {
        "_px": (x - F.col("tile_x")) / size, "_py": (y - F.col("tile_y")) / size,
        "_pw": (F.col("xmax") - F.col("xmin")) / size, "_ph": (F.col("ymax") - F.col("ymin")) / size,
    }


def tile_labels(pixel: DataFrame) -> DataFrame:
    """Annotations cut into the tiles that hold their centre.

    Tiles come from the centre itself (at most three per axis), so there is no
    join with a tile table and no shuffle.
    """
    keep = [c for c in pixel.columns if c not in ("xmin", "ymin", "xmax", "ymax")] + ["tile_x", "tile_y"]
    mid = pixel.withColumn("_x", (F.col("xmin") + F.col("xmax")) / 2).withColumn(
        "_y", (F.col("ymin") + F.col("ymax")) / 2
    )
    placed = mid.withColumn("tile_x", F.explode(G.tiles_holding("_x", "img_w"))).withColumn(
        "tile_y", F.explode(G.tiles_holding("_y", "img_h"))
    )
    return _fitted(placed.withColumns(_in_tile(F.col("_x"), F.col("_y"))), keep)


def within_limits(images: DataFrame, size_col: str = "bytes") -> DataFrame:
    """Images above the size limit are not prepared."""
    return images.filter(F.col(size_col) / (1024 * 1024) <= C.MAX_IMAGE_MB)


def small_image_gate(labels: DataFrame) -> DataFrame:
    return labels.filter("cx > 0 AND cx < 1 AND cy > 0 AND cy < 1 AND w > 0.003 AND h > 0.003")


# Boxes are stored with six decimals, and later steps see the stored values.
def _stored(labels: DataFrame) -> DataFrame:
    out = computed(labels, "stem", "source", "class_id", *[stored(c, 6).alias(c) for c in BOX])
    return out.filter(G.label_is_valid("class_id", *BOX))


def stage(pixel: DataFrame) -> DataFrame:
    """Mapped pixel annotations of all sources -> one staged label table.

    Needs ``stem, source, img_w, img_h, class_id`` and corner boxes; with the size of the
    image file in ``bytes``, images of the source that is cut into tiles are left out above
    the limit. One narrow
    pass: each row takes the way of its source (letterboxed as it is, clamped
    first, or cut into tiles) inside the projection, so sources are neither
    scanned again nor united.
    """
    dota, visdrone = F.col("source") == "dota", F.col("source") == "visdrone"
    tiled = dota & ((F.col("_w0") > C.TILE_TRIGGER) | (F.col("_h0") > C.TILE_TRIGGER))
    if "bytes" in pixel.columns:
        pixel = pixel.filter(~dota | (F.col("bytes") / (1024 * 1024) <= C.MAX_IMAGE_MB))
    rows = pixel.withColumn("stem", source_stem()).withColumns({"_w0": F.col("img_w"), "_h0": F.col("img_h")})
    rows = rows.withColumn("_tiled", tiled)
    rows = shrink_oversized(rows, F.col("_tiled"))
    share = G.corners_to_center("xmin", "ymin", "xmax", "ymax", "img_w", "img_h")
    rows = rows.withColumns(share).withColumns(
        {c: F.when(visdrone, G.clamp(c, 0.001, 0.999)).otherwise(F.col(c)) for c in BOX}
    ).withColumns({"_x": (F.col("xmin") + F.col("xmax")) / 2, "_y": (F.col("ymin") + F.col("ymax")) / 2})
    rows = computed(
        rows, "stem", "source", "class_id", "img_w", "img_h", "_tiled", *BOX, "_x", "_y", "xmin", "ymin", "xmax", "ymax"
    )
    usable = (
        F.when(F.col("_tiled"), F.lit(True))
        .when(dota, (F.col("cx") > 0) & (F.col("cx") < 1) & (F.col("cy") > 0) & (F.col("cy") < 1)
              & (F.col("w") > 0.003) & (F.col("h") > 0.003))
        .when(visdrone, (F.col("w") * F.col("img_w") >= C.MIN_BOX_PX) & (F.col("h") * F.col("img_h") >= C.MIN_BOX_PX))
        .otherwise(G.label_is_valid("class_id", *BOX))
    )
    whole = F.array(F.lit(-1))
    placed = (
        _with_letterbox(rows.filter(usable))
        .withColumn("tile_x", F.explode(F.when(F.col("_tiled"), G.tiles_holding("_x", "img_w")).otherwise(whole)))
        .withColumn("tile_y", F.explode(F.when(F.col("_tiled"), G.tiles_holding("_y", "img_h")).otherwise(whole)))
    )
    in_tile, in_square = _in_tile(F.col("_x"), F.col("_y")), _letterboxed()
    boxed = placed.withColumns({
        **{c: F.when(F.col("_tiled"), in_tile[c]).otherwise(in_square[c]) for c in in_tile},
        "stem": F.when(F.col("_tiled"), F.concat("stem", F.lit("_t"), F.col("tile_x"), F.lit("_"), F.col("tile_y")))
        .otherwise(F.col("stem")),
    })
    return _stored(_fitted(boxed, ["stem", "source", "class_id"]))


def image_index(labels: DataFrame) -> DataFrame:
    """Classes and box count of each image: at most seven classes per row."""
    return labels.groupBy("stem").agg(
        F.array_sort(F.collect_set("class_id")).alias("classes"), F.count(F.lit(1)).alias("boxes")
    )


def categorise(index: DataFrame) -> DataFrame:
    """Balancing category, most valuable content first."""
    def has(c):
        return F.array_contains("classes", c)

    return index.withColumn(
        "category",
        F.when(F.arrays_overlap("classes", F.lit(C.RARE_CLASSES)), "rare")
        .when(has(0), "person")
        .when(has(2) & has(1), "crowd_vehicle")
        .when(has(2), "crowd_only")
        .when(has(1), "vehicle_only")
        .otherwise("other"),
    )


def class_distribution(labels: DataFrame) -> DataFrame:
    """Images and boxes per class with the share of images; two levels, no distinct shuffle."""
    per_image = labels.groupBy("stem", "class_id").agg(F.count(F.lit(1)).alias("n"))
    total = labels.select("stem").distinct().agg(F.count(F.lit(1)).alias("n"))
    return per_image.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("images"), F.sum("n").alias("annotations")
    ).withColumn(
        "image_pct", exact_round(F.col("images") / F.greatest(total.scalar(), F.lit(1)) * 100, 1)
    )


def downsample(categories: DataFrame, seed: int = C.SEED) -> DataFrame:
    """Keep a fixed share of the over-represented categories, all of the others.

    Exactly ``floor(n * share)`` images in hash order. Ranks are two-level, so
    one huge category does not end up in one task.
    """
    thinned = categories.filter(F.col("category").isin(list(C.KEEP_RATIO)))
    whole = categories.filter(~F.col("category").isin(list(C.KEEP_RATIO)))
    ratio = F.create_map(*[F.lit(x) for kv in C.KEEP_RATIO.items() for x in kv])[F.col("category")]
    ranked = with_hash_position(thinned, ["category"], "stem", seed, total="_n")
    kept = ranked.filter(F.col("pos") <= F.floor(F.col("_n") * ratio)).drop("_n", "pos")
    return whole.unionByName(kept)


def rare_image_counts(selected: DataFrame) -> DataFrame:
    """Selected rare images per rare class, one row."""
    return selected.filter("category = 'rare'").agg(
        *[F.count_if(F.array_contains("classes", c)).alias(f"class_{c}") for c in C.RARE_CLASSES]
    )


def to_augment(selected: DataFrame) -> DataFrame:
    """Rare images holding a rare class that has too few images."""
    counts = rare_image_counts(selected)
    scarce = F.lit(False)
    for c in C.RARE_CLASSES:
        n = counts.select(f"class_{c}").scalar()
        scarce = scarce | (F.array_contains("classes", c) & (n < C.RARE_AUGMENT_BELOW))
    return selected.filter(F.col("category") == "rare").filter(scarce)


def flip_labels(labels: DataFrame) -> DataFrame:
    return labels.withColumn("stem", F.concat("stem", F.lit("_hflip"))).withColumn("cx", G.flip_horizontal("cx"))


def augment(selected: DataFrame) -> DataFrame:
    """Selection with flipped copies of scarce rare images appended.

    ``base_stem`` and ``flipped`` tell where the labels of an image come from.
    """
    own = selected.withColumn("base_stem", F.col("stem")).withColumn("flipped", F.lit(False))
    copies = to_augment(selected).withColumns({
        "base_stem": F.col("stem"), "flipped": F.lit(True),
        "stem": F.concat("stem", F.lit("_hflip")), "category": F.lit("rare_aug"),
    })
    return own.unionByName(copies.select(*own.columns))


def labels_of(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the selected images; copies get mirrored boxes. One pass over labels."""
    base = labels.withColumnRenamed("stem", "base_stem")
    out = base.join(images.select("stem", "base_stem", "flipped", *(["split"] if "split" in images.columns else [])), "base_stem")
    return out.withColumn("cx", F.when(F.col("flipped"), G.flip_horizontal("cx")).otherwise(F.col("cx"))).drop(
        "base_stem", "flipped")


def stratified_split(selected: DataFrame, seed: int = C.SEED + 1) -> DataFrame:
    """80/10/10 per category; a category of one or two images stays in train."""
    n = F.col("_n")
    val = F.greatest(F.lit(1), F.floor(n * 0.10))
    train = n - 2 * val
    ranked = with_hash_position(selected, ["category"], "stem", seed, total="_n")
    return ranked.withColumn(
        "split",
        F.when((n < 3) | (F.col("pos") <= train), "train")
        .when(F.col("pos") <= train + val, "val").otherwise("test"),
    ).drop("_n", "pos")


def random_split(images: DataFrame, seed: int = C.SEED) -> DataFrame:
    """80/10/10 per source."""
    n = F.col("_n")
    train_end = F.floor(n * 0.8)
    val_end = train_end + F.floor(n * 0.1)
    ranked = with_hash_position(images, ["source"], "stem", seed, total="_n")
    return ranked.withColumn(
        "split",
        F.when(F.col("pos") <= train_end, "train").when(F.col("pos") <= val_end, "val").otherwise("test"),
    ).drop("_n", "pos")


def source_split(images: DataFrame) -> DataFrame:
    """Given validation images stay; the last tenth of train by name becomes test.

    Needs ``source, given_split, stem``.
    """
    train = images.filter("given_split = 'train'")
    ranked = with_sorted_position(train, ["source"], "stem", total="_n")
    carved = ranked.withColumn(
        "split", F.when(F.col("pos") <= F.floor(F.col("_n") * 0.90), "train").otherwise("test")
    ).drop("_n", "pos")
    rest = images.filter("given_split <> 'train'").withColumn("split", F.col("given_split"))
    return carved.unionByName(rest)


def cap_vehicle_boxes(labels: DataFrame, limit: int = C.MAX_VEHICLE_BOXES, seed: int = C.SEED) -> DataFrame:
    """At most ``limit`` vehicle boxes per image, chosen in hash order of their text.

    Needs ``ann_id`` to tell equal boxes apart. Only vehicle rows are ranked, and
    Spark trims each task to ``limit`` per image before the shuffle.
    """
    from scenespark.operators.ordering import first_rows

    order = F.md5(F.concat_ws(":", F.col("stem"), F.col("ann_id"), F.lit(seed)))
    vehicles = first_rows(labels.filter("class_id = 1"), ["stem"], [order, "ann_id"], limit)
    return labels.filter("class_id <> 1").unionByName(vehicles)


def drop_vehicle_only(index: DataFrame, ratio: float = C.VEHICLE_ONLY_REMOVE, seed: int = C.SEED) -> DataFrame:
    """Remove a share of the images whose only class is vehicle, within each split."""
    only = F.col("classes") == F.array(F.lit(1))
    ranked = with_hash_position(index.filter(only), ["split"], "stem", seed, total="_n")
    kept = ranked.filter(F.col("pos") > F.floor(F.col("_n") * ratio)).drop("_n", "pos")
    return index.filter(~only).unionByName(kept)


# --- statistics ------------------------------------------------------------

def split_statistics(labels: DataFrame) -> DataFrame:
    """Boxes per split and class plus the overall rows (``split = 'all'``).

    ``labels`` needs ``split, class_id``. Classes without boxes appear with zero.
    ``imbalance`` compares the largest with the smallest class present.
    """
    counts = labels.groupBy("split", "class_id").agg(F.count(F.lit(1)).alias("n"))
    both = counts.select(F.explode(F.array("split", F.lit("all"))).alias("split"), "class_id", "n")
    wide = both.groupBy("split").agg(
        F.sum("n").alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("class_id") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in C.CLASS_NAMES],
    )
    present = F.array_compact(F.array(*[F.when(F.col(f"c{i}") > 0, F.col(f"c{i}")) for i in C.CLASS_NAMES]))
    rows = F.array(*[
        F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("class_name"), F.col(f"c{i}").alias("annotations"))
        for i, n in C.CLASS_NAMES.items()
    ])
    return wide.select(
        "split", "total",
        exact_round(F.array_max(present) / F.greatest(F.lit(1), F.array_min(present)), 1).alias("imbalance"),
        F.inline(rows),
    ).withColumn("pct", exact_round(F.col("annotations") / F.greatest(F.lit(1), F.col("total")) * 100, 1))


def class_balance(labels: DataFrame) -> DataFrame:
    """Verdict per class over all splits; every class appears."""
    one = labels.agg(*[F.count_if(F.col("class_id") == i).alias(f"c{i}") for i in C.CLASS_NAMES],
                     F.count(F.lit(1)).alias("total"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("class_name"), F.col(f"c{i}").alias("annotations"))
        for i, n in C.CLASS_NAMES.items()
    ])
    pct = F.col("annotations") / F.greatest(F.lit(1), F.col("total")) * 100
    n = F.col("annotations")
    # Limits of the verdicts.
    return one.select("total", F.inline(rows)).select(
        "class_id", "class_name", "annotations",
        exact_round(pct, 1).alias("pct"),
        F.when(n == 0, "NO DATA").when(pct > 70, "HEAVILY IMBALANCED").when(pct < 1, "TOO RARE")
        .otherwise("OK").alias("verdict"),
        (n == 0).alias("is_missing"),
        ((n > 0) & (n < 100)).alias("is_rare"),
    )


def compare_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Class shares before and after, change in percentage points."""
    b = class_balance(before).select("class_id", "class_name", F.col("annotations").alias("before_n"))
    a = class_balance(after).select("class_id", F.col("annotations").alias("after_n"))
    joined = b.join(a, "class_id")
    bt = F.greatest(F.lit(1), before.agg(F.count(F.lit(1))).scalar())
    at = F.greatest(F.lit(1), after.agg(F.count(F.lit(1))).scalar())
    bp, ap = F.col("before_n") / bt * 100, F.col("after_n") / at * 100
    return joined.select(
        "class_id", "class_name", "before_n", "after_n",
        exact_round(bp, 1).alias("before_pct"), exact_round(ap, 1).alias("after_pct"),
        exact_round(ap - bp, 1).alias("change"),
        F.when(ap > bp, "up").when(ap < bp, "down").otherwise("same").alias("direction"),
    )


def split_quality(images: DataFrame, files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per-split report: orphans both ways, empty files, bad boxes, class counts.

    ``images(split, stem)``, ``files(split, stem)`` and parsed lines
    ``(split, stem, status, class_id)``.
    """
    key = ["split", "stem"]
    lines = parsed.groupBy(*key).agg(
        F.count_if(F.col("status") == "ok").alias("total_boxes"),
        F.count_if(F.col("status") != "ok").alias("bad_boxes"),
        *[F.count_if((F.col("status") == "ok") & (F.col("class_id") == i)).alias(f"class_{i}") for i in C.CLASS_NAMES],
    )
    presence = (
        images.select(*key).withColumn("_img", F.lit(True))
        .join(files.select(*key).withColumn("_lbl", F.lit(True)), key, "full")
        .join(lines, key, "left")
    )
    img, lbl = F.col("_img").isNotNull(), F.col("_lbl").isNotNull()
    sums = ["total_boxes", "bad_boxes", *[f"class_{i}" for i in C.CLASS_NAMES]]
    return presence.groupBy("split").agg(
        F.count_if(img).alias("images"),
        F.count_if(lbl).alias("label_files"),
        F.count_if(img & ~lbl).alias("orphan_images"),
        F.count_if(lbl & ~img).alias("orphan_labels"),
        F.count_if(lbl & F.col("total_boxes").isNull()).alias("empty_labels"),
        *[F.coalesce(F.sum(F.when(lbl, F.col(c))), F.lit(0)).alias(c) for c in sums],
    )


def preparation_stats(images: DataFrame, files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Kept, skipped, missing and empty counters per source with a total row.

    ``images(source, stem)``, ``files(stem)``, parsed lines ``(stem, status)``.
    """
    lines = parsed.groupBy("stem").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("bad")
    )
    rows = (
        images.select("source", "stem")
        .join(files.select("stem").withColumn("_lbl", F.lit(True)), "stem", "left")
        .join(lines, "stem", "left")
    )
    ok = F.coalesce("ok", F.lit(0))
    per = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("images_written"),
        F.count(F.lit(1)).alias("labels_written"),
        F.sum(ok).alias("annotations_ok"),
        F.sum(F.coalesce("bad", F.lit(0))).alias("annotations_skipped"),
        F.count_if(F.col("_lbl").isNull()).alias("files_missing"),
        F.count_if(ok == 0).alias("empty_labels"),
    )
    sums = [c for c in per.columns if c != "source"]
    both = per.select(F.explode(F.array("source", F.lit("total"))).alias("source"), *sums)
    return both.groupBy("source").agg(*[F.sum(c).alias(c) for c in sums])


# --- the whole preparation ---------------------------------------------------

@dataclass
class Corpus:
    """Image selection ``(stem, classes, boxes, category, split)`` and its labels."""

    images: DataFrame
    labels: DataFrame


def build_corpus(pixel: DataFrame, seed: int = C.SEED, materialise: bool = True) -> Corpus:
    """Stage, balance, augment and split.

    The staged labels serve the image index and the result, and the index, one narrow
    row per image, the ranks that follow: both are written once.
    """
    labels = cut(stage(pixel)) if materialise else stage(pixel)
    index = categorise(image_index(labels))
    if materialise:
        index = cut(index)
    selected = downsample(index, seed)
    if materialise:
        selected = cut(selected)
    images = stratified_split(augment(selected), seed + 1)
    if materialise:
        images = cut(images)
    return Corpus(images, labels_of(images, labels))
