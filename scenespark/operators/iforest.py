"""Isolation forest (Liu, Ting, Zhou 2008) on frame features.

Every tree grows from a sample of a bounded size, drawn in the cluster by the hashes of
frames, so fitting a feed takes one small group however long its baseline is; many feeds are
fitted in parallel. The score that separates anomalies is an exact quantile over all baseline
frames, found by counting their scores in ever finer bins. A fitted forest is one row of
arrays. Scoring sends that row to blocks of frames, never all frames of a feed to one task.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.operators.checkpoints import cut
from scenespark.operators.ordering import spread

EULER = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"
FOREST_SCHEMA = f"feed_id long, trees int, sample_size int, n_train long, offset double, nodes array<struct<{NODE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
# key of the forest of all feeds
ALL_FEEDS = -1
# frames that one group scores
SCORED_ROWS = 65_536
# bits of a score's place that one round of the quantile counts
QUANTILE_BITS = 12


def average_path(n) -> np.ndarray:
    """Mean length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_forest(points: np.ndarray, node: np.ndarray, trees: int, size: int, rng: np.random.Generator) -> pd.DataFrame:
    """Nodes of all trees, grown level by level for all trees at once.

    ``points`` are the rows of all samples, ``node`` the tree of each. ``node`` counts through
    the whole forest; the roots are ``0 .. trees - 1``. Leaves have feature -1 and hold their
    depth plus the expected rest depth of the points left in them.
    """
    limit = int(np.ceil(np.log2(max(size, 2))))
    tree_of, columns, made = np.arange(trees), [], trees
    for depth in range(limit + 1):
        order = np.argsort(node, kind="stable")
        points, node = points[order], node[order]
        ids, starts, counts = np.unique(node, return_index=True, return_counts=True)
        low, high = np.minimum.reduceat(points, starts, axis=0), np.maximum.reduceat(points, starts, axis=0)
        open_features = high > low
        splits = open_features.any(axis=1) & (depth < limit)
        feature = np.where(splits, np.where(open_features, rng.random(low.shape), -1.0).argmax(axis=1), -1)
        at = np.arange(len(ids))
        lo, hi = low[at, feature], high[at, feature]
        cut_at = lo + (hi - lo) * rng.random(len(ids))
        cut_at = np.where(cut_at < hi, cut_at, lo)
        left = np.full(len(ids), -1)
        left[splits] = made + 2 * np.arange(int(splits.sum()))
        columns.append(pd.DataFrame({
            "tree": tree_of, "node": ids, "feature": feature, "threshold": np.where(splits, cut_at, 0.0),
            "left": left, "right": np.where(splits, left + 1, -1),
            "depth": np.where(splits, depth, depth + average_path(counts)),
        }))
        if not splits.any():
            break
        owner = np.repeat(at, counts)
        stay = splits[owner]
        points, owner = points[stay], owner[stay]
        goes_right = points[np.arange(len(points)), feature[owner]] > cut_at[owner]
        node = left[owner] + goes_right
        made += 2 * int(splits.sum())
        tree_of = np.repeat(tree_of[splits], 2)
    return pd.concat(columns, ignore_index=True)


def mean_depth(x: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
    """Mean corrected depth of each row over all trees, all trees one level per step."""
    if not nodes["node"].is_monotonic_increasing:
        nodes = nodes.sort_values("node")
    feature, threshold = nodes["feature"].to_numpy(), nodes["threshold"].to_numpy()
    left, depth = nodes["left"].to_numpy(), nodes["depth"].to_numpy()
    trees = int(nodes["tree"].max()) + 1
    row = np.repeat(np.arange(len(x)), trees)
    at = np.tile(np.arange(trees), len(x))
    inner = np.flatnonzero(feature[at] >= 0)
    while len(inner):
        here = at[inner]
        at[inner] = left[here] + (x[row[inner], feature[here]] > threshold[here])
        inner = inner[feature[at[inner]] >= 0]
    return depth[at].reshape(len(x), trees).mean(axis=1)


def unpacked(nodes) -> pd.DataFrame:
    """Nodes of a model row as a table."""
    return pd.DataFrame.from_records(list(nodes), columns=[f.split()[0] for f in NODE_SCHEMA.split(", ")])


def score_samples(x: np.ndarray, nodes: pd.DataFrame, sample_size: int, rows: int = 8192) -> np.ndarray:
    """Scores of the rows, some thousand at a time."""
    norm = float(average_path([sample_size])[0]) or 1.0
    parts = [mean_depth(x[a:a + rows], nodes) for a in range(0, len(x), rows)]
    return -np.power(2.0, -np.concatenate(parts) / norm) if parts else np.zeros(0)


def samples(
    baseline: DataFrame, trees: int = C.FOREST_TREES, seed: int = C.SEED, size: int = C.FOREST_SAMPLE, ahead: float = 8.0
) -> DataFrame:
    """The frames each tree grows from: the baseline's columns, ``tree`` and ``n_train``.

    The ``size`` frames with the smallest hashes for that tree. ``tree`` is null where the
    baseline has no more frames than that: all of them are the sample of every tree. Frames
    whose hash is beyond ``ahead`` times the expected bound are left out before the ranking;
    if they are ever missed, the ranking is done over all frames.
    """
    sizes = baseline.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_train"))
    counted = baseline.join(sizes.filter(F.col("n_train") >= C.BASELINE_FRAMES), "feed_id")
    few = counted.filter(F.col("n_train") <= size).withColumn("tree", F.lit(None).cast("int"))
    many = counted.filter(F.col("n_train") > size).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    many = many.withColumn("_h", F.xxhash64("feed_id", "_key", "tree", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1)))

    def ranked(bound: Column | bool) -> DataFrame:
        first = Window.partitionBy("feed_id", "tree").orderBy("_h", "_key")
        return many.filter(bound).withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= size)

    picked = ranked(F.col("_h") / float(1 << 62) * F.col("n_train") <= ahead * size)
    wanted = sizes.filter(F.col("n_train") > size).count() * trees
    if wanted:
        picked = cut(picked)
        if picked.count() < wanted * size:
            picked = ranked(F.lit(True))
    return few.unionByName(picked.drop("_h", "_rank"))


def _fit_one(rows: pd.DataFrame, feed: int, trees: int, seed: int) -> tuple[int, pd.DataFrame]:
    rng = np.random.default_rng([seed, zlib.crc32(str(feed).encode())])
    x = rows[C.FEATURES].to_numpy(float)
    if rows["tree"].isna().all():
        size = len(x)
        picks = np.argsort(rng.random((trees, size)), axis=1)
        return size, grow_forest(x[picks.ravel()], np.repeat(np.arange(trees), size), trees, size, rng)
    return len(x) // trees, grow_forest(x, rows["tree"].to_numpy(np.int64), trees, len(x) // trees, rng)


class Forest(NamedTuple):
    size: int
    offset: float
    nodes: pd.DataFrame


def fit_whole(points: pd.DataFrame, feed: int, trees: int, contamination: float = C.CONTAMINATION, seed: int = C.SEED) -> Forest:
    """The forest ``fit`` gives a feed whose baseline is no longer than the sample of a tree."""
    size, nodes = _fit_one(points.assign(tree=None), feed, trees, seed)
    own = score_samples(points[C.FEATURES].to_numpy(float), nodes, size)
    return Forest(size, float(np.quantile(own, contamination)), nodes)


def quantiles(scores: DataFrame, share: float, column: str = "score", few: int = 4096) -> DataFrame:
    """``feed_id, offset``: the exact quantile of a column of -1 to 0 per feed, between two ranks in proportion.

    Scores are counted by the leading bits of their place on that scale; only the bins that
    hold a wanted rank are looked at again, until they hold ``few`` rows or one place. The
    rows of such a bin are counted by value, so equal scores are one row however many.
    """
    steps = 48 // QUANTILE_BITS
    rows = cut(scores.select("feed_id", F.col(column).alias("s")).withColumn(
        "place", F.least(F.floor((F.col("s") + 1.0) * float(1 << 48)), F.lit((1 << 48) - 1)).cast("long")))
    at = F.lit(share) * (F.col("n") - 1)
    wanted = rows.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"low": F.floor(at), "part": at - F.floor(at)})
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(
        F.col("low"), F.least(F.col("low") + 1, F.col("n") - 1)))))
    # a target: the rank, its bin so far, the rows before the bin and in it
    targets = cut(wanted.select(
        "feed_id", "rank", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"), F.col("n").alias("held")))
    done = 0
    while done < steps * QUANTILE_BITS and targets.filter(F.col("held") > few).head(1):
        left = 48 - done - QUANTILE_BITS
        if left < 0:
            break
        own = targets.select("feed_id", "rank", F.col("bin").alias("_bin"), F.col("before").alias("_before"))
        counted = (
            rows.join(own, "feed_id").filter(F.expr(f"shiftright(place, {48 - done}) = _bin"))
            .groupBy("feed_id", "rank", "_before", F.expr(f"shiftright(place, {left})").alias("bin"))
            .agg(F.count(F.lit(1)).alias("held")))
        run = Window.partitionBy("feed_id", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        targets = cut(
            counted.withColumn("before", F.col("_before") + F.coalesce(F.sum("held").over(run), F.lit(0)))
            .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("held")))
            .select("feed_id", "rank", "bin", "before", "held"))
        done += QUANTILE_BITS
    own = targets.withColumnRenamed("bin", "_bin")
    values = rows.join(own, "feed_id").filter(F.expr(f"shiftright(place, {48 - done}) = _bin")).groupBy(
        "feed_id", "rank", "before", "s").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("feed_id", "rank").orderBy("s")
    found = values.withColumn("_to", F.col("before") + F.sum("n").over(run)).filter(
        (F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("n")))
    ends = found.groupBy("feed_id").agg(F.min_by("s", "rank").alias("a"), F.max_by("s", "rank").alias("b"))
    part = wanted.select("feed_id", "part").distinct()
    return ends.join(part, "feed_id").select("feed_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("offset"))


def fit(
    baseline: DataFrame,
    trees: int = C.FOREST_TREES,
    contamination: float = C.CONTAMINATION,
    seed: int = C.SEED,
    scope: str = "feed",
) -> DataFrame:
    """One row per fitted forest; feeds with a short baseline get none.

    ``baseline`` holds ``feed_id, frame_id`` and the feature columns. ``scope`` 'feed' fits
    one forest per feed from its first frames; 'global' fits one (key ``feed_id = -1``) from
    the frames of all feeds. ``nodes`` lists the trees.
    """
    rows = baseline.select("feed_id", F.concat_ws("_", "feed_id", "frame_id").alias("_key"), "frame_id", *C.FEATURES)
    if scope == "global":
        rows = rows.withColumn("feed_id", F.lit(ALL_FEEDS).cast("bigint"))
    rows = cut(rows)

    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64()}
    kind = pa.struct([(c, kinds[t]) for c, t in (f.split() for f in NODE_SCHEMA.split(", "))])

    def run(part: pa.Table) -> pa.Table:
        pdf = part.to_pandas().sort_values(["tree", "frame_id", "_key"])
        feed = int(pdf["feed_id"].iloc[0])
        size, grown = _fit_one(pdf, feed, trees, seed)
        packed = pa.StructArray.from_arrays([pa.array(grown[c].to_numpy()).cast(f.type) for c, f in zip(names, kind)], fields=list(kind))
        return pa.table({
            "feed_id": pa.array([feed], pa.int64()), "trees": pa.array([trees], pa.int32()), "sample_size": pa.array([size], pa.int32()),
            "n_train": pa.array([int(pdf["n_train"].iloc[0])], pa.int64()), "offset": pa.array([0.0], pa.float64()),
            "nodes": pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed)})

    drawn = samples(rows, trees, seed)
    model = cut(spread(drawn, "feed_id").groupBy("feed_id").applyInArrow(run, FOREST_SCHEMA))
    offsets = quantiles(score(rows.withColumn("frame_id", F.monotonically_increasing_id()), model), contamination, "model_score")
    order = [f.split()[0] for f in FOREST_SCHEMA.split(", nodes")[0].split(", ")] + ["nodes"]
    return model.drop("offset").join(offsets, "feed_id").select(order)


def nodes(model: DataFrame) -> DataFrame:
    """The trees of fitted forests, a row per node."""
    return model.select("feed_id", "sample_size", "n_train", "offset", F.explode("nodes").alias("_n")).select(
        "feed_id", "_n.*", "sample_size", "n_train", "offset")


def score(features: DataFrame, model: DataFrame, scope: str = "feed", block_rows: int = SCORED_ROWS) -> DataFrame:
    """``model_score`` (0 at the contamination quantile, lower is more anomalous).

    The row of a feed's forest meets the frames of the feed in a cogroup; a feed with more
    than ``block_rows`` frames has several blocks of them and as many copies of the row.
    """
    frames = features.select("feed_id", "frame_id", *C.FEATURES)
    rows = frames.withColumn("_model", F.lit(ALL_FEEDS).cast("bigint") if scope == "global" else F.col("feed_id"))
    sizes = rows.groupBy("_model").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    rows = rows.join(sizes, "_model").withColumn("_block", F.pmod(F.xxhash64("feed_id", "frame_id"), F.col("_blocks"))).drop("_blocks")
    copies = model.withColumnRenamed("feed_id", "_of").join(sizes, F.col("_of") == F.col("_model")).select(
        "_of", "sample_size", "offset", "nodes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_at"))

    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]

    def run(part: pa.Table, forest: pa.Table) -> pa.Table:
        keep = ["feed_id", "frame_id"]
        if not len(part) or not len(forest):
            return pa.table({**{c: part[c].slice(0, 0) for c in keep}, "model_score": pa.array([], pa.float64())})
        held = forest["nodes"].combine_chunks().flatten()
        nodes = pd.DataFrame({c: held.field(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)})
        x = np.stack([part[c].to_numpy().astype(float) for c in C.FEATURES], 1)
        s = score_samples(x, nodes, forest["sample_size"][0].as_py())
        return pa.table({**{c: part[c] for c in keep}, "model_score": pa.array(s - forest["offset"][0].as_py())})

    return spread(rows, "_model", "_block").groupBy("_model", "_block").cogroup(
        spread(copies, "_of", "_at").groupBy("_of", "_at")).applyInArrow(run, "feed_id long, frame_id long, model_score double")


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(FOREST_SCHEMA).parquet(path)
