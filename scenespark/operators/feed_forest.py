"""Random-forest threat labels, one classifier per feed, all feeds trained at once.

Trees grow level by level over rows ``(feed, model, tree, node)``: features are cut into bins
at quantiles of the feed, a level counts the classes per node, feature and bin, takes the
split with the largest Gini gain as an aggregate, and sends each row to its child. One level
is two shuffles for all trees of all feeds, whatever their number, and what is shuffled are
counts. Bootstrap weights, candidate features and folds come from hashes, so a repeated task
draws the same. ``model`` 0 is trained on all rows of a feed, the others each without one fold.

Rows of a feed times models times trees are shuffled at every level, though a baseline often has
some dozen frames. The forests of a feed with at most ``TOGETHER`` rows therefore grow in one
group, by the same draws, bins and rules and with the same nodes; what leaves the group is the
model of all rows and the shares of right answers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.operators.checkpoints import cut
from scenespark.operators.ordering import spread

BINS = 32
CLASSES = len(C.PRIORITIES)
CANDIDATES = max(1, math.isqrt(len(C.FEATURES)))
NODE = ["feed_id", "model", "tree", "node"]
COUNTS = [f"c{k}" for k in range(CLASSES)]
NODE_SCHEMA = "tree int, node int, feature int, threshold double, gain double, " + ", ".join(f"{c} long" for c in COUNTS)
MODEL_SCHEMA = (
    "feed_id long, labels array<string>, n_samples long, accuracy double, cv_accuracy double, "
    f"nodes array<struct<{NODE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
)
# frames that one group labels, and rows walked at a time
LABELLED_ROWS, WALKED = 65_536, 2048
# rows of a feed whose forests grow in one group
TOGETHER = 2048


def _uniform(*parts) -> Column:
    """A number from 0 to 1, the same for the same parts."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)


def _weight(u: Column) -> Column:
    """How often a bootstrap of many rows draws a row: Poisson of mean one, up to six."""
    steps, total, out = [], 0.0, F.lit(6)
    for k in range(6):
        total += math.exp(-1) / math.factorial(k)
        steps.append((k, total))
    for k, bound in reversed(steps):
        out = F.when(u < bound, F.lit(k)).otherwise(out)
    return out


def binned(rows: DataFrame, seed: int, folds: int) -> tuple[DataFrame, DataFrame]:
    """Training rows as ``feed_id, frame_id, fold, label, bins``, and the feeds with labels, rows and bin edges.

    Bin k of a feature holds values above k edges of the feed; the edges are values.
    """
    probes = [i / BINS for i in range(1, BINS)]
    feeds = rows.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.array_sort(F.collect_set("label_text")).alias("labels"),
        F.max_by("label_text", F.lit(1)).alias("_any"),
        F.array(*[F.array_distinct(F.percentile_approx(F.col(c).cast("double"), probes)) for c in C.FEATURES]).alias("edges"))
    largest = rows.groupBy("feed_id", "label_text").count().groupBy("feed_id").agg(F.max("count").alias("largest"))
    feeds = cut(feeds.drop("_any").join(largest, "feed_id").withColumn(
        "judged", (F.size("labels") > 1) & (F.col("n_samples") >= 10) & (F.col("largest") >= folds) & F.lit(folds > 1)))
    if feeds.filter(F.size("labels") > CLASSES).head(1):
        raise ValueError(f"more than {CLASSES} labels")
    values = F.array(*[F.col(c).cast("double") for c in C.FEATURES])
    told = rows.join(feeds.filter(F.size("labels") > 1), "feed_id").select(
        "feed_id", "frame_id", "judged",
        (F.pmod(F.xxhash64("feed_id", "frame_id", F.lit(seed + 1)), F.lit(max(folds, 1))) + 1).cast("int").alias("fold"),
        (F.array_position("labels", F.col("label_text")) - 1).cast("int").alias("label"),
        F.zip_with(values, "edges", lambda v, e: F.size(F.filter(e, lambda x: x < v))).alias("bins"))
    return cut(told), feeds


def _counts(weight: str) -> list[Column]:
    return [F.sum(F.when(F.col("label") == k, F.col(weight)).otherwise(0)).alias(c) for k, c in enumerate(COUNTS)]


def _squares(names: list[str]) -> tuple[Column, Column]:
    """Sum of the squared counts and their sum, as doubles of whole numbers."""
    total, squares = F.lit(0), F.lit(0)
    for n in names:
        total, squares = total + F.col(n), squares + F.col(n) * F.col(n)
    return squares.cast("double"), total.cast("double")


def _splits(rows: DataFrame, seed: int) -> DataFrame:
    """Best split of every node: ``feature`` (-1 for none), ``bin``, ``gain`` and the node's class counts."""
    drawn = F.array_sort(F.array(*[
        F.struct(F.xxhash64(*NODE, F.lit(i), F.lit(seed + 2)).alias("h"), F.lit(i).alias("i")) for i in range(len(C.FEATURES))]))
    each = rows.withColumn("_f", F.explode(F.slice(drawn, 1, CANDIDATES))).withColumn("feature", F.col("_f.i"))
    hist = each.groupBy(*NODE, "feature", F.get("bins", F.col("feature")).alias("bin")).agg(*_counts("w"))
    side = Window.partitionBy(*NODE, "feature")
    upto = side.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({f"t{k}": F.sum(c).over(side) for k, c in enumerate(COUNTS)})
    hist = hist.withColumns({f"l{k}": F.sum(c).over(upto) for k, c in enumerate(COUNTS)})
    hist = hist.withColumns({f"r{k}": F.col(f"t{k}") - F.col(f"l{k}") for k in range(CLASSES)})
    (left, n_left), (right, n_right), (whole, n) = (_squares([f"{s}{k}" for k in range(CLASSES)]) for s in "lrt")
    gain = F.when((n_left > 0) & (n_right > 0), (left / n_left + right / n_right) / n - whole / (n * n))
    best = hist.select(*NODE, "feature", "bin", gain.alias("gain"), *[F.col(f"t{k}").alias(c) for k, c in enumerate(COUNTS)])
    # of equal gains the first feature and bin
    top = best.groupBy(*NODE, *COUNTS).agg(F.max(F.when(F.col("gain") > 1e-12, F.struct(
        "gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))).alias("top"))
    return top.select(
        *NODE, F.coalesce(-F.col("top.f"), F.lit(-1)).cast("int").alias("feature"),
        F.coalesce(-F.col("top.b"), F.lit(-1)).cast("int").alias("bin"),
        F.coalesce("top.gain", F.lit(0.0)).alias("gain"), *COUNTS)


def grown(rows: DataFrame, trees: int, depth: int, seed: int, folds: int) -> DataFrame:
    """Nodes of all trees of ``binned`` rows: ``NODE``, ``feature``, ``bin``, ``gain`` and class counts.

    The root of a tree is node 1, the children of node k are 2 k (up to the bin) and 2 k + 1.
    """
    models = F.when(F.col("judged"), F.filter(
        F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold"))).otherwise(F.array(F.lit(0)))
    at = rows.withColumn("model", F.explode(models)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    at = at.withColumn("w", _weight(_uniform("feed_id", "frame_id", "model", "tree", F.lit(seed)))).filter("w > 0").select(
        "feed_id", "model", "tree", F.lit(1).alias("node"), "label", "bins", "w")
    levels = []
    for level in range(depth + 1):
        if level == depth:
            last = at.groupBy(*NODE).agg(*_counts("w"))
            levels.append(cut(last.select(
                *NODE, F.lit(-1).alias("feature"), F.lit(-1).alias("bin"), F.lit(0.0).alias("gain"), *COUNTS)))
            break
        splits = cut(_splits(at, seed))
        levels.append(splits)
        inner = splits.filter("feature >= 0").select(*NODE, "feature", "bin")
        if not inner.head(1):
            break
        at = cut(at.join(inner, NODE).withColumn(
            "node", (F.col("node") * 2 + (F.get("bins", F.col("feature")) > F.col("bin")).cast("int")).cast("int")
        ).drop("feature", "bin"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _shares(frames: DataFrame, forests: DataFrame) -> DataFrame:
    """``feed_id, model, frame_id, shares`` of the frames (``feed_id, model, frame_id`` and features).

    ``forests``: ``feed_id, model, nodes``, one row each; copied once per block of a feed's frames.
    """
    sizes = frames.groupBy("feed_id", "model").agg(F.ceil(F.count(F.lit(1)) / LABELLED_ROWS).alias("_blocks"))
    rows = frames.select("feed_id", "model", "frame_id", *C.FEATURES).join(sizes, ["feed_id", "model"]).withColumn(
        "_block", F.pmod(F.xxhash64("frame_id"), F.col("_blocks"))).drop("_blocks")
    copies = forests.join(sizes, ["feed_id", "model"]).select(
        F.col("feed_id").alias("_of"), F.col("model").alias("_model"), "nodes",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_at"))
    columns = [f.split()[0] for f in NODE_SCHEMA.split(", ")]

    def run(part: pa.Table, forest: pa.Table) -> pa.Table:
        keep = ["feed_id", "model", "frame_id"]
        if not len(part) or not len(forest):
            return pa.table({**{c: part[c].slice(0, 0) for c in keep}, "shares": pa.array([], pa.list_(pa.float64()))})
        held = forest["nodes"].combine_chunks().flatten()
        nodes = {c: held.field(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
        trees, size = int(nodes["tree"].max()) + 1, 2 * int(nodes["node"].max()) + 2
        # the place of a node in the list; a tree that is not there gives no shares
        none = len(nodes["tree"])
        place = np.full((trees, size), none)
        place[nodes["tree"], nodes["node"]] = np.arange(none)
        left = np.append(place[nodes["tree"], 2 * nodes["node"]], none)
        right = np.append(place[nodes["tree"], 2 * nodes["node"] + 1], none)
        feature, threshold = np.append(nodes["feature"], -1), np.append(nodes["threshold"].astype(float), 0.0)
        share = np.stack([np.append(nodes[c], 0) for c in COUNTS], 1).astype(float)
        share /= np.maximum(share.sum(1, keepdims=True), 1)
        x = np.stack([part[c].to_numpy().astype(float) for c in C.FEATURES], 1)
        out, root = [], place[:, 1]
        for a in range(0, len(x), WALKED):
            rows = x[a:a + WALKED]
            at = np.tile(root, (len(rows), 1))
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                above = np.take_along_axis(rows, np.maximum(f, 0), 1) > threshold[at]
                at = np.where(inner, np.where(above, right[at], left[at]), at)
            out.append(share[at].mean(1))
        shares = pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * CLASSES, CLASSES, dtype=np.int32), np.concatenate(out).ravel())
        return pa.table({**{c: part[c] for c in keep}, "shares": shares})

    keys, others = ["feed_id", "model", "_block"], ["_of", "_model", "_at"]
    return spread(rows, *keys).groupBy(*keys).cogroup(spread(copies, *others).groupBy(*others)).applyInArrow(
        run, "feed_id long, model int, frame_id long, shares array<double>")


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _hashed(state, value, size: int) -> np.ndarray:
    """One step of ``F.xxhash64``: ``value``, whole numbers of ``size`` bytes, upon the hash so far (42 at first)."""
    def turned(x, by: int):
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    value = np.asarray(value, np.int64).astype(np.uint64)
    h = np.asarray(state, np.uint64) + _P[4] + np.uint64(size)
    if size == 8:
        h = turned(h ^ turned(value * _P[1], 31) * _P[0], 27) * _P[0] + _P[3]
    else:
        h = turned(h ^ (value & np.uint64(0xFFFFFFFF)) * _P[0], 23) * _P[1] + _P[2]
    h = (h ^ h >> np.uint64(33)) * _P[1]
    h = (h ^ h >> np.uint64(29)) * _P[2]
    return h ^ h >> np.uint64(32)


_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(6)])


def _best(node: np.ndarray, drawn: np.ndarray, bins: np.ndarray, label: np.ndarray, w: np.ndarray, whole: np.ndarray):
    """``feature``, ``bin`` and ``gain`` of every node: entries (numbered node, bins of the row, label, weight)."""
    n = len(whole)
    feature, bin_, gain = np.full(n, -1), np.full(n, -1), np.zeros(n)
    f = drawn[node]
    b = np.take_along_axis(bins, f, 1)
    # entries by node, feature and bin; counts up to the end of each run of equal bins
    key = ((node[:, None] * len(C.FEATURES) + f) * BINS + b).ravel()
    order = np.argsort(key, kind="stable")
    key, each = key[order], np.zeros((len(key), CLASSES), np.int64)
    each[np.arange(len(key)), np.repeat(label, CANDIDATES)[order]] = np.repeat(w, CANDIDATES)[order]
    upto = np.cumsum(each, 0)
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
    of, at_bin = key[ends] // BINS, key[ends] % BINS
    side = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    before = np.concatenate((np.zeros((1, CLASSES), np.int64), upto[ends[side[1:] - 1]]))
    left = upto[ends] - np.repeat(before, np.diff(np.r_[side, len(ends)]), 0)
    at = of // len(C.FEATURES)
    total = whole[at]
    right = total - left
    (sl, nl), (sr, nr), (st, nt) = (((x * x).sum(1).astype(float), x.sum(1).astype(float)) for x in (left, right, total))
    ok = np.flatnonzero((nl > 0) & (nr > 0))
    g = (sl[ok] / nl[ok] + sr[ok] / nr[ok]) / nt[ok] - st[ok] / (nt[ok] * nt[ok])
    ok, g = ok[g > 1e-12], g[g > 1e-12]
    # of equal gains the first feature and bin, as the entries lie
    first = np.lexsort((ok, -g, at[ok]))
    ok, g = ok[first], g[first]
    top = np.flatnonzero(np.r_[True, at[ok][1:] != at[ok][:-1]]) if len(ok) else []
    won = at[ok][top]
    feature[won], bin_[won], gain[won] = of[ok][top] % len(C.FEATURES), at_bin[ok][top], g[top]
    return feature, bin_, gain


def grown_together(
    feed: int, frame: np.ndarray, fold: np.ndarray, label: np.ndarray, bins: np.ndarray, models: int, trees: int, depth: int, seed: int
) -> tuple[dict[str, np.ndarray], list[float]]:
    """What ``grown`` gives for one feed: the nodes of model 0, and each model's share of right answers, for the
    others on the fold they have not seen."""
    n = len(frame)
    forest = np.arange(models * trees)
    model, tree = forest // trees, forest % trees
    start = _hashed(_hashed(42, feed, 8), frame, 8)
    h = _hashed(_hashed(_hashed(start[None, :], model[:, None], 4), tree[:, None], 4), seed, 4)
    u = (h & np.uint64((1 << 52) - 1)).astype(float) / float(1 << 52)
    w = np.searchsorted(_STEPS, u, side="right")
    unseen = (model[:, None] > 0) & (fold[None, :] == model[:, None])
    w[unseen] = 0
    # rows that judge a forest go down its trees without weight
    of, row = np.nonzero((w > 0) | unseen | (model[:, None] == 0))
    w = w[of, row]
    node = np.ones(len(of), np.int64)
    shares, there, kept = np.zeros((models * trees, n, CLASSES)), np.zeros(models * trees, bool), []
    for level in range(depth + 1):
        span = 1 << (level + 1)
        ids, at = np.unique(of * span + node, return_inverse=True)
        own, number = ids // span, ids % span
        whole = np.bincount(at * CLASSES + label[row], w, len(ids) * CLASSES).astype(np.int64).reshape(-1, CLASSES)
        feature, bin_, gain = np.full(len(ids), -1), np.full(len(ids), -1), np.zeros(len(ids))
        if level < depth:
            key = _hashed(_hashed(_hashed(_hashed(42, feed, 8), model[own], 4), tree[own], 4), number, 4)
            each = np.arange(len(C.FEATURES))
            lot = _hashed(_hashed(key[:, None], each[None, :], 4), seed + 2, 4).view(np.int64)
            drawn = np.argsort(lot, axis=1, kind="stable")[:, :CANDIDATES]
            some = w > 0
            feature, bin_, gain = _best(at[some], drawn, bins[row[some]], label[row[some]], w[some], whole)
        # a tree without rows is not there
        full = whole.sum(1) > 0
        if level == 0:
            there[own[full]] = True
        mine = full & (own < trees)
        kept.append((tree[own[mine]], number[mine], feature[mine], bin_[mine], gain[mine], whole[mine]))
        leaf = feature[at] < 0
        shares[of[leaf], row[leaf]] = whole[at[leaf]] / np.maximum(whole[at[leaf]].sum(1, keepdims=True), 1)
        stay = ~leaf
        if not stay.any():
            break
        of, row, w, at, node = of[stay], row[stay], w[stay], at[stay], node[stay]
        node = 2 * node + (bins[row, feature[at]] > bin_[at])
    hits = []
    for m in range(models):
        judged = np.flatnonzero(fold == m) if m else np.arange(n)
        exists = np.flatnonzero(there[m * trees:(m + 1) * trees])
        if len(judged) and len(exists):
            told = shares[m * trees:m * trees + int(exists[-1]) + 1, judged].transpose(1, 0, 2).mean(1)
            hits.append(float((told.argmax(1) == label[judged]).mean()))
        else:
            hits.append(float("nan"))
    names = ["tree", "node", "feature", "bin", "gain", "counts"]
    out = {c: np.concatenate([k[i] for k in kept]) for i, c in enumerate(names)}
    order = np.lexsort((out["node"], out["tree"]))
    return {c: v[order] for c, v in out.items()}, hits


def _fitted_together(told: DataFrame, feeds: DataFrame, trees: int, depth: int, seed: int, folds: int) -> DataFrame:
    """``feed_id, accuracy, cv_accuracy, nodes``; a group holds the rows of one feed."""
    kind = pa.struct([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in NODE_SCHEMA.split(", ")])
    schema = pa.schema([("feed_id", pa.int64()), ("accuracy", pa.float64()), ("cv_accuracy", pa.float64()), ("nodes", pa.list_(kind))])

    def run(part: pa.Table, edge: pa.Table) -> pa.Table:
        if not len(part) or not len(edge):
            return schema.empty_table()
        part = part.sort_by("frame_id")
        feed, edges = part["feed_id"][0].as_py(), edge["edges"][0].as_py()
        bins = part["bins"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(part), -1)
        frame, fold, label = (part[c].to_numpy().astype(np.int64) for c in ("frame_id", "fold", "label"))
        got, hits = grown_together(feed, frame, fold, label, bins, folds + 1 if part["judged"][0].as_py() else 1, trees, depth, seed)
        table = np.full((len(C.FEATURES), BINS), np.nan)
        for i, e in enumerate(edges):
            table[i, :len(e)] = e
        threshold = table[np.maximum(got["feature"], 0), np.maximum(got["bin"], 0)]
        values = [got["tree"], got["node"], got["feature"], threshold, got["gain"], *got["counts"].T]
        nodes = pa.StructArray.from_arrays([pa.array(v).cast(f.type) for v, f in zip(values, kind)], fields=list(kind))
        others = [x for x in hits[1:] if x == x]
        return pa.table([
            pa.array([feed]), pa.array([hits[0]], pa.float64()), pa.array([float(np.mean(others)) if others else None], pa.float64()),
            pa.ListArray.from_arrays(pa.array([0, len(nodes)], pa.int32()), nodes)], schema=schema)

    types = "feed_id long, accuracy double, cv_accuracy double, " + MODEL_SCHEMA.split("cv_accuracy double, ")[1]
    return spread(told, "feed_id").groupBy("feed_id").cogroup(
        spread(feeds.select(F.col("feed_id").alias("_of"), "edges"), "_of").groupBy("_of")).applyInArrow(run, types)


def fit(rows: DataFrame, trees: int = 200, depth: int = 10, seed: int = C.SEED, folds: int = 5) -> DataFrame:
    """One row per feed of labelled rows (``feed_id, frame_id``, features, ``label_text``).

    ``accuracy`` is on the training rows, ``cv_accuracy`` the mean over the folds, null where
    a feed has one label, fewer than ten rows or no label as often as there are folds, or with
    ``folds`` 0. A feed with one label has no trees.
    """
    rows = cut(rows.select("feed_id", "frame_id", "label_text", *C.FEATURES))
    told, feeds = binned(rows, seed, folds)
    small = feeds.filter(F.col("n_samples") <= TOGETHER).select("feed_id")
    judged = _fitted_together(told.join(small, "feed_id", "left_semi"), feeds, trees, depth, seed, folds)
    large = feeds.filter((F.col("n_samples") > TOGETHER) & (F.size("labels") > 1)).select("feed_id")
    if large.head(1):
        judged = judged.unionByName(_fitted_by_level(
            rows.join(large, "feed_id", "left_semi"), told.join(large, "feed_id", "left_semi"), feeds, trees, depth, seed, folds))
    return feeds.join(judged, "feed_id", "left").select(
        "feed_id", "labels", "n_samples",
        exact_round(F.when(F.size("labels") > 1, F.col("accuracy")).otherwise(1.0), 4).alias("accuracy"),
        exact_round("cv_accuracy", 4).alias("cv_accuracy"), "nodes")


def _fitted_by_level(rows: DataFrame, told: DataFrame, feeds: DataFrame, trees: int, depth: int, seed: int, folds: int) -> DataFrame:
    """``feed_id, accuracy, cv_accuracy, nodes`` of feeds of any length."""
    grow = grown(told, trees, depth, seed, folds)
    edges = feeds.select("feed_id", "edges")
    listed = grow.join(edges, "feed_id").withColumn(
        "threshold", F.get(F.get("edges", F.greatest("feature", F.lit(0))), F.greatest("bin", F.lit(0))))
    columns = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    forests = cut(listed.groupBy("feed_id", "model").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("nodes")))
    # every row by the model of all rows, and by the one that has not seen its fold
    known = told.select("feed_id", "frame_id", "fold", "judged", "label")
    tries = rows.join(known, ["feed_id", "frame_id"]).withColumn(
        "model", F.explode(F.when(F.col("judged"), F.array(F.lit(0), F.col("fold"))).otherwise(F.array(F.lit(0)))))
    right = (F.array_position("shares", F.array_max("shares")) - 1) == F.col("label")
    hits = _shares(tries, forests).join(known, ["feed_id", "frame_id"]).groupBy("feed_id", "model").agg(
        F.avg(right.cast("int")).alias("hit"))
    judged = hits.groupBy("feed_id").agg(
        F.max(F.when(F.col("model") == 0, F.col("hit"))).alias("accuracy"),
        F.avg(F.when(F.col("model") > 0, F.col("hit"))).alias("cv_accuracy"))
    whole = forests.filter("model = 0").select("feed_id", "nodes")
    return whole.join(judged, "feed_id", "left").select("feed_id", "accuracy", "cv_accuracy", "nodes")


def classify(features: DataFrame, model: DataFrame) -> DataFrame:
    """``threat_label`` and ``threat_proba`` (label -> share, 4 decimals) by the classifier of each frame's feed.

    Feeds without one get ``UNKNOWN`` and no shares.
    """
    rows = features.withColumn("model", F.lit(0))
    grown_ = model.filter(F.col("nodes").isNotNull()).select("feed_id", F.lit(0).alias("model"), "nodes")
    shares = _shares(rows, grown_).select("feed_id", "frame_id", "shares")
    out = features.join(model.select("feed_id", "labels"), "feed_id", "left").join(shares, ["feed_id", "frame_id"], "left")
    sure = F.array(F.lit(1.0))
    told = F.coalesce(F.slice("shares", 1, F.size("labels")), F.when(F.size("labels") == 1, sure))
    best = F.get("labels", (F.array_position(told, F.array_max(told)) - 1).cast("int"))
    return out.withColumns({
        "threat_label": F.coalesce(best, F.lit("UNKNOWN")),
        "threat_proba": F.coalesce(
            F.map_from_arrays("labels", F.transform(told, lambda p: exact_round(p, 4))),
            F.create_map().cast("map<string,double>")),
    }).drop("labels", "shares")


def nodes(model: DataFrame) -> DataFrame:
    """The trees of the classifiers, a row per node."""
    return model.select("feed_id", F.explode("nodes").alias("_n")).select("feed_id", "_n.*")


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).parquet(path)
