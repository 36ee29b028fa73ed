"""SimHash near duplicates: a popcount embedding, a grid join under Manhattan distance, exact checks.

A fingerprint's 64 bits are 32 segments of two bits; the bit counts of the segments are its
point. Flipping one bit moves the point by at most one, so the Manhattan distance of two
points never exceeds the Hamming distance. Points within distance ``RADIUS`` differ in at
most ``RADIUS`` of the eight groups of four segments and so share the counts of at least
four groups: every choice of four groups is a grid, and each fingerprint enters one cell of
each grid. What meets in a cell is verified on the bits.

A cell emits the components of its members, never all pairs. The members of a cell with
more than ``CELL`` fingerprints (one neighbourhood of heavily edited copies) take an exact
way of linear size instead: two fingerprints differ in at most four bits exactly when some
point is within two bits of both, so each is linked to the smallest one at each of the
2081 points around it.

``op6_simhash`` keeps to this rule. Near copies of the pipeline are linked by it as well, and
beyond it if their sets of five-word shingles have a similarity (common / all) of ``SIMILAR`` or
more. Such pairs differ in about ten bits of a fingerprint and often in more, beyond what a grid
can prune, so candidates share the smallest hashes of a band, and each is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common

SHINGLE = 4
RADIUS = 4
SEED = 42
# where all pairs of a cell cost as much as the points around its members
CELL = 2081
# shingles of a long text that are counted together
PART = 1 << 16
_EVEN = 0x5555555555555555
# near copies of the pipeline: words of a shingle, and the similarity from which texts are linked
WORDS = 5
SIMILAR = 0.8
# a pair of similarity 0.8 shares no band with a probability of (1 - 0.8^5)^25 = 0.00005
BANDS, BAND = 25, 5
# shingles of the members of a cell that are compared in one task; more are compared part by part
CELL_SHINGLES = 1 << 20


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# one mask per choice of four of the eight groups, each group a byte of the embedding
GRIDS = [signed(sum(0xFF << (8 * g) for g in chosen)) for chosen in combinations(range(8), 4)]


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, a part of them at a time; a text of fewer words is one shingle."""
    if not text:
        return
    # bytes.split() cuts at 0x09-0x0D and 0x20, bytes.lower() touches A-Z alone
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([digest(joined, SEED)], "<u8")
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    first, last = starts[:-shingle], starts[shingle:] - 1
    for at in range(0, len(first), PART):
        yield np.array(
            [digest(joined[a:b], SEED) for a, b in zip(first[at:at + PART].tolist(), last[at:at + PART].tolist())], "<u8")


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half the shingle hashes; 0 for a text without words."""
    bits, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, SHINGLE):
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of the five-word shingles' hashes."""
    found = [np.unique(h) for h in _hashes(text, WORDS)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, "<u8")


# an odd factor turns the hashes into another order
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * BAND, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(found: np.ndarray) -> list[int]:
    """One hash per band, over the smallest shingle in each of the band's orders; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[at:at + 4096] * _FACTORS).min(1))
    return [signed(xxhash.xxh64_intdigest(b.tobytes(), SEED)) for b in least.reshape(BANDS, BAND)]


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint of every whole text as a signed 64-bit number."""
    common.prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def of(body: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(t)) for t in body], dtype="int64")

    return common.replaced(docs, {name: of(F.col(f"`{text}`"))})


def _component_stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) for members linked within a cell."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _cells(batches: Iterator[pa.RecordBatch], radius: int, cell: int) -> Iterator[pa.RecordBatch]:
    """Edges of the cells in a partition sorted by grid, cell and fingerprint.

    A cell may span batches; beyond ``cell`` members they leave as dense rows at once, so
    no more than that is ever held.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dense", pa.bool_())])
    open_key, dense = None, False
    held = np.zeros((0, 3), np.int64)

    def edges(rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        first = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((first, [len(rows)])))
        fps = rows[:, 2].view(np.uint64)
        two = first[size == 2]
        close = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
        left, right = [fps[two[close] + 1]], [fps[two[close]]]
        for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            x, y = _component_stars(fps[s:s + n], radius)
            left.append(x)
            right.append(y)
        return left, right

    def batch(left: list[np.ndarray], right: list[np.ndarray], alone: np.ndarray) -> pa.RecordBatch:
        a = np.concatenate([*left, alone]).astype(np.uint64).view(np.int64)
        b = np.concatenate([*right, alone]).astype(np.uint64).view(np.int64)
        flag = np.arange(len(a)) >= len(a) - len(alone)
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(flag)], schema=schema)

    empty = np.zeros(0, np.uint64)
    for got in batches:
        rows = np.stack([got.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        if not len(rows):
            continue
        alone = []
        if dense:
            same = (rows[:, 0] == open_key[0]) & (rows[:, 1] == open_key[1])
            alone.append(rows[same, 2].view(np.uint64))
            rows = rows[~same]
            if not len(rows):
                yield batch([], [], np.concatenate(alone))
                continue
            dense = False
        rows = np.concatenate((held, rows))
        tail = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
        start = int(tail[-1]) + 1 if len(tail) else 0
        open_key, held, rows = (rows[-1, 0], rows[-1, 1]), rows[start:], rows[:start]
        if len(held) > cell:
            alone.append(held[:, 2].view(np.uint64))
            held, dense = held[:0], True
        # complete cells that are large but came in one batch
        left, right = [], []
        if len(rows):
            cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            first = np.concatenate(([0], cut))
            size = np.diff(np.concatenate((first, [len(rows)])))
            large = np.repeat(size > cell, size)
            alone.append(rows[large, 2].view(np.uint64))
            if (~large).any():
                left, right = edges(rows[~large])
        yield batch(left, right, np.concatenate(alone) if alone else empty)
    if len(held) > 1:
        yield batch(*edges(held), empty)


def _around(dense: DataFrame) -> DataFrame:
    """Edges (a, b) among fingerprints that share a point within two bits."""
    points = F.expr("""concat(array(0L), flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j ->
        shiftleft(1L, i) | shiftleft(1L, j)))))""")
    ball = dense.withColumn("_points", points).select(
        "fp", F.explode(F.expr("transform(_points, m -> fp ^ m)")).alias("point"))
    least = ball.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b <> most")
    return ball.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints at ``RADIUS`` or fewer differing bits.

    The components of the edges are those of all such pairs; each cell sends a spanning
    star instead of its pairs.
    """
    # two bits of a segment: 2 where both are set, 1 where one is
    counts = F.expr(f"shiftleft(fp & shiftrightunsigned(fp, 1) & {_EVEN}L, 1) | ((fp ^ shiftrightunsigned(fp, 1)) & {_EVEN}L)")
    rows = (
        fps.select("fp").withColumn("_v", counts)
        .select(F.posexplode(F.array(*[F.col("_v").bitwiseAND(F.lit(m)) for m in GRIDS])).alias("grid", "cell"), "fp")
        .repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")
    )
    found = common.staged(
        rows.mapInArrow(lambda it: _cells(it, RADIUS, cell), "a long, b long, dense boolean"), "cells")
    sparse = found.where("not dense").select("a", "b")
    dense = found.where("dense").select(F.col("a").alias("fp")).distinct()
    return sparse.unionAll(_around(dense))


def grouped(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) per document.

    component_id is the smallest id among documents reachable over links of at most
    ``RADIUS`` bits; texts without words share fingerprint zero. Equal fingerprints are
    linked without pairs. A bit set in exactly half of the shingles is 0; a long text is
    counted in parts; no rows give no rows. Repeated rows come once each; a null id is never a
    representative, and a group of null ids alone has a null component_id.
    """
    marked = common.staged(fingerprints(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))).select(
        "doc_id", "fp"), "fingerprints")
    fps = common.staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = common.components(links(fps)).withColumnRenamed("id", "fp")
    whole = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.staged(whole.select("fp", "root").join(names, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(common.table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _linked(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """Per set the smallest index in its component of pairs at ``similar`` or more; all pairs count."""
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(size)[:-1])
    label, mark = np.arange(len(sets)), np.zeros(int(size.sum()), bool)
    for i in range(len(sets) - 1):
        # pairs of one component need no look; nor do sizes too far apart
        rest = np.flatnonzero(
            (label[i + 1:] != label[i]) & (np.minimum(size[i + 1:], size[i]) + 1e-9 >= similar * np.maximum(size[i + 1:], size[i]))
        ) + i + 1
        if not len(rest):
            continue
        mark[ids[i]] = True
        common_n = np.add.reduceat(
            mark[np.concatenate([ids[j] for j in rest])], np.concatenate(([0], np.cumsum(size[rest])[:-1])), dtype=np.int64)
        mark[ids[i]] = False
        near = rest[common_n + 1e-9 >= similar * (size[i] + size[rest] - common_n)]
        if len(near):
            joined = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label


def _verified(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Edges of the cells in a partition sorted by cell and parts."""
    of, keys, sets = None, [], []

    def edges() -> pa.RecordBatch:
        label = _linked(sets, similar) if len(sets) > 1 else np.arange(len(sets))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([
            pa.array([keys[i] for i in moved], pa.int64()), pa.array([keys[label[i]] for i in moved], pa.int64())], names=["a", "b"])

    for batch in batches:
        for *cell, key, body in zip(*[c.to_pylist() for c in batch.columns]):
            if cell != of:
                yield edges()
                of, keys, sets = cell, [], []
            keys.append(key)
            sets.append(np.frombuffer(body, "<u8"))
    yield edges()


def near_links(marked: DataFrame, docs: DataFrame, similar: float = SIMILAR, most: int = CELL_SHINGLES) -> DataFrame:
    """Edges (a, b) whose components are those of all candidates with similar shingle sets.

    ``marked``: row, key, size, bands; ``docs``: row, text. Equal sets share a key and are
    one member. Cells with the same members count once; all pairs of a cell are compared,
    those of a large cell in pairs of parts.
    """
    sets = marked.where("size > 0").groupBy("key").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    rows = sets.select("key", "size", F.posexplode("bands").alias("band", "cell"))
    cells = rows.groupBy("band", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("n > 1")
    cells = cells.groupBy("n", "x", "y", "total").agg(F.min(F.struct("band", "cell")).alias("c")).select(
        "c.band", "c.cell", F.ceil(F.col("total") / F.lit(most)).cast("int").alias("parts"))
    members = common.staged(rows.join(cells, ["band", "cell"]).select("band", "cell", "parts", "key"), "members")
    wanted = members.select("key").distinct().join(sets.select("key", "row"), "key")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([
                batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())],
                names=["key", "body"])

    found = common.staged(docs.join(wanted, "row").dropDuplicates(["row"]).select("key", F.col("text").cast("string")).mapInArrow(
        bodies, "key long, body binary"), "shingles")
    part = F.expr("pmod(xxhash64(key, 2), parts)")
    split = members.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = split.select("key", "band", "cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    return (
        dealt.join(found, "key").select("band", "cell", "low", "high", "key", "body")
        .repartition("band", "cell", "low", "high").sortWithinPartitions("band", "cell", "low", "high", "key")
        .mapInArrow(lambda it: _verified(it, similar), "a long, b long")
    )


def fingerprint_links(marked: DataFrame) -> DataFrame:
    """Edges (a, b) among the keys of ``marked`` (key, size, fp) whose fingerprints are equal or linked by the grids."""
    keys = common.staged(marked.where("size > 0").select("key", "fp").distinct(), "keys")
    fps = common.staged(keys.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    equal = keys.join(fps, "fp").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    ends = [fps.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in "ab"]
    near = links(fps).join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return equal.unionAll(near)


def _row() -> Column:
    """A digest of all columns: rows with the same digest are repeated rows."""
    return F.sha2(F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars")), 256)


def near_groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(row, doc_id, key, root) per document: rows of one root are near copies, directly or through others.

    Links are those of the fingerprints and those of the shingle sets. Texts without words are
    copies of each other.
    """
    common.prepare(docs.sparkSession)

    @F.pandas_udf("key long, size int, bands array<long>, fp long")
    def of(body: pd.Series) -> pd.DataFrame:
        found = [shingles(t) for t in body]
        return pd.DataFrame({
            "key": [signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) if len(x) else 0 for x in found],
            "size": [len(x) for x in found], "bands": [bands(x) for x in found],
            "fp": pd.Series([signed(fingerprint(t)) for t in body], dtype="int64")})

    rows = docs.withColumn("row", _row())
    marked = common.staged(rows.select("row", "doc_id", of(F.col("text").cast("string")).alias("_m")).select("row", "doc_id", "_m.*"), "marked")
    edges = fingerprint_links(marked).unionAll(near_links(marked, rows.select("row", "text"), similar))
    roots = common.components(edges).withColumnRenamed("id", "key")
    return marked.select("row", "doc_id", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies one row stays, decided per row.

    It is the row with the smallest id, nulls last, then with the smallest digests of its
    shingles and columns. Repeated rows are one. Columns beyond those of ``documents`` are dropped.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(*columns)
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key", "row")
    keep = near_groups(docs).groupBy("root").agg(F.min(order).alias("_first")).select("_first.row")
    return docs.withColumn("row", _row()).join(keep, "row", "left_semi").dropDuplicates(["row"]).select(*columns)
