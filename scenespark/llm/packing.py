"""Packing by non-negative least squares over length combinations.

Documents are tokenised once and cut into whole windows and one remainder. The remainders'
length histogram (one count per length, so its size is that of the window) is all the
solver sees: combinations of two or three lengths that fill a window are columns, their
repeat counts the non-negative least-squares solution, rounded down; what is left is
packed greedily, longest first, in patterns that repeat as often as their lengths last.
Each piece then finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from scenespark.llm import common

LENGTH = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"
# pieces of one length are ranked in buckets of about so many rows of the table
BUCKET_ROWS = 8192
ROUNDS = 200
_tokenizers: dict[str, object] = {}


def _plain(path: str):
    """The tokenizer of the file itself."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _fast(path: str):
    """The same vocabulary in a faster library, if its ranks lie beside the file; else None."""
    ranks = path.rsplit(".", 1)[0] + ".tiktoken"
    if ranks not in _tokenizers:
        _tokenizers[ranks] = None
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            _tokenizers[ranks] = tiktoken.Encoding(
                "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _tokenizers[ranks]


def token_ids(text: str | None, path: str) -> list[int]:
    """Ids of a text and the end id; null counts as empty.

    Texts of letters up to U+024F take the faster library, which gives the same ids there
    (see the tests); others, and texts that spell a special token, the tokenizer itself.
    """
    if not text:
        return [END]
    fast = _fast(path)
    if fast is not None and max(text) < "ɐ" and "<|" not in text:
        return [*fast.encode_ordinary(text), END]
    return [*_plain(path).encode(text, add_special_tokens=False).ids, END]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, text: str = "text") -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, start, length, ids_crc32, doc_tokens.

    A document of n ids is cut into n // length whole windows and the remainder.
    """
    common.prepare(docs.sparkSession)

    @F.pandas_udf("array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long>>")
    def cut(body: pd.Series) -> pd.Series:
        out = []
        for t in body:
            ids = np.array(token_ids(t, path), "<u4")
            out.append([
                (s, min(length, len(ids) - s), zlib.crc32(ids[s:s + length].tobytes()), len(ids))
                for s in range(0, len(ids), length)
            ])
        return pd.Series(out)

    name = common.tmp(docs, "_piece")
    rows = docs.withColumn(name, F.explode(cut(F.col(f"`{text}`"))))
    fields = ["start", "length", "ids_crc32", "doc_tokens"]
    got = common.replaced(rows, {f: F.col(f"{name}.{f}") for f in fields})
    return got.drop(name, text)


@dataclass
class Plan:
    """For each length the slots its ranks fill: first rank, sequence of that rank, offset there."""

    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int
    tokens: int
    patterns: int


def combinations_of(lengths: np.ndarray, window: int) -> list[np.ndarray]:
    """Pairs and triples (a <= b <= c) of the given lengths that fill the window."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a = lengths[lengths <= window // 2]
    pairs = np.stack([a, window - a], 1)
    pairs = pairs[there[pairs[:, 1]]]
    triples = []
    for x in lengths[lengths <= window // 3].tolist():
        y = lengths[(lengths >= x) & (lengths <= (window - x) // 2)]
        z = window - x - y
        ok = there[z]
        triples.append(np.stack([np.full(ok.sum(), x), y[ok], z[ok]], 1))
    return [pairs, np.concatenate(triples) if triples else np.zeros((0, 3), np.int64)]


def solve(histogram: np.ndarray, columns: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Repeat counts x >= 0 of the columns that minimise |A x - histogram|, by multiplicative updates."""
    target = histogram.astype(float)
    x = [np.full(len(c), 1.0) for c in columns]
    want = [target[c].sum(1) for c in columns]
    for _ in range(rounds):
        filled = sum(
            np.bincount(c.ravel(), np.repeat(v, c.shape[1]), len(target)) for c, v in zip(columns, x) if len(c))
        if np.isscalar(filled):
            break
        x = [v * w / np.maximum(filled[c].sum(1), 1e-12) for c, v, w in zip(columns, x, want)]
    return x


def plan(histogram: np.ndarray, window: int) -> Plan:
    """Sequences for all pieces of a histogram over lengths 1..window."""
    left = histogram.astype(np.int64).copy()
    used: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        used.append(((window,), int(left[window])))
        left[window] = 0
    columns = combinations_of(np.flatnonzero(left), window)
    counts = solve(left, columns)
    for column, count in zip(columns, counts):
        whole = np.floor(count + 1e-9).astype(np.int64)
        for at in np.argsort(-whole, kind="stable")[: int((whole > 0).sum())].tolist():
            lengths = tuple(column[at].tolist())
            times = min(int(whole[at]), min(left[n] // lengths.count(n) for n in lengths))
            if times:
                used.append((lengths, int(times)))
                for n in lengths:
                    left[n] -= times
    # residuals: the longest piece, then always the longest that still fits
    while left.any():
        pattern: list[int] = []
        free, have = window, left.copy()
        while free:
            fit = np.flatnonzero(have[: free + 1])
            if not len(fit):
                break
            n = int(fit[-1])
            pattern.append(n)
            have[n] -= 1
            free -= n
        times = int(min(left[n] // pattern.count(n) for n in set(pattern)))
        used.append((tuple(pattern), times))
        for n in pattern:
            left[n] -= times
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(window + 1, np.int64)
    sequence = 0
    for lengths, times in used:
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((int(taken[n]), sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    packed = {n: tuple(np.array(c, np.int64) for c in zip(*s)) for n, s in slots.items()}
    return Plan(packed, sequence, int((histogram * np.arange(window + 1)).sum()), len(used))


def packed(rows: DataFrame, order: list[str], length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to ``length`` ids.

    ``order`` names the columns that tell pieces of one length apart; equal rows are
    interchangeable. Ranks come from counts per length and bucket, so a length that many
    copies share is no hot group. Without rows there are no sequences.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("length").count().collect()  # one row per length at most
    histogram = np.zeros(length + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    shared = spark.sparkContext.broadcast(plan(histogram, length).slots)
    buckets = int(histogram.sum()) // BUCKET_ROWS + 8
    name = common.tmp(rows, "_bucket")
    tagged = rows.withColumn(name, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = tagged.groupBy("length", name).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", name).orderBy(*order)
    ranked = tagged.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, ["length", name])

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slots = shared.value
        sizes, ranks = n.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for size in np.unique(sizes).tolist():
            here = sizes == size
            first, seq, off = slots[size]
            at = np.searchsorted(first, ranks[here], "right") - 1
            sequence[here] = seq[at] + ranks[here] - first[at]
            offset[here] = off[at]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    put = ranked.withColumn("_place", place("length", F.col("_ahead") + F.col("_rank")))
    return put.select(*[F.col(f"`{c}`") for c in rows.columns], "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, path: str, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences.

    A null or empty text is the end id alone; a text is tokenised as a whole and cut after,
    however long. Repeated rows and ids are packed once each;
    columns of ``docs`` named like a result give way to it.
    """
    cut = common.staged(pieces(docs, path, length, text), "pieces")
    return packed(cut, [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in cut.columns], length)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, common.table(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of every document and their places; columns beyond the id are dropped."""
    return pack(docs.select("doc_id", "text"), vocabulary()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
