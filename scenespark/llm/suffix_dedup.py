"""Exact removal of long byte strings that occur twice: anchor windows grouped by hash.

This is not the merge of shard Burrows-Wheeler transforms, whose interleave takes a pass over
all suffixes for each byte of common prefix, here 400 (measured in the README). It sorts
no suffixes and builds no transform. It finds the same repeated intervals, all strings of
``WINDOW`` bytes that start twice, from a sample of the places in a text:

* anchors are chosen by content: every window of ``WINDOW`` bytes has exactly one, the least
  of its k-mer hashes, the leftmost of equals, so equal windows have equal anchors at equal
  places;
* anchors are grouped by the hash of their k-mer. A group with one member is a string that
  occurs once: finished. One whose members agree on the whole context is repeated: finished;
* any other group splits by the place of the anchor in the window, coarse ranges first,
  and its parts are compared by the bytes all windows of the range share.

The last round compares single windows, so the outcome is exact up to equal hashes: k-mer and
context have 64 bits each, and within the anchors of one k-mer only the 64 bits of the
context tell strings apart. A finished group is never looked at again, and members with equal
contexts are one class with a count, so large groups of copies cost as much as one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common

WINDOW = 400
ANCHOR = 128
# ranges of anchor places that the rounds compare; the last is a single window
RANGES = (64, 8, 1)
# window starts that are worked on together
CHUNK = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every ``ANCHOR`` bytes, doubling the length step by step."""
    h = _TABLE[data]
    size, step = 1, 0
    while size < ANCHOR:
        h = h[:-size] * _FACTORS[step] + h[size:]
        size, step = 2 * size, step + 1
    h ^= h >> np.uint64(32)
    h *= _FACTORS[7]
    h ^= h >> np.uint64(29)
    return h


def runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last window start, anchor hash) of the runs of valid starts with one anchor."""
    width = WINDOW - ANCHOR + 1
    h = anchor_hashes(data)
    n = len(h) - width + 1
    value = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    padded[:len(h)] = value
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & _PLACE).astype(np.int64)
    valid = starts[:n]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    first, end = np.flatnonzero(new), np.flatnonzero(last)
    at = anchor[first]
    return at, first, end, h[at]


def _chunks(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """(buffer, [(text, place in the buffer, place in the text)]): short texts together, long ones in overlapping parts."""
    held: list[bytes] = []
    where: list[tuple[int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - WINDOW + 1), CHUNK):
            part = t[begin:begin + CHUNK + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if size and size + len(part) > CHUNK + WINDOW:
                yield b"".join(held), where
                held, where, size = [], [], 0
            where.append((i, size, begin))
            held.append(part)
            size += len(part)
    if held:
        yield b"".join(held), where


OCCURRENCES = "kmer long, sig long, key binary, at int, lo int, hi int"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        for buffer, where in _chunks(texts):
            data = np.frombuffer(buffer, np.uint8)
            starts = np.zeros(len(data), bool)
            places = np.array([w[1] for w in where])
            sizes = np.diff(np.concatenate((places, [len(data)])))
            for place, size in zip(places.tolist(), sizes.tolist()):
                starts[place:place + size - WINDOW + 1] = True
            at, first, last, kmer = runs(data, starts)
            lo, hi = at - last, at - first
            digest = xxhash.xxh3_64_intdigest
            sig = np.array([
                digest(buffer[a:b + WINDOW], seed=x << 16 | y)
                for a, b, x, y in zip(first.tolist(), last.tolist(), lo.tolist(), hi.tolist())], np.uint64)
            owner = np.searchsorted(places, first, "right") - 1
            text = np.array([w[0] for w in where])[owner]
            shift = np.array([w[2] for w in where])[owner] - places[owner]
            yield pa.record_batch([
                pa.array(_signed(kmer)), pa.array(_signed(sig)), keys.take(pa.array(text)),
                pa.array((at + shift).astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
            ], names=["kmer", "sig", "key", "at", "lo", "hi"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the listed anchors; equal texts in a row are read once."""
    names = ["kmer", "sig", "single", "key", "at", "lo", "hi", "bytes"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    before = None
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if key == before:
                continue
            before = key
            raw = (text or "").encode("utf-8", "surrogatepass")
            for p in places:
                values = (p["kmer"], p["sig"], p["single"], key, p["at"], p["lo"], p["hi"],
                          raw[p["at"] - p["hi"]:p["at"] - p["lo"] + WINDOW])
                for column, v in zip(out, values):
                    column.append(v)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=names)


PARTS = "kmer long, sig long, single boolean, place int, core long, whole long"


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Ranges of ``size`` anchor places of each context, within the open ranges (first, last).

    core: hash of what all windows of the full range share; whole: of all that the windows
    of this context in the range cover.
    """
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows: list[tuple] = []
        for kmer, sig, single, lo, hi, raw, spans in zip(*[c.to_pylist() for c in batch.columns]):
            for begin, end in ((s["first"], s["last"]) for s in spans):
                for b in range(begin // size * size, end + 1, size):
                    x, y = max(b, lo), min(b + size - 1, hi)
                    if x > y:
                        continue
                    core = raw[hi - b:max(hi - b + ANCHOR, hi - b - size + 1 + WINDOW)]
                    rows.append((kmer, sig, single, b, digest(core, seed=size),
                                 digest(raw[hi - y:hi - x + WINDOW], seed=x << 16 | y)))
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.record_batch([
            pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()),
            pa.array(columns[3], pa.int32()), pa.array(_signed(np.array(columns[4], np.uint64))),
            pa.array(_signed(np.array(columns[5], np.uint64))),
        ], names=["kmer", "sig", "single", "place", "core", "whole"])


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, first, last): runs of window starts, per text, whose window occurs elsewhere too.

    ``key`` is ``text_key`` of the text. Runs may touch or overlap, never across texts.
    """
    common.prepare(docs.sparkSession)
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    found = common.staged(keyed.mapInArrow(_occurrences, OCCURRENCES), "occurrences")
    blocks = found.groupBy("kmer").agg(
        F.count(F.lit(1)).alias("n"), F.min("sig").alias("least"), F.max("sig").alias("most")).where("n > 1")
    # staged, so that the join deals both sides anew and can split a frequent anchor's rows
    blocks = common.staged(blocks.select("kmer", (F.col("least") == F.col("most")).alias("agree")), "blocks")
    merged = common.staged(found.join(blocks, "kmer"), "merged")
    runs_of = [(F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last")]
    done = merged.where("agree").select("key", *runs_of)

    open_ = merged.where("not agree")
    classes = common.staged(open_.groupBy("kmer", "sig").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at", "lo", "hi")).alias("one")), "classes")
    copies = open_.join(classes.where("n > 1").select("kmer", "sig"), ["kmer", "sig"]).select("key", *runs_of)

    wanted = classes.groupBy("one.key").agg(F.collect_list(F.struct(
        "kmer", "sig", (F.col("n") == 1).alias("single"), "one.at", "one.lo", "one.hi")).alias("places"))
    contexts = common.staged(
        keyed.join(wanted, "key").select("key", "text", "places").mapInArrow(
            _contexts, "kmer long, sig long, single boolean, key binary, at int, lo int, hi int, bytes binary"), "contexts")
    work = contexts.select("kmer", "sig", "single", "lo", "hi", "bytes", F.array(F.struct(
        F.col("lo").alias("first"), F.col("hi").alias("last"))).alias("spans"))
    singles = contexts.where("single").select("kmer", "sig", "key", "at", "lo", "hi")
    answers = []
    for size in RANGES:
        parts = common.staged(work.mapInArrow(lambda it, s=size: _parts(it, s), PARTS), "parts")
        split = parts.groupBy("kmer", "place", "core").agg(
            F.count(F.lit(1)).alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"),
            F.count_if(~F.col("single")).alias("many")).where("n > 1")
        split = common.staged(
            split.select("kmer", "place", "core", (F.col("least") == F.col("most")).alias("agree")), "split")
        told = common.staged(parts.join(split, ["kmer", "place", "core"]).select("kmer", "sig", "single", "place", "agree"), "told")
        answers.append(
            told.where("agree and single").join(singles, ["kmer", "sig"]).select(
                "key",
                (F.col("at") - F.least(F.col("place") + (size - 1), F.col("hi"))).alias("first"),
                (F.col("at") - F.greatest("place", "lo")).alias("last")))
        if size == RANGES[-1]:
            break
        again = told.where("not agree").groupBy("kmer", "sig").agg(F.collect_set(F.struct(
            F.col("place").alias("first"), (F.col("place") + (size - 1)).alias("last"))).alias("spans"))
        work = contexts.join(again, ["kmer", "sig"]).select("kmer", "sig", "single", "lo", "hi", "bytes", "spans")
    out = done.unionAll(copies)
    for a in answers:
        out = out.unionAll(a)
    return out


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_bytes, n_removed, n_spans, spans (first byte, bytes), kept (binary) and kept_sha256.

    Every byte covered by a ``WINDOW``-byte string that starts anywhere else too is removed,
    judged on the input. Null text counts as empty. Texts below ``WINDOW`` bytes keep all;
    repeated rows of at least that size lose all. Long texts are read in overlapping parts;
    no rows give no rows. Input columns named like a result give
    way to it.
    """
    common.prepare(docs.sparkSession)
    runs_ = repeated(docs, text).distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = rows.withColumn("key", text_key(F.col(names[text]))).join(runs_, "key", "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,bytes:long>>, kept binary, "
                  "kept_sha256 string")
    def cut(body: pd.Series, runs_: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(body, runs_):
            raw = (t or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for a, b in sorted((r["first"], r["last"] + WINDOW) for r in (found if found is not None else ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edges = [0, *[x for s in spans for x in s], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if spans else raw
            out.append((len(raw), len(raw) - len(kept), len(spans), [(a, b - a) for a, b in spans], kept,
                        hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    rows = rows.withColumn("_cut", cut(F.col(names[text]).cast("string"), F.col("_runs")))
    fields = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]
    keep = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in fields]
    return rows.select(*keep, *[F.col(f"_cut.{f}").alias(f) for f in fields])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return removed(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("changed"))


# hexadecimal digits stand for bytes, two of them each; long texts are cut into overlapping parts of so many windows
_PART = 256
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
cut AS (
  SELECT doc_id, c, substr(x, {2 * _PART} * c + 1, {2 * (_PART + WINDOW - 1)}) AS x
  FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2 - {WINDOW} + {_PART}) // {_PART})) AS c FROM d
        WHERE len(x) >= {2 * WINDOW})),
wins AS (
  SELECT doc_id, c * {_PART} + i AS i, md5(substr(x, 2 * i + 1, {2 * WINDOW})) AS h
  FROM (SELECT doc_id, c, x, unnest(range(0, len(x) // 2 - {WINDOW - 1})) AS i FROM cut)),
twice AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM wins WHERE h IN (SELECT h FROM wins GROUP BY h HAVING count(*) > 1)),
numbered AS (
  SELECT doc_id, i, count_if(before IS NULL OR i - before > {WINDOW}) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM twice),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + {WINDOW} AS b FROM numbered GROUP BY doc_id, span),
told AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a AS stop FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * start + 1, 2 * (coalesce(stop, len(x) // 2) - start)), '' ORDER BY start) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256, coalesce(n_removed, 0) > 0 AS changed
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
