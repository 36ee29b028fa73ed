"""Benchmark decontamination: a broadcast set of normalised test n-grams against token windows.

Hits are verified on the words themselves; the operator marks documents, lists the spans
and can cut them out. The set is broadcast only if the benchmark's text is within a bound.
A larger benchmark never leaves the cluster: its windows and those of the documents meet in
a join on the words, after a bit filter of fixed size has dropped most document windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common

WINDOW = 13
# a document is contaminated from this share of hit words
SHARE = 0.05
# up to so many bytes of benchmark text are broadcast
BLOCK_BYTES = 16 << 20
# the filter of the join has 64 << FILTER_BITS bits, 16 MB
FILTER_BITS = 21
_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Grams:
    """The windows of one block of test items: vocabulary, rare first word and exact windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        # window length -> {word ids of the window: items that have it, None for those without an id}
        self.by_length: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for name, text in items:
            got = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            if not got:
                continue
            size = min(window, len(got))
            grams = self.by_length.setdefault(size, {})
            for i in range(len(got) - size + 1):
                grams.setdefault(tuple(got[i:i + size]), set()).add(name)

    def hits(self, found: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """(mask of the hit words, items with an occurring window)."""
        known = np.array([self.ids.get(w, -1) for w in found], np.int64)
        mask, names = np.zeros(len(found), bool), set()
        # words in a row that any test item uses: only such stretches can hold a window
        ends = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).astype(np.int8), [0]))))
        for start, stop in zip(ends[::2].tolist(), ends[1::2].tolist()):
            stretch = None
            for size, grams in self.by_length.items():
                if stop - start < size:
                    continue
                stretch = stretch or known[start:stop].tolist()
                for i in range(stop - start - size + 1):
                    owners = grams.get(tuple(stretch[i:i + size]))
                    if owners:
                        mask[start + i:start + i + size] = True
                        names |= owners
        return mask, names


FIELDS = ["n_words", "n_hit", "n_items", "items_sha256", "spans", "contaminated"]
MARKS = ("n_words long, n_hit long, n_items long, items_sha256 string, "
         "spans array<struct<first:long,words:long>>, contaminated boolean")


def _told(mask: np.ndarray, names: set[str | None], one_in: int) -> tuple:
    """The ``FIELDS`` of one document from its hit words and items."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    n_hit = int(mask.sum())
    return (
        len(mask), n_hit, len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(),
        [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])], n_hit > 0 and one_in * n_hit >= len(mask),
    )


def _by_broadcast(docs: DataFrame, items: DataFrame, window: int, one_in: int, text: str, name: str) -> DataFrame:
    rows = [(r["item"], r["text"]) for r in items.collect()]  # within the bound
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf(MARKS)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams(shared.value, window)
        for batch in batches:
            yield pd.DataFrame([_told(*grams.hits(words(t)), one_in) for t in batch], columns=FIELDS)

    return docs.withColumn(name, judged(F.col(f"`{text}`")))


def _cell(gram: bytes) -> int:
    return xxhash.xxh3_64_intdigest(gram) & ((64 << FILTER_BITS) - 1)


def _by_join(docs: DataFrame, items: DataFrame, window: int, one_in: int, text: str, name: str) -> DataFrame:
    """Windows of documents and items meet by their words; texts are told apart by a digest."""
    spark = docs.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(body)
                size = min(window, len(found))
                for gram in {b" ".join(found[i:i + size]) for i in range(len(found) - size + 1)} if found else ():
                    rows.append((item, size, gram, _cell(gram) >> 6, _cell(gram) & 63))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int32()))],
                names=["item", "size", "gram", "cell", "bit"])

    grams = common.staged(
        items.mapInArrow(of_items, "item string, size int, gram binary, cell int, bit int").distinct(), "grams")
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # one row per length, ``window`` at most
    cells = grams.groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect()  # 1 << FILTER_BITS at most
    bitmap = np.zeros(1 << FILTER_BITS, np.int64)
    bitmap[[r["cell"] for r in cells]] = [r["bits"] for r in cells]
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keys, starts, lengths, found_grams = [], [], [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(body)
                for size in sizes:
                    for i in range(len(found) - size + 1):
                        gram = b" ".join(found[i:i + size])
                        at = _cell(gram)
                        if int(bits[at >> 6]) >> (at & 63) & 1:
                            keys.append(key)
                            starts.append(i)
                            lengths.append(size)
                            found_grams.append(gram)
            yield pa.record_batch(
                [pa.array(keys, pa.binary()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()),
                 pa.array(found_grams, pa.binary())], names=["key", "first", "size", "gram"])

    key = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")))
    tagged = docs.withColumn(name, key)
    windows = tagged.select(F.col(name).alias("key"), F.col(f"`{text}`").cast("string").alias("body")).mapInArrow(
        of_docs, "key binary, first int, size int, gram binary")
    hits = common.staged(windows.join(grams.select("size", "gram").distinct(), ["size", "gram"]).distinct(), "hits")
    places = hits.groupBy("key").agg(F.collect_list(F.struct("first", "size")).alias("_places"))
    owners = (
        hits.select("key", "size", "gram").distinct().join(grams.select("size", "gram", "item"), ["size", "gram"])
        .groupBy("key").agg(F.collect_set(F.struct("item")).alias("_items"))
    )
    marks = common.staged(places.join(owners, "key"), "marks")
    more = [common.tmp(docs, "_hit_places"), common.tmp(docs, "_hit_items")]
    marks = marks.toDF(name, *more)

    @F.pandas_udf(MARKS)
    def judged(body: pd.Series, places: pd.Series, names: pd.Series) -> pd.DataFrame:
        out = []
        for t, at, got in zip(body, places, names):
            mask = np.zeros(len(words(t)), bool)
            for p in at if at is not None else ():
                mask[p["first"]:p["first"] + p["size"]] = True
            out.append(_told(mask, {g["item"] for g in got} if got is not None else set(), one_in))
        return pd.DataFrame(out, columns=FIELDS)

    joined = tagged.join(marks, name, "left")
    return joined.withColumn(name, judged(F.col(f"`{text}`"), *more)).drop(*more)


def mark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE,
    block_bytes: int = BLOCK_BYTES, text: str = "text",
) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, spans and contaminated.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item. A
    document word inside an occurrence of a window is hit; ``spans`` lists the runs of hit
    words as (first word, words). Null and empty texts have no words and are clean; items
    without words match nothing; an empty benchmark hits nothing. Items without an id hit
    words as others do: n_items counts them as one together, items_sha256 (the digest of
    the listed ids) leaves them out. Repeated rows are marked
    alike; input columns named like a result give way to it. More than ``block_bytes`` of
    benchmark text and ids are joined instead of broadcast.
    """
    common.prepare(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    name = common.tmp(docs, "_marked")
    way = _by_broadcast if size <= block_bytes else _by_join
    out = way(docs, items, window, round(1 / share), text, name)
    return common.replaced(out, {f: F.col(f"{name}.{f}") for f in FIELDS}).drop(name)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def remove_spans(marked: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit words out of marked texts; each removed run leaves one blank.

    Separators around a run stay. Null stays null, texts without a span stay as they are.
    """

    @F.pandas_udf("string")
    def cut(body: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, runs in zip(body, spans):
            if t is None or runs is None or not len(runs):
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            at = [m.span() for m in _WORDS.finditer(raw.lower())]
            kept, before = [], 0
            for run in runs:
                kept.append(raw[before:at[run["first"]][0]])
                before = at[run["first"] + run["words"] - 1][1]
            kept.append(raw[before:])
            out.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    return marked.withColumn(text, cut(F.col(f"`{text}`"), "spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, the others pass with the columns of ``documents``, any more are dropped."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    marked = mark(docs.select(*columns), common.table(spark, sf_dir, "benchmark"))
    return marked.where("not contaminated").select(*columns)


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, m, w[i:i + m - 1] AS g
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
wins AS (
  SELECT doc_id, m, i, w[i:i + m - 1] AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM grams) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, wins.m, item FROM wins JOIN grams ON wins.m = grams.m AND wins.g = grams.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {round(1 / SHARE)} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
