"""Cross-tokenizer alignment: where the tokens of two vocabularies overlap, and which ids go together.

Both encodings of a text tile the same bytes. In a batch of documents, ``merge_asof`` keyed
by document finds for each token start the other side's token that covers it; the union of
both directions is every overlapping pair, and places where both sides end cut the text into
groups. A batch keeps its links as numbers into its own list of id pairs, so what is counted
over the corpus and handed back is one row per batch and pair, not one per link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common, packing, piece_encoding

# documents are worked on together up to so many characters; a longer one is a batch of its own
BATCH_CHARS = 1 << 20
# an id pair as one number: first * PAIR + second
PAIR = 1 << 32
_sides: dict[tuple[str, str], "Sides"] = {}


class Sides:
    """Both vocabularies: ids of a text, the bytes of every id, and the ids as decimal text."""

    def __init__(self, first: str, second: str) -> None:
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.fast = packing._fast(first)
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        raw = self._byte_of()
        names = {i: n for n, i in self.first.get_vocab(with_added_tokens=True).items()}
        special = {t.content for t in self.first.get_added_tokens_decoder().values()}
        self.a = [
            n.encode() if n in special else bytes(raw[c] for c in n)
            for n in (names.get(i, "") for i in range(max(names) + 1))]
        library = self.second
        self.b = [
            bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i)
            else b"" if library.is_control(i) or library.is_unknown(i)
            else library.id_to_piece(i).replace(piece_encoding.SPACE, " ").encode()
            for i in range(library.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.a, self.b))
        # the bytes of all ids behind one another, and where each begins
        self.flat_a, self.flat_b = (
            (np.frombuffer(b"".join(side), np.uint8), np.cumsum(size) - size)
            for side, size in ((self.a, self.size_a), (self.b, self.size_b)))
        # decimal ids with what may follow them: the next of the side, the other side, the next group, nothing
        self.text_a, self.text_b = (
            np.array([[b"%d%s" % (i, end) for i in range(len(side))] for end in (b",", b"|", b";", b"")], object)
            for side in (self.a, self.b))

    @staticmethod
    def _byte_of() -> dict[str, int]:
        """The byte each character of a byte-level entry stands for: printable ones themselves, others from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}

    def ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where their bytes are not those of a space and the text."""
        none = np.zeros(0, np.int64)
        first, second, raws = [], [], []
        for text, b in zip(texts, self.second.encode([t or "" for t in texts], num_threads=1)):
            raw = b""
            a = b = none if not text else np.array(b, np.int64)
            if text:
                raw, body = (" " + text).encode("utf-8", "surrogatepass"), " " + text
                if self.fast is not None and max(text) < "ɐ":
                    a = np.array(self.fast.encode_ordinary(body), np.int64)
                else:
                    a = np.array(self.first.encode(body, add_special_tokens=False).ids, np.int64)
                if not len(raw) == int(self.size_a[a].sum()) == int(self.size_b[b].sum()):
                    a, b, raw = none, none, b""
            first.append(a)
            second.append(b)
            raws.append(raw)
        told = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        for ids, sizes, flat in ((first, self.size_a, self.flat_a), (second, self.size_b, self.flat_b)):
            flat_ids = np.concatenate(ids) if ids else none
            size = sizes[flat_ids]
            shift = flat[1][flat_ids] - (np.cumsum(size) - size)
            wrong = np.flatnonzero(flat[0][np.repeat(shift, size) + np.arange(len(told))] != told)
            for i in np.unique(np.searchsorted(ends, wrong, "right")).tolist():
                first[i] = second[i] = none
            if len(wrong):
                return self.ids([t if len(x) else None for t, x in zip(texts, first)])
        return first, second


def sides(first: str, second: str) -> Sides:
    """One per worker and pair of files."""
    if (first, second) not in _sides:
        _sides[first, second] = Sides(first, second)
    return _sides[first, second]


def _covering(start: np.ndarray, doc: np.ndarray, other_start: np.ndarray, other_doc: np.ndarray) -> np.ndarray:
    """For each token the number of the other side's token that covers its start."""
    left = pd.DataFrame({"start": start, "doc": doc, "own": np.arange(len(start))})
    right = pd.DataFrame({"start": other_start, "doc": other_doc, "other": np.arange(len(other_start))})
    met = pd.merge_asof(
        left.sort_values("start", kind="stable"), right.sort_values("start", kind="stable"), on="start", by="doc")
    out = np.empty(len(start), np.int64)
    out[met["own"].to_numpy()] = met["other"].to_numpy()
    return out


def align(texts: list[str | None], both: Sides, wanted: bool = False) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """One batch: a row per text, its id pairs (sorted), how many links hold each, and each link's pair.

    The rows have n_a, n_b, n_groups, n_links, groups_sha256 and, if ``wanted``, groups;
    links follow one another text by text.
    """
    ids = both.ids(texts)
    docs = np.arange(len(texts))
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in ids)
    a, b = map(np.concatenate, ids)
    doc_a, doc_b = np.repeat(docs, n_a), np.repeat(docs, n_b)
    # ends over the whole batch: the texts lie one behind the other
    end_a, end_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
    size = np.bincount(doc_a, both.size_a[a], len(texts)).astype(np.int64)
    base = np.cumsum(size) - size
    start_a, start_b = end_a - both.size_a[a] - base[doc_a], end_b - both.size_b[b] - base[doc_b]

    to_b, to_a = _covering(start_a, doc_a, start_b, doc_b), _covering(start_b, doc_b, start_a, doc_a)
    inner = start_b > start_a[to_a]  # equal starts are found from both sides
    link_doc = np.concatenate((doc_a, doc_b[inner]))
    code = np.concatenate((a * PAIR + b[to_b], a[to_a[inner]] * PAIR + b[inner]))
    code = code[np.argsort(link_doc, kind="stable")]
    pairs, links, held = np.unique(code, return_inverse=True, return_counts=True)

    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    parts = np.empty(len(a) + len(b), object)
    more_a, more_b = (np.append(g[1:] == g[:-1], False) for g in (group_a, group_b))
    last = np.append(doc_b[1:] != doc_b[:-1], True)[: len(b)]
    parts[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = both.text_a[np.where(more_a[: len(a)], 0, 1), a]
    parts[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = both.text_b[
        np.where(more_b[: len(b)], 0, np.where(last, 3, 2)), b]
    edges = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    told = [b"".join(parts[x:y]) for x, y in zip(edges, edges[1:])]
    rows = pd.DataFrame({
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_b[np.append(~more_b[:-1], True)[: len(b)]], minlength=len(texts)),
        "n_links": np.bincount(link_doc, minlength=len(texts)),
        "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in told],
    })
    if wanted:
        rows["groups"] = [t.decode() for t in told]
    return rows, pairs, held, links


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of texts that are worked on together."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 64
        if i > begin and size + n > BATCH_CHARS:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
RESULTS = [*COUNTS, "n_best", "count_sum", "groups_sha256"]


def aligned(docs: DataFrame, first: str, second: str, text: str = "text", groups: bool = False) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    ``first`` is a byte-level vocabulary, which reads a space and the text, ``second`` one of
    pieces, which puts the space there itself. ``groups`` is text: the ids of both sides per
    group, as in ``1,2|7;3|8,9``. n_best counts the links whose id pair is the commonest of
    its second id in the whole corpus, all of several equally common ones; count_sum adds up
    the counts of the links' pairs. Texts that are null, empty or not given back byte by byte
    by both sides have no tokens, zeros and empty groups. A text is always aligned as a
    whole; repeated rows count as often as they stand there; no rows give no rows. The text
    itself is not kept; other columns are, unless named like a result.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    results = [*RESULTS, *(["groups"] if groups else [])]
    kept = [c for c in docs.columns if c != text and c.lower() not in results]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[
        F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)])
    own = ", ".join(f"_in{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    own = own + ", " if own else ""
    tail = ", groups string" if groups else ""
    made = (f"{own}batch long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string{tail}, "
            "links binary, pairs array<struct<pair:long,n:long>>")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = sides(first, second), TaskContext.get().partitionId() << 32
        kind = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in _batches(texts):
                told, pairs, held, links = align(texts[begin:end], both, groups)
                # numbers of pairs take two bytes while they fit
                raw = links.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
                edges = np.concatenate(([0], np.cumsum(told["n_links"]))).tolist()
                listed = pa.StructArray.from_arrays([pa.array(pairs), pa.array(held)], ["pair", "n"])
                # the pairs of a batch stand in its first row
                offsets = pa.array([0, *[len(pairs)] * (end - begin)], pa.int32())
                columns = [batch.column(i).slice(begin, end - begin) for i in range(1, batch.num_columns)]
                columns += [pa.array(np.full(end - begin, number)), *[pa.array(told[c].to_numpy(np.int64)) for c in COUNTS]]
                columns += [pa.array(told[c], pa.string()) for c in results if c.startswith("groups")]
                columns += [
                    pa.array([raw[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary()),
                    pa.ListArray.from_arrays(offsets, listed).cast(kind)]
                number += 1
                yield pa.record_batch(columns, names=[f.split()[0] for f in _fields(made)])

    found = common.staged(rows.mapInArrow(tokens, made), "tokens")
    listed = found.where(F.size("pairs") > 0).select("batch", F.posexplode("pairs").alias("at", "p"))
    counts = common.staged(
        listed.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("count")), "pairs")
    # one row per id of the second vocabulary at most
    second_id = F.pmod(F.col("pair"), F.lit(PAIR))
    most = counts.groupBy(second_id.alias("second")).agg(F.max("count").alias("most"))
    told = counts.join(most, second_id == F.col("second")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = listed.select("batch", "at", F.col("p.pair").alias("pair")).join(told, "pair").select(
        F.col("batch").alias("of"), "at", "count", "best")

    def summed(own_rows: pa.Table, table: pa.Table) -> pa.Table:
        count = np.zeros(table.num_rows, np.int64)
        best = np.zeros(table.num_rows, np.int64)
        at = table.column("at").to_numpy()
        count[at], best[at] = table.column("count").to_numpy(), table.column("best").to_numpy()
        width = "<u2" if table.num_rows <= 1 << 16 else "<u4"
        sums, bests = [], []
        for raw in own_rows.column("links").to_pylist():
            links = np.frombuffer(raw, width)
            sums.append(int(count[links].sum()))
            bests.append(int(best[links].sum()))
        out = own_rows.drop_columns(["batch", "links"])
        return out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    left = found.drop("pairs")
    schema = f"{own}n_a long, n_b long, n_groups long, n_links long, groups_sha256 string{tail}, n_best long, count_sum long"
    out = left.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(summed, schema)
    return out.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)], *results)


def _fields(schema: str) -> list[str]:
    """The top-level fields of a schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, packing.vocabulary(), piece_encoding.vocabulary()).select("doc_id", *RESULTS)
