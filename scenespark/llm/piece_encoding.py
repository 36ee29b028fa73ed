"""Exact encoding by a merge-type piece vocabulary, found by backtracking instead of merging.

Merging joins the adjacent pair whose union is the best piece, the leftmost of equals, until
none is left. A sequence of pieces is its outcome exactly if every piece and every two
neighbours come out of merging their own characters as they are: merges never cross a
border that no neighbour crosses. So the encoder walks through the text: an Aho-Corasick
automaton names the longest piece at every place, a piece that does not suit the one before
it gives way to its next shorter prefix, and where none is left the place is marked as
failed and the piece before is taken back. Whether two pieces suit each other is decided by
merging them once; the answers are kept.

Where no piece can reach across a border (a space after a word, two characters that stand
together in no piece), the text is cut, so that the parts, mostly words, are encoded once and looked up after.
Characters without a piece become their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_file

from scenespark.llm import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# answers kept by a worker: parts of a text, each of so many characters at most, and pairs of pieces
KEPT_PARTS, KEPT_LENGTH, KEPT_PAIRS = 250_000, 48, 250_000
FAR = float("inf")
_encoders: dict[str, "Encoder"] = {}
_libraries: dict[str, sentencepiece.SentencePieceProcessor] = {}


class Answers(dict):
    """Ids of the parts seen lately; ``find`` tells those of another one.

    Full, they step back behind the next ones: answers still in use return, the others go
    the next time.
    """

    def __init__(self, find: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.find, self.earlier = find, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        told = self.earlier.get(part)
        if told is None:
            told = self.find(part)
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT_PARTS:
                self.earlier = dict(self)
                self.clear()
            self[part] = told
        return told


class Encoder:
    """The pieces of a model file; texts go in as they are (no normalisation, a space in front)."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = model_file.ModelProto.FromString(file.read())
        rules, kinds = model.normalizer_spec, model_file.ModelProto.SentencePiece
        if (model.trainer_spec.model_type != model_file.TrainerSpec.BPE or not model.trainer_spec.byte_fallback
                or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces
                or not rules.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("a merge vocabulary with byte fallback and texts as they are is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("pieces of a user or out of use have rules of their own")
        self.order = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.end = self.library.eos_id()
        # a piece that merging its own characters does not give stands nowhere
        self.history: dict[str, list[tuple[float, str, str]]] = {}
        self.ids = {}
        for p, i in ids.items():
            steps: list[tuple[float, str, str]] = []
            if self.merged(p, steps) == [p]:
                self.ids[p], self.history[p] = i, steps
        self.shorter: dict[str, str | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None)
            # the first character alone is the last resort, with or without a piece of its own
            if self.shorter[p] is None and len(p) > 1:
                self.shorter[p] = p[0]
        self.automaton.make_automaton()
        self.parts_of = re.compile(self._borders()).findall
        self.suits: dict[str, dict[str, bool]] = {}
        self.answers = 0
        self.known = Answers(self._part)

    def _borders(self) -> str:
        """A pattern of the parts of a text that merges never leave.

        Characters that stand next to each other in some piece belong together, and so do
        theirs; no merge joins characters of two such families.
        """
        inner = any(SPACE in p.lstrip(SPACE) for p in self.order)
        family: dict[str, str] = {}

        def head(c: str) -> str:
            while family.setdefault(c, c) != c:
                c = family[c]
            return c

        for p in self.order:
            body = p if inner else p.lstrip(SPACE)
            for c, d in zip(body, body[1:]):
                family[head(c)] = head(d)
        members: dict[str, list[str]] = {}
        for c in family:
            members.setdefault(head(c), []).append(c)
        classes = ["[" + "".join(map(re.escape, sorted(m))) + "]+" for m in members.values()]
        spaces = "" if inner else f"{SPACE}*"
        runs = "|".join(spaces + c for c in sorted(classes, key=len, reverse=True))
        alone = "(?s:.)" if inner else f"{SPACE}*[^{SPACE}]|{SPACE}+"
        return f"{runs}|{alone}" if runs else alone

    def merged(self, text: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """The outcome of merging the characters of a short text.

        ``steps`` gets, for each merge, its order and the first and last part after it.
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.order.get(parts[i] + parts[i + 1], FAR), i) for i in range(len(parts) - 1))
            if best == FAR:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
        return parts

    def _suits(self, a: str, b: str) -> bool:
        """Whether merging the characters of both gives the two pieces again.

        The merges of each piece by itself are replayed side by side, the better one first;
        the pieces part ways only if, at some step, the two parts at the border merge before.
        """
        left, right, i, j = self.history.get(a, ()), self.history.get(b, ()), 0, 0
        x, y = a[-1], b[0]
        while True:
            across = self.order.get(x + y, FAR)
            of_a = left[i][0] if i < len(left) else FAR
            of_b = right[j][0] if j < len(right) else FAR
            # of equally good merges the leftmost comes first
            if across < of_a and across <= of_b and across < FAR:
                return False
            if of_a == of_b == FAR:
                return True
            if of_a <= of_b:
                x = left[i][2]
                i += 1
            else:
                y = right[j][1]
                j += 1

    def pieces(self, part: str) -> list[str]:
        """The pieces of a part, by backtracking; a character without a piece stands for itself."""
        longest, size, suits, shorter = list(part), len(part), self.suits, self.shorter
        for end, piece in self.automaton.iter(part):
            longest[end + 1 - len(piece)] = piece  # longer ones end later
        out: list[str] = []
        failed = bytearray(size + 1)
        at, piece, told = 0, longest[0], None  # told: what is known of the pieces after the last one
        while True:
            end = at + len(piece)
            if not failed[end]:
                fits = True if told is None else told.get(piece)
                if fits is None:
                    fits = told[piece] = self._suits(out[-1], piece)
                    self.answers += 1
                if fits:
                    out.append(piece)
                    if end == size:
                        break
                    told = suits.get(piece)
                    if told is None:
                        told = suits[piece] = {}
                    at, piece = end, longest[end]
                    continue
            piece = shorter.get(piece)
            while piece is None:
                # nothing starts here: take back the piece before and shorten it
                failed[at] = 1
                before = out.pop()
                at -= len(before)
                piece = shorter.get(before)
                told = suits[out[-1]] if out else None
        if self.answers > KEPT_PAIRS:
            suits.clear()
            self.answers = 0
        return out

    def _part(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pieces(part):
            known = self.ids.get(piece)
            if known is None:
                out.extend(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(known)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without an end; null counts as empty."""
        if not text:
            return []
        parts = self.parts_of(SPACE + text.replace(" ", SPACE))
        return list(chain.from_iterable(map(self.known.__getitem__, parts)))


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """One per worker and file; decoding needs nothing else."""
    if path not in _libraries:
        _libraries[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _libraries[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _ids(own: Encoder, texts: list[str | None], end: bool) -> list[list[int]]:
    last = [own.end] if end else []
    return [own.encode(t) + last for t in texts]


def _listed(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def ids_of(text: Column, path: str, end: bool = True) -> Column:
    """The ids of a text as array<int>, with the end id if wanted. A null text counts as empty."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for batch in batches:
            yield _listed(_ids(own, batch.to_pylist(), end))

    return encode(text.cast("string"))


def text_of(ids: Column, path: str) -> Column:
    """The text the ids stand for; null ids count as none."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = library(path)
        for batch in batches:
            yield pa.array(own.decode([x or [] for x in batch.to_pylist()], num_threads=1), pa.string())

    return decode(ids)


def ids_and_text_of(text: Column, path: str, end: bool = True) -> Column:
    """(ids, decoded) of a text in one pass over it."""

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for batch in batches:
            ids = _ids(own, batch.to_pylist(), end)
            decoded = pa.array(own.library.decode(ids, num_threads=1), pa.string())
            yield pa.StructArray.from_arrays([_listed(ids), decoded], ["ids", "decoded"])

    return both(text.cast("string"))


def encoded(docs: DataFrame, path: str, text: str = "text", end: bool = True) -> DataFrame:
    """Add ids (array<int>) and n_tokens, the end id counted where it is asked for.

    A null or empty text has the end id alone. Every row is encoded by itself, a whole text
    at a time, however long; repeated rows get equal ids, ties of equally good merges go to
    the left as in the library, no rows give no rows. Columns of ``docs`` named like a
    result give way to it.
    """
    common.prepare(docs.sparkSession)
    out = common.replaced(docs, {"ids": ids_of(F.col(f"`{text}`"), path, end)})
    return common.replaced(out, {"n_tokens": F.size("ids").cast("long")})


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add decoded, the text of the ids; control ids stand for nothing, null ids for an empty text."""
    common.prepare(docs.sparkSession)
    return common.replaced(docs, {"decoded": text_of(F.col(f"`{ids}`"), path)})


def round_trip(docs: DataFrame, path: str, text: str = "text", end: bool = True) -> DataFrame:
    """Add ids, n_tokens and decoded: ``encoded`` and ``decoded`` at once."""
    common.prepare(docs.sparkSession)
    name = common.tmp(docs, "_coded")
    rows = docs.withColumn(name, ids_and_text_of(F.col(f"`{text}`"), path, end))
    return common.replaced(rows, {
        "ids": F.col(f"{name}.ids"), "n_tokens": F.size(f"{name}.ids").cast("long"), "decoded": F.col(f"{name}.decoded"),
    }).drop(name)


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, path).select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
