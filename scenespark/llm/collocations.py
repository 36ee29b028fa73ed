"""Phrase collocations per language, from counts in a burst trie.

Phrases are counted length by length. Each task counts those of what it reads in a HAT-trie:
hash containers under a shallow trie of word numbers. The words with many phrases burst out
of a full container and get one of their own; once all hold too much, whole subtrees go, the
largest first, as sorted runs. The runs are dealt out by prefix: the first word or, where
that is very frequent, also the next, and so on, so that no prefix is a hot group. In its
partition the sum of a phrase's rows is its count.

No phrase occurs more often than any part of it. So the next length counts only what
consists of phrases that reached the least count, as far as a bit filter of a fixed size can
tell: it lets through all of them, and a few others that their own count removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenespark.llm import common

LONGEST = 3
LEAST = 10
INSIDE = 50
TOP = 2000
# characters that end a piece, and those between words
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
# a container bursts beyond so many phrases; a task holds so many phrases and words at most
BURST, HELD, WORDS = 65_536, 1_000_000, 500_000
# bytes of text that are counted together
BATCH_BYTES = 1 << 21
_BITS = 21
_MASK = (1 << _BITS) - 1
# rows of one partial ranking
RANKED = 100_000
# places of the filter (8 MB), whatever the corpus
FILTER_BITS = 26
# a prefix with more than this share of all words is divided by its next word
DIVIDED = 1 / 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)

_PLAIN = bytes(range(256))
_TABLE = bytes(
    0x0A if b in ENDS else 0x20 if b in SPACES else b + 32 if 0x41 <= b <= 0x5A else b for b in _PLAIN)


class Numbers(dict):
    """Words to numbers from 1 on, given at first sight; the mark of an end is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Node:
    """Counts of the phrases that share a prefix, as word-number codes (first word in the highest bits, 0 after the last).

    A hash container holds the phrases of many next words together. Once it is full, the
    words with many phrases burst out of it and get a node of their own.
    """

    __slots__ = ("held", "own", "full")

    def __init__(self, full: int) -> None:
        self.held: dict[int, int] = {}
        self.own: dict[int, Node] = {}
        self.full = full

    def add(self, codes: np.ndarray, counts: np.ndarray, burst: int, depth: int = 0) -> None:
        """Add sorted, distinct codes."""
        if self.own:
            word = _word(codes, depth)
            out = np.isin(word, np.fromiter(self.own, np.int64, len(self.own)))
            edges = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if out[a]:
                    self.own[int(word[a])].add(codes[a:b], counts[a:b], burst, depth + 1)
            codes, counts = codes[~out], counts[~out]
        held, get = self.held, self.held.get
        for c, n in zip(codes.tolist(), counts.tolist()):
            held[c] = get(c, 0) + n
        if len(held) > self.full and depth < LONGEST - 1:
            self._burst(burst, depth)

    def _burst(self, burst: int, depth: int) -> None:
        codes, counts = _sorted(self.held)
        words, many = np.unique(_word(codes, depth), return_counts=True)
        out = np.isin(_word(codes, depth), words[many >= burst // 32])
        for c in codes[out].tolist():
            del self.held[c]
        for w in words[many >= burst // 32].tolist():
            self.own[w] = Node(burst)
        # what stays has few phrases per word; look again once there are twice as many
        self.full = max(self.full, 2 * len(self.held))
        if out.any():
            self.add(codes[out], counts[out], burst, depth)

    def size(self) -> int:
        return len(self.held) + sum(n.size() for n in self.own.values())

    def containers(self) -> Iterator[dict[int, int]]:
        yield self.held
        for n in self.own.values():
            yield from n.containers()


class Trie:
    """A root node, its size, and the subtrees that go when there is too much."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.root, self.held = burst, Node(burst), 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.root.add(codes, counts, self.burst)
        self.held = self.root.size()

    def spill(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out whole subtrees, the largest first, until ``most`` phrases stay; the shared container last."""
        sizes = {w: n.size() for w, n in self.root.own.items()}
        out: list[dict[int, int]] = []
        for w in sorted(sizes, key=lambda w: (-sizes[w], w)):
            if self.held <= most:
                break
            self.held -= sizes[w]
            out.extend(self.root.own.pop(w).containers())
        if self.held > most:
            out.append(self.root.held)
            self.held -= len(self.root.held)
            self.root.held, self.root.full = {}, self.burst
        if any(out):
            yield tuple(
                np.concatenate([np.fromiter(x(d), np.int64, len(d)) for d in out]) for x in (dict.keys, dict.values))


def _word(codes: np.ndarray, depth: int) -> np.ndarray:
    return codes >> (_BITS * (LONGEST - 1 - depth)) & _MASK


def _sorted(held: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.fromiter(held.keys(), np.int64, len(held))
    counts = np.fromiter(held.values(), np.int64, len(held))
    order = np.argsort(codes)
    return codes[order], counts[order]


def places_of(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Places in the filter of phrases, from the hashes of their first, second, ... words."""
    h = np.full(len(words[0]), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for w in words:
        h = (h ^ w) * _ODD
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


RUN = pa.schema([("prefix", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
RUNS = "prefix long, lang string, phrase string, n long"


class Counter:
    """The tries of a task, one per language, for phrases of ``size`` words whose parts pass the filter."""

    def __init__(
        self, size: int, passes: np.ndarray | None = None, divided: np.ndarray | None = None,
        held: int = HELD, words: int = WORDS, burst: int = BURST,
    ) -> None:
        self.size, self.passes, self.divided = size, passes, divided
        self.most, self.most_words, self.burst = held, words, burst
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.hashes = np.zeros(1, np.uint64)
        self.tries: dict[str, Trie] = {}
        self.total: dict[str, int] = {}

    def phrases(self, lang: str, words: np.ndarray) -> np.ndarray:
        """Codes of the phrases; 0 among the word numbers ends a piece, so does the end of ``words``."""
        n = max(0, len(words) - self.size + 1)
        parts = [words[k:k + n] for k in range(self.size)]
        whole = np.ones(n, bool)
        for p in parts:
            whole &= p > 0
        if self.size > 1:
            self._hash()
            own = [self.hashes[words[k:k + n + 1]] for k in range(self.size - 1)]
            passed = common.in_filter(self.passes, places_of(lang, own)) if n else whole
            whole &= passed[:n] & passed[1:n + 1]
        code = np.zeros(n, np.int64)
        for k, p in enumerate(parts):
            code |= p << (_BITS * (LONGEST - 1 - k))
        return code[whole]

    def _hash(self) -> None:
        """Hashes of the words seen since the last time."""
        if len(self.hashes) < len(self.numbers):
            self.hashes = np.concatenate((self.hashes, _hashes(list(self.numbers)[len(self.hashes):])))

    def prefixes(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Places of the phrases' prefixes, each as short as its frequency allows."""
        self._hash()
        words = [self.hashes[_word(codes, k)] for k in range(self.size)]
        out = places_of(lang, words[:1])
        for k in range(1, self.size):
            more = np.flatnonzero(common.in_filter(self.divided, places_of(lang, words[:k])))
            out[more] = places_of(lang, [w[more] for w in words[:k + 1]])
        return out

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Count texts (a piece never leaves its text); yields what has to go."""
        told = self.numbers
        words = b" . ".join(texts).translate(_TABLE).replace(b"\n", b" . ").split()
        numbers = np.fromiter(map(told.__getitem__, words), np.int64, len(words))
        self.total[lang] = self.total.get(lang, 0) + int((numbers > 0).sum())
        trie = self.tries.setdefault(lang, Trie(self.burst))
        trie.add(*np.unique(self.phrases(lang, numbers), return_counts=True))
        if len(told) > self.most_words:
            yield from self.rest()
        while sum(t.held for t in self.tries.values()) > self.most:
            full = max(self.tries, key=lambda x: self.tries[x].held)
            yield from self._runs(full, self.tries[full].spill(self.tries[full].held // 2))

    def rest(self) -> Iterator[pa.RecordBatch]:
        """All that is held and, with the single words, the number of words seen as a phrase of none."""
        for lang, trie in self.tries.items():
            yield from self._runs(lang, trie.spill(0))
        for lang, n in self.total.items() if self.size == 1 else ():
            yield pa.record_batch([[0], [lang], [""], [n]], schema=RUN)
        self._forget()

    def _runs(self, lang: str, spilled: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Runs sorted by their words' numbers, so that phrases with a common prefix lie together."""
        text = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        for codes, counts in spilled:
            at = np.argsort(codes)
            key, counts = codes[at], counts[at]
            for a in range(0, len(key), 65536):
                words = np.stack([_word(key[a:a + 65536], k) for k in range(LONGEST)], 1)
                there = words > 0
                offsets = np.concatenate(([0], np.cumsum(there.sum(1)))).astype(np.int32)
                phrases = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), text.take(pa.array(words[there]))), " ")
                prefix = pa.array(self.prefixes(lang, key[a:a + 65536]))
                yield pa.record_batch([prefix, pa.repeat(lang, len(words)), phrases, pa.array(counts[a:a + 65536])], schema=RUN)


def _count(
    batches: Iterator[pa.RecordBatch], size: int, passes: np.ndarray | None, divided: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    counter = Counter(size, passes, divided)
    for batch in batches:
        text = pc.fill_null(batch.column(1), "").cast(pa.binary())
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}
        for lang, raw in zip(batch.column(0).to_pylist(), text.to_pylist()):
            waiting.setdefault(lang, []).append(raw)
            held[lang] = held.get(lang, 0) + len(raw)
            if held[lang] >= BATCH_BYTES:
                yield from counter.add(lang, waiting.pop(lang))
                held[lang] = 0
        for lang, texts in waiting.items():
            yield from counter.add(lang, texts)
    yield from counter.rest()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of (lang, phrase) rows."""
    for batch in batches:
        alike: dict[tuple[str, int], list[list[bytes]]] = {}
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = phrase.encode().split(b" ")
            alike.setdefault((lang, len(words)), []).append(words)
        for (lang, _), phrases in alike.items():
            columns = [_hashes(list(c)) for c in zip(*phrases)]
            yield pa.record_batch([pa.array(places_of(lang, columns))], names=["place"])


def counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", longest: int = LONGEST) -> DataFrame:
    """(lang, words, f): phrases of at most ``longest`` words that occur ``least`` times or more.

    The row without words holds the number of all words of the language. Words hold no space.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    told, frequent, passes, divided = [], None, None, None
    for size in range(1, longest + 1):
        def count(batches, size=size, filters=(passes, divided)):
            return _count(batches, size, *[None if f is None else f.value for f in filters])

        runs = rows.mapInArrow(count, RUNS).repartition("prefix")
        often = runs.groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("f")).drop("prefix")
        told.append(common.staged(often.where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases"))
        if size < longest:
            passed = told[-1].where("phrase <> ''")
            total = told[0].where("phrase = ''").agg(F.sum("f")).head()[0] or 0
            hot = passed.where(F.col("f") > total * DIVIDED)
            frequent = hot if frequent is None else frequent.unionAll(hot)

            def bits(phrases):
                places = phrases.select("lang", "phrase").mapInArrow(_places, "place long")
                return spark.sparkContext.broadcast(common.bit_filter(places, FILTER_BITS))

            passes, divided = bits(passed), bits(frequent)
    out = told[0]
    for t in told[1:]:
        out = out.unionAll(t)
    return out.select("lang", F.filter(F.split("phrase", " "), lambda w: w != "").alias("words"), "f")


def _part(words: Column, begin: Column | int, size: Column | int) -> Column:
    return F.slice(words, F.lit(begin) if isinstance(begin, int) else begin, F.lit(size) if isinstance(size, int) else size)


def scored(counted: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, score): phrases of two words or more at their lowest-scoring cut.

    ``counted`` holds every part of its phrases. Of equal scores the shortest first part counts.
    """
    number = counted.select("lang", "words", "f")
    cuts = number.where(F.size("words") > 1).select(
        "lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({
        "left": _part(F.col("words"), 1, F.col("k")),
        "right": _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")),
    })
    both = cuts.join(number.select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        number.select("lang", F.col("words").alias("right"), F.col("f").alias("r")), ["lang", "right"])

    def exact(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    above = (exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).alias("above")
    told = both.select("lang", "words", "a", "k", "l", "r", above, (exact("l") * exact("r")).alias("below")).withColumn(
        "score", F.expr("above div below"))
    least = told.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Phrases have 2 to ``LONGEST`` words and ``least`` occurrences or more. One that lies in a
    longer such phrase with at least ``inside`` hundredths of its occurrences is left out.
    Ranks go by score, then occurrences, then the phrase's bytes, so ties have one order. A
    null language counts as ``und``, a null text as empty; repeated rows count each time;
    texts are counted whole, however long; tables without a word give no rows.
    """
    counted = counts(docs, least, text, lang)
    phrases = counted.where(F.size("words") > 1)
    longer = phrases.where(F.size("words") > 2).select(
        "lang", F.col("f").alias("longer"), F.explode(F.expr(
            "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))"
        )).alias("words"))
    within = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = common.staged(
        scored(counted).join(within, ["lang", "words"], "left")
        .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
        .select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score"), "kept")
    # first within parts of a language, then among what these leave
    parts = kept.count() // RANKED + 1
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top) if parts > 1 else kept
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    total = counted.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents").select("text", "lang"))


def _grams(k: int) -> str:
    return (f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) "
            f"AS phrase FROM pieces WHERE len(w) >= {k}")


SQL = rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM texts),
grams AS ({" UNION ALL ".join(_grams(k) for k in range(1, LONGEST + 1))}),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM f WHERE f >= {LEAST}),
candidates AS MATERIALIZED (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM often WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, size, a, c.w, cut, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
        FROM (SELECT *, unnest(range(1, size)) AS cut FROM candidates)) c
  JOIN often x ON x.lang = c.lang AND x.phrase = c.head
  JOIN often y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE size = 3) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN longer USING (lang, phrase) JOIN total USING (lang)
WHERE most IS NULL OR 100 * most < {INSIDE} * a
QUALIFY rank <= {TOP}
"""
