"""Encoding, alignment and collocations against the libraries and brute force."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from scenespark.llm import collocations as CO, common, packing, piece_encoding as PE, token_alignment as TA

ODD = ["", " ", "  a", "a  ", "a\n\nb\tc", "▁", "x ▁y", "🥊é的", "<s></s><unk>", "<0x41>", "\x00", "aaaa" * 50, "a" + " " * 40 + "b", "ﬁ İ ǅ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PE.vocabulary())


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(os.path.join(sf, "documents.parquet")).collect()}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# 11 pieces

def test_encoder_is_the_library(library):
    own, rng = PE.Encoder(PE.vocabulary()), random.Random(1)
    pieces = list(own.order)
    made = ["".join(rng.choice("aeiou tnsr\n▁ 的é<s>  ") for _ in range(n)) for n in range(1, 400)]
    made += ["".join(rng.choice(pieces) for _ in range(n)).replace("▁", rng.choice(["", "▁", " "])) for n in range(1, 300)]
    for t in [*ODD, *made]:
        assert own.encode(t) == library.encode(t), t
    assert own.encode(None) == []


def test_full_stores_are_emptied(library, monkeypatch):
    monkeypatch.setattr(PE, "KEPT_PARTS", 3)
    monkeypatch.setattr(PE, "KEPT_PAIRS", 5)
    own = PE.Encoder(PE.vocabulary())
    for t in ["some words that are said again and again", "words said, again: some that are"] * 3:
        assert own.encode(t) == library.encode(t)
    assert len(own.known) <= 3 and len(own.known.earlier) <= 3 and own.answers <= 5 + 20


def test_history_says_what_merging_says():
    own, rng = PE.Encoder(PE.vocabulary()), random.Random(2)
    pieces = list(own.ids)
    for a, b in ((rng.choice(pieces), rng.choice(pieces)) for _ in range(3000)):
        assert own._suits(a, b) == (own.merged(a + b) == [a, b]), (a, b)


def test_pieces_of_all_documents(spark, sf, texts, library):
    got = {r.doc_id: r for r in PE.op11_piece_encoding(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t or "", add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(" ".join(map(str, ids))) and got[i].decoded_sha256 == sha(library.decode(ids))


def test_pieces_of_odd_rows(spark, odd_documents, no_documents, library):
    path = PE.vocabulary()
    out = PE.decoded(PE.encoded(odd_documents, path), path)
    assert set(odd_documents.columns) <= set(out.columns)
    for r in out.collect():
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "") and r.n_tokens == len(r.ids)
    assert PE.decoded(PE.encoded(no_documents, path), path).count() == 0
    assert PE.round_trip(odd_documents, path).exceptAll(out.select(PE.round_trip(odd_documents, path).columns)).count() == 0
    assert PE.round_trip(no_documents, path).count() == 0
    none = spark.createDataFrame([(1, None)], "a int, ids array<int>")
    assert PE.decoded(none, path).head().decoded == ""


# 12 alignment

def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def plain_alignment(texts, library):
    """One row per text, by walking over both token lists."""
    first = Tokenizer.from_file(packing.vocabulary())
    first.encode_special_tokens = True
    raw = byte_table()
    told, counts = [], collections.Counter()
    for t in texts:
        links, groups = [], []
        a = b = []
        if t:
            a = [(i, bytes(raw[c] for c in first.id_to_token(i))) for i in first.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i)
                  else library.id_to_piece(i).replace("▁", " ").encode()) for i in library.encode(t)]
            whole = (" " + t).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a = b = []
        spans = [[], []]
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, x in tokens:
                spans[side].append((at, at + len(x), i))
                at += len(x)
        for s, e, i in spans[0]:
            for s2, e2, j in spans[1]:
                if s < e2 and s2 < e:
                    links.append((i, j))
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        before = 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if before < e <= c) for side in spans))
            before = c
        counts.update(links)
        told.append((len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(na, nb, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), ";".join(g))
            for na, nb, g, x in told]


@pytest.mark.parametrize("chars", [1 << 20, 300])
def test_alignment_is_the_walk(spark, texts, library, monkeypatch, chars):
    monkeypatch.setattr(TA, "BATCH_CHARS", chars)
    some = [*ODD, None, *[(t or "")[:700] for t in list(texts.values())[:60]], "the same", "the same"]
    rows = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r for r in TA.aligned(rows, packing.vocabulary(), PE.vocabulary(), groups=True).collect()}
    for i, (na, nb, ng, nl, best, total, groups) in enumerate(plain_alignment(some, library)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == (na, nb, ng, nl, best, total, groups), some[i]
        assert r.groups_sha256 == (sha(groups) if na else "")


def test_wide_pair_lists(library, monkeypatch):
    """More pairs in a batch than two bytes tell apart."""
    rng, both = random.Random(3), TA.sides(packing.vocabulary(), PE.vocabulary())
    text = "".join(rng.choice(both.a).decode("utf-8", "ignore") for _ in range(100_000))
    rows, pairs, held, links = TA.align([text, None], both)
    assert len(pairs) > 1 << 16 and held.sum() == len(links) == rows.n_links[0] and rows.n_a[1] == 0
    assert (np.bincount(links, minlength=len(pairs)) == held).all()


def test_alignment_of_odd_rows(spark, odd_documents, no_documents):
    out = TA.aligned(odd_documents, packing.vocabulary(), PE.vocabulary())
    assert out.count() == odd_documents.count()
    for r in out.filter("n_a = 0").collect():
        assert (r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, "")
    assert out.filter("n_a = 0").count() == 3  # two null texts and the empty one
    assert TA.aligned(no_documents, packing.vocabulary(), PE.vocabulary()).count() == 0


# 13 collocations

def plain_collocations(rows, least, inside, top):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, words[i:i + k]) for i in range(len(words) - k + 1))
    out = collections.defaultdict(list)
    long = [(lang, p, a) for (lang, p), a in f.items() if len(p) == 3 and a >= least]
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(x == lang and p in (q[:2], q[1:]) and 100 * b >= inside * a for x, q, b in long):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                             for k in range(1, len(p)))
        out[lang].append((score, a, " ".join(p), l, r))
    told = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        told += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(told)


def listed(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(7)
    words = ["The", "the", "cat", "sat", "on", "a", "mat", "Ünder", "x\x01y", "-", "zürich", "b"]
    ends = [" ", "  ", "\t", ", ", ". ", "!\n", "\x0b", " ? ", " "]
    rows = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]))
            for _ in range(300)] + [(None, "en"), ("", "en"), ("...", None), ("the the the the " * 2000, "xx")]
    return rows, spark.createDataFrame(rows, "text string, lang string").repartition(5).cache()


def test_collocations_are_brute_force(talk):
    rows, df = talk
    assert listed(CO.collocations(df)) == plain_collocations(rows, 10, 50, 2000)
    assert listed(CO.collocations(df, least=3, inside=80, top=7)) == plain_collocations(rows, 3, 80, 7)


def test_bursts_spills_and_parts_change_nothing(talk, monkeypatch):
    rows, df = talk
    monkeypatch.setattr(CO, "RANKED", 50)
    monkeypatch.setattr(CO, "DIVIDED", 1 / 50)
    assert listed(CO.collocations(df, least=2)) == plain_collocations(rows, 2, 50, 2000)
    raw = [(t or "").encode() for t, lang in rows if lang == "en"]
    for size in (1, 2, 3):
        every = np.full(1 << CO.FILTER_BITS - 3, 255, np.uint8)
        none = np.zeros_like(every)
        whole, small = (CO.Counter(size, every, *kw) for kw in ([none], [every, 40, 8, 4]))
        sums = []
        for counter in (whole, small):
            told, parts = collections.Counter(), 0
            for k in range(0, len(raw), 7):
                for b in counter.add("en", raw[k:k + 7]):
                    for p, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                        told[p] += n
                    parts += 1
            for b in counter.rest():
                for p, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    told[p] += n
            sums.append((told, parts))
        assert sums[0][0] == sums[1][0] and sums[1][1] > 5


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_019
    rows = [("x", [], big * 2), ("x", ["a"], big), ("x", ["b"], big + 7), ("x", ["a", "b"], big - 1)]
    r = CO.scored(spark.createDataFrame(rows, "lang string, words array<string>, f long")).head()
    assert (r.a, r.l, r.r, r.score) == (big - 1, big, big + 7, 1_000_000 * (big - 1) ** 2 // (big * (big + 7)))


def test_collocations_of_odd_rows(odd_documents, no_documents):
    rows = [(r.text, r.lang) for r in odd_documents.collect()]
    assert listed(CO.collocations(odd_documents)) == plain_collocations(rows, 10, 50, 2000)
    assert CO.collocations(no_documents).count() == 0


def test_filter_bits(spark):
    rng = random.Random(9)
    places = {rng.randrange(1 << 18) for _ in range(2000)} | {0, (1 << 18) - 1}
    packed = common.bit_filter(spark.createDataFrame([(p,) for p in places for _ in (0, 1)], "place long"), 18)
    every = np.arange(1 << 18)
    assert set(every[common.in_filter(packed, every)].tolist()) == places
    assert not common.bit_filter(spark.createDataFrame([], "place long"), 18).any()
