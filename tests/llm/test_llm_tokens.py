"""Whitening, phrase mining and byte-level BPE against brute force, numpy's solver and the tokenizers library."""
import collections
import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clustrum.llm import bpe, phrases, whitening

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [
    None, "", " ", "\n\n  x ", "Don't we'll they're I'VE 'S 's", "a" * 3000, "ab" * 2000 + "<|endoftext|>c<|endoftext|><|endof", "<|endoftext|>",
    "é ü ß 日本語 ½ ² ①Ⅷ 🙂🙂 ​﻿\x00\x1c\x85\xa0 ", "x" * 70_000 + " " + "y z " * 40_000, "12 345,678.9 -- ... !!!", "tab\there  two   three \r\n",
    "a b c", "a b c",
]


def test_bpe_gives_the_tokens_and_texts_of_the_library(spark, vocabulary, library):
    rows = [(i % 5 if i else None, t, 7, "ids") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    encoded = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = collections.Counter(
        (row[0], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))) for row, ids in zip(rows, encoded))
    assert collections.Counter(map(tuple, bpe.round_trip(docs, vocabulary).collect())) == expected
    assert all(library.decode(ids, skip_special_tokens=False) == (t or "") for ids, t in zip(encoded, TEXTS))
    assert bpe.round_trip(docs.limit(0), vocabulary).count() == 0
    tokens = bpe.encode(docs, vocabulary)
    assert sorted(r.text for r in bpe.decode(tokens, vocabulary).collect()) == sorted(t or "" for t in TEXTS)


def test_bpe_takes_every_character_as_the_library_does(vocabulary, library):
    encoder = bpe.Encoder(vocabulary)
    for start in range(0, 0x110000, 0x4000):
        text = "".join(f"a{chr(c)}1 {chr(c)}  {chr(c)}.{chr(c)}'" for c in range(start, start + 0x4000, 1 if start < 0x20000 else 61) if not 0xD800 <= c < 0xE000)
        assert next(encoder.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids
    ids = [0, 255, 200, 60_000, 50256, 128, 129, 300]
    assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def word_by_word(pairs, symbols):
    """Plain merging: always the pair of least rank, leftmost first."""
    rank = {(a, b): (r, new) for r, (a, b, new) in enumerate(pairs)}
    while found := [(rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]:
        _, i = min(found)
        symbols = [*symbols[:i], rank[symbols[i], symbols[i + 1]][1], *symbols[i + 2:]]
    return symbols


@pytest.mark.parametrize("few", [0, 16, 10 ** 9])
def test_the_pair_index_equals_merging_word_by_word(monkeypatch, vocabulary, few):
    monkeypatch.setattr(bpe, "FEW", few)
    rng = random.Random(3)
    encoder = bpe.Encoder(vocabulary)
    words = ["".join(rng.choice("aabhetn oé") for _ in range(rng.randrange(1, 40))) for _ in range(300)] + ["a" * k for k in range(1, 20)]
    assert [t.tolist() for t in encoder.merged(words)] == [word_by_word(vocabulary["pairs"], [vocabulary["singles"][b] for b in w.encode()]) for w in words]
    assert encoder.merged([]) == []


def test_small_blocks_and_a_forgetful_memory_change_nothing(monkeypatch, vocabulary):
    texts = [t or "" for t in TEXTS] * 2
    whole = [t.tolist() for t in bpe.Encoder(vocabulary).encode(texts)]
    for name, value in (("KEPT_WORDS", 5), ("KEPT_CHARS", 3), ("BLOCK_WORDS", 100), ("BLOCK_CHARS", 50)):
        monkeypatch.setattr(bpe, name, value)
    assert [t.tolist() for t in bpe.Encoder(vocabulary).encode(texts)] == whole


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# Phrases

def brute_phrases(rows, min_count=30, first=2000):
    words, grams = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    grams[lang][tuple(w[i:i + n])] += 1
    out = set()
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in candidates.items():
            longer = (b for q, b in candidates.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))))
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return out


def phrase_rows():
    rng = random.Random(11)
    rows = []
    for i in range(260):
        lang = ("en", "en", "fr", None)[i % 4]
        text = " ".join(rng.choice(["New  York", "of the", "à la carte", "ab", "x\ty", "é", "z", "the end.", "a,b", "Rio de la Plata"]) for _ in range(rng.randrange(0, 60)))
        rows.append((lang, text))
    return rows + [("en", None), ("de", ""), ("fr", "w " * 3000), ("es", "un dos " * 40), *[("en", "one copy of many, here")] * 90]


@pytest.mark.parametrize("shards,min_count", [(6, 30), (1, 30), (40, 12)])
def test_phrases_equal_brute_force(spark, shards, min_count):
    rows = phrase_rows()
    docs = spark.createDataFrame([(l, t, 1, "p") for l, t in rows], "lang string, text string, shard int, phrase string").repartition(5)
    found = {tuple(r) for r in phrases.collocations(docs, min_count=min_count, shards=shards).collect()}
    assert found == brute_phrases(rows, min_count) and len(found) > 20
    few = {tuple(r) for r in phrases.collocations(docs, min_count=min_count, first=3).collect()}
    assert few == brute_phrases(rows, min_count, 3)


def test_phrases_in_small_blocks_and_many_ranges(spark, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    for name, value in (("BLOCK_BYTES", 200), ("HELD_HASHES", 100), ("RANGE_OCCURRENCES", 1 << 9), ("MAX_BITS", 10)):
        monkeypatch.setattr(phrases, name, value)
    assert {tuple(r) for r in phrases.collocations(docs).collect()} == brute_phrases(rows)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_counts_beyond_64_bits_stay_exact(spark):
    a = 2 ** 61
    found = phrases.score_phrases(
        spark.createDataFrame([("en", 2, "a b", a)], "lang string, words int, phrase string, a long"),
        spark.createDataFrame([("en", "a", a + 1), ("en", "b", a + 5)], "lang string, word string, f long")).collect()
    assert [(r.l, r.r, r.score) for r in found] == [(a + 1, a + 5, 2_000_000 * a // (2 * a + 6))]


# Whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def brute_whitening(vectors, k=8):
    """Exact deviations, and eigenpairs of numpy's solver on a covariance from fractions."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    rows = [[n * a - s for a, s in zip(r, sums)] for r in x]
    d = np.array([[float(Fraction(a, n)) for a in r] for r in rows])
    covariance = np.array([[float(sum(Fraction(r[i] * r[j], n ** 3) for r in rows)) for j in range(len(sums))] for i in range(len(sums))])
    values, components = np.linalg.eigh(covariance)
    return n, [sum(a * a for a in r) for r in rows], d, values[::-1][:k], components.T[::-1][:k], np.trace(covariance)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) @ np.diag(np.linspace(0.1, 2, 12))).astype(np.float32).tolist()
    odd = [None, [], [1.0] * 5, [1.0] * 11 + [None], [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11]
    rows = [(i // 2 if i else None, v, 1, "c") for i, v in enumerate(vectors)] + [(900, v, 1, "c") for v in odd]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    n, deviations, d, values, components, trace = brute_whitening(vectors)
    assert len(found) == 300 * 8 and {r.n for r in found} == {300}
    assert collections.Counter(r.deviation for r in found) == {v: 8 * c for v, c in collections.Counter(deviations).items()}
    by = collections.defaultdict(dict)
    for r in found:
        by[r.deviation][r.component] = r
    plain = d @ components.T / np.sqrt(values)
    signs = np.sign([by[deviations[0]][k + 1].whitened * plain[0, k] for k in range(8)])
    for i, v in enumerate(deviations):
        for k in range(8):
            assert math.isclose(by[v][k + 1].whitened, signs[k] * plain[i, k], abs_tol=1e-9)
            assert math.isclose(by[v][k + 1].explained, values[k] / trace, rel_tol=1e-11)
    assert max(r.identity_error for r in found) < 1e-9


@pytest.mark.parametrize("vectors,real", [
    ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[float(i), 2.0 * i, 0.5] for i in range(9)], 1), ([[float(i)] for i in range(4)], 1),
    ([[float(i == j) for j in range(10)] for i in range(10)], 8),
])
def test_whitening_without_enough_variance(spark, vectors, real):
    found = whitening.whiten(spark.createDataFrame([(i, v, 1, "c") for i, v in enumerate(vectors)], SCHEMA)).collect()
    n_components = min(8, len(vectors[0]))
    assert len(found) == len(vectors) * n_components
    assert all((r.whitened is not None) == (r.component <= real) for r in found)
    assert all((r.identity_error is None) == (real == 0) and (r.identity_error or 0) < 1e-9 for r in found)
    assert [r.deviation for r in sorted(found, key=lambda r: (r.vec_id, r.component))][::n_components] == brute_whitening(vectors)[1]


def test_whitening_of_nothing_and_of_huge_entries(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "c"), (2, [], 1, "c")], SCHEMA)).count() == 0
    huge = [[1e30, 1.0], [-1e30, 2.0], [5.0, 1e9]]
    frame = spark.createDataFrame([(i, v, 1, "c") for i, v in enumerate(huge)], SCHEMA)
    fitted = whitening.fit(frame)
    x = [[max(-2 ** 52, min(2 ** 52, math.floor(1024 * float(np.float32(c))))) + 100_000 for c in v] for v in huge]
    sums = [sum(c) for c in zip(*x)]
    assert fitted.sums == sums
    got = {r.vec_id: int(r.deviation) for r in whitening.transform(frame, fitted).collect()}
    assert got == {i: sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}
    assert all(r.deviation is None for r in whitening.whiten(frame).collect())


@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
def test_the_eigensolver_on_close_equal_and_zero_values(d):
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    spectra = [np.linspace(1, 2, d), np.ones(d), np.zeros(d), np.where(np.arange(d) < 3, 1 + 1e-9 * np.arange(d), 0.1), 10.0 ** -np.arange(d)]
    for spectrum in spectra:
        matrix = basis * spectrum @ basis.T
        matrix = (matrix + matrix.T) / 2
        count = min(8, d)
        values, vectors = whitening.leading_components(matrix, count)
        scale = max(spectrum.max(), 1e-300)
        assert np.allclose(values, np.sort(spectrum)[::-1][:count], rtol=0, atol=1e-13 * scale)
        assert np.abs(vectors @ vectors.T - np.eye(count)).max() < 1e-12
        assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-13 * scale


def test_sturm_counts_are_numbers_of_smaller_eigenvalues():
    rng = np.random.default_rng(0)
    diagonal, beside = rng.normal(size=30), rng.normal(size=29)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    points = np.linspace(-4, 4, 41)
    assert whitening.sturm_count(diagonal, beside ** 2, points, 1e-30).tolist() == [(values < p).sum() for p in points]
