"""Secrets in text, in column expressions only: fixed patterns, and tokens that pass a battery of randomness tests.

Patterns are found by putting marks around all matches and splitting at the marks; running lengths give the places. Long
tokens outside these spans are tested: an encoding is inferred from the characters in use, and chi-squared uniformity of
its alphabet, a runs test around the middle of the alphabet and lag-one serial correlation have to let the token pass
as random. The statistics of the same three tests are then compared with their distribution over ordinary tokens of the
same encoding and length, which are put together from words like those of the whole table; combined, they give the chance of an ordinary token
to look as random. The false-discovery rate of these p-values is controlled (Benjamini and Hochberg) inside each length
class, over the tokens of the whole table.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.session import materialize

# Fixed values of the contract: the three base patterns with the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
# Runs are tried from their first character on only.
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Rate of false discoveries among the added spans of a length class, and the level at which a token counts as not random.
DISCOVERY_RATE = 0.01
NOT_RANDOM = 0.001
#: Words drawn for the ordinary tokens, by the letters of all words of the table.
DRAWN_WORDS = 100_000
#: Ordinary tokens drawn for each encoding and length. A length counts as the largest of these that it reaches.
REFERENCE_TOKENS = 1500
REFERENCE_LENGTHS = [8, 14, 20, 24, 28, 32, 40, 48, 64, 96, 128]
#: For tables with few words.
COMMON_WORDS = (
    "the and that have with this from they would there their what about which when make time people into year your good some could them other "
    "than then look only come over think also back after work first well even want because these give most file value number name index table "
    "system service request message default config version data user list der die und nicht mit sich auch werden haben eine wurde nach durch "
    "zwischen les des une dans pour que qui sur avec tout plus faire comme mais los las por para como pero sus entre cuando todo").split()
#: p-values are counted in steps of a tenth of a power of ten, down to 10^-60, and rounded up to the step.
STEPS, LAST_STEP = 10, 600

DIGITS, SMALL, CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the characters they use, the narrowest first.
ENCODINGS = [
    ("^[0-9]+$", DIGITS), ("^[0-9a-f]+$", DIGITS + SMALL[:6]), ("^[0-9A-F]+$", DIGITS + CAPITALS[:6]),
    ("^[a-z]+$", SMALL), ("^[A-Z2-7]+$", CAPITALS + DIGITS[2:8]), ("^[0-9a-z]+$", DIGITS + SMALL), ("^[0-9A-Z]+$", DIGITS + CAPITALS),
    ("^[A-Za-z]+$", CAPITALS + SMALL), ("^[A-Za-z0-9]+$", CAPITALS + SMALL + DIGITS), ("^[A-Za-z0-9+/]+$", CAPITALS + SMALL + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", CAPITALS + SMALL + DIGITS + "-_"), ("", CAPITALS + SMALL + DIGITS + "+/-_="),
]
_MARKS = "\u0001\u0002"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, replacement: str, inner: int = 0) -> Column:
    """Array of (start, end, piece) of all matches; `replacement` sets mark 1 around a match and `inner` marks 2 inside it."""
    # Blocks of pieces are walked first and then joined, so that no long array is copied match by match.
    start = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("match"),
        F.array().cast("array<struct<start:int,end:int,piece:string>>").alias("spans"))

    def walk(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece) - F.when(state["match"], inner).otherwise(0)
        span = F.struct(state["at"].alias("start"), end.alias("end"), piece.alias("piece"))
        return F.struct(
            end.alias("at"), (~state["match"]).alias("match"),
            F.when(state["match"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    # A block has an even number of pieces (but the last), so each begins outside a match.
    def join(state: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda s: F.struct(
            (s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["piece"].alias("piece")))
        return F.struct((state["at"] + block["at"]).alias("at"), state["match"].alias("match"), F.concat(state["spans"], moved).alias("spans"))

    def walk_all(pieces: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(1), F.size(pieces), F.lit(512)), lambda at: F.aggregate(F.slice(pieces, at, 512), start, walk))
        return F.aggregate(blocks, start, join)["spans"]

    return _let(F.split(F.regexp_replace(text, F.lit(pattern), F.lit(replacement)), "\u0001", -1), walk_all)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, end, piece) in code points of the fixed patterns, leftmost and not overlapping inside a kind."""
    # The marks are in no pattern: other control characters in their place leave matches and lengths as they are.
    safe = F.coalesce(text, F.lit(""))
    safe = F.when(F.contains(safe, F.lit("\u0001")) | F.contains(safe, F.lit("\u0002")), F.translate(safe, _MARKS, "\u0004\u0004")).otherwise(safe)
    value = lambda s: F.length(F.substring_index(s["piece"], "\u0002", -1))
    return {
        "assign": F.filter(_spans(safe, ASSIGN, "\u0001$1\u0002$2\u0001", 1), lambda s: value(s) >= ASSIGN_VALUE),
        "access": _spans(safe, ACCESS, "\u0001$0\u0001"),
        "hex": _spans(safe, HEX, "\u0001$0\u0001"),
        "token": _spans(safe, TOKEN, "\u0001$0\u0001"),
    }


def normal_tail(z: Column) -> Column:
    """P(Z >= z) of the normal distribution (polynomial of Abramowitz and Stegun, 26.2.17)."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.2316419)
    series = ((((t * 1.330274429 - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def character_class(c: Column) -> Column:
    return F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)


def _class_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _ordinary_text(words: list[str], alphabet: str, rng: np.random.Generator) -> np.ndarray:
    """Codes of the words joined as people join them in names, with a number after each third word if there are digits."""
    letters, digits = set(alphabet), "0" in alphabet or "2" in alphabet
    mixed = {"a", "A"} <= letters
    joint = next((c for c in "-/_" if c in letters), "")
    numbers = [str(x % 10 ** y) for x, y in zip(rng.integers(0, 10_000, len(words)), rng.integers(1, 5, len(words)))]
    shape = str.lower if "a" in letters else str.upper
    if mixed:
        shape = (lambda w: w) if joint else str.capitalize
    # Letters that the encoding lacks are left out, words keep their lengths: numbers are as far apart as in other encodings.
    kept = "".join(c for w in words for c in w if shape(c) in letters)
    ends = np.minimum(np.cumsum([len(w) for w in words]), len(kept)).tolist()
    words = [kept[a:b] for a, b in zip([0, *ends], ends) if a < b]
    parts = (shape(w) + (n if digits and at % 3 == 2 else "") + joint for at, (w, n) in enumerate(zip(words, numbers)))
    codes = {c: i for i, c in enumerate(alphabet)}
    return np.array([codes[c] for c in "".join(parts) if c in codes])


def _statistics(codes: np.ndarray, alphabet: str) -> np.ndarray:
    """Statistics of the three tests, one row per token: as `battery` has them."""
    n, k = codes.shape[1], len(alphabet)
    squares = sum((codes == c).sum(1).astype(float) ** 2 for c in range(k))
    classes = np.array([_class_of(c) for c in alphabet])
    kinds = classes[codes] if len(set(classes)) > 1 else codes * 2 >= k
    centred = codes - codes.mean(1, keepdims=True)
    spread, together = (centred ** 2).sum(1), (centred[:, 1:] * centred[:, :-1]).sum(1)
    serial = np.where(spread > 0, together / np.maximum(spread, 1e-9), 1.0) + 1 / n
    return np.stack([np.arcsin(np.sqrt((squares - n) / (n * (n - 1)))), np.arcsin(np.sqrt((kinds[:, 1:] != kinds[:, :-1]).mean(1))), serial], 1)


def fit_ordinary(words: list[str]) -> list[list[list[float]]]:
    """Per encoding and length: weights of the three statistics, and what to take off, for a score that is standard normal or
    narrower over ordinary tokens and high for random ones. None of digits only: numbers look random.

    Weights are those of Fisher's discriminant; the score is widened until its upper quantiles lie inside the normal ones.
    """
    rng = np.random.default_rng(17)
    words = words + [w for _ in range(40) for w in rng.permutation(COMMON_WORDS).tolist()] if len(words) < 20_000 else words
    model = []
    for _, alphabet in ENCODINGS:
        rows = []
        text = None if alphabet == DIGITS else _ordinary_text(words, alphabet, rng)
        for n in REFERENCE_LENGTHS:
            if text is None or len(text) < 2 * n:
                rows.append([0.0, 0.0, 0.0, 99.0])
                continue
            at = rng.integers(0, len(text) - n, REFERENCE_TOKENS)[:, None] + np.arange(n)
            ordinary = _statistics(text[at], alphabet)
            pure = _statistics(rng.integers(0, len(alphabet), (REFERENCE_TOKENS, n)), alphabet)
            cov = np.cov(ordinary.T) + 1e-6 * np.eye(3)
            weights = np.linalg.solve(cov + np.cov(pure.T), pure.mean(0) - ordinary.mean(0))
            weights /= np.sqrt(weights @ cov @ weights)
            scores = (ordinary - ordinary.mean(0)) @ weights
            weights /= max(1.0, np.quantile(scores, 0.99) / 2.326, np.quantile(scores, 0.998) / 2.878)
            rows.append([*weights.tolist(), float(ordinary.mean(0) @ weights)])
        model.append(rows)
    return model


def letter_triples(docs: DataFrame, text: str) -> dict[str, int]:
    """How often each letter follows two others in the words of ASCII letters of all rows, long tokens left out; a space stands
    for what is before and behind a word."""
    plain = F.regexp_replace(text, F.lit(TOKEN), F.lit(" "))
    words = docs.select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z]+"), F.lit(0))).alias("__word"))
    counted = words.groupBy("__word").agg(F.count(F.lit(1)).alias("__n"))
    padded = F.concat(F.lit("  "), "__word", F.lit(" "))
    triples = F.transform(F.sequence(F.lit(1), F.length("__word") + 1), lambda at: F.substring(padded, at, F.lit(3)))
    # At most 53^3 rows.
    found = counted.select(F.explode(triples).alias("__triple"), "__n").groupBy("__triple").agg(F.sum("__n").alias("__n"))
    return {r["__triple"]: r["__n"] for r in found.collect()}


def ordinary_words(docs: DataFrame, text: str) -> list[str]:
    """Words drawn letter by letter, each by its share behind the two letters before it in the words of all rows; as many
    as the table has, DRAWN_WORDS at most."""
    counts = letter_triples(docs, text)
    letters = " " + CAPITALS + SMALL
    number, k = {c: i for i, c in enumerate(letters)}, len(letters)
    shares = np.zeros((k * k, k), np.int64)
    for triple, n in counts.items():
        first, second, third = map(number.__getitem__, triple)
        shares[first * k + second, third] = n
    words = [""] * min(DRAWN_WORDS, sum(n for t, n in counts.items() if t.startswith("  ")))
    sums = np.cumsum(shares, axis=1)
    rng, state, going = np.random.default_rng(29), np.zeros(len(words), np.int64), np.arange(len(words))
    while len(going):
        drawn = rng.integers(0, sums[state, -1])
        after = (sums[state] <= drawn[:, None]).sum(axis=1)
        going, state = going[after > 0], (state % k * k + after)[after > 0]
        for word, letter in zip(going.tolist(), after[after > 0].tolist()):
            words[word] += letters[letter]
    return words


def battery(token: Column, model: list[list[list[float]]]) -> Column:
    """(n, p_random, p_ordinary) of a token: the chance of its worst randomness test under pure chance, times the three tests, and
    the chance that an ordinary token of its encoding and length has statistics as random (`model` of fit_ordinary)."""
    body = F.regexp_extract(token, "^(.*?)=*$", 1)
    flat = F.lit([x for rows in model for row in rows for x in row])

    def encoded(t: Column) -> Column:
        kind = F.lit(len(ENCODINGS))
        for at, (pattern, _) in reversed([*enumerate(ENCODINGS[:-1], 1)]):
            kind = F.when(t.rlike(pattern), F.lit(at)).otherwise(kind)
        return F.struct(F.filter(F.split(t, "", -1), lambda c: c != "").alias("chars"), kind.alias("kind"))

    def coded(e: Column) -> Column:
        alphabet = F.element_at(F.lit([letters for _, letters in ENCODINGS]), e["kind"])
        return _let(alphabet, lambda letters: coded_by(e, letters))

    def coded_by(e: Column, alphabet: Column) -> Column:
        codes = F.transform(e["chars"], lambda c: F.instr(alphabet, c) - 1)
        return F.struct(
            e["kind"].alias("kind"), codes.alias("codes"), F.transform(e["chars"], character_class).alias("classes"),
            F.length(alphabet).cast("double").alias("k"), F.size(e["chars"]).cast("double").alias("n"))

    def counted(c: Column) -> Column:
        n, k, codes = c["n"], c["k"], c["codes"]
        zero = F.lit(0.0)
        squares = F.aggregate(F.array_distinct(codes), zero, lambda a, x: a + F.pow(F.size(F.filter(codes, lambda y: y == x)).cast("double"), F.lit(2.0)))
        pairs = F.arrays_zip(F.slice(codes, F.lit(1), F.size(codes) - 1).alias("x"), F.slice(codes, F.lit(2), F.size(codes) - 1).alias("y"))
        kinds = F.arrays_zip(
            F.slice(c["classes"], F.lit(1), F.size(codes) - 1).alias("x"), F.slice(c["classes"], F.lit(2), F.size(codes) - 1).alias("y"))
        mean = F.aggregate(codes, zero, lambda a, x: a + x) / n
        return _let(mean, lambda m: F.struct(
            c["kind"].alias("kind"), n.alias("n"), k.alias("k"), squares.alias("squares"),
            F.size(F.filter(codes, lambda x: x * 2 >= k)).cast("double").alias("high"),
            F.size(F.filter(pairs, lambda p: (p["x"] * 2 >= k) != (p["y"] * 2 >= k))).cast("double").alias("changes"),
            F.aggregate(codes, zero, lambda a, x: a + (x - m) * (x - m)).alias("spread"),
            F.aggregate(pairs, zero, lambda a, p: a + (p["x"] - m) * (p["y"] - m)).alias("together"),
            F.size(F.filter(kinds, lambda p: p["x"] != p["y"])).cast("double").alias("switches")))

    def judged(s: Column) -> Column:
        n, k, free = s["n"], s["k"], s["k"] - 1
        chi = s["squares"] * k / n - n
        # Wilson and Hilferty: the cube root of chi-squared is nearly normal.
        uniform = normal_tail((F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (F.lit(1.0) - F.lit(2.0) / (free * 9))) / F.sqrt(F.lit(2.0) / (free * 9)))
        both = s["high"] * (n - s["high"]) * 2
        variance = both * (both - n) / (n * n * (n - 1))
        runs = F.when(both <= n, F.pow(F.lit(2.0), -(n - 1))).otherwise(
            normal_tail(F.abs(s["changes"] - both / n) / F.sqrt(F.greatest(variance, F.lit(1e-9)))) * 2)
        serial = F.when(s["spread"] <= 0, F.lit(0.0)).otherwise(
            normal_tail(F.abs(s["together"] / F.greatest(s["spread"], F.lit(1e-9)) + F.lit(1.0) / n) * F.sqrt(n)) * 2)
        # Against ordinary tokens: chi-squared as the share of equal pairs, runs of character classes where the encoding has several.
        pairs = F.asin(F.sqrt(F.greatest(s["squares"] - n, F.lit(0.0)) / (n * (n - 1))))
        one_class = F.lit([len({*map(_class_of, letters)}) == 1 for _, letters in ENCODINGS])
        switches = F.asin(F.sqrt(F.when(F.element_at(one_class, s["kind"]), s["changes"]).otherwise(s["switches"]) / (n - 1)))
        lag = F.when(s["spread"] <= 0, F.lit(1.0)).otherwise(s["together"] / F.greatest(s["spread"], F.lit(1e-9))) + F.lit(1.0) / n
        place = sum(((n >= least).cast("int") for least in REFERENCE_LENGTHS[1:]), F.lit(1))
        weights = F.slice(flat, ((s["kind"] - 1) * len(REFERENCE_LENGTHS) + place - 1) * 4 + 1, 4)
        score = _let(weights, lambda w: w[0] * pairs + w[1] * switches + w[2] * lag - w[3])
        return F.struct(
            n.cast("int").alias("n"), F.least(F.least(uniform, runs, serial) * 3, F.lit(1.0)).alias("p_random"),
            normal_tail(score).alias("p_ordinary"))

    tested = _let(_let(_let(_let(body, encoded), coded), counted), judged)
    return F.when(F.length(body) >= 8, tested)


def length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def thresholds(tested: DataFrame, rate: float = DISCOVERY_RATE) -> dict[int, int]:
    """Least p-value step of each length class at which the share of false discoveries is at most `rate`.

    `tested` has (length_class, step) of every tested token; only their counts, at most LAST_STEP + 1 a class, are gathered.
    """
    counts: dict[int, dict[int, int]] = {}
    for row in tested.groupBy("length_class", "step").count().collect():
        counts.setdefault(row["length_class"], {})[row["step"]] = row["count"]
    found = {}
    for kind, steps in counts.items():
        total, above = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            above += steps[step]
            if 10 ** (-step / STEPS) <= rate * above / total:
                found[kind] = step
    return found


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = DISCOVERY_RATE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, as kind:start:end joined by commas), n_random.

    Places are code points, ends exclusive. Null and empty texts have no spans; repeated rows are all kept; an empty table gives
    no rows. Added spans (`random`) never overlap a base span. Further columns are not read.
    """
    spans = base_spans(F.col(text))
    found = docs.select(F.col(key).alias("doc_id"), *[v.alias(k) for k, v in spans.items()])
    def ranked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))

    base = F.concat(*map(ranked, KINDS[:3]))
    found = found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.array_sort(base).alias("base"), "token")
    free = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    found = found.withColumn("token", free)
    model = fit_ordinary(ordinary_words(docs, text))
    tested = F.transform("token", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), battery(t["piece"], model).alias("test")))
    # Whole steps only count fully: 10^-step/STEPS is never below the p-value.
    step = lambda p: F.floor(F.least(-F.log10(F.greatest(p, F.lit(1e-99))) * STEPS, F.lit(float(LAST_STEP)))).cast("int")
    graded = F.transform(F.filter(tested, lambda t: t["test"].isNotNull()), lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), length_class(t["test"]["n"]).alias("length_class"),
        step(t["test"]["p_ordinary"]).alias("step"), (t["test"]["p_random"] > NOT_RANDOM).alias("random")))
    found = materialize(found.withColumn("token", graded), "secrets")
    least = thresholds(found.select(F.explode("token").alias("t")).select("t.length_class", "t.step"), rate)

    def passes(t: Column) -> Column:
        bound = F.lit(LAST_STEP + 1)
        for kind, value in least.items():
            bound = F.when(t["length_class"] == kind, F.lit(value)).otherwise(bound)
        return t["random"] & (t["step"] >= bound)

    added = F.transform(F.filter("token", passes), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", added))).alias("spans"), F.size(added).cast("long").alias("n_random"))
