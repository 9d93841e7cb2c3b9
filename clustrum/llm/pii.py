"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same wherever one entity recurs.

An entity is its type and normal form (digits of a number, lower-cased letters), so different spellings of one entity get
one surrogate, written in the spelling of each place. Surrogates come from a keyed digest of type, normal form and attempt. All
entities of the corpus are checked together: a surrogate that another entity also got, or that is itself an entity of the
corpus, is drawn again. Only such exceptions are looked up when texts are rewritten; all others follow from the key. From the
eighth attempt on every type draws from a wider class, which in the end grows with the attempts: the redraws end however full the
narrow class is. Names of men and women are one space. A mention without a form of address, or by the last word alone,
belongs to the full name that the text gives with one.
"""
from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.llm.common import broadcast_if_small
from clustrum.session import materialize

TYPES = ("email", "iban", "phone", "ssn", "ip", "card", "male", "female")

# Forms of address that mark a man's or a woman's name.
MALE = "Mr Mister Monsieur Herr Señor Sr господин Господин κύριος Κύριος".split()
FEMALE = "Mrs Ms Miss Madame Mme Frau Señora Sra госпожа Госпожа κυρία Κυρία".split()
_NAME = r"[^\W\d_a-zà-öø-ÿа-яёα-ω]\w*(?:[-'’]\w+)?"
_NUMBERS = re.compile("|".join((
    r"(?P<email>[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)",
    r"(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\b\d{3}[.-]\d{3}[.-]\d{4}\b|\b\d{3} \d{3} \d{4}\b(?! ?\d)"
    r"|(?<![\d.,-])0\d(?:(?P<mid>[ .-])\d\d)(?:(?P=mid)\d\d){3}(?!\d)|(?<![\d.,-])0\d{2,4} \d{3,4} ?\d{4}(?! ?\d)|(?<![\d.,-])0[1-9]\d{8}(?!\d))",
    r"(?P<ssn>\b\d{3}-\d{2}-\d{4}\b)",
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
    r"(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))",
)))
_NAMES = re.compile(rf"\b(?:(?P<male>{'|'.join(MALE)})|(?P<female>{'|'.join(FEMALE)}))\.? +(?P<name>{_NAME}(?: {_NAME})?)")
_DIGIT_OR_AT = re.compile("[0-9@]")
# Telephone country codes of one and of two digits; all others have three.
_SHORT_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Attempts in the narrow class of a surrogate, and attempts after which classes grow.
NARROW, WIDE = 8, 16

# Letters that stand in for each other, by script: vowels and consonants.
_ALPHABETS = [("aeiou", "bcdfghjklmnprstvwz"), ("аеиоу", "бвгдзклмнпрст"), ("αεηιο", "βγδκλμνπρστ")]
_VOWELS = set("aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüýÿаеёиоуыэюяαεηιουωάέήίόύώ")


def luhn_sum(digits: str) -> int:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10


def iban_remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of all entities, by place; leftmost first, none overlapping."""
    if not text:
        return []
    found = []
    if _DIGIT_OR_AT.search(text):
        for match in _NUMBERS.finditer(text):
            kind, surface = next(t for t in TYPES if t in match.re.groupindex and match[t] is not None), match.group()
            normal = normal_form(kind, surface)
            if kind == "iban" and iban_remainder(normal) != 1:
                continue
            found.append((match.start(), match.end(), kind, normal))
    found += _names(text)
    found.sort()
    kept: list[tuple[int, int, str, str]] = []
    for entity in found:
        if not kept or entity[0] >= kept[-1][1]:
            kept.append(entity)
    return kept


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Names after a form of address; then all mentions of a full one without it. A last word alone belongs to the one full name
    of its gender that ends in it."""
    titled = [(*m.span("name"), "male" if m["male"] else "female", m["name"]) for m in _NAMES.finditer(text)]
    full: dict[str, str] = {}
    by_last: dict[tuple[str, str], set[str]] = {}
    for *_, kind, name in titled:
        if " " in name:
            full.setdefault(name, kind)
            by_last.setdefault((kind, normal_form(kind, name).rpartition(" ")[2]), set()).add(normal_form(kind, name))
    found = []
    for start, end, kind, name in titled:
        normal = normal_form(kind, name)
        owners = by_last.get((kind, normal), ()) if " " not in name else ()
        found.append((start, end, kind, next(iter(owners)) if len(owners) == 1 else normal))
    if full:
        mentions = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(full, key=len, reverse=True)))})(?!\w)")
        known = {start for start, *_ in found}
        found += [(*m.span(), full[m.group()], normal_form("male", m.group())) for m in mentions.finditer(text) if m.start() not in known]
    return found


def _lowered(text: str) -> str:
    """Small letters, one for each character."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def normal_form(kind: str, surface: str) -> str:
    if kind in ("email", "male", "female", "ip"):
        return _lowered(surface)
    digits = "".join(c for c in surface if c.isalnum())
    return "+" + digits if kind == "phone" and surface.startswith("+") else digits


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    """Endless keyed numbers for these parts."""
    seed, block = hmac.new(key, "\0".join(parts).encode("utf-8", "replace"), hashlib.sha256).digest(), 0
    while True:
        digest = hashlib.sha256(seed + block.to_bytes(8, "big")).digest()
        yield from (int.from_bytes(digest[i:i + 4], "big") for i in range(0, 32, 4))
        block += 1


def _letters(text: str, draw: Iterator[int], keep_last: bool = False) -> str:
    """Digits and small letters replaced by their like, script by script; with `keep_last` an ending that may show gender stays."""
    out = []
    for place, c in enumerate(text):
        if c.isdigit():
            out.append(str(next(draw) % 10))
        elif not c.isalpha() or (keep_last and place == len(text) - 1 and c in _VOWELS):
            out.append(c)
        else:
            script = 1 if "Ѐ" <= c <= "ӿ" else 2 if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else 0
            letters = _ALPHABETS[script][0 if c in _VOWELS else 1]
            out.append(letters[next(draw) % len(letters)])
    return "".join(out)


def _number(digits: str, draw: Iterator[int], kept: int) -> str:
    """Digits after the first `kept` replaced; leading zeros stay zeros and other first digits other than zero."""
    out = list(digits[:kept])
    for place, digit in enumerate(digits[kept:]):
        value = next(draw)
        out.append(str(value % 10) if place else ("0" if digit == "0" else str(1 + value % 9)))
    return "".join(out)


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """Normal form of the surrogate: the same type, length, country code and check digits.

    From attempt `NARROW` on mails and names grow, and addresses keep their private prefix only; from attempt `WIDE` on numbers
    grow too, and an address becomes a private one of version 6.
    """
    draw = _stream(key, kind, normal, str(attempt))
    further = max(0, attempt - WIDE + 1)
    if kind == "email":
        local, _, domain = normal.rpartition("@")
        labels = domain.split(".")
        # One domain has one surrogate, whoever writes from it; the last label stays.
        shared = _stream(key, "domain", domain)
        grown = "".join(str(next(draw) % 10) for _ in range(max(0, attempt - NARROW + 1)))
        return f"{_letters(local, draw)}{grown}@{'.'.join([_letters('.'.join(labels[:-1]), shared), labels[-1]])}"
    if kind == "ip":
        if further:
            return "fd" + ":".join(f"{next(draw) & 0xFFFF:04x}" for _ in range(8))[2:]
        octets = normal.split(".")
        private = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] else 0
        redraw = _octet if attempt < NARROW else lambda o, d: str(next(d) % 254 + 1)
        return ".".join(o if i < private else redraw(o, draw) for i, o in enumerate(octets))
    if kind in ("male", "female"):
        grown = "".join(_ALPHABETS[0][i % 2][next(draw) % 5] for i in range(2 * max(0, attempt - NARROW + 1)))
        words = [_letters(w, draw, keep_last=True) for w in normal.split(" ")]
        return " ".join(words[:-1] + [words[-1] + grown])
    longer = normal + "0" * further
    if kind == "iban":
        body = "".join(c if not c.isalnum() else str(next(draw) % 10) if c.isdigit() else chr(65 + next(draw) % 26) for c in longer[4:])
        check = 98 - iban_remainder(normal[:2] + "00" + body)
        return f"{normal[:2]}{check:02d}{body}"
    if kind == "phone":
        if normal[0] == "+":
            code = next((n for n in (1, 2) if normal[1:1 + n] in _SHORT_CODES), 3)
            return "+" + _number(longer[1:], draw, code)
        return _number(longer, draw, 0)
    if kind == "card":
        number = _number(longer, draw, 1)
        # The last digit brings the checksum to what it was, valid or not.
        wanted = luhn_sum(normal)
        return number[:-1] + next(d for d in "0123456789" if luhn_sum(number[:-1] + d) == wanted)
    return _number(longer, draw, 0)


def _octet(octet: str, draw: Iterator[int]) -> str:
    low, high = {1: (0, 9), 2: (10, 99)}.get(len(octet), (100, 255))
    return str(low + next(draw) % (high - low + 1)).zfill(len(octet)) if octet[0] != "0" or octet == "0" else octet


def render(kind: str, surface: str, replacement: str) -> str:
    """The surrogate's characters in the spelling of `surface`: its separators and capitals."""
    if kind == "ip":
        return replacement
    if kind in ("male", "female"):
        # A mention by the last word gets the last word.
        replacement = " ".join(replacement.split(" ")[-len(surface.split(" ")):])
    if kind in ("email", "male", "female"):
        shaped = "".join(r.upper() if s.isupper() and len(r.upper()) == 1 else r for r, s in zip(replacement, surface))
        return shaped + replacement[len(surface):]
    drawn = iter([c for c in replacement if c.isalnum()])
    return "".join(next(drawn) if c.isalnum() else c for c in surface) + "".join(drawn)


def rewrite(key: bytes, text: str | None, redrawn: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    """`text` with all entities replaced, and their types in order; `redrawn` has the attempts other than 0."""
    entities = find_entities(text)
    if not entities:
        return text, []
    out, end = [], 0
    for start, stop, kind, normal in entities:
        replacement = surrogate(key, kind, normal, redrawn.get((kind, normal), 0))
        out += [text[end:start], render(kind, text[start:stop], replacement)]
        end = stop
    return "".join(out) + text[end:], [e[2] for e in entities]


def _with_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, attempt) with the surrogate of that attempt."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.record_batch(
                [*batch.columns, pa.array([surrogate(key, *row) for row in rows], pa.string())], [*batch.schema.names, "surrogate"])

    return entities.select("kind", "normal", "attempt").mapInArrow(draw, "kind string, normal string, attempt int, surrogate string")


def redrawn_entities(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, attempt) of the entities that need another attempt than the first, for all surrogates of `entities`
    (distinct kind, normal) to differ from each other and from every entity.

    Of those that meet on one surrogate the smallest keeps it. Every round redraws the losers only, against all
    that is settled; it ends when there are none, which the growing classes bring about (some 20 rounds at the very most).
    """
    same = ["space", "surrogate"]
    space = F.when(F.col("kind").isin("male", "female"), "name").otherwise(F.col("kind")).alias("space")
    taken = entities.select(space, F.col("normal").alias("surrogate"))
    settled, redrawn, attempt = None, None, 0
    waiting = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = materialize(_with_surrogates(waiting, key).select("*", space), "surrogates")
        fresh = drawn.join(taken, same, "left_anti")
        if settled is not None:
            fresh = fresh.join(settled, same, "left_anti")
        winners = fresh.groupBy(*same).agg(F.min(F.struct("normal", "kind")).alias("first"))
        winners = materialize(winners.select(*same, "first.*", F.lit(attempt).alias("attempt")), "settled")
        settled = winners.select(*same) if settled is None else settled.union(winners.select(*same))
        if attempt:
            kept = winners.select("kind", "normal", "attempt")
            redrawn = kept if redrawn is None else redrawn.union(kept)
        attempt += 1
        waiting = materialize(
            drawn.select("kind", "normal").join(winners, ["kind", "normal"], "left_anti").withColumn("attempt", F.lit(attempt)), "waiting")
        if waiting.isEmpty():
            return redrawn if redrawn is not None else waiting


def replace_entities(docs: DataFrame, key: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities and types (the types in order of place, joined by commas).

    `key` is the secret of the surrogates. Null texts stay null and empty ones empty; texts without entities are unchanged;
    repeated rows are all kept; an empty table gives no rows; further columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(hashlib.md5(t.encode(), usedforsecurity=False).digest(), e) for t in batch.column(0).to_pylist() if t
                     for e in sorted({(k, n) for *_, k, n in find_entities(t)})]
            yield pa.record_batch([
                pa.array([d for d, _ in found], pa.binary()), pa.array([e[0] for _, e in found], pa.string()),
                pa.array([e[1] for _, e in found], pa.string())], ["text_key", "kind", "normal"])

    places = materialize(rows.select("text").mapInArrow(detect, "text_key binary, kind string, normal string"), "entities")
    redrawn = redrawn_entities(materialize(places.select("kind", "normal").distinct(), "distinct-entities"), key)
    # Per text with exceptions: bounded by its own entities.
    by_text = places.distinct().join(redrawn, ["kind", "normal"]).groupBy("text_key").agg(
        F.collect_list(F.struct("kind", "normal", "attempt")).alias("redrawn"))
    by_text = broadcast_if_small(materialize(by_text, "redrawn"))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = rows.join(by_text, digest == F.col("text_key"), "left").select("doc_id", "text", "redrawn")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, exceptions in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(rewrite(key, content, {(e["kind"], e["normal"]): e["attempt"] for e in exceptions or ()}))
            yield pa.record_batch([
                batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([len(o[1]) for o in out], pa.int64()),
                pa.array([",".join(o[1]) for o in out], pa.string())], ["doc_id", "text", "n_entities", "types"])

    kind = dict(rows.dtypes)["doc_id"]
    return joined.mapInArrow(replace, f"doc_id {kind}, text string, n_entities long, types string")
