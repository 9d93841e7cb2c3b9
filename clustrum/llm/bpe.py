"""Byte-level BPE from a public vocabulary file, by a pair occurrence index over the distinct words of a partition.

A task splits its texts into words, lays the words it has not met yet one after the other as linked bytes, and maps each pair
that the vocabulary merges to all positions where it stands. Ranks are then taken in ascending order: the positions of a
rank are merged at once and the lists of the pairs that arise beside them are extended. A pair with the new token always has
a later rank, so one pass over the active ranks gives each word the tokens that word-by-word merging gives.
"""
from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words, pieces after a blank, and pieces at the start of a line whose tokens a task keeps, the first of each; later ones are
#: merged anew where they come again. Speed only.
KEPT_WORDS = 150_000
#: Longer ones are not kept.
KEPT_CHARS = 64
#: Words that are looked up at a time, characters of texts whose new words share one index, and rows taken out of a batch at a time.
BLOCK_WORDS, BLOCK_CHARS, BATCH_ROWS = 1 << 17, 1 << 22, 1000
#: Positions from which a pair is merged at all of them at once.
FEW = 16


#: White space that is neither a single blank nor a single line feed between other characters.
_UNEVEN = re.compile(r"[^\S \n]|\s\s|^\s|\s\Z")


def byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable in Latin-1, else one
    from U+0100 on, in byte order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(0x100)
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


def late_characters() -> str:
    """Ranges of letters and digits that `regex` knows and `unicodedata` does not: they came with a later version of Unicode than
    that of the vocabulary's own library, for which they are neither."""
    unassigned = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    late = np.array([ord(c) for run in regex.findall(r"[\p{L}\p{N}]+", unassigned) for c in run], np.int64)
    ranges = np.split(late, np.flatnonzero(np.diff(late) > 1) + 1) if len(late) else []
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in ranges)


def word_pattern(late: str = "") -> str:
    """Fixed value: the word pattern of byte-level vocabularies, here without the ranges `late` of letters and digits."""
    letter, digit = (rf"[\p{{{c}}}--[{late}]]" if late else rf"\p{{{c}}}" for c in "LN")
    return rf"{'(?V1)' if late else ''}'(?:[stmd]|re|ve|ll)| ?(?:{letter}+|{digit}+|[^\s{letter}{digit}]+)|\s+(?!\S)|\s+"


def read_vocabulary(path: str) -> dict:
    """Merges, byte strings of tokens and special tokens of a byte-level BPE file, as plain values that a broadcast can ship.

    Refuses files of another kind, and merges that are not in learned order, for which the pass by ascending ranks would not
    be exact. The size is that of the file, which the driver holds.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    extras = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    levels = (before, spec.get("decoder") or {})
    if model["type"] != "BPE" or any(model.get(e) for e in extras) or any(x.get("type") != "ByteLevel" for x in levels):
        raise ValueError("not a byte-level BPE vocabulary")
    if before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("prefix spaces, other word patterns and normalizers are not supported")
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that take other characters with them are not supported")
    vocabulary, byte_of = model["vocab"], {c: b for b, c in enumerate(byte_characters())}
    token_bytes: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
    token_bytes |= {i: content.encode() for content, i in specials.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
    made: dict[int, int] = {}
    for rank, (a, b, new) in enumerate(pairs):
        if made.get(a, -1) >= rank or made.get(b, -1) >= rank or made.setdefault(new, rank) != rank:
            raise ValueError("merges are not in learned order")
    if any(made.get(x, -1) > rank for rank, (a, b, _) in enumerate(pairs) for x in (a, b)):
        raise ValueError("merges are not in learned order")
    return {
        "pairs": pairs, "bytes": token_bytes, "singles": [vocabulary[c] for c in byte_characters()],
        "specials": specials, "late": late_characters(),
    }


class _PairIndex:
    """Bytes of many words as linked symbols, and of every pair that can be merged the positions where it stands."""

    def __init__(self, encoder: Encoder, first: np.ndarray, ends: np.ndarray):
        n = len(first)
        self.encoder, self.symbols = encoder, encoder.single_ids[first]
        self.following, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.following[ends - 1] = -1
        self.before[ends[:-1]] = -1
        self.views = tuple(map(memoryview, (self.symbols, self.following, self.before)))
        ranks = encoder.byte_ranks[first[:-1], first[1:]]
        ranks[ends[:-1] - 1] = -1
        self.places: dict[int, list] = {}
        self.active: list[int] = []
        self._add(ranks, np.arange(n - 1, dtype=np.int32))

    def _add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Adds positions to the lists of the ranks of the pairs that stand there; rank -1 is no pair to merge."""
        some = ranks >= 0
        ranks, places = ranks[some], places[some]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for rank, start, end in zip(ranks[np.concatenate([[0], cuts])].tolist(), bounds, bounds[1:]):
            self._list(rank).append(places[start:end])

    def _list(self, rank: int) -> list:
        if rank not in self.places:
            self.places[rank] = []
            heapq.heappush(self.active, rank)
        return self.places[rank]

    def apply(self, rank: int) -> None:
        """Merges a pair at all its positions; where it overlaps itself, the one further left takes the token."""
        lists = self.places.pop(rank)
        if len(lists) == 1:
            at = lists[0]
        else:
            at = np.concatenate(lists)
        if len(at) < FEW:
            self._one_by_one(rank, sorted(set(at.tolist())))
            return
        left, right, new = self.encoder.pairs[rank]
        symbols, following, before = self.symbols, self.following, self.before
        at = np.unique(at) if len(lists) > 1 or left == right else at
        at = at[symbols[at] == left]
        after = following[at]
        stands = (after >= 0) & (symbols[after] == right)
        at, after = at[stands], after[stands]
        if left == right and len(at):
            # In a run of overlapping pairs every second one stays.
            begins = np.concatenate([[True], at[1:] != after[:-1]])
            number = np.arange(len(at))
            stays = (number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0
            at, after = at[stays], after[stays]
        symbols[at], symbols[after] = new, -1
        after = following[after]
        following[at] = after
        goes_on = after >= 0
        before[after[goes_on]] = at[goes_on]
        self._add(self.encoder.ranks_after(new, symbols[after[goes_on]]), at[goes_on])
        front = before[at]
        front = front[front >= 0]
        self._add(self.encoder.ranks_before(new, symbols[front]), front)

    def _one_by_one(self, rank: int, places: list[int]) -> None:
        left, right, new = self.encoder.pairs[rank]
        symbols, following, before = self.views
        rank_of = self.encoder.rank.get
        for at in places:
            after = following[at]
            if symbols[at] != left or after < 0 or symbols[after] != right:
                continue
            symbols[at], symbols[after] = new, -1
            after = following[at] = following[after]
            front = before[at]
            if after >= 0:
                before[after] = at
                found = rank_of((new, symbols[after]))
                if found is not None:
                    self._list(found).append(np.array([at], np.int32))
            if front >= 0:
                found = rank_of((symbols[front], new))
                if found is not None:
                    self._list(found).append(np.array([front], np.int32))


class Encoder:
    """The encoder and decoder of one task, made from `read_vocabulary`."""

    def __init__(self, vocabulary: dict):
        self.pairs, self.bytes, self.singles = vocabulary["pairs"], vocabulary["bytes"], vocabulary["singles"]
        self.rank = {(a, b): rank for rank, (a, b, _) in enumerate(self.pairs)}
        self.single_ids = np.array(self.singles, np.int32)
        self.byte_ranks = np.array([[self.rank.get((a, b), -1) for b in self.singles] for a in self.singles], np.int32)
        # Of every token the tokens that it merges with, on either side, and the ranks.
        sides = np.array(self.pairs, np.int32).reshape(-1, 3)
        self.partners = [self._partners(sides[:, own], sides[:, other]) for own, other in ((0, 1), (1, 0))]
        self.scratch = np.full(max(self.bytes) + 1, -1, np.int32)
        self.specials = vocabulary["specials"]
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        late = vocabulary["late"]
        self.beyond = re.compile(f"[{late[0]}-{chr(sys.maxunicode)}]") if late else None
        self.late = regex.compile(f"[{late}]") if late else None
        self.words, self.words_late = regex.compile(word_pattern()), regex.compile(word_pattern(late))
        # Tokens, as 32-bit numbers, of words, and of pieces that follow a blank or begin a line.
        self.known: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.line_feed = self._packed(self.merged(["\n"])[0])

    @staticmethod
    def _packed(ids) -> bytes:
        return np.asarray(ids, np.int32).tobytes()

    @staticmethod
    def _partners(own: np.ndarray, other: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(own, kind="stable").astype(np.int32)
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        return {int(own[r[0]]): (other[r], r) for r in np.split(order, starts[1:]) if len(r)}

    def _ranks(self, side: int, token: int, others: np.ndarray) -> np.ndarray:
        if token not in self.partners[side]:
            return np.full(len(others), -1, np.int32)
        tokens, ranks = self.partners[side][token]
        self.scratch[tokens] = ranks
        found = self.scratch[others]
        self.scratch[tokens] = -1
        return found

    def ranks_after(self, token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of `token` with each of `others` after it, -1 where they do not merge."""
        return self._ranks(0, token, others)

    def ranks_before(self, token: int, others: np.ndarray) -> np.ndarray:
        return self._ranks(1, token, others)

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """Tokens of each word, by one pair index over all of them."""
        if not words:
            return []
        data = [w.encode() for w in words]
        ends = np.cumsum([len(d) for d in data])
        first = np.frombuffer(b"".join(data), np.uint8)
        index = _PairIndex(self, first, ends)
        while index.active:
            index.apply(heapq.heappop(index.active))
        left = index.symbols >= 0
        return np.split(index.symbols[left], np.cumsum(left)[ends - 1][:-1])

    def word_blocks(self, text: str) -> Iterator[list[str]]:
        """Blocks of the words of a text without special tokens, in order."""
        words = self.words_late if self.beyond and self.beyond.search(text) and self.late.search(text) else self.words
        if len(text) < BLOCK_WORDS:
            yield words.findall(text)
        else:
            found = (m.group() for m in words.finditer(text))
            while block := list(itertools.islice(found, BLOCK_WORDS)):
                yield block

    def word_tokens(self, texts: list[str]) -> list[bytes]:
        """Tokens of each text, its words looked up, new words of all texts merged together."""
        split = [list(self.word_blocks(t)) for t in texts]
        known = self._known(self.known, {w for text in split for block in text for w in block}, lambda new: map(self._packed, self.merged(new)))
        return [b"".join(b"".join(map(known.__getitem__, block)) for block in text) for text in split]

    def piece_tokens(self, pieces: list[str], blank: str) -> list[bytes]:
        """Tokens of pieces without white space, each with the blank before it.

        They go through the word pattern as lines of one text: a line feed between them is a word of its own, and stands for
        the ends of the pieces among the tokens.
        """
        out: list[bytes] = []
        end = b"\xff" * 4
        for start in range(0, len(pieces), BLOCK_WORDS):
            lines = "\n".join([blank + p for p in pieces[start:start + BLOCK_WORDS]])
            words = (self.words_late if self.beyond and self.beyond.search(lines) and self.late.search(lines) else self.words).findall(lines)
            known = self._known(self.known, set(words) - {"\n"}, lambda new: map(self._packed, self.merged(new)))
            # No token has four bytes of 255: their highest byte is 0.
            tokens = [end if w == "\n" else known[w] for w in words]
            out += b"".join(tokens).split(end) if tokens else []
        return out

    @staticmethod
    def _known(kept: dict[str, bytes], wanted: set[str], find: Callable) -> dict[str, bytes]:
        """`kept` with the tokens of all that is wanted; what is new and short stays in it while there is room."""
        new = list(wanted.difference(kept))
        tokens = dict(zip(new, find(new)))
        if len(kept) + len(new) <= KEPT_WORDS and all(len(w) <= KEPT_CHARS for w in new):
            kept.update(tokens)
            return kept
        found = kept | tokens
        if len(kept) < KEPT_WORDS:
            kept.update(itertools.islice(((w, t) for w, t in tokens.items() if len(w) <= KEPT_CHARS), KEPT_WORDS - len(kept)))
        return found

    def plain(self, texts: list[str]) -> list[bytes]:
        """Tokens of texts in which blanks and line feeds stand singly between other characters, and no other white space is.

        There a line feed is a word and a blank begins one, so the pieces between them have tokens of their own, whatever
        stands beside them.
        """
        split = [[line.split(" ") for line in text.split("\n")] for text in texts]
        start = self._known(self.at_start, {line[0] for text in split for line in text}, lambda new: self.piece_tokens(new, ""))
        after = {p for text in split for line in text for p in itertools.islice(line, 1, None)}
        blank = self._known(self.after_blank, after, lambda new: self.piece_tokens(new, " ")).__getitem__
        return [
            self.line_feed.join([start[line[0]] + b"".join(map(blank, itertools.islice(line, 1, None))) for line in text]) for text in split]

    def parts_tokens(self, parts: list[str]) -> list[bytes]:
        """Tokens of texts without special tokens. Long ones go by blocks of words, which bounds what is held."""
        plain = [i for i, p in enumerate(parts) if 0 < len(p) <= BLOCK_CHARS and not _UNEVEN.search(p)]
        out: list[bytes] = [b""] * len(parts)
        for i, tokens in zip(plain, self.plain([parts[i] for i in plain])):
            out[i] = tokens
        others = sorted(set(range(len(parts))).difference(plain))
        short = [i for i in others if len(parts[i]) <= BLOCK_CHARS]
        for i, tokens in zip(short, self.word_tokens([parts[i] for i in short])):
            out[i] = tokens
        for i in set(others).difference(short):
            out[i] = b"".join(self._long(parts[i]))
        return out

    def _long(self, text: str) -> Iterator[bytes]:
        for block in self.word_blocks(text):
            new = list(set(block).difference(self.known))
            tokens = self.known | dict(zip(new, map(self._packed, self.merged(new))))
            yield b"".join(map(tokens.__getitem__, block))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text; texts of up to `BLOCK_CHARS` characters together share one index."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= BLOCK_CHARS):
                size += len(texts[end])
                end += 1
            split = [self.special.split(t) if self.special else [t] for t in texts[start:end]]
            tokens = iter(self.parts_tokens([p for parts in split for p in parts[::2]]))
            for parts in split:
                yield np.frombuffer(b"".join(
                    next(tokens) if i % 2 == 0 else self._packed([self.specials[p]]) for i, p in enumerate(parts)), np.int32)
            start = end

    def decode(self, ids: list[int]) -> str:
        """Text of token ids; unknown ids give nothing, bytes that are no UTF-8 a replacement character."""
        return b"".join(map(self.bytes.get, ids, itertools.repeat(b""))).decode("utf-8", "replace")


def _per_task(df: DataFrame, vocabulary: dict, row: Callable, name: str, kind: pa.DataType, spark_kind: str) -> DataFrame:
    """`df` with a column `name` that `row` makes of batches of its last column."""
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            made = row(encoder, batch.column(batch.num_columns - 1))
            yield pa.record_batch([*batch.columns[:-1], pa.array(made, kind)], [*batch.schema.names[:-1], name])

    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[:-1])
    return df.mapInArrow(run, f"{kept}, {name} {spark_kind}")


def encode(df: DataFrame, vocabulary: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): token ids of each whole text, in one pass without a shuffle.

    Null texts are empty and have no ids; repeated rows and null keys are kept; further columns are not read; an empty table
    gives no rows. The strings of special tokens in a text are those tokens.
    """
    def ids(encoder: Encoder, texts: pa.Array) -> list:
        return list(encoder.encode([t or "" for t in texts.to_pylist()]))

    return _per_task(df.select(key, text), vocabulary, ids, "ids", pa.list_(pa.int32()), "array<int>")


def _texts(encoder: Encoder, lists: pa.Array) -> list:
    """Texts of an Arrow array of lists of ids, without a Python list of each."""
    offsets, flat = lists.offsets.to_pylist(), lists.values
    return [encoder.decode(flat.slice(a, b - a).to_numpy().tolist()) for a, b in zip(offsets, offsets[1:])]


def decode(encoded: DataFrame, vocabulary: dict, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of each list of token ids; null lists give empty texts."""
    return _per_task(encoded.select(key, ids), vocabulary, _texts, "text", pa.string(), "string")


def round_trip(df: DataFrame, vocabulary: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the ids in decimal, joined by commas, and of the text that they decode
    to. One pass, in which the ids stay in the task that made them; nulls and repeats as in `encode`."""
    shipped, kind = df.sparkSession.sparkContext.broadcast(vocabulary), dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        decimal = list(map(str, range(max(encoder.bytes) + 1))).__getitem__
        digest = lambda content: hashlib.sha256(content.encode("utf-8")).hexdigest()
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            made = []
            for ids in map(np.ndarray.tolist, encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                made.append((len(ids), digest(",".join(map(decimal, ids))), digest(encoder.decode(ids))))
            columns = zip(*made) if made else ([], [], [])
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string())))],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
