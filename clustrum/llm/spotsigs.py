"""SpotSigs fingerprints (Theobald and others, 2008): chains of content words after common anchor words.

Every anchor in a text opens a signature: the anchor and the next content words at a fixed distance from each other.
The set of signatures is the fingerprint; junk and boilerplate without anchors hardly add to it. Sets are compared by
Jaccard with the bounds that sizes allow: a pair whose sizes differ too much is never counted through.
"""
from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrum.llm.common import mix, word_hashes
from clustrum.session import materialize

CHAIN_WORDS = 2
SPOT_DISTANCE = 1
#: Rows of one range of the ordered table, and most ranges.
RANGE_ROWS = 2_000
MOST_RANGES = 1 << 16
DIGITS = 12
FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

# Common words of English, French, German and Spanish that open a signature.
ANCHORS = (
    "a an and are at be by for had has have in is of on or that the this to was were with "
    "au aux ce des du elle est et il la le les par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für ist mit nicht sich und von zu "
    "al como con de del el en es las lo los más no se su y"
).split()
_ANCHOR_HASHES = np.sort(word_hashes([w.encode() for w in sorted(set(ANCHORS))]))
_EDGES = b".,;:!?\"'()[]{}<>|*$#%&@-_/\\+=~^`"
_SEPARATORS = bytes(0x20 if c in _EDGES else c for c in range(256))


def signature_set(text: str | None, chain: int = CHAIN_WORDS, distance: int = SPOT_DISTANCE) -> np.ndarray:
    """Sorted distinct 48-bit signatures. Words are runs without ASCII blanks and punctuation, lower-cased.

    A text with words but without a full chain has one signature, of all its words; null, empty and wordless texts
    have none.
    """
    words = (text or "").lower().encode("utf-8", "replace").translate(_SEPARATORS).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    at = np.searchsorted(_ANCHOR_HASHES, hashes)
    anchor = _ANCHOR_HASHES[np.minimum(at, len(_ANCHOR_HASHES) - 1)] == hashes
    content = hashes[~anchor]
    spots = np.flatnonzero(anchor)
    # Content words before each anchor: the next content word has that index.
    first = spots - np.arange(len(spots))
    full = first + (chain - 1) * distance < len(content)
    spots, first = spots[full], first[full]
    if not len(spots):
        return word_hashes([b" ".join(words)]) >> np.uint64(16)
    value = hashes[spots]
    for k in range(chain):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + content[first + k * distance])
    return np.unique(value >> np.uint64(16))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets, or 0 as soon as their sizes rule out `least`. Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    likeness = common / (len(a) + len(b) - common)
    return likeness if likeness >= least else 0.0


def to_text(signatures: np.ndarray) -> str:
    """The fingerprint: its signatures in ascending order, DIGITS hex digits each."""
    return "".join(f"{s:0{DIGITS}x}" for s in signatures.tolist())


def edited(text: str, following: str) -> str:
    """`text` with its last third (rounded down) replaced by as many first characters of `following`, or all it has."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def range_starts(ids: DataFrame, range_rows: int = RANGE_ROWS, most: int = MOST_RANGES) -> list:
    """Largest ids of ranges of about `range_rows` rows in descending order of the one column of `ids`, nulls left out.

    At most `most` ranges; beyond that each gets more rows, which a task streams through.
    """
    name = ids.columns[0]
    ranges = max(1, min(most, ids.count() // range_rows))
    dealt = ids.where(F.col(name).isNotNull()).repartitionByRange(ranges, F.desc(name))
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.max(name).alias("first")).select("first").distinct().collect()
    return sorted((r["first"] for r in firsts), reverse=True)


def with_followers(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of (doc_id, text) dealt into ranges of descending id and sorted inside each: (part, guest, doc_id, text).

    The first row of a range goes, as a guest, also to the end of the range before it, and the first row of all to the end of
    the last range. So every row finds its successor in its own range, and the texts are shuffled once. Rows of one id are
    ordered by text digest; null ids come last.
    """
    starts = range_starts(docs.select("doc_id"), range_rows)
    ascending, kind = starts[::-1], dict(docs.dtypes)["doc_id"]
    last = max(0, len(starts) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, guests = [], [], []
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                # Starts below the id come after it.
                part = last if doc_id is None else min(last, len(ascending) - 1 - bisect.bisect_left(ascending, doc_id))
                rows.append(row), parts.append(part), guests.append(False)
                if (doc_id is None and not starts) or (doc_id is not None and doc_id == starts[part]):
                    rows.append(row), parts.append((part - 1) % (last + 1)), guests.append(True)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch(
                [pa.array(parts, pa.int32()), pa.array(guests, pa.bool_()), taken.column(0), taken.column(1)],
                ["part", "guest", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, f"part int, guest boolean, doc_id {kind}, text string").repartition("part")
    return dealt.sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")


def _compare(row: tuple, following: str, next_signatures: np.ndarray) -> tuple:
    _, doc_id, text, own = row
    changed = edited(text, following)
    signatures = signature_set(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), to_text(own), to_text(signatures),
        pruned_jaccard(own, signatures), pruned_jaccard(own, next_signatures))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row, in descending id: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text borrows from the next row's text (after the last row: the first's); likenesses are those of the row's
    fingerprint to that of its edited text and of the next row's text. A null text is empty; a text without words has
    an empty fingerprint, and two empty ones are alike (1.0). Repeated rows are all kept and follow each other; a single row
    follows itself; an empty table gives no rows. Further columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for part, guest, doc_id, content in zip(*(c.to_pylist() for c in batch.columns)):
                own = signature_set(content)
                if held is not None and held[0] == part:
                    out.append(_compare(held, content, own))
                held = None if guest else (part, doc_id, content, own)
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], FIELDS)

    return with_followers(rows, range_rows).mapInArrow(
        fingerprint, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                     "near_edited double, near_next double")


def similar_pairs(prints: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near copies among `prints` (doc_id, fingerprint): pairs (a, b, likeness) of unlike fingerprints whose Jaccard is at
    least `least`, by their digest, and the membership (doc_id, class) of the rows in these digests.

    Fingerprints are partitioned by size so that only neighbouring partitions can hold partners, and meet there on one of
    their rarest signatures; sizes are compared before sets. Null and empty fingerprints are in no pair and have class null.
    """
    classes = prints.select("doc_id", F.when(F.length("fingerprint") > 0, F.sha2("fingerprint", 256)).alias("class"), "fingerprint")
    sets = materialize(classes.where("class IS NOT NULL").select("class", "fingerprint").dropDuplicates(["class"]).select(
        "class", F.regexp_extract_all("fingerprint", F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0)).alias("signatures")), "prints")
    n = F.size("signatures")
    spread = sets.select("class", n.alias("n"), F.explode("signatures").alias("signature"))
    spread = spread.join(spread.groupBy("signature").agg(F.count("*").alias("df")), "signature")
    rank = F.row_number().over(Window.partitionBy("class").orderBy("df", "signature"))
    prefix = spread.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    home = prefix.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / float(-np.log(least)) + 1e-9))
    probe = home.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    x, y = home.select("part", "signature", F.col("class").alias("a"), F.col("n").alias("n_a")), probe.select(
        "part", "signature", F.col("class").alias("b"), F.col("n").alias("n_b"))
    smaller = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    met = x.join(y, ["part", "signature"]).where(smaller & (F.col("n_b") >= F.col("n_a") * least - 1e-9)).select("a", "b").distinct()
    both = met.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    pairs = both.select("a", "b", (common / (F.size("set_a") + F.size("set_b") - common)).alias("likeness"))
    return pairs.where(F.col("likeness") >= least - 1e-12), classes.select("doc_id", "class")
