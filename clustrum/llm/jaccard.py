"""Similarity join of documents on word shingles by a grouped prefix filter, and the components of its links.

Shingles are ordered by rarity. Two sets that are similar enough share a shingle among the first few of this
order (their prefixes), so only sets that meet on a prefix shingle are compared. Sets with the same prefix and size
are one group: filters see groups, and only surviving pairs of groups are expanded to members and verified exactly.

The links are wanted as components, so pairs inside a component found earlier need no comparison. Rounds of stars come
first: on each shingle all groups are compared with one of them, which contracts a large group of near copies in linear
work. What is left in different components is then joined in full.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrum.llm.common import SHINGLE_WORDS, binary_column, mix, shingle_set
from clustrum.llm.graph import components
from clustrum.llm.sketches import bucket_bits, bucket_counts, is_set
from clustrum.session import materialize

#: Buckets of the rarity table. Shingles in one bucket share a count; any order is right, a finer one is faster.
RARITY_BITS = 22
ROW_BITS = 24
MAX_STAR_ROUNDS = 8
#: Rows that a Python worker holds at a time beside the batch they came in.
BLOCK_ROWS = 1000
_SIGNATURES = "doc_id {kind}, row_key long, text_key binary, n_shingles long, set_id binary, group_id binary, prefix array<long>"


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased."""
    return text.lower().split()


def _sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(words_of(text), size) if text else np.empty(0, np.uint64)


def _row_keys(ids: pa.Array, texts: list[bytes | None]) -> np.ndarray:
    """64-bit keys of the rows: id and text."""
    seeds = [xxhash.xxh32_intdigest(i or "") for i in ids.cast(pa.string()).to_pylist()]
    return np.fromiter((xxhash.xxh3_64_intdigest(t or b"", seed=s) for s, t in zip(seeds, texts)), np.uint64, len(texts))


def _set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def needed_overlap(a: Column, b: Column, percent: int) -> Column:
    """Smallest intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


class JaccardJoin:
    """Join of `docs` (columns `key` and `text`) with itself; `percent` is the least similarity."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = 80):
        self.docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        self.size, self.percent = size, percent
        self.spark = docs.sparkSession
        self.signatures = materialize(self._signatures(), "signatures")

    def _signatures(self) -> DataFrame:
        size, percent = self.size, self.percent
        rarity = bucket_counts(
            self.docs.select("text"), lambda batch: np.concatenate([np.empty(0, np.uint64), *_sets(binary_column(batch, "text"), size)]), RARITY_BITS)
        rarity = self.spark.sparkContext.broadcast(rarity)
        kind = dict(self.docs.dtypes)["doc_id"]

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = rarity.value
            for batch in (b.slice(at, BLOCK_ROWS) for b in batches for at in range(0, b.num_rows, BLOCK_ROWS)):
                n, sets, groups, prefixes = [], [], [], []
                ids, texts = batch.column(batch.schema.get_field_index("doc_id")), binary_column(batch, "text")
                for shingles in _sets(texts, size):
                    n.append(len(shingles))
                    if not len(shingles):
                        sets.append(None), groups.append(None), prefixes.append(None)
                        continue
                    length = len(shingles) - (len(shingles) * percent + 99) // 100 + 1
                    count = counts[(shingles >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                    # Sorted by hash already, so a stable sort by count orders by (count, hash).
                    prefix = shingles[np.argsort(count, kind="stable")[:length]]
                    sets.append(_set_id(shingles))
                    groups.append(xxhash.xxh3_128_digest(prefix.tobytes() + len(shingles).to_bytes(8, "little")))
                    prefixes.append(prefix.view(np.int64))
                yield pa.record_batch([
                    ids, pa.array(_row_keys(ids, texts).view(np.int64)),
                    pa.array([hashlib.md5(t or b"", usedforsecurity=False).digest() for t in texts], pa.binary()),
                    pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(groups, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ], ["doc_id", "row_key", "text_key", "n_shingles", "set_id", "group_id", "prefix"])

        return self.docs.mapInArrow(sign, _SIGNATURES.format(kind=kind))

    def shingles_of(self, nodes: DataFrame) -> DataFrame:
        """(set_id, shingles) of the sets in `nodes` (set_id, row_key): their texts are read once more, picked out by a
        fixed-size bit table of row keys, and then joined exactly."""
        bits = self.spark.sparkContext.broadcast(bucket_bits(
            nodes.select("row_key"), lambda batch: mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), ROW_BITS))
        size = self.size

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, BLOCK_ROWS) for b in batches for at in range(0, b.num_rows, BLOCK_ROWS)):
                texts = binary_column(batch, "text")
                keys = _row_keys(batch.column(batch.schema.get_field_index("doc_id")), texts)
                hit = is_set(bits.value, (mix(keys) >> np.uint64(64 - ROW_BITS)).astype(np.int64))
                if len(hit):
                    sets = [s.tobytes() for s in _sets([texts[i] for i in hit], size)]
                    yield pa.record_batch([pa.array(keys[hit].view(np.int64)), pa.array(sets, pa.binary())], ["row_key", "shingles"])

        found = self.docs.mapInArrow(pick, "row_key long, shingles binary")
        # Repeated rows meet on the key they were joined by, so that sets move once.
        return found.join(nodes, "row_key").dropDuplicates(["row_key", "set_id"]).select("set_id", "shingles")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b: set ids) whose sets are similar enough, compared shingle by shingle."""
        pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        sets = materialize(self.shingles_of(self.nodes.join(ids, "set_id").select("set_id", "row_key")), "sets")
        both = pairs.join(sets.toDF("a", "left_set"), "a").join(sets.toDF("b", "right_set"), "b")
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, BLOCK_ROWS) for b in batches for at in range(0, b.num_rows, BLOCK_ROWS)):
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        links = both.select("a", "b", "left_set", "right_set").mapInArrow(compare, "a binary, b binary")
        return materialize(links, "verified")

    def _fits(self, a: str, b: str) -> Column:
        """Size and position bounds of two sets that share a shingle, from columns n, at and live with these endings.

        `at` is the shingle's place in the rarity order of a set and `live` the number of shingles before it that can be
        common at all: those that another component has in a prefix, too.
        """
        n_a, at_a, live_a, n_b, at_b, live_b = (F.col(f"{c}_{side}") for side in (a, b) for c in ("n", "at", "live"))
        most = F.least(live_a, live_b) + 1 + F.least(n_a - at_a - 1, n_b - at_b - 1)
        return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * self.percent) & (most >= needed_overlap(n_a, n_b, self.percent))

    def _needed_shared(self, n_a: Column, n_b: Column) -> Column:
        """Smallest number of prefix shingles that two similar sets share: beyond the shorter-lived prefix at most the rest of a set can match."""
        rest = F.floor((F.greatest(n_a, n_b) * self.percent + 99) / 100) - 1
        return F.greatest(needed_overlap(n_a, n_b, self.percent) - rest, F.lit(1))

    def links(self) -> DataFrame:
        """Links (a, b) between set ids; their components are those of all pairs that are similar enough."""
        sets = self.signatures.where("n_shingles > 0")
        self.nodes = materialize(
            sets.groupBy("set_id", "group_id", "n_shingles").agg(F.min("row_key").alias("row_key")), "nodes")
        groups = sets.select(F.xxhash64("group_id").alias("g"), "group_id", "prefix").dropDuplicates(["group_id"])
        # Between groups: the shingles that at least two prefixes share.
        postings = groups.select("g", F.posexplode("prefix").alias("at", "token"))
        shared = F.count("*").over(Window.partitionBy("token"))
        open_ = self._packed(postings.withColumn("shared", shared).where("shared > 1"))
        # Inside a group: all against its first member.
        leads = self.nodes.groupBy("group_id").agg(F.min("set_id").alias("lead"), F.count("*").alias("members"))
        members = self.nodes.join(leads.where("members > 1"), "group_id").where("set_id <> lead")
        wanted = members.select(F.col("lead").alias("a"), F.col("set_id").alias("b"))
        roots, links = self.spark.createDataFrame([], "node binary, root binary"), None
        rooted, spans = self._spans(roots)
        for turn in range(MAX_STAR_ROUNDS):
            pairs = materialize(wanted.unionAll(self._star(open_, spans, turn)).distinct(), "pairs")
            compared, found = pairs.count(), self.verified(pairs)
            links = found if links is None else links.unionAll(found)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found))
            wanted = pairs.limit(0)
            rooted, spans = self._spans(roots)
            open_ = self._open(open_, spans)
            # Another round is worth it only while rounds link a fair part of what they compare, and while pairs that the full
            # join would make far outnumber the postings.
            if found.count() * 20 < compared or not self._crowded(open_, spans):
                break
        # What is still apart: members of one group, then groups that meet on a shingle, each pair in full.
        left, right = rooted.toDF("a", "root_a", "g"), rooted.toDF("b", "root_b", "g")
        inner = left.join(spans.where("low <> high").select("g"), "g").join(right, "g").where("a < b AND root_a <> root_b").select("a", "b")
        rows = self._postings(open_, spans.select("g", "n", "low", "high"))
        x, y = rows.toDF(*[f"{c}_a" for c in rows.columns]), rows.toDF(*[f"{c}_b" for c in rows.columns])
        # The first open shingle that two similar sets share has all others that they share behind it.
        least = self._needed_shared(F.col("n_a"), F.col("n_b"))
        met = x.join(y, (F.col("token_a") == F.col("token_b")) & (F.col("g_a") < F.col("g_b"))
                     & ((F.col("low_a") != F.col("high_b")) | (F.col("high_a") != F.col("low_b")))
                     & self._fits("a", "b") & (F.least("later_a", "later_b") >= least - 1))
        met = materialize(met.select(F.col("g_a").alias("a"), F.col("g_b").alias("b")).distinct(), "met")
        tokens = open_.join(spans.select("g", "n"), "g").select("g", "n", F.col("postings.token").alias("tokens"))
        enough = met.join(tokens.toDF("a", "n_a", "tokens_a"), "a").join(tokens.toDF("b", "n_b", "tokens_b"), "b").where(
            F.size(F.array_intersect("tokens_a", "tokens_b")) >= least)
        outer = enough.select(F.col("a").alias("g_a"), F.col("b").alias("g_b")).join(
            rooted.toDF("a", "root_a", "g_a"), "g_a").join(rooted.toDF("b", "root_b", "g_b"), "g_b")
        rest = self.verified(inner.unionAll(outer.where("root_a <> root_b").select("a", "b")))
        return links.unionAll(rest)

    def _crowded(self, open_: DataFrame, spans: DataFrame) -> bool:
        """Whether pairs on open shingles far outnumber the postings, counting shingles with enough others behind them to be the
        first that sets of equal size share."""
        pairs = lambda kept: F.sum(F.aggregate(kept, F.lit(0.0), lambda s, p: s + (p.shared - 1) / 2))
        held, met = open_.agg(F.sum(F.size("postings").cast("double")), pairs(F.col("postings"))).first()
        if not held or met <= 4 * held:
            return False
        first = F.size("postings") - self._needed_shared(F.col("n"), F.col("n")).cast("int") + 1
        early = open_.join(spans.select("g", "n"), "g").agg(pairs(F.slice("postings", 1, F.greatest(first, F.lit(0))))).first()[0]
        return early > 4 * held

    def _spans(self, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(set_id, root, g) of all sets, and of each group g: its size n, its first member (lead) with the component of that (own),
        and the least and largest component of its members (low, high). Components are told apart by 64-bit hashes of their roots."""
        nodes = self.nodes.select("set_id", "n_shingles", F.xxhash64("group_id").alias("g"))
        rooted = materialize(self._rooted(nodes, roots), "rooted")
        spans = rooted.withColumn("own", F.xxhash64("root")).groupBy("g").agg(
            F.min("n_shingles").cast("int").alias("n"), F.min("set_id").alias("lead"), F.min_by("own", "set_id").alias("own"),
            F.min("own").alias("low"), F.max("own").alias("high"))
        return rooted.select("set_id", "root", "g"), materialize(spans, "spans")

    def _star(self, open_: DataFrame, spans: DataFrame, turn: int) -> DataFrame:
        """Pairs of set ids: on each open shingle every lead with the hub, the lead whose open shingles have the most postings.

        Such a lead is closest to the text that near copies come from. In later turns chance has a say as well.
        """
        chance = F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20) if turn else F.lit(1.0)
        weight = F.aggregate("postings", F.lit(0.0), lambda s, p: s + p.shared) * chance
        rows = self._postings(open_.withColumn("weight", weight), spans.select("g", "n", "own"))
        hub = F.max(F.struct("weight", "g", "n", "at", "live", "own")).over(Window.partitionBy("token"))
        star = rows.withColumn("hub", hub).select(
            F.col("hub.g").alias("a"), F.col("g").alias("b"), "own", F.col("hub.own").alias("own_a"),
            *[F.col(f"hub.{c}").alias(f"{c}_a") for c in ("n", "at", "live")], *[F.col(c).alias(f"{c}_b") for c in ("n", "at", "live")],
        ).where((F.col("own_a") != F.col("own")) & self._fits("a", "b"))
        enough = self._enough(star).select(F.col("a").alias("g_a"), F.col("b").alias("g_b"))
        lead = spans.select("g", "lead")
        return enough.join(lead.toDF("g_a", "a"), "g_a").join(lead.toDF("g_b", "b"), "g_b").select("a", "b")

    def _enough(self, met: DataFrame) -> DataFrame:
        """Pairs that share enough prefix shingles."""
        return met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")).where(
            F.col("shared") >= self._needed_shared(F.col("n_a"), F.col("n_b")))

    @staticmethod
    def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
        return nodes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
            "set_id", F.coalesce("root", "set_id").alias("root"), *[c for c in nodes.columns if c != "set_id"])

    @staticmethod
    def _packed(rows: DataFrame) -> DataFrame:
        """Postings (g, at, token, shared) as one row a group, written out: a round then moves a group's name once, not once a shingle."""
        return materialize(rows.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("at", "token", "shared"))).alias("postings")), "open")

    @staticmethod
    def _postings(open_: DataFrame, spans: DataFrame) -> DataFrame:
        """Packed postings and the columns of `spans` as rows again; added is the number of the group's open shingles before each (live) and after it (later)."""
        rows = open_.join(spans, "g").withColumn("live_all", F.size("postings"))
        others = [c for c in rows.columns if c not in ("postings", "live_all")]
        return rows.select(*others, "live_all", F.posexplode("postings").alias("live", "p")).select(
            *others, "live", (F.col("live_all") - F.col("live") - 1).alias("later"), "p.at", "p.token")

    def _open(self, open_: DataFrame, spans: DataFrame) -> DataFrame:
        """Packed postings on the shingles where more than one component still meets, with the number of the shingle's postings (shared).
        Components only grow, so what is left out stays out."""
        on_token = Window.partitionBy("token")
        rows = self._postings(open_, spans.select("g", "low", "high")).select("g", "low", "high", "at", "token")
        met = rows.withColumns({
            "least": F.min("low").over(on_token), "most": F.max("high").over(on_token), "shared": F.count("*").over(on_token)})
        return self._packed(met.where("least <> most"))

    def classes(self) -> DataFrame:
        """Per row: doc_id, n_shingles, component_id, the smallest doc_id that links reach, text_key, and root, the set that names the
        class. Classes under one repeated doc_id, or without any, share a component_id but not a root.

        Null and empty texts and texts without words have no shingles and no links: their own doc_id. Texts with fewer words
        than a shingle are one shingle. Equal sets are linked; null ids are never the smallest unless there is no other.
        Repeated rows are all kept. An empty table gives no rows.
        """
        signatures = self.signatures
        roots = components(self.links())
        least = signatures.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
        rooted = materialize(self._rooted(least, roots), "least")
        smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = materialize(rooted.join(smallest, "root").select("set_id", "root", "component_id"), "components")
        joined = signatures.select("doc_id", "n_shingles", "set_id", "text_key").join(named, "set_id", "left")
        return joined.select(
            "doc_id", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key", "root")


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """Classes of `docs` under links of at least 80 percent of common five-word shingles; see JaccardJoin."""
    return JaccardJoin(docs, **options).classes().drop("text_key", "root")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one row of each class: the one with the smallest id (null ids last), of equal ids the one with the smallest text digest.

    Unlinked texts under one id, or without ids, are classes of their own. Rows without shingles are in no class and all stay. Of wholly repeated rows of a class one stays.
    """
    classes = JaccardJoin(docs, key, text, **options).classes()
    linked = classes.where("n_shingles > 0 AND doc_id <=> component_id")
    first = materialize(linked.groupBy("root").agg(F.min("component_id").alias("__id"), F.min("text_key").alias("__text")), "first")
    digest = F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")))
    same = docs[key].eqNullSafe(F.col("__id")) & (digest == F.col("__text"))
    alone = classes.where("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct()
    wanted = materialize(first.select("__id", "__text").union(alone), "wanted")
    kept = docs.join(wanted, same, "left_semi")
    repeated = materialize(linked.groupBy("doc_id", "text_key").count().where("count > 1").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")), "repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").dropDuplicates([key, text])
        kept = kept.join(repeated, same, "left_anti").select(*docs.columns).union(once.select(*docs.columns))
    return kept.select(*docs.columns)
