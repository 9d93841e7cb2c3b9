"""Encoding, fitting, freezing and sweeping clustering models."""
from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clustrum.functions.text import WORD_PATTERN, clean_text, trigrams
from clustrum.functions.vectors import as_vector, centroid_matrix, listed_rows, stacked_rows
from clustrum.operators import kmeans
from clustrum.operators.cleaning import ContractError
from clustrum.operators.geometry import MAX_CLUSTERS, assign_clusters, cluster_sums, inertia, silhouette_cosine
from clustrum.operators.ordering import global_index
from clustrum.operators.partitions import compare_partitions
from clustrum.operators.sampling import fraction_subset
from clustrum.session import bounded_collect, materialize

METHODS = ("kmeans", "spherical_kmeans")


@cache
def _is_word_character(character: str) -> bool:
    return regex.fullmatch(WORD_PATTERN, character * 2) is not None


#: Bytes of word characters as they are, all others as spaces: of Latin-1, and of the ASCII part of UTF-8.
LATIN_WORDS = bytes(i if _is_word_character(chr(i)) else 32 for i in range(256))
ASCII_WORDS = LATIN_WORDS[:128] + bytes(range(128, 256))


def _raw_words(lowered: str) -> list[str] | list[bytes]:
    """What `WORD_PATTERN` finds in a text, and its single word characters: as Latin-1 bytes where the text has no other
    characters, else as strings."""
    try:
        return lowered.encode("latin-1").translate(LATIN_WORDS).split()
    except UnicodeEncodeError:
        for character in set(lowered):
            if not character.isascii() and not _is_word_character(character):
                lowered = lowered.replace(character, " ")
        return lowered.encode().translate(ASCII_WORDS).decode().split()


class _WordSlots(dict):
    """Slot of a word, hashed when it is first met; one more for what is shorter than two characters and no word."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, raw: str | bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        word = raw.decode("latin-1") if isinstance(raw, bytes) else raw
        slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimension if len(word) > 1 else self.dimension
        self[raw] = slot
        return slot


class HashedWordEncoder:
    """Deterministic stand-in for a pretrained encoder: word counts in hashed slots, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self._slots = _WordSlots(dimension)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            words = _raw_words(text.lower())
            slots = np.fromiter(map(self._slots.__getitem__, words), np.intp, len(words))
            out[row] = np.bincount(slots, minlength=self.dimension + 1)[:-1]
            if not out[row].any():  # a text without words still needs a direction
                out[row, 0] = 1
        return out


def encode_texts(
    df: DataFrame,
    encoder: Callable[[], object] = HashedWordEncoder,
    text: str = "text",
    name: str = "embedding",
    batch_size: int = 64,
) -> DataFrame:
    """Adds unit `array<float>` embeddings. `encoder()` is built once per Python worker and needs
    `encode(list[str]) -> matrix`; batches bound what a worker holds."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder()
        for texts in batches:
            values = texts.to_pylist()
            blocks = []
            for start in range(0, len(values), batch_size):
                block = np.asarray(model.encode(values[start:start + batch_size]), dtype=np.float64)
                lengths = np.linalg.norm(block, axis=1, keepdims=True)
                if not np.isfinite(block).all() or (lengths == 0).any():
                    raise ValueError("encoder returned invalid embeddings")
                blocks.append((block / lengths).astype(np.float32))
            yield listed_rows(np.concatenate(blocks) if blocks else np.zeros((0, 1), dtype=np.float32))

    # Marked so that no later filter or explode makes the optimizer run the encoder a second time.
    # Filters on other columns therefore belong before this call.
    return df.withColumn(name, encode.asNondeterministic()(clean_text(text)))


def kmeans_fit(
    df: DataFrame,
    method: str = "spherical_kmeans",
    n_clusters: int = 10,
    n_init: int = 10,
    max_iter: int = 300,
    seed: int = 42,
    vector: str = "embedding",
    tol: float = 1e-6,
    initial: DataFrame | None = None,
) -> tuple[DataFrame, float]:
    """Best of `n_init` runs by inertia: centroids (`cluster_id`, `centroid`) and that inertia.

    All runs share each pass over the vectors (`operators.kmeans`). There are always `n_clusters` centroids: a cluster that
    loses its rows takes the farthest one. `initial` gives the start instead, as centroids 0..k-1.
    """
    return kmeans_fits(df, method, [seed], n_clusters, n_init, max_iter, vector, tol, initial)[0]


def kmeans_fits(
    df: DataFrame,
    method: str = "spherical_kmeans",
    seeds: Sequence[int] = (42,),
    n_clusters: int = 10,
    n_init: int = 10,
    max_iter: int = 300,
    vector: str = "embedding",
    tol: float = 1e-6,
    initial: DataFrame | None = None,
) -> list[tuple[DataFrame, float]]:
    """What `kmeans_fit` finds for each of the seeds, in passes that all of them share."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if n_init < 1 or max_iter < 1 or n_clusters < 1:
        raise ValueError("n_clusters, n_init and max_iter must be positive")
    start = None if initial is None else centroid_matrix(initial)
    fits = kmeans.fit_seeds(
        df, n_clusters if start is None else len(start), n_init, max_iter, seeds, tol, method == "spherical_kmeans", vector, start)
    schema = "cluster_id int, centroid array<double>"
    return [(df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], schema), cost) for centers, cost, _ in fits]


def fit_and_assign(df: DataFrame, method: str, vector: str = "embedding", **options) -> tuple[DataFrame, DataFrame, float]:
    """Centroids, the rows with their cluster, and the training inertia."""
    centroids, cost = kmeans_fit(df, method, vector=vector, **options)
    return centroids, label_rows(df, centroids, method, vector), cost


def label_rows(df: DataFrame, centroids: DataFrame, method: str, vector: str = "embedding") -> DataFrame:
    """Nearest centroid by cosine, or by Euclidean distance for plain k-means."""
    if method == "spherical_kmeans":
        return assign_clusters(df, centroids, vector)
    # argmin |x - c|^2 = argmax x.c - |c|^2 / 2: one extra coordinate turns it into a product.
    lifted = centroids.withColumn("centroid", F.concat(
        "centroid", F.array(-F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x) / 2)
    ))
    wide = df.withColumn("_lifted", F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0))))
    return assign_clusters(wide, lifted, "_lifted").drop("_lifted")


# What differs between the two partitions of a comparison: the drawn rows, the seed of the fit, or both.
STABILITY_MODES = ("statistical", "algorithmic", "global")


def _stability_plan(mode: str, n_repeats: int, seed: int) -> tuple[list[tuple[int, str | None, int]], list[tuple[int, int]]]:
    """Fits as (repeat, side of the draw or None for all rows, seed), and the pairs of fits to compare by position."""
    if mode == "algorithmic":
        return [(i, None, seed + i) for i in range(n_repeats)], list(combinations(range(n_repeats), 2))
    seeds = iter(range(seed, seed + 2 * n_repeats))
    fits = [(i, side, seed if mode == "statistical" else next(seeds)) for i in range(n_repeats) for side in "ab"]
    return fits, [(k, k + 1) for k in range(0, len(fits), 2)]


def evaluate_stability(
    df: DataFrame,
    id_column: str,
    method: str = "spherical_kmeans",
    mode: str = "statistical",
    n_repeats: int = 10,
    sample_fraction: float = 0.8,
    seed: int = 42,
    vector: str = "embedding",
    **options,
) -> DataFrame:
    """ARI of the partitions of independent fits: on two draws of rows (`statistical`), with other seeds (`algorithmic`), or both
    (`global`). One row per comparison, over the rows that both fits have.

    All fits are planned first and their labels go to one table; the comparisons are one aggregate over it.
    """
    if mode not in STABILITY_MODES:
        raise ValueError(f"mode has to be one of {', '.join(STABILITY_MODES)}")
    if n_repeats < 2 or not 0 < sample_fraction <= 1:
        raise ValueError(f"cannot compare {n_repeats} repeats on a share of {sample_fraction}")
    base = materialize(df.select(id_column, vector), "stability-vectors")
    fits, pairs = _stability_plan(mode, n_repeats, seed)
    labels = None
    for number, (repeat, side, fit_seed) in enumerate(fits):
        rows = base if side is None else fraction_subset(base, id_column, sample_fraction, seed, repeat, side)
        _, labelled, _ = fit_and_assign(rows, method, vector, seed=fit_seed, **options)
        one = materialize(labelled.select(F.lit(number).alias("fit"), id_column, F.col("cluster_id").alias("label")), "stability-labels")
        labels = one if labels is None else labels.unionByName(one)
    wanted = df.sparkSession.createDataFrame(
        [(i, j, fits[i][0], fits[j][0]) for i, j in pairs], "fit_a int, fit_b int, repeat_a int, repeat_b int")
    left, right = labels.toDF("fit_a", id_column, "a"), labels.toDF("fit_b", id_column, "b")
    met = left.join(F.broadcast(wanted), "fit_a").join(right, ["fit_b", id_column])
    scores = compare_partitions(met, "a", "b", ["repeat_a", "repeat_b"])
    return scores.withColumns({"method": F.lit(method), "mode": F.lit(mode)})


def sweep(
    train: Mapping[str, DataFrame],
    evaluation: Mapping[str, DataFrame],
    id_column: str,
    methods: Sequence[str] = METHODS,
    seeds: Sequence[int] = (42, 43, 44, 45, 46),
    vector: str = "embedding",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Fits every encoder x method x seed on training rows only and scores it on the held-out ones.

    `train` and `evaluation` map an encoder name to its embeddings. Returns the runs (one row per
    configuration) and their labels in long form.
    """
    spark = next(iter(train.values())).sparkSession
    results, labels = [], None
    for encoder, rows in train.items():
        # Encoded once: every fit and every score of this encoder reads the written tables.
        fitted = materialize(rows.select(id_column, vector), "sweep-train")
        held = materialize(evaluation[encoder].select(id_column, vector), "sweep-evaluation")
        for method in methods:
            # The seeds of a method share the passes over the training rows.
            for seed, (centroids, cost) in zip(seeds, kmeans_fits(fitted, method, seeds, vector=vector, **options)):
                labelled = materialize(label_rows(held, centroids, method, vector), "sweep-labels")
                score = silhouette_cosine(labelled, vector).first()
                results.append((encoder, method, seed, score.silhouette_cosine if score else None, cost))
                one = labelled.select(
                    F.lit(encoder).alias("encoder"), F.lit(method).alias("method"), F.lit(seed).alias("seed"),
                    id_column, F.col("cluster_id").alias("label"),
                )
                labels = one if labels is None else labels.unionAll(one)
    runs = spark.createDataFrame(results, "encoder string, method string, seed int, silhouette double, inertia double")
    return runs, labels


def reduce_dimensions(df: DataFrame, k: int = 15, vector: str = "embedding", name: str = "reduced") -> DataFrame:
    """Principal components: one pass for the covariance (d x d), one to project."""
    features = df.withColumn("_v", as_vector(vector))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(features)
    return model.transform(features).withColumn(name, vector_to_array("_p")).drop("_v", "_p")


def silhouette_squared_euclidean(df: DataFrame, vector: str, label: str = "cluster_id") -> DataFrame:
    """Mean silhouette under squared Euclidean distance, exact in closed form.

    The mean squared distance of x to a cluster is |x|^2 - 2 x.S/n + Q/n with the cluster's vector sum
    S and square sum Q, so k sums are enough.
    """
    assigned = df.filter(F.col(label) >= 0)
    model = {r.cluster_id: r for r in bounded_collect(cluster_sums(assigned, vector, label), MAX_CLUSTERS, "clusters")}
    known = np.array(sorted(model))
    if not 2 <= len(known) < sum(r.n for r in model.values()):
        return df.sparkSession.sql("SELECT CAST(NULL AS DOUBLE) AS silhouette_squared_euclidean")
    counts = np.array([model[x].n for x in known], dtype=np.float64)
    sums = np.stack([np.array(model[x].vector_sum) for x in known])
    squares = np.array([model[x].square_sum for x in known])

    @F.arrow_udf("double")
    def score(vectors: pa.Array, given: pa.Array) -> pa.Array:
        matrix = stacked_rows(vectors)
        own = np.searchsorted(known, given.to_numpy(zero_copy_only=False))
        rows = np.arange(len(matrix))
        totals = (matrix * matrix).sum(axis=1)[:, None] * counts - 2 * matrix @ sums.T + squares
        size = counts[own]
        inside = totals[rows, own] / np.maximum(size - 1, 1)
        means = totals / counts
        means[rows, own] = np.inf
        nearest = means.min(axis=1)
        top = np.maximum(inside, nearest)
        return pa.array(np.where((size > 1) & (top > 0), (nearest - inside) / np.where(top > 0, top, 1), 0.0))

    return assigned.agg(F.avg(score(vector, F.col(label).cast("long"))).alias("silhouette_squared_euclidean"))


def density_cluster(
    df: DataFrame,
    id_column: str,
    vector: str,
    radius: float,
    min_neighbours: int = 10,
    min_cluster_size: int = 50,
    index_axes: int = 3,
) -> DataFrame:
    """Density clusters with noise -1, on grid cells of side `radius` over all coordinates.

    A cell is dense when it and the cells that touch it hold `min_neighbours` rows; touching dense cells form a
    cluster, and a sparse cell joins a touching dense one. Rows are only counted per cell, so a cell with a third of all
    rows is one number: neighbour pairs of rows are never formed. Touching cells are found by an equi-join on the first `index_axes`
    coordinates, which only sets the size of the index, and a test of all others. Clusters below `min_cluster_size`
    become noise. Labels count from 0 by falling size.
    """
    gridded = df.withColumn("_cell", F.transform(vector, lambda x: F.floor(x / radius).cast("long")))
    cells = materialize(gridded.groupBy(F.col("_cell").alias("cell")).agg(F.count(F.lit(1)).alias("n")), "density-cells")
    keys = [f"k{i}" for i in range(index_axes)]
    keyed = cells.select("*", *[F.coalesce(F.get("cell", F.lit(i)), F.lit(0)).alias(k) for i, k in enumerate(keys)])
    shifted = keyed.select(F.col("cell").alias("other"), F.col("n").alias("other_n"), *keys)
    for k in keys:
        shifted = shifted.withColumn("s", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(k, F.col(k) + F.col("s")).drop("s")
    near_by = F.forall(F.zip_with("cell", "other", lambda a, b: F.abs(a - b) <= 1), lambda close: close)
    touching = materialize(keyed.join(shifted, keys).where(near_by).select("cell", "other", "other_n"), "density-touching")
    dense = touching.groupBy("cell").agg(F.sum("other_n").alias("near")).filter(F.col("near") >= min_neighbours).select("cell")
    labelled = materialize(dense.select("cell", F.array_join("cell", ",").alias("label")), "density-labels")
    inner = materialize(
        touching.select("cell", "other").join(labelled.select("cell"), "cell").join(labelled.select(F.col("cell").alias("other")), "other"),
        "density-links")
    changed = True
    while changed:
        low = inner.join(labelled.select(F.col("cell").alias("other"), "label"), "other").groupBy("cell").agg(F.min("label").alias("low"))
        stepped = labelled.join(low, "cell").withColumn("new", F.least("label", "low"))
        # Pointer jump: take over the label that the labelling cell has itself found by now.
        roots = stepped.select(F.array_join("cell", ",").alias("new"), F.col("new").alias("root"))
        jumped = materialize(stepped.join(roots, "new", "left").select(
            "cell", F.least("new", F.coalesce("root", "new")).alias("label"), F.col("label").alias("old")), "density-labels")
        changed = not jumped.filter(F.col("label") != F.col("old")).isEmpty()
        labelled = jumped.drop("old")
    reached = touching.join(labelled.select(F.col("cell").alias("other"), "label"), "other").groupBy("cell").agg(F.min("label").alias("border"))
    assigned = cells.join(labelled, "cell", "left").join(reached, "cell", "left").select(
        "cell", "n", F.coalesce("label", "border").alias("label"))
    sizes = assigned.filter(F.col("label").isNotNull()).groupBy("label").agg(F.sum("n").alias("size")).filter(
        F.col("size") >= min_cluster_size)
    numbered = global_index(sizes.withColumn("falling", -F.col("size")), ["falling", "label"], "cluster_id")
    cell_labels = assigned.join(numbered.select("label", F.col("cluster_id").cast("int").alias("cluster_id")), "label", "left")
    return gridded.join(cell_labels.select(F.col("cell").alias("_cell"), "cluster_id"), "_cell").select(
        id_column, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


PROFILE_SIZE = 300


def language_profiles(df: DataFrame, text: str = "text", language: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """The most frequent character trigrams per language with their rank from 0."""
    counted = (
        df.select(F.col(language).alias("lang"), F.explode(trigrams(F.lower(clean_text(text)))).alias("trigram"))
        .groupBy("lang", "trigram").agg(F.count(F.lit(1)).alias("n"))
    )
    window = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("trigram"))
    return counted.withColumn("position", F.row_number().over(window) - 1).filter(F.col("position") < size).select(
        "lang", "trigram", "position"
    )


def language_detect(df: DataFrame, profiles: DataFrame, text: str = "text", name: str = "detected", size: int = PROFILE_SIZE) -> DataFrame:
    """Adds the language whose trigram ranks are nearest those of the text; `NA` when it has none.

    Profiles are `size` rows per language. A text is ranked where it lies, so the trigrams of the
    table are never shuffled.
    """
    ranks: dict[str, dict[str, int]] = {}
    for r in bounded_collect(profiles, 1000 * size, "profile rows"):
        ranks.setdefault(r.lang, {})[r.trigram] = r.position
    languages = sorted(ranks)

    @F.arrow_udf("string")
    def detect(texts: pa.Array) -> pa.Array:
        found = []
        for value in texts.to_pylist():
            counted = Counter(map("".join, zip(value, value[1:], value[2:])))
            if not counted or not languages:
                found.append("NA")
                continue
            top = sorted(counted.items(), key=lambda item: (-item[1], item[0].encode()))[:size]
            scores = [
                (sum(abs(i - ranks[x].get(t, i + size)) for i, (t, _) in enumerate(top)), x) for x in languages
            ]
            found.append(min(scores)[1])
        return pa.array(found, type=pa.string())

    return df.withColumn(name, detect(F.lower(clean_text(text))))


def model_identity(configuration: Mapping) -> str:
    compact = json.dumps(configuration, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(compact.encode()).hexdigest()


def centroid_digest(centroids: DataFrame) -> str:
    return hashlib.sha256(centroid_matrix(centroids).tobytes()).hexdigest()


def freeze_model(centroids: DataFrame, configuration: Mapping, path: str) -> str:
    """Writes the centroids and a one-row manifest with content ids; never over an existing model.

    The centroids are computed once: sums added up in another order would differ from the checksum in their last bits.
    """
    centroids = materialize(centroids.select("cluster_id", "centroid"), "frozen-centroids")
    matrix = centroid_matrix(centroids)
    identity = model_identity(configuration)
    spark = centroids.sparkSession
    centroids.coalesce(1).write.parquet(f"{path}/centroids", mode="errorifexists")
    checksum = hashlib.sha256(matrix.tobytes()).hexdigest()
    row = (identity, json.dumps(configuration, sort_keys=True, ensure_ascii=False), checksum, *matrix.shape)
    spark.createDataFrame([row], "model_id string, configuration string, checksum string, n_clusters int, n_features int").write.parquet(
        f"{path}/manifest", mode="errorifexists"
    )
    return identity


def load_frozen(spark: SparkSession, path: str, model_id: str | None = None, n_features: int | None = None) -> tuple[DataFrame, dict]:
    """Centroids and manifest; refuses another identity, changed content or another shape."""
    manifest = spark.read.parquet(f"{path}/manifest").first().asDict()
    centroids = spark.read.parquet(f"{path}/centroids")
    matrix = centroid_matrix(centroids)
    if model_identity(json.loads(manifest["configuration"])) != manifest["model_id"] or model_id not in (None, manifest["model_id"]):
        raise ContractError("model identity mismatch")
    if centroid_digest(centroids) != manifest["checksum"]:
        raise ContractError("model checksum mismatch")
    if matrix.shape != (manifest["n_clusters"], manifest["n_features"]) or n_features not in (None, matrix.shape[1]):
        raise ContractError("model shape mismatch")
    return centroids, manifest


def training_inertia(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    return inertia(df, centroids, vector)
