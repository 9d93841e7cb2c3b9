import hashlib
import sys
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark import cloudpickle
from pyspark.sql import functions as F

from clustrum.functions.text import WORD_PATTERN
from clustrum.operators import keywords, models
from clustrum.operators.cleaning import ContractError
from clustrum.operators.geometry import centroids_of, inertia
from clustrum.operators.keywords import ctfidf_keywords, term_frequency
from clustrum.operators.partitions import sweep_aggregate, pairwise_ari
from clustrum.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class NumberEncoder:
    """Direction from the number in the text: three groups with a little noise."""

    def encode(self, texts):
        numbers = np.array([int(t.split()[-1]) for t in texts])
        out = np.zeros((len(texts), 6))
        out[np.arange(len(texts)), numbers % 3] = 1
        out[:, 3] = (numbers % 5) * 0.02
        return out


@pytest.fixture(scope="module")
def encoded(spark):
    rows = spark.range(60).select("id", F.concat(F.lit("review "), F.col("id")).alias("text"))
    return models.encode_texts(rows, NumberEncoder).drop("text").cache()


def test_encoder_plugs_in_and_unit_length(spark, encoded):
    lengths = [np.linalg.norm(r.embedding) for r in encoded.collect()]
    assert lengths == pytest.approx([1] * 60, abs=1e-6) and dict(encoded.dtypes)["embedding"] == "array<float>"


class BrokenEncoder:
    def __init__(self, value):
        self.value = value

    def encode(self, texts):
        return np.full((len(texts), 2), self.value)


@pytest.mark.parametrize("value", [0.0, float("nan")])
def test_bad_encoder_output_stops(spark, value):
    rows = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(Exception, match="invalid embeddings"):
        models.encode_texts(rows, lambda: BrokenEncoder(value)).collect()


@pytest.mark.parametrize("method", models.METHODS)
def test_fit_recovers_groups_and_inference_never_fits(spark, encoded, method):
    centroids, labelled, cost = models.fit_and_assign(encoded, method, n_clusters=3, n_init=3, max_iter=30)
    groups = labelled.groupBy((F.col("id") % 3).alias("g")).agg(F.count_distinct("cluster_id").alias("n")).collect()
    assert [r.n for r in groups] == [1, 1, 1] and labelled.select("cluster_id").distinct().count() == 3
    if method == "spherical_kmeans":
        assert inertia(encoded, centroids).first().inertia == pytest.approx(cost, rel=1e-4)
        norms = [np.linalg.norm(r.centroid) for r in centroids.collect()]
        assert norms == pytest.approx([1] * 3)
    repeat, _ = models.kmeans_fit(encoded, method, n_clusters=3, n_init=3, max_iter=30)
    assert np.allclose(sorted(map(tuple, (r.centroid for r in repeat.collect()))), sorted(map(tuple, (r.centroid for r in centroids.collect()))))


def test_fit_refuses_bad_options(spark, encoded):
    for options in (dict(method="dbscan"), dict(n_init=0), dict(max_iter=0), dict(n_clusters=61)):
        with pytest.raises(ValueError):
            models.kmeans_fit(encoded, **options)


@pytest.mark.parametrize("mode,rows", [("statistical", 2), ("algorithmic", 3), ("global", 2)])
def test_stability_modes(spark, encoded, mode, rows):
    repeats = 3 if mode == "algorithmic" else 2
    out = models.evaluate_stability(encoded, "id", mode=mode, n_repeats=repeats, n_clusters=3, n_init=2, max_iter=20).collect()
    assert len(out) == rows and all(r.ari == pytest.approx(1.0) and r["mode"] == mode for r in out)
    expected = 60 if mode == "algorithmic" else None
    assert all(expected in (None, r.n_common) for r in out)


def test_stability_refuses(spark, encoded):
    for options in (dict(mode="other"), dict(n_repeats=1), dict(sample_fraction=0)):
        with pytest.raises(ValueError):
            models.evaluate_stability(encoded, "id", **options)


def test_sweep_scores_held_out_rows_only(spark, encoded):
    train, held = encoded.filter("id < 40"), encoded.filter("id >= 40")
    runs, labels = models.sweep({"e": train}, {"e": held}, "id", methods=["spherical_kmeans"], n_clusters=3, n_init=1, max_iter=10)
    assert runs.count() == 5 and labels.filter("id < 40").count() == 0 and labels.count() == 100
    pairs = pairwise_ari(labels, ["encoder", "method"], "id")
    row = sweep_aggregate(runs, pairs, ["encoder", "method"]).first()
    assert row.eligible and row.ari_pairs == 10 and -1 <= row.silhouette_mean <= 1


def test_frozen_model_round_trip_and_refusals(spark, encoded, tmp_path):
    centroids = centroids_of(encoded.withColumn("cluster_id", (F.col("id") % 3).cast("int")))
    path = str(tmp_path / "model")
    config = {"method": "spherical_kmeans", "note": "été"}
    identity = models.freeze_model(centroids, config, path)
    loaded, manifest = models.load_frozen(spark, path, identity, 6)
    assert manifest["n_clusters"] == 3 and loaded.count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        models.freeze_model(centroids, config, path)
    for arguments in (("0" * 64, 6), (identity, 7)):
        with pytest.raises(ContractError):
            models.load_frozen(spark, path, *arguments)
    other = str(tmp_path / "other")
    centroids.coalesce(1).withColumn("centroid", F.reverse("centroid")).write.parquet(f"{other}/centroids")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
    with pytest.raises(ContractError, match="checksum"):
        models.load_frozen(spark, other)


def test_words_of_a_text_are_those_of_the_pattern():
    every = "".join(f"a{chr(i)}b {chr(i)} {chr(i) * 2}. " for i in range(0x3200) if not 0xD800 <= i < 0xE000)
    texts = ["", "x", "Été, l'été_2 à la MER; x mer", "« œuvre » – d’un “mot” 中文 字 Ⅷ½ ٣٤", "ab\x85cd\xa0ef\u2028gh\x1cij", "İx ẞẞ ǅ", "ªº µ ²³", every]
    texts += [every[i:i + 40] for i in range(0, len(every), 40)]
    encoder = models.HashedWordEncoder(16)
    for text in texts:
        words = regex.findall(WORD_PATTERN, text.lower())
        assert [w for w in (w.decode("latin-1") if isinstance(w, bytes) else w for w in models._raw_words(text.lower())) if len(w) > 1] == words
        wanted = np.zeros(16)
        for w in words:
            wanted[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        wanted[0] += not words
        assert (encoder.encode([text])[0] == wanted).all()


def test_a_sweep_encodes_no_other_cohorts_and_shares_its_passes(spark, sf, monkeypatch):
    from clustrum.operators import kmeans
    from clustrum.plans import models as plans

    written, fits, lloyd = [], [], kmeans.lloyd
    monkeypatch.setattr(plans, "materialize", lambda df, name: (written.append(materialize(df, name)), written[-1])[1])
    monkeypatch.setattr(kmeans, "lloyd", lambda vectors, centers, *rest: (fits.append(len(centers)), lloyd(vectors, centers, *rest))[1])
    runs = plans.sweep_query(spark, sf)
    cohorts = {r.cohort for d in written for r in d.select("cohort").distinct().collect()}
    # Two encoders, two methods; each fit is of both seeds.
    assert cohorts == {"training", "selection"} and runs.count() == 8 and fits == [2, 2, 2, 2]
    alone = written[0].filter("cohort = 'training'")
    for r in runs.filter("encoder = 'small'").collect():
        assert models.kmeans_fit(alone, r.method, n_clusters=4, n_init=1, max_iter=15, seed=r.seed)[1] == pytest.approx(r.inertia, rel=1e-12)


def test_terms_of_a_block_are_folded_as_columns(spark):
    texts = ["été, l'été_2 à la mer; x mer mer", None, "", "?! ...", "mer mer  42\n日本語 mer", "é"]
    clusters, stop = [3, 3, 7, 7, 7, 7], ["la"]
    wanted = {}
    for cluster, text in zip(clusters, texts):
        words = [w for w in regex.findall(WORD_PATTERN, text or "") if w not in stop]
        for term in words + [" ".join(p) for p in zip(words, words[1:])]:
            wanted[cluster, term] = wanted.get((cluster, term), 0) + 1
    found = keywords._folded_terms(pa.array(clusters), pa.array([t or "" for t in texts]), stop).to_pylist()
    assert {(r["cluster"], r["term"]): r["tf"] for r in found} == wanted and len(found) == len(wanted) > 10
    assert keywords._folded_terms(pa.array([1]), pa.array(["a . -"]), stop).num_rows == 0


def test_a_model_is_frozen_as_it_was_computed_once(spark, tmp_path):
    # Every computation of these centroids gives other last digits.
    noise = F.udf(lambda: time.time_ns() % 1000 * 1e-15, "double").asNondeterministic()
    centroids = spark.range(3).select(F.col("id").cast("int").alias("cluster_id"), F.array(F.lit(1.0), noise()).alias("centroid"))
    identity = models.freeze_model(centroids, {"method": "kmeans"}, str(tmp_path / "model"))
    loaded, manifest = models.load_frozen(spark, str(tmp_path / "model"), identity, 2)
    assert loaded.count() == 3 and models.centroid_digest(loaded) == manifest["checksum"]


def density_by_hand(points, radius, near, smallest):
    cells = {}
    for i, p in enumerate(points):
        cells.setdefault(tuple(int(np.floor(x / radius)) for x in p), []).append(i)
    touching = lambda a, b: all(abs(x - y) <= 1 for x, y in zip(a, b))
    dense = [c for c in cells if sum(len(v) for d, v in cells.items() if touching(c, d)) >= near]
    group = {c: c for c in dense}
    changed = True
    while changed:
        changed = False
        for a in dense:
            for b in dense:
                if touching(a, b) and group[b] < group[a]:
                    group[a], changed = group[b], True
    return cells, group


def test_density_clusters_equal_a_cell_by_cell_search(spark):
    rng = np.random.default_rng(6)
    blobs = [rng.normal(c, 0.25, (80, 2)) for c in ((0, 0), (4, 4), (0, 6))]
    chain = np.stack([np.linspace(8, 14, 120), np.full(120, -3.0)], axis=1)
    lonely = rng.uniform(-20, -10, (15, 2))
    points = np.concatenate([*blobs, chain, lonely])
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    out = models.density_cluster(frame, "id", "v", 0.5, 8, 40).toPandas().set_index("id").cluster_id
    cells, group = density_by_hand(points, 0.5, 8, 40)
    roots = {}
    for cell, root in group.items():
        roots.setdefault(root, set()).update(cells[cell])
    found = [set(out.index[out == k]) for k in sorted(set(out) - {-1})]
    kept = [r for r in roots.values()]
    assert len(found) == 4 and sorted(map(len, found), reverse=True) == list(map(len, found))
    for members in kept:
        assert len({out[i] for i in members}) == 1
    assert all(out[i] == -1 for i in range(len(points) - 15, len(points)))


def test_density_clusters_use_every_coordinate(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(0, 0.05, (120, 6))
    points[60:, 5] += 100.0
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    out = models.density_cluster(frame, "id", "v", 1.0, 5, 10).toPandas().set_index("id").cluster_id
    assert len({out[i] for i in range(60)}) == len({out[i] for i in range(60, 120)}) == 1 and out[0] != out[60]


def test_pca_keeps_rows(spark, encoded):
    out = models.reduce_dimensions(encoded, 3)
    assert {len(r.reduced) for r in out.collect()} == {3} and out.count() == 60


def test_language_detection(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    out = models.language_detect(documents, models.language_profiles(documents))
    assert out.filter("detected = lang").count() / out.count() > 0.9
    empty = spark.createDataFrame([("",), (None,)], "text string")
    assert [r.detected for r in models.language_detect(empty, models.language_profiles(documents)).collect()] == ["NA", "NA"]


def test_keywords_skip_noise_and_join_neighbours_over_stop_words(spark):
    rows = pd.DataFrame({"text": ["livraison de qualité", "livraison rapide", "aujourd'hui retard", " ", "bruit"], "cluster_id": [0, 0, 1, 1, -1]})
    out = ctfidf_keywords(spark.createDataFrame(rows), stop_words=["de", "aujourd'hui"], top_n=3).collect()
    terms = {(r.cluster, r["rank"]): r.term for r in out}
    assert terms[0, 1] == "livraison" and "livraison qualité" in {r.term for r in out} and "bruit" not in {r.term for r in out}
    assert [r.term for r in out if r.cluster == 1] == ["retard"]
    # livraison: 2 of 6 terms of its cluster, 2 in all; clusters hold 6 and 1 terms, 3 (rounded down) on average.
    assert next(r.score_ctfidf for r in out if r.term == "livraison") == pytest.approx(2 / 6 * np.log(1 + 3 / 2))
    assert ctfidf_keywords(spark.createDataFrame(rows).filter("cluster_id < 0")).count() == 0
    counts = {r.term: r.n for r in term_frequency(spark.createDataFrame([("Colis colis a@b.fr http://colis.fr/x 12 ok être",)], "text string")).collect()}
    assert counts == {"colis": 2}
