"""The pipeline's stages, each against brute force on its own input."""
import collections
import os
import sys

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.path.dirname(os.path.abspath(__file__))]

import corpus_pipeline  # noqa: E402
from test_llm_join import brute_classes, brute_contamination, words_of  # noqa: E402

from clustrum.llm import mixing, quality, queries  # noqa: E402
from clustrum.session import materialize  # noqa: E402


def test_stages_do_what_their_operators_decide(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    outputs, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "stage")
        outputs.append(docs)
    assert all(o.columns == documents.columns for o in outputs[:-1])
    rows = [[(r.doc_id, r.text) for r in o.select("doc_id", "text").collect()] for o in outputs[:-1]]
    ids = [sorted(i for i, _ in r) for r in rows]

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = quality.score_quality(documents, labels).where("predicted = 1").select("doc_id").collect()
    assert ids[1] == sorted(r.doc_id for r in good) and 0.5 * len(ids[0]) < len(ids[1]) < len(ids[0])

    assert ids[2] == sorted(i for i, _, component in brute_classes(rows[1]) if i == component) and len(ids[2]) < len(ids[1])

    # Only items that share a word sequence of their first window's length can matter: the whole benchmark is searched.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for _, t in items for w in [words_of(t)] for i in range(max(1, len(w) - 9))}
    clean = [i for i, t in rows[2] if not windows & {tuple(words_of(t)[j:j + 10]) for j in range(len(words_of(t)) - 9)}]
    assert ids[3] == sorted(clean) and len(clean) < len(rows[2])
    assert brute_contamination(rows[2][:5], items)[0][0] == rows[2][0][0]

    mixed = mixing.mix(outputs[3], queries.label_domains(labels), queries.DOMAIN_TARGETS).collect()
    assert collections.Counter(ids[4]) == {r.doc_id: r.copies for r in mixed if r.copies}

    final = outputs[-1].collect()
    assert sorted(r.doc_id for r in final) == ids[4]
    slots = collections.defaultdict(list)
    for r in final:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
