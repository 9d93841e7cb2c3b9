import json

import pytest

from clustrum.operators.cleaning import ContractError
from clustrum.operators.requests import latency_summary, replay_summary
from clustrum.sources import embeddings, requests, reviews

GOOD = ',commentaire\nr0,"line one\nline ""two"""\nr1,NA\nr2, trois \n'


def write(tmp_path, text, name="cohort.csv", bom=False):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


@pytest.mark.parametrize("bom", [False, True])
def test_strict_reader(spark, tmp_path, bom):
    out = reviews.read_reviews_strict(spark, write(tmp_path, GOOD, bom=bom)).orderBy("source_row_index").collect()
    assert [(r.source_row_id, r.source_row_index, r.text) for r in out] == [
        ("r0", 0, 'line one\nline "two"'), ("r1", 1, "NA"), ("r2", 2, " trois ")]


def test_strict_reader_keeps_order_over_files(spark, tmp_path):
    for n in range(3):
        write(tmp_path, ",commentaire\n" + "".join(f"{n}-{i},text {i}\n" for i in range(n + 2)), f"part-{n}.csv")
    out = reviews.read_reviews_strict(spark, str(tmp_path)).orderBy("source_row_index").collect()
    assert [r.source_row_id for r in out] == [f"{n}-{i}" for n in range(3) for i in range(n + 2)]


@pytest.mark.parametrize("text", [
    "id,commentaire\nr0,x\n", ",other\nr0,x\n", ",commentaire\nr0,  \n", ",commentaire\nr0,x\nr0,y\n", ",commentaire\n,x\n",
    ",commentaire\n", ",commentaire\nr0\n", ",commentaire\nr0,x,y\n", ",commentaire\nr0," + "x" * 5001 + "\n",
    ",commentaire,commentaire\nr0,x,y\n",
])
def test_strict_reader_refuses(spark, tmp_path, text):
    with pytest.raises(ContractError):
        reviews.read_reviews_strict(spark, write(tmp_path, text))


def test_strict_reader_refuses_a_file_with_another_header(spark, tmp_path):
    write(tmp_path, ",commentaire\na,x\n", "part-0.csv")
    write(tmp_path, "commentaire,\ny,b\n", "part-1.csv")
    with pytest.raises(ContractError):
        reviews.read_reviews_strict(spark, str(tmp_path))


def test_raw_reader(spark, tmp_path):
    header = "commentaire;titre;auteur;date_avis;date_experience;note;texteServiceReply;url;dateServiceReply;dataServiceReply\n"
    out = reviews.read_raw_reviews(spark, write(tmp_path, header + '"a;\nb";t;x;d;May 05, 2025;4;;u;;\n')).collect()
    assert out[0].commentaire == "a;\nb" and out[0].note == 4 and out[0].dataServiceReply is None


def test_outputs_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x")], "observation_id string, cluster_id int, cohort string")
    for writer, target in ((reviews.write_assignments, "a"), (reviews.write_splits, "s"), (reviews.write_report, "r"), (requests.write_request_log, "l"), (embeddings.write_embeddings, "e")):
        path = str(tmp_path / target)
        writer(rows, path)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
            writer(rows, path)


def test_report_has_null_instead_of_nan(spark, tmp_path):
    path = str(tmp_path / "report")
    reviews.write_report(spark.createDataFrame([(float("nan"), None, 1.5)], "a double, b double, c double"), path)
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [{"a": None, "b": None, "c": 1.5}]


@pytest.mark.parametrize("rows", ["x,1\nx,2\n", "x,-1\n", "x,1.5\n", ",1\n"])
def test_assignments_refused(spark, tmp_path, rows):
    with pytest.raises(Exception):
        reviews.read_assignments(spark, write(tmp_path, "observation_id,cluster_id\n" + rows)).collect()


@pytest.mark.parametrize("bad", [[1.0, 1.0], [float("nan"), 0.0], [1.0], None])
def test_embedding_contract(spark, bad):
    rows = spark.createDataFrame([([1.0, 0.0],), (bad,)], "embedding array<float>")
    with pytest.raises(ContractError):
        embeddings.check_embeddings(rows)


def test_embedding_alignment(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    embeddings.check_alignment(ids("a", "b"), ids("b", "a"), "id", "id")
    for wrong in (ids("a"), ids("a", "b", "b"), ids("a", "c")):
        with pytest.raises(ContractError):
            embeddings.check_alignment(ids("a", "b"), wrong, "id", "id")


def log_row(index, ids, **changes):
    record = lambda i: dict(run_id="run", request_id=f"batch-{index:06d}", source_row_id=i, source_row_index=0, cluster_id=1,
                            model_id="m", request_timestamp="t", request_latency_seconds=1.0, success=True, http_status=200,
                            error_category=None, attempt_count=1)
    row = dict(request_id=f"batch-{index:06d}", run_id="run", kind="prediction", state="complete", source_row_ids=ids,
               attempts=[dict(timestamp="t", latency_seconds=float(index + 1), http_status=200, error_category=None)],
               records=[record(i) for i in ids])
    row.update(changes)
    return row


def read_log(spark, tmp_path, rows):
    folder = tmp_path / "requests"
    folder.mkdir()
    for n, row in enumerate(rows):
        (folder / f"{n}.json").write_text(json.dumps(row, indent=1))
    return requests.read_request_log(spark, str(folder), multi_line=True)


def plan(spark):
    return spark.createDataFrame([("batch-000000", ["a", "b"]), ("batch-000001", ["c", "d"]), ("batch-000002", ["e"])],
                                 "request_id string, source_row_ids array<string>")


def test_request_log_and_summary(spark, tmp_path):
    failed = log_row(1, ["c", "d"])
    for r in failed["records"]:
        r.update(success=False, cluster_id=None, http_status=500, error_category="http_error")
    failed["attempts"] = [dict(timestamp="t", latency_seconds=9.0, http_status=503, error_category="http_error")] * 2
    health = dict(request_id="health-x", run_id="run", kind="health", state="complete", source_row_ids=[], attempts=[failed["attempts"][0]], records=[])
    log = read_log(spark, tmp_path, [log_row(0, ["a", "b"]), failed, log_row(2, ["e"]), health])
    requests.check_request_log(log, plan(spark), "run")
    s = replay_summary(log, 5, 2.0).first()
    assert (s.state, s.attempted_reviews, s.successful_reviews, s.failed_reviews, s.pending_reviews, s.unattempted_reviews) == (
        "completed_with_errors", 5, 3, 2, 0, 0)
    assert (s.http_requests, s.prediction_http_requests, s.health_http_requests, s.successful_reviews_per_second) == (5, 4, 1, 1.5)
    t = latency_summary(log).first()
    assert (t["count"], t["mean"], t.p50, t.p95, t["max"]) == (4, 5.5, 3.0, 9.0, 9.0)


@pytest.mark.parametrize("change", [
    dict(kind="other"), dict(request_id="batch-x"), dict(request_id="batch-000009"), dict(run_id="else"), dict(state="odd"),
    dict(source_row_ids=["b", "a"]), dict(state="pending"), dict(records=[]),
])
def test_request_log_refused(spark, tmp_path, change):
    log = read_log(spark, tmp_path, [log_row(0, ["a", "b"], **change), log_row(1, ["c", "d"])])
    with pytest.raises(ContractError):
        requests.check_request_log(log, plan(spark), "run")


def test_inconsistent_success_and_repeats_refused(spark, tmp_path):
    row = log_row(0, ["a", "b"])
    row["records"][1]["http_status"] = 500
    log = read_log(spark, tmp_path, [row, log_row(1, ["c", "d"]), log_row(1, ["c", "d"])])
    reasons = {r.reason for r in requests.log_violations(log, plan(spark), "run").collect()}
    assert reasons == {"inconsistent_record", "repeated_request"}


def test_pending_rows_are_counted(spark, tmp_path):
    log = read_log(spark, tmp_path, [log_row(0, ["a", "b"]), log_row(1, ["c", "d"], state="pending", records=[])])
    s = replay_summary(log, 5).first()
    assert (s.state, s.pending_reviews, s.unattempted_reviews, s.successful_reviews_per_second) == ("interrupted", 2, 1, None)
