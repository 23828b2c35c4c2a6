import json

import pytest
from pyspark.sql import functions as F

from fieldproof.operators import select, validate
from fieldproof.plans import compare, evaluate
from fieldproof.sources import readers, sinks


def dataset(path, rows=None, images=True):
    rows = readers.fixtures() if rows is None else rows
    (path / "images").mkdir(parents=True)
    for r in rows:
        if images and isinstance(r, dict) and r.get("image") and ".." not in r["image"]:
            (path / r["image"]).write_bytes(r["id"].encode())
    (path / "annotations.jsonl").write_text("\n".join(["", *(json.dumps(r) for r in rows)]) + "\n", encoding="utf-8")
    return path / "annotations.jsonl"


def row(**more):
    base = {"id": "a", "image": "images/a.png", "question": "q", "field_schema": {"total": "number"}, "expected_fields": {"total": 12}, "mock_response": {"fields": {"total": "12.0"}}}
    return base | more


def test_dry_run(spark, tmp_path):
    run = evaluate.evaluate(spark, dataset(tmp_path / "d"), tmp_path / "run")
    assert (run["correct_fields"], run["total_fields"], run["document_accuracy"]) == (15, 15, 1.0)
    assert run["claim"].startswith("PIPELINE CHECK ONLY")
    assert list(run["per_field"]) == ["vendor", "document_number", "date", "currency", "total_amount"]
    saved = json.loads((tmp_path / "run/run.json").read_text())
    assert saved["complete"] and len(saved["results"]) == 3
    assert (tmp_path / "run/errors.csv").read_bytes().startswith(b"\xef\xbb\xbfid,image,field")
    assert "15/15" in (tmp_path / "run/summary.md").read_text()
    with pytest.raises(ValueError, match="already exists"):
        evaluate.evaluate(spark, tmp_path / "d/annotations.jsonl", tmp_path / "run")


def test_replay_keeps_failures_in_the_denominator(spark, tmp_path):
    path = dataset(tmp_path / "d", [row(), row(id="b", image="images/b.png", expected_fields={"total": None})])
    first = evaluate.evaluate(spark, path, tmp_path / "one")
    lines = [json.loads(x) for x in (tmp_path / "one/predictions.jsonl").read_text().splitlines()]
    lines[1] |= {"prediction": None, "error": "RuntimeError: gone"}
    (tmp_path / "saved").mkdir()
    (tmp_path / "saved/run.json").write_text(json.dumps(first))
    (tmp_path / "saved/predictions.jsonl").write_text("\n".join(map(json.dumps, lines)))
    run = evaluate.evaluate(spark, path, tmp_path / "two", "replay", tmp_path / "saved/predictions.jsonl")
    assert (run["correct_fields"], run["total_fields"], run["failed_examples"]) == (1, 2, 1)
    assert run["error_categories"] == {"inference_error": 1}
    assert run["configuration"]["source_mode"] == "dry-run"
    assert run["results"][1]["error"] == "ValueError: Recorded failure: RuntimeError: gone"
    with pytest.raises(ValueError, match="Only completed live runs"):
        compare.compare(spark, [tmp_path / "one/run.json", tmp_path / "two/run.json"])
    (tmp_path / "saved/predictions.jsonl").write_text(json.dumps(lines[0]))
    with pytest.raises(ValueError, match="missing selected"):
        evaluate.evaluate(spark, path, tmp_path / "three", "replay", tmp_path / "saved/predictions.jsonl")
    (tmp_path / "saved/predictions.jsonl").write_text("\n".join([json.dumps(lines[0])] * 2))
    with pytest.raises(ValueError, match="Duplicate"):
        evaluate.evaluate(spark, path, tmp_path / "four", "replay", tmp_path / "saved/predictions.jsonl")


class Model:
    def __init__(self, value="12"):
        self.value = value

    def analyze(self, image, question, field_schema):
        if image.endswith("b.png"):
            raise RuntimeError("no answer")
        return {"fields": {"total": self.value}, "review_flags": [{"field": "total", "reason": "amount_has_no_digits", "value": "=x"}]}

    def describe(self):
        return {"model": "stub"}


RECEIPT = {"total_amount": "string or null", "tax_amount": "string or null", "note": "string"}


class Texts:
    """Answers with a model's text; the second reading of the tax, asked for alone, is better than the first."""

    def analyze(self, image, question, field_schema):
        if image.endswith("c.png"):
            return "no object here"
        if list(field_schema) == ["tax_amount"]:
            return '{"fields": {"tax_amount": "1.50"}, "evidence": [{"field": "tax_amount", "text": "PPN 1.50"}], "confidence": 0.9}'
        fields = {"tax_amount": "10%", "total_amount": "15.00", "note": None, "more": 1}
        return "Here:\n```json\n" + json.dumps({"fields": fields, "evidence": [{"field": "tax_amount", "text": "10%"}, {"field": "total_amount", "text": "15.00"}], "answer": "paid", "confidence": 2}) + "\n```"

    def describe(self):
        return {"model": "texts"}


def receipts(path):
    labels = {"total_amount": "15.00", "tax_amount": "1.50"}
    return dataset(path, [row(id=i, image=f"images/{i}.png", field_schema=RECEIPT, expected_fields=labels) for i in "abc"])


def test_live_texts_are_parsed_and_flagged(spark, tmp_path):
    run = evaluate.evaluate(spark, receipts(tmp_path / "d"), tmp_path / "run", "live", analyzer=Texts)
    assert (run["correct_fields"], run["total_fields"], run["failed_examples"], run["review_flagged_examples"], run["rechecked_examples"]) == (2, 6, 1, 2, 0)
    assert list(run["per_field"]) == ["total_amount", "tax_amount"]
    good, _, bad = run["results"]
    assert set(good) == {"id", "image", "prediction", "error", "score", "raw_error_output", "wall_seconds"} and good["error"] is None
    assert good["prediction"]["fields"] == {"tax_amount": "10%", "total_amount": "15.00", "note": None}
    assert good["prediction"]["review_flags"] == [{"field": "tax_amount", "reason": "percentage_is_not_amount", "value": "10%"}]
    assert good["prediction"]["confidence"] == 1.0 and good["prediction"]["raw_output"].startswith("Here:")
    assert list(good["score"]["field_results"].items()) == [("total_amount", True), ("tax_amount", False)]
    assert good["score"]["details"]["tax_amount"] == {"correct": False, "category": "value_mismatch", "expected": "1.50", "predicted": "10%", "expected_present": True}
    assert bad["prediction"] is None and bad["error"] == "OutputParseError: The response did not contain a valid JSON object." and bad["raw_error_output"] == "no object here"
    assert bad["score"]["details"]["total_amount"]["predicted"] is None and bad["score"]["accuracy"] == 0
    sheet = (tmp_path / "run/review-flags.csv").read_text(encoding="utf-8-sig").splitlines()
    assert sheet[1] == 'a,images/a.png,tax_amount,percentage_is_not_amount,"""10%"""' and len(sheet) == 3


def test_second_reading_in_a_run(spark, tmp_path):
    run = evaluate.evaluate(spark, receipts(tmp_path / "d"), tmp_path / "run", "live", analyzer=Texts, policy="invalid-amount-v1")
    assert (run["correct_fields"], run["review_flagged_examples"], run["rechecked_examples"], run["failed_rechecks"]) == (4, 0, 2, 0)
    p = run["results"][0]["prediction"]
    assert p["fields"] == {"tax_amount": "1.50", "total_amount": "15.00", "note": None} and p["review_flags"] == []
    assert p["recheck_attempt"]["accepted_fields"] == ["tax_amount"] and p["recheck_attempt"]["error"] is None
    assert p["initial_prediction"]["fields"]["tax_amount"] == "10%" and p["answer"] == "" and p["confidence"] is None
    assert {e["field"]: e["text"] for e in p["evidence"]} == {"tax_amount": "PPN 1.50", "total_amount": "15.00"}
    assert p["metadata"]["model_calls"] == 2 and p["metadata"]["recheck_policy"] == "invalid-amount-v1"


def test_compare_keeps_label_order_and_reads_records(spark, tmp_path):
    path = receipts(tmp_path / "d")
    evaluate.evaluate(spark, path, tmp_path / "one", "live", analyzer=Texts)
    evaluate.evaluate(spark, path, tmp_path / "two", "live", analyzer=Texts, policy="invalid-amount-v1")
    runs = [tmp_path / "one/run.json", tmp_path / "two/run.json"]
    text = compare.compare(spark, runs)
    assert text.index("| total_amount | 0 | 0 |") < text.index("| tax_amount | 2 | 0 |")
    alone = []
    for i, p in enumerate(runs):
        (tmp_path / f"alone{i}").mkdir()
        alone.append(tmp_path / f"alone{i}/run.json")
        alone[-1].write_bytes(p.read_bytes())
    assert compare.compare(spark, alone) == text
    with pytest.raises(SystemExit) as stop:
        compare.main([str(runs[0])])
    assert stop.value.code == 2


def test_numbers_beyond_a_double_fail(spark, tmp_path):
    path = dataset(tmp_path / "d", [row(), row(id="b", image="images/b.png")])
    evaluate.evaluate(spark, path, tmp_path / "one")
    lines = (tmp_path / "one/predictions.jsonl").read_text().splitlines()
    lines[1] = lines[1].replace('"prediction":{', '"prediction":{"x":[1e999],"y":"1e999",')
    (tmp_path / "one/predictions.jsonl").write_text("\n".join(lines))
    run = evaluate.evaluate(spark, path, tmp_path / "two", "replay", tmp_path / "one/predictions.jsonl")
    assert run["failed_examples"] == 1 and run["results"][1]["error"] == validate.NOT_FINITE


def test_settings():
    s = readers.settings({"MLLM_BACKEND": " Transformers ", "MLLM_LOAD_IN_4BIT": "no", "MLLM_MAX_PIXELS": "300000", "MLLM_API_KEY": "k", "MLLM_LOCAL_MODEL": "m"})
    assert (s.backend, s.load_in_4bit, s.max_pixels, s.api_key, s.local_model) == ("transformers", False, 300000, "k", "m") and "api_key" not in repr(s)
    for bad in ({"MLLM_BACKEND": "x"}, {"MLLM_MIN_PIXELS": "9999999"}, {"MLLM_RECEIPT_RECHECK": "x"}, {"MLLM_API_MODE": "x"}):
        with pytest.raises(ValueError):
            readers.settings(bad)


class Worse(Model):
    def __init__(self):
        super().__init__("13")


def test_live_runs_compare(spark, tmp_path):
    path = dataset(tmp_path / "d", [row(), row(id="b", image="images/b.png")])
    run = evaluate.evaluate(spark, path, tmp_path / "one", "live", analyzer=Model)
    assert (run["correct_fields"], run["failed_examples"], run["review_flagged_examples"]) == (1, 1, 1)
    assert "amount_has_no_digits" in (tmp_path / "one/review-flags.csv").read_text(encoding="utf-8-sig")
    evaluate.evaluate(spark, path, tmp_path / "two", "live", analyzer=Worse)
    text = compare.compare(spark, [tmp_path / "one/run.json", tmp_path / "two/run.json"])
    assert "| total | 0 | 1 |" in text and "| 1 | stub |" in text
    evaluate.evaluate(spark, path, tmp_path / "part", "live", analyzer=Model, limit=1)
    with pytest.raises(ValueError, match="Different document selections"):
        compare.compare(spark, [tmp_path / "one/run.json", tmp_path / "part/run.json"])


BAD = [
    ([row(), row()], ":3: IDs must be"),
    ([row(id=" ")], ":2: IDs must be"),
    ([row(image="")], ":2: Missing image"),
    ([row(question=None)], ":2: Missing question"),
    ([row(expected_fields={})], ":2: field_schema and nonempty"),
    ([row(expected_fields={"other": 1})], ":2: Every label"),
    ([row(expected_fields={"total": "12,34"})], ":2: A label"),
    ([row(expected_fields={"total": True})], ":2: A label"),
    ([row(image="../x.png")], ":2: Image must be inside"),
    ([[1]], ":2: Row must be an object"),
]


@pytest.mark.parametrize("rows, message", BAD)
def test_bad_datasets(spark, tmp_path, rows, message):
    with pytest.raises(ValueError, match=message):
        evaluate.load(spark, dataset(tmp_path / "d", rows))


def test_missing_image_and_empty(spark, tmp_path):
    with pytest.raises(ValueError, match="Image does not exist"):
        evaluate.load(spark, dataset(tmp_path / "d", [row()], images=False))
    with pytest.raises(ValueError):
        evaluate.load(spark, dataset(tmp_path / "e", []))


def test_fingerprint_follows_images_not_selection(spark, tmp_path):
    path = dataset(tmp_path / "d")
    rows, info = evaluate.load(spark, path)
    _, one = evaluate.select(rows, info, 1, 1)
    assert one["fingerprint"] == info["fingerprint"] and one["selected_ids"] == ["receipt-001"]
    for bad in ((-1, None), (0, 0), (9, None)):
        with pytest.raises(ValueError):
            evaluate.select(rows, info, *bad)
    (tmp_path / "d/images/order_001.png").write_bytes(b"other")
    assert evaluate.load(spark, path)[1]["fingerprint"] != info["fingerprint"]


def test_lines_have_physical_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"id": "x"}\r\n\n  \n{"id": "y"}', encoding="utf-8")
    got = readers.jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == [2, 5]


def test_line_numbers_over_many_splits(spark, tmp_path):
    made = [("x" * (i % 37) if i % 5 else "") + ("\x0b" if i % 11 == 0 else "") for i in range(3000)]
    text = "\n".join(made)
    (tmp_path / "a.jsonl").write_text(text, encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("one\n\ntwo", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = readers.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {("a", i, x) for i, x in enumerate(text.splitlines(), 1) if x.strip()} | {("b", 1, "one"), ("b", 3, "two")}
    assert {(r["file"][-7], r["line_no"], r["value"]) for r in got} == want


def test_prepare(spark, tmp_path):
    from fieldproof.plans import prepare

    truths = [json.dumps({"gt_parse": {"total": {"total_price": str(i)}} if i % 3 else {}}) for i in range(7)]
    spark.createDataFrame([((b"img%d" % i,), t) for i, t in enumerate(truths)], "image struct<bytes:binary>, ground_truth string").coalesce(1).write.parquet(str(tmp_path / "tmp"))
    (tmp_path / "corpus").mkdir()
    next((tmp_path / "tmp").glob("*.parquet")).rename(tmp_path / "corpus/test-0.parquet")
    made = prepare.prepare(spark, tmp_path / "corpus", tmp_path / "out", "test", 5, "1" * 40)
    assert made["included_examples"] == 3 and made["source_rows_examined"] == 5 and list(made["source_files_sha256"]) == ["test-0.parquet"]
    rows, info = evaluate.load(spark, tmp_path / "out/annotations.jsonl")
    assert info["examples"] == 3 and (tmp_path / "out/images/doc-test-0004.png").read_bytes() == b"img4"
    for bad in ({"split": "x"}, {"limit": 0}, {"revision": "main"}):
        with pytest.raises(ValueError):
            prepare.prepare(spark, tmp_path / "corpus", tmp_path / "out2", **bad)


def test_corpus_numbers_and_export(spark, tmp_path):
    from fieldproof.operators.parse import map_labels

    truths = [json.dumps({"gt_parse": {"total": {"total_price": str(i)}} if i % 3 else {}}) for i in range(7)]
    for k, part in enumerate((truths[:4], truths[4:])):
        df = spark.createDataFrame([((b"img",), t) for t in part], "image struct<bytes:binary>, ground_truth string").coalesce(1)
        df.write.parquet(str(tmp_path / f"tmp{k}"))
        (tmp_path / "data").mkdir(exist_ok=True)
        next((tmp_path / f"tmp{k}").glob("*.parquet")).rename(tmp_path / f"data/test-{k}.parquet")
    rows = select.numbered(readers.corpus(spark, str(tmp_path / "data"), "test"), ["file", "row_index"], "doc", "test")
    rows = map_labels(select.first_of_source(rows, 5))
    line = rows.withColumn("line", F.to_json(F.struct("id", F.col("expected").alias("expected_fields"))))
    made = sinks.export_dataset(line.where("reject is null"), line.where("reject is not null"), {"split": "test"}, rows.count(), tmp_path / "out")
    assert made["included_examples"] == 3 and [x["id"] for x in made["excluded"]] == ["doc-test-0000", "doc-test-0003"]
    assert json.loads((tmp_path / "out/annotations.jsonl").read_text().splitlines()[-1]) == {"id": "doc-test-0004", "expected_fields": {"total_amount": "4"}}


def test_integrity(spark, tmp_path):
    import hashlib

    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.bin").write_bytes(b"abc")
    blob = hashlib.sha1(b"blob 3\0abc").hexdigest()
    files = [{"file": "a.bin", "size": 3, "checksum": blob}, {"file": "b.bin", "size": 1, "checksum": "0" * 64}, {"file": "../c", "size": 1, "checksum": "x"}]
    (tmp_path / "i.json").write_text(json.dumps({"repository": "o/n", "revision": "1" * 40, "files": files}))
    listed = readers.manifest_files(spark, str(tmp_path / "i.json"))
    assert [r["reason"] for r in validate.manifest_problems(listed).collect()] == ["path leaves the snapshot"]
    actual = readers.binaries(spark, str(tmp_path / "m"))
    assert {(r["file"], r["reason"]) for r in validate.integrity_problems(listed, actual).collect()} == {("b.bin", "missing"), ("../c", "missing")}


def test_streamed_accuracy(spark, tmp_path):
    from fieldproof.streaming import live

    line = lambda i, p: json.dumps({"run_id": "r", "id": f"d{i}", "field": "a", "rule": "string", "expected": "1", "predicted": p, "error": None, "at": "2026-01-01T00:00:00Z"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([line(0, "1"), line(1, "2"), line(0, "1")]))
    stream = live.accuracy(live.read(spark, str(tmp_path / "in")), unicode=False)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("live_accuracy").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    (tmp_path / "in/2.json").write_text(line(2, "1") + "\n" + line(1, "1"))
    q.processAllAvailable()
    q.stop()
    got = spark.table("live_accuracy").first()
    assert (got["correct"], got["total"]) == (2, 3)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from fieldproof.streaming import live

    row = lambda i, minute, said="1": {"run_id": "r", "id": f"d{i}", "field": "a", "rule": "string", "expected": "1", "predicted": said, "error": None, "at": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}
    folders = [str(tmp_path / x) for x in ("in", "out", "state")]
    assert live.caught_up(spark, *folders, unicode=False).count() == 0
    steps = [
        ([row(0, 1), row(1, 2, "2"), row(0, 1), {"id": None, "at": None}], []),
        # a field that was read before, then one two hours on, which closes the first window
        ([row(1, 3), row(2, 4), row(3, 125)], [(2, 3)]),
        # too late for its window, which stays as it was
        ([row(4, 2), row(5, 126)], [(2, 3)]),
    ]
    for n, (rows, closed) in enumerate(steps):
        (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, rows)))
        got = live.caught_up(spark, *folders, unicode=False).where("run_id is not null").orderBy("start").collect()
        assert [(r["correct"], r["total"]) for r in got] == closed
