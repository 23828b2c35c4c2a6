"""Answers that outlive tasks and runs."""

import json
import os
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldproof.operators.infer import infer
from fieldproof.plans import evaluate
from fieldproof.sources import ledger as L

from .test_evaluate import receipts


class Counting:
    """Notes each call in a file; while ``poison`` is there, the document of that id takes the whole worker down with it."""

    def __init__(self, folder):
        self.folder = Path(folder)

    def analyze(self, image, question, field_schema):
        if question == "poison" and (self.folder / "poison").exists():
            (self.folder / "poison").unlink()
            os._exit(1)
        with (self.folder / "calls").open("a") as out:
            out.write(question + "\n")
        if question.endswith("3"):
            raise ValueError("unreadable")
        return {"fields": {"n": question}}

    def describe(self):
        return {"model": "counting"}


def documents(spark, names):
    return spark.createDataFrame([(n, "i", n, "{}") for n in names], "id string, image string, question string, field_schema string")


def calls(folder):
    return Counter((folder / "calls").read_text().split())


def test_a_killed_task_asks_for_nothing_twice(spark, tmp_path):
    names = [str(i) for i in range(60)] + ["poison"]
    make = lambda: Counting(tmp_path)
    ledger = str(tmp_path / "ledger")
    (tmp_path / "poison").touch()
    with pytest.raises(Exception):  # noqa: B017, PT011  the worker is gone, and this session tries a task once
        infer(documents(spark, names), make, ledger)
    before = calls(tmp_path)
    held = L.read(spark, ledger).count()
    assert "poison" not in before and held == len(before)
    got = infer(documents(spark, names), make, ledger).collect()
    assert sorted(r["id"] for r in got) == sorted(names)
    assert calls(tmp_path) == Counter(names)
    assert {r["id"] for r in got if r["error"]} == {n for n in names if n.endswith("3")}
    again = infer(documents(spark, names).repartition(3), make, ledger).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) and calls(tmp_path) == Counter(names)


def test_other_requests_are_asked(spark, tmp_path):
    make, ledger = (lambda: Counting(tmp_path)), str(tmp_path / "ledger")
    infer(documents(spark, ["a", "b"]), make, ledger)
    infer(documents(spark, ["a", "b", "c", "c"]), make, ledger)
    assert calls(tmp_path) == Counter("abc")
    infer(documents(spark, ["a"]).withColumn("image", F.lit("other")), make, ledger)
    infer(documents(spark, ["a"]), make, ledger, "another model")
    infer(documents(spark, ["a"]).withColumn("profile", F.lit("label-aware-v1")), make, ledger)  # refused by this analyzer, and that is kept
    assert calls(tmp_path) == Counter("aaabc")


def test_segments_of_one_partition(tmp_path):
    """What an attempt wrote, the next attempt of its partition leaves out; a torn line counts as never written."""
    for every, appends in ((1, True), (4, False)):
        ledger = str(tmp_path / uuid.uuid4().hex)
        first = L.Segments(ledger, "job", 3, every)
        first.appends = appends
        for k in range(6):
            first.append({"request": f"r{k}", "id": str(k)})
        # no close: the attempt died here
        kept = 6 if appends else 4
        if appends:
            path = next((Path(ledger) / "job/3").iterdir())
            path.write_bytes(path.read_bytes()[:-9])
            kept = 5
        assert L.Segments(ledger, "job", 3).answered() == {f"r{k}" for k in range(kept)}
        assert L.Segments(ledger, "job", 4).answered() == set()


def test_torn_lines_are_not_read(spark, tmp_path):
    (tmp_path / "l/j/0").mkdir(parents=True)
    whole = json.dumps({"request": "a", "id": "1", "prediction": "{}", "error": None, "done": True})
    (tmp_path / "l/j/0/x.jsonl").write_text(whole + "\n" + whole.replace('"a"', '"b"')[:-8])
    (tmp_path / "l/j/0/y.jsonl").write_text(whole + "\n")
    assert [r["request"] for r in L.read(spark, str(tmp_path / "l")).collect()] == ["a"]
    assert L.read(spark, str(tmp_path / "none")).collect() == []


class Stops(Counting):
    def analyze(self, image, question, field_schema, receipt_profile=None):
        super().analyze(image, Path(image).stem, field_schema)
        if (self.folder / "stop").exists() and image.endswith("b.png"):
            os._exit(1)
        return {"fields": {"total_amount": "15.00", "tax_amount": "10%" if len(field_schema) == 3 and not receipt_profile else "1.50"}}


def test_a_run_goes_on(spark, tmp_path):
    """A run that was broken off between documents, and one with another policy, ask only for what is new."""
    path = receipts(tmp_path / "d")
    make = lambda: Stops(tmp_path)
    (tmp_path / "stop").touch()
    with pytest.raises(Exception):  # noqa: B017, PT011
        evaluate.evaluate(spark, path, tmp_path / "one", "live", analyzer=make, ledger=tmp_path / "ledger")
    (tmp_path / "stop").unlink()
    before = calls(tmp_path)
    run = evaluate.evaluate(spark, path, tmp_path / "two", "live", analyzer=make, ledger=tmp_path / "ledger")
    after = calls(tmp_path)
    assert run["examples"] == 3 and run["failed_examples"] == 0 and after["b"] == before["b"] + 1 and after["a"] == after["c"] == 1
    third = evaluate.evaluate(spark, path, tmp_path / "three", "live", analyzer=make, ledger=tmp_path / "ledger")
    assert calls(tmp_path) == after and third["correct_fields"] == run["correct_fields"]
