import hashlib
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from fieldproof.operators import select
from fieldproof.plans import compare, evaluate
from fieldproof.sources import files, readers, sinks

from .test_evaluate import Texts, receipts


def rows(spark, made):
    return spark.createDataFrame(made, "path string, content binary")


def test_files_are_published_together(spark, tmp_path):
    made = [(f"d{i % 3}/f{i}.bin", b"%d" % i) for i in range(40)]
    files.write_files(rows(spark, made).repartition(4), str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*.bin")} == dict(made)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="already exists"):
        files.write_files(rows(spark, made), str(tmp_path / "out"))
    files.write_files(rows(spark, []), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


@pytest.mark.parametrize("bad, said", [(("../x", b"1"), "no file can be"), (("/x", b"1"), "no file can be"), (("x", None), "no content"), (("d0/f0.bin", b"2"), "stands twice")])
def test_nothing_stays_of_a_failed_write(spark, tmp_path, bad, said):
    with pytest.raises(Exception, match=said):
        files.write_files(rows(spark, [("d0/f0.bin", b"0"), bad]).repartition(2), str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_an_attempt_that_runs_again_leaves_the_same_files(tmp_path):
    writer = files.FileWriter(str(tmp_path / "out"))
    for _ in range(2):
        done = writer.write(iter([("a", b"1"), ("b/c", b"2")]))
    writer.commit([done])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["out/a", "out/b/c"]


def test_joined_lines_are_in_order(spark, tmp_path):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("n")).withColumn("line", F.concat(F.lit("é "), F.col("n").cast("string"))).repartition(7)
    assert files.joined_lines(df, ["n"], "line", str(tmp_path / "a"), b"head\n") == 5000
    assert (tmp_path / "a").read_text(encoding="utf-8").splitlines() == ["head", *(f"é {i}" for i in range(5000))]
    assert files.joined_lines(df.where("false"), ["n"], "line", str(tmp_path / "b")) == 0 and (tmp_path / "b").read_bytes() == b""


def test_fingerprint_is_that_of_sorted_json(spark, tmp_path):
    made = {i: hashlib.sha256(i.encode()).hexdigest() for i in ("b", "a", "é", "a\"\\", "\U0001f600", "￿", "Z", "10", "9")}
    (tmp_path / "a").write_bytes(b"lines\n" * 300_000)
    got = sinks.fingerprint(tmp_path / "a", spark.createDataFrame(list(made.items()), "id string, sha256 string").repartition(3))
    raw = (tmp_path / "a").read_bytes()
    assert got["fingerprint"] == hashlib.sha256(raw + json.dumps(made, sort_keys=True).encode()).hexdigest()
    assert got["annotations_sha256"] == hashlib.sha256(raw).hexdigest() and got["image_sha256"] == made and got["examples"] == len(made)
    none = sinks.fingerprint(tmp_path / "a", spark.createDataFrame([], "id string, sha256 string"), listed=False)
    assert none["fingerprint"] == hashlib.sha256(raw + b"{}").hexdigest() and "image_sha256" not in none


def test_order_digest(spark):
    digest = lambda made: select.order_digest(spark.createDataFrame(made, "p long, id string").repartition(3), "p", "id").first()["digest"]
    one = digest([(1, "a"), (2, "b"), (3, "c")])
    assert digest([(3, "c"), (1, "a"), (2, "b")]) == one
    for other in ([(1, "b"), (2, "a"), (3, "c")], [(1, "a"), (2, "b")], [(1, "a"), (2, "b"), (3, "d")], [(1, "a"), (2, "b"), (4, "c")], [(1, "a"), (2, "b"), (3, "c"), (3, "c")], []):
        assert digest(other) != one


def test_runs_without_lists_are_compared(spark, tmp_path):
    """run.json without ids, hashes and records: the guards go by the digest of the selection and by the documents' table."""
    path = receipts(tmp_path / "d")
    for name, more in (("one", {}), ("two", {}), ("part", {"limit": 2})):
        run = evaluate.evaluate(spark, path, tmp_path / name, "live", analyzer=Texts, records=False, **more)
        assert not {"selected_ids", "image_sha256"} & set(run["dataset"]) and run["results"] == []
    assert "| tax_amount | 0 | 0 |" in compare.compare(spark, [tmp_path / "one/run.json", tmp_path / "two/run.json"])
    with pytest.raises(ValueError, match="Different document selections"):
        compare.compare(spark, [tmp_path / "one/run.json", tmp_path / "part/run.json"])
    saved = json.loads((tmp_path / "two/run.json").read_text())
    saved["dataset"]["selected_digest"] = json.loads((tmp_path / "one/run.json").read_text())["dataset"]["selected_digest"]
    (tmp_path / "part/run.json").write_text(json.dumps(saved))
    with pytest.raises(ValueError, match="do not match"):
        compare.compare(spark, [tmp_path / "one/run.json", tmp_path / "part/run.json"])


def corpus(spark, folder, sizes):
    folder.mkdir()
    n = 0
    for k, size in enumerate(sizes):
        df = spark.createDataFrame([((b"x",), str(n + i)) for i in range(size)], "image struct<bytes:binary>, ground_truth string").coalesce(1)
        df.write.parquet(str(folder.parent / f"t{k}"))
        next((folder.parent / f"t{k}").glob("*.parquet")).rename(folder / f"test-{k:02d}.parquet")
        n += size
    (folder / "train-0.parquet").write_bytes(b"no Parquet")


def test_a_prefix_opens_the_files_it_needs(spark, tmp_path):
    corpus(spark, tmp_path / "c", [3, 0, 4, 5])
    (tmp_path / "c/test-04.parquet").write_bytes(b"behind the limit, and broken")
    for limit, used in ((1, 1), (3, 1), (4, 3), (7, 3), (9, 4), (12, 4)):
        got = readers.numbered_corpus(spark, str(tmp_path / "c"), "test", limit)
        assert sorted((r["n"], r["id"], r["ground_truth"]) for r in got.collect()) == [(i, f"doc-test-{i:04d}", str(i)) for i in range(limit)]
        assert len(got.inputFiles()) == used
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "c/test-04.parquet").unlink()
    assert sorted(r["n"] for r in readers.numbered_corpus(spark, str(tmp_path / "c"), "test").collect()) == list(range(12))
    with pytest.raises(ValueError, match="no file"):
        readers.numbered_corpus(spark, str(tmp_path / "c"), "validation", 3)


def test_lists_of_a_run_pass_line_by_line(spark, tmp_path):
    path = receipts(tmp_path / "d")
    whole = evaluate.evaluate(spark, path, tmp_path / "one", "live", analyzer=Texts)
    slim = evaluate.evaluate(spark, path, tmp_path / "two", "live", analyzer=Texts, returned=False)
    one, two = (json.loads((tmp_path / f"{name}/run.json").read_text()) for name in ("one", "two"))
    assert one == whole and len(one["results"]) == 3 and one["dataset"]["selected_ids"] == ["a", "b", "c"] and set(one["dataset"]["image_sha256"]) == set("abc")
    assert two["dataset"] == one["dataset"] and [r["score"] for r in two["results"]] == [r["score"] for r in one["results"]]
    assert slim["results"] == [] and not {"selected_ids", "image_sha256"} & set(slim["dataset"]) and slim["correct_fields"] == whole["correct_fields"]
    assert sinks.run_head(tmp_path / "two/run.json") == slim
    # laid out otherwise, it is read whole
    for indent in (None, 0, 1, 2):
        (tmp_path / "other.json").write_text(json.dumps(two, indent=indent))
        assert sinks.run_head(tmp_path / "other.json") == slim
    # many records are neither held nor read
    (tmp_path / "lines").write_text("".join(json.dumps({"id": i, "text": " ]\n" * 100}) + "\n" for i in range(5000)))
    tracemalloc.start()
    sinks.save_json(tmp_path / "many.json", slim | {"results": sinks.Lines(tmp_path / "lines")})
    head = sinks.run_head(tmp_path / "many.json")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert head == slim and peak < 1 << 20 < (tmp_path / "many.json").stat().st_size
    assert len(json.loads((tmp_path / "many.json").read_text())["results"]) == 5000
    (tmp_path / "lines").write_text('{"x": 1}\n{"x": 1e999}\n')
    with pytest.raises(ValueError):
        sinks.save_json(tmp_path / "many.json", {"results": sinks.Lines(tmp_path / "lines")})
    assert not list(tmp_path.glob(".many*")) and sinks.run_head(tmp_path / "many.json") == slim
