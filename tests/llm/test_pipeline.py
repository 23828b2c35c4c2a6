
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402
from fieldproof.llm import line_dedup, quality  # noqa: E402

from ..oracle import DATA  # noqa: E402
from . import helpers as H  # noqa: E402


def plain(text):
    """Lower-case A-Z, one space for each run of white space."""
    return b" ".join((text or "").encode().translate(H.LOWER).split())


def least_edits(item, text):
    """Edit distance of ``item`` to the nearest substring of ``text``, cell by cell."""
    t = np.frombuffer(text, np.uint8)
    cost, ramp = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for letter in item:
        step = np.minimum(np.concatenate([[cost[0] + 1], cost[:-1] + (t != letter)]), cost + 1)
        cost = np.minimum.accumulate(step - ramp) + ramp
    return int(cost.min())


def by_sql(texts, sql, columns):
    """Rows of an operator's SQL over the documents that a stage was given."""
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array(texts, pa.int64()), "text": pa.array(texts.values(), pa.string())}))
    return c.execute(f"SELECT {columns} FROM ({sql})").fetchall()


def test_stages(spark, tmp_path):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, d).write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        seen.append(name)
        if name == "packing":
            placed, sequences, sizes, crcs = {}, {}, {}, {}
            for r in docs.collect():
                placed.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
                crcs[r["doc_id"], r["start"], r["length"]] = r["ids_crc32"]
                sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
                sizes[r["doc_id"]] = r["doc_tokens"]
            tokenizer = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
            ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in before.items()}
            assert sizes == {i: len(x) for i, x in ids.items()}
            assert crcs == {(i, a, n): zlib.crc32(ids[i][a : a + n].tobytes()) for i, a, n in crcs}
            for i, found in placed.items():
                assert all(a + n == b for (a, n), (b, _) in zip(sorted(found), sorted(found)[1:])) and min(found)[0] == 0 and sum(n for _, n in found) == sizes[i]
            for found in sequences.values():
                assert all(a + n == b for (a, n), (b, _) in zip(sorted(found), sorted(found)[1:])) and sum(n for _, n in found) <= 4096 and len(found) <= 128
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality rules":
            assert set(after) == {r[0] for r in by_sql(before, quality.ORACLE, "doc_id, kept") if r[1]}
        if name == "line dedup":
            assert {i: r["text"] for i, r in after.items()} == dict(by_sql(before, line_dedup.ORACLE, "doc_id, kept_text"))
            assert all(r["n_chars"] == len(r["text"]) for r in after.values()) and any(after[i]["text"] != t for i, t in before.items())
        if name == "near dedup":
            want = H.components(sorted(before.items()), 5)
            assert set(after) == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            items = [plain(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            assert min(map(len, items)) >= 40
            gone = {i for i, t in before.items() if any(least_edits(x, plain(t)) <= int(0.08 * len(x)) for x in items)}
            assert set(after) == set(before) - gone and gone
    assert len(seen) == 5
    assert P.run(spark, d).count() == docs.count()


def test_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
