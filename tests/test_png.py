import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldproof.functions import png
from fieldproof.operators import infer as I
from fieldproof.plans import recheck

KINDS = [(c, d) for c, ds in png.DEPTHS.items() for d in ds]


def image(seed, width, height, colour, depth):
    stride = -(-width * depth * png.SAMPLES[colour] // 8)
    rows = np.random.default_rng(seed).integers(0, 256, (height, stride)).astype(np.uint8)
    return png.Image(width, height, depth, colour, rows, ((b"PLTE", bytes(range(12))),) if colour == 3 else ())


def plain(lines, stride, step):
    """Filters undone byte by byte."""
    out = []
    for kind, *raw in lines:
        row = []
        for i, x in enumerate(raw):
            a, b = row[i - step] if i >= step else 0, out[-1][i] if out else 0
            c = out[-1][i - step] if out and i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((x + [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(row)
    return np.array(out, np.uint8).reshape(len(lines), stride)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 40), st.sampled_from(KINDS), st.lists(st.integers(0, 4), min_size=40, max_size=40))
def test_round_trip(seed, width, height, kind, filters):
    made = image(seed, width, height, *kind)
    used = np.array(filters[:height], np.uint8)
    data = png.encode(made, used)
    got = png.decode(data)
    assert (got.width, got.height, got.depth, got.colour, got.meaning) == (width, height, kind[1], kind[0], made.meaning)
    assert (got.rows == made.rows).all()
    stored = b"".join(body for name, body in png._parts(data) if name == b"IDAT")
    stride = made.rows.shape[1]
    lines = np.frombuffer(zlib.decompress(stored), np.uint8).reshape(height, stride + 1).tolist()
    assert (plain(lines, stride, max(1, kind[1] * png.SAMPLES[kind[0]] // 8)) == made.rows).all()


def test_between():
    made = image(1, 7, 23, 2, 8)
    part = png.decode(png.encode(png.between(made, 2, 21)))
    assert (part.height, part.width) == (19, 7) and (part.rows == made.rows[2:21]).all()
    for top, bottom in ((-1, 3), (3, 3), (0, 24)):
        with pytest.raises(ValueError):
            png.between(made, top, bottom)


def test_bad_files():
    good = png.encode(image(2, 5, 5, 0, 8))
    head = lambda *x: png.MAGIC + (lambda b: struct.pack(">I", 13) + b + struct.pack(">I", zlib.crc32(b)))(b"IHDR" + struct.pack(">IIBBBBB", *x))
    for bad in (b"", b"GIF89a", good[:40], good[:-20], good.replace(b"IHDR", b"JHDR"), good[:50] + b"\0" + good[51:], head(5, 5, 8, 0, 0, 0, 1), head(0, 5, 8, 0, 0, 0, 0), head(5, 5, 3, 0, 0, 0, 0), head(1 << 20, 1 << 20, 8, 2, 0, 0, 0)):
        with pytest.raises((ValueError, zlib.error)):
            png.decode(bad)


def test_large_images_take_steps_of_whole_diagonals():
    made = image(3, 600, 900, 2, 8)
    assert (png.decode(png.encode(made, np.arange(900) % 5)).rows == made.rows).all()


class Looks:
    """Says what it was given: the size of the image and the profile."""

    def analyze(self, image, question, field_schema, receipt_profile=None):
        got = png.decode(Path(image).read_bytes())
        return {"fields": {"tax_amount": f"{got.width} by {got.height}", "total_amount": receipt_profile}, "evidence": [{"field": "tax_amount", "text": image}]}

    def describe(self):
        return {}


def documents(spark, folder, policy_field="10%"):
    rules = json.dumps({"tax_amount": "string or null", "total_amount": "string or null"})
    rows = []
    for name, size in (("a", (30, 47)), ("b", (5, 9))):
        (folder / f"{name}.png").write_bytes(png.encode(image(4, *size, 2, 8), np.full(size[1], 4)))
        rows.append((name, str(folder / f"{name}.png"), "whole", rules, json.dumps({"fields": {"tax_amount": policy_field, "total_amount": "7"}})))
    (folder / "c.png").write_bytes(b"no image")
    rows.append(("c", str(folder / "c.png"), "whole", rules, json.dumps({"fields": {"tax_amount": policy_field, "total_amount": "7"}})))
    df = spark.createDataFrame(rows, "id string, image string, question string, s string, p string")
    return df.select("id", "image", "question", F.parse_json("s").alias("field_schema"), F.json_object_keys("s").alias("requested"), F.parse_json("p").alias("prediction"))


def test_crop_policy_shows_the_central_rows(spark, tmp_path):
    got = {r["id"]: json.loads(r["prediction"]) for r in recheck.reread(documents(spark, tmp_path), Looks, "percent-crop-v1").collect()}
    a, b, c = (got[k] for k in "abc")
    view = a["recheck_attempt"]["view"]
    assert (view["kind"], view["box"], view["source_size"]) == (I.CENTRAL, [0, 4, 30, 43], [30, 47]) and len(view["sha256"]) == 64
    assert a["fields"] == {"tax_amount": "30 by 39", "total_amount": "7"} and b["fields"]["tax_amount"] == "5 by 9"
    assert a["metadata"]["model_calls"] == 2 and "receipt_profile" not in a["recheck_attempt"]
    shown = png.decode(Path(a["evidence"][0]["text"]).read_bytes())
    assert (shown.rows == png.decode((tmp_path / "a.png").read_bytes()).rows[4:43]).all()
    # what is no image fails before the model is asked
    assert c["recheck_attempt"]["error"].startswith("ValueError") and c["recheck_attempt"]["request_started"] is False and c["metadata"]["model_calls"] == 1
    assert c["fields"]["tax_amount"] == "10%" and c["recheck_attempt"]["view"] is None


def test_context_policy_has_its_own_profile(spark, tmp_path):
    got = {r["id"]: json.loads(r["prediction"]) for r in recheck.reread(documents(spark, tmp_path), Looks, "label-context-v1").collect()}
    a = got["a"]
    assert a["recheck_attempt"]["receipt_profile"] == "label-aware-v1" and a["recheck_attempt"]["prediction"]["fields"]["total_amount"] == "label-aware-v1"
    assert a["fields"] == {"tax_amount": "30 by 47", "total_amount": "7"} and a["recheck_attempt"]["question"] == "whole" and "view" not in a["recheck_attempt"]


def test_images_of_a_shape_go_together(monkeypatch):
    kinds = [(7, 12, *KINDS[i % len(KINDS)]) for i in range(600)] + [(1 + i % 5, 1 + i % 3, 0, 8) for i in range(60)]
    made = [image(i, *kind) for i, kind in enumerate(kinds)]
    filters = [(i + np.arange(x.height)) % (5 if i % 2 else 3) for i, x in enumerate(made)]
    files = png.encode_all(made, filters)
    assert files == [png.encode(x, f) for x, f in zip(made, filters, strict=True)]
    calls, one = [], png.unfiltered
    monkeypatch.setattr(png, "unfiltered", lambda *x: calls.append(x) or one(*x))
    for x, got in zip(made, png.decode_all(files), strict=True):
        assert (got.rows == x.rows).all() and (got.width, got.depth, got.colour, got.meaning) == (x.width, x.depth, x.colour, x.meaning)
    assert len(calls) < 40
    assert png.decode_all([]) == png.encode_all([]) == []
    with pytest.raises(ValueError):
        png.decode_all([files[0], b"GIF89a"])


def test_views_of_one_file_are_cut_by_many_tasks(spark, tmp_path):
    from fieldproof.plans import catalog

    spark.range(2000).selectExpr("id as o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.queries()["crop_views"](spark, str(tmp_path))
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and sum(sizes) == 2000 and max(sizes) < 500
