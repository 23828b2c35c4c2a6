import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from fieldproof.llm import packing as P  # noqa: E402

from . import helpers as H  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_limits_hold(seed):
    r = random.Random(seed)
    limits = P.Limits(*r.choice([(64, 64, 64), (64, 3, 64), (64, 64, 20), (50, 4, 30)]))
    lengths = np.array([r.choice([1, 2, 5, 30, 64, 200]) for _ in range(80)])
    loss = np.array([r.randint(0, n) for n in lengths])
    placed = P.pack(lengths, loss, limits)
    covered = {i: [] for i in range(80)}
    bins = {}
    for i, s, n, b, o in placed:
        covered[i] += range(s, s + n)
        bins.setdefault(b, []).append((o, n, max(0, min(loss[i], s + n) - s)))
    assert all(sorted(v) == list(range(lengths[i])) for i, v in covered.items())
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, *_ in pieces] == list(np.cumsum([0] + [n for _, n, _ in pieces])[:-1])
        assert sum(n for _, n, _ in pieces) <= limits.tokens and len(pieces) <= limits.segments and sum(x for *_, x in pieces) <= limits.loss
    if limits.segments == limits.loss == limits.tokens:
        assert len(bins) == -(-lengths.sum() // limits.tokens)


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ["", "The end. It's \x1cWE'LL…  Straße ΑΣ. ΑΣ, É́ ÷. x÷, 1.5, á. <|endoftext|> don't!?", "naïve, İstanbul. a.b., ²³. 日本語。 ", *H.prose(7, 20)]
    many = P.Encoder(PATH)
    for text, ids, other in zip(texts, many.encode_batch(pa.array(texts)), many.encode(texts), strict=True):
        assert ids.tolist() == other.tolist()
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], text


def test_text_of_more_words_than_the_cache_holds(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(P, "CACHE_WORDS", 50)
    t = Tokenizer.from_file(PATH)
    texts = ["few words", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), "few words again", *H.prose(9, 5)]
    many = P.Encoder(PATH)
    for text, ids in zip(texts, many.encode_batch(pa.array(texts)), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
    assert many.pieces.size <= 50


def test_documents(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = list(enumerate([None, "", *H.prose(8, 60), "word " * 9000])) + [(3, "again")]
    out = P.pack_documents(H.docs(spark, rows), PATH).select("row.doc_id", "*").collect()
    whole = {}
    for r in out:
        whole.setdefault((r["doc_id"], r["item_tokens"]), []).append(r)
    texts = {(i, len(t.encode(x or "", add_special_tokens=False).ids) + 1): x or "" for i, x in rows}
    assert set(whole) == set(texts)
    for key, pieces in whole.items():
        ids = np.array([*t.encode(texts[key], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    size = {}
    for r in out:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in size.values())


def test_empty_loss_and_clashing(spark):
    assert P.pack_documents(H.docs(spark, []), PATH).count() == 0
    rows = spark.createDataFrame([(1, "a b c", 2, 9), (2, "d e", None, 9)], "doc_id long, text string, loss int, start int")
    out = P.pack_documents(rows, PATH, loss="loss", limits=P.Limits(4, 2, 2), halved=False).collect()
    assert sum(r["length"] for r in out) == 7 and out[0]["row"]["start"] == 9
    with pytest.raises(ValueError):
        P.pack_documents(rows, PATH, limits=P.Limits(0, 1, 1))


def test_production_limits_bind(spark):
    """Short texts among long ones: sequences stay full, and none has more than 128 pieces; short ones alone reach them."""
    r = random.Random(4)
    said = lambda n: " ".join(r.choice(["river", "stone", "cloud"]) for _ in range(n))
    mixed = [(i, said(r.choice([1, 2, 3, 3000]) if i % 30 else 3000)) for i in range(1500)]
    short = [(i, said(r.randint(1, 3))) for i in range(9000)]
    for rows, full in ((mixed, True), (short, False)):
        out = P.pack_documents(H.docs(spark, rows).coalesce(1), PATH, limits=P.PRODUCTION, ids=True).collect()
        assert all(len(x["ids"]) == x["length"] and zlib.crc32(np.array(x["ids"], np.uint32).tobytes()) == x["ids_crc32"] for x in out)
        found = {}
        for x in out:
            found.setdefault(x["sequence_id"], []).append(x["length"])
        assert max(map(len, found.values())) == 128 or full
        assert max(map(len, found.values())) <= 128
        if full:
            assert sum(4096 - sum(v) for v in found.values() if sum(v) & (sum(v) - 1)) < 0.01 * sum(map(sum, found.values()))


def test_ids_of_a_row_join_again(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = list(enumerate([*H.prose(5, 8), None, "", "word " * 6000]))
    got = {}
    for x in P.pack_documents(H.docs(spark, rows), PATH, limits=P.Limits(64, 5, 64), ids=True).collect():
        got.setdefault(x["row"]["doc_id"], []).append((x["start"], x["ids"]))
    for i, text in rows:
        assert [n for _, ids in sorted(got[i]) for n in ids] == [*t.encode(text or "", add_special_tokens=False).ids, 2]
