"""Quality rules, chat formatting and line dedup: whole queries against SQL, odd rows against plain Python."""

import random
from collections import Counter

import pytest

from fieldproof.llm import chat_format as C
from fieldproof.llm import line_dedup as L
from fieldproof.llm import quality as Q

from ..oracle import same
from . import helpers as H


def test_sql(spark):
    assert same(spark, Q.op6_quality_rules, Q.ORACLE) == 200
    assert same(spark, C.op9_chat_format, C.ORACLE) > 0
    assert same(spark, L.op10_line_dedup, L.ORACLE) == 200


def repeated(text):
    w = [x.decode() for x in H.WORDS.findall((text or "").encode())]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    return len(w), len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def test_quality(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(150)]
    texts += [None, "", " \n\x0b", "x" * 5000, "a b c d e " * 500, "a b c d e", "\n\n a \n a\n b", "é ü #*$%&|<>   z"]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    out = Q.judge(docs).collect()
    assert len(out) == len(rows)
    for x in out:
        n, again = repeated(texts[x["doc_id"]])
        assert (x["n_words"], x["n_repeat_words"]) == (n, again), texts[x["doc_id"]]
        assert x["base_failed"] == (n < 10 or 100 * again > 20 * n)
        assert not (x["base_failed"] and x["kept"])
    by = {x["doc_id"]: x for x in out}
    last = len(texts) - 1
    assert (by[last]["n_symbols"], by[last - 1]["n_dup_lines"], by[last - 4]["word_chars"]) == (8, 1, 5000) or by[last]["n_symbols"] == 8
    odd = docs.withColumnsRenamed({"kept": "_words"})
    assert Q.judge(odd).where("_words = 'x'").count() == len(rows)
    kept = Q.keep(docs)
    assert kept.columns == docs.columns and {r["kept"] for r in kept.collect()} <= {"x"}
    assert Q.judge(docs.where("false")).count() == 0


@pytest.mark.parametrize("rule, ok", [(Q.Rule("a", "n_words / n_lines", 1, 2), True), (Q.Rule("a", "n_words / n_lines", 3), False), (Q.Rule("a", "n_words / n_lines", most=1), False)])
def test_thresholds(spark, rule, ok):
    out = Q.judge(H.docs(spark, [(1, "a b\nc d")]), rules=(rule,)).first()
    assert (out["failed_rules"] == []) == ok


def test_clean_texts_without_stop_words_stay(spark):
    rows = [
        (1, "Üau heit ie enie, den, chö enkeitstau enchentz schungen des."), (2, "Pas. Éauxaux etèmenteuxeau aile.\nDe, ré retreeau.\nAll rights reserved."),
        (3, "Kissa istui ikkunalla ja katseli lintuja puutarhassa koko aamun ilman kiirettä."), (4, "buy now $$ cheap pills && fast cash ** win prizes"),
    ]
    docs = H.docs(spark, rows)
    assert sorted(r["doc_id"] for r in Q.keep(docs).collect()) == [1, 2, 3]
    measured = {r["doc_id"]: r["n_stop_tokens"] for r in Q.measure(docs).collect()}
    assert measured == {1: 2, 2: 1, 3: 0, 4: 0}
    assert Q.judge(docs).where("doc_id = 4").first()["failed_rules"] == ["symbols_per_word", "stop_word_ratio"]


def chats(rows):
    by = {}
    for c, t, role, text in dict.fromkeys(rows):
        # a turn without a conversation stands alone
        by.setdefault(c if c is not None else (t, role, text), []).append(((t is not None, t or 0), role, text))
    turns = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda y: y[0])) for c, v in by.items()}
    whole = {}
    for c, t in turns.items():
        whole.setdefault(t, []).append(None if isinstance(c, tuple) else c)
    return Counter((min((c for c in cs if c is not None), default=None), len(t), len(cs)) for t, cs in whole.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in whole))


def test_chats(spark):
    r = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["hi", "yo", "", None])))
    rows += rows[:10] + [(99, None, None, "first"), (99, 3, "user", "a<|im_end|>b"), (None, 0, "user", "lost"), (None, 0, "user", "lost"), (None, 4, "user", "lost"), (None, 1, "user", "<|x"), (None, None, None, None), (None, 0, "user", "hi")]
    turns = spark.createDataFrame([(*x, 5) for x in rows], "conv_id long, turn long, role string, text string, k int")
    out = C.render(turns).collect()
    assert Counter((x["conv_id"], x["n_turns"], x["n_copies"]) for x in out) == chats(rows)
    odd = next(x for x in out if x["conv_id"] == 99)
    assert odd["rendered"] == "<|im_start|>unknown\nfirst<|im_end|>\n<|im_start|>user\na< |im_end|>b<|im_end|>\n"
    assert sorted((x["n_copies"], x["rendered"]) for x in out if x["conv_id"] is None) == [
        (1, "<|im_start|>unknown\n<|im_end|>\n"), (1, "<|im_start|>user\n< |x<|im_end|>\n"), (2, "<|im_start|>user\nlost<|im_end|>\n"),
    ]
    assert C.render(turns.where("false")).count() == 0


def stripped(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(H.SPACE)]
        gone, mine = set(), []
        for p in range(len(full) - 2):
            key = tuple(lines[full[p + k]].strip(H.SPACE) for k in range(3))
            if key in seen:
                gone |= {full[p + k] for k in range(3)}
            seen.add(key)
            mine.append(key)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t))
    return out


def test_lines(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["a", "b", " c ", "", "d", "\t"]) for _ in range(r.randint(0, 14)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a\nb"), (103, "x\n" * 3000), (104, "long " * 20000 + "\nb\nd")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, row string, starts int")
    out = L.dedup(docs).collect()
    assert sorted((x["row"]["doc_id"], x["kept_text"] or "") for x in out) == sorted((i, t or "") for i, t in stripped(rows))
    assert all(x["row"]["text"] == x["kept_text"] and x["row"]["row"] == "n" for x in out)
    twice = L.dedup(H.docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "a\nb\nc")])).collect()
    assert sorted((x["row"]["doc_id"] or 0, x["n_removed"]) for x in twice) == [(0, 0), (1, 3), (1, 3), (2, 3)]
    assert L.dedup(docs.where("false")).count() == 0


def test_labels_fall_evenly(spark):
    from pyspark.sql import functions as F

    from fieldproof.llm.common import labels

    for parts, each in ((1, 1), (7, 1), (51, 4), (211, 4)):
        got = labels(parts, each)
        assert len(set(got.tolist())) == parts * each
        rows = spark.createDataFrame([(int(x),) for x in got], "x int").select("x", F.pmod(F.hash("x"), F.lit(parts)).alias("p")).collect()
        at = {r["x"]: r["p"] for r in rows}
        assert [at[x] for x in got.tolist()] == [i % parts for i in range(parts * each)]
