"""Small tables and plain Python forms of the corpus operators."""

import random
import re

SPACE = " \t\n\x0b\f\r"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def prose(seed, n, words=400):
    """Texts of invented words, with copies, near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéñ") for _ in range(r.randint(2, 7))) for _ in range(words)]
    said = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = said(40), said(8)
    out = []
    for i in range(n):
        kind = r.randrange(8)
        if out and kind == 0:
            text = r.choice(out)
        elif out and kind == 1:
            ws = r.choice(out).split(" ")
            for _ in range(max(1, len(ws) // 25)):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
            text = " ".join(ws)
        else:
            text = "\n".join(said(r.randint(3, 30)) for _ in range(r.randint(1, 6)))
            if kind == 2:
                text += "\n" + passage + " " + said(5)
            if kind == 3:
                text = "\n".join([line] * r.randint(2, 5)) + "\n" + text
        out.append(text)
    return out


def shingles(text, k):
    w = WORDS.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k):
    """Smallest id reachable over links of 0.8, by all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def repeats(rows, length):
    """Removed bytes of each row by a set of all strings seen."""
    seen, out = set(), []
    for _, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out.append((b, bytes(gone)))
    return out


def edits(p, t):
    """Least edit distance of p to a substring of t."""
    before = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        now = [i]
        for j, d in enumerate(t, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)
