import hashlib
import random
import time
import zlib

import pytest

from tessera.llm import runs as rn


def plain_runs(w, m=12):
    """Every stretch by every period, smallest first."""
    out, n, seen = [], len(w), set()
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - s >= max(m, 2 * q) and (s, i) not in seen:
                seen.add((s, i))
                out.append((s, i - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_result(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    most = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *most, 1000 * most[1] // most[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts(r, n):
    for _ in range(n):
        kind, size = r.randrange(6), r.randrange(1, 90)
        letters = "ab" if kind < 2 else "abcdefghij"
        w = [r.choice(letters) for _ in range(size)]
        if kind >= 1:
            for _ in range(r.randrange(1, 4)):
                block = [r.choice(letters) for _ in range(r.randrange(1, 15))] * r.randrange(2, 6)
                cut = r.randrange(len(block)) if r.random() < 0.5 else 0
                at = r.randrange(len(w) + 1)
                w[at:at] = block[cut:]
        if kind == 5:
            w = w + w
        yield w


def test_runs_against_all_stretches_and_periods():
    r = random.Random(3)
    for w in texts(r, 1500):
        for m in (12, 13, 4):
            assert rn.runs(w, m) == plain_runs(w, m), (m, w)
    fib = ["a"], ["a", "b"]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    assert rn.runs(fib[1]) == plain_runs(fib[1])


def test_equal_hashes_of_different_words_lose_nothing():
    class Same(str):
        __hash__ = lambda self: 7

    w = [Same(x) for x in "x a b c d a b c d a b c d e f g".split()]
    assert rn.runs(w) == [(1, 12, 4)]


@pytest.mark.parametrize("words", [["w"] * 60_000, ["a", "b", "c"] * 20_000, [f"w{i % 7000}" for i in range(60_000)], [f"w{i}" for i in range(200_000)]])
def test_long_texts(words):
    began = time.time()
    got = rn.runs(words)
    period = next((q for q in (1, 3, 7000) if words[0] == words[q]), None)
    assert got == ([(0, len(words), period)] if period else []) and time.time() - began < 30


def test_query_against_plain_loops(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(w) if i % 5 else "\t" + " \n".join(w) + "\x0b") for i, w in enumerate(texts(r, 300))]
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, "a b " * 20), (None, None), (303, "é " * 30 + "    x"), (304, "a b " * 20), (304, "a b " * 20), (-1, "x y z " * 9), (305, "\x1c " * 14)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = [tuple(x) for x in rn.op13_runs(spark, path).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted((plain_result(*x) for x in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10


def test_awkward_tables(spark):
    rows = [(1, "a b " * 20, "kept"), (1, "a b " * 20, "kept"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_bytes string").selectExpr("*", "'mine' AS runs", "'own' AS crc_of_id", "'own' AS words_of_text", "map('k', 1) AS m")
    got = rn.periodic_runs(rn.made_periodic(docs)).collect()
    assert [(x.n_words, [tuple(y) for y in x.runs], x.collapsed, x.text_bytes, x.crc_of_id, x.m) for x in got] == [(40, [(0, 40, 2)], "a b", "kept", "own", {"k": 1})] * 2 + [(0, [], "", None, "own", {"k": 1})]
    assert rn.periodic_runs(rn.made_periodic(docs.where("false"))).collect() == []
