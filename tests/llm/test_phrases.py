import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases as ph
from tessera.plans import skew


def plain(rows, least, first, share=100, depth=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand, kept = {p: x for p, x in c.items() if x >= least and " " in p}, []
        for p, a in cand.items():
            w = p.split(" ")
            score, _, l, r = min((1000 * a * n[lang] // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k, c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w)))
            if not any(len(q) > len(p) and f" {p} " in f" {q} " and 100 * x >= share * a for q, x in cand.items()):
                kept.append((-score, -a, p.encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["the", "of", "a", "Éa", "x\x00y", "New", "york", "CITY", "漢字", "-"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(40)):
            w += r.choice([["new", "york", "city", "hall"], ["of", "the"], ["a", "a", "a"], [r.choice(vocab)], [r.choice(vocab)], ["red", "tape", "\n", "runs"]])
        rows.append((r.choice(["en", "en", "de", None, "und"]), "".join(x + r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\r\n", "\xa0"]) for x in w)))
    return [*rows, ("en", None), ("en", ""), ("fr", " .,. "), (None, "new york " * 500), ("en", "lone"), *[("en", "Of The new york city hall")] * 20]


@pytest.mark.parametrize("shard_words,share,bound", [(1 << 19, 100, skew.BROADCAST_ROWS), (300, 100, skew.BROADCAST_ROWS), (60, 80, 2)])
def test_collocations_against_plain_counts(spark, monkeypatch, shard_words, share, bound):
    for f in (skew.split_join, skew.lookup_join):
        monkeypatch.setattr(f, "__defaults__", tuple(bound if x == skew.BROADCAST_ROWS else x for x in f.__defaults__))
    rows = corpus(7)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("shard", F.lit("own")).withColumn("ids", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = ph.collocations(df.repartition(3), least=8, first=40, share=share, shard_words=shard_words, hashes_sent=min(bound, ph.HASHES))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))
    want = plain(rows, 8, 40, share)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60


def test_empty_table(spark):
    assert ph.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_states_of_the_automaton_are_classes_of_equal_ends():
    r = np.random.default_rng(3)
    for n in (1, 5, 60, 400):
        ids = r.integers(0, 5, n).astype(np.int32)
        ids[n // 2 :] = np.resize([1, 2, 3, 4, 4, 0], n - n // 2)
        ends = defaultdict(list)
        for i in range(n):
            for k in range(1, 6):
                if k <= i + 1 and (w := ids[i - k + 1 : i + 1]).all():
                    ends[tuple(w.tolist())].append(i)
        states = defaultdict(list)
        for p, e in ends.items():
            states[tuple(e)].append(p)
        got = ph.automaton(ids, 5)
        at = {}
        for s in range(len(got.count)):
            longest = tuple(ids[got.end[s] - got.longest[s] + 1 : got.end[s] + 1].tolist())
            at[s] = tuple(ends[longest])
            assert got.count[s] == len(at[s]) and {len(p) for p in states[at[s]]} == set(range(got.shortest[s], got.longest[s] + 1))
        assert sorted(at.values()) == sorted(states)
        for s, up in enumerate(got.link):
            short = min(states[at[s]], key=len)
            assert (up < 0) == (len(short) == 1) and (up < 0 or at[int(up)] == tuple(ends[short[1:]]))


def test_scores_pass_64_bits(spark):
    rows = [("en", "ab cd . " * 3_000 + "e . " * 10)] * 3
    got = ph.collocations(spark.createDataFrame(rows, "lang string, text string"), first=5).collect()
    assert [tuple(x) for x in got] == plain(rows, 100, 5)
    big = spark.sql("SELECT CAST(CAST(1000 AS DECIMAL(38,0)) * CAST(4000000000 AS DECIMAL(38,0)) * CAST(9000000000000 AS DECIMAL(38,0)) AS DECIMAL(38,0)) div (CAST(4000000000 AS DECIMAL(38,0)) * CAST(4000000001 AS DECIMAL(38,0))) AS x").first().x
    assert big == 1000 * 4_000_000_000 * 9_000_000_000_000 // (4_000_000_000 * 4_000_000_001)


def test_query_against_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = duckdb.sql(ph.op11_sql()).fetchall()
    assert sorted(map(tuple, ph.op11_phrases(spark, d).collect())) == sorted(want) and len(want) > 50


def test_shards_are_passed_packed(spark):
    rows = [("en", " ".join(f"w{i % 50}" for i in range(20_000))), ("en", "x\x00y É."), (None, ""), ("de", None)]
    got = {r.lang: r for r in ph.sharded(spark.createDataFrame(rows, "lang string, text string")).groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.length("ids")).alias("ids"), F.sum(F.expr("length(cast(words AS binary))")).alias("words")).collect()}
    assert got["en"].n == 20_002 and got["en"].ids < 20_002 * 4 / 2 and got["und"].n == got["de"].n == 0
    assert ph.unpacked(ph.packed(b"")) == b"" and ph.unpacked(ph.packed(b"ab\x00")) == b"ab\x00"


@pytest.mark.parametrize("hashes_sent", [ph.HASHES, 0])
def test_shards_give_out_only_phrases_whose_beginning_and_end_are_frequent(spark, monkeypatch, hashes_sent):
    # Pairs of frequent words are all frequent; of longer phrases, only "a b c d e" and what it holds are.
    r = random.Random(4)
    rows = [("en", ". ".join(["a b c d e", *[" ".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(4)]])) for _ in range(80)]
    seen, real = {}, ph.phrase_rows
    monkeypatch.setattr(ph, "phrase_rows", lambda texts, size, sent: seen.setdefault(size, (out := real(texts, size, sent)).cache().agg(F.sum("n")).first()[0]) and out)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = ph.collocations(docs, least=25, first=50, shard_words=400, hashes_sent=hashes_sent).collect()
    assert sorted(map(tuple, got)) == plain(rows, 25, 50)
    assert seen[4] < 300 and seen[5] < 150  # of 3,040 and 2,640 places


def test_numbers_are_dense(spark):
    got = ph.numbered(spark.range(1000).repartition(7)).collect()
    assert sorted(x.id for x in got) == list(range(1, 1001))
    assert ph.numbered(spark.range(0)).collect() == []
