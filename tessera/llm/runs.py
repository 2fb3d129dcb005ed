"""Maximal periodic runs of words, from suffix automata.

In an automaton over a stretch of words, a state stands for the words that all end at the same positions. Going up the suffix
links, the ordered end positions of a state's children are merged, the smaller set into the larger. Two positions that become
neighbours in a state agree on exactly as many words before them as the state is long, and on no more; if they are no further
apart than that, a square ends at the later one, and if the next words differ, its run does. The run with smallest period q
that ends at e is seen at (e - q, e): no end position of their state lies between, or a smaller period would hold.

Automata are built only where a run can be. With length >= max(m, 2 q), a run's words a period apart agree over at least m / 2
words, so that each word of it is in a sequence of m // 2 words that occurs twice within the run; stretches of words covered by
such repeats are found by sorting, again within each stretch until nothing is shed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table

#: Words from which a run counts; it also has two periods.
MIN_LENGTH = 12
#: Times that stretches are narrowed; what is left beyond goes to the automata, which decide.
NARROWED = 8
SPACES, WORD_GAP = "[\\x20\\x09-\\x0D]+", b" "
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretches(words: Sequence, m: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold runs: words in sequences of m // 2 words that occur twice in a stretch."""
    g, n = max(1, m // 2), len(words)
    if n < m:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    gram = np.zeros(n - g + 1, np.uint64)
    for k in range(g):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[k : n - g + 1 + k]
        gram ^= gram >> np.uint64(29)
    at, part = np.arange(len(gram)), np.zeros(n, np.int64)  # part: the stretch of each word
    found: list[tuple[int, int]] = [(0, n)]
    for _ in range(NARROWED):
        key = gram[at] + part[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        edge = np.zeros(n + 1, np.int64)
        edge[at] += 1
        edge[at + g] -= 1  # starts are distinct, so are ends
        held = np.cumsum(edge)[:n] > 0
        step = np.diff(np.r_[0, held.astype(np.int8), 0])
        now = [(int(a), int(b)) for a, b in zip(np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]) if b - a >= m]
        if now == found:
            break
        found, part = now, np.full(n, -1)
        for k, (a, b) in enumerate(found):
            part[a:b] = k
        at = at[part[at] >= 0]
        if not len(at):
            return []
    return found


def automaton(words: Sequence) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, end) of each state; end is the position of a state that a prefix made, -1 of a clone."""
    step, link, length, end, last = [{}], [-1], [0], [-1], 0
    for i, w in enumerate(words):
        new = len(step)
        step.append({})
        length.append(i + 1)
        link.append(0)
        end.append(i)
        at = last
        while at >= 0 and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if at >= 0:
            to = step[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                clone = len(step)
                step.append(step[to].copy())
                length.append(length[at] + 1)
                link.append(link[to])
                end.append(-1)
                while at >= 0 and step[at].get(w) == to:
                    step[at][w] = clone
                    at = link[at]
                link[to] = link[new] = clone
        last = new
    return length, link, end


def meet(large: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of neighbours of the union that are not of one set; small is merged into large. Both are sorted."""
    places = [bisect_left(large, x) for x in small]
    for i, (x, p) in enumerate(zip(small, places)):
        if p and (not i or places[i - 1] < p):
            yield large[p - 1], x
        if p < len(large) and (i + 1 == len(small) or places[i + 1] > p):
            yield x, large[p]
    if len(small) * 16 < len(large):
        for x in small:
            insort(large, x)
    else:
        large.extend(small)
        large.sort()


def stretch_runs(words: Sequence, m: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of a stretch."""
    length, link, end = automaton(words)
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    # Positions are negated: states of falling length come in falling order, so that most insertions are at the end of a set.
    sets = {v: [-e] if e >= 0 else [] for v, e in enumerate(end)}
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up = link[v]
        k, mine = length[up], sets.pop(v)
        if 2 * k < m:  # length = period + k and period <= k
            continue
        theirs = sets[up]
        large, small = (theirs, mine) if len(theirs) >= len(mine) else (mine, theirs)
        sets[up] = large
        for later, earlier in list(meet(large, small)):
            a, b = -earlier, -later
            q = b - a
            if q <= k and k + q >= m and (b + 1 == n or words[a + 1] != words[b + 1]):
                key = (a - k + 1, b + 1)
                if found.get(key, n) > q:  # a child merged later may still come between
                    found[key] = q
    return found


def runs(words: Sequence, m: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with length >= max(m, 2 * period), by start, then period."""
    out = []
    for a, b in stretches(words, m):
        number: dict = {}
        ids = [number.setdefault(w, len(number)) for w in words[a:b]]
        out += [(a + s, e - s, q) for (s, e), q in stretch_runs(ids, m).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that any run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s + q for s, _, q in found], 1)
    np.add.at(edge, [s + k for s, k, _ in found], -1)
    return [words[i] for i in np.nonzero(np.cumsum(edge)[:-1] == 0)[0]]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, text_col: str = "text") -> DataFrame:
    """docs with n_words, runs (array of start, length, period in words, by start, then period) and collapsed added.

    Words are what white space (ASCII) parts. A run is a stretch of words that are the same a period later, of min_length words
    and two periods or more, that can't be made longer; its period is the smallest. collapsed: the words, joined by one space,
    without those that a run holds after its first period. Columns of these names are replaced.

    Null and empty texts have no words, no runs and an empty collapsed text. Each row is looked at by itself: repeated rows and
    null ids come out as they are, an empty table gives an empty result. A text is held by one task, in memory that grows with
    its length (automata: some hundred bytes for each word of its repeating stretches).
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    (bytes_,) = fresh(docs, "text_bytes")
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *cells, texts = b.columns
            n, found, left = [], [], []
            for t in texts:
                words = (t.as_py() or b"").split()
                got = runs(words, min_length)
                n.append(len(words))
                found.append([{"start": s, "length": k, "period": q} for s, k, q in got])
                left.append(WORD_GAP.join(collapsed(words, got)))
            yield pa.RecordBatch.from_arrays([*cells, pa.array(n, pa.int64()), pa.array(found, spans), pa.array(left, pa.binary()).cast(pa.string())], names=schema.names)

    return docs.select("*", F.col(text_col).cast("binary").alias(bytes_)).mapInArrow(run, schema)


def made_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which every tenth text, by crc32 of its id, goes on periodically from some word: word i >= a is word a + (i - a) % p.

    With h the crc32 and g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Null ids have no h: their texts stay.
    """
    w, h, n, a, p = fresh(docs, "words_of_text", "crc_of_id", "word_count", "from_word", "period_of_text")
    col = F.col
    g: Column = F.floor(col(h) / 10)
    out = docs.withColumn(h, F.crc32(F.col(id_col).cast("string").cast("binary")))
    out = out.withColumn(w, F.when(col(h) % 10 == 0, F.filter(F.split(text_col, SPACES), lambda x: x != "")))
    out = out.withColumn(n, F.when(F.size(w) > 0, F.size(w)))
    out = out.withColumn(a, (g % col(n)).cast("int")).withColumn(p, (1 + F.floor((col(n) - col(a)) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice(w, col(a) + 1, col(p)), F.ceil((col(n) - col(a)) / col(p)).cast("int")))
    again = F.array_join(F.concat(F.slice(w, 1, col(a)), F.slice(tail, 1, col(n) - col(a))), " ")
    return out.withColumn(text_col, F.when(col(n).isNotNull(), again).otherwise(col(text_col))).select(*docs.columns)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    most = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, period = -F.col("most.start"), -F.col("most.period")
    return out.select("doc_id", "n_runs", start.alias("start"), F.col("most.length").alias("length"), period.alias("period"), F.floor(F.col("most.length") * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
