"""Collocations: phrases of words that stand together more often than their parts would by chance.

Texts of one language are put together in shards. Over each shard, a generalised suffix automaton bounded in depth is built: its
states are the classes of phrases that end at the same positions, with the number of these, and a suffix link to the class of a
shorter end of theirs. They come from sorting: phrases of k words split the classes of phrases of k - 1 words by the word
before. States give the counts of all phrases of the shard; the counts of all shards are summed.

Phrases are summed size by size. Frequent words are numbered, and so are the frequent phrases of each size; a phrase stands as the
number of the phrase before its last word and that word's number, which is exact and takes one long. A shard learns the numbers
of its frequent phrases of one size, and gives out only those of the next whose beginning and end are both frequent. Texts are put
together for frequent phrases only.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, table
from tessera.plans.lineage import cut, forget, stored
from tessera.plans.skew import fits, lookup_join, split_join

LEAST, DEPTH, FIRST, SHARE = 100, 5, 2000, 100
#: Words from which a shard is closed (with the text that fills it), and of all open shards of a task.
SHARD_WORDS, OPEN_WORDS = 1 << 19, 1 << 20
#: Phrases of a size up to which their numbers are broadcast (48 MB), and words.
HASHES, WORDS_SENT = 4_000_000, 2_000_000
BREAKS = ".,;:!?\n\v\f\r"
#: A byte that UTF-8 never has stands for a break.
BREAK = b"\xff"
BYTES = bytes.maketrans((UPPER + BREAKS + "\t").encode(), LOWER.encode() + BREAK * len(BREAKS) + b" ")


class Numbers(dict):
    """Words by number, in order of first use; a break is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(data: bytes) -> bytes:
    """data compressed, after its size. Shards are passed to workers several in a batch, which would hold them at their full size."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def sharded(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, lang, n, words, ids): texts of one language; ids are int32 numbers into words, 0 at breaks and ends of texts.

    Both are packed, words after being joined by spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[Numbers, array]] = {}
        made, part = 0, TaskContext.get().partitionId()

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            numbers, ids = open_.pop(lang)
            made += 1
            words = packed(b" ".join(list(numbers)[1:]))
            n = int(np.count_nonzero(np.frombuffer(ids, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([lang]), pa.array([n]), pa.array([words]), pa.array([packed(ids.tobytes())])], names=["shard", "lang", "n", "words", "ids"])

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang = lang.as_py()
                tokens = text.as_py().translate(BYTES).replace(BREAK, b" \xff ").split()
                if lang not in open_:
                    open_[lang] = Numbers(), array("i")
                numbers, ids = open_[lang]
                ids.extend(map(numbers.__getitem__, tokens))
                ids.append(0)
                if len(ids) >= shard_words:
                    yield closed(lang)
                elif sum(len(x) for _, x in open_.values()) >= OPEN_WORDS:
                    yield closed(max(open_, key=lambda k: len(open_[k][1])))
        for lang in list(open_):
            yield closed(lang)

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "shard long, lang string, n long, words binary, ids binary")


@dataclass
class Automaton:
    """States by number: the lengths of their phrases (shortest to longest), how often and where last these end, suffix links
    (-1 at phrases that no shorter class is above)."""

    shortest: np.ndarray
    longest: np.ndarray
    count: np.ndarray
    end: np.ndarray
    link: np.ndarray

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(end, count) of each phrase of k words."""
        has = (self.shortest <= k) & (k <= self.longest)
        return self.end[has], self.count[has]


def automaton(ids: np.ndarray, depth: int, known: list[np.ndarray] | None = None) -> Automaton:
    """Of phrases of 1 to depth words that hold no 0; known: from pairs on, whether the phrase of each size that ends at a position may
    be in a longer one."""
    at, cls = np.nonzero(ids)[0], None
    base = int(ids.max(initial=0)) + 1
    count, up, length, end, first = [], [], [], [], 0
    for k in range(1, depth + 1):
        if k == 1:
            key = ids[at].astype(np.int64)
        else:
            fits = at >= k - 1
            fits[fits] = ids[at[fits] - (k - 1)] > 0
            if known and 0 <= k - 3 < len(known):
                fits[fits] = known[k - 3][at[fits]] & known[k - 3][at[fits] - 1]
            at, cls = at[fits], cls[fits]
            key = cls * base + ids[at - (k - 1)]
        seen, cls_k, n = np.unique(key, return_inverse=True, return_counts=True)
        last = np.zeros(len(seen), np.int32)
        last[cls_k] = at
        count.append(n.astype(np.int32))
        up.append((first + seen // base if k > 1 else np.full(len(seen), -1)).astype(np.int32))
        length.append(np.full(len(seen), k, np.int8))
        end.append(last)
        first += len(count[-2]) if k > 1 else 0
        cls = cls_k
    count, up, length, end = map(np.concatenate, (count, up, length, end))
    # A class with as many ends as the one above it has the same ends: they are one state.
    joins = (up >= 0) & (count == count[up])
    state = np.ones(len(count), bool)
    state[up[joins]] = False
    top = np.arange(len(count), dtype=np.int32)
    for _ in range(depth - 1):
        top = np.where(joins[top], up[top], top)
    number = np.full(len(count), -1, np.int32)
    number[state] = np.arange(int(state.sum()))
    heir = np.arange(len(count), dtype=np.int32)  # the longest class of the state of a class
    below = np.full(len(count), -1, np.int32)
    below[up[joins]] = np.nonzero(joins)[0]
    for _ in range(depth - 1):
        heir = np.where(below[heir] >= 0, below[heir], heir)
    above = up[top[state]]
    return Automaton(length[top[state]], length[state], count[state], end[state], np.where(above >= 0, number[heir[above]], -1))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(shard, lang, words, ids, *further cells) by row."""
    for b in batches:
        for i in range(b.num_rows):
            shard, lang, words, ids = (b.column(c)[i].as_py() for c in ("shard", "lang", "words", "ids"))
            words = unpacked(words).decode()
            yield shard, lang, ["", *(words.split(" ") if words else [])], np.frombuffer(unpacked(ids), np.int32), *[c[i] for c in b.columns[4:]]


def word_rows(shards: DataFrame) -> DataFrame:
    """(shard, lang, phrase, number, f): the words of each shard, their numbers there and how often they occur."""

    def run(batches):
        for shard, lang, words, ids in opened(batches):
            n = np.bincount(ids, minlength=len(words))[1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array([lang] * len(n), pa.string()), pa.array(words[1:], pa.string()), pa.array(np.arange(1, len(n) + 1, dtype=np.int32)), pa.array(n)], names=["shard", "lang", "phrase", "number", "f"])

    return shards.select("shard", "lang", "words", "ids").mapInArrow(run, "shard long, lang string, phrase string, number int, f long")


def numbered(df: DataFrame) -> DataFrame:
    """df, cut, with its rows numbered from 1 in `id`, so densely that 32 bits hold 2^31 rows."""
    placed = cut(df.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))
    firsts = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=1)))
    first = F.broadcast(df.sparkSession.createDataFrame(firsts, "part long, first long"))
    return placed.withColumn("part", part).join(first, "part").withColumn("id", F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first")


def coded(shards: DataFrame, words: DataFrame, words_sent: int) -> DataFrame:
    """(shard, ids): shards with the numbers of frequent words, `words`, and 0 for other words; packed.

    Words are broadcast up to words_sent; beyond it each shard gets the numbers of those that it holds, by a join.
    """
    texts, sent = shards.select("shard", "lang", "words", "ids"), None
    if fits(words, words_sent):
        found = words.select("lang", "phrase", "id").toArrow()
        by_lang = ((lang, found.filter(pc.equal(found["lang"], lang))) for lang in pc.unique(found["lang"]))
        sent = words.sparkSession.sparkContext.broadcast({lang.as_py(): (x["phrase"].combine_chunks(), x["id"].to_numpy().astype(np.int32)) for lang, x in by_lang})
    else:
        own = split_join(word_rows(shards).drop("f"), words.select("lang", "phrase", "id", "f"), ["lang", "phrase"], "f")
        texts = texts.join(own.groupBy("shard").agg(F.collect_list(F.struct("number", "id")).alias("own")), "shard")

    def run(batches):
        for shard, lang, words, ids, *own in opened(batches):
            to = np.zeros(len(words), np.int32)
            if own:
                to[own[0].values.field("number").to_numpy()] = own[0].values.field("id").to_numpy()
            elif lang in sent.value:
                names, numbers = sent.value[lang]
                at = pc.fill_null(pc.index_in(pa.array(words[1:], names.type), value_set=names), -1).to_numpy()
                to[1:] = np.where(at >= 0, numbers[at], 0)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([packed(to[ids].tobytes())])], names=["shard", "ids"])

    return texts.mapInArrow(run, "shard long, ids binary")


def numbers_at(shorter: np.ndarray, ids: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """By position, the number of the frequent phrase that ends there, or 0. shorter: the same for phrases of a word less; keys,
    numbers: of frequent phrases, in order of keys."""
    at = np.nonzero((shorter[:-1] > 0) & (ids[1:] > 0))[0] + 1
    key = (shorter[at - 1].astype(np.int64) << 32) | ids[at]
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    out = np.zeros(len(ids), np.int32)
    out[at] = np.where(keys[place] == key, numbers[place], 0)
    return out


def phrase_rows(texts: DataFrame, size: int, sent: list[Broadcast | None]) -> DataFrame:
    """(shard, key, n): the phrases of so many words of each shard whose beginnings and ends are frequent, and how often they occur there.

    texts: of `coded`; for each size from 2 to size - 1 the keys and numbers of frequent phrases are broadcast, or a further column
    has those of the shard.
    """

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(unpacked(b.column("ids")[i].as_py()), np.int32)
                at, known, own = ids, [], iter(b.columns[2:])
                for s in sent:
                    if s:
                        keys, numbers = s.value
                    else:
                        cell = next(own)[i].values
                        keys, numbers = cell.field("key").to_numpy(), cell.field("id").to_numpy()
                        order = np.argsort(keys)
                        keys, numbers = keys[order], numbers[order]
                    at = numbers_at(at, ids, keys, numbers)
                    known.append(at > 0)
                ends, n = automaton(ids, size, known).phrases(size)
                key = (at[ends - 1].astype(np.int64) << 32) | ids[ends]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b.column("shard")[i].as_py(), np.int64)), pa.array(key), pa.array(n, pa.int64())], names=["shard", "key", "n"])

    return texts.mapInArrow(run, "shard long, key long, n long")


def phrase_counts(texts: DataFrame, words: DataFrame, least: int, depth: int, hashes_sent: int = HASHES) -> DataFrame:
    """(lang, phrase, size, f) of the phrases of 2 to depth words with f >= least; texts: of `coded`, words: those with f >= least, numbered.

    The numbers of frequent phrases of a size are broadcast if there are no more than hashes_sent. Beyond it each shard gets those
    that it holds, by a join: no more than it has words.
    """
    spark, sent, shorter, found = words.sparkSession, [], words.select("id", "lang", "phrase"), []
    for size in range(2, depth + 1):
        rows = phrase_rows(texts, size, [*sent])
        often = numbered(rows.groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        parts = often.select("id", "key", "f", F.shiftright("key", 32).alias("before"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("last"))
        named = lookup_join(parts, shorter.withColumnsRenamed({"id": "before", "phrase": "beginning"}), ["before"])
        named = lookup_join(named, words.select(F.col("id").alias("last"), F.col("phrase").alias("word")), ["last"])
        shorter = cut(named.select("id", "lang", F.concat_ws(" ", "beginning", "word").alias("phrase"), F.lit(size).alias("size"), "f"))
        found.append(shorter.drop("id"))
        shorter = shorter.select("id", "lang", "phrase")
        if size == depth or fits(often, 0):
            break
        if fits(often, hashes_sent):
            known = often.select("key", "id").orderBy("key").toArrow()
            sent.append(spark.sparkContext.broadcast((known["key"].to_numpy(), known["id"].to_numpy().astype(np.int32))))
        else:
            own = split_join(rows.select("shard", "key"), often.select("key", "id", "f"), "key", "f")
            texts = texts.join(cut(own.groupBy("shard").agg(F.collect_list(F.struct("key", "id")).alias(f"own_{size}"))), "shard")
            sent.append(None)
    return reduce(DataFrame.unionByName, found)


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, first: int = FIRST, share: int = SHARE, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS, hashes_sent: int = HASHES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, then a, then the phrase's bytes.

    Words are lower-cased (A-Z) and parted by blanks and tabs; a phrase of 2 to depth words doesn't go over `.,;:!?` or a line
    break. a, l, r: how often the phrase and the two parts of its weakest cut occur, n: the words of the language; score:
    floor(1000 a n / (l r)) at that cut. Phrases rarer than `least` are left out, and those inside of a longer one that occurs at
    least `share` percent as often.

    Null languages are `und`, null texts are empty. Repeated rows count each. Texts without words, languages without frequent
    phrases and an empty table give no rows; other columns play no part. A text is held whole by one task.
    """
    shards, folder = stored(sharded(docs, lang_col, text_col, shard_words), "shards")
    words = numbered(word_rows(shards).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    total = cut(shards.groupBy("lang").agg(F.sum("n").alias("n")))
    texts, numbers = stored(coded(shards, words, min(hashes_sent, WORDS_SENT)), "numbers")
    forget(docs.sparkSession, folder)
    found = phrase_counts(texts, words, least, depth, hashes_sent)
    forget(docs.sparkSession, numbers)
    parts = words.drop("id").unionByName(found.select("lang", "phrase", "f"))
    join = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = found.join(F.broadcast(total), "lang").withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "n", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = lookup_join(cuts, parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = lookup_join(cuts, parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n")).withColumn("under", whole("l") * whole("r"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("top div under").alias("score"), "k", "l", "r")).alias("at"))
    # What a phrase holds: the phrases along its suffix links, and their beginnings.
    inner = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size")), lambda s: F.transform(F.sequence(F.lit(1), F.col("size")), lambda k: F.when((k >= 2) & (k < F.col("size")) & (s + k - 1 <= F.col("size")), F.array_join(F.slice("w", s, k), " "))))), lambda x: x.isNotNull())
    longer = found.where("size > 2").withColumn("w", F.split("phrase", " ")).select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("at.score"), F.desc("a"), "phrase"))
    out = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
    return out.select("lang", "rank", "phrase", "a", "at.l", "at.r", "n", "at.score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op11_sql() -> str:
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
sized AS (SELECT lang, w, unnest(range(1, {DEPTH + 1})) AS size FROM worded WHERE len(w) > 0),
placed AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized WHERE len(w) >= size),
f AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM placed GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT lang, phrase, f AS a, w, size, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
  FROM cuts AS c JOIN total AS t ON t.lang = c.lang
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
starts AS (SELECT lang, f, w, size, unnest(range(1, size)) AS s FROM cand WHERE size > 2),
inside AS (SELECT lang, f, w, size, s, unnest(range(2, size)) AS k FROM starts),
longer AS (SELECT lang, array_to_string(w[s : s + k - 1], ' ') AS phrase, max(f) AS longer FROM inside WHERE s + k - 1 <= size GROUP BY ALL),
ranked AS (
  SELECT k.*, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(k.phrase)) AS rank
  FROM weakest AS k LEFT JOIN longer AS g ON g.lang = k.lang AND g.phrase = k.phrase WHERE g.longer IS NULL OR 100 * g.longer < {SHARE} * k.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {FIRST}"""
