"""Substring deduplication by line or paragraph hashing.

Units are normalised and hashed; digests are grouped globally; the earliest ranked occurrence stays and the others go, with
their places in the original text kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table
from tessera.plans.lineage import cut, forget, stored
from tessera.plans.skew import split_join

#: Words from which a repeated line, or a run of repeated units within lines, is removed. One word a line is the exact mode;
#: the registered query takes QUERY_MIN_LINE, so that a "Yes." that many clean documents hold is left to them.
MIN_LINE, MIN_RUN, QUERY_MIN_LINE = 1, 20, 5
#: Digests up to which they are broadcast to the units: they grow with the corpus, so that only small corpora do so.
DIGESTS = 20_000
#: Units end after a line break, and within a line where a capital follows a small letter, or a letter without case or a capital
#: follows the end of a sentence: at sentences, and at the seams of passages that were pasted into other text. The pieces put
#: together are the text. The letter is tried first: looking back is slow.
PIECES = r"(?<=\n)|(?=[\p{Lu}\p{Lo}])(?<=(?:\p{Ll}|[\p{Ll}\p{Lu}\p{Lo}\p{M}\p{Nd}][.!?\u061F\u0964]|\p{Ll}[,;:]) )|(?<=[\u3002\uFF01\uFF1F])"
#: Pieces of more characters are cut further, at one in EVERY places between words, as a hash of the two words tells, so that equal
#: passages are cut alike wherever they stand; where EDGE words have no such place, at each EDGE-th word of the piece.
LONG, LONG_UNSPACED, EVERY, EDGE = 400, 40, 6, 32
#: Scripts without spaces: each character is a word.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
WORDS = rf"(?<=\s)(?=\S)|(?<=[{UNSPACED}])(?=[^\s])|(?<=\S)(?=[{UNSPACED}])"
PARAGRAPHS = r"(?<=\n\n)"


_WORD = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")


def word_count(unit: str) -> int:
    return len(unit.split()) if unit.isascii() else len(_WORD.findall(unit))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cut_long(piece: Column) -> Column:
    """The parts of a long piece; put together they are the piece."""

    def parts(words: Column) -> Column:
        hashed = F.transform(words, lambda w: F.xxhash64(F.lower(F.rtrim(w, F.lit(" \t\n\x0b\f\r")))))
        marked = named(hashed, lambda h: F.transform(h, lambda x, i: (i > 0) & (F.pmod(F.xxhash64(F.get(h, i - 1), x), F.lit(EVERY)) == 0)))

        def at(marks: Column) -> Column:
            bare = lambda i: ~F.exists(F.slice(marks, F.greatest(i - EDGE + 2, F.lit(1)), EDGE), lambda m: m)
            starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(marks, i) | (i == 0) | ((F.pmod(i, F.lit(EDGE)) == 0) & bare(i)))
            return named(starts, lambda s: F.transform(s, lambda first, j: F.array_join(F.slice(words, first + 1, F.coalesce(F.get(s, j + 1), F.size(words)) - first), "")))

        return named(marked, at)

    return named(F.split(piece, WORDS), parts)


def pieces_of(text: Column) -> Column:
    """The units of a text by line: lines, sentences, and parts of long ones."""
    # Only pieces with letters outside of ASCII are searched for scripts without spaces.
    long = lambda p: (F.char_length(p) > LONG) | ((F.char_length(p) > LONG_UNSPACED) & (F.octet_length(p) > F.char_length(p)) & p.rlike(f"[{UNSPACED}]"))
    return F.flatten(F.transform(F.split(text, PIECES), lambda p: F.when(long(p), cut_long(p)).otherwise(F.array(p))))


def normal(unit: Column) -> Column:
    """unit in lower case, with single spaces for white space and none around it; the pattern is tried only where there is such white space."""
    odd = [unit.contains(s) for s in ("  ", "\n", "\t", "\r", "\x0b", "\x0c")]
    return F.trim(F.lower(F.when(reduce(or_, odd), F.regexp_replace(unit, r"\s+", " ")).otherwise(unit)))


def hashed_units(docs: DataFrame, id_col: str, text_col: str, pieces: Column) -> DataFrame:
    """(n, id, t, units) by row of docs: whether its id is null, id, hash of the text, and each unit's length and 128-bit hash
    (null where a unit is blank)."""
    hashes = lambda u: F.when(u != "", F.struct(F.xxhash64(u).alias("h1"), F.xxhash64(F.lit("second"), u).alias("h2")))
    units = F.transform(pieces, lambda p: F.struct(F.char_length(p).alias("size"), named(normal(p), hashes).alias("hash")))
    return docs.select(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), units.alias("units"))


def lost(words: list[int], ends: list[bool], late: set[int], min_line: int, min_run: int) -> set[int]:
    """Which of the late units go: those of whole late lines, and of runs of late units, with enough words.

    Units without words are never late; they neither end a run nor count in it, and go with a run that they are inside of.
    """
    gone, run, line = set(), [], []
    for i in range(len(words) + 1):
        if i < len(words) and (i in late or run and not words[i]):
            run.append(i)
        else:
            while run and not words[run[-1]]:
                run.pop()
            if sum(words[j] for j in run) >= min_run:
                gone.update(run)
            run = []
        if i < len(words):
            line.append(i)
            if ends[i] or i == len(words) - 1:
                if all(j in late or not words[j] for j in line) and sum(words[j] for j in line) >= max(1, min_line):
                    gone.update(line)
                line = []
    return gone


def late_units(texts: DataFrame) -> DataFrame:
    """texts: of hashed_units -> (n, id, t, late, sizes, times): of each text that has late units their places, the lengths of all
    its units, and how many rows have this id and text.

    Digests are counted by hash aggregation first; the first place is looked for only among those that occur twice.
    """
    units = texts.select("n", "id", "t", F.posexplode("units").alias("pos", "unit")).where(F.col("unit.hash").isNotNull())
    units = units.select("unit.hash.h1", "unit.hash.h2", "n", "id", "t", "pos")
    counts = cut(units.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1"))
    again, folder = stored(split_join(units, counts, ["h1", "h2"], "times", DIGESTS), "repeated-units")
    firsts = again.groupBy("h1", "h2").agg(F.min(F.struct("n", "id", "t", "pos")).alias("first"), F.count("*").alias("times"))
    late = split_join(again, cut(firsts), ["h1", "h2"], "times", DIGESTS).where(F.struct("n", "id", "t", "pos") > F.col("first"))
    # Each row brings its lengths once, so that these count the rows.
    both = late.select("n", "id", "t", "pos").unionByName(texts.select("n", "id", "t", F.col("units.size").alias("sizes")), allowMissingColumns=True)
    late = both.groupBy("n", "id", "t").agg(F.collect_set("pos").alias("late"), F.first("sizes", True).alias("sizes"), F.count("sizes").alias("times"))
    late = cut(late.where(F.size("late") > 0))
    forget(texts.sparkSession, folder)
    return late


def dedup_units(docs: DataFrame, unit: str = "line", min_line: int = MIN_LINE, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten and n_units, n_removed, removed added (array of (start, length) in code points of the original).

    unit: "line" (its sentences, and parts of long ones) or "paragraph". Units are equal if they are the same after lower-casing and turning
    white space into single spaces; a 128-bit hash stands for them. The first by (id, hash of the text, place) stays, null ids
    last; later ones are late, and go as `lost` tells: by default every whole line that is late. Rows of equal id and text
    count as one and come out equal. Null text stays null and empty text empty, without units removed. An empty table gives an
    empty result.
    """
    docs = docs.drop("n_units", "n_removed", "removed").withColumn(text_col, F.col(text_col).cast("string"))
    k_id, k_text, late_, sizes_, n_, times_ = fresh(docs, "key_id", "key_text", "late_at", "sizes", "count_of_units", "count_of_rows")
    pieces = pieces_of(F.col(text_col)) if unit == "line" else F.split(text_col, PARAGRAPHS)
    key_text = F.xxhash64(text_col)
    texts, folder = stored(hashed_units(docs, id_col, text_col, pieces), "units")
    late = late_units(texts).select(F.struct("id").alias(k_id), F.col("t").alias(k_text), F.col("late").alias(late_), F.col("sizes").alias(sizes_), F.col("times").alias(times_))
    forget(docs.sparkSession, folder)
    # Positions grow with the corpus: they are never broadcast. A struct of a null id equals another.
    out = split_join(docs.withColumn(k_id, F.struct(F.col(id_col).alias("id"))).withColumn(k_text, key_text), late, [k_id, k_text], times_, -1, "left")
    # Texts with late units bring their lengths along; only the others are cut again, to be counted.
    out = out.withColumn(n_, F.when(F.col(sizes_).isNotNull(), F.size(sizes_)).when(F.length(text_col) > 0, F.size(pieces)).otherwise(0).cast("long"))
    cols = docs.columns
    where = cols.index(text_col)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_units"), F.lit(0).cast("long").alias("n_removed"), F.expr("CAST(NULL AS array<struct<start:bigint,length:bigint>>) AS removed")).schema
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, k, taken, (*cells, sizes, late, count) = [], [], [], b.columns
            for i in range(b.num_rows):
                text = cells[where][i]
                if not late[i].is_valid:
                    texts.append(text.as_py()), k.append(0), taken.append([])
                    continue
                whole, size = text.as_py(), sizes[i].as_py()
                starts = [0, *accumulate(size)]
                parts = [whole[s : s + n] for s, n in zip(starts, size)]
                gone = lost([word_count(u) for u in parts], [u.endswith("\n") for u in parts], set(late[i].as_py()), min_line, min_run)
                texts.append("".join(u for j, u in enumerate(parts) if j not in gone) if gone else whole)
                k.append(len(gone))
                taken.append([{"start": starts[j], "length": size[j]} for j in sorted(gone)])
            cells[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cells, count, pa.array(k, pa.int64()), pa.array(taken, spans)], names=schema.names)

    return out.select(*cols, sizes_, late_, n_).mapInArrow(run, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"), min_line=QUERY_MIN_LINE)
