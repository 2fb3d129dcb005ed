"""Benchmark decontamination over a distributed positional inverted index (native DataFrame operations only).

The corpus is cut into words once; the postings (document, position, term) of the benchmark's words are stored as a table.
Offset-adjusted lists of the rarest words of each block of an item are intersected, which leaves the few diagonals (document,
item, shift) on which a window can lie; these are then intersected with the lists of all the words there, which gives the
exact phrases. `proximity_matches` answers unordered matches within a span from the same postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, fresh, table
from tessera.plans.lineage import cut, forget, stored
from tessera.plans.skew import fits, lookup_join

#: What lies between words, once A-Z are lower-cased: all ASCII but 0-9 and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Share of hit words from which a document counts as contaminated: one in so many.
ONE_IN = 20
#: Words of a document within which a proximity match lies.
SPAN = 30
KEYS = ["k1", "k2"]


def parts(text: Column) -> Column:
    """The words, and an empty string before or behind them where the text begins or ends between words; null is empty."""
    return F.split(ascii_lower(text), BETWEEN)


def words(text: Column) -> Column:
    return F.filter(parts(text), lambda x: x != "")


def n_parts(cut_up: Column) -> Column:
    """Number of words of what `parts` gives."""
    last = F.element_at(cut_up, -1)
    return (F.size(cut_up) - (cut_up[0] == "").cast("int") - ((F.size(cut_up) > 1) & (last == "")).cast("int")).cast("long")


def text_keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text: equal texts are searched as one, whatever their ids."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def sequences(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(tid, words, len, block, items): the distinct word sequences, the length of their windows and blocks, and their items.

    A window is `width` words, or the whole sequence if it is shorter. Sequences are cut into blocks of such a size that each
    window holds a whole one. Items without words, or without an id, have none. tid is a 64-bit hash of the sequence.
    """
    w = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    each = w.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return each.select(F.xxhash64(F.array_join("words", " ")).alias("tid"), "words", F.least(n, F.lit(width)).alias("len"), F.when(n < width, n).otherwise((width + 1) // 2).alias("block"), "items")


def offsets(seqs: DataFrame, *cols: str) -> DataFrame:
    """(tid, off, term, word) and the given columns; term is a 64-bit hash of the word."""
    at = seqs.select("tid", *cols, F.posexplode("words").alias("off", "word"))
    return at.withColumn("term", F.xxhash64("word"))


def index(docs: DataFrame, text_col: str, vocabulary: DataFrame) -> tuple[DataFrame, str]:
    """The stored positional index (k1, k2, pos, term) of the words in vocabulary (word, term), and its folder.

    Texts are cut once, here. pos counts the words of the text from 0.
    """
    cut_up = docs.select(*[k.alias(n) for k, n in zip(text_keys(F.col(text_col)), KEYS)], parts(F.col(text_col)).alias("parts"))
    each = cut_up.select(*KEYS, (F.col("parts")[0] == "").cast("int").alias("lead"), F.posexplode("parts").alias("at", "word")).where("word <> ''")
    hit = each.join(F.broadcast(vocabulary), "word") if fits(vocabulary) else lookup_join(each, vocabulary, ["word"])
    return stored(hit.select(*KEYS, (F.col("at") - F.col("lead")).alias("pos"), "term"), "postings")


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("cf"))


def rarest(at: DataFrame, frequency: DataFrame, by: list[str], lists: int) -> DataFrame:
    """at (by, term, off, ...) with bit and need: the `lists` rarest of each group by frequency in the corpus, leftmost first.

    Groups with a word that the corpus lacks can't occur and are left out.
    """
    w = W.partitionBy(*by)
    at = at.join(frequency, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    at = at.withColumn("least", F.min("cf").over(w)).withColumn("nth", F.row_number().over(w.orderBy("cf", "off"))).where((F.col("least") > 0) & (F.col("nth") <= lists))
    at = at.withColumn("bit", F.expr("shiftleft(1, CAST(nth AS INT) - 1)"))
    return at.withColumn("need", F.bit_or("bit").over(w)).drop("cf", "least", "nth")


def diagonals(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(k1, k2, tid, shift, blk): where the offset-adjusted lists of all anchors (term, tid, off, blk, bit, need) of a block meet.

    The item's word `off` would stand at shift + off in the document.
    """
    met = lookup_join(postings, anchors, ["term"]).withColumn("shift", F.col("pos") - F.col("off"))
    met = met.groupBy(*KEYS, "tid", "shift", "blk").agg(F.bit_or("bit").alias("got"), F.max("need").alias("need"))
    return met.where("got = need").select(*KEYS, "tid", "shift", "blk")


def phrase_hits(postings: DataFrame, seqs: DataFrame, lists: int = 2) -> DataFrame:
    """(k1, k2, tid, pos): the words of documents inside occurrences of windows, from the postings alone; distinct."""
    at = offsets(seqs, "len", "block").withColumn("blk", F.floor(F.col("off") / F.col("block")).cast("int"))
    whole = seqs.select("tid", F.floor(F.size("words") / F.col("block")).alias("blocks"))
    full = at.join(whole, "tid").where(F.col("blk") < F.col("blocks")).drop("blocks", "len", "block", "word")
    anchors = cut(rarest(full, frequencies(postings), ["tid", "blk"], lists))
    places = cut(diagonals(postings, anchors))
    # All words of a window that holds the block lie within len - block words of it.
    around = seqs.select("tid", F.size("words").alias("n"), (F.col("len") - F.col("block")).alias("more"), "block", "len")
    spots = lookup_join(places, around, ["tid"])
    first, last = F.greatest(F.col("blk") * F.col("block") - F.col("more"), F.lit(0)), F.least((F.col("blk") + 1) * F.col("block") + F.col("more"), F.col("n")) - 1
    spots = spots.select(*KEYS, "tid", "shift", "len", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("off")).distinct()
    wanted = lookup_join(spots, offsets(seqs).drop("word"), ["tid", "off"]).withColumn("pos", F.col("shift") + F.col("off"))
    texts = places.select(*KEYS).distinct()
    near = postings.join(F.broadcast(texts) if fits(texts) else texts, KEYS, "left_semi")
    met = near.join(wanted, [*KEYS, "pos", "term"]).select(*KEYS, "tid", "shift", "len", "off").distinct()
    # Runs of consecutive offsets of a window's length or more; a diagonal has no more rows than its item has words.
    line = W.partitionBy(*KEYS, "tid", "shift")
    met = met.withColumn("run", F.col("off") - F.row_number().over(line.orderBy("off")))
    met = met.withColumn("long", F.count("*").over(W.partitionBy(*KEYS, "tid", "shift", "run")))
    return met.where(F.col("long") >= F.col("len")).select(*KEYS, "tid", (F.col("shift") + F.col("off")).alias("pos")).distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, span: int = SPAN, lists: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc id, item_id, off, pos): windows of items (from word `off`) whose distinct words all lie, in any order, within span
    consecutive words of the document; pos is the first word at which such a span can begin with a word of the window.

    Postings of the `lists` rarest words that lie near enough propose, the postings of all words decide. Null ids of documents
    are kept, items with null id take no part; null and empty texts match nothing; equal texts are searched once, and each row
    of docs with that text has its own result rows. Empty tables give an empty result.
    """
    seqs = cut(sequences(items, item_id, item_text, width))
    postings, folder = index(docs, text_col, offsets(seqs).select("word", "term").distinct())
    n = F.size("words")
    wins = seqs.select("tid", "words", "len", F.explode(F.sequence(F.lit(0), n - F.col("len"))).alias("s"))
    terms = wins.select("tid", "s", F.explode(F.array_distinct(F.slice("words", F.col("s") + 1, F.col("len")))).alias("word")).withColumn("term", F.xxhash64("word"))
    terms = cut(terms.withColumn("off", F.col("term")).drop("word"))  # among equally frequent words the hash decides
    anchors = cut(rarest(terms, frequencies(postings), ["tid", "s"], lists).drop("off"))
    by = W.partitionBy(*KEYS, "tid", "s").orderBy("pos").rangeBetween(1 - span, span - 1)
    near = lookup_join(postings, anchors, ["term"]).withColumn("got", F.bit_or("bit").over(by)).where("got = need AND bit = 1")
    near = near.select(*KEYS, "tid", "s", F.col("pos").alias("q"), F.explode(F.sequence(F.floor(F.col("pos") / span) - 1, F.floor(F.col("pos") / span) + 1)).alias("slot"))
    texts = near.select(*KEYS).distinct()
    slots = postings.join(F.broadcast(texts) if fits(texts) else texts, KEYS, "left_semi").withColumn("slot", F.floor(F.col("pos") / span))
    both = slots.join(near, [*KEYS, "slot"]).where(F.abs(F.col("pos") - F.col("q")) < span)
    both = both.join(terms.select("tid", "s", "term"), ["tid", "s", "term"])
    # At most 2 span - 1 postings lie around one of the rarest word.
    each = both.groupBy(*KEYS, "tid", "s", "q").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("at"))
    size = terms.groupBy("tid", "s").agg(F.count("*").alias("n_terms"))
    each = lookup_join(each, size, ["tid", "s"])
    inside = lambda x: F.size(F.array_distinct(F.transform(F.filter("at", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + span)), lambda y: y["term"]))) == F.col("n_terms")
    begin = F.array_min(F.transform(F.filter("at", inside), lambda x: x["pos"]))
    found = each.select(*KEYS, "tid", "s", begin.alias("pos")).where("pos IS NOT NULL").groupBy(*KEYS, "tid", "s").agg(F.min("pos").alias("pos"))
    found = cut(lookup_join(found, seqs.select("tid", F.explode("items").alias("item_id")), ["tid"]))
    forget(docs.sparkSession, folder)
    ids = docs.select(F.col(id_col).alias("of_doc"), *[k.alias(c) for k, c in zip(text_keys(F.col(text_col)), KEYS)])
    return lookup_join(ids, found, KEYS).select(F.col("of_doc").alias(id_col), "item_id", F.col("s").alias("off"), "pos")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids, items_sha256, contaminated added (columns of these names are replaced).

    A document word inside any occurrence of a benchmark window is hit; a document is contaminated from one hit word in
    ONE_IN on. Null and empty texts have no words and are never contaminated. Texts are searched once each, so null and
    repeated ids are safe and rows of equal text get equal results. Without items nothing is hit; items with null id take no
    part. An empty table gives an empty result. Words and texts are told apart by 64- and 128-bit hashes.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated")
    seqs = cut(sequences(items, item_id, item_text, width))
    postings, folder = index(docs, text_col, offsets(seqs).select("word", "term").distinct())
    hits = cut(phrase_hits(postings, seqs))
    n_hit = hits.select(*KEYS, "pos").distinct().groupBy(*KEYS).agg(F.count("*").alias("n_hit"))
    named = lookup_join(hits.select(*KEYS, "tid").distinct(), seqs.select("tid", "items"), ["tid"]).select(*KEYS, F.explode("items").alias("item"))
    named = named.groupBy(*KEYS).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))  # no more than there are items
    k1, k2, p_ = fresh(docs, "key_of_text", "second_key", "cut_up")
    found = cut(n_hit.join(named, KEYS).select(F.col("k1").alias(k1), F.col("k2").alias(k2), "n_hit", "item_ids"))
    forget(docs.sparkSession, folder)
    keyed = docs.withColumns(dict(zip((k1, k2), text_keys(F.col(text_col)))))
    out = lookup_join(keyed, found, [k1, k2], "left", 100_000).drop(k1, k2)
    out = out.withColumn(p_, parts(F.col(text_col))).withColumn("n_words", n_parts(F.col(p_))).drop(p_)
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    out = out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of the same index: passages whose words were put in another order or mixed with others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return proximity_matches(docs, table(spark, sf_dir, "benchmark"))


def op1_sql() -> str:
    """All windows by plain enumeration: no index."""
    return f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + {WINDOW} - 1], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dp.n, item_id FROM dp JOIN win USING (phrase)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""
