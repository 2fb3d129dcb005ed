import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup as ld


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def units(spark, text):
    return texts(spark, [text]).select(ld.pieces_of(F.col("text")).alias("u")).first().u


@pytest.mark.parametrize("letters", ["ABCDEFGHIJKLM", "бвгдежзиклмно", "ابتثجحخدذرزس", "漢"])
def test_passages_inside_lines_of_one_case_are_found(spark, letters):
    r = random.Random(7)
    words = [chr(0x4E00 + 7 * i) for i in range(150)] if letters == "漢" else ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(150)]
    gap = "" if letters == "漢" else " "
    say = lambda n: gap.join(r.choice(words) for _ in range(n))
    passage = say(80)
    rows = [gap.join((say(r.randint(60, 130)), passage, say(r.randint(60, 130)))) for _ in range(6)]
    rows.append(gap.join((say(90), passage, say(70), passage, say(90))))
    clean = [say(150) for _ in range(4)]
    got = {x.doc_id: x for x in ld.dedup_units(texts(spark, rows + clean), min_line=5).collect()}
    n = ld.word_count
    first = n(got[0].text)
    assert first == n(rows[0])  # the earliest stays whole
    for i in range(1, 6):
        gone = n(rows[i]) - n(got[i].text)
        assert 50 <= gone <= 80 and passage not in got[i].text, i
    assert passage not in got[6].text and n(rows[6]) - n(got[6].text) >= 110
    for i, t in enumerate(clean):
        assert got[len(rows) + i].text == t
    for i, t in enumerate(rows + clean):  # what stays and what goes are the text
        left, at = [], 0
        for s in got[i].removed:
            left.append(t[at : s.start])
            at = s.start + s.length
        assert "".join([*left, t[at:]]) == got[i].text


def test_units_put_together_are_the_text_and_are_cut_by_what_they_hold(spark):
    r = random.Random(2)
    for _ in range(30):
        t = "".join(r.choice(["a", "B", " ", "  ", "\t", "\n", ". ", "。", "漢", "字", "é", "word ", "\x0b", "WORD "]) for _ in range(r.randint(0, 900)))
        assert "".join(units(spark, t)) == t
    a = " ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(400))
    u, v = units(spark, a), units(spark, "zz yy xx ww " + a)
    assert len(u) > 20 and u[2:] == v[-len(u) + 2 :] and max(len(x.split()) for x in u) <= 2 * ld.EDGE


def test_repeated_words_and_long_texts(spark):
    began = time.time()
    rows = ["w " * 500_000, "one two three " * 20_000, "x" * 1_000_000, None, "", "漢字" * 50_000]
    got = {x.doc_id: x for x in ld.dedup_units(texts(spark, rows)).collect()}
    assert time.time() - began < 90
    assert len(got[0].text) < 200 and len(got[1].text.split()) <= 3 * ld.EDGE + 1 and got[2].text == rows[2] and got[3].text is None and got[4].text == "" and len(got[5].text) <= 200


def test_words_are_counted_by_character_where_there_are_no_spaces():
    assert [ld.word_count(t) for t in ("", "a  b\n", "漢字", "漢字 ab c", "ไทย", "한국 말")] == [0, 2, 2, 4, 3, 2]


def test_late_places_of_a_text_are_not_copied(spark, monkeypatch):
    line = "one two three four five six\n"
    rows = [(None, line), *[(i, line + f"own words of {i}") for i in range(40)], *[(7, line + "twice")] * 5, (None, line), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small, real = [], ld.split_join
    monkeypatch.setattr(ld, "split_join", lambda big, s, *a: small.append(s) or real(big, s, *a))
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in ld.dedup_units(docs, min_line=5).collect()), key=str)
    want = [(0, line + "own words of 0", 0), *[(i, f"own words of {i}", 1) for i in range(1, 40)], *[(7, "twice", 1)] * 5, (None, "", 1), (None, "", 1), (None, None, 0)]
    assert got == sorted(want, key=str)
    late = small[-1].select("count_of_rows").collect()
    assert len(late) == 41 and sorted(r[0] for r in late)[-2:] == [2, 5]


def test_texts_with_late_units_are_not_cut_again(spark, monkeypatch):
    rows = ["one two three four five six\nOwn words. And more\n", "one two three four five six\n\n A  last line", "nothing of that", "", None]
    small, real = [], ld.split_join
    monkeypatch.setattr(ld, "split_join", lambda big, s, *a: small.append(s) or real(big, s, *a))
    got = {r.doc_id: r.n_units for r in ld.dedup_units(texts(spark, rows), min_line=5).collect()}
    assert got == {i: len(units(spark, t)) if t else 0 for i, t in enumerate(rows)}
    assert [r.sizes for r in small[-1].collect()] == [[len(u) for u in units(spark, rows[1])]]


def test_units_are_normalised_as_by_one_pattern(spark):
    r = random.Random(5)
    rows = ["".join(r.choice(["a", "B", "É", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\xa0", "　"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    got = texts(spark, rows).select(ld.normal(F.col("text")).alias("a"), F.trim(F.lower(F.regexp_replace("text", r"\s+", " "))).alias("b")).collect()
    assert all(x.a == x.b for x in got)
