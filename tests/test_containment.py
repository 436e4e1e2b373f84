"""Joins by containment against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import companions, containment, escalation


def _told(found):
    return sorted((r["doc"]["doc_id"], r["mark"]["seq"], r["start"]) for r in found.collect())


def _plain(docs, marks):
    return sorted((d, s, t.find(m)) for d, t in docs for s, m in marks if t and m and m in t)


def _tables(spark, docs, marks):
    return spark.createDataFrame(docs, "doc_id int, text string").repartition(5), spark.createDataFrame(marks, "seq int, text string").repartition(3)


def test_marks_of_all_lengths(spark):
    r = random.Random(1)
    words = ["the ", "a ", "Stra\u00dfe ", "\U0001f600", "aaaaaaaaaaaaaaaa", "xyz", "common passage of some words here ", "\n", "\u6771\u4eac"]
    docs = [(n, "".join(r.choice(words) for _ in range(r.randint(0, 60)))) for n in range(150)] + [(900, None), (901, ""), (902, "a" * 200_000), (3, "the the the ")]
    marks = [(n, "".join(r.choice(words) for _ in range(r.randint(1, 4)))) for n in range(60)]
    for n in range(200):
        text = docs[r.randrange(150)][1] or ""
        size = r.choice([1, 2, 3, 4, 5, 11, 12, 13, 40, 200])
        at = r.randint(0, max(0, len(text) - size))
        marks.append((100 + n, text[at : at + size]))
    marks += [(800, "a" * 100_000), (801, "a" * 199_999 + "b"), (802, ""), (803, None), (804, "the "), (805, "the ")]
    assert _told(containment.containment(*_tables(spark, docs, marks))) == _plain(docs, marks)


def test_a_hot_gram_is_not_dealt_by(spark):
    docs = [(n, f"the common beginning of all and number {n} of them") for n in range(400)]
    marks = [(n, f"the common beginning of all and number {n} of") for n in range(0, 400, 2)]
    found = containment.containment(*_tables(spark, docs, marks))
    assert _told(found) == _plain(docs, marks)


@pytest.mark.parametrize("docs,marks", [([], [(1, "a")]), ([(1, "a")], []), ([(1, "a")], [(1, ""), (2, None)]), ([(1, None)], [(1, "x")])])
def test_nothing_to_find(spark, docs, marks):
    assert containment.containment(*_tables(spark, docs, marks)).collect() == []


def test_other_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "some text", 5)] * 2, "mark int, text string, row int")
    marks = spark.createDataFrame([("text", 7), ("text", 7)], "words string, doc int")
    got = containment.containment(docs, marks, mark_text="words").collect()
    assert len(got) == 4 and {(r["doc"]["row"], r["mark"]["doc"], r["start"]) for r in got} == {(5, 7, 5)}


def test_first_of_many_canaries(spark):
    made = [(k, f"canary-{k * 2654435761 % 2**32:032x}") for k in range(3000)]
    docs = [(1, f"x {made[2000][1]} y {made[7][1]}{made[9][1]}"), (2, "canary-canary-" + made[5][1]), (3, None), (4, "canary-none"), (5, made[11][1][:-1]), (6, f"{made[8][1]}")]
    outputs = spark.createDataFrame(docs, "id int, text string")
    listed = spark.createDataFrame([*made, (-1, ""), (-2, None), (3001, made[7][1])], "ord int, canary string")
    got = {r["id"]: r["leak"] and tuple(r["leak"]) for r in containment.first_leaks(outputs, listed, "canary-", 39).collect()}
    assert got == {1: (made[7][1], 44), 2: (made[5][1], 14), 3: None, 4: None, 5: None, 6: (made[8][1], 0)}


@pytest.mark.parametrize("kind", ["int", "long", "short", "string"])
def test_keys_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, "abc")], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    marks = spark.createDataFrame([(2, "b", "s")], "mark_seq int, text string, source string").withColumn("mark_seq", F.col("mark_seq").cast(kind))
    r = companions.taint_matches(docs, marks).first()
    assert (str(r["doc_id"]), str(r["mark_seq"])) == ("1", "2") and dict(companions.taint_matches(docs, marks).dtypes)["mark_seq"] == marks.schema["mark_seq"].dataType.simpleString()
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, v array<float>").withColumn("k", F.col("k").cast(kind))
    found = escalation.embedding_search(vectors, vectors, "k", "v", k=1)
    assert sorted((str(x["k"]), round(x["score"], 6)) for x in found.collect()) == [("1", 1.0), ("2", 1.0)]
