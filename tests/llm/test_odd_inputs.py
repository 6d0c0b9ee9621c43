"""Inputs that once crashed an operator or gave rows that followed the layout."""

import time

import pytest
from pyspark.sql import functions as F

from lapsewise.llm import decontaminate, html_text, jaccard, pii, secrets, vectors
from lapsewise.llm.common import without_ids


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e-200, 1e-200], 0), (2, [2e-200, 2e-200], 0), (3, [1e200, 1e200], 0), (4, [1.0, 1.0], 0), (5, [5e-324, 5e-324], 0), (6, [-1.7e308, 1.7e308], 0), (7, [1.0, -1.0], 0)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.id: (r.n_links, r.component_id) for r in found} == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (0, 6), 7: (0, 7)}


@pytest.mark.parametrize("kind, labels", [("string", ["a", "b"]), ("double", [1.2, 1.7]), ("boolean", [True, False])])
def test_labels_of_any_type(spark, kind, labels):
    rows = [(i, [1.0, float(i % 2)], labels[i // 2 % 2]) for i in range(8)] + [(8, [1.0, 0.0], None)]
    found = vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()
    assert {r.id: (r.n_links, r.component_id) for r in found} == {0: (1, 0), 4: (1, 0), 1: (1, 1), 5: (1, 1), 2: (1, 2), 6: (1, 2), 3: (1, 3), 7: (1, 3), 8: (0, 8)}


@pytest.mark.parametrize("parts", [1, 4])
def test_rows_that_share_a_key(spark, parts):
    """Two texts of one id are two sets, wherever they lie."""
    a, b = ([f"{x}{i}" for i in range(24)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:8] + ["z"] * 1 + b[:15])), (3, " ".join([*a, "more"])), (4, " ".join([*b, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts)
    found = {(r.id, r.n_shingles): r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert found == {(1, 20): 1, (2, 20): 2, (3, 21): 1, (4, 21): 1}


def test_many_spans_in_one_text(spark):
    one = "mail me@here.org or call +49 170 1234567, 10.0.0.1; "
    df = spark.createDataFrame([(1, one), (2, one * 9_000)], "doc_id long, text string")
    started = time.time()
    rows = {r["id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert time.time() - started < 60
    first = [(s["kind"], s["start"], s["end"], s["value"]) for s in rows[1]]
    assert len(first) == 3 and len(rows[2]) == 27_000
    want = sorted((k, s + i * len(one), e + i * len(one), v) for i in range(9_000) for k, s, e, v in first)
    assert sorted((s["kind"], s["start"], s["end"], s["value"]) for s in rows[2]) == want


def test_clashing_names_and_dots(spark):
    names = ["id_to_drop", "may_hold_a_secret", "_found", "_later", "id", "words"]
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(1, body, *names), (2, body, *names), (3, 'password = "q8Zr4LmX0pTkW2vB"', *names), (None, body, *names)]
    df = spark.createDataFrame(rows, "`doc.id` long, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(16)))], "item_id long, text string")
    kept = decontaminate.decontaminated(df, bench, key="doc.id")
    assert kept.columns == df.columns and [r[0] for r in kept.orderBy(F.col("`doc.id`")).collect()] == [None, 3]
    kept = jaccard.firsts(df, key="doc.id")
    assert kept.columns == df.columns and [r[0] for r in kept.orderBy(F.col("`doc.id`")).collect()] == [None, 1, 3]
    hidden = secrets.masked(df)
    assert hidden.columns == df.columns and "q8Zr4LmX0pTkW2vB" not in " ".join(r["text"] for r in hidden.collect())
    assert without_ids(df, "doc.id", spark.createDataFrame([(2,), (2,)], "id long")).count() == 3


def test_items_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "red green blue white black grey")], "doc_id long, text string")
    items = [(7, "one two three four five six"), (7, "red green blue white black grey"), (7, "red green blue white black grey")]
    found = decontaminate.find_overlaps(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 7, 0, 6), (2, 7, 0, 6)]


def test_pages_in_other_languages():
    russian = "Вчера вечером мы долго гуляли по набережной и говорили о том, как быстро прошло это лето и что будет осенью. " * 2
    page = f"<html><body><div class='menu'><a href='/'>Главная</a></div><p>{russian}</p><p>{russian}</p></body></html>"
    text = html_text.main_text(page)
    assert text.count("набережной") == 4 and "Главная" not in text
