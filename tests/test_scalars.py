"""Edge rows of the scalar columns and filters."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import articles, health, mentions, vectors
from tidemark.operators import chunking, filters
from tidemark.operators.aggregates import top_entities


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "kind", "expected"),
    [
        (None, "other", ""),
        ("", "other", ""),
        ("B b,3;A,1;A,9", "other", "A, B_b"),
        ("A,1;", "other", ", A"),
        ("no comma", "other", "no_comma"),
        ("1#a#Rome#x;4#X;;2#b#Oslo#y", "locations", "Oslo, Rome"),
    ],
)
def test_distinct_names(spark, text, kind, expected):
    assert one(spark, text, mentions.distinct_names("c", kind)) == expected


def test_digits_include_other_scripts(spark):
    assert one(spark, "a1_b٣c", mentions.strip_digits("c")) == "a  b c"


def test_bad_dates_are_set_aside(spark):
    df = spark.createDataFrame([("20240103101500",), ("2024",), (None,)], "DATE string")
    good, bad = articles.split_bad_dates(df)
    assert [r["ts"] for r in good.collect()] == [dt.datetime(2024, 1, 3, 10, 15)]
    assert bad.count() == 2


def test_display_date_always_ends_in_th(spark):
    shown = one(spark, dt.datetime(2024, 1, 3), articles.display_date("c"), "timestamp")
    assert shown == "03th January 2024"


def test_summary_sentence(spark):
    row = ("20240103000000", None, "Acme Inc,5;Acme Inc,9", "1#x#Rome#", "TAX_9,1")
    df = spark.createDataFrame([row], "DATE string, V2Persons string, V2Organizations string, V2Locations string, V2Themes string")
    assert articles.article_summary(df).first()["Summary"] == (
        "This article talks about these people (), these organizations (Acme Inc), these locations (Rome). "
        "It took place on 03th January 2024 and includes these themes (tax  )."
    )


def test_missing_column_fails_at_plan_time(spark):
    with pytest.raises(ValueError, match="V2Themes"):
        articles.require_columns(spark.range(1), ["V2Themes"])


def test_health(spark):
    df = spark.createDataFrame([("[1.0, 0.5, 0.25]",), (None,), ("[]",)], "h string")
    parts = [health.health_component("h", i).alias(n) for i, n in enumerate("abc")]
    scores = df.select(*parts).select(health.combined_health("a", "b", "c").alias("s")).collect()
    assert scores[0]["s"] == pytest.approx(0.5 + 0.15 - 0.15)
    assert scores[1]["s"] is None and scores[2]["s"] is None


def test_company_name_is_no_pattern(spark):
    df = spark.createDataFrame([("100% Pure's,1",), ("100x Pure's,1",)], "V2Organizations string")
    assert filters.mentions_company(df, "100% PURE'S").count() == 1
    assert filters.mentions_company(df, "100_").count() == 0


def test_unknown_form_type_is_rejected(spark):
    with pytest.raises(ValueError):
        filters.form_types(spark.range(1).withColumn("formType", F.lit("x")), types=("S-1",))


def test_zero_vector_has_no_similarity(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine("a", "b")).collect()] == [0.0, 1.0, None]
    assert one(spark, [-10.0, -10.0], vectors.missing_to_null("c"), "array<double>") is None


def test_links_with_commas_stay_whole_as_array(spark):
    links = ["http://a/x,y", "http://b"]
    joined = one(spark, links, mentions.join_links("c"), "array<string>")
    assert joined == "http://a/x,y,http://b"
    assert one(spark, joined, mentions.split_links("c")) == ["http://a/x", "y", "http://b"]


def test_entities_skip_empty_and_malformed(spark):
    rows = [(0, "A,1;A,2;;B,3", None, "4#X;1#a#Rome#", ""), (-1, "C,1", None, None, None)]
    df = spark.createDataFrame(rows, "cluster int, V2Persons string, V2Organizations string, V2Locations string, V2Themes string")
    got = {(r["cluster"], r["kind"], r["name"], r["mentions"], r["rank"]) for r in top_entities(df).collect()}
    assert got == {(0, "persons", "A", 2, 1), (0, "persons", "B", 1, 2), (0, "locations", "Rome", 1, 1), (-1, "persons", "C", 1, 1)}


@pytest.mark.parametrize("size", [1, 7, 50])
def test_separator_chunks_are_bounded_and_complete(spark, size):
    text = "Para one is here.\n\nLine a\nLine b with words\n\n" + "x" * 60 + " tail é"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    rows = chunking.chunk_text(df, "text", size).orderBy("id", "chunk_index").collect()
    assert all(0 < len(r["content"]) <= size for r in rows)
    assert "".join(r["content"] for r in rows if r["id"] == 1) == text
    assert {r["id"] for r in rows} == {1}


def test_separator_chunks_break_at_paragraphs(spark):
    df = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncccc")], "id int, text string")
    got = [r["content"] for r in chunking.chunk_text(df, "text", 12).orderBy("chunk_index").collect()]
    assert got == ["aaaa\n\nbbbb\n\n", "cccc"]


def test_fixed_chunks_overlap(spark):
    df = spark.createDataFrame([(1, "abcdefghij")], "id int, text string")
    got = [r["content"] for r in chunking.chunk_chars(df, "text", 4, 1).orderBy("chunk_index").collect()]
    assert got == ["abcd", "defg", "ghij"]


def test_clean_doc(spark):
    assert one(spark, "a\\nb #12 c#3! d.,", chunking.clean_doc("c")) == "a\nb  c d.,"
