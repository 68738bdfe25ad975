"""Golden cases of the text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vocabspark.functions import decoding as D
from vocabspark.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "noun,want",
    [
        ("hour", "an hour"), ("unicorn", "a unicorn"), ("ewe", "a ewe"), ("F1 car", "a F1 car"), ("FB car", "an FB car"), ("X-ray", "an X-ray"),
        ("one-way street", "a one-way street"), ("apple", "an apple"), ("Umbrella", "an Umbrella"), ("ukulele", "a ukulele"), ("cat", "a cat"),
        ("once over", "a once over"), ("t-shirt", "a t-shirt"), ("MRI scan", "an MRI scan"), ("European", "a European"),
    ],
)
def test_indefinite(spark, noun, want):
    assert one(spark, T.indefinite(F.lit(noun))) == want


def test_indefinite_suffix_does_not_choose_article(spark):
    assert one(spark, T.indefinite(F.lit("cat"), F.lit(", a type of animal"))) == "a cat, a type of animal"


@pytest.mark.parametrize(
    "noun,want",
    [("  Café   au-lait ", "cafe au lait"), ("St. John's/Wort", "st johns wort"), ("Straße", "strasse"), ("Œuvre – x", "oeuvre x"), ("Ångström’s", "angstroms")],
)
def test_canon(spark, noun, want):
    assert one(spark, T.canon(F.lit(noun))) == want


@pytest.mark.parametrize(
    "name,want",
    [
        ("cat (animal (pet)) toy", "cat toy"), ("crane/bird", "crane"), ("bell or wind chime", "chime"), ("ping or pong ball", "ping ball"),
        ("big cat or dog", "big cat"), ("cat or dog", "cat"), ("a ((b) c) d (e)", "a d"),
    ],
)
def test_clean_class_name(spark, name, want):
    assert one(spark, T.clean_class_name(F.lit(name))) == want


@pytest.mark.parametrize(
    "caption,noun,want",
    [
        ("A Cat sits.", "cat", "A {singular} sits"), ("The cat's toy!", "cat", "The {singular}'s toy"), ("Concatenate cats", "cat", None),
        ("Two: cat, a cat. here", "cat", "Two: {singular}, a {singular} here"), ("cat cat", "cat", "{singular} cat"), ("I like my cat.", "cat", "I like my {singular}"),
        ("The c.t sits", "c.t", "The {singular} sits"), ("The cat sits", "c.t", None),
    ],
)
def test_caption_template(spark, caption, noun, want):
    assert one(spark, T.caption_template(F.lit(caption), F.lit(noun), "singular")) == want


def test_caption_lines(spark):
    text = "Sure!\n1. A small cat sits here.\n 2 . Another café scene here \n3. short\n- 4. not numbered line"
    assert one(spark, T.caption_lines(F.lit(text))) == ["A small cat sits here.", "Another cafe scene here"]


@pytest.mark.parametrize("name", ["beam_k10_vnone_gp_t1_a0", "all_k3_vtok0.5_gr_t0.75_a0.125", "greedy_k1_vtgt2_gn_t1.5_a0"])
def test_decoding_names_round_trip(spark, name):
    row = spark.range(1).select(F.lit(name).alias("n")).select(D.parse_name(F.col("n")).alias("c")).select("c.*", D.make_name(F.col("c")).alias("n")).first()
    assert row["valid"] and row["n"] == name


@pytest.mark.parametrize("name", ["walk_k1_vnone_gn_t1_a0", "beam_k0_vnone_gn_t1_a0", "beam_k1_vbad_gn_t1_a0", "beam_k1_vnone_gx_t1_a0", "beam_k1_vnone_gn_t0_a0", "beam_k1_z2"])
def test_decoding_names_rejected(spark, name):
    assert not one(spark, D.parse_name(F.lit(name))["valid"])


def test_order_report(spark):
    from vocabspark.plans.reports import order_report

    rows = spark.createDataFrame([("b", "x 10.5%"), ("a", "x 9"), ("c", "-")], "Name string, Cell string")
    names = lambda spec: [r["Name"] for r in order_report(rows, spec).collect()]
    assert names(None) == ["a", "b", "c"]
    assert names("0cell") == ["a", "b", "c"]
    assert names("-0CELL") == ["b", "a", "c"]
    assert names("-name") == ["c", "b", "a"]


def test_sql_functions_equal_column_functions(spark):
    from vocabspark.functions.register import register_functions

    register_functions(spark)
    nouns = ["hour", "F1 car", "X-ray", "  Café   au-lait ", "St. John's/Wort", "Straße", "Œuvre – x", "one-way", "apple"]
    rows = spark.createDataFrame([(n,) for n in nouns], "n string").select("n", T.indefinite(F.col("n")).alias("a"), T.canon(F.col("n")).alias("c"))
    rows.createOrReplaceTempView("sql_function_nouns")
    got = spark.sql("SELECT count_if(a = with_article(n) AND c = canonical_noun(n)) AS n FROM sql_function_nouns").first()["n"]
    assert got == len(nouns)
    assert spark.sql("SELECT decoding_topk('beam_k10_vnone_gn_t1_a0') AS k").first()["k"] == 10


@pytest.mark.parametrize(
    ("text", "want"),
    [("Ψωμί και Θάλασσα", "Psomi kai Thalassa"), ("Щука, Ёж и Юг", "Shchuka, Iozh i Iug"), ("ＡＢＣ　１２！", "ABC 12!"), ("Straße café – déjà", "Strasse cafe - deja"), ("日本 x", "日本 x")],
)
def test_transliteration_of_other_scripts(spark, text, want):
    from vocabspark.functions.register import register_functions

    row = spark.createDataFrame([(text,)], "t string").select(T.transliterate(F.col("t")).alias("a"), T.canon(F.col("t")).alias("c")).first()
    assert row.a == want
    register_functions(spark)
    assert spark.createDataFrame([(text,)], "t string").selectExpr("canonical_noun(t) AS c").first().c == row.c
