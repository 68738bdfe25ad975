"""Corpus expansion against a small brute-force expansion, and the id arithmetic."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vocabspark.operators import corpus as C
from vocabspark.operators import vocab as V
from vocabspark.operators.embedding import embed_texts, hashing_model
from vocabspark.plans.fixtures import template_rows

VOCAB = [
    (0, "animal", "animal", ["animal"], [1], ["animals"], [2], []),
    (3, "cat", "cat", ["cat", "kitty"], [3, 1], [], [], [0]),
    (5, "ox", "ox", ["ox"], [2], ["oxen"], [1], [0, 3]),
]
DEBUG = [("Debug", 0, 2, None), ("Debug", 1, 3, ", a type of {target}"), ("Debug", 2, 2, ", an example of {article_target}")]
PROMPTS = [("P", 0, 2, "a photo of {article_noun}"), ("P", 1, 1, "many {plural}!"), ("P", 2, 1, "the {noun}, here")]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(VOCAB, V.VOCAB_SCHEMA)


@pytest.fixture(scope="module")
def plan(spark, vocab):
    return C.CorpusPlan(vocab, template_rows(spark, PROMPTS), template_rows(spark, DEBUG), "P", "Debug")


def expected():
    """Plain loops over the rules: vocabulary, kind, prompt, suffix, noun."""
    prompts = {
        "singular": [("a photo of {noun}.", True, False, 2), ("the {noun}, here.", False, False, 1)],
        "plural": [("a photo of {noun}.", False, False, 2), ("many {noun}!.", False, False, 1), ("the {noun}, here.", False, False, 1)],
    }
    targets = {row[0]: row[1] for row in VOCAB}
    article = lambda noun: ("an " if noun[0] in "aeiou" else "a ") + noun
    dists = {0: ([], []), 1: ([3], [2]), 2: ([2, 1], [1, 1])}
    rows, usid, fsid = [], 0, 0
    for _, target, _, sing, sfreq, plur, pfreq, hyp in VOCAB:
        names = [targets[h] for h in hyp]
        suffixes = [("", 2 + (5 if not names else 0))]
        first, second = dists[len(names)]
        suffixes += [(f", a type of {n}", f) for n, f in zip(names, first) if f]
        suffixes += [(f", an example of {article(n)}", f) for n, f in zip(names, second) if f]
        for kind, nouns, freqs in (("singular", sing, sfreq), ("plural", plur, pfreq)):
            for template, needs, _, tfreq in prompts[kind]:
                for suffix, hfreq in suffixes:
                    for noun, nfreq in zip(nouns, freqs):
                        text = template.format(noun=(article(noun) if needs else noun) + suffix)
                        freq = tfreq * hfreq * nfreq
                        rows.append((usid, fsid, freq, text, target))
                        usid, fsid = usid + 1, fsid + freq
    return rows


def test_samples_and_ids(plan):
    got = [tuple(r) for r in plan.samples().select("usid", "fsid", "freq", "text", "target").orderBy("usid").collect()]
    assert got == expected()


def test_totals_match_samples(plan):
    rows = expected()
    assert tuple(plan.totals().first()) == (3, len(rows), sum(r[2] for r in rows))


def test_random_access_covers_every_fsid(spark, plan):
    rows = expected()
    total = sum(r[2] for r in rows)
    want = [(f, usid, text, target) for usid, start, freq, text, target in rows for f in range(start, start + freq)]
    got = [tuple(r) for r in plan.lookup_fsids(spark.range(total).withColumnRenamed("id", "fsid")).orderBy("fsid").collect()]
    assert got == want


def test_comma_only_before_words(spark):
    rows = template_rows(spark, [("P", 0, 1, "the {noun} here"), ("P", 1, 1, "the {noun}; here"), ("P", 2, 1, "the {noun}")])
    flags = {r["template"]: r["need_hyp_comma"] for r in C.compile_prompts(rows, "P").filter("kind = 'singular'").collect()}
    assert flags == {"the {noun} here.": True, "the {noun}; here.": False, "the {noun}.": False}


@pytest.mark.parametrize("template", ["no field", "{noun} and {noun}", "{thing} here"])
def test_bad_prompts_fail(spark, template):
    with pytest.raises(Exception, match="template"):
        C.compile_prompts(template_rows(spark, [("P", 0, 1, template)]), "P").collect()


def test_missing_null_hypernym_fails(spark, vocab):
    with pytest.raises(Exception, match="must be null"):
        C.CorpusPlan(vocab, template_rows(spark, PROMPTS), template_rows(spark, DEBUG[1:]), "P", "Debug")


def test_small_blocks_and_shares_give_the_same_corpus(spark, vocab, monkeypatch):
    """Templates in several blocks and the vocabulary in several shares, joined by shuffle."""
    monkeypatch.setattr(C, "TEMPLATE_BLOCK", 2)
    monkeypatch.setattr(C, "VOCAB_SHARE", 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = C.CorpusPlan(vocab, template_rows(spark, PROMPTS), template_rows(spark, DEBUG), "P", "Debug")
        assert wide.shares == 4
        columns = ("usid", "fsid", "freq", "text")
        assert sorted(map(tuple, wide.samples().select(*columns).collect())) == sorted(r[:4] for r in expected())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_templates_use_all_tasks(spark, vocab):
    """50,000 templates: the expansion is dealt to as many tasks as its rows need, all with rows."""
    prompts = spark.range(50_000).select(
        F.lit("P").alias("collection"), F.col("id").alias("pos"), F.lit(1).alias("freq"), F.concat(F.lit("photo "), "id", F.lit(" of {noun}")).alias("template")
    )
    plan = C.CorpusPlan(vocab, prompts, template_rows(spark, DEBUG), "P", "Debug")
    rows = plan.samples(with_ids=False)
    assert plan.partitions > 4 and rows.count() == plan.totals().first()["num_usids"]
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 0.8 * plan.partitions


def test_huge_frequencies_stay_arithmetic(spark):
    """A frequency of 10**9 makes no row per unit."""
    numbered = spark.createDataFrame([(0, 10**9, 0), (1, 5, 10**9)], "hpos long, hfreq long, hfreq_before long")
    got = {(r.n_hyp, r.hpos, r.hyp_idx): r.sfreq for r in C.hypernym_freq_dist(numbered, 3).collect()}
    assert got[3, 0, 0] == 333_333_334 and got[3, 0, 1] == got[3, 0, 2] == 333_333_333
    assert [got[3, 1, i] for i in (1, 2, 0)] == [2, 2, 1] and got[1, 0, 0] == 10**9
    assert sum(v for (n, _, _), v in got.items() if n == 2) == 10**9 + 5
    vocab = spark.createDataFrame(
        [(1, "ox", "ox", ["ox", "bull"], [10**9, 3], [], [], [])],
        "id long, target_noun string, pretty_noun string, singulars array<string>, singulars_freq array<int>, plurals array<string>, plurals_freq array<int>, hypernyms array<long>",
    )
    plan = C.CorpusPlan(vocab, template_rows(spark, [("P", 0, 10**9, "a {noun}"), ("P", 1, 2, "the {noun}")]), template_rows(spark, [("D", 0, 1, None)]), "P", "D")
    last = 10**18 + 3 * 10**9 + 2 * 10**9 + 6 - 1
    asked = spark.createDataFrame([(0,), (10**18 - 1,), (10**18,), (last,)], "fsid long")
    assert [r.text for r in plan.lookup_fsids(asked).orderBy("fsid").collect()] == ["a ox.", "a ox.", "a bull.", "the bull."]


def test_multisets_have_full_permutations(spark, vocab):
    prompts = C.number_prompts(C.compile_prompts(template_rows(spark, PROMPTS), "P"))
    sets = C.noun_multisets(vocab, prompts, [0, 2], seed=1)
    counts = sets.withColumn("t", F.explode("targets")).groupBy("kind", "t").count()
    weights = {("singular", "animal"): 1, ("singular", "cat"): 4, ("singular", "ox"): 2, ("plural", "animal"): 2, ("plural", "ox"): 1}
    slots = {"singular": 3, "plural": 4}
    got = {(r["kind"], r["t"]): r["count"] for r in counts.collect()}
    assert got == {key: 2 * 2 * slots[key[0]] * w for key, w in weights.items()}
    assert sets.filter(F.size("targets") != 2).count() == 0


def test_hypernym_lookup_ignores_threshold(spark, vocab):
    kept = V.filter_vocab(vocab, 3)
    assert [r["id"] for r in kept.orderBy("id").collect()] == [3]
    assert [r["hypernym_target"] for r in V.resolve_hypernyms(kept, vocab).collect()] == ["animal"]


def test_embedding_runs_once_per_text(spark):
    rows = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(40)], "i int, text string")
    out = embed_texts(rows, hashing_model(16)).collect()
    assert len(out) == 40
    assert len({tuple(r["embedding"]) for r in out if r["text"] == "same"}) == 1
    assert all(abs(sum(v * v for v in r["embedding"]) - 1) < 1e-5 for r in out)


def test_hypernym_names_are_not_broadcast(spark, sf_dir):
    """A vocabulary's file is small, its rows are not: they are merged."""
    from vocabspark.operators.vocab import resolve_hypernyms, with_hypernym_targets
    from vocabspark.plans import fixtures as X

    vocab = X.vocab(spark, sf_dir)
    for df in (resolve_hypernyms(vocab), with_hypernym_targets(vocab)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def _before_merge(df):
    """The optimized plan below the merge of equal templates."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (merge,) = [i for i, line in enumerate(lines) if "Aggregate [template" in line]
    return "\n".join(lines[merge + 1:])


def test_hypernyms_are_compiled_after_the_merge(spark, monkeypatch):
    """Leaving out the plain noun puts no pattern on the rows before the merge."""
    sums, numbered_from = C.ranged_sums, []
    monkeypatch.setattr(C, "ranged_sums", lambda df, *args, **values: numbered_from.append(df) or sums(df, *args, **values))
    columns = [F.lit("P").alias("collection"), F.col("id").alias("pos"), F.lit(1).alias("freq")]
    template = F.when(F.col("id") > 0, F.concat(F.lit("a  "), F.expr("id % 4"), F.lit(" {target}"))).alias("template")
    C.number_hypernyms(C.compile_hypernyms(spark.range(9).select(*columns, template), "P"))
    (rows,) = numbered_from
    below = _before_merge(rows)
    assert "regexp" not in below and "raise_error" not in below


def test_plain_noun_takes_no_number(spark):
    """Positions and frequencies go on past the null template, wherever it stands; columns stay as compiled."""
    given = [("K", 0, 2, ", a {target}"), ("K", 1, 5, None), ("K", 2, 3, ", an  {article_target}"), ("K", 3, 1, ", a {target}"), ("K", 4, 4, None), ("K", 5, 1, ", the {target}")]
    compiled = C.compile_hypernyms(template_rows(spark, given), "K")
    numbered = C.number_hypernyms(compiled)
    assert numbered.columns == [*compiled.columns, "hpos", "hfreq_before"]
    got = [(r.hpos, r.hfreq_before, r.hfreq, r.template, r.template_comma, r.need_article) for r in numbered.orderBy("hpos").collect()]
    assert got == [
        (0, 0, 3, ", a {target}", ", a {target},", False), (1, 3, 3, ", an {target}", ", an {target},", True), (2, 6, 1, ", the {target}", ", the {target},", False),
    ]


def test_bad_hypernyms_fail(spark):
    for template in ("no field", "{target} and {target}", "{thing} here"):
        with pytest.raises(Exception, match="template"):
            C.number_hypernyms(C.compile_hypernyms(template_rows(spark, [("K", 0, 1, template), ("K", 1, 1, None)]), "K"))
