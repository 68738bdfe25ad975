"""Order-dependent scoring rules and opinion rules."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vocabspark.operators import annotation as A
from vocabspark.operators import scoring as S


def predictions(spark, samples):
    rows = [("f", "m", "g", 4, s, k, p, 1.0 / k) for s, preds in samples.items() for k, p in enumerate(preds, 1)]
    return spark.createDataFrame(rows, "file string, model string, gencfg string, gen_topk int, sample string, k int, pred string, score double")


ANN = [
    ("s", "incorrect", "bad"), ("s", "close_primary", "near"), ("s", "correct_primary", "twice"), ("s", "close_secondary", "twice"), ("s", "correct_secondary", "good"),
]


@pytest.fixture(scope="module")
def ann(spark):
    return spark.createDataFrame(ANN, "sample string, category string, noun string")


def test_noun_in_two_categories_takes_the_alphabetically_first(spark, ann):
    scored = S.attach_category(predictions(spark, {"s": ["twice"]}), ann)
    assert scored.first()["category"] == "close_secondary"
    assert [tuple(r) for r in S.multiple_categories(scored, ann).collect()] == [("s", "twice", "close_secondary,correct_primary")]


def test_specificity_takes_the_last_category(spark, ann):
    spec = spark.createDataFrame([("twice", 0.5)], "noun string, specificity double")
    row = S.specificity_scores(predictions(spark, {"s": ["twice"]}), ann, spec).first()
    assert (row["prediction_score"], row["overall_score"]) == (0.4, 0.2)


def test_specificity_is_strict(spark, ann):
    spec = spark.createDataFrame([("other", 0.5)], "noun string, specificity double")
    with pytest.raises(Exception, match="no specificity"):
        S.specificity_scores(predictions(spark, {"s": ["twice"]}), ann, spec).collect()


def counted(spark, ann, preds, sample="s"):
    rows = S.cumulative_best_category(S.attach_category(predictions(spark, {sample: preds}), ann), 4)
    return [r["counted"] for r in rows.orderBy("k").collect()]


def test_cumulative_best_category(spark, ann):
    # unknown noun weighs 0, equal weight counts its own category, worse items count the earliest best
    assert counted(spark, ann, ["what", "bad", "near", "twice"]) == [None, "incorrect", "close_primary", "close_primary"]
    assert counted(spark, ann, ["good", "bad"]) == ["correct_secondary", "correct_secondary"]
    assert counted(spark, ann, ["near", "good"], sample="absent") == [None, None]


def test_denominator_includes_unannotated_samples(spark, ann):
    row = S.score_top1(S.attach_category(predictions(spark, {"s": ["good"], "absent": ["good"]}), ann)).first()
    assert (row["n"], row["score"], row["score_ratio"], row["other"]) == (2, 0.8, 0.4, 1)


def needed(rule, n, right):
    c = rule.confidence
    settle = min((c * n - right) / (1 - c), (c * n - (n - right)) / (1 - c), rule.most - n)
    return max(math.ceil(settle), rule.least - n, 0)


def test_needed_opinions_rule(spark):
    rule = A.OpinionRule(2, 6, 0.78)
    rows = [(n, r) for n in range(8) for r in range(n + 1)]
    got = spark.createDataFrame(rows, "n long, r long").select("n", "r", rule.needed(F.col("n"), F.col("r")).alias("need")).collect()
    assert all(x["need"] == needed(rule, x["n"], x["r"]) for x in got)


def test_accept_opinions_equals_fold(spark):
    import random

    rng = random.Random(3)
    rule = A.OpinionRule(2, 5, 0.78)
    rows = [(f"i{rng.randrange(6)}", f"n{rng.randrange(3)}", t, t, rng.random() < 0.6) for t in range(400)]
    got = A.accept_opinions(spark.createDataFrame(rows, "image string, noun string, ts long, event_id long, opinion boolean"), rule)
    state, want = {}, set()
    for image, noun, t, _, opinion in rows:
        seen = state.setdefault((image, noun), [])
        if needed(rule, len(seen), sum(seen)) > 0:
            seen.append(opinion)
            want.add(t)
    assert {r["event_id"] for r in got.collect()} == want


def test_consensus_three_of_four_is_close(spark):
    rows = [("i", "n", t, t, t != 0) for t in range(4)]
    row = A.consensus(spark.createDataFrame(rows, "image string, noun string, ts long, event_id long, opinion boolean"), A.OpinionRule(2, 4, 0.78)).first()
    assert (row["category"], row["odd_count"]) == ("close_primary", False)


def test_request_lists_cover_needs(spark):
    needs = [("i", f"n{j:02d}", need) for j, need in enumerate([3, 1, 1, 2, 0, 0, 0])] + [("k", "only", 1), ("k", "done", 0), ("z", "done", 0)]
    lists = A.request_lists(spark.createDataFrame(needs, "image string, noun string, need int"), 4, 1).collect()
    by_request = {}
    for r in lists:
        by_request.setdefault((r["image"], r["request"]), []).append(r["noun"])
    assert all(len(set(nouns)) == len(nouns) for nouns in by_request.values())
    for image, noun, need in needs:
        real = sum(1 for r in lists if (r["image"], r["noun"]) == (image, noun) and not r["padded"])
        assert real == need
    assert {k for k in by_request if k[0] == "i"} == {("i", 0), ("i", 1), ("i", 2)}
    assert all(len(n) >= 4 for k, n in by_request.items() if k[0] == "i")
    assert sorted(by_request[("k", 0)]) == ["done", "only"]
    assert not any(k[0] == "z" for k in by_request)


def parse(spark, nouns, content, finish="stop"):
    row = spark.createDataFrame([(1, "i", nouns, finish, content)], "request_id long, image string, nouns array<string>, finish_reason string, content string")
    parsed = A.parse_answers(row)
    first = parsed.first()
    return first["error"], first["description"], [(r["noun"], r["opinion"]) for r in A.answer_opinions(parsed).orderBy("pos").collect()]


def test_parse_plain_answer(spark):
    text = "A dog   on\ngrass.\n\n1) dog: Correct\n2) **Polar-bear** - incorrect"
    assert parse(spark, ["dog", "polar bear"], text) == (None, "A dog on grass.", [("dog", True), ("polar bear", False)])


def test_parse_prefers_verdict_lines_when_both_marks_occur(spark):
    text = "1. grass\n2. sky\n3. dog\n\n1) dog. Correct\n2) cat. Incorrect"
    error, description, opinions = parse(spark, ["dog", "cat"], text)
    assert (error, opinions) == (None, [("dog", True), ("cat", False)])
    assert description == "1. grass 2. sky 3. dog"


@pytest.mark.parametrize(
    "content,finish,error",
    [
        ("1) dog: Correct", "stop", "count"), ("1) dog: Correct\n3) cat: Correct", "stop", "order"), ("1) dog: Correct\n2) cow: Correct", "stop", "noun"),
        ("1) dog: Correct\n2) cat maybe", "stop", "line"), ("", "stop", "empty"), ("1) dog: Correct\n2) cat: Correct", "length", "finish"),
    ],
)
def test_rejected_answers_give_no_opinions(spark, content, finish, error):
    got = parse(spark, ["dog", "cat"], content, finish)
    assert (got[0], got[2]) == (error, [])


def pack(rows, max_n, max_bytes, max_tokens):
    """One shard packed by plain loops."""
    batches, count, size, tokens, batch = {}, 0, 0, 0, 0
    for i, (image, request, nbytes, ntokens) in enumerate(rows):
        count, size, tokens = count + 1, size + nbytes, tokens + ntokens
        batches[(image, request)] = batch
        last = i + 1 == len(rows) or rows[i + 1][0] != image
        if last and (count >= max_n or size >= max_bytes or tokens >= max_tokens - ntokens * 10):
            batch, count, size, tokens = batch + 1, 0, 0, 0
    return batches


def test_pack_requests(spark):
    import random

    rng = random.Random(5)
    rows = sorted((f"i{rng.randrange(60):02d}", r, rng.randrange(100, 900), rng.randrange(50, 200)) for r in range(300))
    df = spark.createDataFrame(rows, "image string, request long, num_bytes long, num_tokens long")
    got = A.pack_requests(df, 20, 9000, 4000).collect()
    assert {(r["image"], r["request"]): r["batch"] for r in got} == pack(rows, 20, 9000, 4000)
    many = A.pack_requests(df, 20, 9000, 4000, images_per_shard=12).collect()
    by_shard = {}
    for r in many:
        by_shard.setdefault(r["shard"], []).append(r)
    assert sum(map(len, by_shard.values())) == len(rows)
    for shard_rows in by_shard.values():
        plain = sorted((r["image"], r["request"], r["num_bytes"], r["num_tokens"]) for r in shard_rows)
        assert {(r["image"], r["request"]): r["batch"] for r in shard_rows} == pack(plain, 20, 9000, 4000)


def test_annotations_and_priors_are_merged(spark, ann):
    """Exploded rows pass for few with the planner; a broadcast would bring them all to the driver."""
    from vocabspark.operators import tokens as K

    many = ann.filter("noun = 'twice'").select(F.explode(F.array([F.lit(f"s{i}") for i in range(9)])).alias("sample"), "category", "noun")
    scored = S.attach_category(predictions(spark, {"s1": ["twice", "good"], "t": ["twice"]}), many)
    targets = spark.createDataFrame([(1, [1, 2]), (2, [1, 3])], "target_id long, token_ids array<int>")
    prior = K.vocabulary_prior(targets, targets, per_token=False)
    rows = spark.createDataFrame([("s", 1, 0.0, 2), ("s", 2, 0.5, 2), ("s", 3, 0.9, 2)], "sample string, target_id long, logprob double, n_tokens int")
    best = K.rescore(rows, prior, 0.5, 0.0, 2)
    for df in (scored, prior, best):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["sample"], r["pred"]): r["category"] for r in scored.collect()} == {("s1", "twice"): "close_secondary", ("s1", "good"): None, ("t", "twice"): None}
    assert [r["target_id"] for r in best.orderBy("rank").collect()] == [2, 1]
