"""Token tables: checks, compact ids, translation, prefix statistics, accuracy.

Rows are (target_id, token_ids ARRAY<INT>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.tokens import is_monotone
from ..session import cut_lineage
from .ordinals import ranged_rank
from .small import local_rows

MOST_TOKENS = 1 << 22  # ids of any tokenizer are smaller
TARGETS_PER_PARTITION = 20_000  # targets whose steps a task sorts


def token_violations(df: DataFrame, vocab_size: int, pad_id: int, end_id: int | None, start_id: int | None, mask: str | None = None) -> DataFrame:
    """Rows (target_id, rule) of every rule a padded token row breaks."""
    ids = F.col("token_ids")
    padding = F.transform(ids, lambda t: t == pad_id)
    rules = {
        "token_range": F.exists(ids, lambda t: (t < 0) | (t >= vocab_size)),
        "token_after_padding": ~is_monotone(padding),
    }
    if start_id is not None:
        rules["no_start_token"] = F.get(ids, F.lit(0)) != start_id
    if end_id is not None:
        rules["no_end_token"] = ~F.exists(ids, lambda t: t == end_id)
        if end_id != pad_id:
            end = F.array_position(ids, F.lit(end_id).cast("int"))
            first_pad = F.array_position(ids, F.lit(pad_id).cast("int"))
            after = F.when(first_pad > 0, first_pad).otherwise(F.size(ids).cast("long") + 1)
            rules["end_not_before_padding"] = (end > 0) & (after != end + 1)
    if mask is not None:
        flags = F.col(mask)
        rules["mask_not_monotone"] = ~is_monotone(flags)
        if end_id is not None and end_id == pad_id:
            shifted = F.concat(F.array(F.lit(False)), F.slice(padding, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))))
            rules["mask_not_padding"] = flags != shifted
        else:
            rules["mask_not_padding"] = flags != padding
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return df.select("target_id", F.explode(found).alias("rule"))


def compact_ids(df: DataFrame, pad_id: int, end_id: int, start_id: int | None = None, with_start: bool = False) -> DataFrame:
    """Mapping (token_id, compact_id) of the used tokens: padding and end 0, start 1, others dense in token order."""
    special = {pad_id: 0, end_id: 0}
    if with_start and start_id is not None:
        special[start_id] = 1
    n_special = 2 if with_start else 1
    skip = {pad_id, end_id} | ({start_id} if start_id is not None else set())
    used = df.select(F.explode("token_ids").alias("token_id")).distinct().filter(~F.col("token_id").isin(*skip))
    ranked = ranged_rank(used, [], [F.col("token_id")], "compact_id")
    dense = ranked.select(F.col("token_id").cast("int").alias("token_id"), (F.col("compact_id") + n_special).cast("int").alias("compact_id"))
    fixed = local_rows(df.sparkSession, sorted(special.items()), "token_id int, compact_id int")
    return fixed.unionByName(dense)


def token_length(df: DataFrame) -> DataFrame:
    """Longest token row and the number of rows."""
    return df.agg(F.max(F.size("token_ids")).alias("token_length"), F.count("*").alias("n_targets"))


def _lookup(mapping: DataFrame, source: str, target: str) -> Column:
    """The mapping as one dense array by `source`, null where it has no entry.

    Its length is that of a tokenizer's vocabulary, which doesn't grow with the data; a larger id is an error.
    """
    top = mapping.agg(F.max(source).alias("top")).select(
        F.explode(F.sequence(F.lit(0), F.when(F.col("top") < MOST_TOKENS, F.col("top")).otherwise(F.raise_error(F.lit("a token id beyond any tokenizer")).cast("int")))).alias("__at")
    )
    filled = top.join(mapping.select(F.col(source).alias("__at"), F.col(target).alias("__to")), "__at", "left")
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__to"))), lambda x: x["__to"])).scalar()


def _mapped(df: DataFrame, lookup: Column) -> DataFrame:
    ids = F.transform("token_ids", lambda t: F.when(t >= 0, F.get("__lookup", t)))
    return df.withColumn("__lookup", lookup).select("target_id", ids.alias("token_ids")).withColumn("n_missing", F.size(F.filter("token_ids", lambda t: t.isNull())).cast("long"))


def encode_tokens(df: DataFrame, mapping: DataFrame, source: str = "token_id", target: str = "compact_id") -> DataFrame:
    """Token rows through a mapping table, with `n_missing` tokens that the mapping lacks; rows are not shuffled."""
    return _mapped(df, _lookup(mapping, source, target))


def translate_tokens(df: DataFrame, from_map: DataFrame, to_map: DataFrame, strict: bool = True) -> DataFrame:
    """Compact token rows of one model in the compact ids of another; all tokens must exist in the other."""
    back = from_map.filter("compact_id > 0").select("token_id", F.col("compact_id").alias("from_id"))
    step = back.join(to_map.select("token_id", F.col("compact_id").alias("to_id")), "token_id").select("from_id", "to_id")
    zero = local_rows(df.sparkSession, [(0, 0)], "from_id int, to_id int")
    rows = _mapped(df, _lookup(step.unionByName(zero), "from_id", "to_id"))
    if strict:
        failed = F.raise_error(F.lit("the other vocabulary is not a superset")).cast("array<int>")
        rows = rows.withColumn("token_ids", F.when(F.col("n_missing") == 0, F.col("token_ids")).otherwise(failed))
    return rows


def unencodable_targets(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Targets with a token that the mapping lacks; they are dropped from guides."""
    return encode_tokens(df, mapping).filter("n_missing > 0").select("target_id", "n_missing")


def _root() -> Column:
    return F.struct(F.lit(42).cast("long").alias("a"), F.lit(43).cast("long").alias("b"))


def _step(node: Column, token: Column) -> Column:
    return F.struct(F.xxhash64(node["a"], token.cast("int")).alias("a"), F.xxhash64(node["b"], token.cast("int"), F.lit(1)).alias("b"))


def path_node(tokens: Column) -> Column:
    """The prefix tree's node that a path of tokens leads to: 128 bits, chained from the root token by token.

    A node is as wide for a long path as for a short one, and the table of nodes needs no round for each level.
    """
    return F.aggregate(tokens, _root(), _step)


def _steps(df: DataFrame, *keep: str, end_id: int | None = None) -> DataFrame:
    """Rows (target_id, pos, node, token): each token with the node of the path before it.

    With `end_id` the end of each target is a token as well, so that a target that begins another has a path of its own.
    """
    ids = F.col("token_ids") if end_id is None else F.concat("token_ids", F.array(F.lit(end_id).cast("int")))
    # One walk down the path, which leaves the nodes it has passed.
    start = F.struct(_root().alias("node"), F.array().cast("array<struct<node:struct<a:bigint,b:bigint>,token:int>>").alias("passed"))
    walk = lambda at, t: F.struct(
        _step(at["node"], t).alias("node"), F.array_append(at["passed"], F.struct(at["node"].alias("node"), t.cast("int").alias("token"))).alias("passed")
    )
    passed = F.aggregate(ids, start, walk, lambda at: at["passed"])
    return df.select("target_id", *keep, F.posexplode(passed).alias("pos", "s")).select("target_id", *keep, "pos", "s.node", "s.token")


def prefix_nodes(vocab: DataFrame, end_id: int | None = None) -> DataFrame:
    """Prefix tree steps (node, token): targets through the step, through its node, and sibling tokens."""
    steps = _steps(vocab, end_id=end_id).groupBy("node", "token").agg(F.count("*").alias("n"))
    totals = steps.groupBy("node").agg(F.sum("n").alias("n_prefix"), F.count("*").alias("n_siblings"))
    return steps.join(totals.hint("merge"), "node")


def vocabulary_prior(targets: DataFrame, vocab: DataFrame, per_token: bool, end_id: int | None = None) -> DataFrame:
    """Log prior of each target from the vocabulary's prefix tree, +infinity for an unseen path.

    Per token: uniform over the next tokens seen after the prefix. Per target: share of targets.
    Targets are unpadded; with `end_id` their end is a step of the path too.
    """
    nodes = prefix_nodes(vocab, end_id)
    joined = _steps(targets, end_id=end_id).join(nodes.hint("merge"), ["node", "token"], "left")
    share = F.lit(1.0) / F.col("n_siblings") if per_token else F.col("n") / F.col("n_prefix")
    summed = joined.groupBy("target_id").agg(F.count_if(F.col("n").isNull()).alias("unseen"), F.sum(F.log(share)).alias("s"))
    return summed.select("target_id", F.when(F.col("unseen") > 0, F.lit(float("inf"))).otherwise(F.col("s")).alias("prior"))


def rescore(candidates: DataFrame, prior: DataFrame | None, scaler: float, alpha: float, k: int) -> DataFrame:
    """Top-k candidates per sample by (logprob - scaler * prior) * max(length, 1) ** -alpha, with probability.

    With scaler 0 the prior has no part. Otherwise a candidate without a prior, or with an infinite one, scores minus infinity.
    """
    joined = candidates.withColumn("__off", F.lit(0.0))
    if scaler:
        joined = candidates.join(prior.hint("merge"), "target_id", "left").withColumn("__off", F.coalesce(F.lit(scaler) * F.col("prior"), F.lit(float("inf"))))
    score = (F.col("logprob") - F.col("__off")) * F.pow(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"), F.lit(-alpha))
    order = W.partitionBy("sample").orderBy(F.desc("score"), "target_id")
    ranked = joined.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("sample", "rank", "target_id", "score", F.exp("score").alias("prob"))


def allowed_tokens(guides: DataFrame, end_id: int | None = None) -> DataFrame:
    """Distinct steps (node, token) that some guide target allows; with `end_id`, the end after a whole target."""
    return _steps(guides, end_id=end_id).select("node", "token").distinct()


def guided_log_softmax(logits: DataFrame, allowed: DataFrame, renormalise: bool) -> DataFrame:
    """Log-softmax of the allowed next tokens of each (sample, node): the columns of `logits` but `logit`, and logprob.

    With renormalisation only allowed tokens share the probability; otherwise all tokens do and the
    rest is then masked out. A group holds at most one row per vocabulary token.
    """
    flagged = logits.join(allowed.withColumn("legal", F.lit(True)), ["node", "token"], "left_semi" if renormalise else "left")
    group = W.partitionBy("sample", "node")
    shifted = flagged.withColumn("shifted", F.col("logit") - F.max("logit").over(group))
    scored = shifted.withColumn("logprob", F.col("shifted") - F.log(F.sum(F.exp("shifted")).over(group)))
    legal = scored if renormalise else scored.filter("legal")
    return legal.select(*[c for c in logits.columns if c != "logit"], "logprob")


def _scored(target: Column, pad_id: int, end_id: int | None) -> Column:
    """Which positions of a padded target are scored: its tokens and its end, which is the first pad where both share an id."""
    ends = F.array_position(target, F.lit(pad_id).cast("int")) if end_id is not None and end_id == pad_id else F.lit(0)
    return F.transform(target, lambda t, i: (t != pad_id) | (i + 1 == ends))


def token_accuracy(df: DataFrame, pad_id: int, end_id: int | None = None) -> DataFrame:
    """Token accuracy per position and overall (pos null). Rows hold `target_tokens` and `pred_tokens`; the end is scored if given."""
    parts = F.arrays_zip(F.col("target_tokens").alias("t"), F.col("pred_tokens").alias("p"), _scored(F.col("target_tokens"), pad_id, end_id).alias("s"))
    units = df.select(F.posexplode(parts).alias("pos", "u")).filter("u.s")
    hit = F.coalesce(F.col("u.t") == F.col("u.p"), F.lit(False))
    counts = units.rollup("pos").agg(F.count("*").alias("n_tokens"), F.count_if(hit).alias("n_correct"))
    return counts.withColumn("accuracy", F.col("n_correct") / F.col("n_tokens"))


def noun_accuracy(df: DataFrame, pad_id: int, sample: str = "sample", end_id: int | None = None) -> DataFrame:
    """Share of samples with at least one valid target of which all scored tokens are right."""
    pairs = F.arrays_zip(F.col("target_tokens").alias("t"), F.col("pred_tokens").alias("p"), _scored(F.col("target_tokens"), pad_id, end_id).alias("s"))
    right = F.forall(pairs, lambda u: ~F.coalesce(u["s"], F.lit(False)) | F.coalesce(u["t"] == u["p"], F.lit(False)))
    valid = F.exists("target_tokens", lambda t: t != pad_id)
    per_sample = df.groupBy(sample).agg(F.bool_or(right & valid).alias("hit"))
    return per_sample.agg(F.count("*").alias("n_samples"), F.count_if("hit").alias("n_correct"), (F.count_if("hit") / F.count("*")).alias("accuracy"))


def achievable_accuracy(df: DataFrame, pad_id: int, end_id: int | None = None) -> DataFrame:
    """Best possible token and noun accuracy of multi-target rows (row_id, m, weight, token_ids).

    Targets of a row that share a prefix can only get one next token: the heaviest (ties: lowest id).
    Groups are the few targets of one row. Rows are padded, or unpadded with `end_id`, whose end is then scored too.
    Targets are dealt by row, so many a task, before they become steps; the steps themselves are never shuffled.
    """
    whole = df.withColumnRenamed("m", "target_id").filter((F.col("weight") > 0) & F.col("row_id").isNotNull())
    rows = cut_lineage(whole.withColumn("token_ids", F.filter("token_ids", lambda t: t != pad_id)))
    dealt = rows.repartition(1 + rows.count() // TARGETS_PER_PARTITION, "row_id")
    group = W.partitionBy("row_id", "pos", "node")
    units = _steps(dealt, "row_id", "weight", end_id=end_id).withColumn("w", F.sum("weight").over(W.partitionBy("row_id", "pos", "node", "token")))
    best = F.max(F.struct("w", (-F.col("token")).alias("t"))).over(group)["t"]
    judged = units.withColumn("hit", -F.col("token") == best)
    per_target = judged.groupBy("row_id", "target_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("c"))
    per_row = per_target.groupBy("row_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.bool_or(F.col("n") == F.col("c")).alias("any"))
    return per_row.agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("n_tokens"), F.sum("c").alias("n_correct"),
        (F.sum("c") / F.sum("n")).alias("token_accuracy"), (F.count_if("any") / F.count("*")).alias("noun_accuracy"),
    )
