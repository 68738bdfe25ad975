"""Annotation by repeated opinions: needs, requests, answers, consensus.

Opinions are long rows (image, noun, ts, event_id, opinion) in arrival order (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import digest_bucket, digest_long, seeded_digest
from ..functions.text import canon, squeeze
from ..session import cut_lineage
from .ordinals import bucketed_rank, ranged_sums

# Token estimate and price of a request.
CHARS_PER_TOKEN = 3.8
TOKENS_PER_IMAGE = 85
USD_PER_MILLION_IN = 5
USD_PER_MILLION_OUT = 15

# Fixed value: the length of the instruction that goes with every request.
SYSTEM_CHARS = 639


@dataclass(frozen=True)
class OpinionRule:
    """How many opinions a noun needs and the share that settles it."""

    least: int
    most: int
    confidence: float

    def __post_init__(self):
        if not 1 <= self.least <= self.most:
            raise ValueError("opinion limits must satisfy 1 <= least <= most")
        if not 0.5 < self.confidence < 1:
            raise ValueError("confidence must lie between 0.5 and 1")

    def needed(self, n: Column, n_correct: Column) -> Column:
        """Opinions still needed after n, of which n_correct say correct."""
        c = self.confidence
        n, right = n.cast("double"), n_correct.cast("double")
        settle = F.least((n * c - right) / (1 - c), (n * c - (n - right)) / (1 - c), F.lit(float(self.most)) - n)
        return F.greatest(F.ceil(settle), F.lit(self.least) - n, F.lit(0)).cast("int")

    def category(self, n: Column, n_correct: Column) -> Column:
        right, wrong = n_correct / n, (n - n_correct) / n
        return F.when(right >= self.confidence, "correct_primary").when(wrong >= self.confidence, "incorrect").otherwise("close_primary")


def opinion_counts(opinions: DataFrame) -> DataFrame:
    return opinions.groupBy("image", "noun").agg(F.count("*").alias("n"), F.count_if("opinion").alias("n_correct"))


def accept_opinions(opinions: DataFrame, rule: OpinionRule) -> DataFrame:
    """The opinions that were still needed when they arrived.

    Nothing changes once a noun needs no more, so the accepted ones are a prefix of at most `most`:
    the ranked filter lets Spark cut each group before the shuffle, however large it is.
    """
    order = W.partitionBy("image", "noun").orderBy("ts", "event_id")
    head = opinions.withColumn("seq", F.row_number().over(order)).filter(F.col("seq") <= rule.most)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    right = F.coalesce(F.sum(F.col("opinion").cast("int")).over(before), F.lit(0))
    open_now = head.withColumn("open", rule.needed(F.col("seq") - 1, right) > 0)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return open_now.withColumn("accepted", F.min("open").over(upto)).filter("accepted").drop("open", "accepted")


def consensus(opinions: DataFrame, rule: OpinionRule) -> DataFrame:
    """Category per (image, noun), with a flag for an unexpected number of opinions."""
    counts = opinion_counts(opinions)
    category = rule.category(F.col("n"), F.col("n_correct"))
    odd = ~F.col("n").between(rule.least, rule.most) | ((F.col("category") == "close_primary") & (F.col("n") != rule.most))
    return counts.withColumn("category", category).withColumn("odd_count", odd)


def needed_opinions(opinions: DataFrame, predicted: DataFrame, rule: OpinionRule) -> DataFrame:
    """Opinions needed per (image, noun) over known nouns and predicted ones (columns image, noun)."""
    joined = opinion_counts(opinions).join(predicted.select("image", "noun").distinct(), ["image", "noun"], "full")
    n, right = F.coalesce("n", F.lit(0)), F.coalesce("n_correct", F.lit(0))
    need = F.when(F.col("n").isNull(), F.lit(rule.least)).otherwise(rule.needed(n, right))
    return joined.select("image", "noun", n.alias("n"), need.alias("need"))


def request_lists(needs: DataFrame, min_nouns: int, seed: int) -> DataFrame:
    """Deal nouns onto requests: rows (image, request, slot, noun, padded).

    Each noun appears in as many requests as it needs opinions, most needed first, then by name.
    Short requests are padded with nouns that need no more, in seeded order. Positions come from
    running sums over ranges, so an image with very many nouns is spread over tasks. The needs are read
    several times, so they are written out once.
    """
    needs = cut_lineage(needs.select("image", "noun", "need"))
    open_nouns = needs.filter("need > 0")
    totals = needs.groupBy("image").agg(
        F.sum("need").alias("total"), F.max("need").alias("top"), F.count_if(F.col("need") <= 0).alias("n_done")
    ).filter("total > 0")
    n_requests = F.greatest(F.col("top"), F.ceil(F.col("total") / (2 * min_nouns - 1)).cast("long"))
    sized = totals.withColumn("n_requests", n_requests.cast("long"))
    missing = F.col("n_requests") * (min_nouns - F.expr("total div n_requests")) - F.expr("total % n_requests")
    sized = sized.withColumn("n_pad", F.greatest(F.least(missing, F.col("n_requests") * F.col("n_done")), F.lit(0)))

    placed = ranged_sums(open_nouns.select("image", "noun", "need"), ["image"], [(-F.col("need")), F.col("noun")], start=F.col("need"))
    dealt = placed.join(sized.select("image", "n_requests"), "image").select(
        "image", "noun", "n_requests", F.explode(F.expr("sequence(start, start + need - 1)")).alias("position"), F.lit(False).alias("padded")
    )
    done = needs.filter("need <= 0").join(sized.filter("n_pad > 0"), "image").withColumn(
        "__digest", seeded_digest(seed, F.col("image"), F.col("noun"))
    )
    ranked = bucketed_rank(done, ["image"], digest_bucket(F.col("__digest")), [F.col("__digest"), F.col("noun")], "rank")
    each, extra = F.expr("n_pad div n_done"), F.expr("n_pad % n_done")
    copies = each + F.when(F.col("rank") < extra, 1).otherwise(0)
    pads = ranked.withColumn("copies", copies).filter("copies > 0").withColumn("start", F.col("total") + F.col("rank") * each + F.least("rank", extra))
    padded = pads.select(
        "image", "noun", "n_requests", F.explode(F.expr("sequence(start, start + copies - 1)")).alias("position"), F.lit(True).alias("padded")
    )
    rows = dealt.unionByName(padded)
    return rows.select(
        "image", F.expr("position % n_requests").alias("request"), F.expr("position div n_requests").alias("slot"), "noun", "padded"
    )


def request_texts(lists: DataFrame, seed: int | None = None) -> DataFrame:
    """Numbered request text and token estimate per (image, request); a seed shuffles the nouns in a request."""
    key = F.col("slot").cast("string") if seed is None else seeded_digest(seed, F.col("image"), F.col("request"), F.col("noun"))
    order = F.struct(F.col("slot").alias("key"), "noun") if seed is None else F.struct(key.alias("key"), "noun")
    grouped = lists.groupBy("image", "request").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["noun"]).alias("nouns"))
    lines = F.transform("nouns", lambda noun, i: F.concat((i + 1).cast("string"), F.lit(") "), noun))
    text = F.array_join(lines, "\n")
    tokens = F.lit(SYSTEM_CHARS / CHARS_PER_TOKEN) + (F.lit(float(TOKENS_PER_IMAGE)) + F.length(text) / F.lit(CHARS_PER_TOKEN))
    return grouped.select("image", "request", "nouns", text.alias("text"), F.bround(tokens).cast("long").alias("num_tokens"))


def pack_requests(requests: DataFrame, max_requests: int, max_bytes: int, max_tokens: int, images_per_shard: int = 50_000) -> DataFrame:
    """Greedy batches of requests (image, request, num_bytes, num_tokens), cut at image boundaries.

    A batch closes after an image once it reaches a limit, the token limit with room for ten more
    requests of the last size. Images are dealt to shards by digest, as many shards as they need, and each shard is
    packed on its own in image order. The fold sees one row per image, its sums, and keeps a few counters.
    """
    rows = requests.select("image", *[F.col(c).cast("long").alias(c) for c in ("request", "num_bytes", "num_tokens")])
    sums = cut_lineage(rows.groupBy("image").agg(
        F.count("*").alias("n"), F.sum("num_bytes").alias("size"), F.sum("num_tokens").alias("tokens"), F.max_by("num_tokens", "request").alias("last")
    ))
    shards = 1 + sums.count() // images_per_shard
    placed = sums.withColumn("shard", F.pmod(digest_long(F.md5(F.col("image").cast("binary"))), F.lit(shards)).cast("int"))
    ordered = placed.select("shard", "image", "n", "size", "tokens", "last").repartition(shards, "shard").sortWithinPartitions("shard", "image")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, batch, count, size, tokens, last = None, 0, 0, 0, 0, 0
        for frame in frames:
            numbers = []
            for own, n, bytes_, used, final in zip(*(frame[c].tolist() for c in ("shard", "n", "size", "tokens", "last"))):
                if own != shard:
                    shard, batch, count, size, tokens = own, 0, 0, 0, 0
                elif count >= max_requests or size >= max_bytes or tokens >= max_tokens - last * 10:
                    batch, count, size, tokens = batch + 1, 0, 0, 0
                count, size, tokens, last = count + n, size + bytes_, tokens + used, final
                numbers.append(batch)
            yield frame.assign(batch=pd.Series(numbers, dtype="int32"))[["shard", "batch", "image"]]

    batches = ordered.mapInPandas(pack, "shard int, batch int, image string")
    return rows.join(batches, "image").select("shard", "batch", "image", "request", "num_bytes", "num_tokens")


# Enumerated answer lines (number, then text up to the line end) and the verdict that ends one.
# (?d) makes only \n end a line.
_LINE = r"(?mid)^([1-9][0-9]*)%s[^\S\n]*(.*?)[^\S\n]*$"
_VERDICT_LINE = r"(?mid)^([1-9][0-9]*)%s[^\S\n]*(.*?(?:correct|incorrect))[^\S\n]*$"
_VERDICT = r"(?i)^(.*?)['.\W\s]+(correct|incorrect)$"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator, so that each is computed once however often it is used later.

    Plain projections would be merged, and the regular expressions run again for every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_answers(answers: DataFrame) -> DataFrame:
    """Answers (request_id, image, nouns, finish_reason, content) with parsed lines, description and error.

    `error` is null for an accepted answer; a rejected one gives no opinions at all.
    """
    text, n = F.col("content"), F.size("nouns")
    marks = {"dots": r"\.", "brackets": r"\)"}

    def found(pattern: str, mark: str) -> Column:
        regex = F.lit(pattern % mark)
        return F.arrays_zip(
            F.regexp_extract_all(text, regex, 1).alias("number"), F.regexp_extract_all(text, regex, 2).alias("line")
        )

    rows = _once(answers, **{f"all_{name}": found(_LINE, mark) for name, mark in marks.items()})
    both = (F.size("all_dots") > 0) & (F.size("all_brackets") > 0)
    strict = {name: (F.size(f"all_{name}") > n) | both for name in marks}
    rows = _once(rows, **{name: F.when(strict[name], found(_VERDICT_LINE, mark)).otherwise(F.col(f"all_{name}")) for name, mark in marks.items()})
    use_dots, use_brackets = F.size("dots") == n, F.size("brackets") == n
    first_line = F.when(use_dots, _line_pattern(strict["dots"], marks["dots"])).otherwise(_line_pattern(strict["brackets"], marks["brackets"]))
    # the description ends where the first line matches, wherever else its text stands
    head = F.substr(text, F.lit(1), F.greatest(F.regexp_instr(text, first_line) - 1, F.lit(0)))
    chosen = F.when(use_dots, F.col("dots")).when(use_brackets, F.col("brackets"))
    rows = _once(rows, chosen=chosen, description=squeeze(head))

    def read(u: Column) -> Column:
        line = squeeze(u["c"]["line"])
        return F.struct(
            u["noun"].alias("noun"), u["c"]["number"].cast("int").alias("number"), line.rlike(_VERDICT).alias("fits"),
            F.regexp_replace(F.regexp_extract(line, _VERDICT, 1), r"^[*_]+|[*_]+$", "").alias("said"),
            (F.length(F.regexp_extract(line, _VERDICT, 2)) == 7).alias("opinion"),
        )

    def judge(u: Column, i: Column) -> Column:
        blank = u["noun"] == ""
        error = (
            F.when(u["number"] != i + 1, "order")
            .when(~blank & ~u["fits"], "line")
            .when(~blank & (u["said"] != u["noun"]) & (canon(u["said"]) != canon(u["noun"])), "noun")
        )
        return F.struct(u["noun"].alias("noun"), (~blank & u["opinion"]).alias("opinion"), error.alias("error"))

    zipped = F.arrays_zip(F.col("nouns").alias("noun"), F.col("chosen").alias("c"))
    rows = _once(rows, lines=F.when(F.col("chosen").isNotNull(), F.transform(zipped, read)))
    rows = _once(rows, judged=F.transform("lines", judge))
    first_error = F.get(F.array_compact(F.transform("judged", lambda j: j["error"])), F.lit(0))
    error = (
        F.when(F.col("finish_reason") != "stop", "finish")
        .when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(F.col("chosen").isNull(), "count")
        .when(first_error.isNotNull(), first_error)
        .when(F.size(F.array_distinct("nouns")) != n, "repeated_noun")
    )
    return _once(rows, error=error).drop("all_dots", "all_brackets", "dots", "brackets", "chosen", "lines")


def _line_pattern(strict: Column, mark: str) -> Column:
    return F.when(strict, F.lit(_VERDICT_LINE % mark)).otherwise(F.lit(_LINE % mark))


def answer_opinions(parsed: DataFrame) -> DataFrame:
    """Opinions of the accepted answers: image, noun, opinion and the answer's columns."""
    keep = [c for c in ("request_id", "image", "ts") if c in parsed.columns]
    return parsed.filter("error IS NULL").select(*keep, F.posexplode("judged").alias("pos", "j")).select(
        *keep, "pos", "j.noun", "j.opinion"
    )


def description_counts(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL").groupBy("image", "description").agg(F.count("*").alias("n"))


def usage_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * USD_PER_MILLION_IN + tokens_out * USD_PER_MILLION_OUT) / F.lit(1e6)


def usage_totals(responses: DataFrame, by: list[str]) -> DataFrame:
    """Requests, tokens and cost per group, with subtotals and the grand total."""
    sums = responses.rollup(*by).agg(
        F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return sums.withColumn("total_tokens", total).withColumn("cost_usd", usage_cost(F.col("prompt_tokens"), F.col("completion_tokens")))


def transfer_opinions(target: DataFrame, source: DataFrame, target_images: DataFrame) -> DataFrame:
    """Target opinions plus the source's for nouns the target lacks, on images both know."""
    known = target.select("image", "noun").distinct()
    extra = source.join(target_images.select("image").distinct(), "image", "left_semi").join(known, ["image", "noun"], "left_anti")
    return target.unionByName(extra)


def batch_health(responses: DataFrame, min_valid: float = 0.8, max_bad: int = 5) -> DataFrame:
    """Per batch (columns batch, valid, expected): done, accepted; and whether bad batches force a stop."""
    counts = responses.groupBy("batch").agg(
        F.max("expected").alias("expected"), F.count("*").alias("n_answers"), F.count_if("valid").alias("n_valid")
    )
    flags = counts.withColumns({
        "done": F.col("n_answers") >= F.col("expected"), "accepted": F.col("n_valid") >= F.col("expected") * F.lit(min_valid),
    })
    n_bad = flags.agg(F.count_if(F.col("done") & ~F.col("accepted")).alias("n_bad")).scalar()
    return flags.withColumn("stop", n_bad >= max_bad)
