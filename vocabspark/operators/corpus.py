"""Corpus expansion: templates x hypernym suffixes x nouns, with dense ids and random access.

Template and suffix tables are numbered and written once, in blocks. A vocabulary row is spread over the blocks it meets before
any join, so a key is one block of templates and one share of the vocabulary, whatever the sizes; while the tables are small the planner,
which knows their written size, broadcasts them instead. Ids come from arithmetic on per-vocabulary-row prefix sums,
so the expanded corpus itself is never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import digest_bucket, seeded_digest
from ..functions.text import field_names, fill_template, indefinite, squeeze
from ..session import cut_lineage
from .ordinals import bucketed_rank, last_at_most, last_start, prefix_ids, ranged_sums
from .vocab import explode_nouns, freq_sum, with_hypernym_targets

# Characters after a field that make a closing comma unnecessary.
NO_COMMA_BEFORE = (".", ",", "?", "!", ":", ";")

TEMPLATE_BLOCK = 256  # templates, or suffixes, that a vocabulary row meets at a time
VOCAB_SHARE = 50_000  # vocabulary rows that meet a block of templates at a time
ROWS_PER_PARTITION = 200_000  # expected samples per task of an expansion


def merge_collections(templates: DataFrame, spec: str) -> DataFrame:
    """Templates of the '|'-separated collections with summed frequency, in first-seen order (`seen`)."""
    names = [name.strip() for name in spec.split("|")]
    order = F.coalesce(*[F.when(F.col("collection") == n, F.lit(i)) for i, n in enumerate(names)])
    return (
        templates.withColumn("coll", order)
        .filter(F.col("coll").isNotNull() & (F.col("freq") >= 1))
        .groupBy("template")
        .agg(F.sum("freq").cast("long").alias("freq"), F.min(F.struct("coll", "pos")).alias("seen"))
    )


def _single_field(template: Column, what: str) -> Column:
    fields = field_names(template)
    return F.when(F.size(fields) == 1, fields[0]).otherwise(
        F.raise_error(F.concat(F.lit(f"exactly one field is needed in {what} template: "), template))
    )


def compile_prompts(templates: DataFrame, spec: str) -> DataFrame:
    """Prompt templates per kind: kind, template, need_article, need_hyp_comma, tfreq, seen. Row-local after the merge."""
    merged = merge_collections(templates, spec).withColumn("t", squeeze(F.col("template")))
    dotted = merged.withColumn("t", F.when(F.endswith("t", F.lit(".")), F.col("t")).otherwise(F.concat("t", F.lit("."))))
    typed = dotted.withColumn("ftype", _single_field(F.col("t"), "a prompt"))
    field = F.concat(F.lit("{"), F.col("ftype"), F.lit("}"))
    after = F.substr(F.col("t"), F.instr(F.col("t"), field) + F.length(field), F.lit(1))
    article = F.startswith(F.col("ftype"), F.lit("article_"))
    base = F.regexp_replace("ftype", "^article_", "")
    kinds = (
        F.when(base == "singular", F.array(F.lit("singular")))
        .when(base == "plural", F.array(F.lit("plural")))
        .when(base == "noun", F.array(F.lit("singular"), F.lit("plural")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown field in prompt template: "), F.col("t"))))
    )
    return typed.select(
        F.explode(kinds).alias("kind"),
        F.replace(F.col("t"), field, F.lit("{noun}")).alias("template"),
        article.alias("article"),
        (~after.isin(*NO_COMMA_BEFORE)).alias("need_hyp_comma"),
        F.col("freq").alias("tfreq"),
        "seen",
    ).select(
        "kind", "template", (F.col("article") & (F.col("kind") == "singular")).alias("need_article"),
        "need_hyp_comma", "tfreq", "seen",
    )


def number_prompts(compiled: DataFrame) -> DataFrame:
    """Compiled prompts with their position (tpos) and frequency before them (tfreq_before) per kind."""
    return ranged_sums(compiled, ["kind"], [F.col("seen")], tpos=F.lit(1).cast("long"), tfreq_before=F.col("tfreq"))


def compile_hypernyms(templates: DataFrame, spec: str) -> DataFrame:
    """Hypernym templates: template (null for the plain noun), template_comma, need_article, hfreq, seen."""
    merged = merge_collections(templates, spec).withColumn("t", squeeze(F.col("template")))
    typed = merged.withColumn("ftype", F.when(F.col("t").isNotNull(), _single_field(F.col("t"), "a hypernym")))
    checked = typed.withColumn(
        "t",
        F.when(F.col("t").isNull(), F.col("t"))
        .when(F.col("ftype").isin("target", "article_target"), F.replace("t", F.lit("{article_"), F.lit("{")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown field in hypernym template: "), F.col("t")))),
    )
    return checked.select(
        F.col("t").alias("template"),
        F.concat("t", F.lit(",")).alias("template_comma"),
        F.coalesce(F.col("ftype") == "article_target", F.lit(False)).alias("need_article"),
        F.col("freq").alias("hfreq"),
        "seen",
    )


def number_hypernyms(compiled: DataFrame) -> DataFrame:
    """Non-null hypernym templates with position (hpos) and frequency before them (hfreq_before).

    The plain noun is numbered along, as nothing, and left out by a stored flag: a filter on the template itself would be moved before
    the merge, where it compiles every row several times. The comma is added after the templates are written.
    """
    rows = compiled.withColumn("__plain", F.col("template").isNull()).drop("template_comma")
    counted = lambda value: F.when(F.col("__plain"), F.lit(0).cast("long")).otherwise(value)
    numbered = ranged_sums(rows, [], [F.col("seen")], hpos=counted(F.lit(1).cast("long")), hfreq_before=counted(F.col("hfreq")))
    with_comma = numbered.filter("NOT __plain").withColumn("template_comma", F.concat("template", F.lit(",")))
    return with_comma.select(*compiled.columns, "hpos", "hfreq_before")


def hypernym_freq_dist(numbered: DataFrame, max_hypernyms: int) -> DataFrame:
    """(n_hyp, hpos, hyp_idx, sfreq): frequencies dealt round-robin over the hypernym slots of a row,
    each template going on at the slot where the one before it stopped."""
    counts = numbered.select("hpos", "hfreq", "hfreq_before", F.explode(F.sequence(F.lit(1), F.lit(max(1, max_hypernyms)))).alias("n_hyp"))
    slots = counts.withColumn("hyp_idx", F.explode(F.sequence(F.lit(0), F.col("n_hyp") - 1)))
    # units hfreq_before to hfreq_before + hfreq - 1 that leave the remainder hyp_idx
    upto = lambda end: F.floor((end - 1 - F.col("hyp_idx")) / F.col("n_hyp"))
    dealt = slots.withColumn("sfreq", upto(F.col("hfreq_before") + F.col("hfreq")) - upto(F.col("hfreq_before")))
    return dealt.filter("sfreq > 0").select("n_hyp", "hpos", "hyp_idx", "sfreq")


def suffix_table(compiled: DataFrame, max_hypernyms: int) -> DataFrame:
    """All suffix choices for rows with n_hyp hypernyms, the empty suffix first, with spos and sfreq_before."""
    numbered = cut_lineage(number_hypernyms(compiled))
    spread = hypernym_freq_dist(numbered, max_hypernyms).join(numbered, "hpos")
    plain = compiled.groupBy().agg(
        F.sum(F.when(F.col("template").isNull(), F.col("hfreq"))).alias("none_freq"), F.sum("hfreq").alias("all_freq")
    )
    none_freq = F.when(
        F.col("none_freq").isNull(), F.raise_error(F.lit("one hypernym template must be null")).cast("long")
    ).otherwise(F.when(F.col("n_hyp") == 0, F.col("all_freq")).otherwise(F.col("none_freq")))
    empty = plain.withColumn("n_hyp", F.explode(F.sequence(F.lit(0), F.lit(max_hypernyms)))).select(
        "n_hyp", F.lit(-1).cast("long").alias("hpos"), F.lit(0).alias("hyp_idx"), none_freq.alias("sfreq"),
        F.lit(None).cast("string").alias("suffix_template"), F.lit(None).cast("string").alias("suffix_template_comma"),
        F.lit(False).alias("suffix_article"),
    )
    filled = spread.filter(F.col("n_hyp") <= max_hypernyms).select(
        "n_hyp", "hpos", "hyp_idx", "sfreq", F.col("template").alias("suffix_template"),
        F.col("template_comma").alias("suffix_template_comma"), F.col("need_article").alias("suffix_article"),
    )
    return ranged_sums(empty.unionByName(filled), ["n_hyp"], [F.col("hpos"), F.col("hyp_idx")], spos=F.lit(1).cast("long"), sfreq_before=F.col("sfreq"))


class CorpusPlan:
    """A compiled corpus: vocabulary blocks with id offsets, prompt templates and suffixes."""

    def __init__(
        self, vocab: DataFrame, prompt_rows: DataFrame, hypernym_rows: DataFrame, prompts: str, hypernyms: str,
        lookup: DataFrame | None = None,
    ):
        facts = vocab.agg(
            F.max(F.size("hypernyms")).alias("most"), F.count("*").alias("rows"), F.sum(F.size("singulars") + F.size("plurals")).alias("nouns")
        ).first()
        block = lambda pos: F.floor(F.col(pos) / TEMPLATE_BLOCK)
        self.prompts = cut_lineage(number_prompts(compile_prompts(prompt_rows, prompts)).drop("seen").withColumn("pblock", block("tpos")))
        compiled_hypernyms = compile_hypernyms(hypernym_rows, hypernyms)
        self.suffixes = cut_lineage(suffix_table(compiled_hypernyms, int(facts["most"] or 0)).withColumn("sblock", block("spos")))
        # The vocabulary is small and its expansion is not: spread the rows by the expected output.
        expected = int(facts["nouns"] or 0) * max(1, self.prompts.count()) * max(1, self.suffixes.count())
        self.partitions = 1 + expected // ROWS_PER_PARTITION
        self.shares = 1 + int(facts["rows"]) // VOCAB_SHARE
        rows = with_hypernym_targets(vocab, lookup).withColumn("n_hyp", F.size("hypernyms"))
        sides = F.array(
            *[
                F.struct(
                    F.lit(kind).alias("kind"), F.lit(i).cast("long").alias("side"),
                    F.col(f"{kind}s").alias("nouns"), F.col(f"{kind}s_freq").alias("freqs"),
                )
                for i, kind in enumerate(("singular", "plural"))
            ]
        )
        self.blocks_raw = rows.select("id", "target_noun", "n_hyp", "hypernym_targets", F.inline(sides)).filter(
            F.size("nouns") > 0
        )

    def sized_blocks(self) -> DataFrame:
        """Vocabulary blocks (id, kind) with their number of unique and of frequency-weighted samples."""
        kinds = self.prompts.groupBy("kind").agg(F.count("*").alias("n_templates"), F.sum("tfreq").alias("tfreq_sum"))
        choices = self.suffixes.groupBy("n_hyp").agg(F.count("*").alias("n_suffixes"), F.sum("sfreq").alias("sfreq_sum"))
        return (
            self.blocks_raw.join(kinds, "kind")
            .join(choices, "n_hyp")
            .withColumn("n_nouns", F.size("nouns").cast("long"))
            .withColumn("freq_sum", freq_sum(F.col("freqs")))
            .withColumn("n_usids", F.col("n_nouns") * F.col("n_templates") * F.col("n_suffixes"))
            .withColumn("n_fsids", F.col("freq_sum") * F.col("tfreq_sum") * F.col("sfreq_sum"))
        )

    def blocks(self) -> DataFrame:
        """Sized blocks with the first usid and fsid of each."""
        keyed = self.sized_blocks().withColumn("block_key", F.col("id") * 2 + F.col("side"))
        return prefix_ids(keyed, "block_key", usid_start=F.col("n_usids"), fsid_start=F.col("n_fsids"))

    def totals(self) -> DataFrame:
        """Row counts of the corpus from arithmetic alone (num_tids, num_usids, num_fsids)."""
        return self.sized_blocks().agg(
            F.countDistinct("id").alias("num_tids"), F.sum("n_usids").alias("num_usids"), F.sum("n_fsids").alias("num_fsids")
        )

    def samples(self, with_ids: bool = True) -> DataFrame:
        """Unique samples: id, kind, noun, text, target, freq and, on request, usid and fsid."""
        blocks = self.blocks() if with_ids else self.sized_blocks()
        freqs = F.col("freqs")
        nouns = F.transform(
            F.arrays_zip(F.col("nouns").alias("noun"), freqs.alias("freq")),
            lambda x, i: F.struct(
                i.cast("long").alias("npos"), x["noun"].alias("noun"), x["freq"].cast("long").alias("nfreq"),
                freq_sum(F.slice(freqs, F.lit(1), i)).alias("nfreq_before"),
            ),
        )
        keep = [c for c in blocks.columns if c not in ("nouns", "freqs")]
        parts = lambda n: F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / TEMPLATE_BLOCK))
        met = blocks.withColumn("pblock", F.explode(parts("n_templates"))).withColumn("sblock", F.explode(parts("n_suffixes")))
        spread = met.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(self.shares))).repartition(self.partitions, "id", "kind", "pblock", "sblock")
        shared = lambda df: df.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.shares - 1).cast("long"))))
        rows = (
            spread.select(*keep, "pblock", "sblock", "share", F.inline(nouns))
            .join(shared(self.suffixes), ["n_hyp", "sblock", "share"])
            .join(shared(self.prompts), ["kind", "pblock", "share"])
        )
        out = rows.withColumn("text", sample_text()).withColumn("sample_freq", F.expr("tfreq * sfreq * nfreq"))
        columns = ["id", "kind", "noun", "text", F.col("target_noun").alias("target"), F.col("sample_freq").alias("freq")]
        if with_ids:
            columns.append(F.expr("usid_start + (tpos * n_suffixes + spos) * n_nouns + npos").alias("usid"))
            columns.append(
                F.expr(
                    "fsid_start + freq_sum * (tfreq_before * sfreq_sum + tfreq * sfreq_before) + tfreq * sfreq * nfreq_before"
                ).alias("fsid")
            )
        return out.select(*columns)

    def lookup_fsids(self, requests: DataFrame) -> DataFrame:
        """Random access: rows (fsid) to usid, text and target without expanding the corpus.

        The block, the template and the suffix are each the last one that starts at or before the place asked
        for; the noun follows by division. Blocks grow with the vocabulary and are met by ranges; templates and
        suffixes come from a prompt file, so those of a kind are one sorted array, searched by halves.
        """
        blocks = cut_lineage(self.blocks().filter("n_fsids > 0"))
        found = last_start(requests.select("fsid"), blocks, [], "fsid", "fsid_start").join(blocks, "fsid_start")
        found = found.filter("fsid < fsid_start + n_fsids").withColumn("rest", F.expr("fsid - fsid_start"))
        asked = found.withColumn("tslot", F.expr("rest div (freq_sum * sfreq_sum)"))
        templates = self.prompts.select("kind", "tpos", "tfreq", "template", "need_article", "need_hyp_comma", F.col("tfreq_before").alias("tstart"))
        rows = _in_order(asked, templates, "kind", "tslot", "tstart")
        rows = rows.withColumn("rest", F.expr("rest - tstart * freq_sum * sfreq_sum")).withColumn("sslot", F.expr("rest div (tfreq * freq_sum)"))
        rows = _in_order(rows, self.suffixes.drop("sblock").withColumnRenamed("sfreq_before", "sstart"), "n_hyp", "sslot", "sstart")
        rows = rows.withColumn("nslot", F.expr("(rest - sstart * tfreq * freq_sum) div (tfreq * sfreq)"))
        ends = F.transform("freqs", lambda f, i: freq_sum(F.slice("freqs", F.lit(1), i + 1)))
        npos = F.size(F.filter(ends, lambda end: end <= F.col("nslot")))
        rows = rows.withColumn("npos", npos).withColumn("noun", F.get("nouns", F.col("npos")))
        usid = F.expr("usid_start + (tpos * n_suffixes + spos) * n_nouns + npos").alias("usid")
        return rows.select("fsid", usid, sample_text().alias("text"), F.col("target_noun").alias("target"))


def _in_order(rows: DataFrame, parts: DataFrame, by: str, at: str, start: str) -> DataFrame:
    """`rows` with the columns of the last part of their `by` that starts at or before `at`."""
    part = F.struct(start, *[c for c in parts.columns if c not in (by, start)])
    lists = parts.groupBy(by).agg(F.array_sort(F.collect_list(part)).alias("__parts"))
    lists = lists.withColumn("__starts", F.transform("__parts", lambda p: p[start]))
    met = rows.join(lists, by).withColumn("__at", last_at_most(F.col("__starts"), F.col(at)))
    return met.select(*rows.columns, F.get("__parts", F.col("__at")).alias("__part")).select(*rows.columns, "__part.*")


def sample_text() -> Column:
    """Text of an expanded row: article, noun, hypernym suffix, prompt template."""
    hypernym = F.get("hypernym_targets", F.col("hyp_idx"))
    named = F.when(F.col("suffix_article"), indefinite(hypernym)).otherwise(hypernym)
    pattern = F.when(F.col("need_hyp_comma"), F.col("suffix_template_comma")).otherwise(F.col("suffix_template"))
    suffix = F.coalesce(F.replace(pattern, F.lit("{target}"), named), F.lit(""))
    noun = F.when(F.col("need_article"), indefinite(F.col("noun"), suffix)).otherwise(F.concat("noun", suffix))
    return fill_template(F.col("template"), noun)


def repeat_samples(df: DataFrame, freq: str = "freq") -> DataFrame:
    """Each row `freq` times; place it after the costly step so that step runs once per unique row."""
    return df.withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), F.col(freq).cast("long"))))


def zip_permutations(items: DataFrame, key: str, m: int, seed: int) -> DataFrame:
    """`m` independent seeded permutations of the rows; rows that share a `rank` form a tuple, in `slot` order.

    Rank within each permutation is by digest, bucketed on the leading digits, so a permutation of
    any size is spread evenly.
    """
    drawn = items.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    keyed = drawn.withColumn("__digest", seeded_digest(seed, F.col("slot"), F.col(key)))
    order = [F.col("__digest"), F.col(key)]
    return bucketed_rank(keyed, ["slot"], digest_bucket(F.col("__digest")), order, "rank").drop("__digest")


def noun_multisets(vocab: DataFrame, prompts: DataFrame, multi_target_freq: list[int], seed: int) -> DataFrame:
    """Multisets of nouns: for each set size m with frequency f, every prompt repetition pairs m
    permutations of the frequency-weighted noun list. Nouns may repeat within a set.

    Columns: m, repetition, kind, tslot, rank, text, targets. Trailing zero frequencies have no effect.
    """
    plan = [(m, r) for m, f in enumerate(multi_target_freq, 1) for r in range(1, f + 1)]
    if not plan:
        raise ValueError("at least one multi-target frequency must be positive")
    prompts = cut_lineage(prompts.drop("seen"))
    slots = prompts.groupBy("kind").agg(F.sum("tfreq").alias("n_slots"))
    # Each vocabulary row is drawn very often: spread the rows by the expected draws.
    expected = vocab.count() * int(slots.agg(F.sum("n_slots")).first()[0] or 0) * sum(m for m, _ in plan)
    units = (
        explode_nouns(vocab.repartition(1 + expected // ROWS_PER_PARTITION, "id", "target_noun"))
        .withColumn("unit", F.explode(F.expr("sequence(freq_before, freq_before + freq - 1)")))
        .withColumn("item", F.concat_ws("/", "id", "unit"))
        .select("target_noun", "kind", "noun", "item")
    )
    draws = F.array(
        *[
            F.struct(F.lit(m).alias("m"), F.lit(r).alias("repetition"), F.lit(s).alias("slot"))
            for m, r in plan
            for s in range(m)
        ]
    )
    drawn = units.join(slots, "kind").withColumn("tslot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1)))
    rows = drawn.drop("n_slots").select("*", F.inline(draws))
    by = ["m", "repetition", "kind", "tslot"]
    rows = rows.withColumn("__digest", seeded_digest(seed, *[F.col(c) for c in by], F.col("slot"), F.col("item")))
    ranked = bucketed_rank(rows, [*by, "slot"], digest_bucket(F.col("__digest")), [F.col("__digest"), F.col("item")], "rank")
    sets = ranked.groupBy(*by, "rank").agg(F.array_sort(F.collect_list(F.struct("slot", "noun", "target_noun"))).alias("members"))
    templates = prompts.select("kind", "template", "need_article", F.explode(F.expr("sequence(tfreq_before, tfreq_before + tfreq - 1)")).alias("tslot"))
    filled = sets.join(templates, ["kind", "tslot"])
    named = F.transform("members", lambda x: F.when(F.col("need_article"), indefinite(x["noun"])).otherwise(x["noun"]))
    return filled.select(
        *by, "rank", fill_template(F.col("template"), F.array_join(named, " and ")).alias("text"),
        F.transform("members", lambda x: x["target_noun"]).alias("targets"),
    )


def photo_rows(targets: DataFrame) -> DataFrame:
    """One plain photo caption per target noun."""
    return targets.select(F.col("target_noun").alias("target"), F.format_string("a photo of a %s", "target_noun").alias("text"))
