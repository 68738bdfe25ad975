"""Captions: checks, quotas, request rows, answer parsing, template choice and filling.

Captions are long rows (id, kind, pos, caption) with kind singular or plural; `id` is the vocabulary row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import digest_bucket, seeded_digest
from ..functions.text import CAPTION_TAIL, caption_lines, caption_template, fill_template, transliterate
from ..session import cut_lineage
from .ordinals import bucketed_rank, ranged_rank
from .vocab import explode_nouns, freq_sum

QUOTA_CAP = 10  # frequency above which a noun gets no more captions

# Fixed value: the request text for a list of captions.
CAPTION_REQUEST = (
    'Generate a list of %d image captions each containing the target object "%s" (%s). '
    "Use the style of the image captions for large language model pre-training. "
    "Don't use poetic language. "
    "Use a different sentence structure for each caption. "
    "Output the list in the following form: <nr>. <caption>"
)


def field_of(kind: Column) -> Column:
    return F.concat(F.lit("{"), kind, F.lit("}"))


def with_full_stop(caption: Column) -> Column:
    return F.when(F.endswith(caption, F.lit(".")), caption).otherwise(F.concat(caption, F.lit(".")))


def caption_errors(captions: DataFrame) -> DataFrame:
    """Rows (id, kind, rule) that forbid use: a caption without its placeholder, or repeated once dotted."""
    rows = captions.withColumn("caption", with_full_stop(F.col("caption")))
    copies = rows.groupBy("id", "kind", "caption").agg(F.count("*").alias("n"))
    rules = copies.groupBy("id", "kind").agg(
        F.bool_or(~F.contains("caption", field_of(F.col("kind")))).alias("no_placeholder"), (F.max("n") > 1).alias("repeated")
    )
    found = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in ("no_placeholder", "repeated")]))
    return rules.select("id", "kind", F.explode(found).alias("rule"))


def caption_lint(captions: DataFrame, quotas: DataFrame) -> DataFrame:
    """Rows (id, kind, rule) of the advisory checks; kind 'both' for repeats across kinds.

    `quotas` holds (id, num_singular_captions, num_plural_captions). Copies of a caption are
    counted first, so the checks see each distinct caption once.
    """
    copies = captions.groupBy("id", "kind", "caption").agg(F.count("*").alias("n"))
    fields = F.array_distinct(F.regexp_extract_all("caption", F.lit(r"(\{[^{}]*\})"), 1))
    want = field_of(F.col("kind"))
    tail = F.right("caption", F.lit(1))
    stats = copies.groupBy("id", "kind").agg(
        F.sum("n").alias("have"), (F.max("n") > 1).alias("repeated"),
        F.bool_or(~F.contains("caption", want)).alias("no_placeholder"),
        F.bool_or((F.size(fields) != 1) | (F.get(fields, F.lit(0)) != want)).alias("other_placeholder"),
        F.bool_or(tail.isin(*CAPTION_TAIL)).alias("end_punctuation"),
        F.bool_or(transliterate(F.col("caption")) != F.col("caption")).alias("non_ascii"),
    )
    sides = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"num_{k}_captions").alias("quota")) for k in ("singular", "plural")]
    )
    wanted = quotas.select("id", F.inline(sides))
    joined = wanted.join(stats, ["id", "kind"], "left")
    rules = {"too_few": F.coalesce("have", F.lit(0)) < F.col("quota")}
    rules |= {r: F.coalesce(F.col(r), F.lit(False)) for r in ("repeated", "no_placeholder", "other_placeholder", "end_punctuation", "non_ascii")}
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    single = joined.select("id", "kind", F.explode(found).alias("rule"))
    across = copies.join(quotas.select("id"), "id", "left_semi").groupBy("id", "caption").agg(F.sum("n").alias("n")).filter("n > 1")
    both = across.select("id", F.lit("both").alias("kind"), F.lit("repeated").alias("rule")).distinct()
    return single.unionByName(both)


def caption_quotas(vocab: DataFrame, per_freq: int) -> DataFrame:
    """Wanted captions per kind: capped frequency times `per_freq`, none without nouns."""
    quota = lambda kind: (F.least(freq_sum(F.col(f"{kind}s_freq")), F.lit(QUOTA_CAP)) * per_freq).cast("int").alias(f"num_{kind}_captions")
    return vocab.select("*", quota("singular"), quota("plural"))


def caption_requests(nouns: DataFrame, n_captions: int) -> DataFrame:
    """The next request of each noun that lacks captions: singular first, then its most frequent plural.

    Needs the quotas and `have_singular`, `have_plural`.
    """
    singular = F.col("have_singular") < F.col("num_singular_captions")
    plural = F.col("have_plural") < F.col("num_plural_captions")
    top = F.array_position("plurals_freq", F.array_max("plurals_freq"))
    most = F.get("plurals", (top - 1).cast("int"))
    mode = F.when(singular, F.lit("singular")).otherwise(F.lit("plural"))
    noun = F.when(singular, F.col("pretty_noun")).otherwise(most)
    return nouns.filter(singular | plural).select(
        "id", mode.alias("mode"), noun.alias("noun"), F.format_string(CAPTION_REQUEST, F.lit(n_captions), noun, mode).alias("prompt")
    )


def parsed_captions(answers: DataFrame) -> DataFrame:
    """Caption lines of answers (id, seq, content): id, seq, line, caption."""
    return answers.select("id", "seq", F.posexplode(caption_lines(F.col("content"))).alias("line", "caption"))


def templated_captions(captions: DataFrame, vocab: DataFrame) -> DataFrame:
    """Captions with the first singular and the first plural noun in them replaced by placeholders."""
    first = lambda nouns, field: F.get(
        F.array_compact(F.transform(nouns, lambda n: caption_template(F.col("caption"), n, field))), F.lit(0)
    )
    rows = captions.join(vocab.select("id", "pretty_noun", "singulars", "plurals"), "id")
    singulars = F.when(F.size("singulars") > 0, F.concat(F.array("pretty_noun"), F.col("singulars"))).otherwise(F.col("singulars"))
    return rows.select(
        *captions.columns, first(singulars, "singular").alias("singular_template"), first(F.col("plurals"), "plural").alias("plural_template")
    )


class _CaptionState:
    """Accepted captions of one noun while its answers come in."""

    def __init__(self, want_singular: int, want_plural: int):
        self.want = {"singular": want_singular, "plural": want_plural}
        self.have: dict[str, dict[str, None]] = {"singular": {}, "plural": {}}
        self.idle = 0
        self.stopped = False
        self.seen = 0

    def missing(self, kind: str) -> int:
        return self.want[kind] - len(self.have[kind])

    def open(self) -> bool:
        return not self.stopped and (self.missing("singular") > 0 or self.missing("plural") > 0)

    def close_answer(self) -> None:
        """Five fruitless answers at the start, or four after an accepted caption, end the noun."""
        self.stopped = self.stopped or self.idle > 3
        self.idle += 1
        self.seen += 1

    def answer(self, ordinal: int, singulars, plurals) -> list[tuple[str, int, str]]:
        """The answer at this place among the noun's, by the templates of its lines; those skipped since had none."""
        while self.seen < ordinal and not self.stopped:
            self.close_answer()
        accepted = []
        if not self.open():
            return accepted
        for singular, plural in zip(singulars, plurals):
            pick = {kind: next((t for t in line if t not in self.have[kind]), None) for kind, line in (("singular", singular), ("plural", plural))}
            if pick["singular"] and pick["plural"]:
                # Both fit: it goes to the side that misses more, ties to the plural.
                drop = "singular" if self.missing("singular") <= self.missing("plural") else "plural"
                pick[drop] = None
            for kind, template in pick.items():
                if template:
                    accepted.append((kind, len(self.have[kind]), template))
                    self.have[kind][template] = None
                    self.idle = 0
        self.close_answer()
        return accepted


def collect_captions(answers: DataFrame, vocab: DataFrame) -> DataFrame:
    """Accepted captions (id, kind, pos, caption, seq) from answers in `seq` order, under the quotas of `vocab`.

    The rule depends on what was accepted before, so each noun's answers count in order. Parsing and matching
    happen in the JVM, before the shuffle; an answer in which no line fits is only its place among the noun's answers, so just the
    fitting lines of the others meet. The fold streams over sorted partitions and keeps one noun's accepted
    captions in memory, never its answers.
    """
    nouns = vocab.select("id", "pretty_noun", "singulars", "plurals", "num_singular_captions", "num_plural_captions")
    singulars = F.when(F.size("singulars") > 0, F.concat(F.array("pretty_noun"), F.col("singulars"))).otherwise(F.col("singulars"))

    def matches(caption: Column, variants: Column, field: str) -> Column:
        return F.array_compact(F.transform(variants, lambda n: caption_template(caption, n, field)))

    lines = F.transform(
        caption_lines(F.col("content")),
        lambda c: F.struct(matches(c, F.col("names"), "singular").alias("singular"), matches(c, F.col("plurals"), "plural").alias("plural")),
    )
    fitting = F.filter(lines, lambda x: (F.size(x["singular"]) > 0) | (F.size(x["plural"]) > 0))
    found = answers.join(nouns, "id").withColumn("names", singulars).select(
        "id", "seq", "num_singular_captions", "num_plural_captions", F.inline(F.array(F.struct(fitting.alias("lines"))))
    )
    places = ranged_rank(answers.select("id", "seq"), ["id"], [F.col("seq")], "ordinal")
    part = lambda kind: F.transform("lines", lambda x: x[kind]).alias(kind)
    rows = (
        found.filter(F.size("lines") > 0)
        .join(places, ["id", "seq"])
        .select("id", "seq", "ordinal", "num_singular_captions", "num_plural_captions", part("singular"), part("plural"))
        .repartition("id")
        .sortWithinPartitions("id", "ordinal")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for own, seq, ordinal, want_s, want_p, singular, plural in zip(*(batch[c] for c in batch.columns)):
                if own != current:
                    current, state = own, _CaptionState(want_s, want_p)
                out.extend((own, kind, pos, text, seq) for kind, pos, text in state.answer(ordinal, singular, plural))
            yield pd.DataFrame(out, columns=["id", "kind", "pos", "caption", "seq"])

    return rows.mapInPandas(fold, "id long, kind string, pos int, caption string, seq long")


def join_captions(captions: DataFrame, vocab: DataFrame) -> DataFrame:
    """Dotted captions of vocabulary nouns with `target_noun`."""
    return captions.join(vocab.select("id", "target_noun"), "id").withColumn("caption", with_full_stop(F.col("caption")))


def captions_without_vocab(captions: DataFrame, vocab: DataFrame) -> DataFrame:
    """Captions per kind whose noun is not in the vocabulary."""
    return captions.join(vocab.select("id"), "id", "left_anti").groupBy("kind").agg(
        F.countDistinct("id").alias("n_targets"), F.count("*").alias("n_captions")
    )


def vocab_without_captions(captions: DataFrame, vocab: DataFrame) -> DataFrame:
    return vocab.select("id", "target_noun").join(captions.select("id").distinct(), "id", "left_anti")


def _template_limits(vocab: DataFrame, multiplier: int) -> DataFrame:
    sides = F.array(
        *[F.struct(F.lit(k).alias("kind"), (freq_sum(F.col(f"{k}s_freq")) * multiplier).alias("n_wanted")) for k in ("singular", "plural")]
    )
    return vocab.select("id", "target_noun", F.inline(sides))


def choose_templates(captions: DataFrame, vocab: DataFrame, template_multiplier: int, sample_multiplier: int, seed: int) -> DataFrame:
    """At most frequency x multiplier captions per (id, kind), chosen and ordered by digest.

    The template multiplier is capped by the sample multiplier. Columns: id, kind, tidx, template.
    """
    limits = _template_limits(vocab, min(template_multiplier, sample_multiplier))
    rows = join_captions(captions, vocab).withColumn("__digest", seeded_digest(seed, F.col("id"), F.col("kind"), F.col("caption")))
    ranked = bucketed_rank(rows, ["id", "kind"], digest_bucket(F.col("__digest")), [F.col("__digest"), F.col("caption")], "tidx")
    return ranked.join(limits.drop("target_noun"), ["id", "kind"]).filter(F.col("tidx") < F.col("n_wanted")).select(
        "id", "kind", "target_noun", "tidx", F.col("caption").alias("template")
    )


def fill_captions(templates: DataFrame, vocab: DataFrame, sample_multiplier: int) -> DataFrame:
    """Each noun variant frequency x multiplier times, templates taken in turn across the variants.

    Columns: id, kind, sample, noun, tidx, text, target. The templates are read twice, so they are
    written out once.
    """
    templates = cut_lineage(templates)
    counts = templates.groupBy("id", "kind").agg(F.count("*").alias("n_templates"))
    nouns = explode_nouns(vocab).join(counts, ["id", "kind"])
    unit = F.expr(f"sequence(freq_before * {sample_multiplier}, (freq_before + freq) * {sample_multiplier} - 1)")
    units = nouns.select("id", "kind", "noun", "n_templates", F.explode(unit).alias("sample"))
    dealt = units.withColumn("tidx", F.pmod("sample", F.col("n_templates")))
    joined = dealt.join(templates, ["id", "kind", "tidx"])
    text = fill_template(fill_template(F.col("template"), F.col("noun"), "{singular}"), F.col("noun"), "{plural}")
    return joined.select("id", "kind", "sample", "noun", "tidx", text.alias("text"), F.col("target_noun").alias("target"))


def template_reuse(filled: DataFrame) -> DataFrame:
    """How many templates occur n times."""
    return filled.groupBy("id", "kind", "tidx").agg(F.count("*").alias("n_uses")).groupBy("n_uses").agg(F.count("*").alias("n_templates"))


def sample_reuse(filled: DataFrame) -> DataFrame:
    """How many distinct (text, target) samples occur n times."""
    return filled.groupBy("text", "target").agg(F.count("*").alias("n_uses")).groupBy("n_uses").agg(F.count("*").alias("n_samples"))


def caption_accounting(captions: DataFrame, vocab: DataFrame, template_multiplier: int, sample_multiplier: int) -> DataFrame:
    """Per kind: all captions = outside the vocabulary + used + unused."""
    limits = _template_limits(vocab, min(template_multiplier, sample_multiplier)).drop("target_noun")
    counts = captions.groupBy("id", "kind").agg(F.count("*").alias("n"))
    joined = counts.join(limits, ["id", "kind"], "left")
    used = F.when(F.col("n_wanted").isNotNull(), F.least("n", "n_wanted"))
    return joined.groupBy("kind").agg(
        F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(F.col("n_wanted").isNull(), F.col("n"))), F.lit(0)).alias("n_outside"),
        F.coalesce(F.sum(used), F.lit(0)).alias("n_used"), F.coalesce(F.sum(F.col("n") - used), F.lit(0)).alias("n_unused"),
    )
