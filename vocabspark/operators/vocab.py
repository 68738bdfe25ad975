"""Vocabulary rows: filter, check, resolve hypernyms, align classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canon, squeeze

VOCAB_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("target_noun", T.StringType()),
        T.StructField("pretty_noun", T.StringType()),
        T.StructField("singulars", T.ArrayType(T.StringType())),
        T.StructField("singulars_freq", T.ArrayType(T.IntegerType())),
        T.StructField("plurals", T.ArrayType(T.StringType())),
        T.StructField("plurals_freq", T.ArrayType(T.IntegerType())),
        T.StructField("hypernyms", T.ArrayType(T.LongType())),
    ]
)
KINDS = ("singular", "plural")


def freq_sum(freqs: Column) -> Column:
    return F.aggregate(freqs, F.lit(0).cast("long"), lambda acc, f: acc + f)


def total_freq() -> Column:
    return freq_sum(F.col("singulars_freq")) + freq_sum(F.col("plurals_freq"))


def filter_vocab(vocab: DataFrame, threshold: int) -> DataFrame:
    """Keep rows above a total frequency. Hypernyms must be resolved on the unfiltered vocabulary."""
    return vocab.filter(total_freq() > threshold) if threshold > 0 else vocab


def vocab_violations(vocab: DataFrame, threshold: int = 0) -> DataFrame:
    """Rows (id, rule) of every rule that a vocabulary row breaks."""
    nouns = F.concat(F.array("target_noun", "pretty_noun"), F.col("singulars"), F.col("plurals"))
    freqs = F.concat(F.col("singulars_freq"), F.col("plurals_freq"))
    rules = {
        "bad_id": F.col("id").isNull() | (F.col("id") < 0),
        "empty_target": F.coalesce(F.col("target_noun"), F.lit("")) == "",
        "singular_lengths": F.size("singulars") != F.size("singulars_freq"),
        "plural_lengths": F.size("plurals") != F.size("plurals_freq"),
        "no_nouns": F.size("singulars") + F.size("plurals") < 1,
        "bad_freq": F.exists(freqs, lambda f: f.isNull() | (f < 1)),
        "bad_whitespace": F.exists(nouns, lambda n: n != squeeze(n)),
        "repeated_hypernym": F.size(F.array_distinct("hypernyms")) < F.size("hypernyms"),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    local = vocab.select("id", F.explode(found).alias("rule"))
    repeated_ids = vocab.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated_id").alias("rule"))
    kept = filter_vocab(vocab, threshold)
    repeated_targets = (
        kept.groupBy("target_noun")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"))
        .filter("n > 1")
        .select("id", F.lit("repeated_target").alias("rule"))
    )
    links = kept.select("id", F.explode("hypernyms").alias("hypernym_id"))
    known = vocab.select(F.col("id").alias("hypernym_id")).distinct()
    dangling = links.join(known, "hypernym_id", "left_anti").select("id", F.lit("unknown_hypernym").alias("rule"))
    return local.unionByName(repeated_ids).unionByName(repeated_targets).unionByName(dangling.distinct())


def resolve_hypernyms(vocab: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Long rows (id, pos, hypernym_id, hypernym_target), in hypernym order.

    The names are merged: a vocabulary file is much smaller than its rows, which a broadcast would bring to the driver.
    """
    lookup = vocab if lookup is None else lookup
    links = vocab.select("id", F.posexplode("hypernyms").alias("pos", "hypernym_id"))
    names = lookup.select(F.col("id").alias("hypernym_id"), F.col("target_noun").alias("hypernym_target"))
    return links.join(names.hint("merge"), "hypernym_id").select("id", "pos", "hypernym_id", "hypernym_target")


def with_hypernym_targets(vocab: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Vocabulary with its ordered `hypernym_targets` (a handful per row, bounded by the row itself)."""
    grouped = (
        resolve_hypernyms(vocab, lookup)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "hypernym_target"))).alias("links"))
        .select("id", F.transform("links", lambda x: x["hypernym_target"]).alias("hypernym_targets"))
    )
    empty = F.array().cast("array<string>")
    return vocab.join(grouped.hint("merge"), "id", "left").withColumn("hypernym_targets", F.coalesce("hypernym_targets", empty))


def _noun_structs(kind: str) -> Column:
    freqs = F.col(f"{kind}s_freq")

    def build(item: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("npos"),
            item["noun"].alias("noun"),
            item["freq"].cast("long").alias("freq"),
            freq_sum(F.slice(freqs, F.lit(1), i)).alias("freq_before"),
        )

    return F.transform(F.arrays_zip(F.col(f"{kind}s").alias("noun"), freqs.alias("freq")), build)


def explode_nouns(vocab: DataFrame, *keep: str) -> DataFrame:
    """One row per inserted noun: id, target_noun, kind, npos, noun, freq, freq_before and kept columns."""
    return vocab.select("id", "target_noun", *keep, F.inline(F.concat(*[_noun_structs(k) for k in KINDS])))


def noun_vocab_ids(vocab: DataFrame) -> DataFrame:
    """Distinct (noun, id) over singulars and plurals: every noun to each vocabulary row that holds it."""
    return vocab.select(
        F.explode(F.array_union("singulars", "plurals")).alias("noun"), "id"
    ).distinct()


def _class_names(classes: DataFrame) -> DataFrame:
    """Rows (class_id, pos, raw_name, name) of the comma-separated class names."""
    exploded = classes.select("class_id", F.posexplode(F.split("names", ",")).alias("pos", "raw_name"))
    trimmed = exploded.withColumn("raw_name", F.trim("raw_name"))
    return trimmed.withColumn("name", canon(F.col("raw_name")))


def align_classes(classes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Class names to target nouns; status is ok, ambiguous (several vocabulary rows) or ignored.

    The vocabulary is reduced to one row per noun before the join, so a class name shared by very
    many classes meets a single row.
    """
    totals = vocab.select("id", "target_noun", total_freq().alias("freq"))
    index = (
        noun_vocab_ids(vocab)
        .join(totals, "id")
        .groupBy(F.col("noun").alias("name"))
        .agg(
            F.count("*").alias("n_matches"),
            F.min(F.struct("id", "target_noun", "freq")).alias("first"),
        )
    )
    joined = _class_names(classes).join(index, "name", "left")
    status = F.when(F.col("n_matches").isNull(), "ignored").when(F.col("n_matches") > 1, "ambiguous").otherwise("ok")
    return joined.select(
        "class_id", "pos", "raw_name", "name", F.col("first.target_noun").alias("target_noun"),
        F.col("first.freq").alias("freq"), status.alias("status"),
    )


def class_alignment_report(aligned: DataFrame) -> DataFrame:
    """Names per status with the smallest matched frequency."""
    return aligned.groupBy("status").agg(
        F.count("*").alias("n_names"), F.countDistinct("class_id").alias("n_classes"), F.min("freq").alias("min_freq")
    )


def align_class_targets(classes: DataFrame, targets: DataFrame, noun_ids: DataFrame) -> DataFrame:
    """Long rows (class_id, target, is_main): available targets that share a vocabulary row with a class name.

    The main target is the smallest target of the first name with any match; where that name has
    several vocabulary rows the lowest id counts. List order is (is_main desc, target).
    """
    target_ids = targets.join(noun_ids.withColumnRenamed("noun", "target"), "target").select("target", "id").distinct()
    class_ids = _class_names(classes).join(noun_ids.withColumnRenamed("noun", "name"), "name").select("class_id", "pos", "id")
    matched = (
        class_ids.join(target_ids, "id")
        .groupBy("class_id", "target")
        .agg(F.min(F.struct("pos", "id", "target")).alias("first"))
    )
    main = matched.groupBy("class_id").agg(F.min("first").getField("target").alias("main_target"))
    return matched.join(main, "class_id").select(
        "class_id", "target", (F.col("target") == F.col("main_target")).alias("is_main")
    )


def new_vocab_rows(captions: DataFrame, vocab: DataFrame) -> DataFrame:
    """Caption table with empty caption lists appended for vocabulary rows it does not hold yet."""
    missing = vocab.join(captions.select("id").distinct(), "id", "left_anti")
    empty = F.array().cast("array<string>")
    missing = missing.withColumn("singular_captions", empty).withColumn("plural_captions", empty)
    return captions.unionByName(missing.select(*captions.columns))
