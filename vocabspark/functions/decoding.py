"""Decoding-configuration names such as beam_k10_vtok0.5_gp_t1_a0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import semifix

METHODS = ("greedy", "beam", "all")


def parse_name(name: Column) -> Column:
    """Struct of the fields encoded in a decoding-configuration name; `valid` tells if it is legal."""
    parts = F.split(name, "_")
    method = F.get(parts, F.lit(0))
    fields = F.slice(parts, F.lit(2), F.size(parts))

    def value_of(prefix: str) -> Column:
        return F.element_at(
            F.concat(
                F.array(F.lit(None).cast("string")),
                F.transform(F.filter(fields, lambda p: p.startswith(prefix)), lambda p: F.substr(p, F.lit(2))),
            ),
            -1,
        )

    prior, guide = F.coalesce(value_of("v"), F.lit("none")), F.coalesce(value_of("g"), F.lit("n"))
    has_prior = prior != "none"
    topk = F.coalesce(value_of("k").try_cast("int"), F.lit(0))
    temperature = F.when(value_of("t").isNull(), F.lit(1.0)).otherwise(value_of("t").try_cast("double"))
    alpha = F.when(value_of("a").isNull(), F.lit(0.0)).otherwise(value_of("a").try_cast("double"))
    scaler = F.when(has_prior, F.regexp_extract(prior, r"^(?:tok|tgt)(.+)$", 1).try_cast("double")).otherwise(F.lit(0.0))
    valid = (
        method.isin(*METHODS)
        & (topk >= 1)
        & guide.isin("n", "p", "r")
        & scaler.isNotNull()
        & alpha.isNotNull()
        & F.coalesce(temperature > 0, F.lit(False))
        & F.forall(fields, lambda p: p.rlike("^[kvgta]."))
    )
    return F.struct(
        method.alias("method"),
        topk.alias("topk"),
        has_prior.alias("vocab_prior"),
        prior.startswith("tok").alias("vocab_per_token"),
        scaler.alias("vocab_scaler"),
        (guide != "n").alias("guided"),
        (guide == "r").alias("guide_renorm"),
        temperature.alias("temperature"),
        alpha.alias("length_alpha"),
        valid.alias("valid"),
    )


def make_name(cfg: Column) -> Column:
    """The name of a parsed configuration; parsing and making are inverse on legal names."""
    prior = F.when(
        cfg["vocab_prior"],
        F.concat(F.when(cfg["vocab_per_token"], F.lit("tok")).otherwise(F.lit("tgt")), semifix(cfg["vocab_scaler"])),
    ).otherwise(F.lit("none"))
    guide = F.when(~cfg["guided"], F.lit("n")).when(cfg["guide_renorm"], F.lit("r")).otherwise(F.lit("p"))
    return F.concat(
        cfg["method"], F.lit("_k"), cfg["topk"].cast("string"), F.lit("_v"), prior, F.lit("_g"), guide,
        F.lit("_t"), semifix(cfg["temperature"]), F.lit("_a"), semifix(cfg["length_alpha"]),
    )
