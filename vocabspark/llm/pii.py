"""Personal data: fixed patterns, and terms that give a protected entity away.

Base spans are emails, IP addresses, card and telephone numbers. Each is a protected entity; the words of its documents are terms
that may reveal it, wherever they stand. Over the whole corpus, a term's information about an entity is their pointwise mutual information
(by documents), and what there is to know is the entity's own information. A term that gives away at least
`disclosure` of it, and stands with the entity in at least `support` documents, is a disclosing term:
its spans in documents with that entity are reported as kind `term`, to be generalised or removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, cut_lineage, map_rows

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns.
# An address is looked for at its "@": the name before it is the run of name characters that ends there.
_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, as all its digits have the same end.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

#: Terms a task counts before it hands its counts on.
COUNTED = 300_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and apart, in time linear in the text."""
    done = 0  # nothing before belongs to a later name
    at = text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_NAME))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, by start, then kind."""
    spans = []
    spans += [(start, 0, end) for start, end in emails(text)]
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans)


def term_key(term: str) -> int:
    key = xxhash.xxh64_intdigest(term.lower().encode())
    return key - (1 << 64) if key >> 63 else key


def _entity(kind: int, text: str) -> int:
    return term_key(f"{KINDS[kind]}:{_digits(text) if kind in (2, 3) else text.lower()}")


def terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The places of the terms that touch no span."""
    ends, at = sorted((s, e) for s, _, e in spans), 0
    reach = 0
    for m in _TERM.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            reach = max(reach, ends[at][1])
            at += 1
        if reach <= m.start():
            yield m.span()


def _scan(text: str | None) -> tuple:
    text = text or ""
    base = base_spans(text)
    own = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
    entities = list({_entity(k, text[s:e]) for s, k, e in base})
    words = list({term_key(w) for w in {text[a:b].lower() for a, b in terms(text, base)}}) if base else []
    spans = [[s for s, _, _ in base], [k for _, k, _ in base], [e for _, _, e in base]]
    return (*counts, hashlib.sha256(own.encode()).hexdigest(), *spans, entities, words, text if base else None)


def _places(text: str, starts: list[int], kinds: list[int], ends: list[int], told: list[int]) -> tuple:
    wanted, known = set(told), {}
    found = []
    for a, b in terms(text, list(zip(starts, kinds, ends))):
        word = text[a:b].lower()
        if word not in known:
            known[word] = term_key(word) in wanted
        if known[word]:
            found.append((a, b))
    return [a for a, _ in found], [b for _, b in found]


_LONGS = T.ArrayType(T.LongType())
_FIELDS = [(f"n_{k}", T.LongType()) for k in KINDS[:4]] + [("base_sha256", T.StringType())]
_FIELDS += [(n, _LONGS) for n in ("__s", "__k", "__e", "__entities", "__terms")] + [("__held", T.StringType())]


def document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df): in how many rows of `docs` each term stands; terms are counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(map(term_key, held)), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])
            held.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(at, SLICE).to_pylist():
                    held.update(set(_TERM.findall((text or "").lower())))
                    if len(held) > COUNTED:
                        yield out()
        yield out()

    parts = docs.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "term long, df long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def scan(docs: DataFrame, id_col: str, text_col: str, disclosure: float = 0.9, support: int = 2) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; null texts count as empty.

    `spans` has the base kinds and `term`, as kind:start:end by start, then kind; code points, ends exclusive.
    Each row is a document of its own for the counts, repeated rows too. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    found = cut_lineage(map_rows(rows, [id_col], lambda: _scan, _FIELDS).withColumn("__row", F.monotonically_increasing_id()))
    seen = found.select("__row", F.explode("__entities").alias("entity"))
    # Entities of the same rows have the same counts with every term, so one of them stands for all: a text that lists very many
    # addresses, and its copies, have few such classes.
    same = [F.bit_xor(F.xxhash64("__row", F.lit(i))).alias(f"m{i}") for i in range(2)]
    known = seen.groupBy("entity").agg(F.count("*").alias("entity_df"), *same).filter(F.col("entity_df") >= support)
    classes = known.groupBy("entity_df", "m0", "m1").agg(F.min("entity").alias("class"))
    named = cut_lineage(known.join(classes, ["entity_df", "m0", "m1"]).select("entity", "class", "entity_df"))
    entities = named.filter("entity = class").select("entity", "entity_df")
    held = seen.join(named.select("entity", "class"), "entity").groupBy("__row").agg(F.collect_set("class").alias("entities"))
    listed = cut_lineage(found.join(held, "__row").select("__row", "entities", "__terms"))
    stand = listed.select("__row", F.explode("entities").alias("entity"), "__terms").select("__row", "entity", F.explode("__terms").alias("term"))
    pairs = stand.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= support)
    whole = F.log2(F.lit(float(max(found.count(), 1))))
    counted = pairs.join(entities, "entity").join(document_counts(docs, text_col), "term")
    shared = F.log2("both") + whole - F.log2("df") - F.log2("entity_df")
    information = whole - F.log2("entity_df")
    told = counted.filter((information > 0) & (shared >= disclosure * information)).select("entity", "term")
    given = stand.join(told, ["entity", "term"]).groupBy("__row").agg(F.collect_set("term").alias("__told"))
    texts = found.filter("__held is not null").select("__row", "__held", "__s", "__k", "__e").join(given, "__row")
    placed = map_rows(texts, ["__row"], lambda: _places, [("__ts", _LONGS), ("__te", _LONGS)])
    more = F.transform(F.arrays_zip("__ts", "__te"), lambda x: F.struct(x["__ts"].alias("s"), F.lit(4).cast("long").alias("k"), x["__te"].alias("e")))
    terms_of = placed.select("__row", more.alias("__more"))
    base = F.transform(F.arrays_zip("__s", "__k", "__e"), lambda x: F.struct(x["__s"].alias("s"), x["__k"].alias("k"), x["__e"].alias("e")))
    both = F.array_sort(F.when(F.col("__more").isNull(), base).otherwise(F.concat(base, "__more")))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(both, lambda x: F.concat_ws(":", F.element_at(names, (x["k"] + 1).cast("int")), x["s"], x["e"]))
    return found.drop("__held", "__terms", "__entities").join(terms_of, "__row", "left").select(id_col, *[f"n_{k}" for k in KINDS[:4]], "base_sha256", F.concat_ws(",", spans).alias("spans"))


def sanitise(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, remove_terms: bool = False) -> DataFrame:
    """`docs` (ids unique) with base spans as [KIND], and disclosing terms generalised to [WORD] or removed.

    Overlapping spans count as the first of them, widened. Rows without spans stay as they are.
    """

    def start():
        def clean(text, listed):
            if text is None or not listed:
                return (text,)
            parts, at = [], 0
            for s, e, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in listed.split(","))):
                if e > at:
                    put = "" if kind == "term" and remove_terms else "[WORD]" if kind == "term" else f"[{kind.upper()}]"
                    parts += [text[at:s], put] if s >= at else []
                    at = e
            return ("".join([*parts, text[at:]]),)

        return clean

    named = spans.select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans"))
    joined = docs.join(named, F.col(id_col) == F.col("__id"), "left").withColumnRenamed(text_col, "__old").drop("__id")
    keep = [c for c in docs.columns if c != text_col]
    return map_rows(joined, keep, start, [(text_col, T.StringType())]).select(*docs.columns)
