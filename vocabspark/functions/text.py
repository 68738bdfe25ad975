"""Noun and caption text functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered rules that choose the indefinite article.
ARTICLE_RULES = (
    (r"(?U)^[AEFHILMNORSX][B-Z][A-Z]?\b", "an "),
    (r"(?iu)^([aefhilmnorsx][.-]|hour)", "an "),
    (r"(?iuU)^([a-z][.-]|e[uw]|onc?e\b|uni|u[bcfghjkqrst][aeiou])", "a "),
    (r"(?iu)^[aeiou]", "an "),
)
DEFAULT_ARTICLE = "a "

# Latin letters and punctuation whose transliteration has several characters.
LONG_TRANSLITERATIONS = (
    ("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Þ", "Th"), ("þ", "th"), ("…", "..."),
)
# Single characters without a canonical decomposition.
SHORT_TRANSLITERATIONS = {
    "Ø": "O", "ø": "o", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "ı": "i",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ",
}

# Tail punctuation that captions lose, and that ends a template field.
CAPTION_TAIL = ",.?!:"
CAPTION_MIN_CHARS = 10
CAPTION_LINE = r"^\s*\d+\s*\."

# Greek and Cyrillic letters and their Latin forms, in alphabetical order; lower case first, the capitals by rule.
GREEK = (
    ("α", "a"), ("β", "b"), ("γ", "g"), ("δ", "d"), ("ε", "e"), ("ζ", "z"), ("η", "e"), ("θ", "th"), ("ι", "i"), ("κ", "k"), ("λ", "l"), ("μ", "m"), ("ν", "n"),
    ("ξ", "x"), ("ο", "o"), ("π", "p"), ("ρ", "r"), ("σ", "s"), ("ς", "s"), ("τ", "t"), ("υ", "u"), ("φ", "ph"), ("χ", "kh"), ("ψ", "ps"), ("ω", "o"),
)
CYRILLIC = (
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ж", "zh"), ("з", "z"), ("и", "i"), ("й", "i"), ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"),
    ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"), ("ф", "f"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ъ", "'"),
    ("ы", "y"), ("ь", "'"), ("э", "e"), ("ю", "iu"), ("я", "ia"), ("ё", "io"), ("є", "ie"), ("і", "i"), ("ї", "i"), ("ґ", "g"),
)

NON_CANON = r"[^ 0-9a-z]"
SPACES = r"(?U)\s+"
CANON_BREAKS = r"(?U)[\s/-]+"
CANON_DROPPED = "'."


def indefinite_article(noun: Column) -> Column:
    """Article with its trailing space; the first rule that matches decides."""
    article = F.lit(DEFAULT_ARTICLE)
    for pattern, value in reversed(ARTICLE_RULES):
        article = F.when(noun.rlike(pattern), F.lit(value)).otherwise(article)
    return article


def indefinite(noun: Column, suffix: Column | None = None) -> Column:
    """Noun with its article; the suffix never takes part in choosing the article."""
    parts = [indefinite_article(noun), noun]
    if suffix is not None:
        parts.append(F.coalesce(suffix, F.lit("")))
    return F.concat(*parts)


def squeeze(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _letters() -> dict[str, str]:
    """Greek and Cyrillic letters of both cases by their Latin forms."""
    out = {}
    for lower, latin in (*GREEK, *CYRILLIC):
        out[lower] = latin
        out[lower.upper()] = latin.capitalize()
    return out


def _latin_table() -> tuple[str, str]:
    """Characters and the single ASCII ones they become: accented and full-width forms, and spaces, by their
    decompositions, Greek and Cyrillic letters of one Latin letter, also accented ones, by the tables."""
    letters = {c: latin for c, latin in _letters().items() if len(latin) == 1}
    source, target = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x200B), *range(0xFF01, 0xFF5F), 0x3000):
        char = chr(code)
        if code < 0xFF00 and not (char.isalpha() or char.isspace()):
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        base = letters.get(char, letters.get(base, base))
        if char not in SHORT_TRANSLITERATIONS and len(base) == 1 and base.isascii():
            source.append(char)
            target.append(base)
    for char, base in SHORT_TRANSLITERATIONS.items():
        source.append(char)
        target.append(base)
    return "".join(source), "".join(target)


LATIN_FROM, LATIN_TO = _latin_table()
#: Characters that become several ASCII ones, each with its replacement.
LONG_FORMS = (*LONG_TRANSLITERATIONS, *((c, latin) for c, latin in _letters().items() if len(latin) > 1))
COMBINING_MARKS = r"[̀-ͯ]"


#: Text with letters that only the longer list has; most texts have none and skip it.
LONG_SCRIPTS = "[" + "".join(c for c, _ in LONG_FORMS[len(LONG_TRANSLITERATIONS):]) + "]"


def _replaced(text: Column) -> Column:
    for source, target in LONG_FORMS[len(LONG_TRANSLITERATIONS):]:
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


def transliterate(text: Column) -> Column:
    """ASCII form of Latin, Greek and Cyrillic text; other scripts pass through (and are flagged by `has_bad_canon`)."""
    for source, target in LONG_TRANSLITERATIONS:
        text = F.replace(text, F.lit(source), F.lit(target))
    text = F.when(text.rlike(LONG_SCRIPTS), _replaced(text)).otherwise(text)
    return F.regexp_replace(F.translate(text, LATIN_FROM, LATIN_TO), COMBINING_MARKS, "")


def canon(noun: Column, sanitize: bool = True) -> Column:
    """Canonical noun: lower case, no apostrophes or dots, words joined by single spaces."""
    text = transliterate(squeeze(noun)) if sanitize else noun
    text = F.translate(F.lower(text), CANON_DROPPED, "")
    return F.trim(F.regexp_replace(text, CANON_BREAKS, " "))


def has_bad_canon(canonical: Column) -> Column:
    return canonical.rlike(NON_CANON)


def clean_class_name(name: Column) -> Column:
    """Class name without brackets (any depth), alternatives after '/' and ' or ' choices."""
    opened = F.length(F.regexp_replace(name, r"[^(]", ""))
    flat = F.aggregate(
        F.sequence(F.lit(0), opened), name, lambda acc, _: F.regexp_replace(acc, r"\([^()]*\)", "")
    )
    flat = F.split_part(flat, F.lit("/"), F.lit(1))
    # Fixed value: one class that the choice rule would cut wrongly.
    flat = F.when(flat == "bell or wind chime", F.lit("chime")).otherwise(flat)
    parts = F.split(flat, " or ")
    first, second = squeeze(F.get(parts, F.lit(0))), squeeze(F.get(parts, F.lit(1)))
    rest = F.regexp_replace(second, r"^\S+ ?", "")
    merged = F.when(
        (F.size(parts) >= 2) & (F.length(first) > 0) & ~first.contains(" ") & (F.length(rest) > 0),
        F.concat_ws(" ", first, rest),
    ).when(F.size(parts) >= 2, first)
    return squeeze(F.coalesce(merged, flat))


def fill_template(template: Column, noun: Column, field: str = "{noun}") -> Column:
    return F.replace(template, F.lit(field), noun)


def caption_lines(content: Column) -> Column:
    """Captions of an enumerated answer, in line order; short and unnumbered lines are left out."""
    lines = F.filter(F.split(F.trim(content), "\n"), lambda line: line.rlike(CAPTION_LINE))
    captions = F.transform(
        lines, lambda line: transliterate(F.regexp_replace(F.regexp_replace(line, r"^[^.]*\.\s*", ""), r"\s+$", ""))
    )
    return F.filter(captions, lambda caption: F.length(caption) >= CAPTION_MIN_CHARS)


def caption_field_pattern(noun: Column) -> Column:
    """Fixed pattern of a whole-word noun in a caption, with its possessive or punctuation."""
    return F.concat(F.lit(r"(?iu)(^|\s)(\Q"), noun, F.lit(r"\E)(\.(?!$))?('s?|[,.?!:])?(\s|$)"))


def caption_template(caption: Column, noun: Column, field: str) -> Column:
    """Caption with `noun` replaced by {field}; null where the noun is not in it."""
    # A caption without the noun's letters needs no pattern; of the others only those that the pattern has changed have the noun, or else
    # those in which it stands as the field already.
    near = F.contains(F.lower(caption), F.lower(noun))
    mark = F.lit("\u0001{" + field + "}")
    replaced = F.when(near, F.regexp_replace(caption, caption_field_pattern(noun), F.lit("$1\u0001{" + field + "}$4$5")))
    found = F.contains(replaced, mark)
    return F.when(found, F.rtrim(F.replace(replaced, mark, F.lit("{" + field + "}")), F.lit(CAPTION_TAIL)))


def field_names(template: Column) -> Column:
    """Names of all {fields} of a template, in order."""
    return F.regexp_extract_all(template, F.lit(r"\{([^{}]*)\}"), 1)


def semifix(value: Column, precision: int = 3) -> Column:
    """Fixed decimals without trailing zeros (1.500 -> 1.5, 2.000 -> 2)."""
    text = F.format_string(f"%.{precision}f", value.cast("double"))
    return F.regexp_replace(text, r"\.?0+$", "")
