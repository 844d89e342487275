"""Text columns: folding, slugs, match phrases, markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import col

# Precomposed Vietnamese (and other Latin) letters and what each folds to, by base letter.
_FOLDS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåā",
    "e": "èéẻẽẹêềếểễệëē",
    "i": "ìíỉĩịïîī",
    "o": "òóỏõọôồốổỗộơờớởỡợöō",
    "u": "ùúủũụưừứửữựüûū",
    "y": "ỳýỷỹỵÿ",
    "d": "đ",
    "c": "ç",
    "n": "ñ",
}
FOLD_FROM = "".join(_FOLDS.values())
FOLD_TO = "".join(base * len(marked) for base, marked in _FOLDS.items())
_COMBINING = "".join(map(chr, range(0x300, 0x370)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once: inside a lambda an expression is worked out again for every element."""
    return F.transform(F.array(value), use)[0]


def fold(c) -> Column:
    """Lower case without diacritics; handles precomposed letters and combining marks."""
    lower = F.lower(col(c))
    # A text of one byte a character has none of these; marks stand for nothing in FOLD_TO and so go.
    return F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.translate(lower, FOLD_FROM + _COMBINING, FOLD_TO))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalise(c) -> Column:
    """Words of a text separated by single spaces, for phrase matching."""
    return F.trim(F.regexp_replace(fold(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def street_key(c) -> Column:
    bare = F.regexp_replace(fold(c), r"\b(duong|pho)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", " "), r"\s+", " "))


def cell_key(region, district) -> Column:
    return F.concat(slug(region), F.lit("__"), slug(district))


def category_slug(c, default: Column | None = None) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in fv.CATEGORY_SLUGS.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, col(c)), slug(c) if default is None else default)


def exchange_name(c) -> Column:
    """One spelling per exchange; blank means none."""
    text = F.trim(col(c))
    lookup = F.create_map(*[F.lit(x) for pair in fv.EXCHANGE_NAMES.items() for x in pair])
    return F.when(F.length(text) > 0, F.coalesce(F.try_element_at(lookup, F.lower(text)), F.upper(text)))


def company_phrase(c) -> Column:
    """Name without its legal words; NULL when what is left is too short to identify a company."""
    def usable(bare: Column) -> Column:
        return F.when((F.length(bare) >= 10) & (F.size(F.split(bare, " ")) >= 3) & ~bare.isin(fv.AMBIGUOUS_PHRASES), bare)

    return bound(F.trim(F.regexp_replace(F.regexp_replace(normalise(c), fv.LEGAL_WORDS, " "), r"\s+", " ")), usable)


def contains_phrase(text, phrase) -> Column:
    """Phrase at token boundaries of an already normalised text; phrases under five characters never match."""
    padded = F.concat(F.lit(" "), col(text), F.lit(" "))
    return (F.length(col(phrase)) >= 5) & F.contains(padded, F.concat(F.lit(" "), col(phrase), F.lit(" ")))


def strip_tags(c, joiner: str = " ") -> Column:
    """Text of an HTML fragment: tags out, common entities decoded, spaces collapsed."""
    text = F.regexp_replace(col(c), "<[^>]+>", joiner)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def blank_to_null(c) -> Column:
    x = col(c)
    return F.when(F.length(F.trim(x)) > 0, x)


def before_related_list(c) -> Column:
    """The part of a summary in front of an appended, date-stamped list of other stories."""
    return F.element_at(F.split(col(c), fv.RELATED_LIST_STAMP, 2), 1)


def trim_sentences(c, limit: int | None = None) -> Column:
    """Text without tags and extra blanks: whole, or up to a limit and cut after its last sentence end past half of it."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")), "<[^>]+>", "")
    whole = F.when(F.length(text) == 0, F.lit(None)).otherwise(text)
    if limit is None:
        return whole
    cut = F.substring(text, 1, limit)
    # Position of the last ". ", "! " or "? " in the cut.
    head = F.regexp_extract(cut, r"(?s)^(.*[.!?]) ", 1)
    body = F.when(F.length(head) > limit * 0.5 + 1, head).otherwise(F.rtrim(cut))
    return F.when(F.length(text) <= limit, whole).otherwise(F.concat(body, F.lit(" …")))
