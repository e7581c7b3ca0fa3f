"""Text expressions: normalisation, whole-word phrases with context, labels, excerpts, contact data. All native columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicons import LEGAL_CONTEXT

EMAIL_RE = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_RE = r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(?\d{2,4}\)?[ .-]?){2,5}\d{2,4}(?!\d)"
#: What no word holds, and that but for the space; ``a-z`` stands for itself first, as a class is tried from its left.
_OTHER, _NO_SPACE = r"[^a-z\p{L}\p{N}_]", r"[^a-z \p{L}\p{N}_]"
#: Combining accents.
_MARKS = "".join(map(chr, range(0x300, 0x370)))
#: Characters on each side of a phrase in which a legal wording voids it.
CONTEXT = 70
#: Stands for a phrase in a text cut at it; no normalised text holds it.
_MARK = "\u0001"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters U+00C0 to U+024F that decompose to one base letter, and those letters. Made from Unicode data, not listed."""
    pairs = []
    for cp in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp).casefold()) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalized(text: Column) -> Column:
    """Lower case without accents; runs of anything but letters, digits and ``_`` become one space."""
    source, target = _fold_table()
    # Accents that stand by themselves have no counterpart, so they go.
    folded = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), source + _MARKS, target)
    # Nearly all runs are one space, which stays.
    return F.trim(F.regexp_replace(folded, rf"(?: {_OTHER}|{_NO_SPACE}){_OTHER}*", " "))


def plain(phrase: str) -> str:
    """The same for a constant."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", phrase.casefold()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in folded).split())


def exploded(df: DataFrame, *keep: Column | str, **arrays: Column) -> DataFrame:
    """The columns ``keep`` and a row for each element of an array, under its name.

    A plain explode lets the optimizer put a filter on the array's size below it, and below the projections that made the array, which
    computes all of them twice; the outer form with a filter above doesn't.
    """
    ((name, array),) = arrays.items()
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed here: filters above stay above.

    A filter on computed columns is otherwise put below the projections that make them, with copies of all they are made of, and these are
    then computed again for the rows that pass. It doesn't cross a generator that gives the columns.
    """
    row = F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    return df.select(F.explode_outer(row).alias("_row")).select("_row.*")


def padded(norm: Column) -> Column:
    return F.concat(F.lit(" "), norm, F.lit(" "))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` takes it: plans stay small."""
    return F.transform(F.array(value), use)[0]


def has_phrase(norm: Column, phrase: str) -> Column:
    """Whether normalised text holds the phrase as whole words: plain containment, as words are parted by single spaces."""
    return F.contains(padded(norm), F.lit(f" {plain(phrase)} "))


def _listed(phrases: Sequence[str]) -> Column:
    return F.array(*(F.lit(f" {plain(p)} ") for p in phrases))


def has_any(norm: Column, phrases: Sequence[str]) -> Column:
    return let(padded(norm), lambda pad: F.exists(_listed(phrases), lambda p: F.contains(pad, p)))


def first_label(norm: Column, labels: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first label any of whose phrases occurs."""
    pairs = F.array(*(F.struct(F.lit(f" {plain(p)} ").alias("p"), F.lit(label).alias("l")) for label, phrases in labels for p in phrases))
    return let(padded(norm), lambda pad: F.try_element_at(F.filter(pairs, lambda x: F.contains(pad, x["p"])), F.lit(1))["l"])


def first_phrase(norm: Column, phrases: Sequence[str], context: str | None = None) -> Column:
    """The first phrase of the list with an occurrence that no legal wording stands near; null if none."""
    pairs = F.array(*(F.struct(F.lit(plain(p)).alias("p"), F.lit(p).alias("o")) for p in phrases))
    banned = LEGAL_CONTEXT.get(context, ()) if context else ()

    def free(pad: Column, phrase: Column) -> Column:
        held = F.contains(pad, F.concat(F.lit(" "), phrase, F.lit(" ")))
        return F.when(held, F.exists(_windows(pad, phrase), lambda w: ~F.exists(_listed(banned), lambda b: F.contains(w, b)))).otherwise(False) if banned else held

    return let(padded(norm), lambda pad: F.try_element_at(F.filter(pairs, lambda x: free(pad, x["p"])), F.lit(1))["o"])


def _windows(pad: Column, phrase: Column) -> Column:
    """Each occurrence of the phrase with CONTEXT characters on both sides, padded."""
    wide = lambda c: F.replace(c, F.lit(" "), F.lit("  "))
    narrow = lambda c: F.replace(c, F.lit("  "), F.lit(" "))
    mark = F.concat(F.lit(" "), wide(phrase), F.lit(" "))
    # With doubled spaces, occurrences that follow each other don't share one, so a split finds all of them.
    body = F.concat(F.lit(" "), wide(F.substring(pad, 2, 1 << 30)))
    parts = F.split(F.substring(body, F.lit(1), F.length(body) - 1), mark)

    return let(parts, lambda ps: _with_marks(ps, narrow, phrase))


def _with_marks(parts: Column, narrow, phrase: Column) -> Column:
    # Every part but the last adds a mark of three characters at least, so NEAR parts on a side, and NEAR * 6 characters of each, hold CONTEXT characters.
    near = CONTEXT // 3 + 2
    back = lambda c: F.replace(c, F.lit(_MARK), F.concat(F.lit(" "), phrase, F.lit(" ")))

    def one(k: Column) -> Column:
        first = F.greatest(F.lit(1), k - near + 1)
        before = F.transform(F.slice(parts, first, k - first + 1), lambda p: F.right(p, F.lit(near * 6)))
        after = F.transform(F.slice(parts, k + 1, F.lit(near)), lambda p: F.left(p, F.lit(near * 6)))
        left = F.substring(narrow(F.concat(F.array_join(before, _MARK), F.lit(" "))), F.when(first == 1, 2).otherwise(1), F.lit(1 << 30))
        right = narrow(F.concat(F.lit(" "), F.array_join(after, _MARK)))
        return F.concat(F.lit(" "), F.right(back(left), F.lit(CONTEXT)), phrase, F.left(back(right), F.lit(CONTEXT)), F.lit(" "))

    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), one)


def excerpt_of(text: Column, needle: Column, width: int = 180) -> Column:
    """Text around the needle as it is written, or the text's beginning where it isn't found."""
    at = F.instr(F.lower(text), F.lower(needle)) - 1
    start = F.greatest(F.lit(0), at - width // 3)
    around = F.substring(text, start + 1, at + F.length(needle) + 2 * width // 3 - start)
    return F.trim(F.when(at < 0, F.substring(text, 1, width)).otherwise(around))


def all_of(text: Column, pattern: str, may_hold: Column) -> Column:
    """Whatever of a text the pattern matches; a text that can't hold any, by a cheaper test, isn't searched."""
    return F.when(~may_hold, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def emails(text: Column) -> Column:
    return all_of(text, EMAIL_RE, F.contains(text, F.lit("@")))


def phones(text: Column) -> Column:
    """Phone-like runs of 8 digits or more, without 9 or 14 digit company numbers that are named as such."""

    def ok(value: Column) -> Column:
        digits = F.length(F.regexp_replace(value, r"\D", ""))
        at = F.instr(text, value) - 1
        start = F.greatest(F.lit(0), at - 35)
        near = normalized(F.substring(text, start + 1, at + F.length(value) + 20 - start))
        named = F.contains(near, F.lit("siren")) | F.contains(near, F.lit("siret")) | F.contains(near, F.lit("tva"))
        return (digits >= 8) & ~(digits.isin(9, 14) & named)

    found = F.transform(all_of(text, PHONE_RE, text.rlike(r"\d\d")), lambda p: F.trim(p))
    return F.filter(found, ok)


def title_name(title: Column) -> Column:
    return F.trim(F.split(title, r"\s+[|–—-]\s+", 2)[0])


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\s\u00a0\u202f]+", " "))


def escaped(text: Column) -> Column:
    """HTML escape with quotes."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def evidence(url: Column, kind: str | Column, text: Column, selector: str | None = None) -> Column:
    """Where a value was seen: excerpt at most 300 characters."""
    return F.struct(
        url.alias("url"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        F.substring(text, 1, 300).alias("excerpt"),
        F.lit(selector).cast("string").alias("selector"),
    )
