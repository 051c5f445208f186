"""Value transformations: a column expression and, for use inside Python operators, its plain function.

``unknown`` is NULL throughout: a NULL input gives a NULL output unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transform:
    """``column`` maps a Column, ``plain`` a Python value; ``fails`` gives a message where the input is refused, else NULL."""

    column: Callable[[Column], Column]
    plain: Callable[[object], object] | None = None
    fails: Callable[[Column], Column] | None = None

    def __call__(self, c: Column) -> Column:
        return self.column(c)

    def value(self, x: object) -> object:
        if self.plain is None:
            raise TypeError("this transformation has no Python form; pass one as `plain`")
        return None if x is None else self.plain(x)

    def and_then(self, after: Transform) -> Transform:
        plain = (lambda x: after.value(self.value(x))) if self.plain and after.plain else None
        own = [f for f in (self.fails, (lambda c: after.fails(self.column(c))) if after.fails else None) if f]
        return Transform(lambda c: after.column(self.column(c)), plain, (lambda c: F.coalesce(*[f(c) for f in own])) if own else None)


def transform(column: Callable[[Column], Column], plain: Callable | None = None) -> Transform:
    """Lift any expression builder (a Python or pandas UDF is one too)."""
    return Transform(column, plain)


codec = transform


def field(name: str) -> Transform:
    """A field of a struct column, or of a dictionary or row; an unknown name fails when the plan is built."""
    return Transform(lambda c: c.getField(name), lambda x: x[name])


def with_field(record: Column, name: str, value: Column) -> Column:
    """The record with a field set."""
    return record.withField(name, value)


def words() -> Transform:
    """Split at runs of white space; leading and trailing empty words stay."""
    return Transform(lambda c: F.split(c, r"\s+"), lambda s: re.split(r"[ \t\n\x0b\f\r]+", s))


def ngram(n: int) -> Transform:
    """Character n-grams in order; shorter values have none."""
    if n < 1:
        raise ValueError("n must be positive")

    def column(c: Column) -> Column:
        places = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.when(c.isNotNull(), F.transform(places, lambda i: F.substring(c, i, F.lit(n))))

    return Transform(column, lambda s: [s[i : i + n] for i in range(len(s) - n + 1)])


def bigram() -> Transform:
    return ngram(2)


def trigram() -> Transform:
    return ngram(3)


def lower() -> Transform:
    return Transform(F.lower, lambda s: s.lower())


def normalize_name() -> Transform:
    """Lower case, decompose accents, drop bracketed terms and all but ASCII letters and digits."""

    def plain(s: str) -> str:
        return re.sub(r"[^0-9A-Za-z]", "", re.sub(r"\(.*?\)", "", unicodedata.normalize("NFD", s.lower())))

    # The accented Latin letters that decompose into a plain letter, by rule; others are dropped like any mark.
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii()]
    accented, bare = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)

    def column(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), accented, bare), r"\(.*?\)", ""), r"[^0-9A-Za-z]", "")

    return Transform(column, plain)


def concat_names(*names: str) -> Transform:
    """Non-null fields joined by a blank; the record itself is never NULL."""
    return Transform(lambda c: F.concat_ws(" ", *[c.getField(n) for n in names]), lambda r: " ".join(r[n] for n in names if r[n] is not None))


def fields(*names: str) -> Transform:
    """An array of fields."""
    return Transform(lambda c: F.array(*[c.getField(n) for n in names]), lambda r: [r[n] for n in names])


def iso_date() -> Transform:
    return Transform(lambda c: F.date_format(c, "yyyy-MM-dd"), lambda d: d.isoformat()[:10])


# Fixed values of the published codes: letter classes A to Z.
SOUNDEX_CLASSES = "01230120022455012623010202"
REFINED_CLASSES = "01360240043788015936020505"


def _ascii_only(c: Column) -> Column:
    return F.when(F.upper(c).rlike(r"[\p{L}&&[^A-Z]]"), F.concat(F.lit("character is not mapped: "), c))


def _refuses(s: str) -> None:
    if any(ch.isalpha() and not ch.upper().isascii() for ch in s):
        raise ValueError(f"character is not mapped: {s}")


def soundex() -> Transform:
    """The four-character code; letters beyond A-Z are refused (NULL, with a message in ``fails``)."""

    def plain(s: str) -> str:
        _refuses(s)
        letters = [ch for ch in s.upper() if ch.isalpha()]
        if not letters:
            return ""
        code, last = letters[0], SOUNDEX_CLASSES[ord(letters[0]) - 65]
        for ch in letters[1:]:
            k = SOUNDEX_CLASSES[ord(ch) - 65]
            if k != "0" and k != last:
                code += k
            if ch not in "HW":
                last = k
        return (code + "000")[:4]

    def column(c: Column) -> Column:
        letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
        return F.when(_ascii_only(c).isNull(), F.when(letters == "", "").otherwise(F.soundex(letters)))

    return Transform(column, plain, _ascii_only)


def refined_soundex(classes: str = REFINED_CLASSES) -> Transform:
    """First letter, then the class of every letter with runs of one class written once."""
    if len(classes) != 26:
        raise ValueError("26 letter classes are needed")

    def plain(s: str) -> str:
        _refuses(s)
        letters = [ch for ch in s.upper() if ch.isalpha()]
        if not letters:
            return ""
        out, last = letters[0], ""
        for ch in letters:
            k = classes[ord(ch) - 65]
            if k != last:
                out += k
            last = k
        return out

    def column(c: Column) -> Column:
        letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
        coded = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", classes)
        return F.when(_ascii_only(c).isNull(), F.concat(F.substring(letters, 1, 1), F.regexp_replace(coded, r"(.)\1+", "$1")))

    return Transform(column, plain, _ascii_only)
