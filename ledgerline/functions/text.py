"""Texts: accent folding, slugs, noise labels, section headings."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ledgerline import fixed
from ledgerline.functions.numbers import once, strip

LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def regex_quote(text: str) -> str:
    return re.sub(r"([.\\+*?\[^\]$(){}=!<>|:#/&~-])", r"\\\1", text)


def contains_any(c: Column, words) -> Column:
    """The text holds one of the words. Plain searches are far cheaper than one pattern of alternatives."""
    return once(c, lambda t: _holds_any(t, words))


def _holds_any(t: Column, words) -> Column:
    return reduce(or_, [t.contains(w) for w in words])


def starts_with_any(c: Column, words) -> Column:
    return once(c, lambda t: reduce(or_, [t.startswith(w) for w in words]))


def fold(c: Column) -> Column:
    """Lower case, no outer space, no accents."""
    return F.translate(strip(F.lower(c)), fixed.FOLD_FROM, fixed.FOLD_TO)


def _latin_letters() -> tuple[str, str]:
    """Accented Latin letters and the plain letter each decomposes to."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _PLAIN = _latin_letters()


def slug(name: Column) -> Column:
    """ASCII key of a company name: plain letters and digits joined by ``-``."""
    plain = F.translate(name, _ACCENTED, _PLAIN)
    for letter, ascii_form in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("ø", "o"), ("Ø", "O"),
                               ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"), ("œ", "oe"), ("Œ", "OE")):
        plain = F.replace(plain, F.lit(letter), F.lit(ascii_form))
    joined = F.regexp_replace(F.lower(plain), r"(?<=\d),(?=\d)", "")
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", "-"), F.lit("-"))


def is_noise_label(label: Column) -> Column:
    """Too short, a bare year, or a bare "total"."""
    s = strip(label)
    return (F.length(s) < 4) | s.rlike(r"^\d{4}$") | F.lower(s).isin(fixed.NOISE_WORDS)


def is_non_current(label: Column) -> Column:
    return F.lower(label).contains("no corriente")


def section_of(text: Column) -> Column:
    """Statement section whose heading the text holds; null when it holds none."""
    def find(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, headings in reversed(list(fixed.SECTION_HEADINGS.items())):
            out = F.when(_holds_any(low, headings), name).otherwise(out)
        return out

    return once(F.lower(text), find)


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def is_contents_page(text: Column) -> Column:
    """A table of contents: more than 12 % of its characters are dots."""
    n = F.length(text)
    dots = n - F.length(F.translate(text, ".", ""))
    return (n > 0) & (dots / F.greatest(n, F.lit(1)) > 0.12)


def opens_with(text: Column, words, first_lines: int = 8) -> Column:
    """One of the first lines, without leading numbering, starts with one of the words."""
    heads = F.slice(F.split(F.lower(text), "\n"), 1, first_lines)
    return F.exists(heads, lambda line: starts_with_any(F.ltrim(strip(line), F.lit("0123456789. ")), words))


def mentions(text: Column, words) -> Column:
    return contains_any(F.lower(text), words)


def is_scanned_page(text: Column, n_images: Column) -> Column:
    return (F.length(strip(text)) < 50) & (n_images > 0)


def is_pdf(content: Column) -> Column:
    """The bytes start with the PDF mark."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")
