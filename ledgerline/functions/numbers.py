"""Numbers: safe arithmetic, Latin-format parsing and number texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Space-like characters cut from the ends of a text.
NBSP = chr(0xA0)
SPACES = " \t\n\r" + "".join(
    map(chr, (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is zero or null."""
    return F.try_divide(a, b)


def usable(c: Column) -> Column:
    """Null instead of NaN."""
    return F.when(~F.isnan(c), c)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(text: Column) -> Column:
    """Read a number written with Latin (or mixed) separators; null when it is not a number.

    A lone comma marks decimals. A lone period marks thousands when exactly three characters follow the
    last one. With both, the one that comes first marks thousands, except that a final group of three
    digits after a period is a thousands group too. Parentheses around the text make it negative.
    """
    return F.get(parse_numbers(F.array(text)), F.lit(0))


def parse_numbers(texts: Column) -> Column:
    """:func:`parse_number` of every text of an array, in passes over the array, so that no step is computed twice."""
    def bare(text: Column) -> Column:  # most texts hold no digit and need no closer look
        return F.when(text.rlike("[0-9]"), F.translate(strip(text), " " + NBSP, ""))

    def core(signed: Column) -> Column:  # one parenthesis in front stays as the sign; any inside makes no number
        inner = F.trim(signed, F.lit("()"))
        return (
            F.when(signed.startswith("(") & signed.endswith(")"), F.concat(F.lit("("), inner))
            .when(signed.contains("(") & inner.contains("("), F.lit(None).cast("string")).otherwise(inner)
        )

    def separators(core: Column) -> Column:
        comma, period = F.instr(core, ","), F.instr(core, ".")
        tail = F.substring_index(core, ".", -1)
        no_periods = F.translate(core, ".", "")
        with_commas = (
            F.when(period == 0, F.translate(core, ",", "."))
            .when(period < comma, F.translate(no_periods, ",", "."))
            .when(tail.rlike("^[0-9]{3}$"), F.translate(core, ".,", ""))
            .otherwise(F.translate(core, ",", ""))
        )
        return F.when(comma > 0, with_commas).when((period > 0) & (F.length(tail) == 3), no_periods).otherwise(core)

    def size(plain: Column) -> Column:
        return F.when(plain.rlike(NUMBER_SHAPE), plain.try_cast("double"))

    def value(plain: Column) -> Column:
        return F.when(plain.startswith("("), -size(F.substring(plain, 2, 2**31 - 1))).otherwise(size(plain))

    for step in (bare, core, separators, value):
        texts = F.transform(texts, step)
    return texts


def strip_footnote(cell: Column) -> Column:
    """Cut trailing marks such as ``#`` or ``*`` from a printed amount."""
    return F.regexp_replace(strip(cell), r"[^0-9.,)(\-]+$", "")


def rounded(c: Column, digits: int) -> Column:
    """Rounded to ``digits`` decimals on the exact value, halves to even; infinities and NaN stay."""
    odd = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(odd, c).otherwise(fixed_point(c, digits).cast("double"))


def billions(c: Column, digits: int = 3) -> Column:
    return rounded(c / F.lit(1e9), digits)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def fixed_point(v: Column, digits: int, grouped: bool = False) -> Column:
    """A number with a fixed count of decimals, halves to even on the exact value.

    ``format_number`` rounds that way; ``format_string`` would round the shortest decimal text half up.
    """
    text = F.format_number(v, digits)
    return text if grouped else F.translate(text, ",", "")


def magnitude_text(v: Column) -> Column:
    """``2.5B`` / ``3.0M`` / ``4.2K``; smaller values as they are."""
    return (
        F.when(v >= 1e9, F.concat(fixed_point(v / 1e9, 1), F.lit("B")))
        .when(v >= 1e6, F.concat(fixed_point(v / 1e6, 1), F.lit("M")))
        .when(v >= 1e3, F.concat(fixed_point(v / 1e3, 1), F.lit("K")))
        .otherwise(v.cast("string"))
    )


def kpi_text(v: Column, style: Column) -> Column:
    """A ratio as shown on a card, by display style."""
    return (
        F.when(v.isNull(), "N/A")
        .when(style == "percentage", F.concat(fixed_point(v * 100, 1), F.lit("%")))
        .when(style == "ratio_x", F.concat(fixed_point(v, 2), F.lit("x")))
        .when(style == "dollar_B", F.concat(F.lit("$"), fixed_point(v / 1e9, 1), F.lit("B")))
        .when(style == "days", F.concat(fixed_point(v, 0), F.lit("d")))
        .otherwise(F.round(v, 4).cast("string"))
    )


def delta_text(v: Column) -> Column:
    text = fixed_point(v * 100, 1)
    return F.concat(F.when(text.startswith("-"), "").otherwise("+"), text, F.lit("%"))


def money_text(v: Column, currency: Column) -> Column:
    """An amount in its own currency, scaled by size."""
    suffix = F.when(currency.isin("USD", "EUR"), "B").otherwise("miles de mill.")
    size = F.abs(v)
    return (
        F.when(v.isNull(), "N/A")
        .when(size >= 1e9, F.concat_ws(" ", currency, fixed_point(v / 1e9, 2), suffix))
        .when(size >= 1e6, F.concat(currency, F.lit(" "), fixed_point(v / 1e6, 1), F.lit("M")))
        .otherwise(F.concat_ws(" ", currency, fixed_point(v, 0, grouped=True)))
    )


def local_kpi_text(v: Column, style: Column, currency: Column) -> Column:
    """As :func:`kpi_text`, money in the company's own currency."""
    suffix = F.when(currency.isin("USD", "EUR"), "B").otherwise("miles de mill.")
    return (
        F.when(v.isNull(), "N/A")
        .when(style.isin("percentage", "ratio_x", "days"), kpi_text(v, style))
        .when(style == "dollar_B", F.concat_ws(" ", currency, fixed_point(v / 1e9, 1), suffix))
        .otherwise(money_text(v, currency))
    )
