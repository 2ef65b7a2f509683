"""Small fixed tables as DataFrames.

They are built from Arrow, which Spark plans as a local table: no Python worker, nothing to recompute
when an executor is lost, and an exact size for the broadcast decision.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerline import fixed


def table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType] | None = None) -> DataFrame:
    types = types or {}
    return spark.createDataFrame(pa.table({k: pa.array(v, type=types.get(k)) for k, v in columns.items()}))


def field_tags(spark: SparkSession) -> DataFrame:
    """``(tag, field, priority)``: 60 rows."""
    rows = [(t, f, i) for f, tags in fixed.FIELD_TAGS.items() for i, t in enumerate(tags)]
    tag, field, priority = zip(*rows)
    return table(spark, {"tag": list(tag), "field": list(field), "priority": list(priority)},
                 {"priority": pa.int32()})


@lru_cache(maxsize=8)
def ranked_synonyms(key: tuple | None = None) -> tuple[tuple[str, str], ...]:
    """Distinct ``(synonym, field)`` pairs, longest first, then in table order."""
    source = dict(key) if key is not None else fixed.SYNONYMS
    seen: dict[str, str] = {}
    for field, words in source.items():
        for w in words:
            seen.setdefault(w, field)
    return tuple(sorted(seen.items(), key=lambda p: -len(p[0])))


def synonym_prefixes(spark: SparkSession, key: tuple | None = None, shortest: int = 8,
                     share: float = 0.30) -> DataFrame:
    """``(prefix, field)``: each truncation of a synonym that still identifies it, by the best synonym.

    The size follows from the synonym table alone (about 20 rows per synonym).
    """
    best = _prefixes(key, shortest, share)
    return table(spark, {"prefix": list(best), "prefix_field": list(best.values())})


def _prefixes(key: tuple | None, shortest: int = 8, share: float = 0.30) -> dict[str, str]:
    best: dict[str, str] = {}
    for word, field in ranked_synonyms(key):
        for n in range(shortest, len(word) + 1):
            if n / len(word) >= share:
                best.setdefault(word[:n], field)
    return best


def synonym_keys(spark: SparkSession, key: tuple | None = None) -> DataFrame:
    """``(key, key_field)``: ``word`` and a synonym, or ``cut`` and a truncation of one, so that one look-up serves both."""
    rows = {f"word {w}": f for w, f in ranked_synonyms(key)} | {f"cut {p}": f for p, f in _prefixes(key).items()}
    return table(spark, {"key": list(rows), "key_field": list(rows.values())})


def learned_synonyms(spark: SparkSession) -> DataFrame:
    label, canonical, by, date = zip(*fixed.LEARNED_SYNONYMS)
    return table(spark, {"label": list(label), "canonical": list(canonical), "approved_by": list(by),
                         "date": list(date)})


def kpi_meta(spark: SparkSession) -> DataFrame:
    """``(kpi, label, style, tick_format, category, ord, source_field)``: 20 rows."""
    kpi, label, style, tick, category = zip(*fixed.KPI_META)
    return table(spark, {
        "kpi": list(kpi), "kpi_label": list(label), "style": list(style), "tick_format": list(tick),
        "category": list(category), "ord": list(range(len(kpi))),
        "source_field": [fixed.KPI_SOURCE_FIELD.get(k) for k in kpi],
    }, {"ord": pa.int32(), "source_field": pa.string()})


def stored_fx(spark: SparkSession) -> DataFrame:
    currency, year, rate = zip(*fixed.STORED_FX)
    return table(spark, {"currency": list(currency), "year": list(year), "rate": list(rate),
                         "approximated": [c not in fixed.AVERAGED_CURRENCIES for c in currency]},
                 {"year": pa.int32()})
