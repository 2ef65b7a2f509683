"""Readers. Each returns an empty table of the right schema where a path holds nothing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerline import fixed, schema
from ledgerline.functions.text import is_pdf

_ENTRY = "struct<form:string,fp:string,fy:int,start:string,`end`:string,filed:string,val:double>"
FACT_ROWS = "ticker string, tag string, unit string, pos int, form string, fp string, fy int, start date, `end` date, filed date, val double"
FACTS_JSON = f"entityName string, facts map<string, map<string, struct<units: map<string, array<{_ENTRY}>>>>>"


def _read(spark: SparkSession, load, empty_schema: T.StructType | str) -> DataFrame:
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return schema.empty(spark, empty_schema)
        raise


def parse_facts(raw: DataFrame) -> DataFrame:
    """Rows of facts (``schema.FACTS``) from ``ticker`` and ``json``, the text of a company's facts.

    Tags and units are data, so they are read as map keys and never become columns.
    """
    return _fact_rows(raw.select(F.upper("ticker").alias("ticker"), F.from_json("json", FACTS_JSON)["facts"].alias("facts")))


def _fact_rows(raw: DataFrame) -> DataFrame:
    tags = raw.select("ticker", F.explode(F.col("facts")["us-gaap"]).alias("tag", "t"))
    units = tags.select("ticker", "tag", F.explode("t.units").alias("unit", "entries"))
    rows = units.select("ticker", "tag", "unit", F.posexplode("entries").alias("pos", "e"))

    def day(c: str):
        return F.to_date(F.try_to_timestamp(F.col(f"e.{c}"), F.lit("yyyy-MM-dd")))

    return rows.select(
        "ticker", "tag", "unit", "pos", "e.form", "e.fp", "e.fy",
        day("start").alias("start"), day("end").alias("end"), day("filed").alias("filed"), "e.val")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of all companies from ``<path>/<TICKER>/facts.json`` (any printing of the JSON).

    A file is one record: the number of files, not of entries in one, sets the parallelism.
    """
    try:
        raw = spark.read.schema(FACTS_JSON).option("multiLine", True).json(f"{path.rstrip('/')}/*/facts.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FACT_ROWS)
    ticker = F.upper(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return _fact_rows(raw.select(ticker.alias("ticker"), "facts"))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Tickers that have a facts file, whether or not it can be used."""
    files = _read(spark, lambda: spark.read.format("binaryFile").load(f"{path.rstrip('/')}/*/facts.json").select("path"), T.StructType().add("path", "string"))
    return files.select(F.upper(F.element_at(F.split("path", "/"), -2)).alias("ticker"))


def parse_ticker_ids(text: DataFrame) -> DataFrame:
    """``(ticker, cik)`` from texts (``value``) of ``{"0": {"cik_str": .., "ticker": ..}, ..}``."""
    entry = "struct<cik_str:bigint,ticker:string,title:string>"
    rows = text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("k", "v"))
    return rows.select(F.upper("v.ticker").alias("ticker"), F.lpad(F.col("v.cik_str").cast("string"), 10, "0").alias("cik"))


def _whole_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file of a path as one ``value``; none where there is no file."""
    return _read(spark, lambda: spark.read.text(path, wholetext=True), T.StructType().add("value", "string"))


def read_ticker_ids(spark: SparkSession, path: str) -> DataFrame:
    return parse_ticker_ids(_whole_text(spark, path))


def read_table(spark: SparkSession, path: str, expected: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Parquet conformed to the expected schema; older files may lack columns."""
    def load():
        return schema.conform(spark.read.option("mergeSchema", True).parquet(path), expected)

    out = _read(spark, load, expected)
    return out.select(*columns) if columns else out


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Label candidates from JSON lines; broken lines are left out."""
    def load():
        return spark.read.schema(schema.CANDIDATES).option("mode", "DROPMALFORMED").json(path)

    return _read(spark, load, schema.CANDIDATES).withColumns({
        "seen_count": F.coalesce("seen_count", F.lit(1)),
        "companies_seen": F.coalesce("companies_seen", F.array("company"))})


def read_json_table(spark: SparkSession, path: str, expected: T.StructType) -> DataFrame:
    """A small JSON table (array of records or JSON lines); broken records are left out."""
    def load():
        return spark.read.schema(expected).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)

    return _read(spark, load, expected)


def read_learned(spark: SparkSession, path: str) -> DataFrame:
    return read_json_table(spark, path, schema.LEARNED).filter(
        (F.trim("label") != "") & (F.trim("canonical") != ""))


def parse_fx(text: DataFrame) -> DataFrame:
    """Rates (``schema.FX_RATES``) from texts (``value``) of ``{"CUR_YEAR": rate}``."""
    rows = text.select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "value"))
    currency = F.substring_index("key", "_", 1)
    return rows.select(
        currency.alias("currency"), F.substring_index("key", "_", -1).try_cast("int").alias("year"),
        F.col("value").alias("rate"), (~currency.isin(fixed.AVERAGED_CURRENCIES)).alias("approximated"))


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    return parse_fx(_whole_text(spark, path))


def parse_profiles(text: DataFrame) -> DataFrame:
    """Site profiles (``schema.PROFILES``) from texts (``value``) of a JSON map by company; entries that describe the file are left out."""
    fields = (
        "struct<domain:string,last_success:string,strategy:string,pdf_url_pattern:string,nav_path:array<string>,"
        "doc_tier:int,failed_ddgs_queries:array<string>,historical_pdfs:map<string,string>,"
        "t2_pdfs:map<string,string>,notes:string>")
    raw = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "json"))
    rows = raw.filter(~F.col("key").startswith("_")).select("key", F.from_json("json", fields).alias("value"))

    def by_year(c: str):
        dated = F.map_filter(F.col(f"value.{c}"), lambda k, v: k.try_cast("int").isNotNull())
        return F.transform_keys(dated, lambda k, v: k.try_cast("int"))

    out = {f.name: F.col(f"value.{f.name}") for f in schema.PROFILES.fields if f.name != "slug"}
    out["historical_pdfs"], out["t2_pdfs"] = by_year("historical_pdfs"), by_year("t2_pdfs")
    return rows.select(F.col("key").alias("slug"), *[c.alias(n) for n, c in out.items()])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return parse_profiles(_whole_text(spark, path))


def read_company_meta(spark: SparkSession, path: str) -> DataFrame:
    """Company records, one JSON object per file or line, below ``path``."""
    return read_json_table(spark, path, schema.COMPANY_META)


FIRST_BYTES = 4


def _starts(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first bytes of each file, by one ranged read each from whatever store its address names."""
    for frame in paths:
        out = []
        for path in frame["path"]:
            store, inner = (fs.LocalFileSystem(), path.split(":", 1)[-1]) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(quote(path, safe=":/"))
            with store.open_input_file(re.sub("^//+", "/", inner)) as file:
                out.append(file.read_at(min(FIRST_BYTES, file.size()), 0))
        yield frame.assign(start=out)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files with their size and whether they really are PDFs.

    Path and size come from the file listing, which reads no content; of each file only its first four bytes are read, and
    tasks share out the files. Spark's listing leaves out empty files.
    """
    listed = _read(spark, lambda: spark.read.format("binaryFile").load(path).select("path", "length"), "path string, length bigint")
    starts = listed.mapInPandas(_starts, "path string, length bigint, start binary")
    return starts.select("path", "length", is_pdf(F.col("start")).alias("is_pdf"))


def _plain(text: str):
    """A scalar or a ``{name: value, ...}`` of the rule file."""
    text = text.strip()
    if text.startswith("{") and text.endswith("}"):
        pairs = [p.split(":", 1) for p in text[1:-1].split(",") if p.strip()]
        return {k.strip().strip("\"'"): _plain(v) for k, v in pairs}
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _uncommented(line: str) -> str:
    return re.match(r"""(?:[^"'#]|"[^"]*"|'[^']*'|(?<=\S)#)*""", line)[0].rstrip()


def parse_rules(text: str) -> dict:
    """The part of YAML that rule files use: maps by indentation, lists of maps, maps in braces, quoted texts and comments."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(_uncommented, text.splitlines()) if x.strip()]

    def block(at: int, depth: int) -> tuple[object, int]:
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] == depth:
            line = lines[at][1]
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                # An entry is a block of its own that begins behind its dash.
                inner = depth + len(line) - len(line[1:].lstrip()) if line != "-" else depth + 2
                lines[at] = (inner, line[1:].lstrip())
                if lines[at][1]:
                    value, at = block(at, inner) if re.match(r"[^\s{\"'][^:]*:(\s|$)", lines[at][1]) else (_plain(lines[at][1]), at + 1)
                else:
                    value, at = block(at + 1, lines[at + 1][0]) if at + 1 < len(lines) and lines[at + 1][0] > depth else (None, at + 1)
                out.append(value)
                continue
            out = {} if out is None else out
            name, _, rest = line.partition(":")
            name, at = name.strip().strip("\"'"), at + 1
            if rest.strip():
                out[name] = _plain(rest)
            elif at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("-"))):
                out[name], at = block(at, lines[at][0])
            else:
                out[name] = None
        if at < len(lines) and lines[at][0] > depth:
            raise ValueError(f"unexpected indentation: {lines[at][1]!r}")
        return out, at

    if not lines:
        return {}
    found, end = block(0, lines[0][0])
    if end < len(lines) or not isinstance(found, dict):
        raise ValueError(f"not a rule file, from: {lines[min(end, len(lines) - 1)][1]!r}")
    return found


def read_rules(path: str, spark: SparkSession | None = None) -> dict:
    """Threshold rules from JSON or YAML, from any store Spark reads; an absent file means no rules.

    Rules are configuration of a few lines: they become column expressions.
    """
    spark = spark or SparkSession.active()
    found = _whole_text(spark, path).first()
    if found is None:
        return {}
    text = found["value"]
    raw = json.loads(text) if text.lstrip().startswith("{") else parse_rules(text)
    sectors = {}
    for name, body in (raw.get("sectors") or {}).items():
        specs = (body.get("flags") if isinstance(body, dict) else body) or []
        sectors[name] = [
            {**{k: r[k] for k in ("id", "name", "kpi", "description")}, **(r.get("thresholds") or {}),
             **{s: r[s] for s in fixed.SEVERITIES if s in r}} for r in specs]
    return {"default_sector": raw.get("default_sector", "healthcare"), "sectors": sectors}
