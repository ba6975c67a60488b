"""Readers by payload shape: flat and nested JSON, search dumps, feeds, HTML, script state."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import POSTING, conform, valid_rows


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, columns: dict[str, Column], rows: str | None = None) -> DataFrame:
    """JSON files; rows names an array to explode (nested lists), columns maps the
    record's fields. Malformed records come as nulls and leave by valid_rows."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    if rows:
        df = df.select(F.explode(rows).alias("item")).select("item.*")
    return conform(df.select(*[c.alias(k) for k, c in columns.items()]))


def read_search_dump(spark: SparkSession, path: str, source_schema: str, columns: dict[str, Column]) -> DataFrame:
    """hits.hits[]._source records, one for each _id."""
    df = spark.read.schema(f"hits struct<hits:array<struct<_id:string,_source:{source_schema}>>>").option("multiLine", True).json(path)
    hits = df.select(F.explode("hits.hits").alias("h")).select("h._id", "h._source.*").dropDuplicates(["_id"])
    return conform(hits.select(*[c.alias(k) for k, c in columns.items()]))


def read_feed(spark: SparkSession, path: str, columns: dict[str, Column], item: str = "item", schema: str = "title string, link string, description string, pubDate string, guid string, category array<string>") -> DataFrame:
    """RSS or XML items."""
    df = spark.read.format("xml").option("rowTag", item).schema(schema).load(path)
    return conform(df.select(*[c.alias(k) for k, c in columns.items()]))


class _Cards(HTMLParser):
    """Cards: elements with a class; in each, the first link, and the texts by class,
    those under no class of their own by the card's."""

    def __init__(self, card: str):
        super().__init__(convert_charrefs=True)
        self.card, self.found, self.depth = card, [], 0
        self.stack: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        own = dict(attrs)
        classes = (own.get("class") or "").split()
        if not self.depth and self.card in classes:
            self.depth = 1
            self.found.append({"url": None, "title": "", "fields": {}})
            self.stack = [self.card]
            return
        if self.depth:
            self.depth += 1
            name = classes[0] if classes else ""
            if tag == "a" and self.found[-1]["url"] is None and own.get("href"):
                self.found[-1]["url"] = own["href"]
                name = "@title"
            self.stack.append(name or self.stack[-1])

    def handle_endtag(self, tag):
        if self.depth:
            self.depth -= 1
            self.stack.pop()

    def handle_data(self, data):
        if not self.depth or not data.strip():
            return
        text, card = " ".join(data.split()), self.found[-1]
        if self.stack[-1] == "@title":
            card["title"] = f"{card['title']} {text}".strip()
        elif self.stack[-1]:
            card["fields"][self.stack[-1]] = f"{card['fields'].get(self.stack[-1], '')} {text}".strip()


def parse_cards(html: str | None, card: str) -> list[dict]:
    parser = _Cards(card)
    parser.feed(html or "")
    parser.close()
    return parser.found


def html_cards(pages: DataFrame, card: str, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, pos, url, title, fields) for every card of every page."""
    kind = pa.list_(pa.struct([("url", pa.string()), ("title", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]))

    @F.arrow_udf("array<struct<url:string,title:string,fields:map<string,string>>>")
    def cards(texts: pa.Array) -> pa.Array:
        found = ([c | {"fields": list(c["fields"].items())} for c in parse_cards(t, card)] for t in texts.to_pylist())
        return pa.array(found, kind)

    return pages.select(page_id, F.posexplode(cards(F.col(html)))).select(page_id, "pos", "col.*")


def literals(html: str | None, anchor: str) -> Iterator[tuple[str, str]]:
    """(anchor's text, JSON text) for every match of anchor with a JSON value right
    after it, up to 40 characters before an object or list. What does not parse is
    passed over."""
    decoder = json.JSONDecoder()
    for m in re.finditer(anchor, html or ""):
        gap = re.compile(r"\s*").match(html, m.end()).end()
        opening = re.compile(r"[\[{]").search(html, m.end(), m.end() + 41)
        for start in dict.fromkeys([gap, *([opening.start()] if opening else [])]):
            try:
                _, end = decoder.raw_decode(html, start)
            except (ValueError, RecursionError):
                continue
            yield m[0], html[start:end]
            break


@F.udtf(returnType="pos int, anchor string, literal string")
class ScriptLiterals:
    """A row for each literal of a page, for a lateral join."""

    def eval(self, html: str, anchor: str):
        for pos, (found, literal) in enumerate(literals(html, anchor)):
            yield pos, found, literal


def script_literals(pages: DataFrame, anchor: str, html: str = "html") -> DataFrame:
    """pages with pos, anchor and literal: a row for each JSON literal that follows a
    match of anchor in the page's scripts. Pages without one have no row."""
    return pages.lateralJoin(ScriptLiterals(F.col(html).outer(), F.lit(anchor)))


def html_state(pages: DataFrame, anchor: str, schema: str, html: str = "html") -> DataFrame:
    """Add state: the page's first embedded JSON object or list, parsed by the schema
    (null without one)."""

    @F.arrow_udf("string")
    def first(texts: pa.Array) -> pa.Array:
        found = ((x for _, x in literals(t, anchor) if x[0] in "[{") for t in texts.to_pylist())
        return pa.array((next(x, None) for x in found), pa.string())

    return pages.withColumn("state", F.from_json(first(F.col(html)), schema))


def with_details(stubs: DataFrame, details: DataFrame, key: str, fields: str = "fields") -> DataFrame:
    """Listing rows with what their detail page says: details(key, fields map) replace
    the listing's columns of those names, null values included; other columns, and
    rows without a detail page, stay. Of several details of one key, the one with the
    most fields counts."""
    one = details.groupBy(F.col(key).alias("_key")).agg(F.max_by(fields, F.size(fields)).alias("_fields"))
    j = stubs.join(one, stubs[key] == F.col("_key"), "left")
    out = [
        F.when(F.coalesce(F.map_contains_key("_fields", F.lit(f.name)), F.lit(False)), F.col("_fields")[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        for f in stubs.schema
    ]
    return j.select(*out)


def links(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, n_links, title) with built-in functions only."""
    return pages.select(
        page_id,
        F.size(F.regexp_extract_all(F.col(html), F.lit(r"<a [^>]*href=\"([^\"]*)\""), 1)).alias("n_links"),
        F.regexp_extract(F.col(html), r"<title>(.*?)</title>", 1).alias("title"),
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType = POSTING) -> DataFrame:
    return conform(spark.read.parquet(path), schema)


def read_documents(spark: SparkSession, path: str, to_text: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of binary files (PDF, DOCX); the extractor is injected."""
    @F.arrow_udf("string")
    def text(content: pa.Array) -> pa.Array:
        return pa.array((None if x is None else to_text(x) for x in content.to_pylist()), pa.string())

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


class Registry:
    """Readers by source name; sources whose credential is missing are left out."""

    def __init__(self):
        self._readers: dict[str, tuple[Callable, tuple[str, ...], bool]] = {}

    def add(self, name: str, reader: Callable[[SparkSession], DataFrame], needs: tuple[str, ...] = (), enabled: bool = True) -> None:
        self._readers[name] = (reader, needs, enabled)

    def active(self, settings: dict[str, str]) -> list[str]:
        return [n for n, (_, needs, on) in self._readers.items() if on and all(settings.get(k) for k in needs)]

    def load(self, spark: SparkSession, settings: dict[str, str]) -> tuple[DataFrame | None, DataFrame | None]:
        """(valid rows, rows set aside) of all active sources."""
        out = None
        for name in self.active(settings):
            df = self._readers[name][0](spark).withColumn("source", F.lit(name))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return valid_rows(out) if out is not None else (None, None)
