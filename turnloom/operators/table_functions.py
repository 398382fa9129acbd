"""Parsers as table functions for SQL: ``SELECT ... FROM pages, LATERAL parse_messages(html, url)``.

``register(spark)`` makes them known to a session. Arguments are checked when a query is analyzed, so a wrong
type or an unknown provider is an error before anything runs; rows come from the parsers as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, MapType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from turnloom.functions import rules
from turnloom.functions.dom import parse
from turnloom.operators.nodes import numbered
from turnloom.operators.providers import parse_page


def provider_of(html: str | None, url: str | None) -> str:
    """By markers in the URL, else in the start of the page, else the default."""
    for value, markers in (((url or "").lower(), rules.URL_MARKERS), ((html or "")[: rules.HTML_PREFIX].lower(), rules.HTML_MARKERS)):
        for provider, parts in markers:
            if any(p in value for p in parts):
                return provider
    return "claude"


def _texts(**given: AnalyzeArgument | None) -> None:
    for name, argument in given.items():
        if argument is not None and not isinstance(argument.dataType, (StringType, NullType)):
            raise ValueError(f"{name} must be a string, not {argument.dataType.simpleString()}")


class ParseMessages:
    """``pos, provider, role, html, text, thought``: a page's messages in order. A null page has none. The
    provider is told by url and page, unless it is given."""

    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument | None = None, provider: AnalyzeArgument | None = None) -> AnalyzeResult:
        _texts(html=html, url=url, provider=provider)
        if provider is not None and provider.isConstantExpression and provider.value is not None and provider.value not in rules.PROVIDERS:
            raise ValueError(f"provider must be one of {', '.join(rules.PROVIDERS)}, not {provider.value}")
        schema = StructType().add("pos", IntegerType())
        for name in ("provider", "role", "html", "text", "thought"):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, html: str | None, url: str | None = None, provider: str | None = None) -> Iterator[tuple]:
        known = provider or provider_of(html, url)
        for pos, m in enumerate(parse_page(known, html, url)["messages"]):
            yield pos, known, m["role"], m["html"], m["text"], m["thought"]


class PageNodes:
    """``nid, parent, last, tag, attrs, text``: a page's elements in document order, each with the text that
    stands in it outside of other elements."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        _texts(html=html)
        schema = StructType()
        for name in ("nid", "parent", "last"):
            schema = schema.add(name, IntegerType())
        return AnalyzeResult(schema.add("tag", StringType()).add("attrs", MapType(StringType(), StringType())).add("text", StringType()))

    def eval(self, html: str | None) -> Iterator[tuple]:
        nodes, place, last = numbered(parse(html))
        for i, node in enumerate(nodes):
            yield i, place[id(node.parent)] if i else None, last[i], node.tag, node.attrs, "".join(c for c in node.children if isinstance(c, str))


def register(spark: SparkSession) -> None:
    """Makes ``parse_messages(html, url, provider)`` and ``page_nodes(html)`` known to the session's SQL."""
    spark.udtf.register("parse_messages", udtf(ParseMessages))
    spark.udtf.register("page_nodes", udtf(PageNodes))
