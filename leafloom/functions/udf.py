"""Kernels as functions for SQL: scalar pandas UDFs over a column of HTML, and table functions for LATERAL.

They parse the page anew at each call; for more than one question about a page, parse it once (leafloom.sources.pages)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafloom.errors import PageError
from leafloom.kernel.flat import Tree, parse_html
from leafloom.kernel.markdown import markdown
from leafloom.kernel.selectors import Matcher, parse_selector
from leafloom.kernel.structure import microdata, title
from leafloom.kernel.text import clean
from leafloom.kernel.urls import document_base, resolve


def _scalar(fn: Callable[[Tree], str | None]):
    def run(pages: pd.Series) -> pd.Series:
        def one(html: str | None) -> str | None:
            try:
                return None if html is None else fn(parse_html(html))
            except PageError:
                return None

        return pages.map(one)

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


@F.udtf(returnType="text string, href string, url string")
class PageLinks:
    """The links of a page: html, base URL."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        if html is None:
            return
        try:
            t = parse_html(html, base_url=base)
        except PageError:
            return
        at = document_base(t, base)
        for i in Matcher(t).select(parse_selector("a[href], area[href]")):
            yield clean(t, i), t.attr(i, "href"), resolve(t.attr(i, "href"), at)


@F.udtf(returnType="id int, name string, text string")
class PageElements:
    """The elements of a page that match a selector: html, selector."""

    def eval(self, html: str, css: str) -> Iterator[tuple]:
        if html is None:
            return
        try:
            t = parse_html(html)
        except PageError:
            return
        for i in Matcher(t).select(parse_selector(css)):
            yield i, t.name[i], clean(t, i)


@F.udtf(returnType="item string, property string, value string, child string")
class PageMicrodata:
    """The microdata of a page: html, base URL."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        if html is None:
            return
        try:
            t = parse_html(html, base_url=base)
        except PageError:
            return
        for r in microdata(t, [0]):
            yield r["item"], r["property"], r["value"], r["child"]


def register(spark: SparkSession) -> None:
    """page_text, page_markdown and page_title as functions; page_links, page_elements and page_microdata as table functions."""
    spark.udf.register("page_text", _scalar(lambda t: clean(t, 0)))
    spark.udf.register("page_markdown", _scalar(lambda t: markdown(t, 0)))
    spark.udf.register("page_title", _scalar(title))
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("page_elements", PageElements)
    spark.udtf.register("page_microdata", PageMicrodata)
