"""Books in EPUB form as chapter tables: one task for each book, in spine order."""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from passagemill.functions.text import heading, html_to_text
from passagemill.options import TUNING

_OPF = "{http://www.idpf.org/2007/opf}"
_BOX = "{urn:oasis:names:tc:opendocument:xmlns:container}"
_NCX = "{http://www.daisy.org/z3986/2005/ncx/}"


def spine(content: bytes) -> list[tuple[str, str, str | None, str]]:
    """(id, href, title, html) of a book's spine items that have an id and a file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(f".//{_BOX}rootfile").get("full-path")
        base = posixpath.dirname(root)
        opf = ElementTree.fromstring(z.read(root))
        items = {i.get("id"): i for i in opf.iter(f"{_OPF}item")}
        titles: dict[str, str] = {}
        for i in items.values():
            if i.get("media-type") == "application/x-dtbncx+xml":
                path = posixpath.join(base, unquote(i.get("href")))
                for point in ElementTree.fromstring(z.read(path)).iter(f"{_NCX}navPoint"):
                    src, label = point.find(f"{_NCX}content"), point.find(f"{_NCX}navLabel/{_NCX}text")
                    if src is not None and label is not None:
                        at = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(src.get("src").split("#")[0])))
                        titles.setdefault(at, label.text or "")
        out = []
        for ref in opf.iter(f"{_OPF}itemref"):
            i = items.get(ref.get("idref"))
            if i is None or not i.get("id"):
                continue
            at = posixpath.normpath(posixpath.join(base, unquote(i.get("href"))))
            out.append((i.get("id"), at, titles.get(at), z.read(at).decode("utf-8", "replace")))
        return out


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, href, order, text) of every book under path; order counts a book's kept pages."""

    def run(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                rows = spine(content)
                yield pd.DataFrame([(name, k, *r) for k, r in enumerate(rows)], columns=["path", "pos", "item", "href", "title", "html"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    x = raw.mapInPandas(run, "path string, pos int, item string, href string, title string, html string")
    x = x.withColumn("text", html_to_text(F.col("html"))).where(F.length("text") >= TUNING.least_page_chars)
    title = F.coalesce("title", heading(F.col("html")), "href", "item")
    order = F.row_number().over(W.Window.partitionBy("path").orderBy("pos")) - 1
    return x.select("path", title.alias("title"), F.coalesce("href", F.lit("")).alias("href"), order.cast("bigint").alias("order"), "text")
