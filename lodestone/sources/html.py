"""The one Python step of the page pipeline: HTML to a struct of raw parts, in Arrow batches.

Everything that can be said in expressions happens after this step; it only tokenises. Texts are joined and stripped node by
node, scripts and the like are left out, and links are resolved against the page's URL.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
HIDDEN = frozenset({"script", "style", "svg", "img", "noscript", "iframe"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})

ANCHOR = pa.struct([("ordinal", pa.int32()), ("href", pa.string()), ("label", pa.string()), ("url", pa.string())])
BUTTON = pa.struct([("label", pa.string()), ("href", pa.string())])
FIELDS = [
    ("title", pa.string()), ("description", pa.string()), ("html_lang", pa.string()), ("meta_locale", pa.string()), ("site_name", pa.string()),
    ("form_detected", pa.bool_()), ("clean_text", pa.string()), ("anchors", pa.list_(ANCHOR)), ("buttons", pa.list_(BUTTON)), ("json_ld", pa.list_(pa.string())),
]
SCHEMA = "title string, description string, html_lang string, meta_locale string, site_name string, form_detected boolean, clean_text string, anchors array<struct<ordinal:int,href:string,label:string,url:string>>, buttons array<struct<label:string,href:string>>, json_ld array<string>"


class Reader(HTMLParser):
    """Collects the raw parts of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list | None]] = []
        self.opened: Counter[str] = Counter()  # open tags by name, so that an end tag without its start costs nothing
        self.sinks: list[list] = []  # of the open links, outermost first
        self.texts: list[str] = []
        self.links: list[tuple[str, dict, list[str]]] = []
        self.metas: list[dict] = []
        self.title: list[str] | None = None
        self.lang: str | None = None
        self.form = False
        self.hidden = 0
        self.json: list[list[str]] = []
        self.in_json = False

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html" and self.lang is None:
            self.lang = values.get("lang", "")
        elif tag == "meta":
            self.metas.append(values)
        elif tag == "form":
            self.form = True
        elif tag == "title" and self.title is None:
            self.title = []
        sink = None
        if tag in ("a", "button"):
            sink = []
            self.links.append((tag, values, sink))
        if tag == "script" and values.get("type") == "application/ld+json":
            self.json.append([])
            self.in_json = True
        if tag not in VOID:
            self.open.append((tag, sink))
            self.opened[tag] += 1
            if sink is not None:
                self.sinks.append(sink)
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.opened[tag]:
            while True:
                t, sink = self.open.pop()
                self.opened[t] -= 1
                self.hidden -= t in HIDDEN
                if sink is not None:
                    self.sinks.pop()
                if t == tag:
                    break
        if tag == "script":
            self.in_json = False

    def handle_data(self, data):
        if self.in_json:
            self.json[-1].append(data)
        if self.open and self.open[-1][0] == "title" and self.title is not None:
            self.title.append(data)
        text = data.strip()
        if not text or self.hidden:
            return
        self.texts.append(text)
        for sink in self.sinks:
            sink.append(text)


def normalise_link(base: str, href: str) -> str | None:
    """Absolute form of a link; null for fragments, scripts, mail and phone links."""
    href = href.strip()
    if not href or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:", "tel:")):
        return None
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def nodes_of(block: str) -> list[dict]:
    """Objects of a JSON-LD block at any depth of lists and @graph, an object before those of its graph; none if it isn't JSON."""
    try:
        waiting = [json.loads(block)]
    except (ValueError, RecursionError):
        return []
    out = []
    while waiting:
        found = waiting.pop()
        if isinstance(found, dict):
            out.append(found)
            found = found.get("@graph")
        if isinstance(found, list):
            waiting += reversed(found)
    return out


def read_page(html: str | None, base: str | None) -> dict:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    meta = lambda key, name: next((m["content"].strip() for m in reader.metas if m.get(key) == name and m.get("content")), None)
    named = next((m for m in reader.metas if m.get("name") == "description"), None) or next((m for m in reader.metas if m.get("property") == "og:description"), None)
    anchors, buttons = [], []
    for tag, values, sink in reader.links:
        label = " ".join(sink)
        if tag == "a" and "href" in values:
            href = values["href"].strip()
            anchors.append({"ordinal": len(anchors), "href": href, "label": label, "url": normalise_link(base or "", href)})
        buttons.append({"label": label, "href": values.get("href", "")})
    return {
        "title": "".join(reader.title or []).strip(), "description": ((named or {}).get("content") or "").strip(), "html_lang": (reader.lang or "").strip().lower() or None,
        "meta_locale": (meta("property", "og:locale") or "").lower() or None, "site_name": meta("property", "og:site_name"), "form_detected": reader.form,
        "clean_text": re.sub(r"\s+", " ", " ".join(reader.texts)), "anchors": anchors, "buttons": buttons, "json_ld": [json.dumps(n, ensure_ascii=False) for x in reader.json for n in nodes_of("".join(x))],
    }


def read_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, the raw parts of every page, and the columns to keep."""
    names = ["page_id", "url", *keep]

    def work(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                got = [read_page(h, u) for h, u in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array([g[name] for g in got], kind) for name, kind in FIELDS)], [*names, *(name for name, _ in FIELDS)])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), *(c for c in keep if c != "html"))
    kept = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(work, f"page_id bigint, url string, {kept}{SCHEMA}")
