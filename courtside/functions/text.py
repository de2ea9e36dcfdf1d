"""Text and value helpers."""

from __future__ import annotations

import re
from collections import Counter
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What user HTML may keep.
ALLOWED_TAGS = {"b", "i", "em", "strong", "a", "p", "br"}
ALLOWED_ATTRIBUTES = {"a": {"href", "target"}}
ALLOWED_SCHEMES = {"http", "https", "ftp", "mailto", "tel"}
TEXTLESS_TAGS = {"script", "style", "textarea", "option"}
VOID_TAGS = set("area base basefont br col embed frame hr img input isindex link meta param source track wbr".split())
# Elements whose start closes an open paragraph.
PARAGRAPH_ENDERS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
# Fixed value: the shape of an inline image.
DATA_URL = r"^data:(.+?);base64,(.+)$"
_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9.\-+]*):")


def _safe_link(value: str) -> bool:
    found = _SCHEME.match(re.sub(r"[\x00-\x20]+", "", value))
    return found is None or found.group(1).lower() in ALLOWED_SCHEMES


class _Cleaner(HTMLParser):
    """Keeps allowed tags and all text outside script-like elements, closes what stays open.

    Open elements are counted by name, so an end tag that closes nothing and a text cost the same at any depth; each element is
    opened and closed once.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.silent = 0  # open elements whose text is dropped

    def _close_top(self) -> None:
        tag = self.open.pop()
        self.count[tag] -= 1
        self.silent -= tag in TEXTLESS_TAGS
        if tag in ALLOWED_TAGS:
            self.out.append(f"</{tag}>")

    def handle_starttag(self, tag, attrs):
        if tag in PARAGRAPH_ENDERS and self.open and self.open[-1] == "p":
            self._close_top()
        if tag in ALLOWED_TAGS:
            kept, seen = [], set()
            for name, value in attrs:
                if name not in ALLOWED_ATTRIBUTES.get(tag, ()) or name in seen or (name == "href" and not _safe_link(value or "")):
                    continue
                seen.add(name)
                kept.append(f' {name}="{_quote(value)}"' if value else f" {name}")
            self.out.append(f"<{tag}{''.join(kept)}{' /' if tag in VOID_TAGS else ''}>")
        if tag not in VOID_TAGS:
            self.open.append(tag)
            self.count[tag] += 1
            self.silent += tag in TEXTLESS_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.count[tag]:
            while self.open[-1] != tag:
                self._close_top()
            self._close_top()
        elif tag == "p":
            self.out.append("<p></p>")
        elif tag == "br":
            self.out.append("<br />")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(escape(data, quote=False))


def _quote(value: str) -> str:
    return escape(value, quote=False).replace('"', "&quot;")


def clean_html_text(html: str | None) -> str | None:
    if html is None:
        return None
    cleaner = _Cleaner()
    cleaner.feed(html)
    cleaner.close()
    while cleaner.open:
        cleaner._close_top()
    return "".join(cleaner.out)


def clean_html(c: Column | str) -> Column:
    """Allow-list HTML cleaning of a whole column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(clean_html_text, na_action="ignore")

    return run(c)


def data_url(c: Column) -> tuple[Column, Column]:
    """MIME type and bytes of ``data:<mime>;base64,<body>``; NULL when text has another shape."""
    ok = c.rlike(DATA_URL)
    return F.when(ok, F.regexp_extract(c, DATA_URL, 1)), F.when(ok, F.unbase64(F.regexp_extract(c, DATA_URL, 2)))


def to_int(c: Column, default: int) -> Column:
    """Leading whole number of text, ``default`` when there is none or it is zero."""
    head = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.coalesce(F.nullif(head, F.lit(0)), F.lit(default))


def cents(c: Column) -> Column:
    """Amount in cents, halves up."""
    return F.floor(c * 100 + 0.5).cast("bigint")


def days_before(ts: Column, days: int = 15) -> Column:
    """The date some days before, as yyyy-MM-dd text."""
    return F.date_format(F.date_sub(F.to_date(ts), days), "yyyy-MM-dd")


def split_list(c: Column, separator: str = ",") -> Column:
    """Separated text as an array, empty for NULL and empty text."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, f"\\Q{separator}\\E"))
