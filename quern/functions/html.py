"""Text of saved pages, and what to know about a judge's model by its name."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SILENT = {"script", "style", "noscript", "template"}
_VOID = {"img", "br", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}


class _Visible(HTMLParser):
    """Collects text that no inline style or hidden attribute hides; pictures give their alternative text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        off = tag in _SILENT or "hidden" in a or "display:none" in style or "visibility:hidden" in style or "position:absolute" in style or style.startswith("opacity:0;") or style.endswith("opacity:0")
        if tag == "img" and a.get("alt") and not any(self.hidden):
            self.parts.append(f" {a['alt']} ")
        if tag not in _VOID:
            self.hidden.append(off)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and tag not in _VOID:
            self.hidden.pop()

    def handle_data(self, data: str) -> None:
        if not any(self.hidden):
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    """The visible text of each page; what only a browser can compute (style sheets, sizes) is not looked at. Null stays null."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        p = _Visible()
        p.feed(page)
        p.close()
        return "".join(p.parts)

    return pages.map(one)


def sees_images(model: str) -> bool:
    """Whether a model's name says that it takes images."""
    name = model.lower()
    return "-vl-" in f"{name}-" or "qwen3.5" in name or "qwen3_5" in name
