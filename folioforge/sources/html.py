"""Text of HTML, with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_to_text(html: str | None) -> str | None:
    """The text nodes in their order, entities decoded, without comments, scripts and styles."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


def html_text(html: Column | str) -> Column:
    """html_to_text() over Arrow batches."""
    return F.arrow_udf(lambda values: pa.array([html_to_text(v) for v in values.to_pylist()], pa.string()), "string")(html)
