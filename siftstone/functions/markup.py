"""The text of HTML pages by a tag state machine, and the repair of wrongly decoded text. Both are small helpers over Arrow batches; the clean rules of text.py call them if a profile asks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that begin a line, as the flat path has them, and tags whose content is no text.
BLOCKS = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"))
SILENT = frozenset(("script", "style", "template", "noscript"))


class _PageText(HTMLParser):
    """State: the silent tags that are open. Data inside one is dropped, entities elsewhere are decoded, block tags begin lines; comments and declarations give nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent.append(tag)
        elif tag in BLOCKS and not self.silent:
            self.out.append("\n")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # An empty tag opens nothing.
        if tag in BLOCKS and not self.silent:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            del self.silent[self.silent.index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data)


def page_text(html: str) -> str:
    parser = _PageText()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


def html_text(html: Column) -> Column:
    """The text of a page; null for null."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else page_text(t))

    return texts(html)


#: What the bytes 80 to 9F are in the encoding that is most often taken for Latin-1; a byte without a character stands for itself.
_SPECIAL = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TO_BYTES = str.maketrans(_SPECIAL)
_TAIL = "[\x80-\xbf" + re.escape("".join(_SPECIAL)) + "]"
#: Characters that, taken as bytes, are one character of UTF-8.
_DAMAGE = re.compile(f"[\xc2-\xdf]{_TAIL}|[\xe0-\xef]{_TAIL}{{2}}|[\xf0-\xf4]{_TAIL}{{3}}")
#: Classes of characters by their last code point, and about the logarithm of their share in text.
_CLASSES = ((0x7F, -1.0), (0x9F, -14.0), (0xBF, -6.0), (0xFF, -3.0), (0x17F, -5.0), (0x2FF, -10.0), (0x36F, -9.0), (0x52F, -6.0), (0x1FFF, -8.0), (0x206F, -5.0), (0x20CF, -6.0), (0x2FFF, -8.0), (0x9FFF, -6.0), (0xABFF, -9.0), (0xD7FF, -6.0), (0xFFFF, -9.0), (0x10FFFF, -9.0))


def _likelihood(text: str) -> float:
    return sum(next(value for last, value in _CLASSES if ord(c) <= last) for c in text)


def _undone(match: re.Match) -> str:
    seen = match[0]
    try:
        meant = seen.translate(_TO_BYTES).encode("latin-1").decode("utf-8")
    except UnicodeError:
        return seen
    return meant if _likelihood(meant) > _likelihood(seen) else seen


def repaired(text: str, rounds: int = 3) -> tuple[str, int]:
    """text with UTF-8 that was read as Latin-1 or its Windows variant read as what it is, and the number of places repaired.

    A place is changed only if its characters are bytes of one UTF-8 character and that is likelier than they are; damage that was done several times is undone as often.
    """
    places = 0
    for _ in range(rounds):
        if not _DAMAGE.search(text):
            break
        n = 0

        def undo(m: re.Match) -> str:
            nonlocal n
            out = _undone(m)
            n += out != m[0]
            return out

        text = _DAMAGE.sub(undo, text)
        if not n:
            break
        places += n
    return text, places


def repaired_encoding(text: Column) -> Column:
    """struct<text, places>; a null text stays null."""

    @F.pandas_udf("text string, places int")
    def repair(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([(None, 0) if t is None else repaired(t) for t in s], columns=["text", "places"]).astype({"text": "object", "places": "int32"})

    return repair(text)
