"""String functions with the semantics of Python's str, as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_TERM = "\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029"
_SPACE = r"[\s\x1c-\x1f]"
RX_STRIP = rf"(?U)^{_SPACE}+|{_SPACE}+\z"
RX_LINES = f"[^{_TERM}]*(?:\\r\\n|[{_TERM}])|[^{_TERM}]+"
RX_HEADING = rf"(?sU)^(#{{1,6}}){_SPACE}+(.*)\z"
_GAP = rf"[\s\x1c-\x1f&&[^{_TERM}]]"
_BEGIN = f"(?<![^{_TERM}])"
#: In whole texts: heading lines with their line ends, and the rest of a line with one hash, indented or not.
RX_HEADING_LINES = f"(?U)(?=#){_BEGIN}#{{1,6}}(?:[{_TERM}&&[^\\r\\n]]|{_GAP}[^{_TERM}]*+(?:\\r\\n|[{_TERM}])?)"
RX_TITLE = rf"(?U){_BEGIN}{_GAP}*+#{_GAP}++([^\s\x1c-\x1f][^{_TERM}]*+)"
#: From the first character that isn't white space to the end of its line.
RX_FIRST = rf"(?U)[^\s\x1c-\x1f][^{_TERM}]*+"
RX_TOKEN = r"[\p{L}\p{N}_]+"
#: Characters that str.isdigit accepts beyond category Nd.
_DIGITS = r"[\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once for each row even where body mentions it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(text: Column) -> Column:
    return F.regexp_replace(text, RX_STRIP, "")


def is_blank(text: Column) -> Column:
    """Whether str.strip() would leave nothing; stops at the first other character."""
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def split_lines(text: Column) -> Column:
    """str.splitlines(keepends=True); none for empty text."""
    return F.regexp_extract_all(text, F.lit(RX_LINES), F.lit(0))


def windows(text: Column, size: int, step: int) -> Column:
    """text[i * step : i * step + size] for each i that begins inside it, in one walk over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}}+)).{{1,{step}}}+"), F.lit(1))


def tokenize(text: Column) -> Column:
    """Runs of word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(RX_TOKEN), F.lit(0))


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?U)^{_SPACE}*([^\s\x1c-\x1f]+)", 1)


def has_digit(text: Column) -> Column:
    return text.rlike(_DIGITS)


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")
