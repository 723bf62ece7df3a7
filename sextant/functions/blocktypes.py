"""Block types and their aliases, from blocktypes.csv."""

from __future__ import annotations

import csv
import io
import pkgutil

from pyspark.sql import Column, functions as F

from .text import first_word, has_digit

_ROWS = list(csv.DictReader(io.StringIO(pkgutil.get_data(__package__, "blocktypes.csv").decode("utf-8"))))
TYPES = tuple(r["name"] for r in _ROWS if r["kind"] == "type")
ALIASES = {r["name"]: r["type"] for r in _ROWS if r["kind"] == "alias"}
#: Types that the metadata filter drops.
IRRELEVANT = ("acknowledgments", "contents", "doi", "index", "msc", "pacs", "title")
_EDGES = " \t\r\n()[]{}<>\"'“”‘’"


def special_type(title: Column) -> Column:
    """Type named by the first word of a six-hash heading; `special` where it names none."""
    word = F.btrim(F.lower(first_word(title)), F.lit(_EDGES))
    word = F.rtrim(word, F.lit(".,;:"))
    table = F.create_map(*[F.lit(x) for kv in sorted(ALIASES.items()) for x in kv])
    named = F.coalesce(F.try_element_at(table, word), word)
    return F.when((F.coalesce(word, F.lit("")) == "") | has_digit(word) | ~named.isin(*TYPES), "special").otherwise(named)


def block_type(hashes: Column, title: Column) -> Column:
    """0 hashes: text before any heading; 1: title; 2 to 5: heading; 6: special_type."""
    return F.when(hashes == 0, "text").when(hashes == 1, "title").when(hashes == 6, special_type(title)).otherwise("heading")
