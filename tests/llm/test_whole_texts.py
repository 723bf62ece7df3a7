"""Whole texts and whole tables of the training-data operators: nothing is cut off before it is looked at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import ann, htmltext, langid, licenses
from tests.llm.test_operators import ARTICLE


def test_licenses_by_whole_texts_and_names():
    s = licenses.Scanner()
    best = lambda text: max(s.scan(text), key=lambda f: (f[1], -f[2]), default=(None,))[0]
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Zlib", "BSL-1.0", "Unlicense"):
        text = licenses._text(name)
        assert [f[0] for f in s.scan(f"Copyright 2020 Someone\n{text}\nend")] == [name], name
        assert best(f"{'x ' * 50}{text[: len(text) // 2]} {'y ' * 3000} {text[len(text) // 2 :]}") == name, name
    mit = licenses._text("MIT")
    assert [f[0] for f in s.scan(f"{mit} {'z ' * 400} {mit}")] == ["MIT", "MIT"]
    notice = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    assert best(notice) == "GPL-2.0" and best(notice.replace("version 2", "version 3")) == "GPL-3.0" and best(notice.replace("General", "Affero General").replace("version 2", "version 3")) == "AGPL-3.0"
    assert best("This work is licensed under the GNU Lesser General Public License, version 3.") == "LGPL-3.0"
    for text in ("Licensed under the Xlib License.", "Released under the BSD License.", "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1."):
        assert best(text) is None, text
    assert s.scan("the x the y released under the MIT License.")[0][1] == 1


@pytest.mark.parametrize("name", ["class='page has-sidebar'", "class='content no-sidebar'", "class='site-content with-sidebar'", "class='sticky-header wrapper'", "id='legal-news-7'", "class='post comments-open'"])
@pytest.mark.parametrize("inner", ["<div class='entry-content'>%s</div>", "%s"])
def test_html_wrappers_named_like_frames(name, inner):
    want = htmltext.extract(f"<body><div>{ARTICLE}</div></body>")
    side = "<div class='sidebar widget'><p>short side text</p></div><div class='related'><a href=x>" + "more links " * 60 + "</a></div>"
    assert "Last one" in want and htmltext.extract(f"<body><div class=menu><a href=x>home</a></div><div {name}>{inner % ARTICLE}{side}</div></body>") == want


def test_nearest_with_repeated_ids(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(400, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(1000, (x[0] * (1 + 0.01 * j)).tolist()) for j in range(60)] + [(0, (x[0] * 0.9).tolist())] * 30
    best = {i: x[i : i + 1].astype(float) for i in range(400)} | {1000: np.stack([x[0] * (1 + 0.01 * j) for j in range(60)]).astype(np.float32).astype(float)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, k=20).filter("query_id < 400").collect()
    hit = 0
    for q in range(0, 400, 50):
        asks = x[q].astype(float) if q else max((x[0], x[0] * np.float32(0.9)), key=lambda v: v.tolist()).astype(float)
        score = {i: float((v @ asks).max()) for i, v in best.items() if i != q}
        mine = [g.vec_id for g in got if g.query_id == q]
        assert len(mine) == len(set(mine)) == 20 and q not in mine
        hit += len(set(mine) & set(sorted(score, key=lambda i: (-score[i], i))[:20]))
    assert hit >= 0.97 * 160


def test_language_stage_without_profiles(spark):
    d = spark.createDataFrame([(1, "clean text", None), (2, "x", None), (3, "12 !", None), (4, None, None), (5, "", None)], "doc_id long, text string, lang string")
    profiles = langid.fit(d)
    assert not profiles.langs
    assert {r.doc_id for r in langid.keep_known(d, profiles).collect()} == {1, 2}
