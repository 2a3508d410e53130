from __future__ import annotations

from collections import Counter
from math import log, sqrt

from warmtrace.llm import licenses as lic

FILES = [
    ("/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("/a/x.py", "import os\nprint(1)"),
    ("/a/b/y.py", "code here\n# Released under the MIT License.\nmore code, and more of it, line after line"),
    ("/a/b/c/z.py", "nothing"),
    ("/a/d/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("/a/d/e/f.txt", "text"), ("/other/g.txt", "text without a licence"), ("/a/d/e/f.txt", "text"),
    ("/a/d/e/n.txt", None), (None, "Released under the MIT License."), (None, "x"), ("/a/empty", ""), ("/ab/h.txt", "not in a"),
    ("/a/d/COPYING2", "This work is licensed under the GNU General Public License, version 3."), ("top.txt", "no slash"),
]


def test_headers_files_and_the_nearest_directory(spark):
    rows = lic.scan(spark.createDataFrame(FILES, "path string, text string").selectExpr("*", "0 as score", "'x' as place")).collect()
    assert len(rows) == len(FILES)
    got = {(r.path, r.text): (r.license, r.found, r.license_path, r.line) for r in rows}
    for key, want in {
            FILES[0]: ("Apache-2.0", "file", None, None), FILES[1]: ("Apache-2.0", "inherited", "/a/LICENSE", None),
            FILES[2]: ("MIT", "header", None, 1), FILES[3]: ("Apache-2.0", "inherited", "/a/LICENSE", None),
            FILES[4]: ("GPL-3.0", "file", None, None), FILES[5]: ("GPL-3.0", "inherited", "/a/d/COPYING", None),
            FILES[6]: (None, None, None, None), FILES[8]: ("GPL-3.0", "inherited", "/a/d/COPYING", None),
            FILES[9]: ("MIT", "file", None, None), FILES[10]: (None, None, None, None),
            FILES[11]: ("Apache-2.0", "inherited", "/a/LICENSE", None), FILES[12]: (None, None, None, None),
            FILES[14]: (None, None, None, None)}.items():
        assert got[key] == want, key


def test_cosines_equal_the_formula(spark):
    docs = spark.createDataFrame(FILES, "path string, text string")
    vocabulary = {w for _, t in lic.TEMPLATES for w in lic.words(t)}
    holding = lic.holding(docs, vocabulary)
    want = Counter(w for _, t in FILES for w in set(lic.words(t or "")) & vocabulary)
    assert {w: n for w, n in holding.items() if n} == dict(want)
    scorer = lic.Scorer(lic.TEMPLATES, len(FILES), holding)
    for _, text in FILES[:5]:
        def vector(t):
            return {w: n * (log((1 + len(FILES)) / (1 + holding[w])) + 1e-3 if w in holding else log(1 + len(FILES)))
                    for w, n in Counter(lic.words(t)).items()}
        a = vector(text)
        cosines = []
        for name, template in lic.TEMPLATES:
            b = vector(template)
            cosines.append(sum(a[w] * b.get(w, 0) for w in a) / sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
        assert abs(scorer.best(text)[0] - max(cosines)) < 1e-9


def test_odd_rows(odd, empty):
    found = lic.scan(odd.selectExpr("concat('/', source, '/', doc_id) as path", "*"))
    rows = found.collect()
    assert len(rows) == odd.count() and all(r.license is None and r.found is None for r in rows)
    assert lic.scan(empty.selectExpr("'p' as path", "*")).collect() == []
