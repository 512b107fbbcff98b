import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.llm import license_scan as L

MIT = L.TEMPLATES[3][1]
APACHE = L.TEMPLATES[5][1]


def brute(text, threshold=L.THRESHOLD):
    """Every segment against every template, without bounds."""
    found = []
    for s in L.segments(text) if text else []:
        a = L.bigrams(L.words(s))
        m = sum(a.values())
        if m:
            each = [(2 * sum((a & b).values()) / (m + n), -i) for i, (name, b, n) in enumerate((x, y, sum(y.values())) for x, t in L.TEMPLATES for y in [L.bigrams(L.words(t))])]
            if max(each)[0] >= threshold:
                found.append(max(each))
    if not found:
        return [], None, 0.0, 0
    return sorted({L.TEMPLATES[-i][0] for _, i in found}), L.TEMPLATES[-max(found)[1]][0], pytest.approx(max(found)[0]), len(found)


def test_against_brute_force():
    rng = random.Random(2)
    known = L.Templates(L.TEMPLATES, L.THRESHOLD)
    prose = "the work of an author under a public sky and the license to be free".split()
    texts = [None, "", "\n\n", "...", "MIT", "released under the mit license", "# Released under the MIT License!", "Copyright 2020 Me", "Copyright (c) 2024 A. B.\n\n" + MIT, MIT.replace("Software", "Program"), "x y\n" + MIT.replace("\n", " ") + "\nz", APACHE + "\n\n" + MIT, "z" * 5000, "w " * 50_000]
    for _ in range(150):
        t = rng.choice(L.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, len(t) // 3)):
            t[rng.randrange(len(t))] = rng.choice(prose)
        lines = [" ".join(rng.choices(prose, k=rng.randint(1, 20))) for _ in range(rng.randint(0, 4))]
        lines.insert(rng.randint(0, len(lines)), " ".join(t))
        texts.append(rng.choice(["\n", "\n\n"]).join(lines))
    for t in texts:
        assert L.scanned(t, known) == brute(t), t


def test_finds_notices_and_leaves_prose_alone():
    known = L.Templates(L.TEMPLATES, L.THRESHOLD)
    assert L.scanned("Some prose here.\nLicensed under CC BY-NC 4.0.\nMore.", known)[:2] == (["CC-BY-NC-4.0"], "CC-BY-NC-4.0")
    assert L.scanned("This work is licensed under the GNU General Public License, version 3.", known)[1] == "GPL-3.0"
    assert L.scanned("He licensed the song under a pen name. The license was public.", known)[1] is None


def test_rows_and_sql(spark):
    rows = [(1, "a\nReleased under the MIT License.\nb"), (1, "a\nReleased under the MIT License.\nb"), (2, None), (3, ""), (None, "Licensed under CC BY 4.0."), (4, "none")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, dice int, license string")
    got = Counter((r.doc_id, tuple(r.licenses), r.license, r.dice, r.segments) for r in L.licenses(docs).collect())
    assert got == Counter([(1, ("MIT",), "MIT", 1.0, 1)] * 2 + [(2, (), None, 0.0, 0), (3, (), None, 0.0, 0), (None, ("CC-BY-4.0",), "CC-BY-4.0", 1.0, 1), (4, (), None, 0.0, 0)])
    assert L.licenses(docs.where(F.lit(False))).count() == 0
    # The notices in the synthetic documents are lines of their own; a plain search must find the same documents.
    path = "/root/testdata/sf0.01/documents.parquet"
    want = {r[0] for r in duckdb.sql(f"select doc_id from '{path}' where regexp_matches(text, 'Licensed under the Apache License, Version 2.0\\.|Released under the MIT License\\.|Licensed under CC BY-NC 4.0\\.|licensed under the GNU General Public License, version 3\\.')").fetchall()}
    got = {r.doc_id for r in L.licenses(spark.read.parquet(path)).where("license is not null").collect()}
    assert got <= want and len(got) > 0.8 * len(want)


def test_standard_licences_inside_longer_files():
    known = L.Templates(L.TEMPLATES, L.THRESHOLD)
    rng = random.Random(4)
    prose = lambda: "\n".join(" ".join(rng.choices("a reader of the house went to see seven ships on that day".split(), k=12)) for _ in range(300))
    for name, text in L.TEMPLATES:
        w = text.split()
        if len(w) < 30:
            continue
        third = len(w) // 3
        parts = [w[:third], w[third : 2 * third], w[2 * third :]]  # three paragraphs of short lines
        body = "\n\n".join("\n".join(" ".join(p[i : i + 11]) for i in range(0, len(p), 11)) for p in parts)
        got = L.scanned(prose() + "\n\nCopyright (c) 2020 A. B.\n\n" + body + "\n\n" + prose(), known)
        assert name in got[0] and got[1] == name and got[2] > 0.95, (name, got)
    isc, mit = (t for n, t in L.TEMPLATES if n in ("ISC", "MIT") and len(t) > 400)
    two = prose() + "\n\n" + isc.replace(". ", ".\n\n") + "\n\n" + prose() + "\n\n" + mit.replace(": ", ":\n\n").replace("Software. THE", "Software.\n\nTHE")
    assert L.scanned(two, known)[0] == ["ISC", "MIT"]
    gpl = next(t for n, t in L.TEMPLATES if n == "GPL-3.0" and 400 < len(t) < 2000)
    assert L.scanned(gpl.split(" This program is distributed")[0].replace("\nThis program", " "), known)[1] != "GPL-2.0"


def test_runs_against_all_runs():
    """The best line or run of each text against every run of lines and every template."""
    known = L.Templates(L.TEMPLATES[:24], L.THRESHOLD)
    rng = random.Random(6)
    for _ in range(60):
        w = rng.choice(L.TEMPLATES[:24])[1].split()
        lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
        if rng.random() < 0.5 and len(lines) > 2:
            lines.insert(rng.randrange(len(lines)), "some other words in between")
        text = "\n".join(["first words", *lines, "last words", ""])
        own = [L.words(x) for x in text.splitlines()]
        best = 0
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                a = L.bigrams(sum(own[i:j], []))
                best = max([best, *(2 * sum((a & b).values()) / (sum(a.values()) + n) for _, b, n in known.all)])
        lone = [d for x in own for d, _ in known.best(L.bigrams(x), max(1, len(x) - 1))]
        got = max([0, *lone, *(d for d, *_ in L.runs(text, known))])
        assert got == (pytest.approx(best) if best >= 0.8 else 0), text


def _dice(a: str, b: str) -> float:
    """By the definition, with nothing of the module's own."""
    import re

    x, y = (re.findall(r"[^\W_]+", t.lower()) for t in (a, b))
    x, y = Counter(zip(x, x[1:])), Counter(zip(y, y[1:]))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def test_usual_forms_of_complete_texts():
    known = L.Templates(L.TEMPLATES, L.THRESHOLD)
    parts = [MIT[: MIT.index("The above")], MIT[MIT.index("The above") : MIT.index("THE SOFTWARE IS")], MIT[MIT.index("THE SOFTWARE IS") :]]
    readme = "# A tool\n\nIt does things.\n\n" + "\n\n".join(parts) + "\n\nThanks to all who helped with it."
    assert L.scanned(readme, known)[1] == "MIT"
    assert L.scanned("\n".join(f"Copyright (c) {1900 + k} Somebody Else And Others" for k in range(400)) + "\n\n" + MIT, known)[:3] == (["MIT"], "MIT", 1.0)
    for name in ("BSD-3-Clause", "BSD-2-Clause", "ISC", "Apache-2.0", "GPL-3.0"):
        text = max((t for n, t in L.TEMPLATES if n == name), key=len)
        changed = text.replace("HOLDER", "OWNER").replace("AUTHOR", "MAKER")
        assert _dice(changed, text) >= 0.8
        assert L.scanned(changed, known)[1] == name, name
