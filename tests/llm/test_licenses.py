import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tenderlens.llm import licenses


def noise(rng, n):
    return " ".join("w%d" % x for x in rng.integers(0, 500, n))


def texts():
    rng = np.random.default_rng(5)
    out = [None, "", "one two", "MIT License."]
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        out.append(noise(rng, 200) + " " + text + " " + noise(rng, 300))
        out.append("# " + "\n# ".join(words).upper())
        out.append(noise(rng, 31) + " " + " ".join(words[: len(words) * 9 // 10]) + " " + noise(rng, 5))
        out.append(" ".join(words[: len(words) // 2]))
    out.append(" ".join(licenses.TEMPLATES.values()) + " " + noise(rng, 40_000))
    return out


def test_against_all_windows():
    prepared = licenses.Templates(licenses.TEMPLATES)
    column = pa.array(texts(), pa.string())
    got = licenses.matches_in(column, prepared, 0.8)
    assert got == licenses.matches_in(column, prepared, 0.8, every_window=True)
    found = {(d, prepared.names[m]) for d, m, *_ in got}
    for i, name in enumerate(licenses.TEMPLATES):
        assert (4 + 4 * i, name) in found and (5 + 4 * i, name) in found
    assert not any(d < 4 for d, _ in found)
    assert {m for d, m in found if d == len(texts()) - 1} == set(licenses.TEMPLATES)


def test_rows(spark):
    rows = [(1, "x Released under the MIT License. y"), (1, "x Released under the MIT License. y"), (2, None), (None, "released UNDER the mit license")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license_id", F.lit(0)).withColumn("_id", F.lit(0))
    got = licenses.license_matches(docs).collect()
    assert sorted((str(r.doc_id), r.license_id, r.containment) for r in got) == [("1", "MIT-line", 1.0)] * 2 + [("None", "MIT-line", 1.0)]
    assert licenses.license_matches(docs.limit(0)).count() == 0


def scanned(*column):
    prepared = licenses.Templates(licenses.TEMPLATES, licenses.WORDINGS)
    found = licenses.matches_in(pa.array(column, pa.string()), prepared, 0.8)
    return [{prepared.names[m] for d, m, *_ in found if d == i} for i in range(len(column))]


def test_short_wordings():
    given = {
        "Licensed under the MIT License": "MIT-line", "the MIT license applies.": "MIT-line", "# SPDX-License-Identifier: MIT": "MIT-line",
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-line", "released under GPLv3, see": "GPL-3.0-line",
        "under the terms of version 2 of the GNU General Public License": "GPL-2.0-line",
        "distributed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1-line",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-line",
        "available under the BSD 3-Clause License": "BSD-3-Clause-line", "licensed under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0-line",
        "licensed under the Eclipse Public License v2.0": "EPL-2.0-line", "Dedicated, license: CC0 1.0 Universal": "CC0-1.0-line",
    }
    assert scanned(*given) == [{name} for name in given.values()]
    assert scanned("MIT License.", "licensed under", "the MIT license", "licensed under a licence", None) == [set()] * 5
    # A wording does not go on in the next text.
    assert scanned("licensed under", "the MIT License") == [set(), set()]


def test_competing_versions():
    old, new = licenses.TEMPLATES["GPL-2.0-header"], licenses.TEMPLATES["GPL-3.0-header"]
    apart = " ".join("z%d" % x for x in range(900))
    assert scanned(old, new, f"{old} {apart} {new}", f"{old} {new}") == [
        {"GPL-2.0-header"}, {"GPL-3.0-header"}, {"GPL-2.0-header", "GPL-3.0-header"}, {"GPL-2.0-header", "GPL-3.0-header"}]


def test_whole_texts():
    named = [n for n in licenses.TEMPLATES if n.endswith("-text")]
    assert {"GPL-2.0-text", "LGPL-2.1-text", "AGPL-3.0-text", "BSD-3-Clause-text", "CC0-1.0-text", "Unlicense-text", "EPL-1.0-text"} <= set(named)
    # Every seventh line has another word: still that licence and no other.
    texts = ["\n".join(line + (" changed" if k % 7 == 3 else "") for k, line in enumerate(licenses.TEMPLATES[n].split("\n"))) for n in named]
    for name, found in zip(named, scanned(*texts)):
        assert name in found and {licenses.licence_of(x) for x in found} == {licenses.licence_of(name)}, (name, found)
