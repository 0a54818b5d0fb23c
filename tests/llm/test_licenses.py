import re
import textwrap
from pathlib import Path

import pytest

from ledgerweave.llm import licenses, queries
from tests.compare import both
from tests.llm.data import awkward, documents


def found(spark, texts):
    return sorted((r["doc_id"], r["unit"], r["license"], r["times"]) for r in licenses.scan(spark, documents(spark, texts)).collect())


def test_whole_texts(spark):
    mit = licenses.KNOWN["MIT"][0]
    changed = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ;")
    isc = "© 1999 me\n" + licenses.KNOWN["ISC"][0].replace("  ", "\n")
    assert found(spark, [mit, changed, isc, mit + " And more.", mit[:-40]]) == [(0, "document", "MIT", 1), (1, "document", "MIT", 1), (2, "document", "ISC", 1)]


def wrapped(text, width):
    """Every paragraph wrapped anew, but those that state a copyright."""
    out = []
    for part in re.split(r"\n[ \t]*\n", text):
        flat = " ".join(part.split())
        out.append(part if re.search(licenses.COPYRIGHT_LINE.replace(r"\p{L}\p{N}", r"\w"), part.lower()) else textwrap.fill(flat, width, break_long_words=False))
    return "\n\n".join(out)


def test_texts_are_found_however_they_are_wrapped(spark):
    rows, names = [], []
    for name, texts in licenses.KNOWN.items():
        for t in texts:
            for width in (40, 60, 66, 72, 75, 78, 80, 100, 1_000_000):
                rows.append("Copyright (c) 2015-2020, Some Holder, Inc.\n\n" + wrapped(t, width))
                names.append(name)
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark, documents(spark, rows)).where("unit = 'document'").collect()}
    # two names may share a text; then it is the first of them
    assert all(got.get(i) is not None and (got[i] == n or set(licenses.KNOWN[got[i]]) & set(licenses.KNOWN[n])) for i, n in enumerate(names)), [names[i] for i in range(len(names)) if got.get(i) != names[i]]


def test_published_texts(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not all((folder / n).exists() for n in names):
        pytest.skip("no texts of licenses here")
    texts = [(folder / n).read_text() for n in names]
    got = found(spark, texts + [wrapped(t, 66) for t in texts] + [t[:-200] for t in texts])
    assert [(i, n) for i, unit, n, _ in got if unit == "document"] == list(enumerate([*names.values()] * 2))


@pytest.mark.parametrize("line, goes", [("Copyright 2020 X", 1), ("(c) 2001 Y", 1), ("© Z", 1), (" * Copyright (C) <year> <name>", 1), ("Copyright [yyyy] [name]", 1), ("Copyright by the people", 1), ("Copyright The Great Authors", 1), ("Copyright Some One 2014", 1), ("All rights reserved.", 1), ("copyright notice and this permission notice appear in all copies.", 0), ("copyright holders and contributors", 0), ("(c) You must retain all notices", 0), ("the copyright 2020", 0)])
def test_lines_that_state_a_copyright(spark, line, goes):
    rest = spark.createDataFrame([(line,)], "t string").select(licenses.canonical(licenses.F.col("t")).alias("c")).first()["c"]
    assert (rest == "") == bool(goes)


def test_notices(spark):
    got = found(spark, ["Words.\n# RELEASED under the MIT Licence!\nwords\nReleased under the MIT License.", "Released under the MIT License.", "They released under the MIT License."])
    assert got == [(0, "line", "MIT", 2), (1, "document", "MIT", 1), (1, "line", "MIT", 1)]


def test_awkward_rows(spark):
    assert licenses.scan(spark, awkward(spark)).count() == 0
    assert licenses.scan(spark, awkward(spark).where("false")).count() == 0
    assert found(spark, ["Copyright 2020 X", "All rights reserved."]) == []


def test_query_equals_its_sql(spark):
    for sf in ("0.001", "0.01"):
        ours, theirs = both(spark, f"/root/testdata/sf{sf}", queries.op2_license_scan, licenses.sql())
        assert ours == theirs and ours
