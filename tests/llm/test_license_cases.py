import os

import pytest

from casebook.llm import op08_license as lic

SHIPPED = "/usr/share/common-licenses"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids or range(len(texts)), texts)], "doc_id bigint, text string, digest string")


def test_short_notices_and_ties(spark):
    rows = lic.scan(table(spark, ["MIT", "a\nmit\nMIT!", "MITx", None]), licenses=[("B", "one text"), ("A", "One TEXT.")], notices=[("MIT", "MIT"), ("none", "...")]).collect()
    assert {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in rows} == {0: (None, 1, "MIT"), 1: (None, 2, "MIT"), 2: (None, 0, ""), 3: (None, 0, "")}
    assert lic.scan(table(spark, ["one text"]), licenses=[("B", "one text"), ("A", "One TEXT.")]).first().license_id == "A"


def test_rows_that_share_an_id_and_an_empty_table(spark):
    line = "Released under the MIT License."
    rows = lic.scan(table(spark, [f"x\n{line}", "y", "y", line], [1, 1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.n_notices, r.notices) for r in rows) == [("1", 1, "MIT")] * 3 + [("None", 0, "")]
    assert lic.scan(table(spark, ["a"]).limit(0)).count() == 0


def test_a_known_text_with_titles_copyright_lines_and_line_breaks(spark):
    body = lic.LICENSES["MIT"]
    wrapped = body.replace(". ", ".\n").replace("above copyright", "above\ncopyright")
    texts = [f"MIT License\n\nCopyright (c) 2020-2024 A. B.\nAll rights reserved.\n\n{wrapped}", f"{wrapped}\nmore", "The 3-Clause BSD License\n(c) 2001 X\n" + lic.LICENSES["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")]
    assert [r.license_id for r in lic.scan(table(spark, texts)).orderBy("doc_id").collect()] == ["MIT", None, "BSD-3-Clause"]


def test_very_long_text(spark):
    rows = lic.scan(table(spark, ["word " * 400_000 + "\n" + "Licensed under CC0 1.0.\n" * 3])).collect()
    assert [(r.n_notices, r.notices) for r in rows] == [(3, "CC0-1.0")]


@pytest.mark.skipif(not os.path.isdir(SHIPPED), reason="no licence files here")
@pytest.mark.parametrize("name, want", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_licences_as_shipped(spark, name, want):
    with open(f"{SHIPPED}/{name}", errors="replace") as f:
        text = f.read()
    assert [r.license_id for r in lic.scan(table(spark, [text, text + "x"])).orderBy("doc_id").collect()] == [want, None]
