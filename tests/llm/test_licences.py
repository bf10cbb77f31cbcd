import duckdb
import pytest

from tallyspark.llm.licences import TEMPLATES, WHOLE, scan_licences


def test_licences_are_found_in_lines_paragraphs_and_whole_texts(spark, odd_docs, no_docs):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    wrapped = "Copyright (c) 2020 Somebody\n\n" + mit.replace(", ", ",\n") + "\n\nEnd of file"
    # the first text matches by its second line, by the run of its first two lines, and as a whole, being short; a paragraph whose lines are a run counts once
    rows = [(1, "Text.\nlicensed under the APACHE license version 2.0\nMore text."), (2, wrapped), (3, mit.replace("Software", "Program")), (4, "No licence here, but the apache and the version are named."), (5, None), (None, "Licensed under CC BY-NC 4.0."), (None, "Licensed under CC BY-NC 4.0."), (6, "a b")]
    got = {(r.id, r.licence): (round(r.dice, 3), r.passages) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "Apache-2.0"), (2, "MIT"), (3, "MIT"), (None, "CC-BY-NC-4.0")}
    assert got[(1, "Apache-2.0")] == (1.0, 3) and got[(2, "MIT")] == (1.0, 2) and got[(3, "MIT")][0] < 1 and got[(None, "CC-BY-NC-4.0")] == (1.0, 1)
    assert scan_licences(odd_docs).count() == scan_licences(no_docs).count() == scan_licences(odd_docs, templates=[]).count() == 0


#: Written down from the tables, not from TEMPLATES.
LINES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-rights-reserved",
}


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_licence_line_of_documents_is_found(spark, d):
    lines = duckdb.connect().execute(f"SELECT doc_id, trim(line) FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) AS line FROM '{d}/documents.parquet') WHERE regexp_matches(line, '(?i)licen[sc]e|CC BY|all rights')").fetchall()
    assert lines and {line for _, line in lines} <= set(LINES)
    found = scan_licences(spark.read.parquet(f"{d}/documents.parquet")).collect()
    want = {(i, LINES[line]) for i, line in lines}
    assert {(r.id, r.licence) for r in found if r.dice > 0.999} == {(r.id, r.licence) for r in found} == want


def test_short_notices_begin_with_any_usual_verb(spark):
    want = [(f"{verb} under {called}.", name) for verb in ("Released", "Distributed", "Available", "Provided") for called, name in (("the MIT License", "MIT"), ("the ISC License", "ISC"), ("the Apache License, Version 2.0", "Apache-2.0"), ("CC BY-SA 4.0", "CC-BY-SA-4.0"), ("the Unlicense", "Unlicense"))]
    got = {(r.id, r.licence) for r in scan_licences(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(want)], "doc_id long, text string")).where("dice > 0.999").collect()}
    assert got == {(i, name) for i, (_, name) in enumerate(want)}


#: What short notices say and the one licence that each states; none for licences that no template has.
ALIKE = [
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("Distributed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", None), ("Licensed under CC BY 3.0.", None),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
]


def test_licences_that_differ_in_a_word_are_told_apart(spark):
    got = {(r.id, r.licence) for r in scan_licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ALIKE)], "doc_id long, text string")).collect()}
    assert got == {(i, name) for i, (_, name) in enumerate(ALIKE) if name}


def test_whole_licences_wrapped_beside_code(spark):
    rows = []
    for i, (name, text) in enumerate(sorted(WHOLE.items())):
        w = text.split(" ")
        lines = "\n".join(" * " + " ".join(w[j : j + 9]) for j in range(0, len(w), 9))
        rows.append((i, f"import os\nimport numpy as np\n/*\n * Copyright (c) 2020 Somebody\n *\n{lines}\n */\ndef compute_all(rows, columns, limits, depth):\n    return sum(row[column] for row in rows for column in columns)\n"))
    got = {(r.id, r.licence): r.dice for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(i, name) for i, name in enumerate(sorted(WHOLE))} and min(got.values()) > 0.95
