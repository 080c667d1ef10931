import textwrap
from pathlib import Path

from edge import PROSE, edge_documents, no_documents
from flowlens.llm import licenses
from flowlens.llm.licenses import TEMPLATES, matches, scan_licenses, with_paths


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id: bigint, path: string, text: string")


def test_each_template_is_its_own_best_match(spark):
    bodies = spark.createDataFrame([(text,) for _, text in TEMPLATES], "body: string")
    got = {r.body: r.license for r in matches(bodies).collect()}
    assert got == {text: name for name, text in TEMPLATES}


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "src/a/LICENSE", "Released under the MIT License."),
        (2, "src/a/b/c/x.py", PROSE),
        (3, "src/a/b/y.py", PROSE + "\nLicensed under the Apache License, Version 2.0."),
        (4, "src/a/b/c/d/z.py", PROSE),
        (5, "src/a/b/c/d/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (6, "other/w.py", PROSE),
        (7, "src/ab/v.py", PROSE),
        (8, "/src//a/u.py", None),
        (9, None, PROSE),
    ]
    got = {r.doc_id: (r.license, r.found, r.from_folder) for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {
        1: ("MIT", "own", None),
        2: ("MIT", "inherited", "src/a"),
        3: ("Apache-2.0", "own", None),
        4: ("GPL-3.0", "inherited", "src/a/b/c/d"),
        5: ("GPL-3.0", "own", None),
        6: (None, "none", None),
        7: (None, "none", None),
        8: ("MIT", "inherited", "src/a"),
        9: (None, "none", None),
    }


def test_a_license_of_the_top_folder_reaches_everything(spark):
    rows = [(1, "LICENSE", "Licensed under CC BY-NC 4.0."), (2, "a/b/c", PROSE), (3, None, PROSE)]
    got = {r.doc_id: r.license for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: "CC-BY-NC-4.0", 2: "CC-BY-NC-4.0", 3: "CC-BY-NC-4.0"}


def test_prose_about_licenses_is_no_license(spark):
    rows = [(1, "a/x", "He lost his driving license on a long and rainy road to the coast, and copyright bored him.")]
    assert [r.license for r in scan_licenses(frame(spark, rows)).collect()] == [None]


def test_whole_license_files_and_standard_headers(spark):
    folder = Path(licenses.__file__).with_name("license_texts")
    files = {p.stem: p.read_text() for p in sorted(folder.glob("*.txt"))}
    rows = [(i, f"{n}/LICENSE", f"Copyright (c) 2020 Somebody\n\n{t}") for i, (n, t) in enumerate(files.items())]
    rows += [(100 + i, f"{n}/src/x.py", PROSE) for i, n in enumerate(files)]
    got = {r.doc_id: r.license for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {k + i: n for i, n in enumerate(files) for k in (0, 100)}
    headers = [(i, n, t) for i, (n, t) in enumerate(TEMPLATES) if len(t) > 250]
    code = "\n".join(f"value_{k} = compute({k}) + {k * k}" for k in range(80))
    rows = [(i, f"h{i}/x.py", "\n".join("# " + x for x in textwrap.wrap(t, 70)) + "\n" + code) for i, _, t in headers]
    rows += [(100 + i, f"h{i}/y.py", PROSE) for i, _, _ in headers]
    got = {r.doc_id: r.license for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {k + i: n if k == 0 else None for i, n, _ in headers for k in (0, 100)}


def test_full_notice_over_several_lines(spark):
    notice = TEMPLATES[4][1].replace(" of this ", "\nof this ")
    rows = [(1, "a/x", f"{PROSE}\n\n{notice}\n\n{PROSE}")]
    assert [r.license for r in scan_licenses(frame(spark, rows)).collect()] == ["MIT"]


def test_edge_documents(spark):
    docs = edge_documents(spark)
    got = scan_licenses(with_paths(docs))
    assert got.count() == docs.count() and got.where("license IS NOT NULL").count() == 0
    assert scan_licenses(with_paths(no_documents(spark))).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
