import os
import textwrap

import pytest

from strandflow.llm import licenses as lic


def test_variants_of_a_licence_are_found(spark):
    mit = dict(lic.KNOWN[1:2])["MIT"]
    long = "word " * 60_000
    texts = {
        1: lic.KNOWN[0][1].upper(),
        2: mit.replace("<year> <copyright holders>", "2019 A. Author").replace("\n", "\n\n").replace('"', "”"),
        3: "Copyright 2001 Me\n\n" + mit.replace("sublicense", "sub-licence").replace(".", " ."),
        4: "some text\n  licensed under the APACHE licence version 2.0!\nmore",
        5: "Released under the MIT License.\nReleased under the MIT License.",
        6: "Released under the MIT License. And more.",
        7: None, 8: "", 9: "Copyright (c) nobody. All rights reserved.", 10: long, 11: long + "\nLicensed under CC BY-NC 4.0.",
    }
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()] + [(4, texts[4], "x", 1)], "doc_id long, text string, license string, lines int")
    known = spark.createDataFrame(lic.KNOWN, "license string, text string")
    got = sorted(tuple(r) for r in lic.scan_licenses(docs, known).select("doc_id", "license", "unit", "hits").collect())
    assert got == [
        (1, "MIT", "text", 1), (2, "MIT", "text", 1), (3, "MIT", "text", 1), (4, "Apache-2.0", "line", 2),
        (5, "MIT", "line", 2), (11, "CC-BY-NC-4.0", "line", 1),
    ]
    assert lic.scan_licenses(docs.limit(0), known).collect() == []
    assert lic.scan_licenses(docs, known.limit(0)).collect() == []


def test_main_path_has_no_python(spark):
    plan = lic.op7_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_known_texts_are_found_at_any_width(spark):
    known = spark.createDataFrame(lic.KNOWN, "license string, text string")
    texts = [(k, t) for k, t in lic.KNOWN if "\n" in t]
    rows = []
    for k, t in texts:
        for width in (20, 50, 60, 66, 70, 72, 76, 80, 100):
            head = t.replace("<year> <copyright holders>", "2019 A. Author").replace("<year> <owner>", "2019 A. Author")
            rows.append((k, "\n".join(textwrap.fill(x, width, break_long_words=False) if not x.startswith("Copyright") else x for x in head.split("\n"))))
    rows += [("MIT", lic.KNOWN[1][1].replace("(c) <year> <copyright holders>", x)) for x in ("The Authors", "2001 Me", "[year] Me", "© Me", "Jane Doe")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in lic.scan_licenses(docs, known).where("unit = 'text'").collect()}
    assert len({k for k, _ in rows}) >= 6
    assert got == {(i, k) for i, (k, _) in enumerate(rows)}


FULL = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isfile("/usr/share/common-licenses/GPL-3"), reason="no licence texts on this machine")
def test_full_texts_are_found_by_digest_at_any_width(spark):
    def wrapped(text, width):
        parts = []
        for part in text.split("\n\n"):
            kept = [x.strip() for x in part.split("\n") if x.strip()]
            heads = [x for x in kept if x.lower().startswith("copyright (") or x.lower().startswith("copyright [")]
            parts.append("\n".join([*heads, textwrap.fill(" ".join(x for x in kept if x not in heads), width, break_long_words=False)]))
        return "\n\n".join(parts)

    rows = []
    for name, file in FULL.items():
        text = open(f"/usr/share/common-licenses/{file}", encoding="utf-8").read()
        rows += [(name, text), (name, text.upper().replace("\n", "\r\n"))] + [(name, wrapped(text, width)) for width in (40, 50, 60, 72, 80, 100, 120)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    known = spark.createDataFrame(lic.KNOWN, "license string, text string")
    digests = spark.createDataFrame(lic.KNOWN_DIGESTS, "license string, size int, digest string")
    got = {(r.doc_id, r.license) for r in lic.scan_licenses(docs, known, digests).where("unit = 'text'").collect()}
    assert got == {(i, k) for i, (k, _) in enumerate(rows)}, sorted({(k, i) for i, (k, _) in enumerate(rows)} - {(k, i) for i, k in got})
