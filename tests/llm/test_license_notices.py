import random
from pathlib import Path

import pytest

from boardwise.llm import license_scan
from boardwise.llm.queries import op8_license_scan

from .cases import documents

GNU = "This program is free software{3} you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation{2} either version {1} of the License, or (at your option) any later version."
BSD = [t for n, t in license_scan.NOTICES if n.startswith("BSD") and t.startswith("Redistribution")]
CASES = [
    (GNU.format("", "2", ";", ";"), {"GPL-2.0"}), (GNU.format("", "3", ",", ":"), {"GPL-3.0"}), (GNU.format("Affero ", "3", ",", ":"), {"AGPL-3.0"}),
    (GNU.format("Lesser ", "2.1", ";", ";").replace("program", "library"), {"LGPL-2.1"}), (GNU.format("Lesser ", "3", ",", ":"), {"LGPL-3.0"}),
    (GNU.format("", "2", ";", ";") + " or " + GNU.format("", "3", ",", ":"), {"GPL-2.0", "GPL-3.0"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}), (BSD[0], {"BSD-2-Clause"}), (BSD[1], {"BSD-3-Clause"}),
    ("This project is licensed under the MIT License.", {"MIT"}), ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}), ("x // SPDX-License-Identifier: MIT\nend", {"MIT"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}), ("SPDX-License-Identifier: MITX", set()),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", {"MPL-2.0"}),
    (None, set()), ("no license here", set()),
]


def test_notices_are_told_apart(spark, tmp_path):
    texts = [t if t is None else f"{lead}{t}{' and more words after it' * k}" for k, lead in enumerate(("", "some words lead in. " * 9)) for t, _ in CASES]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {i: set() for i in range(len(texts))}
    for r in op8_license_scan(spark, str(tmp_path)).collect():
        got[r.doc_id].add(r.license)
    assert got == {i: CASES[i % len(CASES)][1] for i in got}


def test_short_templates_count(spark):
    docs = documents(spark, ["a b Public-Domain work", "publicdomain work"])
    assert [tuple(r) for r in license_scan.scan_licenses(docs, [("PD", "public domain"), license_scan.TEMPLATES[0]]).collect()] == [(0, "PD", 1.0, 2)]
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, [("PD", "...")])


def test_any_number_of_templates(spark, monkeypatch):
    """Templates joined by shuffles give what a broadcast gives."""
    docs = documents(spark, [t for _, t in license_scan.NOTICES] + [c for c, _ in CASES])
    whole = {tuple(r) for r in license_scan.scan_licenses(docs, license_scan.NOTICES, apart=True).collect()}
    monkeypatch.setattr(license_scan, "BROADCAST", 400)
    assert {tuple(r) for r in license_scan.scan_licenses(docs, license_scan.NOTICES, apart=True).collect()} == whole and len(whole) > 60


def test_what_tells_templates_apart(spark):
    """Rarest shingles find all near templates that comparing each with each finds, hot ones among them."""
    r = random.Random(5)
    hot = [f"h{k}" for k in range(30)]
    texts = [" ".join([*hot[: r.randrange(10, 31)], *(r.choice("abc") + str(r.randrange(9)) for _ in range(r.randrange(0, 25)))]) for _ in range(40)]
    known = license_scan._templates(spark.range(1), [(f"L{k % 7}", t) for k, t in enumerate(texts)])
    own = {x.template: (x.license, set(x.own)) for x in known.collect()}
    want = {i: sorted(sorted(a - b) for m, b in own.values() if m != n and a - b and len(a & b) >= 0.5 * len(a)) for i, (n, a) in own.items()}
    got = {x.template: sorted(map(sorted, x.apart)) for x in license_scan._apart(known).collect()}
    assert got == {i: w for i, w in want.items() if w} and len(got) > 20


FULL = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FULL.is_dir(), reason="no full license texts here")
def test_full_license_texts(spark):
    """Whole licenses as templates: each is found in a text around it, and changed here and there, as itself alone."""
    names = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "GFDL-1.3") if (FULL / n).is_file()]
    texts = [(FULL / n).read_text(errors="replace") for n in names]
    changed = [" ".join(w for k, w in enumerate(t.split()) if k % 80) for t in texts]
    docs = documents(spark, [f"some words {t} and more" for t in changed])
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs, list(zip(names, texts)), apart=True).collect()}
    assert got == set(enumerate(names))
