"""Notices that are edited, repeated, short or many."""

from lexspark.llm import licenses

KNOWN = [licenses.Template(n, t) for n, t in sorted(licenses.TEMPLATES.items())]


def test_prose_words_do_not_hide_notices():
    text = licenses.TEMPLATES["mit-grant"].split()
    lacking = " ".join(w for w in text if w not in ("hereby", "charge,"))
    prose = "the of and to in this a " * 20
    found = licenses.find_license(f"{prose} hereby {prose} charge {prose} {lacking} {prose} {lacking} {prose}", KNOWN)
    assert found[1] == "mit-grant" and found[2] > 0.95


def test_distinguishing_words_are_needed():
    of = lambda text: licenses.find_license(text, KNOWN)[1]
    assert of("Licensed under the Mozilla Public License, Version 2.0") == "mpl-notice"
    assert of("Released under the Foo License") is None
    assert of("Licensed under the Foo License, Version 2.0") is None
    assert of("This work is licensed under the GNU Lesser General Public License, version 3") == "lgpl-notice"
    assert of("Licensed under CC BY-NC-SA 4.0") == "cc-by-nc-sa-notice"
    assert of(licenses.TEMPLATES["gpl-header"].replace("GNU General", "GNU Affero General")) == "agpl-header"


def test_all_findings_of_a_document(spark):
    text = "Released under the MIT License. Some other words in between. Licensed under CC BY-NC 4.0. And so on. Released under the MIT License."
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [f["license"] for f in row["findings"]] == ["mit-notice", "cc-by-nc-notice", "mit-notice"]
    assert row["license"] == "cc-by-nc-notice" and row["first_word"] == 10  # of equal ones the first by name


def test_versions_and_identifiers():
    of = lambda text: [(f[0], f[5]) for f in licenses.find_licenses(text, KNOWN)[1]]
    assert of("Licensed under the Mozilla Public License, version 2.0") == [("mpl-notice", "2.0")]
    assert of("This work is licensed under the GNU Lesser General Public License, version 3") == [("lgpl-notice", "3")]
    assert of("Licensed under CC BY-SA 4.0") == [("cc-by-sa-notice", "4.0")]
    assert of("// SPDX-License-Identifier: GPL-3.0-or-later\n") == [("gpl-3.0-or-later-spdx", None)]
    assert of("/* SPDX-License-Identifier: BSD-3-Clause */") == [("bsd-3-clause-spdx", None)]
    assert of("MIT License\n\nCopyright (c) 2001 A B") == [("mit-notice-name", None)]
    assert of("SPDX-License-Identifier: Foo-1.0") == []


def test_names_of_licenses():
    of = lambda text: [f[0] for f in licenses.find_licenses(text, KNOWN)[1]]
    assert of("released under the BSD 3-Clause License") == ["bsd-3-clause-name"]
    assert of("Licensed under the Apache-2.0 license") == of("the Apache 2.0 License") == ["apache-2-0-license-name"]
    assert of("Licensed under Apache License 2.0") == ["apache-license-2-0-name"]
    assert of("Licensed under the GPLv3") == ["gplv3-name"]
    assert of("the Creative Commons Attribution-ShareAlike 4.0") == ["creative-commons-attribution-sharealike-name"]
    assert of("licensed as CC BY-SA 4.0") == ["cc-by-sa-4-0-name"]
    assert of('"license": "MIT",') == ["license-mit-name"]
    assert of("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007") == ["gnu-general-public-license-name"]
    assert of("under the zlib license") == ["zlib-license-name"] and of("MIT No Attribution") == ["mit-no-attribution-name"]
    assert of("under the MIT License or the Apache License, Version 2.0") == ["mit-notice-bare", "apache-license-version-2-0-name"]
    assert of("the GNU Lesser General Public License") == ["gnu-lesser-general-public-license-name"]
    assert of("a license to operate; the general public; version 3 of the plan; apache helicopters") == []


def test_expressions_of_identifiers():
    of = lambda text: [f[0].removesuffix("-spdx") for f in licenses.find_licenses(text, KNOWN)[1]]
    assert of("SPDX-License-Identifier: MIT OR Apache-2.0") == ["mit", "apache-2.0"]
    assert of("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR (MIT AND BSD-3-Clause)\nint x;") == ["gpl-2.0-only", "mit", "bsd-3-clause"]
    assert of("SPDX-License-Identifier: GPL-2.0-or-later OR LGPL-3.0-or-later") == ["gpl-2.0-or-later", "lgpl-3.0-or-later"]
    assert of("SPDX-License-Identifier: MIT OR CC-BY-SA-4.0") == ["mit", "cc-by-sa-4.0"]
    assert of("SPDX-License-Identifier: MIT and so on") == ["mit"] and of("SPDX-License-Identifier: MIT OR") == ["mit"]


def test_a_date_is_no_minor_version():
    assert [f[5] for f in licenses.find_licenses("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", KNOWN)[1]] == ["3"]


def test_denied_notices_are_none():
    of = lambda text: [f[0] for f in licenses.find_licenses(text, KNOWN)[1]]
    for text in ("This is not under the MIT License", "It isn't licensed under the terms of the MIT License.", "never released under the GNU General Public License"):
        assert of(text) == [], text
    assert of("This is not all. We use it. Released under the MIT License") == ["mit-notice"]
    assert of("not under the MIT License but under the ISC License") == ["isc-notice"]
    assert of("You may not sell it. " + licenses.TEMPLATES["mit-grant"]) == ["mit-grant"]
