"""Which licence: versions, expressions, titles and remarks; precision and recall over a labelled set."""

import re

import pytest

from paratope.llm import license_scan
from tests.llm.test_native import MIT, wrapped

CODE = "\n\nimport os\n\ndef main(arguments):\n    return os.path.join(*arguments)\n" * 5
HEADER = license_scan._GPL_HEADER

#: (text, the licence that it declares)
LABELLED = [
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "LGPL-2.1"),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.", "LGPL-2.1"),
    ("GNU LIBRARY GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "LGPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989", "GPL-2.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "AGPL-3.0"),
    ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("// Licensed under the Apache License, Version 2.0 (the \"License\");\n" + CODE, "Apache-2.0"),
    ("# ISC License notes", None),
    ("# ISC License", "ISC"),
    ("See the MIT License.", None),
    ("The MIT License (MIT)\n\nCopyright (c) 2020 A", "MIT"),
    ("# MIT License", "MIT"),
    ("Released under the MIT License.", "MIT"),
    ("This was once released under the MIT License.", None),
    ("It is not released under the MIT License.", None),
    ("SPDX-License-Identifier: GPL-2.0-only" + CODE, "GPL-2.0-only"),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later\n" + CODE, "LGPL-2.1-or-later"),
    ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */" + CODE, "MIT OR Apache-2.0"),
    ("// SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) AND BSD-3-Clause\n" + CODE, "(GPL-2.0 WITH Linux-syscall-note) AND BSD-3-Clause"),
    ("<!-- SPDX-License-Identifier: EPL-2.0 -->", "EPL-2.0"),
    ("-- SPDX-License-Identifier: BUSL-1.1", "BUSL-1.1"),
    ("SPDX-License-Identifier: CC-BY-ND-4.0", "CC-BY-ND-4.0"),
    ("Put SPDX-License-Identifier: MIT into each file.", None),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Creative Commons Attribution-NonCommercial 4.0 International", "CC-BY-NC-4.0"),
    ("Mozilla Public License Version 1.1", "MPL-1.1"),
    ("Mozilla Public License Version 2.0\n\n1. Definitions", "MPL-2.0"),
    ("/* " + wrapped(license_scan._MPL_HEADER, " * ", 75) + " */" + CODE, "MPL-2.0"),
    ("Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM", "EPL-2.0"),
    ("/*\n" + wrapped(HEADER.format(v=3), " * ") + "\n */" + CODE, "GPL-3.0"),
    (wrapped(HEADER.format(v=2), "# ") + CODE, "GPL-2.0"),
    (wrapped(HEADER.replace("General", "Lesser General").replace("program", "library").format(v="2.1"), "// ") + CODE, "LGPL-2.1"),
    (wrapped(HEADER.replace("General", "Affero General").format(v=3), "; "), "AGPL-3.0"),
    ("GNU GENERAL PUBLIC LICENSE", None),
    ("The GNU General Public License, version 3, protects the freedom of users.", None),
    ("We like the Apache License 2.0 and the MIT License.", None),
    ("You need a license to drive.", None),
    ("Copyright 2020 The Authors. All rights reserved.", None),
    ("License: see the file COPYING", None),
    (MIT, "MIT"),
    (wrapped(MIT, "# ") + CODE, "MIT"),
    ("BSD 3-Clause License\n\nCopyright (c) 2001, X\nAll rights reserved.\n\n" + wrapped(" ".join([license_scan._BSD_GRANT, license_scan._BSD_THIRD, license_scan._BSD_WARRANTY])), "BSD-3-Clause"),
    ("BSD 2-Clause License\n\n" + wrapped("Copyright (c) 2001, X All rights reserved. " + license_scan._BSD_GRANT + " " + license_scan._BSD_WARRANTY), "BSD-2-Clause"),
    ("ISC License\n\nCopyright (c) 2010 Y\n\n" + wrapped(license_scan._ISC), "ISC"),
    (wrapped(license_scan._UNLICENSE), "Unlicense"),
    ("CC0 1.0 Universal\n\nStatement of Purpose", "CC0-1.0"),
    ("This program is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public Licence, version 3.", "GPL-3.0"),
    ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("Distributed under the Mozilla Public License, version 2.0.", "MPL-2.0"),
    ("", None),
    (None, None),
]


#: Texts written after the rules, but for NEAR, which they led to.
LATER = [
    ("This file is part of X. It is licensed under the GNU General Public License v3.0", "GPL-3.0"),
    ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
    ("Apache License 2.0", "Apache-2.0"),
    ("Copyright (c) 2015 Foo. Distributed under the MIT License.", "MIT"),
    ("// SPDX-License-Identifier: 0BSD\nint main() {}", "0BSD"),
    ("Code released under the Apache License, Version 2.0", "Apache-2.0"),
    ("All rights reserved. No license granted.", None),
    ("The GPL version 2 was published in 1991.", None),
    ("Licensed under CC BY 4.0", "CC-BY-4.0"),
    ("GNU GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007\n\nPreamble", "GPL-3.0"),
    ("This documentation is licensed under CC0 1.0", "CC0-1.0"),
    ("This software is licensed under the ISC License.", "ISC"),
    ("Our competitor is licensed under a proprietary license.", None),
    ("/* Licensed under the LGPL, version 2.1 or later. */", "LGPL-2.1"),
    ("The MIT License is short and permissive.", None),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
    ("Mozilla Public License, version 2.0", "MPL-2.0"),
    ("Please read the Apache License, Version 2.0 before contributing.", None),
    ("License: BSD 3-Clause", "BSD-3-Clause"),
    ("Driving license number 2.0", None),
]


@pytest.mark.parametrize(("texts", "recall"), [(LABELLED, 1.0), (LATER, 0.75)])
def test_labelled_sets(spark, texts, recall):
    """Nothing wrong is named; of the licences declared the named part."""
    df = spark.createDataFrame([(i, f"p{i}/f", t) for i, (t, _) in enumerate(texts)], "id long, path string, text string")
    found = {r.id: r.own_license for r in license_scan.scan_licenses(df).collect()}
    judged = [found[i] for i in range(len(texts))]
    wrong = [(text, want, got) for (text, want), got in zip(texts, judged, strict=True) if want != got]
    named = sum(g is not None for g in judged)
    right = sum(g is not None and g == w for (_, w), g in zip(texts, judged, strict=True))
    assert right == named and right >= recall * sum(w is not None for _, w in texts), wrong


def test_the_first_licence_of_a_file_is_its_directorys(spark):
    rows = [(1, "p/LICENSE", "Mozilla Public License Version 2.0\n\nSome text.\n\nReleased under the MIT License."), (2, "p/x.txt", "x"), (3, "q/LICENSE", "Released under the MIT License."), (4, "q/r/s/y", None)]
    found = {r.id: (r.license, r.origin) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert found == {1: ("MPL-2.0", "own"), 2: ("MPL-2.0", "inherited"), 3: ("MIT", "own"), 4: ("MIT", "inherited")}


def test_patterns_read_alike_in_both_engines():
    for pattern in (license_scan.CLAIM, license_scan.CLAUSES, license_scan.TAG, license_scan.DECLARES, license_scan.DOUBTS):
        re.compile(pattern)
        assert "(?=" not in pattern and "(?!" not in pattern and "(?<" not in pattern and "'" not in pattern
