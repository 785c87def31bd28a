import textwrap

import pytest

from shareflow.llm.licenses import RULES, SPDX, license_scan

APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
]
GPL = [
    "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
LESSER = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
]
#: For each of RULES, the licence's own wording in paragraphs.
CANONICAL = [
    ["Licensed under the Apache License, Version 2.0."],
    APACHE[:1],
    APACHE,
    ["Released under the MIT License."],
    ["Licensed under the MIT License."],
    MIT[:2],
    MIT,
    ["This work is licensed under the GNU General Public License, version 3."],
    [GPL[0].format(":", 3), GPL[1]],
    [GPL[0].format(";", 2), GPL[1]],
    BSD[:3],
    BSD,
    ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    ["Licensed under CC BY-NC 4.0."],
    ["Licensed under CC BY-SA 4.0."],
    ["Licensed under CC BY 4.0."],
    ["This work is dedicated to the public domain under CC0 1.0."],
    ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    ["This is free and unencumbered software released into the public domain."],
    UNLICENSE,
    [*MIT, 'IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    [*BSD[:3], DISCLAIMER],
    [*BSD, DISCLAIMER],
    [LESSER.format("library", "2.1"), GPL[1].replace("program", "library").replace("General", "Lesser General")],
    [LESSER.format("program", "3"), GPL[1].replace("General", "Lesser General")],
    [LESSER.format("program", "3").replace("Lesser", "Affero"), GPL[1].replace("General", "Affero General")],
    ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    ["Distributed under the Boost Software License, Version 1.0."],
    ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    ["Licensed under the Artistic License 2.0."],
    *([f"This work is licensed under a Creative Commons Attribution{x} 4.0 International License."] for x in ("", "-ShareAlike", "-NonCommercial", "-NoDerivatives")),
]
ONLY = [GPL[0].format(":", 2).replace("; either version 2 of the License, or (at your option) any later version", x).replace("License as", f"License{y} as") for x, y in (("", " version 2"), (", version 2", ""), (", version 2 of the License", ""))]
CANONICAL += [*([x, GPL[1]] for x in ONLY), *([f"SPDX-License-Identifier: {x}"] for x in SPDX)]


def scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, license_scan(df).collect()), key=str)


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_every_rule_matches_its_licence_wrapped_at_72_columns(spark, prefix):
    rows = []
    for k, paragraphs in enumerate(CANONICAL):
        lines = [line for p in paragraphs for part in p.split("\n\n") for line in [*textwrap.wrap(part, 72 - len(prefix)), ""]]
        rows.append((k, "\n".join(["Copyright A. Holder", "", *lines, "int main;"]) if not prefix else "\n".join(prefix + x for x in lines)))
    got = scan(spark, rows)
    assert sorted((i, licence, rule) for i, licence, rule, _, _ in got) == [(k, licence, k) for k, (licence, _) in enumerate(RULES)]


def test_places_gaps_and_borders(spark):
    short = "Released under the MIT License."
    rows = [
        (1, f"{short} {short}\n--\nReleased under\nthe MIT License"),
        (2, "Unreleased under the MIT License. Released under the MIT Licenses. Released under. x. the MIT License"),
        (3, f"a. 1. {short}"),
        (4, "\n".join([BSD[0], BSD[1], "2. Something else.", BSD[2]])),
        (5, None),
        (6, ""),
        (3, f"a. 1. {short}"),
        (None, short),
    ]
    assert scan(spark, rows) == sorted([(1, "MIT", 3, 0, 1), (1, "MIT", 3, 1, 1), (1, "MIT", 3, 2, 2), (3, "MIT", 3, 2, 1), (None, "MIT", 3, 0, 1)], key=str)
    assert scan(spark, []) == []


def test_texts_of_one_id_are_looked_at_one_by_one(spark):
    half = [(None, MIT[0]), (None, MIT[1]), (7, MIT[0]), (7, "\n".join(MIT[1:])), (8, "\n".join(MIT[:2])), (8, "\n".join(MIT))]
    # of the two texts of 8, the match of the first isn't hidden by the longer one of the second
    assert scan(spark, half) == [(8, "MIT", 5, 0, 2), (8, "MIT", 6, 0, 3)]


def test_names_notices_and_identifiers(spark):
    three = lambda name: "\n".join([*BSD[:3], BSD[3].replace("the copyright holder", name)])
    rows = [
        (1, three("Google Inc.")), (2, three("the University of California, Berkeley")), (3, textwrap.fill(three("Example Labs GmbH and Co"), 40)),
        (4, "\n".join([*BSD[:3], "3. Neither the name of the author may be used in any way."])),
        (5, "SPDX-License-Identifier: MIT"), (6, "/* SPDX-License-Identifier: Apache-2.0 OR MIT */"), (7, "// SPDX-License-Identifier: MIT-0"), (8, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"), (9, "SPDX-License-Identifier: NOT-KNOWN"),
        (10, "This project is licensed under the MIT License"), (11, "Licensed under the MIT License (see LICENSE)."), (12, "<p>Released under the MIT License</p>"), (13, "unlicensed under the MIT License"),
        (14, "\n".join([ONLY[0], GPL[1]])), (15, "\n".join(BSD[:3]) + "\nint main;"),
    ]
    got = {}
    for doc_id, licence, *_ in scan(spark, rows):
        got.setdefault(doc_id, set()).add(licence)
    bsd3 = {"BSD-3-Clause"}
    assert got == {1: bsd3, 2: bsd3, 3: bsd3, 5: {"MIT"}, 6: {"Apache-2.0", "MIT"}, 7: {"MIT-0"}, 8: {"GPL-2.0-only"}, 10: {"MIT"}, 11: {"MIT"}, 12: {"MIT"}, 14: {"GPL-2.0"}, 15: {"BSD-2-Clause"}}


def test_repeated_notices_in_a_very_long_text(spark):
    import time

    took = []
    for n in (500, 8000):
        began = time.time()
        assert len(scan(spark, [(1, "Released under the MIT License.\nsome other line here\n" * n)])) == n
        took.append(time.time() - began)
    assert took[1] < 16 * max(took[0], 1)
