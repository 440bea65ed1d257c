"""Each rule on the notice it stands for, as published."""

from helpers import docs

from plansmith.llm import license_scan

NOTICES = {
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT DAMAGES.
""",
}
_BSD = NOTICES["BSD-2-Clause"].split("THIS SOFTWARE")
NOTICES["BSD-3-Clause"] = f"""Copyright (c) 2020, A. Author
All rights reserved.

{_BSD[0]}3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE{_BSD[1]}"""
NOTICES["ISC"] = """Copyright (c) 2020, A. Author

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
NOTICES["LGPL-2.1-or-later"] = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
NOTICES["LGPL-3.0-or-later"] = NOTICES["GPL-3.0-or-later"].replace("GNU General", "GNU Lesser General")
NOTICES["AGPL-3.0-or-later"] = NOTICES["GPL-3.0-or-later"].replace("GNU General", "GNU Affero General")
NOTICES["EPL-2.0"] = """This program and the accompanying materials
are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""
NOTICES["Unlicense"] = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
NOTICES["CC0-1.0"] = """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.
"""
GPL2 = NOTICES["GPL-3.0-or-later"].replace("software:", "software;").replace("version 3", "version 2")
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
LINES = {
    "Apache-2.0": "Released under the Apache License, Version 2.0.", "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "Licensed under the GNU General Public License, version 2.", "CC-BY-NC-4.0": "This work is licensed under CC BY-NC 4.0.", "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.", "Public-Domain": "This work is dedicated to the public domain.", "MIT": "Released under the MIT License.",
}


def test_notices(spark):
    commented = "".join(f"# {line}".rstrip() + "\n" for line in NOTICES["Apache-2.0"].splitlines())
    starred = "".join(f" * {line}".rstrip() + "\n" for line in NOTICES["BSD-2-Clause"].splitlines())
    cases = [*NOTICES.items(), ("GPL-2.0-or-later", GPL2), ("MIT", MIT), *LINES.items(), ("Apache-2.0", commented)]
    texts = [f"Some words first.\n\n{t}\nMore words." for _, t in cases]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, [*texts, starred])).collect()}
    for i, (name, t) in enumerate(cases):
        assert (got[i].licenses, got[i].n_unruled) == (name, 0), (name, got[i].sentence_ids)
    assert "<bsd-source>" in got[len(cases)].sentence_ids and {name for name, _ in license_scan.RULES} - {"MIT-partial"} == {name for name, _ in cases}


def test_known_sentences_stay_whole():
    import re

    assert [s for group in license_scan.SENTENCES.values() for s in group if re.search(license_scan.BREAK, s)] == []


def test_gpl2_as_published(spark):
    """Version 2's own notice has a semicolon before the version, too."""
    text = GPL2.replace("Foundation, either", "Foundation; either")
    assert license_scan.scan_licenses(docs(spark, [text])).first().licenses == "GPL-2.0-or-later"


def test_known_sentences_come_through_the_cuts():
    for sentence in license_scan._ID:
        assert license_scan.pieces(f"Before. {sentence.capitalize()}. After") == ["before", sentence, "after"]
