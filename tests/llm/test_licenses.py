from crewmetrics.llm import licenses as L

DOCS = "doc_id long, text string, s string"
MIT = """# Copyright (c) 2020 Someone
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
#
# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
# IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
# FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
LIABLE = """ In no event shall the
authors or copyright holders be liable for any claim, damages or other
liability, whether in an action of contract, tort or otherwise, arising from,
out of or in connection with the software or the use or other dealings in the software."""


def scan(spark, *texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return [tuple(r)[1:] for r in sorted(L.scan(spark.createDataFrame(rows, DOCS)).collect())]


def test_sentences_and_rules(spark):
    got = scan(
        spark,
        "Some prose | here\nReleased under the MIT License.\nmore",
        "A.\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
        "The licence of this is unclear. Really.",
        "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT\n",
        None,
        "",
        "nothing",
    )
    assert got == [
        ("mit", "MIT", 1, 0),
        ("apache2,apacheUse", "Apache-2.0", 2, 0),
        ("gpl3,ccByNc4", "GPL-3.0-only,CC-BY-NC-4.0", 2, 0),
        ("", "", 0, 1),
        ("mit,mit,mit", "MIT,MIT,MIT", 3, 0),
        ("", "", 0, 0),
        ("", "", 0, 0),
        ("", "", 0, 0),
    ]


def test_a_long_text_is_one_licence_and_a_cut_one_none(spark):
    got = scan(spark, MIT + LIABLE, MIT, "mit license\n" + MIT.replace("# ", "") + LIABLE)
    assert got[0] == ("mitGrant,mitNotice,mitWarranty,mitLiable", "MIT", 4, 0)
    assert got[1][1] == ""
    assert got[2][:2] == ("mit,mitGrant,mitNotice,mitWarranty,mitLiable", "MIT")


def test_every_known_sentence_has_a_needed_word_and_a_rule():
    import re

    assert all(re.search(L.NEEDED, s) for s in L.SENTENCES)
    assert {i.rstrip("*") for _, rule in L.RULES for i in rule.split()} == set(L.SENTENCES.values())


def test_long_and_repeated_rows(spark):
    text = "word " * 200_000 + ".\nMIT License\n"
    df = spark.createDataFrame([(1, text, None), (1, text, None), (None, text, None)], DOCS)
    assert [r.licenses for r in L.scan(df).collect()] == ["MIT"] * 3
    assert L.scan(df.limit(0)).collect() == []


GPL = """# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{1} either version {2} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License along
# with this program"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""


def test_verbatim_headers(spark):
    two = GPL.format(";", ";", 2) + "; if not, write to the Free Software\n# Foundation, Inc., 51 Franklin Street, Boston, MA 02110-1301 USA."
    three = GPL.format(":", ",", 3) + ".  If not, see <https://www.gnu.org/licenses/>."
    got = scan(spark, two, three, MPL, APACHE)
    assert got[0][:2] == ("gpl2Later,gnuWarranty,gplSee,gplCopy", "GPL-2.0-or-later")
    assert got[1][:2] == ("gpl3Later,gnuWarranty,gplSee,gplCopy", "GPL-3.0-or-later")
    assert got[2][:2] == ("mpl2", "MPL-2.0")
    assert got[3][:2] == ("apache2,apacheUse,apacheCopy,apacheWarranty,apacheSee", "Apache-2.0")


MIT_VERBATIM = MIT.replace("# ", "").replace("#", "") + """ IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def headers():
    two = GPL.format(";", ";", 2) + "; if not, write to the Free Software\n# Foundation, Inc., 51 Franklin Street, Boston, MA 02110-1301 USA."
    texts = {"MIT": MIT_VERBATIM, "BSD-2-Clause": BSD, "GPL-2.0-or-later": two.replace("# ", "").replace("#", ""), "Apache-2.0": APACHE}
    forms = []
    for name, text in texts.items():
        lines = [line.strip() for line in text.strip().split("\n")]
        forms += [(name, text), (name, "\n".join(f" * {line}" for line in lines)), (name, "\r\n".join(lines))]
        forms += [(name, " ".join(line for line in lines if line))] if name != "Apache-2.0" else []  # an address ends a sentence there
    forms += [("MIT", "MIT License\n\n" + MIT_VERBATIM), ("MPL-2.0", MPL)]
    return forms


def test_verbatim_texts_in_every_form(spark):
    got = scan(spark, *(text for _, text in headers()))
    assert [g[1] for g in got] == [name for name, _ in headers()]


def test_verbatim_texts_equal_the_sql(spark):
    import duckdb
    import pandas as pd

    texts = [text for _, text in headers()] + [None, "", MIT, "Some prose\nReleased under the MIT License.\nmore"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert sorted(con.execute(L.oracle()).fetchall()) == [(i, *row) for i, row in enumerate(scan(spark, *texts))]
    assert con.execute(f"select count(*) from ({L.oracle()}) where licenses <> ''").fetchone()[0] == len(headers()) + 1
