"""Licenses, personal data and secrets."""

import hashlib
import random
import re
import time

from hypothesis import given, settings, strategies as st

from marketlake.llm import licenses, pii, secrets
from marketlake.llm.common import clear_of


def test_license_rules_in_order(spark):
    full = "\n".join(s + "." for s in ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The software is provided \"as is\", without warranty of any kind, express or implied"))
    rows = [
        (1, full), (2, "Text. This work is licensed under the GNU General Public License, version 3.\nMore"), (3, "The software is provided as is, without warranty of any kind, express or implied!"),
        (4, "Released under the MIT License. Released under the MIT License. Licensed under CC BY-NC 4.0."), (5, "no licensed thing"), (6, None), (7, ""),
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MitGrant,MitNotice,AsIs", "MIT", 1, "")
    assert got[2] == ("Gpl3Ref", "GPL-3.0", 1, "") and got[3] == ("AsIs", "", 0, "AsIs")
    assert got[4] == ("MitRef,MitRef,CcByNcRef", "CC-BY-NC-4.0,MIT", 3, "")
    assert got[5] == got[6] == got[7] == ("", "", 0, "")


def test_every_sentence_is_telling_and_normal(spark):
    assert all(any(t in s for t in licenses.TELLING) for s in licenses.SENTENCES)
    frame = spark.createDataFrame([(s,) for s in licenses.SENTENCES], "s string")
    assert all(r[0] == r[1] for r in frame.select("s", licenses.normal(frame["s"])).collect())
    assert {i for _, seq in licenses.RULES for i in seq} <= set(licenses.SENTENCES.values())


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ.@+1 2-3()4.5@b_é\n", max_size=60))
def test_fixed_personal_data(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_pii_query(docs):
    field = pii.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find_pii(docs, field=field).collect():
        base = pii._shown(plain_pii(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r["spans"].split(","))


def test_field_finds_what_the_patterns_miss():
    rng = random.Random(2)

    def card():
        body = "".join(rng.choice("0123456789") for _ in range(15))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    texts = []
    for i in range(150):
        texts.append(f"reach me at user{i}@mail{i}.com or phone +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} soon, host {rng.randint(1, 255)}.{rng.randint(0, 255)}.3.4 up, card {card()} end and ref {rng.randint(10**5, 10**8)} of {'ab12' * rng.randint(3, 9)}")
    examples = pii._examples(texts)
    assert examples
    import numpy as np

    field = pii.Field(np.zeros((pii._WIDTH, 5)), np.zeros((5, 5)))
    before = sum(field.gradient(*e)[2] for e in examples)
    for _ in range(60):
        steps = [field.gradient(*e) for e in examples]
        field.weights += 0.02 * sum(s[0] for s in steps)
        field.follows += 0.02 * sum(s[1] for s in steps)
    assert sum(field.gradient(*e)[2] for e in examples) > before / 4
    found = {pii.KINDS[k]: "call 1 (415) 555-7209 now"[s:e] for s, k, e in field.spans("call 1 (415) 555-7209 now")}
    assert found == {"phone": "1 (415) 555-7209"}


def test_gradient_is_the_slope_of_the_likelihood():
    import numpy as np

    lattice = pii._lattice("tel +1 (487) 555-7209 x", 0, 23)
    gold = pii._gold(lattice, [(4, 3, 21)])
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(0, 0.2, (pii._WIDTH, 5)), rng.normal(0, 0.2, (5, 5)))
    weights, follows, value = field.gradient(lattice, gold)
    for at in ((0, 4), (5, 4), (11, 3), (pii._WIDTH - 3, 0)):
        field.weights[at] += 1e-5
        assert abs((field.gradient(lattice, gold)[2] - value) / 1e-5 - weights[at]) < 1e-2
        field.weights[at] -= 1e-5
    field.follows[0, 4] += 1e-5
    assert abs((field.gradient(lattice, gold)[2] - value) / 1e-5 - follows[0, 4]) < 1e-2


ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", "ApiKey", " ", "=", ":", '"', "'", "abcdef", "0123456789", "AKIA", "ZZZZ9999", "secret", "K", "é", "."]), max_size=14).map("".join))
def test_fixed_secrets(text):
    assert [s[:3] for s in secrets.base_spans(text)] == plain_secrets(text)


def test_ownership_separates_copies_from_live_ones(spark):
    live, shared = "Zx81Qp07Lm55Rt92Vn34", "Ab12Cd34Ef56Gh78Ij90"
    rows = [(1, f"key {live} here", "en", "a"), (2, f"see {shared} x", "en", "a"), (3, f"see {shared} x", "en", "b"), (4, f"token = {shared}", "en", "c"), (5, None, None, None), (6, f"é {live}", "fr", "a"), (6, f"é {live}", "fr", "a")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by_id[1]["spans"] == "owned:4:24" and by_id[6]["spans"] == "owned:2:22" and by_id[6]["most_repositories"] == 2
    assert by_id[2]["spans"] == "" and by_id[2]["n_copied"] == 1 and by_id[3]["n_copied"] == 1
    assert by_id[4]["spans"] == "assign:0:28" and by_id[4]["n_copied"] == 1
    assert by_id[5]["spans"] == "" and by_id[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_secrets_query(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.find_secrets(docs).collect():
        base = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, e, k in sorted(plain_secrets(texts[r["doc_id"]]), key=lambda x: (x[0], x[2])))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_odd_rows(odd, empty, docs):
    for scan in (licenses.scan, secrets.find_secrets, lambda d: pii.find_pii(d, field=pii.Field(None, None))):
        assert scan(odd).count() == 13 and scan(empty).count() == 0
    assert pii.fit(empty).weights is None and pii.find_pii(empty).count() == 0


APACHE = """Copyright 2020 A. N. Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 A. N. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
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
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of Some University, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
GPL_3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL_2 = GPL_3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")


def test_verbatim_wrapped_licenses(spark):
    want = {
        APACHE: ("ApacheRef,ApacheComply,ApacheCopy,ApacheSee", "Apache-2.0"), MIT: ("MitGrant,MitNotice,AsIs", "MIT"),
        BSD_2 + BSD_END: ("BsdPre,BsdSource,BsdBinary", "BSD-2-Clause"), BSD_3 + BSD_END: ("BsdPre,BsdSource,BsdBinary,BsdNotEndorsed", "BSD-3-Clause"),
        ISC: ("IscGrantNotice,Disclaims", "ISC"), GPL_3: ("Gpl3Ref,GplReceived", "GPL-3.0"), GPL_2: ("Gpl2Ref,GplReceived", "GPL-2.0"),
        "SPDX-License-Identifier: MIT": ("SpdxMit", "MIT"), "SPDX-License-Identifier: GPL-2.0-or-later": ("SpdxGPL20", "GPL-2.0"),
    }
    frames = ("", ""), ("// ", ""), ("# ", ""), (" * ", ""), ("    ", ""), ("", "\r")
    rows, expected = [], []
    for text, named in want.items():
        for before, after in frames:
            rows.append((len(rows), "\n".join((before + line).rstrip(" ") + after for line in text.rstrip("\n").split("\n"))))
            expected.append((*named, 1, ""))
        for opened, closed in (("/*\n", " */"), ("/* ", " */"), ("<!-- ", " -->"), ("Words before***\n", "\nwords after")):
            rows.append((len(rows), opened + text.rstrip("\n") + closed))
            expected.append((*named, 1, ""))
    rows += [(len(rows), "It was said that it is not licensed under the MIT license."), (len(rows) + 1, "spdx-license-identifier: mitten")]
    expected += [("", "", 0, "")] * 2
    got = sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r[1:] for r in got] == expected


def test_every_whole_sentence_is_telling_and_normal(spark):
    assert all(any(t in s for t in licenses.TELLING) for s in licenses.WHOLE_SENTENCES)
    frame = spark.createDataFrame([(s,) for s in licenses.WHOLE_SENTENCES], "s string")
    assert all(r[0] == r[1] for r in frame.select("s", licenses.normal(frame["s"])).collect())
    assert {i for _, seq in licenses.WHOLE_RULES for i in seq} <= set((licenses.SENTENCES | licenses.WHOLE_SENTENCES).values())


def test_long_texts_take_linear_time(spark):
    """Each of these took long where a search began anew at every character."""
    run = "a1B2" * 250_000 + " 7"
    began = time.time()
    field = pii.fit(spark.createDataFrame([(f"call +44 20 7946 09{i:02d} or mail a{i}@b.org from 10.0.{i}.1 now",) for i in range(40)], "text string"))
    assert field.weights is not None
    learnt = time.time()
    for text in (run, "12-" * 8_000, "x@" * 8_000, "card 4111111111111111 and 10.0.0.1 " * 1_000):
        field.spans(text), pii.base_spans(text)
    many = "password=abcdef12 " * 50_000
    found = secrets.base_spans(many)
    assert len(found) == 50_000 and secrets.wide_spans(many, found) == []
    rows = [(1, "license" + " " * 200_000 + "x"), (2, "license " + "." * 200_000 + "x"), (3, "license " + "*" * 200_000 + "x"), (4, many), (5, run)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    assert licenses.scan(docs).count() == 5
    licenses.scan(docs).collect(), secrets.find_secrets(docs).collect(), pii.find_pii(docs, field=field).collect()
    assert time.time() - learnt < 90 and learnt - began < 60


def test_field_sees_other_dotted_forms(spark):
    docs = spark.createDataFrame([(f"host 10.0.{i}.7 is up, ask server 192.168.1.{i} at noon",) for i in range(60)], "text string")
    field = pii.fit(docs)
    assert pii._stretches("host 10-0-0-1 up")
    assert ("host 10-0-0-1 up"[5:13], 1) in [("host 10-0-0-1 up"[s:e], k) for s, k, e in field.spans("host 10-0-0-1 up")]


def test_clear_of_spans():
    rng = random.Random(3)
    for _ in range(200):
        taken = [(s, s + rng.randrange(1, 9)) for s in rng.sample(range(60), 6)]
        clear = clear_of(taken)
        for _ in range(20):
            s = rng.randrange(60)
            e = s + rng.randrange(1, 9)
            assert clear(s, e) == (not any(a < e and s < b for a, b in taken))
