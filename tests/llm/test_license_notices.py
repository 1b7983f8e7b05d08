"""Licence notices as they stand in files: wrapped, in comments, with the sentences as published."""

import random
import textwrap

import pytest

from tidewater.llm import license_scan

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD2 = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
NOTICES = [(MIT, "MIT", "17,3"), (APACHE, "Apache-2.0", "18"), (GPL, "GPL-3.0-or-later", "7,8"), (BSD2, "BSD-2-Clause", "12,13,22,23"), (BSD3, "BSD-3-Clause", "12,13,22,23,14"), (MPL, "MPL-2.0", "16,30")]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "\r"])
def test_wrapped_notices(spark, mark):
    texts = ["some code\n" + "".join(mark.strip(" \r") and f"{mark}{x}\n" or f"{x}{mark}\n" for x in n.splitlines()) + "\nmore" for n, *_ in NOTICES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.sentence_ids) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {i: (name, ids) for i, (_, name, ids) in enumerate(NOTICES)}


def follows(ids, rule):
    it = iter(ids)
    return all(i in it for i in rule)


def test_every_rule_on_wrapped_sentences(spark):
    """Each rule's sentences, wrapped at random behind comment marks, between other sentences, against a plain reading of the rules."""
    r, texts, want = random.Random(3), [], []
    for _, ids in license_scan.RULES:
        for mark in ("", "# ", "; ", "/// "):
            lines = []
            for i in ids:
                lines += [*textwrap.wrap(license_scan.SENTENCES[i], r.randint(30, 90), break_long_words=False), ""]
                lines += r.choice([[], ["Something else stands here, of no known form.", ""]])
            texts.append("A file of some kind.\n\n" + "\n".join(mark + x for x in lines) + "\nint main();")
            want.append((next(n for n, rule in license_scan.RULES if follows(ids, rule)), ",".join(map(str, ids))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.license, x.sentence_ids) for x in license_scan.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_edges(spark):
    texts = ["Copyright X\nAll rights reserved\nCall me", "All rights\n\nreserved.", "Not all rights reserved.", " all ~ rights | reserved "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in license_scan.scan_licenses(docs).collect()}
    assert got == {0: "12", 1: "", 2: "", 3: "12"}


def test_signs_are_in_every_sentence():
    import re

    assert all(re.search(license_scan.SIGNS, license_scan.normal_form(s)) for s in license_scan.SENTENCES.values())
