"""Licence scans by sentence rules: DataFrame operations only, one pass, no shuffle.

A text is normalised (ASCII lower case, runs of other characters to one space) with marks where sentences, paragraphs
and lines end. A known licence sentence is found where its words stand between two marks; it may be wrapped over lines,
with comment marks, but not over a blank line. The identifiers, in the text's order, form a sequence such as ``,7,9,``. A
licence rule is an ordered list of identifiers with free sentences between them; the rules are tried in their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, as published, some of them also shortened (2, 4, 5).
SENTENCES = {
    1: "Released under the MIT License.",
    2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    3: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    4: "Licensed under the Apache License, Version 2.0.",
    5: "You may not use this file except in compliance with the License.",
    6: "This work is licensed under the GNU General Public License, version 3.",
    7: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    8: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    9: "Licensed under CC BY-NC 4.0.",
    10: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    11: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    12: "All rights reserved.",
    13: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    14: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    15: "This work is dedicated to the public domain.",
    16: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    17: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    18: 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    19: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    20: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    21: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    22: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    23: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    24: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    25: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    26: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    27: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    28: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    29: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    30: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    31: 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    32: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    33: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    34: 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    35: "This is free and unencumbered software released into the public domain.",
    36: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    37: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    38: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    39: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    40: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    41: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    42: "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    43: "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    44: "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    45: "This work is free.",
    46: "You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
    47: "This software is provided 'as-is', without any express or implied warranty.",
    48: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    49: "Distributed under the Boost Software License, Version 1.0.",
    50: 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    51: "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    52: "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
    53: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    54: "As long as you retain this notice you can do whatever you want with this stuff.",
    55: "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    56: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.",
    57: "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    58: "Licensed under the MIT license.",
    59: "This project is licensed under the MIT License.",
    60: "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    61: "Licensed under the GNU Affero General Public License, version 3.",
    62: "Licensed under CC BY 4.0.",
    63: "Licensed under CC BY-SA 4.0.",
    64: 'Use of this software is governed by the Business Source License included in the LICENSE file.',
}
#: Ordered rules: (licence, sentence identifiers in their order). The first that matches names the document's licence.
RULES = [
    ("BSD-4-Clause", (13, 24)),
    ("NCSA", (17, 56)),
    ("BSD-3-Clause", (13, 14)),
    ("BSD-2-Clause", (13, 22, 23)),
    ("BSD-1-Clause", (13, 22)),
    ("BSD-2-Clause", (13,)),
    ("X11", (17, 3, 57)),
    ("MIT", (17, 3)),
    ("MIT", (2, 3)),
    ("MIT", (1,)),
    ("MIT", (58,)),
    ("MIT", (59,)),
    ("MIT-0", (19,)),
    ("ISC", (20,)),
    ("0BSD", (21,)),
    ("Apache-2.0", (18,)),
    ("Apache-2.0", (4, 5)),
    ("Apache-2.0", (4,)),
    ("GPL-3.0-or-later", (7, 8)),
    ("GPL-3.0-or-later", (7,)),
    ("GPL-3.0", (6,)),
    ("GPL-2.0-or-later", (25,)),
    ("GPL-2.0-only", (26,)),
    ("AGPL-3.0-or-later", (27,)),
    ("AGPL-3.0", (61,)),
    ("LGPL-2.1-or-later", (28,)),
    ("LGPL-3.0-or-later", (29,)),
    ("MPL-2.0", (16, 30)),
    ("MPL-2.0", (16,)),
    ("MPL-1.1", (31,)),
    ("EPL-1.0", (32,)),
    ("EPL-2.0", (33,)),
    ("CDDL-1.0", (34,)),
    ("Unlicense", (35, 36)),
    ("Unlicense", (35,)),
    ("CC0-1.0", (37,)),
    ("CC0-1.0", (38,)),
    ("CC-BY-NC-4.0", (9,)),
    ("CC-BY-NC-4.0", (10,)),
    ("CC-BY-4.0", (11,)),
    ("CC-BY-4.0", (62,)),
    ("CC-BY-SA-4.0", (39,)),
    ("CC-BY-SA-4.0", (63,)),
    ("CC-BY-ND-4.0", (40,)),
    ("CC-BY-NC-SA-4.0", (41,)),
    ("CC-BY-NC-ND-4.0", (42,)),
    ("CC-BY-3.0", (43,)),
    ("CC-BY-SA-3.0", (44,)),
    ("WTFPL", (45, 46)),
    ("Zlib", (47, 48)),
    ("BSL-1.0", (50,)),
    ("BSL-1.0", (49,)),
    ("OFL-1.1", (51,)),
    ("EUPL-1.2", (52,)),
    ("PostgreSQL", (53,)),
    ("Beerware", (54,)),
    ("Artistic-2.0", (55,)),
    ("BUSL-1.1", (64,)),
    ("BSD-style", (60,)),
    ("Public-Domain", (15,)),
    ("All-Rights-Reserved", (12,)),
]
#: Each known sentence has one of these; texts without them are not normalised.
SIGNS = "licens|licenc|permission|copyright|warranty|reserved|redistribution|domain|work is free|this notice|advertising materials|anyone is free|mpl was"


def normal_form(sentence: str) -> str:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in low).split())


def pattern(ids: tuple) -> str:
    """A rule as a regular expression over a sequence ``,a,b,``."""
    return "," + ",([0-9]+,)*".join(map(str, ids)) + ","


def wrapped(sentence: str) -> str:
    """A regular expression for a sentence in a marked text: lines (``~``) may end between its words, and sentences (``|``) where it has such an end itself, as in ``v. 2.0``."""
    parts = [normal_form(x).replace(" ", "[ ~]") for x in re.split(r"[.!?]\s+", sentence)]
    return "[ ~|]".join(parts)


def marked(low):
    """Lower-case text with ``|`` where a sentence or paragraph ends, ``~`` at other line ends, and else one space between words."""
    text = F.translate(low, "|~", "  ")
    text = F.regexp_replace(text, r"[.!?][ \t\r\x0B\f\n]+", "|")
    text = F.regexp_replace(text, r"\n[^a-z0-9|]*\n", "|")
    text = F.regexp_replace(F.translate(text, "\n", "~"), "[^a-z0-9|~]+", " ")
    text = F.regexp_replace(text, r"[ ~]*\|[ ~|]*", "|")
    return F.trim(F.regexp_replace(text, " ?~[ ~]*", "~"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: the id, n_license_sentences, sentence_ids (``,`` joined, in order), license, licenses.

    ``license`` is that of the first rule that matches, null if none; ``licenses`` all that match, by rule order, joined
    by ``|``. Null and empty texts have no sentences. Sentences begin and end at a line end, at a blank line, or at ``.``,
    ``!`` or ``?`` before white space; known ones may go on over line ends, the longest of one beginning counting. Other
    columns are ignored, and repeated rows give repeated results.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(low.rlike(SIGNS), marked(low)).otherwise("")
    sentences = "|".join(wrapped(s) for s in sorted(SENTENCES.values(), key=lambda s: -len(normal_form(s))))
    hits = F.regexp_extract_all(text, F.lit(f"(?<![^|~])({sentences})(?![^|~])"), F.lit(1))
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (normal_form(s), i)])
    found = docs.select(F.col(id_col), F.transform(hits, lambda x: F.try_element_at(known, F.translate(x, "~|", "  "))).alias("ids"))
    found = found.withColumn("line", F.concat(F.lit(","), F.array_join(F.col("ids").cast("array<string>"), ","), F.lit(",")))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("line").rlike(pattern(ids)), F.lit(name)) for name, ids in RULES])))
    found = found.withColumn("hits", hits)
    return found.select(
        id_col,
        F.size("ids").cast("long").alias("n_license_sentences"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("sentence_ids"),
        F.when(F.size("hits") > 0, F.col("hits")[0]).alias("license"),
        F.array_join("hits", "|").alias("licenses"),
    )


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    cases = ", ".join(f"CASE WHEN regexp_matches(line, '{pattern(ids)}') THEN {i} END" for i, (_, ids) in enumerate(RULES))
    names = "[" + ", ".join(f"'{n}'" for n, _ in RULES) + "]"
    known = " UNION ALL ".join(f"SELECT '{normal_form(s)}' AS s, {i} AS id" for i, s in SENTENCES.items())
    return f"""
WITH known AS ({known}),
lines AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([.!?])[ \\t\\r\\x0B\\f]+', E'\\\\1\\n', 'g'), E'\\n') AS l FROM {table}),
each AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS k FROM lines),
plain AS (SELECT doc_id, k, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS s FROM each),
seq AS (SELECT doc_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS ids FROM plain JOIN known USING (s) GROUP BY doc_id),
per AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, ',' || coalesce(ids, '') || ',' AS line FROM {table} d LEFT JOIN seq USING (doc_id)),
hit AS (SELECT *, list_transform(list_filter([{cases}], lambda x: x IS NOT NULL), lambda x: {names}[x + 1]) AS h FROM per),
uniq AS (SELECT *, list_filter(h, lambda x, i: NOT list_contains(h[1:i - 1], x)) AS u FROM hit)
SELECT doc_id, CAST(n AS BIGINT) AS n_license_sentences, ids AS sentence_ids, u[1] AS license, array_to_string(u, '|') AS licenses FROM uniq"""
