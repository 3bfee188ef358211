"""Licence recognition by sentence rules.

A text is cut into sentences, which are normalised (lower case, letters and
digits only) and looked up in a table of known licence sentences. The resulting
sequence of identifiers is matched against rules in order: a rule that is found
names a licence and consumes its sentences. Everything happens inside a row, by
higher-order functions; texts without any of the trigger words are not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of public licences, by identifier. A sentence may span any number of lines.
SENTENCES = {
    "apache2-line": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "This project is licensed under the Apache License, Version 2.0", "Apache License, Version 2.0", "Released under the Apache License 2.0", "Distributed under the Apache License, Version 2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the License"],
    "apache2-obtain": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-line": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License (MIT)", "MIT License", "Distributed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-line": ["Licensed under the BSD License", "Licensed under the BSD 3-Clause License", "Released under the BSD License", "BSD 3-Clause License"],
    "bsd2-line": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "gpl2-line": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Licensed under the GPL version 2"],
    "gpl3-line": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GPL version 3", "GNU General Public License v3.0"],
    "gpl-free2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-free3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "lgpl-line": ["Licensed under the GNU Lesser General Public License, version 2.1", "Licensed under the GNU Lesser General Public License, version 3"],
    "agpl-line": ["Licensed under the GNU Affero General Public License, version 3"],
    "mpl2-line": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "cc0-line": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Licensed under CC0 1.0", "Released under CC0 1.0"],
    "ccby-line": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ccbysa-line": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "ccbync-line": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "ccbynd-line": ["Licensed under CC BY-ND 4.0"],
    "unlicense-line": ["This is free and unencumbered software released into the public domain"],
    "proprietary-line": ["All rights reserved"],
    "spdx-apache2": ["SPDX-License-Identifier: Apache-2.0"],
    "spdx-mit": ["SPDX-License-Identifier: MIT"],
    "spdx-bsd2": ["SPDX-License-Identifier: BSD-2-Clause"],
    "spdx-bsd3": ["SPDX-License-Identifier: BSD-3-Clause"],
    "spdx-gpl2": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "spdx-gpl3": ["SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0"],
    "spdx-mpl2": ["SPDX-License-Identifier: MPL-2.0"],
}

# Ordered rules, the more specific first: licence and the identifiers that follow each other.
RULES = [
    ("Apache-2.0", ["apache2-line", "apache2-comply", "apache2-obtain", "apache2-asis", "apache2-see"]),
    ("MIT", ["mit-line", "mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl-free2", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free3", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-free2"]),
    ("GPL-3.0-or-later", ["gpl-free3"]),
    ("MPL-2.0", ["mpl2-line", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-line"]),
    ("MPL-2.0", ["spdx-mpl2"]),
    ("Apache-2.0", ["apache2-line"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["spdx-mit"]),
    ("BSD-3-Clause", ["bsd-line"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("BSD-2-Clause", ["bsd2-line"]),
    ("BSD-2-Clause", ["spdx-bsd2"]),
    ("ISC", ["isc-grant"]),
    ("GPL-2.0-only", ["gpl2-line"]),
    ("GPL-2.0-only", ["spdx-gpl2"]),
    ("GPL-3.0-only", ["gpl3-line"]),
    ("GPL-3.0-only", ["spdx-gpl3"]),
    ("LGPL", ["lgpl-line"]),
    ("AGPL-3.0-only", ["agpl-line"]),
    ("CC0-1.0", ["cc0-line"]),
    ("CC-BY-4.0", ["ccby-line"]),
    ("CC-BY-SA-4.0", ["ccbysa-line"]),
    ("CC-BY-NC-4.0", ["ccbync-line"]),
    ("CC-BY-ND-4.0", ["ccbynd-line"]),
    ("Unlicense", ["unlicense-line"]),
    ("LicenseRef-Proprietary", ["proprietary-line"]),
]

#: Each known sentence holds one of these; single words, so that line breaks and signs between words do not matter.
TRIGGERS = ("licen", "permi", "redistribut", "copyright", "software", "reserved", "mozilla", "merchantability", "cc0")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _rows() -> list[tuple[str, str]]:
    """Normalised sentences and their identifiers, the longest first."""
    rows = [(" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()), i) for i, group in SENTENCES.items() for s in group]
    return sorted(rows, key=lambda r: -len(r[0]))


def _known() -> Column:
    return F.array(*(F.struct(F.lit(s).alias("s"), F.lit(i).alias("i")) for s, i in _rows()))


def triggered(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for word in TRIGGERS:
        out = out | F.contains(low, F.lit(word))
    return F.coalesce(out, F.lit(False))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, by place; a sentence may run over several lines."""
    cut = F.split(F.regexp_replace(text, r"([.!?;])\s+", "$1\n"), "\n+", -1)
    pieces = F.filter(F.transform(cut, normal), lambda x: x != "")

    most = max(len(s.split()) for s, _ in _rows())  # a piece has a word at least, so no sentence spans more pieces

    def look(p: Column) -> Column:
        n = F.size(p)
        join = lambda i, k: F.array_join(F.slice(p, i + 1, k), " ")

        def longest(i: Column) -> Column:
            def ended(found: Column) -> Column:
                """The longest of the sentences that the text goes on with, if it ends where a piece ends."""
                ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n - i)), lambda k: F.length(join(i, k)))
                return F.when(F.size(found) > 0, _let(ends, lambda e: F.get(F.filter(found, lambda k: F.array_contains(e, F.length(k["s"]))), 0)["i"]))

            def begun(found: Column) -> Column:
                """Most pieces begin no sentence; of those that do, all that follows is compared."""
                follows = F.concat(join(i, F.lit(most)), F.lit(" "))
                return F.when(F.size(found) > 0, _let(_let(follows, lambda t: F.filter(found, lambda k: F.startswith(t, F.concat(k["s"], F.lit(" "))))), ended))

            first = F.concat(F.get(p, i), F.lit(" "))
            return _let(_let(first, lambda t: F.filter(_known(), lambda k: F.startswith(F.concat(k["s"], F.lit(" ")), t))), begun)

        # of the sentences that start at a place, the longest counts
        ids = F.transform(F.sequence(F.lit(0), n - 1), longest)
        return F.when(n > 0, F.array_compact(ids)).otherwise(F.array().cast("array<string>"))

    return F.when(triggered(text), _let(pieces, look)).otherwise(F.array().cast("array<string>"))


def licences_of(ids: Column) -> Column:
    """Licences of a sequence of identifiers: rules in order, each consuming what it matches."""
    rules = F.array(*(F.struct(F.lit("," + ",,".join(seq) + ",").alias("seq"), F.lit(name).alias("name")) for name, seq in RULES))
    first = F.struct(F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["seq"])
        return F.struct(F.when(hit, F.replace(state["left"], rule["seq"], F.lit(";"))).otherwise(state["left"]).alias("left"), F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.aggregate(rules, first, step)["found"]))


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, sentence_ids (in order of place) and licences (in order of the rules).

    Null and empty texts have none. Row by row: no shuffle, so no skew; repeated
    rows and null ids stay; other columns are not read.
    """
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("sentence_ids"))
    return found.select("doc_id", "sentence_ids", licences_of(F.col("sentence_ids")).alias("licences"))
