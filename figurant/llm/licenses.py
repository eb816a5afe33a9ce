"""Licence scans by sentence rules.

A text is cut into sentences twice, at line ends and across them; each sentence is normalised
and looked up among known licence sentences. The identifiers found, in the order of the text,
are matched against ordered rules, each a sequence of identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from figurant.llm.stages import arrow_map

#: Sentences of licence texts and headers, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "epl-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}
#: How licences are named in one-line notices.
NAMES = {
    "MIT": ("MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD license"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "ISC": ("ISC License",),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense",),
}
#: Further identifiers of SPDX expressions, and exceptions.
SPDX = ("0BSD", "Artistic-2.0", "CC-BY-3.0", "CC-BY-SA-3.0", "EPL-1.0", "EUPL-1.2", "LGPL-2.0", "MIT-0", "MPL-1.1", "OFL-1.1", "PostgreSQL", "Python-2.0", "WTFPL", "AGPL-1.0", "GPL-1.0")
EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "Bison-exception-2.2")
VERBS = ("licensed", "released", "distributed", "available", "published", "made available")
SUBJECTS = ("", "this work is ", "this software is ", "this project is ", "this document is ", "this file is ", "the code is ", "this text is ", "this content is ")


def spdx_names() -> list[str]:
    """Licences that an SPDX expression may name; GNU licences also as "or later"."""
    names = [*NAMES, *SPDX]
    return names + [f"{n}-or-later" for n in names if "GPL" in n]


#: Rules in the order in which they are tried; those of more sentences come before their parts.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-grant", "apache-copy")),
    ("Apache-2.0", ("apache-grant",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-grant",)),
    ("Unlicense", ("unlicense-grant",)),
    ("MIT", ("mit-grant",)),
    ("GPL-2.0", ("gpl2-only", "gpl-hope")),
    ("GPL-2.0", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("EPL-2.0", ("epl-grant",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    *((name, (f"notice-{name}",)) for name in NAMES),
    *((f"{name} WITH {e}", (f"spdx-{name}", f"spdx-with-{e}")) for name in spdx_names() for e in EXCEPTIONS),
    *((name, (f"spdx-{name}",)) for name in spdx_names()),
]
#: Each known sentence holds one of these, so texts without any have no licence sentence.
ANCHORS = ("licen", "copyright", "permission", "redistribut", "free software", "unencumbered", "warranty", "cc by", "cc0", "gplv", "under", "copy of the mpl", "free to copy", "the author disclaims", "as is", "spdx")

_STOP = r"(?:(?<=[.!?])|(?<=conditions:)|(?<=are met:))[\"')\]]*\s+"
_END = re.compile(_STOP + r"|\n[ \t#*/;-]*\n")
_LINE = re.compile(_STOP + r"|\n")
_NOISE = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
#: What may stand behind the name in a notice ("- see the LICENSE file for details").
_SEE = re.compile(r" (?:see|read) (?:the )?(?:(?:licen[sc]e|copying)(?: md| txt)? ?){1,2}(?:file )?for (?:more |further )?(?:details|information)$")
#: An SPDX expression up to the end of its line or comment, and its parts.
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)")
_OPERAND = re.compile(r"[A-Za-z0-9.+-]+")


def normalise(sentence: str) -> str:
    """Lower case, with one space for each run of anything but letters and digits; a leading
    item number goes."""
    out = _NOISE.sub(" ", sentence.lower()).strip()
    return re.sub(r"^(?:\d{1,2}|[a-c]) (?=redistributions |neither )", "", out)


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: the texts above, and notices from the grammar
    subject, verb, "under", name. A sentence with a stop within it ("v. 2.0") is also known by
    what comes before that stop; ``tails`` has what must follow."""
    out = {normalise(s): i for i, s in SENTENCES.items()}
    out |= {normalise(s[: m.start()]): i for i, s in SENTENCES.items() if (m := re.search(_STOP, s))}
    for name, spelled in NAMES.items():
        for n in (normalise(x) for x in spelled):
            for verb in VERBS:
                for subject in SUBJECTS:
                    for the in ("", "the ", "a "):
                        out[f"{subject}{verb} under {the}{n}"] = out[f"{subject}{verb} under the terms of {the}{n}"] = f"notice-{name}"
    return out


def operands() -> dict[str, str]:
    """Identifier of each operand of an SPDX expression, in lower case: "+" is "-or-later", and
    "-only" goes without saying."""
    out = {name.lower(): f"spdx-{name}" for name in spdx_names()}
    out |= {f"{name.lower()}-only": f"spdx-{name}" for name in spdx_names() if "GPL" in name and not name.endswith("later")}
    return out | {f"{name.removesuffix('-or-later').lower()}+": f"spdx-{name}" for name in spdx_names() if name.endswith("-or-later")}


def tails() -> dict[str, re.Pattern]:
    """What must follow the first part of a known sentence, by that part."""
    out = {}
    for s in SENTENCES.values():
        if m := re.search(_STOP, s):
            words = normalise(s[m.end() :]).split(" ")
            out[normalise(s[: m.start()])] = re.compile(r"[\W_]*" + r"[\W_]+".join(map(re.escape, words)) + r"\b(?!\.\d)", re.IGNORECASE)
    return out


def spans(text: str, cut: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for m in cut.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


class Scanner:
    def __init__(self):
        self.known, self.tails = known_sentences(), tails()
        self.operands, self.exceptions = operands(), {e.lower(): f"spdx-with-{e}" for e in EXCEPTIONS}
        self.longest = max(map(len, self.known)) + 80  # and what _SEE may match
        self.rules: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for name, ids in RULES:
            self.rules.setdefault(ids[0], []).append((name, ids))

    def identifiers(self, text: str) -> list[tuple[int, int, str]]:
        """(from, to, identifier) of the known sentences, in order, each place once."""
        low = text.lower()
        if not any(a in low for a in ANCHORS):
            return []
        found: dict[int, tuple[int, str]] = {}
        for cut in (_LINE, _END):
            for a, b in spans(text, cut):
                while a < b and not text[a].isalnum():
                    a += 1
                sentence = self.normalised(text, a, b)
                i = self.known.get(sentence) or self.known.get(_SEE.sub("", sentence))
                if i and sentence in self.tails:
                    m = self.tails[sentence].match(text, b)
                    if not m:
                        continue
                    b = m.end()
                if i and found.get(a, (0, ""))[0] < b:
                    found[a] = (b, i)
        for m in _EXPRESSION.finditer(text):
            found |= self.expression(m)
        out: list[tuple[int, int, str]] = []
        for a, (b, i) in sorted(found.items()):
            if not out or b > out[-1][1]:  # a line of a longer sentence is no notice of its own
                out.append((a, b, i))
        return out

    def normalised(self, text: str, a: int, b: int) -> str:
        """The normalised span, or as much of it as shows that it is longer than any known one:
        however much white space and marks lie in it, only so many words are taken."""
        if b - a <= 2 * self.longest:
            return normalise(text[a:b])
        words, n = [], 0
        for m in _WORD.finditer(text, a, b):
            words.append(m[0])
            n += len(m[0]) + 1
            if n > self.longest + 10:  # and a leading item number
                break
        return normalise(" ".join(words))

    def expression(self, m: re.Match) -> dict[int, tuple[int, str]]:
        """The known operands of an SPDX expression, the first of them from its mark on; none if
        two operands, or two operators, follow each other."""
        out, last = {}, "or"
        for x in _OPERAND.finditer(m.string, m.start(1), m.end(1)):
            low = x[0].lower()
            if (low in ("or", "and", "with")) != (last == ""):
                return {}
            if last == "":
                last = low
                continue
            i = self.exceptions.get(low) if last == "with" else self.operands.get(low)
            last = ""
            if i:
                out[x.start() if out else m.start()] = (x.end(), i)
        return out

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(licence, from, to): at each identifier the first rule that matches is taken, and
        the search goes on behind it."""
        ids, out, k = self.identifiers(text), [], 0
        while k < len(ids):
            names = [i for _, _, i in ids[k : k + 8]]
            for name, rule in self.rules.get(names[0], ()):
                if tuple(names[: len(rule)]) == rule:
                    out.append((name, ids[k][0], ids[k + len(rule) - 1][1]))
                    k += len(rule)
                    break
            else:
                k += 1
        return out


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, with ``sentences`` (identifiers in order, joined by spaces),
    ``licences`` (distinct, sorted, joined by spaces) and ``matches`` (array of licence, from,
    to in characters): a row per row of ``docs``.

    One narrow stage, a document at a time; whole texts are read. Null and empty texts have no
    sentences (empty strings, empty array). Repeated rows give equal results; an empty table
    gives no rows; other columns are left out.
    """
    kind = pa.list_(pa.struct([("licence", pa.string()), ("from", pa.int32()), ("to", pa.int32())]))

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            ids, names, rows = [], [], []
            for t in batch.column(text):
                t = t.as_py() or ""
                ids.append(" ".join(i for _, _, i in scanner.identifiers(t)))
                got = scanner.scan(t) if ids[-1] else []
                names.append(" ".join(sorted({n for n, _, _ in got})))
                rows.append([{"licence": n, "from": a, "to": b} for n, a, b in got])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(rows, kind)], [*keep, "sentences", "licences", "matches"])

    from pyspark.sql.types import StructType

    made = StructType.fromDDL("sentences string, licences string, matches array<struct<licence: string, from: int, to: int>>")
    return arrow_map(docs.select(*dict.fromkeys([*keep, text])), run, StructType([*(docs.schema[c] for c in keep), *made.fields]))
