import random
import re

import pytest

from figurant.llm import licenses as L

MIT = [L.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is")]


def wrapped(text, width, lead=""):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line += (" " if line else "") + w
    return "\n".join(lead + x for x in [*out, line])


def names(text):
    return [n for n, _, _ in L.Scanner().scan(text)]


def test_texts_headers_and_notices():
    assert names(" ".join(MIT)) == ["MIT"]
    assert names("Some title\n\n" + "\n\n".join(wrapped(s, 60, "// ") for s in MIT)) == ["MIT"]
    assert names("\n".join(MIT[:1] + ["Other words stand between."] + MIT[1:2])) == ["MIT"]  # unknown sentences don't count
    bsd = [L.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
    assert names("\n".join([bsd[0], "1. " + bsd[1], "2. " + bsd[2]])) == ["BSD-2-Clause"]
    assert names("\n".join([bsd[0], "1. " + bsd[1], "2. " + bsd[2], "3. " + bsd[3]])) == ["BSD-3-Clause"]
    assert names("\n".join([bsd[0], bsd[2], bsd[1]])) == []  # the rules are ordered sequences
    assert names("junk %%%\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. More.") == ["MIT", "CC-BY-NC-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("# SPDX-License-Identifier: Apache-2.0\n") == ["Apache-2.0"]
    assert names("He was released under the MIT License law of nature.") == []
    assert names("") == [] and names("licen" * 3000) == []


def test_every_sentence_holds_an_anchor_and_every_rule_is_known():
    for s in L.known_sentences():
        assert any(normal in s for normal in ("licen", "copyright", "permission", "redistribut", "free software", "unencumbered", "warrant", "under", "free to copy", "mpl", "warranties", "as is")), s
    ids = set(L.known_sentences().values()) | set(L.operands().values()) | {f"spdx-with-{e}" for e in L.EXCEPTIONS}
    assert all(set(rule) <= ids for _, rule in L.RULES)
    for text in L.SENTENCES.values():
        assert any(a in text.lower() for a in L.ANCHORS)


def brute(text):
    """Every pair of cut points of either kind, then every rule at every place."""
    known = L.known_sentences() | {L.normalise("SPDX-License-Identifier: MIT"): "spdx-MIT"}
    found = {}
    for joined in (False, True):
        cuts = {0, len(text)}
        for i in range(1, len(text)):
            if (text[i - 1] in ".!?" or re.search("(conditions|are met):$", text[:i])) and re.match(r"[\"')\]]*\s", text[i:]) or (not joined and text[i - 1] == "\n") or (joined and re.search(r"\n[ \t#*/;-]*\n$", text[:i])):
                cuts.add(i)
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:]):
            i = known.get(L.normalise(text[a:b]))
            if i:
                start = next(k for k in range(a, b) if text[k].isalnum())
                found[start] = i
    ids, out, k = [i for _, i in sorted(found.items())], [], 0
    while k < len(ids):
        hit = next((r for r in L.RULES if tuple(ids[k : k + len(r[1])]) == r[1]), None)
        k += len(hit[1]) if hit else 1
        out += [hit[0]] if hit else []
    return ids, out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(seed):
    r = random.Random(seed)
    pool = [*L.SENTENCES.values(), "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Wholly other words here.", "A line without end", "SPDX-License-Identifier: MIT"]
    for _ in range(40):
        text = ""
        for _ in range(r.randrange(7)):
            s = r.choice(pool)
            text += (wrapped(s, 50) if r.random() < 0.3 else s) + r.choice([" ", "\n", "\n\n", "\n * \n"])
        scanner = L.Scanner()
        ids, got = brute(text)
        assert [i for _, _, i in scanner.identifiers(text)] == ids, text
        assert [n for n, _, _ in scanner.scan(text)] == got


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x"), (None, "word " * 50_000 + "\nLicensed under CC BY 4.0.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    out = L.scan(docs)
    assert out.columns == ["doc_id", "sentences", "licences", "matches"]
    got = sorted(((str(r.doc_id), r.sentences, r.licences, len(r.matches)) for r in out.collect()))
    assert got == [("1", "", "", 0), ("2", "", "", 0), ("3", "notice-MIT", "MIT", 1), ("3", "notice-MIT", "MIT", 1), ("None", "notice-CC-BY-4.0", "CC-BY-4.0", 1)]
    assert L.scan(docs.limit(0)).count() == 0


def test_each_sentence_and_each_rule_is_recognised(spark):
    notice = "Released under the {}."
    full = {**L.SENTENCES, **{f"notice-{n}": notice.format(x[0]) for n, x in L.NAMES.items()}, **{f"spdx-{n}": f"SPDX-License-Identifier: {n}" for n in L.spdx_names()}}
    cases = [((i,), full[i], None) for i in full]
    for name, rule in L.RULES:
        if rule[-1].startswith("spdx-with-"):
            continue
        first = next(n for n, r in L.RULES if r == rule)
        cases += [(rule, gap.join(wrapped(full[i], width, lead) for i in rule), first) for gap, width, lead in (("\n", 10_000, ""), ("\n\n", 60, "// "))]
    docs = spark.createDataFrame([(k, text) for k, (_, text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    for k, (ids, text, name) in enumerate(cases):
        assert got[k].sentences.split() == list(ids), text
        assert name is None or got[k].licences == name, text


def test_header_with_a_stop_in_its_version():
    header = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\ncode\n"
    ((name, a, b),) = L.Scanner().scan(header)
    assert name == "MPL-2.0" and header[a:b].startswith("This Source") and header[a:b].endswith("v. 2.0")
    assert names(header.replace("v. 2.0", "v. 3.0")) == names(header.replace("v. 2.0", "v. 2.01")) == []
    assert names(header.replace(", v. 2.0. If", ", v.\n * 2.0. If")) == ["MPL-2.0"]


def test_expressions():
    say = lambda x: names(f"// SPDX-License-Identifier: {x}\nint main() {{}}")
    assert say("GPL-3.0-or-later") == say("GPL-3.0+") == ["GPL-3.0-or-later"] and say("GPL-2.0-only") == say("GPL-2.0") == ["GPL-2.0"]
    assert say("MIT OR Apache-2.0") == ["MIT", "Apache-2.0"] and say("(mit AND ISC) or 0BSD */") == ["MIT", "ISC", "0BSD"]
    assert say("GPL-2.0-only WITH Classpath-exception-2.0") == ["GPL-2.0 WITH Classpath-exception-2.0"]
    assert say("Apache-2.0 WITH LLVM-exception OR MIT") == ["Apache-2.0 WITH LLVM-exception", "MIT"]
    assert say("LicenseRef-own") == say("Nothing-9") == say("") == []


def test_notices_that_point_to_a_file():
    for tail in (" - see the LICENSE file for details", "; see the [LICENSE](LICENSE) file for details", " - see LICENSE.md for more information"):
        assert names(f"This project is licensed under the MIT License{tail}.") == ["MIT"]
    assert names("This project is licensed under the ISC License") == ["ISC"]


def test_room_within_a_sentence():
    s = L.SENTENCES["unlicense-grant"]
    assert names(s.replace(" ", " " * 3000)) == names("\n".join(["x"] * 5000 + [s.replace(" ", "\t*  ")])) == ["Unlicense"]
    assert names(s.replace("software", "software " + "word " * 3000)) == []
