import random

import numpy as np

from opsight.llm.license_scan import TEMPLATES, Index, align, license_scan, scan, tokens_of, winnow


def test_finds_every_template_inside_prose(documents):
    chance = random.Random(1)
    prose = lambda n: " ".join(chance.choice("the of licensed under and to work any".split()) for _ in range(n))
    rows, want = [], set()
    for name, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            before = prose(chance.randint(0, 300))
            i = len(rows)
            rows.append((i, f"{before}\n{text.upper() if number else text}\n{prose(50)}"))
            last = len(before) + 1 + tokens_of(text)[1][-1][1]
            want.add((i, name, number, 1.0, last))
    got = license_scan(documents(rows)).collect()
    assert {(r["doc_id"], r["license"], r["template"], r["coverage"], r["span_end"]) for r in got} == want
    assert all(r["matched_tokens"] == r["template_tokens"] for r in got)


def test_edited_notice_is_covered_in_part():
    index = Index(TEMPLATES, 3, 2)
    text = TEMPLATES["BSD-3-Clause"][0].replace("permitted", "fully allowed").replace("source and", "source code and")
    (found,) = scan("x " * 50 + text, index, 8, 0.8)
    assert found[0] == "BSD-3-Clause"
    n = len(tokens_of(TEMPLATES["BSD-3-Clause"][0])[0])
    assert found[3] == n - 1
    assert found[5] == 100


def test_plain_texts_have_none(documents):
    rows = [(1, None), (2, ""), (3, "licensed under"), (None, "a public license of the work " * 2000), (4, "!!")]
    assert license_scan(documents(rows)).count() == 0
    assert license_scan(documents([])).count() == 0


def test_several_matches_and_repeated_rows(documents):
    mit, cc = TEMPLATES["MIT"][0], TEMPLATES["CC-BY-NC-4.0"][0]
    rows = [(5, f"{mit} and {cc} then é {mit}")] * 2
    got = [(r["license"], r["span_start"]) for r in license_scan(documents(rows)).collect()]
    one = [("MIT", 0), ("CC-BY-NC-4.0", len(mit) + 5), ("MIT", len(mit) + len(cc) + 13)]
    assert sorted(got) == sorted(one * 2)


def brute_lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_alignment_with_a_wide_band_is_the_longest_common_subsequence():
    chance = np.random.default_rng(2)
    for _ in range(60):
        a, b = chance.integers(1, 5, chance.integers(1, 12)), chance.integers(0, 5, chance.integers(1, 15))
        matched, first, last = align(a.astype(np.uint64), b.astype(np.uint64), 0, 30)
        assert matched == brute_lcs(a, b)
        if matched:
            assert brute_lcs(a, b[first : last + 1]) == matched


def test_every_window_has_a_fingerprint():
    hashes = np.random.default_rng(3).integers(0, 9, 200).astype(np.uint64)
    picked = set(winnow(hashes, 4).tolist())
    for i in range(len(hashes) - 3):
        window = hashes[i : i + 4]
        assert max(j for j in range(4) if window[j] == window.min()) + i in picked


def test_adjacent_copies_against_brute_force():
    """Runs of copies of each notice, with or without words between, all found."""
    chance = random.Random(5)
    index = Index(TEMPLATES, 3, 2)
    for name, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            words = tokens_of(text)[0]
            for copies in (1, 2, 3, 7):
                for gap in (0, 1, 3):
                    page = " ".join(f"{text} " + " ".join(chance.choices("qx zz kk".split(), k=gap)) for _ in range(copies))
                    seq, places = tokens_of(page)
                    at = [i for i in range(len(seq)) if seq[i : i + len(words)] == words]
                    want = [(name, number, places[i][0], places[i + len(words) - 1][1]) for i in at]
                    assert len(want) == copies
                    assert [(*m[:2], *m[5:]) for m in scan(page, index, 8, 0.8)] == want


def names(text):
    return [m[0] for m in scan("some text before " + text + " and some after", Index(TEMPLATES, 3, 2), 8, 0.8)]


def test_licenses_of_like_wording_get_their_own_name_or_none():
    gpl = TEMPLATES["GPL-3.0"][1]
    agpl = gpl.replace("GNU General", "GNU Affero General")
    assert names(gpl) == ["GPL-3.0"] and names(agpl) == ["AGPL-3.0"]
    assert names(gpl.replace("version 3", "version 2")) == ["GPL-2.0"]
    assert names(gpl.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0"]
    cc = TEMPLATES["CC-BY-4.0"][1]
    assert names(cc) == ["CC-BY-4.0"] and names(cc.replace("Attribution", "Attribution-ShareAlike")) == ["CC-BY-SA-4.0"]
    assert names(cc.replace("Attribution", "Attribution-NonCommercial-NoDerivatives")) == []
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and names("Licensed under CC BY-NC 3.0.") == []
    two = TEMPLATES["BSD-2-Clause"][0]
    assert names(two) == ["BSD-2-Clause"] and names(TEMPLATES["BSD-3-Clause"][0]) == ["BSD-3-Clause"]
    assert names(TEMPLATES["MPL-1.1"][0]) == ["MPL-1.1"]
    assert names("Licensed under the Eclipse License, Version 2.0.") == []
    assert names("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.0.") == []
