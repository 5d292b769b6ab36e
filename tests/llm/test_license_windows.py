"""Licence notices that are part of a line, wrapped, or over several paragraphs of a longer text."""

import random
import re

import pytest

from pedolake.llm import license_scan
from pedolake.llm.common import WORD_TABLE

GPL = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and len(t) > 200)
BSD = next(t for n, t in license_scan.TEMPLATES if n == "BSD-2-Clause" and len(t) > 200)
FILLER = "\n".join(f"int f{i}(int a{i}); // of the line {i}\n" for i in range(300))


def wrapped(text, width):
    return re.sub(rf"(.{{1,{width}}})(?: |$)", r" * \1\n", text)


CASES = {
    "line": ("Copyright 2020 Jane Doe. Released under the MIT License.", "MIT", 1.0),
    "sentence": ("This module parses dates and times. Copyright 2020 Jane Doe. Released under the MIT License. It has no limits.", "MIT", 1.0),
    "wrapped": (FILLER + "\nThe library is released\nunder the MIT\nLicense.\n" + FILLER, "MIT", 1.0),
    "gpl": (FILLER + "\n/*\n" + wrapped(GPL.replace(" This program is distributed", "\n\nThis program is distributed"), 60) + " */\n" + FILLER, "GPL-3.0", 0.97),
    "bsd": (FILLER + "\n\n" + BSD.replace(" 1.", "\n\n1.").replace(" 2.", "\n\n2.") + "\n\n" + FILLER, "BSD-2-Clause", 1.0),
    "none": (FILLER + "The license of the work is not known.", None, 0.0),
}


@pytest.mark.parametrize("case", CASES)
def test_notice_anywhere(case):
    text, name, dice = CASES[case]
    found = license_scan.Scanner(license_scan.TEMPLATES, 0.8).scan(text.encode())
    assert [n for _, n in found] == ([name] if name else [])
    assert max((d for d, _ in found), default=0.0) >= dice


def test_against_all_runs():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    rng = random.Random(3)
    some = [t for _, t in license_scan.TEMPLATES if len(t) < 120]
    matched = 0
    for _ in range(150):
        words = " ".join(rng.choice(some) for _ in range(2)).split()
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(["the", "License", "under", "x", "words[at]"])]
        raw = " ".join(words).encode()
        norm = raw.translate(WORD_TABLE).split()
        best = 0.0
        for i in range(len(norm)):
            for j in range(i + 1, len(norm) + 1):
                own = license_scan.bigrams(norm[i:j])
                best = max(best, *(2 * len(own & s) / (len(own) + len(s)) for _, s in scanner.sets))
        got = max((d for d, _ in scanner.scan(raw)), default=0.0)
        assert got == pytest.approx(best if best >= 0.8 else 0.0), raw
        matched += got > 0
    assert matched > 50


def test_long_repeats_stay_linear_and_notices_are_counted():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    assert len(scanner.scan(b"Released under the MIT License.\n" * 3000)) == 3000
    assert {n for _, n in scanner.scan(("Released under the MIT License. " + "of the " * 100_000 + GPL).encode())} == {"MIT", "GPL-3.0"}
    assert license_scan.Scanner([("Z", "Zlib")], 0.8).scan(b"zlib") == [(1.0, "Z")]
