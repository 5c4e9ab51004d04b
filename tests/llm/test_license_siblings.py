import random

import pytest

from voxelmetry.llm import licenses as N
from voxelmetry.llm.license_texts import TEMPLATES

SCANNER = N.Scanner(TEMPLATES, N.LEAST)


def names(text):
    return [x[0] for x in SCANNER.scan(f"alpha beta {text} gamma delta")]


@pytest.mark.parametrize("name", TEMPLATES)
def test_a_template_is_reported_as_itself_alone(name):
    assert names(TEMPLATES[name]) == [name]


@pytest.mark.parametrize(
    "text",
    ["Released under the Foo License.", "Licensed under CC BY-XX 4.0.", "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1.",
     "This work is licensed under the GNU General Public License, version 4.", "Licensed under CC BY-NC 3.0."],
)
def test_unknown_siblings_are_no_license(text):
    assert names(text) == []


def test_interrupted_passages_are_found():
    text = "Licensed under the [Apache License](http://www.apache.org/licenses/LICENSE-2.0), Version 2.0."
    assert SCANNER.scan(text) == [("Apache-2.0 (line)", 1.0, 0, 15)]
    rng = random.Random(3)
    for name in ("MIT", "BSD-3-Clause", "GPL-3.0-or-later", "Apache-2.0"):
        words = TEMPLATES[name].split()
        for gap in (len(words), 5 * len(words)):
            noise = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(gap)]
            for at in (len(words) // 3, len(words) // 2, 2 * len(words) // 3):
                found = SCANNER.scan(" ".join(noise + words[:at] + noise + words[at:] + noise))
                assert [x[:2] for x in found] == [(name, 1.0)], (name, gap, at, found)


@pytest.mark.parametrize("name", TEMPLATES)
def test_every_copy_is_reported(name):
    text = TEMPLATES[name]
    n = len(N.WORD.findall(text))
    assert SCANNER.scan("\n".join([text] * 3)) == [(name, 1.0, k * n, k * n + n - 1) for k in range(3)]
    found = SCANNER.scan("one two three\n".join([text, text.replace(" the ", " thee ", 1), text]))
    assert [x[0] for x in found] == [name] * 3 and all(x[3] < y[2] for x, y in zip(found, found[1:]))
