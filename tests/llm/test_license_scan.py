"""The license scan against brute force, and over whole license texts."""

import re

import numpy as np
import pytest

from graphloom.llm import license_scan
from tests.llm.test_operators import _longest_common


@pytest.mark.parametrize("n", [60, 64, 150, 2000])
def test_lists_without_anchors_are_aligned_exactly(n):
    rng = np.random.default_rng(n)
    a, b = ([w for w in rng.integers(0, 9, k).tolist() for _ in range(2)] for k in (n // 2, n // 2))  # each word at least twice
    a, b = [1, *a, 3], [2, *b, 4]
    pairs = license_scan.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))
    assert len(pairs) == _longest_common(a, b)


def _windows_shared(words, template, width):
    """Of every window of the text: the longest common subsequence with the template, and how many distinct words both have."""
    for s in range(len(words)):
        part = words[s : s + width]
        yield s, _longest_common(part, template), len(set(part) & set(template))


def test_license_hits_against_brute_force():
    """Planted copies with changed, left out and inserted words: each is found where it is and as far as it was copied, and
    nothing is found where no window of the text shares as much of a template in the same order."""
    rng = np.random.default_rng(4)
    words = [f"t{k}" for k in range(30)]
    template = words + [words[k] for k in rng.integers(0, 30, 10)]
    scanner = license_scan.Scanner({"x": " ".join(template)}, 0.8)
    least, distinct, width = 32, 0.7 * 30, 60
    found = none = 0
    for trial in range(60):
        text, planted = [], []
        for _ in range(int(rng.integers(0, 4))):
            copy = list(template)
            for k in rng.integers(0, len(copy), rng.integers(0, 16)).tolist():
                kind = rng.integers(0, 3)
                if kind == 0:
                    copy[k % len(copy)] = f"c{rng.integers(99)}"
                elif kind == 1:
                    copy.pop(k % len(copy))
                else:
                    copy.insert(k % len(copy), f"i{rng.integers(99)}")
            text += [f"p{w}" if rng.integers(4) else words[rng.integers(30)] for w in rng.integers(0, 50, 70)]
            planted.append((len(text), len(text) + len(copy), _longest_common(copy, template)))
            text += copy
        text += [f"p{w}" for w in rng.integers(0, 50, 20)]
        raw = " ".join(text)
        place = {m.start(): k for k, m in enumerate(re.finditer(r"\S+", raw))}
        hits = [(round(share * len(template)), place[a], place[a] + raw[a:b].count(" ") + 1) for _, share, a, b in scanner.scan(raw)]
        enough = [s for s, n, d in _windows_shared(text, template, width) if n >= least and d >= distinct]
        assert bool(hits) <= bool(enough)
        for n, a, b in hits:
            assert least <= n <= _longest_common(text[a:b], template) and b - a <= width
            assert text[a] in words and text[b - 1] in words
        for a, b, n in planted:
            if n >= least + 3 and len(set(text[a:b]) & set(words)) >= 24:
                over = [h for h in hits if h[1] < b and h[2] > a]
                assert len(over) == 1 and n - 3 <= over[0][0]
                found += 1
        none += not hits
        assert all(x[2] <= y[1] for x, y in zip(sorted(hits, key=lambda h: h[1]), sorted(hits, key=lambda h: h[1])[1:]))
    assert found > 30 and none > 5


def test_whole_license_texts_are_hits():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    names = sorted(license_scan.TEMPLATES.keys() - license_scan.NOTICES.keys())
    assert {"MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(names)
    for name in names:
        words = license_scan.TEMPLATES[name].split()
        del words[len(words) // 2 : len(words) // 2 + len(words) // 20]
        (hit,) = scanner.scan("some code " + " ".join(words) + " and more")
        assert hit[0] == name and 0.9 < hit[1] < 1


def test_longer_insertions_need_a_greater_stretch():
    words = license_scan.TEMPLATES["MIT"].split()
    text = " ".join(words[:80] + [f"other{k}" for k in range(120)] + words[80:])
    assert not license_scan.Scanner(license_scan.TEMPLATES, 0.8).scan(text)
    assert [h[0] for h in license_scan.Scanner(license_scan.TEMPLATES, 0.8, 2.0).scan(text)] == ["MIT"]
