"""Cases that the operators used to leave out."""

import itertools
import random
import re
import time

import pytest

from vitrine.llm import common as C
from vitrine.llm import licenses, line_dedup, secrets


@pytest.fixture(autouse=True)
def ready(spark):
    C.prepare(spark)


# --------------------------------------------------------------- line dedup

def maximal_brute(rows, least):
    """Every line is compared with every earlier place, and on from there as far as the lines agree."""
    seen, out = [], {}
    for i, text in sorted(rows):
        _, _, contents, words = line_dedup.lines_of(text)
        gone = set()
        for y in range(len(contents)):
            for earlier, x in [(e, x) for e in seen for x in range(len(e))] + [(contents, x) for x in range(y)]:
                room = y - x if earlier is contents else len(earlier) - x
                n = 0
                while n < room and y + n < len(contents) and earlier[x + n] == contents[y + n]:
                    n += 1
                if sum(words[y:y + n]) >= least:
                    gone.update(range(y, y + n))
        seen.append(contents)
        out[i] = (sum(words[g] for g in gone), len(gone))
    return out


def line_of(name, words):
    return " ".join(f"{name}{k}" for k in range(words))


def test_the_tail_of_a_repeated_run_goes(spark):
    rows = []
    for k, sizes in enumerate([[30, 20], [15, 15, 15, 8], [8, 15, 15, 15], [24], [24, 1, 3]]):
        run = "\n".join(line_of(f"r{k}x{j}y", n) for j, n in enumerate(sizes))
        rows += [(10 * k, f"before {k}\n{run}\nafter {k} one"), (10 * k + 1, f"else {k}\n{run}\nand {k} two")]
    got = {r.doc_id: (r.removed_words, r.removed_lines) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[10 * k + 1] for k in range(5)] == [(50, 2), (53, 4), (53, 4), (0, 0), (28, 3)]
    assert all(got[10 * k] == (0, 0) for k in range(5))


def test_line_dedup_against_maximal_matches(spark):
    rng = random.Random(23)
    pool = [line_of(f"p{k}w", rng.randint(1, 9)) for k in range(25)]
    passage = [line_of(f"q{k}w", rng.randint(1, 11)) for k in range(9)]
    rows = []
    for i in range(70):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"only {i} {k} here" for k in range(rng.randint(0, 9))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[rng.randint(0, 3):rng.randint(4, 9)]
        if rng.random() < 0.2:
            lines += lines
        rows.append((i * 3 % 70, "\n".join(lines)))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=12, gram_words=6).collect()
    want = maximal_brute(rows, 12)
    assert {r.doc_id: (r.removed_words, r.removed_lines) for r in got} == want and any(w[1] for w in want.values())


# ------------------------------------------------------------------ secrets

def test_long_runs_of_letters_take_one_pass():
    tokens = secrets.encoder().encode_ordinary
    began = time.monotonic()
    for run in ("a" * 10_000 + "123", "Q" * 10_000 + "x", "Ab" * 5_000 + "1", "A" * 1_000_000 + "123"):
        assert secrets.KNOWN.fullmatch(run) is None
    assert secrets.random_spans("x " + "a" * 10_000 + "123 y", [], lambda run: len(tokens(run))) == []
    assert time.monotonic() - began < 20


def test_identifiers_are_the_same_in_one_pass():
    nested = re.compile(r"(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})[0-9]{0,2}[+/_=-]*)+")
    for n in range(1, 9):
        for run in map("".join, itertools.product("Aa1_", repeat=n)):
            assert bool(secrets.KNOWN.fullmatch("g" * 2 + run)) == bool(nested.fullmatch("g" * 2 + run)), run


def test_random_letters_are_random_and_identifiers_are_not():
    enc, rng = secrets.encoder(), random.Random(41)

    def found(run):
        return secrets.random_spans(f"key {run} end", [], lambda r: len(enc.encode_ordinary(r))) == [(4, 3, 4 + len(run))]

    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        for n, least in ((20, 0.97), (32, 0.99), (40, 0.99)):
            assert sum(found("".join(rng.choices(letters, k=n))) for _ in range(300)) >= least * 300
    for run in ("internationalization_of_configuration_values", "MAX_RETRY_COUNT_PER_CONNECTION", "AbstractSingletonProxyFactoryBean",
                "getElementsByTagNameAndClass2", "DEFAULT_SHUFFLE_PARTITIONS", "src/main/resources/templates", "parseHTMLDocumentFragment"):
        assert not found(run), run


# ----------------------------------------------------------------- licences

ISC = ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
       """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""]
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
PROSE = "The keeper climbs the stairs of the old tower each morning and lights the lamp again by hand"


def test_usual_licence_texts_match():
    index = licenses.Templates(licenses.TEMPLATES, 0.8)
    flat = [p.replace("\n", " ") for p in ISC]
    for text, name in (("\n".join(flat), "ISC"), ("\n\n".join(ISC), "ISC"), (f"{PROSE}. {' '.join(flat)} {PROSE}.", "ISC"), (BSD2, "BSD-2-Clause")):
        assert {s[2] for s in index.scan(text)} == {name}, text
    for name, variants in licenses.TEMPLATES.items():
        for text in variants:
            assert {s[2] for s in index.scan(f"{PROSE}. {text} {PROSE}.")} == {name}, text


def test_notices_inside_longer_lines_match():
    index = licenses.Templates(licenses.TEMPLATES, 0.8)
    text = f"Copyright 2020 Example Corp. All rights reserved.\n{PROSE} and this tool is released under the MIT License, as {PROSE}.\n{PROSE}."
    got = index.scan(text)
    assert [(text[s:e], name) for s, e, name, _ in got] == [("All rights reserved", "Proprietary"), ("released under the MIT License", "MIT")]
    assert all(d == 1 for *_, d in got)
    text = f"{PROSE}. This work is licensed under a Creative\nCommons Attribution 4.0 International License. {PROSE}. " * 3
    assert [s[2] for s in index.scan(text)] == ["CC-BY-4.0"] * 3
    assert index.scan(f"{PROSE}. " * 50) == []


def test_long_texts_of_licences_take_one_pass():
    index, began = licenses.Templates(licenses.TEMPLATES, 0.8), time.monotonic()
    mit = licenses.TEMPLATES["MIT"][-1].replace("\n", " ")
    assert index.scan(f"{mit} {PROSE}. " * 200) and index.scan(f"All rights reserved. {PROSE}. " * 10_000)
    assert time.monotonic() - began < 60
