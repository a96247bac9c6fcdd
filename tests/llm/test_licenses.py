from __future__ import annotations

import math
import random
import re

import pytest

from marquee.llm import licenses
from marquee.llm.queries import op3_licenses
from tests.llm.util import SF, documents


#: Written out here, not taken from the module: the contract's phrases.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Templates of this test's own.
OWN = [
    ("one", "The quick brown fox jumps over the lazy dog near the old mill", ("quick brown fox",)), ("two", "Lorem ipsum dolor sit amet", ("lorem ipsum|ipsum lorem", "amet")),
    ("two", " ".join(f"word{i}" for i in range(64)), ("word1 word2",)), ("fox", "The slow brown fox jumps over the lazy dog near the old mill", ("slow brown fox",)),
]


def brute(text, templates):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, base = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        base |= {label} if own else set()
    found, share = set(), 0.0
    for label, text, must in templates:
        t = re.findall("[a-z0-9]+", text.lower())
        size = max(16, 1 << (2 * len(t) - 1).bit_length())
        for a in range(0, max(1, len(words)), size // 2):
            block = words[a : a + size]
            n = len(set(block) & set(t))
            told = all(any(f" {p} " in f" {' '.join(block)} " for p in group.split("|")) for group in must)
            if n >= math.ceil(0.8 * len(set(t)) - 1e-9) and told:
                found.add(label)
                share = max(share, n / len(set(t)))
            if a + size >= len(words):
                break
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else share)


def check(spark, rows, templates):
    got = sorted((tuple(r) for r in licenses.scan(documents(spark, rows), templates=templates).collect()), key=str)
    assert got == sorted(((d, *brute(t, templates)) for d, t in rows), key=str)
    return got


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, OWN])
def test_like_brute_force(spark, templates):
    rng = random.Random(12)
    filler = [f"w{i}" for i in range(50)] + ["the", "license", "software", "été", "of"]
    rows = []
    for i in range(120):
        _, text, _ = rng.choice(templates)
        words = text.split()
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = rng.choice(filler)
        before, after = rng.choices(filler, k=rng.randrange(300)), rng.choices(filler, k=rng.randrange(300))
        rows.append((i, rng.choice([" ", "\n", ", "]).join([*before, *words, *after])))
    rows += [(200, None), (201, ""), (202, "Under The MIT License, the mit license"), (203, "CC-BY-NC cc by nc, cc_by_nc under the mit license"), (204, "xunder the mit license"), (205, "under the mit licenseé"), (206, "w " * 30_000 + "Apache License, Version 2"), (206, "cc by nc"), (None, "cc by nc"), (207, "---")]
    got = check(spark, rows, templates)
    assert sum(r[6] != r[5] for r in got) > 30
    assert licenses.scan(documents(spark, rows).limit(0)).count() == 0


def test_table(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [tuple(r) for r in op3_licenses(spark, sf).collect()]
    assert sorted(rows) == sorted((d, *brute(t, licenses.TEMPLATES)) for d, t in texts.items())
    assert any(r[5] != r[6] for r in rows)


def test_licenses_are_told_apart(spark):
    rows = [
        (1, "released under the Apache License", ""), (2, "a book released under the title, without license", ""), (3, "Licensed under the Apache License, Version 2.0", "apache-2"),
        (4, "licensed under a Creative Commons Attribution 4.0 International License", "cc-by"), (5, "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        (6, "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"), (7, "licensed under the GNU Lesser General Public License, version 3", "lgpl-3"),
        (8, "licensed under the GNU General Public License, version 3", "gpl-3"), (9, "It is the MIT License", ""), (10, "released under the MIT license", "mit"), (11, "mit students released " + "w " * 40 + "under the license", ""),
    ]
    got = {r.doc_id: r.labels for r in licenses.scan(documents(spark, [r[:2] for r in rows])).collect()}
    assert got == {i: want for i, _, want in rows}
    r = licenses.scan(documents(spark, [(1, "It is under the MIT license. The MIT license it is, under the mit license")])).first()
    assert (r.n_base, r.first_word, r.last_word) == (2, 2, 11)
    with pytest.raises(ValueError):
        licenses.scan(documents(spark, rows[:1] and [(1, "x")]), templates=[("long", "w " * 65, ("w",))])
    with pytest.raises(ValueError):
        licenses.scan(documents(spark, [(1, "x")]), templates=[("no phrase", "some words", ())])


def header(name, version, thing="program"):
    return f"""This file is part of Foo, with 3 parts and 2 more. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the
    Free Software Foundation, either version {version} of the License, or (at your option) any later version. Foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details. You should have received a copy of the GNU {name}General Public License along with this {thing}. If not, see https://www.gnu.org/licenses/."""


APACHE_1 = """The Apache Software License, Version 1.1. Copyright (c) 2000 The Apache Software Foundation. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice."""
APACHE_2 = """Copyright 2020 Someone. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def test_whole_headers_of_relatives(spark):
    """Each header gives its own license alone, and prose with the same words none."""
    rows = [
        (1, header("", 3), "gpl-3"), (2, header("", 2), "gpl-2"), (3, header("Lesser ", 3, "library"), "lgpl-3"), (4, header("Affero ", 3), "agpl-3"), (5, header("Lesser ", "2.1", "library"), ""), (6, header("", 1), ""), (7, APACHE_2, "apache-2"),
        (8, APACHE_1, "bsd"), (9, "the mit press granted a license to use the term under the released book title", ""), (10, "the terms of the general assembly: version 3 of the public statement is published by the gnu in the free zoo", ""),
        (11, "Apache pilots flew version 2 under the license of the state, licensed since 1980", ""), (12, header("Lesser ", 3) + " You should have received a copy of the GNU General Public License too.", "lgpl-3"),
        (13, header("Lesser ", 3) + "\n" + "w " * 200 + header("", 3), "gpl-3,lgpl-3"), (14, "a creative and commons minded school gave attribution 4 times for international use, licensed under no license", ""),
    ]
    for before in ("", "x " * 37):
        got = {r.doc_id: r.labels for r in licenses.scan(documents(spark, [(i, before + t) for i, t, _ in rows])).collect()}
        assert got == {i: want for i, _, want in rows}
