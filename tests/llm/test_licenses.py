"""Licence scans against a version without filters, joins or Spark."""

import collections
import math
import os
import random
import re
import textwrap

from mergewell.llm import licenses

FILE = "doc_id long, path string, text string"


def brute(files, templates, threshold, least_share=0.5):
    word = re.compile(r"[^\W_]+")
    bags = [set(word.findall((t or "").lower())) for _, _, t in files]
    vocabulary = {w for _, t in templates for w in word.findall(t.lower())}
    df = {w: sum(w in b for b in bags) for w in vocabulary}
    weight = lambda w: math.log((1 + len(files)) / (1 + df.get(w, 1))) + 1

    def cosine(a, b):
        a, b = ({w: n * weight(w) for w, n in collections.Counter(x).items()} for x in (a, b))
        length = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / (length(a) * length(b))

    own = []
    for _, _, text in files:
        best, share, at = (0.0, None), 0, 0
        for sentence in re.split(r"(?<=[.!?])(?=\s)|\n", text or ""):
            words = word.findall(sentence.lower())
            if not words or len(words) > licenses.WINDOW:
                continue
            top = max(((round(cosine(words, word.findall(t.lower())), 6), -k) for k, (_, t) in enumerate(templates)))
            if top[0] >= threshold:
                share += len(words)
                best = max(best, (top[0], templates[-top[1]][0]), key=lambda x: x[0])
            at += len(sentence)
        total = len(word.findall((text or "").lower()))
        own.append((best[1], best[0], bool(total) and share / total >= least_share))
    givers = {}
    for (_, path, _), (name, _, big) in sorted(zip(files, own), key=lambda x: x[0][1] or ""):
        if path and name and (big or re.match(licenses.LICENCE_NAME, path.rsplit("/", 1)[-1])):
            givers.setdefault(path.rsplit("/", 1)[0] if "/" in path else "", name)
    out = []
    for (i, path, _), (name, score, _) in zip(files, own):
        above, up = None, path or ""
        while "/" in up and above is None:
            up = up.rsplit("/", 1)[0]
            above = givers.get(up)
        if path is not None and above is None:
            above = givers.get("")
        out.append((str(i), name, round(score, 4), above, name or above))
    return sorted(map(str, out))


def test_scan(spark):
    rng = random.Random(6)
    notices = [t for _, t in licenses.TEMPLATES] + ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    filler = lambda n: " ".join(rng.choice("version the of under this work free use code alpha beta gamma delta é".split()) for _ in range(n))
    files = []
    for k in range(120):
        text = filler(rng.choice([0, 3, 40])) + ".\n"
        if rng.random() < 0.4:
            text += rng.choice(notices) + ".\n"
        directory = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        files.append((k, (directory + "/" if directory else "") + f"f{k}", text + filler(rng.choice([0, 30]))))
    files += [(500, "a/b/LICENSE", filler(90) + "\nReleased under the MIT License.\n"), (501, "a/b/z/y/x", None), (502, None, "Released under the MIT License."), (503, "a/b/COPYING.txt", filler(80) + "\nLicensed under CC BY 4.0")]
    files += [(504, "c", ""), (501, "a/b/z/y/x", None)]
    df = spark.createDataFrame([(*f, "x") for f in files], f"{FILE}, license string")
    got = licenses.scan(df, ["doc_id"]).collect()
    shown = sorted(str((str(r["doc_id"]), r["own_license"], round(r["own_score"], 4), r["inherited_license"], r["license"])) for r in got)
    assert shown == brute(files, licenses.TEMPLATES, licenses.THRESHOLD)
    assert any(r["own_license"] is None and r["inherited_license"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[501]["license"] == "CC-BY-4.0" and by[501]["inherited_from"] == "a/b/COPYING.txt"
    assert licenses.scan(df.limit(0), ["doc_id"]).count() == 0


def test_every_template_finds_itself():
    model = licenses.Templates(licenses.TEMPLATES, {t: 3 for _, x in licenses.TEMPLATES for t in licenses.terms(x)}, 1000, 0.75)
    for name, text in licenses.TEMPLATES:
        found = model.judge("Some words first.\n" + text + ".\nAnd after.")
        assert found[0] == name and found[1] == 1.0, name
    assert model.judge("word " * 5000 + "Released under the MIT License")[2] <= 1


def test_notices_of_the_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.isdir(os.path.dirname(path)):
        return
    docs = spark.read.parquet(path)
    lines = {"Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Released under the MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "GNU General Public License, version 3": "GPL-3.0"}
    want = {r["doc_id"]: v for r in docs.collect() for k, v in lines.items() if k in r["text"]}
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan_documents(docs).collect()}
    assert len(got) == docs.count() and {d: x for d, x in got.items() if x} == want


def test_offsets_where_lower_case_is_longer():
    model = licenses.Templates(licenses.TEMPLATES, {t: 3 for _, x in licenses.TEMPLATES for t in licenses.terms(x)}, 1000, 0.75)
    text = "İİ.\nİ\nReleased under the MIT License.\n"
    shown = model.judge(text)[4]
    name, start, end = shown.split(":")
    assert name == "MIT" and text[int(start) : int(end)] == "Released under the MIT License"
    assert licenses.terms("İ") == ["i̇"]
    line = "İstanbul Released under the MIT License"
    (start, end, n, _, _) = next(licenses.Templates(licenses.TEMPLATES, {}, 1, 0.5).notices(line))
    assert (start, end, n) == (0, len(line), 6)


def test_a_word_more_is_found_whatever_the_size_of_the_corpus():
    lines = ("This project is licensed under the MIT License", "This code is released under the MIT License", "Released under the MIT License by Acme")
    words = {t for _, x in licenses.TEMPLATES for t in licenses.terms(x)}
    for documents in (100, 10_000, 10**9):
        frequencies = {t: documents // 20 for t in words} | {"code": 0}
        model = licenses.Templates(licenses.TEMPLATES, frequencies, documents, licenses.THRESHOLD)
        assert [model.judge(line)[0] for line in lines] == ["MIT"] * 3
        assert model.judge("Licensed under the Eclipse Public License, Version 2.0")[0] is None


def test_wrapped_headers_titles_and_notices_in_prose(spark):
    wrap = lambda text, width=60, start="# ": "\n".join(start + line for line in textwrap.wrap(text, width))
    prose = " ".join(f"word{k}" for k in range(150))
    texts = [(name, "import os\n" + wrap(text) + "\n\ncode = 1\n") for name, text in licenses.HEADERS]
    texts += [(name, wrap(text, 25, " * ")) for name, text in licenses.TEMPLATES if len(text) > 25]
    texts += [(name, f"{prose} and {text[0].lower() + text[1:]} and {prose}") for name, text in licenses.TEMPLATES]
    texts += [(name, f"\n{title}\n\nCopyright (c) 2020 Someone\n{prose}") for name, title in licenses.TITLES]
    texts += [("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + prose), ("MIT", "MIT License")]
    texts += [(None, "MIT License talk\n" + prose), (None, f"{prose}\nMIT License\n{prose}"), (None, wrap("Licensed under the Eclipse Public License, Version 2.0", 20))]
    files = [(k, f"d{k}/LICENSE", text) for k, (_, text) in enumerate(texts)] + [(1000 + k, f"d{k}/deep/file", prose) for k in range(len(texts))]
    files += [(10_000 + k, f"x/{k}", prose) for k in range(300)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(files, FILE), ["doc_id"]).collect()}
    for k, (name, text) in enumerate(texts):
        assert (got[k]["own_license"], got[1000 + k]["license"]) == (name, name), text
    assert all(got[k]["n_notices"] == 1 for k, (name, _) in enumerate(texts) if name)


def test_licences_that_are_worded_alike():
    every = (*licenses.TEMPLATES, *licenses.HEADERS)
    words = {t for _, x in (*every, *licenses.TITLES) for t in licenses.terms(x)}
    model = licenses.Templates(every, dict.fromkeys(words, 3), 10_000, licenses.THRESHOLD, licenses.TITLES)
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    for text, name in (
        (lesser, "LGPL-2.1"),
        (lesser.replace("2.1", "3"), "LGPL-3.0"),
        (lesser.replace("Lesser ", "").replace("library", "program").replace("2.1", "2"), "GPL-2.0"),
        ("Released under the BSD 2-Clause license", "BSD-2-Clause"),
        ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("Licensed under the GNU GPL v3", "GPL-3.0"),
        ("Licensed under the GNU GPL v2.", "GPL-2.0"),
        ("This is not licensed under the MIT license", None),
        ("This code is not released under the MIT License.", None),
        ("This code is released under the MIT License, not for sale.", "MIT"),
        *((f"// SPDX-License-Identifier: {name}", name) for name, _ in licenses.SENTENCES),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ):
        assert model.judge(f"Some code.\n{text}\nx = 1\n")[0] == name, text
        assert model.judge(f"{'word ' * 60}\n# {text}")[0] == name, text
