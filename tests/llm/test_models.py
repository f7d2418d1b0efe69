"""Quality, toxicity, licences, language: held-out accuracy, edge cases and small brute-force checks."""

import textwrap
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import _text as T
from quillmill.llm import language, licenses, quality, toxicity
from quillmill.llm._sample import labelled, remainder
from quillmill.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_word_hashes_depend_on_the_word_alone():
    data, _ = T.encode(["ab cd ab", None, "", "cd"])
    h = T.word_hashes(data, *T.words(data, T.NOT_SPACE))
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert len(T.ngram_hashes(h[:2], 5)) == 1 and len(T.ngram_hashes(h[:0], 5)) == 0


def test_remainder_and_sample(spark, nasty, labels):
    got = nasty.select("doc_id", remainder(F.col("doc_id"), 5).alias("r")).distinct().collect()
    assert {r.doc_id: r.r for r in got} == {None: -1} | {i: zlib.crc32(str(i).encode()) % 5 for i in (1, 2, 3, 4, 5, 6, 7, 9)}
    held = {i for i in range(1, 10) if zlib.crc32(str(i).encode()) % 5 == 0}
    rows = labelled(nasty, labels, "quality", 5, 0, 100, "s").collect()
    assert rows and not {r.doc_id for r in rows} & held
    assert len({r.doc_id for r in labelled(nasty, labels, "quality", 5, 0, 2, "s").collect()}) <= 2


def test_trees_learn_a_step_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] < 0.2)).astype(float)
    model = quality.grow(x[:1500], y[:1500], least=5)
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.grow(x, np.ones(len(x))).score(x) > 0.9).all()


def test_statistics_do_not_depend_on_the_batch():
    parts = [b"One two. One two!\nThree", None, b"", "Ünï cödé | x".encode()]
    together = quality.statistics(parts)
    assert np.allclose(together, np.concatenate([quality.statistics([p]) for p in parts]))
    assert not together[1].any() and not together[2].any()


def test_quality_held_out(spark):
    got = QUERIES["op1_quality_trees"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_edges(spark, nasty, labels):
    rows = quality.score(nasty, quality.fit(nasty, labels)).collect()
    assert len(rows) == nasty.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    none = nasty.limit(0)
    assert quality.score(none, quality.fit(none, labels.limit(0))).count() == 0


def test_noisy_or_finds_the_sentence(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        sentences = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if i % 5 == 0:
            sentences[i % 4] += " vile" + "abc"[i % 3]
        rows.append((i, ". ".join(sentences) + ".", int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), least=2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    for i in held:
        if got[i].predicted and i % 5 == 0:
            assert any("vile" in rows[i][1][s.start : s.end] for s in got[i].spans)


def test_toxic_is_told_from_clean_at_any_share_of_labels(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    for share in (0.25, 0.5, 0.75):
        toxic = rng.random(600) < share
        rows = [(i, ". ".join(" ".join(rng.choice(words, 6)) for _ in range(4)) + (" vile." if t else "."), int(t)) for i, t in enumerate(toxic)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "toxic"))).collect()}
        held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
        assert np.mean([got[i] == toxic[i] for i in held]) > 0.97, share


def test_toxicity_edges(spark, nasty, labels):
    rows = toxicity.score(nasty, toxicity.fit(nasty, labels)).collect()
    assert len(rows) == nasty.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 and r.n_sentences == 0 and r.spans == [] for r in rows if r.doc_id in (2, 3, 4))
    none = nasty.limit(0)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_span_offsets_are_code_points():
    doc, start, end, keys, raw, off = toxicity.instances(["é😀. ab cd!".encode(), b"x"])
    before = T.code_points_before(raw)
    text = "é😀. ab cd!"
    assert [text[before[s] : before[e]] for s, e, d in zip(start, end, doc, strict=True) if d == 0] == ["é😀", " ab cd"]
    assert len(keys) >= 4


def test_licences(spark):
    docs = spark.createDataFrame(
        [
            (1, "Some text here.\nReleased under the MIT License.\nmore"), (2, "We go to the license office, all the rights of man reserved seats."), (3, "All rights reserved."), (4, "é é\nlicensed under the apache license version 2.0"),
            (5, None), (6, ""), (7, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Foundation, version 3 of the License."),
        ],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert {i: [f.family for f in r.findings] for i, r in got.items()} == {1: ["MIT"], 2: [], 3: ["reserved"], 4: ["Apache"], 5: [], 6: [], 7: ["GPL"]}
    assert (got[1].findings[0].start, got[1].findings[0].end) == (16, 47) and got[4].findings[0].start == 4
    assert got[5].n_paragraphs == got[6].n_paragraphs == 0


def test_wrapped_notices_of_every_family(spark):
    rows, want = [], {}
    for family, texts in sorted(licenses.TEMPLATES.items()):
        for text in texts:
            for width in (40, 60, 76):
                for mark in ("", "# ", " * ", "// "):
                    lines = textwrap.wrap(text, width)
                    if len(lines) > 1:
                        want[len(rows)] = (family, text, width, mark)
                        rows.append((len(rows), "import one two\n\n" + "\n".join(mark + x for x in lines) + f"\n{mark}\nother words of the program follow here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [f.family for f in r.findings] for r in licenses.scan(docs, licenses.fit(docs.limit(0))).collect()}
    lost = [(want[i], got[i]) for i in want if want[i][0] not in got[i]]
    assert {f for f, *_ in want.values()} == set(licenses.TEMPLATES)
    assert not lost, (len(lost), len(want), lost[:12])
    plain = spark.createDataFrame([(1, "We go to the license office\nunder all of the rights\nof the people of this program\nand the terms of the use")], "doc_id long, text string")
    assert licenses.scan(plain, licenses.fit(docs.limit(0))).first().findings == []


def test_notices_that_are_no_templates(spark):
    """Reworded notices name their own family or none, never another."""
    cases = [
        ("MPL", "This file is licensed under the Mozilla Public License, version 2.0"), ("EPL", "// Licensed under the Eclipse Public License, version 2.0"),
        ("Apache", "This project is licensed under the Apache License, Version 2.0, see below"), ("MIT", "This code is released under the MIT License, enjoy"),
        ("CC-BY-NC-SA", "Text licensed under CC BY-NC-SA 4.0 by the authors"), ("CC-BY-NC", "Text licensed under CC BY-NC 4.0 by the authors"), ("CC-BY", "Text licensed under CC BY 4.0 by the authors"),
        (None, "Licensed under the Artistic License, version 2.0."), (None, "Licensed under the Boost Software License, Version 1.0."), (None, "Released under the Zlib License."),
        (None, "Licensed under the European Union Public License, version 1.2."), ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1"), ("AGPL", "Licensed under the GNU Affero General Public License, version 3 only"),
    ]
    docs = spark.createDataFrame([(i, f"Some words here.\n{t}\nand more") for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: [f.family for f in r.findings] for r in licenses.scan(docs, licenses.fit(docs.limit(0))).collect()}
    assert all(set(got[i]) <= {family} for i, (family, _) in enumerate(cases)), got
    assert sum(got[i] == [family] for i, (family, _) in enumerate(cases) if family) >= 9, got


def test_findings_equal_brute_force(spark):
    """Against the rules written out: the model's probabilities for the words of each line, and templates by Python sets."""
    lines = [t for texts in licenses.TEMPLATES.values() for t in texts] + ["We go to the license office.", "Licensed under the Artistic License, version 2.0.", "x"]
    docs = spark.createDataFrame([(i, f"Plain.\n\n{t}\n\nEnd.") for i, t in enumerate(lines)], "doc_id long, text string")
    model = licenses.fit(docs.limit(0))
    words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t).split()
    grams = lambda w: {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))}
    used = {f: {w for t in ts for w in words(t)} for f, ts in licenses.TEMPLATES.items()}
    got = {r.doc_id: [f.family for f in r.findings] for r in licenses.scan(docs, model).collect()}
    for i, line in enumerate(lines):
        own = words(line)
        _, _, _, of, h, _, _ = licenses.paragraphs([line.encode()])
        p = model.probabilities(*model.hits(of, h), 1)[0]
        like = {}
        for f, ts in licenses.TEMPLATES.items():
            for t in ts:
                g, name = grams(words(t)), set(words(t)) - set().union(*(u for e, u in used.items() if e != f))
                both = len(g & grams(own))
                if len(words(t)) > licenses.BRIEF or 2 * len(name & set(own)) >= len(name):
                    like[f] = max(like.get(f, (0, 0)), (2 * both / (len(g) + len(grams(own))), both / len(g)))
        like = {f: a for f, (a, inside) in like.items() if inside >= 0.6}
        best = licenses.FAMILIES[int(p.argmax())]
        want = [best] if p.max() >= 0.5 and best in like and like[best] >= max(like.values()) - 0.1 else []
        assert got[i] == want, (line, got[i], want)


def test_licence_edges(spark, nasty):
    none = nasty.limit(0)
    assert licenses.scan(none, licenses.fit(none)).count() == 0
    assert all(r.findings == [] for r in licenses.scan(nasty, licenses.fit(nasty)).collect())


def test_language_held_out(spark):
    got = QUERIES["op9_rank_order_language"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def brute_distance(text, ranks, size):
    """The rank-order distance by dictionaries."""
    folded = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode() + b"\n")
    while b"  " in folded:
        folded = folded.replace(b"  ", b" ")
    counts: dict = {}
    for n in range(1, 5):
        for i in range(len(folded) - n + 1):
            g = folded[i : i + n]
            if 32 not in g[1 : n - 1] and (g != b" " if n == 1 else not (g[0] == 32 and g[-1] == 32)):
                counts[n, g] = counts.get((n, g), 0) + 1
    top = sorted(counts, key=lambda k: (-counts[k], k[0], int.from_bytes(k[1], "big")))[:size]
    code = lambda k: (k[0] << 32) | int.from_bytes(k[1], "big")
    return sum(abs(ranks[code(g)] - i) if code(g) in ranks else size for i, g in enumerate(top)) / len(top) / size


def test_distances_equal_brute_force(spark, documents):
    profiles = language.learn(documents, size=60)
    texts = [r.text for r in documents.where("length(text) < 3000").limit(12).collect()]
    got = profiles.distances([t.encode() for t in texts])
    for j in range(len(profiles.languages)):
        ranks = {int(c): int(r) for c, r in zip(profiles.codes, profiles.ranks[:, j], strict=True) if r < 60}
        assert np.allclose(got[:, j], [brute_distance(t, ranks, 60) for t in texts])


def test_language_edges(spark, nasty):
    profiles = language.learn(nasty)
    got = language.predict(nasty, profiles).collect()
    assert len(got) == nasty.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 3, 4, 9))
    assert language.known(nasty, profiles).columns == nasty.columns
    none = nasty.limit(0)
    assert language.predict(none, language.learn(none)).count() == 0 and language.known(none, language.learn(none)).count() == 0
    assert all(r.lang_pred == "und" for r in language.predict(nasty, language.learn(none)).collect())
