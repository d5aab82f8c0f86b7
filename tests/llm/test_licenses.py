"""Licence scans against a plain version."""

import random
import re

from landgraph.llm.licenses import TEMPLATES, marking_words, scan_licenses, telling_words


def grams(text):
    w = [x for x in re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ") if x]
    return {" ".join(p) for p in zip(w, w[1:])} if len(w) > 1 else set(w)


def plain(docs, templates, t=0.8):
    out = set()
    for i, text in docs:
        text = text or ""
        blocks = re.split(r"\n[\t ]*\n", text)
        parts = re.sub(r'([.!?])[ \t\r\n]+([A-ZÄÖÜ"(])', "\\1\x01\\2", text).split("\x01")
        units = [("sentence", k, x) for k, x in enumerate(parts) if len(parts) > 1] + [("line", k, x) for k, x in enumerate(text.split("\n"))] + [("block", k, x) for k, x in enumerate(blocks) if "\n" in x] + ([("text", 0, text)] if len(blocks) > 1 else [])
        for unit, k, body in units:
            a = grams(body)
            best = max(((2 * len(a & grams(b)) / max(1, len(a) + len(grams(b))), n) for n, b in templates.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
            if best[0] >= t:
                out.add((i, unit, k, best[1], round(best[0], 9)))
    return out


def test_equals_the_plain_version(spark):
    templates = TEMPLATES | {"long": "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software", "word": "Unlicense"}
    docs = [(1, "x\nAll Rights  Reserved!\ny"), (2, "licensed under the apache license version 2.0"), (3, "Licensed under the Apache License"), (4, templates["long"] + "\n\n" + "more text"), (5, "a\n\n" + templates["long"].upper()), (6, None), (7, ""), (8, "All rights"), (9, "unlicense"), (10, "all rights reserved all rights reserved"), (11, "w " * 5000 + "\nReleased under the MIT License."), (1, "All rights reserved")]
    docs += [(20, "Copyright 2020 Acme Inc. Released under\nthe MIT License. Enjoy it."), (21, "All rights reserved. " + " " * 500 + "\nnext"), (22, "All rights reserved.\n" * 300), (None, "All rights reserved")]
    docs += [(30 + i, "Head\n\n" + t.replace(" ", "\n", 3) + "\n\nTail") for i, t in enumerate(TEMPLATES.values())]
    docs += [(60 + i, " ".join(w for k, w in enumerate(t.split()) if k % (5 + i % 9))) for i, t in enumerate(TEMPLATES.values())]
    got = {(r.doc_id, r.unit, r.unit_no, r.license, round(r.dice, 9)) for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    assert got == plain(docs, templates)


def test_empty_and_many_templates(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    assert scan_licenses(docs, broadcast_bigrams=0, max_marks=0).count() == 1


def test_a_passage_that_reaches_the_threshold_holds_enough_telling_words():
    rng = random.Random(3)
    for text in TEMPLATES.values():
        whole = sorted(grams(text))
        words, need = telling_words(whole, 0.8)
        for _ in range(200):
            left = [w for w in text.lower().split() if rng.random() > 0.12]
            if 2 * len(grams(" ".join(left)) & set(whole)) >= 0.8 * (len(grams(" ".join(left))) + len(whole)):
                assert any(w in " ".join(left) for w in marking_words(whole, 0.8))
                assert len({w for g in grams(" ".join(left)) for w in g.split(" ")} & set(words)) >= need


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.", "x", 3)], "doc_id long, text string, unit string, dice int")
    assert [tuple(r) for r in scan_licenses(docs).collect()] == [(1, "line", 0, "proprietary", 1.0)]
