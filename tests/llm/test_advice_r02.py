"""Cases that a review found cut short: each failed before its fix."""

import pathlib

import numpy as np
import pytest

from skyledger.llm import html_extract, license_scan, near_dedup, packing, pii

TEXT = "doc_id long, text string"


@pytest.fixture(scope="module")
def form_weights(spark):
    """Form weights as fitted on 4,000 documents."""
    return pii.trained(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_repeats_are_found_without_a_base_span(spark, form_weights):
    far = " and then, after many other words that make the distance longer, "
    for form, kind in (("(858) 555-2896", "phone"), ("4644.3483.9801.0899", "card")):
        base, spans = pii.label(f"see {form}{far}{form}.", form_weights)
        assert base == [] and [s[0] for s in spans] == [kind, kind], form
    assert pii.label("in 2024 and 858 of 97", form_weights) == ([], [])


def test_no_number_of_repeats_outvotes_a_pattern(form_weights):
    far = " and then, after many other words that make the distance longer, "
    for form in ("858-555-2896", "8585552896"):
        for times in (1, 2, 30, 200):
            _, spans = pii.label("call +1 (858) 555-2896" + (far + form) * times, form_weights)
            assert [s[0] for s in spans] == ["phone"] * (1 + times), (form, times)


def test_every_candidate_weighs_in_the_form_model(spark):
    docs = spark.createDataFrame([(i, "order 123456789" if i % 3 else "call +1 858 555 2896") for i in range(3600)], TEXT)
    features = np.array([pii._features("123456789"), pii._features("+1 858 555 2896")], float)
    assert np.allclose(pii.trained(docs, 10000), pii.fit(features, np.array([0, 4]), np.array([2400, 1200])))


PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_a_class_word_alone_does_not_drop_the_article(spark):
    story = "The river rose again on day {0} and took the old bridge of village {0} with it."
    forms = ("<div class='layout with-sidebar'><article><p>{}</p></article></div>", "<div id=content class=no-sidebar><p>{}</p></div>",
             "<div class='social-news'><article><p>{}</p></article></div>", "<form id=aspnetForm><nav>home</nav><div id=login><p>{}</p></div></form>")
    rows = [(10 * k + i, f"http://h{k}.org/{i}", f"<html><head><title>t</title><body><nav>menu</nav>{form.format(story.format(i))}<footer>end</footer>") for k, form in enumerate(forms) for i in range(4)]
    got = texts(spark, rows)
    assert got == {10 * k + i: story.format(i) for k in range(4) for i in range(4)}


def test_marked_containers_go_where_the_template_has_them(spark):
    page = "<body><div class=ad>buy {0}</div><div class=comments><article class=comment>me too {0}</article></div><main><p>text {0}</main>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(4)] + [(9, "http://a.org/9", "<body><p>" + "a long text " * 9 + "<div class=notice>a notice of this page only</div>")]
    got = texts(spark, rows)
    assert [got[i] for i in range(4)] == [f"text {i}" for i in range(4)]
    assert got[9].endswith("a notice of this page only")


def test_text_of_every_page_is_template_and_all_slots_are_text(spark):
    rng = np.random.default_rng(11)
    some = lambda k: " ".join("w" + "".join(rng.choice(list("abcdefghij"), 5)) for _ in range(k))
    rows, want = [], {}
    for i in range(20):
        story, intro, side = some(60), some(8), some(5)
        extra = "<p>Buy our book of the old bridges today.</p>" if i % 4 else ""  # on some pages only
        rows.append((i, f"http://news.org/{i}", f"<body><div class=top>Daily river paper</div><div class='story-intro'><p>{intro}</p></div>"
                                                f"<div class=c><p>Published by the desk on {side}</p><p>{story}</p>{extra}<p>Read all our other stories of the day</p></div>"))
        want[i] = f"{intro}\n{side}\n{story}"
    rows += [(100 + i, f"http://copy.org/{i}", f"<body><p>{story}</p>") for i in range(12)]  # copies of one page
    got = texts(spark, rows)
    assert {i: got[i] for i in want} == want
    assert {got[100 + i] for i in range(12)} == {story}


MIT = """The MIT License (MIT)

Copyright (c) 2015 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER BE LIABLE"""
NAMES = """3. Neither the name of Example Widgets, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
"""


def licences(spark, rows):
    return {r.doc_id: (r.license, r.licenses) for r in license_scan.scan(spark.createDataFrame(rows, TEXT)).collect()}


def test_published_licences_are_recognised(spark):
    cases = [(MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2), "GPL-2.0-or-later"), (LGPL, "LGPL-2.1-or-later"),
             (BSD.format(NAMES), "BSD-3-Clause"), (BSD.format(""), "BSD-2-Clause"),
             ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0\nInternational License.", "CC-BY-NC-4.0")]
    forms = [lambda t: t, lambda t: t.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n") if "Redistribution" not in t else t,
             lambda t: "/*\n" + "\n".join(" * " + line for line in t.split("\n")) + "\n */\nint x;", lambda t: "\r\n".join("# " + line for line in t.split("\n")) + "\r\n\r\nx = 1"]
    rows = [(100 * k + f, "Some words before.\n\n" + form(text)) for k, (text, _) in enumerate(cases) for f, form in enumerate(forms)]
    got = licences(spark, rows)
    assert got == {100 * k + f: (name, name) for k, (_, name) in enumerate(cases) for f in range(len(forms))}


def test_a_sentence_does_not_run_over_a_blank_line(spark):
    got = licences(spark, [(1, "Released under\nthe MIT License."), (2, "Released under\n \nthe MIT License."), (3, "Never released under the MIT License."), (4, "x\nAll rights reserved\ny")])
    assert got == {1: ("MIT", "MIT"), 2: (None, ""), 3: (None, ""), 4: ("proprietary", "proprietary")}


@pytest.mark.parametrize("name, want", [("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("CC0-1.0", "CC0-1.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0")])
def test_unedited_texts(spark, name, want):
    text = pathlib.Path("/usr/share/common-licenses", name)
    if not text.exists():
        pytest.skip("the text is not on this machine")
    assert licences(spark, [(1, text.read_text())])[1][0] == want


def test_the_registered_packing_weighs_all_dimensions(spark, docs, monkeypatch):
    import corpus_pipeline
    from skyledger.llm import queries

    seen = []
    plan = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda *args: seen.append(args) or plan(*args))
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    queries.QUERIES["op9_best_fit_packing"](spark, "")
    corpus_pipeline.packed(spark, docs, "")
    assert len(seen) == 2 and all(min(weights) > 0 for *_, weights, _ in seen)


def test_weights_of_pieces_and_cost_decide():
    """10 tokens fit beside 50 and 31 (19 left) or 80 (20 left); by tokens the first is best, by all three the second, which has less cost left."""
    place = {}
    for weights in ((1.0, 0.0, 0.0), packing.BALANCED):
        rules = packing.best_fit({80: 1, 50: 1, 31: 1, 10: 1}, 100, weights=weights).rules.tolist()
        place[weights] = rules[-1][3]
    assert list(place.values()) == [1, 0]


def test_pairs_at_80_percent_are_found(spark):
    """The first document's 2,400 shingles are among the second's 3,000; of the 512 least values of each, 378 and 385 are shared."""
    rows = []
    for seed in (707, 312):
        words = [f"w{seed}x{i}" for i in range(3004)]
        rows += [(seed, " ".join(words[:2404])), (seed + 1, " ".join(words))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, TEXT), percent=80).collect()}
    assert got == {707: 707, 708: 707, 312: 312, 313: 312}
    assert near_dedup._shared(40, 85, 1e-7) == 20 and near_dedup._shared(512, 85, 1e-8) >= 386
