import re

from wayfold.llm.op9_licenses import BASE, op9_license_scan, rules


def slow(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in BASE}
    at = sorted(sum(places.values(), []))
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({BASE[p] for p in places if places[p]}))


def test_base_and_rules(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.", "cc, BY and cc\nby", "GENERAL Public license v3 all rights reserved", "This work is licensed under the GNU General Public License, version 3.",
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "acción by accc by", "", None, "é cc by ß", "no licence here", "all rights", "general public licenses",
        "all rights reserved all rights reserved", "Kelvin cc by", "SPDX-License-Identifier: MIT", "x " * 4000 + "cc by", "cc by" + " y" * 4000,
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string")
    got = {r.doc_id: r for r in op9_license_scan(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "cc-by-nc-4.0" in got[0].labels.split(",") and "cc-by-4.0" not in got[0].labels
    assert got[3].labels == "gpl,gpl-3.0,licensed" and "mit" in got[4].labels.split(",") and "apache-2.0" in got[5].labels.split(",")
    assert got[10].score == got[7].score == got[8].score == 0 and got[4].score > 0.9
    assert got[15].labels == "spdx-mit" and got[10].labels == ""
    assert op9_license_scan(df.limit(0)).count() == 0


def test_rules_are_many_and_valid():
    table = rules()
    assert len(table) > 250
    for _, key, pattern in table:
        re.compile(pattern)


def examples(pattern):
    """The shortest match of each alternative of a pattern."""
    from re import _parser

    def spell(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "x"
            elif name == "IN":
                out += spell(arg[:1]) if str(arg[0][0]) == "LITERAL" else chr(arg[0][1][0])
            elif name == "BRANCH":
                out += spell(arg[1][0])
            elif name == "MAX_REPEAT":
                out += spell(arg[2]) * arg[0]
            elif name == "SUBPATTERN":
                out += spell(arg[3])
            else:
                raise ValueError(name)
        return out

    parts = list(_parser.parse(pattern))
    if len(parts) == 1 and str(parts[0][0]) == "BRANCH":
        return [spell(x) for x in parts[0][1][1]]
    return [spell(parts)]


def test_each_rule_alone_gets_its_label(spark):
    table = rules()
    texts = [(label, f"zz {x} zz") for label, _, pattern in table for x in examples(pattern)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(len(texts) + i, f"zz {p} zz") for i, p in enumerate(BASE)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in op9_license_scan(df).collect()}
    compiled = [(rank, label, re.compile(f"(?<= )(?:{pattern})(?= )")) for rank, (label, _, pattern) in enumerate(table)]
    for i, (label, text) in enumerate(texts):
        hits = [(m.start(), m.end(), rank, name) for rank, name, p in compiled for m in p.finditer(f" {text} ")]
        left = {h[3] for h in hits if not any(g[0] <= h[0] and g[1] >= h[1] and g[2] < h[2] for g in hits)}
        r = got[i]
        assert any(h[3] == label for h in hits), text
        assert set(r.labels.split(",")) == left | set(filter(None, r.base_labels.split(","))) and r.score > 0, (label, text)
    assert all(got[len(texts) + i].n_base == 1 for i in range(len(BASE)))


def slow_hits(text):
    """All rules over the whole text; intervals held by one of higher priority go."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    raw = [(m.start(), m.end(), rank, label) for rank, (label, key, p) in enumerate(rules()) if key in norm for m in re.finditer(f"(?<= )(?:{p})(?= )", norm)]
    return sorted(h for h in raw if not any(g[0] <= h[0] and g[1] >= h[1] and g[2] < h[2] for g in raw))


def test_hits_of_long_texts_equal_a_plain_scan(spark):
    """Matches at, across and between the borders of blocks."""
    from wayfold.llm.op9_licenses import scan

    lines = ["Released under the MIT License.", "gnu general public license version 3 or any later version", "CC BY-NC-SA 4.0", "copyright 2001 2002 2003", "all rights reserved", "licensed under the apache license version 2 0"]
    texts = []
    for shift in (0, 488, 494, 497, 499, 500, 503):
        texts.append("w " * shift + " w w ".join(lines * 3) + " v" * 700 + " " + lines[shift % 6])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in scan(df).collect():
        assert sorted((h.s, h.e, h.rank, h.label) for h in r.hits) == slow_hits(texts[r.doc_id]), r.doc_id


def test_time_grows_with_the_length(spark):
    import time

    took = []
    for n in (200, 1600):
        df = spark.createDataFrame([(1, "released under the mit license. " * n)], "doc_id bigint, text string")
        start = time.perf_counter()
        assert op9_license_scan(df).collect()[0].labels.startswith("licensed,mit")
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0]  # eight times the text; 64 were quadratic


def test_every_match_holds_what_the_rule_needs():
    """All spellings of every rule, optional parts present and absent: keyword, beginning and a stem are in each."""
    from itertools import islice, product
    from re import _parser

    from wayfold.llm.op9_licenses import STEMS, needed

    def spellings(items):
        parts = []
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                parts.append([chr(arg)])
            elif name == "NOT_LITERAL":
                parts.append(["x"])
            elif name == "IN":
                parts.append([chr(a) if str(kind) == "LITERAL" else chr(a[0]) for kind, a in arg])
            elif name == "BRANCH":
                parts.append([x for branch in arg[1] for x in spellings(branch)])
            elif name == "MAX_REPEAT":
                inner = spellings(arg[2])
                parts.append(([""] if arg[0] == 0 else []) + [x * max(1, arg[0]) for x in inner])
            elif name == "SUBPATTERN":
                parts.append(spellings(arg[3]))
            else:
                raise ValueError(name)
        return ["".join(x) for x in islice(product(*parts), 5000)]

    for label, key, pattern in rules():
        for x in spellings(_parser.parse(pattern)):
            text = f" {x} "
            assert key in text and needed(key, pattern) in text and any(s in x for s in STEMS), (label, x)
    assert all(any(s in p for s in STEMS) for p in BASE)


def test_few_texts_pass_the_gate_and_fewer_get_rules(spark):
    """Words that merely begin like a licence's name do not cost a scan: the German 'mit' is no licence, 'x11 license' is."""
    from wayfold.llm.op9_licenses import scan

    texts = ["wir kommen mit dem zug " * 50, "simple examples accent", "under the x11 license", "released under the expat license"]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0].norm is None and got[1].hits is None
    assert "mit" in {h.label for h in got[2].hits} & {h.label for h in got[3].hits}
