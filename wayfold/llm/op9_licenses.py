"""License scan by ordered signature rules, with DataFrame functions alone.

Texts become words (A-Z lower-cased; letters, digits and everything beyond ASCII). A row-level gate looks for ``STEMS``,
parts of words without which no rule matches, by plain substring search; only rows that have one are normalised
(`` w1 w2 … ``). The rules whose keyword, and then whose beginning (``needed``), stands in the text are listed once a
text. Texts with listed rules are read in blocks of ``BLOCK`` words with ``MARGIN`` words around, more than any match has,
so that time grows in proportion to a text's length; a block answers for the matches that begin in it. Of the listed rules
only those whose beginning the block holds are run. A rule's matches become intervals; an interval inside another one of a
higher priority goes, so ``cc-by-nc-4.0`` silences ``cc-by`` found by a rule within it. Base phrases are counted by
position in the word array and are never suppressed. No shuffle, no join: each row is decided alone.

Cases: null and empty texts have no words and no labels; equal rows get equal values; a text of any length is handled
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_NOT_WORD = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
_ANY = "(?:the |a |an |this |of |under |terms |license |licence |version |v ?){0,8}"
BLOCK, MARGIN = 500, 60


def rules() -> list[tuple[str, str, str]]:
    """(label, keyword, pattern over normalised words), highest priority first. Families are spelled by rule: a licence
    name in its usual wordings, times its versions, times "only" and "or later" where they exist."""
    out: list[tuple[str, str, str]] = []

    def versions(label: str, keyword: str, names: list[str], numbers: list[str], later: bool = False) -> None:
        for number in numbers:
            spoken = number.replace(".", " ")
            short = spoken.removesuffix(" 0")
            shown = f"(?:{spoken}|{short})" if short != spoken else spoken
            for name in names:
                if later:
                    out.append((f"{label}-{number}-or-later", keyword, f"{name} {_ANY}{shown} (?:of the license )?or (?:any |at your option any )?(?:later|newer)(?: version)?"))
                    out.append((f"{label}-{number}-only", keyword, f"{name} {_ANY}{shown} only"))
                out.append((f"{label}-{number}", keyword, f"{name} {_ANY}{shown}"))
        out.extend((label, keyword, name) for name in names)

    # SPDX lines name the licence outright
    for name in ("mit", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "isc", "mpl 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "unlicense", "zlib", "epl 2 0", "bsl 1 0"):
        out.append((f"spdx-{name.replace(' ', '-')}", "spdx", f"spdx license identifier {name}(?: only| or later)?"))
    # Creative Commons: the longest combinations first
    long_names = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for parts in ("by nc sa", "by nc nd", "by nc", "by sa", "by nd", "by"):
        spoken = " ".join(long_names[p] for p in parts.split())
        versions(f"cc-{parts.replace(' ', '-')}", "cc", [f"cc {parts}"], ["4.0", "3.0", "2.5", "2.0", "1.0"])
        versions(f"cc-{parts.replace(' ', '-')}", "creative", [f"creative commons {spoken}"], ["4.0", "3.0", "2.5", "2.0", "1.0"])
    out += [("cc0-1.0", "cc0", "cc0(?: 1 0)?"), ("cc0-1.0", "creative", "creative commons zero"), ("cc", "creative", "creative commons license"), ("public-domain", "domain", "(?:in|into|to) the public domain"), ("public-domain", "domain", "public domain dedication")]
    # GNU
    versions("agpl", "affero", ["gnu affero general public license", "affero general public license"], ["3.0", "1.0"], True)
    versions("lgpl", "lesser", ["gnu lesser general public license", "lesser general public license"], ["3.0", "2.1", "2.0"], True)
    versions("lgpl", "library", ["gnu library general public license", "library general public license"], ["2.0"], True)
    versions("gfdl", "documentation", ["gnu free documentation license", "free documentation license"], ["1.3", "1.2", "1.1"], True)
    versions("gpl", "general public", ["gnu general public license", "general public license"], ["3.0", "2.0", "1.0"], True)
    for short, numbers in (("agpl", ["3.0"]), ("lgpl", ["3.0", "2.1", "2.0"]), ("gpl", ["3.0", "2.0", "1.0"])):
        versions(short, short, [f"gnu {short}", short], numbers, True)
        for number in numbers:
            out.append((f"{short}-{number}", short, f"{short}v{number.replace('.', ' ').removesuffix(' 0')}"))
    # licences with versions
    for label, keyword, names, numbers in (
        ("apache", "apache", ["apache license", "apache software license", "apache public license", "apache"], ["2.0", "1.1", "1.0"]),
        ("mpl", "mozilla", ["mozilla public license"], ["2.0", "1.1", "1.0"]), ("mpl", "mpl", ["mpl"], ["2.0", "1.1", "1.0"]),
        ("epl", "eclipse", ["eclipse public license"], ["2.0", "1.0"]), ("eupl", "european", ["european union public licen[cs]e"], ["1.2", "1.1", "1.0"]),
        ("cddl", "distribution license", ["common development and distribution license"], ["1.1", "1.0"]), ("cpl", "common public", ["common public license"], ["1.0"]),
        ("artistic", "artistic", ["artistic license"], ["2.0", "1.0"]), ("osl", "open software", ["open software license"], ["3.0", "2.1", "2.0", "1.0"]),
        ("afl", "academic", ["academic free license"], ["3.0", "2.1", "2.0", "1.2"]), ("ofl", "open font", ["sil open font license", "open font license"], ["1.1", "1.0"]),
        ("php", "php", ["php license"], ["3.01", "3.0"]), ("zpl", "zope", ["zope public license"], ["2.1", "2.0"]), ("bsl", "boost", ["boost software license"], ["1.0"]),
        ("busl", "business", ["business source license"], ["1.1", "1.0"]), ("sspl", "server side", ["server side public license"], ["1.0"]), ("elastic", "elastic", ["elastic license"], ["2.0", "1.0"]),
        ("lppl", "latex", ["latex project public license"], ["1.3", "1.2", "1.0"]), ("ms-pl", "microsoft", ["microsoft public license"], ["1.0"]), ("ms-rl", "microsoft", ["microsoft reciprocal license"], ["1.0"]),
        ("odbl", "database", ["open database license"], ["1.0"]), ("odc-by", "commons", ["open data commons attribution license"], ["1.0"]), ("pddl", "commons", ["open data commons public domain dedication and license"], ["1.0"]),
        ("python", "python", ["python software foundation license", "python license"], ["2.0"]), ("qpl", "public license", ["q public license"], ["1.0"]), ("ipl", "ibm", ["ibm public license"], ["1.0"]),
    ):
        versions(label, keyword, names, numbers)
    # licences without versions, and the sentences that give them away
    for label, keyword, pattern in (
        ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: license)?|bsd (?:4|four) clause(?: license)?|original bsd license"),
        ("bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: license)?|bsd (?:3|three) clause(?: license)?|(?:new|modified|revised) bsd license"),
        ("bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: license)?|bsd (?:2|two) clause(?: license)?|(?:simplified|freebsd) bsd license"),
        ("bsd-0-clause", "bsd", "(?:0|zero) clause bsd(?: license)?|0bsd"), ("bsd", "bsd", "bsd(?: style)? license"),
        ("mit-0", "mit", "mit no attribution"), ("mit", "licens", "(?:the )?(?:mit|x11|expat)(?: style)? license"), ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc", "isc", "isc license"), ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"), ("zlib", "zlib", "zlib(?: libpng)? license"),
        ("unlicense", "unlicense", "(?:the )?unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license"), ("postgresql", "postgresql", "postgresql license"),
        ("ruby", "ruby", "ruby license"), ("openssl", "openssl", "openssl license"), ("perl", "perl", "same terms as perl(?: itself)?"), ("vim", "vim", "vim license"), ("curl", "curl", "curl license"),
        ("commons-clause", "clause", "commons clause(?: license condition)?"), ("no-warranty", "warrant", "without warrant(?:y|ies)(?: or conditions)? of any kind"), ("no-warranty", "warrant", "provided as is without warranty"),
        ("confidential", "confidential", "(?:strictly |company )?confidential and proprietary"), ("proprietary", "proprietary", "proprietary (?:license|software|and confidential)"), ("copyleft", "copyleft", "copyleft(?:ed)?"),
        ("copyright", "copyright", "copyright (?:c )?(?:by )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2}){0,40}"), ("copyright", "copyright", "(?:see|under) copyright"), ("reserved", "reserved", "(?:all|some|no) rights reserved"),
        ("licensed", "licens", "licensed under(?: the)?(?: terms of)?"), ("licensed", "licens", "released under(?: the)? [^ ]+ license"), ("license-file", "licens", "see (?:the )?license file"), ("license-text", "licens", "you may not use this file except in compliance with the license"),
    ):
        out.append((label, keyword, pattern))
    return out


#: Whatever stands between words, a text without any of these has no match of a rule and no base phrase.
STEMS = (
    "licens", "public", "cc", "creative", "gpl", "apache", "mpl", "bsd", "attribution", "hereby", "redistribution", "wtfpl", "perl", "clause",
    "warrant", "confidential", "proprietary", "copyleft", "copyright", "reserved",
)


def needed(keyword: str, pattern: str) -> str:
    """What a normalised text holds wherever the pattern matches: the words the pattern begins with, from the blank before
    them, or else the rule's keyword."""
    groups = re.compile(r"\(\?:[^()]*\)")
    flat = pattern
    while groups.search(flat):
        flat = groups.sub("", flat)
    plain = re.match("[a-z0-9 ]*", pattern)[0]
    rest = pattern[len(plain) :]
    if rest[:1] in ("?", "{", "*"):
        plain = plain[:-1]
    if "|" in flat or len(plain) < len(keyword):
        return keyword
    return f" {plain}" if rest else f" {plain} "


def _matches(norm: Column, rule: Column) -> Column:
    """Intervals (start, end, priority, label) of one rule in the normalised text, from the pieces between matches."""
    pieces, texts = F.split(norm, rule["pattern"], -1), F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    both = F.arrays_zip(pieces.alias("gap"), texts.alias("hit"))
    nothing = F.array().cast("array<struct<s:int,e:int,rank:int,label:string>>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        row = F.struct(s.alias("s"), e.alias("e"), rule["rank"].alias("rank"), rule["label"].alias("label"))
        return F.struct(F.coalesce(e, s).alias("at"), F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(row))).alias("found"))

    return F.aggregate(both, start, step)["found"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, base, hits, norm): word positions of base phrases, their labels, and the intervals of
    the rules that survive suppression, in characters of the normalised text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    # cut between words: Java finds these runs many times faster than those of the negated class
    pieces = F.array_remove(F.split("text", f"[{_NOT_WORD}]+"), "")
    low = rows.select("doc_id", pieces.alias("pieces"), F.lower("text").alias("low"))
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains("low", F.lit(stem))
    upper = "".join(map(chr, range(65, 91)))
    plain = F.translate(F.array_join("pieces", " "), upper, upper.lower())
    norm = F.when(gate, F.concat(F.lit(" "), plain, F.lit(" ")))
    made = low.select("doc_id", F.size("pieces").cast("bigint").alias("n_words"), norm.alias("norm"))
    words = made.select("*", F.when(F.col("norm").isNotNull(), F.split(F.trim("norm"), " ")).alias("w"))

    def here(i: Column, phrase: str) -> Column:
        out = F.lit(True)
        for k, word in enumerate(phrase.split()):
            out = out & F.coalesce(F.get("w", i + k) == word, F.lit(False))
        return out

    def spots_of(phrase: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: here(i, phrase))

    spots = [spots_of(p).alias(f"b{k}") for k, p in enumerate(BASE)]
    held = F.filter(F.array(*[F.contains("norm", F.lit(f" {p} ")) for p in BASE]), lambda x: x)
    words = words.select("*", F.when(F.size(held) > 0, F.struct(*spots)).alias("spots"))
    keys: dict[str, list[Column]] = {}
    for n, (label, key, p) in enumerate(rules()):
        rule = F.struct(F.lit(n).alias("rank"), F.lit(label).alias("label"), F.lit(needed(key, p)).alias("need"), F.lit(f"(?<= )(?:{p})(?= )").alias("pattern"))
        keys.setdefault(key, []).append(rule)
    table = F.array(*[F.struct(F.lit(key).alias("key"), F.array(*group).alias("rules")) for key, group in keys.items()])
    # of the whole text first, keyword by keyword: most texts hold few
    some = F.flatten(F.transform(F.filter(table, lambda k: F.contains("norm", k["key"])), lambda k: k["rules"]))
    listed = F.filter(some, lambda r: F.contains("norm", r["need"]))
    n_blocks = F.greatest(F.ceil(F.size("w") / BLOCK).cast("int"), F.lit(1))
    numbers = F.sequence(F.lit(0), n_blocks - 1)
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    # where each block begins in the normalised text: one more than the words before it, with a blank after each
    begins = F.aggregate(numbers, F.array(F.lit(1)), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(joined(i * BLOCK + 1, F.lit(BLOCK))) + 1)))

    def block(i: Column) -> Column:
        before = F.least(i * BLOCK, F.lit(MARGIN))
        text = F.concat(F.lit(" "), joined(i * BLOCK + 1 - before, before + BLOCK + MARGIN), F.lit(" "))
        margin = F.when(before > 0, F.length(joined(i * BLOCK + 1 - before, before)) + 1).otherwise(0)
        return F.struct(text.alias("text"), F.get("begins", i).alias("at"), F.get("begins", i + 1).alias("end"), (F.get("begins", i) - 1 - margin).alias("shift"))

    def found(x: Column, listed: Column) -> Column:
        """Intervals that begin in the block and no rule of higher priority holds, in characters of the normalised text."""
        raw = F.flatten(F.transform(F.filter(listed, lambda r: F.contains(x["text"], r["need"])), lambda r: _matches(x["text"], r)))
        kept = F.filter(raw, lambda h: (h["s"] + x["shift"] >= x["at"]) & (h["s"] + x["shift"] < x["end"]) & ~F.exists(raw, lambda g: (g["s"] <= h["s"]) & (g["e"] >= h["e"]) & (g["rank"] < h["rank"])))
        return F.transform(kept, lambda h: F.struct((h["s"] + x["shift"]).alias("s"), (h["e"] + x["shift"]).alias("e"), h["rank"].alias("rank"), h["label"].alias("label")))

    cut_up = words.select("doc_id", "n_words", "norm", "w", "spots", F.when(F.col("norm").isNotNull(), listed).alias("listed"))
    cut_up = cut_up.withColumn("listed", F.when(F.size("listed") > 0, F.col("listed")))
    cut_up = cut_up.withColumn("begins", F.when(F.col("listed").isNotNull(), begins))
    # an array of one element binds the rules: they are chosen once a text, not once a block
    hits = F.transform(F.array("listed"), lambda r: F.flatten(F.transform(F.transform(numbers, block), lambda x: found(x, r))))
    got = cut_up.select("doc_id", "n_words", "norm", "spots", F.when(F.col("listed").isNotNull(), F.get(hits, F.lit(0))).alias("hits"))
    places = F.array_sort(F.concat(*[F.col("spots")[f"b{k}"] for k in range(len(BASE))]))
    base = F.array_compact(F.array(*[F.when(F.size(F.col("spots")[f"b{k}"]) > 0, F.lit(label)) for k, label in enumerate(BASE.values())]))
    return got.select("doc_id", "n_words", "norm", places.alias("places"), base.alias("base"), "hits")


def op9_license_scan(docs: DataFrame) -> DataFrame:
    """Contract columns; ``score`` is the share of the normalised text that surviving rule matches cover."""
    found = scan(docs)
    none = F.array().cast("array<string>")
    base = F.when(F.col("places").isNotNull() & (F.size("places") > 0), F.array_sort("base")).otherwise(none)
    labels = F.array_sort(F.array_distinct(F.concat(base, F.coalesce(F.transform("hits", lambda h: h["label"]), none))))
    cover = F.aggregate(
        F.array_sort("hits"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, h: F.struct(F.greatest(a["end"], h["e"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), h["e"] - F.greatest(a["end"], h["s"]))).alias("sum")),
    )["sum"]
    n_base = F.when(F.col("places").isNotNull(), F.size("places")).otherwise(0).cast("bigint")
    some = n_base > 0
    return found.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.when(some, F.element_at("places", 1)).cast("bigint").alias("first_word"), F.when(some, F.element_at("places", -1)).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("norm").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(cover, F.lit(0)) / F.greatest(F.length("norm") - 2, F.lit(1)))).alias("score"),
    )
