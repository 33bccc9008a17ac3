"""License scans: ordered signature rules behind a keyword prefilter.

Base labels come from four phrases of consecutive words. The signature rules, some
370 regular expressions, add labels of their own: names of licences in six settings,
short spellings of versions, and sentences of licence texts and notices. A rule runs
only where the text holds words that each of its matches holds. Overlapping detections
are settled by priority and containment: one that lies inside another of the same or a
better priority is suppressed; of equal spans the rule that stands first.

Everything is a projection of built-in functions: no shuffle and no Python.

Defined results: a null text counts as empty: no words, no labels, score 0. Rows map
one to one, repeated ones too, and an empty table gives none. Long texts are scanned
whole, in time that grows with the text and its matches. Columns beside doc_id and text
are never read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.functions.text import all_spans, let
from glosswright.llm._common import ascii_lower

# The base phrases and their labels.
PHRASES = (
    (("gnu", "general", "public", "license"), "gpl"),
    (("apache", "license"), "apache"),
    (("cc", "by"), "cc-by"),
    (("mit", "license"), "mit"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

KEPT = "array<struct<label:string,confidence:double>>"

_S = r"[\s\-_,.'\"()]{1,4}"  # what may stand between two words of a name
_V = r"(?:,?\s{0,2}(?:version\s{0,2}|v\.?\s{0,2}))?"

# Label, words that every match of the name holds (| between alternatives), pattern of the name, SPDX identifiers. Lower case.
FAMILIES = (
    ("agpl-3.0", "affero licen", rf"(?:gnu{_S})?affero{_S}general{_S}public{_S}licen[cs]e", r"agpl-3\.0(?:-only|-or-later)?"),
    ("gpl-2.0", "gnu licen", rf"gnu{_S}general{_S}public{_S}licen[cs]e{_V}2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "gnu licen", rf"gnu{_S}general{_S}public{_S}licen[cs]e{_V}3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "lesser licen", rf"(?:gnu{_S})?lesser{_S}general{_S}public{_S}licen[cs]e{_V}2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3.0", "lesser licen", rf"(?:gnu{_S})?lesser{_S}general{_S}public{_S}licen[cs]e{_V}3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    ("gfdl", "documentation licen", rf"gnu{_S}free{_S}documentation{_S}licen[cs]e", r"gfdl-1\.[123](?:-only|-or-later)?"),
    ("apache-1.1", "apache licen", rf"apache{_S}(?:software{_S})?licen[cs]e{_V}1\.1", r"apache-1\.1"),
    ("apache-2.0", "apache licen", rf"apache{_S}(?:software{_S})?licen[cs]e{_V}2(?:\.0)?", r"apache-2\.0"),
    ("mit", "mit licen", rf"(?:the{_S})?mit{_S}licen[cs]e", r"mit"),
    ("mit-0", "mit attribution", rf"mit{_S}no{_S}attribution", r"mit-0"),
    ("x11", "x11 licen", rf"x11{_S}licen[cs]e", r"x11"),
    ("isc", "isc licen", rf"isc{_S}licen[cs]e", r"isc"),
    ("bsd-2-clause", "bsd", rf"(?:simplified|freebsd|2-clause|two-clause){_S}bsd(?:{_S}licen[cs]e)?|bsd{_S}2{_S}clause", r"bsd-2-clause(?:-patent)?"),
    ("bsd-3-clause", "bsd", rf"(?:new|modified|revised|3-clause|three-clause){_S}bsd(?:{_S}licen[cs]e)?|bsd{_S}3{_S}clause", r"bsd-3-clause(?:-clear)?"),
    ("bsd-4-clause", "bsd", rf"(?:original|4-clause|four-clause){_S}bsd(?:{_S}licen[cs]e)?|bsd{_S}4{_S}clause", r"bsd-4-clause"),
    ("0bsd", "bsd", rf"(?:zero-clause|0-clause){_S}bsd", r"0bsd"),
    ("mpl-1.1", "mozilla licen", rf"mozilla{_S}public{_S}licen[cs]e{_V}1\.1", r"mpl-1\.1"),
    ("mpl-2.0", "mozilla licen", rf"mozilla{_S}public{_S}licen[cs]e{_V}2(?:\.0)?", r"mpl-2\.0"),
    ("epl-1.0", "eclipse licen", rf"eclipse{_S}public{_S}licen[cs]e{_V}1(?:\.0)?", r"epl-1\.0"),
    ("epl-2.0", "eclipse licen", rf"eclipse{_S}public{_S}licen[cs]e{_V}2(?:\.0)?", r"epl-2\.0"),
    ("cddl-1.0", "development distribution licen", rf"common{_S}development{_S}and{_S}distribution{_S}licen[cs]e", r"cddl-1\.[01]"),
    ("cpl-1.0", "common public licen", rf"common{_S}public{_S}licen[cs]e", r"cpl-1\.0"),
    ("eupl", "european union licen", rf"european{_S}union{_S}public{_S}licen[cs]e", r"eupl-1\.[012]"),
    ("cecill", "cecill licen", rf"cecill(?:{_S}free{_S}software)?{_S}licen[cs]e", r"cecill-(?:1\.[01]|2\.[01]|b|c)"),
    ("artistic-1.0", "artistic licen", rf"artistic{_S}licen[cs]e{_V}1(?:\.0)?", r"artistic-1\.0(?:-perl)?"),
    ("artistic-2.0", "artistic licen", rf"artistic{_S}licen[cs]e{_V}2(?:\.0)?", r"artistic-2\.0"),
    ("boost", "boost licen", rf"boost{_S}software{_S}licen[cs]e", r"bsl-1\.0"),
    ("zlib", "zlib licen", rf"zlib(?:/libpng)?{_S}licen[cs]e", r"zlib"),
    ("libpng", "libpng licen", rf"libpng{_S}licen[cs]e", r"libpng(?:-2\.0)?"),
    ("openssl", "openssl licen", rf"openssl{_S}licen[cs]e", r"openssl"),
    ("php", "php licen", rf"php{_S}licen[cs]e", r"php-3\.0?1?"),
    ("python", "python licen", rf"python{_S}(?:software{_S}foundation{_S})?licen[cs]e", r"(?:psf|python)-2\.0"),
    ("ruby", "ruby licen", rf"ruby{_S}licen[cs]e", r"ruby"),
    ("postgresql", "postgresql licen", rf"postgresql{_S}licen[cs]e", r"postgresql"),
    ("ncsa", "ncsa licen", rf"(?:university{_S}of{_S}illinois/)?ncsa{_S}open{_S}source{_S}licen[cs]e", r"ncsa"),
    ("ms-pl", "microsoft public licen", rf"microsoft{_S}public{_S}licen[cs]e", r"ms-pl"),
    ("ms-rl", "microsoft reciprocal licen", rf"microsoft{_S}reciprocal{_S}licen[cs]e", r"ms-rl"),
    ("ofl-1.1", "font licen", rf"(?:sil{_S})?open{_S}font{_S}licen[cs]e", r"ofl-1\.[01]"),
    ("odbl-1.0", "database licen", rf"open{_S}database{_S}licen[cs]e", r"odbl-1\.0"),
    ("odc-by", "commons attribution licen", rf"open{_S}data{_S}commons{_S}attribution{_S}licen[cs]e", r"odc-by-1\.0"),
    ("pddl", "domain dedication licen", rf"public{_S}domain{_S}dedication{_S}and{_S}licen[cs]e", r"pddl-1\.0"),
    ("unlicense", "unlicense", r"(?:the\s)?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl|fuck licen", rf"wtfpl|do{_S}what{_S}the{_S}fuck{_S}you{_S}want{_S}to{_S}public{_S}licen[cs]e", r"wtfpl"),
    ("beerware", "beer licen", rf"beer-?ware{_S}licen[cs]e", r"beerware"),
    ("cc0-1.0", "cc0", r"cc0(?:\s{0,2}1\.0)?(?:\suniversal)?", r"cc0-1\.0"),
    ("cc-by-nc-nd", "cc by nc", rf"cc{_S}by{_S}nc{_S}nd", r"cc-by-nc-nd-[1-4]\.\d"),
    ("cc-by-nc-sa", "cc by nc", rf"cc{_S}by{_S}nc{_S}sa", r"cc-by-nc-sa-[1-4]\.\d"),
    ("cc-by-nc", "cc by nc", rf"cc{_S}by{_S}nc(?!{_S}(?:nd|sa))", r"cc-by-nc-[1-4]\.\d"),
    ("cc-by-nd", "cc by nd", rf"cc{_S}by{_S}nd", r"cc-by-nd-[1-4]\.\d"),
    ("cc-by-sa", "cc by sa", rf"cc{_S}by{_S}sa", r"cc-by-sa-[1-4]\.\d"),
    ("cc-by", "cc by", rf"cc{_S}by(?!{_S}(?:nc|nd|sa))", r"cc-by-[1-4]\.\d"),
    ("creative-commons", "creative commons licen", rf"creative{_S}commons(?:{_S}attribution)?(?:{_S}\w{{2,20}}){{0,3}}{_S}licen[cs]e", r"cc-[a-z-]{2,12}"),
    ("proprietary", "rights reserved", rf"all{_S}rights{_S}reserved", r"licenseref-proprietary"),
)

#: Templates around a family's name: priority (smaller is better), confidence, pattern.
TEMPLATES = (
    (1, 1.0, r"spdx-license-identifier:\s{{0,4}}(?:{spdx})(?![\w.-])"),
    (2, 0.95, r"(?:licen[cs]ed|released|distributed|available|published|provided)\s{{1,3}}(?:under|with|by)\s{{1,3}}(?:the\s{{1,3}})?(?:terms\s{{1,3}}of\s{{1,3}})?(?:the\s{{1,3}})?(?:{name})"),
    (3, 0.9, r"(?:subject\s{{1,3}}to|governed\s{{1,3}}by|in\s{{1,3}}accordance\s{{1,3}}with|under)\s{{1,3}}(?:the\s{{1,3}})?(?:terms\s{{1,3}}of\s{{1,3}}the\s{{1,3}})?(?:{name})"),
    (4, 0.9, r"licen[cs]e\s{{0,2}}[:=]\s{{0,3}}[\"']?(?:{name}|{spdx})(?![\w-])"),
    (5, 0.8, r"(?<![\w-])(?:{name})(?![\w])"),
    (6, 0.7, r"(?<![\w.-])licen[cs]es?/(?:{spdx})(?![\w.-])"),
)


_T = r"[\s\-_,.;:'\"()*#/]{1,12}"  # what may stand between two words of a licence text, comment marks too

# Sentences that licence texts and notices hold, punctuation aside. Label, words.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("x11", "the name of the x consortium shall not be used in advertising or otherwise to promote the sale"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
)

# Short spellings of versions. Label, word that every match holds, pattern.
SHORT = (
    ("gpl-2.0", "gpl", r"gpl[\s-]?v?2(?:\.0)?(?:\+)?"), ("gpl-3.0", "gpl", r"gpl[\s-]?v?3(?:\.0)?(?:\+)?"), ("lgpl-2.1", "lgpl", r"lgpl[\s-]?v?2\.1(?:\+)?"),
    ("lgpl-3.0", "lgpl", r"lgpl[\s-]?v?3(?:\.0)?(?:\+)?"), ("agpl-3.0", "agpl", r"agpl[\s-]?v?3(?:\.0)?(?:\+)?"), ("apache-2.0", "asl", r"asl[\s-]?v?2(?:\.0)?"),
    ("apache-2.0", "apache", r"apache[\s-]?v?2(?:\.0)?"), ("mpl-2.0", "mpl", r"mpl[\s-]?v?2(?:\.0)?"), ("epl-1.0", "epl", r"epl[\s-]?v?1(?:\.0)?"), ("epl-2.0", "epl", r"epl[\s-]?v?2(?:\.0)?"),
    ("bsd-2-clause", "bsd", r"bsd[\s-]?2"), ("bsd-3-clause", "bsd", r"bsd[\s-]?3"), ("cddl-1.0", "cddl", r"cddl[\s-]?v?1(?:\.[01])?"), ("eupl", "eupl", r"eupl[\s-]?v?1(?:\.[012])?"),
    ("artistic-2.0", "artistic", r"artistic[\s-]?2(?:\.0)?"), ("ofl-1.1", "ofl", r"ofl[\s-]?v?1(?:\.[01])?"),
)


@dataclass(frozen=True)
class Signature:
    order: int
    priority: int
    confidence: float
    keyword: str
    regex: str
    label: str


def _rare(words: str) -> str:
    """The two longest words of a sentence, which every match of it holds."""
    return " ".join(sorted(dict.fromkeys(words.split()), key=lambda w: (-len(w), w))[:2])


def _signatures() -> tuple[Signature, ...]:
    named = [
        (priority, confidence, "spdx" if priority == 1 else "licen" if priority in (4, 6) else keyword, template.format(name=name, spdx=spdx), label)
        for priority, confidence, template in TEMPLATES
        for label, keyword, name, spdx in FAMILIES
    ]
    notices = [(2, 0.95, _rare(words), r"(?<![\w-])" + words.replace(" ", _T) + r"(?![\w])", label) for label, words in TEXTS]
    short = [(5, 0.8, keyword, rf"(?<![\w-])(?:{regex})(?![\w])", label) for label, keyword, regex in SHORT]
    return tuple(Signature(i, *s) for i, s in enumerate([*named, *notices, *short]))


SIGNATURES = _signatures()


def alternatives(keyword: str) -> list[list[str]]:
    """Lists of words; a text that a rule matches holds all words of one of them."""
    return [a.split() for a in keyword.split("|")]


WORDS = tuple(sorted({w for s in SIGNATURES for ws in alternatives(s.keyword) for w in ws}))


def _fetched(low: Column, held: Column) -> Column:
    """The rules that may match: their keywords are held, and one of their group matches.

    A group, the rules of one keyword, is one alternation that stands in the plan and is
    compiled once. Only where it matches its rules run one by one.
    """
    groups: dict[str, list[Signature]] = {}
    for s in SIGNATURES:
        groups.setdefault(s.keyword, []).append(s)
    one = lambda s: F.struct(F.lit(s.priority).alias("priority"), F.lit(s.order).alias("order"), F.lit(s.confidence).alias("confidence"), F.lit(s.regex).alias("regex"), F.lit(s.label).alias("label"))
    out = []
    for keyword, rules in groups.items():
        fits = F.lit(False)
        for words in alternatives(keyword):
            fits = fits | F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(held, w))
        some = F.lit("|".join(f"(?:{s.regex})" for s in rules))
        found = F.array(*map(one, rules))
        out.append(F.when(fits & F.rlike(low, some), found))
    return F.flatten(F.filter(F.array(*out), lambda rules: rules.isNotNull()))


def _spans(text: Column, rule: Column) -> Column:
    """All matches of the rule as struct(start, stop, priority, order, confidence, label)."""
    found = all_spans(text, rule["regex"])
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["confidence"].alias("confidence"), rule["label"].alias("label")))


def _settle(found: Column) -> Column:
    """struct(label, confidence) of the detections inside no other one of the same or a better priority.

    In order of start, of two with the same start the longer first, a detection is
    inside an earlier one exactly when that one ends no earlier. So it's enough to
    carry the furthest end for each priority, and each label's best confidence: what
    the fold carries doesn't grow with the detections.
    """
    keyed = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("a"), (-d["stop"]).alias("b"), d["priority"].alias("p"), d["order"].alias("o"), d["confidence"].alias("confidence"), d["label"].alias("label"))))
    none = F.array().cast(KEPT)
    levels = max(p for p, _, _ in TEMPLATES)
    state = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), none.alias("out"))

    def step(acc: Column, d: Column) -> Column:
        stop, out = -d["b"], acc["out"]
        inside = F.array_max(F.slice(acc["ends"], F.lit(1), d["p"])) >= stop
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == d["p"] - 1, F.greatest(e, stop)).otherwise(e))
        mine = F.struct(d["label"].alias("label"), d["confidence"].alias("confidence"))
        better = F.transform(out, lambda k: F.struct(k["label"].alias("label"), F.when(k["label"] == d["label"], F.greatest(k["confidence"], d["confidence"])).otherwise(k["confidence"]).alias("confidence")))
        known = F.exists(out, lambda k: k["label"] == d["label"])
        return F.struct(ends.alias("ends"), F.when(inside, out).when(known, better).otherwise(F.concat(out, F.array(mine))).alias("out"))

    return F.aggregate(keyed, state, step)["out"]


def report(docs: DataFrame) -> DataFrame:
    """Base places and labels, all labels and a score for each row."""
    low = F.col("low")
    phrase = F.lit(False)
    for ws, _ in PHRASES:
        both = F.lit(True)
        for w in ws:
            both = both & F.contains(low, F.lit(w))
        phrase = phrase | both
    no_words, no_ints = F.array().cast("array<string>"), F.array().cast("array<int>")
    words = F.col("words")

    def places(ws: tuple[str, ...]) -> Column:
        def here(i: Column) -> Column:
            fits = F.lit(True)
            for k, w in enumerate(ws):
                fits = fits & F.get(words, i + k).eqNullSafe(F.lit(w))
            return fits

        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)

    held = F.col("held")
    detections = lambda rules: _settle(F.flatten(F.transform(rules, lambda r: _spans(low, r))))
    at = [f"at_{i}" for i in range(len(PHRASES))]
    base = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    base = base.withColumn("n_words", F.regexp_count(low, F.lit(WORD)).cast("long"))
    # a text is searched once for each word
    base = base.withColumn("held", F.filter(F.array(*map(F.lit, WORDS)), lambda w: F.contains(low, w)))
    base = base.withColumn("words", F.when(phrase, F.regexp_extract_all(low, F.lit(WORD), F.lit(0))).otherwise(no_words))
    base = base.withColumns({c: F.when(F.size(words) > 0, places(ws)).otherwise(no_ints) for c, (ws, _) in zip(at, PHRASES, strict=True)})
    base = base.withColumn("found", F.when(F.size(held) > 0, let(_fetched(low, held), detections)).otherwise(F.array().cast(KEPT)))
    starts = F.concat(*at)
    base_labels = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(at, PHRASES, strict=True))), lambda x: x.isNotNull())))
    base = base.withColumn("starts", starts).withColumn("base", base_labels)
    more = F.transform("found", lambda d: d["label"])
    confidence = F.coalesce(F.array_max(F.transform("found", lambda d: d["confidence"])), F.lit(0.0))
    return base.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.greatest(confidence, F.when(F.size("base") > 0, F.lit(0.8)).otherwise(F.lit(0.0))).alias("score"),
    )
