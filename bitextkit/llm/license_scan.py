"""Operator 10, license scans by ordered signature rules.

A document first passes a keyword gate over its raw text; only the few that
pass are normalised to ``word word word`` and tried against the rules whose own
keyword they contain.  The rules (several hundred regular expressions) are the
SPDX identifiers of :data:`SPDX` (as tags, and without a tag where they carry a
version), the written names of :data:`LICENSES` alone and after a verb, the short
names of :data:`SHORT` in their everyday forms, and the notices, headers and
addresses of :data:`OTHER`.  A detection that lies inside another one of the same or a
stronger priority is suppressed (the first in rule order wins between equal
intervals); the labels of the rest are reported.  Everything is an expression
over one row: map-only, no shuffle, no Python.

Defined results: null and empty texts have no words and no labels; repeated
rows are scanned one by one; only the id and text columns are read; an empty
table has no rows; a very long text is scanned whole, in time linear in its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import lower_az, text_of

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"             # in lower-cased text
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD_CHAR = "[a-zA-Z0-9\\x{80}-\\x{10FFFF}]"      # before lower-casing; the commonest range first
GAP_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

# Base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"),
        ("cc by", "cc-by"), ("mit license", "mit")]

V = "(?:version |ver |v ?)?"
ONLY = "(?: only| or later| or (?:at your option )?any later version)?"

# SPDX identifier -> (keyword, name pattern), more specific ones first.
LICENSES = [
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public licen[cs]e {V}3(?: 0)?{ONLY}"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", "agpl", f"agpl ?{V}3(?: 0)?{ONLY}"),
    ("lgpl-2.0", "lesser", f"(?:gnu )?(?:lesser|library) general public licen[cs]e {V}2(?: 0)?{ONLY}"),
    ("lgpl-2.1", "lesser", f"(?:gnu )?lesser general public licen[cs]e {V}2 1{ONLY}"),
    ("lgpl-3.0", "lesser", f"(?:gnu )?lesser general public licen[cs]e {V}3(?: 0)?{ONLY}"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-3.0", "lgpl", f"lgpl ?{V}3(?: 0)?{ONLY}"),
    ("lgpl-2.1", "lgpl", f"lgpl ?{V}2 1{ONLY}"),
    ("gpl-1.0", "general public", f"(?:gnu )?general public licen[cs]e {V}1(?: 0)?{ONLY}"),
    ("gpl-2.0", "general public", f"(?:gnu )?general public licen[cs]e {V}2(?: 0)?{ONLY}"),
    ("gpl-3.0", "general public", f"(?:gnu )?general public licen[cs]e {V}3(?: 0)?{ONLY}"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e"),
    ("gpl-2.0", "gpl", f"(?:gnu )?gpl ?{V}2(?: 0)?{ONLY}"),
    ("gpl-3.0", "gpl", f"(?:gnu )?gpl ?{V}3(?: 0)?{ONLY}"),
    ("gfdl-1.3", "free documentation", f"(?:gnu )?free documentation licen[cs]e {V}1 3{ONLY}"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("apache-1.1", "apache", f"apache (?:software )?licen[cs]e {V}1 1"),
    ("apache-2.0", "apache", f"apache (?:software )?licen[cs]e {V}2(?: 0)?"),
    ("apache", "apache", "apache (?:software )?licen[cs]e"),
    ("apache-2.0", "apache", f"apache {V}2(?: 0)?"),
    ("mit", "mit licen", "mit licen[cs]e"),
    ("mit", "expat", "expat licen[cs]e"),
    ("mit-0", "mit no attribution", "mit no attribution"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("isc", "isc licen", "isc licen[cs]e"),
    ("bsd-2-clause", "bsd", "(?:simplified |freebsd )?bsd 2 clause|bsd 2 clause simplified"),
    ("bsd-3-clause", "bsd", "(?:new |modified |revised )?bsd 3 clause|3 clause bsd"),
    ("bsd-4-clause", "bsd", "bsd 4 clause|original bsd"),
    ("0bsd", "0bsd", "0bsd|zero clause bsd"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("mpl-1.1", "mozilla", f"mozilla public licen[cs]e {V}1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public licen[cs]e {V}2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("mpl-2.0", "mpl", f"mpl ?{V}2(?: 0)?"),
    ("epl-1.0", "eclipse", f"eclipse public licen[cs]e {V}1(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public licen[cs]e {V}2(?: 0)?"),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("cddl-1.0", "common development", "common development and distribution licen[cs]e"),
    ("cpl-1.0", "common public", "common public licen[cs]e"),
    ("eupl-1.2", "european union public", f"european union public licen[cs]e(?: {V}1 2)?"),
    ("artistic-2.0", "artistic", f"artistic licen[cs]e {V}2(?: 0)?"),
    ("artistic-1.0", "artistic", "artistic licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("bsl-1.0", "boost", "boost software licen[cs]e"),
    ("busl-1.1", "business source", "business source licen[cs]e"),
    ("sspl-1.0", "server side public", "server side public licen[cs]e"),
    ("psf-2.0", "python software", "python software foundation licen[cs]e"),
    ("php-3.01", "php licen", "php licen[cs]e"),
    ("ruby", "ruby licen", "ruby licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e"),
    ("odbl-1.0", "open database", "open database licen[cs]e|odbl"),
    ("odc-by-1.0", "open data commons", "open data commons attribution licen[cs]e"),
    ("pddl-1.0", "public domain dedication and", "public domain dedication and licen[cs]e"),
    ("ogl-uk-3.0", "open government", "open government licen[cs]e"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e"),
    ("osl-3.0", "open software licen", "open software licen[cs]e"),
    ("afl-3.0", "academic free", "academic free licen[cs]e"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", "creative commons zero"),
]
# Creative Commons names follow one rule: modules in order, then the version.
CC_MODULES = [("by-nc-nd", ["noncommercial", "no ?derivatives|noderivs"]), ("by-nc-sa", ["noncommercial", "share ?alike"]),
              ("by-nc", ["noncommercial"]), ("by-nd", ["no ?derivatives|noderivs"]), ("by-sa", ["share ?alike"]), ("by", [])]
for _m, _names in CC_MODULES:
    for _v in ("4.0", "3.0", "2.5", "2.0", ""):
        _ver = (" " + V + _v.replace(".", " ")) if _v else ""
        _long = "".join(f" (?:{n.replace('noncommercial', 'non ?commercial')})" for n in _names)
        LICENSES.append((f"cc-{_m}" + (f"-{_v}" if _v else ""), "cc by", f"cc {_m.replace('-', ' ')}{_ver}"))
        LICENSES.append((f"cc-{_m}" + (f"-{_v}" if _v else ""), "creative commons",
                         f"creative commons attribution{_long}(?: international| unported)?(?: licen[cs]e)?{_ver}"))

# SPDX identifiers; the label is the identifier without "-only" and "-or-later".
SPDX = """0BSD AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0
Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause
BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-3.0
CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CECILL-B CECILL-C CPL-1.0 curl ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1 GFDL-1.2
GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later
GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1
MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0
PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11
Zlib ZPL-2.0 ZPL-2.1""".split()
TAG_ONLY = {"mit-0", "php-3.0", "php-3.01", "python-2.0", "ipl-1.0", "cal-1.0", "upl-1.0"}   # else no licence for certain
# Short name -> label, for the everyday forms in which a licence is only named.
SHORT = {"mit": "mit", "isc": "isc", "bsd": "bsd", "gpl": "gpl", "gnu gpl": "gpl", "lgpl": "lgpl", "gnu lgpl": "lgpl",
         "agpl": "agpl", "gnu agpl": "agpl", "apache": "apache", "mpl": "mpl", "epl": "epl", "eupl": "eupl-1.2",
         "cddl": "cddl-1.0", "zlib": "zlib", "expat": "mit", "x11": "x11", "cc0": "cc0-1.0", "gfdl": "gfdl", "ofl": "ofl-1.1",
         "wtfpl": "wtfpl", "unlicense": "unlicense"}
VERB = "(?:licen[cs]ed|released|distributed|published|available|covered|provided|offered) under "
TERMS = "(?:(?:the )?terms (?:and conditions )?of )?"
# Versions of short names beside the ones in LICENSES: (label, keyword, pattern, example).
VERSIONS = [
    ("gpl-1.0", "gpl", f"(?:gnu )?gpl ?{V}1(?: 0)?{ONLY}", "GPLv1"),
    ("agpl-1.0", "agpl", f"(?:gnu )?agpl ?{V}1(?: 0)?{ONLY}", "AGPLv1"),
    ("lgpl-2.0", "lgpl", f"(?:gnu )?lgpl ?{V}2(?: 0)?{ONLY}", "LGPLv2+"),
    ("mpl-1.1", "mpl", f"mpl ?{V}1 1", "MPLv1.1"),
    ("epl-1.0", "epl", f"epl ?{V}1(?: 0)?", "EPLv1.0"),
    ("epl-2.0", "epl", f"epl ?{V}2(?: 0)?", "EPL v2"),
    ("eupl-1.1", "eupl", f"eupl ?{V}1 1", "EUPLv1.1"),
    ("eupl-1.2", "eupl", f"eupl ?{V}1 2", "EUPL v1.2"),
    ("gfdl-1.2", "gfdl", f"(?:gnu )?gfdl ?{V}1 2{ONLY}", "GFDL v1.2"),
    ("gfdl-1.3", "gfdl", f"(?:gnu )?gfdl ?{V}1 3{ONLY}", "GFDLv1.3"),
    ("apache-2.0", "asl", f"asl ?{V}2(?: 0)?", "ASLv2"),
]
FSF = " as published by the free software foundation (?:either )?version "
for _l, _n in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero ")):
    for _v, _e in (("1.0", "1"), ("2.0", "2"), ("2.1", "2 1"), ("3.0", "3")):
        if (_l, _v) not in (("gpl", "2.1"), ("lgpl", "1.0"), ("agpl", "2.0"), ("agpl", "2.1")):
            VERSIONS.append((f"{_l}-{_v}", f"{_n}general public license as published",
                             f"gnu {_n}general public license{FSF}{_e}(?: 0)?(?: of the license)?{ONLY}",
                             f"GNU {_n}General Public License as published by the Free Software Foundation; "
                             f"either version {_e.replace(' ', '.')} of the License, or (at your option) any later version"))

OTHER = [
    ("all-rights-reserved", 3, "rights reserved", "all rights reserved"),
    ("public-domain", 3, "public domain", "(?:in|into|to) the public domain"),
    ("proprietary", 3, "proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("apache-2.0", 1, "apache org", "www apache org licenses license 2 0"),
    ("gpl", 1, "gnu org", "www gnu org licenses gpl"),
    ("mit", 1, "opensource org", "opensource org licenses mit"),
    ("mpl-2.0", 1, "mozilla org", "mozilla org mpl 2 0"),
    ("cc", 1, "creativecommons org", "creativecommons org licenses by[a-z ]*"),
    ("mit", 2, "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 2, "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 2, "redistribution and use", "redistribution and use in source and binary forms with or without modification"),
    ("apache-2.0", 2, "may not use this file", "you may not use this file except in compliance with the license"),
    ("mpl-2.0", 2, "source code form is subject",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd-3-clause", 2, "neither the name", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors"),
    ("zlib", 2, "in no event will the authors",
     "without any express or implied warranty in no event will the authors be held liable"),
    ("gpl", 2, "this program is free software", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", 2, "this library is free software", "this library is free software you can redistribute it and or modify it"),
    ("unlicense", 2, "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("bsl-1.0", 2, "any person or organization",
     "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("openssl", 2, "developed by the openssl", "this product includes software developed by the openssl project"),
    ("agpl-3.0", 1, "gnu org", "www gnu org licenses agpl 3 0"),
    ("lgpl-3.0", 1, "gnu org", "www gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", 1, "gnu org", "www gnu org licenses old licenses lgpl 2 1"),
    ("gpl-2.0", 1, "gnu org", "www gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", 1, "gnu org", "www gnu org licenses gpl 3 0"),
    ("bsd-3-clause", 1, "opensource org", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 1, "opensource org", "opensource org licenses bsd 2 clause"),
    ("isc", 1, "opensource org", "opensource org licenses isc"),
    ("apache-2.0", 1, "opensource org", "opensource org licenses apache 2 0"),
    ("bsl-1.0", 1, "boost org", "www boost org license 1 0"),
    ("epl-2.0", 1, "eclipse org", "www eclipse org legal epl (?:v20|2 0)"),
    ("epl-1.0", 1, "eclipse org", "www eclipse org legal epl v10"),
    ("cc0-1.0", 1, "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("ofl-1.1", 1, "sil org", "scripts sil org ofl"),
    ("unknown-license", 4, "licen", "(?:licen[cs]ed|released|distributed) under [^ ]+ [^ ]+ [^ ]+"),
    ("copyright", 4, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
]
# Beginnings of what the rules match; a space stands for any gap.  A text without one has no licence.
GATE_PHRASES = """licen|unlicen|spdx|affero|gpl|lgpl|agpl|general public|free documentation|free software|free and unencumbered|apache|expat
mit no|0bsd|bsd|x11|mozilla|mpl|eclipse|zlib|odbl|wtfpl|cc0|cc by|creative commons|rights reserved|public domain|proprietary
copyright|creativecommons|opensource org|permission|redistribution|gnu org|boost org|sil org|neither the name
may not use this file|source code form|no event|openssl|ms pl|ms rl|unicode dfs|odc by|cecill""".replace("\n", "|").split("|")


def gate() -> str:
    """The gate's pattern.  It tries its branches at the beginnings of words
    only, and only those of the first letter at hand."""
    gap = GAP_ANY_CASE
    short = "(?:" + "|".join(n.replace(" ", gap) for n in SHORT) + ")(?![a-z0-9_])"
    tags = sorted({x.split("-")[0].lower() for x in SPDX if "-" in x and x.lower() not in TAG_ONLY} | {"asl"})
    branches = [p.replace(" ", gap) for p in GATE_PHRASES] + [f"{x}(?:{gap})?[0-9v]" for x in tags] + [
        f"{x}{gap}(?:the{gap})?{short}" for x in ("under", "of")]
    letters = sorted({x[0] for x in branches})
    return f"(?<!{WORD_CHAR})(?i:" + "|".join(
        f"{c}(?:" + "|".join(x[1:] for x in branches if x[0] == c) + ")" for c in letters) + ")"


GATE = gate()
CONFIDENCE = {1: 0.99, 2: 0.9, 3: 0.7, 4: 0.4}


def spdx_words(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


def signatures() -> list[tuple[str, int, str, str, str | None]]:
    """(label, priority, keyword, pattern, example) in rule order; no example
    where the pattern is a written name or notice."""
    out = []
    for name in SPDX:
        label, words = name.lower().removesuffix("-only").removesuffix("-or-later"), spdx_words(name)
        out.append((label, 1, f"identifier {words}", f"spdx licen[cs]e identifier {words}", f"SPDX-License-Identifier: {name}"))
        if " " in words and label not in TAG_ONLY:
            out.append((label, 3, words, words, f"deps: {name}"))
    for label, key, pat, example in VERSIONS:
        out.append((label, 2, key, f"{VERB}{TERMS}(?:the )?(?:{pat})", f"available under the {example}"))
        out.append((label, 3, key, pat, example))
    for name, label in SHORT.items():
        out.append((label, 2, f"the {name}", f"{VERB}{TERMS}the {name}", f"Released under the terms of the {name.upper()}."))
        out.append((label, 2, f"under {name}", f"{VERB}{name}", f"distributed under {name.upper()}."))
        out.append((label, 2, f"{name} licen", f"{name} licen[cs]ed", f"It is {name.upper()}-licensed."))
    for label, key, name in LICENSES:
        out.append((label, 2, key, f"{VERB}{TERMS}(?:the )?(?:{name})", None))
        out.append((label, 3, key, f"(?:{name})", None))
    out = [(label, prio, key, f"(?<= )(?:{pat})(?= )", example) for label, prio, key, pat, example in out]
    return out + [(label, prio, key, f"(?<= )(?:{pat})(?= )", None) for label, prio, key, pat in OTHER]


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) in rule order."""
    return [x[:4] for x in signatures()]


def _rule_array(table) -> Column:
    """The rules as one constant array (parsed from one literal, so that the
    plan does not hold a thousand of them)."""
    import json
    body = json.dumps([{"n": i, "label": a, "p": b, "key": c, "pat": d}
                       for i, (a, b, c, d) in enumerate(table)])
    return F.from_json(F.lit(body), "array<struct<n:int,label:string,p:int,key:string,pat:string>>")


SPAN_BLOCK = 256                 # matches whose places are summed up in one array


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def match_spans(text: Column, pattern: Column) -> Column:
    """(s, e) of every non-overlapping match, in characters from 0, e exclusive.

    A match begins where the pieces and matches before it end.  The lengths are
    summed up in blocks, first over the blocks and then within each, so the
    work grows with the matches and not with their square."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def walk(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), lambda acc, x: F.struct(
            (acc["at"] + x["b"] + x["m"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("s"),
                                                  (acc["at"] + x["b"] + x["m"]).alias("e")))).alias("out")),
            lambda acc: acc["out"])

    def starts(blocks):
        """Where each block begins: sums of the blocks before it."""
        return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(
            F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda n, x: n + x["b"] + x["m"]))))

    def placed(lengths):
        blocks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(SPAN_BLOCK)),
                             lambda i: F.slice(lengths, i, F.lit(SPAN_BLOCK)))
        return F.when(F.size(lengths) <= SPAN_BLOCK, walk(lengths, F.lit(0))).otherwise(
            _with(blocks, lambda bs: F.flatten(F.transform(F.filter(
                F.zip_with(bs, starts(bs), lambda b, at: F.struct(b.alias("b"), at.alias("at"))),
                lambda z: z["b"].isNotNull()), lambda z: walk(z["b"], z["at"])))))

    def lengths(found):
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        return F.zip_with(F.transform(found, lambda x: F.length(x)),
                          F.slice(between, F.lit(1), F.size(found)),
                          lambda m, b: F.struct(m.alias("m"), b.alias("b")))

    return _with(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(
        F.size(found) > 0, _with(lengths(found), placed)).otherwise(empty))


def word_form(text: Column) -> Column:
    """`` word word `` : lower-cased words between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_az(text), GAP, " ")), F.lit(" "))


def scan_licenses(docs: DataFrame, table=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_detections`` for every row."""
    text = F.col("_t")
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    d = d.select("doc_id", F.regexp_count(text, F.lit(WORD_CHAR + "++")).cast("long").alias("n_words"),
                 F.when(text.rlike(GATE), word_form(text)).alias("_w"))
    w = F.col("_w")
    union = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"

    def words_in(prefix: Column) -> Column:
        return (F.length(prefix) - F.length(F.translate(prefix, " ", "")) - 1).cast("long")

    table = rules() if table is None else table
    tried = F.filter(_rule_array(table), lambda r: F.contains(w, r["key"]))
    found = F.flatten(F.transform(tried, lambda r: F.transform(
        match_spans(w, r["pat"]), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), r["p"].alias("p"),
                                                     r["n"].alias("n"), r["label"].alias("label")))))
    d = d.select(
        "doc_id", "n_words", "_w",
        F.coalesce(F.regexp_count(w, F.lit(union)), F.lit(0)).cast("long").alias("n_base"),
        F.when(w.isNotNull(), F.array_sort(found)).alias("_f"))
    top = max(p for _, p, _, _ in table)
    names = [f"m{p}" for p in range(1, top + 1)]

    def step(acc, x):
        inside = F.greatest(*[F.when(x["p"] >= p, acc[f"m{p}"]).otherwise(-1) for p in range(1, top + 1)],
                            F.lit(-1)) >= -x["ne"]
        return F.struct(
            *[F.when(x["p"] == p, F.greatest(acc[f"m{p}"], -x["ne"])).otherwise(acc[f"m{p}"]).alias(f"m{p}")
              for p in range(1, top + 1)],
            F.when(inside, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"),
            F.when(inside, acc["best"]).otherwise(F.least(acc["best"], x["p"])).alias("best"),
            F.when(inside, acc["labels"]).otherwise(
                F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"))

    start = F.struct(*[F.lit(-1).alias(n) for n in names], F.lit(0).alias("kept"), F.lit(top + 1).alias("best"),
                     F.array().cast("array<string>").alias("labels"))
    has = F.col("n_base") > 0
    d = d.select(
        "doc_id", "n_words", "n_base",
        F.when(has, words_in(F.split(w, union, 2)[0])).alias("first_word"),
        F.when(has, words_in(F.regexp_extract(w, "(?s)^(.*)" + union, 1))).alias("last_word"),
        F.array_compact(F.array(*[F.when(has & F.contains(w, F.lit(f" {p} ")), F.lit(label))
                                  for p, label in BASE])).alias("_b"),
        F.aggregate(F.coalesce(F.col("_f"), F.array().cast(d.schema["_f"].dataType)), start, step).alias("_r"))
    score = F.coalesce(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("_r.best")],
                       F.when(has, F.lit(0.5)), F.lit(0.0))
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_b"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_b", F.col("_r.labels"))), ",").alias("labels"),
        score.alias("score"), F.col("_r.kept").cast("long").alias("n_detections"))
