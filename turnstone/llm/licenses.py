"""Operator 4, license scans: ordered signature rules, in DataFrame functions only.

Texts become words; a text whose words pass one keyword test is scanned further. There each
rule runs only if its own keywords are in the text. A rule's regex works on words joined by
single spaces, so a match is an interval of words. The rules, best first: passages of license
texts and standard file headers, written by hand; the identifiers of an SPDX line, each of an
expression with "and", "or" and "with" by itself; names with versions and grants ("licensed
under ..."), made from families, versions and templates.

Detections that lie within another one are suppressed (of equal ones the better rule stays).
Of those that overlap otherwise the one of the better rule stays, then the earlier one. All
of this happens within a row: nothing is shuffled, broadcast or collected.

The base places (``PHRASES``) are found the same way but never suppressed.

Cases: null text counts as empty: no words, score 0; other columns pass through, columns of
the names made here are replaced; repeated rows give repeated results; the score of a text
without detections is 0. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Families: label, gate word, regex of the name in words, versions (regex by label suffix).
_V1, _V2, _V3 = "1( 0)?", "2( 0)?", "3( 0)?"
_FAMILIES = [
    ("mit", "mit", "(the )?mit", {}),
    ("mit-0", "mit", "(the )?mit (no attribution|0)", {}),
    ("expat", "expat", "(the )?expat", {}),
    ("x11", "x11", "(the )?x11", {}),
    ("isc", "isc", "(the )?isc", {}),
    ("apache", "apache", "(the )?apache( software)?", {"1": _V1, "1.1": "1 1", "2": _V2}),
    ("gpl", "gpl", "(the )?(gnu )?gpl", {"1": _V1, "2": _V2, "3": _V3}),
    ("gpl", "general", "(the )?gnu general public", {"1": _V1, "2": _V2, "3": _V3}),
    ("lgpl", "lgpl", "(the )?(gnu )?lgpl", {"2": _V2, "2.1": "2 1", "3": _V3}),
    ("lgpl", "lesser", "(the )?gnu lesser general public", {"2.1": "2 1", "3": _V3}),
    ("lgpl", "library", "(the )?gnu library general public", {"2": _V2}),
    ("agpl", "agpl", "(the )?(gnu )?agpl", {"1": _V1, "3": _V3}),
    ("agpl", "affero", "(the )?(gnu )?affero general public", {"1": _V1, "3": _V3}),
    ("gfdl", "documentation", "(the )?gnu free documentation", {"1.1": "1 1", "1.2": "1 2", "1.3": "1 3"}),
    ("bsd", "bsd", "(the )?bsd", {}),
    ("bsd-0", "0bsd", "(the )?0bsd", {}),
    ("bsd-1", "bsd", "(the )?(bsd (1|one) clause|(1|one) clause bsd)", {}),
    ("bsd-2", "bsd", "(the )?(bsd (2|two) clause|(2|two) clause bsd|simplified bsd|freebsd)", {}),
    ("bsd-3", "bsd", "(the )?(bsd (3|three) clause|(3|three) clause bsd|new bsd|modified bsd|revised bsd)", {}),
    ("bsd-4", "bsd", "(the )?(bsd (4|four) clause|(4|four) clause bsd|original bsd)", {}),
    ("mpl", "mpl", "(the )?mpl", {"1": _V1, "1.1": "1 1", "2": _V2}),
    ("mpl", "mozilla", "(the )?mozilla public", {"1": _V1, "1.1": "1 1", "2": _V2}),
    ("epl", "epl", "(the )?epl", {"1": _V1, "2": _V2}),
    ("epl", "eclipse", "(the )?eclipse public", {"1": _V1, "2": _V2}),
    ("edl", "eclipse", "(the )?eclipse distribution", {"1": _V1}),
    ("cddl", "cddl", "(the )?cddl", {"1": _V1, "1.1": "1 1"}),
    ("cddl", "common", "(the )?common development and distribution", {"1": _V1, "1.1": "1 1"}),
    ("cpl", "common", "(the )?common public", {"1": _V1}),
    ("eupl", "eupl", "(the )?eupl", {"1.1": "1 1", "1.2": "1 2"}),
    ("eupl", "european", "(the )?european union public", {"1.1": "1 1", "1.2": "1 2"}),
    ("artistic", "artistic", "(the )?(perl )?artistic", {"1": _V1, "2": _V2}),
    ("boost", "boost", "(the )?boost software", {"1": _V1}),
    ("zlib", "zlib", "(the )?zlib( libpng)?", {}),
    ("unlicense", "unlicense", "(the )?unlicense", {}),
    ("wtfpl", "wtfpl", "(the )?wtfpl", {"2": _V2}),
    ("ofl", "ofl", "(the )?(sil )?ofl", {"1": _V1, "1.1": "1 1"}),
    ("ofl", "open", "(the )?sil open font", {"1": _V1, "1.1": "1 1"}),
    ("psf", "python", "(the )?python( software foundation)?", {"2": _V2}),
    ("php", "php", "(the )?php", {"3": _V3, "3.01": "3 01"}),
    ("ruby", "ruby", "(the )?ruby", {}),
    ("openssl", "openssl", "(the )?openssl", {}),
    ("postgresql", "postgresql", "(the )?postgresql", {}),
    ("ncsa", "ncsa", "(the )?(university of illinois )?ncsa", {}),
    ("upl", "universal", "(the )?universal permissive", {"1": _V1}),
    ("ms-pl", "microsoft", "(the )?microsoft public", {}),
    ("ms-rl", "microsoft", "(the )?microsoft reciprocal", {}),
    ("bsl", "business", "(the )?business source", {"1.1": "1 1"}),
    ("sspl", "server", "(the )?server side public", {"1": _V1}),
    ("odbl", "odbl", "(the )?(odc )?odbl", {"1": _V1}),
    ("odbl", "database", "(the )?open database", {"1": _V1}),
    ("cecill", "cecill", "(the )?cecill( [bc])?", {"1": _V1, "2": _V2, "2.1": "2 1"}),
    ("afl", "academic", "(the )?academic free", {"2.1": "2 1", "3": _V3}),
    ("osl", "open", "(the )?open software", {"2.1": "2 1", "3": _V3}),
]
_CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(ative)?s?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(ative)?s?"}
_CC_VERSIONS = {"1": "1 0", "2": "2 0", "2.5": "2 5", "3": "3 0", "4": "4 0"}
_LICENCE = "licen[cs]e"


#: Words of which a grant or a license name has one: a gate for families whose own name is an ordinary word somewhere.
_CUES = ["license", "licence", "licensed", "licenced", "released", "distributed", "available", "published", "covered", "provided", "spdx"]

_FSF = "as published by the free software foundation"
_FORMS = "redistribution and use in source and binary forms"
_LATER = "( at your option)? any later version"
#: Passages of license texts and file headers: label, gate word, regex, strength.
_PASSAGES = [
    ("gpl-3-or-later", "general", f"(under the terms of )?the gnu general public license {_FSF} either version 3( of the license)? or{_LATER}", 1.0),
    ("gpl-2-or-later", "general", f"(under the terms of )?the gnu general public license {_FSF} either version 2( of the license)? or{_LATER}", 1.0),
    ("gpl-1-or-later", "general", f"(under the terms of )?the gnu general public license {_FSF} either version 1( of the license)? or{_LATER}", 1.0),
    ("gpl-3", "general", f"(under the terms of )?the gnu general public license (version 3 {_FSF}|{_FSF} version 3( of the license)?)", 1.0),
    ("gpl-2", "general", f"(under the terms of )?the gnu general public license (version 2 {_FSF}|{_FSF} version 2( of the license)?)", 1.0),
    ("lgpl-3-or-later", "lesser", f"(under the terms of )?the gnu lesser general public license {_FSF} either version 3( of the license)? or{_LATER}", 1.0),
    ("lgpl-2.1-or-later", "lesser", f"(under the terms of )?the gnu lesser general public license {_FSF} either version 2 1( of the license)? or{_LATER}", 1.0),
    ("lgpl-2-or-later", "library", f"(under the terms of )?the gnu library general public license {_FSF} either version 2( of the license)? or{_LATER}", 1.0),
    ("agpl-3-or-later", "affero", f"(under the terms of )?the gnu affero general public license {_FSF} either version 3( of the license)? or{_LATER}", 1.0),
    ("agpl-3", "affero", f"(under the terms of )?the gnu affero general public license version 3 {_FSF}", 1.0),
    ("gfdl-1.3-or-later", "documentation", "under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation", 1.0),
    ("gfdl-1.2-or-later", "documentation", "under the terms of the gnu free documentation license version 1 2 or any later version published by the free software foundation", 1.0),
    ("gfdl-1.1-or-later", "documentation", "under the terms of the gnu free documentation license version 1 1 or any later version published by the free software foundation", 1.0),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2", "apache", "apache license version 2 0 january 2004", 1.0),
    ("apache-1.1", "apache", "the apache software license version 1 1", 1.0),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 1.0),
    ("ncsa", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 1.0),
    ("boost-1", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("ofl-1.1", "permission", "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell", 1.0),
    ("isc", "permission", "permission to use copy modify (and )?(or )?distribute this software for any purpose with or without fee is hereby granted provided that", 1.0),
    ("bsd-0", "permission", "permission to use copy modify (and )?(or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)", 1.0),
    ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 1.0),
    ("bsd-4", "redistribution", f"{_FORMS}(?: [^ ]+){{1,90}}? all advertising materials mentioning features or use of this software", 1.0),
    ("bsd-3", "redistribution", f"{_FORMS}(?:(?! all advertising materials) [^ ]+){{1,120}}? (neither the names?|the names? of the) (?:[^ ]+ ){{1,20}}?(may|be used)", 1.0),
    ("bsd-2", "redistribution", f"{_FORMS}(?:(?! all advertising materials| neither the name| the name of the) [^ ]+){{1,120}}? this software is provided", 1.0),
    ("bsd", "redistribution", _FORMS, 0.8),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0", 1.0),
    ("epl-2", "eclipse", "are made available under the terms of the eclipse public license (v |v)?2 0", 1.0),
    ("epl-1", "eclipse", "are made available under the terms of the eclipse public license (v |v)?1 0", 1.0),
    ("cddl-1", "common", "subject to the terms of the common development and distribution license", 0.9),
    ("cpl-1", "common", "are made available under the terms of the common public license (v |v)?1 0", 1.0),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "whatever", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 1.0),
    ("beerware", "beer", "you can do whatever you want with this stuff(?: [^ ]+){0,20}? buy me a beer", 1.0),
    ("cc0-1", "waived", "has waived all copyright and related or neighbou?ring rights", 1.0),
    ("artistic-1", "package", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic-2", "package", "this license establishes the terms under which a given free software package may be copied modified distributed", 1.0),
    ("json", "evil", "the software shall be used for good not evil", 1.0),
    ("php-3.01", "php", "this source file is subject to version 3 01 of the php license", 1.0),
    ("php-3", "php", "this source file is subject to version 3 0 of the php license", 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 1.0),
    ("upl-1", "universal", "the universal permissive license upl version 1 0", 1.0),
    ("eupl-1.2", "eupl", "licensed under the eupl version 1 2( or as soon they will be approved by the european commission subsequent versions of the eupl)?", 1.0),
    ("python-2", "python", "python software foundation license version 2", 1.0),
    ("lppl-1.3c", "latex", "this work may be distributed and or modified under the conditions of the latex project public license", 1.0),
    ("cc-by-sa-4", "creative", "licensed under the creative commons attribution sharealike 4 0 international license", 1.0),
    ("cc-by-4", "creative", "licensed under the creative commons attribution 4 0 international license", 1.0),
    ("proprietary", "proprietary", "proprietary and confidential", 0.9),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited", 1.0),
    ("proprietary", "trade", "confidential and proprietary trade secrets?", 0.9),
]
#: Identifiers of an SPDX expression in words, with the label of each; what follows in _VERSIONED comes from the families.
_SPDX = {
    "mit": "mit", "mit 0": "mit-0", "isc": "isc", "x11": "x11", "0bsd": "bsd-0", "bsd 1 clause": "bsd-1", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "bsd 4 clause": "bsd-4", "zlib": "zlib",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "bsl 1 0": "boost-1", "busl 1 1": "bsl-1.1", "cc0 1 0": "cc0", "ruby": "ruby", "openssl": "openssl", "postgresql": "postgresql", "ncsa": "ncsa", "ms pl": "ms-pl",
    "ms rl": "ms-rl", "python 2 0": "python-2", "curl": "curl", "hpnd": "hpnd", "json": "json", "beerware": "beerware", "vim": "vim", "tcl": "tcl", "w3c": "w3c", "lppl 1 3c": "lppl-1.3c", "qpl 1 0": "qpl-1",
}
_VERSIONED = ["apache", "gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "cddl", "cpl", "eupl", "artistic", "ofl", "psf", "php", "upl", "sspl", "odbl", "cecill", "afl", "osl"]
#: Stands before an identifier: the line's start, or a connective at most 80 characters after it.
_IN_LINE = "(?:(?<= spdx license identifier )|(?<= spdx license identifier [a-z0-9 ]{1,80} (?:and|or|with) ))"


def rules() -> list[tuple[str, str, str, float]]:
    """(label, gate word, regex over single-spaced words, strength), best priority first."""
    return [r[:4] for r in _rules()]


def _spdx_rules() -> list[tuple[str, str, str, float, str]]:
    out = []
    for label, _, _, versions in _FAMILIES:
        for v in versions if label in _VERSIONED else {}:
            words = f"{label} {v.replace('.', ' ')}{'' if '.' in v else ' 0'}"
            out += [(f"{label}-{v}-or-later", words + " or later"), (f"{label}-{v}", words + "( only)?(?! or later)")]
    out += [(f"cc-{kind}-{v}", f"cc {kind.replace('-', ' ')} {number}") for kind in _CC for v, number in _CC_VERSIONS.items()]
    out += [(label, words) for words, label in sorted(_SPDX.items(), key=lambda x: -len(x[0]))]
    return [(label, "spdx", _IN_LINE + words, 1.0, "") for label, words in dict.fromkeys(out)]


def _rules() -> list[tuple[str, str, str, float, str]]:
    """rules() with a second text that must be there too, or an empty one."""
    out: list[tuple[str, str, str, float, str]] = [(*r, "") for r in _PASSAGES] + _spdx_rules()
    for label, gate, name, versions in _FAMILIES:
        grant = f"(licen[cs]ed|released|distributed|available|published|covered|provided) under (the terms of )?(the terms and conditions of )?{name}( {_LICENCE})?"
        for v, number in versions.items():
            out.append((f"{label}-{v}-or-later", gate, f"(under )?(the terms of )?{name}( {_LICENCE})? (version |v ?)?{number} or( at your option)?( any)? (later|newer)( versions?)?", 1.0, ""))
        for v, number in versions.items():
            out.append((f"{label}-{v}", gate, f"{grant} (version |v ?)?{number}( only)?", 1.0, ""))
            out.append((f"{label}-{v}", gate, f"{name}( {_LICENCE})? (version |v ?)?{number}( only)?", 0.9, ""))
        out.append((label, gate, grant, 0.9 if versions else 1.0, " under "))
        out.append((label, gate, f"(under )?{name} {_LICENCE}", 0.8, " licen"))
    for kind, words in _CC.items():
        short = "cc " + kind.replace("-", " ")
        for v, number in _CC_VERSIONS.items():
            out.append((f"cc-{kind}-{v}", "cc", f"{short} {number}", 1.0, ""))
            out.append((f"cc-{kind}-{v}", "creative", f"creative commons {words} {number}( (international|unported|generic))?", 1.0, ""))
        out.append((f"cc-{kind}", "cc", short, 0.8, ""))
        out.append((f"cc-{kind}", "creative", f"creative commons {words}", 0.8, ""))
    out += [
        ("cc0", "cc0", "cc0( 1 0)?( universal)?", 1.0, ""),
        ("cc0", "zero", "creative commons zero( 1 0)?( universal)?", 1.0, ""),
        ("public-domain", "domain", "(dedicated to|released into|placed in|in) the public domain", 0.9, ""),
        ("all-rights-reserved", "rights", "all rights reserved", 0.6, ""),
        ("copyright-notice", "copyright", "copyright (c )?(19|20)[0-9]{2}", 0.5, ""),
        ("permission-notice", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 0.8, ""),
        ("warranty-disclaimer", "warranty", "without warranty of any kind", 0.5, ""),
    ]
    return out


def _any_of(words: list[str]) -> str:
    """A regex for any of words that tries each first letter once: few steps at the start of an ordinary word."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    parts = [head + (_any_of(tails) if len(tails) > 1 else tails[0]) for head, tails in by.items() if head]
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in by else "")


MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def scanned(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections."""
    return B.shielded(docs, ("text",), MADE, _scanned)


def _scanned(docs: DataFrame) -> DataFrame:
    others, table = docs.columns, _rules()
    plain = {gate for _, gate, _, versions in _FAMILIES if not versions}  # these rules also need a cue
    gates = sorted(({r[1] for r in table} - plain) | {r[1] for r in _PASSAGES} | {gate for _, gate, _, versions in _FAMILIES if versions} | {*_CUES})
    regexes = [f" {regex}(?= |$)" for _, _, regex, _, _ in table]
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    signature = "array(" + ", ".join(f"named_struct('gate', {quote(f' {g} ')}, 'also', {quote(also)}, 'label', {quote(label)}, 'rank', {i}, 'strength', {s}D, 'regex', {quote(r)})" for i, ((label, g, _, s, also), r) in enumerate(zip(table, regexes))) + ")"
    base = "array(" + ", ".join(f"named_struct('label', {quote(label)}, 'regex', {quote(f' {p}(?= |$)')})" for p, label in PHRASES.items()) + ")"

    def intervals(rule: str, extra: str) -> str:
        """Cuts norm at a rule's matches; a piece or match has as many words as spaces."""
        return f"""aggregate(
            zip_with(slice(split(_norm, {rule}.regex, -1), 1, size(regexp_extract_all(_norm, {rule}.regex, 0))), regexp_extract_all(_norm, {rule}.regex, 0), (p, h) -> named_struct('piece', p, 'hit', h)),
            named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int{extra}>>)),
            (acc, x) -> named_struct(
                'at', acc.at + length(x.piece) - length(replace(x.piece, ' ', '')) + length(x.hit) - length(replace(x.hit, ' ', '')),
                'out', concat(acc.out, array(named_struct(
                    'start', acc.at + length(x.piece) - length(replace(x.piece, ' ', '')),
                    'end', acc.at + length(x.piece) - length(replace(x.piece, ' ', '')) + length(x.hit) - length(replace(x.hit, ' ', '')){{}})))),
            acc -> acc.out)"""

    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gate = f"(?i)(?<![0-9A-Za-z]){_any_of(gates)}(?![0-9A-Za-z])"
    words = docs.select(*others, F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"), F.when(F.rlike(body, F.lit(gate)), F.regexp_extract_all(F.translate(body, _UPPER, _LOWER), F.lit(WORD), F.lit(0))).alias("_words"))
    norm = words.withColumn("_norm", F.when(F.col("_words").isNotNull(), F.concat(F.lit(" "), F.array_join("_words", " "))))
    bases = intervals("r", ",label:string").format(", 'label', r.label")
    hits = intervals("r", ",label:string,rank:int,strength:double").format(", 'label', r.label, 'rank', r.rank, 'strength', r.strength")
    found = norm.select(
        *others, "n_words",
        F.expr(f"if(_norm is null, null, flatten(transform({base}, r -> {bases})))").alias("_base"),
        # sorted so that what contains an interval comes before it
        F.expr(f"if(_norm is null, null, array_sort(transform(flatten(transform(filter({signature}, r -> contains(concat(_norm, ' '), r.gate) and contains(concat(_norm, ' '), r.also)), r -> {hits})), d -> named_struct('start', d.start, 'back', -d.end, 'rank', d.rank, 'label', d.label, 'strength', d.strength))))").alias("_hits"),
    )
    fields = "start:int,end:int,rank:int,label:string,strength:double"
    free = F.expr(f"""aggregate(_hits,
        named_struct('reach', 0, 'out', cast(array() as array<struct<{fields}>>)),
        (acc, d) -> if(-d.back <= acc.reach, acc, named_struct('reach', -d.back, 'out', concat(acc.out, array(named_struct('start', d.start, 'end', -d.back, 'rank', d.rank, 'label', d.label, 'strength', d.strength))))),
        acc -> acc.out)""")
    # best rule first; what overlaps one that stays goes
    kept = F.expr(f"""array_sort(transform(aggregate(array_sort(transform(_free, d -> named_struct('rank', d.rank, 'start', d.start, 'end', d.end, 'label', d.label, 'strength', d.strength))),
        cast(array() as array<struct<rank:int,start:int,end:int,label:string,strength:double>>),
        (acc, d) -> if(exists(acc, e -> e.start < d.end and d.start < e.end), acc, concat(acc, array(d)))), d -> named_struct('start', d.start, 'end', d.end, 'label', d.label, 'strength', d.strength)))""")
    none = "cast(array() as array<struct<start:int,end:int,label:string,strength:double>>)"
    out = found.withColumn("_free", free).withColumn("detections", F.coalesce(kept, F.expr(none)))
    return out.select(
        *others, "n_words",
        F.expr("cast(if(_base is null, 0, size(_base)) as bigint)").alias("n_base"),
        F.expr("cast(array_min(transform(_base, b -> b.start)) as bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(_base, b -> b.start)) as bigint)").alias("last_word"),
        F.expr("coalesce(array_join(array_sort(array_distinct(transform(_base, b -> b.label))), ','), '')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(coalesce(transform(_base, b -> b.label), cast(array() as array<string>)), transform(detections, d -> d.label)))), ',')").alias("labels"),
        F.expr("greatest(if(size(_base) > 0, 1D, 0D), coalesce(array_max(transform(detections, d -> d.strength)), 0D))").alias("score"),
        "detections",
    )
