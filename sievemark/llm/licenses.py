"""License scan: ordered signature rules on normalised words, with overlapping detections resolved.

A text becomes its lower-cased words with single spaces, so a rule needn't care for line breaks or punctuation.
Cheap substring tests gate the rules twice: whether a text has any license word at all, and whether it has a rule's
own keyword. What the rules find are intervals; one sweep over them in order drops an interval inside another one if that
one is longer, or as long and of an earlier rule. Everything happens inside the row, without a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import documents

# License labels, their keyword, and what names them in normalised words.
NAMES: tuple[tuple[str, str, str], ...] = (
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("mit", "mit", r"mit(?: x11)? licen[sc]e"),
    ("expat", "expat", r"expat licen[sc]e"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:4 clause bsd|bsd 4 clause|original bsd) licen[sc]e"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)1(?: 0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)3(?: 0)?"),
    ("gpl-2.0-short", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0-short", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-any", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("lgpl-2.1", "general public", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)2 1"),
    ("lgpl-3.0", "general public", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)3(?: 0)?"),
    ("lgpl-any", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("agpl-3.0", "general public", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v)3(?: 0)?)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("cddl", "distribution", r"common development and distribution licen[sc]e"),
    ("cpl-1.0", "common public", r"common public licen[sc]e"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v)?1 0)?"),
    ("wtfpl", "public licen", r"do what the fuck you want to public licen[sc]e"),
    ("unlicense", "unlicen", r"(?:the )?unlicen[sc]e"),
    ("odbl", "database", r"open (?:data commons open )?database licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("python-2.0", "python", r"python software foundation licen[sc]e"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", r"(?:creative commons |licen[sc]e )?cc by nc nd(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "cc by", r"(?:creative commons |licen[sc]e )?cc by nc sa(?: [1-4] [0-9])?"),
    ("cc-by-nc", "cc by", r"(?:creative commons |licen[sc]e )?cc by nc(?: [1-4] [0-9])?"),
    ("cc-by-nd", "cc by", r"(?:creative commons |licen[sc]e )?cc by nd(?: [1-4] [0-9])?"),
    ("cc-by-sa", "cc by", r"(?:creative commons |licen[sc]e )?cc by sa(?: [1-4] [0-9])?"),
    ("cc-by-nc-long", "creative commons", r"creative commons attribution non ?commercial(?: (?:share ?alike|no ?derivatives))?(?: [1-4] [0-9])?"),
    ("cc-by-sa-long", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [0-9])?"),
    ("cc-by-long", "creative commons", r"creative commons attribution(?: [1-4] [0-9])?"),
    ("public-domain", "public domain", r"public domain"),
)
# How a license is granted, in order of priority, and how sure that makes it.
FORMS: tuple[tuple[str, float], ...] = (
    (r"(?:spdx )?licen[sc]e identifier {}", 1.0),
    (r"(?:is |are |be )?(?:licen[sc]ed|released|distributed|published|available|provided|dedicated) (?:under|to|into) (?:the )?(?:terms of (?:the )?)?{}", 1.0),
    (r"under (?:the )?(?:terms|conditions|provisions|terms and conditions) of (?:the )?{}", 0.95),
    (r"(?:subject to|governed by|permitted by) (?:the )?(?:terms of (?:the )?)?{}", 0.9),
    (r"(?:copy|text) of (?:the )?{}", 0.85),
    (r"{}", 0.7),
)
# Short names and identifiers, which say a license only beside a word for it.
SHORT_NAMES: tuple[tuple[str, str], ...] = (
    ("apache-1.1", r"apache 1 1"),
    ("apache-2.0", r"apache v?2(?: 0)?"),
    ("mit", r"mit"),
    ("x11", r"x11"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd)"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd)"),
    ("gpl-1.0", r"(?:gnu )?gpl ?v?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", r"(?:gnu )?lgpl ?v?2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", r"(?:gnu )?lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl-3.0", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-any", r"(?:gnu )?lgpl"),
    ("agpl-3.0", r"(?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-any", r"(?:gnu )?gpl"),
    ("mpl-1.1", r"mpl v?1 1"),
    ("mpl-2.0", r"mpl v?2(?: 0)?"),
    ("epl-1.0", r"epl v?1(?: 0)?"),
    ("epl-2.0", r"epl v?2(?: 0)?"),
    ("cddl", r"cddl(?: 1 [01])?"),
    ("cpl-1.0", r"cpl 1 0"),
    ("gfdl", r"gfdl(?: 1 [1-3])?(?: only| or later)?"),
    ("artistic-2.0", r"artistic 2 0"),
    ("isc", r"isc"),
    ("zlib", r"zlib"),
    ("boost-1.0", r"(?:bsl|boost) 1 0"),
    ("odbl", r"odbl(?: 1 0)?"),
    ("ofl-1.1", r"ofl 1 1"),
    ("postgresql", r"postgresql"),
    ("python-2.0", r"(?:python|psf) 2 0"),
    ("wtfpl", r"wtfpl"),
    ("unlicense", r"unlicense"),
)
SHORT_FORMS: tuple[tuple[str, float], ...] = (
    (r"(?:spdx )?licen[sc]e identifier {}", 1.0),
    (r"(?:is |are |be )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{}", 1.0),
    (r"{} licen[sc]ed", 0.95),
    (r"licen[sc]e {}", 0.9),
    (r"{} licen[sc]e", 0.9),
)
# Label, keyword in normalised words, and a sentence of the license's own text or notice.
BODIES: tuple[tuple[str, str, str], ...] = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("boost-1.0", "hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "hereby granted", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-4-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted.{0,1200}? all advertising materials mentioning features"),
    ("bsd-3-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted.{0,1200}? may be used to endorse or promote products"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("lgpl-2.1", "lesser general", r"lesser general public licen[sc]e as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", "lesser general", r"lesser general public licen[sc]e as published by the free software foundation either version 3"),
    ("agpl-3.0", "affero general", r"affero general public licen[sc]e as published by the free software foundation either version 3"),
    ("gpl-2.0", "gnu general", r"gnu general public licen[sc]e as published by the free software foundation either version 2"),
    ("gpl-3.0", "gnu general", r"gnu general public licen[sc]e as published by the free software foundation either version 3"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
)
# Label, keyword, and the words of a license's address or of a line that names it in headers and manifests.
NOTICES: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "apache", r"osi approved apache software license"),
    ("apache-1.1", "apache", r"apache org licenses license 1 1"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("mit", "opensource org", r"opensource org licen[sc]es? mit(?: license)?"),
    ("mit", "mit", r"osi approved mit license"),
    ("mit", "mit", r"released under (?:the )?mit"),
    ("mit", "mit", r"choosealicense com licenses mit"),
    ("bsd-2-clause", "opensource org", r"opensource org licen[sc]es? bsd 2 clause"),
    ("bsd-3-clause", "opensource org", r"opensource org licen[sc]es? bsd 3 clause"),
    ("bsd", "opensource org", r"opensource org licen[sc]es? bsd license"),
    ("bsd", "bsd", r"osi approved bsd license"),
    ("bsd", "bsd", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("gpl-2.0", "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu org", r"gnu org licenses gpl 3 0"),
    ("gpl-any", "gnu org", r"gnu org (?:licenses|copyleft) gpl"),
    ("gpl-2.0", "gplv2", r"osi approved gnu general public license v2 gplv2"),
    ("gpl-3.0", "gplv3", r"osi approved gnu general public license v3(?: or later)? gplv3"),
    ("gpl-any", "general public", r"you should have received a copy of the gnu general public license"),
    ("gpl-any", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-2.1", "gnu org", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu org", r"gnu org licenses lgpl 3 0"),
    ("lgpl-any", "gnu org", r"gnu org (?:licenses|copyleft) lgpl"),
    ("lgpl-any", "general public", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-any", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "gnu org", r"gnu org licenses agpl 3 0"),
    ("agpl-3.0", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "mozilla org", r"mozilla org mpl mpl 1 1"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-1.0", "eclipse", r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", r"eclipse org legal epl (?:2 0|v20)"),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl", "opensource", r"opensource org licen[sc]es? cddl1?"),
    ("cddl", "cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "opensource org", r"opensource org licen[sc]es? cpl1 0"),
    ("artistic-2.0", "artistic", r"(?:perlfoundation org|opensource org licen[sc]es?) artistic (?:license )?2 0"),
    ("isc", "opensource org", r"opensource org licen[sc]es? isc(?: license)?"),
    ("zlib", "zlib", r"(?:zlib net zlib license|opensource org licen[sc]es? zlib)"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-1.0", "boost", r"boost org license 1 0"),
    ("boost-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl net"),
    ("ofl-1.1", "sil", r"scripts sil org ofl"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by"),
    ("postgresql", "postgresql", r"(?:postgresql org about licence|opensource org licen[sc]es? postgresql)"),
    ("python-2.0", "python", r"(?:docs python org|python org psf) license"),
    ("python-2.0", "python", r"osi approved python software foundation license"),
    ("ms-pl", "microsoft", r"microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license(?: ms rl)?"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e(?: eupl)?(?: v ?| version )?1 2"),
    ("osl-3.0", "open software", r"open software license(?: version| v)? 3 0"),
    ("afl-3.0", "academic free", r"academic free license(?: version| v)? 3 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("openssl", "openssl", r"openssl (?:and original ssleay )?license"),
    ("php-3.01", "php", r"php license(?: version| v)? 3 01"),
    ("w3c", "w3c", r"w3c software (?:notice and |and document )?licen[sc]e"),
    ("vim", "vim", r"vim license"),
    ("ruby", "ruby", r"ruby license"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] [0-9])?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] [0-9])?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] [0-9])?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1-4] [0-9])?"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1-4] [0-9])?"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|document|software|work)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("reserved", "rights", r"some rights reserved"),
)
#: The base: phrases whose words stand consecutively.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: A text without any of these has nothing that a rule or phrase could find.
GATES = ("licen", "cc", "gpl", "creative", "public", "reserved", "hereby", "redistribution", "warranty", "wtfpl", "apache", "released", "altered source", "ofl", "proprietary", "unauthorized", "reproduced", "mozilla", "eclipse", "artistic")


DETECTIONS = "array<struct<nth:int,label:string,start:int,end:int,confidence:double>>"


def rules() -> list[dict]:
    """All rules in order: every form of a license before the next form. Labels of long and short spellings agree."""
    out = []
    for form, confidence in FORMS:
        for label, keyword, name in NAMES:
            label = label.removesuffix("-long").removesuffix("-short")
            out.append({"nth": len(out), "label": label, "keyword": keyword, "pattern": f" (?:{form.format(f'(?:{name})')})(?= )", "confidence": confidence})
    return out


def signatures() -> list[dict]:
    """The rules of short names, of bodies and of notices, after all others: each with its keyword and what must stand in a text."""
    pairs = [(label, "licen", form.format(f"(?:{name})"), confidence) for form, confidence in SHORT_FORMS for label, name in SHORT_NAMES]
    pairs += [(label, keyword, line, 1.0) for label, keyword, line in (*BODIES, *NOTICES)]
    first = len(FORMS) * len(NAMES)
    return [{"nth": first + k, "label": label, "keyword": keyword, "pattern": f" (?:{p})(?= )", "confidence": confidence} for k, (label, keyword, p, confidence) in enumerate(pairs)]


NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_pieces(text: Column, separator: str) -> Column:
    """How many pieces separators leave of a text, empty ones at either end not counted: a single fast split."""
    pieces = F.split(text, separator)
    ends = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return (F.size(pieces) - ends).cast("long")


def normalised(text: Column) -> Column:
    """The words of a lower-case text, with one space before and after each; a lone space if there is none."""
    words = F.trim(F.regexp_replace(text, NOT_WORD, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _nested() -> list[dict]:
    """The rules by keyword and, under each, by what names the license: most of them are never tried."""
    every = rules()
    names = [{"name": name, "keyword": keyword, "forms": every[k :: len(NAMES)]} for k, (_, keyword, name) in enumerate(NAMES)]
    sure = signatures()
    short = len(SHORT_NAMES)
    names += [{"name": f" {name} ", "keyword": "licen", "forms": sure[k : short * len(SHORT_FORMS) : short]} for k, (_, name) in enumerate(SHORT_NAMES)]
    names += [{"name": r["pattern"], "keyword": r["keyword"], "forms": [r]} for r in sure[short * len(SHORT_FORMS) :]]
    return [{"keyword": k, "names": [n for n in names if n["keyword"] == k]} for k in dict.fromkeys(n["keyword"] for n in names)]


_NESTED = "array<struct<keyword:string,names:array<struct<name:string,forms:array<struct<nth:int,label:string,pattern:string,confidence:double>>>>>>"
_FIND = "struct<nth:int,label:string,start:int,end:int,confidence:double>"
#: Items that are folded together: appending copies an array, so long arrays are folded in parts, and the parts joined.
_PART = 128


def _folded(items: str, start: str, kind: str, step: str) -> str:
    """SQL of a fold over an array that gathers what it appends. `step` makes a state (at, out) of the state `a` and the item `x`;
    `at` goes on from part to part."""
    return f"""flatten(aggregate(sequence(0, greatest(0, (size({items}) - 1) div {_PART})), named_struct('at', {start}, 'out', CAST(array() AS array<array<{kind}>>)),
  (o, c) -> element_at(transform(array(aggregate(slice({items}, CAST(c * {_PART} + 1 AS int), {_PART}), named_struct('at', o.at, 'out', CAST(array() AS array<{kind}>)), (a, x) -> {step})),
    i -> named_struct('at', i.at, 'out', array_append(o.out, i.out))), 1), o -> o.out))"""


def _when(condition: str, appended: str) -> str:
    return f"CASE WHEN {condition} THEN array_append(a.out, {appended}) ELSE a.out END"


# the matches of a rule are marked in place, so that one pass gives both them and their positions
_MATCH = "named_struct('nth', r.nth, 'label', r.label, 'start', a.at, 'end', a.at + length(substring_index(x, char(2), 1)), 'confidence', r.confidence)"
_MATCHES = _folded("p", "length(first)", _FIND, f"named_struct('at', a.at + length(x) - 1, 'out', array_append(a.out, {_MATCH}))").replace("length(first)", "q.head")
_FOUND = f"""
flatten(transform(filter(flatten(transform(filter(_rules, k -> contains(_norm, k.keyword)), k -> k.names)), n -> _norm RLIKE n.name),
  n -> flatten(transform(n.forms, r -> element_at(transform(array(split(regexp_replace(_norm, r.pattern, concat(char(1), '$0', char(2))), char(1))),
    s -> element_at(transform(array(named_struct('head', length(s[0]), 'p', slice(s, 2, size(s)))), q -> element_at(transform(array(q.p), p -> {_MATCHES}), 1)), 1)), 1)))))"""
# in this order an interval that holds another one stands before it: one sweep with the farthest end so far drops the others
_SORTED = """array_sort(_found, (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start WHEN x.end <> y.end THEN y.end - x.end ELSE x.nth - y.nth END)"""
_KEPT = _folded("_sorted", "-1", _FIND, f"named_struct('at', greatest(a.at, x.end), 'out', {_when('x.end > a.at', 'x')})")


def _places(phrase: str) -> Column:
    """Word numbers at which a phrase begins, in ascending order."""
    n = len(phrase.split())
    # words before the k-th place: those in the pieces up to it, and the phrases between
    words = "length(x) - length(replace(x, ' ', ''))"
    fold = _folded("p", "0L", "bigint", f"named_struct('at', a.at + {words} + {n}, 'out', array_append(a.out, a.at + {words}))")
    return F.expr(f"element_at(transform(transform(array(split(_norm, ' {phrase}(?= )', -1)), s -> slice(s, 1, size(s) - 1)), p -> {fold}), 1)")


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_words, the base's places and labels, `detections` and all labels with a score.

    `detections` (array of nth, label, start, end, confidence) has what is left of the rules' finds, as half-open
    code-point intervals of the normalised text. score is the chance that any of it holds, base places counting 0.6.
    Null and empty texts have no words, no places (null) and empty label lists. Texts of any length are scanned whole, and
    the work is in proportion to their finds but for their sorting. Of equal intervals the earlier rule's stays. Ids may
    repeat or be null, and repeated rows are judged alike, each alone. Other columns aren't read, so their names don't
    matter. An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.translate(F.coalesce(text_col, F.lit("")), _UPPER, _LOWER).alias("_text"))
    d = d.withColumn("n_words", count_pieces(F.col("_text"), NOT_WORD)).withColumn("_gate", F.expr(" OR ".join(f"contains(_text, '{g}')" for g in GATES)))
    d = d.withColumn("_norm", F.when(F.col("_gate"), normalised(F.col("_text")))).withColumn("_rules", F.when(F.col("_gate"), F.from_json(F.lit(json.dumps(_nested())), _NESTED)))
    d = d.withColumn("_found", F.when(F.col("_gate"), F.expr(_FOUND)))
    d = d.withColumn("_sorted", F.when(F.size("_found") > 0, F.expr(_SORTED)))
    d = d.withColumn("detections", F.when(F.size("_found") > 0, F.expr(_KEPT)).otherwise(F.array().cast(DETECTIONS)))
    for k, (phrase, _) in enumerate(PHRASES):
        d = d.withColumn(f"_p{k}", F.when(F.col("_gate") & F.contains("_norm", F.lit(f" {phrase} ")), _places(phrase)).otherwise(F.array().cast("array<bigint>")))
    places = F.concat(*(F.col(f"_p{k}") for k in range(len(PHRASES))))
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)))))
    d = d.withColumn("_places", places).withColumn("_base", base)
    every = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda x: x["label"]))))
    doubt = F.aggregate("detections", F.when(F.size("_base") > 0, F.lit(0.4)).otherwise(F.lit(1.0)), lambda a, x: a * (1.0 - x["confidence"]))
    return d.select(F.col("_id").alias(id_col), "n_words", F.size("_places").cast("long").alias("n_base"), F.array_min("_places").alias("first_word"), F.array_max("_places").alias("last_word"), F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), (1.0 - doubt).alias("score"), "detections")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license labels."""
    return scan_licenses(documents(spark, sf_dir)).drop("detections")
