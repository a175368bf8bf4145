"""License scans by ordered signature rules, in DataFrame functions only.

A text is brought to words: A-Z in lower case, and runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with one space between them.  For each
rule there are keywords, strings one of which stands in all that it matches, and for each
keyword the beginning of one of its words; both are derived from the pattern, so they lose
no match.  One pass over the words finds the beginnings: texts without any are done, and
in the others the rules are run of which a keyword occurs;
each match is an interval of word positions with the rule's label and priority
(0 first).  Detections are taken by start, longest first, then by priority; one
that lies inside an earlier one of the same or a better priority is suppressed.

Base phrases are the three of ``BASE``, matched word by word.  They are always
counted, and their labels stay whatever contains them.

``score`` is the best confidence of the labels left: 1 for base phrases and
license identifiers, less for looser rules, 0 for none.

Defined results: a null text reads as empty: 0 words, no detection, empty label
strings, null first and last word.  Everything is computed row by row, without a
shuffle, so repeated rows, null ids and extra columns need no care.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the query's contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label: (name as a pattern over words, identifier as words).
NAMES = {
    "mit": ("mit(?: x11)?|expat", "mit"),
    "mit-0": ("mit no attribution|mit 0", "mit 0"),
    "apache-2": ("apache(?: software)?(?: public)? licen[cs]e (?:version |v)?2|apache 2", "apache 2"),
    "apache-1.1": ("apache(?: software)? licen[cs]e (?:version |v)?1 1", "apache 1 1"),
    "apache-1.0": ("apache(?: software)? licen[cs]e (?:version |v)?1 0", "apache 1 0"),
    "bsd-2-clause": ("(?:2|two) clause bsd|bsd 2 clause|simplified bsd|freebsd", "bsd 2 clause"),
    "bsd-3-clause": ("(?:3|three) clause bsd|bsd 3 clause|(?:new|modified|revised) bsd", "bsd 3 clause"),
    "bsd-4-clause": ("(?:4|four) clause bsd|bsd 4 clause|original bsd", "bsd 4 clause"),
    "bsd-0-clause": ("(?:0|zero) clause bsd|bsd zero clause|0bsd", "0bsd"),
    "gpl-1": ("gnu general public licen[cs]e (?:version |v)?1|gnu gpl ?v?1", "gpl 1 0"),
    "gpl-2": ("gnu general public licen[cs]e (?:version |v)?2|gnu gpl ?v?2", "gpl 2 0"),
    "gpl-3": ("gnu general public licen[cs]e (?:version |v)?3|gnu gpl ?v?3", "gpl 3 0"),
    "lgpl-2": ("gnu library general public licen[cs]e(?: version| v)? ?2", "lgpl 2 0"),
    "lgpl-2.1": ("gnu lesser general public licen[cs]e (?:version |v)?2 1", "lgpl 2 1"),
    "lgpl-3": ("gnu lesser general public licen[cs]e (?:version |v)?3", "lgpl 3 0"),
    "agpl-3": ("gnu affero general public licen[cs]e(?: (?:version |v)?3)?", "agpl 3 0"),
    "gfdl": ("gnu free documentation licen[cs]e(?: (?:version |v)?1 [123])?", "gfdl 1 3"),
    "mpl-1.1": ("mozilla public licen[cs]e (?:version |v)?1 1", "mpl 1 1"),
    "mpl-2": ("mozilla public licen[cs]e (?:version |v)?2", "mpl 2 0"),
    "epl-1": ("eclipse public licen[cs]e (?:version |v)?1", "epl 1 0"),
    "epl-2": ("eclipse public licen[cs]e (?:version |v)?2", "epl 2 0"),
    "edl-1": ("eclipse distribution licen[cs]e(?: (?:version |v)?1 0)?", "edl 1 0"),
    "cddl-1": ("common development and distribution licen[cs]e(?: (?:version |v)?1)?", "cddl 1 0"),
    "cpl-1": ("common public licen[cs]e(?: (?:version |v)?1 0)?", "cpl 1 0"),
    "ipl-1": ("ibm public licen[cs]e(?: (?:version |v)?1 0)?", "ipl 1 0"),
    "artistic-1": ("artistic licen[cs]e (?:version |v)?1", "artistic 1 0"),
    "artistic-2": ("artistic licen[cs]e (?:version |v)?2", "artistic 2 0"),
    "bsl-1": ("boost software licen[cs]e(?: (?:version |v)?1 0)?", "bsl 1 0"),
    "busl-1.1": ("business source licen[cs]e(?: (?:version |v)?1 1)?", "busl 1 1"),
    "isc": ("isc", "isc"),
    "zlib": ("zlib(?: libpng)?", "zlib"),
    "libpng": ("libpng", "libpng 2 0"),
    "unlicense": ("unlicen[cs]e", "unlicense"),
    "wtfpl": ("wtfpl|do what the fuck you want to public licen[cs]e", "wtfpl"),
    "postgresql": ("postgresql", "postgresql"),
    "python-2": ("python software foundation licen[cs]e(?: (?:version |v)?2)?|psf licen[cs]e", "python 2 0"),
    "php-3": ("php licen[cs]e (?:version |v)?3", "php 3 01"),
    "ruby": ("ruby", "ruby"),
    "openssl": ("openssl", "openssl"),
    "sleepycat": ("sleepycat(?: public)?", "sleepycat"),
    "ofl-1.1": ("(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?", "ofl 1 1"),
    "ubuntu-font": ("ubuntu font licen[cs]e", "ubuntu font 1 0"),
    "eupl-1.1": ("european union public licen[cs]e (?:version |v)?1 1", "eupl 1 1"),
    "eupl-1.2": ("european union public licen[cs]e (?:version |v)?1 2", "eupl 1 2"),
    "cecill": ("cecill(?: [abc])?", "cecill 2 1"),
    "osl-3": ("open software licen[cs]e(?: (?:version |v)?3 0)?", "osl 3 0"),
    "afl-3": ("academic free licen[cs]e(?: (?:version |v)?[23] [01])?", "afl 3 0"),
    "ms-pl": ("microsoft public licen[cs]e", "ms pl"),
    "ms-rl": ("microsoft reciprocal licen[cs]e", "ms rl"),
    "odbl-1": ("open (?:data commons open )?database licen[cs]e(?: v?1 0)?", "odbl 1 0"),
    "odc-by": ("open data commons attribution licen[cs]e", "odc by 1 0"),
    "pddl-1": ("open data commons public domain dedication(?: and licen[cs]e)?", "pddl 1 0"),
    "upl-1": ("universal permissive licen[cs]e(?: (?:version |v)?1 0)?", "upl 1 0"),
    "ncsa": ("university of illinois ncsa open source licen[cs]e", "ncsa"),
    "zpl-2": ("zope public licen[cs]e(?: (?:version |v)?2 [01])?", "zpl 2 1"),
    "w3c": ("w3c software(?: notice and)? licen[cs]e", "w3c"),
    "vim": ("vim", "vim"),
    "beerware": ("beer ?ware", "beerware"),
    "sspl-1": ("server side public licen[cs]e(?: (?:version |v)?1)?", "sspl 1 0"),
    "elastic-2": ("elastic licen[cs]e (?:version |v)?2(?: 0)?", "elastic 2 0"),
    "commons-clause": ("commons clause(?: licen[cs]e)?(?: condition)?", "commons clause"),
    "cc0": ("creative commons zero|cc zero|cc0", "cc0 1 0"),
    "cc-by": ("creative commons attribution|cc by", "cc by 4 0"),
    "cc-by-sa": ("creative commons attribution share ?alike|cc by sa", "cc by sa 4 0"),
    "cc-by-nd": ("creative commons attribution no ?deriv(?:ative)?s?(?: works)?|cc by nd", "cc by nd 4 0"),
    "cc-by-nc": ("creative commons attribution non ?commercial|cc by nc", "cc by nc 4 0"),
    "cc-by-nc-sa": ("creative commons attribution non ?commercial share ?alike|cc by nc sa", "cc by nc sa 4 0"),
    "cc-by-nc-nd": ("creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?|cc by nc nd", "cc by nc nd 4 0"),
}

_LED = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed|made available) (?:to you )?under (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?"
#: How a name stands in a text: (keyword of the form, pattern around the name, priority, confidence).
FORMS = (
    ("spdx", "spdx licen[cs]e identifier {id}", 0, 1.0),
    ("under", _LED + "(?:{name})(?: licen[cs]e)?(?: (?:version |v)?[0-9]+(?: [0-9]+)?)?(?: international| unported| generic)?", 1, 0.95),
    ("licen", "(?:the |an? )?(?:{name}) licen[cs]e(?: (?:version |v)?[0-9]+(?: [0-9]+)?)?", 2, 0.8),
    ("licen", "licen[cs]e[ds]? (?:is |name )?(?:the )?(?:{name})", 3, 0.6),
    ("licen", "(?:the |an? )?(?:{full})", 2, 0.7),
)

#: Signatures of license texts and notices: (pattern, label, priority, confidence).
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 1, 1.0),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 1, 1.0),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 1, 0.9),
    ("neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause", 1, 1.0),
    ("all advertising materials mentioning features or use of this software must display", "bsd-4-clause", 1, 1.0),
    ("apache org licenses license 2 0", "apache-2", 0, 1.0),
    ("you may not use this file except in compliance with the licen[cs]e", "apache-2", 2, 0.8),
    ("gnu org licenses gpl 3 0", "gpl-3", 0, 1.0),
    ("gnu org licenses (?:old licenses )?gpl 2 0", "gpl-2", 0, 1.0),
    ("gnu org licenses lgpl 3 0", "lgpl-3", 0, 1.0),
    ("gnu org licenses agpl 3 0", "agpl-3", 0, 1.0),
    ("(?:the )?gnu general public licen[cs]e", "gpl", 3, 0.7),
    ("(?:the )?gnu lesser general public licen[cs]e", "lgpl", 3, 0.7),
    ("you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "gpl", 2, 0.9),
    ("either version 2 of the licen[cs]e or at your option any later version", "gpl-2-or-later", 1, 1.0),
    ("either version 3 of the licen[cs]e or at your option any later version", "gpl-3-or-later", 1, 1.0),
    ("gpl ?v?2(?: 0)?", "gpl-2", 3, 0.6),
    ("gpl ?v?3(?: 0)?", "gpl-3", 3, 0.6),
    ("lgpl ?v?2(?: 1)?", "lgpl-2.1", 3, 0.6),
    ("lgpl ?v?3(?: 0)?", "lgpl-3", 3, 0.6),
    ("agpl ?v?3(?: 0)?", "agpl-3", 3, 0.6),
    ("mozilla org mpl 2 0", "mpl-2", 0, 1.0),
    ("this source code form is subject to the terms of the mozilla public licen[cs]e", "mpl-2", 1, 1.0),
    ("eclipse org legal epl (?:v10|2 0)", "epl", 0, 1.0),
    ("opensource org licenses mit", "mit", 0, 1.0),
    ("opensource org licenses bsd", "bsd", 0, 0.9),
    ("opensource org licenses isc", "isc", 0, 1.0),
    ("creativecommons org licenses by [1-4] [0-9]", "cc-by", 0, 1.0),
    ("creativecommons org licenses by sa [1-4] [0-9]", "cc-by-sa", 0, 1.0),
    ("creativecommons org licenses by nc [1-4] [0-9]", "cc-by-nc", 0, 1.0),
    ("creativecommons org licenses by nd [1-4] [0-9]", "cc-by-nd", 0, 1.0),
    ("creativecommons org licenses by nc sa [1-4] [0-9]", "cc-by-nc-sa", 0, 1.0),
    ("creativecommons org licenses by nc nd [1-4] [0-9]", "cc-by-nc-nd", 0, 1.0),
    ("creativecommons org publicdomain zero 1 0", "cc0", 0, 1.0),
    ("(?:is |are |been )?(?:released |placed |dedicated )?(?:in|into|to) the public domain", "public-domain", 2, 0.8),
    ("this is free and unencumbered software released into the public domain", "unlicense", 1, 1.0),
    ("all rights reserved", "all-rights-reserved", 3, 0.5),
    ("(?:proprietary and confidential|confidential and proprietary)", "proprietary", 2, 0.8),
    ("provided as is without any express or implied warranty", "zlib", 2, 0.6),
    ("the software is provided as is without warranty of any kind", "mit", 3, 0.5),
    ("opensource org licenses apache 2 0", "apache-2", 0, 1.0),
    ("apache org licenses license 1 1", "apache-1.1", 0, 1.0),
    ("unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "apache-2", 2, 0.8),
    ("this product includes software developed by the apache (?:software foundation|group)", "apache-1.1", 2, 0.7),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 1, 0.9),
    ("except as contained in this notice the name of (?:the )?.{1,60}? shall not be used in advertising or otherwise to promote", "x11", 1, 1.0),
    ("permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "hpnd", 1, 1.0),
    ("the software shall be used for good not evil", "json", 1, 1.0),
    ("redistributions of source code must retain the above copyright notice", "bsd", 1, 0.9),
    ("redistributions in binary form must reproduce the above copyright notice", "bsd", 1, 0.9),
    ("this software is provided by the (?:copyright holders|regents) and contributors as is", "bsd", 2, 0.8),
    ("this product includes software developed by the university of california", "bsd-4-clause", 1, 1.0),
    ("the software is provided as is and the author disclaims all warranties with regard to this software", "isc", 1, 0.9),
    ("the origin of this software must not be misrepresented", "zlib", 1, 1.0),
    ("altered source versions must be plainly marked as such", "zlib", 1, 1.0),
    ("opensource org licenses zlib", "zlib", 0, 1.0),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "bsl-1", 1, 1.0),
    ("boost org license 1 0", "bsl-1", 0, 1.0),
    ("anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 1, 1.0),
    ("unlicense org", "unlicense", 0, 0.9),
    ("you just do what the fuck you want to", "wtfpl", 1, 1.0),
    ("wtfpl net", "wtfpl", 0, 0.9),
    ("this program is free software you can redistribute it and or modify", "gpl", 2, 0.8),
    ("this library is free software you can redistribute it and or modify", "lgpl", 2, 0.8),
    ("you should have received a copy of the gnu general public licen[cs]e", "gpl", 2, 0.9),
    ("you should have received a copy of the gnu lesser general public licen[cs]e", "lgpl", 2, 0.9),
    ("you should have received a copy of the gnu affero general public licen[cs]e", "agpl", 2, 0.9),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "gfdl", 1, 1.0),
    ("gnu org licenses fdl(?: 1 [123])?", "gfdl", 0, 1.0),
    ("gnu org (?:licenses|copyleft) gpl(?: html| txt)?", "gpl", 1, 0.9),
    ("gnu org (?:licenses|copyleft) lesser(?: html| txt)?", "lgpl", 1, 0.9),
    ("opensource org licenses gpl (?:2|3) 0", "gpl", 0, 0.9),
    ("opensource org licenses lgpl (?:2|3) [01]", "lgpl", 0, 0.9),
    ("opensource org licenses mpl 2 0", "mpl-2", 0, 1.0),
    ("opensource org licenses artistic 2 0", "artistic-2", 0, 1.0),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2", 1, 1.0),
    ("the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "mpl-1.1", 1, 1.0),
    ("this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "epl", 1, 1.0),
    ("this program and the accompanying materials are made available under the terms of the eclipse distribution licen[cs]e", "edl-1", 1, 1.0),
    ("eclipse org org documents edl v10", "edl-1", 0, 1.0),
    ("the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "cddl-1", 1, 1.0),
    ("licen[cs]ed under the eupl", "eupl", 1, 0.9),
    ("the intent of this document is to state the conditions under which a package may be copied", "artistic-1", 1, 1.0),
    ("if we meet some day and you think this stuff is worth it you can buy me a beer", "beerware", 1, 1.0),
    ("this font software is licen[cs]ed under the sil open font licen[cs]e", "ofl-1.1", 1, 1.0),
    ("scripts sil org ofl", "ofl-1.1", 0, 1.0),
    ("psf is making python available to licensee on an as is basis", "python-2", 1, 1.0),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql", 1, 1.0),
    ("to deal with the software without restriction", "ncsa", 1, 0.9),
    ("this product includes software developed by the openssl project", "openssl", 1, 1.0),
    ("this product includes php software freely available from", "php-3", 1, 1.0),
    ("permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted", "w3c", 1, 1.0),
    ("vim is charityware", "vim", 1, 1.0),
    ("this work is licen[cs]ed under a creative commons", "cc", 3, 0.6),
    ("to the extent possible under law .{1,80}? (?:has|have) waived all copyright and related or neighboring rights", "cc0", 1, 1.0),
    ("creativecommons org publicdomain mark 1 0", "public-domain", 0, 1.0),
    ("opendatacommons org licenses odbl", "odbl-1", 0, 1.0),
    ("opendatacommons org licenses by", "odc-by", 0, 1.0),
    ("opendatacommons org licenses pddl", "pddl-1", 0, 1.0),
    ("the software is provided to you by the licensor under the licen[cs]e as defined below subject to the following condition", "commons-clause", 1, 1.0),
    ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "busl-1.1", 1, 1.0),
    ("mariadb com bsl11", "busl-1.1", 0, 1.0),
    ("if you make the functionality of the program or a modified version available to third parties as a service", "sspl-1", 1, 1.0),
    ("you may not provide the software to third parties as a hosted or managed service", "elastic-2", 1, 1.0),
    ("elastic co licensing elastic license", "elastic-2", 0, 1.0),
    ("polyformproject org licenses", "polyform", 0, 0.9),
    ("polyform (?:noncommercial|shield|strict|small business|free trial|perimeter)(?: licen[cs]e)?", "polyform", 2, 0.8),
    ("creativeml open ?rail(?: m)?|bigscience (?:open ?)?rail(?: m)?|open ?rail(?: m)? licen[cs]e", "openrail", 1, 0.9),
    ("llama (?:[234](?: [0-9])? )?community licen[cs]e(?: agreement)?", "llama-community", 1, 0.9),
    ("unauthori[sz]ed copying of this file via any medium is strictly prohibited", "proprietary", 1, 0.9),
    ("this software is the confidential and proprietary information of", "proprietary", 1, 0.9),
    ("no part of this (?:book|publication|document|work|software) may be reproduced", "all-rights-reserved", 1, 0.8),
)

#: What stands between the contract's words, before A-Z are in lower case.
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PRIORITIES = 4
#: Words that say little of a text: others of a keyword are looked for first.
COMMON = frozenset(
    "a about above accompanying agreement all an and any anyone applicable are as at available be but buy by can conditions contents copy copying copyright covered day distributed distribution do document either everyone except"
    " express file following for free from function general good government group have hereby how if implied in includes including information is it its kind later law library made make managed material materials may me meet modify more must"
    " new no not notice obtain obtained of on only open or org original otherwise our part permitted person please point product products program prohibited promote provide provided public purpose received related"
    " release released required right rights sell server service shall should some source state stuff such terms than that the their them these they think this to under university use used version versions want was way we what when which"
    " will with without work worth would writing written you your".split()
)


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars outside of groups."""
    depth, out = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def without_groups(pattern: str) -> str:
    """A pattern with a line break for each group."""
    while pattern != (pattern := re.sub(r"\([^()]*\)\??", "\n", pattern)):
        pass
    return pattern


def literals(pattern: str) -> list[str]:
    """For each alternative of a pattern, a string that stands in all that it matches, with the space before the first word and behind the last."""
    out = []
    for alternative in alternatives(pattern):
        plain = re.sub(r"\[[^]]*\]\??|\.\{[^}]*\}\??|[^\n]\?", "\n", without_groups(alternative))
        pieces = plain.split("\n")
        pieces[0] = f" {pieces[0]}" if pieces[0] else ""
        pieces[-1] = f"{pieces[-1]} " if pieces[-1] else ""
        longest = max(pieces, key=len)
        out += [longest] if longest.strip() else literals(re.fullmatch(r"\(\?:(.*)\)", alternative)[1])
    return out


def rules() -> list[tuple[str, tuple[str, ...], str, str, int, float]]:
    """(string in all matches, strings of which one is in each match, pattern, label, priority, confidence) of all rules in order."""
    out = []
    for first, form, priority, sure in FORMS:
        for label, (name, spdx) in NAMES.items():
            full = "|".join(a for a in alternatives(name) if "licen" in without_groups(a))
            if full or "{full}" not in form:
                own = spdx if first == "spdx" else full if "{full}" in form else name
                out.append((first, tuple(literals(own)), form.format(name=name, id=spdx, full=full), label, priority, sure))
    return [*out, *(("", tuple(literals(pattern)), pattern, *rest) for pattern, *rest in TEXTS)]


def stems() -> dict[str, str]:
    """For each keyword, and each base phrase, one of its words, with the space behind it, or how its last word begins.
    None of these begins another, so at a word there is one at most."""
    needed = {k for _, keywords, *_ in rules() for k in keywords} | {f" {phrase} " for phrase, _ in BASE}
    words = {k: [w for w in re.findall("(?<= )[^ ]+ ?", k)] for k in needed}
    often = Counter(w for found in words.values() for w in set(found))
    made = {k: max(found, key=lambda w: (w.strip() not in COMMON and not w.strip().isdigit(), often[w], len(w), w)) for k, found in words.items()}
    short = sorted(set(made.values()), key=len)
    return {k: next(s for s in short if w.startswith(s)) for k, w in made.items()}


def any_of(words: set[str]) -> str:
    """A pattern for any of some words, by their letters one after the other."""
    parts = []
    for c in sorted({w[0] for w in words if w}):
        rest = {w[1:] for w in words if w[:1] == c}
        parts.append(c if "" in rest else c + any_of(rest))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def bounded(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def detections(words: Column, rule: Column) -> Column:
    """(start, -end, priority, label, sure) of a rule's matches, which are put between marks that no word holds."""
    parts = F.split(F.regexp_replace(words, rule["pattern"], F.lit("\x01$0\x02")), F.lit("[\x01\x02]"))
    hits = "array<struct<start:int,back:int,priority:int,label:string,sure:double>>"
    kind = f"struct<at:int,odd:boolean,out:{hits}>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(hits).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + spaces(part)
        one = F.struct(acc["at"].alias("start"), (-end - 1).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["sure"].alias("sure"))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out")).cast(kind)

    return F.when(F.size(parts) > 1, F.aggregate(parts, start.cast(kind), step, lambda acc: acc["out"])).otherwise(F.array().cast(hits))


def survivors(found: Column) -> Column:
    """Labels and best confidence of the detections that no earlier one contains."""
    kind = f"struct<ends:array<int>,labels:array<string>,sure:double>"
    start = F.struct(F.array_repeat(F.lit(0), PRIORITIES).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("sure")).cast(kind)

    def step(acc: Column, d: Column) -> Column:
        end = -d["back"]
        inside = F.exists(F.slice(acc["ends"], F.lit(1), d["priority"] + 1), lambda e: e >= end)
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == d["priority"], F.greatest(e, end)).otherwise(e))
        taken = F.struct(ends.alias("ends"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.greatest(acc["sure"], d["sure"]).alias("sure")).cast(kind)
        return F.when(inside, acc).otherwise(taken)

    return F.aggregate(F.array_sort(found), start, step)


def scan(docs: DataFrame, text_col: str = "text", prefilter: bool = True) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.  Without the prefilter every rule runs on every text, with the same result."""
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    taken = {c.lower() for c in docs.columns}
    hold = "_words"
    while {f"{hold}{s}" for s in ("", "_low", "_norm", "_stems", "_n", "_spaced", "_scan", "_hit")} & taken:
        hold += "_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.translate(F.col(hold + "_norm"), upper, upper.lower())
    begins = stems()
    if prefilter:
        words = F.when(F.size(hold + "_stems") > 0, words)
    by_stem: dict[str, list[dict]] = {}
    for first, keywords, pattern, label, priority, sure in rules():
        for begin in sorted({begins[k] for k in keywords}) if prefilter else [""]:
            by_stem.setdefault(begin, []).append({"also": first, "keywords": keywords, "pattern": bounded(pattern), "label": label, "priority": priority, "sure": sure})
    shape = "map<string,array<struct<also:string,keywords:array<string>,pattern:string,label:string,priority:int,sure:double>>>"
    book = F.from_json(F.lit(json.dumps(by_stem)), shape)  # a constant of the plan
    out = docs.withColumn(hold + "_norm", F.trim(F.regexp_replace(text, OTHER, " ")))
    out = out.withColumn(hold + "_low", F.concat(F.lit(" "), F.lower(hold + "_norm"), F.lit(" ")))
    out = out.withColumn(hold + "_stems", F.array_distinct(F.regexp_extract_all(hold + "_low", F.lit(f" (?=({any_of(set(begins.values()))}))"))))
    count = F.when(F.col(hold + "_norm") == "", F.lit(0)).otherwise(spaces(F.col(hold + "_norm")) + 1).cast("long")
    out = out.withColumns({hold + "_n": count, hold: words})
    out = out.withColumn(hold + "_spaced", F.concat(F.lit(" "), F.col(hold), F.lit(" ")))
    count, held = F.col(hold + "_n"), F.col(hold)
    spaced = F.col(hold + "_spaced")
    wanted = book[""]
    if prefilter:  # a rule that is there twice finds everything twice, which the second time lies inside the first
        wanted = F.flatten(F.transform(hold + "_stems", lambda begin: book[begin]))
        wanted = F.filter(wanted, lambda r: F.contains(spaced, r["also"]) & F.exists(r["keywords"], lambda k: F.contains(spaced, k)))
    found = F.flatten(F.transform(wanted, lambda r: detections(held, r)))
    out = out.withColumn(hold + "_scan", F.when(held.isNotNull(), survivors(found)))
    phrases = []
    for phrase, label in BASE:
        left = F.split(held, bounded(phrase))
        n = F.size(left) - 1
        extra = phrase.count(" ")
        phrases.append(F.when(F.contains(spaced, F.lit(f" {phrase} ")), F.struct(n.alias("n"), spaces(left[0]).alias("first"), (spaces(held) - extra - spaces(F.element_at(left, -1))).alias("last"), F.lit(label).alias("label"))))
    out = out.withColumn(hold + "_hit", F.when(held.isNotNull(), F.array_compact(F.array(*phrases))))
    hit, scanned = F.col(hold + "_hit"), F.col(hold + "_scan")
    base = F.coalesce(F.array_sort(F.array_distinct(hit["label"])), F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union(base, F.coalesce(scanned["labels"], F.array().cast("array<string>"))))
    columns = {
        "n_words": count,
        "n_base": F.coalesce(F.aggregate(hit["n"], F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"),
        "first_word": F.array_min(hit["first"]).cast("long"),
        "last_word": F.array_max(hit["last"]).cast("long"),
        "base_labels": F.array_join(base, ","),
        "labels": F.array_join(labels, ","),
        "score": F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(scanned["sure"], F.lit(0.0))),
    }
    rest = [c for c in docs.columns if c.lower() not in made]
    return out.select(*rest, *[columns[c].alias(c) for c in made])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", "text")).drop("text")


def doubled(pattern: str) -> str:
    """A rule's pattern over words with two spaces between them, so that neighbouring matches need not share one."""
    out = re.sub(r"\.(?=\{)", "(?:[^ ]|\0)", pattern)
    return re.sub(r"(?<!\^) (\??)", lambda m: "(?:\0)?" if m[1] else "\0", out).replace("\0", "  ")


def sql() -> str:
    """The same scan in DuckDB SQL: every rule on every text, and a detection stays unless an earlier one of no worse priority holds it."""
    book = ",\n".join("('%s', '%s', %d, %r)" % (doubled(pattern), label, priority, sure) for _, _, pattern, label, priority, sure in rules())
    at = [" AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split())) for phrase, _ in BASE]
    places = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {test}) AS at{k}" for k, test in enumerate(at))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    named = ", ".join(f"CASE WHEN len(at{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(BASE))
    return f"""
WITH rules(pattern, label, priority, sure) AS (VALUES {book}),
split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
base AS (SELECT *, '  ' || array_to_string(w, '  ') || '  ' AS t, {places} FROM split),
flat AS (SELECT *, list_concat(list_concat(at0, at1), at2) AS every, list_sort(list_distinct(list_filter([{named}], lambda x: x IS NOT NULL))) AS known FROM base),
marked AS (SELECT doc_id, label, priority, sure::DOUBLE AS sure, string_split(regexp_replace(t, ' (' || pattern || ') ', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts
  FROM flat, rules WHERE regexp_matches(t, ' (' || pattern || ') ')),
counted AS (SELECT *, list_transform(parts, lambda p: len(list_filter(string_split(p, ' '), lambda x: x <> ''))) AS c FROM marked),
hits AS (SELECT doc_id, label, priority, sure, list_sum(c[1 : 2 * k - 1]) AS s, list_sum(c[1 : 2 * k]) AS e FROM (SELECT *, unnest(range(1, len(parts) // 2 + 1)) AS k FROM counted)),
kept AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND o.s <= h.s AND o.e >= h.e AND o.priority <= h.priority
  AND (o.s < h.s OR o.e > h.e OR o.priority < h.priority OR o.label < h.label))),
found AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(sure) AS sure FROM kept GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT - 1 AS first_word, list_max(every)::BIGINT - 1 AS last_word,
  array_to_string(known, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(known, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(known) > 0 THEN 1.0 ELSE coalesce(sure, 0) END::DOUBLE AS score FROM flat LEFT JOIN found USING (doc_id)
"""
