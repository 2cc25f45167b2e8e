"""License scans [native]: ordered signature rules behind a keyword gate, with containment suppression.

A text is lower-cased (A-Z) and reduced to its words joined by one space. Only texts that hold a gate keyword are matched, and of
the rules only those whose keyword a text holds. Rules are names of licences, written by hand, and sentences of their texts
(SIGNATURES); versions and suffixes are added to the names by rule. The rules of one family or label share a pattern that finds
their places. Of all places found in a text, those inside another place (or equal to one of a higher priority) are dropped; the
first rule of its family that fits then names the label of each place that stays.

Defined results: null text is empty (no words, no labels); tables may be empty, rows repeated; input columns named like an
output are replaced; texts of any length are matched whole.
"""

from __future__ import annotations

import functools
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Families as (label, keyword, names as patterns over normalised words, versions, suffixes). The rules are made
# from them: every version with every suffix, by full name, short name and tag. A name with + needs a version behind it.
FAMILIES = (
    ("agpl", "affero", ("gnu affero general public license", "affero general public license", "affero gpl", "gnu affero gpl"), ("1 0", "2", "3"), ("or-later", "only")),
    ("agpl", "agpl", ("gnu agpl", "agpl"), ("1 0", "3", "3 0"), ("or-later", "only")),
    ("lgpl", "lesser", ("gnu lesser general public license", "lesser general public license", "lesser gpl"), ("2 1", "3", "3 0"), ("or-later", "only")),
    ("lgpl", "library general", ("gnu library general public license", "library general public license"), ("2", "2 0"), ("or-later", "only")),
    ("lgpl", "lgpl", ("gnu lgpl", "lgpl"), ("2", "2 0", "2 1", "3", "3 0"), ("or-later", "only")),
    ("gpl", "general public", ("gnu general public license", "general public license"), ("1", "2", "2 0", "3", "3 0"), ("or-later", "only")),
    ("gpl", "gpl", ("gnu gpl", "gpl"), ("1", "2", "2 0", "3", "3 0"), ("or-later", "only")),
    ("gfdl", "free documentation", ("gnu free documentation license", "free documentation license"), ("1 1", "1 2", "1 3"), ("or-later", "only")),
    ("gfdl", "gfdl", ("gnu gfdl", "gfdl"), ("1 1", "1 2", "1 3"), ("or-later", "only")),
    ("apache", "apache", ("apache software license", "apache license", "apache+"), ("1 0", "1 1", "2", "2 0"), ()),
    ("mit", "mit", ("mit expat license", "mit license", "mit x11 license", "mit no attribution license"), (), ()),
    ("bsd", "bsd", ("bsd zero clause license", "bsd 0 clause license", "bsd 1 clause license", "bsd 2 clause license", "bsd 3 clause license", "bsd 4 clause license", "simplified bsd license", "new bsd license", "modified bsd license", "original bsd license", "bsd license", "bsd 2 clause", "bsd 3 clause"), (), ()),
    ("isc", "isc", ("isc license",), (), ()),
    ("isc", "systems consortium", ("internet systems consortium license",), (), ()),
    ("mpl", "mozilla", ("mozilla public license", "mozilla public licence"), ("1 0", "1 1", "2", "2 0"), ("no-copyleft-exception",)),
    ("mpl", "mpl", ("mpl+",), ("1 0", "1 1", "2", "2 0"), ()),
    ("epl", "eclipse", ("eclipse public license", "eclipse distribution license"), ("1 0", "2", "2 0"), ()),
    ("eupl", "european union public", ("european union public licence", "european union public license"), ("1 0", "1 1", "1 2"), ()),
    ("cddl", "common development", ("common development and distribution license",), ("1 0", "1 1"), ()),
    ("cddl", "cddl", ("cddl", "cddl license"), ("1 0", "1 1"), ()),
    ("cpl", "common public", ("common public license",), ("1 0",), ()),
    ("artistic", "artistic", ("artistic license", "perl artistic license"), ("1 0", "2", "2 0"), ()),
    ("bsl", "boost", ("boost software license",), ("1 0",), ()),
    ("busl", "business source", ("business source license",), ("1 0", "1 1"), ()),
    ("sspl", "server side public", ("server side public license",), ("1", "1 0"), ()),
    ("elastic", "elastic", ("elastic license",), ("1 0", "2", "2 0"), ()),
    ("unlicense", "unlicense", ("the unlicense", "unlicense"), (), ()),
    ("unlicense", "public domain", ("free and unencumbered software released into the public domain", "released into the public domain", "dedicated to the public domain"), (), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("1", "2", "2 0"), ()),
    ("zlib", "zlib", ("zlib libpng license", "zlib license"), (), ()),
    ("psf", "python software foundation", ("python software foundation license",), ("2", "2 0"), ()),
    ("ofl", "open font", ("sil open font license", "open font license"), ("1 0", "1 1"), ()),
    ("odbl", "open database", ("open database license",), ("1 0",), ()),
    ("pddl", "open data commons", ("open data commons public domain dedication and license", "open data commons attribution license", "open data commons open database license"), ("1 0",), ()),
    ("ms-pl", "microsoft", ("microsoft public license", "microsoft reciprocal license"), (), ()),
    ("osl", "open software", ("open software license",), ("1 0", "1 1", "2", "2 0", "2 1", "3", "3 0"), ()),
    ("afl", "academic free", ("academic free license",), ("1 1", "1 2", "2", "2 0", "2 1", "3", "3 0"), ()),
    ("ecl", "educational community", ("educational community license",), ("1 0", "2", "2 0"), ()),
    ("cecill", "cecill", ("cecill b", "cecill c", "cecill"), ("1 0", "1 1", "2", "2 0", "2 1"), ()),
    ("cc0", "cc0", ("cc0",), ("1 0",), ("universal",)),
    ("cc-by-nc-nd", "nc nd", ("cc by nc nd",), ("1 0", "2", "2 0", "2 5", "3", "3 0", "4", "4 0"), ("international", "unported")),
    ("cc-by-nc-sa", "nc sa", ("cc by nc sa",), ("1 0", "2", "2 0", "2 5", "3", "3 0", "4", "4 0"), ("international", "unported")),
    ("cc-by-nc", "by nc", ("cc by nc",), ("1 0", "2", "2 0", "2 5", "3", "3 0", "4", "4 0"), ("international", "unported")),
    ("cc-by-nd", "by nd", ("cc by nd",), ("1 0", "2", "2 0", "2 5", "3", "3 0", "4", "4 0"), ("international", "unported")),
    ("cc-by-sa", "by sa", ("cc by sa",), ("1 0", "2", "2 0", "2 5", "3", "3 0", "4", "4 0"), ("international", "unported")),
    ("cc-by", "cc by", ("cc by",), ("1 0", "2", "2 0", "2 5", "3", "3 0", "4", "4 0"), ("international", "unported")),
    ("cc", "creative commons", ("creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial sharealike", "creative commons attribution noncommercial", "creative commons attribution noderivatives", "creative commons attribution sharealike", "creative commons attribution", "creative commons zero", "creative commons"), ("1 0", "2", "2 0", "2 5", "3", "3 0", "4", "4 0"), ("international", "unported", "universal")),
    ("proprietary", "rights reserved", ("all rights reserved",), (), ()),
    ("proprietary", "confidential", ("proprietary and confidential", "confidential and proprietary"), (), ()),
)

# Sentences and notices as label | keyword | pattern over normalised words, in order of priority.
SIGNATURES = """
mit | hereby granted free | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | without restriction | to deal in the software without restriction including without limitation the rights
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | mit licen[sc]ed | (?:is|are|dual) mit licen[sc]ed
mit | mit style | mit style licen[sc]e
mit | mit | (?:spdx )?licen[sc]e(?: identifier)? mit
mit-0 | mit 0 | licen[sc]e(?: identifier)? mit 0
bsd | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | retain the above copyright | redistributions of source code must retain the above copyright notice
bsd | reproduce the above copyright | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse or promote | neither the names? of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
bsd | bsd licen[sc]ed | (?:is|are) bsd licen[sc]ed
bsd | bsd style | bsd style licen[sc]e
bsd-2-clause | bsd 2 | licen[sc]e(?: identifier)? bsd 2 clause
bsd-3-clause | bsd 3 | licen[sc]e(?: identifier)? bsd 3 clause
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | isc | licen[sc]e(?: identifier)? isc
apache-2.0 | www apache org | (?:https? )?www apache org licenses license 2 0(?: html| txt)?
apache-2.0 | except in compliance | you may not use this file except in compliance with the license
apache-2.0 | distributed under the license is | software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | apache 2 | licen[sc]e(?: identifier)? apache 2 0
apache-1.1 | this product includes software developed by the apache | this product includes software developed by the apache software foundation
apache | apache licensed | (?:is|are) apache licensed
gpl-2-or-later | version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3-or-later | version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2 | version 2 of the | under the terms of version 2 of the gnu general public license
gpl-3 | version 3 of the | under the terms of version 3 of the gnu general public license
gpl | distributed in the hope | this program is distributed in the hope that it will be useful but without any warranty
gpl | this program is free software | this program is free software you can redistribute it and or modify it
gpl | copy of the gnu general | you should have received a copy of the gnu general public license
gpl | www gnu org licenses gpl | www gnu org licenses gpl(?: html| txt)?
gpl-2.0-only | gpl 2 0 only | licen[sc]e identifier gpl 2 0 only
gpl-2.0-or-later | gpl 2 0 or later | licen[sc]e identifier gpl 2 0 or later
gpl-3.0-only | gpl 3 0 only | licen[sc]e identifier gpl 3 0 only
gpl-3.0-or-later | gpl 3 0 or later | licen[sc]e identifier gpl 3 0 or later
gpl-classpath-exception | classpath | (?:gnu )?(?:general public license|gpl)(?: v?2(?: 0)?)?(?: only)? with (?:the )?classpath exception
gpl | gplv | (?:gnu )?gplv[123]
gpl | gpled | (?:is|are) gpled
lgpl | lesser general public | you should have received a copy of the gnu lesser general public license
lgpl | this library is free software | this library is free software you can redistribute it and or modify it
lgpl | lgplv | (?:gnu )?lgplv[23](?: 1)?
lgpl-2.1-or-later | lgpl 2 1 or later | licen[sc]e identifier lgpl 2 1 or later
lgpl-3.0-only | lgpl 3 0 only | licen[sc]e identifier lgpl 3 0 only
agpl | copy of the gnu affero | you should have received a copy of the gnu affero general public license
agpl | agplv | (?:gnu )?agplv3
agpl | interacting with it remotely | users interacting with it remotely through a computer network
agpl-3.0-or-later | agpl 3 0 or later | licen[sc]e identifier agpl 3 0 or later
gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
gfdl | copy distribute and or modify this document | permission is granted to copy distribute and or modify this document
mpl-2.0 | mozilla org mpl | (?:if a copy of the mpl was not distributed with this file you can obtain one at )?(?:https? )?(?:www )?mozilla org mpl 2 0
mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mpl 2 | licen[sc]e(?: identifier)? mpl 2 0
epl-2.0 | eclipse org legal epl | (?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?
epl-1.0 | eclipse org legal epl v10 | (?:www )?eclipse org legal epl v10(?: html)?
epl-2.0 | epl 2 | licen[sc]e(?: identifier)? epl 2 0
cddl | contents of this file are subject to the terms of the common development | the contents of this file are subject to the terms of the common development and distribution license
cpl | ibm public license | ibm public license(?: version)?(?: 1 0)?
bsl-1.0 | boost org license | (?:www )?boost org license 1 0 txt
bsl-1.0 | hereby granted free of charge to any person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
bsl-1.0 | bsl 1 | licen[sc]e(?: identifier)? bsl 1 0
zlib | as is without any express | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | must not be misrepresented | the origin of this software must not be misrepresented
zlib | plainly marked | altered source versions must be plainly marked as such
libpng | libpng | libpng license(?: version 2)?
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense org | (?:please refer to )?(?:https? )?unlicense org
wtfpl | what the fuck | do what the fuck you want to public licen[sc]e(?: version 2)?
wtfpl | wtfpl net | (?:www )?wtfpl net
cc0-1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0(?: deed| legalcode)?
cc0-1.0 | waived all copyright | (?:has|have) waived all copyright and related or neighboring rights
cc-by-4.0 | licenses by 4 0 | creativecommons org licenses by 4 0(?: deed| legalcode)?
cc-by-3.0 | licenses by 3 0 | creativecommons org licenses by 3 0(?: us| de| fr| deed| legalcode)?
cc-by-2.0 | licenses by 2 | creativecommons org licenses by 2 (?:0|5)(?: deed| legalcode)?
cc-by-sa-4.0 | licenses by sa 4 | creativecommons org licenses by sa 4 0(?: deed| legalcode)?
cc-by-sa-3.0 | licenses by sa 3 | creativecommons org licenses by sa 3 0(?: us| de| fr| deed| legalcode)?
cc-by-nc-4.0 | licenses by nc 4 | creativecommons org licenses by nc 4 0(?: deed| legalcode)?
cc-by-nc-sa-4.0 | licenses by nc sa 4 | creativecommons org licenses by nc sa 4 0(?: deed| legalcode)?
cc-by-nc-nd-4.0 | licenses by nc nd 4 | creativecommons org licenses by nc nd 4 0(?: deed| legalcode)?
cc-by-nd-4.0 | licenses by nd 4 | creativecommons org licenses by nd 4 0(?: deed| legalcode)?
cc-by-sa | attribution share alike | (?:creative commons )?attribution share alike(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc | attribution non commercial | (?:creative commons )?attribution non commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-sa | non commercial share alike | (?:creative commons )?attribution non commercial share alike(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-nd | non commercial no deriv | (?:creative commons )?attribution non commercial no deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
cc-by-nd | attribution no deriv | (?:creative commons )?attribution no deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
public-domain | in the public domain | (?:this work|this file|this software|this text|it|which) is in the public domain
public-domain | domain mark | public domain mark(?: 1 0)?
public-domain | united states government | (?:as )?a work of the united states government
psf | psf license | psf license(?: agreement)?(?: 2)?
python-2.0 | python 2 | licen[sc]e identifier python 2 0
ofl-1.1 | scripts sil org ofl | (?:https? )?scripts sil org ofl
ofl-1.1 | ofl 1 | licen[sc]e(?: identifier)? ofl 1 1
odbl | opendatacommons org licenses odbl | opendatacommons org licenses odbl(?: 1 0)?
odc-by | opendatacommons org licenses by | opendatacommons org licenses by(?: 1 0)?
pddl | opendatacommons org licenses pddl | opendatacommons org licenses pddl(?: 1 0)?
sspl | functionality of the program | if you make the functionality of the program or a modified version available to third parties as a service
busl | change license | (?:the )?change date .{1,60}? change license
elastic | hosted or managed | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons clause | commons clause(?: license)? condition(?: v1 0)?
openssl | openssl | (?:dual )?openssl(?: and original ssleay)? licen[sc]e
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php license | (?:the )?php licen[sc]e(?: version)?(?: 3 0[01])?
ruby | ruby | ruby (?:s )?licen[sc]e
artistic-2.0 | artistic 2 | licen[sc]e(?: identifier)? artistic 2 0
artistic | same terms as perl | (?:under )?the same terms as perl itself
vim | vim license | vim licen[sc]e
tcl | tcl tk license | tcl tk licen[sc]e
curl | curl | licen[sc]e(?: identifier)? curl
postgresql | postgresql license | (?:the )?postgresql licen[sc]e
ncsa | illinois | (?:university of illinois )?(?:ncsa )?university of illinois(?: ncsa)? open source license
x11 | x window system | x window system licen[sc]e
w3c | w3c software | w3c software(?: and document)?(?: notice and)? licen[sc]e
unicode | unicode license | unicode (?:license agreement|licen[sc]e)(?: v3)?
intel | intel simplified | intel simplified software license
nvidia | nvidia | nvidia (?:software|source code) licen[sc]e
ms-eula | microsoft software license | microsoft software licen[sc]e terms
eula | end user | end user licen[sc]e agreement
openrail | openrail | (?:creativeml )?openrail(?: m)?(?: licen[sc]e)?
llama | llama | llama(?: [23](?: [123])?)? community licen[sc]e(?: agreement)?
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | may not be reproduced | (?:this (?:work|document|publication)|no part of this publication) may not be reproduced
proprietary | no part of this | no part of this (?:publication|book|document) may be reproduced
proprietary | distribution | not for (?:re)?distribution
proprietary | trade secret | trade secrets? (?:of|and confidential information)
proprietary | commercial license | (?:requires|under) a commercial licen[sc]e
non-commercial | non commercial use only | (?:for )?(?:personal(?: and| or)? )?non commercial use only
research-only | research purposes only | (?:for )?(?:academic(?: and| or)? )?research purposes only
"""

# Single words of which any rule's place holds one; the short ones count at the start of a word only.
GATE = ("licen", "gpl", "gfdl", "apache", "permi", "redistribut", "bsd", "cddl", "domain", "wtfpl", "cecill", "commons", "reserved", "confidential", "copyright", "software", "openrail", "advertising", "invariant", "mozilla", "eclipse", "attribution", "perl", "commercial", "research", "reproduced", "distribut", "secret", "unauthorized", "hosted", "functionality", "remotely", "misrepresented", "plainly", "government", "endorse", "contributors")
GATE_STARTS = ("cc", "mpl", "ofl")

# What the words between a name and its version, and the suffixes, look like.
_LINK = r"(?: (?:as published by the free software foundation|either|license|licence|public|version|ver|v))*"
_SUFFIX = {
    "or-later": r"(?: or(?: at your option)? any later version| or later| or newer)",
    "only": r" only",
    "no-copyleft-exception": r" no copyleft exception",
    "international": r" international(?: license)?",
    "unported": r" unported(?: license)?",
    "universal": r" universal(?: public domain dedication)?",
}

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE_PATTERN = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"
OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@functools.cache
def signatures() -> dict[str, list[tuple[str, str]]]:
    """(keyword, pattern) of the signatures by label, in order."""
    out: dict[str, list[tuple[str, str]]] = {}
    for line in SIGNATURES.strip().splitlines():
        label, keyword, pattern = (x.strip() for x in line.split("|", 2))
        out.setdefault(label, []).append((keyword, pattern))
    return out


@functools.cache
def rules() -> tuple[tuple[int, str, str, float], ...]:
    """(family, regex over one place, label, confidence), in order of priority within each family; signatures follow the names."""
    made = []
    for f, (label, _, names, versions, suffixes) in enumerate(FAMILIES):
        for marked in names:
            name = marked.rstrip("+")
            own = name_label(label, name)
            for v in sorted(versions, key=len, reverse=True):
                version = v.replace(" ", ".")
                for s in suffixes:
                    made.append((f, f"^{name}{_LINK} v?{v}{_SUFFIX[s]}$", f"{own}-{version}-{s}", 1.0))
                made.append((f, f"^{name}{_LINK} v?{v}$", f"{own}-{version}", 1.0))
            if marked == name:
                made.append((f, f"^{name}{_LINK}$", own, 0.8 if versions else 0.95))
    for f, label in enumerate(signatures(), len(FAMILIES)):
        made += [(f, f"^{pattern}$", label, 1.0) for _, pattern in signatures()[label]]
    return tuple(made)


def name_label(label: str, name: str) -> str:
    """The label of a family's name: variants that the name tells apart get their own."""
    for mark, said in (("noncommercial noderivatives", "cc-by-nc-nd"), ("noncommercial sharealike", "cc-by-nc-sa"), ("attribution noncommercial", "cc-by-nc"), ("attribution noderivatives", "cc-by-nd"), ("attribution sharealike", "cc-by-sa"), ("commons attribution", "cc-by"), ("commons zero", "cc0"), ("distribution license", "edl"), ("no attribution", "mit-0"), ("reciprocal", "ms-rl")):
        if mark in name and (label in ("cc", "epl", "mit", "ms-pl")):
            return said
    if label == "bsd" and (m := re.search(r"(\d) clause", name)):
        return f"bsd-{m[1]}-clause"
    return {"simplified bsd license": "bsd-2-clause", "new bsd license": "bsd-3-clause", "modified bsd license": "bsd-3-clause", "original bsd license": "bsd-4-clause", "bsd zero clause license": "bsd-0-clause"}.get(name, label)


@functools.cache
def families() -> tuple[tuple[tuple[str, ...], str], ...]:
    """The keywords of each family and the pattern that finds its places in normalised text; longest versions and names come first."""
    out = []
    for _, keyword, names, versions, suffixes in FAMILIES:
        version = "(?:" + "|".join(sorted(versions, key=len, reverse=True)) + ")"
        end = "(?:" + "|".join(_SUFFIX[s] for s in suffixes) + ")?" if suffixes else ""
        tail = f"(?:{_LINK} v?{version}(?= ){end})" if versions else ""
        each = [x.rstrip("+") + (tail if x.endswith("+") else f"{tail}?" if tail else "") for x in sorted(names, key=len, reverse=True)]
        out.append(((keyword,), "(?<= )(?:" + "|".join(each) + ")(?= )"))
    for rows in signatures().values():
        out.append((tuple(k for k, _ in rows), "(?<= )(?:" + "|".join(p for _, p in rows) + ")(?= )"))
    return tuple(out)


KIND = "array<struct<s:int,o:int,p:int,hit:string>>"


@functools.cache
def places_sql(norm: str) -> str:
    """All places of all families in the column norm, one SQL expression: KIND sorted, where o is the negative end.

    Sorted by (s, o, p), a place that contains another stands before it. Offsets are the lengths of the parts and hits before.
    """
    parts = []
    for f, (keywords, pattern) in enumerate(families()):
        held = " OR ".join(f"{norm} RLIKE '{k}'" if "[" in k else f"contains({norm}, '{k}')" for k in keywords)
        step = f"""(a, x) -> named_struct('at', a.at + length(x.part) + length(x.hit), 'out', concat(a.out, array(named_struct('s', a.at + length(x.part), 'o', -(a.at + length(x.part) + length(x.hit)), 'p', {f}, 'hit', x.hit))))"""
        pairs = f"zip_with(slice(split({norm}, r'{pattern}', -1), 1, size(h)), h, (part, hit) -> named_struct('part', part, 'hit', hit))"
        found = f"transform(array(regexp_extract_all({norm}, r'{pattern}', 0)), h -> aggregate({pairs}, named_struct('at', 0, 'out', CAST(array() AS {KIND})), {step}, a -> a.out))[0]"
        parts.append(f"CASE WHEN {held} THEN {found} ELSE CAST(array() AS {KIND}) END")
    return f"sort_array(concat({', '.join(parts)}))"


def named(place: Column) -> Column:
    """struct<label, conf> of a place: the first rule of its family that fits."""
    # One line a rule: regex, label and confidence, tab-separated; the lists are constants.
    lines = ["\n".join(f"{regex}\t{label}\t{conf}" for k, regex, label, conf in rules() if k == f) for f in range(len(families()))]
    own = F.split(F.element_at(F.array(*[F.lit(x) for x in lines]), place["p"] + 1), "\n")
    first = F.get(F.filter(own, lambda r: F.rlike(place["hit"], F.split_part(r, F.lit("\t"), F.lit(1)))), F.lit(0))
    return F.struct(F.split_part(first, F.lit("\t"), F.lit(2)).alias("label"), F.split_part(first, F.lit("\t"), F.lit(3)).cast("double").alias("conf"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with OUTPUTS and places (start and end in the normalised text, label) of what the method finds.

    One pass over the texts, no shuffle. Texts without a gate keyword are only counted.
    """
    docs = without(docs, *OUTPUTS, "places")
    # The text's own columns are set aside in one struct, so that no name of theirs meets a name used here.
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    names = docs.schema["row"].dataType.names
    t = F.coalesce(F.col("row").getField(text), F.lit(""))
    words = F.size(F.array_remove(F.split(t, _NOT_WORD_ANY_CASE), "")).cast("long")
    low = F.col("__low")
    gate = reduce(or_, [F.contains(low, F.lit(k)) for k in GATE] + [F.contains(low, F.lit(k)) & low.rlike(f"(?<![0-9a-z]){k}") for k in GATE_STARTS])
    gated = F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(t, _UPPER, _LOWER), _NOT_WORD, " ")), F.lit(" ")))
    base = docs.withColumn("n_words", words).withColumn("__low", F.lower(t)).withColumn("__norm", gated)
    norm = F.col("__norm")

    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    parts, hits = F.split(norm, _BASE_PATTERN, -1), F.regexp_extract_all(norm, F.lit(_BASE_PATTERN), F.lit(0))
    last = F.element_at(hits, -1)
    is_base = norm.rlike(_BASE_PATTERN)
    label_of = F.create_map(*[F.lit(x) for pair in BASE for x in pair])
    found = base.withColumn("__base", F.when(is_base, F.struct(
        F.size(hits).cast("long").alias("n"), (spaces(F.element_at(parts, 1)) - 1).cast("long").alias("first"),
        (F.col("n_words") - (spaces(F.element_at(parts, -1)) - 1) - (spaces(last) + 1)).cast("long").alias("last"),
        F.array_distinct(F.transform(hits, lambda h: F.element_at(label_of, h))).alias("labels"),
    )))
    found = found.withColumn("__all", F.expr(f"CASE WHEN __norm IS NOT NULL THEN {places_sql('__norm')} END"))

    # In this order a place lies in an earlier one just if its end isn't beyond all ends so far.
    def keep(acc: Column, x: Column) -> Column:
        new = -x["o"] > acc["end"]
        return F.when(new, F.struct((-x["o"]).alias("end"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)

    kept = F.aggregate("__all", F.struct(F.lit(0).alias("end"), F.array().cast(KIND).alias("out")), keep, lambda acc: acc["out"])
    told = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), named(x).alias("as")))
    found = found.withColumn("__kept", F.when(F.size("__all") > 0, told))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.col("__base.labels"), none)
    own = F.coalesce(F.transform("__kept", lambda x: x["as"]["label"]), none)
    return found.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        "n_words",
        F.coalesce(F.col("__base.n"), F.lit(0).cast("long")).alias("n_base"),
        F.col("__base.first").alias("first_word"),
        F.col("__base.last").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("__kept", lambda x: x["as"]["conf"])), F.when(F.col("__base").isNotNull(), F.lit(0.8)), F.lit(0.0)).alias("score"),
        F.coalesce(F.transform("__kept", lambda x: F.struct(x["s"].alias("start"), (-x["o"]).alias("end"), x["as"]["label"].alias("label"))), F.array().cast("array<struct<start:int,end:int,label:string>>")).alias("places"),
    )
