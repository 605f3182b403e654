"""License scan by ordered signature rules (DataFrame functions only).

A text is reduced to its words, each between two spaces of its own, so a rule is a
plain regular expression over whole words and two neighbouring matches share nothing.
Rules are written in a small notation, one element per word: ``a|b`` alternatives,
``?`` optional.  A rule runs only where its keyword stands in the words, and the whole
set only where the text holds one of a few stems.

Every detection has a priority: identifiers over links, statements, notices and names.
A detection that lies within another one of higher priority (or of the same priority
and longer) is suppressed.  Beside the rules, the base phrases are counted at every
place.

Edge cases: a null or empty text has no words and no labels and scores 0; ties
between equal intervals go to the earlier rule; repeated rows are scanned each; an
empty table gives an empty result; other columns are ignored.  Very long texts are
scanned whole; places and suppression come from running sums and maxima over the
detections in order, so a text of nothing but licenses takes time in proportion to it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Every rule demands a word with one of these stems (a test holds them together), so a text without any cannot match.
STEMS = ("licen", "spdx", "copyright", "copyleft", "permission", "redistribut", "domain", "commons", "reserved", "warrant", "proprietary", "commercial", "advertising", "clause", "cc0", "attribution", "released", "distributed", "published", "provided", "available")

#: Signatures, written for each license by itself: (label, notation).  Earlier groups have priority over later ones.
#: Identifier lines.
IDENTIFIERS = (
    ("mit", "spdx license identifier mit"),
    ("mit-0", "spdx license identifier mit 0"),
    ("x11", "spdx license identifier x11"),
    ("isc", "spdx license identifier isc"),
    ("apache-1.1", "spdx license identifier apache 1 1"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("bsd-1-clause", "spdx license identifier bsd 1 clause"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("bsd-4-clause", "spdx license identifier bsd 4 clause"),
    ("0bsd", "spdx license identifier 0bsd"),
    ("gpl-1.0", "spdx license identifier gpl 1 0 only|or? later?"),
    ("gpl-2.0", "spdx license identifier gpl 2 0 only|or? later?"),
    ("gpl-3.0", "spdx license identifier gpl 3 0 only|or? later?"),
    ("agpl-1.0", "spdx license identifier agpl 1 0 only|or? later?"),
    ("agpl-3.0", "spdx license identifier agpl 3 0 only|or? later?"),
    ("lgpl-2.0", "spdx license identifier lgpl 2 0 only|or? later?"),
    ("lgpl-2.1", "spdx license identifier lgpl 2 1 only|or? later?"),
    ("lgpl-3.0", "spdx license identifier lgpl 3 0 only|or? later?"),
    ("gfdl", "spdx license identifier gfdl 1 1|2|3"),
    ("mpl-1.0", "spdx license identifier mpl 1 0"),
    ("mpl-1.1", "spdx license identifier mpl 1 1"),
    ("mpl-2.0", "spdx license identifier mpl 2 0"),
    ("epl-1.0", "spdx license identifier epl 1 0"),
    ("epl-2.0", "spdx license identifier epl 2 0"),
    ("cddl-1.0", "spdx license identifier cddl 1 0"),
    ("cddl-1.1", "spdx license identifier cddl 1 1"),
    ("cpl-1.0", "spdx license identifier cpl 1 0"),
    ("ipl-1.0", "spdx license identifier ipl 1 0"),
    ("eupl-1.1", "spdx license identifier eupl 1 1"),
    ("eupl-1.2", "spdx license identifier eupl 1 2"),
    ("artistic-1.0", "spdx license identifier artistic 1 0"),
    ("artistic-2.0", "spdx license identifier artistic 2 0"),
    ("zlib", "spdx license identifier zlib"),
    ("bsl-1.0", "spdx license identifier bsl 1 0"),
    ("bsl-1.1", "spdx license identifier busl 1 1"),
    ("unlicense", "spdx license identifier unlicense"),
    ("wtfpl", "spdx license identifier wtfpl"),
    ("beerware", "spdx license identifier beerware"),
    ("psf-2.0", "spdx license identifier psf 2 0"),
    ("openssl", "spdx license identifier openssl"),
    ("php-3.0", "spdx license identifier php 3 0"),
    ("php-3.01", "spdx license identifier php 3 01"),
    ("ruby", "spdx license identifier ruby"),
    ("vim", "spdx license identifier vim"),
    ("tcl", "spdx license identifier tcl"),
    ("postgresql", "spdx license identifier postgresql"),
    ("curl", "spdx license identifier curl"),
    ("ncsa", "spdx license identifier ncsa"),
    ("upl-1.0", "spdx license identifier upl 1 0"),
    ("ms-pl", "spdx license identifier ms pl"),
    ("ms-rl", "spdx license identifier ms rl"),
    ("osl-3.0", "spdx license identifier osl 3 0"),
    ("afl-3.0", "spdx license identifier afl 3 0"),
    ("ecl-2.0", "spdx license identifier ecl 2 0"),
    ("w3c", "spdx license identifier w3c"),
    ("lppl-1.3c", "spdx license identifier lppl 1 3c"),
    ("sleepycat", "spdx license identifier sleepycat"),
    ("ofl-1.1", "spdx license identifier ofl 1 1"),
    ("odbl-1.0", "spdx license identifier odbl 1 0"),
    ("odc-by-1.0", "spdx license identifier odc by 1 0"),
    ("pddl-1.0", "spdx license identifier pddl 1 0"),
    ("cc0-1.0", "spdx license identifier cc0 1 0"),
    ("cc-by-2.0", "spdx license identifier cc by 2 0"),
    ("cc-by-3.0", "spdx license identifier cc by 3 0"),
    ("cc-by-4.0", "spdx license identifier cc by 4 0"),
    ("cc-by-sa-2.0", "spdx license identifier cc by sa 2 0"),
    ("cc-by-sa-3.0", "spdx license identifier cc by sa 3 0"),
    ("cc-by-sa-4.0", "spdx license identifier cc by sa 4 0"),
    ("cc-by-nd-4.0", "spdx license identifier cc by nd 4 0"),
    ("cc-by-nc-3.0", "spdx license identifier cc by nc 3 0"),
    ("cc-by-nc-4.0", "spdx license identifier cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "spdx license identifier cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "spdx license identifier cc by nc nd 4 0"),
    ("elastic-2.0", "spdx license identifier elastic 2 0"),
    ("sspl-1.0", "spdx license identifier sspl 1 0"),
)
#: Addresses of license texts.
LINKS = (
    ("mit", "opensource org licenses mit"),
    ("isc", "opensource org licenses isc"),
    ("apache-2.0", "www? apache org licenses license 2 0"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("gpl-2.0", "opensource org licenses gpl 2 0"),
    ("gpl-3.0", "gnu org licenses gpl 3 0"),
    ("gpl-3.0", "opensource org licenses gpl 3 0"),
    ("gpl", "gnu org licenses gpl"),
    ("agpl-3.0", "gnu org licenses agpl 3 0"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0"),
    ("bsl-1.0", "boost org license 1 0"),
    ("unlicense", "unlicense org"),
    ("odbl-1.0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "opendatacommons org licenses by"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-2.0", "creativecommons org licenses by 2 0"),
    ("cc-by-3.0", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-2.0", "creativecommons org licenses by sa 2 0"),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nd-3.0", "creativecommons org licenses by nd 3 0"),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0"),
    ("polyform", "polyformproject org licenses"),
)
#: Statements that a license applies.
STATEMENTS = (
    ("mit", "licensed|licenced|released|distributed|available under the? terms? of? the? mit license|licence"),
    ("isc", "licensed|released|distributed|available under the? terms? of? the? isc license"),
    ("apache-2.0", "licensed|released|distributed|available under the? terms? of? the? apache software? license version? 2|v2 0?"),
    ("bsd-2-clause", "licensed|released|distributed|available under the? terms? of? the? bsd 2|two clause license?"),
    ("bsd-3-clause", "licensed|released|distributed|available under the? terms? of? the? bsd 3|three clause license?"),
    ("bsd", "licensed|released|distributed|available under the? terms? of? the? bsd license"),
    ("gpl-2.0", "licensed|released|distributed|available under the? terms? of? the? gplv2"),
    ("gpl-3.0", "licensed|released|distributed|available under the? terms? of? the? gplv3"),
    ("gpl", "licensed|released|distributed|available under the? terms? of? the? gpl|gnugpl"),
    ("agpl-3.0", "licensed|released|distributed|available under the? terms? of? the? agpl|agplv3"),
    ("lgpl", "licensed|released|distributed|available under the? terms? of? the? lgpl|lgplv2|lgplv3"),
    ("eupl-1.2", "licensed under the eupl"),
    ("artistic", "licensed|released|distributed|available under the? terms? of? the? artistic license"),
    ("perl", "licensed|distributed|available under the same terms as perl itself"),
    ("perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("wtfpl", "licensed|released|distributed|available under the? terms? of? the? wtfpl"),
    ("ruby", "licensed|distributed|available under the? terms? of? the? ruby license"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("odbl-1.0", "made available under the open database license"),
    ("cc-by-4.0", "licensed|available|distributed|published under a? the? cc by 4 0"),
    ("cc-by-sa-4.0", "licensed|available|distributed|published under a? the? cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed|available|distributed|published under a? the? cc by nc 4 0"),
    ("creative-commons", "licensed|available|distributed|published under a? the? creative commons"),
    ("public-domain", "dedicated|released|placed to|into|in the public domain"),
)
#: Sentences of notices and of the licenses themselves.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name without prior written permission"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions license"),
    ("bsd-3-clause", "neither the name of the? copyright holder|holders nor the names of its|their contributors may be used"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("gpl-2.0", "terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2.0", "terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", "terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("agpl-3.0", "remote network interaction use with the gnu general public license"),
    ("lgpl-2.1", "terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser|library general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("psf-2.0", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("openssl", "the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software without prior written permission"),
    ("php-3.01", "this source file is subject to version 3 01 of the php license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("lppl-1.3c", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("cc0-1.0", "waived all copyright and related or neighboring rights"),
    ("cc-by-nc-sa-4.0", "creative commons attribution non? noncommercial|commercial share|sharealike alike? 4 0"),
    ("cc-by-nc-nd-4.0", "creative commons attribution non? noncommercial|commercial no? noderivatives|noderivs|derivatives 4 0"),
    ("public-domain", "this work is in the public domain"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "redistribution is strictly? prohibited|forbidden"),
    ("proprietary", "this software is licensed not sold"),
    ("proprietary", "end user license agreement"),
    ("non-commercial", "for non commercial use only"),
    ("non-commercial", "permission is granted for noncommercial|personal|academic use only?"),
    ("non-commercial", "may not be used for commercial purposes"),
    ("proprietary", "unauthorized reproduction or distribution of this copyrighted work"),
)
#: Names of licenses.
TITLES = (
    ("mit", "mit license|licence"),
    ("mit", "license|licence mit"),
    ("mit", "expat license"),
    ("mit-0", "mit no attribution license?"),
    ("x11", "x11|xfree86 license"),
    ("isc", "isc license"),
    ("isc", "license isc"),
    ("apache-1.1", "apache software? license version 1 1"),
    ("apache-2.0", "apache software? license version? 2|v2 0?"),
    ("apache-2.0", "license apache 2 0"),
    ("apache-2.0", "apache 2 0 license|licence"),
    ("bsd-1-clause", "bsd 1|one clause license"),
    ("bsd-2-clause", "bsd 2|two clause license?"),
    ("bsd-2-clause", "simplified|freebsd bsd license"),
    ("bsd-2-clause", "2|two clause bsd license"),
    ("bsd-3-clause", "bsd 3|three clause license?"),
    ("bsd-3-clause", "new|modified|revised bsd license"),
    ("bsd-3-clause", "3|three clause bsd license"),
    ("bsd-4-clause", "bsd 4|four clause license?"),
    ("bsd-4-clause", "original|old bsd license"),
    ("0bsd", "zero clause bsd license?"),
    ("0bsd", "bsd zero clause license"),
    ("gpl-1.0", "gnu? general public license version|v 1 0?"),
    ("gpl-2.0", "gnu? general public license version|v 2 0?"),
    ("gpl-2.0", "gnu? general public license v2"),
    ("gpl-2.0", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", "gnu? general public license version|v 3 0?"),
    ("gpl-3.0", "gnu? general public license v3"),
    ("agpl-1.0", "affero general public license version 1"),
    ("agpl-3.0", "gnu? affero general public license version|v 3 0?"),
    ("agpl-3.0", "gnu affero general public license"),
    ("lgpl-2.0", "gnu? library general public license version|v 2 0?"),
    ("lgpl-2.0", "gnu library general public license"),
    ("lgpl-2.1", "gnu? lesser general public license version|v 2 1"),
    ("lgpl-2.1", "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", "gnu? lesser general public license version|v 3 0?"),
    ("gfdl-1.1", "gnu free documentation license version 1 1"),
    ("gfdl-1.2", "gnu free documentation license version 1 2"),
    ("gfdl-1.3", "gnu free documentation license version 1 3"),
    ("gfdl", "gnu? free documentation license"),
    ("mpl-1.0", "mozilla public license version? 1 0"),
    ("mpl-1.1", "mozilla public license version? 1 1"),
    ("mpl-2.0", "mozilla public license version|v? 2|v2 0"),
    ("epl-1.0", "eclipse public license version|v? 1|v1 0"),
    ("epl-2.0", "eclipse public license version|v? 2|v2 0"),
    ("edl-1.0", "eclipse distribution license version|v? 1|v1 0"),
    ("cddl-1.0", "common development and distribution license"),
    ("cddl-1.1", "common development and distribution license version 1 1"),
    ("cpl-1.0", "common public license version? 1? 0?"),
    ("ipl-1.0", "ibm public license version? 1? 0?"),
    ("eupl-1.1", "european union public licence|license version|v? 1|v1 1"),
    ("eupl-1.2", "european union public licence|license version|v? 1|v1 2"),
    ("artistic-1.0", "artistic license version? 1 0"),
    ("artistic-2.0", "artistic license version? 2 0"),
    ("zlib", "zlib libpng? license"),
    ("bsl-1.0", "boost software license version? 1? 0?"),
    ("bsl-1.1", "business source license 1? 1?"),
    ("unlicense", "the unlicense"),
    ("beerware", "beer|beerware ware? license"),
    ("psf-2.0", "python software foundation license version? 2?"),
    ("openssl", "openssl license"),
    ("php-3.0", "php license version 3 0"),
    ("php-3.01", "php license version 3 01"),
    ("vim", "vim license"),
    ("tcl", "tcl tk license"),
    ("postgresql", "postgresql license"),
    ("curl", "curl license"),
    ("ncsa", "university of illinois ncsa open source license"),
    ("upl-1.0", "universal permissive license version|v? 1|v1 0"),
    ("ms-pl", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license"),
    ("osl-3.0", "open software license version|v? 3|v3 0"),
    ("afl-3.0", "academic free license version|v? 3|v3 0"),
    ("ecl-2.0", "educational community license version? 2 0"),
    ("w3c", "w3c software notice and? document? license"),
    ("lppl-1.3c", "latex project public license"),
    ("sleepycat", "sleepycat license"),
    ("ofl-1.1", "sil open font license version? 1? 1?"),
    ("odbl-1.0", "open database license"),
    ("odc-by-1.0", "open data commons attribution license"),
    ("pddl-1.0", "open data commons public domain dedication and licence|license"),
    ("cc0-1.0", "creative commons cc0 1? 0?"),
    ("cc0-1.0", "cc0 1 0 universal"),
    ("cc0-1.0", "no rights reserved creative commons"),
    ("cc-by-2.0", "creative commons attribution 2 0"),
    ("cc-by-3.0", "creative commons attribution 3 0"),
    ("cc-by-4.0", "creative commons attribution 4 0"),
    ("cc-by-sa-3.0", "creative commons attribution share|sharealike alike? 3 0"),
    ("cc-by-sa-4.0", "creative commons attribution share|sharealike alike? 4 0"),
    ("cc-by-nd-4.0", "creative commons attribution noderivatives|noderivs 4 0"),
    ("cc-by-nc-3.0", "creative commons attribution non? noncommercial|commercial 3 0"),
    ("cc-by-nc-4.0", "creative commons attribution non? noncommercial|commercial 4 0"),
    ("cc-by-nc-sa-3.0", "creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0"),
    ("elastic-2.0", "elastic license version? 2|v2 0?"),
    ("sspl-1.0", "server side public license version? 1?"),
    ("commons-clause", "commons clause license? condition"),
    ("openrail", "responsible ai license"),
    ("polyform", "polyform noncommercial license"),
    ("polyform", "polyform small business license"),
    ("polyform", "polyform perimeter|shield|strict license"),
    ("llama", "llama 2|3 community license"),
    ("openrail", "creativeml open rail m license"),
)
#: Names of families only.
HINTS = (
    ("creative-commons", "creative commons license"),
    ("copyleft", "copyleft license"),
    ("proprietary", "all rights reserved"),
    ("gpl", "gnu? general public license"),
    ("lgpl", "gnu? lesser|library general public license"),
    ("apache", "apache license"),
    ("bsd", "bsd style? license"),
    ("mpl", "mozilla public license"),
)
#: priority, confidence and signatures of each group.
GROUPS = (
    (100, 1.0, IDENTIFIERS),
    (95, 0.95, LINKS),
    (90, 0.95, STATEMENTS),
    (70, 0.85, NOTICES),
    (40, 0.6, TITLES),
    (20, 0.3, HINTS),
)


def pattern(notation: str) -> str:
    """The regular expression of a rule over words that each stand between two spaces."""
    out = []
    for element in notation.split():
        optional, body = element.endswith("?"), element.rstrip("?")
        out.append(f"(?: (?:{body}) )" + "?" * optional)
    return "".join(out)


def keyword(notation: str) -> str:
    """The longest word that every match of the rule holds."""
    fixed = [e for e in notation.split() if "|" not in e and not e.endswith("?")]
    return f" {max(fixed, key=len)} " if fixed else " "


def rules() -> list[dict]:
    """All rules in order: the earlier one wins between equals."""
    out = [(priority, confidence, label, notation) for priority, confidence, signatures in GROUPS for label, notation in signatures]
    return [{"no": k, "priority": p, "confidence": c, "label": label, "kw": keyword(n), "rx": pattern(n)} for k, (p, c, label, n) in enumerate(out)]


#: Values that a running sum takes in one go.
RUN_BLOCK = 256

RULE_TYPE = "array<struct<no:int,priority:int,confidence:double,label:string,kw:string,rx:string>>"


def _places(words: list[str], label: str) -> Column:
    """Every place (word index, from 0) where the words stand consecutively in ``_w``."""
    starts = F.when(F.size("_w") >= len(words), F.sequence(F.lit(0), F.size("_w") - len(words))).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(words):
            ok = ok & (F.get(F.col("_w"), i + k) == w)
        return ok

    return F.transform(F.filter(starts, stands), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _words_in(part: Column) -> Column:
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, first: Column, join) -> Column:
    """For every place of an array: all earlier values joined, from ``first`` on.

    Runs within blocks and over the blocks' totals, so an array of n takes n * RUN_BLOCK short steps."""
    grow = lambda xs: F.aggregate(xs, F.array(first), lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x))))

    def joined(blocks: Column) -> Column:
        return _let(grow(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda starts: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: join(F.get(starts, i), x)))))

    n_blocks = F.ceil(F.size(values) / RUN_BLOCK).cast("int")
    cut = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(1)) - 1), lambda b: grow(F.slice(values, b * RUN_BLOCK + 1, RUN_BLOCK))))
    return F.when(n_blocks > 0, _let(cut, joined)).otherwise(F.array().cast("array<int>"))


def _detections(norm: Column, rule: Column) -> Column:
    """Places of one rule as structs [from, to) in words."""
    add = lambda x, y: x + y
    pieces = F.transform(F.split(norm, rule["rx"], -1), _words_in)  # words before, between and after the matches
    lengths = F.transform(F.regexp_extract_all(norm, rule["rx"], F.lit(0)), _words_in)

    def placed(own: Column) -> Column:
        return F.transform(own["steps"], lambda step, k: F.struct((F.get(own["sums"], k) + step["gap"]).alias("from"), (F.get(own["sums"], k) + step["gap"] + step["n"]).alias("to"), rule["priority"].alias("priority"), rule["no"].alias("no"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    steps = F.zip_with(pieces, lengths, lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    with_sums = lambda s: F.struct(s.alias("steps"), _before(F.transform(s, lambda x: x["gap"] + x["n"]), F.lit(0), add).alias("sums"))
    return _let(_let(F.filter(steps, lambda x: x["n"].isNotNull()), with_sums), placed)


def _kept(found: Column) -> Column:
    """Detections that none of higher priority, or of the same and longer (or earlier in the rules), holds.

    In the order by start, longer ones first, every detection that holds another one stands before it; so one goes
    if the furthest end so far, among those of its priority or higher, is not before its own end."""
    key = lambda x: F.struct(x["from"].alias("a"), (-x["to"]).alias("b"), (-x["priority"]).alias("c"), x["no"].alias("d"))
    ordered = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(key(x).alias("key"), x.alias("x")))), lambda x: x["x"])

    def of_level(level: Column, rows: Column) -> Column:
        def alone(mine: Column) -> Column:
            marked = lambda far: F.filter(F.zip_with(mine, far, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: (z["x"]["priority"] == level) & (z["y"] < z["x"]["to"]))
            return F.transform(_let(_before(F.transform(mine, lambda x: x["to"]), F.lit(-1), F.greatest), marked), lambda z: z["x"])

        return _let(F.filter(rows, lambda x: x["priority"] >= level), alone)

    return _let(ordered, lambda rows: F.flatten(F.transform(F.array_distinct(F.transform(rows, lambda x: x["priority"])), lambda level: of_level(level, rows))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections
    (array of the kept detections: from and to in words, label, priority, confidence)."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lower = F.lower(text)
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains(lower, F.lit(stem))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    step = own.select("_id", F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), F.when(gate, F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("_w"))
    step = step.withColumn("_w", F.coalesce("_w", F.array().cast("array<string>")))
    base = F.concat(*(_places(phrase.split(), label) for phrase, label in BASE))
    norm = F.when(F.size("_w") > 0, F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" "))).otherwise(F.lit(""))
    step = step.select("_id", "n_words", base.alias("_base"), norm.alias("_norm"))
    table = F.from_json(F.lit(json.dumps(rules())), RULE_TYPE)
    hits = F.when(
        F.length("_norm") > 0,
        F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("_norm"), r["kw"])), lambda r: _detections(F.col("_norm"), r))),
    )
    kind = "array<struct<from:int,to:int,priority:int,no:int,label:string,confidence:double>>"
    step = step.select("_id", "n_words", "_base", F.coalesce(hits, F.array().cast(kind)).alias("_all"))
    step = step.withColumn("detections", F.when(F.size("_all") > 1, _kept(F.col("_all"))).otherwise(F.col("_all")))
    base_labels = F.array_distinct(F.col("_base.label"))
    at = F.col("_base.at")
    found = F.array_max(F.col("detections.confidence"))
    score = F.greatest(F.coalesce(found, F.lit(0.0)), F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return step.select(
        F.col("_id").alias(id_col), "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.col("detections.label")))), ",").alias("labels"),
        score.alias("score"), "detections",
    )
