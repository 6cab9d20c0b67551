"""License scans: some 460 ordered signature rules over a text's words.

A text is lower-cased (A-Z) and reduced to its words, one space apart. A rule is a
regular expression over that line, with a keyword that has to occur in the line
before the expression is tried; a first gate of a few keywords leaves most texts
out. Detections are intervals of words. One that lies inside a detection of equal
or higher priority is suppressed; of equal intervals the first rule's stays. Rules
marked `base` report every place, suppressed or not.

All of it is DataFrame functions: matches are marked in the line by a replacement,
and the marks' positions in the split line are the intervals.

Defined results: null and empty texts have no words and no detections. Texts are
scanned whole, row by row: repeated rows, null keys and extra columns pass through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_words, fresh, word_line


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    base: bool = False


#: The phrases that always count.
BASE = (
    Rule("gpl", "gnu general public license", "gnu general public license", 2, True),
    Rule("apache", "apache license", "apache license", 2, True),
    Rule("cc-by", "cc by", "cc by", 2, True),
    Rule("mit", "mit license", "mit license", 2, True),
)

_THE = "(?:the )?(?:terms of )?(?:the )?"
_LIC = "licen[cs]e"
_V = "(?:v|version )? ?"

#: Label, keyword, name as words, words of its SPDX identifier, words of its URL.
NAMES = (
    ("gpl-1.0", "general public", f"(?:gnu )?general public {_LIC} ?{_V}1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", "general public", f"(?:gnu )?general public {_LIC} ?{_V}2(?: 0)?", "gpl 2 0(?: only)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-2.0-or-later", "general public", f"(?:gnu )?general public {_LIC}(?: as published by the free software foundation)? (?:either )?version 2(?: of the {_LIC})? or (?:at your option )?any later version", "gpl 2 0 or later", "gnu org licenses gpl 2 0 plus"),
    ("gpl-3.0", "general public", f"(?:gnu )?general public {_LIC} ?{_V}3(?: 0)?", "gpl 3 0(?: only)?", "gnu org licenses gpl 3 0"),
    ("gpl-3.0-or-later", "general public", f"(?:gnu )?general public {_LIC}(?: as published by the free software foundation)? (?:either )?version 3(?: of the {_LIC})? or (?:at your option )?any later version", "gpl 3 0 or later", "gnu org licenses gpl 3 0 plus"),
    ("lgpl-2.0", "general public", f"(?:gnu )?(?:library|lesser) general public {_LIC} ?{_V}2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", "general public", f"(?:gnu )?lesser general public {_LIC} ?{_V}2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "general public", f"(?:gnu )?lesser general public {_LIC} ?{_V}3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public {_LIC} ?{_V}3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl-1.0", "affero", f"affero general public {_LIC} ?{_V}1(?: 0)?", "agpl 1 0(?: only| or later)?", "affero org oagpl"),
    ("gfdl-1.1", "documentation", f"(?:gnu )?free documentation {_LIC} ?{_V}1 1", "gfdl 1 1(?: only| or later)?", "gnu org licenses (?:old licenses )?fdl 1 1"),
    ("gfdl-1.2", "documentation", f"(?:gnu )?free documentation {_LIC} ?{_V}1 2", "gfdl 1 2(?: only| or later)?", "gnu org licenses (?:old licenses )?fdl 1 2"),
    ("gfdl-1.3", "documentation", f"(?:gnu )?free documentation {_LIC} ?{_V}1 3", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl 1 3"),
    ("apache-1.0", "apache", f"apache (?:software )?{_LIC} ?{_V}1 0", "apache 1 0", "apache org licenses license 1 0"),
    ("apache-1.1", "apache", f"apache (?:software )?{_LIC} ?{_V}1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache", f"apache (?:software )?{_LIC} ?{_V}2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("mit", "mit", f"mit {_LIC}", "mit", "opensource org licenses? mit(?: license)?"),
    ("mit-0", "mit", f"mit no attribution(?: {_LIC})?", "mit 0", "opensource org licenses? mit 0"),
    ("x11", "x11", f"x11 {_LIC}", "x11", "xfree86 org 3 3 6 copyright2"),
    ("isc", "isc", f"isc {_LIC}", "isc", "opensource org licenses? isc"),
    ("bsd-1-clause", "bsd", f"(?:1|one) clause bsd {_LIC}", "bsd 1 clause", "opensource org licenses? bsd 1 clause"),
    ("bsd-2-clause", "bsd", f"(?:(?:2|two) clause |simplified |freebsd )bsd {_LIC}", "bsd 2 clause", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "bsd", f"(?:(?:3|three) clause |new |modified |revised )bsd {_LIC}", "bsd 3 clause", "opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", "bsd", f"(?:(?:4|four) clause |original )bsd {_LIC}", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "bsd", f"(?:zero clause bsd|0bsd)(?: {_LIC})?", "0bsd", "opensource org licenses? 0bsd"),
    ("mpl-1.0", "mozilla", f"mozilla public {_LIC} ?{_V}1 0", "mpl 1 0", "mozilla org mpl mpl 1 0"),
    ("mpl-1.1", "mozilla", f"mozilla public {_LIC} ?{_V}1 1", "mpl 1 1", "mozilla org mpl mpl 1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public {_LIC} ?{_V}2(?: 0)?", "mpl 2 0", "mozilla org (?:mpl|en us mpl) 2 0"),
    ("epl-1.0", "eclipse", f"eclipse public {_LIC} ?{_V}1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", f"eclipse public {_LIC} ?{_V}2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "distribution", f"common development and distribution {_LIC} ?{_V}1(?: 0)?", "cddl 1 0", "opensource org licenses? cddl 1 0"),
    ("cddl-1.1", "distribution", f"common development and distribution {_LIC} ?{_V}1 1", "cddl 1 1", "spdx org licenses cddl 1 1"),
    ("cpl-1.0", "common public", f"common public {_LIC} ?{_V}1(?: 0)?", "cpl 1 0", "opensource org licenses? cpl 1 0"),
    ("eupl-1.1", "european", f"european union public {_LIC} ?{_V}1 1", "eupl 1 1", "joinup ec europa eu eupl 1 1"),
    ("eupl-1.2", "european", f"european union public {_LIC} ?{_V}1 2", "eupl 1 2", "joinup ec europa eu eupl 1 2"),
    ("artistic-1.0", "artistic", f"artistic {_LIC} ?{_V}1(?: 0)?", "artistic 1 0(?: perl)?", "opensource org licenses? artistic 1 0"),
    ("artistic-2.0", "artistic", f"artistic {_LIC} ?{_V}2(?: 0)?", "artistic 2 0", "opensource org licenses? artistic 2 0"),
    ("zlib", "zlib", f"zlib {_LIC}", "zlib", "opensource org licenses? zlib"),
    ("libpng", "libpng", f"libpng {_LIC}", "libpng(?: 2 0)?", "libpng org pub png src libpng license"),
    ("bsl-1.0", "boost", f"boost software {_LIC} ?{_V}1(?: 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", "business source", f"business source {_LIC} ?{_V}1 1", "busl 1 1", "mariadb com bsl11"),
    ("wtfpl", "public", f"do what the fuck you want to public {_LIC}", "wtfpl", "wtfpl net"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "cc pddc", "creativecommons org licenses publicdomain"),
    ("python-2.0", "python", f"python (?:software foundation )?{_LIC} ?{_V}2(?: 0)?", "python 2 0(?: 1)?", "docs python org license"),
    ("php-3.01", "php", f"php {_LIC} ?{_V}3 01", "php 3 01", "php net license 3 01"),
    ("ruby", "ruby", f"ruby {_LIC}", "ruby", "ruby lang org en about license"),
    ("postgresql", "postgresql", f"postgresql {_LIC}", "postgresql", "opensource org licenses? postgresql"),
    ("openssl", "openssl", f"openssl {_LIC}", "openssl", "openssl org source license"),
    ("curl", "curl", f"curl {_LIC}", "curl", "curl se docs copyright"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa (?:open source )?{_LIC}", "ncsa", "opensource org licenses? ncsa"),
    ("afl-3.0", "academic", f"academic free {_LIC} ?{_V}3(?: 0)?", "afl 3 0", "opensource org licenses? afl 3 0"),
    ("osl-3.0", "open software", f"open software {_LIC} ?{_V}3(?: 0)?", "osl 3 0", "opensource org licenses? osl 3 0"),
    ("ofl-1.1", "open font", f"(?:sil )?open font {_LIC} ?{_V}1 1", "ofl 1 1", "scripts sil org ofl"),
    ("odbl-1.0", "database", f"open (?:data commons open )?database {_LIC}(?: {_V}1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "data commons", f"open data commons attribution {_LIC}(?: {_V}1 0)?", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", "data commons", f"open data commons public domain dedication(?: and {_LIC})?", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("cc0-1.0", "cc0", f"cc0(?: {_V}1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("sspl-1.0", "server side", f"server side public {_LIC}(?: {_V}1)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", f"elastic {_LIC} ?{_V}2(?: 0)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("ms-pl", "microsoft", f"microsoft public {_LIC}", "ms pl", "opensource org licenses? ms pl"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_LIC}", "ms rl", "opensource org licenses? ms rl"),
    ("unicode", "unicode", f"unicode {_LIC}", "unicode dfs 201[56]", "unicode org copyright"),
    ("openrail-m", "rail", f"(?:creativeml |bigscience )?open ?rail m(?: {_LIC})?", "openrail m", "huggingface co spaces bigscience license"),
)

#: Creative Commons: parts, versions. Their rules come from the parts.
CC_PARTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:s|atives|ative works)"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


_GNU = "as published by the free software foundation"
_LATER = "or at your option any later version"
_FREE = "(?:this|the|[^ ]+) (?:[^ ]+ )?is free software you can redistribute it and or modify it under the terms of (?:the |version [0-9](?: [0-9])? of the )"
_GRANT = "permission is hereby granted free of charge to any person"

#: Label, keyword, words of the licence's own text or notice. These are worth most.
TEXTS = (
    ("mit", "free of charge", f"{_GRANT} obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", "free of charge", f"{_GRANT} obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("ncsa", "free of charge", f"{_GRANT} obtaining a copy of this software and associated documentation files(?: the software)? to deal with the software without restriction"),
    ("bsl-1.0", "free of charge", f"{_GRANT} or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", "boost", "boost software license version 1 0 august 17th 2003"),
    ("ofl-1.1", "free of charge", f"{_GRANT} obtaining a copy of the font software"),
    ("ofl-1.1", "open font", "this font software is licensed under the sil open font license(?: version 1 1)?"),
    ("unicode", "free of charge", f"{_GRANT} obtaining a copy of (?:the unicode )?data files and any associated documentation"),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("postgresql", "written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "without fee", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)?(?: is hereby granted)? without fee(?: is hereby granted)?(?! and without)"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "express or implied", "this software is provided by the (?:copyright holders|authors?|regents)(?: and contributors)? as is and any express or implied warranties"),
    ("bsd-3-clause", "endorse or promote", "neither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its|their|the|any)(?: other)? contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "january 2004", "apache license version 2 0 january 2004"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl-1.0-or-later", "free software", f"{_FREE}gnu general public license {_GNU} either version 1(?: of the license)? {_LATER}"),
    ("gpl-2.0-or-later", "free software", f"{_FREE}gnu general public license {_GNU} either version 2(?: of the license)? {_LATER}"),
    ("gpl-3.0-or-later", "free software", f"{_FREE}gnu general public license {_GNU} either version 3(?: of the license)? {_LATER}"),
    ("gpl-2.0-only", "free software", f"{_FREE}gnu general public license version 2(?: only)? {_GNU}"),
    ("gpl-3.0-only", "free software", f"{_FREE}gnu general public license version 3(?: only)? {_GNU}"),
    ("lgpl-2.0-or-later", "free software", f"{_FREE}gnu library general public license {_GNU} either version 2(?: of the license)? {_LATER}"),
    ("lgpl-2.1-or-later", "free software", f"{_FREE}gnu lesser general public license {_GNU} either version 2 1(?: of the license)? {_LATER}"),
    ("lgpl-3.0-or-later", "free software", f"{_FREE}gnu lesser general public license {_GNU} either version 3(?: of the license)? {_LATER}"),
    ("agpl-3.0-or-later", "free software", f"{_FREE}gnu affero general public license {_GNU} either version 3(?: of the license)? {_LATER}"),
    ("gpl-1.0", "february 1989", "gnu general public license version 1 february 1989"),
    ("gpl-2.0", "june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "june 2007", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.0", "june 1991", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "june 2007", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", "november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("gfdl-1.2", "november 2002", "gnu free documentation license version 1 2 november 2002"),
    ("gfdl-1.3", "november 2008", "gnu free documentation license version 1 3 3 november 2008"),
    ("gfdl", "this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-2.0", "take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "in the hope", "this (?:program|library|software|file) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "license document", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("wtfpl", "license document", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0"),
    ("epl", "eclipse", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cddl", "distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "eupl", "this european union public licence the eupl applies to the work"),
    ("artistic-1.0", "intent of this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "free software package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("zlib", "authors be held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights to"),
    ("cc0-1.0", "this deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain", "public domain", "this (?:work|software|file|code|book|article|program) is (?:in|hereby (?:placed|released) (?:in|into)) the public domain"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("php-3.01", "php", "this product includes php software freely available from"),
    ("python-2.0", "python", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("json", "not evil", "the software shall be used for good not evil"),
    ("beerware", "with this stuff", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("zpl-2.1", "zope", "zope public license zpl version 2 1"),
    ("ms-pl", "accompanying software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("elastic-2.0", "managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "non production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "as a service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("odbl-1.0", "database", "(?:this|the) (?:[^ ]+ ){1,12}?is made available under the open database license"),
    ("llama", "llama", "llama (?:[0-9] (?:[0-9] )?)?community license agreement"),
    ("gemma", "gemma", "gemma is provided under and subject to the gemma terms of use"),
    ("proprietary", "proprietary", "(?:this|the) (?:software|file|document|program|code) (?:is|contains) (?:the )?confidential and proprietary (?:information|property)"),
    ("proprietary", "strictly prohibited", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material|work)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "may be reproduced", "no part of this (?:publication|book|work|document|article|website) may be reproduced"),
    ("proprietary", "prior written", "may not be (?:copied|reproduced|republished|redistributed|published broadcast rewritten or redistributed)(?: in any form)? without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("eula", "end user", "end user licen[cs]e agreement"),
    ("cc", "creative commons", "this (?:work|article|book|document|page|content|dataset) is licen[cs]ed under (?:a|the) creative commons"),
)

#: Label, keyword, what people write for short.
SHORT = (
    ("gpl", "gnu gpl", "gnu gpl"),
    ("lgpl", "gnu lgpl", "gnu lgpl"),
    ("agpl", "gnu agpl", "gnu agpl"),
    ("gpl-1.0", "gpl", "(?:gnu )?gpl ?(?:v|version )?1(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:v|version )?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:v|version )?3(?: 0)?"),
    ("gpl-2.0-or-later", "gpl", "(?:gnu )?gpl ?(?:v|version )?2(?: 0)? or (?:later|newer|any later version)"),
    ("gpl-3.0-or-later", "gpl", "(?:gnu )?gpl ?(?:v|version )?3(?: 0)? or (?:later|newer|any later version)"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:v|version )?2(?: 1)?"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl ?(?:v|version )?3(?: 0)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl ?(?:v|version )?3(?: 0)?"),
    ("apache-2.0", "apache", "apache ?2(?: 0)?"),
    ("apache-2.0", "asl", "asl ?2(?: 0)? licen[cs]ed?"),
    ("mpl-2.0", "mpl", "mpl ?(?:v|version )?2(?: 0)? licen[cs]ed?"),
    ("mit", "mit", "mit licen[cs]ed"),
    ("bsd", "bsd", "bsd (?:style )?licen[cs]ed?"),
    ("bsd-2-clause", "bsd", "bsd 2(?: clause)?(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "bsd 3(?: clause)?(?: licen[cs]e)?"),
    ("cc0-1.0", "cc0", "cc0 licen[cs]ed?"),
    ("public-domain", "public domain", "public domain(?: dedication)?"),
    ("epl", "epl", "epl licen[cs]ed"),
)


def _rules() -> tuple[Rule, ...]:
    out = list(BASE)
    for label, keyword, text in TEXTS:
        out.append(Rule(label, keyword, text, 4))
    for label, keyword, name, spdx, url in NAMES:
        out.append(Rule(label, keyword, name, 2))
        out.append(Rule(label, keyword, f"(?:licen[cs]ed|released|distributed|available|published|redistributed?) (?:only )?under {_THE}{name}", 3))
        out.append(Rule(label, "spdx", f"spdx license identifier {spdx}", 4))
        out.append(Rule(label, url.split(" ")[0], f"(?:https? )?(?:www )?{url}", 3))
    for label, keyword, short in SHORT:
        out.append(Rule(label, keyword, short, 2))
    for parts in CC_PARTS:
        words = " ".join(CC_WORDS[p] for p in parts.split(" "))
        short = f"cc-{parts.replace(' ', '-')}"
        out.append(Rule(short, f"cc {parts}", f"cc {parts}", 2))
        out.append(Rule(short, "creative commons", f"creative commons {words}(?: {_LIC})?", 2))
        for version in CC_VERSIONS:
            label = f"{short}-{version.replace(' ', '.')}"
            out.append(Rule(label, f"cc {parts} {version}", f"(?:(?:licen[cs]ed|released|available) under {_THE})?cc {parts} {version}(?: {_LIC})?", 3))
            out.append(Rule(label, "creative commons", f"creative commons {words} {version}(?: (?:international|unported|generic))?(?: {_LIC})?", 3))
            out.append(Rule(label, "creativecommons", f"(?:https? )?creativecommons org licenses {parts} {version}", 3))
    out.append(Rule("proprietary", "all rights reserved", "(?:copyright (?:c )?)?(?:[0-9]{4} )?all rights reserved", 1))
    out.append(Rule("license-mention", "licen", f"(?:licen[cs]ed|released|distributed) under {_THE}[^ ]+ {_LIC}", 1))
    out.append(Rule("no-ai-training", "training", "(?:may not|must not|shall not|do not) (?:be used|use) (?:for|in) (?:the )?training(?: of)?", 2))
    return tuple(out)


RULES = _rules()
#: Every rule needs one of these in the line with a space at either end.
GATE = ("licen", "software", "gpl", "permi", "document", "prohibited", "proprietary", "terms of use", "this stuff", "waived", "this deed", " apache", "hope that", "no part of", "prior written", "third parties", " cc ", "spdx", "creative", "cc0", "public domain", "reserved", "training", "rail", "unlicense", "mit no attribution", "bsd", " org ", " net ", " com ", " co ", " se ", " eu ")
#: What a detection of each priority is worth.
WORTH = (0.2, 0.5, 0.9, 1.0)


def _literal(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(
        F.struct(
            F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"),
            F.lit(f"(?<![^ ])(?:{r.pattern})(?![^ ])").alias("pattern"),
            F.lit(r.priority).alias("priority"), F.lit(r.base).alias("base"), F.lit(i).alias("rank"),
        ) for i, r in enumerate(rules)
    ))


def _found(line: Column, rule: Column) -> Column:
    """Intervals of a rule's matches, as structs that sort outermost and most important first."""
    marked = F.split(F.regexp_replace(line, rule["pattern"], F.lit("\x01$0\x02")), " ")

    def places(words: Column) -> Column:
        starts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit("\x02")), i)), lambda i: i.isNotNull())
        return F.zip_with(starts, ends, lambda a, b: F.struct(
            a.alias("start"), (-b).alias("before"), (-rule["priority"]).alias("less"), rule["rank"].alias("rank"),
            rule["label"].alias("label"), rule["base"].alias("base"),
        ))

    return F.flatten(F.transform(F.array(marked), places))


def _suppressed(spans: Column) -> Column:
    """One pass over sorted detections; `reach` has the furthest end so far of each priority or higher."""
    levels = len(WORTH)
    empty = F.array().cast("array<struct<label:string,start:int,end:int,priority:int,base:boolean,kept:boolean>>")
    zero = F.struct(F.array(*[F.lit(0)] * levels).alias("reach"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end, priority = 1 - s["before"], -s["less"]
        kept = F.get(acc["reach"], priority - 1) < end
        reach = F.transform(acc["reach"], lambda r, i: F.when(i < priority, F.greatest(r, end)).otherwise(r))
        one = F.struct(s["label"].alias("label"), s["start"].alias("start"), end.alias("end"), priority.alias("priority"), s["base"].alias("base"), kept.alias("kept"))
        return F.struct(reach.alias("reach"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame, name: str = "licenses", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the words' number (`<name>_words`) and the detections of each whole text.

    A detection has label, start and end (words from 0, end exclusive), priority, and
    whether it is of a base rule and whether it is kept.
    """
    line, gate = fresh(docs, "_line"), F.lit(False)
    first = GATE if rules is RULES else tuple(dict.fromkeys(r.keyword for r in rules))
    words = fresh(docs, f"{name}_words")
    out = docs.withColumn(line, word_line(F.col("text")))
    padded = F.concat(F.lit(" "), F.col(line), F.lit(" "))
    for word in first:
        gate = gate | F.contains(padded, F.lit(word))
    tried = F.filter(_literal(rules), lambda r: F.contains(F.col(line), r["keyword"]))
    spans = F.array_sort(F.flatten(F.transform(tried, lambda r: _found(F.col(line), r))))
    return (
        out.withColumn(words, count_words(F.col(line)))
        .withColumn(fresh(docs, name), F.when(gate, _suppressed(spans)).otherwise(F.array()))
        .drop(line)
    )


def label_list(spans: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def score(spans: Column) -> Column:
    """How sure the best kept detection makes a licence, 0 to 1."""
    best = F.array_max(F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: s["priority"]))
    worth = F.array(*map(F.lit, WORTH))
    return F.coalesce(F.get(worth, best - 1), F.lit(0.0))
