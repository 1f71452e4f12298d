"""License scan by ordered signature rules, in the JVM alone.

A text is reduced to its words (runs of ASCII digits, letters in lower case and
characters above ASCII). Rules are regular expressions over whole words, each
gated by a keyword and by its triggers, words of which every match holds one: a
text's words are looked up among all triggers at once, and a rule is tried where
a trigger of it and its keyword stand. Where detections overlap, one that lies
within another of the same or higher priority is suppressed; partly overlapping
ones both stay.

Defined cases: a null or empty text has no word and no label, score 0; equal
detections count once, by rule order; repeated rows and null ids are scanned one
by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm._native import lower_ascii, places

BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """A pattern over words parted by single spaces; priority 3 is a text passage, 2 a name with version, 1 a mention."""

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


#: Hand-written passages and notices: label, keyword, pattern.
PASSAGES = [
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "granted", "permission is hereby granted free of charge(?: to)? any person"),
    ("isc", "granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribut", "redistribution and use in source and binary forms(?: with or without modification)? are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of(?: [^ ]+){1,8} nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "apache", "licensed under the apache license version 2(?: 0)?"),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", "released under the apache license version 2(?: 0)?"),
    ("apache-1.1", "apache", "apache software license version 1 1"),
    ("gpl-2.0", "gnu", "under the terms of the gnu general public license as published by the free software foundation version 2"),
    ("gpl-3.0", "gnu", "under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("gpl-2.0", "gnu", "licensed under the gnu general public license version 2(?: 0)?"),
    ("gpl-3.0", "gnu", "licensed under the gnu general public license version 3(?: 0)?"),
    ("lgpl-2.1", "gnu", "under the terms of the gnu lesser general public license(?: [^ ]+){0,8} version 2 1"),
    ("lgpl-3.0", "gnu", "under the terms of the gnu lesser general public license(?: [^ ]+){0,8} version 3"),
    ("agpl-3.0", "gnu", "under the terms of the gnu affero general public license(?: [^ ]+){0,8} version 3"),
    ("gfdl", "gnu", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?2 0"),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("boost-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("wtfpl", "public", "do what the fuck you want to public license"),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "this (?:work|file|document|text) is in the public domain"),
    ("cc0-1.0", "waived", "to the extent possible under law(?: [^ ]+){1,10} waived all copyright"),
    ("proprietary", "rights", "all rights reserved"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized copying of this (?:file|document|work)(?: via any medium)? is strictly prohibited"),
    ("no-redistribution", "redistribut", "(?:may|must|do) not (?:be )?redistributed?"),
    ("no-commercial", "commercial", "for non commercial (?:use|purposes) only"),
    ("no-derivatives", "derivative", "no derivative works(?: are)?(?: permitted| allowed)?"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("python-2.0", "python", "python software foundation license version 2"),
    ("ofl-1.1", "sil open", "licensed under the sil open font license version 1 1"),
    ("artistic-2.0", "artistic", "under the terms of the artistic license 2 0"),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version)? 1 2"),
    ("odbl-1.0", "database", "made available under the open database license"),
    ("ms-pl", "accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
]
#: Hand-written sentences of license texts and of notices in files: label, keyword, pattern.
SENTENCES = [
    ("mit", "substantial portions", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions"),
    ("mit", "mit license", "(?:licensed|released|distributed|available) under the(?: terms of the)? mit license"), ("mit", "mit license", "subject to the mit license"), ("mit", "mit license", "the mit license mit"),
    ("mit-0", "attribution", "mit no attribution"), ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("warranty-disclaimer", "merchantability", "without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software"), ("isc", "isc", "(?:licensed|released|distributed) under the isc license"),
    ("hpnd", "supporting documentation", "appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("hpnd", "suitability", "makes no representations about the suitability of this software for any purpose"),
    ("bsd", "retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice"), ("bsd", "copyright holders", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "regents", "this software is provided by the regents and contributors as is"), ("bsd", "bsd", "use of this source code is governed by a bsd style license"), ("bsd", "bsd", "(?:licensed|released|distributed) under the(?: terms of the)? bsd license"),
    ("bsd-3-clause", "bsd", "(?:licensed|released|distributed) under the(?: terms of the)? (?:3 clause bsd|bsd 3 clause|new bsd|revised bsd) license"), ("bsd-2-clause", "bsd", "(?:licensed|released|distributed) under the(?: terms of the)? (?:2 clause bsd|bsd 2 clause|simplified bsd) license"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"), ("bsd-4-clause", "acknowledgement", "must display the following acknowledgement"),
    ("bsd-2-clause-patent", "bsd", "bsd 2 clause plus patent license"), ("bsd-source-code", "bsd", "bsd source code attribution"), ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("apache-2.0", "contributor license", "licensed to the apache software foundation asf under one or more contributor license agreements"), ("apache-2.0", "apache", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "apache", "(?:licensed|available|distributed) under the terms of the apache license(?: version)? 2(?: 0)?"), ("apache-2.0", "apache", "subject to the terms and conditions of the apache license version 2 0"), ("apache-2.0", "asl", "asl 2 0"),
    ("apache-1.1", "apache", "the names apache and apache software foundation must not be used to endorse"), ("apache-1.0", "apache", "this software consists of voluntary contributions made by many individuals on behalf of the apache group"), ("apache", "apache", "apache style license"),
    ("gpl-2.0-or-later", "either version", "either version 2 of the license or at your option any later version"), ("gpl-3.0-or-later", "either version", "either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "either version", "either version 2 1 of the license or at your option any later version"), ("gpl-1.0-or-later", "either version", "either version 1 or at your option any later version"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"), ("gpl", "you should have received", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received", "you should have received a copy of the gnu lesser general public license"), ("lgpl", "you should have received", "you should have received a copy of the gnu library general public license"),
    ("agpl", "you should have received", "you should have received a copy of the gnu affero general public license"), ("lgpl", "library", "this library is free software you can redistribute it and or modify it"),
    ("gpl", "useful", "distributed in the hope that it will be useful but without any warranty"), ("gpl-2.0", "version 2", "gnu general public license version 2 june 1991"), ("gpl-3.0", "version 3", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", "february", "gnu lesser general public license version 2 1 february 1999"), ("agpl-3.0", "november", "gnu affero general public license version 3 19 november 2007"), ("gpl", "copyleft", "this is a copyleft license"),
    ("gpl-2.0-with-classpath", "classpath", "gnu general public license(?: version 2)? with(?: the)? classpath exception"), ("gpl-classpath", "independent modules", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-gcc-exception", "runtime library", "gcc runtime library exception"), ("gpl-bison-exception", "bison", "bison parser skeleton"), ("gpl-font-exception", "embed", "as a special exception if you create a document which uses this font and embed this font"),
    ("linux-syscall-note", "system calls", "this copyright does not cover user programs that use kernel services by normal system calls"), ("gpl", "gpl", "(?:licensed|released|distributed) under the(?: terms of the)? gnu gpl"), ("gpl", "gpl", "(?:licensed|released) under the gpl"),
    ("lgpl", "lgpl", "(?:licensed|released|distributed) under the(?: terms of the)? lgpl"), ("agpl", "agpl", "(?:licensed|released|distributed) under the(?: terms of the)? agpl"), ("gpl-dual", "dual", "dual licensed under the(?: [^ ]+){0,4} gpl"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"), ("gfdl-1.2", "documentation", "gnu free documentation license version 1 2"), ("gfdl-1.3", "documentation", "gnu free documentation license version 1 3"),
    ("mpl-2.0", "mozilla", "if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0"), ("mpl-2.0-no-copyleft", "incompatible", "this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "www mozilla", "you may obtain a copy of the license at http www mozilla org mpl"), ("mpl-tri", "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("npl-1.1", "netscape", "netscape public license version 1 1"), ("npl-1.0", "netscape", "netscape public license version 1 0"), ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl", "eclipse", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license"), ("edl-1.0", "eclipse", "eclipse distribution license v? ?1 0"),
    ("cddl-1.0", "cddl", "cddl header start"), ("cddl", "common development", "subject to the terms of the common development and distribution license"), ("cddl-gpl", "cddl", "dual license consisting of the cddl"),
    ("cpl-1.0", "common public", "this program and the accompanying materials are made available under the terms of the common public license"), ("ipl-1.0", "ibm", "ibm public license(?: version)? 1 0"), ("boost-1.0", "boost", "see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt"),
    ("boost-1.0", "machine executable", "unless such copies or derivative works are solely in the form of machine executable object code"), ("zlib", "altered", "altered source versions must be plainly marked as such"), ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("libpng", "png", "png reference library license(?: version 2)?"), ("unlicense", "unlicense", "for more information please refer to https? unlicense org"), ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do", "you just do what the fuck you want to"), ("public-domain", "dedicate", "i hereby dedicate this work to the public domain"), ("public-domain", "no copyright", "no copyright is claimed"), ("public-domain", "government", "this is a work of the u s government and is not subject to copyright protection"),
    ("public-domain", "disclaims copyright", "the author disclaims copyright to this source code"), ("cc0-1.0", "cc0", "cc0 1 0 universal"), ("cc0-1.0", "publicdomain", "creativecommons org publicdomain zero 1 0"), ("pddl-1.0", "public domain dedication", "open data commons public domain dedication"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0"), ("cc-by-3.0", "creativecommons", "creativecommons org licenses by 3 0"), ("cc-by-2.0", "creativecommons", "creativecommons org licenses by 2 0"), ("cc-by-sa-4.0", "creativecommons", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons", "creativecommons org licenses by sa 3 0"), ("cc-by-nc-4.0", "creativecommons", "creativecommons org licenses by nc 4 0"), ("cc-by-nc-sa-4.0", "creativecommons", "creativecommons org licenses by nc sa 4 0"), ("cc-by-nc-nd-4.0", "creativecommons", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nd-4.0", "creativecommons", "creativecommons org licenses by nd 4 0"), ("cc", "some rights", "some rights reserved"), ("cc", "commons", "this work is licensed under a creative commons"),
]
#: Hand-written terms of proprietary, restricted, data and model licenses.
TERMS = [
    ("proprietary", "confidential", "this (?:document|file|software) contains confidential(?: and proprietary)? information"), ("proprietary", "trade secret", "contains trade secrets"), ("proprietary", "reproduced", "no part of this (?:publication|document|book|work) may be reproduced"),
    ("proprietary", "reproduction", "reproduction in whole or in part is prohibited"), ("proprietary", "written permission", "without(?: the)?(?: prior)? written permission of the (?:publisher|author|owner|copyright holder)"), ("proprietary", "unpublished", "unpublished rights reserved under the copyright laws"),
    ("proprietary", "internal use", "for internal use only"), ("proprietary", "end user", "end user license agreement"), ("proprietary", "reverse engineer", "you may not reverse engineer decompile or disassemble"), ("proprietary", "sublicense", "you may not rent lease lend sell redistribute or sublicense"),
    ("proprietary", "restricted rights", "u s government restricted rights"), ("proprietary", "strictly prohibited", "unauthorized (?:use|copying|reproduction|distribution) is strictly prohibited"), ("proprietary", "by installing", "by installing or using the software you agree"), ("proprietary", "property of", "is the property of its respective owners?"),
    ("proprietary", "permission denied", "permission denied to copy"), ("no-redistribution", "redistribution", "redistribution is (?:not permitted|prohibited|forbidden)"), ("no-redistribution", "republish", "do not republish"), ("no-redistribution", "may not be", "may not be (?:published|broadcast|rewritten|redistributed)"),
    ("no-commercial", "commercial", "not for commercial use"), ("no-commercial", "commercial", "commercial use is (?:not permitted|prohibited|not allowed)"), ("no-commercial", "personal", "for personal(?: and)? non commercial use"), ("no-commercial", "academic", "for academic use only"), ("no-commercial", "research", "for research purposes only"),
    ("no-commercial", "evaluation", "for evaluation purposes only"), ("no-commercial", "educational", "for educational purposes only"), ("no-commercial", "noncommercial", "polyform noncommercial license"), ("polyform-small-business", "polyform", "polyform small business license"), ("commons-clause", "commons clause", "commons clause license condition"),
    ("no-derivatives", "modified", "may be copied and distributed(?: freely)? but not modified"), ("verbatim", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"), ("verbatim", "verbatim", "verbatim copying and distribution of this entire article"), ("no-ai-training", "training", "may not be used(?: for the purpose of| to)? training(?: [^ ]+){0,4} models?"),
    ("no-ai-training", "data mining", "text and data mining is not permitted"), ("freeware", "freeware", "this (?:program|software|font) is freeware"), ("freeware", "free of charge", "free of charge for personal use"), ("shareware", "shareware", "this (?:program|software) is shareware"), ("donationware", "donation", "this software is donationware"),
    ("elastic-2.0", "elastic", "elastic license(?: version)? 2 0"), ("elastic-1.0", "elastic license", "elastic license agreement"), ("confluent-1.0", "confluent", "confluent community license(?: agreement)?(?: version)? 1 0"), ("redis-sal", "redis", "redis source available license"), ("rsal-2.0", "redis", "redis source available license 2 0"),
    ("sspl-1.0", "server side", "server side public license version 1"), ("bsl-1.1", "change date", "business source license 1 1(?: [^ ]+){0,12} change date"), ("busl", "additional use grant", "additional use grant"), ("timescale", "timescale", "timescale license agreement"), ("fsl-1.1", "functional source", "functional source license version 1 1"),
    ("openrail", "creativeml", "creativeml open rail m"), ("openrail", "responsible ai", "responsible ai license"), ("bigscience-openrail", "bigscience", "bigscience(?: open)? rail(?: m)? license"), ("llama-2", "llama 2", "llama 2 community license(?: agreement)?"), ("llama-3", "llama 3", "llama 3 community license(?: agreement)?"), ("gemma", "gemma", "gemma terms of use"),
    ("odbl-1.0", "individual contents", "any rights in individual contents of the database are licensed under"), ("odbl-1.0", "openstreetmap", "openstreetmap contributors"), ("odc-by-1.0", "opendatacommons", "opendatacommons org licenses by"), ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl"), ("pddl-1.0", "opendatacommons", "opendatacommons org licenses pddl"),
    ("cdla-permissive-2.0", "community data", "community data license agreement permissive(?: version)? 2 0"), ("cdla-permissive-1.0", "community data", "community data license agreement permissive(?: version)? 1 0"), ("cdla-sharing-1.0", "community data", "community data license agreement sharing(?: version)? 1 0"), ("c-uda-1.0", "computational use", "computational use of data agreement"),
    ("ogl-3.0", "public sector", "contains public sector information licensed under the open government licen[cs]e v3 0"), ("ogl-2.0", "public sector", "contains public sector information licensed under the open government licen[cs]e v2 0"), ("etalab-2.0", "etalab", "licence ouverte(?: open licence)?(?: version)? 2 0 etalab"), ("dl-de-by-2.0", "datenlizenz", "datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("ofl-1.1", "sil open", "this font software is licensed under the sil open font license"), ("ofl-1.1", "reserved font name", "with reserved font name"), ("ubuntu-font-1.0", "ubuntu font", "ubuntu font licen[cs]e(?: version)? 1 0"), ("bitstream-vera", "bitstream", "bitstream vera is a trademark of bitstream"), ("lppl-1.3c", "latex", "latex project public license(?: either)? version 1 3c"),
    ("lppl", "latex", "this work may be distributed and or modified under the conditions of the latex project public license"), ("artistic-1.0-perl", "perl", "under the same terms as perl(?: itself)?"), ("artistic-1.0", "artistic", "the artistic license preamble"), ("python-2.0", "psf", "psf license agreement"), ("python-2.0", "python software", "this license agreement is between the python software foundation"),
    ("php-3.01", "php", "this product includes php software freely available from"), ("php-3.01", "php", "subject to version 3 01 of the php license"), ("ruby", "ruby", "under the(?: same)? terms (?:of|as) ruby(?: s license)?"), ("vim", "vim", "vim is charityware"), ("curl", "curl", "curl license"), ("openssl", "openssl toolkit", "the openssl toolkit stays under a dual license"),
    ("ssleay", "eric young", "this package is an ssl implementation written by eric young"), ("ntp", "ntp", "ntp license"), ("tcl", "tcl", "tcl tk license"), ("icu", "icu", "icu license icu 1 8 1 and later"), ("unicode-dfs-2016", "unicode", "unicode data files and software(?: [^ ]+){0,6} license"), ("w3c", "w3c", "w3c software notice and license"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"), ("freetype", "freetype", "portions of this software are copyright(?: [^ ]+){0,4} the freetype project"), ("imagemagick", "imagemagick", "imagemagick license"), ("ms-pl", "microsoft", "licensed under the microsoft public license"), ("ms-rl", "reciprocal", "microsoft reciprocal license ms rl"), ("ms-lpl", "limited", "microsoft limited public license"),
    ("nasa-1.3", "nasa", "nasa open source agreement(?: version)? 1 3"), ("ncsa", "illinois", "developed by(?: [^ ]+){0,6} university of illinois"), ("upl-1.0", "universal permissive", "universal permissive license(?: version| v)? 1 0"), ("eupl-1.1", "eupl", "licensed under the eupl(?: version)? 1 1"), ("cecill-2.1", "cecill", "ce logiciel est régi par la licence cecill"), ("cecill-b", "cecill", "licence cecill b"), ("cecill-c", "cecill", "licence cecill c"),
    ("osl-3.0", "open software", "licensed under the open software license version 3 0"), ("afl-3.0", "academic", "licensed under the academic free license version 3 0"), ("rpl-1.5", "reciprocal public", "reciprocal public license 1 5"), ("qpl-1.0", "public license", "the q public license version 1 0"), ("sleepycat", "sleepycat", "sleepycat license"), ("watcom-1.0", "watcom", "sybase open watcom public license version 1 0"),
    ("apsl-2.0", "apple", "apple public source license(?: version)? 2 0"), ("rpsl-1.0", "realnetworks", "realnetworks public source license"), ("sissl", "sun industry", "sun industry standards source license"), ("json", "evil", "the software shall be used for good not evil"), ("beerware", "beer", "you can buy me a beer in return"), ("postcardware", "postcard", "send me a postcard"),
    ("bzip2", "bzip2", "this program bzip2 the associated library libbzip2"), ("mulan-2.0", "mulan", "mulan(?: psl| permissive software license) v2"), ("blueoak-1.0", "blue oak", "blue oak model license"), ("eth-hippocratic", "hippocratic", "hippocratic license"), ("anti-996", "996", "anti 996 license"), ("parity-7.0", "parity", "parity public license 7 0"),
]
#: Families: label stem, keyword, names, versions ("" for none).
FAMILIES = [
    ("gpl", "gpl", "gpl|gnu gpl", "1 2 3"), ("gpl", "general public", "(?:gnu )?general public license", "1 2 3"),
    ("lgpl", "lgpl", "lgpl|gnu lgpl", "2 2.1 3"), ("lgpl", "lesser", "(?:gnu )?lesser general public license", "2.1 3"),
    ("lgpl", "library", "(?:gnu )?library general public license", "2"), ("agpl", "agpl", "agpl|gnu agpl", "1 3"),
    ("agpl", "affero", "(?:gnu )?affero general public license", "1 3"), ("gfdl", "documentation", "(?:gnu )?free documentation license", "1.1 1.2 1.3"),
    ("apache", "apache", "apache(?: software)? license", "1 1.1 2"), ("mpl", "mozilla", "mozilla public license", "1 1.1 2"), ("mpl", "mpl", "mpl", "1 1.1 2"),
    ("epl", "eclipse", "eclipse public license", "1 2"), ("cddl", "common development", "common development and distribution license", "1 1.1"),
    ("cpl", "common public", "common public license", "1"), ("boost", "boost", "boost software license", "1"), ("artistic", "artistic", "artistic license", "1 2"),
    ("eupl", "union public", "european union public license", "1 1.1 1.2"), ("osl", "open software", "open software license", "1 2 2.1 3"), ("afl", "academic", "academic free license", "1.2 2 2.1 3"),
    ("zpl", "zope", "zope public license", "1.1 2 2.1"), ("php", "php", "php license", "3 3.01"), ("lppl", "latex", "latex project public license", "1 1.3"),
    ("odbl", "database", "open database license", "1"), ("odc-by", "attribution", "open data commons attribution license", "1"), ("ofl", "font", "(?:sil )?open font license", "1 1.1"),
    ("ecl", "educational", "educational community license", "1 2"), ("cecill", "cecill", "cecill(?: free software)?(?: license)?", "1 2 2.1"), ("bsl", "business", "business source license", "1.1"),
    ("sspl", "server side", "server side public license", "1"), ("ogl", "open government", "open government licen[cs]e", "1 2 3"), ("python", "python", "python software foundation license", "2"),
]
#: Licenses named without a version: label, keyword, names.
NAMES = [
    ("mit", "mit license", "mit license"), ("mit", "mit license", "mit licensed"), ("mit", "expat", "expat license"), ("bsd", "bsd", "bsd license"), ("bsd", "bsd", "bsd licensed"), ("bsd", "berkeley", "berkeley software distribution license"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?"), ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?"),
    ("bsd-0-clause", "bsd", "(?:bsd 0 clause|0 clause bsd|zero clause bsd)(?: license)?"), ("isc", "isc license", "isc license"), ("zlib", "zlib", "zlib license"), ("unlicense", "unlicense", "the unlicense"), ("wtfpl", "wtfpl", "wtfpl"),
    ("public-domain", "domain", "public domain"), ("cc0-1.0", "cc0", "cc0(?: 1 0)?"), ("ncsa", "illinois", "university of illinois(?: ncsa)? open source license"), ("json", "json", "json license"), ("beerware", "beer", "beer ware license"),
    ("vim", "vim", "vim license"), ("ruby", "ruby", "ruby license"), ("curl", "curl", "curl license"), ("x11", "x11", "x11 license"), ("postgresql", "postgresql", "postgresql license"), ("openssl", "openssl", "openssl license"), ("icu", "icu license", "icu license"),
    ("unicode", "unicode", "unicode(?: inc)? license(?: agreement)?"), ("w3c", "w3c", "w3c (?:software|document)(?: notice and)? license"), ("ms-pl", "microsoft", "microsoft public license"), ("ms-rl", "microsoft", "microsoft reciprocal license"), ("copyleft", "copyleft", "copyleft"),
]
SPDX = "mit isc zlib unlicense wtfpl 0bsd bsd-2-clause bsd-3-clause bsd-4-clause apache-1.1 apache-2.0 gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 agpl-3.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cpl-1.0 bsl-1.0 artistic-2.0 eupl-1.2 osl-3.0 afl-3.0 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-nc-nd-4.0 odbl-1.0 ofl-1.1 python-2.0 postgresql ncsa sspl-1.0"


def rules() -> list[Rule]:
    """All rules in order: passages, then versions of each family, Creative Commons, SPDX tags, and bare names."""
    out = [Rule(a, k, p, 3, 0.95) for a, k, p in PASSAGES + SENTENCES + TERMS]
    for stem, keyword, names, versions in FAMILIES:
        for v in versions.split():
            dotted, spaced = (v if "." in v else v + ".0"), v.replace(".", " ")
            zero = "" if "." in v else "(?: 0)?"
            out.append(Rule(f"{stem}-{dotted}", keyword, f"(?:{names})(?: version| v)? v?{spaced}{zero}(?: only| or later)?", 2, 0.85))
        out.append(Rule(stem, keyword, f"(?:{names})", 1, 0.6))
    out += [Rule(f"gpl-{v}.0", "gplv", f"a?gplv{v}", 2, 0.8) for v in "123"] + [Rule(f"lgpl-{v}.0", "lgplv", f"lgplv{v}", 2, 0.8) for v in "23"]
    words = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
    for short, long in words.items():
        spaced = short.replace("-", " ")
        out += [Rule(f"cc-{short}-{v}", "cc by", f"cc {spaced} {v.replace('.', ' ')}(?: international| unported)?", 2, 0.85) for v in ("2.0", "2.5", "3.0", "4.0")]
        out += [Rule(f"cc-{short}-{v}", "creative", f"creative commons {long} {v.replace('.', ' ')}(?: international| unported)?(?: license)?", 2, 0.85) for v in ("3.0", "4.0")]
        out += [Rule(f"cc-{short}", "cc by", f"cc {spaced}", 1, 0.6), Rule(f"cc-{short}", "creative", f"creative commons {long}", 1, 0.6)]
    out.append(Rule("cc", "creative", "creative commons(?: license)?", 1, 0.5))
    out += [Rule(name, "spdx", "spdx license identifier " + re.sub(r"[-.]", " ", name) + "(?: only| or later)?", 3, 0.99) for name in SPDX.split()]
    return out + [Rule(a, k, f"(?:{n})", 1, 0.6) for a, k, n in NAMES]


def wrapped(pattern: str) -> str:
    """A pattern for text in which every word has a space on either side."""
    return " " + pattern.replace(" ", "  ").replace("  ?", "(?:  )?") + " "


#: Words that many texts hold; they trigger a rule only if it has no other word.
COMMON = frozenset("a and any as at be by file for free in is it license licensed may must not of open or public released software source the this to under use version with work you 0 1 2 3 4".split())


def expansions(pattern: str) -> list[str]:
    """Every text that a rule's pattern stands for, with an asterisk for the runs of free words."""

    def sequence(at: int) -> tuple[list[str], int]:
        every: list[str] = []
        out = [""]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                every, out, at = every + out, [""], at + 1
                continue
            if pattern.startswith("(?:", at):
                part, at = sequence(at + 3)
                at += 1
            elif pattern.startswith("[^ ]+", at):
                part, at = ["*"], at + 5
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                part, at = list(pattern[at + 1 : end]), end + 1
            else:
                part, at = [pattern[at]], at + 1
            if at < len(pattern) and pattern[at] == "{":
                part, at = ["", *part] if pattern[at + 1] == "0" else part, pattern.index("}", at) + 1
            elif at < len(pattern) and pattern[at] == "?":
                part, at = ["", *part], at + 1
            out = [x + y for x in out for y in part]
        return every + out, at

    return sequence(0)[0]


def triggers(pattern: str) -> frozenset[str]:
    """Words of which every match of the pattern holds one; one word where that can be."""
    each = [{w for w in x.split() if "*" not in w} for x in expansions(pattern)]
    rank = lambda w: (w not in COMMON, len(w), w)
    always = frozenset.intersection(*map(frozenset, each))
    best = max(always, key=rank, default=None)
    chosen = frozenset(max(words, key=rank) for words in each) if all(each) else frozenset()
    return frozenset([best]) if best and (best not in COMMON or chosen & COMMON) else chosen


def _words(x: Column) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("int")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", own: list[Rule] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    table = rules() if own is None else own
    by_trigger: dict[str, list[Column]] = {}
    for k, r in enumerate(table):
        rule = F.struct(F.lit(k).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.keyword.replace(" ", "  ")).alias("keyword"), F.lit(wrapped(r.pattern)).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"))
        words = triggers(r.pattern)
        if not words:
            raise ValueError(f"no word stands in every match of {r.pattern}")
        for word in words:
            by_trigger.setdefault(word, []).append(rule)
    known = F.array(*[F.lit(w) for w in by_trigger])
    rules_of = F.create_map(*[x for w, v in by_trigger.items() for x in (F.lit(w), F.array(*v))])
    lower = docs.select(F.col(id_col).cast("long").alias("doc_id"), lower_ascii(F.col(text_col)).alias("lower"))
    cut = lower.select("doc_id", F.regexp_extract_all("lower", F.lit(WORDS), F.lit(0)).alias("parts"))
    counted = cut.select("doc_id", F.size("parts").cast("long").alias("n_words"), F.array_intersect(known, "parts").alias("seen"), F.concat(F.lit(" "), F.array_join("parts", "  "), F.lit(" ")).alias("words"))

    def detect(r: Column) -> Column:
        found = places(F.col("words"), r["pattern"], measure=_words)
        return F.transform(found, lambda m: F.struct(m["at"].alias("at"), (-m["to"]).alias("back"), (-r["priority"]).alias("rank"), r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight")))

    tried = F.filter(F.flatten(F.transform("seen", lambda w: F.element_at(rules_of, w))), lambda r: F.contains(F.col("words"), r["keyword"]))
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(tried), detect))))
    no_place = F.expr("cast(array() as array<int>)")
    base = [F.when(F.contains("words", F.lit(wrapped(p))), F.transform(places(F.col("words"), F.lit(wrapped(p)), measure=_words), lambda m: m["at"])).otherwise(no_place).alias(f"base_{k}") for k, (_, p) in enumerate(BASE)]
    seen = counted.select("doc_id", "n_words", hits.alias("hits"), *base)

    # Sorted by start, longest first: a detection is inside an earlier one of its priority or more if that one's end reaches its own.
    start = F.struct(*[F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)], F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"))

    def sweep(acc: Column, h: Column) -> Column:
        end, p = -h["back"], -h["rank"]
        inside = F.when(p == 1, acc["m1"]).when(p == 2, acc["m2"]).otherwise(acc["m3"]) >= end
        reach = [F.when(F.lit(k) <= p, F.greatest(acc[f"m{k}"], end)).otherwise(acc[f"m{k}"]).alias(f"m{k}") for k in (1, 2, 3)]
        labels = F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(h["label"])))
        score = F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], h["weight"]))
        return F.struct(*reach, labels.alias("labels"), score.alias("score"), F.when(inside, acc["n"]).otherwise(acc["n"] + 1).alias("n"))

    kept = seen.withColumn("kept", F.aggregate("hits", start, sweep))
    found = F.filter(F.array(*[F.when(F.size(f"base_{k}") > 0, F.lit(a)) for k, (a, _) in enumerate(BASE)]), lambda x: x.isNotNull())
    every = F.concat(*[F.col(f"base_{k}") for k in range(len(BASE))])
    return kept.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(found), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(found, F.col("kept.labels"))), ",").alias("labels"),
        F.greatest(F.col("kept.score"), F.when(F.size(every) > 0, 0.6).otherwise(0.0)).alias("score"), F.col("kept.n").alias("n_detections"),
    )
