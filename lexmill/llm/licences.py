"""Licence detection by ordered signature rules.

Rules are regular expressions over a text's words in lower case, joined by one space. Each has a label, a priority, a
confidence and keywords; a rule is only tried where one of its keywords occurs (one pass of a keyword automaton), within
the width that its pattern can match. Before that, a text only leaves the JVM if it holds a hint; the hints are derived
from the rules' patterns, so no text that a rule can match is kept back. Of overlapping detections the one with the
higher priority stays, then the longer; a detection whose words lie within a kept one's is suppressed.

The rules are of two sorts: 173 written one by one from the words of licence texts, notices and links, and seven forms times
some forty licences, which give another 373 for the ways in which these are granted, named and tagged.

Base phrases are places where their words stand consecutively; all are counted, whatever the rules say. Time grows with
a text's length and its detections (times their logarithm); one text at a time is a Python string.

Edge cases: a null or empty text has no words, labels "" and score 0; repeated rows get a row each; the column `out`
replaces one of that name, all others are passed through.
"""

import bisect
import functools
import itertools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import one_by_one, whole_text

#: A word's characters, before A-Z are lower-cased and after.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, tag words, names (regular expressions over words).
LICENCES = [
    ("mit", "mit", ["mit(?: x11)?", "expat"]),
    ("apache-2", "apache 2 0", ["apache(?: software)?(?: license)?(?: version)?(?: v)? ?2(?: 0)?", "apache(?: software)? license"]),
    ("apache-1", "apache 1 1", ["apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"]),
    ("bsd-2", "bsd 2 clause", ["(?:bsd )?(?:2|two) clause(?: bsd)?", "simplified bsd", "freebsd"]),
    ("bsd-3", "bsd 3 clause", ["(?:bsd )?(?:3|three) clause(?: bsd)?", "(?:new|revised|modified) bsd"]),
    ("bsd-4", "bsd 4 clause", ["(?:bsd )?(?:4|four) clause(?: bsd)?", "original bsd"]),
    ("bsd", "bsd", ["bsd(?: style)?"]),
    ("gpl-2", "gpl 2 0(?: only| or later)?", ["(?:gnu )?(?:general public license|gpl)(?: license)?(?: as published by the free software foundation)?(?: either)?(?: version)? ?v?2(?: 0)?"]),
    ("gpl-3", "gpl 3 0(?: only| or later)?", ["(?:gnu )?(?:general public license|gpl)(?: license)?(?: as published by the free software foundation)?(?: either)?(?: version)? ?v?3(?: 0)?"]),
    ("gpl", "gpl", ["gnu general public license", "gnu gpl"]),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", ["(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: version)? ?v?2(?: 1)?"]),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", ["(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v?3(?: 0)?"]),
    ("lgpl", "lgpl", ["(?:gnu )?(?:lesser|library) general public license", "gnu lgpl"]),
    ("agpl-3", "agpl 3 0(?: only| or later)?", ["(?:gnu )?(?:affero general public license|agpl)(?: version)?(?: ?v?3)?(?: 0)?"]),
    ("mpl-1.1", "mpl 1 1", ["mozilla public license(?: version)? ?v?1(?: [01])?", "mpl ?1(?: 1)?"]),
    ("mpl-2", "mpl 2 0", ["mozilla public license(?: version)?(?: ?v?2)?(?: 0)?", "mpl ?2(?: 0)?"]),
    ("epl-1", "epl 1 0", ["eclipse public license(?: version)? ?v?1(?: 0)?"]),
    ("epl-2", "epl 2 0", ["eclipse public license(?: version)?(?: ?v?2)?(?: 0)?"]),
    ("cddl", "cddl 1 [01]", ["common development and distribution license", "cddl"]),
    ("eupl", "eupl 1 [012]", ["european union public licen[cs]e", "eupl"]),
    ("isc", "isc", ["isc"]),
    ("zlib", "zlib", ["zlib(?: libpng)?"]),
    ("boost-1", "bsl 1 0", ["boost software(?: license)?(?: version)?(?: 1)?(?: 0)?"]),
    ("artistic-2", "artistic 2 0", ["artistic(?: license)?(?: version)? 2(?: 0)?", "perl artistic"]),
    ("unlicense", "unlicense", ["unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl", "do what the fuck you want to public license"]),
    ("postgresql", "postgresql", ["postgresql"]),
    ("python-2", "python 2 0", ["python software foundation", "psf"]),
    ("ofl-1.1", "ofl 1 1", ["sil open font(?: license)?(?: version)?(?: 1)?(?: 1)?", "open font license"]),
    ("odbl", "odbl 1 0", ["open database license", "odbl"]),
    ("cc0", "cc0 1 0", ["cc0(?: 1 0)?", "creative commons zero"]),
    ("cc-by", "cc by [1-4] [05]", ["cc by(?: [1-4] [05])?", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?"]),
    ("cc-by-sa", "cc by sa [1-4] [05]", ["cc by sa(?: [1-4] [05])?", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"]),
    ("cc-by-nc", "cc by nc [1-4] [05]", ["cc by nc(?: [1-4] [05])?", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"]),
    ("cc-by-nd", "cc by nd [1-4] [05]", ["cc by nd(?: [1-4] [05])?", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"]),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]", ["cc by nc sa(?: [1-4] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"]),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]", ["cc by nc nd(?: [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"]),
    ("public-domain", "public domain", ["public domain"]),
    ("ms-pl", "ms pl", ["microsoft public", "ms pl"]),
    ("proprietary", "proprietary", ["proprietary", "commercial"]),
]
#: Form, priority, confidence; {} stands for a name or, in a tag, the tag words.
FORMS = [
    ("spdx license identifier {}", 5, 0.99),
    ("(?:is |are )?(?:licensed|released|distributed|published|available|provided|offered|redistributed) (?:to you )?(?:only )?under(?: the terms(?: and conditions)? of)?(?: the| an?)? {}(?: licen[cs]e)?", 4, 0.97),
    ("subject to the terms(?: and conditions)? of(?: the| an?)? {}(?: licen[cs]e)?", 4, 0.95),
    ("under(?: the terms of)?(?: the| an?)? {} licen[cs]e", 3, 0.9),
    ("licen[cs]e(?: is| name)?(?: the)? {}(?: licen[cs]e)?", 3, 0.85),
    ("dedicated to the {}", 3, 0.9),
    ("(?:the )?{} licen[cs]es?", 2, 0.7),
]
#: Rules written from the licences' own words: pattern, label, priority, confidence.
TEXTS = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 4, 0.95),
    ("without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "mit", 4, 0.95),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 4, 0.9),
    ("permission is hereby granted without written agreement and without licen[cs]e or royalty fees", "mit", 3, 0.85),
    ("except as contained in this notice the names? of (?:the )?above copyright holders?", "mit", 3, 0.85),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 4, 0.95),
    ("permission to use copy modify and distribute this software (?:and its documentation )?for any purpose with or without fee is hereby granted", "isc", 4, 0.9),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "0bsd", 5, 0.9),
    ("(?:bsd zero clause|zero clause bsd|0bsd) licen[cs]e", "0bsd", 4, 0.95),
    ("spdx license identifier 0bsd", "0bsd", 5, 0.99),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 3, 0.85),
    ("redistributions of source code must retain the above copyright notice", "bsd", 3, 0.85),
    ("redistributions in binary form must reproduce the above copyright notice", "bsd", 3, 0.85),
    ("may be used to endorse or promote products derived from this software", "bsd-3", 4, 0.9),
    ("all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4", 5, 0.95),
    ("the views and conclusions contained in the software and documentation are those of the authors", "bsd-2", 4, 0.9),
    ("bsd patent licen[cs]e", "bsd-patent", 4, 0.9),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2", 5, 0.99),
    ("you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0", "apache-2", 5, 0.99),
    ("apache org licenses license 2 0", "apache-2", 5, 0.97),
    ("licensed to the apache software foundation asf under one or more contributor license agreements", "apache-2", 5, 0.98),
    ("this product includes software developed by the apache (?:software foundation|group)", "apache-1", 4, 0.85),
    ("apache org licenses license 1 [01]", "apache-1", 5, 0.97),
    ("products derived from this software may not be called apache", "apache-1", 5, 0.95),
    ("asl ?2(?: 0)?", "apache-2", 2, 0.6),
    ("opensource org licenses (?:mit|mit license)", "mit", 5, 0.97),
    ("opensource org licenses bsd 2 clause", "bsd-2", 5, 0.97),
    ("opensource org licenses bsd 3 clause", "bsd-3", 5, 0.97),
    ("opensource org licenses (?:bsd license|bsd)", "bsd", 5, 0.9),
    ("opensource org licenses isc(?: license)?", "isc", 5, 0.97),
    ("opensource org licenses apache 2 0", "apache-2", 5, 0.97),
    ("opensource org licenses gpl (?:license|2 0)", "gpl-2", 5, 0.95),
    ("opensource org licenses gpl 3 0", "gpl-3", 5, 0.97),
    ("opensource org licenses zlib", "zlib", 5, 0.97),
    ("opensource org licenses artistic license 2 0", "artistic-2", 5, 0.97),
    ("opensource org licenses unlicense", "unlicense", 5, 0.97),
    ("opensource org licenses (?:eupl|eupl 1 [12])", "eupl", 5, 0.97),
    ("opensource org licenses ms pl", "ms-pl", 5, 0.97),
    ("choosealicense com licenses mit", "mit", 5, 0.95),
    ("choosealicense com licenses apache 2 0", "apache-2", 5, 0.95),
    ("choosealicense com licenses gpl 3 0", "gpl-3", 5, 0.95),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 4, 0.97),
    ("either version 2 of the license or at your option any later version", "gpl-2", 3, 0.85),
    ("either version 3 of the license or at your option any later version", "gpl-3", 3, 0.85),
    ("gnu general public license version 2 as published by the free software foundation", "gpl-2", 5, 0.98),
    ("gnu general public license version 3 as published by the free software foundation", "gpl-3", 5, 0.98),
    ("version 2 june 1991 copyright", "gpl-2", 4, 0.9),
    ("version 3 29 june 2007 copyright", "gpl-3", 4, 0.9),
    ("you should have received a copy of the gnu general public license along with this (?:program|library|software)", "gpl", 4, 0.95),
    ("you should have received a copy of the gnu lesser general public license along with this (?:program|library|software)", "lgpl", 4, 0.95),
    ("you should have received a copy of the gnu library general public license along with this (?:program|library|software)", "lgpl", 4, 0.95),
    ("you should have received a copy of the gnu affero general public license along with this (?:program|library|software)", "agpl-3", 4, 0.95),
    ("under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", "lgpl-2.1", 5, 0.98),
    ("under the terms of the gnu lesser general public license as published by the free software foundation either version 3", "lgpl-3", 5, 0.98),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl-3", 5, 0.98),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "lgpl", 4, 0.97),
    ("gnu org licenses gpl 3 0", "gpl-3", 5, 0.97),
    ("gnu org licenses (?:old licenses )?gpl 2 0", "gpl-2", 5, 0.97),
    ("gnu org licenses (?:old licenses )?lgpl 2 1", "lgpl-2.1", 5, 0.97),
    ("gnu org licenses lgpl 3 0", "lgpl-3", 5, 0.97),
    ("gnu org licenses agpl 3 0", "agpl-3", 5, 0.97),
    ("gnu org licenses gpl(?: html| txt)?", "gpl", 4, 0.9),
    ("gnu org licenses lgpl(?: html| txt)?", "lgpl", 4, 0.9),
    ("gnu org licenses (?:old licenses )?fdl(?: 1 [123])?", "gfdl", 5, 0.97),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 5, 0.98),
    ("gnu free documentation licen[cs]e", "gfdl", 3, 0.9),
    ("with no invariant sections no front cover texts and no back cover texts", "gfdl", 4, 0.9),
    ("as a special exception (?:the copyright holders? gives? you permission to )?link this (?:library|program)", "gpl-exception", 3, 0.8),
    ("classpath exception(?: 2 0)?", "gpl-exception", 3, 0.85),
    ("gcc runtime library exception", "gpl-exception", 4, 0.9),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", 5, 0.99),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2", 5, 0.98),
    ("mozilla org mpl 2 0", "mpl-2", 5, 0.97),
    ("mozilla org mpl 1 1", "mpl-1.1", 5, 0.97),
    ("mozilla org mpl mpl 1 1", "mpl-1.1", 5, 0.97),
    ("the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 5, 0.98),
    ("incompatible with secondary licenses as defined by the mozilla public license", "mpl-2", 4, 0.9),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "epl-1", 5, 0.98),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0", "epl-2", 5, 0.98),
    ("eclipse org legal epl v10", "epl-1", 5, 0.97),
    ("eclipse org legal epl (?:v20|2 0)", "epl-2", 5, 0.97),
    ("the contents of this file are subject to the terms of the common development and distribution license", "cddl", 5, 0.98),
    ("licensed under the eupl", "eupl", 4, 0.95),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 4, 0.93),
    ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib", 5, 0.96),
    ("the origin of this software must not be misrepresented", "zlib", 4, 0.93),
    ("boost org license 1 0", "boost-1", 5, 0.97),
    ("distributed under the boost software license version 1 0", "boost-1", 5, 0.98),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5, 0.97),
    ("anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 5, 0.95),
    ("unlicense org", "unlicense", 4, 0.9),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl", 4, 0.8),
    ("you just do what the fuck you want to", "wtfpl", 5, 0.97),
    ("this package is free software you can redistribute it and or modify it under the same terms as perl itself", "perl", 5, 0.95),
    ("under the same terms as perl itself", "perl", 4, 0.9),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql", 5, 0.95),
    ("psf is making python available to licensee on an as is basis", "python-2", 5, 0.97),
    ("this license agreement is between the python software foundation psf", "python-2", 5, 0.97),
    ("the sil open font license", "ofl-1.1", 3, 0.9),
    ("this font software is licensed under the sil open font license version 1 1", "ofl-1.1", 5, 0.98),
    ("scripts sil org ofl", "ofl-1.1", 5, 0.96),
    ("with reserved font names?", "ofl-1.1", 3, 0.8),
    ("opendatacommons org licenses odbl", "odbl", 5, 0.97),
    ("opendatacommons org licenses by", "odc-by", 5, 0.97),
    ("opendatacommons org licenses pddl", "pddl", 5, 0.97),
    ("open data commons attribution licen[cs]e", "odc-by", 4, 0.95),
    ("public domain dedication and licen[cs]e", "pddl", 4, 0.9),
    ("open government licen[cs]e(?: version| v)?(?: ?[123](?: 0)?)?", "ogl", 4, 0.93),
    ("contains public sector information licensed under the open government licen[cs]e", "ogl", 5, 0.97),
    ("creativecommons org publicdomain zero 1 0", "cc0", 5, 0.97),
    ("creativecommons org publicdomain mark 1 0", "public-domain", 5, 0.97),
    ("has waived all copyright and related or neighboring rights", "cc0", 5, 0.97),
    ("cc0 1 0 universal", "cc0", 4, 0.95),
    ("this work has been identified as being free of known restrictions under copyright law", "public-domain", 5, 0.95),
    ("this (?:work|file|software|document|program|code) is (?:hereby )?(?:placed )?in the public domain", "public-domain", 4, 0.92),
    ("(?:has|have) been (?:placed|released|dedicated) (?:in|into|to) the public domain", "public-domain", 4, 0.92),
    ("is a work of the (?:united states|u s) government", "public-domain", 3, 0.7),
    ("not subject to copyright protection in the united states", "public-domain", 3, 0.8),
    ("creativecommons org licenses by [1-4] [05]", "cc-by", 5, 0.97),
    ("creativecommons org licenses by sa [1-4] [05]", "cc-by-sa", 5, 0.97),
    ("creativecommons org licenses by nc [1-4] [05]", "cc-by-nc", 5, 0.97),
    ("creativecommons org licenses by nd [1-4] [05]", "cc-by-nd", 5, 0.97),
    ("creativecommons org licenses by nc sa [1-4] [05]", "cc-by-nc-sa", 5, 0.97),
    ("creativecommons org licenses by nc nd [1-4] [05]", "cc-by-nc-nd", 5, 0.97),
    ("cc by [1-4] [05]", "cc-by", 2, 0.7),
    ("cc by sa(?: [1-4] [05])?", "cc-by-sa", 2, 0.7),
    ("cc by nd(?: [1-4] [05])?", "cc-by-nd", 2, 0.7),
    ("cc by nc sa(?: [1-4] [05])?", "cc-by-nc-sa", 3, 0.75),
    ("cc by nc nd(?: [1-4] [05])?", "cc-by-nc-nd", 3, 0.75),
    ("wikipedia org wiki wikipedia text of creative commons attribution share ?alike", "cc-by-sa", 4, 0.9),
    ("text is available under the creative commons attribution share ?alike licen[cs]e", "cc-by-sa", 5, 0.97),
    ("business source licen[cs]e(?: 1 1)?", "busl", 4, 0.9),
    ("server side public licen[cs]e", "sspl", 4, 0.93),
    ("elastic licen[cs]e(?: 2 0)?", "elastic", 3, 0.85),
    ("commons clause licen[cs]e condition", "commons-clause", 4, 0.93),
    ("polyform (?:noncommercial|small business|strict|shield|perimeter) licen[cs]e", "polyform", 4, 0.93),
    ("blue oak model licen[cs]e", "blueoak", 4, 0.93),
    ("universal permissive licen[cs]e", "upl", 4, 0.93),
    ("academic free licen[cs]e", "afl", 4, 0.93),
    ("open software licen[cs]e", "osl", 3, 0.85),
    ("common public licen[cs]e", "cpl", 3, 0.85),
    ("ibm public licen[cs]e", "ipl", 4, 0.93),
    ("sun public licen[cs]e", "spl", 4, 0.93),
    ("apple public source licen[cs]e", "apsl", 4, 0.93),
    ("netscape public licen[cs]e", "npl", 4, 0.93),
    ("university of illinois ncsa open source licen[cs]e", "ncsa", 5, 0.97),
    ("historical permission notice and disclaimer", "hpnd", 4, 0.93),
    ("sleepycat licen[cs]e", "sleepycat", 4, 0.9),
    ("w3c software (?:notice and )?(?:and document )?licen[cs]e", "w3c", 4, 0.93),
    ("x consortium", "x11", 2, 0.6),
    ("the x11 licen[cs]e", "x11", 3, 0.85),
    ("openssl licen[cs]e", "openssl", 3, 0.85),
    ("this product includes software developed by the openssl project", "openssl", 5, 0.96),
    ("this product includes cryptographic software written by eric young", "openssl", 5, 0.96),
    ("vim licen[cs]e", "vim", 3, 0.85),
    ("php licen[cs]e(?: version)?(?: 3(?: 0[01])?)?", "php", 3, 0.85),
    ("ruby licen[cs]e", "ruby", 3, 0.8),
    ("latex project public licen[cs]e", "lppl", 4, 0.95),
    ("beerware licen[cs]e", "beerware", 4, 0.93),
    ("if we meet some day and you think this stuff is worth it you can buy me a beer", "beerware", 5, 0.97),
    ("the software shall be used for good not evil", "json", 5, 0.97),
    ("microsoft reciprocal licen[cs]e", "ms-rl", 4, 0.93),
    ("microsoft limited public licen[cs]e", "ms-pl", 4, 0.9),
    ("llama (?:[23] )?community licen[cs]e", "llama", 4, 0.93),
    ("responsible ai licen[cs]e", "rail", 3, 0.9),
    ("open ?rail m", "rail", 3, 0.9),
    ("non ?commercial use only", "proprietary", 2, 0.6),
    ("for personal use only", "proprietary", 1, 0.4),
    ("no part of this (?:publication|book|work|document) may be reproduced", "proprietary", 3, 0.8),
    ("unauthorized (?:copying|reproduction|distribution) of this (?:file|work|software|document)", "proprietary", 3, 0.85),
    ("proprietary and confidential", "proprietary", 3, 0.85),
    ("end user licen[cs]e agreement", "proprietary", 3, 0.8),
    ("all rights reserved", "proprietary", 1, 0.4),
]
#: Words of a rule that don't make a keyword.
COMMON = {"the", "of", "and", "to", "is", "are", "an", "in", "or", "you", "under", "terms", "with", "for", "only", "by", "any", "version", "general", "open", "may", "used", "this"}
#: Words of so few characters are looked for whole, as most texts have them as parts of others.
SHORT = 3
#: Hints that many rules share and few other texts have, taken where a rule proves them.
FAVOURED = ("licen", "copyright", "permission", "redistribut", "creativecommons", "unencumbered", "domain", "software")


def pieces(pattern: str) -> frozenset[str]:
    """Parts of words, or short whole words with a space at both ends, one of which stands in every text that the pattern matches.

    Of the sets that the pattern proves (a run of letters that it can't do without, or one such set of each alternative),
    it is a favoured one, or else the one whose shortest member is longest, common words last. It follows the pattern's own parse, so it holds for any rule.
    """
    best: frozenset[str] = frozenset()

    def rank(x: frozenset[str]) -> tuple:
        favoured = [min((i for i, f in enumerate(FAVOURED) if f in w), default=len(FAVOURED)) for w in x]
        return -max(favoured, default=len(FAVOURED)), not any(w.strip() in COMMON for w in x), min((len(w.strip()) for w in x), default=0), -len(x)


    def runs(parts, bounded: bool) -> tuple[frozenset[str], ...]:
        """The sets that a sequence proves; bounded: whether it starts and ends at the ends of words."""
        found, run, whole = [], "", bounded

        def close(at_end: bool) -> None:
            nonlocal run
            if run:
                found.append(frozenset([f" {run} " if whole and at_end else run]))
            run = ""

        for op, arg in parts:
            kind = str(op)
            if kind == "LITERAL" and chr(arg) != " ":
                run += chr(arg)
            elif kind == "LITERAL":
                close(True)
                whole = True
            else:
                optional = kind == "MAX_REPEAT" and arg[0] == 0
                starts_word = optional and str(arg[2][0][0]) == "SUBPATTERN" and str(arg[2][0][1][3][0]) == "(LITERAL, 32)"
                close(starts_word)
                whole = whole and starts_word
                if kind == "BRANCH":
                    sides = [max(runs(x, False), key=rank, default=frozenset()) for x in arg[1]]
                    if all(sides):
                        found.append(frozenset().union(*sides))
                elif kind == "SUBPATTERN":
                    found.extend(runs(arg[3], False))
                elif kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                    found.extend(runs(arg[2], False))
        close(bounded)
        return tuple(found)

    for x in runs(re._parser.parse(pattern), True):
        x = frozenset(next((f for f in FAVOURED if f in w), w if len(w.strip()) <= SHORT else w.strip()) for w in x)
        if rank(x) > rank(best):
            best = x
    return best


@functools.cache
def hints() -> list[str]:
    """What the rules and base phrases prove, without those that hold another one."""
    found = set().union(*(pieces(p) for p in [*(p for p, *_ in patterns()), *BASE]))
    return sorted(x for x in found if not any(y.strip() != x.strip() and y == y.strip() and y in x for y in found))


def hinted(text: Column) -> Column:
    """Whether any rule or base phrase can match; plain searches, as one large pattern takes several times as long.

    Anything may stand between the words of a rule, so each hint lies within one word.
    """
    low, out = F.lower(text), F.lit(False)
    letter = r"[0-9a-z\x{80}-\x{10FFFF}]"
    for hint in hints():
        word = hint.strip()
        out = out | (low.contains(word) if word == hint else low.contains(word) & low.rlike(f"(?<!{letter}){word}(?!{letter})"))
    return out


def _without_groups(pattern: str, group: str) -> str:
    """The pattern with every group of the kind replaced by a space, inner ones first."""
    while (less := re.sub(group, " ", pattern)) != pattern:
        pattern = less
    return pattern


def _longest(pattern: str) -> str:
    return max((w for w in re.findall(r"(?<![\w\[])[a-z0-9]{2,}(?![\w\[?])", pattern) if w not in COMMON), key=len, default="")


def _keywords(name: str) -> frozenset[str]:
    """Words of which one must occur where the name does: its longest literal word, else one of each alternative of its group."""
    needed = _without_groups(name, r"\(\?:[^()]*\)\?")
    if word := _longest(_without_groups(needed, r"\(\?:[^()]*\)")):
        return frozenset([word])
    inner = _without_groups(needed.strip().removeprefix("(?:"), r"\(\?:[^()]*\)")
    return frozenset(w for part in inner.split("|") if (w := _longest(part)))


def patterns() -> list[tuple[str, str, int, float, frozenset[str]]]:
    """pattern, label, priority, confidence, keywords of every rule, in order."""
    out = []
    for label, tag, names in LICENCES:
        for form, priority, confidence in FORMS:
            for name in [tag] if "identifier" in form else names:
                if "dedicated" not in form or label in ("public-domain", "cc0"):
                    out.append((form.format(f"(?:{name})"), label, priority, confidence, _keywords(name)))
    return out + [(p, label, priority, confidence, _keywords(p)) for p, label, priority, confidence in TEXTS]


@functools.cache
def rules() -> list[tuple[re.Pattern, str, int, float, frozenset[str], int]]:
    """Compiled pattern, label, priority, confidence, keywords and the most characters it can match of every rule."""
    return [(re.compile(rf"(?<!\S){p}(?!\S)"), *rest, re._parser.parse(p).getwidth()[1]) for p, *rest in patterns()]


@functools.cache
def _gates() -> tuple[ahocorasick.Automaton, list[int]]:
    """The automaton from keyword to rules, and the rules without keywords."""
    by_word: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for word in rule[4]:
            by_word.setdefault(word, []).append(i)
    automaton = ahocorasick.Automaton()
    for word, found in by_word.items():
        automaton.add_word(word, found)
    automaton.make_automaton()
    return automaton, [i for i, rule in enumerate(rules()) if not rule[4]]


def _windows(ends: list[int], reach: int, joined: str) -> list[tuple[int, int]]:
    """Where a rule that matches at most reach characters, with keywords that end at these places, can match: merged, and
    cut at spaces."""
    out: list[list[int]] = []
    for end in ends:
        if out and end - reach <= out[-1][1]:
            out[-1][1] = end + reach
        else:
            out.append([max(0, end - reach), end + reach])
    cut = lambda at: len(joined) if (space := joined.find(" ", min(at, len(joined)))) < 0 else space
    return [(a, cut(b)) for a, b in out]


def suppress(found: list[tuple[int, int]]) -> list[bool]:
    """Of intervals in order of rank, which lie in no kept one before them.

    Kept intervals that no other kept one holds are a staircase: sorted by start they are sorted by end too, so the last
    one that starts no later decides.
    """
    starts, ends, kept = [], [], []
    for a, b in found:
        at = bisect.bisect_right(starts, a)
        kept.append(not at or ends[at - 1] < b)
        if kept[-1]:
            lo = bisect.bisect_left(starts, a)
            hi = bisect.bisect_right(ends, b)
            if lo < hi:  # those that it holds
                del starts[lo:hi], ends[lo:hi]
            starts.insert(lo, a)
            ends.insert(lo, b)
    return kept


def detections(joined: str) -> list[tuple[int, int, str, float]]:
    """(first character, end, label, confidence) of what stays after suppression; joined: words, one space between."""
    automaton, always = _gates()
    places: dict[int, list[int]] = {}
    for end, tried in automaton.iter(joined):
        for i in tried:
            places.setdefault(i, []).append(end)
    windows = {i: _windows(ends, rules()[i][5], joined) for i, ends in places.items()} | {i: [(0, len(joined))] for i in always}
    found = set()
    for i, spans in windows.items():
        pattern, label, priority, confidence, *_ = rules()[i]
        for lo, hi in spans:
            for m in pattern.finditer(joined, lo, hi):
                found.add((-priority, m.start() - m.end(), m.start(), m.end(), i, label, confidence))
    ranked = sorted(found)
    kept = suppress([x[2:4] for x in ranked])
    return [(a, b, label, c) for (_, _, a, b, _, label, c), stays in zip(ranked, kept, strict=True) if stays]


def base_places(joined: str) -> list[tuple[int, str]]:
    """(first character, label) of every place of a base phrase."""
    padded, out = f" {joined} ", []
    for phrase, label in BASE.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


RESULT = "n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:int,end:int,label:string,confidence:double>>"


def _scan(text: str | None) -> tuple:
    if text is None:
        return 0, None, None, "", "", 0.0, []
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    joined = " ".join(words)
    base, found = base_places(joined), detections(joined)
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0)) if base or found else []
    number = lambda at: bisect.bisect_left(starts, at)
    miss = 1.0
    for c in [0.9 for _ in {label for _, label in base}] + [c for _, _, _, c in found]:
        miss *= 1 - c
    labels = sorted({label for _, label in base} | {label for _, _, label, _ in found})
    places = [number(at) for at, _ in base]
    spans = [{"first": number(a), "end": number(b), "label": label, "confidence": c} for a, b, label, c in found]
    return len(base), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in base})), ",".join(labels), round(1 - miss, 6), spans


SPAN = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())])
FIELDS = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(SPAN)}


def with_licences(docs: DataFrame, out: str, text: str = "text", gated: bool = True) -> DataFrame:
    """docs with the struct out: what the base phrases and the rules found. Only texts with a hint leave the JVM, unless
    gated is False; the results are the same."""

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [_scan(x) for x in one_by_one(texts)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(FIELDS.values())], list(FIELDS))

    whole = whole_text(text)
    return docs.withColumn(out, scan(F.when(hinted(whole), whole) if gated else whole))


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD_ANY_CASE)).cast("long")
