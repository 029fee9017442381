"""License scans: ordered signature rules, hundreds of patterns behind a keyword prefilter.

A rule is a pattern over the words of a lower-cased text joined by one space, with a label, a
priority, a weight and a keyword. The rules are sentences of licences' own texts and identifiers, names of
licences, and notices, in this order of priority. One automaton of all keywords runs over the text; only
rules whose keyword occurs are tried. Of overlapping detections a rule of higher
priority suppresses those that lie inside its interval; among equals the longer
one does, then the earlier rule. A name right after words that grant it has the full weight.

Defined cases: a null text is as an empty one; a text without words has no labels
and null places; equal detections of one label count once in the labels; repeated
rows are scanned each; columns with the names of outputs are replaced; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodegraph.llm.common import append, map_in_arrow, with_columns_schema

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: What separates words, as bytes of a lower-cased text in UTF-8: ASCII characters that are no digits or small letters.
_GAPS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_TO_SPACE = bytes.maketrans(_GAPS, b" " * len(_GAPS))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    #: All of it occurs where the rule matches; it begins a word.
    keyword: str
    #: Its group v, if it has one and it matched, is the label's version.
    pattern: str
    #: How surely the words grant or reserve rights, 0 to 1.
    weight: float


# Rules, one a line: label, weight, keyword, pattern; without a pattern the keyword is it.

#: Sentences of licences' own texts.
BODIES = r"""
mit | 1.0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0.9 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy(?! of this (?:software and|font))
mit | 0.9 | the above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 0.8 | the rights to use | the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit-0 | 0.9 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software (?:\S+ ){20,60}so the software is provided
x11 | 1.0 | except as contained in | except as contained in this notice the name of the (?:\S+ ){1,8}shall not be used in advertising
isc | 1.0 | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.9 | permission to use copy | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
0bsd | 1.0 | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | 1.0 | permission to use copy | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
bsd | 1.0 | redistribution and use in | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 0.9 | redistribution and use in | redistribution and use in source and binary forms
bsd | 0.9 | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 0.9 | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3 | 1.0 | neither the name | neither the name of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-3 | 0.9 | the name of the author | the name of the author may not be used to endorse or promote products derived from this software
bsd-4 | 1.0 | all advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-patent | 0.9 | subject to the terms | subject to the terms and conditions of this license each copyright holder and contributor hereby grants
apache-2.0 | 1.0 | you may not use | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | 1.0 | licensed under the apache | licensed under the apache license version 2 0
apache-2.0 | 0.9 | www apache org licenses | (?:https? )?www apache org licenses license 2 0
apache-2.0 | 0.8 | unless required by applicable | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 | 1.0 | the apache software license | the apache software license version 1 1
apache-1.1 | 0.9 | this product includes software | this product includes software developed by the apache (?:software foundation|group)
gpl | 1.0 | this program is free | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 0.9 | is free software you | (?:\S+ )is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0 | 1.0 | either version 2 of | either version 2 of the license or (?:at your option )?any later version
gpl-3.0 | 1.0 | either version 3 of | either version 3 of the license or (?:at your option )?any later version
gpl-2.0 | 1.0 | gnu general public license | gnu general public license version 2 june 1991
gpl-3.0 | 1.0 | gnu general public license | gnu general public license version 3 29 june 2007
gpl | 0.8 | without even the implied | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | 0.8 | you should have received | you should have received a copy of the gnu general public license
lgpl | 0.8 | you should have received | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | 0.8 | you should have received | you should have received a copy of the gnu affero general public license
lgpl-2.1 | 1.0 | gnu lesser general public | gnu lesser general public license version 2 1 february 1999
lgpl-2.0 | 1.0 | gnu library general public | gnu library general public license version 2 june 1991
lgpl-3.0 | 1.0 | gnu lesser general public | gnu lesser general public license version 3 29 june 2007
agpl-3.0 | 1.0 | gnu affero general public | gnu affero general public license version 3 19 november 2007
gpl | 0.7 | free software foundation inc | free software foundation inc (?:59 temple place|51 franklin st(?:reet)?|675 mass ave)
gpl-exception | 0.9 | as a special exception | as a special exception (?:\S+ ){1,20}gives? (?:you )?(?:unlimited )?permission to
classpath-exception | 1.0 | linking this library statically | linking this library statically or dynamically with other modules is making a combined work
gcc-exception | 1.0 | gcc runtime library exception
mpl-2.0 | 1.0 | this source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 1.0 | the contents of this | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | 1.0 | the contents of this | the contents of this file are subject to the mozilla public license version 1 0
npl | 1.0 | the contents of this | the contents of this file are subject to the netscape public license
cddl-1.0 | 1.0 | the contents of this | the contents of this file are subject to the terms of the common development and distribution license
cpal-1.0 | 1.0 | the contents of this | the contents of this file are subject to the common public attribution license
apsl | 1.0 | the contents of this | the contents of this file constitute original code as defined in and are subject to the apple public source license
epl-1.0 | 1.0 | this program and the | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | 1.0 | this program and the | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl | 0.9 | the accompanying program is | the accompanying program is provided under the terms of this eclipse public license
cpl-1.0 | 1.0 | the accompanying program is | the accompanying program is provided under the terms of this common public license
ipl-1.0 | 1.0 | the accompanying program is | the accompanying program is provided under the terms of this ibm public license
eupl | 1.0 | licensed under the eupl
eupl | 0.9 | this european union public | this european union public licen[cs]e
zlib | 1.0 | this software is provided | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 0.9 | the origin of this | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 0.8 | altered source versions must | altered source versions must be plainly marked as such
boost-1.0 | 1.0 | distributed under the boost | distributed under the boost software license version 1 0
boost-1.0 | 1.0 | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | 1.0 | this is free and | this is free and unencumbered software released into the public domain
unlicense | 0.9 | anyone is free to | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 1.0 | you just do what | you just do what the fuck you want to
ofl-1.1 | 1.0 | this font software is | this font software is licensed under the sil open font license version 1 1
ofl | 0.9 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of the font software
ofl | 0.8 | the fonts are released | the fonts are released under the sil open font license
artistic-1.0 | 1.0 | the intent of this | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | 1.0 | this license establishes the | this license establishes the terms under which a given free software package may be copied modified distributed
perl | 1.0 | under the same terms | (?:it and or modify it )?under the same terms as perl(?: itself)?
ruby | 0.9 | under the same terms | (?:it and or modify it )?under the same terms as ruby
python-2.0 | 1.0 | psf is making python | psf is making python available to licensee on an as is basis
python-2.0 | 0.9 | this license agreement is | this license agreement is between the python software foundation
openssl | 1.0 | this product includes software | this product includes software developed by the openssl project
ssleay | 1.0 | this product includes cryptographic | this product includes cryptographic software written by eric young
curl | 0.8 | copyright and permission notice | copyright and permission notice copyright
postgresql | 1.0 | in no event shall | in no event shall the university of california be liable to any party for direct indirect special
ncsa | 1.0 | university of illinois ncsa | university of illinois ncsa open source license
w3c | 1.0 | w3c software notice and | w3c software notice and (?:document )?license
unicode | 1.0 | unicode data files and | unicode data files and software
ms-pl | 1.0 | this license governs use | this license governs use of the accompanying software if you use the software you accept this license
gfdl | 1.0 | permission is granted to | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 0.8 | with no invariant sections | with no invariant sections (?:with )?no front cover texts
latex-lppl | 1.0 | this work may be | this work may be distributed and or modified under the conditions of the latex project public license
odbl | 1.0 | is made available under | (?:\S+ )?is made available under the open database license
odc-by | 1.0 | is made available under | (?:\S+ )?is made available under the open data commons attribution license
pddl | 1.0 | is made available under | (?:\S+ )?is made available under the public domain dedication and license
cc | 0.9 | to view a copy | to view a copy of this license visit https? creativecommons org licenses
cc | 0.9 | the work as defined | the work as defined below is provided under the terms of this creative commons public license
cc0-1.0 | 1.0 | to the extent possible | to the extent possible under law (?:\S+ ){1,12}waived all copyright and related or neighbou?ring rights
sspl-1.0 | 1.0 | server side public license
busl-1.1 | 1.0 | business source license 1 | business source license 1 1
elastic-2.0 | 1.0 | elastic license 2 0
commons-clause | 1.0 | commons clause license condition | commons clause license condition v1 0
json | 1.0 | the software shall be | the software shall be used for good not evil
beerware | 1.0 | the beer ware license
vim | 1.0 | there are no restrictions | there are no restrictions on distributing unmodified copies of vim
imagemagick | 1.0 | imagemagick license
llama | 1.0 | community license agreement | (?:meta )?llama \d(?: \d)? community license agreement
openrail | 1.0 | responsible ai license | (?:open |bigscience |creativeml )(?:open )?(?:rail(?: m)? )?responsible ai license
openrail | 0.9 | openrail m | (?:creativeml )?openrail m
"""

#: Names of licences, with their versions where they have one.
NAMES = r"""
apache-2.0 | 0.8 | apache license | (?:the )?apache (?:software )?license (?:version |v ?)?2(?: 0)?
apache-2.0 | 0.7 | apache 2 0
apache-2.0 | 0.7 | asl 2 0
apache-1.1 | 0.8 | apache license | apache (?:software )?license (?:version |v ?)?1 1
apache-1.0 | 0.8 | apache license | apache (?:software )?license (?:version |v ?)?1 0
apache | 0.6 | apache license
apache | 0.6 | apache software license
gpl-3.0 | 0.8 | general public license | (?:gnu )?general public license (?:version |v ?)?3(?: 0)?(?: or later| only)?
gpl-2.0 | 0.8 | general public license | (?:gnu )?general public license (?:version |v ?)?2(?: 0)?(?: or later| only)?
gpl-1.0 | 0.8 | general public license | (?:gnu )?general public license (?:version |v ?)?1(?: 0)?(?: or later| only)?
gpl-3.0 | 0.8 | general public license | version 3 (?:or later )?of the (?:gnu )?general public license
gpl-2.0 | 0.8 | general public license | version 2 (?:or later )?of the (?:gnu )?general public license
gpl-3.0 | 0.8 | gpl | (?:gnu )?gpl (?:version |v ?)?3(?: 0)?(?: or later| only)?
gpl-2.0 | 0.8 | gpl | (?:gnu )?gpl (?:version |v ?)?2(?: 0)?(?: or later| only)?
gpl-3.0 | 0.8 | gplv3 | gplv3(?: 0)?(?: or later)?
gpl-2.0 | 0.8 | gplv2 | gplv2(?: 0)?(?: or later)?
gpl | 0.6 | gnu general public license
gpl | 0.6 | gnu gpl
lgpl-3.0 | 0.8 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?(?: or later| only)?
lgpl-2.1 | 0.8 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)?2 1(?: or later| only)?
lgpl-2.0 | 0.8 | library general public license | (?:gnu )?library general public license (?:version |v ?)?2(?: 0)?(?: or later| only)?
lgpl-3.0 | 0.8 | lgpl | (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?(?: or later| only)?
lgpl-2.1 | 0.8 | lgpl | (?:gnu )?lgpl (?:version |v ?)?2 1(?: or later| only)?
lgpl-3.0 | 0.8 | lgplv3 | lgplv3(?: 0)?
lgpl-2.1 | 0.8 | lgplv2 | lgplv2(?: 1)?
lgpl | 0.6 | lesser general public license | (?:gnu )?lesser general public license
lgpl | 0.6 | library general public license | (?:gnu )?library general public license
lgpl | 0.6 | lgpl | (?:gnu )?lgpl
agpl-3.0 | 0.8 | affero general public license | (?:gnu )?affero general public license (?:version |v ?)?3(?: 0)?(?: or later| only)?
agpl-1.0 | 0.8 | affero general public license | (?:gnu )?affero general public license (?:version |v ?)?1(?: 0)?
agpl-3.0 | 0.8 | agpl | agpl ?(?:version |v ?)?3(?: 0)?
agpl-3.0 | 0.8 | agplv3 | agplv3(?: 0)?
agpl | 0.6 | affero general public license | (?:gnu )?affero general public license
agpl | 0.6 | agpl
mpl-2.0 | 0.8 | mozilla public license | mozilla public license (?:version |v ?)?2(?: 0)?
mpl-1.1 | 0.8 | mozilla public license | mozilla public license (?:version |v ?)?1 1
mpl-1.0 | 0.8 | mozilla public license | mozilla public license (?:version |v ?)?1 0
mpl-2.0 | 0.7 | mpl 2 0
mpl-1.1 | 0.7 | mpl 1 1
mpl | 0.6 | mozilla public license
epl-2.0 | 0.8 | eclipse public license | eclipse public license (?:version |v ?)?2(?: 0)?
epl-1.0 | 0.8 | eclipse public license | eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0 | 0.7 | epl 2 0
epl-1.0 | 0.7 | epl 1 0
epl | 0.6 | eclipse public license
edl-1.0 | 0.8 | eclipse distribution license | eclipse distribution license(?: (?:version |v ?)?1 0)?
cddl-1.1 | 0.8 | common development and distribution | common development and distribution license (?:version |v ?)?1 1
cddl-1.0 | 0.8 | common development and distribution | common development and distribution license (?:version |v ?)?1 0
cddl | 0.6 | common development and distribution | common development and distribution license
cddl | 0.6 | cddl | cddl(?: 1 [01])?
cpl-1.0 | 0.8 | common public license | common public license(?: (?:version |v ?)?1 0)?
eupl-1.2 | 0.8 | european union public | european union public licen[cs]e (?:version |v ?)?1 2
eupl-1.1 | 0.8 | european union public | european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 | 0.7 | eupl 1 2
eupl-1.1 | 0.7 | eupl 1 1
mit | 0.8 | mit license | (?:the )?mit (?:x11 )?license
mit | 0.8 | mit licence | (?:the )?mit licence
mit | 0.8 | mit licensed
mit | 0.8 | expat license | (?:mit )?expat license
x11 | 0.8 | x11 license | (?:mit )?x11 license
bsd-2 | 0.8 | 2 clause bsd | (?:the )?2 clause bsd(?: license)?
bsd-2 | 0.8 | bsd 2 clause | (?:the )?bsd 2 clause(?: license)?
bsd-2 | 0.8 | two clause bsd | two clause bsd(?: license)?
bsd-2 | 0.8 | simplified bsd license
bsd-2 | 0.8 | freebsd license
bsd-3 | 0.8 | 3 clause bsd | (?:the )?3 clause bsd(?: license)?
bsd-3 | 0.8 | bsd 3 clause | (?:the )?bsd 3 clause(?: license)?
bsd-3 | 0.8 | three clause bsd | three clause bsd(?: license)?
bsd-3 | 0.8 | new bsd license
bsd-3 | 0.8 | modified bsd license
bsd-3 | 0.8 | revised bsd license
bsd-4 | 0.8 | bsd 4 clause | bsd 4 clause(?: license)?
bsd-4 | 0.8 | original bsd license
bsd | 0.7 | bsd license | (?:the )?bsd license
bsd | 0.7 | bsd licence | (?:the )?bsd licence
bsd | 0.7 | bsd style license
isc | 0.8 | isc license | (?:the )?isc license
0bsd | 0.8 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
zlib | 0.8 | zlib license | (?:the )?zlib license
zlib | 0.8 | zlib libpng license
libpng | 0.8 | libpng license | (?:the )?libpng license
boost-1.0 | 0.8 | boost software license | boost software license(?: version 1 0)?
unlicense | 0.8 | unlicense org
unlicense | 0.8 | the unlicense
wtfpl | 0.8 | wtfpl
artistic-2.0 | 0.8 | artistic license | artistic license (?:version |v ?)?2(?: 0)?
artistic-1.0 | 0.8 | artistic license | artistic license (?:version |v ?)?1(?: 0)?
artistic | 0.6 | artistic license
ofl-1.1 | 0.8 | open font license | (?:sil )?open font license (?:version |v ?)?1 1
ofl-1.0 | 0.8 | open font license | (?:sil )?open font license (?:version |v ?)?1 0
ofl | 0.7 | open font license | (?:sil )?open font license
gfdl-1.3 | 0.8 | gnu free documentation license | gnu free documentation license (?:version |v ?)?1 3
gfdl-1.2 | 0.8 | gnu free documentation license | gnu free documentation license (?:version |v ?)?1 2
gfdl-1.1 | 0.8 | gnu free documentation license | gnu free documentation license (?:version |v ?)?1 1
gfdl | 0.7 | gnu free documentation license
gfdl | 0.7 | gfdl
python-2.0 | 0.8 | python software foundation license | python software foundation license(?: version 2)?
python-2.0 | 0.8 | psf license | psf license(?: agreement)?
ms-pl | 0.8 | microsoft public license
ms-rl | 0.8 | microsoft reciprocal license
afl-3.0 | 0.8 | academic free license | academic free license(?: (?:version |v ?)?3 0)?
osl-3.0 | 0.8 | open software license | open software license(?: (?:version |v ?)?3 0)?
qpl-1.0 | 0.8 | q public license | q public license(?: version 1 0)?
sleepycat | 0.8 | sleepycat license
cecill | 0.8 | cecill | cecill(?: [bc])?(?: (?:version |v ?)?[12](?: [01])?)?
mulan | 0.8 | mulan psl | mulan psl (?:v2|2 0)
blueoak-1.0 | 0.8 | blue oak model license | blue oak model license(?: 1 0 0)?
lppl | 0.8 | latex project public license
odbl-1.0 | 0.8 | open database license | open database license(?: (?:odbl )?(?:version |v ?)?1 0)?
odbl | 0.7 | odbl
odc-by | 0.8 | open data commons attribution | open data commons attribution license
pddl | 0.8 | public domain dedication and | public domain dedication and license
ogl-3.0 | 0.8 | open government licence | open government licence(?: (?:version |v ?)?3 0)?
"""

#: Creative Commons licences, by their letters and by their words.
COMMONS = r"""
cc-by-nc-nd | 0.9 | cc by | cc by nc nd(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-nc-sa | 0.9 | cc by | cc by nc sa(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-nc | 0.9 | cc by | cc by nc(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-nd | 0.9 | cc by | cc by nd(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-sa | 0.9 | cc by | cc by sa(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by | 0.9 | cc by | cc by(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-nc-nd | 0.9 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-nc-sa | 0.9 | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-nc | 0.9 | creative commons attribution | creative commons attribution non ?commercial(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-nd | 0.9 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-sa | 0.9 | creative commons attribution | creative commons attribution share ?alike(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by | 0.9 | creative commons attribution | creative commons attribution(?: (?P<v>4 0|3 0|2 5|2 0|1 0))?
cc-by-nc-nd | 0.9 | creativecommons org licenses | creativecommons org licenses by nc nd(?: (?P<v>\d \d))?
cc-by-nc-sa | 0.9 | creativecommons org licenses | creativecommons org licenses by nc sa(?: (?P<v>\d \d))?
cc-by-nc | 0.9 | creativecommons org licenses | creativecommons org licenses by nc(?: (?P<v>\d \d))?
cc-by-nd | 0.9 | creativecommons org licenses | creativecommons org licenses by nd(?: (?P<v>\d \d))?
cc-by-sa | 0.9 | creativecommons org licenses | creativecommons org licenses by sa(?: (?P<v>\d \d))?
cc-by | 0.9 | creativecommons org licenses | creativecommons org licenses by(?: (?P<v>\d \d))?
cc0-1.0 | 0.9 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 0.9 | creative commons zero | creative commons zero(?: v?1 0)?(?: universal)?
cc0-1.0 | 0.9 | creativecommons org publicdomain | creativecommons org publicdomain zero
cc-pdm | 0.9 | public domain mark | (?:creative commons )?public domain mark(?: 1 0)?
cc | 0.6 | creative commons | (?:a |the )?creative commons licen[cs]e
cc | 0.6 | licence creative commons
"""

#: Identifiers that tools write into files. Label, name after the mark.
MARKS = r"""
apache-2.0 | apache 2 0
mit | mit
bsd-2 | bsd 2 clause
bsd-3 | bsd 3 clause
isc | isc
gpl-2.0 | gpl 2 0(?: only| or later)?
gpl-3.0 | gpl 3 0(?: only| or later)?
lgpl-2.1 | lgpl 2 1(?: only| or later)?
lgpl-3.0 | lgpl 3 0(?: only| or later)?
agpl-3.0 | agpl 3 0(?: only| or later)?
mpl-2.0 | mpl 2 0
epl-2.0 | epl 2 0
cc0-1.0 | cc0 1 0
cc-by-4.0 | cc by 4 0
cc-by-sa-4.0 | cc by sa 4 0
unlicense | unlicense
zlib | zlib
boost-1.0 | bsl 1 0
0bsd | 0bsd
"""

#: Notices that grant or reserve rights without naming a licence.
NOTICES = r"""
reserved | 0.8 | all rights reserved
reserved | 0.8 | alle rechte vorbehalten
reserved | 0.8 | tous droits réservés
reserved | 0.8 | todos los derechos reservados
reserved | 0.8 | some rights reserved
reserved | 0.9 | may be reproduced | no part of this (?:publication|book|work|document|site) may be reproduced
reserved | 0.8 | without permission | (?:reproduction|use|copying|distribution) without (?:prior )?(?:written )?permission (?:is )?(?:strictly )?(?:prohibited|forbidden)
reserved | 0.8 | unauthorized | unauthorized (?:copying|reproduction|distribution|use) (?:of this (?:\S+ ){1,4})?is (?:strictly )?prohibited
reserved | 0.8 | prior written permission | without the (?:express )?prior written permission of
reserved | 0.7 | do not distribute
copyright | 0.5 | copyright | copyright (?:c |© )?(?:by )?(?:19|20)\d\d\b
copyright | 0.5 | © | © (?:19|20)\d\d\b
copyright | 0.4 | copyrighted material
public-domain | 0.9 | public domain | (?:released|dedicated|placed|is|are) (?:in |in?to )?the public domain
public-domain | 0.7 | no known copyright restrictions
proprietary | 0.9 | confidential | proprietary and confidential
proprietary | 0.9 | confidential | confidential and proprietary
proprietary | 0.8 | trade secrets | (?:contains|are) trade secrets of
proprietary | 0.8 | end user license agreement
noncommercial | 0.6 | commercial use | (?:not for|non|no) commercial use
noncommercial | 0.7 | for non commercial use | for non commercial use only
noncommercial | 0.7 | personal use only | (?:for )?(?:your )?personal use only
research-only | 0.8 | research purposes only | (?:for )?(?:academic |non commercial )?research purposes only
research-only | 0.7 | for research use only
attribution | 0.5 | with attribution | (?:free )?to (?:use|share|copy) (?:and adapt )?with attribution
warranty | 0.4 | as is | (?:is |are )?provided (?:by \S+ (?:\S+ ){0,6})?as is (?:and |without )
warranty | 0.4 | without warranty of any | without warranty of any kind
warranty | 0.4 | without warranties | without warranties or conditions of any kind
"""

#: What stands before the identifiers of MARKS.
MARK = "spdx license identifier"
#: Right before a detection, words that grant the licence: its weight is 1.
GRANT = re.compile(r"(?:^| )(?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:by|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?$")
#: Characters before a detection in which GRANT is looked for.
BEFORE = 64


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order: texts and identifiers before names, names before notices."""
    out = []
    for priority, table in ((4, BODIES), (3, NAMES), (3, COMMONS), (1, NOTICES)):
        for label, weight, keyword, *pattern in (line.split(" | ") for line in table.strip().split("\n")):
            out.append(Rule(label, priority, keyword, pattern[0] if pattern else keyword, float(weight)))
    for label, name in (line.split(" | ") for line in MARKS.strip().split("\n")):
        out.append(Rule(label, 4, MARK, f"{MARK} {name}", 1.0))
    return tuple(out)


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        #: Of each keyword, the rules that it opens.
        self.opens: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.opens.setdefault(r.keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for key in self.opens:
            self.automaton.add_word(f" {key}", key)
        self.automaton.make_automaton()
        self.compiled: dict[int, re.Pattern] = {}

    def detections(self, joined: str) -> list[tuple[int, int, str, float]]:
        """Of words joined by one space: begin, end, label and weight of what isn't suppressed."""
        there = {key for _, key in self.automaton.iter(f" {joined}")}
        found = []
        for i in sorted(i for key in there for i in self.opens[key]):
            p = self.compiled.get(i)
            if p is None:
                p = self.compiled[i] = re.compile(rf"(?<![^ ])(?:{self.rules[i].pattern})(?![^ ])")
            found += [(m.start(), m.end(), i, m.groupdict().get("v")) for m in p.finditer(joined)]
        # the suppressing come first; what an interval held so far contains goes
        found.sort(key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[2], d[0]))
        held = []
        covers = _Covers()
        for s, e, i, version in found:
            if not covers.contain(s, e):
                covers.add(s, e)
                rule = self.rules[i]
                granted = rule.priority > 1 and GRANT.search(joined, max(0, s - BEFORE), s)
                label = f"{rule.label}-{version.replace(' ', '.')}" if version else rule.label
                held.append((s, e, label, 1.0 if granted else rule.weight))
        return sorted(held)


class _Covers:
    """Intervals none of which contains another, sorted; so the one that contains [s, e) best is the last that begins at s or before."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def contain(self, s: int, e: int) -> bool:
        k = bisect_right(self.begins, s)
        return bool(k) and self.ends[k - 1] >= e

    def add(self, s: int, e: int) -> None:
        k = bisect_left(self.begins, s)
        j = k
        while j < len(self.begins) and self.ends[j] <= e:
            j += 1
        self.begins[k:j], self.ends[k:j] = [s], [e]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    spaced = text.encode().translate(_LOWER).translate(_TO_SPACE) if text else b""
    words = spaced.split()
    at: list[int] = []
    base = set()
    labels: dict[str, float] = {}
    if words:
        joined = b" ".join(words)
        padded = b" " + joined + b" "
        for phrase, label in BASE:
            needle = f" {phrase} ".encode()
            p, counted, word = padded.find(needle), 0, 0
            while p >= 0:
                word, counted = word + padded.count(b" ", counted, p), p
                at.append(word)
                base.add(label)
                p = padded.find(needle, p + 1)
        for _, _, label, weight in scanner().detections(joined.decode()):
            labels[label] = max(labels.get(label, 0.0), weight)
    for label in base:
        labels.setdefault(label, 0.6)
    score = max(labels.values(), default=0.0)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


OUTPUTS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]


def license_scan(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with OUTPUTS: places of the base phrases in words from 0, labels of them and of the rules, and the surest label's weight."""
    kept, schema = with_columns_schema(docs, [n for n, _ in OUTPUTS], OUTPUTS)
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(a, 512)
                values = list(zip(*[scan(x) for x in part.column(text_col).to_pylist()], strict=True)) or [[]] * 7
                columns = {n: pa.array(v, t) for (n, _), v, t in zip(OUTPUTS, values, types, strict=True)}
                yield append(part if keep_text else part.drop_columns([text_col]), columns)

    return map_in_arrow(kept, run, schema)
