"""Signature rules of licences, hand-written in a short notation of word patterns.

A line is ``label | priority | keyword | pattern``. In a pattern, words stand apart; ``a/b`` is one of several words, a ``?``
behind makes it optional, ``#`` is a number, ``~n`` is up to n words of any kind. The keyword is a word that every match holds:
a text without it is never matched. Priority 3 is a grant or an identifier, 2 a full name or a typical sentence, 1 a mention.
"""

from __future__ import annotations

import re
from typing import NamedTuple

RULES_TEXT = """
mit | 3 | mit | spdx license identifier mit
mit | 3 | mit | licensed/released/distributed/available/published under the? terms? of? the? mit license/licence
mit | 3 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 2 | merge | use copy modify merge publish distribute sublicense and or sell copies
mit | 2 | noninfringement | warranties of merchantability fitness for a particular purpose and noninfringement
mit | 2 | mit | the? mit license/licence
mit | 2 | expat | the? expat license/licence
mit | 1 | mit | mit style/like license/licence
mit | 1 | mit | mit licensed
mit-0 | 3 | mit | spdx license identifier mit 0
mit-0 | 2 | attribution | mit no attribution
x11 | 2 | x11 | the? x11 license/licence
x11 | 2 | consortium | x consortium ~12 not be used in advertising
apache-2.0 | 3 | apache | spdx license identifier apache 2 0
apache-2.0 | 3 | apache | licensed under the apache license version 2 0?
apache-2.0 | 3 | apache | released/distributed/available/published under the? terms? of? the? apache license/licence version? 2 0?
apache-2.0 | 3 | compliance | you may not use this file except in compliance with the license
apache-2.0 | 2 | apache | apache software? license/licence version? v2/2 0?
apache-2.0 | 2 | apache | apache 2 0? license/licence
apache-2.0 | 2 | apache | www apache org licenses license 2 0
apache-1.1 | 2 | apache | apache software? license/licence version? 1 1
apache-1.0 | 2 | apache | apache software? license/licence version? 1 0
apache | 1 | apache | apache license/licence
apache | 1 | apache | apache licensed
bsd-2-clause | 3 | bsd | spdx license identifier bsd 2 clause
bsd-3-clause | 3 | bsd | spdx license identifier bsd 3 clause
bsd-4-clause | 3 | bsd | spdx license identifier bsd 4 clause
0bsd | 3 | 0bsd | spdx license identifier 0bsd
0bsd | 2 | bsd | zero clause bsd license/licence?
bsd-2-clause | 2 | bsd | bsd 2/two clause license/licence?
bsd-2-clause | 2 | bsd | 2/two clause bsd license/licence?
bsd-2-clause | 2 | bsd | simplified bsd license/licence?
bsd-2-clause | 2 | freebsd | freebsd license/licence
bsd-3-clause | 2 | bsd | bsd 3/three clause license/licence?
bsd-3-clause | 2 | bsd | 3/three clause bsd license/licence?
bsd-3-clause | 2 | bsd | new/modified/revised bsd license/licence
bsd-3-clause | 2 | endorse | neither the name of ~12 may be used to endorse or promote products
bsd-4-clause | 2 | bsd | bsd 4/four clause license/licence?
bsd-4-clause | 2 | bsd | original/old bsd license/licence
bsd-4-clause | 2 | advertising | all advertising materials mentioning features or use of this software
bsd | 3 | bsd | licensed/released/distributed/available/published under the? terms? of? a/the? bsd license/licence
bsd | 2 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 2 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 1 | bsd | bsd style/like? license/licence
bsd | 1 | bsd | bsd licensed
isc | 3 | isc | spdx license identifier isc
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | the? isc license/licence
zlib | 3 | zlib | spdx license identifier zlib
zlib | 2 | zlib | zlib libpng? license/licence
zlib | 2 | misrepresented | the origin of this software must not be misrepresented
libpng | 2 | libpng | libpng license/licence version? 2?
boost-1.0 | 3 | bsl | spdx license identifier bsl 1 0
boost-1.0 | 3 | boost | distributed under the boost software license version 1 0
boost-1.0 | 2 | boost | boost software license/licence version? 1? 0?
gpl-1.0 | 3 | gpl | spdx license identifier gpl 1 0 only/or? later?
gpl-2.0 | 3 | gpl | spdx license identifier gpl 2 0 only?
gpl-2.0+ | 3 | gpl | spdx license identifier gpl 2 0 or later
gpl-3.0 | 3 | gpl | spdx license identifier gpl 3 0 only?
gpl-3.0+ | 3 | gpl | spdx license identifier gpl 3 0 or later
gpl-2.0+ | 3 | general | gnu general public license ~10 either version 2 of the license or at your option any later version
gpl-3.0+ | 3 | general | gnu general public license ~10 either version 3 of the license or at your option any later version
gpl-1.0 | 2 | general | gnu? general public license/licence version/v 1 0?
gpl-2.0 | 2 | general | gnu? general public license/licence version/v 2 0?
gpl-3.0 | 2 | general | gnu? general public license/licence version/v 3 0?
gpl-2.0 | 2 | general | gnu? general public license/licence v2 0?
gpl-3.0 | 2 | general | gnu? general public license/licence v3 0?
gpl-2.0+ | 2 | general | gnu? general public license/licence version? 2 0? or any? later version?
gpl-3.0+ | 2 | general | gnu? general public license/licence version? 3 0? or any? later version?
gpl-2.0 | 2 | gpl | gnu? gpl version/v 2 0?
gpl-3.0 | 2 | gpl | gnu? gpl version/v 3 0?
gpl-2.0 | 2 | gpl | gnu? gpl v2/2 0?
gpl-3.0 | 2 | gpl | gnu? gpl v3/3 0?
gpl-2.0 | 2 | gplv2 | gnu? gplv2
gpl-3.0 | 2 | gplv3 | gnu? gplv3
gpl-2.0 | 2 | gpl2 | gnu? gpl2
gpl-3.0 | 2 | gpl3 | gnu? gpl3
gpl | 3 | general | licensed/released/distributed/available/published under the? terms? of? the? gnu? general public license/licence
gpl | 3 | gpl | licensed/released/distributed/available/published under the? terms? of? the? gnu? gpl
gpl | 2 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 2 | gnu | see the gnu general public license for more details
gpl | 2 | gnu | you should have received a copy of the gnu general public license
gpl | 1 | general | gnu? general public license/licence
gpl | 1 | gpl | gnu gpl
gpl | 1 | gpl | gpl license/licence/licensed/compatible
gpl-exception | 2 | classpath | classpath exception
gpl-exception | 2 | linking | gpl ~4 linking exception
lgpl-2.0 | 3 | lgpl | spdx license identifier lgpl 2 0 only?
lgpl-2.0+ | 3 | lgpl | spdx license identifier lgpl 2 0 or later
lgpl-2.1 | 3 | lgpl | spdx license identifier lgpl 2 1 only?
lgpl-2.1+ | 3 | lgpl | spdx license identifier lgpl 2 1 or later
lgpl-3.0 | 3 | lgpl | spdx license identifier lgpl 3 0 only?
lgpl-3.0+ | 3 | lgpl | spdx license identifier lgpl 3 0 or later
lgpl-2.1 | 2 | lesser | gnu? lesser general public license/licence version/v? 2 1
lgpl-3.0 | 2 | lesser | gnu? lesser general public license/licence version/v? 3 0?
lgpl-2.1+ | 3 | lesser | gnu lesser general public license ~10 either version 2 1 of the license or at your option any later version
lgpl-3.0+ | 3 | lesser | gnu lesser general public license ~10 either version 3 of the license or at your option any later version
lgpl-2.0 | 2 | library | gnu? library general public license/licence version? v? 2? 0?
lgpl-2.1 | 2 | lgpl | gnu? lgpl version? v2/2 1
lgpl-3.0 | 2 | lgpl | gnu? lgpl version? v3/3 0?
lgpl-2.1 | 2 | lgplv2 | gnu? lgplv2 1?
lgpl-3.0 | 2 | lgplv3 | gnu? lgplv3
lgpl | 2 | lesser | gnu? lesser general public license/licence
lgpl | 1 | lgpl | gnu? lgpl
agpl-1.0 | 2 | affero | affero general public license/licence version? v1/1 0?
agpl-3.0 | 3 | agpl | spdx license identifier agpl 3 0 only?
agpl-3.0+ | 3 | agpl | spdx license identifier agpl 3 0 or later
agpl-3.0 | 2 | affero | gnu? affero general public license/licence version? v3/3 0?
agpl-3.0 | 2 | agpl | gnu? agpl version? v3/3 0?
agpl-3.0 | 2 | agplv3 | gnu? agplv3
agpl | 2 | affero | gnu? affero general public license/licence
agpl | 1 | agpl | gnu? agpl
gfdl-1.1 | 2 | documentation | gnu? free documentation license/licence version? 1 1
gfdl-1.2 | 2 | documentation | gnu? free documentation license/licence version? 1 2
gfdl-1.3 | 2 | documentation | gnu? free documentation license/licence version? 1 3
gfdl | 3 | documentation | licensed/released/distributed/available/published under the? terms? of? the? gnu? free documentation license/licence
gfdl | 2 | documentation | gnu? free documentation license/licence
gfdl | 1 | gfdl | gnu? gfdl
mpl-1.0 | 3 | mpl | spdx license identifier mpl 1 0
mpl-1.1 | 3 | mpl | spdx license identifier mpl 1 1
mpl-2.0 | 3 | mpl | spdx license identifier mpl 2 0
mpl-2.0 | 3 | mozilla | subject to the terms of the mozilla public license v/version? 2 0
mpl-1.1 | 3 | mozilla | subject to the mozilla public license version 1 1
mpl-1.0 | 2 | mozilla | mozilla public license/licence version/v? 1 0
mpl-1.1 | 2 | mozilla | mozilla public license/licence version/v? 1 1
mpl-2.0 | 2 | mozilla | mozilla public license/licence version/v? 2 0?
mpl | 1 | mozilla | mozilla public license/licence
epl-1.0 | 3 | epl | spdx license identifier epl 1 0
epl-2.0 | 3 | epl | spdx license identifier epl 2 0
epl-1.0 | 2 | eclipse | eclipse public license/licence version/v? v1/1 0?
epl-2.0 | 2 | eclipse | eclipse public license/licence version/v? v2/2 0?
epl | 1 | eclipse | eclipse public license/licence
edl-1.0 | 2 | eclipse | eclipse distribution license/licence version/v? v1/1? 0?
cddl-1.0 | 3 | cddl | spdx license identifier cddl 1 0
cddl-1.1 | 3 | cddl | spdx license identifier cddl 1 1
cddl-1.0 | 2 | distribution | common development and distribution license/licence version? 1 0
cddl-1.1 | 2 | distribution | common development and distribution license/licence version? 1 1
cddl | 2 | distribution | common development and distribution license/licence
cpl-1.0 | 2 | common | common public license/licence version? v? 1? 0?
ipl-1.0 | 2 | ibm | ibm public license/licence version? 1? 0?
eupl-1.1 | 2 | european | european union public license/licence v/version? 1 1
eupl-1.2 | 2 | european | european union public license/licence v/version? 1 2
eupl | 1 | eupl | eupl v/version? 1? #?
osl-3.0 | 2 | open | open software license/licence version? v? 3 0
afl-3.0 | 2 | academic | academic free license/licence version? v? 3 0
afl-2.1 | 2 | academic | academic free license/licence version? v? 2 1
artistic-1.0 | 2 | artistic | artistic license/licence version? 1 0
artistic-2.0 | 2 | artistic | artistic license/licence version? 2 0
artistic | 1 | artistic | the? artistic license/licence
python-2.0 | 2 | python | python software foundation license/licence version? 2?
psf | 1 | psf | psf license/licence
ruby | 2 | ruby | ruby license/licence
ruby | 2 | ruby | same terms as ruby itself
perl | 2 | perl | same terms as perl itself
perl | 1 | perl | perl license/licence
php-3.0 | 2 | php | php license/licence version? 3 0
php-3.01 | 2 | php | php license/licence version? 3 01
ntp | 2 | ntp | ntp license/licence
postgresql | 2 | postgresql | postgresql license/licence
openssl | 2 | openssl | openssl license/licence
sleepycat | 2 | sleepycat | sleepycat license/licence
w3c | 2 | w3c | w3c software notice and license
w3c | 2 | w3c | w3c document license/licence
ofl-1.0 | 2 | sil | sil open font license/licence version? 1 0
ofl-1.1 | 2 | sil | sil open font license/licence version? 1 1
ofl-1.1 | 3 | ofl | spdx license identifier ofl 1 1
ofl | 1 | font | open font license/licence
unlicense | 3 | unlicense | spdx license identifier unlicense
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | the unlicense
wtfpl | 2 | wtfpl | wtfpl version? 2?
cc0-1.0 | 3 | cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 3 | cc0 | released/licensed/dedicated/available under cc0 1? 0?
cc0-1.0 | 2 | cc0 | cc0 1 0 universal?
cc0-1.0 | 2 | creative | creative commons zero v1/1? 0? universal?
cc0 | 1 | cc0 | cc0
public-domain | 3 | domain | dedicated to the public domain
public-domain | 3 | domain | released/placed/put in/into the public domain
public-domain | 2 | domain | this work is in the public domain
public-domain | 1 | domain | public domain
cc-by-1.0 | 2 | cc | cc by 1 0
cc-by-2.0 | 2 | cc | cc by 2 0
cc-by-2.5 | 2 | cc | cc by 2 5
cc-by-3.0 | 2 | cc | cc by 3 0
cc-by-4.0 | 2 | cc | cc by 4 0
cc-by-sa-1.0 | 2 | cc | cc by sa 1 0
cc-by-sa-2.0 | 2 | cc | cc by sa 2 0
cc-by-sa-2.5 | 2 | cc | cc by sa 2 5
cc-by-sa-3.0 | 2 | cc | cc by sa 3 0
cc-by-sa-4.0 | 2 | cc | cc by sa 4 0
cc-by-nd-2.0 | 2 | cc | cc by nd 2 0
cc-by-nd-3.0 | 2 | cc | cc by nd 3 0
cc-by-nd-4.0 | 2 | cc | cc by nd 4 0
cc-by-nc-2.0 | 2 | cc | cc by nc 2 0
cc-by-nc-3.0 | 2 | cc | cc by nc 3 0
cc-by-nc-4.0 | 2 | cc | cc by nc 4 0
cc-by-nc-sa-2.0 | 2 | cc | cc by nc sa 2 0
cc-by-nc-sa-3.0 | 2 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 2 | cc | cc by nc sa 4 0
cc-by-nc-nd-2.0 | 2 | cc | cc by nc nd 2 0
cc-by-nc-nd-3.0 | 2 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 2 | cc | cc by nc nd 4 0
cc-by-sa | 1 | cc | cc by sa
cc-by-nd | 1 | cc | cc by nd
cc-by-nc | 1 | cc | cc by nc
cc-by-nc-sa | 1 | cc | cc by nc sa
cc-by-nc-nd | 1 | cc | cc by nc nd
cc-by | 1 | cc | cc by
cc-by-3.0 | 2 | creative | creative commons attribution 3 0 unported/international? license/licence?
cc-by-4.0 | 2 | creative | creative commons attribution 4 0 international? public? license/licence?
cc-by-sa-3.0 | 2 | creative | creative commons attribution share/sharealike alike? 3 0 unported/international? license/licence?
cc-by-sa-4.0 | 2 | creative | creative commons attribution share/sharealike alike? 4 0 international? public? license/licence?
cc-by-nd-4.0 | 2 | creative | creative commons attribution no/noderivatives derivatives/derivs? 4 0 international? license/licence?
cc-by-nc-3.0 | 2 | creative | creative commons attribution non/noncommercial commercial? 3 0 unported? license/licence?
cc-by-nc-4.0 | 2 | creative | creative commons attribution non/noncommercial commercial? 4 0 international? license/licence?
cc-by-nc-sa-4.0 | 2 | creative | creative commons attribution non/noncommercial commercial? share/sharealike alike? 4 0 international? license/licence?
cc-by-nc-nd-4.0 | 2 | creative | creative commons attribution non/noncommercial commercial? no/noderivatives derivatives/derivs? 4 0 international? license/licence?
cc-by | 3 | creative | licensed/released/distributed/available/published under a/the? terms? of? a/the? creative commons attribution license/licence
cc-by | 1 | creative | creative commons attribution license/licence?
cc-by-sa | 1 | creative | creative commons attribution share/sharealike alike? license/licence?
cc-by-nc | 1 | creative | creative commons attribution non/noncommercial commercial? license/licence?
cc | 1 | creative | creative commons license/licence?
cc-by-4.0 | 2 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | 2 | creativecommons | creativecommons org licenses by 3 0
cc-by-sa-4.0 | 2 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 2 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 2 | creativecommons | creativecommons org licenses by nc 4 0
cc0-1.0 | 2 | creativecommons | creativecommons org publicdomain zero 1 0
odbl-1.0 | 2 | odbl | odbl v/version? v1/1? 0?
odbl-1.0 | 2 | database | open database license/licence v1/1? 0?
odc-by-1.0 | 2 | commons | open data commons attribution license/licence v1/1? 0?
pddl-1.0 | 2 | dedication | public domain dedication and license/licence v1/1? 0?
cdla-permissive | 2 | permissive | community data license agreement permissive version? v? #? 0?
cdla-sharing | 2 | sharing | community data license agreement sharing version? v? #? 0?
ogl-uk-3.0 | 2 | government | open government license/licence v3/3? 0?
ms-pl | 2 | microsoft | microsoft public license/licence
ms-rl | 2 | microsoft | microsoft reciprocal license/licence
busl-1.1 | 2 | business | business source license/licence v/version? 1? 1?
sspl-1.0 | 2 | server | server side public license/licence v/version? v1/1? 0?
elastic-2.0 | 2 | elastic | elastic license/licence v/version? v2/2? 0?
commons-clause | 2 | clause | commons clause license/licence? condition? v1/1? 0?
polyform | 2 | polyform | polyform noncommercial/shield/strict/perimeter/small license/licence? 1? 0?
openrail | 2 | openrail | openrail m? license/licence?
llama | 2 | llama | llama ~2 community license/licence agreement?
json | 2 | evil | the software shall be used for good not evil
beerware | 2 | beerware | beerware license/licence?
beerware | 2 | beer | beer ware license/licence
vim | 2 | vim | vim license/licence
proprietary | 3 | confidential | proprietary and confidential
proprietary | 3 | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 2 | proprietary | proprietary license/licence/software
proprietary | 2 | reproduced | no part of this publication may be reproduced
proprietary | 2 | permission | may not be reproduced ~6 without the? prior? express? written permission
proprietary | 2 | eula | end user license/licence agreement eula
proprietary | 1 | agreement | end user license/licence agreement
reserved | 2 | reserved | copyright ~8 all rights reserved
reserved | 1 | reserved | all rights reserved
some-reserved | 1 | reserved | some rights reserved
no-reserved | 1 | reserved | no rights reserved
noncommercial | 2 | commercial | for non commercial use only
noncommercial | 2 | noncommercial | for noncommercial use only
noncommercial | 2 | personal | for personal use only
copyright | 1 | copyright | copyright c? # ~4
copyright | 1 | copyright | copyright holder/holders/owner/owners/notice
source-identifier | 1 | spdx | spdx license identifier ~1
"""  # fmt: skip


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    keyword: str
    pattern: str


def word_pattern(notation: str) -> str:
    """The regular expression of a pattern, over a text written as ``<word><word>...``; Java and RE2 read it alike."""

    def one(part: str) -> str:
        optional = part.endswith("?")
        part = part.removesuffix("?")
        if part.startswith("~"):
            return f"(?:<[^>]*>){{0,{part[1:]}}}"
        found = "<[0-9]+>" if part == "#" else f"<{part}>" if "/" not in part else f"<(?:{part.replace('/', '|')})>"
        return f"(?:{found})?" if optional else found

    return "".join(map(one, notation.split()))


def read_rules(text: str) -> list[Rule]:
    lines = [[p.strip() for p in line.split(" | ")] for line in text.strip().splitlines()]
    return [Rule(i, label, int(priority), keyword, word_pattern(pattern)) for i, (label, priority, keyword, pattern) in enumerate(lines)]


RULES = read_rules(RULES_TEXT)
assert all(re.search(rf"<{r.keyword}>(?!\)\?)", r.pattern) for r in RULES), "every match must hold its keyword"
