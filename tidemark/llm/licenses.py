"""License scanning with ordered signature rules.

A text becomes words separated by one blank.  Rules are regular expressions over that
form, ordered by priority: first sentences of license texts, written out by hand, then
names of license families in five forms of notice, with versions before plain names.
Each rule has a keyword, words of their own in the text, without which its expression is
not tried.  Every match is an interval; an interval contained in another detection's is
suppressed if that one is longer or of better priority, so the most specific reading of
a passage stays.  Everything is DataFrame expressions inside a row: no shuffle and no
explosion of texts.  Texts (nearly all) without the first word of any keyword are told
apart on the raw text and only have their words counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import ascii_lower

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels that are always reported.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License families as (label, keyword, name as a regular expression, versions).
FAMILIES = [
    ("agpl", "affero", "(?:gnu )?affero general public license", ("1", "3")),
    ("agpl", "agpl", "agpl", ("1", "3")),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license", ("2 1", "3")),
    ("lgpl", "library general", "(?:gnu )?library general public license", ("2",)),
    ("lgpl", "lgpl", "lgpl", ("2", "2 1", "3")),
    ("gpl", "general public license", "(?:gnu )?general public license", ("1", "2", "3")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1", "2", "3")),
    ("gfdl", "documentation", "(?:gnu )?free documentation license", ("1 1", "1 2", "1 3")),
    ("gfdl", "gfdl", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache(?: software)? licen[sc]e", ("1 0", "1 1", "2", "2 0")),
    ("mit", "mit", "mit(?: x11)? licen[sc]e", ()),
    ("x11", "x11", "x11 licen[sc]e", ()),
    ("bsd-4-clause", "bsd", "(?:original bsd|4 clause bsd|bsd 4 clause)(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause)(?: licen[sc]e)?", ()),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|2 clause bsd|bsd 2 clause)(?: licen[sc]e)?", ()),
    ("bsd-2-clause", "freebsd", "freebsd licen[sc]e", ()),
    ("0bsd", "zero clause bsd", "zero clause bsd(?: licen[sc]e)?", ()),
    ("bsd", "bsd", "bsd licen[sc]e", ()),
    ("cc-by-nc-nd", "cc by", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc by", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "noncommercial", "(?:creative commons )?attribution noncommercial noderiv(?:ative)?s", ("3 0", "4 0")),
    ("cc-by-nc-sa", "noncommercial", "(?:creative commons )?attribution noncommercial sharealike", ("3 0", "4 0")),
    ("cc-by-nc", "noncommercial", "(?:creative commons )?attribution noncommercial", ("3 0", "4 0")),
    ("cc-by-sa", "sharealike", "(?:creative commons )?attribution sharealike", ("3 0", "4 0")),
    ("cc-by", "creative commons", "creative commons attribution", ("3 0", "4 0")),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc0", "creative commons", "creative commons zero", ("1 0",)),
    ("mpl", "mozilla", "mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[sc]e", ("1 0", "2 0")),
    ("eupl", "european union", "european union public licen[sc]e", ("1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 1", "1 2")),
    ("cddl", "common development", "common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cpl", "common public", "common public licen[sc]e", ("1 0",)),
    ("artistic", "artistic", "artistic licen[sc]e", ("1 0", "2 0")),
    ("boost", "boost", "boost software licen[sc]e", ("1 0",)),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", ()),
    ("isc", "isc", "isc licen[sc]e", ()),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("postgresql", "postgresql", "postgresql licen[sc]e", ()),
    ("python", "python", "python software foundation licen[sc]e", ("2",)),
    ("php", "php", "php licen[sc]e", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby licen[sc]e", ()),
    ("openssl", "openssl", "openssl licen[sc]e", ()),
    ("ofl", "font", "(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("odbl", "database", "open database licen[sc]e", ("1 0",)),
    ("odc-by", "commons", "open data commons attribution licen[sc]e", ("1 0",)),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", ()),
    ("public-domain", "domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", ()),
    ("proprietary", "reserved", "all rights reserved", ()),
]
# Forms of a notice, from the most to the least certain: (expression around the name, confidence).
FORMS = [
    ("(?:dual )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}{version}", 1.0),
    ("(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}{version}", 0.95),
    ("spdx licen[sc]e identifier {name}{version}", 1.0),
    ("(?:or|and) {name}{version}", 0.9),
    ("{name}{version}", 0.8),
]


# Sentences of license texts and deeds, as label, keyword and expression over words between blanks.
TEXTS = [
    tuple(x.strip() for x in line.split(" | "))
    for line in r"""
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font|database)
mit | sublicense | (?:rights|right) to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | authors | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | mit | (?:this (?:software|project|library|package|code|work) is|is) (?:licensed|released|distributed) under (?:the )?mit
mit | mit | mit licensed
mit-0 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-0 | mit | mit no attribution
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | consortium | x consortium is not liable|the x consortium be liable for any claim
hpnd | advertising | the name of (?:[^ ]+ ){1,8}not be used in advertising or publicity pertaining to distribution of the software
isc | fee | permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc | disclaims | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse | neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | endorse | the names? of (?:[^ ]+ ){1,12}may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | contributors | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd | regents | this software is provided by the regents and contributors as is|copyright (?:c )?(?:[0-9]+ )*the regents of the university of california
bsd-2-clause-patent | patent | redistribution and use in source and binary forms (?:[^ ]+ ){1,60}each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except for failure to satisfy the conditions of this license )?patent license
bsd-3-clause-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
bsd | bsd | use of this source code is governed by a bsd style license
bsd-3-clause | bsd | bsd style license that can be found in the license file
apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | apache | you may obtain a copy of the license at https? www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | asis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an asis basis
apache | conditions | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache | apache | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | apache | apache license version 2 0 january 2004
apache-2.0 | reproduction | terms and conditions for use reproduction and distribution 1 definitions license shall mean
apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
apache-2.0 | notice | if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy
apache-1.1 | apache | this product includes software developed by the apache software foundation
apache-1.1 | apache | products derived from this software may not be called apache
gpl | gnu | free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2-only | gnu | under the terms of (?:the gnu general public license version 2|version 2 of the gnu general public license) (?:only )?as published by the free software foundation
gpl-3-only | gnu | under the terms of (?:the gnu general public license version 3|version 3 of the gnu general public license) (?:only )?as published by the free software foundation
gpl | gnu | you should have received a copy of the gnu general public license along with this (?:program|software|library|file)
gpl | gnu | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
gpl-2 | gnu | gnu general public license version 2 june 1991
gpl-3 | gnu | gnu general public license version 3 29 june 2007
gpl-1 | gnu | gnu general public license version 1 february 1989
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2 | freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl-3 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3 | convey | you may convey verbatim copies of the program s source code as you receive it in any medium
gpl-3 | convey | to convey a work means any kind of propagation that enables other parties to make or receive copies
gpl-2 | verbatim | you may copy and distribute verbatim copies of the program s source code as you receive it in any medium
gpl-2-classpath | exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable
gpl-gcc-exception | exception | gcc runtime library exception|as a special exception (?:[^ ]+ ){1,20}link(?:ed|ing)? (?:[^ ]+ ){1,12}compiled with gcc
lgpl | gnu | under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation
lgpl-2.1-or-later | gnu | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3-or-later | gnu | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2-or-later | gnu | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl | gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with this library
lgpl-2.1 | successor | this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license
lgpl-3 | incorporates | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
agpl-3-or-later | affero | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl | affero | you should have received a copy of the gnu affero general public license along with this program
agpl-3 | affero | gnu affero general public license version 3 19 november 2007
agpl-3 | remotely | all users interacting with it remotely through a computer network
gfdl | invariant | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.3 | documentation | gnu free documentation license version 1 3 3 november 2008
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1 the license
mpl-1.0 | mozilla | the contents of this file are subject to the mozilla public license version 1 0 the license
mpl | mpl | alternatively the contents of this file may be used under the terms of (?:[^ ]+ ){1,20}under the (?:terms of )?the mpl
mpl-2.0-no-copyleft | incompatible | this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0
npl | netscape | the contents of this file are subject to the netscape public license
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
edl | eclipse | eclipse distribution license
cddl-1.0 | common | the contents of this file are subject to the terms of the common development and distribution license
cddl | cddl | include this cddl header notice in each file|when distributing covered code include this cddl header
cpl-1.0 | common | made available under the terms of the common public license v1 0
ipl | ibm | ibm public license
eupl | eupl | licensed under the eupl version
eupl-1.2 | eupl | eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl
artistic-2.0 | artistic | everyone is permitted to copy and distribute verbatim copies of this license document (?:[^ ]+ ){1,20}artistic license 2 0|the artistic license 2 0
artistic-1.0 | artistic | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
perl | perl | under the same terms as perl itself
perl | artistic | either the gnu general public license (?:[^ ]+ ){1,16}or the (?:perl )?artistic license
boost-1.0 | boost | distributed under the boost software license version 1 0
boost-1.0 | processor | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | altered | this notice may not be removed or altered from any source distribution
libpng | png | the png reference library is supplied as is
ijg | jpeg | this software is based in part on the work of the independent jpeg group
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense | for more information please refer to https? unlicense org
wtfpl | fuck | do what the fuck you want to public license
wtfpl | fuck | you just do what the fuck you want to
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
postgresql | postgresql | postgresql is released under the postgresql license
postgresql | postgres | postgresql database management system formerly known as postgres
python-2.0 | psf | psf is making python available to licensee on an as is basis
python-2.0 | psf | psf license agreement for python
php | php | this product includes php software freely available from
php-3.01 | php | this source file is subject to version 3 01 of the php license
php-3.0 | php | this source file is subject to version 3 0 of the php license
zpl | zope | zope public license zpl version
zpl-2.1 | zope | this software is subject to the provisions of the zope public license version 2 1 zpl
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric | this product includes cryptographic software written by eric young
openldap | openldap | the openldap public license
curl | stenberg | copyright (?:c )?(?:[0-9]+ )+daniel stenberg
ncsa | ncsa | university of illinois ncsa open source license
ncsa | illinois | developed by (?:[^ ]+ ){1,12}university of illinois at urbana champaign
w3c | w3c | w3c software (?:and document )?notice and license
w3c | w3c | permission to copy modify and distribute this software and its documentation (?:[^ ]+ ){1,16}w3c
unicode | unicode | unicode inc license agreement data files and software
icu | icu | icu license icu 1 8 1 and later
ofl-1.1 | sil | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | font | the font software may be bundled redistributed and or sold with any software|reserved font names? may not be used
ofl-1.1 | font | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
cc0-1.0 | waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc0-1.0 | waived | to the extent possible under law (?:[^ ]+ ){1,12}ha(?:s|ve) waived all copyright and related or neighboring rights
cc0-1.0 | creativecommons | https? creativecommons org publicdomain zero 1 0
cc-pdm | creativecommons | https? creativecommons org publicdomain mark 1 0
cc-by-4.0 | creativecommons | https? creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | https? creativecommons org licenses by 3 0
cc-by-2.5 | creativecommons | https? creativecommons org licenses by 2 5
cc-by-2.0 | creativecommons | https? creativecommons org licenses by 2 0
cc-by-sa-4.0 | creativecommons | https? creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons | https? creativecommons org licenses by sa 3 0
cc-by-sa-2.0 | creativecommons | https? creativecommons org licenses by sa 2 0
cc-by-nc-4.0 | creativecommons | https? creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | creativecommons | https? creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | creativecommons | https? creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | creativecommons | https? creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | creativecommons | https? creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | creativecommons | https? creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | creativecommons | https? creativecommons org licenses by nc nd 3 0
cc-by-4.0 | creative | this work is licensed under a creative commons attribution 4 0 international license
cc-by-3.0 | creative | this work is licensed under a creative commons attribution 3 0 (?:unported|united states) license
cc-by-sa-4.0 | creative | this work is licensed under a creative commons attribution sharealike 4 0 international license
cc-by-sa-3.0 | creative | this work is licensed under a creative commons attribution share ?alike 3 0 (?:unported|united states) license
cc-by-nc-4.0 | creative | this work is licensed under a creative commons attribution noncommercial 4 0 international license
cc-by-nd-4.0 | creative | this work is licensed under a creative commons attribution noderivatives 4 0 international license
cc-by-nc-sa-4.0 | creative | this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license
cc-by-nc-nd-4.0 | creative | this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license
cc | creative | some rights reserved under a creative commons license|licensed under a creative commons license
odbl-1.0 | database | this (?:[^ ]+ ){1,6}is made available under the open database license
odbl-1.0 | opendatacommons | https? (?:www )?opendatacommons org licenses odbl
odc-by-1.0 | opendatacommons | https? (?:www )?opendatacommons org licenses by 1 0
pddl-1.0 | opendatacommons | https? (?:www )?opendatacommons org licenses pddl
pddl-1.0 | dedication | public domain dedication and license
ogl-uk-3.0 | government | contains public sector information licensed under the open government licence v3 0
ogl-uk | government | open government licence
cdla-permissive | community | community data license agreement permissive
cdla-sharing | community | community data license agreement sharing
ms-pl | microsoft | this license governs use of the accompanying software (?:[^ ]+ ){1,20}microsoft public license|microsoft public license ms pl
ms-rl | microsoft | microsoft reciprocal license
bsl-1.1 | business | business source license 1 1
bsl-1.1 | change | effective on the change date
bsl-1.1 | grant | additional use grant
sspl | side | server side public license
elastic-2.0 | elastic | elastic license 2 0
elastic-2.0 | hosted | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons | commons clause license condition
polyform-nc | polyform | polyform noncommercial license
polyform | polyform | polyform (?:small business|shield|strict|internal use|perimeter|free trial) license
json | evil | the software shall be used for good not evil
hippocratic | hippocratic | hippocratic license
openrail | responsible | open responsible ai license|responsible ai license
openrail-m | rail | (?:creativeml |bigscience )?open rail m license
openrail-m | openrail | (?:creativeml |bigscience )?openrail m license
llama-community | llama | llama [0-9 ]*community license agreement
gemma | gemma | gemma terms of use
public-domain | domain | (?:this (?:work|file|software|document|text) is|has been) (?:placed |released |dedicated )?(?:in|into|to) the public domain
public-domain | copyright | the authors? (?:hereby )?(?:disclaims?|waives?) copyright to this (?:source code|work)
public-domain | government | work of the (?:u s|us|united states) government|(?:u s|united states) government work
proprietary | proprietary | proprietary and confidential
proprietary | prohibited | unauthori[sz]ed copying of this file via any medium is strictly prohibited
proprietary | prohibited | unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:[^ ]+ ){1,12}(?:is )?(?:strictly )?prohibited
proprietary | reserved | all rights (?:are )?reserved no part of this (?:publication|book|work|document) may be reproduced
proprietary | confidential | this (?:file|document|software) (?:contains|is) confidential and proprietary information
proprietary | reproduced | may not be reproduced (?:[^ ]+ ){1,12}without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent) of
mit | spdx | spdx licen[sc]e identifier mit
isc | spdx | spdx licen[sc]e identifier isc
zlib | spdx | spdx licen[sc]e identifier zlib
apache-2.0 | spdx | spdx licen[sc]e identifier apache 2 0
boost-1.0 | spdx | spdx licen[sc]e identifier bsl 1 0
ofl-1.1 | spdx | spdx licen[sc]e identifier ofl 1 1
python-2.0 | spdx | spdx licen[sc]e identifier python 2 0
postgresql | spdx | spdx licen[sc]e identifier postgresql
apache-2.0 | apache | (?:or|and) apache 2 0
noncommercial | commercial | for non commercial (?:use|purposes) only|free for non commercial use
noncommercial | noncommercial | for noncommercial (?:use|purposes) only|free for noncommercial use
academic | academic | for academic (?:use|purposes|research) only
personal | personal | free for personal use(?: only)?
""".strip().splitlines()
]


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, keyword, expression, label, confidence) in order: texts, then names, with a version before plain, by form.

    Expressions are over words between single blanks; a match starts and ends at a blank.
    """
    out = [(keyword, f"(?:{e})", label, 1.0) for label, keyword, e in TEXTS]
    for versioned in (True, False):
        for form, confidence in FORMS:
            for label, keyword, name, versions in FAMILIES:
                for v in versions if versioned else ("",):
                    # "v3", "version 3", "3", and for "2" as well "2.0"
                    tail = f" (?:v|version )?{v}{'' if ' ' in v else '(?: 0)?'}" if versioned else ""
                    full = f"{label}-{v.replace(' ', '.')}" if versioned else label
                    out.append((keyword, form.format(name=name, version=tail), full, confidence - (0 if versioned else 0.1)))
    return [(i, k, f"(?<= ){e}(?= )", label, round(c, 2)) for i, (k, e, label, c) in enumerate(out)]


def alternatives(words: list[str]) -> str:
    """An expression for any of the words that looks at each letter once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    out = []
    for head, rest in sorted(heads.items()):
        more = [r for r in rest if r]
        tail = "" if not more else f"(?:{alternatives(more)})" + ("?" if len(more) < len(rest) else "")
        out.append(head + tail)
    return "|".join(out)


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _quoted(text: str) -> str:
    return "r'" + text + "'"  # no rule holds a quote


def rule_table(rows: list[tuple[int, str, str, str, float]]) -> Column:
    """The rules by keyword, as one literal: an array of (keyword between blanks, its first word, rules)."""
    groups: dict[str, list[str]] = {}
    # A blank that is matched is found faster than one that is looked back at; intervals then start after it.
    rows = [(i, k, " " + e.removeprefix("(?<= )"), label, c) for i, k, e, label, c in rows]
    for priority, keyword, expression, label, confidence in rows:
        rule = f"named_struct('priority', {priority}, 'expression', {_quoted(expression)}, 'label', {_quoted(label)}, 'confidence', {confidence}D)"
        groups.setdefault(keyword, []).append(rule)
    return F.expr("array(" + ", ".join(f"named_struct('keyword', ' {k} ', 'word', '{k.split()[0]}', 'rules', array({', '.join(r)}))" for k, r in groups.items()) + ")")


_DETECTION = "struct<start:int,end:int,priority:int,first_word:int,n_words:int,label:string,confidence:double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(items: Column, fold: Callable[[Column], Column]) -> Column:
    """For each item the ``fold`` (a sum or a maximum) of those before it.

    Items are cut into about as many blocks as each has items: a place takes the fold of
    the blocks before its own and of the items before it there, so n items cost n ** 1.5.
    """

    def by_blocks(wide: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / wide).cast("int")), lambda b: fold(F.slice(items, b * wide + 1, wide)))

        def place(earlier: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                b = F.floor(i / wide).cast("int")
                return fold(F.array(F.get(earlier, b), fold(F.slice(items, b * wide + 1, i - b * wide))))

            return F.transform(items, one)

        return let(let(blocks, lambda all_blocks: F.transform(all_blocks, lambda _, b: fold(F.slice(all_blocks, F.lit(1), b)))), place)

    return F.when(F.size(items) > 0, let(F.ceil(F.sqrt(F.size(items))).cast("int"), by_blocks)).otherwise(F.array().cast("array<int>"))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def _largest(items: Column) -> Column:
    return F.coalesce(F.array_max(items), F.lit(0))


def detections(norm: Column, table: Column, words: Column) -> Column:
    """Matches of all rules whose keyword occurs: an array of (start, end, priority, first_word, n_words, label, confidence).

    ``words`` are the first words of keywords that occur.  Places are running sums over
    the pieces between and within a rule's matches, each of which is measured once.
    """

    def matches(rule: Column) -> Column:
        def intervals(found: Column) -> Column:
            between = F.slice(F.split(norm, rule["expression"], -1), 1, F.size(found))
            both = lambda measure: F.zip_with(between, found, lambda gap, hit: measure(gap) + measure(hit))
            ends = F.zip_with(between, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), _blanks(gap).alias("gap_words"), F.length(hit).alias("hit"), _blanks(hit).alias("hit_words")))

            def interval(m: Column, at: Column) -> Column:
                start = at["place"] + m["gap"]
                return F.struct(
                    (start + 1).alias("start"), (start + m["hit"]).alias("end"), rule["priority"].alias("priority"), (at["word"] + m["gap_words"]).alias("first_word"),
                    m["hit_words"].alias("n_words"), rule["label"].alias("label"), rule["confidence"].alias("confidence"),
                )

            at = F.zip_with(let(both(F.length), lambda x: before(x, _sum)), let(both(_blanks), lambda x: before(x, _sum)), lambda place, word: F.struct(place.alias("place"), word.alias("word")))
            return F.when(F.size(found) > 0, F.zip_with(ends, at, interval)).otherwise(F.array().cast(f"array<{_DETECTION}>"))

        return let(F.regexp_extract_all(norm, rule["expression"], F.lit(0)), intervals)

    present = F.filter(table, lambda g: F.array_contains(words, g["word"]) & F.contains(norm, g["keyword"]))
    return F.flatten(F.transform(F.flatten(F.transform(present, lambda g: g["rules"])), matches))


def unsuppressed(found: Column) -> Column:
    """Detections not contained in a longer one, nor in an equal one of better priority, in the order of the text.

    In the order of start, falling end and priority, what contains a detection comes
    before it, so that one is contained if an earlier one ends as late.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d.alias("d"))))

    def kept(rows: Column) -> Column:
        reach = let(F.transform(rows, lambda o: -o["back"]), lambda e: before(e, _largest))
        marked = F.zip_with(rows, reach, lambda o, r: F.struct(o["d"].alias("d"), (-o["back"] > r).alias("kept")))
        return F.transform(F.filter(marked, lambda m: m["kept"]), lambda m: m["d"])

    return let(ordered, kept)


def base_places(norm: Column, n_words: Column) -> Column:
    """(n, first, last, labels) of the base phrases: what lies before a phrase's first and after its last place counts words."""

    def phrase(words: str, label: str) -> Column:
        def place(parts: Column) -> Column:
            hit = F.size(parts) > 1
            last = n_words - len(words.split()) - (_blanks(F.element_at(parts, -1)) - 1)
            return F.struct(
                (F.size(parts) - 1).cast("long").alias("n"), F.when(hit, _blanks(F.element_at(parts, 1)).cast("long")).alias("first"),
                F.when(hit, last.cast("long")).alias("last"), F.when(hit, F.lit(label)).alias("label"),
            )

        return let(F.split(norm, f" {words}(?= )", -1), place)

    def summed(p: Column) -> Column:
        labels = F.array_sort(F.array_distinct(F.array_compact(F.transform(p, lambda x: x["label"]))))
        return F.struct(
            F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), F.array_min(F.transform(p, lambda x: x["first"])).alias("first"),
            F.array_max(F.transform(p, lambda x: x["last"])).alias("last"), labels.alias("labels"),
        )

    return let(F.array(*[phrase(w, label) for w, label in BASE.items()]), summed)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, licenses) of every row.

    Words are runs of ASCII letters and digits and non-ASCII characters of the text with
    A-Z lower-cased.  ``licenses`` lists the kept detections in the order of the text as
    (first_word, n_words, label, confidence); ``labels`` holds their labels and the base ones; ``score`` is the
    largest confidence, 0.5 for base phrases alone, 0 without any.  A null or empty text
    has no words and no labels; texts of any length are read whole.  Repeated rows are
    scanned each; other columns are not read; an empty table gives an empty one.
    """
    rows = rules()
    # Words of which every rule and every base phrase needs one, on the raw text (its case is the only difference).
    gate = sorted({k.split()[0] for _, k, *_ in rows} | {"gnu", "apache", "cc", "mit"})
    word = r"0-9A-Za-z\x80-\x{10FFFF}"
    gated = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gated = gated.select("doc_id", "text", F.col("text").rlike(rf"(?i)(?<![{word}])(?:{alternatives(gate)})(?![{word}])").alias("may"))

    # The others' words are what lies between runs of other characters, but for an empty piece at either end.
    pieces = let(
        F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1),
        lambda p: F.size(p) - (F.element_at(p, 1) == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int"),
    )
    nothing, none = F.lit(""), F.lit(None).cast("long")
    kept_type = "array<struct<first_word:int,n_words:int,label:string,confidence:double>>"
    plain = gated.where(~F.col("may")).select(
        "doc_id", pieces.cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"),
        nothing.alias("base_labels"), nothing.alias("labels"), F.lit(0.0).alias("score"), F.array().cast(kept_type).alias("licenses"),
    )

    def outcome(n_words: Column, base: Column, kept: Column) -> Column:
        own = F.transform(kept, lambda d: d["label"])
        score = F.greatest(F.coalesce(F.array_max(F.transform(kept, lambda d: d["confidence"])), F.lit(0.0)), F.when(base["n"] > 0, 0.5).otherwise(0.0))
        return F.struct(
            n_words.alias("n_words"), base["n"].alias("n_base"), base["first"].alias("first_word"), base["last"].alias("last_word"),
            F.array_join(base["labels"], ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base["labels"], own)), ",").alias("labels"),
            score.alias("score"), kept.alias("licenses"),
        )

    def read(norm: Column) -> Column:
        count = F.when(F.length(norm) == 2, F.lit(0)).otherwise(_blanks(norm) - 1).cast("long")
        words = F.array_distinct(F.regexp_extract_all(norm, F.lit(f" ({alternatives(gate)})(?= )"), F.lit(1)))
        kept = let(let(words, lambda w: detections(norm, rule_table(rows), w)), lambda found: F.transform(unsuppressed(found), lambda d: F.struct(*[d[c].alias(c) for c in ("first_word", "n_words", "label", "confidence")])))
        return let(count, lambda n: let(base_places(norm, n), lambda base: let(kept, lambda k: outcome(n, base, k))))

    split = F.regexp_replace(ascii_lower(F.col("text")), NOT_WORD, " ")
    # A text that begins or ends with other characters has one blank too many there.
    norm = F.concat(F.lit(" "), F.trim(split), F.lit(" "))
    full = gated.where("may").select("doc_id", let(norm, read).alias("r")).select("doc_id", "r.*")
    return full.unionByName(plain)
