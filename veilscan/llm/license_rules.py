"""Signature rules of the license scan: each written by hand, as label | keyword | priority | pattern over lower-case words.

A pattern stands for words with one space between; its keyword is a run of words that every match of it holds, the last
of them in part where a star follows. Priorities:
100 identifiers, 90 to 98 wording of a license text, 80 to 88 grants, 60 to 75 names, 30 to 50 notices.
"""

RULES = """
apache-2.0 | apache | 88 | licensed under the apache license(?: version)? 2(?: 0)?
apache-2.0 | apache | 86 | (?:released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?license(?: version)? 2(?: 0)?
apache-2.0 | apache | 75 | apache (?:software )?license(?: version| v)? 2(?: 0)?
apache-2.0 | apache | 70 | apache 2 0(?: license)?
apache-2.0 | apache org licenses | 92 | (?:https? )?(?:www )?apache org licenses license 2 0
apache-2.0 | agreed to in writing | 96 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | in compliance with the license | 94 | you may not use this (?:file|software|work) except in compliance with the license
apache-2.0 | apache license version 2 0 | 90 | apache license version 2 0 january 2004
apache-1.1 | apache | 76 | apache (?:software )?license(?: version| v)? 1 1
apache-1.1 | apache software foundation | 92 | this product includes software developed by the apache software foundation
apache-1.0 | apache | 76 | apache (?:software )?license(?: version| v)? 1 0
apache-1.0 | apache group | 92 | this product includes software developed by the apache group
apache | apache | 80 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[cs]e
apache | apache | 60 | apache (?:software )?licen[cs]e
mit | permission is hereby granted free of charge | 96 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice and this permission notice | 95 | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit | without warranty of any kind express or implied | 92 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | mit | 80 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:x11 |expat )?mit(?: x11)? licen[cs]e
mit | mit | 60 | (?:the )?mit(?: x11| expat)? licen[cs]e
mit | expat | 60 | expat licen[cs]e
x11 | x11 | 61 | x11 licen[cs]e
x11 | x consortium | 93 | except as contained in this notice the name of the x consortium shall not be used in advertising
mit-0 | mit | 76 | mit no attribution(?: licen[cs]e)?
mit-0 | mit | 76 | mit 0 licen[cs]e
bsd | redistribution and use in source and binary forms | 94 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions of source code must retain | 93 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce | 93 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | neither the name of | 96 | neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause | neither the name of | 95 | neither the name of the copyright holder nor the names of its contributors may be used
bsd-4-clause | all advertising materials | 96 | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-2-clause | bsd | 76 | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)?
bsd-3-clause | bsd | 76 | (?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|revised|modified) bsd)(?: licen[cs]e)?
bsd-4-clause | bsd | 76 | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?
bsd-0-clause | bsd | 76 | (?:bsd (?:0|zero) clause|(?:0|zero) clause bsd)(?: licen[cs]e)?
bsd-0-clause | 0bsd | 74 | 0bsd
bsd | bsd | 80 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?bsd(?: style)? licen[cs]e
bsd | bsd | 60 | bsd(?: style)? licen[cs]e
bsd | berkeley software distribution | 62 | berkeley software distribution(?: bsd)? licen[cs]e
isc | permission to use copy modify and | 95 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | isc | 80 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?isc licen[cs]e
isc | isc | 60 | isc licen[cs]e
isc | internet s* | 62 | internet (?:systems|software) consortium licen[cs]e
bsd-0-clause | permission to use copy modify and | 97 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
gpl-3.0 | general public license | 90 | gnu general public license version 3 29 june 2007
gpl-2.0 | general public license | 90 | gnu general public license version 2 june 1991
gpl-1.0 | general public license | 90 | gnu general public license version 1 february 1989
gpl-3.0 | general public license | 88 | (?:gnu )?general public license(?: version| v)? 3(?: 0)?
gpl-2.0 | general public license | 88 | (?:gnu )?general public license(?: version| v)? 2(?: 0)?
gpl-1.0 | general public license | 88 | (?:gnu )?general public license(?: version| v)? 1(?: 0)?
gpl-3.0-or-later | general public license | 96 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | general public license | 96 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0-only | general public license | 95 | gnu general public license version 2 as published by the free software foundation
gpl-3.0-only | general public license | 95 | gnu general public license version 3 as published by the free software foundation
gpl | this program is free software | 92 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | general public license | 82 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public license
gpl | you should have received a copy of the gnu general public license | 90 | you should have received a copy of the gnu general public license along with this program
gpl | general public licence | 60 | (?:gnu )?general public licence
gpl-3.0 | gplv3 | 76 | gplv3
gpl-2.0 | gplv2 | 76 | gplv2
gpl-3.0 | gpl | 76 | (?:gnu )?gpl(?: version| v)? 3(?: 0)?
gpl-2.0 | gpl | 76 | (?:gnu )?gpl(?: version| v)? 2(?: 0)?
gpl-1.0 | gpl | 76 | (?:gnu )?gpl(?: version| v)? 1(?: 0)?
gpl | gpl | 80 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
gpl | gpl | 60 | (?:gnu )?gpl licen[cs]e
gpl-classpath-exception | classpath exception | 94 | (?:gnu )?classpath exception
gpl-classpath-exception | linking this library | 96 | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-gcc-exception | gcc runtime library exception | 94 | gcc runtime library exception
gpl-font-exception | font exception | 90 | gpl font exception
gpl-linking-exception | linking exception | 88 | gpl linking exception
lgpl-3.0 | lesser general public license | 89 | (?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?
lgpl-2.1 | lesser general public license | 89 | (?:gnu )?lesser general public license(?: version| v)? 2 1
lgpl-2.0 | library general public license | 89 | (?:gnu )?library general public license(?: version| v)? 2(?: 0)?
lgpl-2.1-or-later | lesser general public license | 97 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | lesser general public license | 97 | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl | lesser general public license | 83 | (?:gnu )?(?:library or )?lesser general public license
lgpl | library general public license | 83 | (?:gnu )?library general public license
lgpl | this library is free software | 93 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-3.0 | lgplv3 | 76 | lgplv3
lgpl-2.1 | lgplv2 | 76 | lgplv2(?: 1)?
lgpl-3.0 | lgpl | 76 | (?:gnu )?lgpl(?: version| v)? 3(?: 0)?
lgpl-2.1 | lgpl | 76 | (?:gnu )?lgpl(?: version| v)? 2 1
lgpl | lgpl | 62 | (?:gnu )?lgpl(?: licen[cs]e)?
agpl-3.0 | affero general public license | 90 | (?:gnu )?affero general public license(?: version| v)? 3(?: 0)?
agpl-1.0 | affero general public license | 90 | affero general public license(?: version| v)? 1(?: 0)?
agpl-3.0-or-later | affero general public license | 97 | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl | affero general public license | 84 | (?:gnu )?affero general public license
agpl | remote network interaction | 96 | remote network interaction use with the gnu general public license
agpl-3.0 | agplv3 | 76 | agplv3
agpl-3.0 | agpl | 76 | (?:gnu )?agpl(?: version| v)? 3(?: 0)?
agpl | agpl | 62 | (?:gnu )?agpl(?: licen[cs]e)?
gfdl-1.3 | free documentation license | 88 | (?:gnu )?free documentation license(?: version| v)? 1 3
gfdl-1.2 | free documentation license | 88 | (?:gnu )?free documentation license(?: version| v)? 1 2
gfdl-1.1 | free documentation license | 88 | (?:gnu )?free documentation license(?: version| v)? 1 1
gfdl | free documentation license | 84 | (?:gnu )?free documentation license
gfdl | invariant sections | 92 | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | mozilla public license | 88 | mozilla public license(?: version| v)? 2 0
mpl-1.1 | mozilla public license | 88 | mozilla public license(?: version| v)? 1 1
mpl-1.0 | mozilla public license | 88 | mozilla public license(?: version| v)? 1 0
mpl-2.0 | this source code form | 96 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | the contents of this file are subject to the mozilla public license | 96 | the contents of this file are subject to the mozilla public license version 1 1
mpl | mozilla public license | 64 | mozilla public license
mpl | mozilla public licence | 64 | mozilla public licence
mpl-2.0 | mozilla org mpl | 90 | mozilla org mpl 2 0
epl-2.0 | eclipse public license | 88 | eclipse public license(?: version| v)? 2 0
epl-1.0 | eclipse public license | 88 | eclipse public license(?: version| v)? 1 0
epl | eclipse public license | 64 | eclipse public license
epl | eclipse org legal | 85 | eclipse org legal epl v[12]0
edl-1.0 | eclipse distribution license | 88 | eclipse distribution license(?: version| v)? 1 0
cddl-1.0 | common development and distribution license | 88 | common development and distribution license(?: cddl)?(?: version| v)? 1 0
cddl-1.1 | common development and distribution license | 88 | common development and distribution license(?: cddl)?(?: version| v)? 1 1
cddl | common development and distribution license | 64 | common development and distribution license
cddl | cddl | 60 | cddl(?: licen[cs]e)?
cpl-1.0 | common public license | 88 | common public license(?: version| v)? 1 0
cpl | common public license | 64 | common public license
ipl-1.0 | ibm public license | 88 | ibm public license(?: version| v)? 1 0
eupl-1.2 | european union public licen* | 88 | european union public licen[cs]e(?: eupl)?(?: version| v)? 1 2
eupl-1.1 | european union public licen* | 88 | european union public licen[cs]e(?: eupl)?(?: version| v)? 1 1
eupl | eupl | 62 | eupl(?: v)?(?: 1 [012])?
artistic-2.0 | artistic license | 88 | (?:the )?artistic license(?: version| v)? 2 0
artistic-1.0 | artistic license | 88 | (?:the )?artistic license(?: version| v)? 1 0
artistic | artistic license | 62 | (?:the )?(?:perl )?artistic license
perl | same terms as perl | 92 | (?:under )?the same terms as perl itself
boost-1.0 | boost software license | 88 | boost software license(?: version)? 1 0
boost | boost software license | 64 | boost software license
boost-1.0 | obtaining a copy of the software and accompanying documentation | 96 | any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib | altered source versions | 96 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | the origin of this software must not be misrepresented | 96 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | in no event will the authors be held liable | 90 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | zlib | 62 | zlib(?: libpng)? licen[cs]e
libpng | libpng | 64 | (?:the )?libpng licen[cs]e
libpng | png reference library | 64 | (?:the )?png reference library licen[cs]e
ijg | independent jpeg group | 86 | this software is based in part on the work of the independent jpeg group
unlicense | released into the public domain | 96 | this is free and unencumbered software released into the public domain
unlicense | unlicense | 70 | (?:the )?unlicense(?: license)?
unlicense | unlicense org | 88 | unlicense org
wtfpl-2.0 | do what the fuck you want to public license | 94 | do what the fuck you want to public license(?: version 2)?
wtfpl | wtfpl | 66 | wtfpl(?: licen[cs]e)?
cc0-1.0 | cc0 | 88 | (?:creative commons )?cc0 1 0(?: universal)?
cc0 | cc0 | 76 | cc0(?: licen[cs]e| public domain dedication)?
cc0-1.0 | publicdomain zero | 92 | publicdomain zero 1 0
cc0-1.0 | dedicated the work to the public domain | 94 | the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights
public-domain | public domain | 84 | (?:dedicated to|released into|placed in(?:to)?|in) the public domain
public-domain | public domain | 70 | public domain (?:dedication|mark|software|work)
cc-by-4.0 | cc by | 78 | cc by 4 0
cc-by-3.0 | cc by | 78 | cc by 3 0
cc-by-2.5 | cc by | 78 | cc by 2 5
cc-by-2.0 | cc by | 78 | cc by 2 0
cc-by-1.0 | cc by | 78 | cc by 1 0
cc-by-sa-4.0 | cc by sa | 82 | cc by sa 4 0
cc-by-sa-3.0 | cc by sa | 82 | cc by sa 3 0
cc-by-sa-2.5 | cc by sa | 82 | cc by sa 2 5
cc-by-sa-2.0 | cc by sa | 82 | cc by sa 2 0
cc-by-sa-1.0 | cc by sa | 82 | cc by sa 1 0
cc-by-sa | cc by sa | 58 | cc by sa
cc-by-nc-4.0 | cc by nc | 82 | cc by nc 4 0
cc-by-nc-3.0 | cc by nc | 82 | cc by nc 3 0
cc-by-nc-2.5 | cc by nc | 82 | cc by nc 2 5
cc-by-nc-2.0 | cc by nc | 82 | cc by nc 2 0
cc-by-nc | cc by nc | 57 | cc by nc
cc-by-nd-4.0 | cc by nd | 82 | cc by nd 4 0
cc-by-nd-3.0 | cc by nd | 82 | cc by nd 3 0
cc-by-nd | cc by nd | 58 | cc by nd
cc-by-nc-sa-4.0 | cc by nc sa | 86 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc by nc sa | 86 | cc by nc sa 3 0
cc-by-nc-sa-2.5 | cc by nc sa | 86 | cc by nc sa 2 5
cc-by-nc-sa | cc by nc sa | 62 | cc by nc sa
cc-by-nc-nd-4.0 | cc by nc nd | 86 | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc by nc nd | 86 | cc by nc nd 3 0
cc-by-nc-nd | cc by nc nd | 62 | cc by nc nd
cc-by-4.0 | creative commons attribution | 80 | creative commons attribution(?: international)?(?: license)?(?: version)? 4 0(?: international)?(?: license)?
cc-by-3.0 | creative commons attribution | 80 | creative commons attribution(?: license)?(?: version)? 3 0(?: unported)?(?: license)?
cc-by-2.0 | creative commons attribution | 80 | creative commons attribution(?: license)?(?: version)? 2 0(?: generic)?(?: license)?
cc-by-sa-4.0 | creative commons attribution share* | 84 | creative commons attribution share ?alike(?: license)?(?: version)? 4 0(?: international)?(?: license)?
cc-by-sa-3.0 | creative commons attribution share* | 84 | creative commons attribution share ?alike(?: license)?(?: version)? 3 0(?: unported)?(?: license)?
cc-by-sa | creative commons attribution share* | 66 | creative commons attribution share ?alike
cc-by-nc-4.0 | creative commons attribution non* | 84 | creative commons attribution non ?commercial(?: license)?(?: version)? 4 0(?: international)?(?: license)?
cc-by-nc-3.0 | creative commons attribution non* | 84 | creative commons attribution non ?commercial(?: license)?(?: version)? 3 0(?: unported)?(?: license)?
cc-by-nc | creative commons attribution non* | 65 | creative commons attribution non ?commercial
cc-by-nc-sa-4.0 | creative commons attribution non* | 87 | creative commons attribution non ?commercial share ?alike(?: license)?(?: version)? 4 0(?: international)?(?: license)?
cc-by-nc-sa-3.0 | creative commons attribution non* | 87 | creative commons attribution non ?commercial share ?alike(?: license)?(?: version)? 3 0(?: unported)?(?: license)?
cc-by-nc-sa | creative commons attribution non* | 68 | creative commons attribution non ?commercial share ?alike
cc-by-nd-4.0 | creative commons attribution no* | 84 | creative commons attribution no ?deriv(?:ative)?s?(?: license)?(?: version)? 4 0(?: international)?(?: license)?
cc-by-nd | creative commons attribution no* | 66 | creative commons attribution no ?deriv(?:ative)?s?
cc-by-nc-nd-4.0 | creative commons attribution non* | 87 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: license)?(?: version)? 4 0(?: international)?(?: license)?
cc-by-nc-nd | creative commons attribution non* | 68 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by | creative commons attribution | 56 | creative commons attribution(?: licen[cs]e)?
cc | creative commons | 45 | (?:under )?(?:a|the) creative commons licen[cs]e
cc-by-4.0 | creativecommons org licenses by | 92 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org licenses by | 92 | creativecommons org licenses by 3 0
cc-by-sa-4.0 | creativecommons org licenses by sa | 93 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org licenses by sa | 93 | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | creativecommons org licenses by nc | 93 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa | 94 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd | 94 | creativecommons org licenses by nc nd 4 0
odbl-1.0 | open database license | 86 | (?:open data commons )?open database license(?: odbl)?(?: version| v)?(?: 1 0)?
odbl-1.0 | odbl | 66 | odbl(?: 1 0)?
odc-by-1.0 | open data commons attribution | 86 | open data commons attribution license(?: version| v)?(?: 1 0)?
pddl-1.0 | public domain dedication and license | 88 | (?:open data commons )?public domain dedication and license(?: pddl)?
ogl-3.0 | open government licen* | 86 | open government licen[cs]e(?: version| v)? 3 0
ogl-2.0 | open government licen* | 86 | open government licen[cs]e(?: version| v)? 2 0
ogl | open government licen* | 66 | open government licen[cs]e
cdla-permissive-2.0 | community data license agreement | 88 | community data license agreement permissive(?: version)? 2 0
cdla-sharing-1.0 | community data license agreement | 88 | community data license agreement sharing(?: version)? 1 0
ofl-1.1 | open font license | 88 | (?:sil )?open font license(?: version| v)? 1 1
ofl-1.0 | open font license | 88 | (?:sil )?open font license(?: version| v)? 1 0
ofl | open font license | 64 | (?:sil )?open font license
ofl-1.1 | reserved font name | 92 | with reserved font name
python-2.0 | python software foundation license | 86 | python software foundation license(?: version| v)?(?: 2)?
python-2.0 | psf | 62 | psf licen[cs]e(?: agreement)?
python-2.0 | this license agreement is between the python software foundation | 96 | this license agreement is between the python software foundation
cnri | corporation for national research initiatives | 88 | corporation for national research initiatives
php-3.01 | php license | 86 | php license(?: version| v)? 3 01
php-3.0 | php license | 86 | php license(?: version| v)? 3 0
php | php license | 62 | php license
ruby | ruby license | 62 | ruby license
openssl | openssl license | 64 | openssl license
openssl | openssl toolkit | 92 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | 92 | this product includes cryptographic software written by eric young
postgresql | postgresql licen* | 64 | postgresql licen[cs]e
curl | curl license | 62 | curl license
ncsa | university of illinois | 86 | university of illinois(?: ncsa)? open source license
ms-pl | microsoft public license | 86 | microsoft public license(?: ms pl)?
ms-rl | microsoft reciprocal license | 86 | microsoft reciprocal license(?: ms rl)?
afl-3.0 | academic free license | 88 | academic free license(?: version| v)? 3 0
afl-2.1 | academic free license | 88 | academic free license(?: version| v)? 2 1
afl | academic free license | 64 | academic free license
osl-3.0 | open software license | 88 | open software license(?: version| v)? 3 0
osl | open software license | 64 | open software license
apsl-2.0 | apple public source license | 88 | apple public source license(?: version| v)? 2 0
qpl-1.0 | q public license | 88 | q public license(?: version| v)?(?: 1 0)?
sleepycat | sleepycat | 66 | sleepycat license
vim | vim license | 64 | vim license
w3c | w3c software | 86 | w3c software(?: notice and| and document)? license
unicode | unicode license | 66 | unicode license(?: agreement)?
sspl-1.0 | server side public license | 90 | server side public license(?: version| v)?(?: 1)?
busl-1.1 | business source license | 90 | business source license(?: version| v)?(?: 1 1)?
elastic-2.0 | elastic license | 86 | elastic license(?: version| v)?(?: 2 0)?
commons-clause | commons clause | 88 | commons clause(?: license condition)?(?: v1 0)?
polyform | polyform | 84 | polyform (?:noncommercial|small business|shield|perimeter|strict|internal use) license(?: 1 0 0)?
openrail | openrail | 82 | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
llama-community | community license agreement | 88 | llama(?: [0-9]+)?(?: [0-9]+)? community license agreement
mulan-psl-2.0 | mulan permissive software license | 88 | mulan permissive software license(?: version)? v?2
blue-oak-1.0.0 | blue oak model license | 88 | blue oak model license(?: version)?(?: 1 0 0)?
upl-1.0 | universal permissive license | 88 | universal permissive license(?: upl)?(?: version| v)?(?: 1 0)?
beerware | beerware | 66 | beerware(?: license)?
beerware | buy me a beer | 90 | you can buy me a beer in return
json | good not evil | 92 | the software shall be used for good not evil
apache-2.0 | spdx license identifier apache | 100 | spdx license identifier apache 2 0
mit | spdx license identifier mit | 99 | spdx license identifier mit
mit-0 | spdx license identifier mit | 100 | spdx license identifier mit 0
bsd-3-clause | spdx license identifier bsd | 100 | spdx license identifier bsd 3 clause
bsd-2-clause | spdx license identifier bsd | 100 | spdx license identifier bsd 2 clause
gpl-2.0 | spdx license identifier gpl | 99 | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | spdx license identifier gpl | 100 | spdx license identifier gpl 2 0 or later
gpl-3.0 | spdx license identifier gpl | 99 | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | spdx license identifier gpl | 100 | spdx license identifier gpl 3 0 or later
lgpl-2.1 | spdx license identifier lgpl | 99 | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | spdx license identifier lgpl | 100 | spdx license identifier lgpl 2 1 or later
lgpl-3.0 | spdx license identifier lgpl | 99 | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | spdx license identifier lgpl | 100 | spdx license identifier lgpl 3 0 or later
agpl-3.0 | spdx license identifier agpl | 99 | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | spdx license identifier agpl | 100 | spdx license identifier agpl 3 0 or later
mpl-2.0 | spdx license identifier mpl | 100 | spdx license identifier mpl 2 0
isc | spdx license identifier isc | 100 | spdx license identifier isc
cc0-1.0 | spdx license identifier cc0 | 100 | spdx license identifier cc0 1 0
unlicense | spdx license identifier unlicense | 100 | spdx license identifier unlicense
proprietary | proprietary and confidential | 72 | (?:strictly )?proprietary and confidential
proprietary | confidential and proprietary | 72 | confidential and proprietary
proprietary | trade secrets | 74 | contains (?:valuable )?trade secrets
proprietary | unauthorized copying | 84 | unauthorized copying of this (?:file|document|work|software) via any medium is strictly prohibited
proprietary | may not be reproduced | 70 | may not be reproduced (?:or|nor) (?:distributed|transmitted|used) (?:in any form )?without (?:the )?(?:prior |express |written )*(?:permission|consent)
proprietary | end user license agreement | 70 | end user license agreement
non-commercial | non commercial | 62 | (?:for|free for) (?:personal and )?non commercial use(?: only)?
non-commercial | academic use only | 62 | (?:for )?academic use only
free-use | free to use | 40 | free to use(?: and distribute)?
warranty-disclaimer | without warranty of any kind | 48 | without warranty of any kind
warranty-disclaimer | without any warranty | 46 | without any warranty
liability-disclaimer | in no event shall | 48 | in no event shall (?:the )?(?:authors?|copyright holders?)(?: or copyright holders?| or contributors)? be liable
reserved | all rights reserved | 38 | all rights reserved
copyright | copyright | 40 | copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | copyright by | 39 | (?:c )?copyright by
copyright | copyright holder* | 36 | the copyright holders?
copyright | copyrighted | 36 | (?:is|are) copyrighted(?: material)?
see-license | license file | 35 | see (?:the )?license file
see-license | license txt | 35 | see (?:the )?license txt
"""

#: Parts of words of which every match of a rule holds one: texts without any are matched against nothing.
STEMS = [
    "licen", " cc", "commons", "softw", "public", "gpl", "copyright", "bsd", " apache", "warrant", "permi", " spdx", "proprietary", " mit ", "reserved",
    "redistribut", " terms", "exception", "mozilla", "eclipse", " cddl", " eupl", " wtfpl", " odbl", " openrail", " beer", " non commercial", " use",
    " consortium", " front cover", " secret", "linking", "unauthorized", " reproduced", "corporation", " liable", " academic",
]


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority) of every rule."""
    out = []
    for line in RULES.strip().splitlines():
        label, keyword, priority, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, keyword, pattern, int(priority)))
    return out
