r"""License scans by ordered signature rules, in DataFrame and SQL functions only.

Text is lower-cased (A-Z) and reduced to its words with single spaces between. A keyword prefilter decides which texts
and which rules are looked at; each remaining rule's regex, a literal of the plan, runs on the word string. Overlaps are
resolved by priority: a detection goes if it lies in a better one that stays, or holds one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._spans import match_spans, placed_spans
from .secrets import _quoted

#: Everything that is not part of a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: The signature rules, one a line, best priority first: label, confidence, regex over words, keyword that it implies.
#: A label has a version only where the regex demands that version or is wording of that version alone.
SIGNATURES = r"""
apache-2.0 | 1.0 | spdx license identifier apache 2 0 | spdx license identifier apache
apache-1.1 | 1.0 | spdx license identifier apache 1 1 | spdx license identifier apache
mit-0 | 1.0 | spdx license identifier mit 0 | spdx license identifier mit
mit | 1.0 | spdx license identifier mit | spdx license identifier mit
isc | 1.0 | spdx license identifier isc | spdx license identifier isc
0bsd | 1.0 | spdx license identifier 0bsd | spdx license identifier 0bsd
bsd-2-clause | 1.0 | spdx license identifier bsd 2 clause | spdx license identifier bsd
bsd-3-clause | 1.0 | spdx license identifier bsd 3 clause | spdx license identifier bsd
bsd-4-clause | 1.0 | spdx license identifier bsd 4 clause | spdx license identifier bsd
agpl-3.0 | 1.0 | spdx license identifier agpl 3 0(?: only| or later)? | spdx license identifier agpl
lgpl-2.1 | 1.0 | spdx license identifier lgpl 2 1(?: only| or later)? | spdx license identifier lgpl
lgpl-3.0 | 1.0 | spdx license identifier lgpl 3 0(?: only| or later)? | spdx license identifier lgpl
lgpl-2.0 | 1.0 | spdx license identifier lgpl 2 0(?: only| or later)? | spdx license identifier lgpl
gpl-2.0 | 1.0 | spdx license identifier gpl 2 0(?: only| or later)? | spdx license identifier gpl
gpl-3.0 | 1.0 | spdx license identifier gpl 3 0(?: only| or later)? | spdx license identifier gpl
mpl-1.1 | 1.0 | spdx license identifier mpl 1 1 | spdx license identifier mpl
mpl-2.0 | 1.0 | spdx license identifier mpl 2 0 | spdx license identifier mpl
epl-1.0 | 1.0 | spdx license identifier epl 1 0 | spdx license identifier epl
epl-2.0 | 1.0 | spdx license identifier epl 2 0 | spdx license identifier epl
cddl-1.0 | 1.0 | spdx license identifier cddl 1 0 | spdx license identifier cddl
bsl-1.0 | 1.0 | spdx license identifier bsl 1 0 | spdx license identifier bsl
cc0-1.0 | 1.0 | spdx license identifier cc0 1 0 | spdx license identifier cc0
cc-by-nc-sa-4.0 | 1.0 | spdx license identifier cc by nc sa 4 0 | spdx license identifier cc
cc-by-nc-nd-4.0 | 1.0 | spdx license identifier cc by nc nd 4 0 | spdx license identifier cc
cc-by-nc-4.0 | 1.0 | spdx license identifier cc by nc 4 0 | spdx license identifier cc
cc-by-nd-4.0 | 1.0 | spdx license identifier cc by nd 4 0 | spdx license identifier cc
cc-by-sa-4.0 | 1.0 | spdx license identifier cc by sa 4 0 | spdx license identifier cc
cc-by-4.0 | 1.0 | spdx license identifier cc by 4 0 | spdx license identifier cc
unlicense | 1.0 | spdx license identifier unlicense | spdx license identifier unlicense
wtfpl | 1.0 | spdx license identifier wtfpl | spdx license identifier wtfpl
zlib | 1.0 | spdx license identifier zlib | spdx license identifier zlib
artistic-2.0 | 1.0 | spdx license identifier artistic 2 0 | spdx license identifier artistic
eupl-1.2 | 1.0 | spdx license identifier eupl 1 2 | spdx license identifier eupl
postgresql | 1.0 | spdx license identifier postgresql | spdx license identifier postgresql
ofl-1.1 | 1.0 | spdx license identifier ofl 1 1 | spdx license identifier ofl
mit | 0.99 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files | permission is hereby granted
mit | 0.97 | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software | this permission notice
mit | 0.95 | permission is hereby granted free of charge to any person obtaining a copy | permission is hereby granted
mit-0 | 0.9 | mit no attribution(?: license)? | mit no attribution
x11 | 0.9 | except as contained in this notice the name(?: s)? of (?:the )?(?:above )?(?:x consortium|copyright holders?) shall not be used in advertising | except as contained in this notice
isc | 0.99 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies | distribute this software
0bsd | 0.97 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is | distribute this software
isc | 0.9 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted | distribute this software
hpnd | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted | and its documentation
postgresql | 0.95 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | without a written agreement
bsd-4-clause | 0.98 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment | all advertising materials
bsd-3-clause | 0.98 | neither the name of (?:the )?(?:\S+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software | endorse or promote products
bsd-3-clause | 0.9 | may be used to endorse or promote products derived from this software without specific prior written permission | endorse or promote products
bsd-2-clause | 0.9 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation | redistributions in binary form
bsd-2-clause | 0.85 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | redistributions of source code
bsd | 0.85 | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)? | redistribution and use in source
apache-2.0 | 0.99 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license | apache license version 2 0
apache-2.0 | 0.95 | you may not use this file except in compliance with the license | in compliance with the license
apache-2.0 | 0.9 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis | agreed to in writing
apache-2.0 | 0.95 | apache license version 2 0 january 2004 | january 2004
apache-1.1 | 0.97 | this product includes software developed by the apache software foundation | developed by the apache software foundation
gpl-3.0 | 0.99 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 | either version 3
gpl-2.0 | 0.99 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 | either version 2
gpl-2.0 | 0.98 | under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation | general public license version 2
gpl-3.0 | 0.98 | under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation | general public license version 3
lgpl-2.1 | 0.99 | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 | either version 2 1
lgpl-3.0 | 0.99 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 | either version 3
lgpl-2.0 | 0.99 | under the terms of the gnu library general public license as published by the free software foundation either version 2 | either version 2
agpl-3.0 | 0.99 | under the terms of the gnu affero general public license as published by the free software foundation either version 3 | either version 3
agpl-3.0 | 0.97 | under the terms of the gnu affero general public license version 3 as published | affero general public license version 3
gpl-2.0 | 0.97 | gnu general public license version 2 june 1991 | june 1991
gpl-3.0 | 0.97 | gnu general public license version 3 29 june 2007 | 29 june 2007
lgpl-3.0 | 0.97 | gnu lesser general public license version 3 29 june 2007 | 29 june 2007
lgpl-2.1 | 0.97 | gnu lesser general public license version 2 1 february 1999 | february 1999
agpl-3.0 | 0.97 | gnu affero general public license version 3 19 november 2007 | 19 november 2007
gpl | 0.9 | you should have received a copy of the gnu general public license along with this (?:program|library|software|package|file) | received a copy of the gnu general
lgpl | 0.9 | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software|package|file) | you should have received a copy of the gnu
agpl | 0.9 | you should have received a copy of the gnu affero general public license along with this (?:program|library|software|package|file) | received a copy of the gnu affero
gpl | 0.8 | (?:this program|this file|it) is free software you can redistribute it and or modify it | free software you can redistribute
mpl-2.0 | 0.99 | this source code form is subject to the terms of the mozilla public license v 2 0 | source code form
mpl-2.0 | 0.97 | if a copy of the mpl was not distributed with this file you can obtain one at | copy of the mpl
mpl | 0.95 | this source code form is subject to the terms of the mozilla public license | source code form
mpl-1.1 | 0.98 | the contents of this file are subject to the mozilla public license version 1 1 | mozilla public license version 1 1
mpl-1.0 | 0.98 | the contents of this file are subject to the mozilla public license version 1 0 | mozilla public license version 1 0
npl-1.1 | 0.97 | the contents of this file are subject to the netscape public license version 1 1 | netscape public license
cddl | 0.98 | the contents of this file are subject to the terms of the common development and distribution license | common development and distribution
cpal-1.0 | 0.97 | the contents of this file are subject to the common public attribution license version 1 0 | common public attribution
epl-2.0 | 0.98 | made available under the terms of the eclipse public license (?:v |version )?2 0 | eclipse public license
epl-1.0 | 0.98 | made available under the terms of the eclipse public license (?:v |version )?1 0 | eclipse public license
bsl-1.0 | 0.98 | distributed under the boost software license version 1 0 | boost software license
bsl-1.0 | 0.95 | boost software license version 1 0 august 17th 2003 | august 17th 2003
unlicense | 0.99 | this is free and unencumbered software released into the public domain | unencumbered
wtfpl | 0.98 | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed | verbatim or modified copies
zlib | 0.98 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software | will the authors be held liable
zlib | 0.9 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | plainly marked as such
ofl-1.1 | 0.97 | this font software is licensed under the sil open font license version 1 1 | sil open font license
cc0-1.0 | 0.97 | to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights | extent possible under law
cc-by-nc-sa-4.0 | 0.97 | licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international(?: public)? license | creative commons attribution
cc-by-nc-nd-4.0 | 0.97 | licensed under (?:a |the )?creative commons attribution non ?commercial no ?derivatives 4 0 international(?: public)? license | creative commons attribution
cc-by-nc-4.0 | 0.97 | licensed under (?:a |the )?creative commons attribution non ?commercial 4 0 international(?: public)? license | creative commons attribution
cc-by-sa-4.0 | 0.97 | licensed under (?:a |the )?creative commons attribution share ?alike 4 0 international(?: public)? license | creative commons attribution
cc-by-nd-4.0 | 0.97 | licensed under (?:a |the )?creative commons attribution no ?derivatives 4 0 international(?: public)? license | creative commons attribution
cc-by-4.0 | 0.97 | licensed under (?:a |the )?creative commons attribution 4 0 international(?: public)? license | creative commons attribution
cc-by-sa-3.0 | 0.97 | licensed under (?:a |the )?creative commons attribution share ?alike 3 0 unported license | creative commons attribution
cc-by-3.0 | 0.97 | licensed under (?:a |the )?creative commons attribution 3 0 unported license | creative commons attribution
apache-1.1 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?license (?:version |v)?1 1 | 1 1
apache-2.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache (?:license )?(?:version |v)?2(?: 0|(?! \d ))(?: license)? | apache
apache | 0.8 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache(?: software)? license | apache
mit | 0.95 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat) licen[cs]e | under
mit | 0.85 | (?:licensed|released|distributed|available) under (?:the )?mit(?: terms)? | under
isc | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc licen[cs]e | isc
bsd-2-clause | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)? | bsd
bsd-3-clause | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)(?: licen[cs]e)? | bsd
bsd-4-clause | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)? | bsd
bsd | 0.85 | (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)? licen[cs]e | bsd
agpl-3.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0|(?! \d )) | 3
agpl | 0.85 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:affero general public license|agpl) | under
lgpl-2.1 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1 | 2 1
lgpl-3.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0|(?! \d )) | 3
lgpl | 0.85 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lesser general public license|library general public license|lgpl) | under
gpl-2.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0|(?! \d ))(?: or later| only)? | 2
gpl-3.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0|(?! \d ))(?: or later| only)? | 3
gpl | 0.85 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:general public license|gpl) | under
mpl-2.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0|(?! \d )) | 2
mpl-1.1 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:mozilla public license|mpl)(?: version| v)? ?1 1 | 1 1
mpl | 0.8 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:mozilla public license|mpl) | under
epl-2.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:eclipse public license|epl)(?: version| v)? ?2(?: 0|(?! \d )) | 2
epl-1.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:eclipse public license|epl)(?: version| v)? ?1(?: 0|(?! \d )) | 1
cddl-1.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:common development and distribution license|cddl)(?: version| v)? ?1(?: 0|(?! \d )) | under
cddl | 0.85 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:common development and distribution license|cddl) | under
artistic-2.0 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?artistic license(?: version)? 2 0 | artistic
artistic-1.0 | 0.9 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:perl )?artistic license version 1 0 | artistic
artistic | 0.8 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:perl )?artistic license | artistic
perl | 0.95 | under the same terms as perl(?: \d)? itself | terms as perl
ruby | 0.9 | under the same terms as ruby | terms as ruby
bsl-1.0 | 0.95 | (?:licensed|released|available) under (?:the )?boost(?: software)? license(?: version)? 1 0 | boost
bsl | 0.85 | (?:licensed|released|available) under (?:the )?boost(?: software)? license | boost
eupl-1.2 | 0.95 | (?:licensed|released|distributed|available) under (?:the )?(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2 | under
eupl | 0.85 | (?:licensed|released|distributed|available) under (?:the )?(?:european union public licen[cs]e|eupl) | under
unlicense | 0.95 | (?:licensed|released|distributed|available) under the unlicense | unlicense
wtfpl | 0.95 | (?:licensed|released|distributed|available) under (?:the )?wtfpl | wtfpl
zlib | 0.95 | (?:licensed|released|distributed|available) under (?:the )?zlib(?: libpng)? licen[cs]e | zlib
cc0-1.0 | 0.95 | (?:licensed|released|distributed|available|dedicated) under (?:the )?(?:cc0|creative commons (?:cc0|zero)) 1 0(?: universal)? | c
cc0 | 0.85 | (?:licensed|released|distributed|available|dedicated) under (?:the )?(?:cc0|creative commons (?:cc0|zero)) | c
cc-by-nc-sa-4.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by nc sa 4 0 | cc by nc sa
cc-by-nc-sa | 0.85 | (?:licensed|released|distributed|available) under (?:a |the )?cc by nc sa | cc by nc sa
cc-by-nc-nd-4.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by nc nd 4 0 | cc by nc nd
cc-by-nc-nd | 0.85 | (?:licensed|released|distributed|available) under (?:a |the )?cc by nc nd | cc by nc nd
cc-by-nc-4.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by nc 4 0 | cc by nc
cc-by-nc | 0.85 | (?:licensed|released|distributed|available) under (?:a |the )?cc by nc | cc by nc
cc-by-sa-4.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by sa 4 0 | cc by sa
cc-by-sa-3.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by sa 3 0 | cc by sa
cc-by-sa | 0.85 | (?:licensed|released|distributed|available) under (?:a |the )?cc by sa | cc by sa
cc-by-nd-4.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by nd 4 0 | cc by nd
cc-by-nd | 0.85 | (?:licensed|released|distributed|available) under (?:a |the )?cc by nd | cc by nd
cc-by-4.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by 4 0 | cc by
cc-by-3.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by 3 0 | cc by
cc-by-2.0 | 0.95 | (?:licensed|released|distributed|available) under (?:a |the )?cc by 2 [05] | cc by
cc-by | 0.85 | (?:licensed|released|distributed|available) under (?:a |the )?(?:cc by|creative commons attribution)(?: license)? | under
creative-commons | 0.7 | (?:licensed|released|distributed|available) under (?:a |the )?creative commons(?: license)? | creative commons
odbl-1.0 | 0.95 | (?:licensed|released|available) under (?:the )?(?:open database license|odbl)(?: version| v)? ?1 0 | under
odbl | 0.85 | (?:licensed|released|available) under (?:the )?(?:open database license|odbl) | under
postgresql | 0.95 | (?:licensed|released|distributed|available) under the postgresql license | postgresql license
php-3.01 | 0.95 | (?:subject to|under) (?:the )?(?:version )?3 01 of the php license | php license
psf | 0.9 | (?:licensed|released|distributed|available) under the (?:python software foundation|psf) license | license
ms-pl | 0.95 | (?:licensed|released|available) under (?:the )?(?:microsoft public license|ms pl) | under
ms-rl | 0.95 | (?:licensed|released|available) under (?:the )?(?:microsoft reciprocal license|ms rl) | under
agpl-3.0 | 0.85 | gnu affero general public license(?: version| v)? ?3(?: 0|(?! \d )) | affero
agpl | 0.75 | gnu affero general public license | affero
agpl-3.0 | 0.8 | agpl ?v?3(?: 0|(?! \d )) | agpl
lgpl-2.1 | 0.85 | (?:gnu )?lesser general public license(?: version| v)? ?2 1 | lesser general
lgpl-3.0 | 0.85 | (?:gnu )?lesser general public license(?: version| v)? ?3(?: 0|(?! \d )) | lesser general
lgpl-2.0 | 0.8 | (?:gnu )?library general public license(?: version| v)? ?2(?: 0|(?! \d )) | library general
lgpl | 0.75 | (?:gnu )?library general public license | library general
lgpl | 0.75 | (?:gnu )?lesser general public license | lesser general
lgpl-2.1 | 0.8 | (?:gnu )?lgpl ?v?2 1 | lgpl
lgpl-3.0 | 0.8 | (?:gnu )?lgpl ?v?3(?: 0|(?! \d )) | lgpl
gpl-2.0 | 0.85 | (?:gnu )?general public license(?: version| v)? ?2(?: 0|(?! \d )) | general public license
gpl-3.0 | 0.85 | (?:gnu )?general public license(?: version| v)? ?3(?: 0|(?! \d )) | general public license
gpl-2.0 | 0.8 | (?:gnu )?gpl ?v?2(?: 0|(?! \d )) | gpl
gpl-3.0 | 0.8 | (?:gnu )?gpl ?v?3(?: 0|(?! \d )) | gpl
gpl | 0.6 | (?:gnu )?general public license | general public license
gpl | 0.6 | gnu gpl | gnu gpl
fdl-1.3 | 0.85 | (?:gnu free documentation license|gfdl)(?: version| v)? ?1 3 | 1 3
fdl-1.2 | 0.85 | (?:gnu free documentation license|gfdl)(?: version| v)? ?1 2 | 1 2
fdl | 0.75 | gnu free documentation license | free documentation
apache-2.0 | 0.85 | apache license (?:version |v)?2(?: 0|(?! \d )) | apache license
apache-1.1 | 0.85 | apache (?:software )?license (?:version |v)?1 1 | apache
apache-1.0 | 0.85 | apache (?:software )?license (?:version |v)?1 0 | apache
apache | 0.7 | apache (?:software )?license | apache
mpl-2.0 | 0.85 | mozilla public license(?: version| v)? ?2(?: 0|(?! \d )) | mozilla public license
mpl-1.1 | 0.85 | mozilla public license(?: version| v)? ?1 1 | mozilla public license
mpl | 0.7 | mozilla public license | mozilla public license
epl-2.0 | 0.85 | eclipse public license(?: version| v)? ?2(?: 0|(?! \d )) | eclipse public license
epl-1.0 | 0.85 | eclipse public license(?: version| v)? ?1(?: 0|(?! \d )) | eclipse public license
epl | 0.7 | eclipse public license | eclipse public license
cpl-1.0 | 0.8 | common public license(?: version)? 1 0 | common public license
cpl | 0.7 | common public license | common public license
cddl-1.1 | 0.85 | common development and distribution license(?: version)? 1 1 | common development and distribution
cddl-1.0 | 0.8 | common development and distribution license(?: version)? 1 0 | common development and distribution
cddl | 0.7 | common development and distribution license | common development and distribution
artistic-2.0 | 0.85 | artistic license(?: version)? 2 0 | artistic license
artistic-1.0 | 0.75 | (?:perl )?artistic license(?: version)? 1 0 | artistic license
bsl-1.0 | 0.8 | boost software license(?: version)? 1 0 | boost software license
bsl | 0.7 | boost software license | boost software license
ecl-2.0 | 0.8 | educational community license(?: version)? 2 0 | educational community
ecl | 0.7 | educational community license | educational community
eupl-1.2 | 0.85 | (?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2 | 1 2
eupl-1.1 | 0.85 | (?:european union public licen[cs]e|eupl)(?: version| v)? ?1 1 | 1 1
eupl | 0.7 | european union public licen[cs]e | european union public
osl-3.0 | 0.8 | open software license(?: version| v)? ?3 0 | open software license
osl | 0.7 | open software license | open software license
afl-3.0 | 0.8 | academic free license(?: version| v)? ?3 0 | academic free license
afl | 0.7 | academic free license | academic free license
ofl-1.1 | 0.8 | sil open font license(?: version)? 1 1 | sil open font
ofl | 0.7 | sil open font license | sil open font
odbl-1.0 | 0.8 | open database license(?: version| v)? ?1 0 | open database license
odbl | 0.7 | open database license | open database license
odc-by-1.0 | 0.8 | open data commons attribution license(?: version| v)? ?1 0 | open data commons
odc-by | 0.7 | open data commons attribution license | open data commons
pddl-1.0 | 0.8 | public domain dedication and license(?: version| v)? ?1 0 | public domain dedication
pddl | 0.7 | public domain dedication and license | public domain dedication
lppl-1.3c | 0.8 | latex project public license(?: version)? 1 3c | latex project
lppl | 0.7 | latex project public license | latex project
ncsa | 0.8 | university of illinois(?: ncsa)? open source license | university of illinois
ms-pl | 0.8 | microsoft public license | microsoft public license
ms-rl | 0.8 | microsoft reciprocal license | microsoft reciprocal
qpl-1.0 | 0.8 | q public license(?: version)? 1 0 | q public license
qpl | 0.7 | q public license | q public license
zpl-2.1 | 0.8 | zope public license(?: version)? 2 1 | zope public license
zpl | 0.7 | zope public license | zope public license
upl-1.0 | 0.8 | universal permissive license(?: version| v)? ?1 0 | universal permissive
upl | 0.7 | universal permissive license | universal permissive
vim | 0.7 | vim license | vim license
w3c | 0.8 | w3c software (?:notice and |and document )license | w3c software
blueoak-1.0.0 | 0.85 | blue oak model license(?: version)? 1 0 0 | blue oak
blueoak | 0.75 | blue oak model license | blue oak
elastic-2.0 | 0.85 | elastic license(?: version)? 2 0 | elastic license
sspl-1.0 | 0.85 | server side public license(?: version| v)? ?1 | server side public
sspl | 0.75 | server side public license | server side public
busl-1.1 | 0.85 | business source license(?: version)? 1 1 | business source license
busl | 0.75 | business source license | business source license
wtfpl | 0.85 | do what the f\S{2,3} you want to public license | you want to public license
cc-by-nc-sa-4.0 | 0.85 | creative commons attribution non ?commercial share ?alike 4 0(?: international)? | creative commons attribution
cc-by-nc-nd-4.0 | 0.85 | creative commons attribution non ?commercial no ?derivatives 4 0(?: international)? | creative commons attribution
cc-by-nc-4.0 | 0.85 | creative commons attribution non ?commercial 4 0(?: international)? | creative commons attribution
cc-by-sa-4.0 | 0.85 | creative commons attribution share ?alike 4 0(?: international)? | creative commons attribution
cc-by-nd-4.0 | 0.85 | creative commons attribution no ?derivatives 4 0(?: international)? | creative commons attribution
cc-by-4.0 | 0.85 | creative commons attribution 4 0(?: international)? | creative commons attribution
cc-by-sa-3.0 | 0.85 | creative commons attribution share ?alike 3 0(?: unported)? | creative commons attribution
cc-by-3.0 | 0.85 | creative commons attribution 3 0(?: unported)? | creative commons attribution
cc0-1.0 | 0.8 | (?:creative commons zero|cc0) 1 0(?: universal)?(?: public domain dedication)? | c
cc0 | 0.7 | (?:creative commons zero|cc0)(?: public domain dedication)? | c
cc-by-nc-sa-4.0 | 0.75 | cc by nc sa 4 0 | cc by nc sa
cc-by-nc-sa | 0.65 | cc by nc sa | cc by nc sa
cc-by-nc-nd-4.0 | 0.75 | cc by nc nd 4 0 | cc by nc nd
cc-by-nc-nd | 0.65 | cc by nc nd | cc by nc nd
cc-by-nc-4.0 | 0.75 | cc by nc 4 0 | cc by nc
cc-by-nc | 0.65 | cc by nc | cc by nc
cc-by-sa-4.0 | 0.75 | cc by sa 4 0 | cc by sa
cc-by-sa-3.0 | 0.75 | cc by sa 3 0 | cc by sa
cc-by-sa | 0.65 | cc by sa | cc by sa
cc-by-nd-4.0 | 0.75 | cc by nd 4 0 | cc by nd
cc-by-nd | 0.65 | cc by nd | cc by nd
cc-by-4.0 | 0.75 | cc by 4 0 | cc by
cc-by-3.0 | 0.75 | cc by 3 0 | cc by
cc-by | 0.6 | cc by | cc by
mit | 0.75 | (?:the )?(?:mit|expat) licen[cs]ed? | licen
mit | 0.75 | licen[cs]e (?:is )?(?:the )?mit | mit
isc | 0.75 | (?:the )?isc licen[cs]ed? | isc licen
bsd-2-clause | 0.8 | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd) licen[cs]e | bsd
bsd-3-clause | 0.8 | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd) licen[cs]e | bsd
bsd-4-clause | 0.8 | (?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e | bsd
bsd | 0.65 | bsd(?: style)? licen[cs]ed? | bsd
unlicense | 0.7 | the unlicense | unlicense
zlib | 0.7 | zlib(?: libpng)? licen[cs]e | zlib
postgresql | 0.75 | postgresql licen[cs]e | postgresql licen
php-3.01 | 0.75 | php license(?: version)? 3 01 | php license
psf-2.0 | 0.75 | python software foundation license version 2 | python software foundation
psf | 0.65 | python software foundation license | python software foundation
public-domain | 0.8 | (?:released|placed|dedicated) (?:in|into|to) the public domain | the public domain
public-domain | 0.6 | (?:is|are) in the public domain | in the public domain
proprietary | 0.8 | (?:this software is )?(?:proprietary and confidential|confidential and proprietary) | confidential
proprietary | 0.7 | unauthori[sz]ed (?:copying|reproduction|use|distribution) of (?:this|the) (?:\S+ ){1,6}is (?:strictly )?prohibited | unauthori
proprietary | 0.7 | may not be (?:copied|reproduced|distributed)(?: or \S+){0,3} without (?:the )?(?:prior |express )?(?:prior )?written (?:permission|consent) | may not be
reserved | 0.6 | all rights reserved | all rights reserved
warranty-disclaimer | 0.5 | without warrant(?:y|ies) (?:of any kind|or conditions of any kind) ?(?:either )?express or implied | without warrant
warranty-disclaimer | 0.5 | (?:the|this) software is provided as is(?: without warranty of any kind)? | is provided as is
copyright | 0.5 | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)* | copyright
copyright | 0.4 | copyright (?:c )?by \S+ | copyright
"""
#: A text without any of these words has no detection by any rule.
GATE = ("licen", "spdx", "gpl", "permission", "redistribution", "free software", "public", "copyright", "all rights reserved", "without warrant", "confidential", "cc by", "cc0", "creative commons", "prohibited", "may not be", "is provided as is", "advertising", "endorse or promote", "in compliance with", "agreed to in writing", "developed by the apache", "mit no attribution", "unencumbered", "verbatim or modified", "held liable", "plainly marked", "eupl", "gfdl", "the mpl", "zlib", "wtfpl", "odbl", "ms pl", "ms rl", "cddl", "under mpl", "under epl", "under the epl", "terms of mpl", "terms of epl", "terms of the epl", "apache", "under mit", "under the mit", "terms as perl", "terms as ruby", "source code form", "this file are subject to", "bsd", "january 2004", "extent possible under law")


def rules() -> list[tuple[int, str, float, str, str]]:
    """(priority, label, confidence, word regex, keyword), best first; a text can match only if it holds the keyword."""
    lines = [[x.strip() for x in line.split(" | ")] for line in SIGNATURES.strip().splitlines()]
    return [(k, label, float(weight), f" (?:{pattern})(?= )", keyword) for k, (label, weight, pattern, keyword) in enumerate(lines)]


_WORDS_IN = "(char_length({0}) - char_length(replace({0}, ' ', '')))"


def _resolve(hits: DataFrame) -> DataFrame:
    """The detections (row, start, end, rank) that stay: best priority first (then the earlier, the longer), each goes if
    it lies in one that stays or holds one.

    Only detections that touch can decide each other, so each run of touching ones is settled alone; a run is as long as
    a chain of overlaps, whatever the length of the text.
    """
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = hits.withColumn("_new", (reach.isNull() | (F.col("start") >= reach)).cast("long")).withColumn("island", F.sum("_new").over(order))
    one = "struct<rank:int,start:int,span:int,end:int>"
    grouped = chained.groupBy("row", "island").agg(F.expr("array_sort(collect_list(named_struct('rank', rank, 'start', start, 'span', start - end, 'end', end)))").alias("found"))
    kept = f"""aggregate(found, cast(array() AS array<{one}>), (k, x) ->
        if(exists(k, y -> (y.start <= x.start AND y.end >= x.end) OR (x.start <= y.start AND x.end >= y.end)), k, concat(k, array(x))))"""
    return grouped.select("row", F.expr(f"inline({kept})")).select("row", "start", "end", "rank")


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, base (array of label, start), found (array of label, start, end, confidence).

    Positions are word numbers from 0, ends exclusive. Null text reads as empty: no words, no detections. Of detections
    of one interval the best priority stays. Repeated rows give repeated rows; other columns are ignored; an empty table
    gives no rows; texts are read whole.
    """
    signatures = rules()
    gated = " OR ".join(f"contains(norm, {_quoted(w)})" for w in GATE)
    in_words = {"measure": _WORDS_IN}
    lowered = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(lowered, SEPARATORS, " "))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.concat(F.lit(" "), words, F.lit(" ")).alias("norm"))
    rows = rows.selectExpr("doc_id", "norm", "if(norm = '  ', 0L, cast(size(split(norm, ' ')) - 2 AS long)) AS n_words", f"({gated}) AS gated")
    none = "cast(array() AS array<struct<label:string,start:int>>)"
    based = [
        f"if(contains(norm, ' {phrase} '), transform({match_spans('norm', _quoted(f' {phrase}(?= )'), **in_words)}, s -> named_struct('label', '{label}', 'start', s.start)), {none})" for label, phrase in BASE
    ]
    # the regexes are literals of the plan; a rule is looked at only where its keyword stands
    cut = [f"if(contains(norm, {_quoted(keyword)}), named_struct('rank', {k}, 'pieces', split(norm, {_quoted(regex)}, -1), 'hits', regexp_extract_all(norm, {_quoted(regex)}, 0)), NULL)" for k, _, _, regex, keyword in signatures]
    spans = placed_spans("r.pieces", "r.hits", **in_words)
    hits = f"""flatten(transform(filter(array({", ".join(cut)}), r -> r IS NOT NULL AND size(r.hits) > 0),
        r -> transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'rank', r.rank))))"""
    empty = "cast(array() AS array<struct<start:int,end:int,rank:int>>)"
    scanned = rows.selectExpr("doc_id", "n_words", f"if(gated, concat({', '.join(based)}), {none}) AS base", f"if(gated, {hits}, {empty}) AS hits")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()))
    kept = _resolve(scanned.select("row", F.inline("hits")))
    labels = F.array(*[F.lit(label) for _, label, *_ in signatures])
    weights = F.array(*[F.lit(weight) for _, _, weight, *_ in signatures])
    found = F.struct("start", "end", F.element_at(labels, F.col("rank") + 1).alias("label"), F.element_at(weights, F.col("rank") + 1).alias("confidence"))
    kept = kept.groupBy("row").agg(F.sort_array(F.collect_list(found)).alias("found"))
    joined = scanned.drop("hits").join(kept, "row", "left")
    shown = "transform(found, h -> named_struct('label', h.label, 'start', h.start, 'end', h.end, 'confidence', h.confidence))"
    return joined.selectExpr("doc_id", "n_words", "base", f"coalesce({shown}, cast(array() AS array<struct<label:string,start:int,end:int,confidence:double>>)) AS found")


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, extreme places and labels of the base phrases; all labels; the best confidence."""
    return scanned.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base) AS long) AS n_base",
        "cast(array_min(transform(base, b -> b.start)) AS long) AS first_word",
        "cast(array_max(transform(base, b -> b.start)) AS long) AS last_word",
        "array_join(array_sort(array_distinct(transform(base, b -> b.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(transform(base, b -> b.label), transform(found, f -> f.label)))), ',') AS labels",
        "coalesce(array_max(concat(transform(found, f -> f.confidence), if(size(base) > 0, array(cast(0.6 AS double)), cast(array() AS array<double>)))), cast(0 AS double)) AS score",
    )
