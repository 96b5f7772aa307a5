"""Licence recognition by sentences.

A text is cut into sentences, each sentence is normalised (ASCII lower case,
runs of anything but letters and digits as one blank) and looked up in a table of
known licence sentences: published wordings, and the names of licences behind
what introduces them ("this file is licensed under the terms of", a tag, ...).
Sentences that speak of licences but are not known stay as ``unknown``. A
sentence ends at punctuation or a blank line (a semicolon inside a known one does
not count); a known one that is wrapped over several lines, with or without comment
marks, is put together, and else each line stands alone. The licences of one tag's
expression, or of a choice between two, are sentences each. The
sequence of identifiers is then matched against licence rules in their order:
each rule that matches takes its identifiers out of the sequence, so a longer
rule stands before the shorter ones that it contains.

Cases: null and empty texts have no sentences, so empty lists. Rows are judged
one by one: repeated rows come out repeatedly, other columns are ignored, an
empty table gives no rows. Texts of any length are scanned whole.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pick

# Licences and how they are called, normalised; identifiers of rules are those of SPDX.
NAMES = {
    "MIT": "mit; mit license; mit licence; expat license; mit expat license; the mit license; mit style license; mit x11 license",
    "Apache-2.0": "apache 2 0; apache 2; apache license 2 0; apache license version 2 0; apache license version 2; apache license v2 0; asl 2 0",
    "Apache-1.1": "apache 1 1; apache license 1 1; apache software license version 1 1",
    "BSD-2-Clause": "bsd 2 clause; bsd 2 clause license; simplified bsd license; freebsd license; two clause bsd license; 2 clause bsd license",
    "BSD-3-Clause": "bsd 3 clause; bsd 3 clause license; new bsd license; modified bsd license; revised bsd license; three clause bsd license; 3 clause bsd license",
    "BSD-4-Clause": "bsd 4 clause; bsd 4 clause license; original bsd license",
    "BSD": "bsd; bsd license; bsd licence; bsd style license; berkeley software distribution license",
    "ISC": "isc; isc license; isc licence",
    "Zlib": "zlib; zlib license; zlib libpng license",
    "BSL-1.0": "bsl 1 0; boost software license; boost software license 1 0; boost software license version 1 0",
    "Unlicense": "unlicense; unlicense license",
    "WTFPL": "wtfpl; do what the fuck you want to public license",
    "MPL-2.0": "mpl 2 0; mozilla public license 2 0; mozilla public license version 2 0; mozilla public license v 2 0",
    "MPL-1.1": "mpl 1 1; mozilla public license 1 1; mozilla public license version 1 1",
    "EPL-1.0": "epl 1 0; eclipse public license 1 0; eclipse public license v1 0; eclipse public license version 1 0",
    "EPL-2.0": "epl 2 0; eclipse public license 2 0; eclipse public license v2 0; eclipse public license version 2 0",
    "CDDL-1.0": "cddl 1 0; common development and distribution license 1 0; common development and distribution license version 1 0",
    "Artistic-2.0": "artistic 2 0; artistic license 2 0; artistic license version 2 0",
    "PSF-2.0": "psf 2 0; python software foundation license; python software foundation license version 2",
    "OFL-1.1": "ofl 1 1; sil open font license version 1 1; sil open font license 1 1",
    "EUPL-1.2": "eupl 1 2; european union public licence v 1 2; european union public licence 1 2",
    "PostgreSQL": "postgresql; postgresql license",
    "CC0-1.0": "cc0; cc0 1 0; cc0 1 0 universal; creative commons zero v1 0 universal; creative commons cc0 1 0 universal",
    "BUSL-1.1": "busl 1 1; business source license 1 1",
    "Python-2.0": "python 2 0; python license 2 0",
    "MS-PL": "ms pl; microsoft public license",
    "Ruby": "ruby; ruby license; ruby s license",
    "JSON": "json license",
    "Artistic-1.0": "artistic license; artistic 1 0; artistic license 1 0",
    "EUPL-1.1": "eupl 1 1; european union public licence v 1 1; european union public licence 1 1",
    "LPPL-1.3c": "lppl 1 3c; latex project public license version 1 3c; latex project public license 1 3c",
    "NCSA": "ncsa; university of illinois ncsa open source license; university of illinois open source license",
    "CPL-1.0": "cpl 1 0; common public license version 1 0; common public license 1 0",
    "OSL-3.0": "osl 3 0; open software license version 3 0; open software license 3 0",
    "AFL-3.0": "afl 3 0; academic free license version 3 0; academic free license 3 0",
    "MS-RL": "ms rl; microsoft reciprocal license",
    "GFDL-1.3": "gfdl 1 3; gnu free documentation license version 1 3; gnu free documentation license 1 3",
    "ODbL-1.0": "odbl 1 0; open database license; open data commons open database license v1 0; open data commons open database license 1 0",
    "0BSD": "0bsd; zero clause bsd license; bsd zero clause license",
    "MulanPSL-2.0": "mulanpsl 2 0; mulan psl v2; mulan permissive software license version 2",
}
for _gnu, _called in (("GPL", "general public license"), ("LGPL", "lesser general public license"), ("AGPL", "affero general public license")):
    for _v in ("2.0", "2.1", "3.0"):
        _w = _v.replace(".", " ")
        _short, _g = (_w[0] if _w.endswith(" 0") else _w), _gnu.lower()
        _forms = [f"{_g} {_w}", f"{_g} {_w} only", f"{_g}v{_short}", f"{_g} v{_short}", f"{_g} version {_short}", f"gnu {_called} version {_short}", f"gnu {_called} v{_w}", f"gnu {_called} v{_short}", f"gnu {_g} version {_short}", f"gnu {_g} v{_short}", f"gnu {_called} {_w}"]
        NAMES[f"{_gnu}-{_v}-or-later"] = "; ".join(x.removesuffix(" only") + e for x in _forms for e in (" or later", " or any later version", " or at your option any later version", "+"))
        NAMES[f"{_gnu}-{_v}"] = "; ".join(_forms)
for _c, _said in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"), ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives")):
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _s = f"cc {_c.lower().replace('-', ' ')} {_v.replace('.', ' ')}"
        _l = f"creative commons {_said} {_v.replace('.', ' ')}"
        NAMES[f"CC-{_c}-{_v}"] = "; ".join([_s, f"{_s} license", f"{_s} international", _l, f"{_l} license", f"{_l} international license", f"{_l} international", f"{_l} unported license"])


def name_id(spdx: str) -> str:
    return {"Apache-2.0": "apache2"}.get(spdx, spdx.lower().replace(".", "")) + "-name"


#: Name: identifier; the sentences that name a licence are these after one of ``INTRODUCTIONS``.
CALLED = {" ".join(form.replace("+", " or later").split()): name_id(spdx) for spdx, forms in NAMES.items() for form in forms.split(";")}
INTRODUCTIONS = (
    "(?:(?:this|the|all) (?:[a-z0-9]+ ){1,4}?(?:is|are) )?(?:also |dual |hereby )?(?:licensed|released|distributed|available|published|provided|offered|covered|made available)"
    "(?: to you)?(?: for use)? (?:under|by|with|as)(?: the| a| an)?(?: terms of| conditions of| terms and conditions of)?(?: the| a| an)? |(?:the )?(?:use of )?(?:this|the) [a-z0-9]+(?: code| file)? is (?:also )?(?:governed by|subject to)(?: the| a| an)?(?: terms of)?(?: the| a| an)? |spdx license identifier |license (?:is )?(?:the )?|licence (?:is )?(?:the )?"
)
ENDINGS = "(?: the license)?(?: that can be (?:found|read) in the (?:license|licence|copying)(?: md| txt| rst)?(?: file)?(?: in the root(?: directory)? of (?:this|the) (?:source tree|repository|project))?)?(?: see (?:the )?(?:license|licence|copying|notice)(?: file)?(?: txt| md)?(?: for (?:more )?(?:details|information))?)?"
# Published wordings, normalised, and their identifiers.
PUBLISHED = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl10-grant",
    "distributed under the boost software license version 1 0": "bsl-10-name",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "apache2-asf",
    "see the notice file distributed with this work for additional information regarding copyright ownership": "apache2-notice",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache2-name",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-20-name",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "epl-10-name",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-20-name",
    "this is free and unencumbered software released into the public domain": "unlicense-name",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "you should have received a copy of the gnu lesser general public license along with this library": "gpl-received",
    "you should have received a copy of the gnu affero general public license along with this program": "gpl-received",
    "see the gnu general public license for more details": "gpl-details",
    "see the gnu lesser general public license for more details": "gpl-details",
    "see the gnu affero general public license for more details": "gpl-details",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-10-name",
    "this font software is licensed under the sil open font license version 1 1": "ofl-11-name",
    "all rights reserved": "rights-reserved",
    "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses": "gpl-received",
    "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses": "gpl-received",
    "if not see http www gnu org licenses": "gpl-received",
    "if not see https www gnu org licenses": "gpl-received",
    "if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa": "gpl-received",
    "if not write to the free software foundation inc 59 temple place suite 330 boston ma 02111 1307 usa": "gpl-received",
    "if not write to the free software foundation inc 675 mass ave cambridge ma 02139 usa": "gpl-received",
    "you should have received a copy of the gnu library general public license along with this library": "gpl-received",
    "you should have received a copy of the gnu lesser general public license along with this program": "gpl-received",
    "this program is free software": "gpl-free",
    "this library is free software": "gpl-free",
    "this file is part of free software": "gpl-free",
    "use reproduction and distribution of this software are governed by the terms of the license": "unknown-terms",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software and its documentation": "mit-notice",
    "except as contained in this notice the name of the authors shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the authors": "x11-names",
    "neither the name of the authors nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-binary",
    "this software is provided by the author as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "this software is provided by the regents and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "this software is provided by the author and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the author be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "in no event shall the regents or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "loss of use data or profits": "bsd-loss",
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-advised",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero-bsd-grant",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "you must not claim that you wrote the original software": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt": "bsl-see",
    "see accompanying file license 1 0 txt or copy at https www boost org license 1 0 txt": "bsl-see",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache2-warranty",
    "licensed to the apache software foundation asf under one or more contributor license agreements see the notice file distributed with this work for additional information regarding copyright ownership": "apache2-asf",
    "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0": "mpl2-incompatible",
    "the contents of this file are subject to the mozilla public license version 1 1 the license": "mpl-11-name",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl-10-name",
    "the contents of this file are subject to the terms of the common development and distribution license version 1 0 the license": "cddl-10-name",
    "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "epl-10-name",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution": "epl-20-name",
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain": "unlicense-dedication",
    "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors": "unlicense-benefit",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-10-name",
    "this library is free software you can redistribute it and or modify it under the same terms as perl itself": "perl-name",
    "it may be used redistributed and or modified under the terms of the perl artistic license": "artistic-10-name",
    "you can redistribute it and or modify it under the same terms as perl itself": "perl-name",
    "this work is free": "wtfpl-free",
    "you can redistribute it and or modify it under the terms of the do what the fuck you want to public license version 2 as published by sam hocevar": "wtfpl-name",
}
for _gnu, _called in (("gpl", "general public license"), ("lgpl", "lesser general public license"), ("agpl", "affero general public license")):
    for _v in ("2", "2.1", "3"):
        for _later in (True, False):
            _end = f"either version {_v} of the license or at your option any later version" if _later else f"version {_v} of the license"
            PUBLISHED[" ".join(f"you can redistribute it and or modify it under the terms of the gnu {_called} as published by the free software foundation {_end}".replace(".", " ").split())] = (
                f"{_gnu}-{(_v + '.0')[:3].replace('.', '')}{'-or-later' if _later else ''}-name"
            )
# Rules over several identifiers, in order; after them, each name by itself. The pattern is matched against identifiers in blanks.
RULES = (
    ("Apache-2.0", " (?:apache2-asf )?(?:apache2-notice )?apache2-name (?:apache2-use )?(?:apache2-copy )?(?:apache2-warranty )?(?:apache2-see )?"),
    ("Apache-2.0", " apache2-use apache2-copy (?:apache2-warranty )?(?:apache2-see )?"),
    ("MIT", " (?:mit-name |mit-title )?(?:copyright-notice )*mit-grant mit-notice (?:mit-warranty )?(?:mit-liability )?"),
    ("MIT", " mit-notice mit-warranty (?:mit-liability )?"),
    ("MIT", " mit-name (?:mit-grant )?(?:mit-notice )?"),
    ("BSD-4-Clause", " bsd-grant bsd-source bsd-binary bsd-advertising (?:unknown )?(?:bsd-endorse )?(?:bsd-warranty )?(?:bsd-liability )?"),
    ("BSD-3-Clause", " bsd-grant bsd-source bsd-binary bsd-endorse (?:bsd-warranty )?(?:bsd-liability )?"),
    ("BSD-2-Clause", " bsd-grant bsd-source bsd-binary (?:bsd-warranty )?(?:bsd-liability )?"),
    ("ISC", " (?:isc-name |isc-title )?(?:copyright-notice )*isc-grant (?:isc-warranty )?"),
    ("Zlib", " (?:zlib-warranty )?(?:zlib-liability )?zlib-grant "),
    ("BSL-1.0", " (?:bsl-10-name )?bsl10-grant "),
    ("Unlicense", " unlicense-name (?:unlicense-grant )?"),
    ("MPL-2.0", " mpl-20-name (?:mpl2-copy )?"),
    *((spdx, f" {name_id(spdx)} (?:gpl-warranty )*(?:gpl-details )?(?:gpl-received )?") for spdx in NAMES if "GPL" in spdx),
    *((spdx, f" {name_id(spdx)} ") for spdx in NAMES if "GPL" not in spdx),
    # a name alone on its line is a title if a copyright notice follows
    *((spdx, f" {name_id(spdx).removesuffix('-name')}-title (?:copyright-notice )+") for spdx in NAMES),
    ("Artistic-1.0-Perl", " perl-name "),
    ("0BSD", " zero-bsd-grant (?:isc-warranty )?(?:isc-liability )?"),
    ("BSD", " bsd-grant (?:bsd-source )?"),
)
#: A word of each known sentence; others that have one are unknown licence sentences.
TRIGGER = "licen[sc]|copyright|warrant|redistribut|permission notice|public domain|rights reserved|hereby granted|liable for any|cc by|apache2|as published by the free|advertising materials"
_ENDS = "[.!?;:][ \\t\\r\\n]+"
#: A semicolon inside of a published sentence.
_INSIDE = r"(?i)(Foundation);([ \t\r\n*#/-]+either[ \t\r\n*#/-]+version)"
#: A colon after which the licence's name follows is no end of a sentence.
_TAG = r"(?i)(SPDX-License-Identifier|Licen[sc]e)[ \t]*:[ \t]*\(?"
#: Nor is the point of an abbreviated version.
_VERSION = r"(?i)\bv\. +([0-9])"
_NAMED = f"^(?:{INTRODUCTIONS})((?:{'|'.join(sorted(CALLED, key=len, reverse=True))})){ENDINGS}$"
_BARE = f"^((?:{'|'.join(sorted((c for c in CALLED if 'licen' in c), key=len, reverse=True))}))$"
_SPDX = "spdx license identifier "
#: A choice between two licences, or both.
_TWO = f"^(?:{INTRODUCTIONS})(?:either |both )?(?:of )?(?:the )?(?:terms of (?:the )?)?({'|'.join(sorted(CALLED, key=len, reverse=True))}) (?:or|and) (?:the )?({'|'.join(sorted(CALLED, key=len, reverse=True))})(?: licen[sc]es?)?(?: at your option)?{ENDINGS}$"
#: Published sentences over any lines, longer ones first, else one line.
_WRAPPED = "(?m)^(?:" + "|".join(s.replace(" ", "[ \\n]") for s in sorted(PUBLISHED, key=len, reverse=True)) + ")$|^.*$"
#: Places of the table of sentences, by hash.
_BUCKETS = 64


def known_sentences() -> dict[str, str]:
    """Every key of the table and its identifier: published sentences, and names behind a mark for what introduces them."""
    titles = {f"title {c}": i.removesuffix("-name") + "-title" for c, i in CALLED.items() if "licen" in c}
    return PUBLISHED | {f"= {c}": i for c, i in CALLED.items()} | titles


def _looked_up(key: Column) -> Column:
    """The identifier of a key: one bucket of the table, found by hash, is searched."""
    places: list[list[tuple[str, str]]] = [[] for _ in range(_BUCKETS)]
    for pair in sorted(known_sentences().items()):
        places[zlib.crc32(pair[0].encode()) % _BUCKETS].append(pair)
    table = F.array(*[F.create_map(*[F.lit(x) for pair in place or [("", "")] for x in pair]) for place in places])
    return F.try_element_at(F.get(table, (F.crc32(key.cast("binary")) % _BUCKETS).cast("int")), key)


def identifiers() -> Column:
    """Identifiers of the licence sentences of ``text`` in order."""
    normal = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))

    def lines(sentence: Column) -> Column:
        # an empty line, or one of comment marks only, stays and parts what is around it
        out = F.array_join(F.transform(F.split(sentence, "\n"), normal), "\n")
        named = F.replace(out, F.lit("\n"), F.lit(" "))  # two blanks where a line is empty, so no name goes over it
        whole = F.transform(F.regexp_extract_all(out, F.lit(_WRAPPED), F.lit(0)), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))
        return F.when(~F.contains(out, F.lit("\n")), F.array(out)).when(named.rlike(_NAMED) | (named.rlike(" (?:or|and) ") & named.rlike(_TWO)), F.array(named)).otherwise(whole)

    def tags(sentence: Column) -> Column:
        # each licence of a tag's expression is a sentence
        rest = F.regexp_replace(F.regexp_replace(sentence, f"^{_SPDX}", ""), " or later", " orlater")
        each = F.transform(F.split(rest, " (?:or|and|with) "), lambda x: F.concat(F.lit(_SPDX), F.regexp_replace(x, " orlater", " or later")))
        two = F.array(*[F.concat(F.lit(_SPDX), F.regexp_extract(sentence, _TWO, g)) for g in (1, 2)])
        is_two = sentence.rlike(" (?:or|and) ") & ~sentence.rlike(_NAMED) & sentence.rlike(_TWO)
        return F.when(sentence.startswith(_SPDX), each).when(is_two, two).otherwise(F.array(sentence))

    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", _TAG, "$1 "), _VERSION, "v $1"), _INSIDE, "$1,$2")
    said = F.filter(F.flatten(F.transform(F.split(text, _ENDS), lines)), lambda s: s.rlike(TRIGGER))
    said = F.flatten(F.transform(said, tags))

    def key(s: Column) -> Column:
        return F.when(s.rlike(_NAMED), F.concat(F.lit("= "), F.regexp_extract(s, _NAMED, 1))).when(s.rlike(_BARE), F.concat(F.lit("title "), s)).otherwise(s)

    def named(k: Column) -> Column:
        return F.coalesce(_looked_up(k), F.when(k.startswith("copyright "), "copyright-notice"), F.lit("unknown"))

    found = F.transform(F.transform(said, key), named)
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.col("text").rlike(f"(?i){TRIGGER}"), F.lit(False)), found).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_unknown, sentence_ids and licenses (comma-joined, in the order of the rules)."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in RULES])
    start = F.struct(
        F.when(F.size("ids") > 0, F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))).otherwise("").alias("seq"),
        F.array().cast("array<string>").alias("names"),
    )

    def step(acc: Column, rule: Column) -> Column:
        seq, names = acc["seq"], acc["names"]
        hit = F.struct(F.regexp_replace(seq, rule["p"], F.lit(" ")).alias("seq"), F.array_append(names, rule["name"]).alias("names"))
        return F.when(F.regexp_like(seq, rule["p"]), hit).otherwise(acc)

    squeezed = lambda c: F.regexp_replace(c, " +", " ")
    start = F.struct(squeezed(start["seq"]).alias("seq"), start["names"].alias("names"))
    names = F.when(F.size("ids") > 0, F.aggregate(rules, start, step)["names"]).otherwise(F.array().cast("array<string>"))
    rows = pick(docs, "doc_id", "text").select("doc_id", identifiers().alias("ids"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_sentences"),
        F.size(F.filter("ids", lambda x: x == "unknown")).cast("bigint").alias("n_unknown"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(names), ",").alias("licenses"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in known_sentences().items()) + "}"
    steps, last = "", "s0"
    for k, (name, p) in enumerate(RULES, 1):
        steps += f""", s{k} AS (SELECT doc_id, ids, CASE WHEN regexp_matches(seq, '{p}') THEN regexp_replace(seq, '{p}', ' ', 'g') ELSE seq END AS seq,
  CASE WHEN regexp_matches(seq, '{p}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})"""
        last = f"s{k}"
    return rf"""
WITH src AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_TAG}', '\1 ', 'g'), '{_VERSION}', 'v \1', 'g'), '{_INSIDE}', '\1,\2', 'g') AS t FROM documents),
cut AS (SELECT doc_id, list_transform(string_split_regex(t, '{_ENDS}'), lambda x: array_to_string(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(lower(y), '[^a-z0-9]+', ' ', 'g'))), chr(10))) AS s FROM src),
said AS (SELECT doc_id, list_filter(flatten(list_transform(s, lambda x: CASE WHEN NOT contains(x, chr(10)) THEN [x]
  WHEN regexp_matches(replace(x, chr(10), ' '), '{_NAMED}') OR regexp_matches(replace(x, chr(10), ' '), '{_TWO}') THEN [replace(x, chr(10), ' ')]
  WHEN regexp_matches(x, '{TRIGGER}') THEN list_transform(regexp_extract_all(x, '{_WRAPPED}'), lambda y: replace(y, chr(10), ' ')) ELSE CAST([] AS VARCHAR[]) END)), lambda x: regexp_matches(x, '{TRIGGER}')) AS s FROM cut),
parts AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN starts_with(x, '{_SPDX}')
  THEN list_transform(string_split_regex(replace(regexp_replace(x, '^{_SPDX}', ''), ' or later', ' orlater'), ' (?:or|and|with) '), lambda y: '{_SPDX}' || replace(y, ' orlater', ' or later'))
  WHEN NOT regexp_matches(x, '{_NAMED}') AND regexp_matches(x, '{_TWO}') THEN ['{_SPDX}' || regexp_extract(x, '{_TWO}', 1), '{_SPDX}' || regexp_extract(x, '{_TWO}', 2)] ELSE [x] END)) AS s FROM said),
keys AS (SELECT doc_id, list_transform(s, lambda x: CASE WHEN regexp_matches(x, '{_NAMED}') THEN '= ' || regexp_extract(x, '{_NAMED}', 1) WHEN regexp_matches(x, '{_BARE}') THEN 'title ' || x ELSE x END) AS k FROM parts),
found AS (SELECT doc_id, list_transform(k, lambda x: coalesce({known}[x], CASE WHEN starts_with(x, 'copyright ') THEN 'copyright-notice' END, 'unknown')) AS ids FROM keys),
s0 AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN ' ' || array_to_string(ids, ' ') || ' ' ELSE '' END AS seq, CAST([] AS VARCHAR[]) AS names FROM found){steps}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, CAST(len(list_filter(ids, lambda x: x = 'unknown')) AS BIGINT) AS n_unknown,
  array_to_string(ids, ',') AS sentence_ids, array_to_string(names, ',') AS licenses FROM {last}
"""


ORACLE = _oracle()
