r"""The signature rules of the license scan, written by hand per license.

A rule is (priority, keyword, pattern, confidence); 1 is the best priority.
Patterns apply to texts with A-Z in lower case; a blank stands for any run of
blanks, line breaks, commas and hyphens.  Every match contains the keyword.
Priority 1: machine-readable tags and pages.  2: grants and words of the license
text.  3: a name next to the word license, or a name that nothing else has.
"""

from __future__ import annotations

#: "licensed under the terms of the", up to the name.
GRANT = (
    r"\b(?:licensed|released|distributed|published|available|provided|covered|redistributed)(?: \w+){0,2} under"
    r" (?:the )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?"
)
TAG = r"\b(?:spdx license identifier|licen[sc]e)[\"']?\s*[:=]\s*[\"']?"
END = r"(?![\w.]*\w)"
#: A version, with or without the word.
V = r"(?:version |v\.? ?)?"

BY_LICENSE = {
    "mit": (
        (1, "mit", TAG + r"mit" + END, 0.95),
        (1, "opensource.org", r"opensource\.org/licenses?/mit\b", 0.95),
        (2, "mit", GRANT + r"mit(?: x11)?(?: licen[sc]e)?" + END, 0.9),
        (2, "permission", r"\bpermission is hereby granted free of charge to any person obtaining a copy of this software\b", 0.95),
        (3, "mit", r"\bmit(?: style)? licen[sc]ed?\b", 0.8),
        (3, "expat", r"\bexpat licen[sc]e\b", 0.8),
    ),
    "apache-2": (
        (1, "apache", TAG + r"apache 2(?:\.0)?" + END, 0.95),
        (1, "apache.org", r"apache\.org/licenses/license 2\.0", 0.95),
        (2, "apache", GRANT + r"apache (?:software )?(?:licen[sc]e )?" + V + r"2(?:\.0)?" + END, 0.9),
        (2, "compliance", r"\byou may not use this file except in compliance with the license\b", 0.7),
        (3, "apache", r"\bapache (?:software )?licen[sc]e " + V + r"2(?:\.0)?" + END, 0.8),
        (3, "asl", r"\basl ?2(?:\.0)?" + END, 0.5),
    ),
    "apache-1.1": (
        (1, "apache", TAG + r"apache 1\.1" + END, 0.95),
        (2, "apache", GRANT + r"apache (?:software )?licen[sc]e " + V + r"1\.1" + END, 0.9),
        (3, "apache", r"\bapache (?:software )?licen[sc]e " + V + r"1\.1" + END, 0.8),
    ),
    "bsd-2": (
        (1, "bsd", TAG + r"bsd 2 clause" + END, 0.95),
        (1, "opensource.org", r"opensource\.org/licenses?/bsd 2 clause", 0.95),
        (2, "bsd", GRANT + r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)\b", 0.9),
        (3, "bsd", r"\b(?:2|two) clause bsd licen[sc]e\b", 0.8),
        (3, "bsd", r"\b(?:simplified bsd|freebsd) licen[sc]e\b", 0.8),
    ),
    "bsd-3": (
        (1, "bsd", TAG + r"bsd 3 clause" + END, 0.95),
        (1, "opensource.org", r"opensource\.org/licenses?/bsd 3 clause", 0.95),
        (2, "bsd", GRANT + r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)\b", 0.9),
        (2, "endorse", r"\bnor the names of (?:its|the|their) contributors may be used to endorse or promote products\b", 0.9),
        (3, "bsd", r"\b(?:3|three) clause bsd licen[sc]e\b", 0.8),
        (3, "bsd", r"\b(?:new|modified|revised) bsd licen[sc]e\b", 0.8),
    ),
    "bsd-4": (
        (1, "bsd", TAG + r"bsd 4 clause" + END, 0.95),
        (2, "bsd", GRANT + r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)\b", 0.9),
        (2, "advertising", r"\ball advertising materials mentioning features or use of this software must display\b", 0.9),
        (3, "bsd", r"\b(?:original|old|(?:4|four) clause) bsd licen[sc]e\b", 0.8),
    ),
    "0bsd": (
        (1, "0bsd", TAG + r"0bsd" + END, 0.95),
        (2, "bsd", GRANT + r"(?:zero clause bsd|bsd zero clause|0bsd)\b", 0.9),
        (3, "bsd", r"\b(?:bsd zero clause|zero clause bsd|0bsd) licen[sc]e\b", 0.8),
    ),
    "bsd": (
        (1, "opensource.org", r"opensource\.org/licenses?/bsd license", 0.9),
        (2, "bsd", GRANT + r"bsd(?: style)?(?: licen[sc]e)?" + END, 0.8),
        (2, "redistribution", r"\bredistribution and use in source and binary forms with or without modification are permitted\b", 0.8),
        (3, "bsd", r"\bbsd(?: style)? licen[sc]ed?\b", 0.6),
    ),
    "gpl-1": (
        (1, "gpl", TAG + r"gpl 1\.0(?: only| or later|\+)?" + END, 0.95),
        (2, "gnu", GRANT + r"gnu general public licen[sc]e " + V + r"1(?:\.0)?" + END, 0.9),
    ),
    "gpl-2": (
        (1, "gpl", TAG + r"gpl 2(?:\.0)?(?: only| or later|\+)?" + END, 0.95),
        (1, "gnu.org", r"gnu\.org/(?:licenses/(?:old licenses/)?)gpl 2\.0", 0.95),
        (2, "gnu", GRANT + r"gnu (?:general public licen[sc]e|gpl) " + V + r"2(?:\.0)?" + END, 0.9),
        (2, "gpl", GRANT + r"gpl ?" + V + r"2(?:\.0)?" + END, 0.9),
        (3, "gnu", r"\bgnu general public licen[sc]e(?: as published by the free software foundation)?;?(?: either)? version 2(?:\.0)?" + END, 0.8),
        (3, "gpl", r"\bgpl ?v?2(?:\.0)? licen[sc]ed?\b", 0.8),
        (3, "gplv2", r"\bgplv2\b", 0.6),
    ),
    "gpl-3": (
        (1, "gpl", TAG + r"gpl 3(?:\.0)?(?: only| or later|\+)?" + END, 0.95),
        (1, "gnu.org", r"gnu\.org/licenses/gpl 3\.0", 0.95),
        (2, "gnu", GRANT + r"gnu (?:general public licen[sc]e|gpl) " + V + r"3(?:\.0)?" + END, 0.9),
        (2, "gpl", GRANT + r"gpl ?" + V + r"3(?:\.0)?" + END, 0.9),
        (3, "gnu", r"\bgnu general public licen[sc]e(?: as published by the free software foundation)?;?(?: either)? version 3(?:\.0)?" + END, 0.8),
        (3, "gpl", r"\bgpl ?v?3(?:\.0)? licen[sc]ed?\b", 0.8),
        (3, "gplv3", r"\bgplv3\b", 0.6),
    ),
    "gpl": (
        (1, "gnu.org", r"gnu\.org/licenses/gpl(?:\.html|\.txt)", 0.9),
        (2, "gnu", GRANT + r"gnu (?:general public licen[sc]e|gpl)\b", 0.8),
        (2, "gpl", GRANT + r"gpl\b", 0.8),
        (2, "copyleft", r"\bthe gnu general public license is a free copyleft license\b", 0.9),
        (3, "gnu", r"\bgnu general public licen[sc]e\b", 0.6),
        (3, "gpl", r"\b(?:gnu )?gpl licen[sc]ed?\b", 0.6),
    ),
    "lgpl-2.1": (
        (1, "lgpl", TAG + r"lgpl 2\.1(?: only| or later|\+)?" + END, 0.95),
        (1, "gnu.org", r"gnu\.org/licenses/(?:old licenses/)?lgpl 2\.1", 0.95),
        (2, "gnu", GRANT + r"gnu lesser general public licen[sc]e " + V + r"2\.1" + END, 0.9),
        (2, "lgpl", GRANT + r"(?:gnu )?lgpl ?" + V + r"2\.1" + END, 0.9),
        (3, "lesser", r"\blesser general public licen[sc]e " + V + r"2\.1" + END, 0.8),
        (3, "lgplv2.1", r"\blgplv2\.1" + END, 0.6),
    ),
    "lgpl-3": (
        (1, "lgpl", TAG + r"lgpl 3(?:\.0)?(?: only| or later|\+)?" + END, 0.95),
        (1, "gnu.org", r"gnu\.org/licenses/lgpl 3\.0", 0.95),
        (2, "gnu", GRANT + r"gnu lesser general public licen[sc]e " + V + r"3(?:\.0)?" + END, 0.9),
        (2, "lgpl", GRANT + r"(?:gnu )?lgpl ?" + V + r"3(?:\.0)?" + END, 0.9),
        (3, "lesser", r"\blesser general public licen[sc]e " + V + r"3(?:\.0)?" + END, 0.8),
        (3, "lgplv3", r"\blgplv3\b", 0.6),
    ),
    "lgpl": (
        (2, "gnu", GRANT + r"gnu (?:lesser|library) general public licen[sc]e\b", 0.8),
        (2, "lgpl", GRANT + r"(?:gnu )?lgpl\b", 0.8),
        (3, "lesser", r"\bgnu lesser general public licen[sc]e\b", 0.6),
        (3, "library", r"\bgnu library general public licen[sc]e\b", 0.6),
        (3, "lgpl", r"\blgpl licen[sc]ed?\b", 0.6),
    ),
    "agpl-3": (
        (1, "agpl", TAG + r"agpl 3(?:\.0)?(?: only| or later|\+)?" + END, 0.95),
        (1, "gnu.org", r"gnu\.org/licenses/agpl 3\.0", 0.95),
        (2, "affero", GRANT + r"(?:gnu )?affero general public licen[sc]e " + V + r"3(?:\.0)?" + END, 0.9),
        (2, "agpl", GRANT + r"(?:gnu )?agpl ?" + V + r"3(?:\.0)?" + END, 0.9),
        (3, "affero", r"\baffero general public licen[sc]e " + V + r"3(?:\.0)?" + END, 0.8),
        (3, "agplv3", r"\bagplv3\b", 0.6),
    ),
    "agpl": (
        (2, "affero", GRANT + r"(?:gnu )?affero general public licen[sc]e\b", 0.8),
        (2, "agpl", GRANT + r"(?:gnu )?agpl\b", 0.8),
        (3, "affero", r"\baffero (?:general public )?licen[sc]e\b", 0.6),
        (3, "agpl", r"\bagpl licen[sc]ed?\b", 0.6),
    ),
    "gfdl": (
        (1, "gfdl", TAG + r"gfdl 1\.[123]" + END, 0.95),
        (1, "gnu.org", r"gnu\.org/licenses/fdl", 0.95),
        (2, "gnu", GRANT + r"gnu free documentation licen[sc]e\b", 0.9),
        (3, "documentation", r"\b(?:gnu )?free documentation licen[sc]e\b", 0.8),
        (3, "gfdl", r"\bgfdl\b", 0.5),
    ),
    "mpl-1.1": (
        (1, "mpl", TAG + r"mpl 1\.1" + END, 0.95),
        (1, "mozilla.org", r"mozilla\.org/mpl/(?:1\.1|mpl 1\.1)", 0.95),
        (2, "mozilla", GRANT + r"mozilla public licen[sc]e " + V + r"1\.1" + END, 0.9),
        (3, "mozilla", r"\bmozilla public licen[sc]e " + V + r"1\.1" + END, 0.8),
    ),
    "mpl-2": (
        (1, "mpl", TAG + r"mpl 2\.0" + END, 0.95),
        (1, "mozilla.org", r"mozilla\.org/(?:en us/)?mpl/2\.0", 0.95),
        (2, "mozilla", GRANT + r"mozilla public licen[sc]e " + V + r"2(?:\.0)?" + END, 0.9),
        (2, "mpl", GRANT + r"mpl ?" + V + r"2(?:\.0)?" + END, 0.9),
        (3, "mozilla", r"\bmozilla public licen[sc]e " + V + r"2(?:\.0)?" + END, 0.8),
        (3, "mpl", r"\bmpl 2\.0" + END, 0.5),
    ),
    "epl-1": (
        (1, "epl", TAG + r"epl 1\.0" + END, 0.95),
        (1, "eclipse.org", r"eclipse\.org/legal/epl v10", 0.95),
        (2, "eclipse", GRANT + r"eclipse public licen[sc]e " + V + r"1(?:\.0)?" + END, 0.9),
        (3, "eclipse", r"\beclipse public licen[sc]e " + V + r"1(?:\.0)?" + END, 0.8),
    ),
    "epl-2": (
        (1, "epl", TAG + r"epl 2\.0" + END, 0.95),
        (1, "eclipse.org", r"eclipse\.org/legal/epl (?:2\.0|v20)", 0.95),
        (2, "eclipse", GRANT + r"eclipse public licen[sc]e " + V + r"2(?:\.0)?" + END, 0.9),
        (2, "epl", GRANT + r"epl ?" + V + r"2(?:\.0)?" + END, 0.9),
        (3, "eclipse", r"\beclipse public licen[sc]e " + V + r"2(?:\.0)?" + END, 0.8),
    ),
    "eupl": (
        (1, "eupl", TAG + r"eupl 1\.[12]" + END, 0.95),
        (1, "joinup.ec.europa.eu", r"joinup\.ec\.europa\.eu/\S*eupl", 0.95),
        (2, "eupl", GRANT + r"eupl\b", 0.9),
        (3, "european", r"\beuropean union public licen[sc]e\b", 0.8),
    ),
    "cddl": (
        (1, "cddl", TAG + r"cddl 1\.[01]" + END, 0.95),
        (1, "opensource.org", r"opensource\.org/licenses?/cddl", 0.95),
        (2, "cddl", GRANT + r"cddl\b", 0.9),
        (3, "development", r"\bcommon development and distribution licen[sc]e\b", 0.8),
    ),
    "artistic-2": (
        (1, "artistic", TAG + r"artistic 2\.0" + END, 0.95),
        (1, "opensource.org", r"opensource\.org/licenses?/artistic licen[sc]e 2\.0", 0.95),
        (2, "artistic", GRANT + r"(?:perl )?artistic licen[sc]e\b", 0.8),
        (3, "artistic", r"\b(?:artistic licen[sc]e " + V + r"2\.0|perl artistic licen[sc]e)\b", 0.8),
    ),
    "boost": (
        (1, "bsl", TAG + r"bsl 1\.0" + END, 0.95),
        (1, "boost.org", r"boost\.org/license_1_0", 0.95),
        (2, "boost", GRANT + r"boost software licen[sc]e\b", 0.9),
        (3, "boost", r"\bboost software licen[sc]e\b", 0.8),
    ),
    "isc": (
        (1, "isc", TAG + r"isc" + END, 0.95),
        (1, "opensource.org", r"opensource\.org/licenses?/isc\b", 0.95),
        (2, "isc", GRANT + r"isc(?: licen[sc]e)?" + END, 0.9),
        (2, "permission", r"\bpermission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted\b", 0.9),
        (3, "isc", r"\bisc licen[sc]ed?\b", 0.8),
    ),
    "zlib": (
        (1, "zlib", TAG + r"zlib" + END, 0.95),
        (1, "zlib.net", r"zlib\.net/zlib_license", 0.95),
        (2, "zlib", GRANT + r"zlib(?:/libpng)?\b", 0.9),
        (2, "altered", r"\baltered source versions must be plainly marked as such\b", 0.8),
        (3, "zlib", r"\bzlib(?:/libpng)? licen[sc]e\b", 0.8),
    ),
    "unlicense": (
        (1, "unlicense", TAG + r"unlicense" + END, 0.95),
        (1, "unlicense.org", r"\bunlicense\.org\b", 0.95),
        (2, "unencumbered", r"\bthis is free and unencumbered software released into the public domain\b", 0.95),
        (3, "unlicense", r"\bthe unlicense\b", 0.7),
    ),
    "wtfpl": (
        (1, "wtfpl", TAG + r"wtfpl" + END, 0.95),
        (1, "wtfpl.net", r"\bwtfpl\.net\b", 0.95),
        (2, "wtfpl", GRANT + r"wtfpl\b", 0.9),
        (3, "fuck", r"\bdo what the fuck you want to public licen[sc]e\b", 0.9),
    ),
    "ofl": (
        (1, "ofl", TAG + r"ofl 1\.1" + END, 0.95),
        (1, "scripts.sil.org", r"scripts\.sil\.org/ofl", 0.95),
        (2, "font", GRANT + r"(?:sil )?open font licen[sc]e\b", 0.9),
        (3, "font", r"\bsil open font licen[sc]e\b", 0.8),
    ),
    "odbl": (
        (1, "odbl", TAG + r"odbl 1\.0" + END, 0.95),
        (1, "opendatacommons.org", r"opendatacommons\.org/licenses/odbl", 0.95),
        (2, "odbl", GRANT + r"odbl\b", 0.9),
        (3, "database", r"\bopen database licen[sc]e\b", 0.8),
    ),
    "odc-by": (
        (1, "odc", TAG + r"odc by 1\.0" + END, 0.95),
        (1, "opendatacommons.org", r"opendatacommons\.org/licenses/by\b", 0.95),
        (2, "odc", GRANT + r"odc by\b", 0.9),
        (3, "commons", r"\bopen data commons attribution licen[sc]e\b", 0.8),
    ),
    "pddl": (
        (1, "pddl", TAG + r"pddl 1\.0" + END, 0.95),
        (1, "opendatacommons.org", r"opendatacommons\.org/licenses/pddl", 0.95),
        (3, "dedication", r"\bpublic domain dedication and licen[sc]e\b", 0.8),
    ),
    "cc0": (
        (1, "cc0", TAG + r"cc0(?: 1\.0)?" + END, 0.95),
        (1, "creativecommons.org", r"creativecommons\.org/publicdomain/zero\b", 0.95),
        (2, "cc0", GRANT + r"(?:creative commons )?cc0\b", 0.9),
        (3, "commons", r"\bcreative commons zero\b", 0.8),
        (3, "cc0", r"\bcc0(?: 1\.0)?(?: universal)? (?:public domain|licen[sc]e)\b", 0.8),
    ),
    "cc-by": (
        (1, "cc", TAG + r"cc by(?: [1-4]\.0)?" + END + r"(?![\s,-]+(?:sa|nc|nd)\b)", 0.95),
        (1, "creativecommons.org", r"creativecommons\.org/licenses/by/", 0.95),
        (2, "cc", GRANT + r"(?:creative commons )?cc by\b(?![\s,-]+(?:sa|nc|nd)\b)", 0.9),
        (3, "commons", r"\bcreative commons attribution (?:[1-4]\.0 )?(?:international )?licen[sc]e\b", 0.8),
        (3, "cc", r"\bcc by (?:[1-4]\.0 )?licen[sc]ed?\b", 0.8),
    ),
    "cc-by-sa": (
        (1, "cc", TAG + r"cc by sa(?: [1-4]\.0)?" + END, 0.95),
        (1, "creativecommons.org", r"creativecommons\.org/licenses/by sa\b", 0.95),
        (2, "cc", GRANT + r"(?:creative commons )?cc by sa\b", 0.9),
        (3, "commons", r"\bcreative commons attribution share ?alike\b", 0.8),
        (3, "cc", r"\bcc by sa(?: [1-4]\.0)?(?: licen[sc]ed?)?" + END, 0.6),
    ),
    "cc-by-nc": (
        (1, "cc", TAG + r"cc by nc(?: [1-4]\.0)?" + END + r"(?![\s,-]+(?:sa|nd)\b)", 0.95),
        (1, "creativecommons.org", r"creativecommons\.org/licenses/by nc/", 0.95),
        (2, "cc", GRANT + r"(?:creative commons )?cc by nc\b(?![\s,-]+(?:sa|nd)\b)", 0.9),
        (3, "commons", r"\bcreative commons attribution non ?commercial(?: [1-4]\.0)?(?: international)? licen[sc]e\b", 0.8),
    ),
    "cc-by-nd": (
        (1, "cc", TAG + r"cc by nd(?: [1-4]\.0)?" + END, 0.95),
        (1, "creativecommons.org", r"creativecommons\.org/licenses/by nd\b", 0.95),
        (2, "cc", GRANT + r"(?:creative commons )?cc by nd\b", 0.9),
        (3, "commons", r"\bcreative commons attribution no ?deriv(?:ative)?s\b", 0.8),
    ),
    "cc-by-nc-sa": (
        (1, "cc", TAG + r"cc by nc sa(?: [1-4]\.0)?" + END, 0.95),
        (1, "creativecommons.org", r"creativecommons\.org/licenses/by nc sa\b", 0.95),
        (2, "cc", GRANT + r"(?:creative commons )?cc by nc sa\b", 0.9),
        (3, "commons", r"\bcreative commons attribution non ?commercial share ?alike\b", 0.8),
    ),
    "cc-by-nc-nd": (
        (1, "cc", TAG + r"cc by nc nd(?: [1-4]\.0)?" + END, 0.95),
        (1, "creativecommons.org", r"creativecommons\.org/licenses/by nc nd\b", 0.95),
        (2, "cc", GRANT + r"(?:creative commons )?cc by nc nd\b", 0.9),
        (3, "commons", r"\bcreative commons attribution non ?commercial no ?deriv(?:ative)?s\b", 0.8),
    ),
    "openrail": (
        (1, "openrail", TAG + r"(?:bigscience |creativeml )?openrail(?: m|\+\+)?" + END, 0.95),
        (2, "openrail", GRANT + r"(?:creativeml )?openrail\b", 0.9),
        (3, "responsible", r"\bresponsible ai licen[sc]e\b", 0.8),
    ),
    "llama": (
        (1, "llama.meta.com", r"llama\.meta\.com/llama\S*license", 0.95),
        (2, "llama", GRANT + r"llama (?:[23](?:\.\d)? )?community licen[sc]e\b", 0.9),
        (3, "llama", r"\bllama (?:[23](?:\.\d)? )?community licen[sc]e\b", 0.8),
    ),
    "proprietary": (
        (3, "reserved", r"\ball rights reserved\b", 0.4),
        (3, "confidential", r"\b(?:strictly )?confidential and proprietary\b", 0.6),
    ),
    "public-domain": (
        (1, "creativecommons.org", r"creativecommons\.org/publicdomain/mark\b", 0.9),
        (3, "domain", r"\b(?:dedicated|released|placed|put)(?: \w+){0,2} (?:to|into|in) the public domain\b", 0.8),
    ),
}
