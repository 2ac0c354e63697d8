r"""License scans by ordered signature rules, with Spark expressions only.

Documents without any rule's keywords stop at a substring test. In the others every rule of which a keyword occurs
is matched, within the one projection that reads the text; the gaps and matches of a rule, in order, give its detections' places by running sums, one small row for each place. A detection inside another of at least its priority is suppressed (of
equal intervals the higher priority, then the earlier rule, stays), except for the base phrases, which always stay.

A word is a run of ASCII letters, digits and characters from U+0080; a base phrase is its words in a row, case-insensitive in A-Z.

Cases: null text counts as empty: no words, no detection; repeated rows are scanned each; a null or repeated id is passed through;
very long texts are scanned whole, as one row, and no pattern repeats a group, so a long match needs no deep stack; ties between equal detections go to the higher priority, then the earlier rule; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.tables import table, text_or_empty

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
SEP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: Fixed by the contract of the scan: phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, name as a pattern, and keywords: any text with that name has one of them in lower case. A keyword lies within a word, as names can be broken over lines.
NAMES = (
    ("gpl-1.0", r"gnu (?:general public licen[sc]e|gpl),? v(?:ersion )?1(?:\.0)?", "gnu"),
    ("gpl-2.0", r"gnu (?:general public licen[sc]e|gpl),? v(?:ersion )?2(?:\.0)?", "gnu"),
    ("gpl-3.0", r"gnu (?:general public licen[sc]e|gpl),? v(?:ersion )?3(?:\.0)?", "gnu"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", "gnu"),
    ("lgpl-2.1", r"gnu lesser general public licen[sc]e,? v(?:ersion )?2\.1", "gnu"),
    ("lgpl-3.0", r"gnu lesser general public licen[sc]e,? v(?:ersion )?3(?:\.0)?", "gnu"),
    ("agpl-3.0", r"(?:gnu )?affero general public licen[sc]e(?:,? v(?:ersion )?3(?:\.0)?)?", "affero"),
    ("gfdl", r"gnu free documentation licen[sc]e(?:,? v(?:ersion )?1\.[1-3])?", "documentation"),
    ("apache-1.1", r"apache (?:software )?licen[sc]e,? v(?:ersion )?1\.1", "apache"),
    ("apache-2.0", r"apache (?:software )?licen[sc]e,? (?:v(?:ersion )?)?2(?:\.0)?", "apache"),
    ("mit", r"mit/expat licen[sc]e", "expat"),
    ("x11", r"x11 licen[sc]e", "x11"),
    ("bsd", r"bsd licen[sc]e", "bsd"),
    ("bsd-2-clause", r"(?:2-clause|simplified|freebsd) bsd licen[sc]e|bsd 2-clause(?: licen[sc]e)?", "bsd"),
    ("bsd-3-clause", r"(?:3-clause|new|revised|modified) bsd licen[sc]e|bsd 3-clause(?: licen[sc]e)?", "bsd"),
    ("bsd-4-clause", r"(?:4-clause|original) bsd licen[sc]e|bsd 4-clause(?: licen[sc]e)?", "bsd"),
    ("0bsd", r"(?:zero-clause|0-clause) bsd licen[sc]e|bsd zero clause licen[sc]e", "bsd"),
    ("isc", r"isc licen[sc]e", "isc"),
    ("mpl-1.1", r"mozilla public licen[sc]e,? v(?:ersion )?1\.1", "mozilla"),
    ("mpl-2.0", r"mozilla public licen[sc]e,? v(?:ersion )?2\.0", "mozilla"),
    ("mpl", r"mozilla public licen[sc]e", "mozilla"),
    ("epl", r"eclipse public licen[sc]e", "eclipse"),
    ("epl-1.0", r"eclipse public licen[sc]e,?(?: -)? v(?:ersion )?1(?:\.0)?", "eclipse"),
    ("epl-2.0", r"eclipse public licen[sc]e,?(?: -)? v(?:ersion )?2(?:\.0)?", "eclipse"),
    ("cpl-1.0", r"common public licen[sc]e(?:,? v(?:ersion )?1\.0)?", "common"),
    ("cddl", r"common development and distribution licen[sc]e(?:,? v(?:ersion )?1\.[01])?", "distribution"),
    ("eupl", r"european union public licen[sc]e(?:,? v(?:ersion )?\.?\s?1\.[12])?", "european"),
    ("artistic", r"artistic licen[sc]e(?:,? v(?:ersion )?[12]\.0)?", "artistic"),
    ("boost", r"boost software licen[sc]e(?:(?:,| -)? v(?:ersion )?1\.0)?", "boost"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib"),
    ("unlicense", r"the unlicense|released under the unlicense", "unlicense"),
    ("wtfpl", r"do what the f\w+ you want to public licen[sc]e|wtfpl", "want wtfpl"),
    ("psf", r"python software foundation licen[sc]e|psf licen[sc]e", "licen"),
    ("ofl", r"sil open font licen[sc]e(?:,? v(?:ersion )?1\.1)?", "font"),
    ("openssl", r"openssl licen[sc]e", "openssl"),
    ("ms-pl", r"microsoft public licen[sc]e|ms-pl", "microsoft ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "reciprocal"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("php", r"php licen[sc]e(?:,? v(?:ersion )?3\.0[01]?)?", "php"),
    ("ruby", r"ruby licen[sc]e", "ruby"),
    ("vim", r"vim licen[sc]e", "vim"),
    ("zpl", r"zope public licen[sc]e(?:,? v(?:ersion )?2\.[01])?", "zope"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e|odc-odbl|odbl", "database odbl"),
    ("odc-by", r"open data commons attribution licen[sc]e", "attribution"),
    ("cc0", r"(?:creative commons|cc)[ -]?(?:zero|0)(?: 1\.0)?(?: universal)?", "cc commons"),
    ("cc-by", r"(?:creative commons|cc)[ -](?:attribution|by)(?:[ -][1-4]\.0)?(?: international| unported)?", "cc commons"),
    ("cc-by", r"creative commons attribution(?: [1-4]\.0)?(?: international| unported)?", "commons"),
    ("cc-by-sa", r"(?:creative commons|cc)[ -](?:attribution|by)[ -]s(?:hare)?-?a(?:like)?(?:[ -][1-4]\.0)?", "cc commons"),
    ("cc-by-sa", r"creative commons attribution[ -]share-?alike(?: [1-4]\.0)?", "commons"),
    ("cc-by-nd", r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:nd|noderivs|noderivatives)(?:[ -][1-4]\.0)?", "cc commons"),
    ("cc-by-nc", r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:nc|noncommercial)(?:[ -][1-4]\.0)?", "cc commons"),
    ("cc-by-nc-sa", r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:nc|noncommercial)[ -](?:sa|sharealike)(?:[ -][1-4]\.0)?", "cc commons"),
    ("cc-by-nc-nd", r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:nc|noncommercial)[ -](?:nd|noderivs)(?:[ -][1-4]\.0)?", "cc commons"),
    ("afl", r"academic free licen[sc]e(?:,? v(?:ersion )?[1-3](?:\.[0-2])?)?", "academic"),
    ("apl-1.0", r"adaptive public licen[sc]e", "adaptive"),
    ("apsl-2.0", r"apple public source licen[sc]e(?:,? v(?:ersion )?2\.0)?", "apple"),
    ("aal", r"attribution assurance licen[sc]e", "assurance"),
    ("bittorrent", r"bittorrent open source licen[sc]e", "bittorrent"),
    ("blueoak-1.0.0", r"blue oak model licen[sc]e(?:,? v?1\.0\.0)?", "oak"),
    ("busl-1.1", r"business source licen[sc]e(?:,? v?(?:ersion )?1\.1)?", "business"),
    ("cal-1.0", r"cryptographic autonomy licen[sc]e", "cryptographic"),
    ("catosl-1.1", r"computer associates trusted open source licen[sc]e", "associates"),
    ("cecill", r"cecill(?:-[abc])?(?: free software)? licen[sc]e(?: agreement)?", "cecill"),
    ("cern-ohl", r"cern open hardware licen[sc]e(?:,? v(?:ersion )?[12](?:\.\d)?)?", "cern"),
    ("clartistic", r"clarified artistic licen[sc]e", "clarified"),
    ("cnri", r"cnri open source licen[sc]e(?: agreement)?", "cnri"),
    ("condor", r"condor public licen[sc]e", "condor"),
    ("cpal-1.0", r"common public attribution licen[sc]e(?:,? v(?:ersion )?1\.0)?", "attribution"),
    ("curl", r"curl licen[sc]e", "curl"),
    ("ecl-2.0", r"educational community licen[sc]e(?:,? v(?:ersion )?[12]\.0)?", "educational"),
    ("efl", r"eiffel forum licen[sc]e(?:,? v(?:ersion )?[12])?", "eiffel"),
    ("elastic-2.0", r"elastic licen[sc]e(?: v?2\.0)?", "elastic"),
    ("entessa", r"entessa public licen[sc]e", "entessa"),
    ("etalab", r"etalab open licen[sc]e(?: 2\.0)?", "etalab"),
    ("eudatagrid", r"eu ?datagrid software licen[sc]e", "datagrid"),
    ("fair", r"fair licen[sc]e", "fair"),
    ("frameworx", r"frameworx open licen[sc]e", "frameworx"),
    ("ftl", r"freetype (?:project )?licen[sc]e", "freetype"),
    ("hpnd", r"historical permission notice and disclaimer(?: licen[sc]e)?", "historical"),
    ("ibm-pl", r"ibm public licen[sc]e(?:,? v(?:ersion )?1\.0)?", "ibm"),
    ("icu", r"icu licen[sc]e", "icu"),
    ("ijg", r"independent jpeg group(?:'s)? licen[sc]e", "jpeg"),
    ("imagemagick", r"imagemagick licen[sc]e", "imagemagick"),
    ("info-zip", r"info-zip licen[sc]e", "info-zip"),
    ("intel", r"intel open source licen[sc]e", "intel"),
    ("ipa", r"ipa font licen[sc]e(?:,? v(?:ersion )?1\.0)?", "ipa"),
    ("jasper", r"jasper(?:-2\.0)? licen[sc]e", "jasper"),
    ("json", r"json licen[sc]e", "json"),
    ("lal", r"free art licen[sc]e(?: 1\.[23])?|licence art libre", "art"),
    ("libpng", r"(?:libpng|png reference library) licen[sc]e(?:,? v(?:ersion )?2)?", "png"),
    ("libtiff", r"libtiff licen[sc]e", "libtiff"),
    ("lppl", r"latex project public licen[sc]e(?:,? v(?:ersion )?1\.3[abc]?)?", "latex"),
    ("lpl-1.02", r"lucent public licen[sc]e(?:,? v(?:ersion )?1\.02)?", "lucent"),
    ("llama", r"llama [234](?:\.[1-3])? community licen[sc]e(?: agreement)?", "llama"),
    ("miros", r"miros licen[sc]e", "miros"),
    ("motosoto", r"motosoto open source licen[sc]e", "motosoto"),
    ("ms-lpl", r"microsoft limited public licen[sc]e", "microsoft"),
    ("mulan-psl", r"mulan permissive software licen[sc]e(?:,? v(?:ersion )?[12])?", "mulan"),
    ("multics", r"multics licen[sc]e", "multics"),
    ("naumen", r"naumen public licen[sc]e", "naumen"),
    ("ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", "ncsa"),
    ("ngpl", r"nethack general public licen[sc]e", "nethack"),
    ("nokia", r"nokia open source licen[sc]e", "nokia"),
    ("nposl-3.0", r"non-profit open software licen[sc]e(?:,? v?3\.0)?", "non-profit"),
    ("ntp", r"ntp licen[sc]e", "ntp"),
    ("oclc-2.0", r"oclc research public licen[sc]e(?:,? v?2\.0)?", "oclc"),
    ("ogl", r"open government licen[sc]e(?:,? v(?:ersion )?[1-3]\.0)?", "government"),
    ("oldap", r"openldap public licen[sc]e(?:,? v(?:ersion )?2\.[0-8])?", "openldap"),
    ("oset-pl", r"oset (?:foundation )?public licen[sc]e", "oset"),
    ("osl", r"open software licen[sc]e(?:,? v(?:ersion )?[1-3]\.[01])?", "software"),
    ("parity", r"parity public licen[sc]e(?: [67]\.0\.0)?", "parity"),
    ("pddl", r"(?:odc |open data commons )?public domain dedication and licen[sc]e", "dedication"),
    ("polyform-nc", r"polyform noncommercial licen[sc]e(?: 1\.0\.0)?", "polyform"),
    ("polyform-sb", r"polyform small business licen[sc]e(?: 1\.0\.0)?", "polyform"),
    ("qpl-1.0", r"q public licen[sc]e(?:,? v(?:ersion )?1\.0)?", "public"),
    ("rail", r"(?:creativeml )?open ?rail(?:\+\+)?(?:-?[ms])? licen[sc]e", "rail"),
    ("rpl", r"reciprocal public licen[sc]e(?:,? v(?:ersion )?1\.[15])?", "reciprocal"),
    ("rpsl-1.0", r"realnetworks public source licen[sc]e", "realnetworks"),
    ("rscpl", r"ricoh source code public licen[sc]e", "ricoh"),
    ("sgi-b", r"sgi free software licen[sc]e b(?:,? v(?:ersion )?2\.0)?", "sgi"),
    ("simpl-2.0", r"simple public licen[sc]e(?: 2\.0)?", "simple"),
    ("sissl", r"sun industry standards source licen[sc]e(?:,? v?1\.[12])?", "industry"),
    ("sleepycat", r"sleepycat licen[sc]e", "sleepycat"),
    ("spl-1.0", r"sun public licen[sc]e(?:,? v(?:ersion )?1\.0)?", "sun"),
    ("sspl-1.0", r"server side public licen[sc]e(?:,? v(?:ersion )?1)?", "server"),
    ("tcl", r"tcl(?:/tk)? licen[sc]e", "tcl"),
    ("ufl-1.0", r"ubuntu font licen[sc]e(?:,? v(?:ersion )?1\.0)?", "ubuntu"),
    ("unicode", r"unicode(?:,? inc\.)?(?: data files and software)? licen[sc]e(?: agreement| v3)?", "unicode"),
    ("upl-1.0", r"universal permissive licen[sc]e(?:,? v(?:ersion )?1\.0)?", "universal"),
    ("vera", r"bitstream vera(?: fonts?)? licen[sc]e", "bitstream"),
    ("vsl-1.0", r"vovida software licen[sc]e(?:,? v(?:ersion )?1\.0)?", "vovida"),
    ("w3c", r"w3c(?: software)?(?: notice and| and document notice and)? licen[sc]e", "w3c"),
    ("watcom-1.0", r"(?:sybase )?open watcom public licen[sc]e(?:,? v?1\.0)?", "watcom"),
    ("xfree86", r"xfree86 licen[sc]e(?: 1\.1)?", "xfree86"),
    ("zend", r"zend (?:engine )?licen[sc]e(?:,? v(?:ersion )?2\.0)?", "zend"),
    ("zimbra", r"zimbra public licen[sc]e(?:,? v(?:ersion )?1\.[34])?", "zimbra"),
    ("commons-clause", r"commons clause(?: licen[sc]e)?(?: condition)?(?: v1\.0)?", "clause"),
)

#: Whole sentences: label, pattern, keywords.
NOTICES = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby"),
    ("isc", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd", r"redistribution and use in source and binary forms,? with or without modification,? are permitted", "redistribution"),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of (?:its|the) contributors may be used to endorse", "endorse"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising"),
    ("gpl-2.0", r"either version 2 of the license,? or (?:\(at your option\) )?any later version", "later"),
    ("gpl-3.0", r"either version 3 of the license,? or (?:\(at your option\) )?any later version", "later"),
    ("gpl", r"this program is free software[:;] you can redistribute it and/or modify", "redistribute"),
    ("lgpl", r"this library is free software[:;] you can redistribute it and/or modify", "redistribute"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("apache-2.0", r"licensed under the apache license, version 2\.0 \(the .?license.?\)", "apache"),
    ("apache-2.0", r"https?://www\.apache\.org/licenses/license-2\.0", "apache.org"),
    ("gpl", r"https?://www\.gnu\.org/licenses/gpl", "gnu.org"),
    ("lgpl", r"https?://www\.gnu\.org/licenses/lgpl", "gnu.org"),
    ("agpl-3.0", r"https?://www\.gnu\.org/licenses/agpl", "gnu.org"),
    ("mit", r"https?://(?:www\.)?opensource\.org/licenses/mit", "opensource.org"),
    ("cc-by", r"https?://creativecommons\.org/licenses/by/[1-4]\.0", "creativecommons.org"),
    ("cc-by-sa", r"https?://creativecommons\.org/licenses/by-sa/[1-4]\.0", "creativecommons.org"),
    ("cc-by-nc", r"https?://creativecommons\.org/licenses/by-nc/[1-4]\.0", "creativecommons.org"),
    ("cc0", r"https?://creativecommons\.org/publicdomain/zero/1\.0", "creativecommons.org"),
    ("zlib", r"this software is provided .?as-is.?, without any express or implied warranty", "as-is"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in)?to the public domain", "domain"),
    ("public-domain", r"in the public domain", "domain"),
    ("proprietary", r"all rights reserved\.? (?:unauthorized )?(?:copying|reproduction) .{0,60}?(?:strictly )?prohibited", "prohibited"),
    ("proprietary", r"proprietary and confidential", "proprietary"),
    ("boost", r"boost software license - version 1\.0", "boost"),
    ("ofl", r"this font software is licensed under the sil open font license", "font"),
    ("copyright", r"(?:copyright|\(c\)|©) (?:\(c\) )?(?:19|20)\d\d[-,\s\d]*\s\w", "copyright (c) ©"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial"),
    ("mit", r"the software is provided .?as is.?, without warranty of any kind, express or implied, including but not limited to", "warranty"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd", r"this software is provided by .{1,80}? .?as is.? and any express or implied warranties", "warranties"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache"),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an .?as is.? basis", "applicable"),
    ("gpl", r"you should have received a copy of the gnu general public license along with", "gnu"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose", "merchantability"),
    ("gpl-2.0", r"gnu general public license as published by the free software foundation[;,] (?:either )?version 2", "gnu"),
    ("gpl-3.0", r"gnu general public license as published by the free software foundation[;,] (?:either )?version 3", "gnu"),
    ("gpl-2.0", r"under the terms of version 2 of the gnu general public license", "gnu"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", "gnu"),
    ("lgpl-2.1", r"gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 2\.1", "gnu"),
    ("lgpl-3.0", r"gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 3", "gnu"),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public license along with", "affero"),
    ("agpl-3.0", r"gnu affero general public license as published by the free software foundation[;,] (?:either )?version 3", "affero"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", "documentation"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", "mozilla"),
    ("mpl-2.0", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0", "mozilla.org"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0", "eclipse"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v\.?)? 2\.0", "eclipse"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "distribution"),
    ("cpl-1.0", r"this program is provided under the terms of this common public license", "common"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose, including commercial applications", "anyone"),
    ("isc", r"permission to use, copy, modify,? and distribute this software for any purpose with or without fee", "fee"),
    ("boost", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "organization"),
    ("boost", r"https?://(?:www\.)?boost\.org/license_1_0\.txt", "boost.org"),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee", "documentation"),
    ("hpnd", r"permission to use, copy, modify and distribute this software and its documentation for any purpose is hereby granted", "documentation"),
    ("unlicense", r"https?://(?:www\.)?unlicense\.org", "unlicense"),
    ("ofl", r"reserved font name .{1,60}?", "reserved"),
    ("cc0", r"has dedicated the work to the public domain by waiving", "waiving"),
    ("cc0", r"has waived all copyright and related or neighbou?ring rights", "waived"),
    ("cc-by-nc-sa", r"licensed under a creative commons attribution-noncommercial-sharealike [1-4]\.0 (?:international|unported|generic) license", "commons"),
    ("cc-by-nc-nd", r"licensed under a creative commons attribution-noncommercial-noderiv(?:ative)?s [1-4]\.0 (?:international|unported|generic) license", "commons"),
    ("cc-by-nc", r"licensed under a creative commons attribution-noncommercial [1-4]\.0 (?:international|unported|generic) license", "commons"),
    ("cc-by-nd", r"licensed under a creative commons attribution-noderiv(?:ative)?s [1-4]\.0 (?:international|unported|generic) license", "commons"),
    ("cc-by-sa", r"text is available under the creative commons attribution-sharealike license", "commons"),
    ("cc-by-nd", r"https?://creativecommons\.org/licenses/by-nd/[1-4]\.0", "creativecommons.org"),
    ("cc-by-nc-sa", r"https?://creativecommons\.org/licenses/by-nc-sa/[1-4]\.0", "creativecommons.org"),
    ("cc-by-nc-nd", r"https?://creativecommons\.org/licenses/by-nc-nd/[1-4]\.0", "creativecommons.org"),
    ("odbl", r"https?://(?:www\.)?opendatacommons\.org/licenses/odbl", "opendatacommons.org"),
    ("odc-by", r"https?://(?:www\.)?opendatacommons\.org/licenses/by", "opendatacommons.org"),
    ("pddl", r"https?://(?:www\.)?opendatacommons\.org/licenses/pddl", "opendatacommons.org"),
    ("isc", r"https?://(?:www\.)?opensource\.org/licenses/isc", "opensource.org"),
    ("bsd-2-clause", r"https?://(?:www\.)?opensource\.org/licenses/bsd-2-clause", "opensource.org"),
    ("bsd-3-clause", r"https?://(?:www\.)?opensource\.org/licenses/bsd-3-clause", "opensource.org"),
    ("apache-2.0", r"https?://(?:www\.)?opensource\.org/licenses/apache-2\.0", "opensource.org"),
    ("gpl-2.0", r"https?://(?:www\.)?opensource\.org/licenses/gpl-2\.0", "opensource.org"),
    ("gpl-3.0", r"https?://(?:www\.)?opensource\.org/licenses/gpl-3\.0", "opensource.org"),
    ("public-domain", r"no copyright (?:is )?(?:claimed|asserted)", "copyright"),
    ("proprietary", r"unauthorized (?:copying|use|distribution) of this (?:file|software|document).{0,60}? is strictly prohibited", "unauthorized"),
    ("proprietary", r"may not be (?:copied|reproduced|redistributed) without (?:the )?(?:prior )?(?:express )?(?:written )?permission", "without"),
    ("all-rights-reserved", r"all rights reserved", "reserved"),
)

#: Form, priority: how a name stands in a text; {} is the name.
FORMS = ((r"{}", 1), (r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{})", 2), (r"licen[sc]e[ds]?\s*[:=]\s*['\"]?(?:{})", 3))
SPDX = (
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 CDDL-1.0 EUPL-1.2 Artistic-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 OFL-1.1 PostgreSQL"
).split()


def rules() -> list[tuple[str, str, str, int, bool]]:
    """(label, pattern, keywords, priority, base), in order."""
    def edge(pattern: str) -> str:
        return rf"(?i)(?<!{WORD})(?:{pattern})(?!{WORD})"

    out = [(label, edge(SEP.join(phrase.split())), phrase.split()[0], 9, True) for phrase, label in BASE]
    for label, pattern, key in NOTICES:
        out.append((label, "(?i)" + pattern.replace(" ", r"\s+"), key, 4, False))
    for label in SPDX:
        out.append((label.lower(), edge(r"SPDX-License-Identifier:\s*" + label.replace(".", r"\.")), "spdx", 5, False))
    for form, priority in FORMS:
        for label, pattern, key in NAMES:
            out.append((label, edge(form.replace("{}", f"(?:{pattern})")).replace(" ", r"\s+"), key, priority, False))
    return out


#: Every text that a rule matches has one of these or what `_may_match` looks for besides.
ANCHORS = (
    "licen", "copyright", "(c)", "©", "spdx", "domain", "hereby", "redistribut", "commons", "advertising", "as-is", "unencumbered", "proprietary", "odbl", "ms-pl", "wtfpl", "endorse", "prohibited", "-clause",
    "warrant", "permission", "mozilla", "apache", "reserved",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def _may_match(low: Column) -> Column:
    found = low.contains(ANCHORS[0])
    for anchor in ANCHORS[1:]:
        found = found | low.contains(anchor)
    found = found | (low.contains("cc") & F.rlike(low, F.lit(r"cc[^0-9a-z\x{80}-\x{10FFFF}]+by|cc[\s+-]*(?:0|zero|by|attribution)")))
    return found | (low.contains("gpl") & F.rlike(low, F.lit(r"gnu\s+gpl")))


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+")).cast("long")


def _places(text: Column, low: Column) -> Column:
    """Array of (n, label, priority, base, i, gap, len, gap_words, len_words) of all rules in a text: for the i-th match of rule n, the length in characters and
    words of what stands between it and the one before, and of itself."""
    every = rules()
    keywords = F.array(*map(F.lit, sorted({key for rule in every for key in rule[2].split()})))
    listed = F.array(
        *(
            F.struct(F.lit(i).alias("n"), F.lit(label).alias("label"), F.lit(p).alias("pattern"), F.array(*map(F.lit, keys.split())).alias("keys"), F.lit(prio).alias("priority"), F.lit(base).alias("base"))
            for i, (label, p, keys, prio, base) in enumerate(every)
        )
    )
    none = F.array().cast("array<struct<n:int,label:string,priority:int,base:boolean,i:int,gap:bigint,len:bigint,gap_words:bigint,len_words:bigint>>")

    def of_rule(rule: Column) -> Column:
        def place(match: Column, gap: Column, i: Column) -> Column:
            lengths = (F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("len"), _words(gap).alias("gap_words"), _words(match).alias("len_words"))
            return F.struct(rule["n"].alias("n"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["base"].alias("base"), i.alias("i"), *lengths)

        def of_matches(found: Column) -> Column:
            both = F.arrays_zip(found.alias("match"), F.slice(F.split(text, rule["pattern"], -1), F.lit(1), F.size(found)).alias("gap"))
            return F.when(F.size(found) > 0, F.transform(both, lambda pair, i: place(pair["match"], pair["gap"], i))).otherwise(none)

        return _let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), of_matches)

    def of_keys(keys: Column) -> Column:
        return F.flatten(F.transform(F.filter(listed, lambda rule: F.arrays_overlap(rule["keys"], keys)), of_rule))

    return F.when(_may_match(low), _let(F.filter(keywords, lambda key: F.contains(low, key)), of_keys)).otherwise(none)


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (array of
    struct<label, word, start, end, priority> that were not suppressed; characters from 0)."""
    rows = docs.select(F.col(id_col), text_or_empty(text).alias("_text"))
    hits = rows.select(id_col, _words(F.col("_text")).alias("n_words"), _let(F.lower("_text"), lambda low: _places(F.col("_text"), low)).alias("_places"), F.monotonically_increasing_id().alias("_row"))
    # One row for each place; a row without any keeps the document. No text leaves this projection.
    places = hits.select(id_col, "n_words", "_row", F.explode_outer("_places").alias("p")).select(id_col, "n_words", "_row", "p.*")
    places = places.repartition("_row")  # by which both windows and the rows need it
    before = W.partitionBy("_row", "n").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends, seen_words = F.sum(F.col("gap") + F.col("len")).over(before), F.sum(F.col("gap_words") + F.col("len_words")).over(before)
    found = places.select(
        id_col, "n_words", "_row", "n", "label", "priority", "base", (ends - F.col("len")).alias("start"), ends.alias("end"), (seen_words - F.col("len_words")).alias("word")
    )
    outer = W.partitionBy("_row").orderBy(F.col("start"), F.col("end").desc(), F.col("priority").desc(), F.col("n")).rowsBetween(W.unboundedPreceding, -1)
    inside = F.lit(False)
    for tier in sorted({r[3] for r in rules() if not r[4]}):
        reach = F.max(F.when((F.col("priority") >= tier) & ~F.col("base"), F.col("end"))).over(outer)
        inside = inside | ((F.col("priority") == tier) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    kept = found.withColumn("stays", F.col("start").isNotNull() & (F.col("base") | ~inside))
    own = F.collect_set(F.when(F.col("stays"), F.col("label")))
    base = F.col("base") & F.col("stays")
    weight = F.max(F.when(F.col("stays"), F.when(F.col("base"), 0.8).otherwise(F.least(F.col("priority") / 5.0, F.lit(1.0)))))
    seen = kept.groupBy("_row").agg(
        F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("word"))).alias("first_word"),
        F.max(F.when(base, F.col("word"))).alias("last_word"), F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(own), ",").alias("labels"), F.coalesce(weight, F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("label", "word", "start", "end", "priority")))).alias("detections"),
    )
    return seen.drop("_row")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
