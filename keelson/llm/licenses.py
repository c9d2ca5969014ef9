"""License scans by ordered signatures.

A text becomes its lower-cased words joined by spaces. A keyword automaton says which signatures can match at all; only
these regexes run. Detections rank by priority, then length, then label, and one that lies within one of higher rank
is suppressed. Base phrases are reported in any case.

Defined results: a null text is an empty one, without detections and with score 0; repeated rows each give a row; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What always counts: a phrase and its label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: its name as a regex over words, a word that any match has, the versions that exist.
FAMILIES = {
    "mit": ("(?:the )?(?:mit|expat|x11) licen[cs]e", "licen", ()),
    "apache": ("(?:the )?apache(?: software)?(?: foundation)? licen[cs]e", "apache", ("1 0", "1 1", "2 0")),
    "gpl": ("(?:the )?(?:gnu )?general public licen[cs]e|gnu gpl", "g", ("1 0", "2 0", "3 0", "2", "3")),
    "lgpl": ("(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl", "g", ("2 0", "2 1", "3 0", "3")),
    "agpl": ("(?:the )?(?:gnu )?affero general public licen[cs]e|gnu agpl", "g", ("1 0", "3 0", "3")),
    "gfdl": ("(?:the )?(?:gnu )?free documentation licen[cs]e", "documentation", ("1 1", "1 2", "1 3")),
    "bsd-0-clause": ("(?:zero clause|0 clause) bsd(?: licen[cs]e)?|bsd 0 clause", "bsd", ()),
    "bsd-1-clause": ("(?:one clause|1 clause) bsd(?: licen[cs]e)?|bsd 1 clause", "bsd", ()),
    "bsd-2-clause": ("(?:simplified|freebsd|two clause|2 clause) bsd(?: licen[cs]e)?|bsd 2 clause", "bsd", ()),
    "bsd-3-clause": ("(?:new|revised|modified|three clause|3 clause) bsd(?: licen[cs]e)?|bsd 3 clause", "bsd", ()),
    "bsd-4-clause": ("(?:original|old|four clause|4 clause) bsd(?: licen[cs]e)?|bsd 4 clause", "bsd", ()),
    "bsd": ("(?:the )?bsd(?: style)? licen[cs]e", "bsd", ()),
    "isc": ("(?:the )?isc licen[cs]e|internet systems consortium licen[cs]e", "licen", ()),
    "mpl": ("(?:the )?mozilla public licen[cs]e", "mozilla", ("1 0", "1 1", "2 0")),
    "epl": ("(?:the )?eclipse public licen[cs]e", "eclipse", ("1 0", "2 0")),
    "edl": ("(?:the )?eclipse distribution licen[cs]e", "eclipse", ("1 0",)),
    "cpl": ("(?:the )?common public licen[cs]e", "common", ("1 0",)),
    "ipl": ("(?:the )?ibm public licen[cs]e", "ibm", ("1 0",)),
    "cddl": ("(?:the )?common development and distribution licen[cs]e", "distribution", ("1 0", "1 1")),
    "cpal": ("(?:the )?common public attribution licen[cs]e", "attribution", ("1 0",)),
    "eupl": ("(?:the )?european union public licen[cs]e", "european", ("1 0", "1 1", "1 2")),
    "artistic": ("(?:the )?(?:perl )?artistic licen[cs]e", "artistic", ("1 0", "2 0")),
    "afl": ("(?:the )?academic free licen[cs]e", "academic", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    "osl": ("(?:the )?open software licen[cs]e", "software", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    "apsl": ("(?:the )?apple public source licen[cs]e", "apple", ("1 0", "1 1", "1 2", "2 0")),
    "bsl": ("(?:the )?boost software licen[cs]e", "boost", ("1 0",)),
    "busl": ("(?:the )?business source licen[cs]e", "business", ("1 1",)),
    "sspl": ("(?:the )?server side public licen[cs]e", "server", ("1 0", "1")),
    "elastic": ("(?:the )?elastic licen[cs]e", "elastic", ("2 0",)),
    "zlib": ("(?:the )?zlib(?: libpng)? licen[cs]e", "zlib", ()),
    "libpng": ("(?:the )?libpng licen[cs]e", "libpng", ("2 0",)),
    "openssl": ("(?:the )?openssl licen[cs]e", "openssl", ()),
    "php": ("(?:the )?php licen[cs]e", "php", ("3 0", "3 01")),
    "python": ("(?:the )?python(?: software foundation)? licen[cs]e", "python", ("2 0", "2")),
    "ruby": ("(?:the )?ruby licen[cs]e", "ruby", ()),
    "postgresql": ("(?:the )?postgresql licen[cs]e", "postgresql", ()),
    "ncsa": ("(?:the )?university of illinois ncsa(?: open source)? licen[cs]e|ncsa open source licen[cs]e", "ncsa", ()),
    "upl": ("(?:the )?universal permissive licen[cs]e", "universal", ("1 0",)),
    "unlicense": ("(?:the )?unlicense", "unlicense", ()),
    "wtfpl": ("do what the f\\w+ you want to public licen[cs]e|wtfpl", "w", ("2",)),
    "zpl": ("(?:the )?zope public licen[cs]e", "zope", ("1 1", "2 0", "2 1")),
    "ofl": ("(?:the )?(?:sil )?open font licen[cs]e", "font", ("1 0", "1 1")),
    "lppl": ("(?:the )?latex project public licen[cs]e", "latex", ("1 0", "1 1", "1 2", "1 3")),
    "ms-pl": ("(?:the )?microsoft public licen[cs]e", "microsoft", ()),
    "ms-rl": ("(?:the )?microsoft reciprocal licen[cs]e", "microsoft", ()),
    "qpl": ("(?:the )?q public licen[cs]e", "public", ("1 0",)),
    "npl": ("(?:the )?netscape public licen[cs]e", "netscape", ("1 0", "1 1")),
    "spl": ("(?:the )?sun public licen[cs]e", "sun", ("1 0",)),
    "rpl": ("(?:the )?reciprocal public licen[cs]e", "reciprocal", ("1 1", "1 5")),
    "odbl": ("(?:the )?open(?: data commons)? database licen[cs]e", "database", ("1 0",)),
    "pddl": ("(?:the )?public domain dedication and licen[cs]e", "dedication", ("1 0",)),
    "odc-by": ("(?:the )?open data commons attribution licen[cs]e", "attribution", ("1 0",)),
    "vim": ("(?:the )?vim licen[cs]e", "vim", ()),
    "w3c": ("(?:the )?w3c(?: software)?(?: notice and)? licen[cs]e", "w3c", ()),
    "cecill": ("(?:the )?cecill(?: [abc])? licen[cs]e|cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    "mulan": ("(?:the )?mulan(?: permissive software| public)? licen[cs]e", "mulan", ("1", "2")),
    "ecl": ("(?:the )?educational community licen[cs]e", "educational", ("1 0", "2 0")),
    "efl": ("(?:the )?eiffel forum licen[cs]e", "eiffel", ("1", "2")),
    "beerware": ("(?:the )?beer ?ware licen[cs]e", "beer", ()),
    "cc0": ("cc0(?: public domain dedication)?|creative commons zero", "c", ("1 0",)),
    "cc-by": ("creative commons attribution(?: licen[cs]e)?|cc by", "c", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-sa": ("creative commons attribution share ?alike(?: licen[cs]e)?|cc by sa", "c", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nd": ("creative commons attribution no ?deriv\\w+(?: licen[cs]e)?|cc by nd", "c", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc": ("creative commons attribution non ?commercial(?: licen[cs]e)?|cc by nc", "c", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-sa": ("creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?|cc by nc sa", "c", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-nd": ("creative commons attribution non ?commercial no ?deriv\\w+(?: licen[cs]e)?|cc by nc nd", "c", ("1 0", "2 0", "2 5", "3 0", "4 0")),
}
#: label: sentences of notices, which say more than a name does. Each is a signature of its own.
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy",
        "the software is provided as is without warranty of any kind",
        "to deal in the software without restriction including without limitation the rights",
        "to use copy modify merge publish distribute sublicen[cs]e and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "except as contained in this notice the names? of .{1,80}? shall not be used in advertising",
        "may be freely distributed under the mit licen[cs]e",
    ),
    "mit-0": ("permission is hereby granted free of charge to any person obtaining a copy .{1,400}? and to permit persons to whom the software is furnished to do so the software is provided",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "neither the name of .{1,80}? nor the names of its contributors",
        "redistributions of source code must retain the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice",
        "this software is provided by the copyright holders and contributors as is",
        "in no event shall the (?:copyright (?:holder|owner)s?|regents) or contributors be liable",
        "use of this source code is governed by a bsd style licen[cs]e",
    ),
    "bsd-4-clause": (
        "all advertising materials mentioning features or use of this software must display",
        "this product includes software developed by the university of california",
    ),
    "bsd-0-clause": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided",),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special direct indirect or consequential damages",
    ),
    "gpl": (
        "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e",
        "this program is free software you can redistribute it",
        "you should have received a copy of the gnu general public licen[cs]e",
        "this program comes with absolutely no warranty",
        "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document",
        "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software",
        "under the terms of the gnu gpl",
        "covered by the gnu general public licen[cs]e with the classpath exception",
    ),
    "gpl-2.0": ("either version 2 of the licen[cs]e or at your option any later version", "gnu general public licen[cs]e version 2 only"),
    "gpl-3.0": ("either version 3 of the licen[cs]e or at your option any later version", "gnu general public licen[cs]e version 3 only"),
    "lgpl": (
        "under the terms of the gnu (?:lesser|library) general public licen[cs]e",
        "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e",
        "this library is free software you can redistribute it",
        "this licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e",
    ),
    "agpl": (
        "under the terms of the gnu affero general public licen[cs]e",
        "you should have received a copy of the gnu affero general public licen[cs]e",
        "remote network interaction use with the gnu general public licen[cs]e",
    ),
    "gfdl": ("with no invariant sections no front cover texts and no back cover texts", "permission is granted to copy distribute and or modify this document"),
    "apache": (
        "you may not use this file except in compliance with the licen[cs]e",
        "unless required by applicable law or agreed to in writing software",
        "you may obtain a copy of the licen[cs]e at",
        "see the licen[cs]e for the specific language governing permissions and limitations",
        "licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements",
        "terms and conditions for use reproduction and distribution",
    ),
    "apache-1.1": ("this product includes software developed by the apache software foundation",),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public licen[cs]e",
        "if a copy of the mpl was not distributed with this file you can obtain one",
        "the contents of this file are subject to the mozilla public licen[cs]e",
        "this source code form is incompatible with secondary licen[cs]es",
    ),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "the accompanying program is provided under the terms of this eclipse public licen[cs]e"),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "you can obtain a copy of the licen[cs]e at usr src opensolaris licen[cs]e"),
    "eupl": ("licen[cs]ed under the eupl", "this european union public licen[cs]e the eupl applies to the work"),
    "bsl": ("distributed under the boost software licen[cs]e", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    "busl": ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "use of the licensed work in production is not permitted"),
    "sspl": ("if you make the functionality of the program or a modified version available to third parties as a service",),
    "elastic": ("you may not provide the software to third parties as a hosted or managed service",),
    "artistic": ("the intent of this document is to state the conditions under which a package may be copied", "this is free software you can redistribute it and or modify it under the same terms as perl itself"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors",
        "the origin of this software must not be misrepresented",
        "altered source versions must be plainly marked as such and must not be misrepresented",
    ),
    "libpng": ("the png reference library is supplied as is",),
    "openssl": ("this product includes software developed by the openssl project",),
    "php": ("this product includes php software freely available",),
    "python": ("psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e", "this licen[cs]e agreement is between the python software foundation"),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",),
    "ncsa": ("to deal with the software without restriction including without limitation the rights",),
    "upl": ("the above copyright notice and either this complete permission notice or at a minimum a reference to the upl must be included",),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed as long as the name is changed",),
    "beerware": ("if we meet some day and you think this stuff is worth it you can buy me a beer",),
    "ofl": ("this font software is licen[cs]ed under the sil open font licen[cs]e", "the font software may be sold as part of a larger software package but no copy of one or more of the font software"),
    "lppl": ("this work may be distributed and or modified under the conditions of the latex project public licen[cs]e",),
    "ms-pl": ("if you bring a patent claim against any contributor over patents that you claim are infringed by the software",),
    "odbl": ("this database is made available under the open database licen[cs]e", "any rights in individual contents of the database are licen[cs]ed under"),
    "cc0": ("to the extent possible under law the .{1,60}? has waived all copyright", "the person who associated a work with this deed has dedicated the work to the public domain"),
    "cc-by": ("this work is licen[cs]ed under a creative commons attribution", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    "cc-by-sa": ("if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e",),
    "cc-by-nc": ("you may not use the material for commercial purposes", "free for non ?commercial use only"),
    "cc-by-nd": ("if you remix transform or build upon the material you may not distribute the modified material",),
    "w3c": ("permission to copy and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted",),
    "commons-clause": ("the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software", "commons clause licen[cs]e condition"),
    "json": ("the software shall be used for good not evil",),
    "curl": ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",),
    "unicode": ("permission is hereby granted free of charge to any person obtaining a copy of the unicode data files",),
    "freetype": ("portions of this software are copyright .{1,40}? the freetype project",),
    "ijg": ("this software is based in part on the work of the independent jpeg group",),
    "proprietary": (
        "all rights reserved",
        "confidential and proprietary",
        "unauthorized copying of this file",
        "is (?:the )?(?:confidential and )?proprietary (?:information|property) of",
        "may not be (?:copied or )?reproduced (?:in any form )?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)",
        "trade secrets? and confidential information of",
        "for internal use only",
        "no part of this (?:publication|work|file) may be reproduced",
    ),
    "eula": ("by (?:installing|using|downloading) (?:this|the) software you (?:agree|accept)", "end user licen[cs]e agreement", "you may not reverse engineer decompile or disassemble"),
    "public-domain": (
        "(?:released|placed|dedicated) (?:in|to|into) the public domain",
        "this (?:file|code|work|software) is in the public domain",
        "the author disclaims copyright to this source code",
        "no copyright is claimed",
        "this is a work of the (?:u s|united states) government and is not subject to copyright protection",
    ),
}
#: Notices that name no licence's text, and so weigh less.
WEAK = ("proprietary", "public-domain", "eula")
GRANT = "(?:licen[cs]ed|released|distributed|available|covered|published|provided) (?:under|by|subject to) (?:the )?(?:terms of )?(?:the )?"
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Signature(NamedTuple):
    label: str
    priority: int
    weight: float
    keyword: str
    regex: re.Pattern


def _keyword(pattern: str) -> str:
    """The longest plain word that each match of a pattern without alternatives has."""
    plain = re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]\w*|\S*[\\.{}?]\S*", " ", pattern)
    return max(plain.split(), key=len)


@lru_cache(1)
def signatures() -> list[Signature]:
    """In order: notices, identifiers, names with a version in a grant, with one, in a grant, alone."""
    out = []
    add = lambda label, priority, weight, keyword, pattern: out.append(Signature(label, priority, weight, keyword, re.compile(f"(?<= )(?:{pattern})(?= )".encode())))
    for label, patterns in NOTICES.items():
        for p in patterns:
            add(label, 6, 0.6 if label in WEAK else 0.95, _keyword(p), p)
    for label, (name, keyword, versions) in FAMILIES.items():
        tag = label.replace("-", " ")
        add(label, 5, 0.99, "spdx", f"spdx licen[cs]e identifier {tag}")
        add(label, 2, 0.8, keyword, GRANT + f"(?:{name})")
        add(label, 1, 0.5, keyword, name)
        for v in versions:
            full = f"{label}-{v.replace(' ', '.')}"
            add(full, 5, 0.99, "spdx", f"spdx licen[cs]e identifier {tag} {v}(?: only| or later)?")
            add(full, 4, 0.95, keyword, GRANT + f"(?:{name})(?: version)? v?{v}")
            add(full, 3, 0.9, keyword, f"(?:{name})(?: version)? v?{v}")
    return sorted(out, key=lambda s: -s.priority)


@lru_cache(1)
def _gate():
    """An automaton of the keywords, and the signatures by keyword. Keywords that start words are looked for as such."""
    import ahocorasick

    by: dict[str, list[Signature]] = {}
    for s in signatures():
        by.setdefault(s.keyword, []).append(s)
    found = ahocorasick.Automaton()
    # a family with a keyword of one letter is gated by what its alternatives start with
    starts = {"g": ("general public", "gnu "), "c": ("creative commons", "cc by", "cc0"), "w": ("do what the", "wtfpl")}
    for k in by:
        for word in starts.get(k, (k,)):
            found.add_word(" " + word, k)
    found.make_automaton()
    return found, by


def normal(text: str) -> bytes:
    return b" " + b" ".join(text.encode().translate(NORMAL).split()) + b" "


class Detection(NamedTuple):
    label: str
    priority: int
    weight: float
    start: int
    end: int


def detect(norm: bytes) -> list[Detection]:
    """What stays of the signatures' matches, by place; start and end are in words."""
    gate, by = _gate()
    keys = {k for _, k in gate.iter(norm.decode("latin-1"))}
    hits = sorted(((m.start(), m.end(), s) for k in keys for s in by[k] for m in s.regex.finditer(norm)), key=lambda h: (h[0], -h[1], -h[2].priority, h[2].label))
    out, furthest, at, word = [], {}, 0, -1
    for start, end, s in hits:
        # what suppresses a hit starts no later, ends no earlier and is of no lower priority
        if not any(until >= end for p, until in furthest.items() if p >= s.priority):
            word += norm.count(b" ", at, start)
            at = start
            out.append(Detection(s.label, s.priority, s.weight, word, word + norm.count(b" ", start, end) + 1))
        furthest[s.priority] = max(end, furthest.get(s.priority, 0))
    return out


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    norm = normal(text or "")
    n_words = norm.count(b" ") - 1 if len(norm) > 2 else 0
    places, base = [], set()
    if b" license " in norm:
        for phrase, label in BASE.items():
            want = f" {phrase} ".encode()
            at = norm.find(want)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = norm.find(want, at + 1)
    found = detect(norm)
    word = lambda at: norm.count(b" ", 0, at)
    miss = 1.0
    for d in found:
        miss *= 1 - d.weight
    for _ in places if not found else ():
        miss *= 0.5
    first, last = (word(min(places)), word(max(places))) if places else (None, None)
    labels = base | {d.label for d in found}
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - miss, found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "array<struct<label:string,priority:int,weight:double,start:int,end:int>>"


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per document, with the detections."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("weight", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *cols, found = zip(*map(scan, batch.column(1).to_pylist()), strict=True)
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array([[d._asdict() for d in f] for f in found], kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, f"{SCHEMA}, detections {SPANS}")


def digest(docs: DataFrame) -> DataFrame:
    return scanned(docs).drop("detections")
