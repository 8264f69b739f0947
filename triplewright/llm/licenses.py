"""License recognition from sentences.

Known license sentences have identifiers. The text is cut into fragments at line and sentence ends, and runs
of normalised fragments are looked up, so that a sentence wrapped over lines is found too. Beside whole sentences
there are notices, made of a known opening and a name of a license, sentences with a hole for the holder's name,
and SPDX tags with an expression. Ordered rules then match the sequence of identifiers: the first rule that fits
at a place names a license and uses up its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import texts

# Sentences of public licenses and the notices that name them, as they are written.
SENTENCES = {
    "apache-2.0-name": ("Licensed under the Apache License, Version 2.0.",
                        'Licensed under the Apache License, Version 2.0 (the "License");',
                        "Apache License Version 2.0.", "Released under the Apache License, Version 2.0.",
                        "This project is licensed under the Apache License 2.0."),
    "apache-2.0-comply": ("you may not use this file except in compliance with the License.",),
    "apache-2.0-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "apache-2.0-as-is": ('Unless required by applicable law or agreed to in writing, software distributed under the '
                         'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                         'either express or implied.',),
    "mit-name": ("Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)",
                 "MIT License", "This project is licensed under the MIT License."),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
                  'associated documentation files (the "Software"), to deal in the Software without restriction, '
                  'including without limitation the rights to use, copy, modify, merge, publish, distribute, '
                  'sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
                  'furnished to do so, subject to the following conditions:',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the Software.",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                  "fee is hereby granted, provided that the above copyright notice and this permission notice "
                  "appear in all copies.",),
    "isc-name": ("ISC License", "Licensed under the ISC License."),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions "
                   "and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of "
                   "conditions and the following disclaimer in the documentation and/or other materials provided "
                   "with the distribution.",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to "
                    "endorse or promote products derived from this software without specific prior written "
                    "permission.",),
    "bsd-2-name": ("Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"),
    "bsd-3-name": ("Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version.",),
    "gpl-2-free": ("This program is free software; you can redistribute it and/or modify it under the terms of the "
                   "GNU General Public License as published by the Free Software Foundation; either version 2 of "
                   "the License, or (at your option) any later version.",),
    "gpl-3-name": ("This work is licensed under the GNU General Public License, version 3.",
                   "Licensed under the GNU General Public License, version 3.", "Licensed under GPL-3.0.",
                   "GNU General Public License version 3"),
    "gpl-2-name": ("This work is licensed under the GNU General Public License, version 2.",
                   "Licensed under the GNU General Public License, version 2.", "Licensed under GPL-2.0.",
                   "GNU General Public License version 2"),
    "lgpl-3-name": ("Licensed under the GNU Lesser General Public License, version 3.", "Licensed under LGPL-3.0."),
    "agpl-3-name": ("Licensed under the GNU Affero General Public License, version 3.", "Licensed under AGPL-3.0."),
    "mpl-2-name": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                   "Licensed under the Mozilla Public License, version 2.0."),
    "cc0-name": ("This work is licensed under CC0 1.0.", "Licensed under CC0 1.0."),
    "cc-by-name": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.",
                   "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-name": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.",
                      "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                      "License."),
    "cc-by-nc-name": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
                      "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                      "License."),
    "cc-by-nd-name": ("Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0."),
    "cc-by-nc-sa-name": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}

# Names of licenses as notices give them, by the identifier of the notice.
NAMES = {
    "apache-2.0-name": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0",
                        "Apache-2.0", "Apache License v2.0"),
    "mit-name": ("MIT License", "MIT", "Expat License"),
    "isc-name": ("ISC License", "ISC"),
    "bsd-2-name": ("BSD 2-Clause License", "BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License"),
    "bsd-3-name": ("BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License", "New BSD License",
                   "Modified BSD License"),
    "gpl-3-name": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"),
    "gpl-2-name": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"),
    "lgpl-3-name": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"),
    "agpl-3-name": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"),
    "mpl-2-name": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0",
                   "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"),
    "cc0-name": ("CC0 1.0", "CC0", "CC0 1.0 Universal"),
    "cc-by-name": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License",
                   "Creative Commons Attribution 4.0 License"),
    "cc-by-sa-name": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-name": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd-name": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc-sa-name": ("CC BY-NC-SA 4.0",
                         "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "unlicense": ("The Unlicense", "Unlicense"),
}

# Sentences in which "..." stands for the name of a holder or an organisation.
HOLES = {
    "bsd-endorse": ("Neither the name of ... nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission.",
                    "Neither the name of ... nor the names of their contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission.",
                    "The name of ... may not be used to endorse or promote products derived from this software "
                    "without specific prior written permission."),
}
#: Bytes that a hole takes at most, in normalised form.
HOLE = 120

#: License and the identifiers that give it, in order of preference; a longer form comes before its parts.
RULES = (
    ("Apache-2.0", ("apache-2.0-name", "apache-2.0-comply", "apache-2.0-copy", "apache-2.0-as-is")),
    ("Apache-2.0", ("apache-2.0-name", "apache-2.0-comply")),
    ("Apache-2.0", ("apache-2.0-name",)),
    ("MIT", ("mit-name", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-name", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-name",)),
    ("BSD-3-Clause", ("bsd-3-name", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-2-name", "bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-3-name",)),
    ("BSD-2-Clause", ("bsd-2-name",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-3.0-only", ("gpl-3-name",)),
    ("GPL-2.0-only", ("gpl-2-name",)),
    ("LGPL-3.0-only", ("lgpl-3-name",)),
    ("AGPL-3.0-only", ("agpl-3-name",)),
    ("MPL-2.0", ("mpl-2-name",)),
    ("CC0-1.0", ("cc0-name",)),
    ("CC-BY-4.0", ("cc-by-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-name",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-name",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-name",)),
    ("Unlicense", ("unlicense",)),
)

_END = re.compile(rb"(?<=[.;:!?])[\x20\x09-\x0D]+|\n")
_SIGNS = re.compile(rb"[^a-z0-9\x80-\xff]+")
_TAG = b"spdx license identifier"
#: How a notice begins, in normalised form; the name of a license follows.
_OPENING = re.compile(
    rb"(?:(?:this|the) (?:file|work|project|software|program|code|source code|document|library|package|repository|"
    rb"module) (?:is |are )?)?(?:(?:dual )?licensed|released|distributed|published|available|made available|provided) "
    rb"under (?:the )?(?:terms of )?(?:the )?")
#: What an SPDX expression joins names with; what follows WITH is an exception and no license.
_JOINTS = re.compile(rb" (?:or|and) ")


def normalised(sentence: bytes) -> bytes:
    """ASCII letters in lower case, every run of other signs one space."""
    return _SIGNS.sub(b" ", sentence.lower()).strip()


KNOWN = {normalised(s.encode()): name for name, forms in SENTENCES.items() for s in forms}
_NAMES = {normalised(s.encode()): name for name, forms in NAMES.items() for s in forms}
_HOLES = [(*(normalised(part.encode()) for part in s.split("...")), name) for name, forms in HOLES.items() for s in forms]
_TAGS = {normalised(name.encode()): name for name, _ in RULES}
_LONGEST_NOTICE = max(map(len, _NAMES)) + 80
_LONGEST = max(*map(len, KNOWN), _LONGEST_NOTICE, *(len(a) + len(b) + HOLE + 2 for a, b, _ in _HOLES))
_STARTS = ({k.split(b" ", 1)[0] for k in KNOWN} | {a.split(b" ", 1)[0] for a, _, _ in _HOLES}
           | set(b"this the dual licensed released distributed published available made provided".split()))


def _identifier(run: bytes) -> str | None:
    """The identifier of a normalised sentence: known as a whole, with a hole, or as a notice."""
    if name := KNOWN.get(run):
        return name
    for before, after, name in _HOLES:
        hole = len(run) - len(before) - len(after) - 2
        if 0 < hole <= HOLE and run.startswith(before + b" ") and run.endswith(b" " + after):
            return name
    if len(run) <= _LONGEST_NOTICE and (opening := _OPENING.match(run)):
        rest = run[opening.end():]
        return _NAMES.get(rest) or _NAMES.get(rest.removesuffix(b" license"))
    return None


def _expression(found: bytes) -> list[str]:
    """The licenses of a normalised SPDX expression, in order; names that are not known give none."""
    parts = (part.split(b" with ", 1)[0] for part in _JOINTS.split(found))
    return [_TAGS[part] for part in parts if part in _TAGS]


def sentence_ids(body: bytes) -> Iterator[tuple[str, bytes]]:
    """The known sentences of a text in order, as (identifier, normalised sentence).

    Of the runs of fragments that are known at a place, the longest counts, and the next place is behind it.
    """
    fragments = [f for f in map(normalised, _END.split(body)) if f]
    at = 0
    while at < len(fragments):
        run, end = fragments[at], at + 1
        if run.split(b" ", 1)[0] in _STARTS:
            best = None
            while len(run) <= _LONGEST:
                if name := _identifier(run):
                    best = (name, run, end)
                if end == len(fragments):
                    break
                run, end = run + b" " + fragments[end], end + 1
            if best:
                yield best[:2]
                at = best[2]
                continue
            run, end = fragments[at], at + 1
        if run.endswith(_TAG) and end < len(fragments) and (names := _expression(fragments[end])):
            for name in names:
                yield f"spdx:{name}", run + b" " + fragments[end]
            end += 1
        at = end


def matched_rules(ids: list[str]) -> list[str]:
    """The licenses of a sequence of identifiers, in order; sentences that no rule uses give none."""
    out, at = [], 0
    while at < len(ids):
        if ids[at].startswith("spdx:"):
            out.append(ids[at][5:])
            at += 1
            continue
        name, used = next(((n, len(r)) for n, r in RULES if tuple(ids[at:at + len(r)]) == r), (None, 1))
        if name:
            out.append(name)
        at += used
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentences, n_licenses, n_sentences) of every row (doc_id, text), from the whole text.

    ``licenses`` holds the different licenses found, sorted, ``sentences`` the identifiers in order. Both are
    empty for a null or empty text, and for one that names no license. Repeated rows give repeated rows.
    """

    def rows(batches):
        for batch in batches:
            names, sequences = [], []
            for body in texts(batch.column(1)):
                found = []
                if body:
                    found = [name for name, _ in sentence_ids(body)]
                sequences.append(found)
                names.append(sorted(set(matched_rules(found))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(sequences, pa.list_(pa.string())),
                 pa.array([len(n) for n in names], pa.int64()), pa.array([len(s) for s in sequences], pa.int64())],
                ["doc_id", "licenses", "sentences", "n_licenses", "n_sentences"])

    schema = ("doc_id long, licenses array<string>, sentences array<string>, n_licenses long, n_sentences long")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)
