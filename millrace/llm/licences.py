"""Licence scans by a trained paragraph classifier.

Sparse word n-gram logistic regression names the licence family of a window
of lines, with an unknown class; the least probability of a family is
calibrated on held-out windows. A comparison with the family's templates, and
with the words that tell it from its relatives, confirms each prediction.

A notice is looked for wherever a line holds a word that every notice has (an
anchor): windows of 1 to 32 lines from there on are classified, so that
notices wrapped over lines, over paragraphs or inside prose are found whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.boosting import threshold
from millrace.llm.util import batches, texts

# Notices of each family as they are commonly written.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "isc": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "bsd-2-clause": (
        "Licensed under the BSD 2-Clause License.",
        "Released under the Simplified BSD License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-3-clause": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the New BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "epl-2.0": (
        "Licensed under the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.",
    ),
    "zlib": (
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented.",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    ),
    "unlicense": (
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "wtfpl": (
        "Licensed under the WTFPL.",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2. Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    ),
    "cc0-1.0": (
        "This work is released under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved.",
    ),
}
#: Words, as this module reads them, that a family's notice has (one of each line), and such that it never has.
MARKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "apache-2.0": (("apache",), ("apache license version 1", "apache 1")),
    "mit": ((r"\bmit\b|permission is hereby granted free of charge to any person obtaining a copy of this software",), (r"\bisc\b", "boost")),
    "isc": ((r"\bisc\b|with or without fee is hereby granted",), (r"\bmit\b",)),
    "bsd-2-clause": (("bsd 2|2 clause|simplified bsd|must reproduce the above",), ("neither the name", "3 clause", "4 clause", "new bsd", "all advertising")),
    "bsd-3-clause": (("bsd 3|3 clause|new bsd|revised bsd|modified bsd|neither the name of",), ("2 clause", "simplified bsd", "4 clause", "all advertising")),
    "mpl-2.0": ((r"mozilla public|\bmpl\b", r"\b2 0\b"), ("mpl 1", "version 1 1")),
    "epl-2.0": ((r"eclipse public|\bepl\b", r"\bv?2 0\b"), ("epl 1", "v1 0")),
    "zlib": (("zlib|alter it and redistribute it freely",), ()),
    "bsl-1.0": (("boost|bsl 1|person or organization obtaining a copy",), ()),
    "unlicense": (("unlicense|free and unencumbered software",), ()),
    "wtfpl": (("wtfpl|do what the fuck you want to",), ()),
    "cc0-1.0": (("cc0",), ("cc by",)),
    "proprietary": (("all rights reserved",), ("redistribut", "permission is hereby granted", "apache", "creative commons", "gnu", "public license", r"\bbsd\b", r"\bmit\b")),
}
#: Short name, its own words, words of relatives, versions.
_GNU = {"gpl": ("gnu general public licen[cs]e|gpl", "lesser|library general|affero|lgpl|agpl", ("2.0", "3.0")), "lgpl": ("lesser general public|lgpl", "affero|agpl", ("2.1", "3.0")), "agpl": ("affero general public|agpl", "lesser|lgpl", ("3.0",))}
_GNU_NAMES = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}
_CC = {"by": ("Attribution", "attribution|by"), "nc": ("NonCommercial", "non ?commercial|nc"), "nd": ("NoDerivatives", "no ?deriv[a-z]*|nd"), "sa": ("ShareAlike", "share ?alike|sa")}
_CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")


def _grow() -> None:
    """The families of the two trees of licences whose notices follow a rule."""
    for short, (own, others, versions) in _GNU.items():
        for v in versions:
            name, major = _GNU_NAMES[short], v[0] if v.endswith("0") else v
            told = r"(?:version|v|l|gpl ?v?) ?" + major.replace(".", " ") + r"\b"
            wrong = rf"(?:version |gpl ?v|\bv|gpl ){'[12]' if major == '3' else '[13]' if major == '2' else '[13]'}\b"
            TEMPLATES[f"{short}-{v}"] = (
                f"This work is licensed under the {name}, version {major}.",
                f"Released under the {short.upper()}v{major}.",
                f"SPDX-License-Identifier: {short.upper()}-{v}-or-later",
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {major} of the License, or (at your option) any later version.",
                f"This library is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; version {major} of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
            )
            MARKS[f"{short}-{v}"] = ((own, told), (others, wrong))
    for kind in _CC_KINDS:
        parts = kind.split("-")
        for v in ("3.0", "4.0"):
            long = "-".join(_CC[p][0] for p in parts)
            TEMPLATES[f"cc-{kind}-{v}"] = (
                f"Licensed under CC {kind.upper()} {v}.",
                f"SPDX-License-Identifier: CC-{kind.upper()}-{v}",
                f"This work is licensed under a Creative Commons {long} {v} International License.",
            )
            has = tuple(rf"\b(?:{_CC[p][1]})\b" for p in parts)
            MARKS[f"cc-{kind}-{v}"] = ((r"creative commons|\bcc\b", v.replace(".", " "), *has), tuple(rf"\b(?:{_CC[p][1]})\b" for p in _CC if p not in parts))


_grow()
UNKNOWN = "unknown"
#: Every template has one of these in its first words; a line without any starts no notice.
ANCHORS = ("licen", "copyright", "redistribut", "permission", "warrant", "rights reserved", "creative commons", "cc by", "cc-by", "cc0", "spdx", "public domain", "free software", "gpl", "source code form", "subject to the terms", "accompanying materials", "proprietary", "wtfpl", "under law", "what the fuck")
#: What is no notice, though it sounds like one.
ALIKE = (
    "the terms of the contest are free of charge", "all rights to the throne were reserved for the king", "a copy of the book without restriction", "she asked permission to use the car", "he lost his driving license in the spring",
    "a licensed electrician must check the wires", "copyright infringement was claimed in the lawsuit", "the general public may visit the garden", "the warranty of the machine ended in version 3 of the contract", "redistribution of land followed the war",
    "the song is now in the public domain", "creative commons of the village are open to all", "software is free of errors only in theory", "no part of the house may be used without the permission of the owner", "the license plate was found in the lake",
    "a license to kill", "the fishing licence costs ten coins", "permission was granted by the mayor", "they hold the copyright of all his letters", "the warrant was signed by a judge",
)
SIZES = (1, 2, 4, 8, 16, 32)
_WORDS = re.compile(r"[^\W_]+").findall


@dataclass(frozen=True)
class Scan:
    """background: most lines of the corpus, those of least hash that have an anchor, that stand for the unknown
    class in training. precision: share of notices among held-out windows, from the least probability of a notice on. alike: least
    share of a template's word pairs that a window has, to confirm. copies: noisy variants of each template to train on."""

    background: int = 2000
    precision: float = 0.98
    alike: float = 0.6
    copies: int = 10


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)


class Classifier:
    """Multinomial logistic regression over the n-grams of the templates; class 0 is unknown."""

    def __init__(self, background: list[str], scan: Scan, seed: int = 7):
        self.scan, self.names = scan, [UNKNOWN, *TEMPLATES]
        said = {name: [_WORDS(t.lower()) for t in ts] for name, ts in TEMPLATES.items()}
        self.place = {g: i for i, g in enumerate(sorted({g for ts in said.values() for t in ts for g in grams(t)}))}
        self.known = {name: [_pairs(t) for t in ts] for name, ts in said.items()}
        self.marks = {name: ([re.compile(x).search for x in has], [re.compile(x).search for x in never]) for name, (has, never) in MARKS.items()}
        rng, rows, labels = np.random.default_rng(seed), [], []
        other = [w for t in (*ALIKE, *background[:200]) for w in _WORDS(t.lower())[:30]]
        for c, ts in enumerate(said.values(), 1):
            for t in ts:
                for n in range(scan.copies):  # words lost, cut short, among other words: as in copied and edited notices
                    keep = rng.random(len(t)) > (0.12 if n and len(t) > 8 else 0)
                    words = [w for w, k in zip(t, keep, strict=True) if k]
                    if n % 3 == 1 and len(words) > 30:
                        words = words[: int(len(words) * rng.uniform(0.6, 1))]
                    if n % 2:
                        around = [other[i] for i in rng.integers(0, len(other), int(len(words) * rng.uniform(0, 0.8)))]
                        cut = int(rng.integers(0, len(around) + 1))
                        words = [*around[:cut], *words, *around[cut:]]
                    rows.append(self.encode(words))
                    labels.append(c)
        for t in (*ALIKE, *background):
            words = _WORDS(t.lower())
            if not any(self.fits(words, name)[1] for name in TEMPLATES):
                rows.append(self.encode(words))
                labels.append(0)
        for g in self.place:  # a lone gram of a template proves nothing
            if " " not in g:
                rows.append(self.encode([g]))
                labels.append(0)
        y, held = np.array(labels), rng.random(len(rows)) < 0.2
        x = np.zeros((len(rows), len(self.place) + 1), np.float32)
        for r, row in enumerate(rows):
            x[r, list(row)] = list(row.values())
        self._fit(x[~held], y[~held])
        some = 1 - self._soft(x[held] @ self.w + self.b)[:, 0]
        self.certain = min(1 - 1e-6, max(0.5, threshold(some, np.ones(len(some)), (y[held] > 0).astype(float), scan.precision)))

    def encode(self, words: list[str]) -> dict[int, float]:
        """A unit vector of the n-grams known from templates, with the share of words that are not as its last feature."""
        hit = {i for g in grams(words) if (i := self.place.get(g)) is not None}
        foreign = 1 - sum(w in self.place for w in words) / max(1, len(words))
        size = max(1, len(hit)) ** 0.5
        return {**{t: 1 / size for t in hit}, len(self.place): foreign}

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 4.0, decay: float = 1e-5) -> None:
        many = np.bincount(y, minlength=len(self.names))
        weight = (len(y) / (len(self.names) * np.maximum(many, 1)))[y][:, None].astype(np.float32)
        self.w, self.b = np.zeros((x.shape[1], len(self.names)), np.float32), np.zeros(len(self.names), np.float32)
        goal, speed_w, speed_b = np.eye(len(self.names), dtype=np.float32)[y], 0.0, 0.0
        for _ in range(rounds):
            error = weight * (goal - self._soft(x @ self.w + self.b)) / len(y)
            speed_w = 0.9 * speed_w + x.T @ error - decay * self.w
            speed_b = 0.9 * speed_b + error.sum(axis=0)
            self.w += rate * speed_w
            self.b += rate * speed_b

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def fits(self, words: list[str], name: str) -> tuple[float, int]:
        """Of the template that the window has most word pairs of, the share of them and their number, if it has the family's marks and none of its relatives'; else zeros."""
        has, never = self.marks[name]
        text = " ".join(words)
        if not all(x(text) for x in has) or any(x(text) for x in never):
            return 0.0, 0
        own = _pairs(words)
        share, many = max((n / len(p), n) for p in self.known[name] for n in [len(own & p)])
        return (share, many) if share >= self.scan.alike else (0.0, 0)

    def predict(self, words: list[str]) -> tuple[str, float, float, int] | None:
        """(family, probability, share and number of the pairs of a template, zeros if not confirmed), or None if unknown is likelier or no family is certain enough.

        What must be certain is that it is a notice at all. Relatives whose notices
        differ in a few words share the probability; of those that the templates
        confirm, the one with most of a template is meant.
        """
        row = self.encode(words)
        if len(row) == 1:
            return None  # no n-gram of any template
        p = self._soft(self.b + self.w[list(row)].T @ np.array(list(row.values()), np.float32))
        c = int(np.argmax(p))
        if c == 0 or 1 - p[0] < self.certain:
            return None
        fits = {i: f for i in np.argsort(-p)[:8].tolist() if i and (f := self.fits(words, self.names[i]))[1]}
        if fits:
            c = max(fits, key=lambda i: (fits[i][1], fits[i][0], p[i]))
        return self.names[c], float(p[c]), *fits.get(c, (0.0, 0))

    def scan_lines(self, lines: list[str]) -> list[dict]:
        """Notices by their first line; a window that is confirmed is searched no further."""
        low, found, after = [x.lower() for x in lines], [], 0
        words = [_WORDS(x) for x in low]
        for i, line in enumerate(low):
            if i < after or not any(a in line for a in ANCHORS):
                continue
            best, most = None, 0
            for size in SIZES:
                if size > 1 and (i + size // 2 >= len(lines) or not any(words[i + size // 2 : i + size])):
                    continue  # nothing new but blank lines
                window = [w for x in words[i : i + size] for w in x]
                if got := self.predict(window):
                    hit = {"line": i, "lines": min(size, len(lines) - i), "family": got[0], "probability": got[1], "overlap": got[2], "confirmed": got[3] > 0}
                    if best is None or got[3] > most:
                        best, most = hit, got[3]
            if best:
                while most and best["lines"] > 1:  # without the lines around that add nothing
                    first, last = best["line"], best["line"] + best["lines"]
                    inner = [(a, b) for a, b in ((first + 1, last), (first, last - 1)) if self.fits([w for x in words[a:b] for w in x], best["family"])[1] == most]
                    if not inner:
                        break
                    best["line"], best["lines"] = inner[0][0], inner[0][1] - inner[0][0]
                found.append(best)
                after = best["line"] + best["lines"] if best["confirmed"] else after
        return found


def scan_licences(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scan: Scan | None = None) -> DataFrame:
    """doc_id, n_lines, found: array<struct<line, lines, family, probability, overlap, confirmed>> of each row.

    A prediction that no template confirms is returned as not confirmed. Null
    and empty texts have no lines. Whole texts are read, however long. Of
    windows from one line the one with most of a template counts, of equal ones the shorter. Repeated rows and rows with a null id each
    give a row; other columns, whatever their names, are not read. An empty
    table gives an empty one. There is no shuffle but for the sample.
    """
    scan = scan or Scan()
    docs = texts(df, id_col, text_col)
    some = F.lit(False)
    for a in ANCHORS:
        some = some | F.col("low").contains(a)
    near = docs.withColumn("low", F.lower("text")).where(some).select(F.explode(F.split("low", "\n")).alias("low")).where(some).distinct()
    background = [r.low for r in near.select("low", F.xxhash64("low").alias("h")).orderBy("h", "low").limit(scan.background).collect()]
    model = df.sparkSession.sparkContext.broadcast(Classifier(background, scan))
    kind = pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64()), ("confirmed", pa.bool_())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches(stream, 256):
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                counts.append(text.count("\n") + 1 if text else 0)
                low = text.lower()
                found.append(own.scan_lines(text.split("\n")) if any(a in low for a in ANCHORS) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_lines", "found"])

    return docs.mapInArrow(run, "doc_id long, n_lines long, found array<struct<line: int, lines: int, family: string, probability: double, overlap: double, confirmed: boolean>>")
