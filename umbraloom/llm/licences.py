"""Licence scan: sentences of a text become identifiers of known licence sentences, and runs of identifiers match ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Licences and the sentences that state them, longer statements first; an earlier rule takes its sentences from later ones.
RULES = (
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("GPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("GPL-2.0-or-later", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
    ("AGPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("LGPL-3.0-or-later", 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("LGPL-2.1-or-later", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty.\nIn no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("EPL-2.0", 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at'),
    ("CC0-1.0", 'To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0.'),
    ("MIT", 'Released under the MIT License.'),
    ("MIT", 'Licensed under the MIT License.'),
    ("GPL-3.0", 'This work is licensed under the GNU General Public License, version 3.'),
    ("CC-BY-NC-4.0", 'Licensed under CC BY-NC 4.0.'),
    ("CC-BY-4.0", 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
    ("CC-BY-SA-4.0", 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.'),
)
#: Identifiers that may stand in a tag.
TAGS = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "EPL-2.0", "Zlib", "BSL-1.0", "CC0-1.0", "0BSD", "Unlicense")
RULES += tuple((name, f"SPDX-License-Identifier:\n{name}") for name in TAGS)
#: Unknown sentences that may stand between two of a rule.
GAP = 2
#: A piece ends at a line feed, or at one of .!?:; before white space or the end. The SQL takes pieces for sentences; the
#: operator also joins those of a wrapped sentence.
SENTENCE = r"(?:[^.!?:;\n]+|[.!?:;]+[^\s.!?:;])+"
_SENTENCE = re.compile(SENTENCE.replace(r"\s", r" \t\n\f\r"))
_FOLD = {i: i + 32 for i in range(65, 91)}
_OTHER = re.compile(r"[^a-z0-9]+")
#: What stands between two pieces of a wrapped sentence: one line feed and comment marks that are no part of a piece.
_WRAP = re.compile(r"[ \t\f\r]*\n[ \t\f]*[;:!]*[ \t\f]*")
#: Comment marks that are words.
_REMARK = re.compile(r"(?:dnl|rem) ")


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.translate(_FOLD)).strip()


def identifiers(rules: tuple[tuple[str, str], ...]) -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """The known sentences' identifiers, and the rules as runs of them."""
    known: dict[str, int] = {}
    runs = [(name, tuple(known.setdefault(normalised(m.group()), len(known) + 1) for m in _SENTENCE.finditer(text) if normalised(m.group()))) for name, text in rules]
    return known, runs


def beginnings(known: dict[str, int]) -> set[str]:
    """The beginnings of known sentences, by whole words, where a line may end."""
    return {" ".join(words[:i]) for words in map(str.split, known) for i in range(1, len(words))}


def sentences(text: str, known: dict[str, int], starts: set[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(identifier, first piece, last piece, start, end) of each known sentence; the longest where one begins another."""
    pieces = list(_SENTENCE.finditer(text))
    words = [_REMARK.sub("", n, count=1) if n.startswith(("dnl ", "rem ")) else n for n in (normalised(m.group()) for m in pieces)]
    k = 0
    while k < len(pieces):
        whole, last, got = words[k], k, None
        while True:
            if whole in known:
                got = known[whole], k, last, pieces[k].start(), pieces[last].end()
            if whole not in starts or last + 1 == len(pieces) or not words[last + 1] or not _WRAP.fullmatch(text, pieces[last].end(), pieces[last + 1].start()):
                break
            last += 1
            whole += " " + words[last]
        if got:
            yield got
            k = got[2]
        k += 1


def scan(text: str, known: dict[str, int], runs: list[tuple[str, tuple[int, ...]]], gap: int = GAP, starts: set[str] | None = None) -> tuple[int, list[tuple[str, int, int]]]:
    """The number of known sentences, and (licence, start, end) of each match in code points."""
    ids, at, places = [], [], []
    for n, first, last, start, end in sentences(text, known, beginnings(known) if starts is None else starts):
        ids.append(n)
        at.append((first, last))
        places.append((start, end))
    found: list[tuple[str, int, int]] = []
    taken = [len(runs)] * len(ids)  # the first rule that occurs over each sentence
    hits = []
    for r, (name, run) in enumerate(runs):
        for i in range(len(ids) - len(run) + 1):
            if tuple(ids[i : i + len(run)]) == run and all(at[j + 1][0] - at[j][1] <= gap + 1 for j in range(i, i + len(run) - 1)):
                hits.append((r, i, i + len(run)))
                for j in range(i, i + len(run)):
                    taken[j] = min(taken[j], r)
    for r, i, j in hits:
        if min(taken[i:j]) == r:
            found.append((runs[r][0], places[i][0], places[j - 1][1]))
    return len(ids), sorted(found, key=lambda f: f[1:])


def licence_scan(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(doc_id, n_sentences, n_matches, licences, matches) for every row of docs, one for one.

    n_sentences counts known licence sentences, those wrapped over lines too, licences is the sorted comma-joined list of different ones, or empty.
    A match is dropped where an earlier rule occurs over one of its sentences. Null and empty texts match nothing; a null doc_id is
    passed on; repeated rows get a row each; texts of any length are read whole; an empty table gives no rows. Other columns are not read.
    """
    known, runs = identifiers(rules)
    starts = beginnings(known)
    ids = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t.as_py() or "", known, runs, starts=starts) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([len(f) for _, f in got], pa.int64()), pa.array([",".join(sorted({x[0] for x in f})) for _, f in got], pa.string()),
                pa.array([[dict(zip(("licence", "start", "end"), x, strict=True)) for x in f] for _, f in got], kind),
            ], ["doc_id", "n_sentences", "n_matches", "licences", "matches"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {ids}, n_sentences long, n_matches long, licences string, matches array<struct<licence:string,start:int,end:int>>")


def licence_sql() -> str:
    known, runs = identifiers(RULES)
    sentences = ", ".join(f"({n}, '{s}')" for s, n in known.items())
    items = ", ".join(f"({r}, '{name}', {i}, {n}, {len(run)})" for r, (name, run) in enumerate(runs) for i, n in enumerate(run))
    return rf"""
        WITH known(sid, s) AS (VALUES {sentences}), rules(r, name, i, sid, len) AS (VALUES {items}),
             x AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS ss FROM documents),
             y AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS raw FROM x),
             z AS (SELECT doc_id, pos, sid FROM y JOIN known ON trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) = s),
             o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {GAP + 1} AS near FROM z),
             h AS (SELECT doc_id, r, name, o.k - i AS k0, any_value(len) AS len FROM o JOIN rules USING (sid) WHERE i = 0 OR near GROUP BY doc_id, r, name, o.k - i HAVING count(*) = any_value(len)),
             m AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h e WHERE e.doc_id = h.doc_id AND e.r < h.r AND e.k0 < h.k0 + h.len AND h.k0 < e.k0 + e.len)),
             n AS (SELECT doc_id, count(*) AS n_sentences FROM z GROUP BY doc_id),
             q AS (SELECT doc_id, count(*) AS n_matches, array_to_string(list_sort(list(DISTINCT name)), ',') AS licences FROM m GROUP BY doc_id)
        SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id)"""
