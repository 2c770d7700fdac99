"""License scan with a generalised suffix automaton of licence tokens.

All templates (short notices, headers and licence texts, written down below) form one automaton. Each document is
streamed through it word by word, which gives matching statistics: the longest template substring ending at each
word. Right-maximal matches of MIN_MATCH words or more become anchors in every template they occur in; anchors in
order in text and template, at most MAX_GAP words apart, are chained. A chain that covers half of a template is a span;
notices of up to SHORT words must stand word for word, as theirs differ in single words. Where spans of different
licences overlap, the fullest stays. Base phrases are templates too; a place is found when the state's suffix chain holds the whole phrase.

Words outside the templates reset the automaton, so only runs of template words are walked.

Nulls: a null text has no words and no labels. Empty texts likewise; an empty table gives an empty result; repeated
rows are scanned each, of equal spans one stays. Long texts are scanned whole, in time that grows with their words and
matches. Other columns come back inside _row, untouched.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import documents, packed
from ._words import ALNUM, Vocabulary, Words, runs, slices

#: Fixed values of the contract.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Public licence notices and texts. (label, text)
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see"),
    ("lgpl-2", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
MIN_MATCH, MAX_GAP, SHORT, COVER_LONG = 3, 8, 12, 0.5


class Automaton:
    """Generalised suffix automaton over sequences of small integers."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.len = [{}], [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        self.whole: list[int] = []
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, ends)
                ends[last].append((t, i + 1))
            self.whole.append(last)
        self.at: list[list[tuple[int, int]]] = [list(e) for e in ends]
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            self.at[self.link[s]].extend(self.at[s])
        self.at = [sorted(set(a)) for a in self.at]

    def _new(self, length: int, nxt: dict, link: int, ends: list) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(link)
        ends.append([])
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int, ends: list) -> int:
        k = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _extend(self, p: int, c: int, ends: list) -> int:
        if c in self.next[p]:
            q = self.next[p][c]
            return q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q, ends)
        cur = self._new(self.len[p] + 1, {}, 0, ends)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q, ends)
        return cur

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) after each symbol."""
        s = n = 0
        nxt, link, length = self.next, self.link, self.len
        for c in seq:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            yield n, s


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        texts = [(label, t.encode()) for label, t in [*base, *templates]]
        words = Words([t for _, t in texts], ALNUM)
        hashes = words.hashes()
        self.vocabulary, self.n_base = Vocabulary(hashes), len(base)
        ids = self.vocabulary.ids(hashes)
        self.seqs = [ids[words.first[i] : words.first[i + 1]].tolist() for i in range(len(texts))]
        self.labels = [label for label, _ in texts]
        self.auto = Automaton(self.seqs)
        self.short = [i < self.n_base or len(q) <= SHORT for i, q in enumerate(self.seqs)]
        self.whole_at: list[list[int]] = [[] for _ in self.auto.len]  # short templates that end a state's strings
        holders: dict[int, list[int]] = {}
        for i, whole in enumerate(self.auto.whole):
            if self.short[i]:
                holders.setdefault(whole, []).append(i)
        for s in range(1, len(self.auto.len)):
            a = s
            while a > 0:
                self.whole_at[s] += holders.get(a, [])
                a = self.auto.link[a]
        self.shortest = min(MIN_MATCH, *(len(s) for s in self.seqs))

    def scan(self, ids: np.ndarray, first: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Base places (start, phrase) and spans (label, first word, end word, covered share), words from ``first``."""
        own = ids[first:end]
        starts, ends = runs(own >= 0, np.empty(0, np.int64))
        long = ends - starts >= self.shortest
        anchors, notices = [], []
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            prev_n = prev_s = 0
            i = a
            for n, s in self.auto.stream(own[a:b].tolist()):
                if prev_n >= MIN_MATCH and n != prev_n + 1:
                    anchors.append((i, prev_n, prev_s))
                i += 1
                for p in self.whole_at[s]:
                    if n >= len(self.seqs[p]):
                        notices.append((p, i - len(self.seqs[p]), i))
                prev_n, prev_s = n, s
            if prev_n >= MIN_MATCH:
                anchors.append((i, prev_n, prev_s))
        places = [(b, p) for p, b, _ in notices if p < self.n_base]
        return places, self._chain(anchors, notices)

    def _chain(self, anchors: list[tuple[int, int, int]], notices: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """anchors: (end word, length, state), by end word. Chains are open only while a gap of MAX_GAP isn't passed.
        notices: (template, first word, end word) of short templates, which stand whole."""
        open_by: dict[int, list[list[int]]] = {}
        done: list[tuple[int, list[int]]] = []
        for e, n, s in anchors:
            for t, te in self.auto.at[s]:
                if self.short[t]:
                    continue
                chains, best = open_by.setdefault(t, []), None
                still = []
                for c in chains:  # [doc end, template end, doc start, covered]
                    if e - n - c[0] > MAX_GAP:
                        done.append((t, c))
                    else:
                        still.append(c)
                        if te > c[1] and -MAX_GAP <= te - n - c[1] <= MAX_GAP and (best is None or c[3] > best[3]):
                            best = c
                open_by[t] = still
                if best is None:
                    still.append([e, te, e - n, n])
                else:
                    best[3] += min(n, te - best[1], max(0, e - best[0]))
                    best[0], best[1] = e, te
        done += [(t, c) for t, chains in open_by.items() for c in chains]
        found = {(b - e, -1.0, b, e, self.labels[p]) for p, b, e in notices}
        for t, (e, _, b, covered) in done:
            share = min(1.0, covered / len(self.seqs[t]))
            if share >= COVER_LONG:
                found.add((-covered, -share, b, e, self.labels[t]))
        out: list[tuple[str, int, int, float]] = []
        starts, held = [], []  # disjoint stretches of one label each, by start: what is taken
        for _, share, b, e, label in sorted(found):  # the fullest span holds its place against other licences
            i = bisect_right(starts, b)
            i -= i > 0 and held[i - 1][0] > b
            j = i
            while j < len(starts) and starts[j] < e:
                j += 1
            if any(x[1] != label for x in held[i:j]):
                continue
            out.append((label, b, e, -share))
            end = max([e, *(x[0] for x in held[i:j])])
            starts[i:j], held[i:j] = [min([b, *starts[i:j]])], [(end, label)]
        return sorted(out)


_SPAN = [("label", T.StringType(), pa.string()), ("first_word", T.LongType(), pa.int64()), ("end_word", T.LongType(), pa.int64()), ("covered", T.DoubleType(), pa.float64())]
_PLACE = [("start", T.LongType(), pa.int64()), ("label", T.StringType(), pa.string())]


def _spark_list(fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in fields]))


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, text, _row (all other columns), n_words, places (of base phrases), spans (covered template spans)."""
    docs = packed(docs)

    def listed(rows: list[list[tuple]], fields) -> pa.Array:
        kind = pa.list_(pa.struct([(n, a) for n, _, a in fields]))
        return pa.array([[dict(zip((n for n, _, _ in fields), r, strict=True)) for r in x] for x in rows], kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for batch, texts in slices(batches):
            words = Words(texts, ALNUM)
            ids = scanner.vocabulary.ids(words.hashes())
            found = [scanner.scan(ids, words.first[d], words.first[d + 1]) for d in range(len(texts))]
            places = [[(i, scanner.labels[p]) for i, p in f[0]] for f in found]
            cols = [pa.array(words.counts, pa.int64()), listed(places, _PLACE), listed([f[1] for f in found], _SPAN)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "n_words", "places", "spans"])

    new = [T.StructField("n_words", T.LongType()), T.StructField("places", _spark_list(_PLACE)), T.StructField("spans", _spark_list(_SPAN))]
    return docs.mapInArrow(work, T.StructType([*docs.schema, *new]))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    base, spans = F.col("places"), F.col("spans")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"), joined(F.concat(base["label"], spans["label"])).alias("labels"),
        F.greatest(F.coalesce(F.array_max(spans["covered"]), F.lit(0.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0)).alias("score"),
    )
