"""License scans: which license notices and license texts a document holds.

Every shingle of every template is indexed. The places where a document has a template's shingle are found exactly, and
the template's containment is the share of its distinct shingles inside one stretch of the document, the best over all
stretches of SPAN times the template's length. Nothing is sampled, so a notice is found wherever it begins, and with
words put in between as long as the threshold and the stretch let them.
"""

from __future__ import annotations

from importlib.resources import files

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_words, shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: Length of a stretch in lengths of its template: as much again as the template may stand in between.
SPAN = 2
#: Places of the table that sorts out most shingles at once.
_QUICK = 1 << 20
#: Notices in common use (fixed wordings).
TEMPLATES = {
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
    "mit": "Released under the MIT License.",
    "bsd": "Released under the BSD License.",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights": "No part of this publication may be reproduced without prior written permission of the publisher.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "all-rights-reserved": "All rights reserved.",
    "cc-by-4": "CC BY 4.0",
    "cc-by-nc-sa-4": "CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4": "CC BY-NC-ND 4.0",
    "cc0-1": "CC0 1.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-mpl-2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-gpl-2": "SPDX-License-Identifier: GPL-2.0",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0",
    "spdx-lgpl-3": "SPDX-License-Identifier: LGPL-3.0",
    "spdx-agpl-3": "SPDX-License-Identifier: AGPL-3.0",
}


def license_texts() -> dict[str, str]:
    """The whole license texts in ``license_texts``, each named ``text-`` and its file."""
    folder = files(__package__) / "license_texts"
    return {f"text-{f.name[:-4]}": f.read_text() for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}



def _templates(templates: dict[str, str]):
    """(name, width, distinct shingles, number of shingles) of each; with fewer words than a shingle, all are one."""
    import pyarrow as pa

    names, texts = list(templates), pa.array(list(templates.values()), pa.large_string())
    out = []
    for first, words, at in document_words(texts, punctuation=True):
        for i in range(len(at) - 1):
            mine = words[at[i] : at[i + 1]]
            if not len(mine):
                raise ValueError(f"a template needs words: {names[first + i]}")
            width = min(SHINGLE, len(mine))
            out.append((names[first + i], width, np.unique(shingle_hashes(mine, width)), len(mine) - width + 1))
    return out


def _index(known) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each width: its templates' shingles in order, and the templates of each from ``starts`` on in ``owners``."""
    out = {}
    for width in sorted({w for _, w, _, _ in known}):
        mine = [i for i, x in enumerate(known) if x[1] == width]
        shingles = np.concatenate([known[i][2] for i in mine])
        owners = np.repeat(mine, [len(known[i][2]) for i in mine])
        order = np.argsort(shingles, kind="stable")
        tokens, starts = np.unique(shingles[order], return_index=True)
        out[width] = tokens, np.append(starts, len(shingles)), owners[order]
    return out


def _quick(tokens: np.ndarray) -> np.ndarray:
    table = np.zeros(_QUICK, bool)
    table[(tokens & np.uint64(_QUICK - 1)).astype(np.int64)] = True
    return table


def best_stretch(places: np.ndarray, tokens: np.ndarray, span: int) -> tuple[int, int, int]:
    """(distinct tokens, first place, last place) of the stretch of ``span`` places with most tokens; of equals the shortest, then the first."""
    at, of = places.tolist(), tokens.tolist()
    held: dict[int, int] = {}
    left, best = 0, (0, 0, 0)
    for place, token in zip(at, of, strict=True):
        held[token] = held.get(token, 0) + 1
        while at[left] <= place - span or held[of[left]] > 1:
            held[of[left]] -= 1
            if not held[of[left]]:
                del held[of[left]]
            left += 1
        best = min(best, (-len(held), place - at[left], at[left]))
    return -best[0], best[2], best[2] + best[1]


def _alike(known) -> np.ndarray:
    """Which templates share half of the shingles of the smaller one or more: versions of one notice or license."""
    out = np.zeros((len(known), len(known)), bool)
    for i, (_, w, a, _) in enumerate(known):
        for j, (_, v, b, _) in enumerate(known[:i]):
            out[i, j] = out[j, i] = w == v and 2 * len(np.intersect1d(a, b, assume_unique=True)) >= min(len(a), len(b))
    return out


def best_of_alike(hits: list[tuple[int, float, int, int]], alike: np.ndarray) -> list[tuple[int, float, int, int]]:
    """The hits (template, containment, first place, last place) of a document without those that a better hit of a like template overlaps."""
    return [h for h in hits if not any(alike[h[0], o[0]] and o[1] > h[1] and o[2] <= h[3] and h[2] <= o[3] for o in hits)]


def _hits(words: np.ndarray, at: np.ndarray, index, quick) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, template, place, token) of all template shingles of a run of documents, in that order."""
    found = []
    for width, (tokens, starts, owners) in index.items():
        if len(words) < width:
            continue
        shingles = shingle_hashes(words, width)
        hit = np.flatnonzero(quick[width][(shingles & np.uint64(_QUICK - 1)).astype(np.int64)])
        token = np.minimum(np.searchsorted(tokens, shingles[hit]), len(tokens) - 1)
        doc = np.searchsorted(at, hit, "right") - 1
        # shingles across two documents are none
        real = (tokens[token] == shingles[hit]) & (hit + width <= at[doc + 1])
        hit, token, doc = hit[real], token[real], doc[real]
        times = starts[token + 1] - starts[token]
        which = np.repeat(starts[token], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        found.append((np.repeat(doc, times), owners[which], np.repeat(hit, times), np.repeat(token, times)))
    doc, template, place, token = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((place, template, doc))
    return doc[order], template[order], place[order], token[order]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, containment, start_word) for each notice that a row of ``docs`` holds, with its best stretch.

    Words are lower-cased runs of letters and digits. A template of fewer words than a shingle is one shingle of all
    its words. Of templates that share half of their shingles or more, such as the versions of one license, a stretch is
    reported under those it holds most of; a document with two such notices at two places has both. Documents shorter than that, null or empty hold nothing. Repeated rows each have their own; other
    columns are ignored. ``templates`` are the notices and license texts of this package if None.
    """
    known = _templates(TEMPLATES | license_texts() if templates is None else templates)
    index = _index(known)
    needs = np.array([len(shingles) for _, _, shingles, _ in known])
    alike = _alike(known)

    def run(batches):
        import pyarrow as pa

        quick = {width: _quick(tokens) for width, (tokens, _, _) in index.items()}
        for batch in batches:
            out = {"at": [], "license": [], "containment": [], "start_word": []}
            for first, words, at in document_words(batch.column("text"), punctuation=True):
                doc, template, place, token = _hits(words, at, index, quick)
                edges = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(template, prepend=-1))
                ends = np.append(edges[1:], len(doc))
                enough = (ends - edges) / needs[template[edges]] >= threshold
                hits: dict[int, list] = {}
                for a, b in zip(edges[enough], ends[enough], strict=True):
                    d, i = int(doc[a]), int(template[a])
                    held, start, end = best_stretch(place[a:b], token[a:b], SPAN * known[i][3])
                    if held / needs[i] >= threshold:
                        hits.setdefault(d, []).append((i, float(held / needs[i]), int(start), int(end) + known[i][1] - 1))
                for d, mine in hits.items():
                    for i, share, start, _ in best_of_alike(mine, alike):
                        for name, value in zip(out, (first + d, known[i][0], share, int(start - at[d])), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(out["at"], pa.int64())), pa.array(out["license"], pa.string()), pa.array(out["containment"], pa.float64()), pa.array(out["start_word"], pa.int64())],
                names=["doc_id", "license", "containment", "start_word"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, containment double, start_word long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
