"""License scan: MinHash bands over overlapping windows of words find candidate templates, exact containment confirms them.

Templates of about the same size share their windows: a class is led by its largest size, C shingles, and goes down to C / 1.2. Its windows of less
than 1.25 C shingles begin every C / 4 shingles, so one of them holds any range of T <= C shingles as a whole. If it has 80 % of a template's T shingles,
its Jaccard similarity to the template is at least 0.8 T / (1.5 T + 0.2 T) = 0.47. With BANDS bands of one row each, a match is missed with a
probability of at most 0.53^24, below 3 in ten million.

A window's minimum is looked up in the sorted minima of its class, so the work for a text grows with the number of classes, which is the logarithm
of the largest size, and not with the number of templates.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import column_bytes, mix, slices
from logbraid.llm.shingles import shingle_hashes

#: Notices as their licences word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
K, BANDS = 5, 24
#: How much larger the largest template of a class is than its smallest may be.
CLASS = Fraction(6, 5)
#: Templates go to every task; a table of more text is refused. The texts of several thousand whole licences fit.
MAX_TEMPLATE_BYTES = 64 << 20
_SALTS = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 63, BANDS, dtype=np.uint64)
_LOW = np.uint64(0xFFF)
#: ASCII letters in lower case and digits are words, as are bytes beyond ASCII; the rest separates.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(_FOLD[data], offsets, K, lower=False)


def _window_minima(x: np.ndarray, size: int, doubled: list[np.ndarray]) -> np.ndarray:
    """Least value of each `size` neighbours; at the end the windows are shorter."""
    power = size.bit_length() - 1
    while len(doubled) <= power:
        last, step = doubled[-1], 1 << (len(doubled) - 1)
        out = last.copy()
        np.minimum(last[:-step], last[step:], out=out[:-step] if step < len(out) else out[:0])
        doubled.append(out)
    rest = size - (1 << power)
    out = doubled[power].copy()
    if 0 < rest < len(out):
        np.minimum(out[:-rest], doubled[power][rest:], out=out[:-rest])
    return out


class Templates:
    def __init__(self, templates: Mapping[str, str]):
        self.names, self.sets = [], []
        for name, text in templates.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            hashes, ends = _shingles(raw, np.array([0, len(raw)]))
            if ends[-1]:
                self.names.append(name)
                self.sets.append(np.unique(hashes))
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.bands = np.array([[mix(s ^ salt).min() for salt in _SALTS] for s in self.sets], np.uint64).reshape(-1, BANDS)
        #: (size, step, values, owners, ends): the largest size of a class, and by band the minima of its templates in order, whose they are, and which
        #: low bits they end in.
        self.classes: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        rest = np.argsort(-self.sizes, kind="stable")
        while len(rest):
            size = int(self.sizes[rest[0]])
            n = int(np.count_nonzero(self.sizes[rest] * CLASS.numerator > size * CLASS.denominator))
            own, rest = rest[:n], rest[n:]
            order = np.argsort(self.bands[own], axis=0, kind="stable")
            values = np.take_along_axis(self.bands[own], order, 0).T.copy()
            ends = np.zeros((BANDS, int(_LOW) + 1), bool)
            ends[np.arange(BANDS)[:, None], (values & _LOW).astype(np.intp)] = True
            self.classes.append((size, max(1, size // 4), values, own[order].T.copy(), ends))

    def candidates(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first, end) of windows of `hashes` that share a band with a template."""
        found: set[tuple[int, int, int]] = set()
        for band in range(BANDS):
            x = mix(hashes ^ _SALTS[band])
            doubled = [x]
            for size, step, values, owners, ends in self.classes:
                window = size + step - 1
                minima = _window_minima(x, window, doubled)[::step]
                # Most minima end in bits that no template's does; the rest is looked up.
                hits = np.flatnonzero(ends[band][(minima & _LOW).astype(np.intp)])
                first = np.searchsorted(values[band], minima[hits])
                end = np.searchsorted(values[band], minima[hits], "right")
                for at, i, j in zip((hits * step).tolist(), first.tolist(), end.tolist(), strict=True):
                    found.update((t, at, min(len(hashes), at + window)) for t in owners[band, i:j].tolist())
        return sorted(found)


def places(hashes: np.ndarray, template: np.ndarray, percent: int) -> list[tuple[int, int, float]]:
    """(first word, end, containment) of each run of the template's shingles, without gaps of more than half the
    template, that holds enough of them."""
    hits = np.flatnonzero(np.isin(hashes, template))
    out = []
    for run in np.split(hits, np.flatnonzero(np.diff(hits) > max(1, len(template) // 2)) + 1):
        shared = len(np.unique(hashes[run]))
        if shared and 100 * shared >= percent * len(template):
            out.append((int(run[0]), int(run[-1]) + K, shared / len(template)))
    return out


def _map_scan(templates: Mapping[str, str], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                hashes, ends = _shingles(data, offsets)
                rows = []
                # A slice is one row of shingles; a window that reaches into the next text points to both.
                pairs = {
                    (t, text)
                    for t, first, end in known.candidates(hashes)
                    for text in range(int(np.searchsorted(ends, first, "right")) - 1, int(np.searchsorted(ends, end, "left")))
                }
                for t, text in sorted(pairs):
                    rows += [(text, t, *place) for place in places(hashes[ends[text] : ends[text + 1]], known.sets[t], percent)]
                if rows:
                    rows.sort()
                    text, t, start, stop, share = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(text)), pa.array([known.names[x] for x in t]),
                            pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(share, pa.float64()),
                        ],
                        ["doc_id", "license", "start_word", "end_word", "containment"],
                    )

    return run


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates from table(license, text). Rows with a null are left out; of several texts of one license each is a template, numbered from the second on
    in the order of the texts, as `license#2`. More than MAX_TEMPLATE_BYTES of text is an error."""
    rows = table.select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text")).dropna().distinct()
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if n_bytes > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of {n_bytes} bytes; at most {MAX_TEMPLATE_BYTES} can go to every task")
    out: dict[str, str] = {}
    last, n = None, 0
    for name, text in sorted(tuple(r) for r in rows.collect()):
        last, n = name, n + 1 if name == last else 1
        out[name if n == 1 else f"{name}#{n}"] = text
    return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | DataFrame = TEMPLATES, percent: int = 80) -> DataFrame:
    """(doc_id, license, start_word, end_word, containment): one row per place of docs(doc_id, text) that holds at least `percent` % of the
    five-word shingles of a template; words are ASCII letters and digits in lower case, and characters beyond ASCII.

    A place is a run of the template's shingles without gaps of more than half the template, given in words of the text. The bound on missed
    matches holds for places as long as the template; longer ones have more windows, but each with a part. A template of fewer words counts as one shingle, which only an equal text
    has. Null and empty texts match nothing; repeated rows match each by itself; a null doc_id stays null; empty tables and empty
    templates give no rows; other columns are ignored. The bands are made for 80 % and more; a smaller `percent` is refused. `templates` may be a table,
    see `templates_of`.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    return texts.mapInArrow(
        _map_scan(dict(templates), percent), "doc_id long, license string, start_word long, end_word long, containment double"
    )
