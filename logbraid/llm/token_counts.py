"""Token counts of sections by offset mapping.

A document is encoded once, as a whole, so its tokens are those a model sees. Tokens and sections are both ranges of the
document's bytes; an interval join over the sorted ranges gives each token to a section. A token that crosses a boundary goes by a rule:
`first`, the section of its first byte; `last`, that of its last byte; `most`, the section with most of its bytes, the earlier one at a tie.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import column_bytes, slices

#: Longer runs of white space are encoded as a token pattern would cut them, without the pattern: its engine keeps a step for each character.
LONG_SPACE = 10_000
#: White space as the pattern's engine sees it (a fixed set), and the part of the pattern that takes a run of it.
_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACES}]{{{LONG_SPACE},}}")
SPACE_RULE = r"\s+(?!\S)"

RULES = ("first", "last", "most")
SECTION = "doc_id long, section int, start long, end long, n_chars long, n_tokens long, n_crossing long"
#: Rows of a batch of results.
ROWS = 50_000


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(encoding, text: str, pattern: str) -> list[int]:
    """The text's tokens. Of a run of white space with a character behind it the pattern takes all but the last one; it takes no
    other match across that place, so long runs are cut out there and merged on their own."""
    if SPACE_RULE not in pattern:
        return encoding.encode_ordinary(text)
    tokens, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        tokens += encoding.encode_ordinary(text[at : run.start()])
        tokens += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return tokens + encoding.encode_ordinary(text[at:])


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, of these those that cross a boundary) per section. Both are ranges that follow one another from 0, given by their ends; no section is empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = first != last
    to = last if rule == "last" else first.copy()
    if rule == "most":
        begins = np.concatenate([[0], section_ends[:-1]])
        for t in np.flatnonzero(crossing):
            own = np.arange(first[t], last[t] + 1)
            shared = np.minimum(section_ends[own], token_ends[t]) - np.maximum(begins[own], starts[t])
            to[t] = own[np.argmax(shared)]
    n = len(section_ends)
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def _map_sections(path: str, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                ids, rows = [], []
                texts = part.column("text").to_pylist()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    if not text:
                        continue
                    data, _ = column_bytes(pa.array([text]))
                    tokens = np.cumsum(sizes[encode(encoding, text, pattern)])
                    ends = np.flatnonzero(data == 0x0A) + 1
                    if not len(ends) or ends[-1] < len(data):
                        ends = np.append(ends, len(data))
                    counted, crossing = attribute(tokens, ends, rule)
                    # Characters are the bytes that do not continue one.
                    chars = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
                    begin = np.concatenate([[0], chars[:-1]])
                    ids.append(doc_id)
                    rows.append(len(ends))
                    for out, values in zip(columns, (np.arange(len(ends)), begin, chars, chars - begin, counted, crossing), strict=True):
                        out.append(values)
                if not ids:
                    continue
                docs = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), rows)))
                types = (pa.int32(), *[pa.int64()] * 5)
                out = pa.RecordBatch.from_arrays(
                    [docs, *(pa.array(np.concatenate(c), t) for c, t in zip(columns, types, strict=True))],
                    ["doc_id", "section", "start", "end", "n_chars", "n_tokens", "n_crossing"],
                )
                for at in range(0, out.num_rows, ROWS):
                    yield out.slice(at, ROWS)

    return run


def section_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, rule: str = "first") -> DataFrame:
    """(doc_id, section, start, end, n_chars, n_tokens, n_crossing): one row per line of each text of docs(doc_id, text), in tokens of
    the byte-level vocabulary at `tokenizer_path` (ranks in tiktoken's format) split by `pattern`.

    A line holds its newline; section counts from 0, start and end are characters of the text. n_crossing counts those of
    its tokens that also reach into another line. The tokens of a document add up to those of its whole text. A null or empty text
    has no section. Runs of white space may be of any length if the pattern takes them by SPACE_RULE. Repeated rows come out repeated; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_map_sections(tokenizer_path, pattern, rule), SECTION)
