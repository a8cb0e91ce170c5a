"""Operator 3: license scans by winnowed fingerprints and banded alignment.

Of every template, winnowing picks word k-grams into an inverted index: one at
least of any `window` grams that follow each other. Every k-gram of a document
is looked up, so an unbroken run of window + k - 1 template words is always
found, and both are chosen so that a match of the least coverage must have such
a run. A hit names a template and a diagonal; the words around that diagonal
are aligned with the template in a band, which gives the matched share of the
template and the span of the match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import ALL
from .words import LOWER, hash_words, mix, separator_table, slices, text_bytes, word_spans

#: Largest k, and words by which a match may shift at least; long templates allow as many as they may lose.
GRAM, BAND = 3, 6
_SEPARATORS = separator_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, _SEPARATORS)
    return hash_words(data, starts, ends), rows, starts - offsets[:-1].repeat(np.diff(rows)), ends - offsets[:-1].repeat(np.diff(rows))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for j in range(size):
        out = mix(out + words[j : j + len(out)])
    return out


def lost_words(words: int, least: float) -> int:
    """Template words that a match of the least coverage may leave unmatched."""
    return words - next((n for n in range(1, words + 1) if n >= least * words), words)


def fingerprints(words: np.ndarray, least: float) -> tuple[int, list[tuple[int, int]]]:
    """k, and (hash, place) of the k-grams of a template that winnowing picks.

    The words that match stand in one run more than words are lost, at most,
    so the longest run has `run` words or more: run - k + 1 grams in a row.
    """
    lost = lost_words(len(words), least)
    run = max(1, -(-(len(words) - lost) // (lost + 1)))
    k = min(GRAM, run)
    grams, window = _grams(words, k), run - k + 1
    picked = {at + int(part.argmin()) for at in range(max(1, len(grams) - window + 1)) if len(part := grams[at : at + window])}
    return k, [(int(grams[i]), i) for i in sorted(picked)]


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order by text within the band of the diagonal, and the span [first, last] of such a match.

    A cell holds the number of words and the place of the first one in a
    number, so that of equally many words the later start counts as more.
    """
    low, high = max(0, diagonal - band), min(len(text), diagonal + len(template) + band)
    mine, unit = text[low:high], np.int64(1) << np.int64(40)
    place = np.arange(low, high, dtype=np.int64)
    best = np.zeros(len(mine) + 1, dtype=np.int64)
    for i, word in enumerate(template):
        a, b = max(0, diagonal + i - band - low), diagonal + i + band + 1 - low
        at = np.flatnonzero(mine[a : max(a, b)] == word) + a
        if len(at):
            # best[j + 1] is that of text up to place j.
            row = best.copy()
            row[at + 1] = np.maximum(row[at + 1], np.where(best[at] > 0, best[at], place[at]) + unit)
            best = np.maximum.accumulate(row)
    words = best[1:] // unit
    if not len(words) or not words.max():
        return 0, 0, -1
    last = np.flatnonzero(words == words.max())
    start = best[1:][last] % unit
    pick = int((start - last).argmax())
    return int(words.max()), int(start[pick]), int(last[pick] + low)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, n_matched, start_word, end_word, start_byte, end_byte) of every match with that coverage of a template.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case; end places are exclusive. A document gives as many rows as it
    has matches that do not overlap for one template, best first, so a null or
    empty text gives none, and an empty table an empty result. Very long texts
    are searched whole. Repeated rows give repeated matches, null ids are kept,
    and templates that tie all give their rows. A match is found if changed, missing and inserted words together
    are no more than the template words that the coverage lets go unmatched and
    shift words by no more than BAND or as many as the template may lose; with
    more inserted words, if one of its fingerprints is whole.
    """
    templates = ALL if templates is None else templates
    names = sorted(templates)
    sequences = [_words(pa.array([templates[n]]))[0] for n in names]
    marked = [fingerprints(x, least) for x in sequences]
    bands = [max(BAND, lost_words(len(x), least)) for x in sequences]
    indexes = []
    for size in sorted({k for k, _ in marked}):
        marks = sorted((h, t, p) for t, (k, own) in enumerate(marked) if k == size for h, p in own)
        if marks:
            indexes.append((size, np.array([m[0] for m in marks], dtype=np.uint64), np.array([m[1] for m in marks], dtype=np.int64), np.array([m[2] for m in marks], dtype=np.int64)))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words, rows, first, last = _words(batch.column("text"))
                ids, out = batch.column("id").to_pylist(), []
                # Places of the batch whose gram is in an index; grams across two documents are left out.
                met = []
                for size, hashes, template, place in indexes:
                    grams = _grams(words, size)
                    at = np.flatnonzero(np.isin(grams, hashes))
                    row = np.searchsorted(rows, at, side="right") - 1
                    inside = at + size <= rows[row + 1]
                    at, row = at[inside], row[inside]
                    low, high = np.searchsorted(hashes, grams[at]), np.searchsorted(hashes, grams[at], side="right")
                    met += [(r, int(template[m]), int(p - rows[r] - place[m])) for r, p, a, b in zip(row.tolist(), at, low, high, strict=True) for m in range(a, b)]
                seen_in: dict[int, set] = {}
                for r, t, diagonal in met:
                    seen_in.setdefault(r, set()).add((t, diagonal))
                for r, seen in sorted(seen_in.items()):
                    mine = words[rows[r] : rows[r + 1]]
                    found = []
                    for t, diagonal in seen:
                        n, a, b = align(mine, sequences[t], diagonal, bands[t])
                        if n and n >= least * len(sequences[t]):
                            found.append((n / len(sequences[t]), n, t, a, b + 1))
                    taken: list[tuple[int, int, int]] = []
                    for share, n, t, a, b in sorted(set(found), key=lambda x: (-x[0], x[4] - x[3], x[3], x[2])):
                        if all(u != t or b <= c or d <= a for u, c, d in taken):
                            taken.append((t, a, b))
                            out.append((ids[r], names[t], share, n, a, b, int(first[rows[r] + a]), int(last[rows[r] + b - 1])))
                kinds = [batch.schema.field("id").type, pa.string(), pa.float64(), *[pa.int64()] * 5]
                columns = list(zip(*out, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "coverage", "n_matched", "start_word", "end_word", "start_byte", "end_byte"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, license string, coverage double, n_matched long, start_word long, end_word long, start_byte long, end_byte long")
