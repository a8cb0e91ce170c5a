"""Operator 10: language identification by a linear-chain conditional random field.

Every word has a label. A word's potentials come from hashed character n-grams
with its borders marked (so affixes are among them) and from a lexicon of the
sample's words; transitions are learned with them by the gradient of the
sequences' likelihood. A share of the training sequences is spliced from pieces
of several texts, so that transitions see languages change. Forward-backward over a whole text gives each word's
label probabilities, also where languages change within it; a text's language
is the one with the most expected words.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import LOWER, WHITE, hash_words, mix, slices, text_bytes, word_spans

#: Documents of each language that are learned from, and bytes of their texts, at most; chosen by a hash of their id among all that may be.
SAMPLE_DOCS, SAMPLE_BYTES = 120, 1 << 20
#: Rows of the n-gram and of the lexicon weights.
NGRAM_ROWS, WORD_ROWS = 1 << 16, 1 << 15
GRAMS = (2, 3, 4)
EPOCHS, SEQUENCE = 8, 64
#: Words of a spliced piece, least and most, and the pieces of which one in so many is spliced.
PIECE, SPLICED = (8, 40), 4
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that start or continue a letter in the features (a-z and all non-ASCII bytes).
_LETTER_BYTE = np.zeros(256, dtype=bool)
_LETTER_BYTE[97:123] = True
_LETTER_BYTE[128:] = True


@dataclass
class Model:
    labels: list[str]
    ngrams: np.ndarray
    words: np.ndarray
    lexicon: np.ndarray
    start: np.ndarray
    move: np.ndarray


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of n-gram weights, word of each; rows of word weights, word of each) of words given by their bytes."""
    size = ends - starts + 2
    edge = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(np.arange(len(starts)), size)
    place = np.arange(edge[-1]) - edge[:-1][own]
    inner = (place > 0) & (place < size[own] - 1)
    flat = np.full(edge[-1], 1, dtype=np.uint64)
    flat[inner] = data[(starts[own] + place - 1)[inner]]
    rows, owner = [], []
    for n in GRAMS:
        h = np.full(len(flat), n, dtype=np.uint64)
        for j in range(n):
            h[: len(flat) - j] = h[: len(flat) - j] * np.uint64(0x100000001B3) + flat[j:]
        fits = place + n <= size[own]
        rows.append((mix(h[fits]) & np.uint64(NGRAM_ROWS - 1)).astype(np.int64))
        owner.append(own[fits])
    at = np.minimum(np.searchsorted(lexicon, hashes), max(0, len(lexicon) - 1))
    known = np.flatnonzero(lexicon[at] == hashes) if len(lexicon) else np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owner), (hashes[known] & np.uint64(WORD_ROWS - 1)).astype(np.int64), known


def _sum_rows(weights: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(owner, weights[:, k][rows], n)
    return out


def _sum_columns(values: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, values.shape[1]))
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(rows, values[:, k][owner], n)
    return out


class Words:
    """The distinct words of a batch of texts, and the texts as sequences of them."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        self.data = LOWER[data]
        starts, ends, self.rows = word_spans(self.data, offsets, WHITE)
        hashes = hash_words(self.data, starts, ends)
        self.hashes, first, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[first], ends[first]
        letters = np.concatenate([[0], np.cumsum(_LETTER_BYTE[self.data])])
        self.has_letter = letters[self.ends] > letters[self.starts]


def _potentials(model: Model, words: Words) -> np.ndarray:
    """exp of each distinct word's potentials, scaled to 1 at most; all 1 for a word without letters."""
    n = len(words.hashes)
    if not n:
        return np.ones((0, len(model.labels)))
    rows, owner, word_rows, word_owner = _features(words.data, words.starts, words.ends, words.hashes, model.lexicon)
    score = _sum_rows(model.ngrams, rows, owner, n) + _sum_rows(model.words, word_rows, word_owner, n)
    score[~words.has_letter] = 0
    return np.exp(np.maximum(score - score.max(1, keepdims=True), -30))


def forward_backward(potentials: np.ndarray, of: np.ndarray, rows: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word of the sequences of[rows[i]:rows[i + 1]], and the sum of the pairs' probabilities.

    Sequences are taken a step at a time, the longest first, so that a step is
    a few operations on all sequences that reach it.
    """
    size = np.diff(rows)
    order = np.argsort(-size, kind="stable")
    size, base = size[order], rows[:-1][order]
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    ahead = np.empty((len(of), len(start)))
    pairs = np.zeros((len(start), len(start)))
    state = None
    for t, m in enumerate(live):
        at = base[:m] + t
        state = (start if t == 0 else state[:m] @ move) * potentials[of[at]]
        state = state / state.sum(1, keepdims=True)
        ahead[at] = state
    back = np.ones((len(size), len(start)))
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = base[:m] + t
        both = ahead[at] * back[:m]
        both /= both.sum(1, keepdims=True)
        if t:
            before = base[:m] + t - 1
            behind = potentials[of[at]] * back[:m]
            step = behind @ move.T
            mass = (ahead[before] * step).sum(1, keepdims=True)
            pairs += (ahead[before] / mass).T @ behind * move
            back[:m] = step / step.sum(1, keepdims=True)
        ahead[at] = both
    return ahead, pairs


def spliced(rows: np.ndarray, seed: int = 5) -> np.ndarray:
    """Places of words that make a text of pieces in random order; rows: offsets of the texts' words."""
    rng = np.random.default_rng(seed)
    pieces = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        while a < b:
            to = min(b, a + int(rng.integers(*PIECE)))
            if rng.integers(SPLICED) == 0:
                pieces.append(np.arange(a, to))
            a = to
    return np.concatenate([pieces[i] for i in rng.permutation(len(pieces))]) if pieces else np.zeros(0, np.int64)


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS) -> Model:
    """Model of labelled texts by gradient ascent with AdaGrad steps; whole texts, cut into sequences of SEQUENCE words."""
    names = sorted(set(labels))
    words = Words(pa.array(texts, pa.string()))
    n, k = len(words.hashes), len(names)
    mixed = spliced(words.rows)
    of = np.concatenate([words.of, words.of[mixed]])
    times = np.bincount(words.of, minlength=n)
    lexicon = words.hashes[times >= 3]
    model = Model(names, np.zeros((NGRAM_ROWS, k)), np.zeros((WORD_ROWS, k)), lexicon, np.full(k, 1 / max(1, k)), np.full((k, k), 0.0))
    if not k or not n:
        model.move = np.ones((k, k))
        return model
    edges = np.append(words.rows, len(of)) if len(mixed) else words.rows
    cuts = np.unique(np.concatenate([np.arange(a, b, SEQUENCE) for a, b in zip(edges[:-1], edges[1:], strict=True)] + [edges]))
    gold = np.repeat(np.array([names.index(x) for x in labels]), np.diff(words.rows))
    gold = np.concatenate([gold, gold[mixed]])
    rows, owner, word_rows, word_owner = _features(words.data, words.starts, words.ends, words.hashes, lexicon)
    target = np.zeros((n, k))
    np.add.at(target, (of, gold), 1)
    same = np.zeros((k, k))
    inside = np.ones(len(gold), dtype=bool)
    inside[cuts[:-1]] = False
    np.add.at(same, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
    weights = [model.ngrams, model.words, np.zeros((k, k))]
    square = [np.full_like(w, 1e-8) for w in weights]
    for _ in range(epochs):
        model.move = np.exp(weights[2])
        chance, pairs = forward_backward(_potentials(model, words), of, cuts, model.start, model.move)
        got = np.stack([np.bincount(of, chance[:, j], n) for j in range(k)], axis=1)
        error = (target - got) / len(gold)
        error[~words.has_letter] = 0
        steps = [_sum_columns(error, rows, owner, NGRAM_ROWS), _sum_columns(error, word_rows, word_owner, WORD_ROWS), (same - pairs) / len(gold)]
        for w, s, g in zip(weights, square, steps, strict=True):
            s += g * g
            w += 0.3 * g / np.sqrt(s)
    model.move = np.exp(weights[2])
    return model


def _sampled(docs: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame | None:
    """(lang, rank, text) of up to SAMPLE_DOCS labelled documents of each language of SAMPLE_BYTES in all, those with the smallest hash of their id; None without any."""
    known = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # A threshold on the hash leaves a few times the sample; the window then ranks these alone.
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 3 * SAMPLE_DOCS / n)))])
    spread = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / F.lit(1 << 30)
    few = known.withColumn("h", spread).where(F.col("h") <= F.element_at(share, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("h", "id", "text")
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_DOCS).withColumn("bytes", F.sum(F.octet_length("text")).over(order))
    return ranked.where(F.col("bytes") <= SAMPLE_BYTES).select("lang", "rank", "text")


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of the whole sample, whatever the order of its rows; nothing of an empty one."""
    rows = list(batches)
    if sum(map(len, rows)):
        sample = pa.Table.from_batches(rows).sort_by([("lang", "ascending"), ("rank", "ascending")])
        model = fit(sample["text"].to_pylist(), sample["lang"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def learned(sample: DataFrame | None) -> Model:
    """fit of the sample in one task: the driver's Python has neither the texts nor what learning makes of them, only the model."""
    found = sample.repartition(1).mapInArrow(_learn, "model binary").collect() if sample is not None else []
    return pickle.loads(found[0].model) if found else fit([], [])


def identify_language(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, sure, shares) of every document's whole text.

    Learned from text and non-null lang of rows that are not held out (by
    default those whose crc32 of the id mod 4 is 2), SAMPLE_DOCS documents of
    each language at most. lang_pred is `und`, score 0, if the text is null or
    has no letter, or if nothing could be learned. score is the share of the
    text's words that lang_pred is expected to have; shares has that of every
    language, for code-switched texts, and sure is the mean over the words of
    the likeliest language's probability, whichever it is. Null ids are never
    learned from; repeated rows are kept, very long texts taken whole; an empty
    table gives an empty result.
    """
    crc = F.crc32(F.col(id_col).cast("string"))
    held_out = F.coalesce(crc % 4 == 2, F.lit(False)) if held_out is None else held_out
    model = docs.sparkSession.sparkContext.broadcast(learned(_sampled(docs, ~held_out, id_col, text_col, lang_col)))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        names = model.value.labels
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                words = Words(batch.column("text"))
                n = len(batch)
                total, sure = np.zeros((n, len(names))), np.zeros(n)
                if names and len(words.of):
                    chance, _ = forward_backward(_potentials(model.value, words), words.of, words.rows, model.value.start, model.value.move)
                    counted = words.has_letter[words.of]
                    own = np.repeat(np.arange(n), np.diff(words.rows))[counted]
                    for k in range(len(names)):
                        total[:, k] = np.bincount(own, chance[counted, k], n)
                    sure = np.bincount(own, chance[counted].max(1), n) / np.maximum(1, np.bincount(own, minlength=n))
                letter = np.array([bool(t) and bool(_LETTER.search(t)) for t in batch.column("text").to_pylist()], dtype=bool)
                sums = total.sum(1)
                good = letter & (sums > 0)
                share = total / np.where(sums > 0, sums, 1)[:, None]
                best = share.argmax(1) if names else np.zeros(n, np.int64)
                pred = [names[b] if g else "und" for b, g in zip(best, good, strict=True)]
                score = np.where(good, np.minimum(1.0, share.max(1)) if names else 0.0, 0.0)
                shares = pa.array([list(zip(names, s, strict=True)) if g else [] for s, g in zip(share.tolist(), good, strict=True)], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(pred, pa.string()), pa.array(score), pa.array(np.where(good, sure, 0.0)), shares], ["doc_id", "held_out", "lang_pred", "score", "sure", "shares"])

    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, sure double, shares map<string,double>")
