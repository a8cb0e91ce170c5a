"""Operator 4: exact SentencePiece BPE encoding and decoding by a merge-type prefix table.

Byte-pair merging of a text ends in the one sequence of pieces whose every
neighbouring pair is compatible: merging the two pieces' text alone gives the
two pieces again. So the last piece of each prefix is unique, and it is found
without merging: an Aho-Corasick automaton gives the pieces that end at a
place, longest first, and the first one compatible with the last piece of the
prefix before it is stored. The ids follow backwards from the end.

Words, each with the blanks before it, are encoded once per slice of texts, all
in numpy; no piece crosses from a letter to a following blank, so a
text's words are independent. Decoding takes a whole text's ids.

Models that normalise, drop blanks, put none first, are no BPE with byte
fallback, or have pieces of the user or with a blank after a letter are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices, text_bytes

BLANK = "▁"
_CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Words kept between calls of encode.
CACHE_WORDS = 400_000
#: Characters put through the table at once, one word at least.
TABLE_CHARACTERS = 1 << 18
#: Bytes of texts put together at once, and bits of the table of pairs met lately.
RUN_BYTES, MEMO_BITS = 1 << 20, 19
_NONE = np.iinfo(np.int64).max
#: High bits of the first of so many bytes of a character.
_LEAD = np.array([0, 0, 0xC0, 0xE0, 0xF0])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 ... first + size - 1 of each, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's fields; nested ones and fixed widths as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
            yield key >> 3, value
            continue
        size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
        yield key >> 3, message[at : at + size]
        at += size


def refuse(model: bytes) -> None:
    """ValueError for a model that this codec would not encode as the library does.

    Field numbers are those of the library's public model format.
    """
    whole = list(_fields(model))
    trainer, normaliser = (dict(x) if (x := [f for k, v in whole if k == number for f in _fields(v)]) else {} for number in (2, 3))
    kinds = [dict(_fields(v)).get(3, 1) for k, v in whole if k == 1]
    problems = {
        "it is no BPE model": trainer.get(3, 1) != 2,
        "it has no byte fallback": not trainer.get(35, 0),
        "its blanks are suffixes": bool(trainer.get(24, 0)),
        "it normalises text": bool(normaliser.get(2, b"")),
        "it puts no blank first": not normaliser.get(3, 1),
        "it drops blanks": bool(normaliser.get(4, 1)),
        "it leaves blanks unescaped": not normaliser.get(5, 1),
        "it has pieces of the user": 4 in kinds,
    }
    if found := [text for text, bad in problems.items() if bad]:
        raise ValueError(f"this model can't be used: {', '.join(found)}")


class PieceCodec:
    """Encoder and decoder of a BPE model file with byte fallback and no normalisation."""

    def __init__(self, model: bytes):
        import sentencepiece

        refuse(model)
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.end = sp.eos_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        # Merges go by falling score and, between equals, from the left; equal scores share a rank.
        scores = {i: sp.get_score(i) for i in plain}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {self.pieces[i]: rank[scores[i]] for i in plain}
        self._automaton()
        #: What an id shows wherever it stands: all but the bytes of longer characters. And one object for each id.
        self.shown = ["" if i in self.silent else p.replace(BLANK, " ") for i, p in enumerate(self.pieces)]
        for i, b in self.bytes.items():
            self.shown[i] = chr(b) if b < 128 else ""
        self.parts = {i: b for i, b in self.bytes.items() if b >= 128}
        self.shown[self.unknown] = " \u2047 "
        self.own = list(range(n))
        self.words: dict[str, tuple[bytes, list[int], bool]] = {}
        # The same for many texts at once.
        self.id_of_token = np.array([0] + [self.id_of[t] for t in self.tokens[1:]], dtype=np.int64)
        self.id_of_byte = np.array([self.byte_id[b] for b in range(256)], dtype=np.int64)
        self.decimals = pa.array([b"%d " % i for i in range(n)], pa.large_binary())
        self.shown_bytes = pa.array([bytes([self.parts[i]]) if i in self.parts else s.encode() for i, s in enumerate(self.shown)], pa.large_binary())
        self.blank_first = np.array([p.startswith(BLANK) and i not in self.silent for i, p in enumerate(self.pieces)])
        self.is_part, self.is_silent = (np.isin(np.arange(n), list(x)) for x in (self.parts, self.silent))
        self.memo_key, self.memo_ok = np.full(1 << MEMO_BITS, -1, dtype=np.int64), np.zeros(1 << MEMO_BITS, dtype=bool)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of text by merging, and the last merge's two sides: for making the tables from the pieces."""
        symbol: list[str | None] = list(text)
        before, after = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap = [(self.rank[text[i : i + 2]], i, text[i : i + 2]) for i in range(len(text) - 1) if text[i : i + 2] in self.rank]
        heapq.heapify(heap)
        last = None
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if symbol[i] is not None else -1
            if j < 0 or symbol[i] + symbol[j] != joined:
                continue
            last = symbol[i], symbol[j]
            symbol[i], symbol[j] = joined, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := symbol[left] + symbol[right]) in self.rank:
                    heapq.heappush(heap, (self.rank[pair], left, pair))
        return [s for s in symbol if s is not None], last

    def _automaton(self) -> None:
        """Tokens are the pieces that merging can make, in order of rank; 0 stands for any character that is no piece."""
        made = sorted(self.rank, key=lambda p: (self.rank[p], p))
        if any(BLANK in p.lstrip(BLANK) for p in made):
            raise ValueError("this model can't be used: it has pieces with a blank after a letter")
        self.tokens: list[str] = [""]
        splits: list[tuple[str, str] | None] = [None]
        for p in made:
            parts, last = self.merge(p)
            if len(parts) == 1:
                self.tokens.append(p)
                splits.append(last)
        number = {p: i for i, p in enumerate(self.tokens)}
        n = len(self.tokens)
        self.length = np.array([1] + [len(p) for p in self.tokens[1:]], dtype=np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.order = np.zeros(n, dtype=np.int64)
        for i, last in enumerate(splits):
            if last:
                self.left[i], self.right[i] = number[last[0]], number[last[1]]
                self.order[i] = self.rank[self.tokens[i]] + 1
        pairs = {}
        for p in made:
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    pairs[number[p[:k]] * n + number[p[k:]]] = self.rank[p] + 1
        self.pair_key = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()] + [_NONE], dtype=np.int64)
        self.pair_key = np.append(self.pair_key, _NONE)
        # Characters that only stand alone share a class with no transitions but their own single token.
        letters = sorted({c for p in self.tokens for c in p if len(p) > 1})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        trie, self.ends, depth = [{}], [0], [0]
        for i, p in enumerate(self.tokens):
            if not p or any(c not in self.letter for c in p):
                continue
            state = 0
            for c in p:
                if (c := self.letter[c]) not in trie[state]:
                    trie[state][c] = len(trie)
                    trie.append({})
                    self.ends.append(0)
                    depth.append(depth[state] + 1)
                state = trie[state][c]
            self.ends[state] = i
        width = len(letters) + 1
        self.step = np.zeros((len(trie), width), dtype=np.int32)
        fail = np.zeros(len(trie), dtype=np.int32)
        self.next_end = np.zeros(len(trie), dtype=np.int32)
        ends = np.array(self.ends, dtype=np.int32)
        level = [0]
        while level:
            following = []
            for state in level:
                if state:
                    self.step[state] = self.step[fail[state]]
                    back = fail[state]
                    self.next_end[state] = back if ends[back] else self.next_end[back]
                for c, to in trie[state].items():
                    fail[to] = self.step[fail[state], c] if state else 0
                    following.append(to)
                if trie[state]:
                    self.step[state, list(trie[state])] = list(trie[state].values())
            level = following
        self.ends = ends
        single = {c: number[c] for c in number if len(c) == 1}
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.single = np.zeros(0x110000, dtype=np.int32)
        for c, i in self.letter.items():
            self.code[ord(c)] = i
        for c, i in single.items():
            self.single[ord(c)] = i

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging left's and right's text leaves the two tokens; pairs met lately are looked up."""
        key = left * len(self.tokens) + right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        ok = self.memo_ok[slot]
        new = np.flatnonzero(self.memo_key[slot] != key)
        ok[new] = self._undone(left[new], right[new])
        self.memo_key[slot[new]], self.memo_ok[slot[new]] = key[new], ok[new]
        return ok

    def _undone(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What compatible returns, by undoing the tokens' merges from the last one on; the arguments are overwritten."""
        n = len(self.tokens)
        ok = np.ones(len(left), dtype=bool)
        limit = np.full(len(left), _NONE)
        live = np.flatnonzero((left > 0) & (right > 0))
        while len(live):
            a, b = left[live], right[live]
            key = a * n + b
            at = np.searchsorted(self.pair_key, key)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE)
            # A pair that merges before what it belongs to is finished crosses the border; on the right's side an equal rank comes later.
            ok[live[rank < limit[live]]] = False
            by_left = self.order[a] > self.order[b]
            done = (self.order[a] == 0) & (self.order[b] == 0)
            limit[live] = np.where(by_left, self.order[a], self.order[b] + 1)
            left[live] = np.where(by_left, self.right[a], a)
            right[live] = np.where(by_left, b, self.left[b])
            live = live[ok[live] & ~done]
        return ok

    def _table(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one word's after the other's, and the number of each. points: the words' characters; the longest first."""
        n = len(sizes)
        start_of = np.cumsum(sizes) - sizes
        code, single = self.code[points], self.single[points]
        # last[base + i]: the last token of a word's first i characters.
        base = start_of + np.arange(n)
        last = np.zeros(len(points) + n, dtype=np.int64)
        state = np.zeros(n, dtype=np.int64)
        reach = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        for i, m in enumerate(reach.tolist()):
            state = self.step[state[:m], code[start_of[:m] + i]].astype(np.int64)
            at = np.where(self.ends[state] > 0, state, self.next_end[state])
            open_ = np.arange(m)
            # Every character is a token by itself, so the search ends; before it come the longer matches.
            last[base[:m] + i + 1] = single[start_of[:m] + i]
            while len(open_):
                token = self.ends[at[open_]].astype(np.int64)
                open_, token = open_[token > 0], token[token > 0]
                start = i + 1 - self.length[token]
                fits = (start == 0) | self.compatible(last[base[open_] + start], token)
                last[base[open_[fits]] + i + 1] = token[fits]
                open_ = open_[~fits]
                at[open_] = self.next_end[at[open_]]
        found, many = [], np.zeros(n, dtype=np.int64)
        place, live = sizes.copy(), np.arange(n)
        while len(live):
            token = last[base[live] + place[live]]
            # A character that is no piece is told apart by its sign.
            found.append((live, np.where(token > 0, self.id_of_token[token], -points[start_of[live] + place[live] - 1] - 1)))
            many[live] += 1
            place[live] -= self.length[token]
            live = live[place[live] > 0]
        to = np.cumsum(many)
        ids = np.empty(to[-1], dtype=np.int64)
        for back, (live, shown) in enumerate(found, 1):
            ids[to[live] - back] = shown
        if (ids < 0).any():
            point = np.maximum(-ids - 1, 0)
            width = np.where(ids < 0, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
            many = np.add.reduceat(width, to - many)
            nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            ids, point, width = np.repeat(ids, width), np.repeat(point, width), np.repeat(width, width)
            byte = point >> 6 * (width - 1 - nth)
            byte = np.where(nth == 0, byte | _LEAD[width], byte & 0x3F | 0x80)
            ids = np.where(ids < 0, self.id_of_byte[byte & 0xFF], ids)
        return ids.astype(np.int32), many

    def tabled(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, and where those of each begin and their number; points: the words' characters, one word at least."""
        order = np.argsort(-sizes, kind="stable")
        first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        ids, counts, low = [], [], 0
        while low < len(order):
            high = low + max(1, TABLE_CHARACTERS // int(size[low]))
            some, many = self._table(points[_ragged(first[low:high], size[low:high])], size[low:high])
            ids.append(some)
            counts.append(many)
            low = high
        many = np.concatenate(counts)
        begin, number = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        begin[order], number[order] = np.cumsum(many) - many, many
        return np.concatenate(ids), begin, number

    def learn(self, words: set[str]) -> None:
        """Put (ids as text, ids, whether bytes of longer characters are among them) of each new word into self.words."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {w: self.words[w] for w in words if w in self.words}
        if not new:
            return
        ids, begin, number = self.tabled(_points("".join(new)), np.array([len(w) for w in new], dtype=np.int64))
        for w, low, many in zip(new, begin.tolist(), number.tolist(), strict=True):
            own = [self.own[i] for i in ids[low : low + many].tolist()]
            self.words[w] = b" ".join([b"%d" % i for i in own]), own, not self.parts.keys().isdisjoint(own)

    def encode_texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, their n + 1 edges) of runs of a column's texts, each with the end id; null is empty.

        Distinct words go through the table once for the whole column.
        """
        if pa.compute.any(pa.compute.match_substring(column, BLANK)).as_py():
            column = pa.compute.replace_substring(column, BLANK, " ")
        data, offsets = text_bytes(column)
        some = np.diff(offsets) > 0
        rows = offsets + np.concatenate([[0], np.cumsum(some)])
        # Encoding puts a blank first, so chunks begin with their blanks and cover the texts.
        text = np.ones(rows[-1], dtype=bool)
        text[rows[:-1][some]] = False
        spaced = np.full(rows[-1], 32, dtype=np.uint8)
        spaced[text] = data
        blank = spaced == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[rows[:-1][some]] = True
        starts = np.flatnonzero(first)
        cut = np.searchsorted(starts, rows)
        if len(starts):
            chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, rows[-1])), pa.py_buffer(spaced)]).dictionary_encode()
            of = np.asarray(chunks.indices)
            data, offsets = text_bytes(chunks.dictionary)
            points = _points(data.tobytes().decode())
            points[points == 32] = ord(BLANK)
            before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            ids, begin, number = self.tabled(points, np.diff(before[offsets]))
        else:
            of, ids, begin, number = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(rows, rows[low] + RUN_BYTES, side="right")) - 1)
            word = of[cut[low] : cut[high]]
            own = ids[_ragged(begin[word], number[word])]
            edge = np.concatenate([[0], np.cumsum(number[word])])[cut[low : high + 1] - cut[low]] + np.arange(high - low + 1)
            out = np.full(edge[-1], self.end, dtype=np.int32)
            inner = np.ones(len(out), dtype=bool)
            inner[edge[1:] - 1] = False
            out[inner] = own
            yield low, high, out, edge
            low = high

    def spelled(self, ids: np.ndarray, edge: np.ndarray) -> list[memoryview]:
        """The ids of each text in decimals, joined by one space; one id at least."""
        line, offsets = text_bytes(self.decimals.take(pa.array(ids)))
        at, line = offsets[edge].tolist(), memoryview(line)
        return [line[a : b - 1] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode_texts(self, ids: np.ndarray, edge: np.ndarray) -> list[memoryview | bytes]:
        """UTF-8 of what decode returns for the ids of each text; one id at least."""
        shown, offsets = text_bytes(self.shown_bytes.take(pa.array(ids)))
        at, shown = offsets[edge].tolist(), memoryview(shown)
        first = ids[edge[:-1]]
        skip, odd = self.blank_first[first].tolist(), np.logical_or.reduceat(self.is_part[ids], edge[:-1])
        out: list[memoryview | bytes] = [shown[a + s : b] for a, b, s in zip(at[:-1], at[1:], skip, strict=True)]
        for i in np.flatnonzero(odd | self.is_silent[first]).tolist():
            own = ids[edge[i] : edge[i + 1]]
            try:
                str(out[i], "utf-8")
                right = not (self.is_silent[first[i]] and len(own) > 1)
            except UnicodeDecodeError:
                right = False
            if not right:
                out[i] = self.decode(own.tolist()).encode()
        return out

    def decode(self, ids: list[int], odd: bool = True) -> str:
        """Text of ids; the blank that encoding puts first goes. odd: bytes of longer characters may be among them."""
        if odd:
            parts, held = [], bytearray()
            for i in ids:
                if i in self.parts:
                    held.append(self.parts[i])
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held.clear()
                parts.append(self.shown[i])
            text = "".join([*parts, held.decode("utf-8", "replace")])
        else:
            text = "".join(map(self.shown.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(BLANK) else text

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of text with the end id, as text encodes alone."""
        cut = self.chunks(text)
        self.learn(set(cut))
        return [i for c in cut for i in self.words[c][1]] + [self.end]


_CODECS: dict[str, PieceCodec] = {}


def piece_codec(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool | None = None, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every document's whole text.

    decoded says whether the decoded texts come too, by default with ids;
    keep names columns of docs that the result has beside these, doc_id among
    them only once; a column that docs has under a result's name is replaced.

    model is a path of a BPE model file, read on the driver and sent to the
    executors (about 0.5 MB). A null text counts as empty and has the end id
    alone. Very long texts and words are encoded whole; a task holds a slice of
    some megabytes of text, one text at least. Repeated rows and null ids are
    kept; other columns are ignored, and an empty table gives an empty result.
    """
    decoded = ids if decoded is None else decoded
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    key = hashlib.sha256(data.value).hexdigest()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]
    kept = [c for c in keep or [] if c not in names]
    # The id and text are sent once, kept or not.
    sent = [id_col, *([text_col] if text_col != id_col else []), *(c for c in kept if c not in (id_col, text_col))]
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(sent)))
    text_at, kept_at = sent.index(text_col), [sent.index(c) for c in kept]
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.StringType(), T.StringType(), *[T.ArrayType(T.IntegerType())] * ids, *[T.StringType()] * decoded]
    schema = T.StructType([T.StructField(n, k) for n, k in zip([*names, *kept], [*kinds, *(docs.schema[c].dataType for c in kept)], strict=True)])

    def run(batches):
        if key not in _CODECS:
            _CODECS[key] = PieceCodec(data.value)
        codec = _CODECS[key]
        for whole in batches:
            for batch in slices(whole, f"c{text_at}"):
                for low, high, own, edge in codec.encode_texts(batch.column(text_at)):
                    lines, texts = codec.spelled(own, edge), codec.decode_texts(own, edge)
                    part = batch.slice(low, high - low)
                    columns = [part.column(0), pa.array(np.diff(edge)), pa.array([hashlib.sha256(x).hexdigest() for x in lines], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(own)))
                    if decoded:
                        columns.append(pa.array([str(x, "utf-8") for x in texts], pa.string()))
                    yield pa.RecordBatch.from_arrays([*columns, *(part.column(i) for i in kept_at)], [*names, *kept])

    return rows.mapInArrow(run, schema)
