"""The ten operators against brute force, on the small tables and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.llm import queries as Q
from barlight.llm.decontaminate import contamination, decontaminate, proximity_matches
from barlight.llm.jaccard_join import LEAVE, SUBPARTS, Bands, ngram_jaccard_join, shared_features, signatures
from barlight.llm.language_crf import identify_language
from barlight.llm.license_scan import license_scan
from barlight.llm.line_dedup import dropped_lines, line_dedup, line_report
from barlight.llm.maxent_lm import maxent_scores
from barlight.llm.piece_codec import PieceCodec, piece_codec
from barlight.llm.token_counts import token_counts
from barlight.llm.voronoi_knn import top_k_search
from barlight.llm.warc import dechunked, chunked, payloads, read_warc, warc_round_trip, write_warc

P = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null and empty texts, blanks, repeated rows, a long text, near copies, and a column that clashes with internal names.
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(40))
ROWS = [(1, BASE), (2, BASE), (3, BASE.replace("word20", "other")), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (7, "one two"), (8, "One TWO"), (9, LONG), (10, "É日本 🎉 ▁▁ a  b <|endoftext|> x"), (None, BASE), (12, "1 2 3 !")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "k", 0) for i, t in ROWS], "doc_id long, text string, id string, n int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def empty(odd):
    return odd.where("false")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and root(a) != root(b):
                    top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join(spark, odd, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()}
    assert got == components(rows)
    r = ngram_jaccard_join(odd).collect()
    assert len(r) == len(ROWS) and {(x.n_shingles, x.component_id) for x in r if x.doc_id is None} == {(36, None)}
    want = components([x for x in ROWS if x[0] is not None])
    assert all((x.n_shingles, x.component_id) == want[x.doc_id] for x in r if x.doc_id is not None)
    assert ngram_jaccard_join(empty(odd)).count() == 0


def test_similar_sets_share_a_signature():
    """Random pairs at the threshold, with and without frequent shingles, whichever sizes the two have."""
    rng = np.random.default_rng(1)
    bands = Bands(75, 100)
    for n in (1, 2, 3, 4, 5, 6, 7, 12, 20, 133, 500):
        for trial in range(60):
            common = int(rng.integers(0, n + 1))
            a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            kept = -(-3 * n // 4) + int(rng.integers(0, n - -(-3 * n // 4) + 1))
            # As many new features as the threshold lets in beside those that are kept.
            more = kept * 4 // 3 - n if trial % 2 else 0
            b = np.concatenate([a[:kept], rng.integers(0, 1 << 64, more, dtype=np.uint64)])
            assert 100 * kept >= 75 * (n + more)
            often = np.sort(rng.permutation(a)[:common])
            sets = [np.sort(a), np.sort(b)]
            keys, owner = signatures(bands, np.concatenate(sets), np.array([0, n, n + len(b)]), often)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (n, trial)


def test_subsets_of_parts_are_enumerated():
    """A set with features all over signs each part SUBPARTS times, and any single difference leaves one of these."""
    rng = np.random.default_rng(3)
    bands = Bands(75, 100)
    a = np.sort(rng.integers(0, 1 << 64, 4000, dtype=np.uint64))
    parts = bands.parts[bands.of(np.array([4000]))][0]
    keys, _ = signatures(bands, a, np.array([0, 4000]), np.zeros(0, np.uint64))
    assert parts * (LEAVE + 1) > bands.apart[bands.of(np.array([4000]))][0]
    own = signatures(bands, np.delete(a, 17), np.array([0, 3999]), np.zeros(0, np.uint64))[0]
    lost = len(set(keys.tolist()) - set(own.tolist()))
    assert lost in (SUBPARTS - LEAVE, 2 * (SUBPARTS - LEAVE)) and len(keys) > 2 * parts


def test_shared_features_are_counted():
    rng = np.random.default_rng(4)
    for many, size, of in ((5, 40, 60), (40, 30, 35), (3, 500, 5000), (60, 20, 4000)):
        sets = [np.unique(rng.integers(0, of, size)).astype(np.uint64) for _ in range(2 * many)]
        got = shared_features(sets[:many], sets[many:])
        assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[many:]] for x in sets[:many]]


def test_blocks_meet_each_other_once(spark, monkeypatch):
    """Groups of many blocks, so that every pair of blocks and of neighbouring bands is a cell."""
    from barlight.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_FEATURES", 400)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(150)]
    made = []
    for i in range(70):
        w = list(base[: rng.integers(90, 150)])
        for p in rng.choice(len(w), rng.integers(1, 4), replace=False):
            w[p] = f"n{i}x{p}"
        made.append((i, " ".join(w)))
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in made}
    want = {i: sum(s != x and 100 * len(s & x) >= 75 * len(s | x) for x in sets.values()) for i, s in sets.items()}
    got = ngram_jaccard_join(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == want and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(made)


def test_many_near_copies_stay_whole(spark):
    """A large group whose members differ pairwise, some linked only through others, and strangers that share its passage."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    made = []
    for i in range(60):
        w = list(base)
        for p in rng.choice(120, rng.integers(1, 6), replace=False):
            w[p] = f"n{i}x{p}"
        made.append((i, " ".join(w)))
    made += [(100 + i, " ".join(base[:60] + [f"s{i}y{k}" for k in range(50)])) for i in range(30)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df).collect()} == components(made)


def test_every_link_is_counted(spark):
    """All links of a large group of different near copies, whose sets are in one component long before all pairs are seen."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(120)]
    made = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, "one two")]
    for i in range(10, 50):
        w = list(base)
        for p in rng.choice(120, rng.integers(1, 5), replace=False):
            w[p] = f"n{i}x{p}"
        made.append((i, " ".join(w)))
    sets = {}
    for i, t in made:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    similar = lambda a, b: a != b and a and b and 100 * len(a & b) >= 75 * len(a | b)
    want = {i: sum(bool(similar(s, x)) for x in set(sets.values())) for i, s in sets.items()}
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = ngram_jaccard_join(df).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(map(tuple, ngram_jaccard_join(df, links=False).collect()))
    assert {r.doc_id: r.n_links for r in got} == want and sum(want.values()) > 400
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(made)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    table = [(i, [float(x) for x in rng.normal(0, 0.1, 6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 320)]
    x = {i: np.floor(256 * np.array(v)).astype(int) for i, v in table}
    bad = [(400, None), (450, [1.0, None] + [0.0] * 4), (500, [math.nan] * 6), (None, [0.1] * 6), (550, [])]
    df = spark.createDataFrame(table + bad, "vec_id long, embedding array<double>")
    want = sorted((q, k + 1, i, s) for q in x if q % 50 == 0 for k, (s, i) in enumerate([(-t[0], t[1]) for t in sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]]))
    assert sorted(map(tuple, top_k_search(df).collect())) == want
    assert top_k_search(df.where("false")).count() == 0 and top_k_search(df.where("vec_id = 50")).count() == 0


def test_top_k_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(3)
    table = [(i, [float(x) for x in rng.normal(0, 0.1, 6)]) for i in range(200)] + [(201, [0.9] * 6)]
    x = {i: np.floor(256 * np.array(v)).astype(int) for i, v in table}
    df = spark.createDataFrame(table + 6 * [table[-1]] + 3 * [table[50]], "vec_id long, embedding array<double>")
    want = sorted((q, k + 1, i, s) for q in x if q % 50 == 0 for k, (s, i) in enumerate([(-t[0], t[1]) for t in sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]]))
    assert sorted(map(tuple, top_k_search(df).collect())) == want


def clusters(seed, many, each, dims=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (many, dims))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    x = np.repeat(middle, each, axis=0) + rng.normal(0, 0.002, (many * each, dims))
    return x[rng.permutation(len(x))] * 2


def test_top_k_of_clusters_prunes_and_stays_exact(spark, monkeypatch):
    """Several pivots and cells: what the bounds close holds no neighbour, and a bound that closes more loses some."""
    from barlight.llm import voronoi_knn as V

    x = clusters(1, 12, 70)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    q = np.floor(256 * x).astype(int)
    want = sorted((a, k + 1, i, s) for a in range(0, len(x), 50) for k, (s, i) in enumerate([(-t[0], t[1]) for t in sorted((-int(q[a] @ q[i]), i) for i in range(len(x)) if i != a)[:5]]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 as id", "'z' as v", "1 as query")
    seen, real = [], V.least_distances

    def watched(apart, near, far, k, slack):
        out = real(apart, near, far, k, slack)
        seen.append((out, near, far))
        return out

    monkeypatch.setattr(V, "least_distances", watched)
    assert sorted(map(tuple, V.top_k_search(df).collect())) == want
    needed, near, far = seen[0]
    asked = [g for g in range(len(needed)) if far.get(g, -1) >= 0]
    # Cells of other clusters are closed: no point of them is as far from its pivot as would be needed.
    assert len(needed) == len(x) // V.CELL_ROWS and sum(needed[g, c] > max(near.get(c) or [0]) * 4 + 1 for g in asked for c in range(len(needed))) > len(asked) * len(needed) / 4
    monkeypatch.setattr(V, "least_distances", lambda *a: np.maximum(real(*a), 0) + 10**6)
    assert sorted(map(tuple, V.top_k_search(df).collect())) != want


def test_groups_that_leave_much_open_are_merged():
    from barlight.llm.voronoi_knn import merged_groups

    needed = np.array([[0.0, 9, 9, 9], [9, 0, 9, 9], [0, 0, 0, 5], [0, 0, 4, 0]])
    into, out = merged_groups(needed, np.array([10, 10, 10, 10]), np.full(4, 3.0))
    assert into.tolist() == [0, 1, 2, 2] and out[2].tolist() == [0, 0, 0, 0] and out[0].tolist() == needed[0].tolist() and np.isinf(out[3]).all()


def test_license_scan(spark, odd):
    filler = " ".join(f"f{i}" for i in range(30))
    notice = "Licensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([(1, f"{filler} {notice} {filler}"), (2, f"{filler} licensed under the old Apache License version 2.0"), (3, filler), (4, None), (5, ""), (6, f"{notice}\n{notice}")], "doc_id long, text string")
    found = license_scan(df).where("license = 'Apache-2.0'").collect()
    assert sorted((r.doc_id, r.n_matched, r.start_word) for r in found) == [(1, 8, 30), (2, 8, 30), (6, 8, 0), (6, 8, 8)]
    assert all(r.coverage == 1 and r.end_word - r.start_word in (8, 9) for r in found)
    assert license_scan(empty(odd)).count() == 0 and license_scan(odd).count() == 0


def test_license_scan_finds_all_matches_of_the_coverage(spark):
    """Every set of changed or missing words that leaves the coverage, wherever they are."""
    from itertools import combinations

    from barlight.llm.license_texts import NOTICES

    templates = {**NOTICES, "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"}
    made, want = [], set()
    for name in ("Apache-2.0", "MIT", "CC-BY-NC-4.0", "MIT-text"):
        w = words(templates[name], r"[a-zA-Z0-9]+")
        for gone in combinations(range(len(w)), len(w) // 5):
            for put in (["zzz"], []):
                text = ["x1", "x2", *[y for k, x in enumerate(w) for y in (put if k in gone else [x])], "x3"]
                if len(made) < 1000:
                    want.add((len(made), name))
                    made.append((len(made), " ".join(text)))
    found = {(r.doc_id, r.license) for r in license_scan(spark.createDataFrame(made, "doc_id long, text string"), templates).collect()}
    assert want <= found


def test_license_scan_against_alignment_at_every_diagonal(spark):
    """Whole texts and headers with random changes: recall and coverage against a plain alignment of the whole text."""
    from barlight.llm.license_scan import license_scan as scan
    from barlight.llm.license_texts import ALL

    rng = np.random.default_rng(12)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    made, want = [], {}
    for name, text in sorted(ALL.items()):
        w = words(text, pattern)
        for part in (0.0, 0.05, 0.12, 0.19):
            own = [*w]
            for p in rng.choice(len(w), int(part * len(w)), replace=False):
                own[p] = "" if rng.random() < 0.3 else f"zz{p}"
            t = " ".join([*(f"q{k}" for k in range(20)), *own, *(f"r{k}" for k in range(20))])
            want[(len(made), name)] = common(w, words(t, pattern))
            made.append((len(made), t))
    found = {}
    for r in scan(spark.createDataFrame(made, "doc_id long, text string")).collect():
        found[(r.doc_id, r.license)] = max(r.n_matched, found.get((r.doc_id, r.license), 0))
    assert all(want[k] >= 0.8 * len(words(ALL[k[1]], pattern)) for k in want)
    assert {k: found.get(k) for k in want} == want


def test_pairing_holds_little():
    """signatures that occur once, which most do, are not carried through the pairing of a range."""
    import tracemalloc

    import pandas as pd

    from barlight.llm.jaccard_join import _pairs

    rng = np.random.default_rng(6)
    sets = rng.permutation(400_000).astype(np.uint64)
    signed = np.concatenate([rng.permutation(400_000 - 60), [5] * 20, [7] * 3, [9] * 37]).astype(np.uint32)
    want = {x: sorted(sets[signed == x].tolist()) for x in (5, 7, 9)}
    blobs = [np.uint32(len(w)).tobytes() + w.tobytes() + np.ones(len(w), np.uint32).tobytes() + x.tobytes() for w, x in zip(np.array_split(sets, 8), np.array_split(signed, 8), strict=True)]
    frame = pd.DataFrame({"blob": blobs})
    tracemalloc.start()
    pairs = _pairs(frame)
    held = tracemalloc.get_traced_memory()[1] / len(sets)
    tracemalloc.stop()
    small = {(a, b) for a in want[7] for b in want[7] if a < b}
    stars = {(want[x][0], b) for x in (5, 9) for b in want[x][1:]}
    assert set(zip(pairs["a"], pairs["b"], strict=True)) == small | stars and pairs["star"].sum() == len(stars)
    assert held < 28


def test_license_templates_that_tie_and_awkward_rows(spark, odd):
    same = {"b": "one two three four five six", "a": "one two three four five six"}
    df = spark.createDataFrame([(1, "x one two three four five six", 5), (1, "x one two three four five six", 5), (None, "one two three four five six", 6), (2, None, 7), (3, "w " * 50_000 + "one two three four five six", 8)], "doc_id long, text string, coverage int")
    got = sorted(((r.doc_id or 0, r.license, r.start_word) for r in license_scan(df, same).collect()))
    assert got == [(0, "a", 0), (0, "b", 0), (1, "a", 1), (1, "a", 1), (1, "b", 1), (1, "b", 1), (3, "a", 50_000), (3, "b", 50_000)]


def test_piece_codec(spark, odd, rows):
    import sentencepiece

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), PieceCodec(model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df, source in ((odd, ROWS), (spark.read.parquet(f"{FOLDER}/documents.parquet"), rows)):
        got = sorted(piece_codec(df, P.path("piece_bpe_32k.model")).collect(), key=str)
        want = []
        for i, t in source:
            ids = [*sp.encode(t or ""), sp.eos_id()]
            want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    rng = np.random.default_rng(4)
    letters = list("abcdehinorst  ▁\n\té日🎉\x00<>/,.'1") + own.tokens[2000:2040]
    for _ in range(1500):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        ids = own.encode(t)
        assert ids == [*sp.encode(t), sp.eos_id()] and own.decode(ids) == sp.decode(ids)


def test_piece_codec_decodes_what_it_encoded(spark, rows):
    """A wrong id shows in the decoded text, long words and runs of blanks go through the table, and other models are refused."""
    import sentencepiece

    from barlight.llm.piece_codec import refuse

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), PieceCodec(model)
    text = next(t for _, t in rows if t and len(t) > 200)
    ids = own.encode(text)
    assert own.decode(ids) == text == own.decode(ids, odd=False) and own.decode([*ids[:5], ids[5] + 1, *ids[6:]]) != text
    word = own.chunks(text)[3]
    right = own.words[word]
    own.words[word] = (right[0], [right[1][0] + 1, *right[1][1:]], right[2])
    assert own.decode(own.encode(text)) != text
    own.words[word] = right
    rng = np.random.default_rng(8)
    letters = "".join(t for _, t in rows[:50] if t).replace(" ", "").replace("\n", "")
    for t in ["x" * 1000, letters[:5000], "  " * 40 + "a" + " " * 7, "日本語" * 300, " \t " * 20, "\u2047 \ufffd"] + [" ".join(letters[i : i + 90] + " " * int(k) for i, k in zip(rng.integers(0, 5000, 4), rng.integers(0, 9, 4), strict=True)) for _ in range(50)]:
        ids = own.encode(t)
        assert ids == [*sp.encode(t), sp.eos_id()] and own.decode(ids) == sp.decode(ids)
    assert piece_codec(spark.createDataFrame([], "doc_id long, text string"), P.path("piece_bpe_32k.model")).count() == 0
    # No BPE; a piece of the user; blanks dropped.
    for other in (b"", model + b"\x0a\x05\x0a\x01x\x18\x04", model + b"\x1a\x02\x20\x01"):
        with pytest.raises(ValueError, match="can't be used"):
            refuse(other)


def test_piece_codec_of_many_texts(spark, monkeypatch):
    """texts of a batch are encoded and decoded as the library does, without a Python step for each word; F2: kept texts come back once."""
    import sys

    import pyarrow as pa
    import sentencepiece

    from barlight.llm import piece_codec as module

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), PieceCodec(model)
    rng = np.random.default_rng(14)
    letters = list("abcdehinorst   ▁\n\té日🎉\x00\x7f߿ࠀ\uffff</,.'1") + own.tokens[2000:2040]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)] + ["", None, " ", "▁", "  a", "x" * 3000, "🎉" * 300]
    monkeypatch.setattr(module, "RUN_BYTES", 500)
    monkeypatch.setattr(module, "TABLE_CHARACTERS", 3000)
    seen = 0
    for low, high, ids, edge in own.encode_texts(pa.array(texts)):
        assert low == seen and high > low
        seen = high
        for i, (t, line, back) in enumerate(zip(texts[low:high], own.spelled(ids, edge), own.decode_texts(ids, edge), strict=True)):
            want = [*sp.encode(t or ""), sp.eos_id()]
            assert ids[edge[i] : edge[i + 1]].tolist() == want and bytes(line).decode() == " ".join(map(str, want)) and bytes(back).decode() == sp.decode(want)
    assert seen == len(texts) and not list(own.encode_texts(pa.array([], pa.string())))
    # Ids that no text has: bytes that are no character, and a silent one first.
    for ids in ([own.byte_id[0xE6], own.byte_id[0x97], 300], [own.end, own.id_of["▁a"], own.byte_id[0xFF], own.end], [own.end, own.id_of["▁a"]]):
        assert bytes(own.decode_texts(np.array(ids, np.int32), np.array([0, len(ids)]))[0]).decode() == own.decode(ids)
    monkeypatch.undo()
    many = pa.array([" ".join(f"w{i * 7919}z{j}" for i in range(2000)) for j in range(10)])
    steps = [0]
    sys.setprofile(lambda *a: steps.__setitem__(0, steps[0] + 1))
    try:
        for _, _, ids, edge in own.encode_texts(many):
            own.spelled(ids, edge), own.decode_texts(ids, edge)
    finally:
        sys.setprofile(None)
    assert steps[0] < 20_000
    df = spark.createDataFrame([(1, "a b", 3), (None, None, 4)], "doc_id long, text string, n int")
    got = piece_codec(df, P.path("piece_bpe_32k.model"), ids=True, decoded=False, keep=df.columns)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "text", "n"] and sorted((r.n, r.text, r.ids) for r in got.collect()) == [(3, "a b", own.encode("a b")), (4, None, [own.end])]
    assert sorted(r.decoded for r in piece_codec(df, P.path("piece_bpe_32k.model"), ids=True).collect()) == ["", "a b"]


def test_last_stage_sends_each_text_once(spark, docs):
    """the pipeline's last stage neither sends the text a second time to be kept nor returns a text that it drops."""
    import corpus_pipeline

    plan = corpus_pipeline.sentencepiece_codec(spark, docs, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\btext#\d+ AS", plan)) == 1 and not re.search(r"\bdecoded#", plan)


def test_token_counts(spark, odd, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    for df, source in ((odd, ROWS), (docs, rows)):
        want = sorted(((i, len((t or "").encode()), n(t), n(t) > 512) for i, t in source), key=str)
        assert sorted(map(tuple, token_counts(df, P.path("byte_bpe_50k.json")).collect()), key=str) == want
    cache = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, token_counts(docs, P.path("byte_bpe_50k.json"), cache).collect()))
    files = lambda: sum(1 for _ in spark.read.parquet(cache).collect())
    before = files()
    assert sorted(map(tuple, token_counts(docs, P.path("byte_bpe_50k.json"), cache).collect())) == first and files() == before
    assert token_counts(empty(odd), P.path("piece_bpe_32k.model")).count() == 0


def test_lm(spark, odd, docs, rows):
    tokens = {i: words(t) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(x for i in tokens if not held[i] for x in tokens[i])
    total, kinds = sum(c.values()), len(c)
    out = maxent_scores(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(x in c for x in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in t))
        assert math.isfinite(r.score) and r.score < 0
    gain = [sum(getattr(r, x) for r in out if r.held_out) / sum(r.n_tokens for r in out if r.held_out) for x in ("score", "base_score")]
    assert gain[0] > gain[1] + 0.1
    assert maxent_scores(odd).count() == len(ROWS) and maxent_scores(empty(odd)).count() == 0


def test_lm_is_the_same_however_rows_are_dealt(spark, docs):
    """Other partitions, other orders and no broadcast joins, as on a cluster."""
    first = {r.doc_id: r for r in maxent_scores(docs).collect()}
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = maxent_scores(docs.repartition(5, "lang", "doc_id")).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(again) == len(first) and all(r.score == pytest.approx(first[r.doc_id].score, rel=1e-9) for r in again)


def test_lm_against_brute_force(spark, docs):
    """Scores by loops over plain numbers, and the chances of all words after two given ones, which add up to 1 with the unseen."""
    from barlight.llm import maxent_lm as M

    texts, shape = M._joined(docs.limit(60), None, "doc_id", "text")
    weights = M._fit(texts, shape, M.RATES)
    own = {r.doc_id: r.score for r in maxent_scores(docs.limit(60)).collect()}

    def softmax(w, rows):
        e = [math.exp(sum(float(w[r, c]) for r in rows)) for c in range(w.shape[1])]
        return [x / sum(e) for x in e]

    checked = 0
    for row in texts.collect():
        text = M.Text(row.asDict(), shape)
        layers = text.layers(np.arange(len(text.count)))
        edge = np.concatenate([[0], np.cumsum(text.lens)])
        for i, a, b in zip(row.ids, edge[:-1], edge[1:], strict=True):
            if checked < 4 and b - a < 400:
                want = 0.0
                for t in range(a, b):
                    c, k = int(text.kind[t]), int(text.branch[t])
                    want += math.log10(softmax(weights[0], layers[0][0][t])[c] * softmax(weights[1], layers[1][0][t])[k] * (int(text.count[t]) + 0.1) / shape.mass[c, k])
                assert own[i] == pytest.approx(want, rel=1e-4)
                checked += 1
    assert checked == 4
    # Every word of the training texts once after the same two words.
    known = sorted({w for r in docs.limit(60).collect() for w in words(r.text)})
    more = docs.limit(60).select("doc_id", "text").union(spark.createDataFrame([(10**6, " ".join(known))], "doc_id long, text string"))
    texts, shape = M._joined(more, F.col("doc_id") >= 10**6, "doc_id", "text")
    row = next(r for r in texts.collect() if 10**6 in r.ids).asDict()
    text = M.Text(row, shape)
    mine = slice(int(np.cumsum(text.lens)[row["ids"].index(10**6)] - len(known) - 1), None)
    # All as if in the first one's place. Branches without a word keep a little.
    for g in text.given:
        g[mine] = g[mine][0]
    chance = 10 ** M.log_chances(text, M._fit(texts, shape, M.RATES))[mine]
    assert len(chance) == len(known) + 1 and 0.95 < chance.sum() <= 1 + 1e-6


def test_contamination(spark, odd, docs, rows):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    table = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [tuple(r) for r in table.select("item_id", "text").collect()]
    extra = spark.createDataFrame([(900, "one two"), (901, None), (902, ""), (903, "É日本"), (904, "é日本"), (None, "word1 word2"), (905, "w1x1 w2x2 w3x3")], "item_id long, text string")
    for df, source, bench, listed in ((docs, rows, table, items), (odd, ROWS, extra, [tuple(r) for r in extra.collect()])):
        windows = defaultdict(set)
        for i, t in listed:
            w = words(t, pattern)
            for k in range(max(1, len(w) - 12) if w and i is not None else 0):
                windows[tuple(w[k : k + 13])].add(str(i))
        want = []
        for i, t in source:
            w, hit, met = words(t, pattern), set(), set()
            for size in {len(x) for x in windows} if i is not None else ():
                for k in range(len(w) - size + 1):
                    if found := windows.get(tuple(w[k : k + size])):
                        hit |= set(range(k, k + size))
                        met |= found
            want.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
        assert sorted(map(tuple, contamination(df, bench).collect()), key=str) == sorted(want, key=str)
    assert contamination(empty(odd), table).count() == 0 and contamination(odd, extra.where("false")).where("contaminated").count() == 0
    assert decontaminate(odd, extra).columns == odd.columns
    asked = spark.createDataFrame([(1, "word3 word7"), (2, "word3 absent")], "query int, text string")
    near = sorted(map(tuple, proximity_matches(odd.where("doc_id is not null"), asked, 4).collect()))
    assert [x[:2] for x in near] == [(1, 1), (2, 1), (3, 1)]


def test_warc(spark, tmp_path):
    big = "x" * 99
    table = [(1, "http://a", "p" * 300), (2, "http://b", "p" * 300), (3, "http://c", big), (4, None, big), (5, "http://e", None), (6, "u\r\nX: y", ""), (7, "g", "é\r\n\r\nWARC/1.1\r\n" * 20_000), (7, "g", "é\r\n\r\nWARC/1.1\r\n" * 20_000), (None, "n", "q" * 200), (0, "z", "p" * 300)]
    pages = spark.createDataFrame([(*r, "k") for r in table], "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h in table:
        if i is not None and h and len(h.encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in table:
        b = (h or "").encode()
        f = first.get(h, i) if i is not None else None
        again = i is not None and f != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    assert sorted(map(tuple, warc_round_trip(pages).collect()), key=str) == sorted(want, key=str)
    assert warc_round_trip(pages.where("false")).count() == 0
    path = f"file://{tmp_path}/warc"
    write_warc(pages, path)
    raw = read_warc(spark, path)
    assert raw.where("type = 'continuation'").count() > 0
    with pytest.raises(Exception, match="missing"):
        payloads(raw.where("segment is null or segment <> 3")).collect()
    assert dechunked(chunked(b"abc" * 9000)) == b"abc" * 9000 and dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_warc_reads_decode_where_they_parse(spark, tmp_path):
    """archives are parsed twice at most, no worker stands beside another, and rows are those of the raw records."""
    long = "".join(chr(97 + i * i % 23) for i in range(90_000))
    made = [(1, "u", "x" * 200), (2, "u", "x" * 200), (3, "u", None), (4, "u", long), (4, "u", long), (5, "u", long), (None, "u", "é" * 40_000), (6, "u", "short")]
    path = f"file://{tmp_path}/warc"
    write_warc(spark.createDataFrame(made, "page_id long, url string, html string"), path)
    raw = read_warc(spark, path)
    assert raw.where("segment is not null").count() >= 8
    plain, own = payloads(raw), payloads(read_warc(spark, path, decoded=True), decoded=True)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(plain) == key(own) and own.columns == plain.columns and own.count() == len(made)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "MapInArrow" in line or "Aggregate" in line]
    assert ["Aggregate" if "Aggregate" in line else "MapInArrow" for line in lines] == ["MapInArrow", "MapInArrow", "Aggregate", "MapInArrow"]
    with pytest.raises(Exception, match="missing"):
        payloads(raw.where("segment is null or segment <> 1")).collect()


def lines_of(rows):
    return sorted({(i, k, x.strip(" ")) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n")) if x.strip(" ")})


def drops(rows):
    listed = lines_of(rows)
    first = {}
    for i, k, x in listed:
        first.setdefault(x, (i, k))
    out = {(i, k, "exact", *first[x]) for i, k, x in listed if first[x] != (i, k)}
    for x, f in first.items():
        a, best = x.split(" "), None
        for y, g in first.items() if len(a) >= 5 else ():
            if g < f and y != x and len(b := y.split(" ")) >= 5:
                if len(a) == len(b) and sum(p != q for p, q in zip(a, b)) == 1 or abs(len(a) - len(b)) == 1 and any(s[:j] + s[j + 1 :] == t for s, t in [(a, b) if len(a) > len(b) else (b, a)] for j in range(len(s))):
                    best = min(best or g, g)
        if best:
            out.add((*f, "near", *best))
    return out


def test_line_dedup(spark, odd, docs, rows):
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = near.split(" ")
    made = [(1, near)] + [(10 + j, " ".join(w[:j] + ["X"] + w[j + 1 :])) for j in range(10)] + [(30 + j, " ".join(w[:j] + w[j + 1 :])) for j in range(10)] + [(50 + j, " ".join([*w[:j], "Y", *w[j:]])) for j in range(11)]
    made += [(100 + n, " ".join(f"s{k}" for k in range(n))) for n in range(5, 12)] + [(200, near + "\n" + near + "\nshort one"), (201, None), (202, " ".join(["same"] * 7)), (203, " ".join(["same"] * 8)), (204, near)]
    for df, source in ((spark.createDataFrame(made, "doc_id long, text string"), made), (odd, ROWS), (docs.limit(60), [tuple(r) for r in docs.limit(60).select("doc_id", "text").collect()])):
        assert {tuple(r) for r in dropped_lines(df).collect()} == drops(source)
    # Short lines are dropped as copies, but one word's difference is too much of them; blank lines stay.
    short = [(1, "All rights reserved.\n\n日本語\none two three four"), (2, "All rights reserved.\n \n日本語 \none two three five"), (3, "All rights kept.")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in short], "doc_id long, text string, dropped_of string, lines_left string")
    assert {tuple(r) for r in dropped_lines(df).collect()} == drops(short) == {(2, 0, "exact", 1, 0), (2, 2, "exact", 1, 2)}
    assert sorted((r.doc_id, r.text, r.lines_left) for r in line_dedup(df).collect()) == [(1, short[0][1], "y"), (2, " \none two three five", "y"), (3, short[2][1], "y")]
    kept = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert kept[200] == "short one" and 204 not in kept and 201 in kept and kept[1] == near
    assert line_report(empty(odd)).count() == 0 and line_report(odd).count() == len(ROWS) and line_dedup(odd).columns == odd.columns


def test_language(spark, odd, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = identify_language(docs).collect()
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    mixed = odd.selectExpr("doc_id", "text", "cast(null as string) lang", "id", "n")
    assert {r.lang_pred for r in identify_language(mixed).collect()} == {"und"}
    texts = {lang: next(r.text for r in docs.collect() if r.lang == lang and len(r.text) > 300)[:300] for lang in ("en", "de")}
    both = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(10**9, texts["en"] + " " + texts["de"], None), (10**9 + 1, None, "en"), (10**9 + 2, "12 34 !", "en")], "doc_id long, text string, lang string"))
    found = {r.doc_id: r for r in identify_language(both).where("doc_id >= 1000000000").collect()}
    assert all(found[10**9].shares[x] > 0.3 for x in ("en", "de"))
    assert [found[10**9 + i].lang_pred for i in (1, 2)] == ["und", "und"] and found[10**9 + 1].score == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))


def test_forward_backward_against_all_labellings():
    """Label and pair probabilities of short sequences, by enumeration of every labelling."""
    from itertools import product

    from barlight.llm.language_crf import forward_backward

    rng = np.random.default_rng(2)
    potentials, start, move = rng.random((7, 3)) + 0.1, rng.random(3) + 0.1, rng.random((3, 3)) + 0.1
    of, rows_ = rng.integers(0, 7, 11), np.array([0, 4, 4, 5, 11])
    got, pairs = forward_backward(potentials, of, rows_, start, move)
    want, want_pairs = np.zeros((11, 3)), np.zeros((3, 3))
    for a, b in zip(rows_[:-1], rows_[1:]):
        whole, one, two = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for labels in product(range(3), repeat=b - a) if b > a else ():
            p = start[labels[0]] * np.prod([potentials[of[a + t], l] for t, l in enumerate(labels)]) * np.prod([move[x, y] for x, y in zip(labels[:-1], labels[1:])])
            whole += p
            for t, l in enumerate(labels):
                one[t, l] += p
            for x, y in zip(labels[:-1], labels[1:]):
                two[x, y] += p
        if b > a:
            want[a:b], want_pairs = one / whole, want_pairs + two / whole
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_language_of_each_part_of_a_switched_text(spark, docs):
    """Transitions see switches: words of texts spliced from two languages get their own labels."""
    from barlight.llm.language_crf import _potentials, Words, fit, forward_backward, spliced
    import pyarrow as pa

    train = [r for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2][:80]
    model = fit([r.text for r in train], [r.lang for r in train])
    # Weights, not shares: staying is likelier than any change, and every change is possible.
    assert model.move.argmax(1).tolist() == list(range(len(model.labels))) and (model.move > 0).all() and len(spliced(np.array([0, 500, 900]))) > 50
    held = [r for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and len(words(r.text)) > 60]
    by = {lang: [words(r.text)[:20] for r in held if r.lang == lang] for lang in {r.lang for r in held}}
    right = total = 0
    for a in sorted(by):
        for b in sorted(by):
            if a != b and by[a] and by[b]:
                text = Words(pa.array([" ".join(by[a][0] + by[b][-1])]))
                chance, _ = forward_backward(_potentials(model, text), text.of, text.rows, model.start, model.move)
                gold = [a] * 20 + [b] * 20
                right += sum(model.labels[k] == g for k, g in zip(chance.argmax(1), gold))
                total += 40
    assert total and right / total > 0.9


def test_language_on_awkward_tables(spark, odd, docs):
    assert identify_language(odd.selectExpr("doc_id", "text", "'x' as lang").where("false")).count() == 0
    named = odd.selectExpr("doc_id", "text", "'x' as lang", "'held' as held", "1 as sure")
    got = identify_language(named).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.sure == 0} == {"und"}


def test_language_is_learned_outside_the_driver(spark, docs, monkeypatch):
    """The driver's Python never learns, and the model is that of the ordered sample, whatever the order of its rows."""
    from barlight.llm import language_crf as L

    sample = L._sampled(docs, F.lit(True), "doc_id", "text", "lang")
    rows = sample.orderBy("lang", "rank").collect()
    want = L.fit([r.text for r in rows], [r.lang for r in rows])

    def fit(texts, labels):
        assert not texts, "learned in the driver"
        return L.Model([], *[np.zeros(0)] * 5)

    monkeypatch.setattr(L, "fit", fit)
    for frame in (sample, sample.orderBy(F.desc("text"))):
        got = L.learned(frame)
        assert got.labels == want.labels and all(np.array_equal(getattr(got, x), getattr(want, x)) for x in ("ngrams", "words", "lexicon", "start", "move"))
    assert L.learned(None).labels == L.learned(sample.where("false")).labels == []
    assert {r.lang_pred for r in identify_language(docs).collect()} <= {*want.labels, "und"} and len(want.labels) > 1


def test_pipeline_stages_return_memory(spark, monkeypatch):
    """Every stage begins with the driver's freed memory given back; where the JVM cannot, the stage runs all the same."""
    import corpus_pipeline
    from barlight.llm.store import return_memory

    with open("/proc/self/maps") as maps:
        glibc = "/libc.so.6" in maps.read()
    assert return_memory(spark) is glibc
    order = []
    monkeypatch.setattr(corpus_pipeline, "return_memory", lambda s: order.append("returned"))
    for name, stage in corpus_pipeline.STAGES:
        order.append(name)
        with pytest.raises(AttributeError):
            stage(spark, None, FOLDER)
    assert order == [x for name, _ in corpus_pipeline.STAGES for x in (name, "returned")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Documents with nulls, repeats and empty texts in every column of the table."""
    more = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, " \n\t", None, "s", 0), (10**6 + 3, "1 2 3", "en", "s", 5), (None, "the null one has words enough for a set", "en", "s", 5), (10**6 + 4, LONG, "en", "s", len(LONG)), (10**6 + 5, "same text of more than five words", "en", "s", 1), (10**6 + 5, "same text of more than five words", "en", "s", 1)]
    return spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))


def test_pipeline_stages_on_awkward_rows(spark, awkward):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, FOLDER)
        assert set(awkward.columns) <= set(out.columns) and stage(spark, awkward.where("false"), FOLDER).count() == 0, name
        ids = Counter(r.doc_id for r in out.collect())
        both = ids[10**6 + 5]
        assert both == (1 if name == "n-gram Jaccard join" else 2) and ids[10**6 + 4] == 1, name
        assert (10**6 in ids, 10**6 + 1 in ids, 10**6 + 3 in ids) == ((False,) * 3 if name == "language ID" else (True,) * 3), name


def test_pipeline(spark, rows):
    import corpus_pipeline
    import sentencepiece

    stages = [s for s, _ in corpus_pipeline.STAGES]
    assert stages == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    out = [r.asDict() for r in corpus_pipeline.run(spark, FOLDER).collect()]
    # Brute force over what language ID keeps: every document of this table has a language.
    gone = defaultdict(set)
    for i, k, *_ in drops(rows):
        gone[i].add(k)
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows if len(gone[i]) < len(t.split("\n"))}
    groups = components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text, pattern)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    clean = {}
    for i, t in kept.items():
        w, hit = words(t, pattern), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        if not hit or 20 * len(hit) < len(w):
            clean[i] = t
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert sorted((o["doc_id"], o["text"], o["ids"], o["n_chars"]) for o in out) == sorted((i, t, [*sp.encode(t), sp.eos_id()], len(t)) for i, t in clean.items())
    assert all(o["decoded_sha256"] == hashlib.sha256(sp.decode(o["ids"]).encode()).hexdigest() for o in out)
