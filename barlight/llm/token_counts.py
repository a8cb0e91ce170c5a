"""Operator 5: token counts through a digest cache.

A text's count is stored under the digest of its content and the version of
its tokenizer. Texts are joined to the stored counts by digest; each distinct
text without one is encoded once, and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh_path, materialise, shuffle_partitions
from .words import slices

#: Words whose counts a worker keeps between batches.
CACHE_WORDS = 1_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the version of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data + f"{library} {__import__(library).__version__}".encode()).hexdigest()


class Counter:
    """Counts tokens of whole texts as the library of the tokenizer's file does.

    For byte-level BPE with the usual word pattern, a text is the sum of its
    words between single blanks, each with the blank before it, so a word is
    encoded once. A word with white space at its ends depends on its
    neighbours; texts that have one are encoded whole.
    """

    def __init__(self, name: str, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word = False
        if name.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.encode = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
        else:
            import json

            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(data.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            spec = json.loads(data)
            pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
            self.by_word = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in added)
        self.words: dict[str, int] = {}
        self.heads: dict[str, int] = {}

    def _learn(self, known: dict[str, int], words: set[str], blank: str) -> None:
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known_now = {w: known[w] for w in words if w in known}
            known.clear()
            known.update(known_now)
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        for w in new:
            known[w] = -1
        known.update(zip(plain, self.encode([blank + w for w in plain]), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.encode(texts)
        cut = [t.split(" ") for t in texts]
        words: set[str] = set()
        for c in cut:
            words.update(c[1:])
        self._learn(self.words, words, " ")
        self._learn(self.heads, {c[0] for c in cut}, "")
        out, whole = [], []
        for i, c in enumerate(cut):
            counts = [self.words[w] for w in c[1:]]
            counts.append(self.heads[c[0]] if texts[i] else 0)
            out.append(sum(counts))
            if min(counts) < 0:
                whole.append(i)
        for i, n in zip(whole, self.encode([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = n
        return out


_COUNTERS: dict[str, Counter] = {}


def _first_of_task(batches):
    """(digest, text) rows whose digest is new in this task, so that copies are not all shuffled."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document's whole text.

    tokenizer is a .json file for the tokenizers library or a .model file for
    sentencepiece; no begin, end or added special tokens are counted. cache is
    a folder that Spark can read and append to; without one a new folder in
    the shared one is used. A null text counts as empty. Repeated rows and
    null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    with open(tokenizer, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    name = os.path.basename(tokenizer)
    cache = cache or fresh_path(spark, "token-cache")
    path = f"{cache}/version={version}"

    def run(batches):
        if version not in _COUNTERS:
            _COUNTERS[version] = Counter(name, data.value)
        for first in _first_of_task(batches):
            for batch in slices(first, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_COUNTERS[version].count(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    stored = "digest binary, n_tokens long"
    texts = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(_first_of_task, "digest binary, text string")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        known = materialise(spark.read.schema(stored).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
        texts = texts.join(known, "digest", "left_anti")
    texts = texts.repartition(shuffle_partitions(spark), "digest")
    texts.mapInArrow(run, stored).write.mode("append").parquet(path)
    # One written row for each digest, so that the join has no aggregate above its shuffle and a digest that many rows share can be split.
    counts = materialise(spark.read.schema(stored).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
