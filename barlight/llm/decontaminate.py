"""Operator 7: benchmark decontamination by a positional inverted index, with DataFrame functions only.

Postings (term, document, position) are made for the anchors of the test
phrases: the ANCHORS rarest terms of each phrase by document frequency in the
corpus. Their lists, shifted by the term's offset in the phrase, are
intersected by grouping on (document, phrase, start); what remains is compared
word by word with the document. A filter of bounded size picks out the
documents for that comparison in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitfilter import bit_filter, may_contain
from .store import free_name, materialise

#: Words of a phrase whose postings are intersected.
ANCHORS = 3
#: Terms that are broadcast at most; more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: What separates words once A-Z are lower case: every other ASCII character than a-z and 0-9.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cut(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR), "")


def _words(text: str) -> Column:
    """Words, A-Z in lower case."""
    return _cut(F.translate(text, _UPPER, _LOWER))


def _folded(text: str) -> Column:
    """Words, all letters in lower case: as many words at the same places, quicker, and equal wherever _words are."""
    return _cut(F.lower(text))


def _terms(df: DataFrame) -> DataFrame:
    """df with the broadcast hint if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def phrases(items: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(phrase, len, words, folded) of the distinct windows, and (phrase, item): the items of each."""
    cut = items.where(f"`{id_col}` is not null").select(F.col(id_col).alias("item"), _words(text_col).alias("w"), _folded(text_col).alias("f")).where("size(w) > 0")
    each = cut.select("item", "w", "f", F.explode(F.expr(f"sequence(1, greatest(1, size(w) - {width - 1}))")).alias("at"))
    each = each.select("item", F.expr(f"slice(w, at, {width})").alias("words"), F.expr(f"slice(f, at, {width})").alias("folded"))
    each = each.select("item", F.concat_ws(" ", "words").alias("words"), F.concat_ws(" ", "folded").alias("folded"), F.size("words").alias("len"))
    each = materialise(each.withColumn("phrase", F.sha2("words", 256)), "phrases")
    return each.select("phrase", "len", "words", "folded").distinct(), each.select("phrase", "item").distinct()


def phrase_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, hits) of docs(id, text) with a match; hits: (phrase, start, len) of every exact occurrence, starts from 0."""
    placed = materialise(windows.select("phrase", "len", "words", F.posexplode(F.split("folded", " ")).alias("offset", "term")), "placed")
    vocabulary = _terms(placed.select("term").distinct())
    df = docs.select(F.explode(_folded("text")).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    df = materialise(df, "frequency")
    order = Window.partitionBy("phrase").orderBy("df", "offset")
    # A phrase with a term that the corpus lacks has no match.
    whole = placed.join(df, "term").withColumn("met", F.count("*").over(Window.partitionBy("phrase"))).where("met = len")
    anchors = whole.withColumn("rank", F.row_number().over(order)).where(f"rank <= {ANCHORS}").select("term", "phrase", "offset", F.least(F.lit(ANCHORS), "len").alias("need"))
    anchors = materialise(anchors, "anchors")
    targets = anchors.groupBy("term").agg(F.collect_list(F.struct("phrase", "offset", "need")).alias("targets"))
    postings = docs.select("id", F.posexplode(_folded("text")).alias("at", "term")).join(_terms(targets), "term")
    starts = postings.select("id", "at", F.explode("targets").alias("t")).select("id", "t.phrase", F.col("t.need").alias("need"), (F.col("at") - F.col("t.offset")).alias("start"), F.col("t.offset").alias("offset"))
    # Repeated rows of a document give a posting again; distinct offsets count it once.
    found = starts.where("start >= 0").groupBy("id", "phrase", "start").agg(F.collect_set("offset").alias("offsets"), F.max("need").alias("need")).where("size(offsets) = need").select("id", "phrase", "start")
    found = found.join(windows.select("phrase", "words", "len"), "phrase").groupBy("id").agg(F.collect_list(F.struct("phrase", "start", "len", "words")).alias("found"))
    found = materialise(found, "found")
    bits = bit_filter(found, "id")
    near = docs.where(may_contain(bits.scalar(), F.col("id"))).join(found, "id")
    near = near.withColumn("w", _words("text")).withColumn("hits", F.expr("filter(found, m -> concat_ws(' ', slice(w, m.start + 1, m.len)) = m.words)"))
    return near.where("size(hits) > 0").select("id", F.expr("transform(hits, m -> struct(m.phrase, m.start, m.len))").alias("hits")).distinct()


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, query, start): a query's rarest term at `start` with every other term of it within so many words of it.

    queries(query, text). Postings are those of the queries' terms. Null and
    empty texts match nothing; repeated rows count once.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = materialise(queries.select("query", F.explode(F.array_distinct(_words("text"))).alias("term")), "asked")
    postings = docs.select("id", F.posexplode(_words("text")).alias("at", "term")).join(_terms(asked.select("term").distinct()), "term").distinct()
    postings = materialise(postings, "postings")
    df = postings.groupBy("term").agg(F.countDistinct("id").alias("df"))
    ranked = asked.join(df, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("df", F.lit(0)), "term")))
    ranked = materialise(ranked.withColumn("terms", F.count("*").over(Window.partitionBy("query"))), "ranked")
    first = ranked.where("rank = 1").select("query", "term", "terms").join(postings, "term").select("query", "terms", "id", F.col("at").alias("start"))
    rest = ranked.where("rank > 1").select("query", "term").join(postings, "term").select("query", "id", "term", "at")
    both = first.join(rest, ["query", "id"], "left").where(f"at is null or abs(at - start) <= {within}")
    met = both.groupBy("query", "id", "start", "terms").agg(F.count_distinct("term").alias("met")).where("met = terms - 1")
    return met.select(F.col("id").alias("doc_id"), "query", "start")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    A document is contaminated if at least one in `share` of its words lies in
    an occurrence of a window of `width` consecutive words of an item; an item
    of fewer words is one window. Null and empty texts have no words; items
    without words or id are ignored. A row with a null id gets its own words
    and no hits. An id names one text, and repeated rows give repeated results.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    windows, owners = phrases(items, item_col, item_text, width)
    hits = materialise(phrase_matches(docs.where("id is not null"), windows).select("id", F.explode("hits").alias("m")).select("id", "m.*"), "hits")
    covered = hits.select("id", F.explode(F.expr("sequence(start, start + len - 1)")).alias("at")).distinct().groupBy("id").agg(F.count("*").alias("n_hit"))
    met = hits.select("id", "phrase").distinct().join(owners, "phrase").select("id", F.col("item").cast("string").alias("item")).distinct()
    met = met.groupBy("id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    every = docs.select("id", F.coalesce(F.size(_folded("text")), F.lit(0)).cast("long").alias("n_words"))
    every = every.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    out = every.join(covered.join(met, "id"), "id", "left").select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """docs without the contaminated ones; rows with a null id stay."""
    key = free_name(docs, "contaminated_id")
    bad = contamination(docs, items, id_col, **options).where("contaminated and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, F.col(id_col) == F.col(key), "left_anti")
