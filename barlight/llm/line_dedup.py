"""Operator 9: line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared by words: two lines are near if one word inserted, deleted
or replaced turns one into the other. The deletion neighbourhood of a line is
the line itself and the line without each one of its words; near lines share a
member of it. As all members of all lines would be as many rows as there are
words, a first join uses the neighbourhood of the line's ends only: whatever
single word differs, either the first or the last END words are untouched and
the other end agrees up to one deletion. Lines that share an end key with
another line, which few do, then emit their whole neighbourhood. Every line
that is not blank is compared for equality, lines of min_words words or more
also for one word's difference: in five words that leaves a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitfilter import bit_filter, may_contain
from .store import free_name, materialise, release

#: Words kept from each end of a line for the first join.
END = 3


def _lines(docs: DataFrame) -> DataFrame:
    """(id, at, line, n, h1, h2) of every line but blank ones; null ids and texts have none."""
    lines = docs.where("id is not null").select("id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.select("id", "at", F.trim("raw").alias("line"))
    lines = lines.select("id", "at", "line", (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n")).where("line <> ''")
    return lines.select("id", "at", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _ends() -> str:
    """SQL: hashed end keys of `line` from its first and last END words; whole deletion variants where the ends would overlap.

    A key holds the number of words that both lines have once the differing
    word is out. A line that may be the shorter one of a pair also gives the
    key that its longer partner makes by leaving a word out of an end.
    """
    long_ = """array(xxhash64(0, n, head, tail), xxhash64(0, n - 1, head, tail),
        xxhash64(1, n, substring_index(head, ' ', 2), tail), xxhash64(2, n, head, substring_index(tail, ' ', -2)),
        xxhash64(1, n - 1, substring_index(head, ' ', -2), tail), xxhash64(1, n - 1, concat(substring_index(head, ' ', 1), ' ', substring_index(head, ' ', -1)), tail), xxhash64(1, n - 1, substring_index(head, ' ', 2), tail),
        xxhash64(2, n - 1, head, substring_index(tail, ' ', -2)), xxhash64(2, n - 1, head, concat(substring_index(tail, ' ', 1), ' ', substring_index(tail, ' ', -1))), xxhash64(2, n - 1, head, substring_index(tail, ' ', 2)))"""
    words = "split(line, ' ')"
    short = f"concat(array(xxhash64(3, line)), transform(sequence(0, n - 1), i -> xxhash64(3, concat_ws(' ', filter({words}, (w, j) -> j <> i)))))"
    return f"array_distinct(case when n > {2 * END} then {long_} when n = {2 * END} then concat({short}, {long_}) else {short} end)"


def _variants(texts: DataFrame) -> DataFrame:
    """(h1, h2, first, gone, n, key) of each line of texts: gone 0 for the whole line, else the number of the word left out.

    A key is the exclusive or of hashes of (word, place), so that leaving one
    word out needs those before it at their places (a), those after it one
    place earlier (b), and of the prefixes only a ^ b, summed by chunks.
    """
    xor = lambda array: f"aggregate({array}, 0L, (x, y) -> x ^ y)"
    cut = texts.select("h1", "h2", "first", F.split("line", " ").alias("words"))
    cut = cut.select("h1", "h2", "first", F.expr("transform(words, (w, j) -> xxhash64(w, j - 1))").alias("b"), F.expr("transform(words, (w, j) -> xxhash64(w, j) ^ xxhash64(w, j - 1))").alias("c"))
    cut = cut.select("h1", "h2", "first", "b", "c", F.expr(xor("b")).alias("all_b"), F.expr(f"transform(sequence(0, (size(c) - 1) div 64), k -> {xor('slice(c, k * 64 + 1, 64)')})").alias("chunks"))
    before = f"{xor('slice(chunks, 1, i div 64)')} ^ {xor('slice(c, (i div 64) * 64 + 1, i % 64)')}"
    each = cut.select("h1", "h2", "first", F.size("b").alias("words"), F.posexplode(F.expr(f"concat(array(all_b ^ {xor('chunks')}), transform(b, (x, i) -> all_b ^ x ^ {before}))")).alias("gone", "key"))
    return each.select("h1", "h2", "first", "gone", F.when(F.col("gone") == 0, F.col("words")).otherwise(F.col("words") - 1).alias("n"), "key")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """(doc_id, line, kind, of_doc, of_line) of the lines that an earlier line of the corpus equals (exact) or is near to (near).

    Earlier is by (doc_id, line number); line numbers count from 0. A near
    line names the earliest line near to it, kept or not. Lines of fewer than
    min_words words, which blanks (U+0020) separate, are dropped as exact
    copies only. Blanks at a line's ends do not count, and lines without more
    are left alone. A null text has no lines, and a row with a null id takes no
    part. Repeated rows of an id give the same line again and are one line
    here. Very long texts and lines are compared whole; an empty table gives an
    empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lines = _lines(docs)
    ended = lines.select("*", F.substring_index("line", " ", END).alias("head"), F.substring_index("line", " ", -END).alias("tail"))
    keyed = materialise(ended.select("id", "at", "h1", "h2", F.when(F.col("n") >= min_words, F.expr(_ends())).alias("ends")), "lines")
    firsts = materialise(keyed.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first")), "firsts")
    release(docs.sparkSession)

    # Repeated lines hold equal keys, so min and max of h1 tell whether a key joins different lines.
    keys = keyed.select("h1", F.explode("ends").alias("key"))
    joint = materialise(keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key"), "joint")
    joint_bits = bit_filter(joint, "key")
    held = keys.where(may_contain(joint_bits.scalar(), F.col("key"))).join(joint, "key", "left_semi")
    near = materialise(held.select("h1").distinct(), "near")
    release(docs.sparkSession)

    bits = bit_filter(near, "h1")
    texts = lines.where(may_contain(bits.scalar(), F.col("h1"))).join(near, "h1", "left_semi").select("h1", "h2", "line").distinct()
    texts = materialise(texts.join(firsts, ["h1", "h2"]), "texts")
    variants = materialise(_variants(texts), "variants")
    shared = variants.groupBy("n", "key").agg(F.count("*").alias("many")).where("many > 1").drop("many")
    variants = materialise(variants.join(shared, ["n", "key"]), "shared")
    groups = variants.groupBy("n", "key").agg(F.min(F.when(F.col("gone") == 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("gone") > 0, F.col("first"))).alias("cut"))
    replaced = variants.where("gone > 0").groupBy("n", "key", "gone").agg(F.min("first").alias("least"))
    by_length = variants.join(groups, ["n", "key"]).select("h1", "h2", "first", F.when(F.col("gone") == 0, F.col("cut")).otherwise(F.col("whole")).alias("by"))
    by_word = variants.join(replaced, ["n", "key", "gone"]).select("h1", "h2", "first", F.col("least").alias("by"))
    best = by_length.union(by_word).where("by is not null and by < first").groupBy("h1", "h2").agg(F.min("by").alias("by"), F.max("first").alias("first"))
    best = _verified(materialise(best, "best"), texts)

    # A line whose text has an earlier copy is dropped as exact; the first copy is dropped if a different earlier line is near.
    seen = keyed.select("id", "at", "h1", "h2").distinct().join(firsts, ["h1", "h2"])
    exact = seen.where("struct(id, at) > first").select("id", "at", F.lit("exact").alias("kind"), F.col("first.id").alias("of_doc"), F.col("first.at").alias("of_line"))
    first_near = best.select(F.col("first.id").alias("id"), F.col("first.at").alias("at"), F.lit("near").alias("kind"), F.col("by.id").alias("of_doc"), F.col("by.at").alias("of_line"))
    return exact.union(first_near).select(F.col("id").alias("doc_id"), F.col("at").alias("line"), "kind", "of_doc", "of_line")


def _verified(best: DataFrame, texts: DataFrame) -> DataFrame:
    """best without pairs whose words are more than one edit apart: shared words at both ends must leave at most one."""
    mine = texts.select("h1", "h2", F.split("line", " ").alias("a"))
    theirs = texts.select(F.col("first").alias("by"), F.split("line", " ").alias("b"))
    pairs = best.join(mine, ["h1", "h2"]).join(theirs, "by")
    shared = lambda a, b: f"coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0) - 1, least(size(a), size(b)))"
    pairs = pairs.withColumn("ahead", F.expr(shared("a", "b"))).withColumn("behind", F.expr(shared("reverse(a)", "reverse(b)")))
    return pairs.where("greatest(size(a), size(b)) - least(size(a), size(b)) <= 1 and ahead + behind >= greatest(size(a), size(b)) - 1").select("h1", "h2", "first", "by")


def _per_document(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("dropped"), F.count_if(F.col("kind") == "exact").alias("n_exact"), F.count_if(F.col("kind") == "near").alias("n_near"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, dropped) of every document; dropped holds line numbers in order."""
    per = _per_document(dropped_lines(docs, id_col, text_col, min_words))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines"))
    none = F.expr("cast(array() as array<int>)")
    return every.join(per, "doc_id", "left").select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped", none).alias("dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """docs with the dropped lines taken out of the text; a document that loses all its lines goes.

    Documents without dropped lines, and rows with a null id or text, stay as they are.
    """
    key, dropped, rest = (free_name(docs, x) for x in ("dropped_of", "dropped_lines", "lines_left"))
    per = _per_document(dropped_lines(docs, id_col, text_col, min_words)).select(F.col("doc_id").alias(key), F.col("dropped").alias(dropped))
    joined = docs.join(per, F.col(id_col) == F.col(key), "left")
    left = F.expr(f"filter(split(`{text_col}`, '\\n'), (x, i) -> not array_contains({dropped}, i))")
    joined = joined.withColumn(rest, F.when(F.col(dropped).isNotNull(), left)).where(f"{rest} is null or size({rest}) > 0")
    text = F.when(F.col(rest).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    return joined.withColumn(text_col, text).select(docs.columns)
