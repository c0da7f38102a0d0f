"""Operator 6: quality rules by cross-document line frequency.

Lines are normalised and hashed, and the distinct texts of each host that hold
one are counted. A line in too large a share of a host's texts is boilerplate:
it is removed everywhere but in the first document that has it. A document left
with too few words is depleted and goes. The base rules look at one text alone.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import SPACE, cut, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
#: Lines above the limit that are broadcast, in all and of one host, at most; each takes some 50 bytes.
MOST_LINES, HOST_LINES = 50_000, 2_000


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words that lie in a window of `width` words that the text has twice or more.

    Windows are compared by a 64-bit hash. Hashes are sorted with their places;
    a window whose neighbour has the same hash repeats; its place covers what
    the next such place doesn't. n log n whatever repeats.
    """
    zero = F.lit(0).cast("long")

    def of(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.aggregate(F.array(order), zero, lambda _, s: covered(s))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, i + 1)["h"] == x["h"]).eqNullSafe(True))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(zero.alias("n"), F.lit(-width).alias("last"))
        step = F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).cast("long").alias("n"), i.alias("last")))
        return step["n"]

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        many = F.aggregate(F.array(hashes), zero, lambda _, h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(of(h)))
        return F.when(F.size(w) <= width, zero).otherwise(many)

    # an aggregate over one array binds it to a variable: it is made once, wherever the optimizer puts this expression
    return F.aggregate(F.array(words), zero, lambda _, w: counted(w))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " "))))


def held_lines(text: Column) -> Column:
    """Hash and number of words of each line with a word."""
    return F.transform(lines_with_words(text), lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n")))


def keyed(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("_text")).withColumn("text_hash", F.xxhash64("_text"))


def exploded(rows: DataFrame) -> DataFrame:
    lines = rows.select("doc_id", "host", "text_hash", F.explode(held_lines(F.col("_text"))).alias("x"))
    return lines.select("doc_id", "host", "text_hash", F.col("x.h").alias("h"), F.col("x.n").alias("n"))


def lines_above(rows: DataFrame, share: float, least_texts: int) -> DataFrame:
    """_h, _l, first (host, line hash, the first document with it) of lines above the limit, as a table."""
    texts = rows.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("texts"))
    by_text = exploded(rows).groupBy("host", "h", "text_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    by_line = by_text.groupBy("host", "h").agg(F.count("*").alias("in_texts"), F.min("first").alias("first")).where(F.col("in_texts") >= least_texts)
    above = by_line.join(texts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).where(F.col("in_texts") > share * F.col("texts"))
    return cut(above.select(F.col("host").alias("_h"), F.col("h").alias("_l"), "first"))


def removed_words(rows: DataFrame, above: DataFrame) -> DataFrame:
    """_h, _t, _d (host, text hash, id) and how many words of such a row are in lines above the limit; rows without any are left out."""
    gone = exploded(rows).join(above, F.col("host").eqNullSafe(F.col("_h")) & (F.col("h") == F.col("_l")))
    gone = gone.where(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))).groupBy("host", "text_hash", "doc_id").agg(F.sum("n").alias("removed"))
    # rows that repeat an id and text were summed together
    twins = rows.groupBy("host", "text_hash", "doc_id").agg(F.count("*").alias("times")).where("times > 1")
    twins = twins.select(F.col("host").alias("_h"), F.col("text_hash").alias("_t"), F.col("doc_id").alias("_d"), "times")
    same = F.col("host").eqNullSafe(F.col("_h")) & (F.col("text_hash") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    gone = gone.join(twins, same, "left").withColumn("removed", (F.col("removed") / F.coalesce("times", F.lit(1))).cast("long"))
    return cut(gone.select(F.col("host").alias("_h"), F.col("text_hash").alias("_t"), F.col("doc_id").alias("_d"), "removed"))


def with_removed(rows: DataFrame, df: DataFrame, id_col: str, text_col: str, host_col: str, share: float, least_texts: int) -> DataFrame:
    """Adds removed, the words in lines above the limit, to rows with _id, _host, _hash and _lines.

    The lines above the limit of a host are few, as each is in a share of its
    texts. Where they number at most MOST_LINES, and HOST_LINES for a host,
    they are broadcast as a map for each host and every row is judged by itself.
    Beyond that they are joined by line, and only ids, hashes and numbers are
    shuffled for it.
    """
    above = lines_above(keyed(df, id_col, text_col, host_col), share, least_texts)
    size = above.groupBy("_h").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("host")).first()
    if size["all"] <= MOST_LINES and size["host"] <= HOST_LINES:
        firsts = above.groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("_l", F.struct("first").alias("first")))).alias("_above"))
        own = F.struct(F.struct(F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash")).alias("first"))

        def counted(m: Column) -> Column:
            gone = F.filter("_lines", lambda x: ~F.try_element_at(m, x["h"]).eqNullSafe(own) & F.try_element_at(m, x["h"]).isNotNull())
            return F.aggregate(gone, F.lit(0).cast("long"), lambda n, x: n + x["n"])

        out = rows.join(F.broadcast(firsts), F.col("_host").eqNullSafe(F.col("_h")), "left")
        return out.withColumn("removed", F.when(F.col("_above").isNull(), F.lit(0).cast("long")).otherwise(counted(F.col("_above"))))
    gone = removed_words(keyed(df, id_col, text_col, host_col), above)
    same = F.col("_hash").eqNullSafe(F.col("_t")) & F.col("_id").eqNullSafe(F.col("_d")) & F.col("_host").eqNullSafe(F.col("_h"))
    return rows.join(gone, same, "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.1, least_texts: int = 20, least_words: int = 20) -> DataFrame:
    """Each row of a table as a struct _row, with the measures and verdict of quality() beside it. Rows are shuffled only beyond the bounds that with_removed() states."""
    text = F.col("_text")
    lines = lines_with_words(text)
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("_host"), text_or_empty(text_col).alias("_text"))
    rows = rows.withColumn("_words", words_of(text))
    rows = rows.select(
        "_row",
        "_id",
        "_host",
        F.xxhash64("_text").alias("_hash"),
        held_lines(text).alias("_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.aggregate(F.array(lines), F.lit(0).cast("long"), lambda _, x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    out = with_removed(rows, df, id_col, text_col, host_col, share, least_texts)
    removed = F.col("removed")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("_row", F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("n_words") - removed >= least_words)).alias("kept"), removed.alias("removed_words"))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.1, least_texts: int = 20, least_words: int = 20) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words of each row.

    A line is above the limit if more than `share` of the host's distinct texts
    have it, and at least `least_texts`. Equal texts count once, so that copies
    of a text don't condemn it. A document is depleted if fewer than
    `least_words` words outlast the removal. A null text is empty and fails the
    base rules; a null host is a host; rows without an id are told apart by
    their texts; rows that repeat an id and text are judged alike.
    """
    return judged(df, id_col, text_col, host_col, share, least_texts, least_words).drop("_row")


def good_rows(df: DataFrame, **rules) -> DataFrame:
    """The rows of a table that quality() keeps; its columns stay."""
    return judged(df, **rules).where("kept").select("_row.*")
