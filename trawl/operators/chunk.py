"""Overlapping windows of words or tokens, and profiles of lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import words


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows over n words: 0 alone if they fit one, none for none, else every step up to n."""
    step = max(1, size - overlap)
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))


def chunk_words(df: DataFrame, text_col: str = "text", size: int = 300, overlap: int = 60, split=words) -> DataFrame:
    """A row per window: the table's other columns, chunk_idx from 0, text, n_words. A text that fits one window stays as it is written."""
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(*rest, F.col(text_col).alias("_text"), split(F.col(text_col)).alias("_w"))
    rows = rows.select(*rest, "_text", "_w", F.posexplode(window_starts(F.size("_w"), size, overlap)).alias("chunk_idx", "_at"))
    piece = F.slice("_w", F.col("_at") + 1, size)
    return rows.select(*rest, "chunk_idx", F.when(F.size("_w") <= size, F.col("_text")).otherwise(F.array_join(piece, " ")).alias("text"), F.size(piece).alias("n_words"))


def over_limit(chunks: DataFrame, limit: int = 512, split=words) -> DataFrame:
    """Chunks with more tokens than the limit: empty in a sound corpus."""
    return chunks.where(F.size(split(F.col("text"))) > limit)


def length_profile(df: DataFrame, n: Column, size: int) -> DataFrame:
    """One row: mean, median, p90 and max of a length, and the percentage that fits."""
    return df.select(n.alias("n")).agg(
        F.round(F.avg("n"), 6).alias("mean_len"),
        F.expr("percentile(n, 0.5)").alias("median_len"),
        F.round(F.expr("percentile(n, 0.9)"), 6).alias("p90_len"),
        F.max("n").alias("max_len"),
        F.round(F.avg((F.col("n") <= size).cast("double")) * 100, 6).alias("pct_fit"),
    )
