"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Lines are normalised (trimmed, blanks collapsed, lower-cased) and hashed. On each host
a line is counted once for each document that holds it, so repeated rows don't count
against one another, while copies of a page under other keys do. Lines found in more
documents than the limit are removed, and documents that keep too little are rejected.

Defined cases: a null text is empty (no words, base fails); a null host is a host of its
own; ties and repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RE, BLANKS, let

SYMBOLS = r"[#*$%&|<>]"


def _repeat_words(words: Column, k: int) -> Column:
    """Words in runs of ``k`` words that occur twice or more in the array, the first included.

    The usual case, no repeated run, costs one sort of 64-bit hashes. Otherwise runs are
    sorted with their places, those with an equal neighbour kept, and the union of their
    spans measured, so that a text of one repeated line stays at n log n.
    """

    def spans(starts: Column) -> Column:
        # each start covers k words, or as many as lie before the next start
        return F.aggregate(
            F.sequence(F.lit(1), F.size(starts)),
            F.lit(0).cast("long"),
            lambda acc, i: acc + F.when(i == F.size(starts), F.lit(k)).otherwise(F.least(F.lit(k), F.get(starts, i) - F.get(starts, i - 1))).cast("long"),
        )

    def places(runs: Column) -> Column:
        pairs = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        return let(pairs, lambda s: let(starts(s), spans))

    def in_runs(runs: Column) -> Column:
        twice = F.size(F.array_distinct(runs)) < F.size(runs)
        return F.when(twice, places(runs)).otherwise(F.lit(0).cast("long"))

    def of(h: Column) -> Column:
        runs = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return let(runs, in_runs)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, BLANK_RE + "+", " ")))


def line_quality(
    df: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    host: str = "source",
    max_docs: int = 20,
    min_kept_share: float = 0.3,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    window: int = 5,
    with_text: bool = False,
) -> DataFrame:
    """Return one row per input row: the key, base counts, what was removed, and ``kept``.

    A line is removed on a host if it is in more than ``max_docs`` documents there, however
    large the host is; a document is depleted if less than
    ``min_kept_share`` of its words, or fewer than ``min_words``, remain. ``with_text``
    adds the text without the removed lines.

    The table of frequent lines is found with map-side counts and joined by (host, line)
    as an ordinary shuffle join, which adaptive execution can split where one line is in a
    third of all documents; it is not broadcast, since its size has no proven bound.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    keyed = df.select(F.col(key).alias("_m_own"), named(key).alias("_m_key"), named(host).alias("_m_host"), body.alias("_m_text"))
    keyed = keyed.withColumn("_m_hash", F.xxhash64("_m_text"))
    lines = F.filter(F.split("_m_text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    words = F.array_remove(F.split("_m_text", BLANK_RE + "+"), "")
    base = (
        keyed.withColumns({"_m_words": words, "_m_lines": lines})
        .withColumns(
            {
                "n_words": F.size("_m_words").cast("long"),
                "word_chars": F.length(F.array_join("_m_words", "")).cast("long"),
                "n_symbols": F.regexp_count("_m_text", F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size("_m_lines") - F.size(F.array_distinct("_m_lines"))).cast("long"),
                "n_repeat_words": _repeat_words(F.col("_m_words"), window),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    )
    spread = keyed.select("_m_key", "_m_host", "_m_hash", F.explode(lines).alias("_m_line"))
    spread = spread.select("_m_key", "_m_host", "_m_hash", F.xxhash64(normal_line(F.col("_m_line"))).alias("_m_line"), F.size(F.array_remove(F.split("_m_line", BLANK_RE + "+"), "")).alias("_m_n"))
    # rows without a key are told apart by their texts
    spread_docs = spread.groupBy("_m_host", "_m_line", "_m_key", F.when(F.col("_m_key") == "\x00", F.col("_m_hash")).alias("_m_text_of")).agg(F.lit(1).alias("_m_one"))
    frequent = spread_docs.groupBy("_m_host", "_m_line").agg(F.count("*").alias("_m_in")).where(F.col("_m_in") > max_docs).select("_m_host", "_m_line")
    # equal keys hold equal texts of one host, so one of several equal rows stands for all
    per_doc = spread.groupBy("_m_key", "_m_host", "_m_hash", "_m_line").agg(F.max("_m_n").alias("_m_n"), F.count("*").alias("_m_times"))
    copies = keyed.groupBy("_m_key", "_m_host", "_m_hash").agg(F.count("*").alias("_m_rows"))
    cut = per_doc.join(frequent, ["_m_host", "_m_line"]).groupBy("_m_key", "_m_host", "_m_hash").agg(F.sum(F.col("_m_n") * F.col("_m_times")).alias("_m_cut"), F.sum("_m_times").alias("_m_cut_lines"), *([F.collect_set("_m_line").alias("_m_gone")] if with_text else []))
    cut = cut.join(copies, ["_m_key", "_m_host", "_m_hash"]).select(F.col("_m_key").alias("_m_k"), F.col("_m_host").alias("_m_h"), F.col("_m_hash").alias("_m_x"), (F.col("_m_cut") / F.col("_m_rows")).cast("long").alias("_m_cut"), (F.col("_m_cut_lines") / F.col("_m_rows")).cast("long").alias("_m_cut_lines"), *(["_m_gone"] if with_text else []))
    if not with_text:
        base = base.drop("_m_text", "_m_words", "_m_lines")
    out = base.join(cut, (F.col("_m_key") == F.col("_m_k")) & (F.col("_m_host") == F.col("_m_h")) & (F.col("_m_hash") == F.col("_m_x")), "left")
    removed = F.coalesce(F.col("_m_cut"), F.lit(0).cast("long"))
    left = F.col("n_words") - removed
    depleted = (left < min_words) | (left < min_kept_share * F.col("n_words"))
    columns = [
        F.col("_m_own").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(F.col("_m_cut_lines"), F.lit(0).cast("long")).alias("n_removed_lines"), removed.alias("n_removed_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    ]
    if with_text:
        gone = F.coalesce(F.col("_m_gone"), F.array().cast("array<bigint>"))
        columns.append(F.array_join(F.filter(F.split("_m_text", "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normal_line(x)))), "\n").alias("cleaned_text"))
    return out.select(*columns)
