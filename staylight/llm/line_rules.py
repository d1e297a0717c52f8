"""Line-first cleaning with DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate); lines that fail
are removed, and a document that loses too much of its text goes as a whole. Nothing
is shuffled: every figure of a document comes from its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylight.llm.texts import documents, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: What a line of running text ends in, and phrases of page furniture.
LINE_ENDS = r"""[.!?:;\x22'\x29…”»。！？][\x20\x09-\x0D]*\z"""
BOILERPLATE = (
    r"(?i)(cookie policy|use cookies|privacy policy|terms of (use|service)|all rights reserved"
    r"|enable javascript|click here|read more|sign in|log in|subscribe (now|to our)|share (this|on)"
    r"|lorem ipsum|back to top)"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules.

    symbol_share   most symbols per character of a line
    shout_share    most doubled exclamation or question marks per word
    separators     so many bars, arrows or bullets make a line navigation
    keep_share     the part of a document's characters that must survive
    """

    symbol_share: float = 0.1
    shout_share: float = 0.2
    separators: int = 3
    keep_share: float = 0.5


def _line_passes(line: Column, rules: LineRules) -> Column:
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = F.regexp_count(line, F.lit("[#*$%&|<>{}~^]"))
    shouts = F.regexp_count(line, F.lit("[!?]{2,}"))
    separators = F.regexp_count(line, F.lit("[|»›•·]"))
    return (
        line.rlike(LINE_ENDS)
        & (symbols <= F.length(line) * rules.symbol_share)
        & (shouts <= n_words * rules.shout_share)
        & (separators < rules.separators)
        & ~line.rlike(BOILERPLATE)
    )


def _repeated_words() -> Column:
    """Words covered by windows that occur at least twice, from the window hashes."""
    ordered = F.col("_ordered")
    twice = F.filter(
        ordered,
        lambda s, i: (F.get(ordered, i - 1)["h"].eqNullSafe(s["h"]))
        | (F.get(ordered, i + 1)["h"].eqNullSafe(s["h"])),
    )
    starts = F.sort_array(F.transform(twice, lambda s: s["at"]))
    none = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total"))
    return F.aggregate(
        starts,
        none,
        lambda acc, at: F.struct(
            (at + WINDOW).alias("upto"),
            (acc["total"] + F.least(F.lit(WINDOW), at + WINDOW - acc["upto"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the figures of its text, the lines
    removed, the cleaned text and the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, n_removed_lines, kept_chars, clean_text. Missing and empty
    texts have zero words, so they fail. Lines without a word are neither judged nor
    counted; they vanish from the cleaned text. Repeated rows give equal rows; an empty
    table gives an empty one. ``base_failed``: fewer than 10 words, or more than a fifth of
    the words lie in repeated five-word windows. ``kept``: not failed, and the lines that
    pass hold at least ``rules.keep_share`` of the characters of all lines with words.
    """
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    read = documents(docs).select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("_words"),
        F.filter(F.split("text", "\n"), has_word).alias("_lines"),
    )
    hashed = read.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        "_lines",
        F.filter("_lines", lambda line: _line_passes(line, rules)).alias("_good"),
    )
    at = lambda i, k: F.get(F.col("_hashes"), i + k)
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
            lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "_lines", "_good"]
    counted = hashed.select(*kept, windows.alias("_windows"))
    # Only texts in which some window comes twice are sorted at all.
    ordered = counted.select(
        *kept,
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ).alias("_ordered"),
    )
    repeated = ordered.select(
        *kept,
        F.when(F.col("_ordered").isNull(), F.lit(0)).otherwise(_repeated_words()).cast("long").alias("n_repeat_words"),
    )
    chars = lambda lines: F.length(F.array_join(lines, ""))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    survives = F.col("kept_chars") >= F.col("_all_chars") * rules.keep_share
    return (
        repeated.withColumns(
            {
                "base_failed": failed,
                "kept_chars": chars("_good").cast("long"),
                "_all_chars": chars("_lines").cast("long"),
            }
        )
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & survives).alias("kept"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_good")).cast("long").alias("n_removed_lines"),
            "kept_chars",
            F.array_join("_good", "\n").alias("clean_text"),
        )
    )
