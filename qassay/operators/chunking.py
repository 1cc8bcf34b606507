"""Documents to sections, character windows and word windows; every step stays within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.functions.text import WS_INLINE, bind, strip, words

# Zero-width split points before heading lines; line ends are \n only.
HEADING_SPLIT = f"(?md)(?=^#{{1,6}}{WS_INLINE})"
HEADING_START = f"^#{{1,6}}{WS_INLINE}"


def section_array(md: Column) -> Column:
    """Sections with a body as structs {title, body}; text before the first heading is titled INTRO."""
    text = F.regexp_replace(md, "\r\n?", "\n")
    pieces = F.split(text, HEADING_SPLIT)

    def to_section(piece: Column) -> Column:
        headed = piece.rlike(HEADING_START)
        first_line = F.substring_index(piece, "\n", 1)
        rest = F.substr(piece, F.length(first_line) + 1)
        return F.struct(
            F.when(headed, strip(first_line)).otherwise("INTRO").alias("title"),
            strip(F.when(headed, rest).otherwise(piece)).alias("body"),
        )

    return F.filter(F.transform(pieces, to_section), lambda s: s["body"] != "")


def md_sections(docs: DataFrame, md: str = "md") -> DataFrame:
    return docs.select("source", F.posexplode(section_array(F.col(md))).alias("section_index", "_s")).select(
        "source", "section_index", "_s.title", "_s.body"
    )


def _check_window(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need 0 <= overlap < window size")


def char_windows(text: Column, max_chars: int = 6000, overlap: int = 200) -> Column:
    """Windows of at most max_chars characters, each starting overlap before the end of the last one."""
    _check_window(max_chars, overlap)
    step = max_chars - overlap

    def windows(body: Column) -> Column:
        n = F.length(body)
        last = F.when(n <= max_chars, F.lit(0)).otherwise(F.ceil((n - max_chars) / step).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), last), lambda k: strip(F.substring(body, k * step + 1, F.lit(max_chars)))
        )

    return F.filter(bind(strip(text), windows), lambda w: w != "")


def char_chunks(docs: DataFrame, text: str = "text", max_chars: int = 6000, overlap: int = 200) -> DataFrame:
    return docs.select(
        "*", F.posexplode(char_windows(F.col(text), max_chars, overlap)).alias("piece_index", "piece")
    )


def chunk_markdown(docs: DataFrame, md: str = "md", max_chars: int = 6000, overlap: int = 200) -> DataFrame:
    """Numbered chunks of each file: sections, then windows; ids restart per file."""
    pieces = F.flatten(
        F.transform(
            section_array(F.col(md)),
            lambda s: F.transform(
                char_windows(s["body"], max_chars, overlap),
                lambda w: F.struct(s["title"].alias("title"), w.alias("text")),
            ),
        )
    )
    return docs.select("source", F.posexplode(pieces).alias("chunk_index", "_c")).select(
        F.concat_ws("::", "source", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "chunk_index",
        "_c.title",
        "_c.text",
        "source",
    )


def word_windows(text: Column, target: int = 350, overlap: int = 50, min_words: int = 80) -> Column:
    """Overlapping word windows; short texts stay whole, pieces under min_words are dropped."""
    step = max(1, target - overlap)
    none = F.array().cast("array<string>")

    def windows(w: Column) -> Column:
        n = F.size(w)
        reach_end = F.ceil((n - target) / step)
        keep_tail = F.floor((n - max(min_words, 1)) / step)
        last = F.greatest(F.lit(0), F.least(reach_end, keep_tail)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(w, k * step + 1, F.lit(target)))
        long_doc = F.transform(F.filter(pieces, lambda p: F.size(p) >= min_words), lambda p: F.array_join(p, " "))
        return F.when(n > target, long_doc).when(n >= min_words, F.array(strip(text))).otherwise(none)

    return bind(words(text), windows)


def word_chunks(
    docs: DataFrame, text: str = "context", target: int = 350, overlap: int = 50, min_words: int = 80
) -> DataFrame:
    pieces = word_windows(F.col(text), target, overlap, min_words)
    keep = [c for c in docs.columns if c != text]
    return (
        docs.select(*keep, pieces.alias("_p"))
        .select(*keep, F.size("_p").alias("n_chunks_in_doc"), F.posexplode("_p").alias("chunk_index", "context"))
        .withColumn("section_id", F.format_string("%s::c%02d", F.col("document_id"), F.col("chunk_index")))
    )


def word_chunks_summary(
    docs: DataFrame, text: str = "context", target: int = 350, overlap: int = 50, min_words: int = 80
) -> DataFrame:
    n = F.size(word_windows(F.col(text), target, overlap, min_words))
    return docs.select(n.alias("_n")).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum("_n").alias("n_chunks"),
        F.min("_n").alias("min_chunks"),
        F.max("_n").alias("max_chunks"),
        F.bround(F.avg("_n"), 4).alias("mean_chunks"),
    )


def equal_windows(text: Column, n_windows: int = 5, min_words: int = 40) -> Column:
    """n equal word windows as word arrays, the last with the remainder; empty for short texts."""

    def windows(w: Column) -> Column:
        width = F.greatest(F.floor(F.size(w) / n_windows), F.lit(1)).cast("int")
        cut = F.transform(
            F.sequence(F.lit(0), F.lit(n_windows - 1)),
            lambda i: F.slice(w, i * width + 1, F.when(i == n_windows - 1, F.size(w)).otherwise(width)),
        )
        return F.when(F.size(w) >= min_words, cut).otherwise(F.array().cast("array<array<string>>"))

    return bind(words(text), windows)


def doc_windows(docs: DataFrame, text: str = "context", n_windows: int = 5, min_words: int = 40) -> DataFrame:
    return docs.select(
        "document_id",
        F.posexplode(equal_windows(F.col(text), n_windows, min_words)).alias("window", "window_words"),
    )
