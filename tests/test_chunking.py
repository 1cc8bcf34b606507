import random

import pytest
from pyspark.sql import functions as F

from qassay.operators import chunking


def char_windows(body, size, overlap):
    out, start = [], 0
    body = body.strip()
    while body:
        end = min(start + size, len(body))
        out.append(body[start:end].strip())
        if end == len(body):
            break
        start = end - overlap
    return [w for w in out if w]


def word_windows(body, target, overlap, least):
    w = body.split()
    if len(w) <= target:
        return [body.strip()] if len(w) >= least else []
    out, start, step = [], 0, max(1, target - overlap)
    while start < len(w):
        part = w[start : start + target]
        if len(part) >= least:
            out.append(" ".join(part))
        if start + target >= len(w):
            break
        start += step
        if start < len(w) and len(w) - start < least:
            break
    return out


def test_sections(column):
    md = "intro\r\n# One\nbody\n\n##  \n#no heading\n### Two  \n   \n###### Deep\rlast"
    got = column([md, "plain", "# only title", "", "#\tTab\nx"], chunking.section_array(F.col("x")))
    assert [[tuple(s) for s in row] for row in got] == [
        [("INTRO", "intro"), ("# One", "body"), ("##", "#no heading"), ("###### Deep", "last")],
        [("INTRO", "plain")], [], [], [("#\tTab", "x")],
    ]


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (7, 6), (50, 5)])
def test_char_windows(column, size, overlap):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé \n") for _ in range(n)) for n in (0, 1, 9, 10, 11, 17, 40, 101)]
    got = column(texts, chunking.char_windows(F.col("x"), size, overlap))
    assert got == [char_windows(t, size, overlap) for t in texts]


def test_window_overlap_is_checked():
    with pytest.raises(ValueError):
        chunking.char_windows(F.lit("x"), 10, 10)


@pytest.mark.parametrize("target,overlap,least", [(10, 3, 4), (5, 0, 5), (8, 9, 2), (6, 2, 8), (350, 50, 80)])
def test_word_windows(column, target, overlap, least):
    texts = [" ".join(f"w{i}" for i in range(n)) + " " for n in (0, 3, 4, 5, 6, 9, 10, 11, 14, 17, 23, 60, 700)]
    got = column(texts, chunking.word_windows(F.col("x"), target, overlap, least))
    assert got == [word_windows(t, target, overlap, least) for t in texts]


def test_equal_windows_cover_the_document(column):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (39, 40, 41, 44, 100)]
    got = column(texts, chunking.equal_windows(F.col("x")))
    assert got[0] == []
    for text, windows in zip(texts[1:], got[1:]):
        assert len(windows) == 5
        assert [w for part in windows for w in part] == text.split()


def test_chunk_ids_restart_per_file(spark):
    df = spark.createDataFrame([("a", "# x\n" + "y" * 25 + "\n# z\nq"), ("b", "t")], "source string, md string")
    rows = chunking.chunk_markdown(df, max_chars=10, overlap=2).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["a::0", "a::1", "a::2", "a::3", "b::0"]
    assert rows[3].title == "# z"
