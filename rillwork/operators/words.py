"""Words of chat in scripts without spaces: runs of characters are cut by a dictionary.

A run that holds Chinese or Japanese characters becomes a lattice of the
dictionary's words and of single characters; the path of the highest likelihood
is its cut, the longer word first on ties.  Characters that no word holds stay
single, and single characters don't count as words.  Nothing is learnt beyond
the dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import STOP_WORDS

#: Kana, ideographs with extension A, and compatibility ideographs; Korean has spaces.
CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"


class Lattice:
    """The best cut of a run, given words and how often each occurs."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(sum(counts.values()) or 1)
        self.known = {w: math.log(max(n, 1)) - total for w, n in counts.items()}
        self.unknown = -total
        self.longest = max(map(len, counts), default=1)

    def cut(self, run: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            ways = [(self.known.get(run[i], self.unknown) + best[i + 1][0], i + 1)]
            for j in range(i + 2, min(i + self.longest, len(run)) + 1):
                p = self.known.get(run[i:j])
                if p is not None:
                    ways.append((p + best[j][0], j))
            best[i] = max(ways)
        out, i = [], 0
        while i < len(run):
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out


def segmented_words(texts: DataFrame, dictionary: DataFrame, *by: str, extra_stop_words: tuple[str, ...] = (), most: int = 2_000_000) -> DataFrame:
    """(by, word, n): how often each word of two characters or more occurs in ``text``, in lower case, stop words left out.

    ``dictionary`` has (word, n), null counts as 1; it goes to all tasks, so it may have ``most`` words.  Runs of
    letters and digits are counted first, so each distinct run is cut once.  Null texts have no words.
    """
    words = dictionary.filter("word <> ''").groupBy("word").agg(F.sum(F.coalesce(F.col("n"), F.lit(1))).alias("n"))
    entries = words.limit(most + 1).toArrow()
    if entries.num_rows > most:
        raise ValueError(f"the dictionary has more than {most} words")
    counts = texts.sparkSession.sparkContext.broadcast(dict(zip(entries["word"].to_pylist(), entries["n"].to_pylist(), strict=True)))
    run = F.explode(F.split(F.coalesce("text", F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+"))
    # the number of the group of ``by`` goes along as one column
    group = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by)], F.lit(0).alias("z")))
    runs = texts.select(group.alias("group"), run.alias("run")).filter(F.length("run") >= 2).groupBy("group", "run").agg(F.count("*").alias("n"))
    mixed = F.col("run").rlike(CJK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(counts.value)
        for batch in batches:
            rows = [(g, w, n) for g, r, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in lattice.cut(r) if len(w) >= 2]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["group", "word", "n"])

    found = runs.filter(~mixed).toDF("group", "word", "n").unionByName(runs.filter(mixed).mapInArrow(cut, "group string, word string, n long"))
    low = found.withColumn("word", F.lower("word")).filter(~F.col("word").isin(*STOP_WORDS, *extra_stop_words))
    counted = low.groupBy("group", "word").agg(F.sum("n").alias("n"))
    kinds = ", ".join(f"c{i} {dict(texts.dtypes)[c]}" for i, c in enumerate(by))
    named = counted.withColumn("group", F.from_json("group", f"{kinds + ', ' if kinds else ''}z int"))
    return named.select(*[F.col(f"group.c{i}").alias(c) for i, c in enumerate(by)], "word", "n")
