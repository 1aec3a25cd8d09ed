"""Evaluation passages inside documents: Wu-Manber search for every run of 15 words of every item.

Texts are reduced to their stream of letters and digits, so case, punctuation, spacing, line breaks inside words, invisible
characters, markup and equivalent character forms make no difference. The patterns are all runs of ``words`` words of an
item. A block table tells how far the search may jump: most blocks of a document end no pattern, and the search moves on by
nearly a whole pattern. Where the shift is zero, the patterns in the bucket of that suffix block are compared directly, and
a hit must start and end at word boundaries of the document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize

WORDS = 15
#: Characters of a block, at most.
BLOCK = 12
#: Patterns shorter than this get tables of their own, so that they don't shorten the jumps of the rest.
SHORT = 40
#: Characters of item text searched for at once; more items are searched in several passes over the normalised documents.
#: Their tables take about 110 bytes a character in every Python worker, and 23 as they are broadcast.
ITEM_CHARS = 1_000_000


def word_runs(text: str) -> list[str]:
    """The runs of letters and digits of a text, in one form: no markup, compatible forms composed, case folded."""
    import html
    import re
    import unicodedata

    if "<" in text:
        text = re.sub(
            r"""<!--.*?-->|</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s<>"']+))*\s*/?>""",
            " ",
            text,
            flags=re.S
        )
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        if not text.isascii():
            # invisible characters and marks that compose with nothing stand inside words
            text = re.sub(
                "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]",
                "",
                text
            )
    return re.findall(r"[^\W_]+", text)


def pattern_tables(items: list[tuple[int, str]], words: int = WORDS) -> list[tuple[int, int, dict, dict]]:
    """Search tables (m, block, shift, buckets) of the items' runs of ``words`` words.

    ``buckets``: suffix block to [(pattern, [(item, word)])]. Items with fewer words have no pattern.
    """
    where: dict[str, list] = defaultdict(list)
    for item, text in items:
        runs = word_runs(text)
        for i in range(len(runs) - words + 1):
            where["".join(runs[i : i + words])].append((item, i))
    tables = []
    for part in (
        {p: w for p, w in where.items() if len(p) < SHORT}, {p: w for p, w in where.items() if len(p) >= SHORT}
    ):
        if not part:
            continue
        m = min(map(len, part))
        block = min(BLOCK, m)
        shift: dict[str, int] = {}
        buckets: dict[str, list] = defaultdict(list)
        for p, w in part.items():
            for end in range(block, m + 1):
                b = p[end - block : end]
                if m - end < shift.get(b, m):
                    shift[b] = m - end
            buckets[p[m - block : m]].append((p, w))
        tables.append((m, block, shift, dict(buckets)))
    return tables


def find_patterns(runs: list[str], tables: list) -> dict[int, set[int]]:
    """item -> first words of its patterns that stand in a document, given as its word runs."""
    stream = "".join(runs)
    found: dict[int, set[int]] = {}
    edges: set[int] = set()
    for m, block, shift, buckets in tables:
        far, end, n = m - block + 1, m, len(stream)
        get = shift.get
        while end <= n:
            step = get(stream[end - block : end], far)
            if step:
                end += step
                continue
            start = end - m
            for p, where in buckets[stream[end - block : end]]:
                if stream.startswith(p, start):
                    if not edges:
                        at = 0
                        edges.add(0)
                        for r in runs:
                            at += len(r)
                            edges.add(at)
                    if start in edges and start + len(p) in edges:
                        for item, i in where:
                            found.setdefault(item, set()).add(i)
            end += 1
    return found


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with the word runs of each text, joined by blanks."""
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([" ".join(word_runs(t)) for t in b.column(1).to_pylist()], pa.string())],
            ["doc_id", "text"]
        )


def _search(tables, words: int, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables.value
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for item, firsts in find_patterns(word_runs(text) if raw else text.split(" "), own).items():
                    covered = len(set().union(*(range(i, i + words) for i in firsts)))
                    out.append((doc, item, covered))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())],
                ["doc_id", "item_id", "words"]
            )

    return run


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, words): each document with each item of which it holds ``words`` consecutive words or more.

    ``words`` counts the words of the item inside such runs. Null texts, null ids and items that are too short give no row;
    an id with several texts counts for each. The items, a fixed set, go to every task, ``item_chars`` characters at a time;
    if they take more than one time, the documents are normalised once before.
    """
    spark = documents.sparkSession
    asked = (
        items.filter("item_id is not null and text is not null")
        .select(F.col("item_id").cast("bigint"), "text")
        .distinct()
    )
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-size // item_chars) or 1
    docs = documents.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    )
    if passes > 1:
        docs = materialize(docs.mapInArrow(_normalised, "doc_id bigint, text string"), "normalised")
    out = None
    for i in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) if passes > 1 else asked
        tables = spark.sparkContext.broadcast(pattern_tables([(r[0], r[1]) for r in part.collect()], words))
        hits = docs.mapInArrow(_search(tables, words, passes == 1), "doc_id bigint, item_id bigint, words int")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def leak_report(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, split, kind, documents, most_words): per item how many documents leak it, and the most of its words in one; 0 if none."""
    hits = (
        materialize(leaked_items(documents, items, words), "leaks")
        .groupBy("item_id")
        .agg(F.count("*").alias("documents"), F.max("words").alias("most_words"))
    )
    named = items.select(F.col("item_id").cast("bigint").alias("item_id"), "split", "kind").distinct()
    return named.join(hits, "item_id", "left").select(
        "item_id",
        "split",
        "kind",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_words", F.lit(0)).alias("most_words")
    )
