"""Retrieval of related sequences by shared 3-grams, its quality measures, exact vector search, and a trained pair scorer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions.arrays import affine_match, jaccard, ngrams, pair_features, subsequence_match
from termloom.functions.terms import clean_terms
from termloom.operators.battery import transformed, varied_starts
from termloom.session import join_hot, materialize, spread


def sequences(corpus: DataFrame) -> DataFrame:
    """(id, seq): the clean terms of each sequence that has any."""
    return corpus.filter("a_number is not null").select(
        F.col("a_number").alias("id"), clean_terms(F.col("terms")).alias("seq")
    ).filter(F.size("seq") > 0)


def shared_gram_candidates(queries: DataFrame, seqs: DataFrame, n: int = 3) -> DataFrame:
    """(q, id, shared, jaccard): for each query sequence every other one that shares an n-gram, by the Jaccard of their n-gram sets.

    The queries are a stated set, so a gram of many sequences meets few queries; the rows of such a gram are cut into parts.
    Sides: ``(id, seq)``.
    """
    grams = (
        lambda d, k: d.select(F.col("id").alias(k), F.array_distinct(ngrams(F.col("seq"), n)).alias("g"))
        .select(k, F.size("g").alias("n" + k), F.explode("g").alias("g"))
        .withColumn("g", F.xxhash64("g"))
    )
    hits = join_hot(grams(queries, "q"), materialize(grams(seqs, "id"), "grams"), "g", "id").filter("q <> id")
    return hits.groupBy("q", "id", "nq", "nid").agg(F.count("*").alias("shared")).select(
        "q", "id", "shared", (F.col("shared") / (F.col("nq") + F.col("nid") - F.col("shared"))).alias("jaccard")
    )


def top_k(scored: DataFrame, k: int | None, score: str = "jaccard") -> DataFrame:
    """The k best candidates of each query with their rank, or all of them; ties go to the smaller id."""
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col(score).desc(), "id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _constant_starts(rows: DataFrame, terms: str, shift: int = 8, least: int = 8) -> DataFrame:
    """The columns of ``rows`` but ``terms``, with at, n and lead: the starts 0..``shift`` from which ``least`` terms or more are the same, the terms from there on, and how many of them are."""
    rest = [c for c in rows.columns if c != terms]
    starts = F.sequence(F.lit(0), F.least(F.size(terms) - least, F.lit(shift)))
    # where not even ``least`` terms are the same, the rest isn't read
    level = F.filter(starts, lambda at: F.size(F.array_distinct(F.slice(terms, at + 1, least))) == 1)
    own = rows.filter(F.size(terms) >= least).select(*rest, terms, F.explode(level).alias("at"))
    n = F.size(terms) - F.col("at")
    # only the slice is a copy, made once; a slice inside the lambda would be made for every term
    other = F.transform(F.slice(terms, F.col("at") + 1, n), lambda x: x != F.get(terms, F.col("at")))
    lead = F.coalesce(F.nullif(F.array_position(other, True), F.lit(0)) - 1, n).cast("int")
    return own.select(*rest, "at", n.alias("n"), lead.alias("lead"))


def _both_constant(asked: DataFrame, there: DataFrame, least: int) -> DataFrame:
    """Pairs of starts of one repeated number, ``asked(q, ..., at, n, lead)`` and ``there(id, at2, n2, lead2)``, that match.

    The shorter of both has nothing but its number, and the longer one repeats its own for as long. So one side's whole length
    is at most what the other repeats: they meet by the binary magnitude of that length, in parts of bounded size.
    """
    bits = lambda x: F.length(F.bin(x))
    up_to = lambda side, lead: F.transform(
        F.sequence(bits(F.lit(least)), bits(lead)), lambda k: F.concat(F.lit(side), k.cast("string"))
    )
    whole = lambda side, n, lead: F.filter(
        F.array(F.when(F.col(n) == F.col(lead), F.concat(F.lit(side), bits(n).cast("string")))), F.isnotnull
    )
    left = asked.withColumn("_k", F.explode(F.concat(whole("q", "n", "lead"), up_to("id", "lead"))))
    right = there.withColumn("_k", F.explode(F.concat(up_to("q", "lead2"), whole("id", "n2", "lead2"))))
    return join_hot(left, materialize(right, "constants"), "_k", "id").filter(
        "q <> id and (at = 0 or at2 = 0) and least(n, n2) <= least(lead, lead2)"
    )


def _in_gaps(gaps: DataFrame, seqs: DataFrame, least: int = 8) -> DataFrame:
    """(q, transform, id): sequences that stand in a complement given by its ranges, or from some place to its end with ``least`` terms.

    A number that a sequence leaves out between its first ``least`` terms is the first one above some range of the
    complement, or there is none, and they lie in one range.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right

        def stands(ranges: list[tuple[int, int]], b: list[int]) -> bool:
            k = bisect_right(ranges, b[0], key=lambda r: r[0]) - 1
            if k < 0 or b[0] > ranges[k][1]:
                return False
            x = b[0]
            for i, y in enumerate(b):
                if y != x:
                    return False
                x += 1
                if x > ranges[k][1]:
                    k += 1
                    if k == len(ranges):
                        return i + 1 >= least
                    x = ranges[k][0]
            return True

        for pdf in batches:
            rows = [
                (q, t, i)
                for q, t, i, g, b in pdf[["q", "transform", "id", "terms", "seq"]].itertuples(index=False)
                if stands([tuple(map(int, x.split(".."))) for x in g], [int(x) for x in b])
            ]
            yield pd.DataFrame(rows, columns=["q", "transform", "id"])

    @F.pandas_udf("string")
    def left_out(b: pd.Series) -> pd.Series:
        def one(b) -> str | None:
            a = [int(x) for x in b[:least]]
            if a[0] < 0 or any(x >= y for x, y in zip(a, a[1:])):
                return None
            return next((str(x + 1) for x, y in zip(a, a[1:]) if y > x + 1), "")

        return b.map(one)

    @F.pandas_udf("array<string>")
    def bounds(g: pd.Series) -> pd.Series:
        return g.map(lambda g: ["", *(str(int(x.split("..")[1]) + 1) for x in g)])

    rising = seqs.filter(F.size("seq") >= least).select(
        "id", left_out(F.slice("seq", 1, least)).alias("x")
    ).filter("x is not null")
    pairs = gaps.select(
        "q", "transform", F.explode(bounds("terms")).alias("x")
    ).join(rising, "x").filter("q <> id").drop("x")
    return pairs.join(gaps, ["q", "transform"]).join(seqs, "id").mapInPandas(
        run, "q bigint, transform string, id bigint"
    )


def matches(queries: DataFrame, seqs: DataFrame, asked: DataFrame, least: int = 8, shift: int = 8) -> DataFrame:
    """(q, transform, id): every sequence with a subsequence or an affine match to a query under a transform.

    ``asked(q, transform, terms)`` are the transforms of ``queries``. Candidates come from hash joins: the first ``least`` terms
    of one with all runs of the other, keys that agree under affine relations, and starts of one repeated number.
    """
    seqs = seqs.select(F.col("id").cast("bigint").alias("id"), "seq")
    gaps, listed = asked.filter("transform = 'complement_gaps'"), asked.filter("transform <> 'complement_gaps'")
    longest = seqs.agg(F.max(F.size("seq"))).first()[0] or 0
    # an affine overlap ends with the other sequence, so the first terms of a complement suffice
    heads = transformed(
        queries.join(gaps.select(F.col("q").alias("id")), "id", "left_semi"), longest + shift, complements=True
    ).select(F.col("id").alias("q"), F.lit("complement_gaps").alias("transform"), "terms")
    ends = materialize(listed.unionByName(heads), "ends")
    first = lambda d, c: d.filter(F.size(c) >= least).withColumn("h", F.xxhash64(F.slice(c, 1, least))).drop(c)
    runs = lambda d, c: d.filter(F.size(c) >= least).withColumn(
        "h",
        F.explode(
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.size(c) - least + 1), lambda i: F.xxhash64(F.slice(c, i, least)))
            )
        )
    ).drop(c)
    key = ["q", "transform", "id"]
    found = first(listed, "terms").join(runs(seqs, "seq"), "h").select(*key).unionByName(
        runs(listed, "terms").join(first(seqs, "seq"), "h").select(*key)
    )
    left, right = (
        varied_starts(d, c, shift, least).filter("affine") for d, c in ((ends, "terms"), (spread(seqs), "seq"))
    )
    found = found.unionByName(
        left.join(right.withColumnRenamed("at", "at2"), "h").filter("at = 0 or at2 = 0").select(*key)
    ).filter("q <> id").distinct()
    same = materialize(
        _both_constant(
            _constant_starts(ends, "terms", shift, least),
            _constant_starts(seqs, "seq", shift, least).withColumnsRenamed({"at": "at2", "n": "n2", "lead": "lead2"}),
            least
        ).select(*key).distinct(),
        "same"
    )
    # pairs of repeated numbers that match as such need no look at their terms
    found = materialize(found.join(same, key, "left_anti"), "found")
    return _held(found, ends, seqs, longest).unionByName(same).unionByName(_in_gaps(gaps, seqs, least)).distinct()


def _held(found: DataFrame, ends: DataFrame, seqs: DataFrame, longest: int) -> DataFrame:
    """Of the pairs ``found(q, transform, id)`` those that have an affine or a subsequence match.

    An affine overlap reaches at most 8 terms beyond the other's length, so the first terms of a long complement tell, and
    sequences and transforms that begin alike are compared once. Only what is left meets the whole lists.
    """
    key = ["q", "transform", "id"]
    a, b = F.col("terms"), F.col("seq")
    head = lambda c, n: F.slice(c, 1, n + 8)
    content = lambda c: F.md5(F.array_join(c, ",").cast("binary"))
    heads = ends.select("q", "transform", head(a, F.lit(longest)).alias("terms"))
    named = materialize(
        found.join(heads.select("q", "transform", content(a).alias("ta")), ["q", "transform"])
        .join(seqs.select("id", content(b).alias("tb")), "id")
        .select(*key, "ta", "tb"),
        "named"
    )
    kinds = named.groupBy("ta", "tb").agg(F.min(F.struct("q", "transform")).alias("t"), F.min("id").alias("id"))
    match = affine_match(head(a, F.size(b)), head(b, F.size(a)))["s"].isNotNull()
    affine = materialize(
        kinds.select("ta", "tb", "t.q", "t.transform", "id")
        .join(heads, ["q", "transform"])
        .join(seqs, "id")
        .filter(match)
        .select("ta", "tb"),
        "affine"
    )
    rest = named.join(affine, ["ta", "tb"], "left_anti").filter("transform <> 'complement_gaps'").select(*key)
    inside = rest.join(ends, ["q", "transform"]).join(seqs, "id").filter(subsequence_match(a, b))
    return named.join(affine, ["ta", "tb"], "left_semi").select(*key).unionByName(inside.select(*key))


def _gram_scores(
    asked: DataFrame, seqs: DataFrame, found: DataFrame, k: int, gramless: bool, block: int
) -> DataFrame:
    """(q, transform, id, j): the 3-gram Jaccard of all pairs that can be among the k best of a query, and of those in ``found``.

    A gram of more than ``block`` sequences is hot. Pairs that share any other gram are all counted. Those that share hot ones
    only have a Jaccard that follows from both sets of hot grams and both counts of grams, so they are ranked as classes of
    sequences, and of each query only the classes down to its 2 k-th sequence, with all that tie with it, are spelled out: of
    2 k, at least k are neither the query itself nor matched, unless k are matched and outrank them anyway. A pair may come
    twice, once with less than its Jaccard.
    """
    grams = lambda c: F.array_distinct(ngrams(F.col(c)))
    left = (
        asked.filter("size(terms) >= 3 and transform <> 'complement_gaps'")
        .select("q", "transform", grams("terms").alias("g"))
        .select("q", "transform", F.size("g").alias("nq"), F.explode("g").alias("g"))
        .withColumn("g", F.xxhash64("g"))
    )
    right = (
        seqs.select(F.col("id").cast("bigint").alias("id"), grams("seq").alias("g"))
        .select("id", F.size("g").alias("nid"), F.explode("g").alias("g"))
        .withColumn("g", F.xxhash64("g"))
    )
    left, right = materialize(left, "asked-grams"), materialize(right, "grams")
    hot = materialize(right.groupBy("g").agg(F.count("*").alias("c")).filter(F.col("c") > block).select("g"), "hot")
    side = F.broadcast(hot) if hot.count() <= 100_000 else hot
    rare = lambda d: d.join(side, "g", "left_anti")
    held = lambda d, *key: d.join(side, "g", "left_semi").groupBy(*key).agg(
        F.sort_array(F.collect_set("g")).alias("h")
    )
    ask = materialize(held(left, "q", "transform", "nq"), "hot-asked")
    have = materialize(held(right, "id", "nid").withColumnRenamed("h", "hid"), "hot-held")
    score = lambda s: (s / (F.col("nq") + F.col("nid") - s)).alias("j")
    common = F.coalesce(F.size(F.array_intersect("h", "hid")), F.lit(0))
    key = ["q", "transform", "id"]
    counted = (
        rare(left)
        .join(rare(right), "g")
        .filter("q <> id")
        .groupBy(*key, "nq", "nid")
        .agg(F.count("*").alias("s"))
        .join(ask.drop("nq"), ["q", "transform"], "left")
        .join(have.drop("nid"), "id", "left")
        .select(*key, score(F.col("s") + F.when(F.col("h").isNotNull() & F.col("hid").isNotNull(), common).otherwise(0)))
    )
    # without ``gramless`` a matched pair needs a gram in common under any transform
    pool = found if gramless else found.select("q", "id").distinct().join(ask.select("q", "transform"), "q")
    known = pool.join(ask, ["q", "transform"]).join(have, "id").filter(common > 0).select(*key, score(common))
    classes = have.groupBy("hid", "nid").agg(F.count("*").alias("n")).withColumn("g", F.explode("hid"))
    kinds = ask.select("h", "nq").distinct().withColumn("g", F.explode("h"))
    met = join_hot(kinds, materialize(classes, "classes"), "g", "nid").groupBy("h", "nq", "hid", "nid", "n").agg(
        F.count("*").alias("s")
    ).select("h", "nq", "hid", "nid", "n", score(F.col("s")))
    up_to = F.sum("n").over(W.partitionBy("h", "nq").orderBy(F.desc("j")))  # with all that tie
    tied = F.sum("n").over(W.partitionBy("h", "nq", "j"))
    kept = met.withColumns({"u": up_to, "t": tied}).filter(F.col("u") - F.col("t") < 2 * k).withColumn(
        "full", F.when(F.col("u") >= 2 * k, F.col("j"))
    )
    best = ask.join(kept, ["h", "nq"]).withColumn("full", F.max("full").over(W.partitionBy("q"))).filter(
        "full is null or j >= full"
    ).select("q", "transform", "j", F.xxhash64("hid", "nid").alias("c"))
    members = materialize(have.select("id", F.xxhash64("hid", "nid").alias("c")), "members")
    alike = join_hot(materialize(best, "best"), members, "c", "id").filter("q <> id").select(*key, "j")
    return counted.unionByName(known).unionByName(alike)


def classical_baseline(
    queries: DataFrame, seqs: DataFrame, k: int = 10, gramless: bool = False, block: int = 2000
) -> DataFrame:
    """(q, id, transform, matched, ngram_jaccard, set_jaccard, rank): the k best related sequences of each query ``(id, seq)``.

    Each query is searched under every transform, among all sequences that share an n-gram with it or have a subsequence or an
    affine match; with ``gramless`` also where the match is all they share. A pair has the transform that ranks best: by the
    match first, then by both Jaccards, then the last by name; ties of pairs go to the smaller id. Complements of more than
    10,000 terms take part in matches only. Grams of more than ``block`` sequences are hot; the result doesn't depend on it.
    """
    asked = materialize(transformed(queries).select(F.col("id").alias("q"), "transform", "terms"), "asked")
    found = materialize(matches(queries, seqs, asked), "matches")
    both = _gram_scores(asked, seqs, found, k, gramless, block).select("*", F.lit(False).alias("m")).unionByName(
        found.select("q", "transform", "id", F.lit(0.0).alias("j"), F.lit(True).alias("m"))
    )
    by = both.groupBy("q", "transform", "id").agg(F.max("m").alias("m"), F.max("j").alias("j"))
    pairs = by.groupBy("q", "id").agg(
        F.max(F.struct("m", "j")).alias("b"),
        F.max("j").alias("g"),
        F.collect_list(F.struct("m", "j", "transform")).alias("all")
    )
    pairs = pairs if gramless else pairs.filter("g > 0")
    # all that tie with the k-th stay until their sets are compared
    near = pairs.withColumn(
        "r", F.rank().over(W.partitionBy("q").orderBy(F.desc("b.m"), F.desc("b.j")))
    ).filter(F.col("r") <= k)
    near = near.select(
        "q",
        "id",
        "b",
        F.explode(
            F.filter("all", lambda x: (x["m"] == F.col("b.m")) & (x["j"] == F.col("b.j")))["transform"]
        ).alias("transform")
    )
    listed = asked.withColumn(
        "terms",
        F.when(F.col("transform") != "complement_gaps", F.col("terms")).otherwise(F.array().cast("array<string>"))
    )
    probed = near.join(listed, ["q", "transform"]).join(seqs, "id").select(
        "q", "id", "b", "transform", jaccard(F.col("terms"), F.col("seq")).alias("set_jaccard")
    )
    best = (
        probed.groupBy("q", "id", "b")
        .agg(F.max(F.struct("set_jaccard", "transform")).alias("t"))
        .select(
            "q",
            "id",
            "t.transform",
            F.col("b.m").alias("matched"),
            F.col("b.j").alias("ngram_jaccard"),
            "t.set_jaccard"
        )
    )
    order = W.partitionBy("q").orderBy(F.desc("matched"), F.desc("ngram_jaccard"), F.desc("set_jaccard"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hit_ranks(held: DataFrame, ranked: DataFrame) -> DataFrame:
    """``held(u, v, ...)`` with rank: the better of v among the candidates of u and u among those of v; null if in neither."""
    one = ranked.select(F.col("q").alias("u"), F.col("id").alias("v"), F.col("rank").alias("_a"))
    two = ranked.select(F.col("q").alias("v"), F.col("id").alias("u"), F.col("rank").alias("_b"))
    return (
        held.join(one, ["u", "v"], "left")
        .join(two, ["u", "v"], "left")
        .withColumn("rank", F.least("_a", "_b"))
        .drop("_a", "_b")
    )


def report_parts(ranks: DataFrame) -> DataFrame:
    """``ranks(u, v, stratum, lt8_any, rank)`` as (stratum, rank) with two more strata: (all), each pair once, and (short), pairs with lt8_any = 1."""
    parts = F.array("stratum", F.lit("(all)"), F.when(F.col("lt8_any") == 1, F.lit("(short)")))
    rows = ranks.select("u", "v", "rank", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("stratum"))
    return rows.distinct().select("stratum", "rank")


def retrieval_report(ranks: DataFrame, ks: tuple[int, ...] = (1, 10, 100), powered: int = 100) -> DataFrame:
    """(stratum, pairs, recall_k..., mrr, underpowered): shares of pairs found in the first k, and the mean reciprocal rank, absent pairs as 0."""
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}")
    return ranks.groupBy("stratum").agg(
        F.count("*").alias("pairs"),
        *map(hit, ks),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        (F.count("*") < powered).alias("underpowered")
    )


def bootstrap_ci(ranks: DataFrame, k: int = 10, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(stratum, low, high): 95 % interval of recall at k over resamples of the pairs.

    Hits are counted per stratum first; a resample of n pairs of which h are hits is a Poisson resample of both counts,
    so the work is (strata x resamples), whatever the number of pairs.
    """
    counts = ranks.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= k).alias("h"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import numpy as np

        for pdf in batches:
            for stratum, n, h in zip(pdf["stratum"], pdf["n"], pdf["h"]):
                rng = np.random.default_rng([seed, zlib.crc32(str(stratum).encode())])
                hits, misses = rng.poisson(h, resamples), rng.poisson(n - h, resamples)
                low, high = np.quantile(hits / np.maximum(hits + misses, 1), [0.025, 0.975])
                yield pd.DataFrame([(stratum, float(low), float(high))], columns=["stratum", "low", "high"])

    return counts.mapInPandas(draw, "stratum string, low double, high double")


def _best_of(k: int, ids, q, there, m):
    """Of the rows m with ids ``there``, the k most similar to each query, and every tie with the k-th, as a frame."""
    import numpy as np

    sim = q @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    sim[ids[:, None] == there[None, :]] = -2
    top = np.argpartition(-sim, min(k, sim.shape[1]) - 1, axis=1)[:, :k]
    edge = np.take_along_axis(sim, top, 1).min(axis=1, keepdims=True)
    a, b = np.nonzero((sim >= edge) & (sim > -2))
    return pd.DataFrame({"q": ids[a], "vec_id": there[b], "similarity": sim[a, b]})


def nearest_vectors(
    vectors: DataFrame, k: int = 10, every: int = 100, block: int = 20_000, rows: int = 50_000
) -> DataFrame:
    """(q, vec_id, similarity, rank): the k nearest by cosine of each vector whose id is divisible by ``every``, itself excluded, exactly.

    Queries are cut into blocks of about ``block`` and all vectors into blocks of about ``rows``; each block of queries meets
    each block of rows in one group of a grid, which keeps its own k best, and those are merged. Nothing passes the driver.
    Null and zero vectors, and those of another length than most, match nothing.
    """
    import numpy as np

    usable = vectors.filter("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    )
    usable = usable.filter(F.exists("e", lambda x: x != 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x)))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    # one row for each length: the most frequent one counts, the longer of two
    widths = usable.groupBy(F.size("e").alias("w")).agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("asked")
    ).orderBy(F.desc("n"), F.desc("w")).first()
    empty = vectors.sparkSession.createDataFrame([], "q bigint, vec_id bigint, similarity double, rank int")
    if widths is None or not widths["asked"]:
        return empty
    usable = usable.filter(F.size("e") == widths["w"])
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    q_blocks, r_blocks = -(-widths["asked"] // block), max(-(-widths["n"] // rows), min(cores, -(-widths["n"] // 1000)))
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    asked = usable.filter(is_query).select("vec_id", "e", of(q_blocks).alias("qb"), every_block(r_blocks).alias("rb"))
    held = usable.select("vec_id", "e", of(r_blocks).alias("rb"), every_block(q_blocks).alias("qb"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "vec_id": [], "similarity": []}).astype({"q": "int64", "vec_id": "int64"})
        q = np.stack(left["e"].to_numpy())
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        ids, there, m = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), np.stack(right["e"].to_numpy())
        step = max(1, 20_000_000 // len(q))  # similarities held at once
        parts = [_best_of(k, ids, q, there[i : i + step], m[i : i + step]) for i in range(0, len(m), step)]
        return pd.concat(parts)

    best = asked.groupBy("qb", "rb").cogroup(held.groupBy("qb", "rb")).applyInPandas(
        cell, "q bigint, vec_id bigint, similarity double"
    )
    order = W.partitionBy("q").orderBy(F.round("similarity", 9).desc(), "vec_id")
    return best.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scored_pairs(splits: DataFrame, corpus: DataFrame) -> DataFrame:
    """(u, v, split, label, and the four pair features) of the distinct labelled pairs whose two sequences have terms."""
    seqs = spread(sequences(corpus))
    pairs = (
        splits.filter("u is not null and v is not null and label is not null")
        .select("u", "v", "split", F.col("label").cast("int").alias("label"))
        .distinct()
    )
    for c in ("u", "v"):
        pairs = pairs.join(seqs.select(F.col("id").alias(c), F.col("seq").alias("s" + c)), c)
    return pairs.select(
        "u", "v", "split", "label", pair_features(F.col("su"), F.col("sv")).alias("f")
    ).select("u", "v", "split", "label", "f.*")


def boosted_trees_report(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """(split, pairs, auc): gradient-boosted trees on the pair features, fitted on the train split, judged on each split."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    features = ["term_set_jaccard", "ngram3_jaccard", "exact_subseq", "affine_match"]
    data = VectorAssembler(inputCols=features, outputCol="features").transform(pairs)
    train = data.filter("split = 'train'")
    if train.select("label").distinct().count() < 2:
        return pairs.groupBy("split").agg(F.count("*").alias("pairs")).withColumn("auc", F.lit(None).cast("double"))
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=seed).fit(train)
    scored = model.transform(data).select("split", "label", "rawPrediction")
    rows = []
    for split, n in sorted((r[0], r[1]) for r in scored.groupBy("split").agg(F.count("*")).collect()):
        auc = BinaryClassificationEvaluator().evaluate(scored.filter(F.col("split") == split))
        rows.append((split, n, float(auc)))
    return pairs.sparkSession.createDataFrame(rows, "split string, pairs bigint, auc double")
