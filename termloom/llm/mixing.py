"""Mixing sources to target shares of all tokens by fitting document rates to soft memberships.

1. A multinomial logistic regression, fitted on a bounded sample of labelled documents, gives each document its domain
   posteriors; token counts come from the same pass over the text. The source that a document names is further evidence: it
   is taken to be wrong with the chance ``LABEL_ERROR``, and the posterior is updated by that.
2. Rates (how often a document is used) are fitted by projected gradient: ``r_i <- clip(r_i + sum_k q_ik g_k, 0, cap_i)``,
   ``g_k = res_k / S_k``, with q the memberships, S_k the expected tokens of domain k and res_k what it lacks. That is the
   gradient of ``sum_k (T_k - sum_i r_i t_i q_ik)**2 / S_k`` in the metric of token counts, where a step of 1 is always
   stable. Steps in the metric of the documents that no bound holds are tried beside it, at several lengths in one pass, and
   the best is taken: where a source is short, documents with a slight share in it would creep otherwise. Documents of one
   label and one membership always have the same rate, so passes go over their groups, not over documents; the driver sees
   a few numbers per source. The fit ends when the plain step would move hardly a token any more.
3. Rates of documents follow from the steps, in one pass. Whole copies are the rates rounded along the documents of a source
   and a size, so that what one document gets too much the next one of its size gets too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions.text import clean_label
from termloom.llm.tokens import DEFAULT_TOKENIZER, encoder
from termloom.session import materialize, release

#: Labelled documents of each source on which the classifier is fitted, at most on average.
SAMPLE = 1000
#: Hashed token features of the classifier.
FEATURES = 512
#: The chance that the source a document names is wrong, and the least posterior it has.
LABEL_ERROR, LABEL_FLOOR = 1e-3, 1e-2
#: Memberships are whole multiples of 1 / UNIT, so that documents fall into groups.
UNIT = 1000
#: The fit has converged when a plain step moves less than this part of all tokens; beyond MAX_STEPS the report says it has not.
STILL, MAX_STEPS = 1e-4, 60
#: Documents of one window when rates are rounded, on average and at most about.
WINDOW = 1_000_000
#: Lengths at which a step in the other metric is tried, and the sources up to which it is.
LENGTHS, METRIC_SOURCES = (1.0, 0.5, 0.25, 0.1, 0.03), 200


def source_key(source: Column) -> Column:
    """A source's spelling without case, outer blanks and the kind of separator."""
    return F.regexp_replace(clean_label(source), r"[\s\p{Z}\-_]+", "_")


def _features(ids: list[int], size: int) -> np.ndarray:
    at = (np.asarray(ids, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(size)
    x = np.log1p(np.bincount(at.astype(np.int64), minlength=size)).astype(np.float32)
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def _sample_rows(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = [_features(enc.ids(t), size) for t in b.column(1).to_pylist()]
            at = np.arange(len(rows) + 1, dtype=np.int32) * size
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(at, pa.array(flat))], ["label", "x"]
            )

    return run


def fit_classifier(
    labelled: DataFrame, n_sources: int, sample: int = SAMPLE, size: int = FEATURES, tokenizer: str = DEFAULT_TOKENIZER
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts), one row per source, from ``labelled(doc_id, label, text)``; sources without documents get no weight.

    The sample takes of each source the documents whose id hashes below ``sample`` / its count.
    """
    weights, bias = np.zeros((n_sources, size), np.float32), np.full(n_sources, -1e9, np.float32)
    # one row per source; no text is read
    counts = {r[0]: r[1] for r in labelled.groupBy("label").agg(F.count("*")).collect()}
    seen = sorted(counts)
    if len(seen) < 2:
        bias[seen or slice(None)] = 0.0
        return weights, bias
    rate = F.lit(0.0)
    for k in seen:
        rate = F.when(F.col("label") == k, F.lit(min(1.0, sample / counts[k]))).otherwise(rate)
    code = F.lit(-1)
    for i, k in enumerate(seen):
        code = F.when(F.col("label") == k, F.lit(i)).otherwise(code)
    chosen = (
        labelled.filter("text is not null")
        .filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < rate * 1_000_000)
        .select(code.cast("double").alias("label"), "text")
    )
    rows = materialize(chosen.mapInArrow(_sample_rows(tokenizer, size), "label double, x array<float>"), "sample")
    data = rows.select("label", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    present = data.agg(F.count_distinct("label")).first()[0]
    if present < 2:
        bias[seen] = np.log([counts[k] for k in seen])
        return weights, bias
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, standardization=False).fit(data)
    release(rows)
    weights[seen[: model.numClasses]] = model.coefficientMatrix.toArray()
    # the sample is even over the sources, the documents aren't
    prior = np.log([counts[k] / min(sample, counts[k]) for k in seen[: model.numClasses]])
    bias[seen[: model.numClasses]] = model.interceptVector.toArray() + prior
    return weights, bias


def _memberships(label: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Posteriors updated by the stated labels (-1 for none), as whole multiples of 1 / UNIT that sum to UNIT."""
    n, k = post.shape
    q, known = post.astype(np.float64), np.flatnonzero(label >= 0)
    own = np.maximum(q[known, label[known]], LABEL_FLOOR) * (1 - LABEL_ERROR)
    q[known] *= LABEL_ERROR / max(k - 1, 1)
    q[known, label[known]] = own
    q /= np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    units = np.floor(q * UNIT).astype(np.int16)
    units[np.arange(n), q.argmax(axis=1)] += (UNIT - units.sum(axis=1)).astype(np.int16)
    return units


def _measured(path: str, weights: np.ndarray, bias: np.ndarray):
    """(doc_id, label, text) to (doc_id, label, tokens, q)."""
    k, size = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            tokens, posts = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, k), np.float32)
            for i, text in enumerate(b.column(2).to_pylist()):
                ids = enc.ids(text) if text else []
                tokens[i] = len(ids)
                if not k:
                    continue
                z = weights @ _features(ids, size) + bias
                e = np.exp(z - z.max())
                posts[i] = e / e.sum()
            q = _memberships(b.column(1).to_numpy(zero_copy_only=False), posts).ravel() if k else np.zeros(0, np.int16)
            units = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * k, pa.array(q))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(tokens), units], ["doc_id", "label", "tokens", "q"]
            )

    return run


def _column(b: pa.RecordBatch, name: str):
    return b.column(b.schema.get_field_index(name))


#: A step: the gradient g, which tells the documents that a bound holds, and what the others move by, both by source.
Step = tuple[np.ndarray, np.ndarray]


def _bound(r: np.ndarray, cap: np.ndarray, push: np.ndarray) -> np.ndarray:
    return ((r >= cap) & (push > 0)) | ((r <= 0) & (push < 0))


def _moved(r: np.ndarray, cap: np.ndarray, q: np.ndarray, step: Step) -> np.ndarray:
    return np.where(_bound(r, cap, q @ step[0]), r, np.clip(r + q @ step[1], 0.0, cap))


def _rates(b: pa.RecordBatch, steps: list[Step], caps: np.ndarray) -> tuple[np.ndarray, ...]:
    """(label, memberships, caps, rates) of a batch of documents or groups; rates follow from the steps alone."""
    label = _column(b, "label").to_numpy(zero_copy_only=False)
    q = (
        _column(b, "q")
        .flatten()
        .to_numpy(zero_copy_only=False)
        .reshape(b.num_rows, len(caps))
        .astype(np.float64) / UNIT
    )
    if not len(caps):
        return label, q, np.zeros(len(label)), np.zeros(len(label))
    cap = caps[np.where(label >= 0, label, q.argmax(axis=1))]
    r = np.minimum(1.0, cap)
    for step in steps:
        r = _moved(r, cap, q, step)
    return label, q, cap, r


#: Sums by source: all tokens and used ones by membership; of the documents that name it all tokens, used ones, and what their caps allow; used tokens of documents without a source, by membership.
SUMS = ("mass", "expected", "own", "own_used", "own_most", "other_used")


def _totals(label, q, cap, r, t):
    known = label >= 0
    by_label = lambda x: np.bincount(label[known], weights=x[known], minlength=q.shape[1])
    return np.array([t @ q, (r * t) @ q, by_label(t), by_label(r * t), by_label(cap * t), (r * t * ~known) @ q])


def _free(label, q, cap, r, t, g):
    """The Gram matrix of the documents that no bound holds."""
    free = ~_bound(r, cap, q @ g)
    return q[free].T @ (q[free] * t[free][:, None])


def _tried(label, q, cap, r, t, steps: list[Step]):
    """For each step the used tokens by membership after it, and the tokens it moves."""
    after = [_moved(r, cap, q, s) for s in steps]
    return np.array([np.append((x * t) @ q, (np.abs(x - r) * t).sum()) for x in after])


class Mix:
    """A fitted mix: ``fitted()`` and ``report()`` by source, and ``documents()`` with rates and whole copies."""

    def __init__(self, measured: DataFrame, names: list[str], shares: np.ndarray, caps: np.ndarray):
        self.measured, self.names, self.caps, self.shares = measured, names, caps, shares
        groups = measured.filter("tokens > 0").groupBy("label", "q").agg(
            F.sum("tokens").alias("tokens"), F.count("*").alias("n")
        )
        self.groups = materialize(groups, "groups")
        self.steps: list[Step] = []
        k = len(names)
        self.sums = dict(zip(SUMS, self._sum(_totals, (len(SUMS), k))))
        self.total, self.count = (x or 0 for x in self.groups.agg(F.sum("tokens").cast("double"), F.sum("n")).first())
        self.target = shares * self.total
        self.converged = not k or not self.total
        if self.converged:
            return
        mass = np.maximum(self.sums["mass"], 1e-9)
        used = self.sums["expected"]
        while not self.converged and len(self.steps) < MAX_STEPS:
            lacks = np.where(self.sums["mass"] > 0, self.target - used, 0.0)
            g = lacks / mass
            steps = [(g, g)]
            if k <= METRIC_SOURCES:
                gram = self._sum(_free, (k, k), g)
                # the move that would leave the least, were there no bounds
                x = np.linalg.lstsq(gram / np.sqrt(mass)[:, None], lacks / np.sqrt(mass), rcond=1e-9)[0]
                steps += [(g, a * x) for a in LENGTHS]
            tried = self._sum(_tried, (len(steps), k + 1), steps)
            loss = (np.where(self.sums["mass"] > 0, self.target - tried[:, :k], 0.0) ** 2 / mass).sum(axis=1)
            self.converged = bool(tried[0, k] <= STILL * self.total)
            best = 0 if self.converged else int(loss.argmin())
            self.steps.append(steps[best])
            used = tried[best, :k]
        self.sums = dict(zip(SUMS, self._sum(_totals, (len(SUMS), k))))

    def _sum(self, measure, shape: tuple[int, int], *more) -> np.ndarray:
        """The sum over all groups of what ``measure`` gives for a batch of them: a few numbers a source."""
        steps, caps = self.steps, self.caps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                if b.num_rows and len(caps):
                    t = _column(b, "tokens").to_numpy(zero_copy_only=False).astype(np.float64)
                    total += measure(*_rates(b, steps, caps), t, *more)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"]
            )

        out = np.zeros(shape[0] * shape[1])
        for at, x in self.groups.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
            out[at] = x
        return out.reshape(shape)

    def fitted(self) -> DataFrame:
        """(source, target_share, expected_share, tokens, mix_tokens, most_tokens, below_target, converged) for each target.

        Shares are of a mix as large as all documents. ``expected_share`` is by the memberships at the fitted rates;
        ``mix_tokens`` are those of the documents that name the source at these rates, with the part by membership of documents
        that name none. A source is below its target if the fit leaves the documents that name it short of it, and these
        documents hold less than it even if each is used to its cap, which no further step could change.
        """
        s, size = self.sums, max(self.total, 1.0)
        below = (s["own_used"] < self.target) & (s["own_most"] < self.target)
        cols = (self.shares, s["expected"] / size, s["own"], s["own_used"] + s["other_used"], s["own_most"])
        rows = [(n, *(float(x[k]) for x in cols), bool(below[k]), self.converged) for k, n in enumerate(self.names)]
        kinds = (
            "source string, target_share double, expected_share double, tokens double, mix_tokens double, most_tokens double, below_target boolean, converged boolean"
        )
        return self.measured.sparkSession.createDataFrame(rows, kinds)

    def report(self) -> DataFrame:
        """``fitted()`` with copied_tokens and actual_share: of the whole copies of ``documents()`` that name the source."""
        used = self.documents().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("copied_tokens"))
        joined = self.fitted().join(F.broadcast(used), "source", "left")  # one row per source
        copied = F.coalesce("copied_tokens", F.lit(0))
        return joined.withColumns({"copied_tokens": copied, "actual_share": copied / max(self.total, 1.0)})

    def documents(self) -> DataFrame:
        """(doc_id, source, tokens, rate, copies): copies is the rate rounded up or down, such that sums of a source and size hold."""
        steps, caps = self.steps, self.caps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cols = [_column(b, c) for c in ("doc_id", "label", "tokens")]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(_rates(b, steps, caps)[-1])], ["doc_id", "label", "tokens", "rate"]
                    )

        rated = self.measured.mapInArrow(run, "doc_id bigint, label int, tokens bigint, rate double")
        parts = F.lit(max(1, self.count // WINDOW))
        near = W.partitionBy(
            "label", F.floor(F.log2(F.col("tokens") + 1)), F.pmod(F.xxhash64("doc_id"), parts)
        ).orderBy("tokens", "doc_id")
        over = F.col("rate") - F.floor("rate")
        so_far = F.sum(over).over(near) + 0.5
        names = F.array(*map(F.lit, self.names)).cast("array<string>")
        copies = (F.floor("rate") + F.floor(so_far) - F.floor(so_far - over)).cast("int")
        return rated.select(
            "doc_id",
            F.when(F.col("label") >= 0, F.get(names, F.col("label"))).alias("source"),
            "tokens",
            "rate",
            copies.alias("copies")
        )


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    tokenizer: str = DEFAULT_TOKENIZER,
    sample: int = SAMPLE,
    size: int = FEATURES
) -> Mix:
    """Fit the mix of ``documents(doc_id, text, source)`` to ``targets(source, target_share, max_repeats)``.

    Targets whose names agree after ``source_key`` are one (largest share, largest cap); a null share or cap counts as 0.
    Documents of a source without target, or of none, take part by their posteriors. Null and empty texts have no tokens.
    Without targets the report is empty and no document is used.
    """
    # one row per source: small by its meaning, and checked
    rows = (
        targets.filter("source is not null")
        .groupBy(source_key(F.col("source")).alias("key"))
        .agg(F.min("source"), F.max("target_share"), F.max("max_repeats"))
        .orderBy("key")
        .limit(10_001)
        .collect()
    )
    if len(rows) > 10_000:
        raise ValueError("more than 10000 sources")
    names, shares, caps = (
        [r[1] for r in rows], np.array([r[2] or 0.0 for r in rows], float), np.array([r[3] or 0 for r in rows], float)
    )
    label = (
        F.coalesce(
            F.array_position(F.array(*(F.lit(r[0]) for r in rows)).cast("array<string>"), source_key(F.col("source"))),
            F.lit(0)
        ).cast("int")
        - 1
    )
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.alias("label"), "text")
    weights, bias = fit_classifier(docs.filter("label >= 0"), len(rows), sample, size, tokenizer)
    measured = docs.mapInArrow(
        _measured(tokenizer, weights, bias), "doc_id bigint, label int, tokens bigint, q array<smallint>"
    )
    return Mix(materialize(measured, "measured"), names, shares, caps)
