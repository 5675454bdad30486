"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Each word carries the log-odds of toxic against other labelled documents, with a Dirichlet prior that
follows the counts of the whole corpus; a word too rare for its own is scored by the longest of its
beginnings that is not. Log-odds that are not significant count as background, a small negative score. A
linear scan over the scores of a text finds all its maximal segments: the passages that no extension and
no cut would improve. Scores of such passages in harmless text follow an extreme-value law; its rate is
solved from the harmless tokens and its scale from the harmless documents, which turns a score into an
expected number of chance passages as good. Passages below `EXPECTED` are toxic ones; their sum is the
document's evidence, and a logistic curve fitted on labelled documents makes it a probability.

How significant log-odds must be is chosen among `SETTINGS` without the rows that are held out: models of three
quarters of the learnable rows judge the last quarter, and the setting with the fewest errors there, each kind
weighing the same, is taken for the model of all of them (equal errors: the smallest logistic loss, then the
first). Labels are learnt from at most `MAX_LABELLED` labelled rows (chosen by a hash of the id), never from those
held out (crc32 of the id as text divisible by 5). The counts behind the prior are over all documents.
Null and empty texts have no words and no evidence. Rows with equal ids are scored each; labels of an id
count for all of its rows. Only ids and texts are read, and labels for learning, so clashing names do no harm.
Without labelled rows of both kinds every score is that of no evidence; an empty table gives no rows. A very
long text is scored whole, in linear time. Of equally good passages the first and shortest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import map_arrow, stored
from evenkeel.llm._text import LETTER_OR_DIGIT, Words, beginning_hashes, chunks, mix, to_batch, words

#: Labelled rows that a model is fitted on, about.
MAX_LABELLED = 200_000
#: Labelled toxic documents that a feature needs.
MIN_COUNT = 5
#: The smallest z-score and log-odds of a feature. Smaller log-odds come from languages and topics that are unevenly
#: labelled. The first is taken where too few rows are labelled to choose.
SETTINGS = ((2.0, 3.0), (2.0, 2.0), (2.0, 2.5), (2.0, 3.5), (4.0, 2.5), (4.0, 3.0))
#: The prior caps log-odds, the more so the more documents are toxic. So this share of what a feature would
#: have without harmless documents is enough, where that is less than the setting's.
REACH = 0.8
#: Score of a token without significant log-odds.
BACKGROUND = -0.1
#: Chance passages in a text of this length, at most, for a passage to count as toxic.
EXPECTED = 0.05
#: Kinds of rows: without a label, harmless and toxic ones to learn from, and those that judge settings.
UNKNOWN, HARMLESS, TOXIC, HARMLESS_JUDGE, TOXIC_JUDGE = range(5)
_KINDS = 5
#: Bytes of the beginnings that stand in for rare words; 0 is the whole word.
_BEGINNINGS = (4, 5, 6, 0)


def held_out(doc_id: str = "doc_id") -> Column:
    """A null id has no checksum and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def features(w: Words) -> list[np.ndarray]:
    """Hashes of each word's beginnings and of the word, shortest first."""
    return [mix(h ^ np.uint64(n + 1)) for n, h in zip(_BEGINNINGS, beginning_hashes(w, _BEGINNINGS))]


def _find(known: np.ndarray, hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `hashes` that are among the sorted `known`, and where. `table` sorts most out."""
    maybe = np.flatnonzero(table[hashes >> np.uint64(44)])
    if not len(maybe):
        return maybe, maybe
    place = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
    hit = known[place] == hashes[maybe]
    return maybe[hit], place[hit]


def _table(known: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, dtype=bool)
    table[known >> np.uint64(44)] = True
    return table


def _text_words(chunk: pa.RecordBatch) -> Words:
    return words(chunk.column("text"), LETTER_OR_DIGIT, lower=True)


# Learning ------------------------------------------------------------------------------------------


def feature_counts(docs: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """(feature, n0 to n4): documents of each `kind` that have a feature, for all features or the `known` ones.

    A document counts once for a feature, so that no text gains weight by repeating itself. A row with
    feature null has the number of documents with words.
    """
    names = [f"n{k}" for k in range(_KINDS)]
    schema = pa.schema([(c, pa.int64()) for c in ["feature", *names]])
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else shared.value
        table = None if wanted is None else _table(wanted)
        totals = None if wanted is None else np.zeros((len(wanted), _KINDS), dtype=np.int64)
        n_docs = np.zeros(_KINDS, dtype=np.int64)
        for chunk in chunks(batches):
            w = _text_words(chunk)
            kind = chunk.column("kind").to_numpy()
            n_docs += np.bincount(kind[np.diff(w.first) > 0], minlength=_KINDS)
            doc = np.repeat(np.arange(chunk.num_rows), np.diff(w.first))
            if wanted is None:
                hashes = features(w)
                all_hashes, all_docs = np.concatenate(hashes), np.tile(doc, len(hashes))
                order = np.lexsort((all_docs, all_hashes))
                all_hashes, all_docs = all_hashes[order], all_docs[order]
                new = np.diff(all_hashes, prepend=~all_hashes[:1]) != 0
                once = new | (np.diff(all_docs, prepend=-1) != 0)
                number = np.cumsum(new)[once] - 1
                counts = np.bincount(number * _KINDS + kind[all_docs[once]], minlength=int(new.sum()) * _KINDS)
                yield to_batch(schema, [all_hashes[new].view(np.int64), *counts.reshape(-1, _KINDS).T])
            elif len(wanted):
                for hashes in features(w):
                    at, place = _find(wanted, hashes, table)
                    pairs = np.unique(doc[at] * len(wanted) + place)
                    cells = pairs % len(wanted) * _KINDS + kind[pairs // len(wanted)]
                    totals += np.bincount(cells, minlength=totals.size).reshape(-1, _KINDS)
        yield to_batch(schema, [[None], *([n] for n in n_docs)])
        if wanted is not None:
            met = totals.sum(axis=1) > 0
            yield to_batch(schema, [wanted[met].view(np.int64), *totals[met].T])

    counted = map_arrow(docs.select("text", "kind"), work, ", ".join(f"{c} long" for c in schema.names))
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])


@dataclass
class Model:
    """What scoring needs. Its size is bounded by the labelled sample."""

    known: np.ndarray
    weights: np.ndarray
    rate: float = 1.0
    scale: float = 1e-3
    slope: float = 1.0
    middle: float = -3.0


def log_odds(a, b, every, n1: int, n0: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of features that `a` of n1 toxic, `b` of n0 harmless and `every` of all documents have.

    Also their z-scores, and the log-odds that they would have without harmless documents.
    """
    strength = 0.1 * (n0 + n1)
    prior = strength * np.maximum(every, 1) / total
    # A feature that every document has leaves nothing on the other side.
    rest1, rest0, rest = (np.maximum(x, 1e-9) for x in (n1 + strength - a - prior, n0 + strength - b - prior, n0 + strength - prior))
    odds = np.log((a + prior) / rest1) - np.log((b + prior) / rest0)
    z = odds / np.sqrt(1 / (a + prior) + 1 / (b + prior))
    return odds, z, np.log((a + prior) / rest1) - np.log(prior / rest)


def _weights(counts: np.ndarray, n: np.ndarray, kinds: tuple[list[int], list[int]]) -> list[np.ndarray]:
    """The weights of features in each setting, learnt from rows of these harmless and toxic kinds.

    Features that too few of these toxic rows have get no number: they are not known.
    """
    harmless, toxic = kinds
    a, b = counts[:, toxic].sum(axis=1).astype(float), counts[:, harmless].sum(axis=1).astype(float)
    n1, n0 = int(n[toxic].sum()), int(n[harmless].sum())
    if not n0 or not n1:
        return [np.full(len(counts), np.nan) for _ in SETTINGS]
    odds, z, reachable = log_odds(a, b, counts.sum(axis=1).astype(float), n1, n0, int(n.sum()))
    out = []
    for min_z, min_odds in SETTINGS:
        telling = (z >= min_z) & (odds >= np.minimum(min_odds, REACH * reachable))
        out.append(np.where(a < MIN_COUNT, np.nan, np.where(telling, odds, BACKGROUND)))
    return out


# Scoring -------------------------------------------------------------------------------------------


def longest_known(w: Words, known: np.ndarray, table: np.ndarray, own: list[np.ndarray]) -> list[np.ndarray]:
    """Of each word, the place in `known` of its longest feature that is in it, or -1, for each of the `own` masks."""
    best = [np.full(len(w.starts), -1) for _ in own]
    if len(known):
        for hashes in features(w):
            at, place = _find(known, hashes, table)
            for mask, out in zip(own, best):
                chosen = mask[place]
                out[at[chosen]] = place[chosen]
    return best


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in one pass.

    Each positive score starts as a segment of its own. A segment looks back for the nearest one that
    begins at a lower running total; if that one ends below the present total, all between are merged and
    the merged segment looks back again. Runs of negative scores only move the total. Each segment keeps
    where its nearest one is, so that looking back skips what earlier segments have passed over.
    """
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(totals[i]), float(totals[i + 1])
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= low:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < high:
            start, low, nearest = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = nearest
        stack.append((start, end, low, high, j))
    return [(s, e, high - low) for s, e, low, high, _ in stack]


_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SEGMENTS_DDL = "array<struct<start: long, end: long, score: double>>"


def segments(docs: DataFrame, known: np.ndarray, weights: list[np.ndarray]) -> DataFrame:
    """Per row and model: doc_id, kind, model, n_words, all maximal segments (word ranges), scores above zero.

    A model is an array of `weights` of the known features; those without a number are not known to it.
    """
    # Models of the same rows know the same features.
    masks, group = [], []
    for each in weights:
        mask = ~np.isnan(each)
        same = [k for k, other in enumerate(masks) if np.array_equal(mask, other)]
        group.append(same[0] if same else len(masks))
        if not same:
            masks.append(mask)
    padded = [np.append(np.nan_to_num(x, nan=BACKGROUND), BACKGROUND) for x in weights]
    shared = docs.sparkSession.sparkContext.broadcast((known, masks, group, padded))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("kind", pa.int32()), ("model", pa.int32()), ("n_words", pa.int64())]
        + [("segments", _SEGMENTS), ("scores", pa.list_(pa.float64()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, masks, group, padded = shared.value
        table = _table(known)
        for chunk in chunks(batches):
            w = _text_words(chunk)
            best = longest_known(w, known, table, masks)
            for model, (which, values) in enumerate(zip(group, padded)):
                scores = values[best[which]]
                positive = np.searchsorted(np.flatnonzero(scores > 0), w.first)
                found, scored = [], []
                for i in range(chunk.num_rows):
                    if positive[i + 1] > positive[i]:
                        own = scores[w.first[i] : w.first[i + 1]]
                        found.append([dict(zip(("start", "end", "score"), s)) for s in maximal_segments(own)])
                        scored.append(own[own > 0])
                    else:
                        found.append([])
                        scored.append([])
                number = np.full(chunk.num_rows, model, dtype=np.int32)
                columns = [chunk.column("doc_id"), chunk.column("kind"), number, np.diff(w.first), found, scored]
                yield to_batch(schema, columns)

    columns = f"doc_id long, kind int, model int, n_words long, segments {_SEGMENTS_DDL}, scores array<double>"
    return map_arrow(docs.select("doc_id", "text", "kind"), work, columns)


def _rate(levels: np.ndarray, counts: np.ndarray, n_words: int, weights: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over harmless tokens.

    One more token, with the mean of the model's positive weights, stands for those not met.
    """
    positive = weights[weights > 0]
    levels = np.append(levels, positive.mean() if len(positive) else 1.0)
    shares = np.append(counts, 1.0) / (n_words + 1)
    rest = 1 - shares.sum()
    low, high = 1e-6, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        above = rest * np.exp(middle * BACKGROUND) + np.sum(shares * np.exp(np.minimum(middle * levels, 700))) > 1
        low, high = (low, middle) if above else (middle, high)
    return low


def evidence(found: DataFrame, rate: Column, scale: Column) -> DataFrame:
    """Adds `passages` (the segments that chance would not give) and `evidence` (their summed -ln E)."""
    length = F.greatest(F.col("n_words"), F.lit(1))

    def surprise(s: Column) -> Column:
        return s["score"] * rate - F.log(length * scale)

    sure = -float(np.log(EXPECTED))
    passages = F.filter("segments", lambda s: surprise(s) >= sure)
    best = F.coalesce(F.array_max(F.transform("segments", surprise)), F.lit(0.0))
    total = F.aggregate(F.transform("passages", surprise), F.lit(0.0), lambda a, x: a + x)
    return found.withColumn("passages", passages).withColumn(
        "evidence", F.when(F.size("passages") > 0, total).otherwise(F.least(best, F.lit(0.0)))
    )


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve for n rows at each point, both kinds weighing the same, slightly held back."""
    weight = n * np.where(y == 1, 0.5 / max(n[y == 1].sum(), 1), 0.5 / max(n[y == 0].sum(), 1))
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([np.sum(weight * (p - y) * x) + 1e-3 * a, np.sum(weight * (p - y))])
        hessian = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


_CAP = 30.0
#: Evidence is told to this many decimals where curves are fitted, so that the points have a bound.
_DECIMALS = 3


def _capped(evidence: str = "evidence") -> Column:
    return F.least(F.greatest(F.col(evidence), F.lit(-_CAP)), F.lit(_CAP))


def calibrate(found: DataFrame, known: np.ndarray, weights: list[np.ndarray]) -> tuple[list[Model], list[tuple]]:
    """Each model calibrated on its rows of column `learn`, and what it makes of the others.

    The latter is the balanced error and logistic loss, infinite if a kind is missing.
    """
    models = [Model(known, w) for w in weights]
    toxic = F.col("kind").isin(TOXIC, TOXIC_JUDGE)
    null = found.where(~toxic & F.col("learn"))
    levels = null.select("model", F.explode("scores").alias("s")).groupBy("model", "s").count().collect()
    n_words = dict(null.groupBy("model").agg(F.sum("n_words")).collect())
    for k, model in enumerate(models):
        own = [r for r in levels if r[0] == k]
        counts = np.array([r[2] for r in own], dtype=float)
        model.rate = _rate(np.array([r[1] for r in own]), counts, n_words.get(k) or 1, model.weights)

    def of_model(values: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("model") + 1)

    rate = of_model([m.rate for m in models])
    # Of Gumbel maxima with this rate, the scale is the inverse of the mean of n * exp(-rate * score).
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    means = dict(null.groupBy("model").agg(F.avg(F.col("n_words") * F.exp(-best * rate))).collect())
    for k, model in enumerate(models):
        model.scale = 1 / max(means.get(k) or 1.0, 1.0)
    points = evidence(found, rate, of_model([m.scale for m in models])).select(
        "model", "learn", toxic.cast("int").alias("y"), F.round(_capped(), _DECIMALS).alias("x")
    )
    rows = np.array([tuple(r) for r in points.groupBy("model", "learn", "y", "x").count().collect()], dtype=float)
    rows = rows.reshape(-1, 5)
    judged = []
    for k, model in enumerate(models):
        own = rows[rows[:, 0] == k]
        y, x, n = own[own[:, 1] == 1, 2:].T
        model.slope, model.middle = _logistic(x, y, n)
        y, x, n = own[own[:, 1] == 0, 2:].T
        sizes = [n[y == kind].sum() for kind in (0, 1)]
        if min(sizes) == 0:
            judged.append((np.inf, np.inf))
            continue
        weight = n * np.where(y == 1, 0.5 / sizes[1], 0.5 / sizes[0])
        p = 1 / (1 + np.exp(-(x * model.slope + model.middle)))
        loss = -np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12))
        judged.append((float(weight[(p >= 0.5) != (y == 1)].sum()), float((weight * loss).sum())))
    return models, judged


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """A model from the labelled rows that are not held out."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = own.count()
    if count > max_labelled:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(count)) < max_labelled)
    judge = F.pmod(F.xxhash64(F.lit("judge"), "doc_id"), F.lit(4)) == 0
    kind = F.when(judge, F.lit(HARMLESS_JUDGE)).otherwise(F.lit(HARMLESS)) + F.col("toxic")
    # At most about `max_labelled` small rows: it may be broadcast.
    own = F.broadcast(stored(own.select("doc_id", kind.cast("int").alias("kind")), "labelled"))
    toxic = docs.join(own.where(F.col("kind").isin(TOXIC, TOXIC_JUDGE)), "doc_id")
    n_toxic = F.col(f"n{TOXIC}") + F.col(f"n{TOXIC_JUDGE}")
    often = feature_counts(toxic).where(n_toxic >= MIN_COUNT).where("feature IS NOT NULL").select("feature").collect()
    known = np.sort(np.array([r[0] for r in often], dtype=np.int64).view(np.uint64))
    if not len(known):
        return Model(known, np.zeros(0))
    every = docs.join(own, "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit(UNKNOWN)))
    counted = feature_counts(every, known).collect()
    n = np.array(next(r[1:] for r in counted if r[0] is None))
    found = np.array([r for r in counted if r[0] is not None], dtype=np.int64)
    counts = found[np.argsort(found[:, 0].view(np.uint64)), 1:]
    whole = _weights(counts, n, ([HARMLESS, HARMLESS_JUDGE], [TOXIC, TOXIC_JUDGE]))
    if np.isnan(whole[0]).all():
        return Model(known[:0], np.zeros(0))
    part = _weights(counts, n, ([HARMLESS], [TOXIC]))
    weights = part + whole
    labelled = stored(segments(docs.join(own, "doc_id"), known, weights), "labelled-segments")
    learn = (F.col("model") >= len(part)) | F.col("kind").isin(HARMLESS, TOXIC)
    models, judged = calibrate(labelled.withColumn("learn", learn), known, weights)
    return models[len(part) + min(range(len(part)), key=lambda k: judged[k])]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, `passages` (word ranges and scores), `evidence`, `score`."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = segments(docs.withColumn("kind", F.lit(UNKNOWN)), model.known, [model.weights])
    found = evidence(found.drop("scores", "kind", "model"), F.lit(model.rate), F.lit(model.scale))
    x = _capped()
    return found.withColumn("score", 1 / (1 + F.exp(-(x * model.slope + model.middle)))).drop("segments")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
