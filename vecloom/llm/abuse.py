"""Problem 8: abusive, hateful or sexual passages, by a character n-gram classifier on naive Bayes ratios."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.arrow_vectors import pack
from vecloom.llm.seed_passages import HARMLESS, all_abusive
from vecloom.session import materialise

#: Labelled documents the classifier is fitted on, at most: abusive and harmless ones, chosen by a hash of the id.
LABELLED = (2_500, 7_500)
#: Characters of the window a score belongs to, and lengths of the n-grams.
WINDOW, ORDERS = 64, (3, 4, 5)
BUCKETS = 1 << 18
#: A text without any known n-gram, whose score is 0, is under the cut by so much at least.
LEAST_CUT = 0.01
#: Labelled texts that the seed passages of a class count for, all together, where held-out scores are weighed.
SEED_WEIGHT = 5.0
#: Labelled harmless documents under which up to so many unlabelled ones are taken for harmless.
LEAST_HARMLESS, STAND_INS = 4, 400
#: Parts of the labelled texts that are held out in turn to find the cut, and how often examples are chosen anew.
FOLDS, ROUNDS = 3, 3
#: Windows of harmless texts taken at random.
BACKGROUND = 4_000
STEP = 0.05
#: An n-gram counts if it occurs in so many example windows; each abusive text gives three windows, and seed passages so many each.
SUPPORT = 9
_STRIDE, _SLICE = 8, 256
_SMOOTHING, _RIDGE = 0.5, 2e-3
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_COMMAND = re.compile(r"\\[a-zA-Z@]+\*?")
_MARKS = str.maketrans(dict.fromkeys("\\{}~%", " "))
_SPACED = re.compile(r" [a-z](?:[ .\-][a-z]){2,}(?![a-z0-9])")
_STRETCHED = re.compile(r"([a-z])\1{2,}")
_DISGUISED = re.compile(r"[0-9@$!|](?:(?<=[a-z].)[0-9@$!|]?(?=[a-z])|(?<=[a-z][0-9@$])(?![a-z0-9])|(?<![a-z0-9].)(?=[a-z]{2}))")
#: Signs that stand for letters. Fixed values.
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"})


def canonical(text: str) -> bytes:
    """Lower-case ASCII in which disguised spellings look like plain ones and markup is gone.

    Invisible characters and soft hyphens vanish, accents are taken off, letters set apart are joined,
    letters repeated more than twice stand once, and one or two digits or signs within or at the end of a
    word become the letters they stand for. Comments, notes and arguments of commands stay as text.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text).replace("ß", "ss")).encode("ascii", "ignore").decode()
    text = _COMMAND.sub(" ", text.replace("\\-", "")).translate(_MARKS)
    text = " " + " ".join(text.lower().split())
    text = _SPACED.sub(lambda m: " " + re.sub(r"[ .\-]", "", m.group()), text)
    text = _DISGUISED.sub(lambda m: m.group().translate(_SIGNS), text)
    return _STRETCHED.sub(r"\1", text).encode()


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a window of zeros, and where each begins."""
    pad = bytes(WINDOW)
    data = np.frombuffer(b"".join(x for t in texts for x in (t, pad)) + bytes(ORDERS[-1]), np.uint8)
    return data, np.append(0, np.cumsum([len(t) + WINDOW for t in texts]))


def _features(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each character; 0, whose weight is 0, for those that reach past a text's end."""
    wide = data.astype(np.uint32)
    n = len(data) - ORDERS[-1]
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(order):
        h = (h ^ wide[j : j + n]) * _FACTORS[j]
        h ^= h >> np.uint32(15)
    inside = wide[:n] != 0
    for j in range(1, order):
        inside &= wide[j : j + n] != 0
    return np.where(inside, (h & np.uint32(BUCKETS - 1)) | np.uint32(1), 0).astype(np.int32)


@dataclass
class Model:
    """Weight of every n-gram bucket, and the window score from which a document is a case."""

    weights: np.ndarray
    threshold: float = 0.0

    def window_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The score of the window that begins at each character, and where each text begins."""
        data, bounds = _buffer(texts)
        total = np.zeros(len(data) - ORDERS[-1] + 1)
        each = np.zeros(len(data) - ORDERS[-1], np.float32)
        for order in ORDERS:
            each += self.weights[_features(data, order)]
        np.cumsum(each, out=total[1:])
        ends = np.minimum(np.arange(len(each)) + WINDOW, len(each))
        return total[ends] - total[:-1], bounds

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window score of each text above the threshold, and where that window begins."""
        if not texts:
            return np.empty(0), np.empty(0, np.int64)
        if len(texts) > _SLICE:
            parts = [self.scores(texts[i : i + _SLICE]) for i in range(0, len(texts), _SLICE)]
            return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        each, bounds = self.window_scores(texts)
        sizes = np.array([max(1, len(t)) for t in texts])
        # windows begin within their text; what they reach over its end are its blanks
        own = np.repeat(bounds[:-1] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        starts = np.append(0, np.cumsum(sizes)[:-1])
        each = each[own]
        best = np.maximum.reduceat(each, starts)
        at = np.flatnonzero(each == np.repeat(best, sizes))
        at = at[np.searchsorted(at, starts)] - starts
        return best - self.threshold, at


def _window_features(texts: list[bytes], where: list[tuple[int, int]]) -> np.ndarray:
    """Buckets of all n-grams of some windows (text, place), one row each; ``where`` is ordered by text."""
    if len(texts) > _SLICE:
        first = np.searchsorted([i for i, _ in where], np.arange(0, len(texts) + _SLICE, _SLICE))
        parts = [_window_features(texts[n * _SLICE : (n + 1) * _SLICE], [(i - n * _SLICE, p) for i, p in where[a:b]]) for n, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b > a]
        return np.concatenate(parts) if parts else np.empty((0, WINDOW * len(ORDERS)), np.int32)
    data, bounds = _buffer(texts)
    each = [_features(data, order) for order in ORDERS]
    starts = np.array([bounds[i] + p for i, p in where], np.int64)
    place = np.minimum(starts[:, None] + np.arange(WINDOW)[None, :], len(each[0]) - 1)
    return np.concatenate([e[place] for e in each], axis=1)


def _ratios(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket from the windows it occurs in; 0 for rare ones."""

    def counted(rows: np.ndarray) -> np.ndarray:
        once = np.sort(rows, axis=1)
        first = np.ones(once.shape, bool)
        first[:, 1:] = once[:, 1:] != once[:, :-1]
        return np.bincount(once[first], minlength=BUCKETS)

    p, q = counted(positive), counted(negative)
    ratio = np.log((p + _SMOOTHING) / (p + _SMOOTHING).sum()) - np.log((q + _SMOOTHING) / (q + _SMOOTHING).sum())
    ratio[(p + q < SUPPORT) | (np.arange(BUCKETS) == 0)] = 0
    return ratio.astype(np.float32)


def _linear(rows: np.ndarray, labels: np.ndarray, ratios: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over n-gram counts scaled by the ratios; returns bucket weights and the offset.

    Rows of both classes weigh the same in total. Full-batch gradient steps of adaptive size.
    """
    known = np.flatnonzero(ratios)
    column = np.full(BUCKETS, -1, np.int32)
    column[known] = np.arange(len(known))
    columns = column[rows]
    row, place = np.nonzero(columns >= 0)
    columns = columns[row, place]
    by_column = np.argsort(columns, kind="stable")
    row_of = row[by_column]
    row_starts, used = np.searchsorted(row, np.arange(len(rows))), np.bincount(row, minlength=len(rows)) > 0
    column_starts, present = np.searchsorted(columns[by_column], np.arange(len(known))), np.bincount(columns, minlength=len(known)) > 0

    def sums(values: np.ndarray, starts: np.ndarray, full: np.ndarray) -> np.ndarray:
        out = np.zeros(len(full))
        if full.any():
            out[full] = np.add.reduceat(values, starts[full])
        return out

    scale = ratios[known].astype(np.float64)
    weight = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (~labels).sum()))
    sign = np.where(labels, 1.0, -1.0)
    w, offset = np.full(len(known), 1.0 / rows.shape[1]), 0.0
    grown, grown_offset = np.full(len(known), 1e-8), 1e-8
    for _ in range(rounds):
        margin = sums((w * scale)[columns], row_starts, used) + offset
        pull = -sign * weight / (1 + np.exp(np.clip(sign * margin, -30, 30)))
        gradient = sums(pull[row_of], column_starts, present) * scale + _RIDGE * w / max(1, len(known))
        grown += gradient * gradient
        grown_offset += pull.sum() ** 2
        w -= STEP * gradient / np.sqrt(grown)
        offset -= 0.2 * pull.sum() / grown_offset**0.5
    out = np.zeros(BUCKETS, np.float32)
    out[known] = w * scale
    return out, offset


def _linear_of(positive: np.ndarray, negative: np.ndarray) -> Model:
    labels = np.append(np.ones(len(positive), bool), np.zeros(len(negative), bool))
    weights, offset = _linear(np.concatenate([positive, negative]), labels, _ratios(positive, negative))
    return Model(weights, -offset)


def _document_ratios(bad: np.ndarray, good: np.ndarray, bad_texts: int, good_texts: int) -> np.ndarray:
    """Log ratios of document frequencies, of n-grams more frequent in abusive texts only."""
    ratio = np.log((bad + _SMOOTHING) / (bad_texts + 2 * _SMOOTHING)) - np.log((good + _SMOOTHING) / (good_texts + 2 * _SMOOTHING))
    ratio = np.where((bad >= 3) & (ratio > 0), ratio, 0).astype(np.float32)
    ratio[0] = 0
    return ratio


def _quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The smallest value that reaches a share of the weights; infinity if there is none."""
    order = np.argsort(values)
    reached = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(reached, share * reached[-1])]) if len(values) else np.inf


def _best_cut(bad: np.ndarray, by_bad: np.ndarray, good: np.ndarray, by_good: np.ndarray, share: float) -> float:
    """The score that parts cases from others best by the F1 to be expected where ``share`` of the texts are cases."""
    if not len(bad) or not len(good):
        return 0.0
    share = min(0.5, max(share, 1e-4))
    scores = np.concatenate([bad, good])
    order = np.argsort(-scores, kind="stable")
    is_bad = order < len(bad)
    weight = np.concatenate([by_bad, by_good])[order]
    hit = np.cumsum(weight * is_bad) / by_bad.sum() * share
    wrong = np.cumsum(weight * ~is_bad) / by_good.sum() * (1 - share)
    best = int(np.argmax(2 * hit / (hit + wrong + share)))
    after = scores[order[best + 1]] if best + 1 < len(scores) else scores[order[best]] - 1
    return float((scores[order[best]] + after) / 2)


@dataclass
class Fitted:
    """What the labelled texts give: a model of each part held out, and the held-out scores that set the cut."""

    models: list[Model]
    #: Of each part the held-out scores of cases and of others, and their weights.
    bad: list[tuple[np.ndarray, np.ndarray]]
    good: list[tuple[np.ndarray, np.ndarray]]
    #: Labelled texts, and those of them that score above the held-out median of their part.
    labelled: int
    above: int

    def medians(self) -> list[float]:
        return [_quantile(*b, 0.5) for b in self.bad]

    def mean(self) -> Model:
        """The mean of the models, with the mean of their held-out medians as the threshold."""
        cuts = [m.threshold + cut for m, cut in zip(self.models, self.medians(), strict=True)]
        return Model(np.mean([m.weights for m in self.models], axis=0), float(np.mean(cuts)))

    def model(self, documents: int, above: float) -> Model:
        """The mean of the models, cut for the share of cases that ``documents`` other texts show, ``above`` of which are over the median."""
        # half of the cases and next to none of the others score above the median case
        share = 2 * (above + self.above) / max(1, documents + self.labelled)
        # each model has its own scale, so its cut comes from the texts that were held out from it
        cuts = [m.threshold + _best_cut(*bad, *good, share) for m, bad, good in zip(self.models, self.bad, self.good, strict=True)]
        return Model(self.mean().weights, max(float(np.mean(cuts)), LEAST_CUT))


def _canonical_rows(batches):
    for batch in batches:
        texts = pa.array([canonical(t) for t in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], names=["doc_id", "bad", "fold", "text"])


def _frequencies(batches):
    """Of each part and class in how many texts each bucket occurs."""
    total: dict[tuple[int, bool], tuple[int, np.ndarray]] = {}
    for batch in batches:
        for bad, fold, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data, _ = _buffer([text])
            there = np.zeros(BUCKETS, bool)
            for order in ORDERS:
                there[_features(data, order)] = True
            texts, counts = total.get((fold, bad), (0, np.zeros(BUCKETS, np.int32)))
            counts += there
            total[fold, bad] = texts + 1, counts
    for (fold, bad), (texts, counts) in total.items():
        yield pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.int32()), "bad": [bad], "texts": [texts], "counts": pa.array([counts.tobytes()], pa.binary())})


def _add_frequencies(table: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(x, np.int32) for x in table["counts"].to_pylist())
    return pa.table({"fold": table["fold"][:1], "bad": table["bad"][:1], "texts": [sum(table["texts"].to_pylist())], "counts": pa.array([counts.astype(np.int32).tobytes()], pa.binary())})


def _window_rows(fold: list[int], features: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pack(features)], names=["fold", "windows"])


def _random_windows(per_text: int, seed: int):
    """Windows at random places of harmless texts; the places depend on a text's id only."""

    def run(batches):
        for batch in batches:
            rows = [r for r in batch.to_pylist() if not r["bad"]]
            texts, where, fold = [r["text"] for r in rows], [], []
            for i, r in enumerate(rows):
                n = max(1, len(r["text"]))
                places = np.random.default_rng((seed, r["doc_id"] & (1 << 63) - 1)).choice(n, min(per_text, max(1, n // WINDOW)), replace=False)
                where += [(i, int(p)) for p in sorted(places)]
                fold += [r["fold"]] * len(places)
            if where:
                yield _window_rows(fold, _window_features(texts, where))

    return run


def _held_out(shared, windows: bool):
    """Each text's score by the model that did not see it, with the n-grams of its worst window (for abusive texts also beside it)."""

    def run(batches):
        models: list[Model] = shared.value
        for batch in batches:
            rows = batch.to_pylist()
            texts, fold = [r["text"] for r in rows], np.array([r["fold"] for r in rows])
            score, at = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
            for k, model in enumerate(models):
                own = np.flatnonzero(fold == k)
                score[own], at[own] = model.scores([texts[i] for i in own])
            near = [(i, max(0, int(at[i]) + d)) for i, r in enumerate(rows) for d in ((-_STRIDE, 0, _STRIDE) if r["bad"] else (0,))] if windows else []
            features = _window_features(texts, near) if near else np.empty((0, WINDOW * len(ORDERS)), np.int32)
            ends = np.cumsum([3 if r["bad"] else 1 for r in rows]) if near else np.zeros(len(rows), int)
            packed = [features[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(score), pa.array(packed, pa.binary())], names=["doc_id", "bad", "fold", "score", "windows"])

    return run


def _fit_part(shared):
    """One model for each part, from the examples of the others."""

    def run(batches):
        positive, owner, negative, other = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                model = _linear_of(positive[owner != k], negative[other != k])
                yield pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int64()), "weights": pa.array([model.weights.tobytes()], pa.binary()), "threshold": [float(model.threshold)]})

    return run


def _windows_of(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int32).reshape(-1, WINDOW * len(ORDERS))


def fit(labelled: DataFrame, seeds: bool = True, seed: int = 5) -> Fitted:
    """Models from whole labelled texts, some of them labelled wrongly, of which a passage is abusive.

    ``labelled`` is a stored table of ``doc_id, bad, fold, text`` (canonical); its texts stay in the tasks, which
    count n-grams, score texts and fit the models. The driver only gets a score and a few windows of fixed
    size for each text.

    The window of each text that looks worst is its example, first by document frequencies and then by the
    models of earlier rounds. Every text is judged by a model that did not see it: an abusive text whose
    worst window looks no worse to that model than usual in harmless ones is left out as mislabelled, and so
    is a harmless one that looks worse than most abusive ones. The same held-out scores set the cut. Seed
    passages are held out in turn like texts and weigh as SEED_WEIGHT of them, however many are labelled.
    """
    spark = labelled.sparkSession
    bad_texts, good_texts = ([canonical(x) for x in all_abusive()], [canonical(x) for x in HARMLESS]) if seeds else ([], [])
    of_bad_texts, of_good_texts = np.arange(len(bad_texts)) % FOLDS, np.arange(len(good_texts)) % FOLDS
    by_seed = [np.full(len(t), SEED_WEIGHT / max(1, len(t))) for t in (bad_texts, good_texts)]
    bad_seeds, good_seeds = (np.repeat(_window_features(t, [(i, 0) for i in range(len(t))]) if t else np.empty((0, WINDOW * len(ORDERS)), np.int32), SUPPORT, axis=0) for t in (bad_texts, good_texts))
    of_bad_seeds, of_good_seeds = np.repeat(of_bad_texts, SUPPORT), np.repeat(of_good_texts, SUPPORT)

    counts = {(k, bad): (0, np.zeros(BUCKETS)) for k in range(FOLDS) for bad in (False, True)}
    parts = labelled.mapInArrow(_frequencies, "fold int, bad boolean, texts bigint, counts binary")
    for r in parts.groupBy("fold", "bad").applyInArrow(_add_frequencies, "fold int, bad boolean, texts bigint, counts binary").collect():
        counts[r.fold, r.bad] = r.texts, np.frombuffer(r.counts, np.int32).astype(np.float64)
    harmless = sum(counts[k, False][0] for k in range(FOLDS))
    per_text = max(1, min(8, BACKGROUND // max(1, harmless)))
    random_ones = labelled.mapInArrow(_random_windows(per_text, seed), "fold int, windows binary").orderBy("windows").toArrow()
    background = np.concatenate([good_seeds, _windows_of(random_ones["windows"].to_pylist())])
    of_background = np.concatenate([of_good_seeds, random_ones["fold"].to_numpy().astype(np.int64)])

    def but(k: int, bad: bool) -> tuple[int, np.ndarray]:
        others = [counts[j, bad] for j in range(FOLDS) if j != k]
        return sum(n for n, _ in others), sum(c for _, c in others)

    def first(k: int) -> Model:
        (bad_n, bad_c), (good_n, good_c) = but(k, True), but(k, False)
        if good_texts:
            # harmless seed passages count as texts here, abusive ones as windows
            for i in np.flatnonzero(of_good_texts != k):
                good_n, good_c = good_n + 1, good_c + _occurs(good_texts[i])
        return Model(_document_ratios(bad_c, good_c, bad_n, good_n) + 0.5 * _ratios(bad_seeds[of_bad_seeds != k], background[of_background != k]))

    def seed_scores(models: list[Model], texts: list[bytes], fold: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, model in enumerate(models):
            own = np.flatnonzero(fold == k)
            out[own] = model.scores([texts[i] for i in own])[0]
        return out

    models = [first(k) for k in range(FOLDS)]
    for again in range(ROUNDS + 1):
        shared = spark.sparkContext.broadcast(models)
        judged = labelled.mapInArrow(_held_out(shared, again < ROUNDS), "doc_id bigint, bad boolean, fold int, score double, windows binary").toArrow().sort_by("doc_id")
        is_bad, fold, score = judged["bad"].to_numpy().astype(bool), judged["fold"].to_numpy().astype(np.int64), judged["score"].to_numpy()
        bad, good = (np.concatenate([score[own], seed_scores(models, texts, of)]) for own, texts, of in ((is_bad, bad_texts, of_bad_texts), (~is_bad, good_texts, of_good_texts)))
        of_bad, of_good = np.concatenate([fold[is_bad], of_bad_texts]), np.concatenate([fold[~is_bad], of_good_texts])
        by_bad, by_good = np.concatenate([np.ones(is_bad.sum()), by_seed[0]]), np.concatenate([np.ones((~is_bad).sum()), by_seed[1]])
        kept = bad > _quantile(good, by_good, 0.95) if len(good) else np.ones(len(bad), bool)
        clean = good < _quantile(bad[kept], by_bad[kept], 0.5)
        if again == ROUNDS:
            found = Fitted(models, *([(x[own & (f == k)], w[own & (f == k)]) for k in range(FOLDS)] for x, w, own, f in ((bad, by_bad, kept, of_bad), (good, by_good, clean, of_good))), len(score), 0)
            cut = np.array(found.medians())
            found.above = int((score > cut[fold]).sum())
            return found
        windows = judged["windows"].to_pylist()
        use_bad, use_good = np.flatnonzero(is_bad)[kept[: is_bad.sum()]], np.flatnonzero(~is_bad)[clean[: (~is_bad).sum()]]
        positive = np.concatenate([bad_seeds, _windows_of([windows[i] for i in use_bad])])
        owner = np.concatenate([of_bad_seeds, np.repeat(fold[use_bad], 3)])
        negative = np.concatenate([background, _windows_of([windows[i] for i in use_good])])
        other = np.concatenate([of_background, fold[use_good]])
        examples = spark.sparkContext.broadcast((positive, owner, negative, other))
        fits = spark.range(0, FOLDS, 1, FOLDS).mapInArrow(_fit_part(examples), "fold bigint, weights binary, threshold double").collect()
        models = [Model(np.frombuffer(r.weights, np.float32), r.threshold) for r in sorted(fits, key=lambda r: r.fold)]
    raise AssertionError


def _occurs(text: bytes) -> np.ndarray:
    there = np.zeros(BUCKETS)
    data, _ = _buffer([text])
    for order in ORDERS:
        there[_features(data, order)] = 1
    return there


def _labelled(texts: DataFrame, labels: DataFrame, most: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The stored table that :func:`fit` takes, and the ids in it."""
    spark = texts.sparkSession
    votes = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.signum(F.col("toxic") - 0.5).alias("v")).groupBy("doc_id").agg(F.sum("v").alias("v")).where("v <> 0")
    there = votes.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    # ids and marks only: at most ``most`` rows of 9 bytes
    chosen = [[r.doc_id for r in there.where(sign).orderBy(F.xxhash64("doc_id"), "doc_id").limit(count).select("doc_id").collect()] for sign, count in zip(("v > 0", "v < 0"), most, strict=True)]
    if len(chosen[1]) < LEAST_HARMLESS:
        spare = texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(STAND_INS + len(chosen[0]) + len(chosen[1])).collect()
        chosen[1] = [i for i in (r.doc_id for r in spare) if i not in chosen[0]][:STAND_INS]
    marks = [(i, kind, n % FOLDS) for kind, ids in ((True, chosen[0]), (False, chosen[1])) for n, i in enumerate(sorted(ids))]
    table = spark.createDataFrame(marks, "doc_id bigint, bad boolean, fold int")
    rows = texts.join(F.broadcast(table), "doc_id").select("doc_id", "bad", "fold", "text").repartition(8, "doc_id").sortWithinPartitions("doc_id")
    return materialise(rows.mapInArrow(_canonical_rows, "doc_id bigint, bad boolean, fold int, text binary"), "labelled"), table.select("doc_id")


def _learned(documents: DataFrame, labels: DataFrame, labelled: tuple[int, int], seeds: bool) -> tuple[DataFrame, Model]:
    """All documents with the raw scores of the fitted model, in one pass, and the model cut for the share of cases they show."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    table, seen = _labelled(source, labels, labelled)
    found = fit(table, seeds)
    mean = found.mean()
    raw = materialise(abuse_scores(documents.withColumn("_there", F.col("text").isNotNull()), Model(mean.weights), ["_there"]), "scores")
    others = raw.where("_there and doc_id is not null").join(F.broadcast(seen), "doc_id", "left_anti")
    counted = others.agg(F.count("*"), F.count_if(F.col("score") > mean.threshold)).first()
    return raw.drop("_there"), found.model(*counted)


def train(documents: DataFrame, labels: DataFrame, labelled: tuple[int, int] = LABELLED, seeds: bool = True) -> Model:
    """A model from ``documents`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``).

    A document is abusive or harmless by the majority of its labels; null labels and ties say nothing. Of
    each class up to ``labelled`` (abusive, harmless) documents are used, those with the smallest hash of their
    id. The share of cases is counted over all documents: those that were fitted on by the model that did not
    see them, all others by the fitted model. With fewer than LEAST_HARMLESS harmless documents up to STAND_INS
    others are taken for harmless, as most are. ``seeds`` adds the package's seed passages to the labelled
    texts; without labels they alone tell what is abusive.
    """
    return _learned(documents.withColumn("source", F.lit(None).cast("string")), labels, labelled, seeds)[1]


def judge(documents: DataFrame, labels: DataFrame, labelled: tuple[int, int] = LABELLED, seeds: bool = True) -> DataFrame:
    """:func:`train` and :func:`abuse_scores` of the same ``documents`` (``doc_id, source, text``), which are scored only once."""
    raw, model = _learned(documents, labels, labelled, seeds)
    return raw.withColumn("score", F.col("score") - F.lit(model.threshold))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """One row of 1 MB."""
    spark.createDataFrame([(bytearray(model.weights.astype(np.float32).tobytes()), float(model.threshold))], "weights binary, threshold double").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(path).first()
    return Model(np.frombuffer(row.weights, np.float32), row.threshold)


def _score_texts(shared):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                scores, _ = model.scores([canonical(t) if t else b"" for t in part.columns[-1].to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "score"])

    return run


def abuse_scores(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, source, score)`` of every row of ``documents`` (``doc_id, source, text``): above 0 it is a case.

    The score is that of the document's worst window of 64 characters of canonical text, so a passage counts
    alike in a short and a very long document; boolean columns named in ``keep`` stay. Null and empty texts have the score of a blank text, which is
    under 0. Documents are read once and never shuffled; the model is 1 MB whatever the data.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), *(keep or []), "text")
    return rows.mapInArrow(_score_texts(shared), f"doc_id bigint, source string, {''.join(f'{c} boolean, ' for c in keep or [])}score double")


def rates(scores: DataFrame) -> DataFrame:
    """``(source, documents, cases, rate)`` per source; documents without a source are one group of their own."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") > 0).alias("cases")).withColumn("rate", F.col("cases") / F.col("documents"))
