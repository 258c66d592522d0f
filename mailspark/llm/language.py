"""Languages of a document as a mixture, by expectation maximisation over n-gram likelihoods.

Training counts letter trigrams (hashed into a fixed number of cells) for each language over all
training rows. A document is cut into segments of trigrams; each segment has a log-likelihood under
every language. EM estimates the document's proportions. In order of these, sets of one, two and more
languages are refitted until a larger set no longer pays its penalty, and the set with the largest
likelihood less its penalty is taken. The prediction is the language with the largest proportion in it.

A document `fits` if it has a letter and its mixture explains it no worse than a background in which all
cells are equally likely: less by FLOOR nats a trigram and by LEAST_LOSS nats in all is a text of none of the
learned languages. Without a model every text with a letter fits.

Defined results: a null text or one without a letter is `und` with score 0, and so is any text if
nothing could be learned. Texts are read whole. Ties go to the first language by name. Rows without
an id count as training rows. An empty table gives no rows. Other columns are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailspark.llm.bpe import LETTER, character_classes
from mailspark.llm.common import per_process, rows_by_id, runs_of_rows

CELLS = 1 << 15
SEGMENT, ROUNDS, CHUNK = 48, 10, 500_000
#: Cost of one more language: this many nats, and as many times the log of the segments.
PENALTY = 3.0
UNDETERMINED = "und"
#: A text that loses so many nats against the background, for each trigram and in all, fits no language.
FLOOR, LEAST_LOSS = 1.0, 40.0


def held_out():
    """Whether a row's label may only be used for evaluation."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def trigrams(texts):
    """(cell of each trigram around a letter, the text it belongs to)."""
    lowered = [t.lower() for t in texts]
    joined = " " + " ".join(lowered) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = per_process("classes", character_classes)[codes] == LETTER
    codes = np.where(letter, codes, np.uint32(32))
    middle = np.flatnonzero(letter)
    cells = codes[middle - 1] * np.uint32(0x85EBCA6B) + codes[middle] * np.uint32(0xC2B2AE35)
    cells += codes[middle + 1] * np.uint32(0x27D4EB2F)
    cells ^= cells >> np.uint32(15)
    cells *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return (cells >> np.uint32(17)).astype(np.int64), np.searchsorted(ends, middle - 1, side="right")


def train(docs):
    """(languages, log probabilities as languages x CELLS) from rows that aren't held out."""

    def count(batches):
        totals = {}
        for batch in batches:
            texts, langs = (batch.column(i).to_pylist() for i in (0, 1))
            for start, stop in runs_of_rows([len(t) + 1 for t in texts], CHUNK):
                cells, owner = trigrams(texts[start:stop])
                names, number = np.unique(np.array(langs[start:stop], object), return_inverse=True)
                both = np.bincount(number[owner] * CELLS + cells, minlength=len(names) * CELLS)
                for name, own in zip(names, both.reshape(len(names), CELLS), strict=True):
                    totals[name] = totals.get(name, 0) + own
        for name, own in totals.items():
            live = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(live), pa.string()), pa.array(live, pa.int32()), pa.array(own[live], pa.int64())],
                ["lang", "cell", "n"],
            )

    rows = docs.filter(~held_out()).filter("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, cell int, n long")
    summed = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(summed["lang"].unique())
    grams = np.full((len(names), CELLS), 0.5)
    for i, name in enumerate(names):
        own = summed[summed["lang"] == name]
        grams[i, own["cell"].to_numpy()] += own["n"].to_numpy()
    return names, np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)


def _fit(scores, heads, owner, allowed):
    """(proportions, log-likelihood) of each document, restricted to the allowed languages."""
    with np.errstate(divide="ignore"):
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            logs = scores + np.log(share)[owner]
            top = logs.max(axis=1, keepdims=True)
            weight = np.exp(logs - top)
            total = weight.sum(axis=1, keepdims=True)
            weight /= total
            share = np.add.reduceat(weight, heads) / np.diff(np.append(heads, len(owner)))[:, None]
    likelihood = np.add.reduceat((top + np.log(total))[:, 0], heads)
    return share, likelihood


def mixtures(texts, logs):
    """(rows with letters, language number, proportion, size of the chosen set, whether it fits)."""
    cells, owner = trigrams(texts)
    if not len(cells) or not len(logs):
        rows = np.unique(owner)
        return rows, *(np.zeros(len(rows), np.int64),) * 3, np.ones(len(rows), bool)
    rows, starts, counts = np.unique(owner, return_index=True, return_counts=True)
    inside = np.arange(len(cells)) - np.repeat(starts, counts)
    heads = np.flatnonzero(inside % SEGMENT == 0)
    scores = np.stack([np.add.reduceat(own[cells], heads) for own in logs], axis=1).astype(np.float64)
    own = np.searchsorted(rows, owner[heads])
    first = np.searchsorted(own, np.arange(len(rows)))
    segments = np.diff(np.append(first, len(own)))
    n = len(logs)
    alone = np.add.reduceat(scores, first)
    best, value = alone.argmax(axis=1), alone.max(axis=1)
    share, size, gain = np.ones(len(rows)), np.ones(len(rows), np.int64), value + counts * np.log(CELLS)
    free, _ = _fit(scores, first, own, np.ones((len(rows), n)))
    order = np.argsort(-free, axis=1, kind="stable")
    for k in range(2, n + 1):
        live = size >= k - 2  # a larger set is tried once more after one that didn't pay
        if not live.any():
            break
        at, part = np.flatnonzero(live), live[own]
        places = (np.cumsum(live) - 1)[own[part]]
        allowed = np.zeros((len(at), n))
        np.put_along_axis(allowed, order[at, :k], 1.0, axis=1)
        fitted, likelihood = _fit(scores[part], np.searchsorted(places, np.arange(len(at))), places, allowed)
        penalised = likelihood - (k - 1) * PENALTY * (1 + np.log1p(segments[at]))
        better = penalised > value[at]
        won = at[better]
        value[won], size[won] = penalised[better], k
        best[won], share[won] = fitted[better].argmax(axis=1), fitted[better].max(axis=1)
        gain[won] = likelihood[better] + counts[won] * np.log(CELLS)
    return rows, best, share, size, (gain > -FLOOR * counts) | (gain > -LEAST_LOSS)


def identify(docs, names, logs):
    """(doc_id, held_out, lang_pred, score, n_languages, fits) of every document."""
    model = docs.sparkSession.sparkContext.broadcast((names, logs))

    def run(batches):
        for batch in batches:
            known, table = model.value
            texts = batch.column(2).fill_null("").to_pylist()
            label, score, count = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            fits = np.zeros(len(texts), bool)
            for start, stop in runs_of_rows([len(t) + 1 for t in texts], CHUNK):
                rows, best, share, size, good = mixtures(texts[start:stop], table)
                score[start + rows], count[start + rows], fits[start + rows] = share, size, good
                for row, i in zip((start + rows).tolist(), best.tolist(), strict=True):
                    label[row] = known[i] if known else UNDETERMINED
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(label), pa.array(np.clip(score, 0, 1)), pa.array(count), pa.array(fits)],
                ["doc_id", "held_out", "lang_pred", "score", "n_languages", "fits"],
            )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_languages long, fits boolean"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


def predict(docs):
    """Learn from the documents that aren't held out and predict all."""
    return identify(docs, *train(docs))


def with_language(docs):
    """The documents that fit a mixture of learned languages, or that have a letter if none was learned.

    Rows without an id share one decision: they stay if one of them fits.
    """
    return rows_by_id(docs, predict(docs).filter("fits"), "left_semi")
