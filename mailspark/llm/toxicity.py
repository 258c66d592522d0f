"""Toxicity of restored text: a noisy-channel decoder undoes disguises, and what it restores is scored.

A character language model (trigrams over all documents) is one half of the channel, costs of disguises the
other. Words that may be disguised - letters beside digits or signs that stand for letters, a letter three
times or more in a row, letters spaced out one by one, separators inside a word - become character lattices:
a sign may be a letter or itself, a separator may go or stay, a repeated letter may go. Viterbi takes the
cheapest way through; words without any such place have one way only and are left as they are.

The restored text gives windows of five characters around the letters of each word. In how many labelled
training documents a window occurs, and in how many toxic ones, shrunk towards the common rate, is its
weight. A document's largest weight, the sum of its weights and its length go into a logistic regression;
a training row's own label is taken out of the weights it is described with.

At most SAMPLE labelled training rows are learned from, chosen by a hash of their ids; that list is sent
to all tasks, so texts aren't shuffled. Counts of the language model cover all documents.

Defined results: null, empty and white texts have no window and are scored by the regression like any others.
A document with two labels counts as toxic. Without labels of both classes every score is the share of toxic
labels (0.5 without any). Rows without an id have no label and are scored. A stretch without white space of
more than LONGEST characters isn't a disguised word. An empty table gives no rows; other columns aren't read.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailspark.llm.bpe import LETTER, character_classes
from mailspark.llm.common import per_process, runs_of_rows, written
from mailspark.llm.language import held_out

THRESHOLD = 0.3
#: The most labelled rows to learn from; they are sent to all tasks (16 bytes each).
SAMPLE = 500_000
#: Characters handled at once, and the longest stretch without white space that is decoded.
CHUNK, LONGEST = 500_000, 100
#: Symbols of the language model: 0 is all that isn't a letter, then a to z, then other letters folded.
SYMBOLS = 64
CELLS = 1 << 19
#: A window's rate of toxic documents is shrunk as if it occurred in so many more at the common rate.
PRIOR = 20.0
#: Costs in nats: a sign read as a letter, a sign left as it is (first of a row, next ones), a repeated
#: letter that goes, a separator that goes between single letters and inside a word.
SIGN, KEEP, KEEP_NEXT, REPEAT, SPACED, INSIDE = 0.7, 8.0, 5.0, 0.3, 0.5, 2.5
RIDGE, STEPS = 1.0, 30

#: The letters that digits and signs stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "€": "e", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
#: Signs that are also punctuation: they count only between letters.
SOFT = "!|+*"
SEPARATORS = " ._*-"
IS_LETTER, IS_SIGN, IS_SOFT, IS_SEPARATOR, IS_WHITE = 1, 2, 4, 8, 16
CUT = re.compile(r"(?<=\w\w)\s+(?=\w\w)")


def _tables():
    """What each code point is, as bits, and its symbol in the language model."""
    classes = character_classes()
    kinds = np.where(classes == LETTER, IS_LETTER, 0).astype(np.uint8)
    symbols = np.where(classes == LETTER, 27 + np.arange(len(classes)) % (SYMBOLS - 27), 0).astype(np.uint8)
    symbols[ord("a") : ord("z") + 1] = np.arange(1, 27)
    for signs, bit in (("".join(SIGNS), IS_SIGN), (SOFT, IS_SOFT), (SEPARATORS, IS_SEPARATOR)):
        kinds[[ord(c) for c in signs]] |= bit
    kinds[[ord(c) for c in " \t\n\r\x0b\x0c\x85\xa0"]] |= IS_WHITE
    return kinds, symbols


def tables():
    return per_process("toxicity-tables", _tables)


def stretches(texts):
    """(row, lower-case text) in stretches of bounded length, cut between words of two letters and more."""
    for row, text in enumerate(texts):
        text = text.lower()
        at = 0
        while len(text) - at > CHUNK and (cut := CUT.search(text, at + CHUNK)):
            yield row, text[at : cut.start()]
            at = cut.end()
        yield row, text[at:]


def joined(texts):
    """(text, ends, rows) of runs of stretches; each is followed by a line end, and one stands in front."""
    every = list(stretches(texts))
    for a, b in runs_of_rows([len(t) + 1 for _, t in every], CHUNK):
        own = [t for _, t in every[a:b]]
        ends = 1 + np.cumsum([len(t) + 1 for t in own])
        yield "\n" + "\n".join(own) + "\n", ends, np.array([r for r, _ in every[a:b]])


def codes_of(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


# -- the language model -----------------------------------------------------------


def trigram_cells(text):
    """Cells of all trigrams of a text that end in a letter or right after one; words begin afresh."""
    symbols = tables()[1][codes_of(text)].astype(np.int32)
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    live = (c > 0) | (b > 0)
    return (np.where(b > 0, a, 0) * SYMBOLS * SYMBOLS + b * SYMBOLS + c)[live]


def _counts(frame, cells_of, size, schema):
    """Sums over all rows of counts by number, each task's counts combined before they are sent."""

    def run(batches):
        totals = np.zeros(size, np.int64)
        for batch in batches:
            for cells in cells_of(batch):
                totals += np.bincount(cells, minlength=size)
        live = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(totals[live])], ["cell", "n"])

    found = frame.mapInArrow(run, schema).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def language_model(docs):
    """Log probabilities of a symbol after two others, from the trigrams of all documents."""

    def cells(batch):
        for text, _, _ in joined(batch.column(0).fill_null("").to_pylist()):
            yield trigram_cells(text)

    n3 = _counts(docs.select("text"), cells, SYMBOLS**3, "cell int, n long").reshape((SYMBOLS,) * 3).astype(float)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2) / (n3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32).ravel()


# -- the decoder ------------------------------------------------------------------


def doubtful(codes):
    """Starts and ends of the stretches that may be disguised, in order and apart."""
    kinds = tables()[0][codes]
    letter, white = (kinds & IS_LETTER) > 0, (kinds & IS_WHITE) > 0
    sign, soft, separator = ((kinds & bit) > 0 for bit in (IS_SIGN, IS_SOFT, IS_SEPARATOR))
    word = letter | sign & ~soft

    def shifted(mask, by):
        out = np.zeros_like(mask)
        if by > 0:
            out[by:] = mask[:-by]
        else:
            out[:by] = mask[-by:]
        return out

    before, after = shifted(letter, 1), shifted(letter, -1)
    marks = sign & ~soft & (before | after) | soft & before & after | separator & ~white & before & after
    same = np.zeros(len(codes), bool)
    same[2:] = (codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2])
    places = np.flatnonzero(marks | same & letter)
    gaps = np.flatnonzero(white)
    right = np.searchsorted(gaps, places)
    starts, ends = gaps[right - 1] + 1, gaps[right]
    fit = ends - starts <= LONGEST
    single = word & ~shifted(word, 1) & ~shifted(word, -1)
    run = np.flatnonzero(
        single & shifted(single, -2) & shifted(single, -4) & shifted(separator, -1) & shifted(separator, -3)
    )
    starts, ends = np.concatenate((starts[fit], run)), np.concatenate((ends[fit], run + 5))
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    head = np.ones(len(starts), bool)
    head[1:] = starts[1:] > ends[:-1]
    starts, ends = starts[head], ends[np.append(np.flatnonzero(head)[1:] - 1, len(ends) - 1)]
    letters = np.concatenate(([0], np.cumsum(letter)))
    live = letters[ends] > letters[starts]
    return starts[live], ends[live]


def lattice(text):
    """For each character the ways to read it: (symbol or None if it goes, what is written, cost)."""
    kinds, symbols = tables()
    own = [int(kinds[ord(c)]) for c in text]
    is_word = [bool(k & IS_LETTER) or bool(k & IS_SIGN) and not k & IS_SOFT for k in own]
    n, out, at = len(text), [], 0
    while at < n:
        end = at + 1
        while end < n and text[end] == text[at]:
            end += 1
        for i in range(at, end):
            c, kind, ways = text[i], own[i], []
            if kind & IS_LETTER:
                ways.append((int(symbols[ord(c)]), c, 0.0))
                if end - at >= 3 and i > at:
                    ways.append((None, "", REPEAT))
            else:
                beside = 0 < i < n - 1 and is_word[i - 1] and is_word[i + 1]
                if kind & IS_SIGN:
                    follows = i > 0 and own[i - 1] & IS_SIGN
                    ways.append((0, c, KEEP_NEXT if follows or kind & IS_SOFT else KEEP))
                    if not kind & IS_SOFT or beside:
                        ways += [(int(symbols[ord(l)]), l, SIGN) for l in SIGNS[c]]
                else:
                    ways.append((0, c, 0.0))
                if kind & IS_SEPARATOR and beside:
                    alone = (i < 2 or not is_word[i - 2]) and (i > n - 3 or not is_word[i + 2])
                    if alone or not kind & IS_WHITE:
                        ways.append((None, "", SPACED if alone else INSIDE))
            out.append(ways)
        at = end
    return out


def decode(text, model):
    """The cheapest reading of a stretch: Viterbi over states of the last two symbols."""
    states = {(0, 0): (0.0, None)}
    for ways in lattice(text):
        new = {}
        for (a, b), (cost, path) in states.items():
            for symbol, written_as, extra in ways:
                if symbol is None:
                    key, total, way = (a, b), cost + extra, path
                elif symbol == 0:
                    key, total, way = (0, 0), cost + extra - (model[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0), (path, written_as)
                else:
                    key, total, way = (b, symbol), cost + extra - model[(a * SYMBOLS + b) * SYMBOLS + symbol], (path, written_as)
                if key not in new or total < new[key][0]:
                    new[key] = total, way
        states = new
    ended = ((cost - (model[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0), path) for (a, b), (cost, path) in states.items())
    _, path = min(ended, key=lambda e: e[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


class Decoder:
    """Restores texts; readings of stretches are kept, up to a bounded number."""

    def __init__(self, model, most=200_000):
        self.model, self.most, self.known = model.tolist(), most, {}

    def reading(self, text):
        if text not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[text] = decode(text, self.model)
        return self.known[text]

    def restored(self, text, ends):
        """A joined text without disguises, and where its stretches end."""
        starts, stops = doubtful(codes_of(text))
        parts, at, more = [], 0, np.zeros(len(starts) + 1, np.int64)
        for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            new = self.reading(text[a:b])
            parts += [text[at:a], new]
            more[i + 1] = more[i] + len(new) - (b - a)
            at = b
        return "".join(parts) + text[at:], ends + more[np.searchsorted(stops, ends - 1, side="right")]


def restore(docs, model=None):
    """(doc_id, restored): every text in lower case without disguises; null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(language_model(docs) if model is None else model)

    def run(batches):
        decoder = Decoder(held.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [None if t is None else [] for t in texts]
            for text, ends, rows in joined([t or "" for t in texts]):
                clear, stops = decoder.restored(text, ends)
                for row, a, b in zip(rows.tolist(), [1, *stops[:-1].tolist()], stops.tolist(), strict=True):
                    if out[row] is not None:
                        out[row].append(clear[a : b - 1])
            clear = [None if parts is None else " ".join(parts) for parts in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clear, pa.string())], ["doc_id", "restored"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, restored string")


# -- windows and their weights ------------------------------------------------------


def windows(text, ends):
    """(cell of each window of five characters around three letters, its stretch)."""
    codes = codes_of(text)
    letter = (tables()[0][codes] & IS_LETTER) > 0
    codes = np.where(letter, codes, np.uint32(32))
    middle = np.flatnonzero(letter[1:-3] & letter[2:-2] & letter[3:-1]) + 2 if len(codes) > 4 else np.zeros(0, np.int64)
    cells = np.zeros(len(middle), np.uint32)
    for step, factor in zip(range(-2, 3), (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x9E3779B1), strict=True):
        cells = cells * np.uint32(31) + codes[middle + step] * np.uint32(factor)
    cells ^= cells >> np.uint32(15)
    cells *= np.uint32(0x2C1B3C6D)
    return (cells >> np.uint32(13)).astype(np.int64), np.searchsorted(ends, middle, side="right")


def window_counts(labelled, model):
    """(number of documents, number of toxic ones) with each cell, from rows (text, toxic)."""
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def cells(batch):
        decoder = Decoder(held.value)
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for text, ends, rows in joined(batch.column(0).fill_null("").to_pylist()):
            found, at = windows(*decoder.restored(text, ends))
            row, cell = np.divmod(np.unique(rows[at] * CELLS + found), CELLS)
            yield cell * 2 + toxic[row]

    counts = _counts(labelled.select("text", "toxic"), cells, 2 * CELLS, "cell int, n long").reshape(CELLS, 2)
    return counts.sum(axis=1), counts[:, 1]


def weights(n, toxic, rate):
    """Log odds of a window's shrunk rate above the common one."""
    own = (toxic + PRIOR * rate) / (n + PRIOR)
    return np.log(own / (1 - own)) - np.log(rate / (1 - rate))


FEATURES = 3


def describe(docs, sample, model, counts, rate):
    """(doc_id, held_out, features, toxic, fitted): ``fitted`` describes a sampled row without its own label."""
    held = docs.sparkSession.sparkContext.broadcast((model, *counts))

    def run(batches):
        model, n, toxic = held.value
        decoder, plain = Decoder(model), weights(n, toxic, rate)
        for batch in batches:
            texts, label = batch.column(2).fill_null("").to_pylist(), batch.column(3)
            known = np.array([-1 if x is None else x for x in label.to_pylist()], np.int64)
            totals = np.zeros((2, FEATURES, len(texts)))
            for text, ends, rows in joined(texts):
                cells, at = windows(*decoder.restored(text, ends))
                row = rows[at]
                mine = np.maximum(known[row], 0)
                # stretches of one text may meet a window again that lies in the others as well
                apart = weights(np.maximum(n[cells] - 1, 0), np.maximum(toxic[cells] - mine, 0), rate)
                for k, values in enumerate((plain[cells], apart)):
                    np.maximum.at(totals[k, 0], row, values)
                    totals[k, 1] += np.bincount(row, weights=np.maximum(values - 1, 0), minlength=len(texts))
                    totals[k, 2] += np.bincount(row, minlength=len(texts))
            totals[:, 1:] = np.log1p(totals[:, 1:])
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * FEATURES)
            features = [pa.ListArray.from_arrays(offsets, pa.array(t.T.ravel())) for t in totals]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), features[0], label, features[1]],
                ["doc_id", "held_out", "features", "toxic", "fitted"],
            )

    schema = "doc_id long, held_out boolean, features array<double>, toxic int, fitted array<double>"
    rows = docs.select("doc_id", held_out().alias("held_out"), "text").join(F.broadcast(sample), "doc_id", "left")
    return rows.select("doc_id", "held_out", "text", "toxic").mapInArrow(run, schema)


def fit(x, y):
    """(mean, scale, coefficients with the constant last) of a ridge logistic regression by Newton's steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    ridge = RIDGE * np.diag([1.0] * FEATURES + [0.0])
    beta = np.zeros(FEATURES + 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (p - y) + ridge @ beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(beta)), gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, beta


def sampled(labels, most=SAMPLE):
    """(doc_id, toxic) of at most ``most`` labelled rows that aren't held out, chosen by a hash of the id."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").filter(~held_out())
    once = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def classify(docs, labels, most=SAMPLE):
    """(doc_id, held_out, score, predicted) of every document."""
    docs = docs.select("doc_id", "text")
    sample = written(sampled(labels, most), "sample")
    n, toxic = (x or 0 for x in sample.agg(F.count("*"), F.sum("toxic")).first())
    if not 0 < toxic < n:
        score = F.lit(toxic / n if n else 0.5)
        return docs.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
    model, rate = language_model(docs), toxic / n
    counts = window_counts(docs.join(F.broadcast(sample), "doc_id"), model)
    described = written(describe(docs, sample, model, counts, rate), "described")
    learned = described.filter("toxic is not null").select("toxic", "fitted").toArrow()  # at most ``most`` rows
    x = learned["fitted"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    mean, scale, beta = fit(x, learned["toxic"].to_numpy().astype(float)) if len(x) else (0, 1, np.zeros(FEATURES + 1))
    slopes = beta[:FEATURES] / scale
    constant = float(beta[-1] - (slopes * mean).sum())
    logit = F.lit(constant)
    for k in range(FEATURES):
        logit = logit + F.col("features")[k] * float(slopes[k])
    score = 1 / (1 + F.exp(-logit))
    return described.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
