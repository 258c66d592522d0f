"""Byte-pair encoding and decoding by a pair occurrence index.

All different words of a block of rows are laid out as one sequence of symbols. An index maps
each mergeable pair to all its positions in it. Ranks that have positions wait in a heap; the
least is taken, all its live positions are merged at once, and the pairs that arise to the left
and right enter the lists of their own ranks.

Defined results: a null or empty text has no ids and decodes to the empty text. Texts of any
length are encoded whole. Repeated rows give repeated results; other columns are not looked at.
"""

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from mailspark.llm.common import RollingHash, per_process, runs_of_rows

NUMBER, LETTER, OTHER, SPACE = 2, 1, 3, 0
#: The characters with Unicode's property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that are cut off after an apostrophe.
CONTRACTIONS = re.compile("(?:[stmd]|re|ve|ll)")
#: Text is laid out so many characters at a time; words are encoded so many characters at a time.
CHUNK, BLOCK = 1_000_000, 12_000_000
#: Encoded words that a task remembers from block to block.
REMEMBERED = 500_000
NONE = np.iinfo(np.int64).max


def character_classes():
    classes = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            classes[code] = LETTER
        elif kind == "N":
            classes[code] = NUMBER
    classes[WHITE_SPACE] = SPACE
    return classes


def byte_characters():
    """The printable character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return table | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class PairIndexEncoder:
    """Encodes texts by a tokenizer file of the kind: lower case, byte-level, marked word ends."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.special_pattern = re.compile("|".join(re.escape(t) for t in self.special) or "(?!)")
        shown = byte_characters()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[shown[b] + end] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left * self.size + self.right
        self.rank_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_order]
        self.rank_type = np.uint16 if len(merges) < 1 << 16 else np.uint32  # small numbers sort faster
        self.classes = per_process("classes", character_classes)
        self.forget()

    def forget(self):
        self.known, self.flat, self.starts, self.counts = {}, np.zeros(0, np.uint16), [], []

    def ranks(self, left, right):
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_order[at], NONE)

    def encode_words(self, words):
        """(ids of all words in a row, number of ids of each word); words are UTF-8 bytes, none empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        lasts = np.cumsum(lengths) - 1
        symbol = self.inner[data]
        symbol[lasts] = self.final[data[lasts]]
        n = len(data)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[lasts] = -1
        before[lasts[:-1] + 1] = -1
        merged = np.zeros(n, bool)
        index, heap = {}, []

        def enter(positions):
            """Add the pairs that begin at these positions to the index."""
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            live = rank != NONE
            rank, positions = rank[live], positions[live]
            if not len(rank):
                return
            order = np.argsort(rank.astype(self.rank_type), kind="stable")
            rank, positions = rank[order], positions[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(rank)]
            for start, stop in zip(bounds, bounds[1:], strict=False):
                r = int(rank[start])
                if r in index:
                    index[r].append(positions[start:stop])
                else:
                    index[r] = [positions[start:stop]]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.sort(np.concatenate(lists))
            left, right = self.left[r], self.right[r]
            at = at[symbol[at] == left]
            then = after[at]
            live = (then >= 0) & (symbol[then] == right)
            at, then = at[live], then[live]
            if left == right and len(at) > 1:  # of overlapping pairs the leftmost
                kept, taken = [], -1
                for i, (a, b) in enumerate(zip(at.tolist(), then.tolist(), strict=True)):
                    if a != taken:
                        kept.append(i)
                        taken = b
                at, then = at[kept], then[kept]
            if not len(at):
                continue
            following, previous = after[then], before[at]
            symbol[at] = self.made[r]
            symbol[then] = -1
            after[at] = following
            inner = following >= 0
            before[following[inner]] = at[inner]
            merged[at] = True  # of a merged pair to the left the right-hand pair is enough
            previous = previous[previous >= 0]
            enter(np.concatenate((at[inner], previous[~merged[previous]])))
            merged[at] = False
        alive = symbol >= 0
        counts = np.add.reduceat(alive, lasts - lengths + 1, dtype=np.int64) if n else lengths
        return symbol[alive].astype(np.uint16 if self.size <= 1 << 16 else np.uint32), counts

    def words(self, text):
        """Starts and ends of the words of a lower-cased text, and its characters' codes."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[codes]
        first = np.ones(len(kind), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(kind))[: len(starts)]
        of_word = kind[starts] != SPACE
        marks = np.flatnonzero((codes[starts] == 0x27) & (ends - starts == 1)) if len(starts) else starts
        merged, cut = [], []
        for i in marks.tolist():
            if found := CONTRACTIONS.match(text, int(ends[i])):
                merged.append(i)
                cut.append(found.end())
        if merged:
            # the apostrophe's word ends after the ending; what is left of the next word begins there
            ends[merged] = cut
            nexts = np.array(merged) + 1
            starts[nexts] = cut
        live = of_word & (starts < ends)
        return starts[live], ends[live], codes

    def encode(self, texts):
        """The ids of each text."""
        plain = []  # texts between special tokens, and to which text they belong
        layout = []
        for text in texts:
            pieces = []
            if "<" in text and self.special_pattern.search(text):
                at = 0
                for found in self.special_pattern.finditer(text):
                    pieces += [len(plain), -1 - self.special[found[0]]]
                    plain.append(self.normal(text[at : found.start()]))
                    at = found.end()
                text = text[at:]
            pieces.append(len(plain))
            plain.append(self.normal(text))
            layout.append(pieces)
        if len(self.known) > REMEMBERED:
            self.forget()
        word_numbers, pending = [], []
        for start, stop in runs_of_rows([len(t) + 1 for t in plain], CHUNK):
            word_numbers += self.number(plain[start:stop], pending)
        self.learn(pending)
        starts, counts = np.array(self.starts, np.int64), np.array(self.counts, np.int64)
        ids = []
        for numbers in word_numbers:
            count = counts[numbers]
            total = int(count.sum())
            shift = np.repeat(starts[numbers] - (np.cumsum(count) - count), count)
            ids.append(self.flat[shift + np.arange(total)])
        whole = []
        for pieces in layout:
            if len(pieces) == 1:
                whole.append(ids[pieces[0]])
            else:
                whole.append(np.concatenate([ids[p] if p >= 0 else np.array([-1 - p], ids[0].dtype) for p in pieces]))
        return whole

    @staticmethod
    def normal(text):
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def number(self, texts, pending):
        """Each text as an array of word numbers; words not known yet join ``pending``."""
        joined = "\n".join(texts)
        starts, ends, codes = self.words(joined)
        hashes = RollingHash(codes).of(starts, ends)
        inverse, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[inverse[::-1]] = np.arange(len(inverse))[::-1]
        known = self.known
        numbers = list(map(known.get, distinct.tolist()))
        for i in [i for i, n in enumerate(numbers) if n is None]:
            numbers[i] = known[int(distinct[i])] = len(known)
            at = first[i]
            pending.append(joined[starts[at] : ends[at]].encode("utf-8", "surrogatepass"))
        numbers = np.array(numbers, np.int64)[inverse]
        cuts = np.cumsum([len(t) + 1 for t in texts])[:-1]
        return np.split(numbers, np.searchsorted(starts, cuts))

    def learn(self, words):
        if not words:
            return
        ids, counts = self.encode_words(words)
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate((self.flat, ids)) if len(self.flat) else ids
        self.starts += starts.tolist()
        self.counts += counts.tolist()

    def decode(self, ids):
        """The tokens' texts with spaces between them, as UTF-8; nothing is skipped."""
        return b" ".join(map(self.token_bytes.__getitem__, ids.tolist()))


def encoder(path):
    """One encoder for each file and Python worker."""
    return per_process(f"encoder {path}", lambda: PairIndexEncoder(path))


def encoded_batches(batches, path, text_at=1):
    """(batch, first row, ids of each text) for blocks of rows of each Arrow batch."""
    own = encoder(path)
    for batch in batches:
        texts = batch.column(text_at).fill_null("").to_pylist()
        for start, stop in runs_of_rows([len(t) for t in texts], BLOCK):
            yield batch.slice(start, stop - start), own.encode(texts[start:stop])


def encode(docs, path):
    """(doc_id, ids) of every document."""

    def run(batches):
        for batch, ids in encoded_batches(batches, path):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    schema = T.StructType().add("doc_id", "long").add("ids", T.ArrayType(T.IntegerType()))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded, path):
    """(doc_id, text) of every row of ids."""

    def run(batches):
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs, path):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, in one pass."""

    def run(batches):
        own = encoder(path)
        for batch, ids in encoded_batches(batches, path):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
