"""Personal data, plain and disguised, found through transducers that keep source offsets.

A transducer rewrites a text and remembers the source range of every stretch it wrote. Three run in turn:
lookalike letters and invisible characters, spelled digits, and disguises of "@" and ".". The detectors
run on the source (base spans) and on the rewritten text; spans found there are mapped back to the source
and added unless a base span of the kind has them. Whether a disguise is undone depends on its own place
only: digits are joined where at least one of them is spelled, and a bare word "at", common in prose, stands
for "@" only before a domain with a disguised dot. There is no limit on lengths, and time is linear in them.

Defined results: a null text is the empty text. Offsets count code points, ends are exclusive. A
match that fails its check is dropped and its characters aren't tried again. Texts are read whole.
Repeated rows give repeated results, an empty table none; other columns are not looked at.
"""

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import functions as F

#: The kinds and the patterns that define base spans.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that fails at the first digit of a run fails at all others too, so only first digits are tried
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
DOTTED = re.compile(r"[0-9]\.[0-9]+\.[0-9]")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Digits in words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
# only rows of at least three are digits, one word alone is prose
SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus[ -]+)?(?:{_DIGIT}|[0-9]+)(?:[ .-]+(?:dot[ .-]+|point[ .-]+)?(?:{_DIGIT}|[0-9]+)){{2,}}(?![^\W_])")
SPELLED_PART = re.compile(rf"(?i)plus|dot|point|{_DIGIT}|[0-9]+|[ .-]+")
# a text without any of these has no spelled digits: it is split into words by its bytes
WATCHED = frozenset(w.encode() for word in (*DIGIT_WORDS, "plus") for w in (word, word.replace("ü", "Ü").replace("é", "É")))
SPLIT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Disguises of "@" and "."; white space around them is taken by the code that reads them.
AT = re.compile(r"(?i)[(\[{<]\s*(?:at|arroba|@)\s*[)\]}>]|(?<=\s)(?:at|arroba)(?=\s)|@")
DOT = re.compile(r"(?i)[(\[{<]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}>]|(?<=\s)(?:dot|punkt|punto)(?=\s)")
DOMAIN_LABEL = re.compile(r"[A-Za-z0-9-]+")
_ANY_DOT = r"(?:\s*[(\[{<]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}>]\s*|\s+(?:dot|punkt|punto)\s+|\.)"
DISGUISED_NUMBER = re.compile(rf"(?i)(?<![0-9])[0-9]+(?:{_ANY_DOT}[0-9]+){{3}}")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text):
    """Each "@" with the local part before it, as far as the last match lets it reach."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        else:
            # characters before a failed "@" can't begin a match, and those after it aren't used up
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text):
    """Base spans (kind, start, end), by kind and start."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text) if DOTTED.search(text) else ():
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


class Tape:
    """A text under rewriting; each layer knows where its stretches come from in the text before it."""

    def __init__(self, text, layers=()):
        self.text, self.layers = text, layers

    def replace(self, pieces):
        """Rewrite pieces (start, end, new text), in order and apart."""
        out, layer, at, size = [], ([], [], [], []), 0, 0

        def write(new, start, end, copied=False):  # a copied stretch stands for its source character by character
            nonlocal size
            if new:
                for column, value in zip(layer, (size, start, end, copied), strict=True):
                    column.append(value)
                out.append(new)
                size += len(new)

        for start, end, new in pieces:
            write(self.text[at:start], at, start, True)
            write(new, start, end)
            at = end
        if not at:
            return self
        write(self.text[at:], at, len(self.text), True)
        return Tape("".join(out), (*self.layers, layer))

    def source(self, start, end):
        for places, starts, ends, copied in reversed(self.layers):
            first, last = bisect_right(places, start) - 1, bisect_right(places, end - 1) - 1
            begin = starts[first] + (start - places[first] if copied[first] else 0)
            stop = starts[last] + end - places[last] if copied[last] else ends[last]
            start, end = begin, stop
        return start, end


def _looks(c):
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～" or unicodedata.category(c) == "Nd" or "\U0001d400" <= c <= "\U0001d7ff":
        plain = unicodedata.normalize("NFKC", c)
        return str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else plain
    return c


ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + INVISIBLE + r"！-～\U0001d400-\U0001d7ff]|(?![0-9])\d")


def _odd(text):
    return ((m.start(), m.end(), _looks(m[0])) for m in ODD.finditer(text))


def _spelled(text):
    """Digits in words, and the separators in rows of digits of which one at least is spelled."""
    for m in SPELLED.finditer(text):
        parts = list(SPELLED_PART.finditer(m[0]))
        if not any(p[0].lower() in DIGIT_WORDS or p[0].lower() == "plus" for p in parts):
            continue
        for part in parts:
            word = part[0].lower()
            if word[0].isdigit():
                continue
            if word == "plus":
                new = "+"
            elif word in DIGIT_WORDS:
                new = DIGIT_WORDS[word]
            else:  # between digits nothing, for a written dot one
                new = "." if word in ("dot", "point") or "." in word else ""
            yield m.start() + part.start(), m.start() + part.end(), new


def _spaces(text, start, end):
    """A range with the white space around it."""
    while start and text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    return start, end


def _addresses(text):
    """The "@" and the dots of disguised addresses."""
    dots = [_spaces(text, m.start(), m.end()) for m in DOT.finditer(text)]
    dots_at, dots_to = dict(dots), {b: a for a, b in dots}
    free = 0
    for m in AT.finditer(text):
        if m.start() < free:
            continue
        at = _spaces(text, m.start(), m.end())
        start, left = at[0], []
        while True:  # the local part, backwards
            inner = start
            while inner > free and text[inner - 1] in LOCAL:
                inner -= 1
            if inner == start:
                break
            start = inner
            if (before := dots_to.get(start)) is None or before <= free:
                break
            left.append((before, start))
            start = before
        if left and start == left[-1][0]:  # nothing before the last dot
            start = left.pop()[1]
        end, right, n = at[1], [], 0
        while label := DOMAIN_LABEL.match(text, end):
            end, n = label.end(), n + 1
            if end in dots_at:
                after = dots_at[end]
            elif text.startswith(".", end):
                after = end + 1
            else:
                break
            if not DOMAIN_LABEL.match(text, after):
                break
            if end in dots_at:
                right.append((end, after))
            end = after
        bare = m[0].lower() == "at"
        if start == at[0] or n < 2 or bare and not right:
            continue
        if left or right or at != (m.start(), m.start() + 1):
            for a, b in reversed(left):
                yield a, b, "."
            yield *at, "@"
            for a, b in right:
                yield a, b, "."
        free = end


def _numbers(text):
    for m in DISGUISED_NUMBER.finditer(text):
        for dot in DOT.finditer(text, m.start(), m.end()):
            yield *_spaces(text, dot.start(), dot.end()), "."


def rewritten(text):
    """The text without disguises as a Tape, or None if it has none."""
    tape = Tape(text)
    if not text.isascii():
        tape = tape.replace(_odd(text))
    words = tape.text.encode("utf-8", "surrogatepass").lower().translate(SPLIT).split()
    if not WATCHED.isdisjoint(words):
        tape = tape.replace(_spelled(tape.text))
    tape = tape.replace(_addresses(tape.text))
    if DOT.search(tape.text):
        tape = tape.replace(_numbers(tape.text))
    return tape if tape.layers else None


def find(text):
    """(base spans, all spans) of a text, both by kind and start."""
    base = detect(text)
    tape = rewritten(text)
    if tape is None:
        return base, base
    every, starts, ends = list(base), {}, {}
    for kind, start, end in base:  # spans of a kind don't overlap and come in order
        starts.setdefault(kind, []).append(start)
        ends.setdefault(kind, []).append(end)
    for kind, start, end in detect(tape.text):
        a, b = tape.source(start, end)
        k = bisect_right(starts.get(kind, []), a) - 1
        if k < 0 or ends[kind][k] < b:
            every.append((kind, a, b))
    return base, sorted(set(every), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text, spans):
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def spans(docs):
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts are of base spans."""

    def run(batches):
        for batch in batches:
            counts, sums, lists = [], [], []
            for text in batch.column(1).fill_null("").to_pylist():
                base, every = find(text)
                kinds = [k for k, _, _ in base]
                counts.append([kinds.count(k) for k in KINDS])
                sums.append(hashlib.sha256(shown(base).encode()).hexdigest())
                lists.append(shown(every))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(sums, pa.string()), pa.array(lists, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs):
    """The documents with all spans masked; ``n_chars``, if there, counts the new text."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: t if t is None else masked(t, find(t)[1]))

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
