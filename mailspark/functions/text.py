"""String expressions: all of them stay in the JVM."""

from pyspark.sql import functions as F

# Elements without readable text, elements that start a new block,
# and the named character references that are resolved.
SILENT_ELEMENTS = ["head", "script", "style", "noscript", "template", "title"]
BLOCK_ELEMENTS = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section select table "
    "tbody td tfoot th thead tr ul"
).split()
NAMED_ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "middot": "·",
    "copy": "©",
    "reg": "®",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "euro": "€",
    "amp": "&",  # last, so that no reference is resolved twice
}

# Patterns that Java and RE2 read alike. Each costs one pass over the text, so
# they are few, and each begins with one fixed character to scan for.
SILENT = (
    r"(?is)<(?:!--.*?--|"
    + "|".join(rf"{e}\b[^>]*>.*?</{e}\s*" for e in SILENT_ELEMENTS)
    + ")>"
)
LINE_BREAKS = "\t\n\r\f"
BLOCK_TAG = r"(?i)</?(?:" + "|".join(BLOCK_ELEMENTS) + r")\b[^>]*>"
ANY_TAG = r"</?[A-Za-z!?][^>]*>"
NUMBER = r"^(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));"


def _resolved_numbers(column):
    """Replace every ``&#233;`` or ``&#xe9;`` by its character.

    The text is cut at the mark, so it is computed once however many it has.
    """

    def resolved(piece, position):
        digits, hexes = (F.regexp_extract(piece, NUMBER, g) for g in (1, 2))
        code = F.coalesce(
            digits.try_cast("bigint"), F.conv(F.nullif(hexes, F.lit("")), 16, 10).cast("bigint")
        )
        # Half pairs and numbers beyond Unicode are no characters: left as written.
        usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        utf32 = F.unhex(F.lpad(F.hex(F.when(usable, code).otherwise(63)), 8, "0"))
        rest = F.regexp_replace(piece, NUMBER, "")
        return (
            F.when(position == 0, piece)
            .when(usable, F.concat(F.decode(utf32, "UTF-32"), rest))
            .otherwise(F.concat(F.lit("&#"), piece))
        )

    return F.array_join(F.transform(F.split(column, "&#"), resolved), "")


def _unmarked(column):
    """Text with tags removed, one line per block, and references resolved."""
    text = F.regexp_replace(column, SILENT, "")
    text = F.translate(text, LINE_BREAKS, " " * len(LINE_BREAKS))
    text = F.regexp_replace(text, BLOCK_TAG, "\n")
    text = _resolved_numbers(F.regexp_replace(text, ANY_TAG, ""))
    for name, character in NAMED_ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    lines = F.split(F.regexp_replace(text, " {2,}", " "), "\n")
    lines = F.filter(F.transform(lines, lambda line: F.trim(line)), lambda line: line != "")
    return F.array_join(lines, "\n")


def html_to_text(column):
    """Readable text of an HTML (or plain) body, one line per block.

    Most mail is plain text; where there is neither a tag nor a reference, only
    blanks are to be tidied. Pass a column, not a costly expression: it is looked
    at more than once.
    """
    plain = F.translate(column, LINE_BREAKS, " " * len(LINE_BREAKS))
    plain = F.trim(F.regexp_replace(plain, " {2,}", " "))
    marked = column.contains("<") | column.contains("&")
    return F.when(marked, _unmarked(column)).otherwise(plain)


def ascii_text(binary):
    """Bytes to text, leaving out every byte above 127."""
    return F.regexp_replace(F.decode(binary, "ISO-8859-1"), r"[^\x00-\x7F]", "")


def sender_domain(column, keep_at=True):
    """The part of an address from ``@`` on; empty when there is none."""
    return F.regexp_extract(column, r"@([^>]+)", 0 if keep_at else 1)


def tokens(column):
    """Distinct lower-case words."""
    words = F.split(F.lower(column), r"[ \t\n\r\f]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def token_overlap(left, right):
    """Shared words over all words of two token arrays, 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / union
    )


def megabytes(column):
    return F.round(column / F.lit(1024 * 1024), 2)


def day_text(column):
    return F.date_format(column, "yyyy-MM-dd")
