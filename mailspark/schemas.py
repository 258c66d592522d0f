"""Table schemas. They are fixed: nothing here is inferred from data."""

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BinaryType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


RAW_MESSAGES = _struct(
    ("mbox_file_id", _S), ("path", _S), ("email_start", _L), ("email_end", _L), ("raw", _B)
)

# One entry per MIME part, in walk order; depth 0 is the message itself.
PART = _struct(
    ("depth", _I),
    ("content_type", _S),
    ("filename", _S),
    ("disposition", _S),
    ("is_container", T.BooleanType()),
    ("content", _S),
    ("payload", _B),
    ("problem", _S),
)

PARSED = _struct(
    ("mbox_file_id", _S),
    ("email_start", _L),
    ("email_end", _L),
    ("message_id", _S),
    ("from_email", _S),
    ("to_email", _S),
    ("subject", _S),
    ("date_text", _S),
    ("labels_text", _S),
    ("content_type", _S),
    ("thread_text", _S),
    ("has_attachment", _I),
    ("parts", T.ArrayType(PART)),
    ("problem", _S),
)

ATTACHMENT = _struct(
    ("filename", _S),
    ("content_type", _S),
    ("size_bytes", _L),
    ("content", _B),
    ("content_preview", _B),
)

EMAILS = _struct(
    ("message_id", _S),
    ("subject", _S),
    ("excerpt", _S),
    ("from_email", _S),
    ("to_email", _S),
    ("date", T.TimestampNTZType()),
    ("has_attachment", _I),
    ("labels", T.ArrayType(_S)),
    ("content_type", _S),
    ("mbox_file_id", _S),
    ("email_start", _L),
    ("email_end", _L),
    ("thread_id", _S),
)

EMBEDDINGS = _struct(
    ("message_id", _S), ("mbox_file_id", _S), ("vec", T.ArrayType(T.FloatType()))
)

DOCUMENTS = _struct(("message_id", _S), ("text", _S))
