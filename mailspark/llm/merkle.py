"""A Merkle manifest of a table: a tree of hashes over each language's documents, and one over these trees.

Leaves are numbered by range partitions in order of (language, doc_id, leaf), so a language that holds most
rows lies in many tasks. Aligned blocks of nodes keep every level as one string of hex digests: a parent
is the hash of a fixed-width substring of two digests, a sibling is the flanking substring, and a block's root
becomes a node of the tier above, until a language has one block. The languages' roots are nodes of one more
tree, built alike. Paths are then completed from the top down, block by block. All of it is SQL.

Defined results: a null field is `-` in a leaf, and a null language a tree of its own, the first one. Rows
without an id come first in their language; rows with equal ids are ordered by their leaves, and rows that are
equal in full stand side by side. A lone node at the end of a level is hashed alone; a language of one document
has its leaf as root, and a table of one language its root as the whole root. An empty table gives no rows.
Columns besides the five hashed ones are not looked at.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailspark.llm.common import written

#: Nodes in a block: two to the power of BITS.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every so-manieth document by checksum of its id is read with one character more than it has.
TAMPER = 7


def _levels(bits):
    """The levels of a block from its nodes up, each one string of hex digests; `height` tells how many follow."""
    return f"""aggregate(
        slice(sequence(1, {bits}), 1, height),
        array(cast(array_join(transform(members, m -> m.digest), '') as binary)),
        (levels, j) -> concat(levels, transform(array(element_at(levels, -1)), last -> cast(array_join(transform(
            sequence(0, (octet_length(last) - 1) div 128), i -> sha2(substring(last, i * 128 + 1, 128), 256)
        ), '') as binary))))"""


def _nodes(bits):
    """Position, payload, digest and path of each node of a block; siblings are the substrings beside a node's own."""
    return f"""element_at(transform(array({_levels(bits)}), levels -> transform(members, (m, p) -> named_struct(
        'pos', m.pos, 'payload', m.payload, 'digest', m.digest, 'path', concat(
            transform(slice(sequence(0, {bits - 1}), 1, height), j -> named_struct(
                'on_the_left', (shiftright(p, j) & 1) = 1,
                'sibling', cast(substring(levels[j], (shiftright(p, j) ^ 1) * 64 + 1, 64) as string))),
            above)))), 1)"""


_PATH = "array<struct<on_the_left: boolean, sibling: string>>"


def _field(column):
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(n_chars=None):
    """The digest of a row; ``n_chars`` replaces the column of that name."""
    values = [n_chars if name == "n_chars" and n_chars is not None else F.col(name) for name in FIELDS]
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def positions(rows, key, order):
    """Rows with ``pos``, their number from 0 within ``key`` by ``order``, and ``n``, the key's number of rows."""
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ordered = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    # one row for each key and partition
    runs = ordered.groupBy(key, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        key, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(whole).alias("n"),
    )
    found = ordered.join(runs, [key, "_part"])
    return found.withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_start")


def _blocks(nodes, bits):
    """(key, block, n, height, members) of nodes (key, pos, n, digest, payload)."""
    member = F.struct("pos", "digest", "payload")
    held = nodes.groupBy("key", F.shiftright("pos", bits).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members")
    )
    levels = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    return held.withColumn("height", F.least(levels, F.lit(bits)))


def tiers(nodes, bits):
    """The blocks of every tier over nodes (key, pos, n, digest, payload), and (key, digest) of the roots."""
    found = []
    while True:
        blocks = written(_blocks(nodes, bits), "blocks")
        found.append(blocks)
        roots = written(
            blocks.select("key", "block", "n", F.expr(f"cast(element_at({_levels(bits)}, -1) as string)").alias("digest")), "roots"
        )
        if roots.filter(F.col("n") > 1 << bits).isEmpty():
            return found, roots.select("key", "digest")
        nodes = roots.select(
            "key", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << bits)).alias("n"), "digest",
            F.lit(None).cast("string").alias("payload"),
        )


def descend(found, above, bits):
    """The nodes of the lowest tier with their paths to the root.

    ``above`` (key, block, above, subroot, root) holds what follows the roots of the highest tier.
    """
    for i, blocks in enumerate(reversed(found)):
        nodes = blocks.join(above, ["key", "block"]).select("key", "subroot", "root", F.expr(f"inline({_nodes(bits)})"))
        if i + 1 < len(found):
            above = nodes.select("key", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot", "root")
    return nodes


def manifest(docs, bits=BITS):
    """(doc_id, pos, leaf, changed, path, subroot, root): each row's place in its language, its digest, the
    digest of its altered copy where it has one, and the siblings on its way up."""
    altered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        # languages in order of their bytes, null before all others
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"),
        "doc_id",
        leaf().alias("digest"),
        F.when(altered, leaf(F.col("n_chars") + 1)).alias("changed"),
    )
    rows = positions(written(leaves, "leaves"), "key", ["doc_id", "digest"])
    found, subroots = tiers(rows.select("key", "pos", "n", "digest", F.struct("doc_id", "changed").alias("payload")), bits)
    subroots = written(subroots, "subroots")
    languages = positions(subroots.select(F.lit("").alias("key"), F.col("key").alias("payload"), "digest"), "key", ["payload"])
    top, root = tiers(languages, bits)
    over = root.select(
        "key", F.lit(0).cast("long").alias("block"), F.expr(f"cast(array() as {_PATH})").alias("above"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    above = written(
        descend(top, over, bits).select(
            F.col("payload").alias("key"), F.lit(0).cast("long").alias("block"), F.col("path").alias("above"),
            F.col("digest").alias("subroot"), "root",
        ),
        "above",
    )
    return descend(found, above, bits).select(
        "payload.doc_id", "pos", F.col("digest").alias("leaf"), "payload.changed", "path", "subroot", "root"
    )


def verified(rows):
    """Rows of a manifest with the digest of their siblings and the root that the altered row leads to."""
    siblings = F.array_join(F.transform("path", lambda s: s["sibling"]), "")
    up = F.aggregate(
        "path",
        F.coalesce("changed", "leaf"),
        lambda a, s: F.sha2(
            F.when(s["on_the_left"], F.concat(s["sibling"], a)).otherwise(F.concat(a, s["sibling"])), 256
        ),
    )
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), up.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def prove(docs):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document."""
    return verified(manifest(docs))
