"""The registered queries of this subpackage and their SQL."""

from pyspark.sql import functions as F

from mailspark.llm import (
    bpe, exact_dedup, jaccard_join, language, lexical, merkle, neighbours, packing, pii, quality, sharding, suffix_dedup, toxicity,
)
from mailspark.llm.common import table

TOKENIZER = "word_bpe_49k.json"

_REGISTERED = {}


def registered(query):
    _REGISTERED[query.__name__] = query
    return query


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@registered
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@registered
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@registered
def op3_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.links(table(spark, sf_dir, "documents"), 4, 85)


@registered
def op5_pii(spark, sf_dir):
    return pii.spans(table(spark, sf_dir, "documents"))


@registered
def op6_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@registered
def op7_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@registered
def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@registered
def op9_language(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"))


@registered
def op10_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@registered
def op11_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op12_merkle_manifest(spark, sf_dir):
    return merkle.prove(table(spark, sf_dir, "documents"))


@registered
def op13_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def all_queries():
    return dict(_REGISTERED)


def all_oracles():
    return dict(_ORACLES)


def _fields(n_chars):
    parts = ("doc_id", "source", "lang", n_chars, "text")
    return ", ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in parts)


_CASES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

_ORACLES = {
    "op1_exact_dedup": r"""
        with rows as (
            select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as digest
            from documents),
        middle as (select (min(doc_id) + max(doc_id)) // 2 as half from documents)
        select doc_id,
               min(doc_id) over (partition by digest) as keep_id,
               count(*) over (partition by digest) as group_size,
               doc_id = min(doc_id) over (partition by digest) as kept,
               digest as text_sha256,
               min(doc_id) over (partition by digest) <= (select half from middle) as in_history
        from rows
    """,
    "op12_merkle_manifest": f"""
        with recursive
        leaves as (
          select *, coalesce('=' || lang, '') as tree,
            sha256(concat_ws('', {_fields("n_chars")})) as leaf,
            sha256(concat_ws('', {_fields("n_chars + 1")})) as more,
            list_reduce(
              flatten([[4294967295]] || list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
              lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end) as inverted
          from documents),
        placed as (
          select *, case when doc_id is null or n_chars is null or xor(inverted, 4294967295) % 7 <> 0 then leaf else more end as altered,
            row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place
          from leaves),
        nodes as (
          select tree, 0 as level, place, leaf as h, count(*) over (partition by tree) as n from placed
          union all
          select tree, level + 1, place // 2, sha256(h || coalesce(next, '')), (n + 1) // 2
          from (select *, lead(h) over (partition by tree order by place) as next from nodes) where n > 1 and place % 2 = 0),
        subroots as (
          select tree, h as subroot, row_number() over (order by tree) - 1 as place from nodes where n = 1),
        upper as (
          select 0 as level, place, subroot as h, count(*) over () as n from subroots
          union all
          select level + 1, place // 2, sha256(h || coalesce(next, '')), (n + 1) // 2
          from (select *, lead(h) over (order by place) as next from upper) where n > 1 and place % 2 = 0),
        steps as (
          select d.tree, d.place, n.level, (d.place >> n.level) % 2 as on_right, coalesce(s.h, '') as sibling
          from placed d join nodes n on n.tree = d.tree and n.place = d.place >> n.level and n.n > 1
          left join nodes s on s.tree = n.tree and s.level = n.level and s.place = xor(n.place, 1)),
        over_steps as (
          select t.tree, n.level, (t.place >> n.level) % 2 as on_right, coalesce(s.h, '') as sibling
          from subroots t join upper n on n.place = t.place >> n.level and n.n > 1
          left join upper s on s.level = n.level and s.place = xor(n.place, 1)),
        paths as (
          select d.tree, d.place,
            coalesce((select list({{'r': on_right, 's': sibling}} order by level) from steps p where p.tree = d.tree and p.place = d.place), [])
              || coalesce((select list({{'r': on_right, 's': sibling}} order by level) from over_steps o where o.tree = d.tree), []) as path
          from placed d)
        select d.doc_id, d.leaf, t.subroot, u.h as root,
          sha256(array_to_string(list_transform(path, lambda x: x.s), '')) as proof_sha256,
          list_reduce(list_transform(path, lambda x: x), lambda a, x: {{'r': 0, 's': case when x.r = 1 then sha256(x.s || a.s) else sha256(a.s || x.s) end}}, {{'r': cast(0 as bigint), 's': altered}}).s as folded_root,
          folded_root = u.h as verified
        from placed d join paths p on p.tree = d.tree and p.place = d.place
        join subroots t on t.tree = d.tree cross join (select h from upper where n = 1) u
    """,
    "op13_lexical_search": f"""
        with words as (
          select doc_id, row_number() over () as row, unnest(regexp_extract_all(
            translate(text, {_CASES}), '{_TERM}')) as term
          from documents),
        asked as (
          select distinct item_id, unnest(regexp_extract_all(
            translate(text, {_CASES}), '{_TERM}')) as term
          from benchmark),
        sizes as (select row, any_value(doc_id) as doc_id, count(*) as n from words group by row),
        corpus as (select count(*) as docs, cast(sum(n) as bigint) as words from sizes),
        counts as (select row, term, count(*) as tf from words where term in (select term from asked) group by row, term),
        weights as (
          select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w
          from counts cross join corpus group by term, docs),
        scores as (
          select item_id, row, any_value(doc_id) as doc_id, cast(sum(
            w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * c.docs) // c.words)))) as bigint) as score
          from asked join weights using (term) join counts using (term) join sizes using (row) cross join corpus c
          group by item_id, row),
        ranked as (
          select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank
          from scores where score > 0)
        select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50
    """,
}
