"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm import (
    decontaminate, fingerprints, knn, langid, linededup, mixing, neardup, negatives, prefixtrie, quality, shards, unigram,
    wordpieces,
)
from skeinlog.llm.common import crc32_fold, save, scratch, table

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: QueryFunction) -> QueryFunction:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


@query()
def op1_winnowing(spark, sf_dir):
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, "
    "generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents), "
    f"keyed as (select *, {_LOWER.format(f'trim(line, {_SPACES})')} as key from lines), "
    "frequent as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 "
    "group by key having count(distinct doc_id) >= 3), "
    "marked as (select k.*, f.key is not null and k.doc_id <> f.keeper as gone from keyed k left join frequent f using (key)) "
    "select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, "
    "sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 "
    "from marked group by doc_id"
)
def op5_sorted_runs(spark, sf_dir):
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


@query()
def op7_cross_parsing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_fold(F.col("doc_id")) == 0
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rate")


@query(
    "with recursive words as (select doc_id, regexp_extract_all("
    + _LOWER.format("coalesce(text, '')")
    + r""", '[^\x20\x09-\x0D]+') as w from documents),
    sets as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
    sizes as (select doc_id, len(s) as n from sets),
    items as materialized (select doc_id, unnest(s) as g from sets),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from items a join items b using (g)
        where a.doc_id < b.doc_id group by 1, 2),
    links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
        where 100 * c >= 75 * (x.n + y.n - c)),
    both_ways as (select a, b from links union all select b, a from links),
    reach as (select a as doc_id, b as other from both_ways union select r.doc_id, e.b from reach r join both_ways e on r.other = e.a),
    lowest as (select doc_id, min(other) as other from reach group by 1)
    select doc_id, n::bigint as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id,
        doc_id = least(doc_id, coalesce(other, doc_id)) as kept
    from sizes left join lowest using (doc_id)"""
)
def op10_minhash_coordinates(spark, sf_dir):
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    # The operator keeps one row of a group; the contract's flag is about the document id.
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("kept"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


@query(
    "with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings "
    "where vec_id is not null and embedding is not null "
    "and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), "
    "scored as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score "
    "from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0), "
    "ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) "
    "select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5"
)
def op3_voronoi_join(spark, sf_dir):
    return knn.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


@query()
def op9_sampled_splitters(spark, sf_dir):
    found = shards.shard(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op4_quadratic_discriminant(spark, sf_dir):
    rows = save(quality.measured(table(spark, sf_dir, "documents")), scratch(spark), "statistics")
    model = quality.train(quality.with_labels(rows, table(spark, sf_dir, "labels")))
    held_out = crc32_fold(F.col("doc_id")) == 0
    return quality.rate_measured(rows, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op6_longest_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = wordpieces.count_tokens(docs, wordpieces.read_vocabulary())
    return counted.select("doc_id", "n_words", "n_tokens", "n_unknown")


@query()
def op2_temperature_mixing(spark, sf_dir):
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "rows", "n_tokens", "epoch", "block", "position")


@query()
def op8_unigram_viterbi(spark, sf_dir):
    """The round trip of every text: its pieces and what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = unigram.Unigram(*unigram.read_model())
    found = unigram.round_trip(docs, model)
    own = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        (F.col("decoded") == own).alias("round_trip"),
    )


# A conversation id's CRC-32, bit by bit: -1 stands for a shift, other values for a byte.
_CRC32 = (
    "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), "
    "lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda s, x: case when x >= 0 then xor(s, x) when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end), 4294967295)"
)


@query(
    f"""with recursive turns as (select conv_id, row_number() over (partition by conv_id
        order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
        strlen(coalesce(text, ''))::bigint as bytes from conversations where conv_id is not null),
    convs as (select conv_id, conv_id - conv_id % 5 as base, {_CRC32} % 9 as h
        from (select distinct conv_id from turns)),
    whole as (select c.conv_id, t.place, t.id, t.bytes from convs c join turns t on t.conv_id = c.base where t.place <= c.h
        union all select c.conv_id, 1000000000 + t.place, t.id, t.bytes from convs c join turns t on t.conv_id = c.conv_id where t.place > c.h),
    numbered as (select conv_id, id, bytes, row_number() over (partition by conv_id order by place) as d from whole),
    paths as (select conv_id, d, bytes, string_agg(id, '') over (partition by conv_id order by d) as path from numbered
        union all select conv_id, 0, 0, '' from convs),
    lengths as (select conv_id, max(d) as n from paths group by 1),
    nodes as (select path, d, min(p.conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
        sha256(coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (where n = d), '')) as ends_sha256
        from paths p join lengths using (conv_id) group by 1, 2),
    linked as (select k.*, u.conv_id as parent_conv_id, u.path as up from nodes k
        left join nodes u on u.d = k.d - 1 and u.path = left(k.path, 32 * (k.d - 1)::integer)),
    children as (select up, count(*) as n from linked where up is not null group by 1),
    below as (select path as top, path, 0 as steps from nodes union all
        select b.top, l.path, 1 from below b join linked l on l.up = b.path),
    sums as (select b.top, count(*) filter (where c.n is null) as n_leaves, sum((k.n_convs - 1) * k.bytes) as saved
        from below b join nodes k on k.path = b.path left join children c on c.up = b.path group by 1)
    select l.conv_id, l.d::bigint as depth, l.parent_conv_id, l.n_convs, coalesce(c.n, 0) as n_children, s.n_leaves,
        s.saved::bigint as saved_tokens, l.ends_sha256
    from linked l join sums s on s.top = l.path left join children c on c.up = l.path"""
)
def op11_prefix_trie(spark, sf_dir):
    turns = prefixtrie.turn_sequences(table(spark, sf_dir, "conversations"))
    turns = save(turns, scratch(spark), "turns")
    conv_id = F.col("conv_id")
    head = F.crc32(conv_id.cast("string").cast("binary")) % 9
    return prefixtrie.trie(prefixtrie.rebuilt(turns, conv_id - conv_id % 5, head, 8))


@query(
    """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
        where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
        cast(list_dot_product(a.v, c.v) as bigint) as score
        from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
    positives as (select anchor_id, vec_id as positive_id, score as positive_score,
        row_number() over (partition by anchor_id order by score desc, vec_id) as positive_rank from scored where same),
    pairs as (select p.anchor_id, p.positive_id, p.positive_rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.positive_rank order by s.score desc, s.vec_id) as rank
        from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
        where p.positive_rank <= 5 and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
    select anchor_id, positive_id, positive_rank::integer as positive_rank, rank::integer as rank, negative_id,
        positive_score, negative_score from pairs where rank <= 10"""
)
def op12_segment_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.usable(table(spark, sf_dir, "embeddings"), label)
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    f"""with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
    i as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
    wanted as (select distinct item_id, least(10, len(w)) as n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)),
        lambda p: array_to_string(w[p:p + 9], ' '))) as g from i where len(w) > 0),
    places as (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from wanted) where len(w) >= n),
    hits as (select r, p, n, item_id from (select r, p, n, array_to_string(w[p:p + n - 1], ' ') as g from places) join wanted using (n, g)),
    covered as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from hits) group by 1),
    held as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct r, item_id::varchar as item from hits) group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
        sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join covered using (r) left join held using (r)"""
)
def op13_winnowed_passages(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
