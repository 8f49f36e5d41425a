"""One registered query per operator, over its whole table, and the SQL it is checked against."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barometry.llm import (
    audit, bpe, chat, fingerprints, infill, jaccard, language, licenses, lines, mixing, pieces, quality, secrets,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/documents.parquet")
    return table.select(*columns) if columns else table


def hex_digest(column):
    return F.sha2(column, 256)


@query
def op7_bpe(spark, folder):
    encoded = bpe.encode(documents(spark, folder, "doc_id", "text"), RANKS)
    # The text is not needed any more: only the ids go through the second pass.
    decoded = bpe.decode(encoded.select("doc_id", "n_tokens", "ids"), RANKS)
    return decoded.select("doc_id", "n_tokens", hex_digest("ids").alias("ids_sha256"),
                          hex_digest("decoded").alias("decoded_sha256"))


@query
def op1_license_scan(spark, folder):
    return licenses.license_scan(documents(spark, folder, "doc_id", "text"), drop=("text",))


@query
def op10_quality_rules(spark, folder):
    judged = quality.quality(documents(spark, folder, "doc_id", "text"), drop=("text",))
    return judged.withColumn("cleaned_sha256", hex_digest("cleaned")).drop("cleaned")


@query
def op3_line_dedup(spark, folder):
    cleaned = lines.line_dedup(documents(spark, folder, "doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "removed", hex_digest("text").alias("text_sha256"))


ORACLES["op3_line_dedup"] = r"""
with l as (
    select doc_id, string_split(text, chr(10)) as ls from documents
), w as (
    select doc_id, unnest(range(len(ls) - 2)) as pos, ls from l where len(ls) >= 3
), v as (
    select doc_id, pos, ls[pos + 1] as a, ls[pos + 2] as b, ls[pos + 3] as c from w
), r as (
    select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as nth
    from v where not (a = '' and b = '' and c = '')
), g as (
    select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as line from r where nth > 1
), s as (
    select doc_id, line, line - row_number() over (partition by doc_id order by line) as island from g
), p as (
    select doc_id, min(line) as first_line, max(line) as last_line, count(*) as n from s group by doc_id, island
), q as (
    select doc_id, sum(n)::bigint as n_removed,
           string_agg(first_line || '-' || last_line, ',' order by first_line) as removed
    from p group by doc_id
), k as (
    select e.doc_id, string_agg(e.line, chr(10) order by e.at) as kept
    from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as at from l) e
    left join g on g.doc_id = e.doc_id and g.line = e.at where g.doc_id is null group by e.doc_id
)
select l.doc_id, len(l.ls) as n_lines, coalesce(q.n_removed, 0) as n_removed, coalesce(q.removed, '') as removed,
       sha256(coalesce(k.kept, '')) as text_sha256
from l left join q using (doc_id) left join k using (doc_id)
"""


@query
def op5_chat_format(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(probe).alias("text"))
    rows = turns.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    made = chat.format_chats(rows).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        hex_digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
                   ).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), hex_digest("loss").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "attachment_tokens")


ORACLES["op5_chat_format"] = r"""
with t as (
    select conv_id, turn, role, text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
           length(regexp_replace(coalesce(role, ''), '([<\[])(\\*)(/?(s>|INST\])|\|)', '\1\\\2\3', 'g')) as role_chars,
           length(regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?(s>|INST\])|\|)', '\1\\\2\3', 'g')) as body_chars
    from t
), s as (
    select conv_id, count(*) as n_turns,
           string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
           coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
           sum(3 + role_chars + 7 + body_chars + 12)::bigint as formatted_chars
    from e group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       formatted_chars, 0::bigint as n_attachments, 0::bigint as attachment_tokens
from s
"""

# Every source is to have the same share, however large it is.
MIX_WEIGHTS = {f"src{i}": 1.0 for i in range(20)}
MIX_REST = 1.0


@query
def op6_mix_sources(spark, folder):
    mixed = mixing.mix(documents(spark, folder), MIX_WEIGHTS, MIX_REST)
    return mixed.select("doc_id", "copy", "source", "shuffle_key", "text")


ORACLES["op6_mix_sources"] = r"""
with d as (
    select *, case when source in ({sources}) then source end as g from documents
), have as (
    select g, sum(length(text)) as n from d group by g having sum(length(text)) > 0
), rate as (
    select g, (select sum(n) from have) * 1.0::double / (select count(*) from have) / n as r from have
), terms as (
    select g, k, exp(-r + sum(case when k = 0 then 0 else ln(r / k) end) over (partition by g order by k)) as p
    from rate, (select unnest(range(400)) as k)
), cdf as (
    select g, list(c order by k) as cs
    from (select g, k, sum(p) over (partition by g order by k) as c from terms) group by g
), u as (
    select d.*, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::bigint / 4503599627370496.0::double as u from d
), n as (
    select u.*, len(list_filter(cs, lambda c: c <= u)) as n from u join cdf on u.g is not distinct from cdf.g
), e as (
    select doc_id, source, text, unnest(range(1, n + 1)) as copy from n
)
select doc_id, copy, source, ('0x' || substr(md5('mix:order:' || doc_id || ':' || copy), 1, 15))::bigint as shuffle_key, text
from e
""".replace("{sources}", ", ".join(f"'{s}'" for s in MIX_WEIGHTS))


@query
def op4_fingerprints(spark, folder):
    docs = documents(spark, folder, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    paired = fingerprints.with_next(docs, {"next_text": "text", "next_sketch": "sketch"}, fingerprints.with_sketch)
    n = F.length("text")
    changed = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - changed), F.substring(F.col("next_text"), F.lit(1), changed))
    both = fingerprints.with_sketch(paired.withColumn("edited", edited), "edited", "edited_sketch")
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), hex_digest("edited").alias("edited_sha256"),
        fingerprints.fingerprint(own).alias("fingerprint"), fingerprints.fingerprint(other).alias("edited_fingerprint"),
        fingerprints.resemblance(own, other).alias("near_edited"), fingerprints.resemblance(own, following).alias("near_next"),
        fingerprints.containment(own, other).alias("contained_edited"),
        fingerprints.distinct_shingles(own).alias("n_shingles"))


@query
def op2_secret_scan(spark, folder):
    found = secrets.secret_scan(documents(spark, folder, "doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id", *[secrets.count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        hex_digest(secrets.span_text(base)).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


@query
def op8_jaccard_join(spark, folder):
    return jaccard.jaccard_join(documents(spark, folder, "doc_id", "text"), width=3, percent=90)


ORACLES["op8_jaccard_join"] = r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
    from documents
), s as (
    select distinct doc_id, unnest(case when len(ws) >= 3
        then [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g
    from w
), n as (
    select doc_id, count(*) as n from s group by doc_id
), pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)
), edges as (
    select a, b from links union all select b, a from links
), reach(doc_id, other) as (
    select a, b from edges
    union select reach.doc_id, edges.b from reach join edges on reach.other = edges.a
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(min(other), w.doc_id)) as component_id
from w left join n using (doc_id) left join reach using (doc_id) group by w.doc_id, n.n
"""


@query
def op9_language_id(spark, folder):
    found = language.language_id(documents(spark, folder, "doc_id", "text", "lang", "source"), declared="lang", host="source",
                                 keep_text=False)
    return found.select("doc_id", F.col("lang").alias("declared"), "text_language", "language",
                        F.round("confidence", 6).alias("confidence"), F.col("language_kept").alias("kept"))


@query
def op11_sentencepiece(spark, folder):
    encoded = pieces.encode(documents(spark, folder, "doc_id", "text"), PIECES, drop=("text",))
    made = pieces.decode(encoded, PIECES)
    return made.select("doc_id", "n_tokens", hex_digest(pieces.id_text(F.col("ids"))).alias("ids_sha256"),
                       hex_digest("decoded").alias("decoded_sha256"))


@query
def op12_filter_audit(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit.filter_audit(audit.file_stream(spark, f"{folder}/documents.parquet"), labels)


ORACLES["op12_filter_audit"] = r"""
with recursive letters(l, i) as (
    values ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)
), orders(o, mask) as (
    select '', 0
    union all select o || l, mask | (1 << i) from orders, letters where mask & (1 << i) = 0
), steps as (
    select o as filter_order, step, substr(o, step, 1) as f,
           list_sum([0] || [1 << (ord(substr(o, k, 1)) - 65) for k in range(1, step)])::int as earlier,
           1 << (ord(substr(o, step, 1)) - 65) as own
    from orders, (select unnest(range(1, 6)) as step) where length(o) = 5
), d as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), w as (
    select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
           coalesce(min(doc_id) over (partition by t) < doc_id, false) as copy
    from d
), g as (
    select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id
), m as (
    select part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int
           + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
           + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * copy::int as mask,
           coalesce(good, false)::int as good, coalesce(toxic, false)::int as toxic
    from w left join g using (doc_id)
), c as (
    select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask
), x as (
    select part, filter_order, step, f, n, good, toxic, mask & own <> 0 as fails, mask & earlier <> 0 as gone,
           mask & (own | earlier) = 0 as kept, mask = own as only_it
    from c, steps
), r as (
    select part, filter_order, step, f, sum(if(kept, n, 0))::bigint as kept, sum(if(fails and not gone, n, 0))::bigint as removed,
           sum(if(fails and gone, n, 0))::bigint as redundant, sum(if(only_it, n, 0))::bigint as unique_fails,
           sum(if(fails and not gone, good, 0))::bigint as good_lost, sum(if(fails and not gone, toxic, 0))::bigint as toxic_lost
    from x group by part, filter_order, step, f
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, f))::bigint as shapley
from r
"""


@query
def op13_fill_in_middle(spark, folder):
    made = infill.fill_in_middle(documents(spark, folder, "doc_id", "text"), drop=("text",))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                       hex_digest("infill").alias("output_sha256"),
                       hex_digest(infill.restored(F.col("infill"), F.col("form"))).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = r"""
with d as (
    select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), u as (
    select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as us, ('0x' || substr(h, 1, 8))::bigint as h1,
           ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
    from d
), c as (
    select *, len(us) as n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as b,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from u
), p as (
    select *, array_to_string(us[1:a], '') as pre, array_to_string(us[a + 1:b], '') as mid, array_to_string(us[b + 1:], '') as suf from c
)
select doc_id, n, form, if(form = 'plain', null, length(pre)) as prefix_chars, if(form = 'plain', null, length(mid)) as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p
"""
