"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

SHARDS = 24


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    import public_tokenizers

    from quire.llm import packing

    return packing.digests(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op2_language_id(spark, sf_dir):
    from quire.llm import langid

    d = _table(spark, sf_dir, "documents")
    return langid.predict(d, langid.learn(d)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_fingerprints(spark, sf_dir):
    from quire.llm import spotsigs

    return spotsigs.beside_next(_table(spark, sf_dir, "documents"))


def fingerprint_classes(spark, sf_dir):
    from quire.llm import spotsigs

    return spotsigs.classes(_table(spark, sf_dir, "documents"))


def op4_html_text(spark, sf_dir):
    from quire.llm import style_tree

    return style_tree.main_text(_table(spark, sf_dir, "pages"))


def op5_top_k(spark, sf_dir):
    from quire.llm import topk

    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark, sf_dir):
    from quire.llm import mixing

    m = mixing.mix(_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_sharding(spark, sf_dir):
    from quire.llm import sharding

    d = sharding.shard(_table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_role_repair(spark, sf_dir):
    from quire.llm import chat

    return chat.repaired(_table(spark, sf_dir, "conversations"))


def op9_suffix_dedup(spark, sf_dir):
    from quire.llm import suffix_dedup

    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark, sf_dir):
    from quire.llm import ngram_join

    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), 4, 85, 100)


def op11_collocations(spark, sf_dir):
    from quire.llm import collocations

    return collocations.top(collocations.phrases(_table(spark, sf_dir, "documents")), 2000)


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    from quire.llm import align

    return align.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_repair_files(spark, sf_dir):
    import public_tokenizers

    from quire.llm import repair

    return repair.digests(repair.read(*repair.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_packing, op2_language_id, op3_fingerprints, op4_html_text, op5_top_k, op6_mixing, op7_sharding, op8_role_repair, op9_suffix_dedup, op10_ngram_join, op11_collocations, op12_token_alignment, op13_repair_files, pipeline, fingerprint_classes]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    top = """
    with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
               from embeddings where vec_id is not null and embedding is not null
                 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
          from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 10"""
    shards = """
    with c as (select list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
    d as (select doc_id, coalesce(doc_id::varchar, 'null') as key, hex(encode(coalesce(text, ''))) as h from documents),
    m as (select doc_id, length(h) // 2 as n, list_transform(range(0, 25), lambda s: substring(md5(key || '/' || s), 1, 13)) as u,
      xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc from d, c),
    s as (select doc_id, (n + 8)::bigint as size, crc::bigint as text_crc32, u, (list_position(u[1:24], list_max(u[1:24])) - 1)::integer as shard from m)
    select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id, text_crc32) - 1 as slot,
      case when u[25] > list_max(u[1:24]) then 24 else shard end as grown_shard from s"""
    # 200-byte windows of hexadecimal text, cut in pieces of 1,000 first, as long texts are slow to index
    repeats = """
    with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents where doc_id is not null),
    c as (select doc_id, k * 1000 as base, substring(h, 2000 * k + 1, 2398) as s from (select doc_id, h, unnest(range(0, length(h) // 2000 + 1)) as k from d)),
    w as (select doc_id, base + i as pos, md5(substring(s, 2 * i + 1, 400)) as m from (select doc_id, base, s, unnest(range(0, least(1000, length(s) // 2 - 199))) as i from c where length(s) >= 400)),
    r as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by m) as n from w) where n > 1),
    i as (select doc_id, pos, sum(case when pos <= before + 200 then 0 else 1 end) over (partition by doc_id order by pos) as g
          from (select *, coalesce(lag(pos) over (partition by doc_id order by pos), -1000) as before from r)),
    s as (select doc_id, min(pos) as a, max(pos) + 200 as b from i group by doc_id, g),
    k as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, list(a order by a) as starts, list(b order by a) as ends from s group by doc_id)
    select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
      sha256(unhex(case when starts is null then h else array_to_string(list_transform(range(0, len(starts) + 1), lambda j: substring(h, 2 * (case when j = 0 then 0 else ends[j] end) + 1,
        2 * ((case when j = len(starts) then length(h) // 2 else starts[j + 1] end) - (case when j = 0 then 0 else ends[j] end)))), '') end)) as kept_sha256
    from d left join k on d.doc_id = k.doc_id"""
    links = r"""
    with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
    s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
          else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as x from d),
    t as (select doc_id, len(x) as n, unnest(x) as g from s),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as o, any_value(a.n) as na, any_value(b.n) as nb from t a join t b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
    l as (select a, b from p where 100 * o >= 85 * (na + nb - o)),
    r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
    select s.doc_id, len(x)::bigint as n_shingles, least(s.doc_id, coalesce((select min(b) from r where r.a = s.doc_id), s.doc_id)) as component_id from s"""
    phrases = r"""
    with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
    w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
    d as (select lang, w, count(*) as m from w where len(w) > 0 group by lang, w),
    t as (select lang, sum(m * len(w))::bigint as n from d group by lang),
    g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, sum(m)::bigint as f
          from (select lang, w, m, k, unnest(range(1, len(w) - k + 2)) as i from d, (values (1), (2), (3), (4)) v(k)) group by lang, k, phrase having sum(m) >= 30),
    c as (select lang, k, phrase, f, string_split(phrase, ' ') as w from g where k > 1),
    s as (select c.lang, c.phrase, c.f as a, x.f as l, y.f as r, j, (2000000 * c.f::hugeint // (x.f + y.f))::bigint as score
          from (select *, unnest(range(1, k)) as j from c) c
          join g x on x.lang = c.lang and x.phrase = array_to_string(w[1:j], ' ') join g y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1:], ' ')),
    b as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as z from s) where z = 1),
    o as (select lang, array_to_string(w[i:i + z - 1], ' ') as phrase, max(f) as most
          from (select *, unnest(range(1, k - z + 2)) as i from (select *, unnest(range(2, k)) as z from c)) group by 1, 2),
    r as (select b.lang, b.phrase, a, l, r, n, score, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
          from b join t on t.lang = b.lang left join o on o.lang = b.lang and o.phrase = b.phrase where o.most is null or 100 * o.most < 80 * a)
    select lang, rank, phrase, a, l, r, n, score from r where rank <= 2000"""
    return {"op11_collocations": phrases, "op5_top_k": top, "op7_sharding": shards, "op9_suffix_dedup": repeats, "op10_ngram_join": links}
