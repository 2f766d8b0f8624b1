"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import alignment, decontaminate, maincontent, mixing, preference, quality, quantised, simhash, suffixdedup, superkmer, topk, toxicity, whitening
from termloom.llm.tables import table


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixture(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "n_tokens", "weight", "epoch", "place")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = superkmer.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maincontent.main_content(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return rows.select(
        "doc_id",
        (~toxicity.learnable()).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
        "offending",
    )


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference.preference_format(preference.reply_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"], s["length"])), " ")
    return rows.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixdedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.learnable())
    return rows.select(
        "doc_id",
        (~quality.learnable()).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(table(spark, sf_dir, "documents"), groups_as_text=False)
    return rows.withColumnRenamed("groups", "groups_sha256")


def op12_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    # a deviation beyond a long has no place in that column
    return rows.withColumns({"deviation_exact": F.col("deviation"), "deviation": F.col("deviation").try_cast("long")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_main_content": op4_main_content,
    "op5_toxicity": op5_toxicity,
    "op6_preference": op6_preference,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_near_embeddings": op12_near_embeddings,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_top_k": """
        with whole as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
            where embedding is not null
                and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
            from whole q join whole c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
    "op3_substring_dedup": """
        with words as (
            select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents
        ), starts as (
            select doc_id, w, unnest(range(1, len(w) - 11)) as s from words
        ), windows as (
            select doc_id, s, sha256(array_to_string(w[s:s + 12], ' ')) as h from starts
        ), firsts as (
            select h, min(doc_id) as first_doc from windows group by h having min(doc_id) < max(doc_id)
        ), covered as (
            select distinct doc_id, unnest(range(s, s + 13)) as i from windows join firsts using (h) where first_doc < doc_id
        ), places as (
            select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words
        ), kept as (
            select p.doc_id, string_agg(p.word, ' ' order by p.i) as k, count(*) as n
            from places p anti join covered c on p.doc_id = c.doc_id and p.i = c.i group by p.doc_id
        )
        select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(k.n, 0))::bigint as n_removed,
            sha256(coalesce(k.k, '')) as kept_sha256
        from words w left join kept k using (doc_id)
    """,
    "op6_preference": """
        with t as (
            select conv_id, row_number() over (
                partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')
            ) as i, coalesce(role, '') as role, coalesce(text, '') as text
            from conversations where conv_id is not null
        ), last as (
            select conv_id, max(i) as spot from t where role = 'assistant' group by conv_id
        ), pairs as (
            select l.conv_id, l.spot, r.text as reply
            from last l join last o on o.conv_id = xor(l.conv_id, 1) join t r on r.conv_id = o.conv_id and r.i = o.spot
        ), sides as (
            select 'c' as side, conv_id, i, role, text from t join pairs using (conv_id)
            union all
            select 'r', conv_id, i, role, text from t join pairs using (conv_id) where i < spot
            union all
            select 'r', conv_id, spot, 'assistant', reply from pairs
        ), same as (
            select conv_id, i from sides group by conv_id, i
            having count(*) = 2 and min(role) = max(role) and min(text) = max(text)
        ), sizes as (
            select conv_id, max(i) as n from sides group by conv_id
        ), common as (
            select p.conv_id, coalesce(min(s.i), max(z.n) + 1) - 1 as n_common
            from pairs p join sizes z using (conv_id) left join (
                select distinct conv_id, i from sides anti join same using (conv_id, i)
            ) s using (conv_id) group by p.conv_id
        ), shown as (
            select side, conv_id, i, role, i <= n_common as shared,
                '<|im_start|>' || role || chr(10)
                || regexp_replace(text, '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') || '<|im_end|>' || chr(10) as s
            from sides join common using (conv_id)
        ), placed as (
            select *, coalesce(sum(length(s)) over (
                partition by side, conv_id, shared order by i rows between unbounded preceding and 1 preceding
            ), 0) + 12 + length(role) + 1 as start, length(s) - 12 - length(role) - 2 as size from shown
        ), texts as (
            select conv_id, side, coalesce(string_agg(s, '' order by i) filter (where shared), '') as prompt,
                coalesce(string_agg(s, '' order by i) filter (where not shared), '') as rest,
                coalesce(string_agg(start::bigint || '+' || size, ' ' order by i)
                    filter (where not shared and role = 'assistant'), '') as mask
            from placed group by conv_id, side
        )
        select c.conv_id, n_common::int as n_common, c.prompt, c.rest as chosen, r.rest as rejected,
            c.mask as chosen_mask, r.mask as rejected_mask
        from texts c join texts r using (conv_id) join common using (conv_id) where c.side = 'c' and r.side = 'r'
    """,
    "op7_suffix_dedup": """
        with texts as (
            select doc_id, hex(encode(coalesce(text, ''))) as h from documents
        ), cut as (
            select doc_id, part, substr(h, 1000 * part + 1, 1198) as piece
            from (select *, unnest(range(0, len(h) // 1000 + 1)) as part from texts)
        ), strings as (
            select doc_id, 500 * part + s as s, md5_number(substr(piece, 2 * s - 1, 200)) as k
            from (select *, unnest(range(1, least(501, len(piece) // 2 - 98))) as s from cut)
        ), firsts as (
            select k, min({'doc': doc_id, 'at': s}) as f from strings group by k having count(*) > 1
        ), again as (
            select doc_id, s from strings join firsts using (k) where doc_id <> f.doc or s <> f.at
        ), edges as (
            select *, s > lag(s, 1, -1000) over (partition by doc_id order by s) + 100 as new from again
        ), numbered as (
            select *, sum(new::int) over (partition by doc_id order by s) as span from edges
        ), spans as (
            select doc_id, min(s) as a, max(s) + 100 as b from numbered group by doc_id, span
        ), pieces as (
            select doc_id, lag(b, 1, 1) over (partition by doc_id order by a) as a, a as b from spans
            union all
            select doc_id, coalesce(max(b), 1), any_value(len(h)) // 2 + 1 from texts left join spans using (doc_id) group by doc_id
        ), kept as (
            select doc_id, string_agg(substr(h, 2 * a - 1, 2 * (b - a)), '' order by a) as kept, sum(b - a) as n, count(*) as n_pieces
            from pieces join texts using (doc_id) group by doc_id
        )
        select doc_id, (len(h) // 2)::bigint as n_bytes, (len(h) // 2 - n)::bigint as n_removed,
            (n_pieces - 1)::bigint as n_spans, sha256(unhex(kept)) as kept_sha256
        from texts join kept using (doc_id)
    """,
    "op12_near_embeddings": """
        with recursive usable as (
            select vec_id, embedding::double[] as v from embeddings
            where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
                and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id
            where list_cosine_similarity(a.v, b.v) >= 0.95
        ), reached as (
            select vec_id as a, vec_id as b from embeddings
            union
            select r.a, l.b from reached r join links l on l.a = r.b
        ), least as (
            select a, min(b) as component_id from reached group by a
        )
        select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, l.component_id,
            e.vec_id = l.component_id as kept
        from embeddings e join least l on l.a = e.vec_id
    """,
}
