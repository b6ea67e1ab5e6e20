"""The registered queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, bpe, exact_dedup, fill_in_middle, fingerprints, html_text, licenses, lm_scoring, mixing, near_dedup, suffix_dedup, token_counts, toxicity
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.best_license(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit_labels(docs, labels)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position", "position_again")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("word_bpe_49k.json")
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), path, token_counts.shared_cache(spark, path))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken")).withColumnRenamed("id", "doc_id")


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.round_trip(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_license_scan, op2_html_extraction, op3_toxicity, op4_mixing, op5_suffix_dedup, op6_token_counts, op7_fingerprints, op8_exact_dedup, op9_byte_bpe, op10_near_dedup, op11_lm_scoring, op12_ball_kmeans, op13_fill_in_middle, pipeline]
    return {f.__name__: f for f in own}


def _license_sql() -> str:
    rows = ", ".join(f"('{i}', {len(b)}, [{', '.join(repr(x) for x in b)}])" for i, b in licenses.table())
    t = licenses.THRESHOLD
    return rf"""
with templates(license, m, grams) as (values {rows}),
texts as (select doc_id, coalesce(text, '') as text from documents),
paragraphs as (select doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) as unit from texts),
units as (
  select doc_id, unnest(string_split(text, chr(10))) as unit from texts
  union all select doc_id, unit from paragraphs where contains(unit, chr(10))
  union all select doc_id, text from texts where regexp_matches(text, '\n[ \t\r]*\n')),
numbered as (select row_number() over () as u, doc_id, list_filter(string_split(lower(regexp_replace(unit, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x != '') as w from units),
grams as (select u, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from numbered where len(w) > 1),
each as (select u, doc_id, len(b) as n, unnest(b) as g from grams),
known as (select license, m, row_number() over () as t, grams from templates),
tg as (select license, m, t, unnest(grams) as g from known),
scored as (
  select u, doc_id, license, 2.0::double * count(*) / (n + m) as score
  from each join tg using (g) where 2.0::double * least(n, m) / (n + m) >= {t}
  group by u, doc_id, n, license, m, t having 2.0::double * count(*) / (n + m) >= {t}),
best as (select u, doc_id, license, score from scored qualify row_number() over (partition by u order by score desc, license) = 1),
per as (select doc_id, count(*) as matches, max(score) as score, arg_min(license, (-score, license)) as license from best group by doc_id)
select d.doc_id, p.license, coalesce(p.score, 0.0::double) as score, coalesce(p.matches, 0)::bigint as matches
from documents d left join per p using (doc_id)"""


_EXACT_SQL = r"""
with rows as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
ranked as (select doc_id, norm, first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from rows)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from ranked"""


_MIDDLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents),
c as (select *, least(('0x' || substr(h, 1, 8))::bigint % (n + 1), ('0x' || substr(h, 9, 8))::bigint % (n + 1)) as a, greatest(('0x' || substr(h, 1, 8))::bigint % (n + 1), ('0x' || substr(h, 9, 8))::bigint % (n + 1)) as b,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain' when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from t),
p as (select *, text[1:a] as pre, text[a + 1:b] as mid, text[b + 1:n] as suf from c),
o as (select *, case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end as output from p),
r as (select *, string_split_regex(output, '<[PSM]>') as x from o)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars, sha256(output) as output_sha256,
  sha256(case form when 'plain' then output when 'psm' then x[2] || x[4] || x[3] else x[3] || x[4] || x[2] end) as restored_sha256 from r"""


def _kmeans_sql(rounds: int = 5) -> str:
    parts = [
        "v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e, sha256('2:' || vec_id) as h from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "c0 as materialized (select row_number() over (order by h) - 1 as k, e as c from v order by h limit 40)",
    ]
    for r in range(rounds + 1):
        near = f"select vec_id, e, k, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{r}"
        parts.append(f"a{r} as materialized (select vec_id, any_value(e) as e, arg_min(k, (d, k)) as k, min(d) as d from ({near}) group by vec_id)")
        if r < rounds:
            parts.append(f"s{r} as (select k, i, sum(x)::bigint as s, count(*) as n from (select k, unnest(e) as x, generate_subscripts(e, 1) as i from a{r}) group by k, i)")
            moved = f"select k, list((s - ((s % n) + n) % n) // n order by i) as c from s{r} group by k"
            parts.append(f"c{r + 1} as materialized (select k, coalesce(m.c, o.c) as c from c{r} o left join ({moved}) m using (k))")
    last = f"select vec_id, k::integer as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (k)"
    return f"with {', '.join(parts)} {last}"


def oracle_sql() -> dict[str, str]:
    out = {"op1_license_scan": _license_sql(), "op8_exact_dedup": _EXACT_SQL, "op12_ball_kmeans": _kmeans_sql(), "op13_fill_in_middle": _MIDDLE_SQL}
    return out
