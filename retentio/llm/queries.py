"""Registered queries of the operators of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import backoff_lm, decontam, langid, periodic_runs, piece_fst, simhash, simplex_kmeans, substring_dedup, token_files, topk, toxicity, url_filter, warc
from retentio.llm.common import materialise, shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Adds a query under the function's name, with its DuckDB SQL where SQL can express it."""
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@register()
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("removed")


@register("""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
      from v q join v c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5""")
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def digests_of_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives that ``warc.write_archives`` made."""
    page = lambda c: F.try_to_number(F.split(c, ":")[2], F.lit("S" + "9" * 19)).cast("long")
    records = warc.read_archives(spark, path).select(
        "record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"))
    whole = warc.resolved(materialise(records, "warc"))
    return whole.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


@register("""
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, max(page_id) as first from p where strlen(html) >= 1000 group by html),
j as (select p.*, first, first is not null and page_id is distinct from first as back from p left join f using (html))
select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest,
       case when back then 'revisit' else 'response' end as record_type, case when back then first end as refers_to from j""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return digests_of_archives(spark, path)


#: The rules of op4: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


# The SQL follows conventional redirects; the given pages hold no canonical or refresh links,
# which tests/llm/test_url_filter.py covers.
@register(rf"""
with recursive rules(host, path, verdict) as (values {", ".join(map(str, URL_RULES))}),
e as (select distinct url as src, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
        '([?&])(?:utm_[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', ''), '^(?i:https?)://(?i:www\.|m\.)?', 'https://'), '/$', '') as dst from pages where contains(url, '://')),
u as (select src as url from e union select dst from e),
p as (select url, translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
      regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) as path from u),
b as (select url, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(verdict, length(r.host || r.path)) as verdict
      from p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by url),
reach(url, other) as (select url, url from u union select reach.url, case when e.src = other then e.dst else e.src end from reach join e on other in (e.src, e.dst)),
i as (select reach.url, bool_or(verdict = 'allow') as allowed from reach join b on other = b.url group by reach.url)
select page_id, translate(regexp_extract(coalesce(pages.url, ''), '://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
       regexp_extract(coalesce(pages.url, ''), '://([^/?#]*)([^?#]*)', 2) as path, rule,
       coalesce(b.verdict, case when allowed then 'allow' when not allowed then 'block' end, 'allow') as verdict
from pages left join b on pages.url = b.url left join i on pages.url = i.url""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    edges = materialise(url_filter.alias_edges(pages), "edges")  # they are read for the components and for the nodes
    return url_filter.judge(pages, edges, rules)


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
ITEM_WORDS = "coalesce(regexp_extract_all(" + LOWER("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


@register(f"""
with d as (select doc_id, {ITEM_WORDS} as ws from documents),
b as (select item_id, {ITEM_WORDS} as ws from benchmark),
p as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as win
      from b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as r(i) where len(ws) > 0),
dw as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as win
       from d, (select distinct n from p) as sizes, unnest(range(1, len(ws) - n + 2)) as r(i)),
h as (select doc_id, item_id, dw.i, dw.n from dw join p on dw.win = p.win and dw.n = p.n),
hw as (select doc_id, count(distinct w) as n_hit from h, unnest(range(i, i + n)) as r(w) group by doc_id),
hi as (select doc_id, count(distinct item_id) as n_items,
       string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@register()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register()
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.encode(table(spark, sf_dir, "documents"))


@register()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


@register()
def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"))


@register()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, path, with_ids=False).drop("ids")


#: CRC-32 of the decimal digits of doc_id, by its table of 256 remainders.
CRC_TABLE = "list_transform(range(256), lambda r: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), r))"
CRC = ("xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), "
       "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)")


@register(rf"""
with c as materialized (select {CRC_TABLE} as crc_table),
w as (select doc_id, {CRC} as h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents, c),
a as (select doc_id, ws, h % 10 = 0 and len(ws) > 0 as tail, len(ws) as n, (h // 10) % greatest(len(ws), 1) as a,
             1 + (len(ws) - (h // 10) % greatest(len(ws), 1)) // (3 + (h // 10) % 8) as p from w),
d as materialized (select doc_id, n, case when tail then list_transform(range(n), lambda i: ws[1 + case when i < a then i else a + (i - a) % p end]) else ws end as ws from a),
g as materialized (select doc_id, n, i, array_to_string(ws[i + 1:i + 5], ' ') as gram from d, unnest(range(0, n - 4)) as r(i)),
q as (select x.doc_id, y.i - x.i as period, x.i from g x join g y on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i and 4 * (y.i - x.i) <= x.n),
e as (select *, i - row_number() over (partition by doc_id, period order by i) as island from q),
s as (select doc_id, min(i) as start, count(*) + 4 + period as length, period from e group by doc_id, period, island),
t as (select * from s where length >= greatest(6, 4 * period)),
f as materialized (select * from t where not exists (select 1 from t u where u.doc_id = t.doc_id and u.period < t.period and u.start <= t.start and u.start + u.length >= t.start + t.length)),
o as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs,
             first(struct_pack(start, length, period) order by length desc, start, period) as top from f group by doc_id),
x as (select distinct doc_id, i from f, unnest(range(start + period, start + length)) as r(i)),
k as (select d.doc_id, string_agg(ws[r.i + 1], ' ' order by r.i) as kept from d cross join unnest(range(0, n)) as r(i) left join x on x.doc_id = d.doc_id and x.i = r.i
      where x.i is null group by d.doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, top.start as start, top.length as length, top.period as period,
       1000 * top.length // top.period as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join o using (doc_id) left join k using (doc_id)""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents")))
    # the greatest of (length, -start, -period)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def _kmeans_sql(k: int, rounds: int, size: int) -> str:
    """Each round as two tables: the vectors' nearest centroids, and the centroids' floored means."""
    ctes = [f"""e as materialized (select row_number() over () as r, vec_id, sha256('3:' || vec_id) as h,
        list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
        where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
            f"v as materialized (select r, i, v[i] as x from e, unnest(range(1, {size + 1})) as t(i))",
            "s as (select v, row_number() over (order by h, v) - 1 as cluster from e)",
            f"c0 as materialized (select cluster, i, v[i] as c from s, unnest(range(1, {size + 1})) as t(i) where cluster < {k})"]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} as materialized (select r, min((d, cluster)) as best from (
            select r, cluster, sum((x - c) * (x - c))::bigint as d from v join c{n} using (i) group by r, cluster) group by r)""")
        if n < rounds:
            ctes.append(f"""m{n} as (select best[2] as cluster, i, sum(x)::bigint as s, count(*) as n from v join a{n} using (r) group by all),
            c{n + 1} as materialized (select cluster, i, coalesce((s - ((s % n) + n) % n) // n, c)::bigint as c from c{n} left join m{n} using (cluster, i))""")
    ctes.append(f"t as (select cluster, sha256(string_agg(c::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by cluster)")
    return f"""with {", ".join(ctes)}
select vec_id, best[2]::integer as cluster, best[1] as distance, (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia,
       (sum(best[1]) over ())::bigint as inertia, centroid_sha256 from a{rounds} join e using (r) join t on t.cluster = best[2]"""


@register(_kmeans_sql(8, 10, 64))
def op13_simplex_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_kmeans.cluster(table(spark, sf_dir, "embeddings"))
