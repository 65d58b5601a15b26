"""The queries of the thirteen operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text left after 50-byte strings that start in a smaller id."""
    from .suffix_dedup import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each text; the list is learned from the quality labels."""
    from .quality_rules import judge

    out = judge(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of near equal bytes."""
    from .sharding import shards_by_bytes

    out = shards_by_bytes(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@_query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page, with block decisions passed on to aliases."""
    from .url_filters import judge

    return judge(_read(spark, sf_dir, "pages"), URL_RULES)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op8_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


@_query
def op10_elias_fano_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie, read back from the written files."""
    from .token_store import read, write

    return read(write(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


@_query
def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without sentences of repeated spans."""
    from .sentence_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of each pair of conversations."""
    from .chat_format import pairs_by_parity, preference_pairs

    return preference_pairs(pairs_by_parity(_read(spark, sf_dir, "conversations")))


ORACLES["op5_chat_format"] = """
with t as (
  select floor(conv_id / 2)::bigint pair_id, conv_id % 2 = 0 is_chosen, conv_id, replace(coalesce(role, 'unknown'), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) k
  from conversations where conv_id is not null),
p as (
  select pair_id, min(conv_id) filter (is_chosen) chosen_id, min(conv_id) filter (not is_chosen) rejected_id,
         count(*) filter (is_chosen) nc, count(*) filter (not is_chosen) nr
  from t group by pair_id having nc > 0 and nr > 0),
d as (
  select c.pair_id, min(c.k) k from t c join t r on c.pair_id = r.pair_id and c.k = r.k and c.is_chosen and not r.is_chosen
  where c.role <> r.role or c.text <> r.text group by c.pair_id),
n as (select p.*, coalesce(d.k - 1, least(nc, nr)) n from p left join d using (pair_id)),
x as (
  select n.pair_id, n.n, t.is_chosen, t.k, t.role, t.text, '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) s,
         sum(case when t.k > n.n then length(t.role) + length(t.text) + 13 else 0 end) over (partition by t.pair_id, t.is_chosen order by t.k) e
  from t join n using (pair_id)),
g as (
  select pair_id,
         coalesce(string_agg(s, '' order by k) filter (is_chosen and k <= n), '') prompt,
         coalesce(string_agg(s, '' order by k) filter (is_chosen and k > n), '') chosen,
         coalesce(string_agg(s, '' order by k) filter (not is_chosen and k > n), '') rejected,
         coalesce(string_agg((e - length(text) - 8)::bigint || ':' || e::bigint, ',' order by k) filter (is_chosen and k > n and role = 'assistant'), '') chosen_loss,
         coalesce(string_agg((e - length(text) - 8)::bigint || ':' || e::bigint, ',' order by k) filter (not is_chosen and k > n and role = 'assistant'), '') rejected_loss
  from x group by pair_id)
select n.pair_id, n.chosen_id, n.rejected_id, n.n::int n_prompt_turns, g.prompt, g.chosen, g.rejected, g.chosen_loss, g.rejected_loss
from n join g using (pair_id)
"""


@_query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles are 85 % alike."""
    from .jaccard_join import classes

    return classes(_read(spark, sf_dir, "documents"), words=4, percent=85)


@_query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of test items in documents, with their alignment."""
    from .decontamination import matches

    return matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


ORACLES["op2_jaccard_join"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (
  select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from w),
e as (select doc_id, unnest(s) g from s),
p as (select a.doc_id x, b.doc_id y, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join s a on a.doc_id = x join s b on b.doc_id = y where 100 * c >= 85 * (len(a.s) + len(b.s) - c)),
u as (select x, y from l union all select y, x from l),
r(doc_id, m) as (select doc_id, doc_id from s union select u.y, r.m from r join u on u.x = r.doc_id)
select s.doc_id, len(s.s)::bigint n_shingles, min(m)::bigint component_id from s join r using (doc_id) group by s.doc_id, s.s
"""

_NORMAL_SQL = r"""
case when {h} <> '' then regexp_replace({h}, '^www\.|:(80|443)$', '') || regexp_replace({p}, '(/|/index\.html?|\.html?)$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(split_part({u}, '#', 1), '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+)(=|$)'))), '&'), ''), '') end"""
_HOST_SQL = "coalesce(translate(regexp_extract({r}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH_SQL = "coalesce(regexp_extract({r}, '^[^/?#]*([^?#]*)', 1), '')"
_REST_SQL = "(case when instr({u}, '://') > 0 then substr({u}, instr({u}, '://') + 3) else '' end)"


def _url_sql(u: str) -> tuple[str, str, str]:
    r = _REST_SQL.format(u=u)
    h, p = _HOST_SQL.format(r=r), _PATH_SQL.format(r=r)
    return h, p, _NORMAL_SQL.format(h=h, p=p, u=u)


_RULES_SQL = " ".join(
    f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{h}{p} {v}'" for h, p, v in sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), r))
)
ORACLES["op6_url_filters"] = rf"""
with recursive a as (select page_id, url, html, {_url_sql('url')[0]} host, {_url_sql('url')[1]} path, {_url_sql('url')[2]} k from pages),
j as (select *, case {_RULES_SQL} end hit from a),
tags as (select url, host, path, k, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*\b(?:rel\s*=\s*["'']?canonical\b|http-equiv\s*=\s*["'']?refresh\b)[^>]*>')) tag from a where url is not null),
t0 as (select host, path, k, coalesce(nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), ''), nullif(regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1), '')) t from tags),
tb as (select *, regexp_replace(path, '[^/]*$', '') || case when contains(path, '/') then '' else '/' end || regexp_extract(t, '^[^?#]*', 0) f, regexp_extract(t, '^[^?#]*(.*)$', 1) q from t0),
td as (select *, list_reduce(string_split(f, '/'), lambda a, x: case when x = '..' and instr(a, '/') > 0 then regexp_replace(a, '/[^/]*$', '') when x in ('.', '..') then a else a || '/' || x end) || case when regexp_matches(f, '(^|/)\.\.?$') then '/' else '' end g from tb),
t1 as (select k, case when contains(t, '://') then t when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') then 'http://' || host || t
  when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') or starts_with(t, '#') then null when starts_with(t, '?') then 'http://' || host || path || t else 'http://' || host || g || q end u from td),
t2 as (select k x, {_url_sql('u')[2]} y from t1),
u as (select x, y from t2 where x <> y union all select y, x from t2 where x <> y),
r(k, m) as (select k, k from j where k is not null union select u.y, r.m from r join u on u.x = r.k),
c as (select k, min(m) comp from r group by 1),
d as (select comp, bool_or(hit like '% allow') ok, bool_or(hit like '% block') no from j join c using (k) where hit is not null group by 1)
select page_id, host, path, split_part(hit, ' ', 1) rule, case when hit is not null then split_part(hit, ' ', 2) when ok then 'allow' when no then 'block' else 'allow' end verdict
from j left join c using (k) left join d using (comp)
"""


@_query
def op11_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each test item."""
    from .lexical_search import build, search

    return search(build(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"), 20)


ORACLES["op11_wavelet_search"] = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from (select distinct item_id, text from benchmark)),
a as (select count(*) n, sum(len(w))::bigint l from d where len(w) > 0),
p as (select r, doc_id, t, count(*) tf, any_value(m) m from (select r, doc_id, unnest(w) t, 75 + (25 * len(w)::bigint * n) // l m from d, a where len(w) > 0) group by 1, 2, 3),
f as (select t, count(*) df from p group by 1),
q as (select item_id, i.t, count(*) c, floor(1000 * ln((2.0::double * any_value(n) + 2) / (2 * any_value(df) + 1)))::bigint w from i join f using (t), a group by 1, 2),
s as (select item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score from q join p using (t) group by 1, 2, 3 having score > 0)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s qualify rank <= 20
"""


@_query
def op12_heap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 16 parts of each vector, with the errors that they leave."""
    from .vector_codes import digest_of, encode, with_label_errors

    coded, books = encode(_read(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _lloyd_sql() -> str:
    assign = "select vec_id, p, arg_min(e, (list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) e from s join b{0} using (p) group by 1, 2"
    update = "select p, e, case when x is null then y else x end y from b{0} left join (select p, e, list(m order by j) x from (select p, e, j, floor(sum(v)::double / count(*))::bigint m from a{0} join s using (vec_id, p), unnest(range(len(x))) u(j), unnest([x[j + 1]]) w(v) group by 1, 2, 3) group by 1, 2) using (p, e)"
    steps = ", ".join(f"a{r} as materialized ({assign.format(r)}), b{r + 1} as materialized ({update.format(r)})" for r in range(2))
    return f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] x from k, range(16) r(p)),
b0 as materialized (select p, e, x y from s join (select vec_id, row_number() over (order by vec_id) - 1 e from k qualify e < 64) using (vec_id)), {steps}, a2 as materialized ({assign.format(2)}),
c as (select vec_id, string_agg(printf('%02x', e), '' order by p) code, sum(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::bigint error from a2 join s using (vec_id, p) join b2 using (p, e) group by 1),
l as (select label, sum(error)::bigint label_error from c join k using (vec_id) group by 1)
select vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(y, ','), ',' order by p, e)) from b2) codebooks_sha256 from c join k using (vec_id) join l on l.label is not distinct from k.label
"""


ORACLES["op12_heap_codes"] = _lloyd_sql()


@_query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without lines that a document of a smaller id has."""
    from .line_dedup import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_line_dedup"] = r"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) t from documents),
l as (select r, doc_id, j, line, case when length(k) >= 10 then k end k from (select r, doc_id, generate_subscripts(t, 1) j, unnest(t) line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from d)),
m as (select k, min(doc_id) least from l where k is not null group by 1 having count(distinct doc_id) > 1)
select doc_id, count(*) n_lines, count(*) filter (least is not null and doc_id > least) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by j) filter (least is null or doc_id = least), '')) kept_sha256
from l left join m using (k) group by r, doc_id
"""
