"""The thin registered queries of the document operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.decision_lists import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.secret_scan import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join("random_by", ",").alias("random_by"),
    )


def op4_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.site_bayes import site_quality

    docs = table(spark, sf_dir, "documents")
    return site_quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.toxicity_chain import toxicity

    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.phrase_index import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))  # near_items: with proximity matches
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join("near_items", ",").alias("near_items"),
    )


def op7_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clumpwise.llm.token_transducer import count_tokens

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.jaccard_join import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


def op9_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clumpwise.llm.trie_pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_template_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.license_templates import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    own = F.transform("matches", lambda m: m["label"])
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        "score",
    )


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.vector_codes import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def op12_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.scaled_sketch import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clumpwise.llm.source_audit import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_karmarkar_karp": op1_karmarkar_karp,
    "op2_decision_list": op2_decision_list,
    "op3_randomness_battery": op3_randomness_battery,
    "op4_site_bayes": op4_site_bayes,
    "op5_classifier_chain": op5_classifier_chain,
    "op6_positional_index": op6_positional_index,
    "op7_token_transducer": op7_token_transducer,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_shared_prefix_viterbi": op9_shared_prefix_viterbi,
    "op10_template_automata": op10_template_automata,
    "op11_yinyang_codes": op11_yinyang_codes,
    "op12_scaled_sketch": op12_scaled_sketch,
    "op13_source_audit": op13_source_audit,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Proximity: starts come from each window's rarest word (by corpus counts), 2 to either side, and every word must lie within 2 of its place.
_OP6 = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
 q as (select distinct item_id, array_to_string(w[k + 1 : k + 10], ' ') as s, least(len(w), 10) as n, w[k + 1 : k + 10] as v from (select item_id, w, unnest(range(greatest(len(w) - 9, 1))) as k from b where len(w) > 0)),
 p as (select r, k, n, array_to_string(w[k + 1 : k + n], ' ') as s from (select r, w, n, unnest(range(len(w) - n + 1)) as k from d cross join (select distinct n from q) where len(w) >= n)),
 m as (select r, k, p.n, item_id from p join q on p.s = q.s and p.n = q.n),
 h as (select r, count(distinct pos) as n_hit from (select r, unnest(range(k, k + n)) as pos from m) group by r),
 i as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from m) group by r),
 x as (select distinct s, n, v from q),
 o as (select r, unnest(w) as t, unnest(range(len(w))) as pos from d),
 c as (select t, count(*) as c from o group by t),
 e as (select s, n, v, t, k, row_number() over (partition by s order by c, k) as place from (select s, n, v, unnest(v) as t, unnest(range(n)) as k from x) a join c using (t)),
 z as (select s, any_value(n) as n, any_value(v) as v, min(case when place = 1 then t end) as t1, min(case when place = 1 then k end) as k1, min(case when place = 2 then t end) as t2, min(case when place = 3 then t end) as t3 from e group by s having count(*) = any_value(n)),
 st as (select distinct z.s, n, v, t2, t3, r, pos - k1 + off as start from z join o on o.t = z.t1 cross join range(-2, 3) f(off)),
 l as (select st.s, n, v, r, w[greatest(start - 1, 1) : start + n + 2] as a, start, greatest(start - 1, 1) as base from st join d using (r) where start + n + 2 >= 1 and (t2 is null or list_contains(w[greatest(start - 1, 1) : start + n + 2], t2)) and (t3 is null or list_contains(w[greatest(start - 1, 1) : start + n + 2], t3))),
 y as (select r, s, start, count(*) as k, any_value(n) as n from (select r, s, n, start, base, a, unnest(v) as t, unnest(range(n)) as k from l) u where start + k + 3 >= base and list_contains(a[greatest(start + k - 1 - base + 1, 1) : start + k + 3 - base + 1], t) group by r, s, start),
 g as (select r, string_agg(item, ',' order by item) as near_items from (select distinct r, cast(item_id as varchar) as item from y join q using (s) where k = y.n) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(near_items, '') as near_items
from d left join h on d.r = h.r left join i on d.r = i.r left join g on d.r = g.r"""

_OP8 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
 s as (select distinct doc_id, array_to_string(w[k + 1 : k + 5], ' ') as s from (select doc_id, w, unnest(range(greatest(len(w) - 4, 1))) as k from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 c as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 l as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 75 * (x.n + y.n - c)),
 e as (select u, v from l union all select v, u from l),
 r as (select doc_id, doc_id as seen from d union select r.doc_id, e.v from r join e on r.seen = e.u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, x.component_id from d left join n on d.doc_id = n.doc_id
join (select doc_id, min(seen) as component_id from r group by doc_id) x on d.doc_id = x.doc_id"""

#: Sketches: distinct MD5 hashes (16 digits) of five-word shingles that begin with 0 or 1, else the least; likeness: what the smaller one shares.
_OP12 = rf"""
with d as (select row_number() over (order by doc_id desc nulls last) as r, doc_id, coalesce(text, '') as t from documents),
 n as (select d.*, coalesce(lead(t) over (order by r), first_value(t) over (order by r)) as u, coalesce(lead(r) over (order by r), 1) as nr from d),
 e as (select r, nr, doc_id, t, left(t, length(t) - length(t) // 2) || left(u, length(t) // 2) as e from n),
 a as (select r, 0 as k, t from e union all select r, 1, e from e),
 w as (select r, k, regexp_extract_all({_LOWER.replace("coalesce(text, '')", "t")}, '[^\x20\x09-\x0D]+') as w from a),
 h as (select r, k, left(md5(array_to_string(w[i + 1 : i + 5], ' ')), 16) as h from (select r, k, w, unnest(range(greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
 m as (select r, k, min(h) as least from h group by r, k),
 s as (select r, k, list_sort(list(distinct h)) as s from h join m using (r, k) where h < '2' or h = least group by r, k),
 f as (select e.*, coalesce(a.s, []) as a, coalesce(b.s, []) as b, coalesce(c.s, []) as c from e left join s a on a.r = e.r and a.k = 0 left join s b on b.r = e.r and b.k = 1 left join s c on c.r = e.nr and c.k = 0)
select doc_id, cast(length(t) as bigint) as n_chars, sha256(e) as edited_sha256, array_to_string(a, '') as fingerprint, array_to_string(b, '') as edited_fingerprint,
 case when least(len(a), len(b)) = 0 then case when len(a) = len(b) then 1e0 else 0e0 end else len(list_intersect(a, b)) / cast(least(len(a), len(b)) as double) end as near_edited,
 case when least(len(a), len(c)) = 0 then case when len(a) = len(c) then 1e0 else 0e0 end else len(list_intersect(a, c)) / cast(least(len(a), len(c)) as double) end as near_next
from f"""

_OP13 = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
 o as (select r, lang, source, unnest(w) as t from d),
 k as (select lang, t, count(*) as n from o group by lang, t having count(distinct r) >= 10),
 g as (select distinct lang, source from d),
 v as (select lang, count(*) as v, sum(n) as nl from k group by lang),
 c as (select lang, source, t, count(*) as c from o semi join k using (lang, t) group by lang, source, t),
 s as (select g.lang, g.source, coalesce(sum(c.c), 0) as n from g left join c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
 p as (select s.lang, s.source, k.t, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (s.n + 2 * v.v) as p, 1 + (1000000000::hugeint * (k.n + 2)) // (v.nl + 2 * v.v) as q
  from s join k on k.lang = s.lang join v on v.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.t = k.t),
 x as (select a.lang, a.source, b.source as item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)), 0) as value from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all),
 y as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(x.value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
 z as (select lang, source, 'term' as part, t as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from p where c > 0 and p > q),
 r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from y union all select * from z) u)
select * from r where part = 'pair' or rank <= 10"""

ORACLE_SQL: dict[str, str] = {"op6_positional_index": _OP6, "op8_jaccard_join": _OP8, "op12_scaled_sketch": _OP12, "op13_source_audit": _OP13}
