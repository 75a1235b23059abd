"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorescape.llm import bpe, collocations, dart_minhash, mixing, pii, pivots, secret_scan, substring_dedup, syncmers, topk, toxicity, variants, warc
from lorescape.llm.shared import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))[0]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.duplicates(table(spark, sf_dir, "embeddings"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_mixing, op2_dart_minhash, op3_warc, op4_substring_dedup, op5_toxicity, op6_syncmers, op7_topk, op8_secret_scan, op9_pii, op10_bpe, op11_pivots, op12_variants, op13_collocations)
    return {f.__name__: f for f in made}


OP3_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h) payload_bytes, sha1(h) x, min(page_id) over (partition by h) first from p)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), 'string_agg', '') payload_digest,
  case when first = page_id then 'response' else 'revisit' end record_type,
  case when first <> page_id then first end refers_to
from d"""


def _op1_sql() -> str:
    """The same fitting: a recursive query makes the rounds, for all budgets at once; a step of a margin is a nested query."""
    steps = "".join(f"when x < {least} then '{name}' " for least, name in mixing.TOPICS)
    topic = f"case {steps}else '{mixing.TOPIC_REST}' end"
    parts = [
        f"""r as materialized (
  select doc_id, coalesce(source, '{mixing.NONE}') source, coalesce(lang, '{mixing.NONE}') lang, {topic} topic,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens
  from (select *, case when length(t) > 0 then (length(t) - length(regexp_replace(t, '[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g'))) / length(t)::double else 0 end x
    from (select doc_id, source, lang, coalesce(text, '') t from documents)))""",
        "c0 as materialized (select source, lang, topic, sum(n_tokens)::double seen from r group by all)",
        "whole as materialized (select sum(seen) total from c0)",
    ]
    for m in mixing.MARGINS:
        parts.append(f"t_{m} as materialized (select {m}, sqrt(s) / (select sum(sqrt(s)) from (select sum(seen) s from c0 group by {m})) * total want_{m} from (select {m}, sum(seen) s from c0 group by {m}), whole)")
    wants = ", ".join(f"want_{m}" for m in mixing.MARGINS)
    parts.append(f"c as materialized (select c0.*, {wants} from c0 " + " ".join(f"join t_{m} using ({m})" for m in mixing.MARGINS) + ")")
    parts.append(f"b as materialized (select {float(mixing.BUDGET)!r}::double * ({mixing.STEPS} - j) / {mixing.STEPS} budget from range({mixing.STEPS}) t(j))")
    inner = "rounds"
    for m in mixing.MARGINS:
        sums = f"select *, sum(case when f < 1 then seen * f else 0 end) over w below, sum(case when f >= 1 then seen else 0 end) over w full_ from {inner} window w as (partition by budget, {m})"
        by = f"case when want_{m} * budget > below + full_ then case when below > 0 then (want_{m} * budget - full_) / below else 1 end when below + full_ > 0 then want_{m} * budget / (below + full_) else 1 end"
        inner = f"(select i, budget, source, lang, topic, seen, {wants}, least(f * {by}, {mixing.MOST!r}::double) f from ({sums}))"
    parts.append(
        f"rounds as (select 0 i, budget, source, lang, topic, seen, {wants}, budget f from c, b union all "
        f"select i + 1, budget, source, lang, topic, seen, {wants}, f from {inner.replace('from rounds window', f'from rounds where i < {mixing.ROUNDS} window')})"
    )
    parts.append(f"fitted as materialized (select budget, source, lang, topic, seen, {wants}, least(f, 1::double) p from rounds where i = {mixing.ROUNDS})")
    errors = " union all ".join(f"select budget, max(abs(s - w)) e from (select budget, {m}, sum(seen * p) s, any_value(want_{m} * budget) w from fitted group by all) group by budget" for m in mixing.MARGINS)
    parts.append(f"e as materialized (select budget, max(e / (budget * total)) e from ({errors}), whole group by budget)")
    parts.append(f"best as (select max(budget) budget from e where e <= greatest({mixing.TOLERANCE}, 1.01 * (select min(e) from e)))")
    return (
        "with recursive " + ",\n".join(parts) + """
select doc_id, source, lang, topic, n_tokens, p probability, round(n_tokens * p, 6) weight,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0::double < p sampled
from r join (select source, lang, topic, round(p, 9) p from fitted join best using (budget)) using (source, lang, topic)"""
    )


OP2_SQL = """
with recursive w as materialized (
  select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: true) w from documents),
s as materialized (
  select doc_id, list_distinct(case when len(w) < 5 then case when len(w) > 0 then [array_to_string(w, ' ')] else [] end
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from w),
e as materialized (select doc_id, len(s) n, unnest(s) g from s),
o as materialized (select a.doc_id a, b.doc_id b, count(*) c, any_value(a.n) m, any_value(b.n) n from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from o where c >= 0.8 * (m + n - c)),
r(doc_id, to_id) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on r.to_id = l.a)
select doc_id, min(class_id) class_id, min(same_as) same_as from (
  select doc_id, to_id class_id, doc_id same_as from r
  union all select s.doc_id, s.doc_id, t.f from s join (select list_sort(s) k, min(doc_id) f from s where len(s) > 0 group by all) t on t.k = list_sort(s.s))
group by doc_id"""


OP4_SQL = """
with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
p as materialized (select doc_id, w, unnest(range(1, len(w) - 18)) i from w),
k as materialized (select doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) k from p),
later as materialized (
  select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) r from k) where r > 1),
gone as (select doc_id, list(distinct j) g from (select doc_id, unnest(range(i, i + 20)) j from later) group by doc_id)
select w.doc_id, len(w)::bigint n_words, coalesce(len(g), 0)::bigint n_removed,
  sha256(coalesce(array_to_string(case when g is null then w else list_filter(w, lambda x, j: not list_contains(g, j)) end, ' '), '')) kept_sha256
from w left join gone using (doc_id)"""


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
where rank <= 20"""


OP11_SQL = """
with recursive v as materialized (
  select vec_id, list_transform(embedding, lambda x: x::double) e,
    embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 sound
  from embeddings),
l as materialized (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id where a.sound and b.sound and list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, to_id) as (select vec_id, vec_id from v union select r.vec_id, l.b from r join l on r.to_id = l.a)
select vec_id, coalesce(n_links, 0) n_links, component_id, vec_id = component_id kept
from (select vec_id, min(to_id) component_id from r group by vec_id) left join (select a vec_id, count(*) n_links from l group by a) using (vec_id)"""


#: crc32 is a reduction of a word's bytes by a table, and a table's entry one of eight steps of a bit.
OP12_SQL = """
with recursive t as materialized (
  select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, x)) t),
o as materialized (
  select coalesce(doc_id::varchar, '') || ':' || run s, run, count(*) c from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) run from documents)
  where length(run) >= 6 group by all),
b as (select run, c, flatten(list_transform(string_split(s, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [192::bigint + (ord(x) >> 6), 128::bigint + (ord(x) & 63)] end)) b from o),
h as (select run, c, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[(1 + (xor(h, x) & 255))::int]), 4294967295::bigint), 4294967295::bigint) h from b, t),
w as materialized (
  select word, sum(c)::bigint n from (select c, case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word from h)
  where length(word) >= 6 group by word having sum(c) >= 5),
d as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) cut from (select *, unnest(range(0, length(word))) i from w)),
p as materialized (
  select a.word, b.word near, b.n from d a join d b on a.i = b.i and a.cut = b.cut and a.word <> b.word and length(a.word) = length(b.word)
  union select d.word, w.word, w.n from d join w on w.word = d.cut
  union select w.word, d.word, d.n from d join w on w.word = d.cut),
f as materialized (select word, count(*) n_near, max(n) best, min(near) filter (n = m) form from (select *, max(n) over (partition by word) m from p) group by word),
k as materialized (select w.word, w.n, coalesce(n_near, 0) n_near, case when best >= 5 * w.n then form end form, case when best >= 5 * w.n then best end form_n from w left join f using (word)),
r(word, root, step) as (select word, coalesce(form, word), 0 from k union all select r.word, k.form, step + 1 from r join k on k.word = r.root where k.form is not null)
select word, form, root, n, n_near, form_n from k join (select word, arg_max(root, step) root from r group by word) using (word)"""


OP13_SQL = """
with p as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
w as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from p),
t as (select lang, sum(len(w))::bigint n from w group by lang),
f as materialized (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, range(1, 4) s(k)) group by all having count(*) >= 10),
c as materialized (select lang, k, phrase, f a, string_split(phrase, ' ') w from f where k > 1),
s as (
  select c.lang, c.phrase, c.a, x.f l, y.f r, (1000000::hugeint * c.a * c.a // (x.f::hugeint * y.f))::bigint score, j
  from (select *, unnest(range(1, k)) j from c) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1:], ' ')),
m as (select lang, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
g as (select distinct c.lang, c.phrase from c join (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) phrase from c where k = 3) x on x.lang = c.lang and x.phrase = c.phrase where 100 * x.a >= 50 * c.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score
from m anti join g using (lang, phrase) join t using (lang)
qualify rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": _op1_sql(),
        "op2_dart_minhash": OP2_SQL,
        "op3_warc": OP3_SQL,
        "op4_substring_dedup": OP4_SQL,
        "op7_topk": OP7_SQL,
        "op11_pivots": OP11_SQL,
        "op12_variants": OP12_SQL,
        "op13_collocations": OP13_SQL,
    }
