"""The queries opN_<name> of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, language, lexical, line_dedup, mixing, ngram_join, pii, prefix_trie, spotsigs, substring_dedup, token_counts, topk, url_filter
from tidewatch.llm.runtime import documents


def vocabulary() -> str:
    """The vocabulary file that the queries are specified with. Elsewhere, operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(documents(spark, sf_dir))


OP1_SQL = r"""
with recursive t as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
g as materialized (select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                   else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from t),
e as (select r, unnest(s) as x from g),
o as (select a.r as a, b.r as b, count(*) as o from e a join e b on a.x = b.x and a.r < b.r group by all),
l as materialized (select a, b from o join g p on p.r = a join g q on q.r = b where 100 * o >= 75 * (len(p.s) + len(q.s) - o)),
pair as materialized (select a, b from l union all select b, a from l),
reach(r, d) as (select r, doc_id from g union select pair.b, reach.d from reach join pair on reach.r = pair.a)
select g.doc_id, cast(any_value(len(s)) as bigint) as n_shingles, min(d) as component_id from g join reach using (r) group by g.r, g.doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.histogram(documents(spark, sf_dir), vocabulary()))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
with d as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as ls from documents),
t as (select r, line, no, coalesce(cast(doc_id as hugeint), 9223372036854775808) * 4294967296 + no - 1 as place
      from (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as no from d)),
f as materialized (select line, min(place) as first, any_value(length(line)) as n, any_value(strlen(line)) as bytes
                   from t where regexp_matches(line, '[^ \t\n\x0B\f\r]') group by line),
-- levenshtein counts bytes: 2 edits of characters are at most 8 of bytes, and such pairs are judged by character
p as materialized (select a.line as a, b.line as b, a.n = a.bytes and b.n = b.bytes as plain, levenshtein(a.line, b.line) as e
                   from f a join f b on b.n between a.n - 2 and a.n + 2 where b.first < a.first and least(a.n, b.n) >= 20 and abs(a.bytes - b.bytes) <= 8 and e <= 8),
c as (select a, list_transform(range(1, length(a) + 1), lambda i: substr(a, i, 1)) as x, list_transform(range(1, length(b) + 1), lambda i: substr(b, i, 1)) as y from p where not plain),
h as (select a, x, y, least(len(x), len(y)) as m, coalesce(nullif(list_position(list_transform(range(1, m + 1), lambda i: x[i] = y[i]), false), 0), m + 1) as k from c),
b as (select a, list_reverse(x[k:]) as x, list_reverse(y[k:]) as y from h),
g as (select a, x, y, least(len(x), len(y)) as m, coalesce(nullif(list_position(list_transform(range(1, m + 1), lambda i: x[i] = y[i]), false), 0), m + 1) as k from b),
-- without common ends, two edits are the first and the last column of the alignment
z as (select a, x[k:] as u, y[k:] as v from g),
near as (select a from p where plain and e <= 2 union
         select a from z where case when len(u) = 0 or len(v) = 0 then greatest(len(u), len(v)) <= 2
           else len(list_filter([[1, 1], [1, 0], [0, 1]], lambda i: len(list_filter([[1, 1], [1, 0], [0, 1]], lambda j: u[1 + i[1]:len(u) - j[1]] = v[1 + i[2]:len(v) - j[2]])) > 0)) > 0 end),
s as (select r, no, line, f.line is not null and (near.a is not null or place > first) as gone from t left join f using (line) left join near on near.a = line),
k as (select r, count(*) filter (where gone) as n, string_agg(line, chr(10) order by no) filter (where not gone) as kept from s group by r)
select doc_id, coalesce(n, 0) as n_lines_removed, sha256(case when text is not null then coalesce(kept, '') end) as kept_sha256 from d left join k using (r)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "n_tokens", "copies")


OP4_SQL = """
with t as (select doc_id, source, greatest(1, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 1)) as n_tokens,
                  cast('0x' || substr(md5(concat_ws(':', 'mix', doc_id::varchar)), 1, 15) as bigint) as o from documents),
s as (select source, count(*) as docs, sum(n_tokens) as tokens, sum(n_tokens) / (select sum(n_tokens) from t) as p from t group by source),
a as (select greatest(0, ceil((1 - ln(2 + 1e-9) / ln(max(p) / min(p))) * 1048576)) / 1048576 as alpha from s),
w as (select source, docs, tokens, pow(p, alpha) / sum(pow(p, alpha)) over () as weight from s, a),
q as (select source, docs, tokens, cast(floor(max(tokens / weight) over () * weight + 1e-6) as bigint) as quota from w),
r as (select source, quota // tokens as full_, quota % tokens as rest, greatest(1, cast(ceil(docs / 1024) as bigint)) as blocks from q),
d as (select t.*, full_, rest, o % blocks as blk from t join r on t.source is not distinct from r.source),
b as (select source, blk, any_value(rest) as rest, sum(n_tokens) as bt, cast('0x' || substr(md5('mix:block:' || blk), 1, 15) as bigint) as turn from d group by source, blk),
c as (select *, rest - coalesce(sum(bt) over (partition by source order by turn, blk rows between unbounded preceding and 1 preceding), 0) as room from b),
e as (select d.*, room, bt <= room as whole, sum(n_tokens) over (partition by d.source, d.blk order by o, doc_id) as upto from d join c on d.source is not distinct from c.source and d.blk = c.blk)
select doc_id, source, n_tokens, cast(full_ + case when room > 0 and (whole or upto <= room) then 1 else 0 end as bigint) as copies from e
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
with t as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
p as (select r, i, array_to_string(w[i:i + 34], ' ') as g from (select r, w, unnest(range(1, len(w) - 33)) as i from t)),
s as (select r, i from (select r, i, count(*) over (partition by g) as n from p) where n > 1),
x as (select t.r, word, j, max(s.i) over (partition by t.r order by j) as last
      from (select r, unnest(w) as word, generate_subscripts(w, 1) as j from t) t left join s on s.r = t.r and s.i = t.j),
k as (select r, count(*) filter (where j - last <= 34) as gone, string_agg(word, ' ' order by j) filter (where last is null or j - last > 34) as kept from x group by r)
select doc_id, len(w) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join k using (r)
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = pii.find(docs, pii.train(docs))
    return out.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.against_next(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    away = language.held_out(F.col("doc_id"))
    return language.predict(docs.select("doc_id", "text", away.alias("held_out")), language.fit(docs.where(~away))).drop("text")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.r as asking, c.vec_id as vec_id,
             cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
      from v q join v c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by query_id, asking order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 20
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.nodes(prefix_trie.borrowed(turns))


OP11_SQL = r"""
with o as materialized (select conv_id, k, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as words, row_number() over (partition by conv_id order by turn nulls first, r, k) as pos
  from (select conv_id, turn, r, t, sha256(concat(length(r), ':', r, t)) as k from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null))),
c as materialized (select conv_id, count(*) as n, conv_id - conv_id % 20 as base,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 4 as h
  from o group by conv_id),
s as (select c.conv_id, pos, k, words from c join o on o.conv_id = c.base where pos <= h union all
      select c.conv_id, pos - c.h + least(c.h, coalesce(b.n, 0)), k, words from c join o using (conv_id) left join c b on b.conv_id = c.base where pos > c.h),
m as materialized (select conv_id, 0 as depth, '' as path, 0 as words from c union all select conv_id, pos, string_agg(k, '') over (partition by conv_id order by pos), words from s),
v as materialized (select depth, path, min(conv_id) as conv_id, count(*) as n, any_value(words) as words from m group by depth, path),
up as (select v.conv_id, v.depth, q.conv_id as parent from v join m on m.conv_id = v.conv_id and m.depth = v.depth - 1 join v q on q.depth = m.depth and q.path = m.path),
kids as (select parent as conv_id, depth - 1 as depth, count(*) as n_children from up group by all),
sums as (select m.depth, m.path, sum((v.n - 1) * v.words) as saved, count(*) filter (where kids.conv_id is null) as leaves
  from v left join kids on kids.conv_id = v.conv_id and kids.depth = v.depth join m on m.conv_id = v.conv_id and m.depth <= v.depth group by m.depth, m.path),
ends as (select m.depth, m.path, sha256(string_agg(m.conv_id::varchar, ',' order by m.conv_id)) as h
  from m join (select conv_id, max(depth) as len from m group by conv_id) l on l.conv_id = m.conv_id and m.depth = len group by m.depth, m.path)
select v.conv_id, v.depth::bigint as depth, up.parent as parent_conv_id, v.n as n_convs, coalesce(n_children, 0) as n_children, leaves as n_leaves, saved::bigint as saved_tokens, coalesce(ends.h, sha256('')) as ends_sha256
from v left join up on up.conv_id = v.conv_id and up.depth = v.depth left join kids on kids.conv_id = v.conv_id and kids.depth = v.depth
join sums on sums.depth = v.depth and sums.path = v.path left join ends on ends.depth = v.depth and ends.path = v.path
"""

#: The rules of op12, fixed by its contract.
RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, RULES, url_filter.train(pages, RULES)).drop("url")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
i as (select row_number() over () as q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ts from benchmark),
s as (select count(*) filter (where len(w) > 0) as n, sum(len(w))::bigint as l from d),
f as materialized (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by r, t),
g as (select t, cast(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) as bigint) as w from f, s group by t, s.n),
x as (select q, item_id, unnest(ts) as t from i),
m as (select r, doc_id, 10 + (90 * len(w) * s.n) // s.l as m from d, s where len(w) > 0),
y as (select q, item_id, r, doc_id, sum(g.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from x join g using (t) join f using (t) join m using (r) group by q, item_id, r, doc_id),
z as (select item_id, cast(row_number() over (partition by q order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from y where score > 0)
select * from z where rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_token_counts, op3_line_dedup, op4_mixing, op5_bpe, op6_substring_dedup, op7_pii, op8_spotsigs, op9_language, op10_topk, op11_prefix_trie, op12_url_filter, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_mixing": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op10_topk": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_lexical_search": OP13_SQL}
