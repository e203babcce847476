"""DuckDB SQL for the rows of the operators' queries."""

#: Words, shingle sets, links by an inverted index, and components by walking the links.
OP5 = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh
  from w
), e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r as (
  select doc_id, doc_id as root from s
  union
  select p.a, r.root from r join p on p.b = r.doc_id
)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, m.root as component_id
from s join (select doc_id, min(root) as root from r group by doc_id) m on m.doc_id = s.doc_id
"""

#: Windows with the first place of each word sequence; a word goes if a window over it is not a first one.
OP4 = r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), win as (
  select doc_id, unnest(range(0, len(ws) - 19)) as s, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) as h from w where len(ws) >= 20
), later as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as k from win) where k > 1
), gone as (
  select doc_id, list(distinct p) as ps from (select doc_id, s + unnest(range(1, 21)) as p from later) group by doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
  sha256(array_to_string(case when ps is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(ps, i)), lambda i: ws[i]) end, ' ')) as kept_sha256
from w left join gone on gone.doc_id = w.doc_id
"""

def _nibble(n: int) -> int:
    """CRC-32 of four bits."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def _crc(column: str) -> str:
    """CRC-32 of a text column, four bits at a time."""
    digits = f"list_transform(range(0, 2 * octet_length(encode({column}))), lambda i: strpos('0123456789ABCDEF', substr(hex(encode({column})), i // 2 * 2 + 2 - i % 2, 1)) - 1)"
    step = f"lambda c, v: xor(c >> 4, {[_nibble(n) for n in range(16)]}[(xor(c, v) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), {step}), 4294967295)"


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words with their made-up misspellings, near words by shared deletions, and roots by walking the forms.
OP11 = rf"""
with recursive r as (
  select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all({_LOW}, '[a-z\x{{C0}}-\x{{FF}}]+')) as w from documents) group by doc_id, w
), h as (select *, {_crc("concat(doc_id, ':', w)")} as h from r),
v as (
  select w, cast(sum(n) as bigint) as n from (
    select case when h % 97 = 0 then concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) else w end as w, n from h
  ) where length(w) >= 5 group by w having sum(n) >= 3
), d as (
  select w, n, unnest(list_distinct(list_append(list_transform(range(1, length(w) + 1), lambda i: concat(substr(w, 1, i - 1), substr(w, i + 1))), w))) as k from v
), near as (
  select distinct a.w as w, a.n as n, b.w as b, b.n as bn from d a join d b on a.k = b.k and a.w <> b.w where length(a.w) <> length(b.w) or len(list_filter(range(1, length(a.w) + 1), lambda i: substr(a.w, i, 1) <> substr(b.w, i, 1))) = 1
), best as (
  select w, count(*) as n_near, first(b order by bn desc, b) as form, first(bn order by bn desc, b) as form_n from near group by w
), f as (
  select v.w, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * v.n then form end as form, case when form_n >= 2 * v.n then form_n end as form_n from v left join best on best.w = v.w
), up as (
  select w, w as here, 0 as k from f
  union all
  select up.w, f.form, k + 1 from up join f on f.w = up.here where f.form is not null
), root as (select w, last(here order by k) as root from up group by w)
select f.w as word, form, root, n, cast(n_near as bigint) as n_near, form_n from f join root on root.w = f.w
"""

#: Features and their buckets, gains, weights, scores and ranks.
OP12 = rf"""
with w as (
  select 0 as kind, doc_id, regexp_extract_all({_LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as ws from documents
  union all select 1, null, regexp_extract_all({_LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') from benchmark
), g as (
  select kind, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) as f from w
), b as (
  select f, {_crc("f")} % 10000 as bucket from (select distinct f from g)
), o as (select kind, doc_id, bucket from g join b on b.f = g.f),
c as (select i as bucket, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t from range(10000) x(i) left join o on o.bucket = x.i group by i),
gain as (
  select bucket, cast(floor(1000 * ln((t + 1.0::double) * ((select sum(s) from c) + 10000) / ((s + 1.0::double) * ((select sum(t) from c) + 10000)))) as bigint) as gain from c
), m as (
  select doc_id, count(*) as n, cast(floor(cast(sum(gain) as double) / count(*)) as bigint) as weight from o join gain on gain.bucket = o.bucket where kind = 0 group by doc_id
), d as (
  select w.doc_id, len(ws) as words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    cast(concat('0x', substr(sha256(concat('7:', w.doc_id)), 1, 8)) as bigint) as h
  from w left join m on m.doc_id = w.doc_id where kind = 0
), e as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from d),
k as (select doc_id, row_number() over (order by score desc, doc_id) as rank, 25 * count(*) over () // 100 as drawn from e where words >= 20)
select e.doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, cast(case when rank <= drawn then rank end as bigint) as rank
from e left join k on k.doc_id = e.doc_id
"""

#: Lines with their keys; a repeated key stays in the largest document.
OP13 = rf"""
with l as (
  select doc_id, p, x, translate(trim(x, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as p from documents)
), r as (
  select k, max(doc_id) as keeper from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), m as (select l.doc_id, p, x, r.k is not null and l.doc_id <> keeper as gone from l left join r on l.k = r.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by p) filter (not gone), '')) as kept_sha256 from m group by doc_id
"""

SQL = {"op4_substring_dedup": OP4, "op5_jaccard_components": OP5, "op11_spelling_variants": OP11, "op12_importance_resampling": OP12, "op13_line_dedup": OP13}
