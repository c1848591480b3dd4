"""DuckDB SQL with the same rows as the queries."""

from __future__ import annotations

CHAT = r"""with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (select *, length(text) + len(regexp_extract_all(text, '<(\\|/?s>|<(/?SYS|ROLE|/?TEXT)>>)|\[(\\|/?INST\])')) as body,
  length(role) + len(regexp_extract_all(role, '<(\\|/?s>|<(/?SYS|ROLE|/?TEXT)>>)|\[(\\|/?INST\])')) as name from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(body + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 15 else 25 + name end) as bigint) as formatted_chars
from sized group by conv_id"""

DECONTAMINATE = r"""with docs as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
items as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from benchmark),
windows as (select distinct item_id, least(13, len(words)) as size, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') as pattern
  from items, unnest(range(1, greatest(len(words) - 11, 2))) as t(i) where len(words) > 0),
sizes as (select distinct size from windows),
places as (select doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') as pattern
  from docs, sizes, unnest(range(1, len(words) - size + 2)) as t(i) where len(words) >= size),
found as (select distinct doc_id, places.size, i, item_id from places join windows using (size, pattern)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by 1)
select docs.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)"""

LINES = r"""with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, i, lines[i] as line, translate(trim(lines[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from docs, unnest(range(1, len(lines) + 1)) as t(i)),
frequent as (select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select lines.*, keeper is not null and keeper <> doc_id as gone from lines left join frequent using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id"""

MIX = r"""with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as key from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rank from sized group by source),
weighed as (select *, [5, 2, 1][cast((rank - 1) % 3 + 1 as int)] as weight, 3 * source_size as cap from sources),
filled as (select *, row_number() over w as place,
    cast(sum(source_size) over () - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as budget,
    cast(sum(weight) over () - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as weights
  from weighed window w as (order by cap / weight, rank)),
first as (select * from filled where cap * weights >= weight * budget order by place limit 1),
named as (select f.source, f.rank, f.source_size,
    case when first.place is null or f.place < first.place then cast(f.cap as double)
      else cast(f.weight * first.budget as double) / cast(first.weights as double) end as target
  from filled f left join first on true),
rows as (select sized.doc_id, sized.size, sized.key, named.rank, named.source_size, named.target,
    cast(sum(size) over (partition by named.rank order by key, sized.doc_id, size rows unbounded preceding) as bigint) as served
  from sized join named on sized.source is not distinct from named.source),
copies as (select *, (turn * source_size + served - size / 2) / target as time
  from rows, (values (0), (1), (2)) t(turn) where size > 0 and target > 0),
queue as (select *, sum(size) over (order by time, rank, key, doc_id, size, turn rows unbounded preceding) - size / 2 as used from copies),
served as (select doc_id, rank, key, size, count(*) as copies from queue where used <= (select sum(size) from sized) group by all)
select doc_id, size, source_size, target, cast(size * coalesce(copies, 0) as bigint) as taken
from rows left join served using (doc_id, rank, key, size)"""

NEAR = r"""with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
shingles as (select distinct doc_id, array_to_string(words[i:i + 2], ' ') as shingle
  from docs, unnest(range(1, greatest(len(words) - 1, 2))) as t(i) where len(words) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from shingles a join shingles b using (shingle)
  join sizes s on s.doc_id = a.doc_id join sizes t on t.doc_id = b.doc_id where a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, s.n, t.n having 100 * count(*) >= 85 * (s.n + t.n - count(*))),
reached as (select doc_id as a, doc_id as b from documents union select reached.a, links.b from reached join links on links.a = reached.b)
select docs.doc_id, coalesce(n, 0) as n_shingles, min(b) as component_id, docs.doc_id = min(b) as kept
from docs left join sizes using (doc_id) join reached on reached.a = docs.doc_id group by docs.doc_id, n"""

PIVOT = r"""with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from e q join e c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from pairs qualify rank <= 5"""

AUDIT = r"""with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
worded as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
  min(doc_id) over (partition by text) as first_id from docs),
failed as (select part, doc_id, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] as fails from worded),
marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
told as (select part, fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n
  from failed left join marks using (doc_id) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step, ascii(filter_order[step]) - 64 as own, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) as earlier
  from orders, range(1, 6) as t(step)),
seen as (select part, filter_order, step, own, n, good, toxic, fails[own] as hit,
  len(list_filter(earlier, lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda x: x)) = 1 as alone from told, steps),
summed as (select part, filter_order, cast(step as integer) as step, own,
  cast(sum(case when hit and not gone then n else 0 end) as bigint) as removed, cast(sum(case when hit and gone then n else 0 end) as bigint) as redundant,
  cast(sum(case when not hit and not gone then n else 0 end) as bigint) as kept, cast(sum(case when hit and alone then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when hit and not gone and good then n else 0 end) as bigint) as good_lost,
  cast(sum(case when hit and not gone and toxic then n else 0 end) as bigint) as toxic_lost from seen group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley from summed"""
