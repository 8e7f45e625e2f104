"""DuckDB SQL of the corpus queries that SQL can express beside their modules' own."""

MIX = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by 1),
s1 as (select *, [1.0, 2.0, 3.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w, 3 * source_size::double as most from s0),
s2 as (select *, greatest(sum(source_size) over ()::double - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0), 0)
  / sum(w) over (order by most / w, source nulls last rows between current row and unbounded following) as level from s1),
s3 as (select *, most <= w * level as full_ from s2),
s4 as (select source, source_size, case when full_ then most else least(most, w * (select level from s3 where not full_ order by most / w, source nulls last limit 1)) end as target from s3),
p as (select doc_id, coalesce('s' || d.source, 'n') as key, size, source_size, target,
  unnest(range(0, case when source_size > 0 then least(3, floor(target / source_size)::bigint + 1) else 1 end)) as pass from d join s4 on d.source is not distinct from s4.source),
q as (select *, ('0x' || substr(md5(pass || ':' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as draw from p),
f as (select *, coalesce(sum(size) over (partition by key order by pass, draw, doc_id rows between unbounded preceding and current row)::double / nullif(target, 0), 0) as finish from q),
m as (select *, sum(size) over (order by finish, key, pass, draw, doc_id rows between unbounded preceding and current row) as merged from f)
select doc_id, any_value(size) as size, any_value(source_size) as source_size, any_value(target) as target,
  sum(case when merged <= (select sum(target) from s4) then size else 0 end)::bigint as taken from m group by doc_id
"""

SUBSTRINGS = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
x as (select doc_id, p, array_to_string(w[p:p + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as p from d)),
l as (select k, min(doc_id) as least from x group by 1),
g as (select distinct doc_id, unnest(range(p, p + 13)) as n from x join l using (k) where least < doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as n from d),
kept as (select words.doc_id, count(*) as n_words, count(g.n) as n_removed, coalesce(string_agg(word, ' ' order by words.n) filter (where g.n is null), '') as kept
  from words left join g on g.doc_id = words.doc_id and g.n = words.n group by 1)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)
"""

EMBEDDINGS = r"""
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
c(a, b) as (select a, b from l union select c.a, l.b from c join l on l.a = c.b),
r as (select a, min(b) as b from c group by 1), n as (select a, count(*) as n from l group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id <= coalesce(b, vec_id) as kept from embeddings left join r on r.a = vec_id left join n on n.a = vec_id
"""


def _crc32(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a text of digits and signs."""
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)), lambda c, b: {bits}))"


_LEAF = "sha256(" + " || ".join(f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c} end" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

MERKLE = f"""
with recursive d as (select row_number() over () as row, doc_id, source, {_LEAF.format(text="text")} as leaf,
  case when doc_id is not null and {_crc32("doc_id::varchar")} % 2 = 0 then {_LEAF.format(text="replace(text, chr(10), '')")} else {_LEAF.format(text="text")} end as received from documents),
p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from d),
t(source, level, pos, h, n) as (select source, 0, pos, leaf, n from p
  union all select source, level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), any_value(n + 2) // 3 from t where n > 1 group by source, level, pos // 3),
sub as (select source, h as subroot from t where n = 1),
q as (select *, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from sub),
u(level, pos, h, n) as (select 0, pos, subroot, n from q
  union all select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), any_value(n + 2) // 3 from u where n > 1 group by level, pos // 3),
nodes as (select coalesce('s' || source, 'n') as tree, level, pos, h, n from t union all select 'top', level, pos, h, n from u),
sides as (select *, coalesce(string_agg(h, '' ) over (partition by tree, level, pos // 3 order by pos rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(h, '') over (partition by tree, level, pos // 3 order by pos rows between 1 following and unbounded following), '') as r from nodes),
path as (select row, level, l, r from p join sides s on s.tree = coalesce('s' || p.source, 'n') and s.pos = p.pos // (3 ** level)::bigint where s.n > 1
  union all select row, 1000 + level, l, r from p join q on p.source is not distinct from q.source join sides s on s.tree = 'top' and s.pos = q.pos // (3 ** level)::bigint where s.n > 1),
steps as (select row, l, r, row_number() over (partition by row order by level) as step from path),
fold(row, step, h) as (select row, 0::bigint, received from d union all select f.row, s.step, sha256(l || h || r) from fold f join steps s on s.row = f.row and s.step = f.step + 1),
folded as (select row, arg_max(h, step) as folded_root from fold group by row),
proof as (select row, sha256(string_agg(l || r, '' order by step)) as proof_sha256 from steps group by row)
select doc_id, leaf, subroot, (select h from u where n = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = (select h from u where n = 1) as verified
from p join sub on p.source is not distinct from sub.source join folded using (row) left join proof using (row)
"""

TRIE = f"""
with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
c as (select conv_id, max(pos) as n, {_crc32("conv_id::varchar")} % 6 as h, conv_id - conv_id % 100 as first from o group by conv_id),
r as (select c.conv_id, pos, role, text from c join o on o.conv_id = c.first where pos <= c.h
  union all select o.conv_id, pos - c.h + least(c.h, coalesce(f.n, 0)), role, text from o join c on c.conv_id = o.conv_id left join c f on f.conv_id = c.first where pos > c.h),
p as (select conv_id, pos as depth, text, string_agg(sha256(role) || sha256(text), '' order by pos) over (partition by conv_id order by pos) as key, max(pos) over (partition by conv_id) as whole from r
  union all select c.conv_id, 0, '', '', coalesce(m.whole, 0) from c left join (select conv_id, max(pos) as whole from r group by 1) m using (conv_id)),
n as (select depth, key, count(*) as n_convs, min(conv_id) as conv_id, max(length(text)) as chars, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where whole = depth), '')) as ends_sha256 from p group by 1, 2),
k as (select left(key, 128 * (depth - 1)) as key, count(*) as n_children from n where depth > 0 group by 1),
t as (select left(key, 128 * e) as key, count(*) filter (where n_children is null) as n_leaves, sum((n_convs - 1) * chars) as saved_tokens
  from (select n.*, n_children, unnest(range(0, depth + 1)) as e from n left join k using (key)) group by 1)
select n.conv_id::bigint as conv_id, n.depth::bigint as depth, up.conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves,
  saved_tokens::bigint as saved_tokens, n.ends_sha256 from n join t using (key) left join k using (key) left join n up on n.depth > 0 and up.key = left(n.key, 128 * (n.depth - 1))
"""
