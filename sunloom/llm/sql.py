"""The operators that SQL can express, for an engine that shares nothing with ours."""

from __future__ import annotations

from sunloom.llm import quality
from sunloom.llm.sharding import Node, even_tree

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
with s as (select doc_id, source, cast(len({WORDS}) as bigint) as size from documents),
src as (select source, cast(sum(size) as bigint) as source_size from s group by source),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight,
        source_size * 2.0e0 as cap, (select sum(source_size) * 1.5e0 from src) as wanted from src),
o as (select *, row_number() over l as r,
        coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as clamped,
        sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as open
      from w window l as (order by cap / weight, source nulls last)),
f as (select min(r) as r from o where not ((wanted - clamped) * weight > cap * open)),
t as (select source, source_size, case when f.r is null or o.r < f.r then cap
        else ((select wanted - clamped from o, f where o.r = f.r)) * weight / (select open from o, f where o.r = f.r) end as target from o, f),
k as (select s.*, t.source_size, t.target, coalesce(cast(floor(t.target / nullif(t.source_size, 0)) as bigint), 0) as whole,
        cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as key
      from s join t on s.source is not distinct from t.source),
b as (select *, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from k)
select doc_id, source, size, source_size, target,
  cast(size * (whole + case when size > 0 and before * 2 + size < 2 * (target - whole * source_size) then 1 else 0 end) as bigint) as taken
from b
"""


def _children(node: Node) -> list[tuple[str, str, float]]:
    own = [(node.name, c.name, c.weight) for c in node.children]
    return own + [row for c in node.children for row in _children(c)]


def sharding(shards: int = 40, seed: int = 11) -> str:
    """Checksums come from the table-free rule for CRC-32, eight steps a byte, as a table of 256."""
    def tree(name: str, n: int) -> str:
        rows = ", ".join(f"('{p}', '{c}', {w}e0)" for p, c, w in _children(even_tree(n)))
        steps = []
        for level, (parent, own) in enumerate((("'root'", "region"), ("region", "rack"), ("rack", "leaf"))):
            source = "keyed" if not level else f"{name}{level - 1}"
            steps.append(f"""{name}{level} as (select k.*, c.child as {own} from {source} k join {name}_nodes c on c.parent = {parent if not level else "k." + parent}
  qualify row_number() over (partition by k.rid order by
    -ln((cast('0x' || substr(md5('{seed}:' || c.child || ':' || k.key), 1, 13) as bigint) + 0.5e0) / 4503599627370496e0) / c.weight, c.child) = 1)""")
        return f"{name}_nodes(parent, child, weight) as (values {rows}),\n" + ",\n".join(steps)

    return rf"""
with recursive bits(b, c, n) as (select cast(range as ubigint), cast(range as ubigint), 0 from range(256)
  union all select b, case when c % 2 = 1 then xor(c // 2, cast(3988292384 as ubigint)) else c // 2 end, n + 1 from bits where n < 8),
crc as (select list(c order by b) as t from bits where n = 8),
keyed as (select row_number() over () as rid, doc_id, coalesce(cast(doc_id as varchar), '') as key, octet_length(encode(coalesce(text, ''))) + 16 as size,
  hex(encode(coalesce(text, ''))) as h from documents),
{tree("a", shards)},
{tree("g", shards + 1)},
sums as (select rid, xor(list_reduce(list_prepend(cast(4294967295 as ubigint),
    list_transform(range(1, length(h), 2), lambda i: cast((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1 as ubigint))),
    lambda x, y: xor(x // 256, crc.t[cast(1 + xor(x % 256, y) as bigint)])), cast(4294967295 as ubigint)) as crc32 from keyed, crc),
placed as (select a.doc_id, a.key, cast(a.size as bigint) as size, cast(s.crc32 as bigint) as text_crc32, a.region, a.rack,
  cast(split_part(a.leaf, '/', 3) as int) as shard, cast(split_part(g.leaf, '/', 3) as int) as grown_shard
  from a2 a join g2 g on a.rid = g.rid join sums s on s.rid = a.rid)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by md5('{seed}/' || key), doc_id, text_crc32, size) - 1 as slot, grown_shard, region, rack
from placed
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# a line is judged by the same patterns; RE2 writes character classes as Java does
QUALITY = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, {WORDS} as w from documents),
l as (select rid, unnest(string_split(t, chr(10))) as line from d),
lines as (select *, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as solid,
    len(line) - len(replace(line, ' ', '')) + 1 as words from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
judged as (select rid, line, solid,
    (len(line) - len(regexp_replace(line, {_quoted(quality.MARK)}, '', 'g')) > {quality.MARKS_A_WORD}e0 * words)
    or not regexp_matches(line, {_quoted(quality.SENTENCE)})
    or regexp_matches(line, {_quoted(quality.SEPARATORS)}) or (words <= 3 and regexp_matches(line, {_quoted(quality.MENU)}))
    or regexp_matches(line, {_quoted(quality.BOILERPLATE)}) as bad from lines),
per_line as (select rid, count(*) - count(distinct line) as dups, coalesce(sum(solid) filter (not bad), 0) as good from judged group by rid),
windows as (select rid, i, w[i:i + 4] as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from d)),
twice as (select rid, i from windows qualify count(*) over (partition by rid, g) > 1),
covered as (select rid, count(distinct i + k) as n from twice, (select unnest(range(5)) as k) group by rid),
base as (select d.rid, doc_id, cast(len(w) as bigint) as n_words, cast(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dups, 0) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words, coalesce(good, 0) as good
  from d left join per_line using (rid) left join covered using (rid)),
judged_doc as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, cast(word_chars - good as bigint) as lost_chars from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and lost_chars <= {quality.MAY_LOSE}e0 * word_chars as kept, lost_chars
from judged_doc
"""

NEAR_DUPLICATES = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, case when len(w) < 5 then w else w[i:i + 4] end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
pairs as (select a, b from links union select b, a from links),
reached(doc_id, r) as (select doc_id, doc_id from d union select p.b, r from reached join pairs p on p.a = reached.doc_id),
least as (select doc_id, min(r) as component_id from reached group by doc_id)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join sizes using (doc_id) join least on least.doc_id = d.doc_id
"""

HARD_NEGATIVES = r"""
with e as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.rid as anchor, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.rid <> b.rid),
p as (select anchor, anchor_id, other_id as positive_id, score as positive_score, row_number() over (partition by anchor order by score desc, other_id) as place
  from s where same qualify place <= 5),
n as (select p.anchor_id, p.positive_id, s.other_id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor, p.place order by s.score desc, s.other_id) as rank
  from p join s on s.anchor = p.anchor and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

SUBSTRINGS = r"""
with d as (select row_number() over () as rid, coalesce(doc_id, 9223372036854775807) as id, doc_id, encode(coalesce(text, '')) as raw from documents),
w as (select rid, id, i, raw[i:i + 49] as s from (select rid, id, raw, unnest(range(1, octet_length(raw) - 48)) as i from d)),
gone as (select rid, i from w qualify min(id) over (partition by s) < id),
heads as (select rid, i, coalesce(i > lag(i) over (partition by rid order by i) + 50, true) as head from gone),
runs as (select rid, i, sum(cast(head as int)) over (partition by rid order by i) as run from heads),
spans as (select rid, run, min(i) as first, max(i) + 50 as stop from runs group by rid, run),
parts as (select rid, coalesce(lag(stop) over (partition by rid order by first), 1) as begin, first - 1 as until from spans
  union all select rid, max(stop), 9223372036854775807 from spans group by rid),
kept as (select rid, unhex(string_agg(hex(raw[begin:least(until, octet_length(raw))]), '' order by begin)) as kept from parts join d using (rid) group by rid),
sums as (select rid, cast(sum(stop - first) as bigint) as n_removed, count(*) as n_spans from spans group by rid)
select doc_id, cast(octet_length(raw) as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(coalesce(kept, raw)) as kept_sha256
from d left join sums using (rid) left join kept using (rid)
"""

_FEATURE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE = rf"""
with recursive bits(b, c, n) as (select cast(range as ubigint), cast(range as ubigint), 0 from range(256)
  union all select b, case when c % 2 = 1 then xor(c // 2, cast(3988292384 as ubigint)) else c // 2 end, n + 1 from bits where n < 8),
crc as (select list(c order by b) as t from bits where n = 8),
d as (select row_number() over () as rid, doc_id, {_FEATURE_WORDS} as w from documents),
b as (select {_FEATURE_WORDS} as w from benchmark),
fd as (select rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from d),
fb as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from b),
f as (select f, hex(encode(f)) as h from (select f from fd union select f from fb)),
k as (select f, cast(xor(list_reduce(list_prepend(cast(4294967295 as ubigint),
    list_transform(range(1, length(h), 2), lambda i: cast((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1 as ubigint))),
    lambda x, y: xor(x // 256, crc.t[cast(1 + xor(x % 256, y) as bigint)])), cast(4294967295 as ubigint)) % 10000 as int) as bucket from f, crc),
cs as (select bucket, count(*) as s from fd join k using (f) group by bucket),
ct as (select bucket, count(*) as t from fb join k using (f) group by bucket),
g as (select range as bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from fd) + 10000)::double
    / ((coalesce(s, 0) + 1)::double * ((select count(*) from fb) + 10000)::double))) as bigint) as gain
  from range(10000) left join cs on cs.bucket = range left join ct on ct.bucket = range),
m as (select rid, count(*) as n_features, sum(gain) as total from fd join k using (f) join g using (bucket) group by rid),
x as (select rid, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, cast(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) as bigint) as weight,
    cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from d left join m using (rid)),
y as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296))) as bigint) as score from x),
r as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features, n_words) end as place from y)
select doc_id, n_features, weight, score, case when place <= 25 * (select count(*) from y where n_words >= 20) // 100 then place end as rank from r
"""

SQL = {
    "op2_mixing": MIXING, "op4_quality": QUALITY, "op7_sharding": sharding(), "op10_neardup": NEAR_DUPLICATES,
    "op11_hardnegatives": HARD_NEGATIVES, "op12_substrings": SUBSTRINGS, "op13_importance": IMPORTANCE,
}
