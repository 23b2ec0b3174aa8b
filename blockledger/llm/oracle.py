"""SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op7_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents
), pairs as (
  select doc_id, pos, line, lead(line) over (partition by doc_id order by pos) as line2 from lines
), again as (
  select doc_id, pos from (
    select doc_id, pos, line, line2, row_number() over (partition by line, line2 order by doc_id, pos) as k
    from pairs where line2 is not null
  ) where k > 1 and (line <> '' or line2 <> '')
), alone as (
  select doc_id, pos from (
    select doc_id, pos, row_number() over (partition by line order by doc_id, pos) as k
    from lines where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20
  ) where k > 1
), gone as (
  select doc_id, pos from again union select doc_id, pos + 1 from again union select doc_id, pos from alone
), marked as (
  select l.doc_id, l.pos, l.line, g.pos is not null as gone
  from lines l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos
), edges as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as opens from marked
), summed as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_runs,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept
  from edges group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_runs, 0)::bigint as n_runs, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join summed s on s.doc_id = d.doc_id
"""

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op3_decontamination"] = f"""
with d as (select doc_id, {WORDS} as w from documents),
b as (select item_id, {WORDS} as w from benchmark),
bw as (
  select item_id, w[i:least(i + 9, len(w))] as words
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
), sizes as (select distinct len(words) as n from bw),
dw as (
  select doc_id, i, n, w[i:i + n - 1] as words
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n)
), hits as (
  select distinct dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.words = bw.words
), covered as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id
)
select d.doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered c on c.doc_id = d.doc_id left join named n on n.doc_id = d.doc_id
"""

ORACLE["op2_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::bigint as score
  from v q join v on v.vec_id <> q.vec_id and len(v.x) = len(q.x) where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as k from scored
)
select query_id, k::int as rank, vec_id, score from ranked where k <= 5
"""

BLANK_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE["op10_jaccard_join"] = f"""
with recursive d as (select doc_id, coalesce({BLANK_WORDS}, []) as w from documents),
s as (
  select distinct doc_id, w[i:least(i + 3, len(w))] as shingle
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as i from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
t as (select dense_rank() over (order by shingle) as k, doc_id from s),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.k = b.k and a.doc_id < b.doc_id group by all),
links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from d union select r.doc_id, e.b from reach r join edges e on e.a = r.other),
c as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""

ORACLE["op8_substring_dedup"] = """
with b as (select doc_id, hex(coalesce(text, '')) as h, length(hex(coalesce(text, ''))) // 2 as n from documents),
w as (
  select doc_id, i, substr(h, 2 * i + 1, 100) as s
  from (select doc_id, h, unnest(generate_series(0, n - 50)) as i from b where n >= 50)
), f as (select s, min(doc_id) as first from w group by s having min(doc_id) < max(doc_id)),
hit as (select w.doc_id, w.i from w join f on f.s = w.s where w.doc_id > f.first),
opened as (
  select *, case when i > lag(i) over (partition by doc_id order by i) + 50
                   or lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as opens from hit
), numbered as (select *, sum(opens) over (partition by doc_id order by i) as k from opened),
spans as (select doc_id, k, min(i) as start, max(i) + 50 as stop from numbered group by doc_id, k),
gaps as (
  select s.doc_id, s.start, s.stop, coalesce(lag(s.stop) over (partition by s.doc_id order by s.start), 0) as before from spans s
), kept as (
  select g.doc_id, count(*) as n_spans, sum(stop - start) as n_removed, max(stop) as tail,
         string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' order by start) as pieces
  from gaps g join b on b.doc_id = g.doc_id group by g.doc_id
)
select b.doc_id, b.n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(case when k.doc_id is null then h else pieces || substr(h, 2 * tail + 1) end)) as kept_sha256
from b left join kept k on k.doc_id = b.doc_id
"""

# Unsigned crc32 of the decimal digits of doc_id: eight shifts a byte, the byte going in before the first.
CRC = """list_reduce(
    flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint)"""
DOC_CRC = f"xor({CRC}, 4294967295)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def merkle(levels: int = 7, arity: int = 8) -> str:
    """Trees of up to arity^levels leaves, level by level, and from each leaf up again."""

    def field(value):
        return f"coalesce(octet_length(encode(({value})::varchar))::varchar || ':' || ({value})::varchar, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(name):
        parts = []
        for k in range(levels):
            parts.append(f"""{name}{k + 1} as (
  select tree, i // {arity} as i, (n + {arity - 1}) // {arity} as n,
         case when n > 1 then sha256(string_agg(digest, '' order by i)) else max(digest) end as digest
  from {name}{k} group by tree, i // {arity}, n)""")
            side = f"string_agg(digest, '') over (partition by tree, i // {arity} order by i rows between"
            parts.append(f"""{name}_side{k} as (
  select tree, i, n > 1 as inner_node, coalesce({side} unbounded preceding and 1 preceding), '') as a,
         coalesce({side} 1 following and unbounded following), '') as b
  from {name}{k})""")
        return parts

    def fold(name, start, tree, i):
        """x is the digest so far, p the siblings so far."""
        parts, before = [], start
        for k in range(levels):
            parts.append(f"""{name}_up{k} as (
  select u.* exclude (x, p), case when inner_node then sha256(a || x || b) else x end as x, p || case when inner_node then a || b else '' end as p
  from {before} u join {name}_side{k} s on s.tree = u.{tree} and s.i = u.{i} // {arity**k})""")
            before = f"{name}_up{k}"
        return parts, before

    up, inside = fold("l", "start", "g", "i")
    over, outside = fold("g", inside, "zero", "g")
    parts = [
        f"""rows as (
  select doc_id, lang, {leaf('text')} as leaf,
         {leaf(f"case when {DOC_CRC} % 3 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end")} as claim
  from documents)""",
        "langs as (select lang, row_number() over (order by lang nulls first) - 1 as g, count(*) as n from rows group by lang)",
        """ranked as (
  select r.*, g, n, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i
  from rows r join langs on r.lang is not distinct from langs.lang)""",
        "l0 as (select g as tree, i, n, leaf as digest from ranked)",
        *climb("l"),
        f"g0 as (select 0 as tree, tree as i, (select count(*) from langs) as n, digest from l{levels})",
        *climb("g"),
        "start as (select *, 0 as zero, claim as x, '' as p from ranked)",
        *up,
        *over,
    ]
    return f"""with {", ".join(parts)}
select doc_id, leaf, l{levels}.digest as subroot, g{levels}.digest as root, sha256(p) as proof_sha256, x as folded_root,
       x = g{levels}.digest as verified
from {outside} u join l{levels} on l{levels}.tree = u.g cross join g{levels}"""


ORACLE["op13_merkle_manifest"] = merkle()


#: The 256 remainders of a byte, by eight shifts each; a text's crc32 takes one of them for each of its UTF-8 bytes.
REMAINDERS = """select list(x order by i) as t from (
    select i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, b: xor(c >> 1, 3988292384 * (c & 1)), i::bigint) as x from range(256) r(i))"""
TEXT_CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"""


def drawn(*parts):
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::bigint"


def sharding(shards: int = 24, cell: int = 64) -> str:
    """One shuffled order: cells by hash, Fisher-Yates swaps in each; shards are equal pieces of it."""
    return f"""with remainders as ({REMAINDERS}), sized as (
  select doc_id, coalesce(octet_length(encode(text)), 0) + 8 as size,
         case when coalesce(text, '') = '' then 0 else {TEXT_CRC} end as text_crc32
  from documents, remainders
), total as (select count(*) as n from sized),
hashed as (select s.*, n, ({drawn("0", "'cell'", "coalesce(doc_id::varchar, '-')", "text_crc32", "size", "0")} * ((n + {cell - 1}) // {cell})) >> 32 as cell from sized s, total),
ranked as (select *, row_number() over (partition by cell order by doc_id nulls first, text_crc32, size) - 1 as r from hashed),
cells as (select cell, count(*) as m, sum(count(*)) over (order by cell) - count(*) as before from ranked group by cell),
draws as (
  select cell, list([i, {drawn("0", "'swap'", "cell", "i")} % (i + 1)] order by i desc) as d
  from (select cell, unnest(range(1, m)) as i from cells) group by cell
), swapped as (
  select c.cell, before, case when d is null then [0::bigint] else list_reduce(d, lambda o, p:
    list_transform(o, lambda x, k: case when k - 1 = p[1] then o[p[2] + 1] when k - 1 = p[2] then o[p[1] + 1] else x end), range(m)) end as o
  from cells c left join draws using (cell)
), placed as (select r.*, before + o[r + 1] as pos from ranked r join swapped using (cell)),
dealt as (select *, pos * {shards} // n as shard from placed)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, (pos - (shard * n + {shards - 1}) // {shards})::bigint as slot,
       null::int as grown_shard
from dealt"""


ORACLE["op12_sharding"] = sharding()

#: Words as the contract has them; every tenth document gets a periodic tail. Pairs of one word q apart make stretches.
ORACLE["op11_periodic_runs"] = f"""
with h as (select doc_id, {DOC_CRC} as h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select *, len(w) as n, h // 10 as g from h),
s as (select *, case when h % 10 = 0 and n > 0 then g % n end as a, case when h % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from g),
d as (select doc_id, n, case when a is null then w else w[:a] || list_transform(range(n - a), lambda i: w[a + i % p + 1]) end as w from s),
t as (select doc_id, i, w[i + 1] as word from (select doc_id, w, unnest(range(n)) as i from d)),
pairs as (select x.doc_id, x.i, y.i - x.i as q from t x join t y on x.doc_id = y.doc_id and x.word = y.word and x.i < y.i),
islands as (select doc_id, q, i - row_number() over (partition by doc_id, q order by i) as k, i from pairs),
found as (select doc_id, q, min(i) as start, count(*) + q as length from islands group by doc_id, q, k having count(*) + q >= greatest(12, 2 * q)),
runs as (
  select * from found f where not exists (
    select 1 from found s where s.doc_id = f.doc_id and s.q < f.q and s.start <= f.start and s.start + s.length >= f.start + f.length)
), listed as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as text,
         arg_min([start, length, q, 1000 * length // q], [-length, start, q]) as longest
  from runs group by doc_id
), dropped as (select distinct doc_id, unnest(range(start + q, start + length)) as i from runs),
kept as (
  select t.doc_id, string_agg(word, ' ' order by t.i) as text from t anti join dropped using (doc_id, i) group by t.doc_id
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, longest[1] as start, longest[2] as length, longest[3] as period, longest[4] as exponent_milli,
       sha256(coalesce(l.text, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from d left join listed l on l.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""
