"""The same results in plain SQL over the given tables."""

import math
import re

KEY = "pool_id, block_id, length, gen_stamp"
ID = "pool_id, block_id"
AGE_US = 6 * 3600 * 1_000_000
ALPHA = 1 - math.exp(-5 / 60)


def h32(*parts):
    text = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


def key_hash(*more):
    return h32("pool_id", "block_id", "length", "gen_stamp", *more)


def numbered(source, group, order, size=None, columns="*"):
    """Row numbers per group in the order (even hash part, key)."""
    text = " || ':' || ".join(f"cast({c} as varchar)" for c in order)
    part = f"substr(md5({text}), 1, 2)"
    over = f"partition by {', '.join(group)} " if group else ""
    number = f"cast(row_number() over ({over}order by {part}, {', '.join(order)}) - 1 as bigint)"
    inner = f"select *, {number} as row_no from ({source})"
    if size is None:
        return inner
    return f"select *, row_no // {size} as batch_no from ({inner})"


KEYS4 = ["pool_id", "block_id", "length", "gen_stamp"]


def object_key(half, prefix=""):
    return f"'{prefix}' || {half} || '/' || pool_id || '/' || block_id || '/' || gen_stamp || '/' || length"


def chunks(text):
    """md5 of each 512 byte chunk, as a list."""
    h = f"hex(encode({text}))"
    return f"list_transform(range(0, cast(ceil(length({h}) / 1024.0) as bigint)), lambda i: md5(unhex(substr({h}, i * 1024 + 1, 1024))))"


# Replicas sort by address, then port.
HOSTS = (
    "list_transform(list_sort(list(distinct {'ip': split_part(r, ':', 1), 'r': r}) filter (where r is not null)),"
    " lambda x: x.r)"
)

BLOCK_TEXT = (
    "'ExtendedBlock [poolId=' || pool_id || ', blockId=' || block_id || ', length=' || length"
    " || ', generationStamp=' || gen_stamp || ']'"
)

PARTS = {
    "lines": """
        select 'BP-' || substr(o_orderpriority, 1, 1) as pool_id,
               cast(l_orderkey * 10 + l_linenumber as bigint) as block_id,
               cast(floor(l_quantity) as bigint) * 1000 as length,
               cast(1000 + l_partkey % 50 as bigint) as gen_stamp,
               l_suppkey, l_partkey, l_returnflag, l_linestatus, l_tax,
               '/wh/' || o_orderstatus || '/' || year(o_orderdate) || '/' || o_orderkey as path
        from lineitem join orders on l_orderkey = o_orderkey""",
    "live_flags": f"""
        select {KEY}, l_returnflag, l_linestatus from lines
        qualify row_number() over (partition by {ID}
            order by gen_stamp desc, length desc, l_returnflag desc, l_linestatus desc) = 1""",
    "live": f"select {KEY} from live_flags",
    "store": f"""
        select pool_id, block_id, case when block_id % 13 = 0 then length + 1 else length end as length,
               case when block_id % 11 = 0 then gen_stamp - 1 else gen_stamp end as gen_stamp
        from live where block_id % 7 <> 0 and pool_id <> 'BP-5'
        union all select pool_id, block_id + 1000000000, length, gen_stamp from live
        where block_id % 17 = 0 and pool_id <> 'BP-5'
        union all select pool_id, block_id, length, gen_stamp - 5 from live
        where block_id % 19 = 0 and pool_id <> 'BP-5'
        union all select 'BP-9', cast(c_custkey as bigint), 500, 7 from customer""",
    "store_set": f"select distinct {KEY} from store",
    "placed": f"""
        select path, {KEY}, l_returnflag,
               case when l_tax = 0.08 then null when l_tax = 0.07 then []
                    else ['10.0.' || (l_suppkey // 256) || '.' || (l_suppkey % 256) || ':50020',
                          '10.0.' || (l_partkey // 256) || '.' || (l_partkey % 256) || ':50020'] end as replicas
        from lines""",
    "file_rows": "select * from placed where l_returnflag <> 'R'",
    "snap_rows": """
        select replace(path, '/wh/', '/wh/.snapshot/s0/') as path, * exclude (path)
        from placed where l_returnflag <> 'N'""",
    "file_held": f"""
        select {KEY}, {HOSTS} as replicas
        from (select {KEY}, unnest(case when len(coalesce(replicas, [])) = 0 then [null] else replicas end) as r
              from file_rows) group by all""",
    "files": "select path, count(*) as blocks from file_rows group by path",
    "node_names": "select 'dn-' || s_suppkey as node from supplier",
    "node_numbers": numbered("select distinct node from node_names", [], ["node"]),
    "replicas": f"select {ID}, 'dn-' || l_suppkey as node from lines",
    "ranked": f"""
        select *, cast(row_number() over (partition by {ID}
               order by md5(block_id || ':' || node), node) - 1 as bigint) as position
        from (select distinct {ID}, node from replicas)""",
    "corrupt": f"select {KEY} from live_flags where l_returnflag = 'R'",
    "present": f"select {KEY} from live_flags where l_linestatus = 'O'",
    "requested": f"select {KEY} from live_flags where length >= 40000",
    "ledger": f"select {KEY} from live_flags where l_linestatus = 'F'",
    "local": f"select {KEY}, l_returnflag <> 'R' as is_valid, length = 17000 as is_symlink from live_flags",
    "halves": f"""
        select {KEY}, 'meta' as half, cast(7 as bigint) as size from store where length <> 14000
        union all select {KEY}, 'data', case when length = 37000 then length - 1 else length end
        from store where length <> 13000""",
    "both_halves": f"""
        select {KEY}, bool_or(half = 'meta') as has_meta, max(case when half = 'data' then size end) as data_size
        from halves group by {KEY}""",
    "finalized": """
        select event_id, 'BP-' || (user_id % 3) as pool_id, cast(user_id as bigint) as block_id,
               cast(floor(value * 1000) as bigint) as length, cast(1 as bigint) as gen_stamp,
               epoch_us(ts) as ts, event_type
        from events""",
    "events10": """
        select event_id as seq, 'dn-' || (user_id % 10) as node, epoch_us(ts) as ts_us, event_type,
               cast(floor(value * 1000) as bigint) as bytes, value
        from events""",
    "transfers": """
        select node, case when event_type in ('click', 'view') then 'backup' else 'restore' end as direction,
               ts_us, bytes from events10""",
    "by_minute": """
        select node, direction, (ts_us // 60000000) * 60000000 as minute_us,
               cast(sum(bytes) as bigint) as bytes, count(*) as n_transfers
        from transfers group by all""",
    "report_rows": """
        select strftime(ts, '%Y%m%d') as run_id, epoch_us(date_trunc('second', ts)) as ts_us,
               strftime(ts, '%Y%m%d%H%M%S') as stamp,
               case event_type when 'click' then 'deleteBackupBlock' when 'view' then 'backupRequestBatch'
                    when 'error' then 'deleteBackupBlockError' when 'signup' then 'restoreBlock'
                    else 'startBlockPoolCheck' end as event,
               event_type in ('click', 'error', 'signup') as is_block,
               'BP-' || (user_id % 3) as pool, cast(user_id as bigint) as block,
               cast(floor(value * 1000) as bigint) as length, event_id as gen_stamp,
               case event_type when 'purchase' then 'BP-' || (user_id % 3)
                    when 'view' then cast(cast(floor(value) as bigint) as varchar)
                    else 'ExtendedBlock [poolId=BP-' || (user_id % 3) || ', blockId=' || user_id || ', length='
                         || cast(floor(value * 1000) as bigint) || ', generationStamp=' || event_id || ']' end as detail
        from events""",
    "plan": f"""
        with l as (select distinct {KEY} from live), s as (select distinct {KEY} from store),
             j as (select coalesce(l.pool_id, s.pool_id) as pool_id, coalesce(l.block_id, s.block_id) as block_id,
                          coalesce(l.length, s.length) as length, coalesce(l.gen_stamp, s.gen_stamp) as gen_stamp,
                          l.pool_id is not null as in_live, s.pool_id is not null as in_store
                   from l full outer join s on l.pool_id = s.pool_id and l.block_id = s.block_id
                        and l.length = s.length and l.gen_stamp = s.gen_stamp)
        select {KEY}, case when in_live and in_store then 'in_sync' when in_live then 'backup'
               when pool_id not in (select pool_id from l) then 'restore'
               when (pool_id, block_id) in (select (pool_id, block_id) from l) then 'delete_stale'
               else 'delete_orphan' end as action
        from j""",
    "todo": f"select * from plan where action <> 'in_sync'",
    "gc_rows": f"select {KEY} from store anti join live using ({KEY})",
    "docs": """
        select source as pool_id, cast(doc_id as bigint) as block_id,
               cast(octet_length(encode(text)) as bigint) as length, cast(1 as bigint) as gen_stamp, text, lang
        from documents""",
    "docs_plan": """
        select source as pool_id, cast(doc_id as bigint) as block_id,
               cast(case when lang = 'en' then octet_length(encode(text)) else n_chars end as bigint) as length,
               cast(1 as bigint) as gen_stamp from documents
        union all select 'pages', cast(page_id as bigint), 1, 1 from pages""",
    "copied": f"""
        select p.pool_id, p.block_id, p.length, p.gen_stamp, coalesce(d.length, 0) as n_bytes,
               case when d.length = p.length then md5(d.text) end as data,
               case when d.length = p.length then md5(array_to_string({chunks('d.text')}, ',')) end as meta,
               case when d.length is null then 'no_payload' when d.length = p.length then 'ok'
                    else 'length_mismatch' end as status
        from docs_plan p left join docs d using (pool_id, block_id, gen_stamp)""",
    "listing": """
        select '/backup/' || pool_id || '/' || block_id || '_' || gen_stamp || '.' || half as path, length,
               pool_id, block_id, gen_stamp, half
        from store, (values ('data'), ('meta')) as h(half)""",
    "wins": f"""
        select pool_id, block_id, min(ts) as t0, 0 as k from finalized group by all
        union all
        select w.pool_id, w.block_id, (select min(ts) from finalized f where f.pool_id = w.pool_id
               and f.block_id = w.block_id and f.ts > w.t0 + {AGE_US}), w.k + 1
        from wins w where w.t0 is not null""",
    "windows": f"""
        with w as (select pool_id, block_id, t0 from wins where t0 is not null),
             m as (select f.*, w.t0 from finalized f asof join w
                   on f.pool_id = w.pool_id and f.block_id = w.block_id and f.ts >= w.t0)
        select pool_id, block_id,
               arg_max(length, (length, -ts)) as length, cast(1 as bigint) as gen_stamp,
               t0 as opened_us, t0 + {AGE_US} as due_us, count(*) as n_events
        from m group by pool_id, block_id, t0""",
    "arrived": """
        select *, (day(make_timestamp(ts)) - 1) // 8 + cast(event_id % 17 = 0 as integer) as file from finalized""",
    "marks": f"select file, max(max(ts)) over (order by file rows between unbounded preceding and 1 preceding) // 1000 * 1000 - {48 * 3600000000} as mark from arrived group by file",
    "timely": "select a.*, coalesce(ts <= mark, false) as late from arrived a join marks using (file)",
    "kept_wins": f"""
        select pool_id, block_id, min(ts) as t0 from timely where not late group by all
        union all
        select w.pool_id, w.block_id, (select min(ts) from timely f where not late and f.pool_id = w.pool_id
               and f.block_id = w.block_id and f.ts > w.t0 + {AGE_US})
        from kept_wins w where w.t0 is not null""",
    "ttl_wins": f"""
        select pool_id, block_id, min(ts) as t0 from finalized group by all
        union all
        select w.pool_id, w.block_id, (select min(ts) from finalized f where f.pool_id = w.pool_id
               and f.block_id = w.block_id and f.ts >= w.t0 + {AGE_US})
        from ttl_wins w where w.t0 is not null""",
    "nodes_picked": f"""
        select c.*, n.node from (select *, {key_hash('0')} % (select count(*) from node_numbers) as no from corrupt) c
        join node_numbers n on c.no = n.row_no""",
    "checked": f"""
        select l.*, case when exists (select 1 from store s where s.pool_id = l.pool_id and s.block_id = l.block_id
               and s.length = l.length and s.gen_stamp = l.gen_stamp) then 'already_stored'
               when not is_valid then 'not_valid' when is_symlink then 'symbolic_link' else 'eligible' end as reason
        from local l""",
    "audit_live": f"""
        select {KEY}, replicas from file_rows where {{kept}}
        union all select {KEY}, replicas from snap_rows where {{kept}}""",
    "audit_held": f"""
        select {KEY}, {HOSTS} as replicas
        from (select {KEY}, unnest(case when len(coalesce(replicas, [])) = 0 then [null] else replicas end) as r
              from audit_live) group by all""",
    "audit_plan": f"""
        with l as (select distinct {KEY} from audit_live), s as (select distinct {KEY} from store)
        select l.*, 'backup' as action from l anti join s using ({KEY})
        union all
        select s.*, case when pool_id not in (select pool_id from l) then 'restore'
               when (pool_id, block_id) in (select (pool_id, block_id) from l) then 'delete_stale'
               else 'delete_orphan' end from s anti join l using ({KEY})
        where pool_id in (select pool_id from l) or block_id not in (select block_id from l)""",
    "audit_batches": numbered("select * from audit_plan", ["pool_id", "action"], KEYS4, 100),
}
NOT_IGNORED = (
    "path not like '/wh/P/%' and path not like '/wh/F/1997/%'"
    " and path not like '/wh/O/19/%' and path not like '/wh/O/2000/12/%'"
)
PARTS["audit_live"] = PARTS["audit_live"].format(kept=NOT_IGNORED)
RECURSIVE = {"wins", "ttl_wins", "kept_wins"}


CORRUPT_STORED = f"select * from corrupt semi join store using ({KEY}) anti join present using ({KEY})"
CORRUPT_DOCS = f"select {KEY} from docs where block_id % 3 <> 0 and block_id % 7 <> 0 and lang <> 'de'"
NOT_FORCED = f"select {KEY}, 0 as asked_at from corrupt where false"
FORCED = f"select {KEY}, 6 as asked_at from corrupt where block_id % 5 = 0"
FORCED_DOCS = f"select {KEY}, 12 as asked_at from docs where block_id % 30 = 0"


def restore_polls(seen, forced, busy, among="true"):
    """Requests of the polls at minute 0, 6 and 12. `seen` and `forced` tell of the rows of a poll, m being its minute."""
    start, minute, rounds = 1704067200000000, 60_000_000, []
    for r, m in enumerate((0, 6, 12)):
        before = [(q, n) for q, n in enumerate((0, 6, 12)) if n < m]
        blocked = [f"(force or ({KEY}) not in (select ({KEY}) from r{q} where accepted))" for q, n in before if n + 10 > m]
        full = [f"(select count(*) from r{q} x where x.accepted and x.node = p.node)" for q, n in before if n + busy > m]
        number = start // (6 * minute) + m // 6
        rounds.append(f"""
            r{r} as (
              select *, row_number() over (partition by node order by {KEY}) <= 10 - ({' + '.join(['0', *full])}) as accepted
              from (select a.*, n.node from (select *, {key_hash("'0'", f"'{number}'")} % (select count(*) from nn) as no from (
                      select {KEY}, bool_or(force) as force, {start + m * minute} as requested_us
                      from (select *, false as force, {m} as m from ({seen}) union all
                            select * exclude (asked_at), true as force, {m} as m from ({forced}) where asked_at = {m}) group by {KEY})
                    where {' and '.join(['true', *blocked])}) a join nn n on a.no = n.row_no) p)""")
    nodes = numbered(f"select distinct node from node_names where {among}", [], ["node"])
    return f"with nn as ({nodes}), {','.join(rounds)} " + " union all ".join(f"select * from r{r}" for r in range(3))


WITH_ONE = "substr(node, -1) = '1'"
DAY = 24 * 3600 * 1_000_000


def poll_rounds(asked, polls, width, ttl, busy, capacity, among):
    """Requests of one poll after the other. `asked` has the blocks of each poll with time and force."""
    rounds, same = [], " and ".join(f"x.{c} = a.{c}" for c in KEYS4)
    for p in polls:
        before = [q for q in polls if q < p and (q + 1) * width + max(ttl, busy) > p * width]
        known = " union all ".join(["select * from nobody", *[f"select {KEY}, node, requested_us from p{q} where accepted" for q in before]])
        rounds.append(f"""
            k{p} as ({known}),
            p{p} as (
              select {KEY}, requested_us, force, node, row_number() over (partition by node order by requested_us, {KEY})
                     <= {capacity} - (select count(*) from k{p} x where x.node = b.node and x.requested_us + {busy} > {p * width}) as accepted
              from (select a.*, n.node from (select *, {key_hash("'0'", f"'{p}'")} % (select count(*) from nn) as no from ({asked})
                    where poll = {p}) a join nn n on a.no = n.row_no
                    where force or not exists (select 1 from k{p} x where {same} and x.requested_us + {ttl} > a.requested_us)) b)""")
    nodes = numbered(f"select distinct node from node_names where {among}", [], ["node"])
    nobody = f"select {KEY}, '' as node, cast(0 as bigint) as requested_us from store where false"
    return f"with nn as ({nodes}), nobody as ({nobody}), {','.join(rounds)} " + " union all ".join(f"select * from p{p}" for p in polls)


SEEN_POLLS = f"""
    select 'BP-9' as pool_id, block_id, cast(500 as bigint) as length, cast(7 as bigint) as gen_stamp, ts // {3 * DAY} as poll,
           min(ts) as requested_us, bool_or(force) as force
    from (select *, event_type = 'error' and block_id % 7 = 0 as force from finalized)
    where (force or block_id in (select c_custkey from customer))
      and (ts // {3 * DAY} + 1) * {3 * DAY} <= (select max(ts) from finalized) // 1000 * 1000 - 3600000000
    group by block_id, ts // {3 * DAY}"""


def with_parts(body: str) -> str:
    """Put the named parts a query uses, directly or not, in front of it."""
    order: list[str] = []

    def visit(text, busy=()):
        for name in PARTS:
            if name not in order and name not in busy and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(PARTS[name], (*busy, name))
                order.append(name)

    visit(body)
    if not order:
        return body
    word = "with recursive " if RECURSIVE & set(order) else "with "
    if body.strip().startswith("with "):
        body = f"select * from ({body.strip()})"
    return word + ",\n".join(f"{n} as ({PARTS[n].strip()})" for n in order) + "\n" + body.strip()


PLAN_BATCHES = numbered("select * from todo", ["pool_id", "action"], KEYS4, 100)
PLAN_EVENTS = f"""
    select cast(epoch_us(timestamp '2024-01-31 00:00:00') as bigint) as ts_us, row_no as seq,
           case when action = 'restore' then 'restoreBlock' else 'deleteBackupBlock' end as event,
           pool_id, cast(1 as bigint) as n_blocks, {BLOCK_TEXT} as detail
    from ({PLAN_BATCHES}) where action <> 'backup'
    union all
    select cast(epoch_us(timestamp '2024-01-31 00:00:00') as bigint), batch_no, 'backupRequestBatch', pool_id,
           count(*), cast(count(*) as varchar)
    from ({PLAN_BATCHES}) where action = 'backup' group by pool_id, batch_no"""

JSON = "'{{\"poolId\":\"' || pool_id || '\",\"blkid\":' || block_id || ',\"len\":' || length || ',\"genstamp\":' || gen_stamp || '}}'".replace("{{", "{").replace("}}", "}")

EVENTS = [
    "start",
    "complete",
    "startBlockMetaDataFetchFromNameNode",
    "completeBlockMetaDataFetchFromNameNode",
    "startBlockPoolCheck",
    "completeBlockPoolCheck",
    "startRestoreAll",
    "completeRestoreAll",
    "restoreBlock",
    "restoreBlockError",
    "startBackupAll",
    "completeBackupAll",
    "backupRequestBatch",
    "backupRequestError",
    "deleteBackupBlock",
    "deleteBackupBlockError",
    "statusBlockMetaDataFetchFromNameNode",
    "statusBlockMetaDataFetchFromBackStore",
    "statusExtendedBlocksFromNameNode",
    "statusExtendedBlocksFromBackStore",
]

FULL_KEYS = f"select {object_key('half')} as key, size from halves"
REASONS = f"""
    select {KEY}, case
        when {{r}} then 'already_requested' when not {{s}} then 'not_stored'
        when {{p}} then 'already_valid' else 'restore' end as reason from corrupt"""


def member(table):
    same = " and ".join(f"x.{c} = corrupt.{c}" for c in KEYS4)
    return f"exists (select 1 from {table} x where {same})"


def crc(polynomial):
    """Sums of chunks and of the whole, byte by byte, with the remainders worked out by shifting."""
    step = "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])"
    of = lambda part: f"xor(list_reduce({part}, {step}, 4294967295::bigint), 4294967295)"
    return f"""
        with r as (select list(x order by i) as t from (
               select i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, b: xor(c >> 1, {polynomial} * (c & 1)), i::bigint) as x
               from range(256) n(i))),
             b as (select {KEY}, t, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as b
                   from docs, r),
             m as (select {KEY}, list_transform(range((len(b) + 511) // 512), lambda i: {of("b[i * 512 + 1:i * 512 + 512]")}) as m, {of("b")} as whole from b)
        select {KEY}, cast(len(m) as bigint) as chunks, md5(array_to_string(m, ',')) as meta, whole as checksum from m"""


QUERIES = {
    "checksum_crc32": crc(0xEDB88320),
    "checksum_crc32c": crc(0x82F63B78),
    "live_blocks": f"select path, {KEY}, array_to_string(replicas, ',') as replicas from file_rows",
    "with_snapshots": f"""
        select {KEY}, array_to_string({HOSTS}, ',') as replicas
        from (select {KEY}, unnest(case when len(coalesce(replicas, [])) = 0 then [null] else replicas end) as r
              from (select * from file_rows union all by name select * from snap_rows)) group by {KEY}""",
    "store_from_keys": f"select {KEY} from halves where half = 'meta'",
    "store_from_files": f"select {KEY} from store",
    "list_store": f"select {KEY} from docs",
    "store_from_real_files": f"select {KEY} from docs",
    "gc_resumed": f"select {KEY}, cast(case when lang = 'en' then 0 else 1 end as bigint) as times from docs",
    "list_after": f"""
        select * from (select {object_key("'meta'")} as key, {KEY} from store)
        where key > 'meta/BP-2' order by key limit 10000""",
    "ignore_list": """
        select distinct '/wh/' || o_orderstatus || '/' || year(o_orderdate) || '/' || o_orderkey as path
        from orders where o_orderpriority <> '2-HIGH'""",
    "read_manifest": f"select {KEY} from store",
    "write_manifest": f"""
        select pool_id, batch_no, '{{"blocks":[' || string_agg({JSON}, ',' order by block_id, length, gen_stamp) || ']}}' as json
        from ({numbered("select * from store", ["pool_id"], KEYS4, 100)}) group by pool_id, batch_no""".replace("{{", "{").replace("}}", "}"),
    "json_blocks": f"select {JSON} as json, block_id, gen_stamp from store",
    "parse_reports": """
        select ts_us, event, case when is_block or event = 'startBlockPoolCheck' then pool end as pool_id,
               case when is_block then block end as block_id, case when is_block then length end as length,
               case when is_block then gen_stamp end as gen_stamp, detail from report_rows""",
    "backup_payload": "select * from copied",
    "write_payload": f"select {KEY}, data, meta from copied where status = 'ok'",
    "upsert_payload": f"select {KEY}, md5(case when lang = 'en' then '2:' || text else text end) as data from docs",
    "restore_payload": f"""
        with a as (select distinct {KEY} from docs_plan)
        select a.*, case when d.text is null then 'not_stored' when d.lang = 'de' then 'already_valid' else 'restored' end as status,
               case when d.text is null or d.lang = 'de' then 0 else d.length end as bytes_copied,
               case when d.lang <> 'de' then md5(d.text) end as data,
               case when d.lang <> 'de' then md5(array_to_string({chunks('d.text')}, ',')) end as meta
        from a left join docs d using ({KEY})""",
    "apply_deletes": f"select {KEY} from store anti join (select * from plan where action like 'delete%') using ({KEY})",
    "delete_keys": f"select half, {object_key('half', 'a/b/')} as key from gc_rows, (values ('meta'), ('data')) as h(half)",
    "purge": f"""
        select {object_key('half', 'a/')} as key, size from halves
        union all select {object_key('half')}, size from halves""",
    "write_report": PLAN_EVENTS,
    "checksum_meta": f"""
        select {KEY}, len({chunks('text')}) as chunks, md5(array_to_string({chunks('text')}, ',')) as meta from docs""",
    "verify_payload": f"""
        with r as (select *, case lang when 'fr' then replace(text, ' ', '_') when 'de' then text || 'x' else text end as now
                   from docs),
             b as (select {KEY}, cast(octet_length(encode(now)) as bigint) as n_bytes, {chunks('text')} as a, {chunks('now')} as b
                   from r)
        select {KEY}, n_bytes, cast(len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i])) as bigint)
               as bad_chunks,
               case when n_bytes <> length then 'length'
                    when len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i])) > 0
                    then 'checksum' else 'none' end as fault
        from b""",
    "render_keys": f"select {KEY}, half, {object_key('half', 'a/b/')} as key from store, (values ('meta'), ('data')) as h(half)",
    "parse_keys": f"""
        select {object_key('half', 'a/')} as key, half, {KEY}, null as error from halves
        union all select url, null, null, null, null, null, 'prefix' from pages
        union all select 'a/meta/' || url, null, null, null, null, null,
               case when len(string_split(url, '/')) <> 4 then 'segments' when split_part(url, '/', 1) = '' then 'pool'
                    else 'number' end from pages""",
    "parse_files": """
        select path, pool_id, block_id, length, gen_stamp, null as error from listing
        union all select url, null, null, null, null,
               case when regexp_extract(url, '([^/]+)/[^/]+$', 1) = '' then 'pool'
                    when not contains(regexp_extract(url, '([^/]+)$', 1), '.') then 'name' else 'number' end
        from pages""",
    "path_ancestors": """
        select path, path || ';' || regexp_replace(path, '/[^/]*$', '') || ';'
               || regexp_replace(path, '/[^/]*/[^/]*$', '') || ';/wh;/' as ancestors from files""",
    "drop_ignored": f"select path, blocks from files where {NOT_IGNORED}",
    "drop_ignored_long_list": f"select path, blocks from files where {NOT_IGNORED}",
    "has_block": f"select {KEY} from both_halves where has_meta and data_size = length",
    "half_uploads": f"""
        select {KEY}, data_size, case when data_size is null then 'data_missing' when not has_meta then 'meta_missing'
               else 'length_differs' end as fault
        from both_halves where data_size is null or not has_meta or data_size <> length""",
    "backup_eligible": "select * from checked",
    "check_pool": f"""
        select {KEY}, case when pool_id <> 'BP-1' then 'Block pool id ' || pool_id || ' does not match BP-1' end as error
        from store""",
    "unbackable": f"select {KEY} from file_held where replicas is null or len(replicas) = 0",
    "reconcile": "select * from plan",
    "reconcile_kept": "select * from plan",
    "pool_actions": """
        select pool_id, in_live, in_store, case when not in_live then 'restore_all' when not in_store then 'backup_all'
               else 'compare' end as rule
        from (select pool_id, bool_or(l) as in_live, bool_or(not l) as in_store
              from (select pool_id, true as l from live union all select pool_id, false from store) group by pool_id)""",
    "pools": "select pool_id from live union select pool_id from store",
    "restore_unknown": f"""
        select distinct {KEY} from store where pool_id not in (select pool_id from live)
        and block_id not in (select block_id from live)""",
    "gc": "select * from gc_rows",
    "gc_by_id": f"select {KEY} from store where block_id not in (select block_id from live)",
    "restore_candidates": REASONS.format(r=member("requested"), s=member("store"), p=member("present")),
    "to_validate": f"select {KEY} from local anti join ledger using ({KEY})",
    "to_validate_all": f"select {KEY} from local",
    "mark_validated": f"select {KEY} from ledger union select {KEY} from corrupt",
    "replica_lookup": f"""
        select {KEY}, coalesce(array_to_string(nodes, ','), '') as nodes
        from store_set left join (select {ID}, list_sort(list(distinct node)) as nodes from replicas group by {ID})
        using ({ID})""",
    "in_sync": f"select {KEY} from live intersect select {KEY} from store",
    "missing": f"select {KEY} from live except select {KEY} from store",
    "orphans": f"select {KEY} from store except select {KEY} from live",
    "dedupe": f"select {KEY}, array_to_string(replicas, ',') as replicas from file_held",
    "longest_pending": f"""
        select {ID}, arg_max(length, r) as length, arg_max(gen_stamp, r) as gen_stamp, arg_max(ts, r) + 5000000 as due_us,
               arg_max(event_type = 'error', r) as force, count(*) as n_pending
        from (select *, (length, -ts, gen_stamp, event_type = 'error') as r from finalized) group by {ID}""",
    "last_generation": "select * from live",
    "merge_replicas": f"""
        select {ID}, coalesce(array_to_string(list_sort(list(distinct 'dn-' || l_suppkey) filter (where l_returnflag <> 'N')), ','), '')
               as nodes, bool_and(l_returnflag = 'N') as no_answer
        from lines group by {ID}""",
    "gc_totals": """
        select (select count(*) from store) as store_blocks, (select cast(sum(length) as bigint) from store) as store_bytes,
               (select count(*) from gc_rows) as deleted_blocks,
               (select cast(sum(length) as bigint) from gc_rows) as deleted_bytes, cast(0 as bigint) as errors""",
    "cluster_stats": """
        select cast(sum(s_suppkey % 5) as bigint) as backups_in_progress, round(sum(s_acctbal), 2) as backup_bytes_per_second,
               cast(sum(s_suppkey % 3) as bigint) as restore_blocks, cast(sum(s_suppkey % 2) as bigint) as restores_in_progress,
               round(sum(s_acctbal / 2), 2) as restore_bytes_per_second, count(*) as nodes
        from supplier where s_acctbal >= 0""",
    "throughput": f"""
        with s as (select node, direction, ts_us // 5000000 as tick, sum(bytes) as bytes from transfers group by all),
             l as (select *, max(tick) over (partition by node, direction) as last from s)
        select node, direction, round(sum(bytes / 5 * {ALPHA!r} * power({1 - ALPHA!r}, last - tick)), 4) as bytes_per_second,
               cast(sum(bytes) as bigint) as total_bytes
        from l group by node, direction""",
    "throughput_by_minute": "select * from by_minute",
    "retry_drop_metrics": """
        select node, count(*) filter (where event_type <> 'error') as retries,
               count(*) filter (where event_type = 'error') as drops,
               min(cast(floor(value) as bigint)) as min_amount, max(cast(floor(value) as bigint)) as max_amount,
               quantile_disc(cast(floor(value) as bigint), 0.5) as p50, quantile_disc(cast(floor(value) as bigint), 0.95) as p95,
               quantile_disc(cast(floor(value) as bigint), 0.99) as p99
        from events10 group by node""",
    "retry_distribution": """
        select node, count(*) as n_amounts, min(cast(floor(value) as bigint)) as min_amount,
               max(cast(floor(value) as bigint)) as max_amount, true as p50_near, true as p95_near, true as p99_near
        from events10 where value is not null group by node""",
    "report_summary": "select run_id, case when event <> 'backupRequestBatch' then pool end as pool_id, "
    + ", ".join(f"count(*) filter (where event = '{e}') as {e}" for e in EVENTS)
    + " from report_rows group by run_id, case when event <> 'backupRequestBatch' then pool end",
    "assign_batches": PLAN_BATCHES,
    "pick_replica": f"""
        select {KEY}, case when len(coalesce(replicas, [])) > 0 then replicas[1 + {key_hash('0')} % len(replicas)] end as replica
        from file_held""",
    "pick_node": f"select {KEY}, node from nodes_picked",
    "elect_owner": f"""
        with a as (select distinct {ID}, node from (select {ID}, 'dn-' || (l_partkey % 100) as node from lines
                   union all select {ID}, node from replicas))
        select a.*, position, case when position is null then 'force' when position = 0 then 'backup' else 'wait' end as decision,
               coalesce(position, 0) * 60000 as wait_ms
        from a left join ranked using ({ID}, node)""",
    "coalesce_requests": "select * from windows",
    "ttl_dedupe": f"""
        with w as (select * from ttl_wins where t0 is not null),
             m as (select f.*, w.t0 from finalized f asof join w
                   on f.pool_id = w.pool_id and f.block_id = w.block_id and f.ts >= w.t0)
        select {ID}, cast(1 as bigint) as length, cast(1 as bigint) as gen_stamp, t0 as ts_us, count(*) - 1 as n_ignored
        from m group by {ID}, t0""",
    "queue_depth": """
        select seq, node, ts_us, cast(d as bigint) as delta,
               cast(sum(d) over (partition by node order by ts_us, seq rows unbounded preceding) as bigint) as depth
        from (select *, case when event_type in ('click', 'view', 'purchase') then 1 else -1 end as d from events10)""",
    "sort_inventory": f"""
        select {KEY}, row_number() over (order by pool_id, block_id, gen_stamp, length) - 1 as position from store""",
    "next_due": f"""
        select {KEY}, event_type = 'error' as force, ts + 5000000 as due_us from finalized
        where ts + 5000000 <= epoch_us(timestamp '2024-01-15 00:00:00') order by due_us, {KEY} limit 1000""",
    "admit": f"""
        select {KEY}, node, row_number() over (partition by node order by gen_stamp, {KEY}) <= 10 as accepted
        from nodes_picked""",
    "block_check": f"""
        select b.*, case when b.action = 'backup' and len(coalesce(h.replicas, [])) > 0
               then h.replicas[1 + {h32('b.pool_id', 'b.block_id', 'b.length', 'b.gen_stamp', '0')} % len(h.replicas)] end as replica
        from audit_batches b left join audit_held h using ({KEY})""",
    "block_check_report": f"""
        with p as (select pool_id from audit_live union select pool_id from store)
        select 'restoreBlock' as event, pool_id, count(*) as n, count(*) as n_blocks from audit_batches
        where action = 'restore' group by pool_id
        union all select 'deleteBackupBlock', pool_id, count(*), count(*) from audit_batches
        where action like 'delete%' group by pool_id
        union all select 'backupRequestBatch', pool_id, count(distinct batch_no), count(*) from audit_batches
        where action = 'backup' group by pool_id
        union all select e, pool_id, 1, null from p, (values ('startBlockPoolCheck'), ('completeBlockPoolCheck')) as v(e)
        union all select e, null, 1, null from (values ('start'), ('complete'), ('startBlockMetaDataFetchFromNameNode'),
               ('completeBlockMetaDataFetchFromNameNode')) as v(e)
        union all select e, pool_id, 1, null from p, (values ('startRestoreAll'), ('completeRestoreAll')) as v(e)
        where pool_id not in (select pool_id from audit_live)
        union all select e, pool_id, 1, null from p, (values ('startBackupAll'), ('completeBackupAll')) as v(e)
        where pool_id not in (select pool_id from store)""",
    "gc_run": numbered("select *, 'delete' as action from gc_rows", ["pool_id", "action"], KEYS4, 100),
    "gc_run_totals": """
        with d as (select * from store where block_id not in (select block_id from live))
        select (select count(*) from store) as store_blocks, (select cast(sum(length) as bigint) from store) as store_bytes,
               (select count(*) from d) as deleted_blocks, (select cast(sum(length) as bigint) from d) as deleted_bytes,
               cast(0 as bigint) as errors""",
    "restore_run": f"select {KEY}, requested_us, node, accepted from ({restore_polls(CORRUPT_STORED, NOT_FORCED, 6)})",
    "restore_run_busy": f"select {KEY}, requested_us, force, node, accepted from ({restore_polls(CORRUPT_STORED, FORCED, 7)})",
    "restore_run_copied": f"""
        with a as (select distinct {KEY} from ({restore_polls(CORRUPT_DOCS, FORCED_DOCS, 6, WITH_ONE)}) where accepted)
        select a.*, case when d.lang = 'de' then 'already_valid' else 'restored' end as status,
               case when d.lang = 'de' then 0 else d.length end as bytes_copied,
               case when d.lang <> 'de' then md5(d.text) end as data,
               case when d.lang <> 'de' then md5(array_to_string({chunks('d.text')}, ',')) end as meta
        from a join docs d using ({KEY})""",
    "node_validate": f"select * from checked anti join ledger using ({KEY})",
    "node_validate_ledger": f"""
        select {KEY} from ledger union
        select {KEY} from checked anti join ledger using ({KEY}) anti join requested using ({KEY}) where reason <> 'eligible'""",
    "converge": f"""
        select {KEY}, 'in_sync' as action from live
        union select {KEY}, 'restore' from store where pool_id not in (select pool_id from live)""",
    "converge_store": f"""
        select {KEY} from store where pool_id not in (select pool_id from live)
        union all select {KEY} from store semi join live using ({KEY}) union all select {KEY} from live anti join store using ({KEY})""",
    "converge_copied": f"""
        select p.*, case when p.block_id % 3 = 0 or d.length = p.length then 'in_sync' else 'backup' end as action
        from (select distinct {KEY} from docs_plan) p left join docs d using (pool_id, block_id, gen_stamp)""",
    "node_validate_copied": f"""
        with l as (select {KEY} from docs_plan where pool_id <> 'pages'), t as (select * from l where block_id % 4 <> 0),
             c as (select *, case when block_id % 3 = 0 then 'already_stored' when block_id % 5 = 0 then 'not_valid'
                   when block_id % 11 = 0 then 'symbolic_link' else 'eligible' end as reason from t),
             p as (select c.*, case when d.length = c.length then 'ok' else 'length_mismatch' end as status
                   from c join docs d using (pool_id, block_id, gen_stamp) where reason = 'eligible')
        select {KEY}, 'marked' as status from l where block_id % 4 = 0
        union all select {KEY}, 'marked' from c where reason <> 'eligible'
        union all select {KEY}, 'marked' from p where status = 'ok'
        union all select {KEY}, status from p""",
    "merge_payload": f"select {KEY}, md5(case when lang = 'en' then '2:' || text else text end) as data from docs",
    "write_report_clean": PLAN_EVENTS,
    "report_debug": f"""
        select case when action = 'restore' then 'restoreBlock' else 'deleteBackupBlock' end as event, pool_id, row_no as seq,
               cast(1 as bigint) as n_blocks, md5({BLOCK_TEXT}) as detail
        from ({PLAN_BATCHES}) where action <> 'backup'
        union all
        select 'backupRequestBatch', pool_id, batch_no, count(*), md5(string_agg({BLOCK_TEXT}, ' ' order by {BLOCK_TEXT}))
        from ({PLAN_BATCHES}) where action = 'backup' group by pool_id, batch_no""",
    "drop_reports": """
        select run_id || '000000' as run_id, case when event like '%Error' then event else 'plan' end as step, count(*) as n
        from report_rows where run_id >= '20240124' group by all""",
    "prune_reports": """
        select 'report.' || strftime(ts, '%Y%m%d%H%M%S') as name from events
        where event_type not in ('error', 'signup')
        and date_trunc('second', ts) + interval 7 days < timestamp '2024-01-31 00:00:00'""",
    "apply_deletes_with": f"""
        with b as ({numbered("select *, 'delete' as action from gc_rows", ["pool_id", "action"], KEYS4, 100)}),
             f as (select pool_id, batch_no, max(length) >= 50000 as bad from b group by all)
        select {KEY}, not bad as ok, case when bad then 'OSError: block too long' end as error
        from b join f using (pool_id, batch_no)""",
    "error_report": f"""
        with b as ({numbered("select *, 'delete' as action from gc_rows", ["pool_id", "action"], KEYS4, 100)}),
             f as (select pool_id, batch_no, max(length) >= 50000 as bad from b group by all)
        select 'deleteBackupBlockError' as event, pool_id, 1 as n_blocks,
               'ExtendedBlock [poolId=' || pool_id || ', blockId=' || block_id || ', length=' || length || ', generationStamp='
               || gen_stamp || '] OSError: block too long' as detail
        from b join f using (pool_id, batch_no) where bad""",
    "gc_run_store": f"select {KEY} from store anti join gc_rows using ({KEY})",
    "send_requests_with": f"""
        with p as (select {KEY}, case when len(coalesce(replicas, [])) > 0
                   then replicas[1 + {key_hash('0')} % len(replicas)] end as replica from file_held)
        select {KEY}, coalesce(replica <> '10.0.0.7:50020', false) as ok,
               case when replica is null then 'no replica' when replica = '10.0.0.7:50020' then 'OSError: no route' end as error
        from p""",
    "stream_backup_requests": "select * from windows where due_us < (select max(ts) from finalized) // 1000 * 1000",
    "stream_restore_requests": f"""
        with recursive seen as (select block_id, ts from finalized where block_id in (select c_custkey from customer)),
        w as (select block_id, min(ts) as t0 from seen group by all
              union all select block_id, (select min(ts) from seen s where s.block_id = w.block_id and s.ts >= w.t0 + {AGE_US})
              from w where t0 is not null)
        select 'BP-9' as pool_id, block_id, cast(500 as bigint) as length, cast(7 as bigint) as gen_stamp, t0 as ts_us
        from w where t0 is not null and t0 <= (select max(ts) from finalized) // 1000 * 1000""",
    "stream_backup_late": f"""
        with w as (select pool_id, block_id, t0 from kept_wins where t0 is not null),
             m as (select f.*, w.t0 from (select * from timely where not late) f asof join w
                   on f.pool_id = w.pool_id and f.block_id = w.block_id and f.ts >= w.t0)
        select pool_id, block_id, arg_max(length, (length, -ts)) as length, cast(1 as bigint) as gen_stamp,
               t0 as opened_us, t0 + {AGE_US} as due_us, count(*) as n_events, false as late
        from m group by pool_id, block_id, t0
        having t0 + {AGE_US} < (select max(ts) from finalized) // 1000 * 1000 - {48 * 3600000000}
        union all select {KEY}, ts, null, 1, true from timely where late""",
    "stream_restore_polls": f"select * from ({poll_rounds(SEEN_POLLS, range(6574, 6585), 3 * DAY, 7 * DAY, 4 * DAY, 2, WITH_ONE)})",
    "stream_throughput": """
        select * from by_minute
        where minute_us + 60000000 <= (select max(ts_us) from transfers) // 1000 * 1000 - 60000000""",
    "with_retries": f"""
        with a as (select {KEY}, length % 1000 = 0 as bad from finalized), r as (select {KEY} from a where bad)
        select {KEY}, case when bad then 'retry' else 'done' end as state, cast(bad as integer) as attempt, bad as force,
               cast(0 as bigint) as batch_id, case when bad then 1704067260000000 end as due_us from a
        union all select {KEY}, 'retry', 2, true, 1, 1704067380000000 from r
        union all select {KEY}, 'retry', 3, true, 2, 1704067500000000 from r""",
    "retry_step": f"""
        select {KEY}, case when length % 1000 <> 0 then 'done' else 'retry' end as state,
               cast(case when length % 1000 <> 0 then 1 else 2 end as bigint) as attempt, length % 1000 = 0 as force,
               case when length % 1000 = 0 then cast(epoch_us(timestamp '2024-01-31 00:01:00') as bigint) end as due_us
        from finalized""",
    "incremental_validate": f"select distinct {KEY} from lines anti join ledger using ({KEY})",
    "gc_pages": f"""
        select {KEY}, row_no, batch_no as page
        from ({numbered("select * from gc_rows", ["pool_id"], KEYS4, 1000)})""",
}


def oracle():
    return {name: with_parts(body) for name, body in QUERIES.items()}
