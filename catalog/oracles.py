"""The same results in DuckDB SQL, by folding scripts line by line.

The fold is a recursive query that keeps one state per script, so it shares nothing
with the windows and chunk summaries it is compared to.
"""

from __future__ import annotations

from catalog.samples import EVENT_LINE


def _fold(keep_versioned: bool = False) -> str:
    plain = "starts_with({0}, '/*')" + (" and not starts_with({0}, '/*!')" if keep_versioned else "")
    return f"""
with recursive script as (
  select user_id as script_idx, event_id as pos,
    row_number() over (partition by user_id order by event_id) as line_no,
    {EVENT_LINE} as line
  from events
),
walk as (
  select distinct script_idx, 0::bigint as line_no, null::bigint as pos, ''::varchar as line, ''::varchar as text,
    false as open_before, false as open_after, 0::bigint as depth_before, 0::bigint as depth_after,
    ';'::varchar as delimiter, false as ends, false as warned, 1::bigint as seq
  from script
  union all
  select script_idx, line_no, pos, line, text, open_before, open_after, depth_before, depth_after, delimiter,
    word = 'end' and depth_after = 0 or counts and delimiter = ';' and ends_with(bare, ';') as ends,
    word = 'end' and depth_before = 0 as warned, seq
  from (
    select *, case when counts and starts_with(bare, 'DELIMITER')
        then regexp_extract(bare, '^DELIMITER\\s*([^\\s]*)', 1) else old_delimiter end as delimiter
    from (
      select *, bare <> '' and word not in ('begin', 'end') and depth_after = 0
          and length(bare) >= length(old_delimiter) as counts
      from (
        select *, case word when 'begin' then depth_before + 1 when 'end' then greatest(depth_before - 1, 0)
            else depth_before end as depth_after
        from (
          select *, trim(text) as bare, lower(trim(trim(trim(text), ';'))) as word
          from (
            select *,
              case when open_before then ''
                when starts_with(line, '--') then ''
                when not ({plain.format("line")}) then line
                when not closes then ''
                when starts_with(rest, '--') or ({plain.format("rest")}) then ''
                else rest end as text,
              case when open_before then not closes
                when starts_with(line, '--') or not ({plain.format("line")}) then false
                when not closes then true
                else {plain.format("rest")} end as open_after
            from (
              select s.script_idx, s.line_no, s.pos, s.line, w.open_after as open_before,
                w.depth_after as depth_before, w.delimiter as old_delimiter,
                w.seq + w.ends::bigint as seq,
                contains(s.line, '*/') as closes,
                trim(regexp_extract(s.line, '^.*\\*/(.*)$', 1)) as rest
              from walk w join script s on s.script_idx = w.script_idx and s.line_no = w.line_no + 1
            )
          )
        )
      )
    )
  )
),
folded as (select * from walk where line_no > 0)
"""


_STATEMENTS = """
select script_idx, seq,
  string_agg(text, chr(10) order by line_no) filter (where text <> '') as text,
  bool_or(ends) as terminated,
  sum(length(line))::bigint as chars_read
from folded group by script_idx, seq
having count(*) filter (where text <> '') > 0
"""

_ORDER_LINES = """
with sized as (select greatest(2000, (count(*) // 10000 // 10 + 1) * 10) as width from orders),
edges as (
  select o.*, o_orderkey // 10 as statement, o_orderkey // width as script_idx,
    o_orderkey = min(o_orderkey) over (partition by o_orderkey // 10) as is_first,
    o_orderkey = max(o_orderkey) over (partition by o_orderkey // 10) as is_last
  from orders o, sized
),
rendered as (
  select script_idx, o_orderkey as place, 4 as part,
    '(' || o_orderkey || ',' || o_custkey || ',''' || o_orderstatus || ''','
      || round(o_totalprice * 100)::bigint || ',''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''','''
      || o_orderpriority || ''')' || case when is_last then ';' else ',' end as line
  from edges
  union all select script_idx, o_orderkey, 3, 'INSERT INTO `orders` VALUES' from edges where is_first
  union all select script_idx, o_orderkey, 2, '/*!40000 ALTER TABLE `orders` DISABLE KEYS */;'
    from edges where is_first and statement % 5 = 0
  union all select script_idx, o_orderkey, 1, '' from edges where is_first and statement % 5 = 0
  union all select script_idx, o_orderkey, 0, '-- chunk ' || statement || ';'
    from edges where is_first and statement % 5 = 0
)
"""

_ORDERS = """
select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 100) / 100.0::double as o_totalprice,
  o_orderdate, o_orderpriority
from orders
"""

# The damaged dump, statement by statement: what is wrong with each before keys are looked
# at, its text, and a walk that keeps the list of keys taken so far.
_ACCOUNTS = """
with recursive sized as (select greatest(300, (count(*) // 10000 // 3 + 1) * 3) as width from customer),
entries as (
  select c_custkey, c_custkey // 3 as statement, c_custkey // width as script_idx, c_custkey % 400 as id, width,
    case when statement % 17 = 7 then 'NULL' when statement % 23 = 3 then '''x' || (c_custkey % 400) || ''''
      else (c_custkey % 400)::varchar end as id_text,
    '(' || id_text || ',''' || c_name || ''',' || round(c_acctbal * 100)::bigint
      || case when statement % 19 = 11 then ',1' else '' end || ')' as tuple
  from customer, sized
),
dump as (
  select statement, min(script_idx) as script_idx, list(id) as ids,
    case when statement % 29 = 20 then 'CALL audit'
      when statement % 13 = 5 then 'INSERT INTO `ledger` VALUES' else 'INSERT INTO `accounts` VALUES' end
      || chr(10) || string_agg(tuple, ',' || chr(10) order by c_custkey) || ';' as text,
    case when statement % 29 = 20 then 'unsupported'
      when statement % 13 = 5 then 'unknown_table'
      when statement % 19 = 11 then 'arity'
      when statement % 17 = 7 then 'null_key'
      when statement % 23 = 3 then 'cast' end as problem
  from entries group by statement
),
lines_before as (
  select statement, text, 0 as extra, script_idx, ids, problem from dump
  union all
  select statement, 'UPDATE `accounts` SET balance = 0;', -1, script_idx, ids, 'unsupported' from dump
  where statement % 29 = 20
),
ordered as (
  select *, row_number() over (partition by script_idx order by statement, extra) as seq,
    row_number() over (order by script_idx, statement, extra) as step
  from lines_before
),
walk as (
  select 0::bigint as step, null::bigint as script_idx, null::bigint as seq, null::varchar as text,
    null::varchar as status, null::varchar as reason, (select list(n_nationkey::bigint + 350) from nation) as taken
  union all
  select o.step, o.script_idx, o.seq, o.text,
    case when o.problem = 'unsupported' then 'skipped' when o.problem is not null then 'failed'
      when list_has_any(w.taken, o.ids) then 'failed' else 'ok' end,
    case when o.problem is not null then o.problem
      when list_has_any(w.taken, o.ids) then 'duplicate_key' end,
    case when o.problem is not null or list_has_any(w.taken, o.ids) then w.taken
      else list_concat(w.taken, o.ids) end
  from walk w join ordered o on o.step = w.step + 1
)
"""

# Rows of one key in run order, those in the table before the run first.
_MEETING = """
with sized as (select greatest(300, (count(*) // 10000 // 3 + 1) * 3) as width from customer),
met as (
  select (c_custkey % 400)::integer as id, c_name as name, round(c_acctbal * 100)::bigint as cents,
    c_custkey // width as script_idx, c_custkey as place
  from customer, sized
  union all select (n_nationkey + 350)::integer, n_name, 7, -1, 0 from nation
),
ordered as (
  select *, row_number() over (partition by id order by script_idx, place) as nth,
    row_number() over (partition by id order by script_idx desc, place desc) as from_end
  from met
)
"""

_SCRIPT_LINES = f"""{_ORDER_LINES}
select script_idx, row_number() over (partition by script_idx order by place, part) as line_no, line from rendered"""

ORACLES = {
    "script_lines": _SCRIPT_LINES,
    "script_lines_packed": _SCRIPT_LINES,
    "script_lines_utf16": _SCRIPT_LINES,
    "script_manifest": f"""{_ORDER_LINES},
sizes as (select script_idx, sum(octet_length(line::blob) + 1)::bigint as file_bytes from rendered group by script_idx)
select * from sizes
union all select (select count(*) from sizes), file_bytes from sizes where script_idx = 0""",
    "script_long_lines": f"""{_ORDER_LINES},
written as (
  select script_idx, 1::bigint as line_no,
    'INSERT INTO `orders` VALUES ' || string_agg(line[:-2], ',' order by place) || ';' as line
  from rendered where part = 4 group by script_idx
  union all select distinct script_idx, 2, '-- rows done,' from rendered
)
select script_idx, line_no, length(line) as chars, length(line) <= 65536 as whole, line[:40] as begins, line[-40:] as ends
from written""",
    "comment_state": f"{_fold()} select script_idx, pos, open_before, open_after from folded",
    "kept_lines": f"{_fold()} select script_idx, pos, text from folded where text <> ''",
    "kept_lines_versioned": f"{_fold(True)} select script_idx, pos, text from folded where text <> ''",
    "block_depth": f"{_fold()} select script_idx, pos, depth_before, depth_after from folded",
    "block_warnings": f"{_fold()} select script_idx, pos, seq from folded where warned",
    "delimiter_state": f"{_fold()} select script_idx, pos, delimiter from folded",
    "statement_bounds": f"""{_fold()}
select script_idx, seq, min(pos) filter (where text <> '') as first_pos, max(pos) filter (where text <> '') as last_pos,
  count(*) filter (where text <> '') as kept_lines, bool_or(ends) as terminated
from folded group by script_idx, seq having kept_lines > 0""",
    "statements": f"{_fold()} {_STATEMENTS}",
    "unterminated": f"""{_fold()}
select script_idx, seq, text, chars_read from ({_STATEMENTS}) where not terminated""",
    "statements_documents": """
with pieces as (
  select doc_id as script_idx, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from documents
)
select script_idx, 1::bigint as seq, string_agg(line, chr(10) order by line_no) filter (where line <> '') as text,
  false as terminated,
  sum(length(line) + length(regexp_replace(line, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::bigint as chars_read
from pieces group by script_idx having count(*) filter (where line <> '') > 0""",
    "statement_progress": f"""{_fold()},
sizes as (select script_idx, sum(octet_length(line::blob) + 1)::bigint as file_bytes from folded group by script_idx),
told as ({_STATEMENTS})
select script_idx, seq, chars_read, chars_done, file_bytes, script_idx + 1 as file_no,
  (select count(*) from sizes) as file_count, chars_done * 100.0::double / file_bytes as percent
from (select *, sum(chars_read) over (partition by script_idx order by seq)::bigint as chars_done from told)
join sizes using (script_idx)""",
    "restore_rows": _ORDERS,
    "restore_long_insert": _ORDERS,
    "restore_overwrite": _ORDERS,
    "restore_ignore": f"{_MEETING} select id, name, cents from ordered where nth = 1",
    "restore_replace": f"{_MEETING} select id, name, cents from ordered where from_end = 1",
    "restore_upsert": f"""{_MEETING}
select id, max(name) filter (from_end = 1) as name, sum(cents)::bigint as cents from ordered group by id""",
    "outcomes": f"{_ACCOUNTS} select script_idx, seq, status, reason from walk where step > 0",
    "outcomes_stop": f"""{_ACCOUNTS} select script_idx, seq, status, reason from walk
where step > 0 and step <= (select coalesce(min(step), (select max(step) from walk)) from walk where status = 'failed')""",
    "failures": f"{_ACCOUNTS} select script_idx, seq, text, reason from walk where status = 'failed'",
    # Statuses of all rows per pass: 0 open, 1 taken, 2 failed; the last pass has none open.
    "resume_statements": """
with recursive claims as (
  select *, dense_rank() over (order by script_idx, seq) as place
  from (
    select l_suppkey as script_idx, l_partkey as seq, l_orderkey, l_linenumber, count(*) as n
    from lineitem group by all
  )
),
passes as (
  select 0 as pass, script_idx, seq, place, l_orderkey, l_linenumber, n, 0 as status from claims
  union all
  select pass + 1, script_idx, seq, place, l_orderkey, l_linenumber, n,
    case when status > 0 then status
      when bool_or(key_taken or n > 1) over statement then 2
      when bool_and(key_first = place) over statement then 1
      else 0 end
  from (
    select *, bool_or(status = 1) over same_key as key_taken,
      min(case when status = 0 then place end) over same_key as key_first,
      bool_or(status = 0) over () as any_open
    from passes
    window same_key as (partition by l_orderkey, l_linenumber)
  )
  where any_open
  window statement as (partition by place)
)
select distinct script_idx, seq, status = 1 as taken from passes where pass = (select max(pass) from passes)""",
    # One statement after the other, with all keys taken so far.
    "resume_chain": """
with recursive held as (
  select event_id as seq, ts from events union all select event_id - 1, ts from events where event_id > 0
), ordered as (
  select *, row_number() over (order by seq) as step from (select seq, list(ts) as keys from held group by seq)
), walk as (
  select 0::bigint as step, null::bigint as seq, null::boolean as taken, []::timestamp[] as gone
  union all
  select o.step, o.seq, ok, case when ok then list_concat(w.gone, o.keys) else w.gone end
  from walk w join ordered o on o.step = w.step + 1,
    lateral (select len(o.keys) = len(list_distinct(o.keys)) and not list_has_any(w.gone, o.keys) as ok)
)
select 0::bigint as script_idx, seq, taken from walk where step > 0""",
    "resume_unique": """
with recursive ordered as (
  select *, row_number() over (order by script_idx, seq) as step
  from (
    select o_orderkey // 3000 as script_idx, o_orderkey // 3 as seq, list(o_orderdate) as dates,
      list(o_custkey || o_orderstatus) as customers
    from orders group by all
  )
), walk as (
  select 0::bigint as step, null::bigint as script_idx, null::bigint as seq, null::boolean as taken,
    (select list(o_orderdate) from orders where o_orderkey % 100 = 99) as gone_dates,
    (select list((o_custkey + 1) || o_orderstatus) from orders where o_orderkey % 100 = 99) as gone_customers
  union all
  select o.step, o.script_idx, o.seq, ok,
    case when ok then list_concat(w.gone_dates, o.dates) else w.gone_dates end,
    case when ok then list_concat(w.gone_customers, o.customers) else w.gone_customers end
  from walk w join ordered o on o.step = w.step + 1,
    lateral (select len(o.dates) = len(list_distinct(o.dates)) and len(o.customers) = len(list_distinct(o.customers))
      and not list_has_any(w.gone_dates, o.dates) and not list_has_any(w.gone_customers, o.customers) as ok)
)
select script_idx, seq, taken from walk where step > 0""",
}
