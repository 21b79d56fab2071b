"""DuckDB SQL for the queries of this folder that SQL can express."""

_CONTROL = "<|im_end|><|im_start|>assistant ok"

OP2 = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}')
), sized as (
  select *,
    role = 'assistant' as trained,
    length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) as text_chars,
    length(regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '<(\\\\*)\\|', '<\\\\\\1|', 'g')) as role_chars,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
    row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as from_end
  from turns
)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (trained), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (trained), '')) as loss_sha256,
  cast(sum(text_chars + role_chars + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))) as bigint) as formatted_chars,
  bool_and(case before
    when 'system' then role = 'user'
    when 'user' then role = 'assistant'
    when 'assistant' then role in ('user', 'tool')
    when 'tool' then role = 'assistant'
    else before is null and role in ('system', 'user') end
    and (from_end > 1 or role = 'assistant')) as in_order
from sized group by conv_id
"""

OP4 = """
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from rest
), canon as (
  select *, case when host <> '' then regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') end as canonical from parts
), listed as (
  select distinct canonical from canon where canonical is not null and regexp_matches(host, 'casino|adult|bets|spam')
), ruled as (
  select *, canonical in (from listed) as hit,
    case
      when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/'
    end as rule
  from canon
)
select page_id, host, path, rule, coalesce(hit, false) as listed,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow'
       when rule is not null or coalesce(hit, false) then 'block' else 'allow' end as verdict
from ruled
"""

OP5 = """
with payloads as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), digests as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from payloads
), held as (
  select *, max(page_id) over (partition by payload_digest) as holder from digests
), typed as (
  select *, payload_bytes >= 1000 and page_id <> holder as again from held
)
select page_id, payload_bytes, payload_digest,
  case when again then 'revisit' else 'response' end as record_type,
  case when again then holder end as refers_to
from typed
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ALPHA = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""
with doc_terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_ALNUM}')) as term from documents
), item_terms as (
  select item_id, term, count(*) as times
  from (select item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_ALNUM}')) as term from benchmark)
  group by all
), sizes as (
  select doc_id, count(*) as n from doc_terms group by doc_id
), corpus as (
  select count(*) as docs, sum(n)::bigint as total from sizes
), tfs as (
  select doc_id, term, count(*) as tf from doc_terms where term in (select term from item_terms) group by all
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tfs, corpus group by term, docs
), parts as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) as part
  from tfs join weights using (term) join sizes using (doc_id), corpus
), scores as (
  select item_id, doc_id, sum(times * part)::bigint as score from parts join item_terms using (term) group by all
)
select item_id, rank::integer as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 10
"""


def _crc_of_bit(bit: int) -> int:
    """What one bit of a byte turns the checksum into; bytes are sums of their bits."""
    crc = 1 << bit
    for _ in range(8):
        crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    return crc


def _crc_of_byte(byte: str) -> str:
    parts = [f"case when ({byte} >> {bit}) & 1 = 1 then {_crc_of_bit(bit)} else 0 end" for bit in range(8)]
    return f"xor({parts[0]}, {_crc_of_rest(parts[1:])})"


def _crc_of_rest(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else f"xor({parts[0]}, {_crc_of_rest(parts[1:])})"


def _hilbert(dimensions: int, bits: int) -> str:
    """A query over `binned (x0, x1, ...)` that adds `curve`, one subquery for each step."""
    names = [f"x{k}" for k in range(dimensions)]
    sql = "binned"
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for k in range(dimensions):
            is_set = f"(x{k} >> {bit}) & 1 = 1"
            new = {"x0": f"case when {is_set} then xor(x0, {below}) else xor(x0, xor(x0, x{k}) & {below}) end"}
            if k:
                new[f"x{k}"] = f"case when {is_set} then x{k} else xor(x{k}, xor(x0, x{k}) & {below}) end"
            sql = f"(select * replace ({', '.join(f'{v} as {c}' for c, v in new.items())}) from {sql})"
    for k in range(1, dimensions):
        sql = f"(select * replace (xor(x{k}, x{k - 1}) as x{k}) from {sql})"
    flips = "0"
    for bit in range(bits - 1, 0, -1):
        flips = f"xor({flips}, case when (x{dimensions - 1} >> {bit}) & 1 = 1 then {(1 << bit) - 1} else 0 end)"
    sql = f"(select *, {flips} as flips from {sql})"
    sql = f"(select * replace ({', '.join(f'xor({c}, flips) as {c}' for c in names)}) from {sql})"
    woven = [f"(((x{k} >> {bit}) & 1) << {bit * dimensions + dimensions - 1 - k})" for bit in range(bits) for k in range(dimensions)]
    return f"select * exclude (flips), {' + '.join(woven)} as curve from {sql}"


OP12 = f"""
with bodies as (
  select doc_id, lang, source, n_chars, encode(coalesce(text, '')) as body from documents
), sums as (
  select doc_id, lang, source, n_chars, octet_length(body) + 16 as size,
    xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(body), '..'), lambda h: ('0x' || h)::bigint)),
      lambda crc, b: xor(crc >> 8, {_crc_of_byte("(xor(crc, b) & 255)")})
    ), 4294967295) as text_crc32
  from bodies
), binned as (
  select doc_id, size, text_crc32,
    {", ".join(
        f"case when {c} is null then 0 else (rank() over (order by {c} nulls last) - 1) * 32 // count({c}) over () end as x{k}"
        for k, c in enumerate(("lang", "source", "n_chars"))
    )}
  from sums
), curved as (
  {_hilbert(3, 5)}
), placed as (
  select *, row_number() over (order by curve, text_crc32, doc_id) - 1 as place, count(*) over () as n from curved
)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, (place * 40 // n)::integer as shard,
  place - (place * 40 // n * n + 39) // 40 as slot, null::integer as grown_shard, curve::bigint as curve
from placed
"""

OP13 = f"""
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text
  from documents
), terms as (
  select doc, lang, source, unnest(regexp_extract_all(text, '{_ALPHA}')) as term from docs
), kept as (
  select lang, term, count(*) as lang_n from terms group by all having count(distinct doc) >= 10
), groups as (
  select distinct lang, source from docs
), sizes as (
  select lang, source, coalesce(v, 0) as v, coalesce(lang_total, 0)::hugeint as lang_total
  from groups left join (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang) using (lang)
), counts as (
  select lang, source, term, count(*) as n from terms semi join kept using (lang, term) group by all
), grid as (
  select s.lang, s.source, s.v, s.lang_total, k.term, k.lang_n, coalesce(c.n, 0)::hugeint as n,
    sum(coalesce(c.n, 0)) over (partition by s.lang, s.source)::hugeint as total
  from sizes s join kept k on k.lang = s.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term
), shares as (
  select *, 1 + 1000000000::hugeint * (n + 2) // (total + 2 * v) as p,
    1 + 1000000000::hugeint * (lang_n + 2) // (lang_total + 2 * v) as q
  from grid
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
    from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) d on d.lang = a.lang and d.source = a.source and d.other = b.source
), told as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
  from shares where n > 0 and p > q
), both_parts as (
  select * from pairs union all select * from told
)
select lang, source, part, item, value, rank::integer as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts)
where part = 'pair' or rank <= 10
"""

ORACLES = {
    "op2_chat_format": OP2,
    "op4_url_filter": OP4,
    "op5_warc": OP5,
    "op11_lexical_search": OP11,
    "op12_hilbert_shards": OP12,
    "op13_source_audit": OP13,
}
