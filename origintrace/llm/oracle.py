"""SQL twins of the queries that SQL can express; the others are tested against brute force."""

OP1 = """
with usable as (
    select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
    where vec_id is not null and len(embedding) > 0
      and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)
), scored as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from (select vec_id, min(v) as v from usable where vec_id % 50 = 0 group by vec_id) q
    join usable c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
), ranked as (
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored
)
select * from ranked where rank <= 5
"""

OP6 = """
with rows as (
    select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
    from pages
), firsts as (
    select payload_digest, min(page_id) as first from rows where payload_bytes >= 100 group by payload_digest
), flagged as (
    select r.*, f.first, f.first is not null and r.page_id is distinct from f.first as again
    from rows r left join firsts f on r.payload_digest = f.payload_digest and r.payload_bytes >= 100
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
    case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to
from flagged
"""

OP11 = """
with lines as (
    select doc_id, x.i, x.line,
        translate(trim(x.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (
        select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda line, i: {'i': i, 'line': line})) as x
        from documents
    )
), keys as (
    select key, min(doc_id) as first from lines where length(key) >= 10 group by key having min(doc_id) <> max(doc_id)
), flagged as (
    select l.*, k.first is not null and k.first <> l.doc_id as lost from lines l left join keys k on l.key = k.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256
from flagged group by doc_id
"""

# CRC-32 is worked out bit by bit from the digits of the id; trees and paths grow by one level a step.
OP13 = """
with recursive rows as (
    select doc_id, lang, n_chars, list_reduce(
            [4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint),
            lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)
        ) as crc,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') as head,
        coalesce(strlen(text) || ':' || text, '-') as tail
    from documents
), hashed as (
    select *, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
        sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) as changed,
        xor(crc, 4294967295) % 7 = 0 as tampered
    from rows
), leaves as (
    select doc_id, lang, leaf, case when tampered then changed else leaf end as start,
        row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n
    from hashed
), nodes(lang, level, pos, n, node) as (
    select lang, 0, pos, n, leaf from leaves
    union all
    select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos))
    from nodes where n > 1 group by lang, level, pos // 2, (n + 1) // 2
), subroots as (
    select lang, node as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1
), tops(level, pos, n, node) as (
    select 0, pos, n, subroot from subroots
    union all
    select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos))
    from tops where n > 1 group by level, pos // 2, (n + 1) // 2
), climbs(doc_id, lang, first, level, pos, n, node, proof) as (
    select doc_id, lang, pos, 0, pos, n, start, '' from leaves
    union all
    select c.doc_id, c.lang, c.first, c.level + 1, c.pos // 2, (c.n + 1) // 2, sha256(case
            when s.node is null then c.node when c.pos % 2 = 1 then s.node || c.node else c.node || s.node end),
        c.proof || coalesce(s.node, '')
    from climbs c left join nodes s
        on s.lang is not distinct from c.lang and s.level = c.level and s.pos = xor(c.pos, 1)
    where c.n > 1
), rest(doc_id, lang, first, level, pos, n, node, proof) as (
    select c.doc_id, c.lang, c.first, 0, s.pos, s.n, c.node, c.proof
    from climbs c join subroots s on s.lang is not distinct from c.lang where c.n = 1
    union all
    select r.doc_id, r.lang, r.first, r.level + 1, r.pos // 2, (r.n + 1) // 2, sha256(case
            when t.node is null then r.node when r.pos % 2 = 1 then t.node || r.node else r.node || t.node end),
        r.proof || coalesce(t.node, '')
    from rest r left join tops t on t.level = r.level and t.pos = xor(r.pos, 1)
    where r.n > 1
)
select l.doc_id, l.leaf, s.subroot, t.node as root, sha256(r.proof) as proof_sha256, r.node as folded_root, r.node = t.node as verified
from leaves l join subroots s on s.lang is not distinct from l.lang
join rest r on r.lang is not distinct from l.lang and r.first = l.pos and r.n = 1
join tops t on t.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree": OP1, "op6_warc": OP6, "op11_line_dedup": OP11, "op13_merkle": OP13}
