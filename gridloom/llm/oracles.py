"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from gridloom.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, run_lengths, template_words
from gridloom.llm.sharding import BLOCK_MULTIPLIER, MULTIPLIER

OP8 = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::double) as e
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""

#: Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters.
def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP1 = f"""
with line as (
    select doc_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)
), coded as (
    select doc_id, line_no, list_sort(list_distinct({_words("line")})) as w from line
), word_line as (select * from coded where len(w) > 0), sets as (
    select row_number() over (order by doc_id, line_no) as id, w, len(w) as n, doc_id, line_no
    from (select *, row_number() over (partition by w order by doc_id, line_no) as nth from word_line) where nth = 1
), word as (select id, n, unnest(w) as t from sets), similar_to as (
    select a.id, count(*) as shared, any_value(a.n) as n, any_value(b.n) as m
    from word a join word b on a.t = b.t and b.id < a.id and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n group by a.id, b.id
), gone as (select distinct id from similar_to where shared >= 0.8 * (n + m - shared) - 1e-9), kept as (
    select doc_id, line_no from sets where id not in (select id from gone)
), removed as (
    select doc_id, list(line_no::int order by line_no) as removed_lines from (select doc_id, line_no from word_line except select doc_id, line_no from kept) group by doc_id
)
select doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines, coalesce(len(removed_lines), 0)::bigint as n_removed, coalesce(removed_lines, []::int[]) as removed_lines
from documents left join removed using (doc_id)
"""

OP2 = f"""
with item as (
    select item_id, {_words("text")} as w from benchmark
), window_of as (
    select item_id, i - 1 as j, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as gram, least(len(w), 10) as m
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)
), doc as (
    select doc_id, {_words("text")} as w from documents
), place as (
    select doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') as gram
    from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from doc, (select distinct m from window_of) where len(w) >= m)
), found as (
    select p.doc_id, p.i, p.m, item_id, j from place p join window_of x on p.gram = x.gram and p.m = x.m
), hit as (
    select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(i, i + m)) as word from found) group by doc_id
), items as (
    select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct doc_id, item_id::varchar as id from found) group by doc_id
), run as (
    select doc_id, item_id::varchar as item, min(i) - 1 as start, min(j) as item_start, max(m) + count(*) - 1 as words
    from (select *, i - row_number() over (partition by doc_id, item_id, i - j order by i) as island from (select distinct * from found)) group by doc_id, item_id, i - j, island
), best as (
    select doc_id, item, start, item_start, words from run qualify row_number() over (partition by doc_id order by words desc, item, start, item_start) = 1
)
select doc_id, coalesce(best.words, 0)::bigint as longest_words, best.item as longest_item, best.start::bigint as longest_start, best.item_start::bigint as longest_item_start, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join items using (doc_id) left join best using (doc_id)
"""

def _phrase_rows() -> str:
    return ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())


def _template_rows() -> str:
    length = run_lengths(TEMPLATES)
    return ", ".join(f"('{k}', {ws}, {length[k]})" for k, ws in template_words(TEMPLATES).items())


OP7 = f"""
with phrase(phrase, label) as (values {_phrase_rows()}), template(name, t, n) as (values {_template_rows()}), doc as (
    select doc_id, {_words("text")} as w, coalesce(text, '') as text from documents
), place as (
    select doc_id, i - 1 as pos, label
    from (select doc_id, w, phrase, label, len(string_split(phrase, ' ')) as k, unnest(range(1, len(w) + 1)) as i from doc, phrase)
    where array_to_string(list_slice(w, i, i + k - 1), ' ') = phrase
), base as (
    select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as marks from place group by doc_id
), own as (
    select doc_id, name, max(share) as share
    from (select doc_id, name, len(list_intersect(list_distinct(list_slice(w, i, i + n - 1)), t))::double / len(t) as share
        from (select doc_id, w, name, t, n, unnest(range(1, len(w) + 1)) as i from doc, template) where list_contains(t, w[i]))
    where share >= {THRESHOLD} group by doc_id, name
), more as (select doc_id, list(name) as names, max(share) as best from own group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
    coalesce(array_to_string(list_sort(marks), ','), '') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(marks, []), coalesce(names, [])))), ',') as labels,
    case when n_base > 0 then 1.0::double else coalesce(best, 0)::double end as score
from doc left join base using (doc_id) left join more using (doc_id)
"""

_CRC = """
    select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
        case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end)) as t
"""

OP9 = f"""
with recursive crc_table as ({_CRC}), d as (
    select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 as size, hex(encode(coalesce(text, ''))) as h from documents
), c as (
    select doc_id, size, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, 2 * size - 1, 2), lambda i:
        ((instr('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::bigint)),
        lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) as text_crc32
    from d, crc_table
), jump(doc_id, n, b, j, k) as (
    select distinct doc_id, n, -1::bigint, 0::bigint, doc_id::hugeint from documents, (values (8), (9)) as x(n)
    union all
    select doc_id, n, j, floor((j + 1)::double * (2147483648.0::double / ((k2 >> 33)::bigint + 1)::double))::bigint, k2
    from (select *, (k * {MULTIPLIER}::hugeint + 1) % 18446744073709551616::hugeint as k2 from jump where j < n)
), place as (
    select doc_id, max(b) filter (n = 8) as shard, max(b) filter (n = 9) as grown_shard from jump where j >= n group by doc_id
)
select c.doc_id, c.size, c.text_crc32, 'key' as law, shard::int as shard,
    row_number() over (partition by shard order by (((c.doc_id::hugeint * {BLOCK_MULTIPLIER}::hugeint) % 18446744073709551616::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint) >> 56, c.doc_id) - 1 as slot, grown_shard::int as grown_shard
from c join place using (doc_id)
"""

OP13 = r"""
with smallest as (select coalesce(text, '') as body, min(doc_id) as least from documents group by 1),
mark as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
body as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), flagged as (
    select part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c,
        regexp_matches(t, '[#$%&*|]') as d, coalesce(body.doc_id > s.least, false) as e, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
    from body join smallest s on s.body = body.t left join mark on mark.doc_id = body.doc_id
), class as (
    select part, [a, b, c, d, e] as f, good, toxic, count(*) as n from flagged group by all
), letter as (select unnest(range(1, 6)) as k), orders as (
    select [a.k, b.k, c.k, d.k, e.k] as o from letter a, letter b, letter c, letter d, letter e
    where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), fate as (
    select part, o, s.k as step, n, good, toxic, f[o[s.k]] as fails, len(list_filter(o[1:s.k - 1], lambda x: f[x])) > 0 as earlier, len(list_filter(f, lambda x: x)) as failing
    from class, orders, letter s
), summed as (
    select part, o, step, sum(n)::bigint as total, coalesce(sum(n) filter (fails and not earlier), 0)::bigint as removed, coalesce(sum(n) filter (fails and earlier), 0)::bigint as redundant,
        coalesce(sum(n) filter (fails and failing = 1), 0)::bigint as unique_fails,
        coalesce(sum(n) filter (fails and not earlier and good = 1), 0)::bigint as good_lost, coalesce(sum(n) filter (fails and not earlier and toxic = 1), 0)::bigint as toxic_lost
    from fate group by 1, 2, 3
)
select part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') as filter_order, step::int as step,
    (total - sum(removed) over (partition by part, o order by step))::bigint as kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, o[step]))::bigint as shapley
from summed
"""

OP11 = r"""
with own as (
    select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
    from conversations where conv_id is not null group by 1
), bit(k, v) as (
    select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) from range(256) t(i)
), coded as (select list(v order by k) as crc_of from bit), shared as (
    select o.conv_id, o.turns, f.turns as head,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(o.conv_id::varchar) + 1), lambda i: ascii(substr(o.conv_id::varchar, i::int, 1))::bigint)),
            lambda c, x: xor(c // 256, crc_of[xor(c, x) % 256 + 1])), 4294967295) % 4 as h
    from own o cross join coded left join own f on f.conv_id = o.conv_id - o.conv_id % 20
), rebuilt as (
    select conv_id, list_concat(coalesce(head[1:h], []), coalesce(turns[h + 1:], [])) as turns from shared
), prefix as (
    select conv_id, d, turns[1:d] as k, d = len(turns) as ends from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from rebuilt)
), node as (
    select k, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ids from prefix group by 1, 2
), counted as (
    select n.*, p.conv_id as parent_conv_id, case when n.d = 0 then 0 else (n.n_convs - 1) * len(regexp_extract_all(n.k[-1].text, '[^\x20\x09-\x0D]+')) end as saved
    from node n left join node p on n.d > 0 and p.d = n.d - 1 and p.k = n.k[1:n.d - 1]
), kids as (select k[1:d - 1] as k, count(*) as n from node where d > 0 group by 1),
below as (
    select top.k, sum(c.saved) as saved, count(*) filter (kids.n is null) as leaves
    from (select *, unnest(range(d + 1)) as up from counted) c join node top on top.d = c.up and top.k = c.k[1:c.up] left join kids on kids.k = c.k group by 1
)
select c.conv_id, c.d::bigint as depth, c.parent_conv_id, c.n_convs::bigint as n_convs, coalesce(kids.n, 0)::bigint as n_children, below.leaves::bigint as n_leaves,
    below.saved::bigint as saved_tokens, sha256(c.ids) as ends_sha256
from counted c join below on below.k = c.k left join kids on kids.k = c.k
"""

ORACLES: dict[str, str] = {"op1_line_dedup": OP1, "op2_decontamination": OP2, "op7_licenses": OP7, "op8_topk": OP8, "op9_sharding": OP9, "op11_prefix_trie": OP11, "op13_filter_audit": OP13}
