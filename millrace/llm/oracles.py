"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_TRIMMED = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

#: (id, component) of all ids of ``nodes`` by the pairs of ``links`` (a, b in both directions).
_COMPONENTS = """reach(id, seen) as (
    select id, id from nodes union
    select reach.id, links.b from reach join links on links.a = reach.seen
), component as (select id, min(seen) as component_id from reach group by id)"""

LINES = f"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), keyed as (
    select *, {_LOWER.format(f"trim(line, {_TRIMMED})")} as key from lines
), shared as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
    select k.*, s.key is not null and k.doc_id <> s.keeper as dropped from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""

JACCARD = f"""
with recursive words as (
    select doc_id, {_WORDS.format(_LOWER.format("text"))} as w from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
    select x.doc_id as a, y.doc_id as b, count(*) as n_both from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all
), alike as (
    select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * n_both >= 90 * (p.n + q.n - n_both)
), links as (select a, b from alike union all select b, a from alike),
nodes as (select doc_id as id from documents),
{_COMPONENTS}
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id::bigint as component_id
from documents d join component c on c.id = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""

QUALITY = f"""
with words as (
    select doc_id, coalesce(text, '') as text, {_WORDS.format("text")} as w, string_split(coalesce(text, ''), chr(10)) as l from documents
), windows as (
    select doc_id, unnest(range(1, len(w) - 1)) as i, w from words
), spelled as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from windows),
repeated as (
    select distinct doc_id, unnest([i, i + 1, i + 2]) as i from (select *, count(*) over (partition by doc_id, s) as c from spelled) where c > 1
), repeats as (select doc_id, count(*) as n_repeat_words from repeated group by doc_id),
counts as (
    select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
        len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines
    from words left join repeats using (doc_id)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > 3 * greatest(n_words, 1)
        or (n_dup_lines >= 4 and 2 * n_dup_lines > n_lines) or word_chars > 40 * n_words or word_chars < 2 * n_words) as kept
from counts
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""
with hashed as (
    select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages
), named as (
    select page_id, n, array_to_string(list_transform(range(0, 32), lambda k:
        substr('{_BASE32}', (((('0x' || substr(h, ((k // 4) * 5 + 1)::int, 5))::int >> (15 - 5 * (k % 4))::int) & 31) + 1)::int, 1)), '') as digest from hashed
), placed as (select *, max(page_id) over (partition by digest, n) as first_id from named)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id <> first_id then first_id end as refers_to
from placed
"""

_SAID = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"
CHAT = f"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '{_SAID}' union all select -7, 1, 'assistant', '{_SAID}'
)
select conv_id::bigint as conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(14 + length(role) + length({_ESCAPED.format("text")}))::bigint as formatted_chars
from said group by conv_id
"""

PASSAGES = f"""
with words as (
    select doc_id, {_WORDS.format("text")} as w from documents
), spelled as (
    select doc_id, unnest(range(1, len(w) - 11)) as i, w from words where len(w) >= 13
), windows as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from spelled),
least as (select s, min(doc_id) as first_id from windows group by s having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, i + unnest(range(0, 13)) as i from windows join least using (s) where first_id < doc_id),
placed as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words)
select d.doc_id, count(p.i)::bigint as n_words, count(g.i)::bigint as n_removed,
    sha256(coalesce(string_agg(word, ' ' order by p.i) filter (where g.i is null), '')) as kept_sha256
from documents d left join placed p on p.doc_id = d.doc_id left join gone g on g.doc_id = p.doc_id and g.i = p.i group by d.doc_id
"""

VECTORS = f"""
with recursive usable as (
    select vec_id, embedding::double[] as v from embeddings
    where embedding is not null and len(embedding) > 0 and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)
), scaled as (select vec_id, v, sqrt(list_dot_product(v, v)) as norm from usable),
links as (
    select x.vec_id as a, y.vec_id as b from scaled x join scaled y on x.vec_id <> y.vec_id and len(x.v) = len(y.v)
    where x.norm > 0 and y.norm > 0 and list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.9
), nodes as (select vec_id as id from embeddings),
{_COMPONENTS}
select e.vec_id, count(l.b)::bigint as n_links, any_value(component_id)::bigint as component_id, e.vec_id = any_value(component_id) as kept
from embeddings e join component c on c.id = e.vec_id left join links l on l.a = e.vec_id group by e.vec_id
"""

MIX = f"""
with sized as (
    select doc_id, source, len({_WORDS.format("text")})::bigint as size, ('0x' || substr(md5('mix' || coalesce('/' || doc_id::varchar, '')), 1, 15))::bigint as key from documents
), sources as (
    select source, sum(size)::hugeint as n, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::hugeint as w from sized group by source
), ordered as (select *, row_number() over (order by n::double / w, source nulls last) as r from sources),
left_over as (
    select *, (select sum(n) from sources) - coalesce(sum(3 * n) over (order by r rows between unbounded preceding and 1 preceding), 0) as rest, sum(w) over (order by r rows between current row and unbounded following) as shares from ordered
), judged as (select *, 3 * n * shares <= rest * w as filled from left_over),
level as (select rest as lw, shares as ls from judged where not filled order by r limit 1),
targets as (
    select source, n, case when filled then (3 * n)::double else (lw * w)::double / ls::double end as target, case when filled then 3 * n else (2 * lw * w + ls) // (2 * ls) end as budget
    from judged left join level on true
), placed as (
    select *, sum(size) over (partition by source order by key, doc_id, size rows unbounded preceding) - size as before from sized
)
select doc_id, size, n::bigint as source_size, target,
    (case when n = 0 then 0 else (budget // n) * size + greatest(0, least(size, budget - (budget // n) * n - before)) end)::bigint as taken
from placed p join targets t on p.source is not distinct from t.source
"""

DIVERGENCE = r"""
with docs as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), said as (
    select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (select lang, term, count(*)::hugeint as n from said group by all having count(distinct r) >= 10),
groups as (select distinct lang, source from docs),
counts as (select s.lang, s.source, s.term, count(*)::hugeint as n from said s join kept k on k.lang = s.lang and k.term = s.term group by all),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
totals as (select lang, source, sum(n)::hugeint as total from counts group by all),
shares as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) as p, 1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) as q
    from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term left join totals t on t.lang = g.lang and t.source = g.source
), summed as (
    select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
), pairs as (
    select g.lang, g.source, h.source as item, coalesce(value, 0)::bigint as value from groups g join groups h on g.lang = h.lang and g.source <> h.source
    left join summed s on s.lang = g.lang and s.source = g.source and s.item = h.source
), terms as (select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from shares where n > 0 and p > q),
ranked as (
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
    union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms qualify row_number() over (partition by lang, source order by value desc, item) <= 10
)
select lang, source, part, item, value, rank::int as rank from ranked
"""

RUNS = r"""
with told as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda crc, c:
            list_reduce(list_transform(range(0, 8), lambda k: 0::bigint), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, c)), 4294967295::bigint), 4294967295::bigint) as h
    from documents
), placed as (
    select doc_id, w, len(w) as n, h, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) else 0 end as a from told
), periods as (select *, 1 + (n - a) // (3 + g % 8) as p from placed),
planted as (
    select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[(case when i < a then i else a + (i - a) % p end) + 1]) else w end as w from periods
), words as (select doc_id, n, unnest(range(0, n)) as i, unnest(w) as word from planted),
equal as (
    select x.doc_id, y.i - x.i as q, x.i from words x join words y on x.doc_id = y.doc_id and x.word = y.word and x.i < y.i and 4 * (y.i - x.i) <= x.n
), islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from equal),
stretches as (
    select doc_id, min(i) as s, count(*) + q as l, q from islands group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)
), runs as (
    select * from stretches x where not exists (select 1 from stretches y where y.doc_id = x.doc_id and y.q < x.q and y.s <= x.s and y.s + y.l >= x.s + x.l)
), gone as (
    select distinct doc_id, unnest(range(s + q, s + l)) as i from runs
), kept as (
    select w.doc_id, string_agg(word, ' ' order by w.i) as t from words w left join gone g on g.doc_id = w.doc_id and g.i = w.i where g.i is null group by w.doc_id
), summed as (
    select doc_id, count(*) as n_runs, first(s order by l desc, s, q) as s, first(l order by l desc, s, q) as l, first(q order by l desc, s, q) as q,
        string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as told from runs group by doc_id
)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, l::bigint as length, q::bigint as period, (1000 * l // q)::bigint as exponent_milli,
    sha256(coalesce(told, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from documents d left join summed r on r.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""

ORACLES = {
    "op1_warc_segments": WARC,
    "op2_chat_format": CHAT,
    "op4_line_dedup": LINES,
    "op6_substring_dedup": PASSAGES,
    "op8_embedding_pairs": VECTORS,
    "op9_jaccard_join": JACCARD,
    "op10_quality_cascade": QUALITY,
    "op11_source_mix": MIX,
    "op12_source_divergence": DIVERGENCE,
    "op13_periodic_runs": RUNS,
}
