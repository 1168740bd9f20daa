"""The same results in SQL for DuckDB, from the tables alone."""

#: For mixing.mix with its default parameters. Every row by itself, whether it is repeated or not.
MIXING = r"""
with sized as (
  select row_number() over () as row_no, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix:' || md5(coalesce(text, ''))), 1, 12))::bigint + 0.5::double) / 281474976710656::double as u
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from sized group by source
), levels as (
  select *, 3.0::double * source_size as stop,
         ((select sum(source_size)::double from sources)
          - coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
         / sum(weight) over (order by 3.0::double * source_size / weight, source nulls last rows between current row and unbounded following) as level
  from sources
), shared as (
  select level from levels where stop / weight > level order by stop / weight, source nulls last limit 1
), targets as (
  select source, source_size, case when stop / weight > level then weight * (select level from shared) else stop end as target from levels
), classes as (
  select source, length(bin(size)) - 1 as k, sum(size)::bigint as words from sized group by 1, 2
), class_levels as (
  select c.source, c.k, c.words, t.source_size, t.target, 1.0::double / (4.0::double + c.k) as per,
         (t.target - 3.0::double * coalesce(sum(c.words) over (partition by c.source order by c.k rows between unbounded preceding and 1 preceding), 0)::double)
         / nullif(sum(c.words / (4.0::double + c.k)) over (partition by c.source order by c.k rows between current row and unbounded following), 0.0::double) as level
  from classes c join targets t on c.source is not distinct from t.source
), first_free as (
  select source, arg_min(level, k) as level from class_levels where level * per < 3.0::double group by source
), copies as (
  select c.source, c.k, c.words, c.source_size, c.target,
         case when c.source_size > 0 then least(coalesce(f.level * c.per, 3.0::double), 3.0::double) else 0.0::double end as e
  from class_levels c left join first_free f on c.source is not distinct from f.source
), wants as (
  select *, e - floor(e) as p, target - sum(floor(e) * words) over (partition by source) as wanted from copies
), ranked as (
  select d.row_no, d.doc_id, d.source, d.size, d.u, w.source_size, w.target, floor(w.e) as certain, w.wanted, w.p > 0 and d.size > 0 as able,
         case when w.p > 0 and d.size > 0 then (d.u / (1 - d.u)) / (w.p / (1 - w.p)) end as ratio
  from sized d join wants w on d.source is not distinct from w.source and length(bin(d.size)) - 1 = w.k
), sampled as (
  select *, able and coalesce(sum(size) over (partition by source, able order by ratio, u, doc_id, row_no rows between unbounded preceding and 1 preceding), 0)::double
            + size / 2.0::double < wanted as drawn
  from ranked
), gaps as (
  select *, wanted - sum(case when drawn then size else 0 end) over (partition by source)::double as gap from sampled
), rests as (
  select *, abs(gap - case when drawn then -size else size end) as rest from gaps
), best as (
  select row_no from (select row_no, row_number() over (partition by source order by rest, u, doc_id, row_no) as place from rests where able and rest < abs(gap)) where place = 1
)
select r.doc_id, r.size, r.source_size, r.target,
       ((r.certain::bigint + case when r.drawn <> (b.row_no is not null) then 1 else 0 end) * r.size)::bigint as taken
from sampled r left join best b on r.row_no = b.row_no
"""


#: For secrets.scan, with patterns and scope of its own.
_ASSIGN_HEAD = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?"""
_PARTS = {
    1: _ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+",
    2: "AKIA[A-Z0-9]+",
    3: "[0-9a-f]+",
    4: "(user|login|client_id|account) *[:=] *[A-Za-z0-9_.@-]{3,}|[A-Z0-9]{16,}",
    5: "[A-Za-z0-9+/_-]{20,}",
    6: "[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(:[0-9]+)?",
}


def _found(kind: int) -> str:
    found, gaps = f"regexp_extract_all(t, $p${_PARTS[kind]}$p$, 0)", f"string_split_regex(t, $p${_PARTS[kind]}$p$)"
    lengths = "coalesce(list_sum(list_transform({}, lambda w: length(w))), 0)"
    start = f"({lengths.format('g[1:i]')} + {lengths.format('f[1:i-1]')})::int"
    return f"(select coalesce(list({{'s': {start}, 'k': {kind}, 'e': ({start} + length(f[i]))::int, 'w': f[i]}} order by i), []) from (select {found} as f, {gaps} as g) q, unnest(range(1, len(f) + 1)) u(i))"


def _apart(parts: str, others: str) -> str:
    return f"list_filter({parts}, lambda x: len(list_filter({others}, lambda y: y.s < x.e and y.e > x.s)) = 0)"


def _near(parts: str, others: str) -> str:
    return f"list_filter({parts}, lambda x: len(list_filter({others}, lambda y: y.s <= x.e + 200 and y.e >= x.s - 200)) > 0)"


def _spelt(parts: str) -> str:
    name = "['assign', 'access', 'hex', 'weak_id', 'weak_secret', 'endpoint']"
    return f"coalesce(list_aggregate(list_transform(list_sort(list_transform({parts}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.e}})), lambda x: {name}[x.k] || ':' || x.s || ':' || x.e), 'string_agg', ','), '')"


SECRETS = f"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
found as (
  select doc_id, {_found(1)} as a0, {_found(2)} as c0, {_found(3)} as h0, {_found(4)} as i0, {_found(5)} as w0, {_found(6)} as p0
  from texts
), kept as (
  select *, list_filter(a0, lambda x: length(regexp_replace(x.w, $p$^{_ASSIGN_HEAD}$p$, '')) >= 8) as a,
         list_filter(c0, lambda x: length(x.w) >= 16) as c, list_filter(h0, lambda x: length(x.w) >= 32) as h from found
), bases as (
  select *, a || c || h as base from kept
), ends as (
  select *, {_apart("p0", "base")} as p,
         list_filter({_apart("w0", "base")}, lambda x: regexp_matches(x.w, '[a-z]') and regexp_matches(x.w, '[A-Z]') and regexp_matches(x.w, '[0-9]')) as w1 from bases
), weak as (
  select *, {_apart("w1", "p")} as w from ends
), ids as (
  select *, list_filter({_apart("i0", "(base || p || w)")}, lambda x: (regexp_matches(x.w, '[A-Z]') and regexp_matches(x.w, '[0-9]')) or regexp_matches(x.w, '[:=]')) as i from weak
)
select doc_id, len(a)::bigint as n_assign, len(c)::bigint as n_access, len(h)::bigint as n_hex,
       sha256({_spelt("base")}) as base_sha256,
       {_spelt("(base || " + _near("i", "(w || a || h)") + " || " + _near("w", "(i || p || c)") + " || " + _near("p", "(w || a || h)") + ")")} as spans
from ids
"""


#: For topk.top_k with queries whose id 100 divides and k = 10. Each query row has a list of its own.
TOPK = """
with v as (
  select row_number() over () as row_no, vec_id::bigint as id, list_transform(embedding, lambda x: floor(1024.0::double * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.row_no, q.id as query_id, c.id as vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.id <> c.id and len(q.v) = len(c.v) where q.id % 100 = 0
), ranked as (
  select *, row_number() over (partition by row_no order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

#: For repeats.without_repeats: every window of 100 bytes, as hexadecimal digits.
REPEATS = """
with docs as (
  select doc_id, hex(encode(coalesce(text, ''))) as x, (length(hex(encode(coalesce(text, '')))) // 2)::bigint as n from documents
), windows as (
  select doc_id, p, md5(substr(x, 2 * p + 1, 200)) as w from docs, unnest(range(0, greatest(n - 99, 0))) u(p)
), ranked as (
  select doc_id, p, row_number() over (partition by w order by doc_id, p) as r from windows
), later as (
  select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end as fresh from ranked where r > 1
), numbered as (
  select doc_id, p, sum(fresh) over (partition by doc_id order by p rows unbounded preceding) as k from later
), runs as (
  select doc_id, k, min(p) as s, max(p) + 100 as e from numbered group by doc_id, k
), gaps as (
  select doc_id, k, coalesce(lag(e) over (partition by doc_id order by k), 0) as a, s as b, e from runs
), kept as (
  select doc_id, count(*) as n_spans, sum(e - b)::bigint as n_removed, max(e) as last,
         string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' order by k) as front
  from gaps join docs using (doc_id) group by doc_id
)
select d.doc_id, d.n as n_bytes, coalesce(k.n_removed, 0)::bigint as n_removed, coalesce(k.n_spans, 0)::bigint as n_spans,
       sha256(unhex(case when k.last is null then d.x else k.front || substr(d.x, 2 * k.last + 1) end)) as kept_sha256
from docs d left join kept k on d.doc_id = k.doc_id
"""

#: For neardup.near_duplicates with words=4 and per=80.
NEAR_DUPLICATES = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words
), each as (
  select doc_id, len(s) as n, hash(t) as t from sets, unnest(s) u(t)
), links as (
  select a.doc_id as a, b.doc_id as b from each a join each b on a.t = b.t and a.doc_id <> b.doc_id
    and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select doc_id as a, doc_id as c from sets
  union
  select l.b, r.c from reach r join links l on l.a = r.a and r.c < l.b
), least_of as (
  select a, min(c) as c from reach group by a
)
select s.doc_id, len(s.s)::bigint as n_shingles, l.c as component_id, l.c = s.doc_id as kept from sets s join least_of l on l.a = s.doc_id
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: For lexical.search with k = 50. Each item row has a list of its own.
LEXICAL = f"""
with docs as (
  select row_number() over () as row_no, doc_id, {_terms("text")} as w from documents
), sized as (
  select row_no, doc_id, w, len(w)::bigint as n from docs where len(w) > 0
), totals as (
  select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sized
), tf as (
  select row_no, t, count(*)::bigint as tf from (select row_no, unnest(w) as t from sized) group by row_no, t
), weights as (
  select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as wt from tf, totals group by t, n_docs
), items as (
  select row_number() over () as item_no, item_id, list_distinct({_terms("text")}) as w from benchmark
), wanted as (
  select item_no, item_id, unnest(w) as t from items
), lengths as (
  select row_no, doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) as m from sized, totals
), scores as (
  select item_no, item_id, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from wanted join weights using (t) join tf using (t) join lengths using (row_no) group by item_no, item_id, row_no, doc_id
), ranked as (
  select *, row_number() over (partition by item_no order by score desc, doc_id)::int as rank from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""

#: For collocations.collocations with its default parameters.
COLLOCATIONS = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') as w
  from (select lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as p from documents)
), totals as (
  select lang, sum(len(w))::bigint as n from pieces group by lang
), counts as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k as words, count(*)::bigint as f
  from pieces, unnest([1, 2, 3, 4, 5]) s(k), unnest(range(1, len(w) - k + 2)) u(i) group by 1, 2, 3 having count(*) >= 100
), cuts as (
  select lang, phrase, words, f as a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as tail
  from counts, unnest([1, 2, 3, 4]) s(k) where words > 1 and k < words
), scored as (
  select c.lang, c.phrase, c.a, h.f as l, t.f as r, n, ((1000::hugeint * c.a::hugeint * n::hugeint) // (h.f::hugeint * t.f::hugeint))::bigint as score,
         row_number() over (partition by c.lang, c.phrase order by (1000::hugeint * c.a::hugeint * n::hugeint) // (h.f::hugeint * t.f::hugeint), k) as best
  from cuts c join counts h on h.lang = c.lang and h.phrase = c.head join counts t on t.lang = c.lang and t.phrase = c.tail join totals o on o.lang = c.lang
), inner_ as (
  select distinct p.lang, p.phrase from counts p join counts q
    on p.lang = q.lang and q.words > p.words and q.f = p.f and contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')
  where p.words > 1
), ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank
  from scored s anti join inner_ i on s.lang = i.lang and s.phrase = i.phrase where best = 1
)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""

#: For contamination.scan with windows of 10 words.
CONTAMINATION = f"""
with docs as (
  select row_number() over () as row_no, doc_id, {_terms("text")} as w from documents
), items as (
  select item_id, {_terms("text")} as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as t
  from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) where len(w) > 0
), places as (
  select row_no, i, k, array_to_string(w[i:i + k - 1], ' ') as t
  from docs, (select distinct k from windows) s, unnest(range(1, len(w) - k + 2)) u(i)
), found as (
  select row_no, i, k, item_id from places join windows using (k, t)
), hits as (
  select row_no, count(distinct p)::bigint as n_hit from (select row_no, unnest(range(i, i + k)) as p from found) group by row_no
), named as (
  select row_no, count(distinct item_id)::bigint as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from found group by row_no
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (row_no) left join named using (row_no)
"""
