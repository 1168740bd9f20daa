"""The registered queries in SQL for DuckDB, written from the tables alone."""

from __future__ import annotations

_PHONE = r"(?:\+?66|0)\d{8,9}\b"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"
_ID = r"\b\d{8,12}\b"


def _first(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}'), '')"


_FIELDS = f"{_first('text', _EMAIL)} as email, {_first('text', _DATE)} as date, {_first('text', _ID)} as numeric_id, {_first("replace(text, '-', '')", _PHONE)} as phone"

_NOTES = """notes as (
  select o_orderkey, 'order ' || k || ' of ' || case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%d/%m/%Y') else strftime(o_orderdate, '%Y-%m-%d') end
         || ' call 08-' || substr(k, 1, 4) || '-' || substr(k, 5, 4) || ' or a' || k || '@mail.example.com' as text
  from (select *, lpad(o_orderkey::varchar, 8, '0') as k from orders)
)"""


def _norm(text: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(replace({text}, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s]+|[\s]+$', '', 'g')"


_PAIRS = r"""pairs as (
  select conv_id, turn, ref, replace(replace(ref, 'rn', 'm'), 'e', 'c') as hyp
  from (select conv_id, turn, regexp_replace(text, '[^\x00-\x7f]', '?', 'g') as ref from conversations)
)"""

_NAMES = """names as (
  select p_partkey, p_name || ' ' || p_type as ref,
         replace(p_name, 'a', 'o') || case when p_partkey % 3 = 0 then ' more words' else '' end || ' ' || p_type as hyp from part
)"""


def _cer(ref: str, hyp: str) -> str:
    a, b = f"replace({_norm(ref)}, ' ', '')", f"replace({_norm(hyp)}, ' ', '')"
    return f"case when length({a}) > 0 then levenshtein({a}, {b})::double / length({a}) when length({b}) > 0 then 1.0 else 0.0 end::double"


#: Words as characters from chr(33) on, for pairs with few distinct words.
_WER = f"""lettered as (
  select p_partkey, ref, hyp, len(a) as n, list_aggregate(list_transform(a, lambda w: chr(33 + list_position(v, w))), 'string_agg', '') as la,
         list_aggregate(list_transform(b, lambda w: chr(33 + list_position(v, w))), 'string_agg', '') as lb
  from (select *, list_distinct(a || b) as v from (
    select p_partkey, ref, hyp, string_split({_norm("ref")}, ' ') as a, string_split({_norm("hyp")}, ' ') as b from names))
)"""

#: Word error rates by the table of distances, a row for each word of the prediction: the least of each place and of all before it.
_WER_ROWS = rf"""words as (
  select conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace({_norm('ref')}, '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' '), lambda w: w <> '') as a,
         list_filter(string_split(regexp_replace(regexp_replace({_norm('hyp')}, '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' '), lambda w: w <> '') as b from pairs
), steps as (
  select conv_id, turn, len(a) as n, len(b) as m, list_reduce(b, lambda d, w:
    list_transform(list_reduce(
      list_transform(range(1, len(a) + 2), lambda k: [case when k = 1 then d[1] else least(d[k] + 1, d[k - 1] + (a[k - 1] <> w)::bigint) - k end]),
      lambda p, q: list_append(p, least(p[len(p)], q[1]))), lambda x, i: x + i), range(0, len(a) + 1)) as d
  from words
)"""

_LINES = r"""lines as (
  select conv_id::varchar as doc, (turn + 1)::int as page, i as seq, parts[i] as text
  from (select *, string_split(text, chr(10)) as parts from conversations), unnest(range(1, len(parts) + 1)) u(i)
), page_texts as (
  select doc, page, coalesce(string_agg(text, chr(10) order by seq) filter (regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''), '') as text from lines group by doc, page
), doc_texts as (
  select doc, string_agg('--- Page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) order by page) as text from page_texts group by doc
)"""

_ENGINES = """engines as (
  select user_id::int as page, event_id % 2 as side, event_id as id,
         ' ' || event_type || case when event_id % 9 = 0 then '' else ' ' end as text,
         case when event_id % 4 <> 0 then value end as confidence,
         case when event_id % 2 = 0 then 'left' else 'right' end as engine,
         case when event_id % 5 = 0 or event_id % 11 = 0 then 1e9 else (event_id % 17)::double end as top
  from events
), sequence as (
  select *, row_number() over (partition by page order by side, id)::int as seq from engines
)"""

_PLAN = r"""items as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as rn,
         lpad(l_partkey::varchar, 8, '0') as k, l_quantity::int::varchar as q from lineitem
), plan as (
  select l_orderkey::varchar as doc, (l_orderkey % 9)::int as page, (rn * 10 + i - 1)::int as seq, case i
    when 1 then ' ' || substr(k, 1, 4) || ' ' || substr(k, 5, 4)
    when 2 then 'name ' || l_suppkey
    when 3 then case l_partkey % 3 when 0 then '77' when 1 then '|' else ' ' end
    when 4 then case when l_suppkey % 5 = 0 then '(3-0-6)' else q || ' (' || q || ' - 0 - 6))' end
    when 5 then 'flag  ' || l_returnflag || ' status ' || l_linestatus
    when 6 then [' Total ', '12345 6', 'รวม', 'เธฃเธงเธก', 'รวม 3', 'รวมตลอด 120', 'x เธฃเธงเธกเธ•เธฅเธญเธ” y', 'วท.บ.',
                 'เธงเธ— 2560', 'เธ' || chr(132) || 'เธ“เธฐ', 'เธชเธ' || chr(136) || 'เธฅ', 'มคอ 2', 'คณะ', 'สจล', 'total 9', '12345 6'][(l_partkey % 16 + 1)::int]
    else 'last line' end as text
  from items, unnest(range(1, 8)) u(i)
), ordered as (
  select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from plan
), placed as (
  select *, row_number() over (partition by doc, page order by seq)::int as pos, replace(t, ' ', '') as tight from ordered where t <> ''
), coded as (
  select *, regexp_matches(lower(tight), '^(\d{8}|\d{5}x{3}|\d{4}x{4}|x{4,8})$') as code_row from placed
), blocked as (
  select *, sum(code_row::int) over (partition by doc, page order by pos rows unbounded preceding)::int as blk from coded
), opened as (
  select * from blocked where blk > 0
), trimmed as (
  select * from (select *, max((not code_row and (lower(t) in ('total', 'รวม', 'เธฃเธงเธก') or contains(t, 'รวมตลอด') or contains(t, 'เธฃเธงเธกเธ•เธฅเธญเธ”')
    or contains(t, 'เธงเธ—') or contains(t, 'เธ' || chr(132) || 'เธ“เธฐ') or contains(t, 'เธชเธ' || chr(136) || 'เธฅ') or contains(t, 'มคอ')))::int) over (partition by doc, page, blk order by pos rows unbounded preceding) as stopped from opened) where stopped = 0
), credited as (
  select *, case when not code_row then nullif(regexp_extract(replace(tight, '))', ')'), '\d+\(\d+-\d+-\d+\)'), '') end as credit from trimmed
), split as (
  select *, min(case when credit is not null then pos end) over (partition by doc, page, blk) as cpos from credited
), made as (
  select doc, page, blk, max(case when code_row then lower(tight) end) as code, min_by(credit, pos) filter (credit is not null) as credits,
         nullif(coalesce(string_agg(t, ' ' order by pos) filter (not code_row and (cpos is null or pos < cpos) and not regexp_matches(t, '^\d+$') and t not in ('|', '.', 'a')), ''), '') as name_th,
         nullif(upper(regexp_replace(coalesce(string_agg(t, ' ' order by pos) filter (not code_row and pos > cpos and credit is null
           and len(regexp_extract_all(t, '[A-Za-z]')) >= greatest(2, length(t) // 3)), ''), '\s+', ' ', 'g')), '') as name_en
  from split group by doc, page, blk having count(*) filter (not code_row) > 0
)"""

_YEAR = "case when {0} between 1 and 7 then (({0} + 1) // 2)::int end"
_SEMESTER = "case when {0} between 1 and 7 then (({0} - 1) % 2 + 1)::int end"

_PATHS = "paths as (select page_id, 'in/dir.x/.page_' || page_id || ['.pdf', '.PNG', '.tar.gz', '', '.jpeg', '.Tiff', '.webp2'][(page_id % 7 + 1)::int] as path from pages)"

ORACLE_SQL: dict[str, str] = {
    "fields_email": f"select doc_id, {_first('text', _EMAIL)} as email from documents",
    "fields_phone": f"""select doc_id, {_first("replace(text, '-', '')", _PHONE)} as phone from documents""",
    "fields_date": f"with {_NOTES} select o_orderkey, {_first('text', _DATE)} as date from notes",
    "fields_id": f"with {_NOTES} select o_orderkey, {_first('text', _ID)} as numeric_id from notes",
    "fields_all": f"select doc_id, {_FIELDS} from documents",
    "fields_orders": f"with {_NOTES} select o_orderkey, {_FIELDS} from notes",
    "fields_json": f"""with {_NOTES}, f as (select o_orderkey, {_FIELDS} from notes)
        select o_orderkey, '{{' || array_to_string(list_filter([
          '"email":"' || email || '"', '"date":"' || date || '"', '"numeric_id":"' || numeric_id || '"', '"phone":"' || phone || '"'], lambda x: x is not null), ',') || '}}' as fields from f""",
    "normalize_text": rf"""with m as (select doc_id, ' ' || chr(9) || chr(13) || chr(10) || replace(replace(text, ' of ', ' ' || chr(9) || ' of' || chr(13) || chr(10) || chr(10) || chr(10) || ' '), '. ', '.' || chr(9) || chr(9)) || chr(10) || chr(10) || ' ' || chr(9) as t from documents)
        select doc_id, {_norm("t")} as normalized from m""",
    "cer": f"with {_PAIRS} select conv_id, turn, {_cer('ref', 'hyp')} as cer from pairs",
    "cer_empty": f"""with {_PAIRS}, blank as (select conv_id, turn, case when turn % 2 = 0 then ' ' || chr(10) else ref end as ref, case when conv_id % 2 = 0 then '' else hyp end as hyp from pairs)
        select conv_id, turn, {_cer('ref', 'hyp')} as cer from blank""",
    "wer": f"with {_NAMES}, {_WER} select p_partkey, levenshtein(la, lb)::double / n as wer from lettered",
    "wer_turns": f"""with {_PAIRS}, {_WER_ROWS}
        select conv_id, turn, case when n > 0 then d[n + 1]::double / n when m > 0 then 1.0::double else 0.0::double end as wer from steps""",
    "exact_match": f"with {_PAIRS} select conv_id, turn, {_norm('ref')} = {_norm('hyp')} as exact_match from pairs",
    "evaluate": f"""with {_NAMES}, {_WER} select 'part_' || p_partkey || '.pdf' as file, {_cer('ref', 'hyp')} as cer, levenshtein(la, lb)::double / n as wer,
        {_norm('ref')} = {_norm('hyp')} as exact_match, length({_norm('ref')})::int as reference_chars, length({_norm('hyp')})::int as prediction_chars from lettered""",
    "gt_lookup": """with truth as (
          select 'doc_' || doc_id || '.pdf' as key, case when doc_id % 7 = 0 then '' else text end as reference from documents where doc_id % 2 = 0 or doc_id % 7 = 0
          union all select 'doc_' || doc_id, text from documents where doc_id % 2 <> 0 or doc_id % 7 = 0)
        select d.doc_id, 'doc_' || d.doc_id || '.pdf' as file, length(coalesce(nullif(a.reference, ''), b.reference))::bigint as chars, md5(coalesce(nullif(a.reference, ''), b.reference)) as digest
        from documents d left join truth a on a.key = 'doc_' || d.doc_id || '.pdf' left join truth b on b.key = 'doc_' || d.doc_id""",
    "page_text": f"with {_LINES} select doc, page, text from page_texts",
    "doc_text": f"with {_LINES} select doc, text from doc_texts",
    "doc_nested": f"""with {_LINES} select t.doc, c.n_pages, c.n_lines, md5(t.text) as digest from doc_texts t
        join (select doc, count(distinct page)::int as n_pages, count(*)::int as n_lines from lines group by doc) c on t.doc = c.doc""",
    "doc_json": f"""with {_LINES} select t.doc, md5(t.text) as digest, c.n_pages from doc_texts t
        join (select doc, count(distinct page)::int as n_pages from lines group by doc) c on t.doc = c.doc""",
    "split_pages": rf"""with {_LINES}, cut as (select doc, regexp_extract_all(text, '--- Page (\d+) ---', 1) as n, string_split_regex(text, '--- Page \d+ ---') as b from doc_texts)
        select doc, i::int as page_index, n[i]::int as page, b[i + 1] as body from cut, unnest(range(1, len(n) + 1)) u(i)""",
    "text_lines": r"""with cut as (select doc_id::varchar as doc, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') as p from documents)
        select doc, 1 as page, i::int as seq, regexp_replace(p[i], '^\s+|\s+$', '', 'g') as text, (i - 1)::double as y
        from cut, unnest(range(1, len(p) + 1)) u(i) where regexp_replace(p[i], '^\s+|\s+$', '', 'g') <> ''""",
    "page_numbers": "select conv_id, row_number() over (partition by conv_id order by turn)::int as page, role from conversations",
    "min_confidence": "select event_id, confidence from (select event_id, case when event_type <> 'view' then value end as confidence from events) where confidence is null or confidence >= 50.0",
    "ensemble_union": f"with {_ENGINES} select page, seq, text, confidence, engine from sequence",
    "ensemble_merge": rf"""with {_ENGINES}, keyed as (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as key from sequence),
        ranked as (select *, row_number() over (partition by page, key order by coalesce(confidence, 0) desc, seq) as r, min(seq) over (partition by page, key) as first_seq from keyed where key <> '')
        select page, row_number() over (partition by page order by top, first_seq)::int as seq, text, confidence, engine from ranked where r = 1""",
    "box_top": f"with {_ENGINES} select id as event_id, top from engines",
    "code_rows": f"with {_PLAN} select doc, pos, lower(tight) as code from coded where code_row",
    "segment_blocks": f"with {_PLAN} select doc, blk, count(*) as n_lines from opened group by doc, blk",
    "trim_blocks": f"with {_PLAN} select doc, blk, count(*) as n_lines from trimmed group by doc, blk",
    "credits": rf"""with {_PLAN} select doc, seq, nullif(regexp_extract(replace(replace(text, ' ', ''), '))', ')'), '\d+\(\d+-\d+-\d+\)'), '') as credits from plan""",
    "course_table": f"with {_PLAN} select doc, blk, code, credits, name_th, name_en, {_YEAR.format('page')} as year, {_SEMESTER.format('page')} as semester, null::varchar as note from made",
    "curriculum": f"""with {_PLAN} select doc, doc as source, 'Extracted academic plan from OCR for DSBA (no_coop)' as description, 'DSBA' as program, 'no_coop' as plan,
        count(*)::int as n_courses, md5(string_agg(code, ',' order by page, blk)) as codes from made group by doc""",
    "line_places": "select event_id, case when event_id % 5 <> 0 then least(value, 40.0) else 0.0 end as x, case when event_id % 5 <> 0 then least(user_id::double, 20.0) else 0.0 end as y from events",
    "looks_english": r"select conv_id, turn, len(regexp_extract_all(text, '[A-Za-z]')) >= greatest(2, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) // 3) as english from conversations",
    "year_semester": f"select conv_id, turn, {_YEAR.format('(turn + 1)')} as year, {_SEMESTER.format('(turn + 1)')} as semester from conversations",
    "template_merge": """with t as (
          select p_partkey as pos, case when p_partkey % 50 <> 0 then 'c' || (p_partkey % 400) end as code, case when p_partkey % 3 = 0 then '' else p_name end as name_th,
                 case when p_partkey % 2 = 0 then '3(3-0-6)' end as credits, case when p_partkey % 5 = 0 then 1 end as year from part),
        p as (
          select p_partkey as pos, case when p_partkey % 60 <> 0 then 'c' || (p_partkey % 400) end as code, upper(p_name) as name_th, p_brand as name_en, '1(1-0-2)' as credits, 4 as year, (p_size % 2 + 1)::int as semester
          from part where p_partkey % 4 <> 1),
        tn as (select *, coalesce(code, 'None') as k, row_number() over (partition by coalesce(code, 'None') order by pos) as n from t),
        pn as (select *, coalesce(code, 'None') as k, row_number() over (partition by coalesce(code, 'None') order by pos) as n from p)
        select tn.pos, tn.code, coalesce(nullif(tn.name_th, ''), nullif(pn.name_th, ''), tn.name_th) as name_th, nullif(pn.name_en, '') as name_en,
               coalesce(tn.credits, pn.credits) as credits, coalesce(tn.year, pn.year) as year, pn.semester
        from tn left join pn on tn.k = pn.k and tn.n = pn.n""",
    "template_heading": "select n_nationkey::varchar as doc, n_name as source, 'template' as description, case when n_nationkey % 2 = 0 then 'IT' else 'DSBA' end as program, 'no_coop' as plan from nation",
    "rules_flatten": """select r_name as program, 'nations' as category, true as present, n_name as label, case when n_nationkey % 6 <> 0 then '>= ' || n_nationkey end as value, null::varchar as summary
        from nation join region on n_regionkey = r_regionkey
        union all select distinct r_name, 'empty', null::boolean, null::varchar, null::varchar, 'none' from nation join region on n_regionkey = r_regionkey""",
    "file_kind": f"""with {_PATHS} select page_id, case when lower(path) like '%.pdf' then 'pdf' when regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|tif|tiff|webp)$') then 'image' else 'other' end as kind from paths""",
    "path_stem": rf"""with {_PATHS}, n as (select page_id, regexp_extract(path, '[^/]*$') as name from paths)
        select page_id, name, case when regexp_matches(name, '^.*[^.]\.[^.]+$') then regexp_replace(name, '\.[^.]+$', '') else name end as stem from n""",
}
