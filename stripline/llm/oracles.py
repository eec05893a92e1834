"""SQL of the operators that SQL can express, on the whole tables: DuckDB, for the comparison at small scale."""

WHITE = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op4_substring_dedup": f"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} ws from documents),
 w as (select doc_id, unnest(ws) word, unnest(range(len(ws))) i from d),
 g as (select doc_id, p, list_aggregate(ws[p+1:p+20], 'string_agg', ' ') t from (select doc_id, ws, unnest(range(greatest(0, len(ws)-19))) p from d) x),
 r as (select doc_id, p from (select *, row_number() over (partition by t order by doc_id, p) k from g) x where k > 1),
 c as (select w.*, max(r.p) over (partition by w.doc_id order by w.i rows between 19 preceding and current row) is not null gone from w left join r on r.doc_id = w.doc_id and r.p = w.i),
 s as (select doc_id, count(*) n, count(*) filter (gone) m, string_agg(word, ' ' order by i) filter (not gone) kept from c group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint n_words, coalesce(m, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join s on s.doc_id = d.doc_id""",
    "op5_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x, octet_length(encode(coalesce(text, ''))) n from documents),
 w as (select doc_id, p, substr(x, 2*p+1, 100) t from (select doc_id, x, unnest(range(greatest(0, n-49))) p from d) y),
 f as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by t) < doc_id r from w) y where r),
 b as (select doc_id, unnest(regexp_extract_all(x, '..')) h, unnest(range(n)) i from d),
 c as (select b.*, max(f.p) over (partition by b.doc_id order by b.i rows between 49 preceding and current row) is not null gone from b left join f on f.doc_id = b.doc_id and f.p = b.i),
 s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) first from c),
 k as (select doc_id, count(*) filter (gone) n_removed, count(*) filter (first) n_spans, string_agg(h, '' order by i) filter (not gone) kept from s group by doc_id)
select d.doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from d left join k on k.doc_id = d.doc_id""",
    "op6_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
 l as (select doc_id, line, i, {LOWER.format(f"trim(line, {WHITE})")} k from (select doc_id, unnest(ls) line, unnest(range(len(ls))) i from d) x),
 m as (select k, max(doc_id) last from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
 j as (select l.*, m.k is not null and l.doc_id <> m.last gone from l left join m on m.k = l.k)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256 from j group by doc_id""",
    "op7_jaccard_join": f"""
with recursive d as (select doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} ws from documents),
 s as (select distinct doc_id, list_aggregate(ws[p+1:p+5], 'string_agg', ' ') t from (select doc_id, ws, unnest(range(greatest(1, len(ws)-4))) p from d where len(ws) > 0) x),
 z as (select doc_id, count(*) n from s group by doc_id),
 o as (select a.doc_id x, b.doc_id y, count(*) m from s a join s b on a.t = b.t and a.doc_id <> b.doc_id group by all),
 e as (select x, y from o join z a on a.doc_id = x join z b on b.doc_id = y where 100 * m >= 80 * (a.n + b.n - m)),
 reach as (select doc_id x, doc_id y from d union select reach.x, e.y from reach join e on e.x = reach.y)
select d.doc_id, coalesce(n, 0) n_shingles, c.component_id from d left join z on z.doc_id = d.doc_id join (select x, min(y) component_id from reach group by x) c on c.x = d.doc_id""",
    "op12_source_divergence": r"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') txt from documents),
 w as (select r, lang, source, unnest(regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) t from d),
 k as (select lang, t, count(*) tot from w group by all having count(distinct r) >= 3),
 c as (select w.lang, w.source, t, count(*) n from w join k using (lang, t) group by all),
 v as (select lang, count(*) vv, sum(tot) ln from k group by all),
 g as (select x.lang, x.source, coalesce(vv, 0) vv, coalesce(ln, 0) ln, coalesce((select sum(n) from c where c.lang = x.lang and c.source = x.source), 0) nn from (select distinct lang, source from d) x left join v on v.lang = x.lang),
 p as (select g.lang, g.source, k.t, coalesce(c.n, 0) n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.nn + vv))::hugeint p, (1 + (1000000000::hugeint * (tot + 1)) // (g.ln + vv))::hugeint q
   from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.t = k.t),
 s as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) s from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all),
 o as (select a.lang, a.source, 'pair' part, b.source item, coalesce(s, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
   union all select lang, source, 'term', t, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q),
 z as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) i from o)
select lang, source, part, item, value, i::integer as rank from z where part = 'pair' or i <= 200""",
}
