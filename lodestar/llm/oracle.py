"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from lodestar.llm import collocations, licenses, line_dedup, mixing
from lodestar.llm import quality_rules as rules

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LIMITS = rules.LineRules()


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CLOSING = ", ".join(map(_quoted, rules.CLOSING))

_PHRASES = ", ".join(f"({_quoted(v)}, {p.split(' ')})" for p, v in licenses.PHRASES.items())
_NOTICES = ", ".join(f"({_quoted(t.label)}, {list(t.tokens)}, {t.need})" for t in licenses.templates())

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
        with t as (
            select doc_id, row_number() over () as row, regexp_extract_all(text, '{_WORD}{_WS}*') as toks,
                   len(text) - len(regexp_replace(text, '^{_WS}+', '')) as lead
            from documents where text is not null),
        w as (select doc_id, row, lead, unnest(toks) as tok, generate_subscripts(toks, 1) as i from t),
        x as (
            select *, regexp_extract(tok, '{_WORD}') as raw, translate(raw, '{_UPPER}', '{_LOWER}') as word,
                   lead + coalesce(sum(length(tok)) over (
                       partition by row order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start,
                   (regexp_matches(raw, '[{line_dedup.CLOSING}]$') or regexp_matches(tok, '\n{_WS}*\n'))::int as ends
            from w),
        c as (select *, coalesce(sum(ends) over (
                  partition by row order by i rows between unbounded preceding and 1 preceding), 0) as clause from x),
        l as (select *, count(*) over (partition by row, clause) as size from c),
        e as (select *, case when size > {line_dedup.LONG} and ('0x' || substr(md5(word), 1, 2))::int % {line_dedup.CUT} = 0
                             then 1 else ends end as last from l),
        n as (select *, coalesce(sum(last) over (
                  partition by row order by i rows between unbounded preceding and 1 preceding), 0) as unit from e),
        u as (
            select doc_id, row, unit, min(start) as start, max(start + length(raw)) as "end", count(*) as n,
                   string_agg(word, ' ' order by i) as norm
            from n group by doc_id, row, unit),
        p as (
            select *, lead(norm) over o as next, lead("end") over o as end_2, lead(n) over o as n_2, count(*) over (partition by row) as k
            from u window o as (partition by row order by unit)),
        q as (
            select doc_id, row, unit, start, coalesce(end_2, "end") as "end", n, coalesce(n_2, 0) as n_2,
                   case when k = 1 then norm else norm || chr(10) || next end as key
            from p where next is not null or k = 1),
        r as (
            select *, row_number() over x as place, first_value(doc_id) over x as keep_doc_id, first_value(start) over x as keep_start
            from q window x as (partition by key order by doc_id nulls last, row, unit)),
        g as (select *, unit - row_number() over (partition by row order by unit) as island from r where place > 1)
        select doc_id, min(start) as start, max("end") as "end", (sum(n) + arg_max(n_2, unit))::bigint as n_words,
               count(*) + (arg_max(n_2, unit) > 0)::bigint as n_units,
               arg_min(keep_doc_id, unit) as keep_doc_id, arg_min(keep_start, unit) as keep_start
        from g group by doc_id, row, island having sum(n) + arg_max(n_2, unit) >= {line_dedup.MIN_WORDS}""",
    "op4_mix_sources": f"""
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
                   ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '')), 1, {mixing.KEY_BITS // 4}))::bigint as key
            from documents),
        s as (
            select source, sum(size)::bigint as source_size,
                   ({list(mixing.WEIGHTS)})[((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int]::double as w,
                   row_number() over (order by source nulls last) as n
            from d group by source),
        p as (
            select *, {mixing.MAX_PASSES} * source_size::double as cap,
                   row_number() over (order by {mixing.MAX_PASSES} * source_size::double / w, n) as place
            from s),
        l as (
            select *, (sum(source_size) over ())::double
                        - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0) as rest,
                   sum(w) over () - coalesce(sum(w) over (order by place rows between unbounded preceding and 1 preceding), 0) as weight
            from p),
        f as (select arg_min(rest, place) as rest, arg_min(weight, place) as weight, min(place) as place
              from l where cap * weight > rest * w),
        t as (select l.source, l.source_size,
                     case when f.place is null or l.place < f.place then l.cap else f.rest * l.w / f.weight end as target
              from l cross join f),
        q as (select *, case when source_size > 0 then round_even(target, 0)::bigint // source_size else 0 end as full_passes,
                     case when source_size > 0 then round_even(target, 0)::bigint % source_size else 0 end as rest
              from t),
        k as (select source, key, sum(size) as words from d group by source, key),
        c as (select source, key, words,
                     coalesce(sum(words) over (partition by source order by key rows between unbounded preceding and 1 preceding), 0) as done
              from k)
        select d.doc_id, d.size, q.source_size, q.target,
               (d.size * (q.full_passes + (c.done + c.words / 2.0 < q.rest)::int))::bigint as taken
        from d join q on d.source is not distinct from q.source
               join c on c.source is not distinct from d.source and c.key = d.key""",
    "op7_exact_dedup": f"""
        with n as (
            select doc_id, length(coalesce(text, '')) as chars,
                   regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') as norm
            from documents),
        h as (select doc_id, chars, sha256(norm) as text_sha256 from n),
        r as (
            select *, count(*) over (partition by text_sha256) as group_size,
                   first_value(doc_id) over w as keep_id, row_number() over w as place
            from h
            window w as (partition by text_sha256 order by chars desc, doc_id nulls last
                         rows between unbounded preceding and unbounded following))
        select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from r""",
    "op8_quality_rules": f"""
        with d as (
            select row_number() over () as row, doc_id, coalesce(text, '') as text,
                   regexp_extract_all(coalesce(text, ''), '{_WORD}') as words
            from documents),
        g as (select row, i, array_to_string(words[i:i + {rules.WINDOW - 1}], ' ') as five
              from (select row, words, unnest(range(1, len(words) - {rules.WINDOW - 2})) as i from d)),
        twice as (select row, i from g qualify count(*) over (partition by row, five) > 1),
        covered as (select row, count(distinct i + k) as n_repeat_words
                    from twice, range(0, {rules.WINDOW}) a(k) group by row),
        l as (select row, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d),
        m as (select row, i, line, regexp_extract_all(line, '{_WORD}') as words, len(words) as n,
                     regexp_extract_all(line, {_quoted(rules.BOILERPLATE_PATTERN)}) as stock from l),
        e as (select *, case when n = 0 then 'b' when right(words[-1], 1) in ({_CLOSING}) or n > {_LIMITS.max_unpunctuated} then 'm'
                             when length(line) >= {_LIMITS.min_wrapped} and not regexp_matches(line, {_quoted('[' + rules.SEPARATORS + ']')})
                                  and lead(n) over (partition by row order by i) > 0 then 'j' else 'x' end as code
              from m),
        f as (select *, arg_min(code, i) filter (code <> 'j') over (
                  partition by row order by i rows between current row and unbounded following) as ending from e),
        j as (select row, line, length(regexp_replace(line, '{_WS}', '', 'g')) as chars,
                     len(list_filter(words, lambda x: regexp_matches(x, {_quoted('^[' + rules.SEPARATORS + ']+$')}))) as seps,
                     ending <> 'm'
                     or (seps >= {_LIMITS.min_separators} and seps >= n * {_LIMITS.separator_share}::double)
                     or regexp_matches(line, {_quoted(rules.MENU_PATTERN)})
                     or (len(stock) > 0 and len(regexp_extract_all(array_to_string(stock, ' '), '{_WORD}')) >= n * {_LIMITS.stock_share}::double) as failed
              from f where n > 0),
        s as (select row, count(*) - count(distinct line) as n_dup_lines, sum(chars) as word_chars,
                     coalesce(sum(chars) filter (not failed), 0) as kept_chars
              from j group by row),
        b as (select d.doc_id, len(d.words)::bigint as n_words, coalesce(s.word_chars, 0)::bigint as word_chars,
                     (length(d.text) - length(regexp_replace(d.text, '[{rules.SYMBOLS}]', '', 'g')))::bigint as n_symbols,
                     coalesce(s.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words,
                     coalesce(s.kept_chars, 0)::bigint as kept_chars
              from d left join s using (row) left join covered c using (row)),
        v as (select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words as base_failed from b)
        select *, not base_failed and kept_chars >= word_chars * {_LIMITS.min_kept}::double as kept from v""",
    "op11_collocations": f"""
        with p as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece
            from documents),
        w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
        g as (
            select lang, len(t) as n_words, array_to_string(t, ' ') as phrase, count(*) as f
            from (select lang, ws[i:i + m - 1] as t
                  from (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w), (select unnest([1, 2, 3, 4]) as m)
                  where i + m - 1 <= len(ws))
            group by lang, t having count(*) >= {collocations.MIN_COUNT}),
        c as (select *, string_split(phrase, ' ') as ws from g where n_words > 1),
        k as (select c.lang, c.n_words, c.phrase, c.ws, c.f as a, k, array_to_string(ws[:k], ' ') as x, array_to_string(ws[k + 1:], ' ') as y
              from c, (select unnest([1, 2, 3]) as k) where k < n_words),
        s as (select k.lang, k.n_words, k.phrase, k.ws, k.a, k.k, x.f as l, y.f as r,
                     (k.a::hugeint * {collocations.SCALE}) // (x.f::hugeint + y.f) as score
              from k join g x on x.lang = k.lang and x.phrase = k.x join g y on y.lang = k.lang and y.phrase = k.y),
        b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        i as (select lang, array_to_string(ws[o:o + m - 1], ' ') as phrase, max(f) as longer
              from c, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as o)
              where m < n_words and o + m - 1 <= n_words group by all),
        n as (select lang, sum(len(ws))::bigint as n from w group by lang)
        select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n,
               score::bigint as score
        from b join n on n.lang = b.lang left join i on i.lang = b.lang and i.phrase = b.phrase
        where i.longer is null or 100 * i.longer::hugeint < {collocations.COVERED} * a::hugeint
        qualify rank <= {collocations.TOP}""",
    "op13_license_scan": f"""
        with d as (
            select doc_id, row_number() over () as row, regexp_extract_all(
                translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as ws
            from documents),
        p as (select * from (values {_PHRASES}) as v(label, part)),
        t as (select * from (values {_NOTICES}) as v(label, tokens, need)),
        b as (
            select row, i - 1 as place, label
            from (select row, ws, unnest(range(1, len(ws) + 1)) as i from d) e, p where ws[i:i + len(part) - 1] = part),
        m as (
            select row, label, len(list_intersect(list_distinct(tokens), block)) / len(tokens) as share
            from (select row, ws[i:i + {licenses.BLOCK_WORDS} - 1] as block
                  from (select row, ws, unnest(range(1, len(ws) + 1, {licenses.BLOCK_WORDS // 2})) as i from d)) k, t
            where len(list_intersect(tokens, block)) >= need),
        g as (select row, count(*) as n_base, min(place) as first_word, max(place) as last_word,
                     string_agg(distinct label, ',' order by label) as base_labels from b group by row),
        s as (select row, max(share) as score from m group by row),
        l as (select row, string_agg(distinct label, ',' order by label) as labels
              from (select row, label from b union all select row, label from m) group by row)
        select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
        from d left join g using (row) left join s using (row) left join l using (row)""",
}
