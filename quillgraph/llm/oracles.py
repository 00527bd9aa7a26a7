"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from quillgraph.llm.quality import COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, SLOTS

EXACT_TOPK = """
        with e as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
          from embeddings
          where embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
          select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
          from e q join e c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 20"""

LINE_DEDUP = r"""
with d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(0, len(lines))) as i from d),
f as (select doc_id, i, cast(concat('0x', substr(md5(line), 1, 7)) as bigint) as h, row_number() over w - 1 as j, count(*) over (partition by doc_id) - 1 as last from l where trim(translate(line, concat(chr(9), chr(13), chr(11), chr(12)), '    ')) <> '' window w as (partition by doc_id order by i)),
p as (select *, lag(h) over w as h0, lag(i) over w as i0 from f window w as (partition by doc_id order by j)),
a as (select * from p where j >= 1 and (j = 1 or j = last or (h * 31 + h0 * 17) % 3 <> 0)),
n as (select *, lead(j) over w as j2, lead(i) over w as i2 from a window w as (partition by doc_id order by j)),
c as (select doc_id, i0 as s, i as e from n union all select doc_id, i0, i2 from n where j2 - j > 2),
t as (select c.doc_id, s, e, array_to_string(lines[s + 1 : e + 1], chr(10)) as chunk from c join d on d.doc_id = c.doc_id),
r as (select *, row_number() over (partition by chunk order by doc_id, s, e) > 1 as gone from t),
g as (select distinct doc_id, unnest(range(s, e + 1)) as i from r where gone),
k as (select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text, count(*) as n from l left join g on g.doc_id = l.doc_id and g.i = l.i where g.i is null group by 1)
select d.doc_id, coalesce(k.text, '') as text, cast(len(lines) as bigint) as n_lines, cast(len(lines) - coalesce(k.n, 0) as bigint) as n_removed from d left join k on k.doc_id = d.doc_id
"""


def quality_rules() -> str:
    """The base rules, the references pooled in two passes and both Jensen-Shannon distances."""
    words = " union all ".join(f"select '{k}' as lang, unnest(string_split('{v}', ' ')) as w, unnest(range(0, {len(v.split())})) as slot" for k, v in COMMON_WORDS.items())
    n = {"upper": r"[\p{Lu}]", "lower": r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]", "digit": r"[\p{Nd}]", "space": r"[\s\v\p{Z}\x{1c}-\x{1f}\x{85}]", "stop": r"[-.,;:''\"()!?]", "symbol": r"[\x00-\x08\x0e-\x1b#$%&*+/<=>@\[\\\]^_`{|}~\x7f]"}
    count = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) as c_{k}" for k, p in n.items())
    names = list(n)
    arr = "[" + ", ".join(f"c_{k}" for k in names) + ", length(t) - " + " - ".join(f"c_{k}" for k in names) + "]"
    dist = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: case when {p}[i] > 0 then {p}[i] / list_sum({p}) * log2({p}[i] / list_sum({p}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) else 0 end + case when {q}[i] > 0 then {q}[i] / list_sum({q}) * log2({q}[i] / list_sum({q}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) else 0 end)) / 2))"
    # pooled histograms of the rows where `out` does not hold, and the verdict against two such references
    pooled = lambda name, column, rows, out: f"{name} as (select lang, list(s order by i) as {name} from (select lang, i, sum(case when {out} then 0 else x end) as s from (select lang, {out.split()[-1]}, unnest({column}) as x, generate_subscripts({column}, 1) as i from {rows}) group by 1, 2) group by 1)"
    near = lambda c, w: f"(n_chars < 200 or coalesce({dist('cv', c)}, 0) <= {MAX_CLASS_DISTANCE}) and (n_words < 100 or lang = 'other' or coalesce({dist('wv', w)}, 0) <= {MAX_WORD_DISTANCE})"
    return f"""
    with d as (select doc_id, coalesce(text, '') as t, case when lang in ({', '.join(f"'{k}'" for k in COMMON_WORDS)}) then lang else 'other' end as lang from documents),
    w as (select doc_id, lang, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select doc_id, lang, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d)),
    tri as (select doc_id, i, count(*) over (partition by doc_id, w, w1, w2) as c from (select doc_id, i, w, lead(w) over o as w1, lead(w, 2) over o as w2 from w window o as (partition by doc_id order by i)) where w2 is not null),
    rep as (select doc_id, count(distinct j) as n from (select doc_id, i + unnest([0, 1, 2]) as j from tri where c > 1) group by 1),
    wc as (select doc_id, count(*) as n, sum(length(w)) as chars from w group by 1),
    ln as (select doc_id, count(*) - count(distinct x) as n from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by 1),
    common as ({words}),
    hit as (select w.doc_id, w.lang, c.slot, count(*) as n from w join common c on c.lang = w.lang and c.w = trim(lower(w.w), '.,;:!?') group by 1, 2, 3),
    slots as (select unnest(range(0, {SLOTS - 1})) as slot),
    hist as (select d.doc_id, list(coalesce(h.n, 0) order by s.slot) as h from d cross join slots s left join hit h on h.doc_id = d.doc_id and h.slot = s.slot group by 1),
    cl as (select doc_id, {count} from d),
    f as (select d.doc_id, d.lang, coalesce(wc.n, 0) as n_words, coalesce(wc.chars, 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(ln.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
      list_transform({arr}, lambda x: cast(x as double)) as cv, list_transform(list_append(h, coalesce(wc.n, 0) - list_sum(h)), lambda x: cast(x as double)) as wv, length(t) as n_chars
      from d join hist using (doc_id) join cl using (doc_id) left join wc using (doc_id) left join ln using (doc_id) left join rep using (doc_id)),
    b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
    {pooled('rc', 'cv', 'b', 'base_failed')}, {pooled('rw', 'wv', 'b', 'base_failed')},
    t as (select b.*, not base_failed and {near('rc', 'rw')} as trusted from b join rc using (lang) join rw using (lang)),
    {pooled('rc2', 'cv', 't', 'not trusted')}, {pooled('rw2', 'wv', 't', 'not trusted')}
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
      not base_failed and {near('rc2', 'rw2')} as kept
    from t join rc2 using (lang) join rw2 using (lang)"""


ORACLE_SQL: dict[str, str] = {"op4_exact_topk": EXACT_TOPK, "op6_line_dedup": LINE_DEDUP, "op9_quality_rules": quality_rules()}
