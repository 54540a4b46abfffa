"""DuckDB SQL for the queries that SQL can express on whole tables.

The others are held against brute force in tests/llm: line similarity needs all pairs of lines, and
tokenizers, checksums and fingerprints have no SQL.
"""

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_DOCS = "docs as (select doc_id, text, {words} as ws from documents)"


def _docs(text: str = "text") -> str:
    return _DOCS.format(words=WORDS.format(text=text))


OP1 = f"""
with recursive {_docs("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
sh as (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 2], ' ') end as g
       from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from docs where len(ws) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as common from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
edge as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
reach as (select doc_id as d, doc_id as c from docs union select d, b from reach join edge on a = c),
comp as (select d, min(c) as c from reach group by d)
select docs.doc_id, coalesce(n, 0) as n_shingles, c as component_id, docs.doc_id = c as kept
from docs left join n on n.doc_id = docs.doc_id join comp on d = docs.doc_id
"""

OP2 = f"""
with {_docs()},
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n, ws from docs),
win as (select doc_id, w, i, n, case when i <= n - 12 then array_to_string(ws[i:i + 12], ' ') end as g from w),
hit as (select doc_id, w, i, n, g is not null and min(doc_id) over (partition by g) < doc_id as hit from win),
cov as (select doc_id, w, i, n, max(hit) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from hit),
per as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, coalesce(string_agg(w, ' ' order by i) filter (not gone), '') as kept from cov group by doc_id)
select docs.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join per on per.doc_id = docs.doc_id
"""

OP5 = rf"""
with {_docs()},
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from docs where len(ws) > 7)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
rep as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from dup) group by doc_id),
m as (select docs.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
      cast(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
      cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
      length(regexp_replace(coalesce(text, ''), '\P{{N}}', '', 'g')) as digits, length(regexp_replace(coalesce(text, ''), '\P{{L}}', '', 'g')) as letters,
      length(regexp_replace(coalesce(text, ''), '\P{{Lu}}', '', 'g')) as capitals
      from docs left join rep on rep.doc_id = docs.doc_id),
b as (select *, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars > 15 * n_words or word_chars < 2 * n_words or n_symbols > 0.5 * n_words or 10 * n_dup_lines > 3 * len(lines)
       or digits > 0.5 * letters or capitals > 0.6 * letters) as kept
from b
"""

OP8 = f"""
with {_docs()},
k as (select d.doc_id, source, cast(len(ws) as bigint) as size, substr(md5(coalesce(cast(d.doc_id as varchar), 'null')), 1, 9) as key from docs d join documents o on o.doc_id = d.doc_id),
s as (select source, sum(size) as own, row_number() over (order by source nulls last) - 1 as r from k group by source),
w as (select *, case r % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 2.0::double * own as cap from s),
l as (select *, coalesce(sum(cap) over (order by cap / weight, r rows between unbounded preceding and 1 preceding), 0) as before,
      sum(weight) over (order by cap / weight, r rows between current row and unbounded following) as rest, 1.5::double * sum(own) over () as total from w),
c as (select *, cap / weight <= (total - before) / rest as capped from l),
t as (select source, own, case when capped then cap else weight * (select arg_min((total - before) / rest, r + 1e9 * cap / weight) from c where not capped) end as target from c),
p as (select *, case when own > 0 then floor(target / own) else 0 end as whole from t),
cum as (select source, key, sum(sum(size)) over (partition by source order by key) as upto from k group by source, key)
select k.doc_id, k.size, cast(p.own as bigint) as source_size, p.target,
  cast(k.size * (p.whole + case when p.whole < 2 and cum.upto <= p.target - p.whole * p.own then 1 else 0 end) as bigint) as taken
from k join p on p.source is not distinct from k.source join cum on cum.source is not distinct from k.source and cum.key = k.key
"""

OP12 = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(d.t) as text_sha256 from d join g on g.t = d.t
"""

SQL = {"op1_minhash": OP1, "op2_substring_dedup": OP2, "op5_quality_rules": OP5, "op8_mixing": OP8, "op12_exact_dedup": OP12}
