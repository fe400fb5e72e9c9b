"""The operators that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from . import filter_audit as a
from . import quality_rules as q


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules() -> str:
    words = "list_filter(regexp_split_to_array(l, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    visible = "length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g'))"
    fails = " or ".join(
        [
            f"length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) > {q.SYMBOL_SHARE} * {visible}",
            *(f"regexp_matches(l, {quoted(p)})" for p in (q.MENU, q.BOILERPLATE, q.SHOUTING)),
            f"(len({words}) >= {q.STUCK_WORDS} and {q.STUCK_SHARE} * len(list_distinct({words})) <= len({words}))",
            f"(not regexp_matches(l, {quoted(q.END_MARK)}) and len({words}) < {q.MIN_OPEN_WORDS})",
        ]
    )
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from t),
windows as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
repeated as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from windows) where c > 1),
covered as (
  select doc_id, count(distinct i + o) as n from repeated, (values (0), (1), (2)) as v(o) group by doc_id),
judged as (
  select w.*, coalesce(covered.n, 0) as n_repeat_words,
    list_distinct(list_filter(lines, lambda l: not ({fails}))) as kept_lines,
    len(words) as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars
  from w left join covered using (doc_id)),
shares as (
  select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words as base_failed,
    case when word_chars > 0 then
      coalesce(list_sum(list_transform(kept_lines, lambda l: {visible})), 0)::double / word_chars else 0.0 end as kept_share
  from judged)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  len(lines)::bigint as n_lines, len(kept_lines)::bigint as n_kept_lines, kept_share,
  not base_failed and kept_share >= {q.KEPT_SHARE} as kept
from shares
"""


def filter_audit() -> str:
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(a.FILTERS))
    return f"""
with t as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by text) as first from t),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
d as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(words) < {a.MIN_WORDS} then 1 else 0 end
    + case when 100 * len(list_distinct(words)) < {a.DISTINCT_PERCENT} * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {a.CAPITAL_PERCENT} * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[{a.SYMBOLS.decode()}]') then 8 else 0 end
    + case when doc_id > first then 16 else 0 end as fails
  from w left join l using (doc_id)),
c as (select part, fails, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from d group by part, fails),
f(x, b) as (values {letters}),
orders as (
  select p.x || q.x || r.x || s.x || u.x as filter_order, [p.b, q.b, r.b, s.b, u.b] as bits
  from f p, f q, f r, f s, f u where p.b + q.b + r.b + s.b + u.b = 31 and p.b | q.b | r.b | s.b | u.b = 31),
steps as (
  select filter_order, i::int as step, bits[i] as own, coalesce(list_sum(bits[1:i - 1]), 0)::int as before from orders, range(1, 6) as g(i)),
rows as (
  select part, filter_order, step, own, fails, n, good, toxic, fails & own > 0 as hit, fails & before > 0 as gone from c, steps)
select part, filter_order, step,
  coalesce(sum(n) filter (not hit and not gone), 0)::bigint as kept, coalesce(sum(n) filter (hit and not gone), 0)::bigint as removed,
  coalesce(sum(n) filter (hit and gone), 0)::bigint as redundant, coalesce(sum(n) filter (fails = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (hit and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (hit and not gone), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(fails), 1)) filter (hit), 0)::bigint as shapley
from rows group by part, filter_order, step
"""
