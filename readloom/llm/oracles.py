"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from readloom.llm import line_dedup, quality

_WORD = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = rf"""
with recursive w as (
  select doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), lambda x: x) as ws from documents
), s as (
  select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] end as sh
  from w, lateral (select unnest(range(1, greatest(len(ws) - 1, 2))) as i) where len(ws) > 0
), n as (select doc_id, count(*) as n from s group by 1
), p as (
  select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2
), e as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 85 * (na.n + nb.n - common)
), u as (select a, b from e union select b, a from e
), r as (select doc_id as node, doc_id as seen from n union select u.b, r.seen from r join u on u.a = r.node
), c as (select node, min(seen) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, d.doc_id = coalesce(c.component_id, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join c on c.node = d.doc_id
"""

CHAT = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11)::bigint as formatted_chars
from rows_ group by conv_id
"""


def _quality() -> str:
    listed = "case d.lang " + " ".join(f"when '{k}' then {list(v)!r}" for k, v in quality.COMMON_WORDS.items()) + " end"
    classes = ["[^\\p{Lu}]", "[^0-9]", "[^\\x20\\x09-\\x0D]", "[^.,;:!?\"''()]", "[^#*$%&|<>]"]
    count = ", ".join(f"length(regexp_replace(t, '{c}+', '', 'g'))" for c in classes)
    js = lambda p, q: f"""sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
      (case when {p}[i] > 0 then {p}[i] / list_sum({p}) * log2(({p}[i] / list_sum({p})) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) else 0.0 end
     + case when {q}[i] > 0 then {q}[i] / list_sum({q}) * log2(({q}[i] / list_sum({q})) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) else 0.0 end) / 2))))"""  # noqa: E731
    total = lambda c, n: "[" + ", ".join(f"coalesce(sum({c}[{i + 1}]), 0)::bigint" for i in range(n)) + "]"
    guard = lambda c, a, b: f"coalesce({c} > {a} + {b} / sqrt(greatest(n_words, 1)), false)"
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents
), g as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as sh from d, lateral (select unnest(range(1, len(ws) - 1)) as i) where len(ws) >= 3
), dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, sh) as c from g) where c > 1
), rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from dup) group by 1
), ln as (
  select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1
), f as (
  select d.doc_id, d.lang, d.ws, len(ws)::bigint as n_words, (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(ln.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
    length(t) as n, [{count}] as c5, {listed} as listed
  from d left join rep on rep.doc_id = d.doc_id left join ln on ln.doc_id = d.doc_id
), h as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, list_append(c5, n - list_sum(c5)) as classes,
    list_transform(listed, lambda x: len(list_filter(ws, lambda y: y = x))) as hits from f
), k as (select *, list_append(hits, greatest(0, n_words - list_sum(hits))) as common from h
), ref as (select lang, {total("classes", 6)} as rc, {total("common", 17)} as rw from k where not base_failed group by lang
), j as (
  select k.*, case when list_sum(classes) > 0 and list_sum(rc) > 0 then {js("classes", "rc")} end as cd,
    case when list_sum(common) > 0 and list_sum(rw) > 0 then {js("common", "rw")} end as wd
  from k left join ref on k.lang is not distinct from ref.lang
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_words >= {quality.GUARD_WORDS} and ({guard("cd", quality.CLASS_LIMIT, quality.CLASS_SLACK)} or {guard("wd", quality.WORD_LIMIT, quality.WORD_SLACK)})) as kept
from j
"""


LINES = f"""
with l as (
  select doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as raw from documents
), t as (select *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line from l
), bad as (
  select line, min(doc_id * 1000000000 + pos) as first from t where length(line) >= {line_dedup.MIN_CHARS}
  group by line having count(distinct source) + max((source is null)::int) >= {line_dedup.MIN_SITES}
), m as (select t.*, bad.line is not null and doc_id * 1000000000 + pos <> first as gone from t left join bad using (line))
select d.doc_id, case when d.text is null then null else coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '') end as text,
  count(raw)::bigint as n_lines, coalesce(sum(gone::int), 0)::bigint as n_removed
from documents d left join m on m.doc_id = d.doc_id group by d.doc_id, d.text
"""

EXACT = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size, doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256 from d
"""

#: The table of CRC-32 by its rule , and the CRC-32 of the bytes of a text by it.
_CRC_TABLE = "crc_t as materialized (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"


def _crc(text: str) -> str:
    byte = f"(instr('0123456789ABCDEF', substr(hex({text}), 2 * j - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex({text}), 2 * j, 1)) - 1"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen({text}) + 1), lambda j: ({byte})::bigint)), lambda c, b: xor(c >> 8, crc_t.t[(xor(c, b) & 255) + 1])), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

IMPORTANCE = rf"""
with {_CRC_TABLE},
w as (select 0 as part, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all select 1, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), f as (
  select part, doc_id, unnest(ws) as f from w
  union all select part, doc_id, ws[i] || ' ' || ws[i + 1] from w, lateral (select unnest(range(1, len(ws))) as i)
  union all select part, doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] from w, lateral (select unnest(range(1, len(ws) - 1)) as i)
), own as materialized (select part, doc_id, f, count(*)::bigint as n from f group by all
), words as (select f, sum(n) filter (where part = 0) as s, sum(n) filter (where part = 1) as t from own group by f
), hashed as materialized (select f, s, words.t, {_crc("f")} % 10000 as bucket from words, crc_t
), sums as (select bucket, coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from hashed group by bucket
), g as (select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from sums) + 10000) / ((s + 1) * ((select sum(t) from sums) + 10000))))::bigint as gain from sums
), weights as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from own join hashed using (f) join g using (bucket) where part = 0 group by doc_id
), d as (
  select doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    list_reduce(list_prepend(0::bigint, list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(sha256('42:' || doc_id), i, 1)) - 1)::bigint)), lambda x, y: x * 16 + y) as h
  from w left join weights using (doc_id) where part = 0
), s as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))))::bigint as score from d
), r as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end as place from s)
select doc_id, n_features, weight, score, case when place <= 5 * (select count(*) from d where n_words >= 20) // 100 then place end as rank from r
"""

SPELLING = rf"""
with recursive {_CRC_TABLE},
x as (select doc_id, {_LOWER.replace("coalesce(text, '')", "x")} as run from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as x from documents) where length(x) >= 7
), h as (select run, {_crc("(doc_id || ':' || run)")} as h from x, crc_t
), v as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from h
), w as materialized (select word, count(*)::bigint as n from v where length(word) >= 7 group by word having count(*) >= 2
), del as materialized (select distinct word, i, substr(word, 1, i - 1) || substr(word, i + 1) as less from (select word, unnest(range(1, length(word) + 1))::int as i from w)
), p as (
  select a.word as a, b.word as b from del a join del b on a.less = b.less and a.i = b.i and a.word <> b.word
  union select d.word, w.word from del d join w on w.word = d.less union select w.word, d.word from del d join w on w.word = d.less
), near as materialized (select p.a as word, p.b as near, w.n as m from p join w on w.word = p.b
), best as (select word, count(*)::bigint as n_near, max(m) as top from near group by word
), b as (select best.*, (select min(near) from near where near.word = best.word and m = top) as near from best
), f as materialized (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when top >= 10 * w.n then near end as form, case when top >= 10 * w.n then top end as form_n from w left join b using (word)
), up as (select word, word as node, 0 as steps from f union all select up.word, f.form, steps + 1 from up join f on f.word = up.node where f.form is not null)
select word, form, (select arg_max(node, steps) from up where up.word = f.word) as root, n, n_near, form_n from f
"""

SQL = {"op11_exact_dedup": EXACT, "op12_importance": IMPORTANCE, "op13_spelling": SPELLING, "op2_line_dedup": LINES, "op5_quality_rules": _quality(), "op8_near_duplicates": NEAR_DUPLICATES, "op10_chat": CHAT}
