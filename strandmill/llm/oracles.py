"""DuckDB SQL for the queries whose results SQL can state."""

from __future__ import annotations

from .substring import BASE, CLOSERS, LONGEST, MARKS, REACH, UNSPACED, WIDE_MARKS


def _escaped(x: str) -> str:
    """Characters of ``x`` once escaped: one more for each backslash and control string."""
    controls = ("<s>", "[INST]", "[/INST]", "</s>", "<|endoftext|>")
    return f"(length({x}) + length({x}) - length(replace({x}, '\\', ''))" + "".join(f" + (length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in controls) + ")"


OP4_CHAT = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(17 + {_escaped("role")} + {_escaped("text")}) as bigint) as formatted_chars
from c group by conv_id"""

_BOILERPLATE = (
    r"\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|javascript (?:is )?(?:disabled|required)"
    r"|click here|read more|sign (?:in|up)|log ?in|subscribe (?:now|to)|share (?:this|on)|skip to (?:main )?content|back to top|lorem ipsum|©)"
)
_MARKS = "'|', '>', '»', '›', '·', '•', '››', '||', '>>'"
_MENU = ", ".join(f"'{w}'" for w in "home about contact login register menu search next previous prev help faq sitemap share print news shop cart blog archive".split())

OP7_LINE_RULES = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
g as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select k, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select k, i from g qualify count(*) over (partition by k, g) > 1),
rep as (select k, count(*) as n from (select distinct k, i + j as p from r, range(3) t(j)) group by k),
l as (select k, line, regexp_extract_all(line, '\S+') as s, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as a from (select k, unnest(string_split(text, chr(10))) as line from d)),
dup as (select k, count(*) - count(distinct line) as n from l where len(a) > 0 group by k),
f as (select k, len(a) as n, case
  when len(s) = 0 then false
  when len(list_filter(s, lambda x: x in ({_MARKS}))) >= 3 and len(list_filter(s, lambda x: x in ({_MARKS}))) * 4 >= len(s) - len(list_filter(s, lambda x: x in ({_MARKS}))) then true
  when len(s) <= 8 and len(list_filter(s, lambda x: lower(trim(x, ',.|/')) in ({_MENU}))) = len(s) then true
  when regexp_matches(line, '(?i){_BOILERPLATE}') then true
  when len(s) >= 5 and regexp_matches(line, '[#*$%&|<>]') and 3 * len(list_filter(s, lambda x: regexp_matches(x, '[#*$%&|<>]{{2,}}$') or not regexp_matches(x, '[\p{{L}}\p{{N}}]'))) > len(s) then true
  when len(s) >= 5 and 2 * len(list_filter(s, lambda x: x like '%!')) > len(s) then true
  when len(s) >= 12 and 5 * len(list_distinct(s)) < len(s) then true
  when regexp_matches(line, '[{{}};]\s*$') then true
  when len(s) >= 12 and not regexp_matches(line, '[.!?…:;。！？]') and not regexp_matches(line, '\p{{Nd}}') then true
  else false end as failed from l),
v as (select k, coalesce(sum(n) filter (not failed), 0) as left_words, count(*) filter (failed) as failed_lines, sum(n) as n from f group by k),
b as (select w.k, doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from w left join dup on dup.k = w.k left join rep on rep.k = w.k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and left_words >= cast(0.6 as double) * n as kept,
  cast(left_words as bigint) as n_words_left, failed_lines as n_failed_lines
from b join v on b.k = v.k"""


_S = r"\x20\x09-\x0D"
_U = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in UNSPACED)
_TOKEN = f"(?:[{_U}]?[^{_S}{_U}]+|[{_U}])"
#: Words with what follows them; hashes of words by Horner's rule; cuts at smallest hashes; runs of pieces as their words; the
#: smallest doc_id that holds a run keeps it.
OP6_SUBSTRING = rf"""
with d as (select row_number() over () as k, doc_id, text from documents),
p0 as (select k, unnest(range(len(s))) as i, unnest(s) as part from (select k, regexp_extract_all(text, '^[{_S}]+{_TOKEN}[{_S}]*|{_TOKEN}[{_S}]*') as s from d)),
p1 as (select k, i, part, regexp_extract(part, '{_TOKEN}') as w from p0),
v as (select w, list_reduce(list_transform(string_split(w, ''), lambda c: cast(ord(c) as hugeint)), lambda h, c: (h * {BASE} + c) % 18446744073709551616) as rank from (select distinct w from p1)),
p2 as (select k, i, part, w, rank, regexp_matches(w, '([{MARKS}]|[{WIDE_MARKS}][{CLOSERS}])$') or regexp_matches(part, '\n[{_S}]*$') as ends from p1 join v using (w)),
p3 as (select *, coalesce(sum(ends::int) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as sentence from p2),
p4 as (select *, row_number() over s - 1 as place, count(*) over (partition by k, sentence) as size, min(rank) over (s rows between {REACH} preceding and 1 preceding) as before, min(rank) over (s rows between 1 following and {REACH} following) as behind from p3 window s as (partition by k, sentence order by i)),
p5 as (select *, ends or (place >= {REACH} and size - 1 - place >= {REACH} and rank < before and rank < behind) as cut from p4),
p6 as (select *, coalesce(sum(cut::int) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as g from p5),
p7 as (select *, (row_number() over (partition by k, g order by i) - 1) // {LONGEST} as j from p6),
q as (select k, row_number() over (partition by k order by g, j) as n, count(*) as words, string_agg(part, '' order by i) as piece, string_agg(w, ' ' order by i) as said from p7 group by k, g, j),
c as (select *, sum(words) over (partition by k order by n) as upto, count(*) over (partition by k) as total from q),
r0 as (select a.k, a.n, greatest(a.n + 2, min(b.n)) as last, a.total from c a join c b on a.k = b.k and b.n >= a.n and b.n < a.n + 25 and b.upto - a.upto + a.words >= 25 group by a.k, a.n, a.total),
r as (select r0.k, r0.n, last, string_agg(said, ' ' order by c.n) as run from r0 join c on c.k = r0.k and c.n between r0.n and r0.last where last <= r0.total group by r0.k, r0.n, last),
u as (select r.*, doc_id from r join d on d.k = r.k),
m as (select run, min(doc_id) as first from u group by run),
x as (select u.k, u.n, last from u join m on m.run = u.run where u.doc_id > first or first is not null and u.doc_id is null
  union all select k, n, last from (select k, n, last, row_number() over (partition by k, run order by n) as again from u) where again > 1),
gone as (select distinct k, unnest(range(n, last + 1)) as n from x),
t as (select c.k, c.n, piece, gone.n is not null as out, gone.n is not null and not coalesce(lag(gone.n is not null) over (partition by c.k order by c.n), false) as opens from c left join gone on gone.k = c.k and gone.n = c.n)
select doc_id, case when count(t.n) = 0 then any_value(text) else coalesce(string_agg(piece, '' order by t.n) filter (not out), '') end as text, count(t.n) as n_sentences,
  coalesce(cast(sum(case when out then 1 else 0 end) as bigint), 0) as n_removed, coalesce(cast(sum(case when opens then 1 else 0 end) as bigint), 0) as n_removed_ranges
from d left join t on t.k = d.k group by d.k, doc_id"""


def _op13(levels: int = 6, top: int = 3) -> str:
    """Trees of degree 16 level by level: ``levels`` for sources, ``top`` for the tree over them."""

    def tree(name: str, start: str, by: str, count: int) -> str:
        out = [start]
        over = f"partition by {by}, pos // 16 order by pos rows between"
        for k in range(count):
            out.append(f"""{name}s{k} as (select *, coalesce(string_agg(node, '') over ({over} unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(node, '') over ({over} 1 following and unbounded following), '') as r from {name}{k})""")
            out.append(f"""{name}{k + 1} as (select {by}, pos // 16 as pos, (any_value(total) + 15) // 16 as total,
  case when any_value(total) > 1 then sha256(string_agg(node, '' order by pos)) else any_value(node) end as node from {name}{k} group by {by}, pos // 16)""")
        return ",\n".join(out)

    def climb(name: str, by: str, key: str, start: str, count: int, columns: str) -> str:
        out = []
        for k in range(count):
            before = start if k == 0 else f"{name}p{k - 1}"
            fold = "case when s.total > 1 then sha256(s.l || x.folded || s.r) else x.folded end as folded"
            proof = "case when s.total > 1 then x.proof || s.l || s.r else x.proof end as proof"
            out.append(f"{name}p{k} as (select {columns}, {key} // 16 as at, {fold}, {proof} from {before} x join {name}s{k} s on {by} and s.pos = {key})")
        return ",\n".join(out)

    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    head = " || ".join(field(c) for c in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)"))
    bit = "list_reduce(list_prepend(xor(c, x), range(8)), lambda y, z: case when y % 2 = 1 then xor(y // 2, 3988292384) else y // 2 end)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda q: cast(ord(q) as bigint))), lambda c, x: {bit}), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    first = f"""d as (select *, {head} as head, coalesce({crc} % 5 = 0, false) as hit from documents),
h as (select doc_id, source, sha256(head || {field("text")}) as leaf, sha256(head || case when hit then {field(lowered)} else {field("text")} end) as tampered from d),
n as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, tampered) - 1 as pos, count(*) over (partition by source) as total from h)"""
    columns = "x.doc_id, x.source, x.leaf"
    parts = [
        first,
        tree("a", "a0 as (select source, pos, total, leaf as node from n)", "source", levels),
        f"subs as (select source, node, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as total from a{levels})",
        tree("b", "b0 as (select 0 as one, pos, total, node from subs)", "one", top),
        "start as (select doc_id, source, leaf, pos as at, tampered as folded, '' as proof from n)",
        climb("a", "s.source is not distinct from x.source", "x.at", "start", levels, columns),
        f"middle as (select {columns}, subs.node as subroot, subs.pos as at, folded, proof from ap{levels - 1} x join subs on subs.source is not distinct from x.source)",
        climb("b", "true", "x.at", "middle", top, columns + ", x.subroot"),
    ]
    last = f"select doc_id, leaf, subroot, b{top}.node as root, sha256(proof) as proof_sha256, folded as folded_root, folded = b{top}.node as verified from bp{top - 1}, b{top}"
    return "with " + ",\n".join(parts) + "\n" + last


OP13_MERKLE = _op13()

#: All scores of anchors with all other rows; missing components of shorter vectors count as 0.
OP12_NEGATIVES = """
with e as (select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.k as ak, b.k as bk, a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
  cast(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) as bigint) as score from e a join e b on a.k <> b.k where a.vec_id % 100 = 0),
p as (select ak, bk, anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by ak order by score desc, other nulls last, bk) <= 5),
n as (select p.anchor_id, positive_id, other as negative_id, positive_score, score as negative_score,
  row_number() over (partition by p.ak, p.bk order by score desc, other nulls last, s.bk) as rank
  from p join s on s.ak = p.ak and not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
