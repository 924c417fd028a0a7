"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echograms.llm.chat import op8_chat
from echograms.llm.decontamination import op1_decontamination
from echograms.llm.filter_audit import op11_filter_audit
from echograms.llm.fingerprints import op5_fingerprints
from echograms.llm.language_id import op4_language_id
from echograms.llm.mixing import op2_mixing
from echograms.llm.near_duplicates import op7_near_duplicates
from echograms.llm.packing import op6_packed_ids
from echograms.llm.periodic import op13_periodic_runs
from echograms.llm.pii import op9_personal_data
from echograms.llm.substrings import op12_substring_dedup
from echograms.llm.token_lengths import op10_token_lengths
from echograms.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints,
    "op6_packed_ids": op6_packed_ids,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_chat": op8_chat,
    "op9_personal_data": op9_personal_data,
    "op10_token_lengths": op10_token_lengths,
    "op11_filter_audit": op11_filter_audit,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?INST\]|/?TURN\]|/?s>)', '\1\\\2\3', 'g')"

#: The others draw random numbers from a hash that DuckDB lacks, learn, tokenise, or list what their method adds; tests hold those to brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
ik as (select item_id, ws, least(10, len(ws)) k from iw where len(ws) > 0),
win as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') g from (select *, unnest(range(1, len(ws) - k + 2)) i from ik)),
ks as (select distinct k from win),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') g from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) i from w, ks where len(ws) >= k)),
hit as (select distinct dw.doc_id, dw.i, dw.k, win.item_id from dw join win on win.k = dw.k and win.g = dw.g),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from hit) group by doc_id),
it as (select doc_id, count(distinct item_id) n_items, array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') names from hit group by doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join h using (doc_id) left join it using (doc_id)""",
    "op7_near_duplicates": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
both_ as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
link as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach(node, start) as (select doc_id, doc_id from w union select link.b, reach.start from reach join link on link.a = reach.node),
c as (select node doc_id, min(start) component_id from reach group by node)
select w.doc_id, coalesce(n.n, 0) n_shingles, component_id, w.doc_id = component_id kept from w left join n using (doc_id) join c using (doc_id)""",
    "op8_chat": rf"""
with r as (select conv_id, turn, coalesce(role, '') "role", coalesce(text, '') text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g as (select conv_id, count(*) n_turns, string_agg("role" || chr(10) || text || chr(10), '' order by turn, "role", text) turns, coalesce(string_agg(text, '' order by turn, "role", text) filter ("role" = 'assistant'), '') loss,
sum(case when "role" = 'user' then 13 + length({ESCAPED.format('text')}) else 17 + length({ESCAPED.format('"role"')}) + length({ESCAPED.format('text')}) end)::bigint formatted_chars from r group by conv_id)
select conv_id, n_turns, sha256(turns) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, formatted_chars from g""",
    "op11_filter_audit": r"""
with l as (select doc_id, coalesce(max((quality = 1)::int), 0) good, coalesce(max((toxic = 1)::int), 0) toxic from labels where doc_id is not null group by doc_id),
w as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
f as (select doc_id, part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::int
+ 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce((doc_id > min(doc_id) over (partition by t))::int, 0) m from w),
c as (select part, m, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from f left join l using (doc_id) group by part, m),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x o from x a join x b on b.x <> a.x join x c on c.x not in (a.x, b.x) join x d on d.x not in (a.x, b.x, c.x) join x e on e.x not in (a.x, b.x, c.x, d.x)),
s as (select o, step, 1 << (ascii(o[step]) - 65) own, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))) b from (select o, unnest(range(1, 6)) step from o)),
t as (select o, step, own, coalesce(b, 0)::int b from s)
select part, o filter_order, step::int step, coalesce(sum(n) filter (m & (b | own) = 0), 0)::bigint kept, coalesce(sum(n) filter (m & b = 0 and m & own <> 0), 0)::bigint removed,
coalesce(sum(n) filter (m & b <> 0 and m & own <> 0), 0)::bigint redundant, coalesce(sum(n) filter (m = own), 0)::bigint unique_fails,
coalesce(sum(good) filter (m & b = 0 and m & own <> 0), 0)::bigint good_lost, coalesce(sum(toxic) filter (m & b = 0 and m & own <> 0), 0)::bigint toxic_lost,
coalesce(sum(n * 120 // greatest(bit_count(m), 1)) filter (m & own <> 0), 0)::bigint shapley from c, t group by part, o, step""",
    "op12_substring_dedup": r"""
with w as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select r, i, array_to_string(ws[i:i + 34], ' ') g from (select r, ws, unnest(range(1, len(ws) - 33)) i from w where len(ws) >= 35)),
twice as (select g from win group by g having count(*) > 1),
hit as (select distinct r, unnest(range(i, i + 35)) p from win join twice using (g)),
word as (select r, unnest(ws) x, unnest(range(1, len(ws) + 1)) p from w),
kept as (select r, string_agg(x, ' ' order by p) t from word anti join hit using (r, p) group by r),
gone as (select r, count(*) n from hit group by r)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (r) left join gone using (r)""",
    # CRC-32 by its definition, bit by bit; runs from places of equal four-word grams, as at least five words in a row agree with those a period further on
    "op13_periodic_runs": r"""
with w as (select row_number() over () r, doc_id, doc_id::varchar d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
c as (select *, len(ws) n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::bigint)),
lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) h from w),
a as (select *, (h // 10) % greatest(n, 1) a from c),
p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) p from a),
t as (select r, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: ws[1 + case when i < a then i else a + (i - a) % p end]) else ws end ws from p),
g as (select r, n, i, array_to_string(ws[i + 1:i + 4], ' ') g from (select *, unnest(range(n - 3)) i from t where n > 5)),
e as (select x.r, x.i, y.i - x.i q from g x join g y on x.r = y.r and x.g = y.g and y.i > x.i and 4 * (y.i - x.i) <= x.n),
f as (select r, q, min(i) s, count(*) + 3 + q l from (select *, i - row_number() over (partition by r, q order by i) part from e) group by r, q, part),
run as (select r, s, l, min(q) q from f where l >= 6 and l >= 4 * q group by r, s, l),
per as (select r, count(*) n_runs, arg_max({'s': s, 'l': l, 'q': q}, {'l': l, 's': -s, 'q': -q}) b, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) t from run group by r),
gone as (select distinct r, unnest(range(s + q, s + l)) i from run),
word as (select r, unnest(ws) x, unnest(range(n)) i from t),
kept as (select r, string_agg(x, ' ' order by i) t from word anti join gone using (r, i) group by r)
select doc_id, coalesce(n_runs, 0) n_runs, b.s "start", b.l length, b.q period, 1000 * b.l // b.q exponent_milli, sha256(coalesce(per.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from t left join per using (r) left join kept using (r)""",
}
