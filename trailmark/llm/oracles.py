"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from trailmark.llm.decontam import ENDS, UNITS, Templates
from trailmark.llm.licence_texts import DIGESTS, KNOWN, SPELLINGS
from trailmark.llm.licences import HEAD, LEAST_RUN, OWNER, TERMS
from trailmark.llm.linededup import Tree
from trailmark.llm.quality import MEASURES, Rules

_BLANK, _WORDLIKE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_sql(rules: Rules | None = None) -> str:
    rules = rules or Rules()
    grid = ", ".join(f"('{r}', {c}::double)" for r, cuts in rules.cutoffs.items() for c in cuts)
    drop = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))"
    share = lambda a, b: f"case when {b} > 0 then {a} / {b} else 0.0 end"
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(lang, '') stratum, coalesce(text, '') t from documents),
w as (
  select *, list_filter(string_split_regex(t, '{_BLANK}'), lambda x: x <> '') ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDLIKE}')) ls from d
),
windows as (select rid, i, ws[i:i + {rules.window - 1}] win from w, unnest(range(1, len(ws) - {rules.window - 2})) u(i)),
twice as (select rid, i, count(*) over (partition by rid, win) n from windows),
covered as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + {rules.window})) p from twice where n > 1) group by rid),
m as (
  select w.rid, doc_id, stratum, len(ws) n_words, {drop(_BLANK)} word_chars, {drop("[^#*$%&|<>]+")} n_symbols,
         len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(covered.n, 0) n_repeat_words, len(ls) n_lines,
         {drop("[^A-Z]+")} n_capitals, {drop("[^!]+")} n_marks
  from w left join covered on w.rid = covered.rid
),
b as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words base_failed from m),
v as (
  select rid, doc_id, stratum, base_failed, unnest([
    {{'rule': 'symbols', 'value': {share("n_symbols", "n_words")}}}, {{'rule': 'marks', 'value': {share("n_marks", "n_words")}}},
    {{'rule': 'capitals', 'value': {share("n_capitals", "word_chars")}}}, {{'rule': 'dup_lines', 'value': {share("n_dup_lines", "n_lines")}}},
    {{'rule': 'repeats', 'value': {share("n_repeat_words", "n_words")}}}, {{'rule': 'word_length', 'value': {share("word_chars", "n_words")}}}], recursive := true)
  from b
),
grid(rule, cutoff) as (values {grid}),
held as (
  select v.*, l.quality, substr(md5(cast(v.doc_id as varchar)), 1, 1) <= '4' proposes
  from v join (select row_number() over () lid, * from labels) l on v.doc_id = l.doc_id where not base_failed and l.quality in (0, 1)
),
proposals as (
  select stratum, rule, cutoff, sum(case when value > cutoff then quality else 0 end) k_good,
         sum(case when value > cutoff then 1 - quality else 0 end) k_bad
  from held join grid using (rule) where proposes group by stratum, rule, cutoff
),
positions as (
  select *, row_number() over (partition by stratum order by k_good, k_bad - {rules.good_weight} * k_good desc, rule, cutoff desc) position
  from proposals where k_bad - {rules.good_weight} * k_good > 0
),
goods as (select b.rid, b.stratum, count(*) times from b join labels l on b.doc_id = l.doc_id
          where not base_failed and l.quality = 1 and substr(md5(cast(b.doc_id as varchar)), 1, 1) > '4' group by b.rid, b.stratum),
sizes as (select stratum, sum(times)::bigint n_good from goods group by stratum),
firsts as (
  select g.rid, g.stratum, g.times, min(position) first from goods g join v on v.rid = g.rid
  join positions p on p.stratum = g.stratum and p.rule = v.rule and v.value > p.cutoff group by g.rid, g.stratum, g.times
),
joint as (
  select p.*, n_good, (select coalesce(sum(times), 0) from firsts f where f.stratum = p.stratum and f.first <= p.position)::bigint joint_good
  from positions p join sizes using (stratum)
),
strata as (select greatest(1, count(distinct stratum)) n from held),
bounded as (
  select *, joint_good < n_good * {rules.risk!r} and list_sum(list_transform(range(0, (case when joint_good < n_good * {rules.risk!r} then joint_good else 0 end)::bigint + 1),
           lambda i: exp(lgamma(n_good + 1.0) - lgamma(i + 1.0) - lgamma(n_good - i + 1.0) + i * ln({rules.risk!r}) + (n_good - i) * ln({1 - rules.risk!r}))))
         <= {rules.delta!r} / (select n from strata) safe
  from joint
),
chosen as (
  select stratum, rule, min(cutoff) cutoff from (select *, bool_and(safe) over (partition by stratum order by position) taken from bounded) x
  where taken group by stratum, rule
),
failed as (select distinct rid from v join chosen on v.stratum = chosen.stratum and v.rule = chosen.rule where value > cutoff)
select doc_id, {", ".join(f"{c}::bigint {c}" for c in MEASURES[:5])}, base_failed, not base_failed and rid not in (select rid from failed) kept from b
"""


def decontamination_sql(rules: Templates | None = None) -> str:
    rules = rules or Templates()
    units = ", ".join(map(_text, UNITS))
    ends = ", ".join("chr(10)" if e == "\n" else _text(e) for e in ENDS)
    # characters of scripts without blanks are set apart before the text is split
    unspaced = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)"
    token = r"\d+(?:[.,:]\d+)*|[\p{L}\p{M}]+|[.!?\n。！？]"

    def parsed(name: str, table: str, key: str) -> str:
        return rf"""
{name}_raw as (select row_number() over () rid, id, regexp_extract_all(regexp_replace(t, '{unspaced}', ' \1 ', 'g'), '{token}') xs
  from (select distinct {key} id, coalesce(text, '') t from {table}) x),
{name}_each as (select rid, id, i, xs[i] x, case when i > 1 then xs[i - 1] end before, xs[i + 1] after from {name}_raw, unnest(range(1, len(xs) + 1)) u(i)),
{name}_typed as (
  select rid, id, i, lower(x) low, case when substring(x, 1, 1) between '0' and '9' then '<num>'
    when coalesce(substring(before, 1, 1) between '0' and '9', false) and lower(x) in ({units}) then '<unit>'
    when not coalesce(before in ({ends}), true) and lower(substring(x, 1, 1)) <> substring(x, 1, 1) and upper(x) <> x then '<name>' end mark,
    coalesce(before in ({ends}), true) starts, coalesce(after in ({ends}), true) stops
  from {name}_each where x not in ({ends})
),
{name} as (
  select rid, id, list(coalesce(mark, low) order by i) ts, list(case when mark is not null then low end order by i) vs,
         list(low order by i) es, list(starts order by i) starts, list(stops order by i) stops
  from {name}_typed group by rid, id
)"""

    size = f"least(len(ts), {rules.window})"
    plain = f"len(list_filter(vs[u.pos + 1:u.pos + {size}], lambda x: x is null))"
    alone = f"(size >= {rules.least_literal} or (starts[u.d + 1] and stops[u.d + size]))"
    return rf"""
with {parsed("doc", "documents", "doc_id")}, {parsed("bench", "benchmark", "item_id")},
places as (
  select rid, id item, u.pos, {size} size, ts[u.pos + 1:u.pos + {size}] win, vs[u.pos + 1:u.pos + {size}] slots, {plain} plain
  from bench, unnest(range(0, len(ts) - {size} + 1)) u(pos)
),
good as (select * from places where size >= {min(rules.least_literal, rules.window)} and plain >= least(size, {rules.least_literal})),
usable as (select *, count(*) over (partition by rid) n_windows from good),
sizes as (select distinct size from usable),
windows as (
  select rid, id, u.d, size, ts[u.d + 1:u.d + size] win, vs[u.d + 1:u.d + size] slots
  from doc, sizes, unnest(range(0, greatest(0, len(ts) - size + 1))) u(d)
),
hits as (
  select windows.rid, windows.id doc_id, item, d - pos as moved, d, pos, n_windows, usable.slots theirs, windows.slots ours, usable.win,
         usable.slots is not distinct from windows.slots verbatim
  from windows join usable on windows.size = usable.size and windows.win = usable.win
),
pairs as (
  select rid, item, moved, win[k] || theirs[k] a, win[k] || ours[k] b, bool_or(verbatim) quoted
  from hits, unnest(range(1, len(win) + 1)) u(k) where theirs[k] is not null group by all
),
fits as (
  select rid, item, moved, count(*) n, count(*) filter (quoted) n_quoted, count(*) = count(distinct a) and count(*) = count(distinct b) fits
  from pairs group by rid, item, moved
),
lines as (
  select rid, doc_id, item, moved, count(distinct pos) found, count(distinct pos) filter (verbatim) quoted, max(n_windows) item_windows from hits group by all
),
judged as (
  select doc_id, lines.item, item_windows, case when coalesce(fits, true) then found else quoted end found,
         coalesce(case when coalesce(fits, true) then n else n_quoted end, 0) n
  from lines left join fits on lines.rid = fits.rid and lines.item is not distinct from fits.item and lines.moved = fits.moved
),
kept as (select doc_id, item, found n_windows, item_windows, n n_slots from judged where found >= least(item_windows, {rules.least_windows})),
wholes as (
  select bench.*, {size} size, len(list_distinct(list_filter(list_transform(range(1, len(ts) + 1), lambda k: case when vs[k] is not null then ts[k] || vs[k] end), lambda x: x is not null))) n_slots
  from bench where rid not in (select rid from good)
),
item_exact as (
  select rid, id item, size, n_slots, len(es) - size + 1 n_windows, u.d pos, es[u.d + 1:u.d + size] win
  from wholes, unnest(range(0, len(es) - size + 1)) u(d) where {alone}
),
whole_sizes as (select distinct size from item_exact),
doc_exact as (
  select rid, id, u.d, size, es[u.d + 1:u.d + size] win from doc, whole_sizes, unnest(range(0, greatest(0, len(es) - size + 1))) u(d) where {alone}
),
whole_lines as (
  select x.rid, x.id doc_id, e.item, e.n_windows, e.n_slots, x.d - e.pos moved
  from doc_exact x join item_exact e on x.size = e.size and x.win = e.win
  group by x.rid, x.id, e.item, e.rid, e.n_windows, e.n_slots, x.d - e.pos having count(distinct e.pos) = e.n_windows
)
select doc_id, item item_id, max(n_windows)::bigint n_windows, max(item_windows)::bigint item_windows, max(n_slots)::bigint n_slots
from (select * from kept union all select doc_id, item, n_windows, n_windows, n_slots from whole_lines) r group by doc_id, item
"""


def licence_sql() -> str:
    def spelt(x: str) -> str:
        for pattern, spelling in SPELLINGS:
            x = f"regexp_replace({x}, '\\b{pattern}\\b', '{spelling}', 'g')"
        return x

    def canonical(line: str) -> str:
        low = f"lower({line})"
        terms = f"regexp_replace({low}, '{OWNER}.*?[.]\\s+({TERMS}\\b)', '\\1')"
        told = f"case when regexp_matches({low}, '{OWNER}') then (case when {terms} <> {low} then {terms} else '' end) else {low} end"
        return spelt(f"trim(regexp_replace({told}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))")

    def lines(text: str) -> str:
        return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {canonical('x')}), lambda x: x <> '')"

    known = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in KNOWN)
    listed = ", ".join(f"({_text(i)}, {n}, {_text(h)}, {_text(d)})" for i, n, h, d in DIGESTS)
    return f"""
with raw(licence, text) as (values {known}),
plain as (select licence, {spelt(f"array_to_string({lines('text')}, ' ')")} t from raw),
known as (
  select distinct * from (
    select licence, len(string_split(t, ' '))::integer size, array_to_string(string_split(t, ' ')[1:{HEAD}], ' ') head, md5(t) digest from plain
    union all select * from (values {listed}) l
  ) k
),
begins as (select '^(?:' || string_agg(distinct head, '|') || ')\\b' pattern from known),
canonical as (select row_number() over () rid, doc_id, {lines("text")} ls from documents),
starts as (
  select rid, doc_id, ls, u.i from canonical, unnest(range(1, len(ls) + 1)) u(i)
  where regexp_matches(array_to_string(ls[u.i:u.i + {HEAD - 1}], ' '), (select pattern from begins))
),
rests as (select *, string_split({spelt("array_to_string(ls[i:], ' ')")}, ' ') ws from starts),
units as (
  select doc_id, 'text' as scope, md5(array_to_string(ws, ' ')) digest from rests where i = 1
  union all select doc_id, 'line', md5(ls[i]) from starts
  union all
  select doc_id, 'run', md5(array_to_string(ws[1:size], ' ')) from rests, (select distinct size from known where size >= {LEAST_RUN}) s
  where size <= len(ws) and size <> len(string_split(ls[i], ' ')) and md5({spelt("array_to_string(ls, ' ')")}) not in (select digest from known)
)
select doc_id, licence, scope, count(*) n from units join (select distinct licence, digest from known) k using (digest) group by all
"""


def line_sql(tree: Tree | None = None) -> str:
    tree = tree or Tree()
    start = lambda r: f"({tree.leading} + (len(ws) - {tree.leading}) * {r} // {tree.regions})"
    literal = lambda x: f"len(list_filter({x}, lambda w: w <> '<*>'))"

    def opened(r: int) -> str:
        region = f"ws[{start(r)} + 1:{start(r + 1)}]"
        key = f"'{r} ' || len(ws) || ' ' || array_to_string(ws[1:{start(r)}], ' ') || ' <open> ' || array_to_string(ws[{start(r + 1)} + 1:], ' ')"
        enough = f"(not list_contains(ws, '<*>') or {literal('ws')} - {literal(region)} >= {tree.least_words})"
        return f"case when len(ws) >= {tree.least_open_words} and len({region}) <= {tree.most_open_words} and {enough} then {key} end"

    whole = f"case when {literal('ws')} < {tree.least_words} then 'x ' || array_to_string(rs, ' ') else 'w ' || array_to_string(ws, ' ') end"
    more = ", ".join(f"case when {literal('ws')} >= {tree.least_words} then {opened(r)} end" for r in range(tree.regions))
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(doc_id, {(1 << 63) - 1}) doc, string_split(text, chr(10)) ls from documents),
split as (
  select rid, doc, i, list_filter(string_split_regex(ls[i], '{_BLANK}'), lambda x: x <> '') rs, list_filter(string_split_regex(
    regexp_replace(ls[i], '[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*', '<*>', 'g'), '{_BLANK}'), lambda x: x <> '') ws
  from d, unnest(range(1, len(ls) + 1)) u(i)
),
lines as (select * from split where len(rs) > 0),
keys as (
  select * from (select rid, doc, i, len(rs) < {tree.least_words} short, unnest([{whole}, {more}]) k from lines) x where k is not null
),
least as (select greatest({tree.least_documents}, ceil({tree.common_share}::double * count(distinct doc))) n from keys),
seen as (
  select k, min(doc) lo from keys group by k
  having (not bool_or(short) and min(doc) < max(doc)) or (bool_or(short) and count(distinct doc) >= (select n from least))
),
gone as (select rid, list(distinct i) pos from keys join seen using (k) where doc > lo group by rid)
select doc_id, coalesce(len(ls), 0)::bigint n_lines, coalesce(len(pos), 0)::bigint n_dropped,
       md5(coalesce(array_to_string(list_filter(ls, lambda x, i: pos is null or not list_contains(pos, i)), chr(10)), '')) text_md5
from d left join gone using (rid)
"""


#: CRC-32 of a text in ASCII: the bits of each character go through the register one by one.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(role) || ':' || role || text) AS id,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) t
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format(text="CAST(conv_id AS VARCHAR)")} % 9 AS h FROM turns
), built AS (
  SELECT c.conv_id, 0 AS part, t.place, t.id, t.text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.id, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.place > c.h
), keys AS (
  SELECT c.conv_id, coalesce(list(b.id ORDER BY b.part, b.place) FILTER (b.id IS NOT NULL), []) AS ids,
         coalesce(list(strlen(b.text) ORDER BY b.part, b.place) FILTER (b.id IS NOT NULL), []) AS sizes
  FROM convs c LEFT JOIN built b ON b.conv_id = c.conv_id GROUP BY c.conv_id
), members AS (
  SELECT conv_id, depth, array_to_string(ids[:depth], '') AS node, sizes[depth] AS size, len(ids) = depth AS ends, ids
  FROM (SELECT *, unnest(range(len(ids) + 1)) AS depth FROM keys) k
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(size), 0) AS own,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256, any_value(ids) AS ids
  FROM members GROUP BY node, depth
), children AS (
  SELECT array_to_string(ids[:depth - 1], '') AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), above AS (
  SELECT array_to_string(n.ids[:up], '') AS node, sum(own) AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM nodes) n LEFT JOIN children c ON c.node = n.node GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, a.n_leaves,
       CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN children c ON c.node = n.node JOIN above a ON a.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = array_to_string(n.ids[:n.depth - 1], '')"""


def resampling_sql() -> str:
    """CRC-32 of every distinct run of words by a table of its 256 steps, which a rule makes."""
    step = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " UNION ALL ".join(
        f"SELECT rid, side, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS run FROM texts"
        for n in (1, 2, 3)
    )
    digit = "(strpos('123456789ABCDEF', {}))"
    byte = f"{digit.format('x[1]')} * 16 + {digit.format('x[2]')}"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, 's' AS side, doc_id, {split} AS ws FROM documents
  UNION ALL SELECT -row_number() OVER (), 't', NULL, {split} FROM benchmark
), runs AS (
  SELECT rid, side, run, count(*) AS n FROM ({runs}) r GROUP BY ALL
), bytes AS (
  SELECT run, unnest(range(1, strlen(run) + 1)) AS place, unnest(list_transform(regexp_extract_all(hex(encode(run)), '..'), lambda x: {byte})) AS byte
  FROM (SELECT DISTINCT run FROM runs) d
), steps AS (
  SELECT i::UBIGINT AS i, {step}::UBIGINT AS v FROM range(256) t(i)
), shifted AS (
  -- a byte counts alone, after as many zero bytes as follow it: CRCs of texts of one length add up by exclusive or
  SELECT n, i, v FROM (
    WITH RECURSIVE z(n, i, v) AS (
      SELECT 0, i, v FROM steps
      UNION ALL SELECT z.n + 1, z.i, xor(z.v >> 8, s.v) FROM z JOIN steps s ON s.i = (z.v & 255)
      WHERE z.n < (SELECT max(place) FROM bytes)
    ) SELECT * FROM z) q
), start AS (
  SELECT n, v FROM (
    WITH RECURSIVE z(n, v) AS (
      SELECT 0, 4294967295::UBIGINT UNION ALL SELECT z.n + 1, xor(z.v >> 8, s.v) FROM z JOIN steps s ON s.i = (z.v & 255)
      WHERE z.n < (SELECT max(place) FROM bytes)
    ) SELECT * FROM z) q
), crcs AS (
  SELECT run, xor(xor(x, a.v), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT b.run, bit_xor(s.v) AS x, max(b.place) AS size
        FROM bytes b JOIN shifted s ON s.n = strlen(b.run) - b.place AND s.i = b.byte GROUP BY b.run) c
  JOIN start a ON a.n = c.size
), buckets AS (
  SELECT rid, side, bucket, sum(n) AS n FROM runs JOIN crcs USING (run) GROUP BY ALL
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM buckets GROUP BY bucket
), alls AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM counts, alls
), weights AS (
  SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM buckets JOIN gains USING (bucket) WHERE side = 's' GROUP BY rid
), scores AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (rid) WHERE side = 's'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_sql(),
        "op5_template_decontamination": decontamination_sql(),
        "op7_licence_digests": licence_sql(),
        "op10_line_templates": line_sql(),
        "op11_importance_resampling": resampling_sql(),
        "op13_conversation_trie": CONVERSATION_TRIE,
    }
