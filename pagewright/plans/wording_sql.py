"""SQL of the text queries, for the oracle. Character classes and words are those of `functions.text`, the rules are written anew."""

from __future__ import annotations

import re

from pagewright.functions import text as t
from pagewright.plans.tables import TEXTS

WITH = f"with u as ({TEXTS})"
QUOTE = "'"
MARK = r"^\s*(?:\[(\d+)\]|(\d+)[.)])\s*[:.)-]?\s*(.*)$"


def literal(value: str) -> str:
    return QUOTE + value.replace(QUOTE, 2 * QUOTE) + QUOTE


def classed(characters: str) -> str:
    """The inside of a character class of Spark's regular expressions as SQL has it."""
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", characters)


def counted(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {literal(pattern)}))"


def gone(text: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({text}, {literal(pattern)}, {literal(new)}, 'g')"


def found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {literal(pattern)})"


def squeezed(text: str) -> str:
    return f"trim({gone(text, r'\s+', ' ')})"


def listed(words: tuple[str, ...]) -> str:
    return ", ".join(map(literal, words))


def same_letters(text: str) -> str:
    """Runs of three or more of one letter or apostrophe cut to two."""
    for c in "abcdefghijklmnopqrstuvwxyz'":
        text = gone(text, f"{c}{{3,}}", c + c)
    return text


def ascii_symbols(text: str) -> str:
    for symbols, new in t.REPLACED.items():
        text = gone(text, f"[{symbols}]", new)
    return text


def sound(text: str) -> str:
    """Whether one or two words look like a transliterated sound."""
    half, known = "left(w, length(w) // 2)", listed(t.SOUNDS)
    words = f"list_filter(list_transform(string_split({squeezed(f'lower({text})')}, ' '), lambda w: rtrim(w, '.,;:!?')), lambda w: length(w) > 0)"
    test = f"w in ({known}) or (length(w) >= 6 and w = {half} || {half} and ({half} in ({known}) or (length({half}) >= 3 and {found(half, '[aiueo]$')})))"
    return f"(len({words}) between 1 and 2 and len(list_filter({words}, lambda w: {test})) > 0)"


KANA, KANJI, POINTS, BRACKETS, CJK, UNDRAWN, QUIET = map(classed, (t.KANA, t.KANJI, t.POINTS, t.BRACKETS, t.CJK, t.UNDRAWN, t.QUIET))
MISSES = counted("t", rf"[^\s\p{{Nd}}{KANA}{KANJI}{POINTS}{BRACKETS}]")
N_KANA, N_KANJI, N_POINTS = counted("t", f"[{KANA}]"), counted("t", f"[{KANJI}]"), counted("t", f"[{POINTS}]")
SMALL = "っッぁぃぅぇぉァィゥェォー〜～"
REPLY = """c as (select conv_id as page, turn, role, replace(text, chr(10), ' ') as text from conversations),
  l as (select page, turn, role, case when turn % 3 = 2 then text else '[' || (turn + 1) || '] ' || text end as line from c),
  r as (select page, string_agg(line, chr(10) order by turn, role, line) as reply, max(turn) + 1 as expected from l group by page)"""


def style_of(text: str, relation: str) -> str:
    """CTEs c, e, f that end with `style` of a text without spaces."""
    return f"""c as (select *, {N_KANA} as kana, {N_KANJI} as kanji, {counted(gone("t", f"[{KANA}{KANJI}]"), r"[\p{L}\p{N}]")} as other, {gone("t", f"[^{KANA}]")} as own,
    {found("t", "[。！？?!]")} as sentence, {found("t", "[、,]")} as comma, {found("t", "[ー〜～]")} as drawn from (select *, {gone(text, r"\s+")} as t from {relation})),
  e as (select *, len(list_filter(range(1, length(own)), lambda i: own[i] = own[i + 1])) > 0 as doubled from c),
  f as (select *, (comma and kana >= 3) or (sentence and kana >= 4) or (kana >= 4 and drawn and not doubled) as spoken,
    kanji = 0 and kana > 0 and (kana = 1 or (kana <= 8 and ({found("t", f"[{SMALL}]")} or doubled))) as effect from e),
  g as (select *, case when t = '' then 'sfx' when sentence or kanji > 0 or kana >= 2 then (case when spoken or not effect then 'dialogue' else 'sfx' end)
    when kana + kanji + other = 0 or length(t) <= 2 then 'sfx' else 'dialogue' end as style from f)"""


ORACLES = {
    "unit_style": f"""{WITH}, w as (select unnest(string_split(source, ' ')) as word from u), d as (select word, count(*) as n from w group by word), {style_of("word", "d")}
  select word, n, style from g""",
    "ocr_noise": f"""{WITH}, c as (select page, idx, trim(source) as t from u), d as (select page, idx, length(t) as n, {MISSES} as misses, {N_POINTS} as points, {N_KANA} as kana, {N_KANJI} as kanji from c)
  select page, idx, cast(misses as int) as misses, n = 0 or misses > greatest(2, n // 8) or (n >= 24 and kanji = 0 and kana > 12 and points > 6) or (n >= 18 and points > n * 0.35) as noisy from d""",
    "ocr_best": f"""{WITH}, v as (select page, idx, unnest([source, {gone("source", f"[^{KANA}]")}, left(source, 12), target]) as v, unnest([0, 1, 2, 3]) as variant_idx from u),
  c as (select page, idx, variant_idx, trim(v) as t from v),
  r as (select *, len(list_filter(range(1, length(t) - 3), lambda i: t[i] <> chr(10) and t[i : i + 4] = repeat(t[i], 5) and (i = 1 or t[i - 1] <> t[i]))) as runs from c),
  s as (select page, idx, variant_idx, case when t = '' then -1e9 else {N_KANJI} * 2.0 + {N_KANA} * 1.2 - {N_POINTS} * 0.35 - {MISSES} * 3.0
    + ({" + ".join(counted("t", p) for p in t.PATTERNS)}) * 1.7 - runs * 2.5 + case when {found("t", "[。、]")} then 1.0 else 0.0 end - case when length(t) < 2 then 2.0 else 0.0 end end as score from r),
  k as (select *, row_number() over (partition by page, idx order by round(score, 6) desc, variant_idx) as k from s)
  select page, idx, cast(variant_idx as int) as variant_idx, cast(round(score, 6) as double) as score from k where k = 1""",
    "sanitize_text": f"""{WITH}, c as (select page, idx, {ascii_symbols(squeezed("concat('“', target, '” — ', source)"))} as clean from u),
  d as (select *, {squeezed(gone("clean", f"[{UNDRAWN}]"))} as rest from c)
  select page, idx, case when rest <> '' then rest when {found("clean", f"[{CJK}]")} then '...' else clean end as text from d""",
    "postprocess_text": rf"""{WITH}, c as (select page, idx, concat('*', target, case when idx % 2 = 0 then '-san!' else '-kun*' end) as raw from u),
  d as (select *, trim({gone(gone("trim(raw)", rf"(?i)([a-z])((?:[-\s](?:{'|'.join(t.TITLES)})\b)+)", r"\1"), r"^\*+|\*+$")}) as x from c),
  e as (select *, case when len(string_split({squeezed("x")}, ' ')) <= 4 and ends_with(x, '!') then upper(x) else x end as y from d)
  select page, idx, case when trim(raw) = '' then raw when {sound("y")} then '...' else y end as text from e""",
    "compress_dialogue": f"""{WITH}, c as (select page, idx, target, {squeezed("target")} as s, regexp_extract_all(target, '[A-Za-z'']+') as ws from u),
  d as (select *, string_split(s, ' ') as p from c),
  e as (select *, rtrim(array_to_string(p[1:6], ' '), '.,;:!?') || '...' as six, list_filter(range(6, len(p) + 1), lambda i: {found("p[i]", "[.!?]$")})[1] as stop,
    rtrim(left(array_to_string(list_transform(ws[1:2], lambda w: {same_letters("lower(w)")}), ' '), 14)) as two from d)
  select page, idx, case when len(p) <= 6 then s else six end as cut, case when len(ws) = 0 then trim(target) else upper(left(two, 1)) || substr(two, 2) end as sound,
  case when len(p) <= 6 then s when stop is not null then array_to_string(p[1:stop], ' ') else six end as short from e""",
    "parse_responses": rf"""with {REPLY},
  n as (select page, expected, unnest(x) as line, generate_subscripts(x, 1) as k from (select page, expected, list_filter(list_transform(string_split(trim(regexp_replace(reply, '\r\n?', chr(10), 'g')), chr(10)), lambda y: trim(y)), lambda y: y <> '') as x from r)),
  m as (select *, try_cast(coalesce(nullif(regexp_extract(line, {literal(MARK)}, 1), ''), nullif(regexp_extract(line, {literal(MARK)}, 2), '')) as int) as number from n),
  o as (select page, k, expected, case when number between 1 and expected then number end as number, case when number between 1 and expected then trim(regexp_extract(line, {literal(MARK)}, 3)) else line end as value from m),
  i as (select *, count(number) over (partition by page) as markers, last_value(number ignore nulls) over (partition by page order by k) as item from o),
  f as (select *, max(case when number is not null and value <> '' then k end) over (partition by page, item) as since from i where markers > 0 and item is not null)
  select page, cast(item as int) as number, string_agg(value, ' ' order by k) as text from f where value <> '' and k >= coalesce(since, 0) group by page, item
  union all select page, cast(k as int), value from i where markers = 0 and k <= expected""",
    "text_rules": rf"""{WITH}, c as (select *, {squeezed("target")} as clean, lower(target) as low, regexp_extract_all(lower(target), '[a-z'']+') as ws, idx % 7 + 3 as words, idx * 20 + 15 as chars from u)
  select page, idx, clean <> '' and not {found("low", "|".join(t.REFUSALS).replace("'", "."))} and {found("source", f"[{KANA}{KANJI}]")} as renderable,
  len(ws) >= 3 and len(list_intersect(ws, ['desu', 'kun', 'chan', 'sama', 'senpai', 'san'])) > 0 as noise,
  clean <> '' and ({counted("clean", "[A-Za-z0-9']+")} > words or length(clean) > chars) as over,
  trim(target) = '' or (not {found("target", r"[\p{L}\p{N}]")} and not {found(gone("target", r"\s+"), "^[.…·･・]+$")}) as points_only, {found(gone("target", r"\s+"), "^[.…·･・]+$")} as dots,
  case when length(clean) > 400 then left(clean, 397) || '...' else clean end as logged from c""",
    "render_rules": rf"""{WITH}, v as (select page, idx, case when idx % 3 = 0 then left(target, 12) else target end as target, case when idx % 2 = 0 then left(source, 9) else source end as source,
    (page * 977 + idx * 7919) % 90000 as area, (page * 331) % 60000 as context, (page + idx) % 3 = 0 as balloon from u),
  c as (select *, {gone("source", r"\s+")} as t, {squeezed("target")} as clean, regexp_extract_all(target, '[A-Za-z]+') as ws, length(trim(target)) as n from v),
  d as (select *, {N_KANA} as kana, {N_KANJI} as kanji, {N_KANA} + {N_KANJI} + {counted(gone("t", f"[{KANA}{KANJI}]"), r"[\p{L}\p{N}]")} as script, array_to_string(ws, '') as letters,
    regexp_extract_all(clean, '[A-Za-z0-9'']+') as own_words, {counted("target", "[A-Za-z']+")} as words from c),
  e as (select *, length(array_to_string(own_words, '')) as m, kanji >= 2 or length(t) >= 14 as block, len(list_filter(range(1, length(letters)), lambda i: letters[i] = letters[i + 1])) > 0 as doubled from d)
  select page, idx, len(ws) between 1 and 3 and length(letters) between 2 and 18 and (len(ws) > 1 or doubled or length(letters) <= 5) as sound,
  case when clean = '' then true when area < 42000 or balloon or length(t) < 8 or script < 8 then false when block and area >= 70000 then true
    when block and len(own_words) <= 2 and m <= 14 and not {found("clean", "[.?!]")} then true else kanji = 0 and kana >= 10 and m <= 8 end as mismatch,
  case when t = '' or words = 0 then true when balloon then false when kanji = 0 and words <= 3 and script <= 4 and n <= 20 and not {found("t", "[。！？?!]")} then true
    when kanji = 0 and words <= 3 and n <= 18 and area >= 30000 then true
    when not (script <= 4 or (kana <= 4 and kanji = 0) or (script <= 8 and kanji = 0)) or (n > 16 and words > 3) or not (area >= 12000 or (context >= 35000 and area >= 5000)) then false
    else n <= 10 or words <= 2 end as noise from e""",
    "drawing_rules": rf"""{WITH}, v as (select page, idx, page * 13 % 90 + 5 as w, idx * 29 % 120 + 5 as h,
    case when idx % 4 = 0 then left(target, 11) when idx % 4 = 1 then {gone("target", "[A-Za-z ]+")} else target end as target from u),
  c as (select *, {squeezed("target")} as s, {found(gone("target", r"\s+"), "^[.…·･・]+$")} as dots from v),
  d as (select *, string_split(s, ' ') as p from c), e as (select *, list_filter(range(4, len(p) + 1), lambda i: {found("p[i]", "[.!?]$")})[1] as stop from d)
  select page, idx, case when w * h >= 3000 or len(p) <= 6 then s when stop is not null then array_to_string(p[1:stop], ' ') else rtrim(array_to_string(p[1:4], ' '), '.,;:!?') || '...' end as tight,
  case when s = '' then true when dots then false when not {found("s", r"[\p{L}\p{N}]")} then true else w * h < 400 end as skipped,
  (s = '' or len(p) <= 2) and not {found("s", "[.?!]")} and h <= w * 1.5 as sound, not {found("target", "[A-Za-z']")} as empty from e""",
}
