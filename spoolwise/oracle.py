"""The same questions in SQL, written independently of the Spark code and without look-around patterns."""

from __future__ import annotations

from .functions.lexicon import OPEN_WORDS, STOP_WORDS, TASK_WORDS
from .jobs import SKELETON
from .operators.picks import AIR, BOOKENDS, CARD, INTRO, TOLERANCE
from .plans.schema import PRESET_ASPECT, PRESET_BOUNDS

OUTLINE_TAIL = ("## Moments skeleton\n\nPick the moments worth keeping and fill this list:\n\n```json\n" + SKELETON + "\n```\n").replace("'", "''")

CUES = r"""
cues as (
  with p as (
    select conv_id recording_id, turn, role speaker, pos, trim(piece) as text
    from (select conv_id, turn, role, unnest(l) piece, generate_subscripts(l, 1) - 1 pos
          from (select *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) l from conversations))
    where trim(piece) <> ''),
  q as (
    select *, row_number() over (partition by recording_id order by turn, pos) - 1 cue_ix,
           sum(length(text) + 1) over (partition by recording_id order by turn, pos rows between unbounded preceding and current row) c
    from p)
  select recording_id, cue_ix, (c - length(text) - 1) / 15.0::double as start, c / 15.0::double as "end", text, speaker from q)"""
LONG = r"""
long_cues as (
  with p as (
    select doc_id recording_id, pos, trim(piece) as text
    from (select doc_id, unnest(l) piece, generate_subscripts(l, 1) - 1 pos
          from (select *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) l from documents))
    where trim(piece) <> ''),
  q as (
    select *, row_number() over (partition by recording_id order by pos) - 1 cue_ix,
           sum(length(text) + 1) over (partition by recording_id order by pos rows between unbounded preceding and current row) c
    from p)
  select recording_id, cue_ix, (c - length(text) - 1) / 15.0::double as start, c / 15.0::double as "end", text from q)"""
WORDS = r"""
words as (
  with t as (select recording_id, cue_ix, start cs, "end" ce, speaker, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') l from cues),
  u as (select recording_id, cue_ix, cs, ce, speaker, unnest(l) as text, generate_subscripts(l, 1) k, list_sum(list_transform(l, lambda x: length(x) + 1)) n from t),
  v as (select *, sum(length(text) + 1) over (partition by recording_id, cue_ix order by k rows between unbounded preceding and current row) b from u)
  select recording_id, row_number() over (partition by recording_id order by cue_ix, k) - 1 word_ix,
         cs + (ce - cs) * (b - length(text) - 1) / n as start, cs + (ce - cs) * b / n as "end", text, speaker, cs cut_start, ce cut_end from v)"""
TIMED = """
timed as (
  select recording_id, word_ix, start, greatest(start, "end" - case when word_ix % 7 = 0 then 0.3 when word_ix % 5 = 0 then 0.05 else 0.0 end) as "end", text, speaker
  from words)"""
EV = "ev as (select user_id recording_id, epoch_us(ts) / 1e6::double t, value, event_type, event_id from events)"
IVS = 'ivs as (select recording_id, t as start, t + value * 1000 as "end" from ev)'
PAUSES = """
pauses as (
  select recording_id, pt as start, t as "end" from (
    select recording_id, t, event_type k, lag(event_type) over w pk, lag(t) over w pt from ev where event_type in ('signup', 'error')
    window w as (partition by recording_id order by t, event_id))
  where k = 'error' and pk = 'signup' and t > pt)"""
BOXES = """
boxes as (
  select recording_id, t as start, t + value * 100 as "end", event_id % 1800 x, event_id * 7 % 900 y, 40 + event_id % 600 w, 20 + event_id % 300 h, event_type why
  from ev)"""


def _list(words: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words.split()) + "]"


STOP, TASK = _list(STOP_WORDS), _list(TASK_WORDS)


def toks(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9'']+')"


def content(c: str, n: int = 3) -> str:
    return f"list_filter({toks(c)}, lambda t: not list_contains({STOP}, t) and length(t) >= {n})"


def hits(c: str) -> str:
    starts = " or ".join(f"starts_with(t, '{k}')" for k in ("thing", "tion", "erin"))
    return f"len(list_filter({toks(c)}, lambda t: {starts}))"


def count(c: str, words: str) -> str:
    return f"len(regexp_extract_all(lower({c}), '\\b(?:{words})\\b'))"


NUMBER = r"len(regexp_extract_all({c}, '(?i)\b\d+(?:[.,]\d+)?\s*(?:%|percent|x|times|minutes?|hours?|seconds?|days?|weeks?|k|m|ms)?\b'))"


def teach(c: str) -> str:
    return (
        f"({count(c, 'which|than')} + {count(c, 'have|would')} + 0.5 * {count(c, 'there|their')} + "
        f"0.5 * least({NUMBER.format(c=c)}, 3) - 1.5 * {count(c, 'about|what')})"
    )


def score(c: str, dur: str, h: str | None, filler: str) -> str:
    n = f"len({toks(c)})"
    return (
        f"case when {n} = 0 then 0.0 else " + (f"3.0 * {h} + " if h else "")
        + f"0.15 * ({n} / greatest({dur}, 0.5)) - 0.5 * {count(c, filler)} + case when contains({c}, '?') then 0.5 else 0.0 end end"
    )


def clean(c: str, filler: str | None) -> str:
    out = c if filler is None else f"regexp_replace({c}, '(?i)\\b(?:{filler})\\b', '', 'g')"
    dash = lambda x: f"regexp_replace({x}, '(^|\\s)-(\\s|$)', '\\1 \\2', 'g')"
    out = dash(dash(out))
    out = f"regexp_replace({out}, '\\s*,(?:\\s*,)+', ',', 'g')"
    out = f"regexp_replace({out}, '([.!?;:])\\s*,(\\s|$)', '\\1\\2', 'g')"
    glue = lambda x: f"regexp_replace({x}, '\\s+([,.!?;:])(\\s|$)', '\\1\\2', 'g')"
    out = glue(glue(out))
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' ,;:')"


FILL = "uh|um|hmm|like|you know"
SPLIT = "string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
DUR = '("end" - start)'


def score_sentence(c: str, focus: bool) -> str:
    n, k = f"len({toks(c)})", f"len({content(c)})"
    return (
        f"case when {n} < 5 then 0.0 else {k} / {n} * 2.0 + least({k}, 12) * 0.2 + {count(c, 'this|from')} + 0.5 * {teach(c)}"
        + (f" + 1.5 * {hits(c)}" if focus else "") + " end"
    )


def hms(t: str) -> str:
    return f"printf('%d:%02d:%02d', {t} // 3600, {t} % 3600 // 60, {t} % 60)"


def merged(src: str, gap: float = 0.0, strict: bool = False, extra: str = "") -> str:
    op = ">=" if strict else ">"
    return f"""
      select recording_id, min(start) as start, max("end") as "end"{extra} from (
        select *, sum(o) over (partition by recording_id order by start, "end" rows between unbounded preceding and current row) g from (
          select *, case when start - max("end") over (partition by recording_id order by start, "end" rows between unbounded preceding and 1 preceding) {op} {gap} then 1 else 0 end o
          from {src}))
      group by recording_id, g"""


CANDS = f"""
sc as (
  select *, {hits('text')} h, {score('text', DUR, hits('text'), FILL)} s from cues),
pairs as (
  select a.recording_id, a.cue_ix i, b.cue_ix j, a.start, b."end", a.h hi, b.h hj
  from sc a join sc b on a.recording_id = b.recording_id and b.cue_ix >= a.cue_ix and b.start >= a.start and b."end" - a.start <= 60),
agg as (
  select p.recording_id, p.i, p.j, p.start, p."end", p.hi, p.hj, sum(c.s) s, sum(c.h) h, max(case when c.h > 0 then c."end" end) - min(case when c.h > 0 then c.start end) core
  from pairs p join sc c on c.recording_id = p.recording_id and c.cue_ix between p.i and p.j
  where p."end" - p.start >= 15
  group by all),
cand as (
  select recording_id, i, j, start, "end", round(s * (h / (j - i + 1)) - 0.02 * ("end" - start), 9) score
  from agg where h > 0 and ((hi > 0 and hj > 0) or core < 15)),
ranked as (
  select *, row_number() over (partition by recording_id order by score desc, i, j) rk from cand where score > 0)"""

R6 = lambda c, n=None: f"round({c}, 6) as {n or c}"
SE = 'round(start, 6) as start, round("end", 6) as "end"'
SE3 = 'round(start, 3) as start, round("end", 3) as "end"'


def w(*ctes: str) -> str:
    return "with recursive " + ", ".join(ctes) + " "


KEPT = """
kept as (
  select recording_id, k seg_ix, a + n * case k when 0 then 2 / 3.0::double else 1 / 6.0::double end s_start, a + n * case k when 0 then 1.0::double else 0.5::double end s_end
  from (select recording_id, min(start) a, max("end") - min(start) n from cues group by 1), (values (0), (1)) v(k))"""
ELEM = """
edges as (select recording_id, start e from boxes union select recording_id, "end" from boxes),
parts as (select recording_id, e a, lead(e) over (partition by recording_id order by e) b from edges),
live as (
  select p.recording_id, p.a, p.b, x, y, w, h from parts p join boxes r
  on r.recording_id = p.recording_id and r.start < p.b and r."end" > p.a where p.b is not null)"""
COVER = ELEM + """,
lat as (
  select recording_id, a, b, count(distinct cell) / (240 * 135.0::double) share from (
    select recording_id, a, b, unnest(range(x // 8, least(240, (x + w + 7) // 8))) cx, y, h from live) c,
    lateral (select unnest(range(c.y // 8, least(135, (c.y + c.h + 7) // 8))) cy) r,
    lateral (select cy * 1000 + cx cell) z
  group by all)"""

ORACLE: dict[str, str] = {
    "p1_keywords": f"""with t as (select item_id, unnest(list_filter({toks('text')}, lambda t: not list_contains({STOP}, t) and not list_contains({TASK}, t) and length(t) > 2)) w from benchmark)
      select distinct item_id, keyword from (
        select item_id, w keyword from t
        {''.join(f" union all select item_id, left(w, length(w) - {len(x)}) from t where ends_with(w, '{x}') and length(w) - {len(x)} >= 3" for x in ('ing', 'ed', 'es', 's'))})""",
    "p2_keyword_hits": w(CUES) + f"select recording_id, cue_ix, {hits('text')} hits from cues",
    "p3_score_cue": w(CUES) + f"select recording_id, cue_ix, round({score('text', DUR, hits('text'), FILL)}, 6) score from cues",
    "p4_content_score": w(CUES) + f"select recording_id, cue_ix, round({score('text', DUR, None, 'that|with')} + 0.75 * {count('text', 'this|from')} + 0.6 * {teach('text')}, 6) score from cues",
    "p5_teachable": w(LONG) + f"select recording_id, cue_ix, {teach('text')}::double points from long_cues",
    "p6_score_sentence": w(CUES) + f"select recording_id, cue_ix, round({score_sentence('text', True)}, 6) score from cues",
    "p7_clean_text": w(LONG) + f"select recording_id, cue_ix, {clean('text', 'that|with')} clean from long_cues",
    "p9_clip_text": w(LONG) + f"""select recording_id, cue_ix, case when length(t) <= 40 then t
        else rtrim(case when contains(substring(left(t, 39), 21), ' ') then regexp_replace(left(t, 39), ' [^ ]*$', '') else left(t, 39) end, ' ,;:.') || '…' end clipped
      from (select *, {clean('text', FILL)} t from long_cues)""",
    "p12_classify": w(CUES) + f"""select recording_id, case when contains(t, '?') and n >= 2 then 'Q&A' when regexp_matches(t, '(?i)\\b(?:this|from)\\b') then 'Demo'
        when {'(' + ' + '.join(['0'])})::double >= 1.5 then 'Lesson' else 'none' end as label
      from (select recording_id, string_agg(text, ' ' order by cue_ix) t, count(distinct speaker) n from cues group by 1)""",
    "p14_clamp_box": w(EV, BOXES) + """,
      a as (select recording_id, x - 6 x0, x + w + 6 x1, y - 6 y0, y + h + 6 y1 from boxes),
      b as (select recording_id, greatest(x0, 0) x0, least(x1, 1920) x1, greatest(y0, 0) y0, least(y1, 1080) y1 from a),
      c as (select recording_id, x0 - x0 % 2 x, y0 - y0 % 2 y, (x1 - x1 % 2) - (x0 - x0 % 2) w, (y1 - y1 % 2) - (y0 - y0 % 2) h from b)
      select recording_id, count(*) boxes, sum(x)::bigint x, sum(y)::bigint y, sum(w)::bigint w, sum(h)::bigint h from c where w >= 2 and h >= 2 group by 1""",
    "p15_email_key": """with k as (
        select doc_id, 'email' kind, text, regexp_extract_all(text, '[\\w.+\\-\\p{L}]+ ?@ ?[\\w\\-\\p{L}]+(?:\\.[\\w\\-\\p{L}]+)+') l from documents
        union all
        select doc_id, 'key', text, regexp_extract_all(text, '(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\\w{20,}|xox[abprs]-[\\w-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,}|eyJ[\\w-]{10,}\\.[\\w-]{10,}\\.[\\w-]*)') from documents),
      f as (select doc_id, kind, text, m, n from (select doc_id, kind, text, unnest(l) m, generate_subscripts(l, 1) n from k)),
      r as (
        select doc_id, kind, text, n, m, strpos(text, m) - 1 as start from f where n = 1
        union all
        select f.doc_id, f.kind, f.text, f.n, f.m, r.start + length(r.m) + strpos(substring(f.text, (r.start + length(r.m) + 1)::bigint), f.m) - 1
        from r join f on f.doc_id = r.doc_id and f.kind = r.kind and f.n = r.n + 1)
      select doc_id, kind, start::bigint as start, (start + length(m))::bigint as "end", m as match from r""".replace("with k as", "with recursive k as"),
    "p16_luhn": """with f as (select doc_id, unnest(regexp_extract_all(text, '[0-9](?:[ -]?[0-9]){12,18}')) digits from documents),
      g as (select doc_id, digits, count(*) n, reverse(regexp_replace(digits, '[ -]', '', 'g')) t from f group by 1, 2)
      select doc_id, digits, n, list_sum(list_transform(range(1, length(t) + 1), lambda i: case when i % 2 = 1 then ascii(t[i]) - 48
        else case when (ascii(t[i]) - 48) * 2 > 9 then (ascii(t[i]) - 48) * 2 - 9 else (ascii(t[i]) - 48) * 2 end end)) % 10 = 0 ok from g""",
    "p17_term_hits": """with t as (select distinct trim(unnest(string_split(text, chr(10))), ' ') term from benchmark),
      f as materialized (select distinct regexp_extract(text, '^[\\p{L}\\p{N}_]+ [\\p{L}\\p{N}_]+') p from benchmark),
      e as materialized (select doc_id, text, regexp_replace(lower(text), '\\s+', ' ', 'g') x from documents),
      d as materialized (select doc_id, regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '([\\p{L}\\p{N}_]+)', chr(1) || '\\1' || chr(2), 'g') x from documents),
      p as materialized (select term, regexp_replace(regexp_replace(lower(term), '\\s+', ' ', 'g'), '([\\p{L}\\p{N}_]+)', chr(1) || '\\1' || chr(2), 'g') x from t where term <> '' and term not like '#%'),
      c as materialized (select doc_id, term, string_split(d.x, p.x) l from d join p on contains(d.x, p.x)),
      m as (select doc_id, term, len(list_filter(range(1, len(l)), lambda i: not ends_with(l[i], chr(2)) and not starts_with(l[i + 1], chr(1)))) hits from c),
      g as materialized (select doc_id, text, replace(p, ' ', '\\s+') p from e join f on p <> '' and contains(x, lower(p))),
      r as (select doc_id, 're:' || p || '\\w*' term, len(regexp_extract_all(text, '(?i)' || p || '[\\p{L}\\p{N}_]*')) hits from g)
      select * from m where hits > 0 union all select * from r where hits > 0""",
    "p19_clip_to_spans": w(EV, PAUSES) + """,
      r as (select recording_id, t as start, t + value * 100 as "end", event_id from ev)
      select r.recording_id, event_id red_ix,
        round(greatest(r.start, coalesce(min(case when p."end" >= r.start then p.start end), r.start) - 60, 0), 3) as start,
        round(least(r."end", coalesce(max(case when p.start <= r."end" then p."end" end), r."end") + 60), 3) as "end"
      from r left join pauses p on p.recording_id = r.recording_id group by r.recording_id, event_id, r.start, r."end" """,
    "p25_shift_origin": w(CUES) + 'select recording_id, cue_ix, round(greatest(0, start - 12.5), 6) as start, round("end" - 12.5, 6) as "end" from cues where "end" > 12.5',
    "f_clocks": w(LONG) + f""", t as (select *, floor(start * 9)::bigint n, round(start * 1000)::bigint ms from long_cues)
      select recording_id, cue_ix, {hms('n')} clock, case when n >= 3600 then {hms('n')} else printf('%d:%02d', n // 60, n % 60) end ts,
        printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) srt,
        round(n, 3)::double parsed, greatest(1, round_even(("end" - start) * 24, 0))::bigint frames from t""",
    "f6_slug": w(CUES) + """select recording_id, cue_ix, case when s = '' then 'clip' else s end slug from (
      select *, rtrim(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-') s from cues)""",
    "f7_tokens": w(CUES) + f"select recording_id, cue_ix, token, count(*) n from (select recording_id, cue_ix, unnest({content('text')}) token from cues) group by all",
    "f8_last_sentence": f"select conv_id, turn, list_extract({SPLIT.format(c='t')}, -1) as last from (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) t from conversations)",
    "f10_boxes": """with b as (select event_id e, event_id * 3 % 300 ax, event_id * 5 % 200 ay, event_id * 5 % 300 bx, event_id * 7 % 200 bb, 40 + event_id % 60 w, 30 + event_id % 50 h from events)
      select e event_id, least(ax, bx) x, least(ay, bb) y, greatest(ax, bx) + w - least(ax, bx) w, greatest(ay, bb) + h - least(ay, bb) h,
        round(greatest(0, w - abs(ax - bx)) * greatest(0, h - abs(ay - bb)) / (w * h), 6) overlap from b""",
    "f11_f13": "select conv_id, round(count(*) * 60 * 0.8, 6)::double low, round(count(*) * 60, 6)::double target, round(count(*) * 60 * 1.2, 6)::double high, least(8, 3 + 1.5 * (count(distinct role) - 1))::double as seconds from conversations group by 1",
    "f14_fingerprint": w(CUES) + """select recording_id, cue_ix, left(sha256('{"recording_id":' || recording_id || ',"cue_ix":' || cue_ix || '}'), 16) tag from cues""",
    "w1_sentences": w(CUES) + f""", p as (
        select recording_id, cue_ix, start, speaker, k, trim(p, ' ,') p from (select recording_id, cue_ix, start, speaker, unnest(l) p, generate_subscripts(l, 1) k from (select *, {SPLIT.format(c=clean('text', FILL))} l from cues)) where trim(p, ' ,') <> ''),
      q as (select *, lag(right(p, 1) in ('.', '!', '?')) over o pe, lag(speaker) over o ps from p window o as (partition by recording_id order by cue_ix, k)),
      r as (select *, sum(case when pe is null or pe or ps is distinct from speaker then 1 else 0 end) over (partition by recording_id order by cue_ix, k) g from q),
      x as (select recording_id, g, first(start order by cue_ix, k) as start, string_agg(p, ' ' order by cue_ix, k) as text, first(speaker order by cue_ix, k) speaker from r group by 1, 2)
      select recording_id, (g - 1)::bigint sent_ix, round(start, 6) as start, case when right(text, 1) in ('.', '!', '?') then text else text || '.' end as text, speaker from x""",
    "w1_sentences_across_cues": w(CUES) + f""", c as (
        select recording_id, cue_ix * 2 + k cue_ix, start, case when k = 0 then left(text, length(text) // 2) else substring(text, length(text) // 2 + 1) end as text from cues, (values (0), (1)) v(k)),
      p as (select recording_id, cue_ix, start, k, trim(p, ' ,') p from (select recording_id, cue_ix, start, unnest(l) p, generate_subscripts(l, 1) k from (select *, {SPLIT.format(c=clean('text', FILL))} l from c)) where trim(p, ' ,') <> ''),
      q as (select *, lag(right(p, 1) in ('.', '!', '?')) over (partition by recording_id order by cue_ix, k) pe from p),
      r as (select *, sum(case when pe is null or pe then 1 else 0 end) over (partition by recording_id order by cue_ix, k) g from q),
      x as (select recording_id, g, first(start order by cue_ix, k) as start, string_agg(p, ' ' order by cue_ix, k) as text from r group by 1, 2)
      select recording_id, (g - 1)::bigint sent_ix, round(start, 6) as start, case when right(text, 1) in ('.', '!', '?') then text else text || '.' end as text from x""",
    "w2_sentence_spans": w(CUES, WORDS, TIMED) + r""", f as (
        select *, case when lag(text) over o is null or regexp_matches(lag(text) over o, '[.!?]+["''”’)\]]*$') or lag(speaker) over o <> speaker or start - lag("end") over o > 1.5 then 1 else 0 end b
        from timed window o as (partition by recording_id order by word_ix)),
      r as (select recording_id, word_ix, start s, "end" e, speaker, b, start span, 0::bigint n from f where word_ix = 0
        union all
        select f.recording_id, f.word_ix, f.start, f."end", f.speaker, f.b, case when f.b = 1 or f."end" - r.span > 20 then f.start else r.span end, case when f.b = 1 or f."end" - r.span > 20 then r.n + 1 else r.n end
        from r join f on f.recording_id = r.recording_id and f.word_ix = r.word_ix + 1)
      select recording_id, min(word_ix) first_word, max(word_ix) last_word, round(first(s order by word_ix), 6) as start, round(last(e order by word_ix), 6) as "end", last(speaker order by word_ix) speaker from r group by recording_id, n""",
    "w3_words_from_cues": w(CUES, WORDS) + f"select recording_id, word_ix, {SE}, text, round(cut_start, 6) cut_start from words",
    "j1_align_speakers": w(CUES) + f""",
      u as (select recording_id, start + 5 t, speaker, cue_ix, list_distinct({content('text')}) k from cues),
      c as (select recording_id, cue_ix, (start + "end") / 2 m, list_distinct({content('text')}) k from cues),
      b as (select c.recording_id, c.cue_ix, u.speaker, u.t, u.cue_ix ux, len(list_intersect(c.k, u.k)) / len(c.k) o, len(list_intersect(c.k, u.k)) / len(c.k) - 0.005 * abs(t - m) s
            from c join u on u.recording_id = c.recording_id and t between m - 30 and m + 30 where len(c.k) > 0),
      x as (select *, row_number() over (partition by recording_id, cue_ix order by s desc, t, ux) r from b where o >= 0.5)
      select c.recording_id, c.cue_ix, coalesce(x.speaker, '?') speaker from c left join x on x.recording_id = c.recording_id and x.cue_ix = c.cue_ix and r = 1""",
    "j2_fill_speakers": w(CUES) + """, c as (select recording_id, cue_ix, start, "end", case when cue_ix % 3 = 0 then speaker end s from cues),
      x as (select *, last_value(case when s is not null then {'s': s, 't': "end"} end ignore nulls) over (partition by recording_id order by cue_ix rows between unbounded preceding and 1 preceding) p,
             first_value(case when s is not null then {'s': s, 't': start} end ignore nulls) over (partition by recording_id order by cue_ix rows between 1 following and unbounded following) n from c)
      select recording_id, cue_ix, coalesce(s, case when p.s = n.s and n.t - p.t <= 10 then p.s end, '?') speaker from x""",
    "j3_retime": w(CUES, KEPT) + """, k as (select *, coalesce(sum(s_end - s_start) over (partition by recording_id order by seg_ix rows between unbounded preceding and 1 preceding), 0) off from kept where s_end > s_start),
      m as (select c.*, k.seg_ix, s_start, off, greatest(start, s_start) a, least("end", s_end) b from cues c join k on k.recording_id = c.recording_id and c.start < s_end and c."end" > s_start),
      z as (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') l from m)
      select recording_id, seg_ix, cue_ix, round(off + a - s_start, 6) as start, round(off + b - s_start, 6) as "end" from z
      where (a = start and b = "end") or ((b - a) / ("end" - start) > 0.25 and
        len(list_filter(range(len(l)), lambda i: (i + 0.5) / len(l) between (a - start) / ("end" - start) and (b - start) / ("end" - start))) > 0)""",
    "j4_talk_time": w(CUES, WORDS, KEPT) + """, m as (
        select c.recording_id, speaker, sum(least("end", s_end) - greatest(start, s_start)) s, min(seg_ix * 100000 + cue_ix) f from cues c join kept k on k.recording_id = c.recording_id and start < s_end and "end" > s_start where s_end > s_start group by 1, 2),
      q as (select w.recording_id, list(text order by seg_ix, word_ix) l from words w join kept k on k.recording_id = w.recording_id and start < s_end and "end" > s_start where s_end > s_start group by 1)
      select m.recording_id, string_agg(speaker, '|' order by round(s, 9) desc, f) speakers, round(max(s), 6) top,
        first(array_to_string(case when len(l) > 88 then l[1:70] || ['…'] || l[-18:] else l end, ' ')) quote
      from m join q on q.recording_id = m.recording_id group by 1""",
    "j5_cues_in_moment": w(CUES, CANDS) + """, r3 as (select * from picks3)
      select p.recording_id, p.i moment_ix, c.cue_ix from picks3 p join cues c on c.recording_id = p.recording_id and c."end" > p.start + 2 and c.start < p."end" - 2""",
    "j6_overlays_on_screen": w(CUES, KEPT) + 'select recording_id, cue_ix overlay_ix from cues c where exists (select 1 from kept k where k.recording_id = c.recording_id and s_end > s_start and c.start < s_end and c."end" > s_start)',
    "j12_frames_in_segments": w(CUES, WORDS, KEPT) + """select w.recording_id, seg_ix, round(start, 6) ts, round(start - s_start + case when seg_ix = 0 then 0 else 100 end, 6) out_ts
      from words w join kept k on k.recording_id = w.recording_id and start >= s_start and start < s_end""",
    "j13_live_boxes": w(EV, BOXES, ELEM) + """, s as (select recording_id, a, b, list_sort(list(distinct {'x': x, 'y': y, 'w': w, 'h': h})) l from live group by all),
      f as (select *, case when lag(b) over o = a and lag(l) over o = l then 0 else 1 end n from s window o as (partition by recording_id order by a)),
      g as (select *, sum(n) over (partition by recording_id order by a) g from f)
      select recording_id, round(min(a), 3) as start, round(max(b), 3) as "end", first(len(l)) live from g group by recording_id, g""",
    "j14_overlap_seconds": w(EV, IVS, PAUSES, f"m as ({merged('ivs')})") + """select m.recording_id, round(sum(least(m."end", p."end") - greatest(m.start, p.start)), 2) as seconds
      from m join pauses p on p.recording_id = m.recording_id and p.start < m."end" and p."end" > m.start group by 1""",
    "u3_intersections": w(EV, IVS, PAUSES) + """select m.recording_id, round(greatest(m.start, p.start), 3) as start, round(least(m."end", p."end"), 3) as "end"
      from ivs m join pauses p on p.recording_id = m.recording_id and p.start < m."end" and p."end" > m.start""",
    "u4_jaccard": w(CUES) + f""", k as (select recording_id, cue_ix, list_distinct({content('text')}) w from cues)
      select a.recording_id, a.cue_ix, case when len(a.w) + len(b.w) = 0 then 0.0 else round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) end jaccard
      from k a join k b on b.recording_id = a.recording_id and b.cue_ix = a.cue_ix + 1""",
    "j16_best_sentence_for_terms": f"""with p as (select conv_id, turn, trim(p, ' ,') p, k from (select conv_id, turn, unnest(l) p, generate_subscripts(l, 1) k from (select *, {SPLIT.format(c=clean('text', FILL))} l from conversations)) where trim(p, ' ,') <> ''),
      r as (select *, row_number() over (partition by conv_id, turn order by {hits('p')} desc, least(length(p), 200) desc, k) n from p)
      select conv_id, turn, left(case when right(p, 1) in ('.', '!', '?') then p else p || '.' end, 200) sentence from r where n = 1""",
    "a1_blocks": w(CUES) + f"select recording_id, floor(start / 30)::bigint block, count(*) cues, sum(len({toks('text')}))::bigint words, count(distinct speaker) speakers from cues group by 1, 2",
    "a2_format_blocks": w(CUES) + f""", c as (select recording_id, floor(start / 30)::bigint block, cue_ix, speaker, {clean('text', FILL)} t from cues),
      f as (select *, case when lag(speaker) over o is distinct from speaker then 1 else 0 end n, row_number() over o rn from c where t <> '' window o as (partition by recording_id, block order by cue_ix)),
      g as (select *, sum(n) over (partition by recording_id, block order by cue_ix) g from f),
      l as (select recording_id, block, g, first(speaker) || ': ' || string_agg(t, ' ' order by cue_ix) s from g group by 1, 2, 3),
      st as (select *, '[' || {hms('(block * 30)')} || ']' stamp from l)
      select recording_id, block, string_agg(case when g = 1 then stamp else repeat(' ', length(stamp)) end || ' ' || s, chr(10) order by g) as text from st group by 1, 2""",
    "a3_dominant_speaker": w(CUES) + """, t as (select recording_id, speaker, sum("end" - start) s, min(cue_ix) f from cues group by 1, 2)
      select recording_id, first(speaker order by round(s, 9) desc, f) speaker, round(max(s), 6) as seconds from t group by 1""",
    "a4_top_topics": w(CUES) + f""", t as (select recording_id, cue_ix, unnest(list_distinct({content('text', 4)})) word from cues),
      n as (select recording_id, word, count(*) lines from t group by 1, 2 having count(*) >= 2)
      select * from (select *, row_number() over (partition by recording_id order by lines desc, word) as rank from n) where rank <= 3""",
    "a5_best_sentence": w(CUES) + f""", p as (
        select recording_id, cue_ix, speaker, k, trim(p, ' ,') p from (select recording_id, cue_ix, speaker, unnest(l) p, generate_subscripts(l, 1) k from (select *, {SPLIT.format(c=clean('text', 'that|with'))} l from cues)) where trim(p, ' ,') <> ''),
      q as (select *, lag(right(p, 1) in ('.', '!', '?')) over o pe, lag(speaker) over o ps from p window o as (partition by recording_id order by cue_ix, k)),
      r as (select *, sum(case when pe is null or pe or ps is distinct from speaker then 1 else 0 end) over (partition by recording_id order by cue_ix, k) g from q),
      x as (select recording_id, g, string_agg(p, ' ' order by cue_ix, k) as t from r group by 1, 2),
      z as (select recording_id, g, case when right(t, 1) in ('.', '!', '?') then t else t || '.' end t from x),
      b as (select *, row_number() over (partition by recording_id order by round({score_sentence('t', False)}, 9) desc, length(t) desc, g) n from z)
      select recording_id, {clean('t', 'that|with')} as text from b where n = 1""",
    "a8_kind_counts": w(EV, BOXES) + """select recording_id, kind, count(*) records from (
        select recording_id, unnest(string_split(case when x % 3 = 0 then why || ', manual' else why end, ', ')) kind from boxes) group by 1, 2""",
    "a9_coverage": w(EV, BOXES, COVER) + 'select recording_id, round(a, 3) as start, round(b, 3) as "end", round(share, 6) share from lat',
    "a10_large_blurs": w(EV, BOXES, COVER) + """, areas as (select recording_id, a, b, sum(w * h / (1920.0::double * 1080)) s, max(w * h / (1920.0::double * 1080)) m from live group by all),
      sh as (select l.recording_id, l.a as start, l.b as "end", case when s <= 0.05 then least(1, s) when m > 0.05 then m else share end share from lat l join areas using (recording_id, a, b)),
      big as (select * from sh where share > 0.05)
      select recording_id, round(start, 3) as start, round("end", 3) as "end", round(share, 6) share from (""" + merged("big", extra=", max(share) share") + ")",
    "a11_peak_rms": w(EV, PAUSES) + """, s as (select *, floor(start * 1000)::bigint span_ix from pauses),
      p as (select recording_id, span_ix, max(abs(value)) p, sqrt(avg(case when k % 4 = 0 then value * value end)) r from (
        select s.recording_id, span_ix, value, row_number() over (partition by s.recording_id, span_ix order by t, event_id) - 1 k from s left join ev e on e.recording_id = s.recording_id and t >= start and t < "end") group by 1, 2)
      select recording_id, span_ix, round(case when p > 0 then greatest(-120, 20 * log10(p / 500)) else -120 end, 4)::double peak_db, round(coalesce(r, 0), 4) rms from p""",
    "a12_changed_share": """with f as (select vec_id // 50 recording_id, (vec_id % 50)::double ts, list_transform(embedding, lambda x: floor(x * 100::float + 0.5::float)::int) l from embeddings)
      select a.recording_id, a.ts, round(len(list_filter(list_zip(a.l, b.l), lambda z: abs(z[1] - z[2]) > 12)) / len(a.l), 6) changed,
        list_max(list_transform(list_zip(a.l, b.l), lambda z: abs(z[1] - z[2])))::bigint diff
      from f a join f b on b.recording_id = a.recording_id and b.ts = a.ts + 1""",
    "a13_first_sightings": """with h as (select doc_id, unnest(regexp_extract_all(text, '[\\w.+\\-\\p{L}]+ ?@ ?[\\w\\-\\p{L}]+(?:\\.[\\w\\-\\p{L}]+)+')) m from documents)
      select 0 recording_id, min(doc_id)::double t, 'email' kind, lower(trim(m)) as match from h where length(trim(m)) >= 3 group by lower(trim(m))""",
    "j11_audit_edges": w(EV, PAUSES) + """, e as (select recording_id, floor(start * 1000)::bigint segment, 'start' kind, start x from pauses union all select recording_id, floor(start * 1000)::bigint, 'end', "end" from pauses),
      l as (select e.recording_id, segment, kind, max(case when t < x then abs(value) end) b, max(case when t >= x then abs(value) end) a
        from e left join ev on ev.recording_id = e.recording_id and t >= x - 20000 and t < x + 20000 group by 1, 2, 3)
      select recording_id, segment, kind, round(coalesce(greatest(-120, 20 * log10(b / 10000)), -120), 4)::double before_db, round(coalesce(greatest(-120, 20 * log10(a / 10000)), -120), 4)::double after_db from l""",
    "a14_audit_report": w(EV, PAUSES) + """, e as (select recording_id, floor(start * 1000)::bigint segment, 'start' kind, start x from pauses union all select recording_id, floor(start * 1000)::bigint, 'end', "end" from pauses),
      l as (select e.recording_id, segment, kind, max(case when t < x then abs(value) end) b, max(case when t >= x then abs(value) end) a
        from e left join ev on ev.recording_id = e.recording_id and t >= x - 20000 and t < x + 20000 group by 1, 2, 3)
      select recording_id, count(*) edges, count(*) filter (20 * log10(a / 10000) > -25 and 20 * log10(b / 10000) > -25) voiced_both_sides from l group by 1""",
    "a16_reconcile": w(CUES, WORDS) + """select recording_id plan_id, word_ix ix, case when word_ix % 50 = 3 then 'missing' else 'moved' end problem from words where word_ix % 50 = 3 or word_ix % 40 = 1
      union all select recording_id, word_ix + 1000000, 'extra' from words where word_ix % 60 = 7""",
    "s11_pair_intervals": w(EV, PAUSES) + f"select recording_id, {SE3} from pauses",
    "w5_merge_intervals": w(EV, IVS) + f"select recording_id, {SE3} from ({merged('ivs')})",
    "w6_merge_silences": w(EV, PAUSES) + f"""select recording_id, {SE3} from ({merged('pauses', 3600, True)}) where "end" - start >= 7200 - 1e-9""",
    "w7_complement": w(EV, IVS, f"m as ({merged('ivs')})") + """, b as (select recording_id, min(start) - 10 lo, max("end") + 10 hi from ivs group by 1),
      g as (select recording_id, "end" a, lead(start) over (partition by recording_id order by start) z from m)
      select recording_id, round(a, 3) as start, round(z, 3) as "end" from (
        select recording_id, a, coalesce(z, hi) z from g join b using (recording_id) union all select recording_id, lo, lo + 10 from b) where z > a""",
    "w8_word_runs": w(CUES, WORDS, TIMED) + f"select recording_id, {SE}, words from ({merged('timed', 0.050001, extra=', count(*) words')})",
    "w18_overlay_runs": w(CUES, WORDS) + """, f as (select recording_id, word_ix n, start ts from words),
      h as (select f.recording_id, c.cue_ix overlay_ix, n, ts, n - row_number() over (partition by f.recording_id, c.cue_ix order by n) g
        from f join cues c on c.recording_id = f.recording_id and ts >= c.start and ts < c."end")
      select recording_id, overlay_ix, round(min(ts), 6) as first, round(max(ts), 6) as last, count(*) frames from h group by recording_id, overlay_ix, g""",
    "w21_sample_times": w(CUES) + """, s as (select recording_id, floor(start) a, floor("end" + 1) b from cues)
      select distinct recording_id, round(t, 2)::double t from (
        select recording_id, a + 0.5 * unnest(range((ceil((b - a) / 0.5))::bigint)) t from s union all select recording_id, greatest(a, b - 0.05) from s)""",
    "t1_best_window": w(CUES, CANDS) + f"select recording_id, i, j, {SE}, round(score, 5) score from ranked where rk = 1",
    "t1_best_windows": w(CUES, CANDS) + f"select recording_id, i, j, {SE}, round(score, 5) score from picks3",
}
PICKS = """,
greedy as (
  select recording_id, rk, [{'s': start, 'e': "end"}] taken, i, j, start, "end", score, true as took, (select max(rk) from ranked z where z.recording_id = r.recording_id) last from ranked r where rk = 1
  union all
  select g.recording_id, c.rk,
    case when len(g.taken) < 3 and len(list_filter(g.taken, lambda t: c.start < t.e and c."end" > t.s)) = 0 then g.taken || [{'s': c.start, 'e': c."end"}] else g.taken end,
    c.i, c.j, c.start, c."end", c.score, len(g.taken) < 3 and len(list_filter(g.taken, lambda t: c.start < t.e and c."end" > t.s)) = 0, g.last
  from greedy g join ranked c on c.recording_id = g.recording_id and c.rk = g.rk + 1),
picks3 as (select * from greedy where took)"""
for _n in ("t1_best_windows",):
    ORACLE[_n] = ORACLE[_n].replace(CANDS + " ", CANDS + PICKS + " ")
ORACLE["j5_cues_in_moment"] = ORACLE["j5_cues_in_moment"].replace(CANDS + " ", CANDS + PICKS + " ").replace(", r3 as (select * from picks3)", "")

REQS = 'reqs as (select recording_id, cue_ix req_ix, start + 1.3 as start, "end" + 17.7 as "end" from cues)'
PK = CANDS + PICKS
TAKE = f""", kp as (
  select p.recording_id, p.i, trim(x, ' ,') s, k from (
    select recording_id, i, unnest(l) x, generate_subscripts(l, 1) k from (
      select recording_id, i, {SPLIT.format(c=clean('t', FILL))} l from (
        select p.recording_id, p.i, string_agg(c.text, ' ' order by c.cue_ix) t from picks3 p join cues c on c.recording_id = p.recording_id and c.cue_ix between p.i and p.j group by 1, 2))) p
  where trim(x, ' ,') <> ''),
tk as (
  select recording_id, i, left(case when right(s, 1) in ('.', '!', '?') then s else s || '.' end, 200) takeaway from (
    select *, row_number() over (partition by recording_id, i order by {hits('s')} desc, least(length(s), 200) desc, k) n from kp) where n = 1),
clips as (
  select p.recording_id, p.i, p.start, p."end", takeaway, row_number() over (partition by p.recording_id order by p.start) n, d.dur
  from picks3 p join tk using (recording_id, i) join (select recording_id, max("end") dur from cues group by 1) d using (recording_id)),
segs as (select *, round(greatest(0, start - 0.15), 3) a, round(least("end" + 0.3, dur), 3) b from clips)"""
SLUG = "rtrim(left(trim(regexp_replace(lower(takeaway), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-')"
CLIP_ID = f"printf('clip-%02d-', n) || case when {SLUG} = '' then 'clip' else {SLUG} end"
TIMELINE = """, per as (select recording_id, count(*) clips from segs group by 1),
items as (
  select recording_id, 0 o, 'intro' role, 4.0 as seconds from per
  union all select recording_id, 1, 'opening', least(8, 3 + 1.5 * (least(clips, 4) - 1)) from per
  union all select recording_id, 2 * i + 10, 'chapter', 3 from (select recording_id, n i from segs)
  union all select recording_id, 2 * n + 11, 'clip', b - a from segs
  union all select recording_id, 1000, 'outro', 3 from per),
line as (select recording_id, (row_number() over o - 1)::bigint item_ix, role, coalesce(sum(seconds) over (partition by recording_id order by o rows between unbounded preceding and 1 preceding), 0)::double as start, seconds::double as seconds from items window o as (partition by recording_id order by o))"""
ORACLE |= {
    "p10_filler_mask": w(CUES, WORDS, TIMED) + r""", x as (
        select *, lag("end") over o pe, lag(text) over o pt, lead(start) over o ns, regexp_replace(lower(text), '[^a-z'']', '', 'g') norm from timed window o as (partition by recording_id order by word_ix))
      select recording_id, word_ix, norm in ('that', 'le') or (norm in ('with', 'de')
        and (pt is null or regexp_matches(pt, '[,.?!;:…]\s*$') or start - pe >= 0.25) and (ns is null or regexp_matches(text, '[,.?!;:…]\s*$') or ns - "end" >= 0.25)) filler from x""",
    "p13_validate_proposals": w(CUES) + """, p as (select recording_id, cue_ix, round(start, 3) s, round(start + cue_ix * 3, 3) e, text, max("end") over (partition by recording_id) d from cues)
      select recording_id, cue_ix req_ix, s as start, round(least(e, d), 3) as "end", case when cue_ix % 3 = 0 then 8.0 else 5.0 end::double score, left(text, 80) title
      from p where cue_ix % 7 <> 0 and s < e and e <= d + 1 and e - s between 10 and 90""",
    "p20_strip_annotations": w(CUES) + "select recording_id, cue_ix, trim(text) as text from cues where cue_ix % 4 <> 0",
    "p23_preset_bounds": w(CUES, PK + TAKE) + f"select recording_id, {CLIP_ID} clip_id, round(2 * (b - a), 3) as seconds from segs where 2 * (b - a) < 15 or 2 * (b - a) > 60",
    "p24_detection_spans": w(CUES, PK) + 'select recording_id, i, round(greatest(0, start - 1.25), 6) detect_start, round("end" + 1.4, 6) detect_end from picks3',
    "j8_neighbours": w(CUES, WORDS, TIMED, REQS) + """select r.recording_id, req_ix,
        round((select last("end" order by word_ix) from timed w where w.recording_id = r.recording_id and w.start < r.start - 1e-6 and w."end" <= r.start + 1e-6), 6) prev_word_end,
        round((select min(start) from timed w where w.recording_id = r.recording_id and w.start >= r."end" - 1e-6), 6) next_word_start from reqs r""",
    "j8_speech_edges": w(CUES, WORDS, TIMED, REQS) + """, i as (
        select r.recording_id, req_ix, r.start s, r."end" e, max(w.word_ix) filter (w.start <= r.start) i, max(w.word_ix) filter (w.start < r."end") j
        from reqs r join timed w on w.recording_id = r.recording_id group by all),
      k as (select i.*, case when i is null then 0 when w."end" <= s + 1e-6 then i + 1 else i end f from i left join timed w on w.recording_id = i.recording_id and w.word_ix = i.i)
      select k.recording_id, req_ix, round(case when f <= j then a.start else s end, 6) as first, round(case when f <= j then b."end" else e end, 6) as last
      from k left join timed a on a.recording_id = k.recording_id and a.word_ix = f left join timed b on b.recording_id = k.recording_id and b.word_ix = j""",
    "t4_executive_summary": w(CUES) + f""", p as (
        select recording_id, cue_ix, start, speaker, k, trim(p, ' ,') p from (select recording_id, cue_ix, start, speaker, unnest(l) p, generate_subscripts(l, 1) k from (select *, {SPLIT.format(c=clean('text', 'that|with'))} l from cues)) where trim(p, ' ,') <> ''),
      q as (select *, lag(right(p, 1) in ('.', '!', '?')) over o pe, lag(speaker) over o ps from p window o as (partition by recording_id order by cue_ix, k)),
      r as (select *, sum(case when pe is null or pe or ps is distinct from speaker then 1 else 0 end) over (partition by recording_id order by cue_ix, k) g from q),
      x as (select recording_id, (g - 1)::bigint sent_ix, first(start order by cue_ix, k) as start, string_agg(p, ' ' order by cue_ix, k) as t from r group by 1, 2),
      z as (select recording_id, sent_ix, start, case when right(t, 1) in ('.', '!', '?') then t else t || '.' end t from x),
      sc as (select *, round({score_sentence('t', False)}, 9) s, list_distinct(list_filter({toks('t')}, lambda t: not list_contains({STOP}, t))) w from z where length(t) <= 300),
      rk as (select *, row_number() over (partition by recording_id order by s desc, sent_ix) rk from sc where s > 0),
      g as (
        select recording_id, rk, sent_ix, start, t, [w] taken, true took from rk where rk = 1
        union all
        select c.recording_id, c.rk, c.sent_ix, c.start, c.t, case when ok then g.taken || [c.w] else g.taken end, ok
        from g join rk c on c.recording_id = g.recording_id and c.rk = g.rk + 1,
        lateral (select len(g.taken) < 4 and len(list_filter(g.taken, lambda x: len(x) > 0 and len(c.w) > 0 and len(list_intersect(x, c.w)) / len(list_distinct(x || c.w)) > 0.6)) = 0 ok) l)
      select recording_id, sent_ix, round(start, 6) as start, t as text from g where took""",
    "t9_build_plan": w(CUES, PK + TAKE) + f'select recording_id, {CLIP_ID} clip_id, takeaway, round(start, 3) as start, round("end", 3) as "end" from clips',
    "a6_plan_runtime": w(CUES, PK + TAKE + TIMELINE) + "select recording_id, round(sum(seconds), 3) as seconds from line group by 1",
    "w19_timeline": w(CUES, PK + TAKE + TIMELINE) + "select recording_id, item_ix, role, round(start, 3) as start, round(seconds, 3) as seconds from line",
    "v1_violations": w(CUES, PK + TAKE) + """, n as (select recording_id plan_id, count(*) c from segs group by 1)
      select plan_id, case plan_id % 5 when 0 then 'length' when 1 then 'choice' when 2 then 'past_end' else 'unknown_key' end as rule, case when plan_id % 5 in (0, 2) then c else 1 end faults from n where plan_id % 5 < 4""",
    "s3_srt_blocks": w(CUES) + """, t as (select *, round(start * 1000)::bigint a, round("end" * 1000)::bigint b from cues)
      select recording_id, cue_ix, (cue_ix + 1) || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a % 3600000 // 60000, a % 60000 // 1000, a % 1000) || ' --> ' ||
        printf('%02d:%02d:%02d,%03d', b // 3600000, b % 3600000 // 60000, b % 60000 // 1000, b % 1000) || chr(10) || text || chr(10) as line from t""",
    "s13_resolve_captions": w(CUES) + """select recording_id, case when recording_id % 3 = 0 then 'srt' when recording_id % 2 = 0 then 'transcribed' else 'embedded' end captions_kind, count(*) cues
      from cues where recording_id % 3 = 0 or recording_id % 2 = 0 or recording_id % 5 = 0 group by 1, 2""",
    "s16_incremental_filter": w(CUES) + "select recording_id, cue_ix from cues where cue_ix % 2 = 0",
    "s1_read_srt": w(CUES) + "select recording_id, cue_ix, round(start, 3) as start, round(\"end\", 3) as \"end\", regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') as text, speaker from cues",
    "s2_strict_cues": w(CUES) + """select recording_id, row_number() over (partition by recording_id order by cue_ix) - 1 cue_ix, round(start, 3) as start, round("end", 3) as "end", text
      from cues where cue_ix % 10 <> 3""",
    "s2_strict_rejects": w(CUES) + "select recording_id, cue_ix + 1 record_ix from cues where cue_ix % 10 = 3",
    "s4_read_words": w(CUES, WORDS, TIMED) + f"select recording_id, word_ix, {SE}, text from timed",
    "s6_read_notes": """with t as (select conv_id recording_id, turn, upper(role[1]) || role[2:] speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, turn // 2 b from conversations),
      x as (select *, sum(length(text)) over (partition by recording_id, b) al, coalesce(sum(length(text)) over (partition by recording_id, b order by turn rows between unbounded preceding and 1 preceding), 0) bf, max(b) over (partition by recording_id) mb from t)
      select recording_id, row_number() over (partition by recording_id order by turn) - 1 utt_ix, round(b * 60 + case when b = mb then al / 15.0::double else 60 end * bf / al, 6)::double as time, speaker, text from x""",
    "s9_read_specs": w(CUES, REQS) + f"""select recording_id, req_ix, {SE}, 'T|a|b' card from reqs where req_ix % 4 <> 1
      union all select recording_id, req_ix + 1, null, null, 'rejected' from reqs where req_ix % 4 = 1""",
    "s12_media_facts": w(CUES) + """select recording_id, case when recording_id % 5 = 0 then 0.0 else printf('%.3f', max("end"))::double end duration_seconds, recording_id % 5 <> 0 and recording_id % 3 = 0 has_video,
      recording_id % 5 <> 0 and recording_id % 3 <> 0 has_audio, case when recording_id % 5 = 0 then -1 when recording_id % 3 = 0 then 0 end::bigint subtitle from cues group by recording_id""",
    "f4_hms_tenths": w(CUES) + """, t as (select *, start * 37 t, floor(start * 37)::bigint n from cues)
      select recording_id, cue_ix, printf('%d:%02d:%04.1f', n // 3600, n % 3600 // 60, n % 60 + (t - n)) stamp from t""",
    "f9_trim_words": w(CUES) + """, l as (select *, regexp_extract_all(text, '\\S+') l from cues)
      select recording_id, cue_ix, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: (i - 0.5) / len(l) between 0.25 and 0.75), lambda i: l[i]), ' ') as text from l""",
    "p8_tidy_sentence": w(CUES) + f"""select recording_id, cue_ix, upper(t[1]) || t[2:] tidy from (select *, trim(regexp_replace({clean('text', 'that|with')}, '\\s+', ' ', 'g'), ' ,;:') t from cues)""",
    "p21_pad": w(CUES, REQS) + """select recording_id, req_ix, round(greatest(0, r.start - 0.15), 6) as start, round(least(r."end" + 0.3, d), 6) as "end"
      from reqs r join (select recording_id, max("end") d from cues group by 1) using (recording_id)""",
    "v2_story_faults": w(CUES) + """select recording_id * 100000 + cue_ix spec_id, case cue_ix % 4 when 0 then 'overlay_outside' when 1 then 'choice' else 'unknown_key' end as rule from cues where cue_ix % 4 < 3""",
    "t5_fit_moments": w(CUES, REQS) + f""", r as (select *, row_number() over (partition by recording_id order by req_ix % 7 desc, req_ix) k from reqs),
      z as (
        select recording_id, 0::bigint k, 0::bigint req_ix, {INTRO + BOOKENDS}::double run, []::struct(s double, e double)[] taken, false ok from r group by 1
        union all
        select recording_id, k, req_ix, case when fits then run + {CARD + AIR} + e - s else run end, case when fits then list_append(taken, {{'s': s, 'e': e}}) else taken end, fits from (
          select z.recording_id, r.k, r.req_ix, z.run, z.taken, r.start s, r."end" e,
            z.run < 90 and z.run + {CARD} + r."end" - r.start <= {90 * (1 + TOLERANCE)} and len(list_filter(z.taken, lambda x: r.start < x.e and r."end" > x.s)) = 0 fits
          from z join r on r.recording_id = z.recording_id and r.k = z.k + 1))
      select recording_id, req_ix moment_ix from z where ok""",
    "w17_screen_runs": """with recursive f as (select vec_id // 50 recording_id, (vec_id % 50)::double ts, list_transform(embedding, lambda x: floor(x * 100::float + 0.5::float)::int) l from embeddings),
      n as (select *, row_number() over (partition by recording_id order by ts) k from f),
      z as (
        select recording_id, k, ts, l head, l seen, ts rt, ts run, true rd from n where k = 1
        union all
        select recording_id, k, ts, case when same then head else l end, case when rd then l else seen end, case when rd then ts else rt end, case when same then run else ts end, rd from (
          select *, not same or far >= 8 or ts - rt >= 3 rd from (
            select n.recording_id, n.k, n.ts, n.l, z.head, z.seen, z.rt, z.run,
              len(list_filter(range(1, len(n.l) + 1), lambda i: abs(z.head[i] - n.l[i]) > 12)) / len(n.l)::double < 0.4 same,
              list_max(list_transform(range(1, len(n.l) + 1), lambda i: abs(z.seen[i] - n.l[i]))) far
            from z join n on n.recording_id = z.recording_id and n.k = z.k + 1)))
      select recording_id, ts, run run_start, rd or (lead(run) over (partition by recording_id order by ts) is distinct from run and ts - rt >= 1) as read from z""",
    "q5_audit_plan": w(CUES, WORDS, PK + TAKE) + """, e as (select recording_id, n, 'start' kind, a x from segs union all select recording_id, n, 'end', b from segs),
      l as (select e.recording_id, n, kind, max(case when w.start < x then length(text) * 1000 end) b, max(case when w.start >= x then length(text) * 1000 end) a
        from e left join words w on w.recording_id = e.recording_id and w.start >= x - 0.5 and w.start < x + 0.5 group by 1, 2, 3)
      select recording_id, count(*) edges, count(*) filter (20 * log10(a / 32768) > -25 and 20 * log10(b / 32768) > -25) voiced_both_sides from l group by 1""",
    "q3_outline": f"""select recording_id, 1 part, block ix, text || chr(10) line from ({ORACLE['a2_format_blocks']})
      union all select recording_id, 0, unnest(range(len(l))), unnest(l) from ({w(CUES)} select recording_id, ['# Session — outline', '',
        'Source: `talk-' || recording_id || '.mp4` · ' || {hms('floor(max("end"))::bigint')} || ' long · ' || count(*) || ' caption cues · 30 s blocks',
        'Speakers: ' || array_to_string(list_sort(list(distinct speaker)), ', '), chr(10) || '## Transcript' || chr(10)] l from cues group by 1)
      union all select distinct conv_id, 2, 0, '{OUTLINE_TAIL}' from conversations where trim(text) <> ''""",
    "j9_snap_to_sentences": w(CUES, WORDS, REQS) + r""", f as (
        select *, case when lag(text) over o is null or regexp_matches(lag(text) over o, '[.!?]+["''”’)\]]*$') or lag(speaker) over o <> speaker or start - lag("end") over o > 1.5 then 1 else 0 end b
        from words window o as (partition by recording_id order by word_ix)),
      r as (select recording_id, word_ix, start s, "end" e, cut_start cs, cut_end ce, start span, 0::bigint n from f where word_ix = 0
        union all
        select f.recording_id, f.word_ix, f.start, f."end", f.cut_start, f.cut_end, case when f.b = 1 or f."end" - r.span > 20 then f.start else r.span end, case when f.b = 1 or f."end" - r.span > 20 then r.n + 1 else r.n end
        from r join f on f.recording_id = r.recording_id and f.word_ix = r.word_ix + 1),
      sp as (select recording_id, min(word_ix) ix, first(cs order by word_ix) s, last(ce order by word_ix) e, first(s order by word_ix) f, last(e order by word_ix) l from r group by recording_id, n),
      h as (
        select q.recording_id, req_ix, q.start t0, q."end" t1, coalesce(bool_or(abs(round(s, 3) - round(q.start, 3)) < 1e-6), false) on0, coalesce(bool_or(abs(round(e, 3) - round(q."end", 3)) < 1e-6), false) on1,
          min({'ix': ix, 's': s, 'f': f}) filter (f <= q.start and q.start < l) h0, min({'ix': ix, 'e': e, 'l': l}) filter (f < q."end" and q."end" <= l) h1
        from reqs q left join sp on sp.recording_id = q.recording_id and least(s, f) < q."end" + 0.001 and greatest(e, l) > q.start - 0.001 group by all)
      select recording_id, req_ix, round(case when on0 or h0 is null then t0 when t0 - h0.s <= 12 then h0.s when t0 - h0.f <= 12 then h0.f else t0 end, 6) snap_start,
        round(case when on1 or h1 is null then t1 when h1.e - t1 <= 12 then h1.e when h1.l - t1 <= 12 then h1.l else t1 end, 6) snap_end from h""",
}
ORACLE |= {
    "t2_candidate_windows": w(CUES) + f""", b as (
        select *, {score('text', DUR, None, 'that|with')} + 0.75 * {count('text', 'this|from')} + 0.6 * {teach('text')} + 0.5 base,
          lag(rtrim(text)) over o pt, lag(speaker) over o ps, lead(speaker) over o ns, lead(cue_ix) over o ni from cues window o as (partition by recording_id order by cue_ix)),
      c as (select *, pt is null or right(pt, 1) in ('.', '!', '?') or ps is distinct from speaker sc, ni is null or right(rtrim(text), 1) in ('.', '!', '?') or ns is distinct from speaker ec,
          sum(base) over (partition by recording_id order by cue_ix) u from b),
      p as (select i.recording_id, i.cue_ix i, j.cue_ix as last, i.start, j."end",
          round((j.u - i.u + i.base) / greatest(j."end" - i.start, 30) * case when i.sc then 1.15 else 1 end * case when j.ec then 1.15 else 1 end, 9) score
        from c i join c j on j.recording_id = i.recording_id and j.cue_ix >= i.cue_ix and j."end" - i.start between 15 and 60),
      r as (select *, row_number() over (partition by recording_id, i order by score desc, last) n, row_number() over (partition by recording_id, i order by last) f from p)
      select recording_id, i, case when n = 1 then 0 else 1 end::bigint kind, last, {SE}, round(score, 5) score from r where n = 1 or f = 1""",
    "w20_card_runs": w(CUES, PK + TAKE + TIMELINE) + """, f as (select *, greatest(1, round_even(seconds * 24, 0))::bigint fr, role <> 'clip' card from line),
      g as (select *, coalesce(sum(fr) over (o rows between unbounded preceding and 1 preceding), 0) as first_frame, sum(case when card then 0 else 1 end) over o as grp, max(item_ix) over (partition by recording_id) as top from f window o as (partition by recording_id order by item_ix)),
      r as (select recording_id, grp, min(first_frame)::bigint start_frame, sum(fr)::bigint frames, min(item_ix) a, max(item_ix) b, max(top) top from g where card group by 1, 2)
      select recording_id, row_number() over (partition by recording_id order by a) - 1 run_ix, start_frame, frames, case when a = 0 then 'first' when b = top then 'last' else 'middle' end as position from r""",
    "a15_chunk_blocks": ORACLE["a2_format_blocks"].replace(
        "select recording_id, block, string_agg(", "select * from (with recursive fb as (select recording_id, block, string_agg(", 1
    ) + """), n as (select recording_id, block, length(text) + 2 len, row_number() over (partition by recording_id order by block) k from fb),
      z as (select recording_id, block, k, len size, 0::bigint as chunk from n where k = 1
        union all
        select n.recording_id, n.block, n.k, case when z.size + n.len > 2000 then n.len else z.size + n.len end, case when z.size + n.len > 2000 then z.chunk + 1 else z.chunk end
        from z join n on n.recording_id = z.recording_id and n.k = z.k + 1)
      select recording_id, block, chunk from z)""",
    "w15_resolve_overlaps": w(CUES, REQS) + """, d as (select recording_id, max("end") dur from cues group by 1),
      o as (select r.recording_id, req_ix, start, least("end", dur) e, row_number() over (partition by r.recording_id order by start, req_ix) k from reqs r join d using (recording_id) where start < dur - 1),
      z as (select recording_id, req_ix, k, start s, e, true keep, e prev from o where k = 1
        union all
        select o.recording_id, o.req_ix, o.k, greatest(o.start, z.prev), o.e, o.start >= z.prev or o.e - z.prev >= 1, case when o.start >= z.prev or o.e - z.prev >= 1 then o.e else z.prev end
        from z join o on o.recording_id = z.recording_id and o.k = z.k + 1)
      select recording_id, req_ix moment_ix, round(s, 6) as start, round(e, 6) as "end" from z where keep""",
}
ORACLE["j10_snap_to_words"] = w(CUES, WORDS, TIMED, REQS) + r""", n as (
    select *, lag(text) over o pt, lag(speaker) over o ps, lag("end") over o pe, lead(start) over o ns, lead(speaker) over o nsp, lead(word_ix) over o nx,
      regexp_matches(text, '[.!?]+["''”’)\]]*$') stop from timed window o as (partition by recording_id order by word_ix)),
  f as (
    select recording_id, word_ix k, start s, "end" e, ns, ns - "end" after_gap, start - pe before_gap,
      nx is null or stop or ns - "end" >= 0.45 - 1e-6 or coalesce(nsp <> speaker, false) closes,
      pt is null or regexp_matches(pt, '[.!?]+["''”’)\]]*$') or start - pe >= 0.45 - 1e-6 or coalesce(ps <> speaker, false) opens from n),
  a as (
    select *, max(case when opens then k end) over (partition by recording_id order by k rows between unbounded preceding and current row) first_k,
      min(case when closes then k end) over (partition by recording_id order by k rows between current row and unbounded following) last_k from f),
  i as (
    select r.recording_id, req_ix, r.start t0, r."end" t1, max(k) filter (s <= r.start) k0, max(k) filter (s < r."end" - 1e-6) k1
    from reqs r join a on a.recording_id = r.recording_id group by all),
  b as (  -- the word from which on an end is looked for, none if the span ends with its sentence
    select i.*, x.e e1, case when k1 is null then 0 when x.e > t1 + 1e-6 then k1 when x.closes then null else k1 + 1 end kb,
      case when y.e > t0 + 1e-6 or not y.closes then k0 end back, y.s s0, y.ns ns0, y.first_k fk
    from i left join a x on x.recording_id = i.recording_id and x.k = k1 left join a y on y.recording_id = i.recording_id and y.k = k0),
  c as (
    select b.*, z.s bs, z.e be, l.e se, h.s ss, o.s s_first from b left join a z on z.recording_id = b.recording_id and z.k = kb
    left join a l on l.recording_id = b.recording_id and l.k = z.last_k left join a h on h.recording_id = b.recording_id and h.k = fk
    left join a o on o.recording_id = b.recording_id and o.k = 0),
  g as (
    select c.recording_id, c.req_ix, arg_max(a.e, a.k) filter (a.k >= kb and a.e <= t1 + 8 + 1e-6 and coalesce(after_gap, 9) >= 0.25 - 1e-6) breath,
      arg_max(a.e, a.k) filter (a.k >= kb and a.e <= t1 + 8 + 1e-6) furthest,
      min(a.s) filter (a.k <= back and a.k > fk and a.s >= t0 - 6 - 1e-6 and before_gap >= 0.25 - 1e-6) pause
    from c join a on a.recording_id = c.recording_id group by all)
  select recording_id, req_ix,
    round(case when back is null then coalesce(case when k0 is null then s_first else ns0 end, t0) when ss >= t0 - 6 - 1e-6 then ss else coalesce(pause, s0) end, 6) snap_start,
    round(case when kb is null then e1 when bs > t1 + 8 then t1 when se <= t1 + 8 + 1e-6 then se else coalesce(breath, furthest, be) end, 6) snap_end
  from c join g using (recording_id, req_ix)"""
ORACLE["p11_dangling"] = f"""with b as (select conv_id, turn, text, (conv_id + turn) % 5 n, regexp_replace(text, '[.!?]+\\s*$', '') bare from conversations),
  t as (select conv_id, turn, trim(regexp_replace(case n when 0 then bare || ':' when 1 then bare || '?"' when 2 then bare || ' and.' else text end, '\\s+', ' ', 'g')) t from b),
  l as (select conv_id, turn, regexp_replace(list_extract({SPLIT.format(c='t')}, -1), '[\\s"''“”‘’)\\]]+$', '') s from t),
  x as (select *, replace(lower(trim(regexp_replace(s, '[.!?]+$', ''))), '’', '''') bare, rtrim(s, ':.…—–-, ') tail from l),
  m as (select *, regexp_extract(bare, '(?:^| )(?:is|the|in|le|de|der|die|to)(?: [^ ]+){{1,3}}$') found, string_split(bare, ' ') w, string_split(trim(tail), ' ') v from x)
  select conv_id, turn, coalesce(case when s = '' then null
    when regexp_matches(s, '(?:[:…—–,-]|\\.\\.\\.)$') then array_to_string(v[-4:], ' ') || trim(substring(s, length(tail) + 1))
    when ends_with(s, '?') then nullif(regexp_extract(bare, '(?:^| )(?:is|the|le|der|that)(?: .*)?$'), '')
    when found <> '' and not regexp_matches(found, ' (?:of|a|la|und)(?: |$)') then found
    when list_contains({_list(OPEN_WORDS)}, w[-1]) then array_to_string(w[-3:], ' ') end, '-') setup from m"""
EDGE = "[^\\p{L}\\p{M}\\p{N}_]"
ORACLE["w4_finish_thought"] = w(CUES, WORDS) + f""", f as (
    select *, case when lag(text) over o is null or regexp_matches(lag(text) over o, '[.!?]+["''”’)\\]]*$') or lag(speaker) over o <> speaker or start - lag("end") over o > 1.5 then 1 else 0 end b
    from words window o as (partition by recording_id order by word_ix)),
  r as (select recording_id, word_ix, text, speaker, start s, "end" e, cut_end ce, start span, 0::bigint n from f where word_ix = 0
    union all
    select f.recording_id, f.word_ix, f.text, f.speaker, f.start, f."end", f.cut_end, case when f.b = 1 or f."end" - r.span > 20 then f.start else r.span end, case when f.b = 1 or f."end" - r.span > 20 then r.n + 1 else r.n end
    from r join f on f.recording_id = r.recording_id and f.word_ix = r.word_ix + 1),
  sp as (
    select recording_id, min(word_ix) ix, last(ce order by word_ix) e, first(s order by word_ix) f, last(e order by word_ix) l, last(speaker order by word_ix) who, string_agg(text, ' ' order by word_ix) t
    from r group by recording_id, n),
  u as (select * exclude t, regexp_replace(list_extract({SPLIT.format(c='t')}, -1), '[\\s"''“”‘’)\\]]+$', '') t from sp),
  v as (select *, lower(trim(regexp_replace(t, '[.!?]+$', ''))) bare from u),
  d as (
    select recording_id, ix, e, f, l, who, case when t = '' then false when regexp_matches(t, '(?:[:…—–,-]|\\.\\.\\.)$') then true when ends_with(t, '?') then false
      else regexp_matches(bare, '(?:^|{EDGE})(?:is|the|le|der)(?:{EDGE}|$)') or list_contains({_list(OPEN_WORDS)}, string_split(bare, ' ')[-1]) end unsaid from v),
  m as (
    select q.recording_id, q.ix req_ix, q.e t, s.ix, s.e, s.f, s.l, s.who, s.unsaid from d q join d s
    on s.recording_id = q.recording_id and least(s.f, s.e) <= q.e + 31 and greatest(s.l, s.e) >= q.e - 1),
  h as (select recording_id, req_ix, min(ix) filter (f < t and t <= l) i, min(ix) filter (abs(e - t) <= 1e-3) a, max(ix) filter (abs(e - t) <= 1e-3) z from m group by 1, 2),
  o as (select m.* from m join h using (recording_id, req_ix) where unsaid and ix = case when i is not null and (a is null or i < a) then i else z end),
  y as (
    select m.* replace (min(m.f) over (partition by m.recording_id, m.req_ix, m.e) as f), lead(m.e) over (partition by m.recording_id, m.req_ix order by m.ix) following
    from m join o using (recording_id, req_ix) where m.ix > o.ix),
  c as (select *, true head from o union all select * exclude following, false from y where following is distinct from e),
  k as (
    select *, not head and not (lag(who) over w = who and f - lag(l) over w <= 1.5 and e - t <= 30 and e > lag(e) over w) broken from c window w as (partition by recording_id, req_ix order by ix)),
  g as (select *, sum(broken::int) over (partition by recording_id, req_ix order by ix) breaks from k),
  x as (select recording_id, req_ix, arg_min(e, ix) filter (not head and breaks = 0 and not unsaid) found from g group by 1, 2)
  select d.recording_id, d.ix req_ix, round(d.e, 6) as "end", round(coalesce(found, d.e), 6) finished from d left join x on x.recording_id = d.recording_id and x.req_ix = d.ix"""


def clip80(c: str) -> str:
    return (
        f"case when length({c}) <= 80 then {c} else rtrim(case when contains(substring(left({c}, 79), 41), ' ') "
        f"then regexp_replace(left({c}, 79), ' [^ ]*$', '') else left({c}, 79) end, ' ,;:.') || '…' end"
    )


ORACLE["q6_storyboard"] = w(CUES, WORDS, PK + TAKE + TIMELINE) + f""", t0 as (select *, {clean('takeaway', FILL)} t from segs),
  t1 as (select *, {clip80('t')} u from t0), t2 as (select *, {clean('u', FILL)} short from t1),
  met as (
    select s.recording_id, n, c.speaker, sum(least(c."end", b) - greatest(c.start, a)) talk, min(cue_ix) since
    from segs s join cues c on c.recording_id = s.recording_id and c.start < b and c."end" > a group by 1, 2, 3),
  who as (select recording_id, n, string_agg(speaker, '|' order by round(talk, 9) desc, since) speakers from met group by 1, 2),
  said as (
    select s.recording_id, n, list(x.text order by word_ix) l from segs s join words x on x.recording_id = s.recording_id and x.start < b and x."end" > a group by 1, 2)
  select line.recording_id, item_ix, role, case role when 'intro' then 'Session' when 'opening' then 'What you''ll learn' when 'chapter' then short when 'clip' then takeaway
      else 'That''s the session' end title, round(line.start, 3) as start, case when role = 'clip' then speakers end speakers,
    case when role = 'clip' then array_to_string(case when len(l) > 88 then l[1:70] || ['…'] || l[-18:] else l end, ' ') end quote
  from line left join t2 on t2.recording_id = line.recording_id and role in ('chapter', 'clip') and n = item_ix // 2
  left join who on who.recording_id = t2.recording_id and who.n = t2.n left join said on said.recording_id = t2.recording_id and said.n = t2.n"""
ORACLE["q1_plan"] = w(CUES, (PK + TAKE).replace("<= 60", f"<= {PRESET_BOUNDS['internal'][1]}").replace(">= 15", f">= {PRESET_BOUNDS['internal'][0]}")) + f""", two as (
    select recording_id, i from picks3 qualify row_number() over (partition by recording_id order by rk) <= 2),
  z as (select c.recording_id, takeaway, start, "end", dur, row_number() over (partition by c.recording_id order by start) n from clips c join two using (recording_id, i))
  select recording_id, '{{"version":"1","source":{{"path":"talk-' || recording_id || '.mp4","duration_seconds":' || round(first(dur), 3) || ',"captions":{{"kind":"embedded"}}}},'
    || '"output":{{"dir":"out","preset":"internal","aspect":"{PRESET_ASPECT['internal']}","captions":"burn_in"}},"clips":['
    || string_agg('{{"id":"' || {CLIP_ID} || '","takeaway":' || to_json(takeaway) || ',"segments":[{{"start":' || round(start, 3) || ',"end":' || round("end", 3) || '}}],"trim_silence":true}}', ',' order by n)
    || ']}}' plan_json from z group by recording_id"""
ORACLE["w22_effective_transition"] = w(CUES, PK) + """, t as (
    select recording_id, "end" - start d, row_number() over (partition by recording_id order by start) k, count(*) over (partition by recording_id) n from picks3)
  select recording_id, round(case when recording_id % 3 = 0 or n < 2 then 0.0 else least(20.0, min(case when recording_id % 3 = 1 and k > 1 and k < n then d / 2 else d end)) end, 5)::double as seconds
  from t group by recording_id, n"""
