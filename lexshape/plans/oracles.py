"""Reference SQL for the registered queries (DuckDB dialect).

Written apart from the Spark code: lists and lambdas instead of regular
expressions over one segment string, ordered windows instead of closed forms."""

from __future__ import annotations

import unicodedata

from lexshape import constants as K
from lexshape.functions import hints, phones, syllable as SY


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cls(text: str) -> str:
    """Characters inside an RE2 class."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def nfd(x: str) -> str:
    """Decomposition of the lower-case Latin letters that the texts can hold."""
    for cp in list(range(0xE0, 0x100)) + [0x113]:
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if d != c:
            x = f"replace({x}, {q(c)}, {q(d)})"
    return x


def chain(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)


def case_in(x: str, groups: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({q(v)}, {x}) THEN {q(k)}" for k, v in groups.items()) + f" ELSE {q(default)} END"


TIE = cls(K.TIE_BARS)
GRAPHEME = f"(?s).(?:[{TIE}]+[^{TIE}]?|[\\p{{M}}{cls(K.ATTACHED)}])*"
V, GL = cls(K.VOWELS), cls(K.GLIDES)

TOK = r"""
tok AS (SELECT doc_id, lang, source, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
        FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents)),
voc AS (SELECT DISTINCT w FROM tok)"""

CANON = TOK + f""",
gr AS (SELECT w, n, regexp_extract_all(n, {q(GRAPHEME)}) AS g, regexp_replace(n, {q('[^' + cls(K.TONES) + ']')}, '', 'g') AS tone
       FROM (SELECT w, {nfd('w')} AS n FROM voc)),
sg AS (SELECT w, n, g, tone, list_filter(list_transform(g, lambda x: {chain(
    "translate(regexp_replace(x, " + q('[' + cls(K.TONES + K.DROPPED) + ']') + ", '', 'g'), "
    + q(''.join(K.FOLD_LETTERS)) + ", " + q(''.join(K.FOLD_LETTERS.values())) + ")", K.FOLD_DIGRAPHS.items())}), lambda x: x <> '') AS s FROM gr),
cn AS (SELECT w, g, tone, s, array_to_string(s, ' ') AS sn,
         array_to_string(list_transform(s, lambda x: nfc_normalize(x)), '') AS segmental,
         array_to_string(list_transform(s, lambda x: nfc_normalize(x)), ' ') AS segments,
         array_to_string(list_transform(s, lambda x: CASE
            WHEN contains({q(K.VOWELS)}, left(x, 1)) THEN CASE WHEN regexp_matches(x, {q('[' + cls(K.NON_SYLLABIC_MARKS) + ']')}) THEN 'G' ELSE 'V' END
            WHEN contains({q(K.GLIDES)}, left(x, 1)) THEN 'G' ELSE 'C' END), '') AS types FROM sg)"""

JUDGE = CANON + f""",
wy AS (SELECT *, CASE
    WHEN len(list_filter(s, lambda x: regexp_matches(x, {q('[' + cls(K.SYLLABIC_MARKS) + ']')}) AND NOT contains({q(K.VOWELS)}, left(x, 1)))) > 0 THEN {q(SY.SYLLABIC)}
    WHEN NOT contains(types, 'V') THEN {q(SY.NO_VOWEL)}
    WHEN length(types) - length(replace(types, 'V', '')) > 1 THEN {q(SY.SEVERAL)}
    WHEN regexp_matches(types, 'V.*C') THEN {q(SY.CODA)}
    WHEN contains(types, 'VG') THEN {q(SY.FINAL_GLIDE)}
    WHEN length(regexp_replace(s[strpos(types, 'V')], '[^{V}]', '', 'g')) = 2 THEN {q(SY.DIPHTHONG)}
    WHEN length(regexp_replace(s[strpos(types, 'V')], '[^{V}]', '', 'g')) > 2 THEN {q(SY.TRIPHTHONG)}
    ELSE {q(SY.MONOPHTHONG)} END AS why FROM cn),
nz AS (SELECT *, why IN ({', '.join(q(r) for r in SY.OPEN_REASONS)}) AS is_open,
    why IN ({', '.join(q(r) for r in SY.OPEN_REASONS)}) AND
    regexp_matches(sn, '(^| )[{cls(K.NASALS)}][^ \\p{{Ll}}\\p{{Lo}}\\p{{Lu}}]* [^ {V}{GL}]') AS nasal,
    regexp_extract(sn, '[^\\p{{Lm}} ]') AS letter, regexp_extract(sn, '(?s)^.*([{V}])', 1) AS vowel FROM wy),
jud AS (SELECT *, CASE WHEN nasal OR why IN ({q(SY.FINAL_GLIDE)}, {q(SY.DIPHTHONG)}, {q(SY.TRIPHTHONG)}) THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN why = {q(SY.FINAL_GLIDE)} THEN 'diphthong(V+glide)' WHEN why IN ({q(SY.DIPHTHONG)}, {q(SY.TRIPHTHONG)}) THEN 'diphthong'
         WHEN why IN ({q(SY.MONOPHTHONG)}, {q(SY.CODA)}) THEN 'monophthong' ELSE 'none' END AS nucleus_type,
    nasal OR why IN ({q(SY.FINAL_GLIDE)}, {q(SY.TRIPHTHONG)}) AS contested,
    CASE WHEN nasal THEN why || {q(SY.NASAL_FIRST)} ELSE why END AS reason,
    CASE WHEN letter = '' THEN 'none' WHEN contains({q(K.ONSET_STOP)}, letter) AND regexp_matches(sn,
           '^[\\p{{Lm}} ]*[{cls(K.ONSET_STOP)}][\\p{{Lm}}\\p{{M}}]*[{cls(K.ONSET_FRICATIVE)}]') THEN 'affricate'
         ELSE {case_in('letter', {
             'none': K.VOWELS, 'glide': K.GLIDES + K.ONSET_APPROXIMANT, 'nasal': K.ONSET_NASAL, 'implosive': K.ONSET_IMPLOSIVE,
             'click': K.ONSET_CLICK, 'stop': K.ONSET_STOP, 'affricate': K.ONSET_AFFRICATE, 'fricative': K.ONSET_FRICATIVE,
             'liquid': K.ONSET_LIQUID}, 'other')} END AS onset_class,
    regexp_matches(segmental, '^[^{cls(K.NOT_IPA_SIGNS + K.NOT_IPA_LETTERS)}\\p{{Lu}}\\p{{Co}}]+$') AS clean FROM nz),
jd AS (SELECT *, CASE WHEN nucleus_type LIKE 'diphthong%' THEN 'diphthong' WHEN vowel = '' THEN 'other'
         ELSE {case_in('vowel', K.VOWEL_BUCKETS, 'other')} END AS nucleus_bucket FROM jud)"""

SOURCES = """
src AS (SELECT DISTINCT source || '/' || (doc_id % 6) AS id, ((doc_id % 6) + n) % 3 AS tier_rank,
          ['curated', 'mined', 'generated'][((doc_id % 6) + n) % 3 + 1] AS tier,
          CASE WHEN CASE WHEN n % 4 = 3 THEN (doc_id % 6) % 2 = 1 ELSE n % 2 = 1 END THEN 'dictionary' ELSE 'word list' END AS kind,
          ['CC-BY-4.0', 'CC-BY-NC-4.0', 'CC-BY-SA-4.0', 'CC-BY-ND-4.0'][n % 4 + 1] AS license
        FROM (SELECT doc_id, source, regexp_extract(source, '(\\d+)$', 1)::int AS n FROM documents))""".replace("\\\\", "\\")

LANGS = r"""
langs AS (SELECT DISTINCT lang || '-' || source AS glottocode, 'Variety ' || source AS name, 'alias ' || lang AS alias, lang AS macroarea,
    CASE WHEN n % 20 <> 19 THEN source ELSE '' END AS family,
    CASE WHEN n % 20 <> 19 THEN source ELSE 'lang:' || lang || '-' || source END AS fam,
    CASE WHEN n % 20 <> 19 THEN n * 7 % 120 - 60 END AS latitude, CASE WHEN n % 20 <> 19 THEN n * 13 % 360 - 180 END AS longitude
  FROM (SELECT lang, source, regexp_extract(source, '(\d+)$', 1)::int AS n FROM documents))"""

ENTRIES = JUDGE + "," + SOURCES + """,
ent AS (SELECT lang || '-' || source AS variety, doc_id, w, source || '/' || (doc_id % 6) AS src, doc_id * 16777216 + pos AS seq,
    CASE WHEN doc_id % 7 <> 0 THEN (CASE WHEN doc_id % 3 = 0 THEN 'Sense ' ELSE 'sense ' END) || ((doc_id % 40) // 4) END AS gloss,
    CASE WHEN doc_id % 2 = 0 THEN doc_id % 40 + 1 END AS cid,
    CASE WHEN doc_id % 2 = 0 THEN 'SENSE ' || ((doc_id % 40) // 4) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' (OTHER)' END END AS cgloss
  FROM tok),
je AS (SELECT e.*, j.segmental AS shape, j.* EXCLUDE (w), s.tier_rank, s.kind,
    CASE WHEN NOT j.clean THEN 'unclean' WHEN j.is_open THEN 'open' ELSE 'closed' END AS status,
    CASE j.confidence WHEN 'high' THEN 0 ELSE 1 END AS cc_rank
  FROM ent e JOIN jd j ON e.w = j.w JOIN src s ON e.src = s.id),
jv AS (SELECT *, variety AS glottocode FROM je),
jt AS (SELECT *, doc_id::varchar AS glottocode FROM je)"""


def forms_of(judged: str = "jv", name: str = "forms") -> str:
    return f"""
{name}_s AS (SELECT glottocode, shape, string_agg(src, '|' ORDER BY ms) AS sources FROM
   (SELECT glottocode, shape, src, min(seq) AS ms FROM {judged} WHERE status = 'open' GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT glottocode, shape, min(tier_rank) AS tier_rank,
    CASE WHEN arg_min(tier_rank, seq) = 2 THEN 2 ELSE max(cc_rank) END AS cc_rank,
    arg_min(tier_rank, seq) = 2 OR bool_or(contested) AS under_review,
    arg_min(onset_class, seq) AS onset_class, arg_min(nucleus_type, seq) AS nucleus_type, arg_min(nucleus_bucket, seq) AS nucleus_bucket,
    coalesce(array_to_string(list_sort(list(DISTINCT tone) FILTER (tone <> '')), '|'), '') AS tones,
    count(DISTINCT tone) FILTER (tone <> '') AS n_tones,
    substr(min(tier_rank::varchar || src), 2) AS preferred_source
  FROM {judged} WHERE status = 'open' GROUP BY glottocode, shape) JOIN {name}_s USING (glottocode, shape))"""


FORMS = ENTRIES + "," + forms_of()
POSTS = FORMS + "," + LANGS + """,
posts AS (SELECT shape, glottocode, tier_rank, cc_rank, under_review, n_tones::int AS tones FROM forms),
feats AS (SELECT shape, arg_min(onset_class, glottocode) AS onset_class, arg_min(nucleus_bucket, glottocode) AS nucleus_bucket,
    arg_min(nucleus_type, glottocode) AS nucleus_type, count(*) AS languages FROM forms GROUP BY shape)"""
DISPUTED = FORMS + ", " + r"""v AS (SELECT glottocode, shape, src, is_open, coalesce('c' || cid, 'g' || lower(trim(gloss))) AS concept, string_split(replace(shape, 'ː', ''), '') AS c FROM jv WHERE status IN ('open', 'closed')),
        u AS (SELECT DISTINCT glottocode, shape, src, is_open, concept, array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), '') AS loose FROM v WHERE concept IS NOT NULL),
        g AS (SELECT glottocode, concept, loose FROM u GROUP BY ALL HAVING count(DISTINCT src) > 1 AND bool_or(is_open) AND NOT bool_and(is_open)),
        d AS (SELECT DISTINCT u.glottocode, u.shape, true AS flag FROM u JOIN g USING (glottocode, concept, loose) WHERE is_open)"""
TIER_COUNTS = ", ".join(f"count(*) FILTER (tier_rank = {i}) AS {t}" for i, t in enumerate(K.TIERS))

CONCEPTS = POSTS + """,
wg AS (SELECT glottocode, shape, tone, gloss, cid, cgloss, src, min(seq) AS seq FROM jv WHERE status = 'open' AND gloss IS NOT NULL GROUP BY ALL),
ce AS (SELECT wg.*, f.tier_rank, coalesce(cid::varchar, 'g-' || left(sha1(lower(trim(gloss))), 16)) AS ckey
       FROM wg JOIN forms f USING (glottocode, shape))"""

LABELS = CONCEPTS + """,
vt AS (SELECT ckey, trim(gloss) AS t, count(*) AS n FROM ce GROUP BY ALL),
vf AS (SELECT ckey, t, n, lower(t) AS f, sum(n) OVER (PARTITION BY ckey, lower(t)) AS total FROM vt),
vb AS (SELECT ckey, t AS gloss FROM vf QUALIFY row_number() OVER (PARTITION BY ckey ORDER BY total DESC, f DESC, n DESC, t DESC) = 1),
nm AS (SELECT ckey, any_value(cid) AS cid, any_value(cgloss) AS cg FROM ce GROUP BY ckey),
bs AS (SELECT ckey, cid, cg, CASE WHEN lower(cg) = lower(gloss) THEN lower(cg) ELSE gloss END AS base FROM vb JOIN nm USING (ckey)),
l0 AS (SELECT *, lower(base) AS f, count(*) OVER (PARTITION BY lower(base)) AS crowd, count(cid) OVER (PARTITION BY lower(base)) AS linked FROM bs),
l1 AS (SELECT ckey, cid, cg, CASE WHEN cid IS NULL THEN CASE WHEN crowd > 1 THEN base || ' (unlinked)' ELSE base END
     WHEN linked = 1 OR lower(cg) = f THEN base WHEN cg <> '' THEN lower(cg) ELSE base || ' (' || cid || ')' END AS label FROM l0)""" + "".join(f""",
l{i} AS (SELECT ckey, cid, cg, CASE WHEN crowd > 1 AND cid IS NULL AND label NOT LIKE '%(unlinked)' THEN label || ' (unlinked)'
     WHEN crowd > 1 AND cid IS NOT NULL AND unlinked = 0 THEN label || ' (' || cid || ')' ELSE label END AS label
   FROM (SELECT *, count(*) OVER (PARTITION BY lower(label)) AS crowd,
                count(*) FILTER (cid IS NULL) OVER (PARTITION BY lower(label)) AS unlinked FROM l{i - 1}))""" for i in (2, 3))

YIELD = """
yl AS (SELECT s_suppkey AS glottocode, s_name AS name, n_name AS family, r_name AS macroarea,
    CASE WHEN s_suppkey % 2 = 0 THEN 'word list' ELSE 'dictionary' END AS sample,
    CASE WHEN s_acctbal < 2500 THEN 'simple' WHEN s_acctbal < 5500 THEN 'moderate' WHEN s_acctbal < 8500 THEN 'complex' ELSE '' END AS syllable_structure,
    s_suppkey % 3 = 0 AS tone_marked, k AS form_count, n AS examined, (s_suppkey % 181 - 90)::double AS latitude,
    CASE WHEN s_suppkey % 10 <> 9 THEN (s_suppkey * 7 % 361 - 180)::double END AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS k, count(DISTINCT l_partkey) AS n
        FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey),
yr AS (SELECT *, form_count / examined AS rate,
    greatest(0, ((form_count / examined + 1.96 * 1.96 / (2 * examined)) - 1.96 * sqrt(form_count / examined * (1 - form_count / examined) / examined + 1.96 * 1.96 / (4 * examined * examined))) / (1 + 1.96 * 1.96 / examined)) AS rate_lo,
    least(1, ((form_count / examined + 1.96 * 1.96 / (2 * examined)) + 1.96 * sqrt(form_count / examined * (1 - form_count / examined) / examined + 1.96 * 1.96 / (4 * examined * examined))) / (1 + 1.96 * 1.96 / examined)) AS rate_hi
  FROM yl),
fn AS (SELECT *, greatest(0, p0 - 1.96 * sqrt(p0 * (1 - p0) / examined)) AS limit_lo, least(1, p0 + 1.96 * sqrt(p0 * (1 - p0) / examined)) AS limit_hi
   FROM (SELECT *, sum(form_count) OVER () / sum(examined) OVER () AS p0, count(*) OVER () AS points FROM yr WHERE sample = 'word list') WHERE points >= 10),
fp AS (SELECT *, CASE WHEN rate > limit_hi THEN 'above' WHEN rate < limit_lo THEN 'below' ELSE 'inside' END AS position FROM fn),
tq AS (SELECT syllable_structure, len(r)::bigint AS languages, r[least(len(r) - 1, floor(0.25 * len(r)))::int + 1] AS q1,
    r[least(len(r) - 1, floor(0.5 * len(r)))::int + 1] AS median, r[least(len(r) - 1, floor(0.75 * len(r)))::int + 1] AS q3, len(r) >= 5 AS readable
  FROM (SELECT syllable_structure, list_sort(list(rate)) AS r FROM yr WHERE sample = 'word list' AND examined >= 20 GROUP BY ALL))"""

PAIRS = """
pw AS (SELECT l_suppkey AS language, n_name AS family, p_name AS ckey, p_brand || '/' || p_type AS shape
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def bands(words: str) -> str:
    """Chance-baseline CTEs over a word table (language, family, ckey, shape)."""
    return f"""
cnt AS (SELECT language, family, ckey, shape, count(*) AS n FROM {words} GROUP BY ALL),
bn AS (SELECT language, sum(n) AS words FROM cnt GROUP BY ALL),
bk AS (SELECT language, family, ckey, sum(n) AS k FROM cnt GROUP BY ALL),
bsh AS (SELECT language, family, shape, sum(n) AS s FROM cnt GROUP BY ALL),
ob AS (SELECT ckey, shape, count(DISTINCT family) AS obs FROM cnt GROUP BY ALL HAVING count(DISTINCT family) >= 2),
hp AS (SELECT count(*) AS h FROM (SELECT ckey, shape FROM bk JOIN bsh USING (language, family) GROUP BY ALL HAVING count(DISTINCT family) >= 5)),
fcn AS (SELECT ckey, shape, family, 1 - product(miss) AS p FROM (
   SELECT ob.ckey, ob.shape, bk.family, coalesce(list_product(list_transform(range(k::bigint),
       lambda i: greatest(0.0, (words - s - i)::double) / greatest(1.0, (words - i)::double))), 1.0) AS miss
   FROM ob JOIN bk ON ob.ckey = bk.ckey JOIN bsh ON bsh.shape = ob.shape AND bsh.language = bk.language JOIN bn ON bn.language = bk.language)
   GROUP BY ALL),
ps AS (SELECT ckey, shape, count(*)::int AS could, list_reduce(list_prepend([1.0::double], list_transform(list_sort(list(p)), lambda x: [x])),
    lambda acc, x: list_transform(range(len(acc) + 1), lambda j:
       coalesce(acc[j + 1], 0.0) * (1 - x[1]) + CASE WHEN j > 0 THEN acc[j] ELSE 0.0 END * x[1])) AS dist
   FROM fcn GROUP BY ckey, shape HAVING count(*) >= 5),
tp AS (SELECT ckey, shape, obs, could, least(1.0, coalesce(list_sum(dist[obs + 1:]), 0.0)) AS p,
    list_filter(range(len(dist)), lambda j: list_sum(dist[1:j + 1]) >= 0.05 - 1e-12)[1]::int AS lo,
    coalesce(list_filter(range(len(dist)), lambda j: list_sum(dist[1:j + 1]) >= 0.95 - 1e-12)[1], len(dist) - 1)::int AS hi
   FROM ps JOIN ob USING (ckey, shape)),
bh AS (SELECT *, round(least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM (
    SELECT *, row_number() OVER (ORDER BY p, ckey, shape) AS rk,
       greatest((SELECT h FROM hp), (SELECT count(*) FROM tp), 1) AS m FROM tp))"""


BANDS = PAIRS + "," + bands("pw")
SUMMARY = LABELS + """,
cw AS (SELECT c.glottocode AS language, l.fam AS family, ckey, shape FROM ce c JOIN langs l USING (glottocode)),""" + bands("cw") + """,
bc AS (SELECT ckey, count(*) AS beyond, max(obs - hi)::int AS gap FROM bh WHERE q <= 0.05 GROUP BY ckey),
cs AS (SELECT ckey, lang_count, fam_count, shape_count, label, coalesce(beyond, 0)::bigint AS beyond, coalesce(gap, 0)::int AS gap FROM
   (SELECT ckey, count(DISTINCT glottocode) AS lang_count, count(DISTINCT fam) AS fam_count, count(DISTINCT shape) AS shape_count
    FROM ce JOIN langs USING (glottocode) GROUP BY ckey) JOIN (SELECT ckey, label FROM l3) USING (ckey) LEFT JOIN bc USING (ckey))"""

PARTS = r"""
pt AS (SELECT p_partkey, p_brand, p_type, p_name, p_size, replace(p_name, ' ', '') AS nm,
    trim(regexp_replace(replace(p_name, ' ', ''), '(.)', '\1 ', 'g')) AS sp, p_size % 12 AS n FROM part),
pf AS (SELECT *, CASE n WHEN 0 THEN '*' || nm WHEN 1 THEN nm || '-' WHEN 2 THEN p_name ELSE nm END AS form,
    CASE WHEN n IN (0, 1, 2, 7, 8) THEN sp WHEN n = 3 THEN sp || ' + a' WHEN n = 4 THEN sp || ' y' WHEN n = 5 THEN sp || ' x/' WHEN n = 6 THEN sp || ' b~p' ELSE '' END AS seg FROM pt),
pi AS (SELECT *, CASE WHEN n <= 1 OR n IN (3, 5, 6) THEN NULL WHEN seg <> '' THEN seg WHEN form NOT LIKE '% %' THEN form END AS ipa FROM pf)"""

LINES = """
le AS (SELECT ['to ', 'the ', '', 'A '][l_orderkey % 4 + 1] || lower(s_name) AS gloss, lower(s_name) AS word,
     ['Action/Process', 'Person/Thing', NULL, 'Person/Thing'][l_orderkey % 4 + 1] AS wants,
     CASE WHEN l_suppkey % 3 = 0 AND l_linenumber = 1 THEN l_suppkey + 1 END AS cid, CASE WHEN l_suppkey % 3 = 0 AND l_linenumber = 1 THEN upper(s_name) END AS cg
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
ct AS (SELECT s_suppkey + 1 AS id, upper(s_name) AS gl, lower(s_name) AS word, CASE WHEN s_suppkey % 2 = 0 THEN 'Person/Thing' ELSE 'Action/Process' END AS cat
   FROM supplier WHERE s_suppkey % 11 <> 10 AND s_suppkey % 7 <> 5 AND s_suppkey + 1 IN (SELECT cid FROM le)),
lk AS (SELECT le.gloss, coalesce(cid, id) AS concepticon_id, coalesce(cg, gl) AS concepticon_gloss, CASE WHEN cid IS NULL AND id IS NOT NULL THEN 'gloss' END AS linked_by
   FROM le LEFT JOIN ct ON le.word = ct.word AND le.cid IS NULL AND (wants IS NULL OR wants = cat))"""

GLOTTOLOG = """
gl AS (SELECT 's' || s_suppkey AS id, 'Supplier ' || lpad(s_suppkey::varchar, 9, '0') AS name, CASE WHEN s_suppkey % 6 <> 0 THEN n_name ELSE 'Supplier ' || lpad(s_suppkey::varchar, 9, '0') END AS family
   FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""

INVENTORY = CANON + f""",
gv AS (SELECT DISTINCT glottocode, value, CASE WHEN regexp_matches(value, '^[{V}]') THEN 'vowel' ELSE 'consonant' END AS segment_class FROM (
   SELECT DISTINCT lang || '-' || source AS glottocode, unnest(g) AS value FROM (SELECT DISTINCT lang, source, w FROM tok) JOIN gr USING (w))),
gc AS (SELECT value, segment_class, translate(regexp_replace(value, {q('[' + cls(K.TONES + K.DROPPED) + ']')}, '', 'g'), {q(''.join(K.FOLD_LETTERS))}, {q(''.join(K.FOLD_LETTERS.values()))}) AS s
   FROM (SELECT DISTINCT value, segment_class FROM gv)),
gs AS (SELECT value, segment_class,
   CASE WHEN segment_class = 'consonant' AND s <> '' THEN nullif({case_in('left(s, 1)', {
       'glide': K.GLIDES + K.ONSET_APPROXIMANT, 'nasal': K.ONSET_NASAL, 'implosive': K.ONSET_IMPLOSIVE, 'click': K.ONSET_CLICK,
       'stop': K.ONSET_STOP, 'affricate': K.ONSET_AFFRICATE, 'fricative': K.ONSET_FRICATIVE, 'liquid': K.ONSET_LIQUID}, 'other')}, 'other') END AS onset,
   CASE WHEN segment_class = 'vowel' AND s <> '' THEN nullif({case_in('left(s, 1)', K.VOWEL_BUCKETS, 'other')}, 'other') END AS nucleus FROM gc)"""

ORDERS = """
os AS (SELECT o_custkey AS glottocode, ['stop', 'nasal', 'fricative', 'liquid', 'none'][left(o_orderpriority, 1)::int] AS onset_class,
     ['i', 'e', 'ə', 'a', 'o', 'u'][month(o_orderdate) % 6 + 1] AS nucleus_bucket, o_orderstatus AS status FROM orders),
oi AS (SELECT glottocode, list_sort(list(DISTINCT onset_class) FILTER (onset_class <> 'none')) AS onsets, list_sort(list(DISTINCT nucleus_bucket)) AS nuclei
   FROM os GROUP BY glottocode HAVING count(*) FILTER (onset_class <> 'none') > 0)"""

RESPELL = r"""
sp AS (SELECT translate(w, 'è', 'ē') AS form FROM voc),
rs AS (SELECT form, """ + chain("replace(form, 'ē', 'eː')", K.RESPELLINGS["abvd"]) + """ AS respelled FROM sp)"""

ORACLES: dict[str, str] = {
    "normalize_unicode": f"WITH {CANON} SELECT w, n AS nfd, w AS nfc, length(n)::int AS n_nfd FROM gr",
    "split_graphemes": f"WITH {CANON} SELECT w, array_to_string(g, '|') AS graphemes, len(g)::int AS n FROM gr",
    "canonicalize": f"WITH {CANON} SELECT w, segmental, tone, segments FROM cn",
    "clean_keys": f"WITH {JUDGE} SELECT w, segmental FROM jd WHERE clean",
    "classify_openness": f"WITH {JUDGE} SELECT w, is_open, confidence, nucleus_type, contested, reason FROM jd",
    "bare_nasal_segments": f"WITH {CANON}, x AS (SELECT DISTINCT unnest(g) AS segment FROM gr) SELECT segment, regexp_matches(segment, '^[{cls(K.NASALS)}][^ \\p{{Ll}}\\p{{Lo}}\\p{{Lu}}]*$') AS bare_nasal FROM x",
    "onset_and_nucleus": f"WITH {JUDGE} SELECT w, onset_class, nucleus_bucket FROM jd",
    "ipa_conformance": f"""WITH {CANON}, x AS (SELECT w, regexp_extract_all(sn, '[^ \\p{{M}}]') AS b FROM cn)
        SELECT w, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_filter(b, lambda c: contains({q(K.VOWELS + K.GLIDES + K.ONSET_NASAL + K.ONSET_STOP + K.ONSET_FRICATIVE + K.ONSET_LIQUID + K.ONSET_IMPLOSIVE)}, c))) / len(b) END, 6) AS conformance FROM x""",
    "loose_key": f"""WITH {CANON}, x AS (SELECT w, string_split(replace(segmental, 'ː', ''), '') AS c FROM cn)
        SELECT w, coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), ''), '') AS loose FROM x""",
    "shape_slugs": f"WITH {FORMS} SELECT DISTINCT shape, 'u' || array_to_string(list_transform(string_split(shape, ''), lambda c: lpad(lower(to_hex(ord(c))), 4, '0')), '-') AS slug FROM forms",
    "attested_forms": f"WITH {PARTS} SELECT p_partkey::varchar AS ID, ipa FROM pi WHERE ipa IS NOT NULL",
    "proto_languages": "SELECT ['Proto-', 'proto ', 'Proto', '', ' PROTO-'][s_suppkey % 5 + 1] || s_name AS name, s_suppkey % 5 IN (0, 1, 4) AS proto FROM supplier",
    "respell": f"WITH {TOK}, {RESPELL} SELECT form, respelled, form AS untouched FROM rs",
    "spelling_exclusions": f"""WITH {TOK}, {RESPELL} SELECT form, CASE WHEN regexp_matches(form, '[êâîôûăǎ]') THEN 'vowel-quality mark in a spelling'
        WHEN regexp_matches(form, '[áéíóúàìòù]') AND length(regexp_replace({nfd('respelled')}, '[^{cls(K.SPELLING_VOWELS)}]', '', 'g')) = 1 THEN 'accent on a one-vowel spelling' END AS reason FROM rs""",
    "noise_words": r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS word FROM documents)
        SELECT word, NOT regexp_matches(word, '\p{L}') OR regexp_full_match(word, '[A-Z]{1,4}') AS noise FROM t""",
    "concise_glosses": r"""WITH t AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS g FROM documents)
        SELECT md5(g) AS id, nullif(trim(split_part(split_part(g, ',', 1), ';', 1), ' ' || chr(9) || chr(13)), '') AS concise,
          regexp_matches(g, '(?i)^\s*(the )?(name of the )?(letter|character|diacritic|syllable)\b') AS letter_sense FROM t""",
    "cleared_sources": f"WITH {SOURCES} SELECT id, license, license <> 'CC-BY-ND-4.0' AS cleared FROM src",
    "cleared_entries": f"""WITH {TOK} SELECT lang || '-' || source AS glottocode, count(*) AS entries FROM tok WHERE regexp_extract(source, '(\\d+)$', 1)::int % 4 <> 3 GROUP BY ALL""",
    "gloss_keys": f"""WITH {TOK}, x AS (SELECT ['to ', 'A ', 'an ', 'The ', ''][length(w) % 5 + 1] AS lead, w FROM voc)
        SELECT lead || w AS gloss, replace(w, 'ß', 'ss') AS word, CASE trim(lead) WHEN 'to' THEN 'Action/Process' WHEN '' THEN NULL ELSE 'Person/Thing' END AS category FROM x""",
    "segment_classes": f"WITH {INVENTORY} SELECT value, segment_class, onset, nucleus FROM gs",
    "equal_earth": f"""WITH {YIELD}, t AS (SELECT glottocode, longitude, asin(sqrt(3) / 2 * sin(radians(latitude))) AS t FROM yl)
        SELECT glottocode, round(2 * sqrt(3) * radians(longitude) * cos(t) / (3 * (9 * 0.003796 * t ** 8 + 7 * 0.000893 * t ** 6 + 3 * -0.081106 * t ** 2 + 1.340264)), 6) AS x,
          CASE WHEN longitude IS NOT NULL THEN round(0.003796 * t ** 9 + 0.000893 * t ** 7 + -0.081106 * t ** 3 + 1.340264 * t, 6) END AS y, longitude IS NOT NULL AS mapped FROM t""",
    "renderability": f"""WITH {FORMS}, ph(letter, phone, approx) AS (VALUES {values(phones.phone_table())}),
        ch AS (SELECT shape, unnest(c) AS letter, generate_subscripts(c, 1) AS pos FROM (SELECT shape, string_split({nfd('shape')}, '') AS c FROM (SELECT DISTINCT shape FROM forms))),
        x AS (SELECT shape, pos, phone, approx, regexp_matches(ch.letter, '\\p{{M}}') AS mark FROM ch LEFT JOIN ph USING (letter)),
        y AS (SELECT shape, min(pos) FILTER (phone IS NULL AND NOT mark) AS bad, min(pos) FILTER (mark OR approx) AS lossy, string_agg(phone, ' ' ORDER BY pos) FILTER (phone IS NOT NULL) AS phones FROM x GROUP BY shape)
        SELECT shape, CASE WHEN bad IS NULL THEN phones END AS phones, coalesce(lossy < coalesce(bad, 1000000), false) AS lossy, bad IS NULL AND phones IS NOT NULL AS renderable FROM y""",
    "describe_shapes": f"""WITH {FORMS}, hs(letter, role, hint) AS (VALUES {values(hints.hint_table())}),
        ch AS (SELECT shape, unnest(c) AS seg, generate_subscripts(c, 1) AS pos FROM (SELECT shape, regexp_extract_all({nfd('shape')}, '(?s).\\p{{M}}*') AS c FROM (SELECT DISTINCT shape FROM forms))),
        x AS (SELECT shape, pos, coalesce(s.hint, {q(hints.NO_MATCH)}) || coalesce(', ' || m.hint, '') AS say FROM ch
              LEFT JOIN hs s ON s.role = 'sound' AND s.letter = left(seg, 1) LEFT JOIN hs m ON m.role = 'mark' AND m.letter = substr(seg, 2, 1))
        SELECT shape, string_agg(say, ', then ' ORDER BY pos) AS reading FROM x GROUP BY shape""",
    "filter_onsets_tiers": f"WITH {POSTS} SELECT onset_class, count(*) AS postings FROM posts JOIN (SELECT shape, onset_class FROM feats) USING (shape) WHERE onset_class IN ('nasal', 'stop', 'none') AND tier_rank <= 1 GROUP BY ALL",
    "search_languages": f"WITH {LANGS} SELECT glottocode, name FROM langs WHERE contains(lower(name), 'src1') OR contains(lower(alias), 'src1')",
    "search_meanings": f"WITH {LABELS} SELECT ckey, label FROM l3 WHERE contains(lower(label), 'sense 1')",
    "filter_languages": f"WITH {YIELD} SELECT glottocode, family, form_count, examined FROM yl WHERE macroarea = 'ASIA' AND sample = 'word list' AND syllable_structure = '' AND NOT tone_marked",
    "disambiguate_names": f"WITH {LANGS} SELECT glottocode, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || glottocode || ')' ELSE name END AS name FROM langs",
    "commercial_safe": f"WITH {FORMS} SELECT glottocode, shape FROM jv JOIN src ON jv.src = src.id WHERE status = 'open' GROUP BY ALL HAVING bool_and(license IN ('CC-BY-4.0', 'CC-BY-SA-4.0'))",
    "build_forms": f"WITH {FORMS} SELECT glottocode, shape, tier_rank, cc_rank, under_review, onset_class, nucleus_type, nucleus_bucket, tones, sources, preferred_source FROM forms",
    "forms_under_review": f"""WITH {DISPUTED}
        SELECT glottocode, shape, coalesce(flag, false) AND NOT under_review AS disputed FROM forms LEFT JOIN d USING (glottocode, shape) WHERE under_review OR flag""",
    "build_words": f"""WITH {CONCEPTS}, s AS (SELECT glottocode, shape, tone, src, min(seq) AS seq, count(*) AS n FROM wg GROUP BY ALL)
        SELECT glottocode, shape, tone, min(tier_rank)::int AS tier_rank, sum(n)::bigint AS glosses, string_agg(src, '|' ORDER BY seq) AS sources FROM s JOIN src ON s.src = src.id GROUP BY ALL""",
    "language_counts": f"""WITH {ENTRIES} SELECT glottocode, count(DISTINCT segments) AS examined, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS sample,
        count(*) FILTER (tone <> '') * 2 >= count(*) AS tone_marked FROM jv WHERE status <> 'unclean' GROUP BY ALL""",
    "document_counts": f"""WITH {ENTRIES} SELECT glottocode, count(DISTINCT segments) AS examined, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS sample,
        count(*) FILTER (tone <> '') * 2 >= count(*) AS tone_marked FROM jt WHERE status <> 'unclean' GROUP BY ALL""",
    "examined": f"WITH {ENTRIES} SELECT glottocode, count(DISTINCT segments) AS examined FROM jv WHERE status <> 'unclean' GROUP BY ALL",
    "sample_kind": f"WITH {ENTRIES} SELECT glottocode, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS sample FROM jv WHERE status <> 'unclean' GROUP BY ALL",
    "tone_marked": f"WITH {ENTRIES} SELECT glottocode, count(*) FILTER (tone <> '') * 2 >= count(*) AS tone_marked FROM jt WHERE status <> 'unclean' GROUP BY ALL",
    "excluded_counts": f"WITH {ENTRIES} SELECT CASE WHEN status = 'unclean' THEN 'not clean notation' ELSE reason END AS reason, count(*) AS rows FROM jv WHERE status <> 'open' GROUP BY 1",
    "merge_sources": "SELECT source AS id, ['curated', 'mined', 'generated'][arg_max(n_chars, doc_id) % 3 + 1] AS tier, arg_max(lang, doc_id) AS license, 'word list' AS kind FROM documents GROUP BY source",
    "merge_languages": """WITH d AS (SELECT *, doc_id % 5 AS o, CASE WHEN doc_id % 3 = 0 THEN 'fam' || (doc_id % 7) END AS fam, lang || '-' || source AS glottocode FROM documents)
        SELECT glottocode, 'doc ' || first(doc_id ORDER BY o, doc_id) AS name, first(n_chars ORDER BY o, doc_id) AS size, coalesce(first(fam ORDER BY o, doc_id) FILTER (fam IS NOT NULL), '') AS family FROM d GROUP BY glottocode""",
    "union_datasets": "SELECT s_name AS name, s_acctbal AS balance, NULL::varchar AS segment, 0 AS dataset_ord FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment, 1 FROM customer",
    "judged_languages": f"WITH {ENTRIES} SELECT doc_id::varchar AS glottocode, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM je WHERE status <> 'unclean')",
    "zero_form_languages": f"WITH {ENTRIES} SELECT doc_id::varchar AS glottocode, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM je WHERE status = 'open')",
    "missing_sources": f"WITH {TOK} SELECT DISTINCT source || '/' || (doc_id % 6) AS source FROM tok WHERE regexp_extract(source, '(\\d+)$', 1)::int % 4 IN (1, 3)",
    "link_concepts": f"WITH {LINES} SELECT gloss, concepticon_id, concepticon_gloss, linked_by, count(*) AS entries FROM lk GROUP BY ALL",
    "families_from_parents": f"WITH {GLOTTOLOG} SELECT id AS glottocode, family FROM gl",
    "name_languages": f"""WITH {GLOTTOLOG} SELECT 's' || (s_suppkey * 2) AS glottocode, coalesce(gl.name, s_name) AS name,
        CASE WHEN s_suppkey % 3 = 0 THEN 'old name' WHEN gl.name IS NOT NULL THEN s_name ELSE '' END AS alias, coalesce(nullif(gl.family, ''), 'given') AS family
        FROM supplier LEFT JOIN gl ON gl.id = 's' || (s_suppkey * 2)""",
    "syllable_structure": "SELECT 'g' || (c_custkey // 2) AS glottocode, min(['simple', 'moderate', 'complex'][c_nationkey % 4 + 1]) AS syllable_structure FROM customer WHERE c_nationkey % 4 < 3 GROUP BY 1 HAVING count(DISTINCT c_nationkey % 4) = 1",
    "sound_inventories": f"""WITH {INVENTORY} SELECT glottocode, array_to_string(list_sort(list(DISTINCT onset) FILTER (onset IS NOT NULL)), '|') AS onsets, array_to_string(list_sort(list(DISTINCT nucleus) FILTER (nucleus IS NOT NULL)), '|') AS nuclei
        FROM gv JOIN gs USING (value, segment_class) GROUP BY glottocode HAVING count(onset) > 0 AND count(nucleus) > 0""",
    "attach_typology": f"""WITH {ORDERS} SELECT c_custkey AS glottocode, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'simple' ELSE '' END AS syllable_structure, array_to_string(onsets, '|') AS onsets, array_to_string(nuclei, '|') AS nuclei
        FROM customer LEFT JOIN oi ON c_custkey = glottocode""",
    "shape_features": f"WITH {POSTS} SELECT * FROM feats",
    "postings": f"WITH {POSTS} SELECT * FROM posts",
    "form_counts": f"WITH {POSTS} SELECT l.glottocode, count(f.shape) AS form_count FROM langs l LEFT JOIN forms f USING (glottocode) GROUP BY ALL",
    "build_concepts": f"WITH {CONCEPTS} SELECT ckey, count(*) AS votes, count(DISTINCT glottocode) AS lang_count, count(DISTINCT shape) AS shape_count FROM ce GROUP BY ckey",
    "concept_labels": f"WITH {LABELS} SELECT ckey, label FROM l3",
    "concept_summary": f"WITH {SUMMARY} SELECT * FROM cs",
    "language_glosses": f"WITH {CONCEPTS} SELECT DISTINCT glottocode, shape, gloss FROM wg",
    "gloss_preview": f"""WITH {CONCEPTS}, g AS (SELECT glottocode, shape, gloss, min(seq) AS seq FROM wg GROUP BY ALL)
        SELECT glottocode, shape, array_to_string(list(gloss ORDER BY seq, gloss)[1:3], ', ') AS preview, greatest(0, count(*) - 3) AS more FROM g GROUP BY ALL""",
    "language_index": f"WITH {POSTS} SELECT glottocode, count(*) AS shapes, {TIER_COUNTS} FROM posts GROUP BY ALL",
    "tier_composition": f"WITH {POSTS} SELECT shape, count(*) AS languages, {TIER_COUNTS} FROM posts GROUP BY ALL",
    "family_spread": f"WITH {POSTS} SELECT shape, count(*) AS languages, count(DISTINCT family) FILTER (family <> '') AS families, count(DISTINCT fam) AS families_or_self FROM posts JOIN langs USING (glottocode) GROUP BY ALL",
    "top_open_shapes": f"""WITH {POSTS} SELECT shape, count(*) AS languages, count(DISTINCT family) FILTER (family <> '') AS families, count(DISTINCT fam) AS families_or_self
        FROM posts JOIN langs USING (glottocode) GROUP BY ALL ORDER BY families DESC, languages DESC, shape LIMIT 50""",
    "heatmap": f"""WITH {POSTS}, b AS (SELECT onset_class, nucleus_bucket, glottocode, min(tier_rank) AS tier_rank FROM posts JOIN feats USING (shape) GROUP BY ALL),
        c AS (SELECT onset_class, nucleus_bucket, count(*) AS languages, count(DISTINCT family) FILTER (family <> '') AS families, {TIER_COUNTS} FROM b JOIN langs USING (glottocode) GROUP BY ALL)
        SELECT *, CASE WHEN families >= 40 THEN 4 WHEN families >= 30 THEN 3 WHEN families >= 20 THEN 2 WHEN families >= 10 THEN 1 WHEN families >= 5 THEN 0 ELSE -1 END AS step FROM c""",
    "heatmap_grid": f"""WITH {POSTS}, b AS (SELECT onset_class, nucleus_bucket, glottocode, min(tier_rank) AS tier_rank FROM posts JOIN feats USING (shape) GROUP BY ALL),
        a AS (SELECT o AS onset_class, n AS nucleus_bucket FROM (SELECT unnest([{', '.join(q(o) for o in K.ONSET_ORDER)}]) AS o), (SELECT unnest([{', '.join(q(n) for n in K.NUCLEUS_ORDER)}]) AS n)
              UNION SELECT onset_class, nucleus_bucket FROM b),
        c AS (SELECT onset_class, nucleus_bucket, count(glottocode) AS languages, count(DISTINCT family) FILTER (family <> '') AS families, {TIER_COUNTS}
              FROM a LEFT JOIN (SELECT * FROM b JOIN langs USING (glottocode)) USING (onset_class, nucleus_bucket) GROUP BY ALL)
        SELECT *, CASE WHEN families >= 40 THEN 4 WHEN families >= 30 THEN 3 WHEN families >= 20 THEN 2 WHEN families >= 10 THEN 1 WHEN families >= 5 THEN 0 ELSE -1 END AS step FROM c""",
    "heatmap_pivot": f"""WITH {POSTS} SELECT onset_class, {', '.join(f"count(DISTINCT family) FILTER (nucleus_bucket = {q(n)} AND family <> '') AS " + chr(34) + f"n_{n}" + chr(34) for n in K.NUCLEUS_ORDER)}
        FROM posts JOIN feats USING (shape) JOIN langs USING (glottocode) GROUP BY ALL""",
    "observed_share": f"""WITH {ORDERS}, u AS (SELECT DISTINCT glottocode, onset_class, nucleus_bucket FROM os),
        c AS (SELECT a.onset_class, b.nucleus_bucket, oi.glottocode FROM (SELECT DISTINCT onset_class FROM u) a, (SELECT DISTINCT nucleus_bucket FROM u) b, oi
              WHERE (a.onset_class = 'none' OR list_contains(onsets, a.onset_class)) AND list_contains(nuclei, b.nucleus_bucket)
                AND oi.glottocode IN (SELECT glottocode FROM os WHERE status = 'F')),
        g AS (SELECT c.onset_class, c.nucleus_bucket, count(DISTINCT n_name) FILTER (u.glottocode IS NOT NULL) AS use, count(DISTINCT n_name) AS could
              FROM c JOIN customer ON c.glottocode = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN u USING (glottocode, onset_class, nucleus_bucket) GROUP BY ALL),
        r AS (SELECT *, use / could / (sum(use) OVER () / sum(could) OVER ()) AS ratio FROM g)
        SELECT onset_class, nucleus_bucket, use, could, round(ratio, 6) AS ratio, CASE WHEN could >= 5 THEN CASE WHEN ratio > 1.25 THEN 'above the usual share' WHEN ratio < 0.8 THEN 'below the usual share' ELSE 'about the usual share' END END AS verdict FROM r""",
    **{f"region_share_{u}": f"""WITH {POSTS}, a AS (SELECT * FROM langs WHERE glottocode IN (SELECT glottocode FROM posts)),
        t AS (SELECT macroarea AS region, count(*) AS n, count(DISTINCT {c}) AS total FROM a GROUP BY ALL HAVING count(*) >= 5 AND ({q(u)} = 'languages' OR count(DISTINCT fam) >= 3)),
        h AS (SELECT shape, macroarea AS region, count(DISTINCT {c}) AS hits FROM posts JOIN a USING (glottocode) GROUP BY ALL)
        SELECT region, shape, coalesce(hits, 0) AS hits, total, round(coalesce(hits, 0) / total, 6) AS share
        FROM t CROSS JOIN (SELECT DISTINCT shape FROM posts) LEFT JOIN h USING (region, shape)""" for u, c in (("families", "fam"), ("languages", "glottocode"))},
    "tone_words": f"WITH {POSTS} SELECT glottocode, sum(greatest(1, tones))::bigint AS words, count(*) FILTER (tones > 1) AS multi_tone_shapes FROM posts GROUP BY ALL",
    "tone_splits": f"WITH {POSTS} SELECT shape, count(*) AS languages, sum(tones)::bigint AS words FROM posts WHERE tones > 1 GROUP BY ALL",
    "language_grid": f"""WITH {POSTS}, g AS (SELECT glottocode, onset_class, nucleus_bucket, count(*) AS shapes FROM posts JOIN (SELECT shape, onset_class, nucleus_bucket FROM feats) USING (shape) GROUP BY ALL)
        SELECT *, least(4, floor(4 * shapes / max(shapes) OVER (PARTITION BY glottocode)))::int AS step FROM g""",
    "spread_elsewhere": f"""WITH {POSTS}, x AS (SELECT shape, glottocode, fam FROM posts JOIN langs USING (glottocode))
        SELECT a.glottocode, a.shape, count(b.glottocode) AS other_languages, count(DISTINCT b.fam) FILTER (b.fam <> a.fam) AS other_families
        FROM x a LEFT JOIN x b ON a.shape = b.shape AND a.glottocode <> b.glottocode GROUP BY ALL""",
    "hidden_by_filter": f"WITH {POSTS} SELECT count(DISTINCT glottocode) AS languages FROM posts WHERE tier_rank = 2",
    "catalog_summary": f"""WITH {POSTS}, b AS (SELECT l.*, best, n FROM langs l LEFT JOIN (SELECT glottocode, min(tier_rank) AS best, count(*) AS n FROM forms GROUP BY ALL) USING (glottocode))
        SELECT count(*) AS languages, count(DISTINCT nullif(family, '')) AS families, sum(n)::bigint AS postings, count(*) FILTER (best = 0) AS curated, count(*) FILTER (best = 1) AS mined, count(*) FILTER (best = 2) AS generated,
          count(*) FILTER (best IS NULL) AS zero_form, count(*) FILTER (latitude IS NULL) AS unmapped, (SELECT count(DISTINCT shape) FROM forms) AS shapes, (SELECT count(DISTINCT id) FROM src) AS sources FROM b""",
    "cross_language_shapes": f"WITH {POSTS} SELECT shape, count(*) AS languages FROM posts GROUP BY ALL HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "rank_shapes": f"""WITH {POSTS}, s AS (SELECT shape, count(*) AS languages, count(DISTINCT family) FILTER (family <> '') AS families FROM posts JOIN langs USING (glottocode) GROUP BY ALL)
        SELECT s.shape, s.languages, families, onset_class, nucleus_bucket, row_number() OVER (PARTITION BY onset_class, nucleus_bucket ORDER BY families DESC, s.languages DESC, s.shape)::int AS rank, s.languages = 1 AS rare
        FROM s JOIN (SELECT shape, onset_class, nucleus_bucket FROM feats) USING (shape)""",
    "top_meanings": f"WITH {SUMMARY} SELECT ckey, label, fam_count, shape_count FROM cs",
    "top_shape": f"WITH {POSTS} SELECT shape, count(*) AS languages FROM posts GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 1",
    "language_shapes": f"""WITH {POSTS}, x AS (SELECT shape, glottocode, fam, tier_rank, tones FROM posts JOIN langs USING (glottocode)),
        m AS (SELECT a.shape, a.tier_rank, a.tones, count(b.glottocode) AS other_languages, count(DISTINCT b.fam) FILTER (b.fam <> a.fam) AS other_families
              FROM x a LEFT JOIN x b ON a.shape = b.shape AND a.glottocode <> b.glottocode WHERE a.glottocode = 'fr-src0' GROUP BY ALL)
        SELECT m.shape, onset_class, m.tier_rank, m.tones, other_languages, other_families FROM m JOIN (SELECT shape, onset_class FROM feats) USING (shape)
        ORDER BY list_position([{', '.join(q(o) for o in K.ONSET_ORDER)}], onset_class), m.shape""",
    "compare_forms": f"""WITH {POSTS}, f AS (SELECT * FROM forms JOIN (SELECT glottocode, name FROM langs) USING (glottocode)
            WHERE (glottocode, shape) IN (('fr-src0', 'la'), ('es-src1', 'la'), ('en-src2', 'the'), ('de-src3', 'de'))),
        x AS (SELECT glottocode, shape, unnest(['tones', 'language', 'tier', 'openness', 'review', 'sources']) AS attribute,
          unnest([replace(tones, '|', ' '), name, ['curated', 'mined', 'generated'][tier_rank + 1], ['high', 'medium', 'low'][cc_rank + 1],
                  CASE WHEN under_review THEN 'under review' ELSE '' END, replace(sources, '|', ', ')]) AS value FROM f) SELECT * FROM x""",
    "sources_listing": f"WITH {SOURCES} SELECT id, tier, license, kind FROM src ORDER BY license, id",
    "convergence": f"""WITH {CONCEPTS}, b AS (SELECT ckey, shape, glottocode, min(tier_rank) AS tier_rank FROM ce GROUP BY ALL),
        c AS (SELECT ckey, shape, count(*) AS languages, count(DISTINCT family) FILTER (family <> '') AS families, {TIER_COUNTS} FROM b JOIN langs USING (glottocode) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY ckey ORDER BY families DESC, languages DESC, shape)::int AS rank FROM c""",
    "convergence_pairs": f"""WITH {BANDS}, c AS (SELECT ckey, shape, count(DISTINCT language) AS languages, count(DISTINCT family) AS families FROM pw GROUP BY ALL)
        SELECT ckey, shape, languages, families, row_number() OVER (PARTITION BY ckey ORDER BY families DESC, languages DESC, shape)::int AS rank, lo, hi, q <= 0.05 AS beyond
        FROM c LEFT JOIN bh USING (ckey, shape)""",
    "wilson_rates": f"WITH {YIELD} SELECT glottocode, form_count, examined, round(rate, 9) AS rate, round(rate_lo, 9) AS rate_lo, round(rate_hi, 9) AS rate_hi FROM yr",
    "rank_languages": f"""WITH {YIELD} SELECT glottocode, sample, examined, round(rate_lo, 9) AS rate_lo FROM (
        SELECT * FROM yr)""",
    "funnel": f"WITH {YIELD} SELECT glottocode, round(rate, 9) AS rate, round(limit_lo, 9) AS limit_lo, round(limit_hi, 9) AS limit_hi, position FROM fp",
    "funnel_summary": f"WITH {YIELD} SELECT count(*) AS points, round(max(p0), 9) AS p0, count(*) FILTER (position = 'above') AS above, count(*) FILTER (position = 'below') AS below, round(count(*) FILTER (position <> 'inside') / count(*), 9) AS outside FROM fp HAVING count(*) > 0",
    "typology_quartiles": f"WITH {YIELD} SELECT syllable_structure, languages, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, readable FROM tq",
    "typology_order": f"""WITH {YIELD}, k AS (SELECT * FROM tq WHERE readable AND syllable_structure <> '')
        SELECT coalesce(o, '') AS ordering, n AS classes, coalesce(o, '') = 'simple > moderate > complex' AS agrees FROM (
          SELECT string_agg(syllable_structure, ' > ' ORDER BY median DESC, list_position(['simple', 'moderate', 'complex'], syllable_structure)) AS o, count(*) AS n FROM k)""",
    "facet_counts": f"""WITH {YIELD} SELECT 'region' AS facet, macroarea AS value, count(*) AS languages FROM yl GROUP BY ALL UNION ALL SELECT 'family', family, count(*) FROM yl GROUP BY ALL
        UNION ALL SELECT 'sample', sample, count(*) FROM yl GROUP BY ALL UNION ALL SELECT 'syllable', syllable_structure, count(*) FROM yl GROUP BY ALL
        UNION ALL SELECT 'tone', CASE WHEN tone_marked THEN 'yes' ELSE 'no' END, count(*) FROM yl GROUP BY ALL""",
    "hit_probability": f"""WITH {BANDS}, x AS (SELECT DISTINCT words::bigint AS words, k::bigint AS k, s::bigint AS s FROM cnt JOIN bk USING (language, ckey) JOIN bsh USING (language, shape) JOIN bn USING (language))
        SELECT words, k, s, round(1 - list_product(list_transform(range(k), lambda i: greatest(0.0, (words - s - i)::double) / (words - i))), 9) AS p FROM x""",
    "observed_pairs": f"WITH {BANDS} SELECT * FROM ob",
    "family_chances": f"WITH {BANDS} SELECT ckey, shape, family, round(p, 9) AS p FROM fcn",
    "count_hypotheses": f"WITH {BANDS} SELECT h AS hypotheses FROM hp",
    "tested_pairs": f"WITH {BANDS} SELECT ckey, shape, obs, could, lo, hi, round(p, 9) AS p FROM tp",
    "benjamini_hochberg": f"""WITH {YIELD}, x AS (SELECT glottocode, rate_lo AS p, row_number() OVER (ORDER BY rate_lo) AS rk, 2 * count(*) OVER () AS m FROM yr)
        SELECT glottocode, round(least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM x""",
    "chance_bands": f"WITH {BANDS} SELECT ckey, shape, obs, lo, hi, q FROM bh",
    "baseline_summary": f"WITH {BANDS} SELECT (SELECT h FROM hp) AS hypotheses, count(*) AS tested, count(*) FILTER (q <= 0.05) AS beyond, 0.05::double AS fdr FROM bh",
    "beyond_chance": f"WITH {BANDS} SELECT ckey, count(*) AS beyond, max(obs - hi)::int AS gap FROM bh WHERE q <= 0.5 GROUP BY ckey",
    "audit_catalog": f"""WITH {POSTS} SELECT unnest(['form counts add up', 'one form per language and shape', 'examined covers forms', 'canonical keys stay', 'keys are clean', 'shapes are open', 'no blocked licence']) AS "check",
        unnest([(SELECT abs(sum(n) - count(*)) FROM (SELECT *, count(*) OVER (PARTITION BY glottocode, shape) AS n FROM forms)), (SELECT count(*) - count(DISTINCT (glottocode, shape)) FROM forms),
          (SELECT count(*) FROM (SELECT glottocode, count(DISTINCT shape) AS f FROM jv WHERE status = 'open' GROUP BY ALL) JOIN
            (SELECT glottocode, count(DISTINCT segments) AS e FROM jv WHERE status <> 'unclean' GROUP BY ALL) USING (glottocode) WHERE e < f),
          (SELECT count(DISTINCT shape) FROM jv WHERE status = 'open' AND NOT clean), (SELECT count(DISTINCT shape) FROM jv WHERE status = 'open' AND NOT clean),
          (SELECT count(DISTINCT shape) FROM jv WHERE status = 'open' AND NOT is_open), (SELECT count(*) FROM src WHERE license = 'CC-BY-ND-4.0')])::bigint AS violations""",
    "build_tripwires": f"""WITH {POSTS}, x AS (SELECT sum(strlen('{{"shape":"' || shape || '","glottocode":"' || glottocode || '","tier_rank":' || tier_rank || '}}'))::bigint AS bytes, count(DISTINCT shape) AS chunks FROM posts)
        SELECT bytes, chunks, bytes > 5000000 AS too_large, chunks > 15000 AS too_many_chunks FROM x""",
    "read_wordlist": f"""WITH {PARTS} SELECT 'g-' || p_brand AS glottocode, ipa, CASE WHEN p_type <> 'SMALL' THEN upper(left(p_type, 1)) || lower(substr(p_type, 2)) ELSE p_type END AS gloss,
        CASE WHEN p_type <> 'PROMO' THEN length(p_type) END::bigint AS concepticon_id, 'parts' AS source, seg <> '' AS segmented, CASE WHEN seg = '' THEN 'spelling without rules' END AS exclude, count(*) AS entries
        FROM pi WHERE ipa IS NOT NULL AND p_brand NOT LIKE '%4' AND p_brand NOT LIKE '%9' GROUP BY ALL""",
    "build_catalog": f"""WITH {PARTS} SELECT 'parts' || k AS dataset, (SELECT count(*) FROM pi WHERE ipa IS NOT NULL AND p_partkey % 3 = k AND k < 2) AS entries, k = 2 AS skipped FROM (SELECT unnest([0, 1, 2]) AS k)""",
    "read_pronunciations": f"""WITH {PARTS} SELECT upper(replace(p_brand, '#', '')) AS glottocode, sp AS ipa, CASE WHEN p_type <> 'SMALL' AND p_brand NOT LIKE '%1' THEN p_type END AS gloss, count(*) AS entries
        FROM pt WHERE p_name NOT LIKE 'red%' AND p_brand <> 'Brand#7' GROUP BY ALL""",
    "read_glosses": """SELECT p_name || ' ' || p_partkey AS word, least(3, count(DISTINCT l_linenumber)) AS senses, max(length(p_type) + 2)::int AS longest
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 5 GROUP BY ALL""",
    "write_index": f"WITH {POSTS} SELECT * FROM posts",
    "write_index_tables": f"WITH {POSTS} SELECT shape, glottocode, tier_rank, onset_class FROM posts JOIN (SELECT shape, onset_class FROM feats) USING (shape)",
    "export_json": f"WITH {POSTS} SELECT *, 'u' || array_to_string(list_transform(string_split(shape, ''), lambda c: lpad(lower(to_hex(ord(c))), 4, '0')), '-') AS slug FROM feats",
    "release_forms": f"""WITH {DISPUTED} SELECT glottocode, shape, tier_rank, cc_rank, under_review OR coalesce(flag, false) AS under_review,
        coalesce(flag, false) AND NOT under_review AS disputed, onset_class, tones, sources, preferred_source FROM forms LEFT JOIN d USING (glottocode, shape)""",
    "merge_release": f"""WITH {FORMS} SELECT glottocode, shape, tier_rank, cc_rank, under_review, tones, array_to_string(list_sort(string_split(sources, '|')), '|') AS sources, preferred_source FROM forms""",
    "sweep_stale": "SELECT p_brand || '/' || p_type AS key, p_partkey FROM part WHERE right(p_brand, 1)::int % 2 = 0",
    "scheme_mapping": f"""WITH {CANON}, x AS (SELECT segmental, string_split(replace(segmental, 'ː', ''), '') AS c FROM cn)
        SELECT segmental AS old_key, coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), ''), '') AS new_key, count(*) AS words FROM x GROUP BY ALL""",
}
# the views over published tables give what the views over the texts give
ORACLES |= {f"published_{name}": ORACLES[name] for name in ("heatmap", "family_spread", "spread_elsewhere", "region_share_families", "region_share_languages", "concept_labels", "concept_summary")}
ORACLES["published_chance_bands"] = f"WITH {SUMMARY} SELECT ckey, shape, label, obs, lo, hi, q FROM bh JOIN l3 USING (ckey)"
# a catalog made by releases is the one made at once
ORACLES |= {f"release_{name.removeprefix('build_')}": ORACLES[name] for name in ("build_words", "language_counts", "excluded_counts")}
ORACLES["published_spread"] = ORACLES["family_spread"]
# reference tables written as files, searches through an index: what the operators give without them
ORACLES |= {"read_wals": ORACLES["syllable_structure"], "read_phoible": ORACLES["sound_inventories"], "indexed_search_languages": ORACLES["search_languages"]}
ORACLES |= {
    "read_glottolog": "SELECT 's' || s_suppkey AS ID, s_name AS Name, 'language' AS Level, 'n' || s_nationkey AS Family_ID FROM supplier",
    "read_concepticon": "SELECT p_partkey::varchar AS ID, upper(p_name) AS GLOSS, p_type AS ONTOLOGICAL_CATEGORY, NULL::varchar AS REPLACEMENT_ID FROM part",
    "read_seed_json": """SELECT 'g-' || p_brand AS name, 'seed' || (p_partkey // 5000) AS source, 'word list' AS kind, CASE WHEN p_type <> 'SMALL' THEN p_type END AS gloss,
        p_size > 25 AS segmented, count(*) AS entries, arg_min(p_name, p_partkey) AS first_ipa FROM part GROUP BY ALL""",
    "indexed_search_customers": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r_1')",
}
