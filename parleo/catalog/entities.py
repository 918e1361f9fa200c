"""Queries over entities, personal data and term correction."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parleo.catalog.base import *  # noqa: F403
from parleo.functions.columns import lookup, pick
from parleo.operators import entities as ent
from parleo.operators import obligations as obl
from parleo.sources import seeds, vocab
from parleo.plans.stage import settle
from parleo.sources.tables import load, raw_turns, segments, spread


def _num(raw: str, p: str, g: int = 1) -> str:
    return f"CAST(replace(regexp_extract({raw}, {q(p)}, {g}), ',', '') AS DOUBLE)"


def _mag(raw: str, p: str) -> str:
    return "CASE lower(regexp_extract({}, {}, 2)) {} ELSE 1e0 END".format(raw, q(p), " ".join(f"WHEN {q(k)} THEN {int(v)}e0" for k, v in ent.MAGNITUDE.items()))


def _money_parts(src: str, ids: str) -> list[str]:
    out = []
    for n, (p, cur) in enumerate(ent.SYMBOL_MONEY):
        sp = p.replace(r"(?<![A-Za-z0-9])", r"\b").replace(r"(?!\d|[-/])", "")
        out.append(f"SELECT {ids}, {n} AS pn, mi, 'payment_amount' AS entity_type, printf('%.2f {cur}', {_num('raw', sp)} * {_mag('raw', sp)}) AS value, trim(raw) AS raw_text, 0.95e0 AS confidence FROM (SELECT {ids}, unnest(regexp_extract_all(text, {q(sp)})) AS raw, generate_subscripts(regexp_extract_all(text, {q(sp)}), 1) AS mi FROM {src})")
    n = 3
    for code in ("hi", "ta", "en"):
        units = seeds.CURRENCY_WORDS[code]
        for scaled, frame in ((False, ent.PLAIN_MONEY), (True, ent.SCALED_MONEY)):
            ws = [(w, u) for u, listed in units.items() if (u in ent.UNITS) == scaled for w in listed]
            p = frame % "|".join(w for w, _ in ws)
            unit = f"regexp_extract(raw, {q(p)}, 2)"
            factor = "CASE " + " ".join(f"WHEN lower({unit}) = {q(w)} THEN {int(ent.UNITS[u][1]) if scaled else 1}e0" for w, u in ws) + " END"
            cur = "CASE " + " ".join(f"WHEN lower({unit}) = {q(w)} THEN {q(ent.UNITS[u][0] if scaled else u)}" for w, u in ws) + " END"
            cond = "" if code == "en" else f" WHERE lang = '{code}'"
            out.append(f"SELECT {ids}, {n} AS pn, mi, 'payment_amount', printf('%.2f ', {_num('raw', p)} * {factor}) || {cur}, trim(raw), 0.95e0 FROM (SELECT {ids}, unnest(regexp_extract_all(text, {q(p)})) AS raw, generate_subscripts(regexp_extract_all(text, {q(p)}), 1) AS mi FROM {src}{cond})")
            n += 1
    return out


def _date_parts(src: str, ids: str, lang: bool) -> list[str]:
    """RE2 has no look-around: every character beside words is doubled, so that neighbours can each use up one."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    twice = rf"regexp_replace(text, '({edge})', '\1\1', 'g')"
    out = _pat_parts(src, ids, [(ent.NUMERIC_DATE, "due_date")], 20, "0.9e0")
    n = 21
    for code in ("hi", "ta", "en") if lang else ("en",):
        for k, frame in ent.WORD_DATES.items():
            core = frame.replace(",?", ",{0,2}") % "|".join(w.replace(" ", r"\s+") for w in seeds.DATE_WORDS[code][ent.DATE_LISTS[k]])
            p = rf"(?i)(?:^|{edge})({core})(?:$|{edge})"
            cond = f" WHERE lang = '{code}'" if code != "en" else " WHERE lang NOT IN ('hi', 'ta')" if lang and k not in ("month", "next_day") else ""
            v = "replace(replace(replace(replace(raw, '  ', ' '), ',,', ','), chr(10) || chr(10), chr(10)), chr(9) || chr(9), chr(9))"
            out.append(f"SELECT {ids}, {n} AS pn, mi, 'due_date' AS entity_type, {v} AS value, trim({v}) AS raw_text, 0.9e0 AS confidence FROM (SELECT {ids}, unnest(regexp_extract_all({twice}, {q(p)}, 1)) AS raw, generate_subscripts(regexp_extract_all({twice}, {q(p)}, 1), 1) AS mi FROM {src}{cond})")
            n += 1
    return out


def _pat_parts(src: str, ids: str, pats, base: int, conf: str, strip: bool = False) -> list[str]:
    out = []
    for n, (p, t) in enumerate(pats):
        v = f"regexp_extract(raw, {q(p)}, 1)"
        v = f"replace({v}, ',', '')" if strip else v
        out.append(f"SELECT {ids}, {base + n} AS pn, mi, {q(t)} AS entity_type, {v} AS value, trim(raw) AS raw_text, {conf} AS confidence FROM (SELECT {ids}, unnest(regexp_extract_all(text, {q(p)})) AS raw, generate_subscripts(regexp_extract_all(text, {q(p)}), 1) AS mi FROM {src})")
    return out


def ent_cte(src: str, ids: str, kinds=("money", "date", "id", "term")) -> str:
    parts = []
    if "money" in kinds:
        parts += _money_parts(src, ids)
    if "date" in kinds:
        parts += _date_parts(src, ids, src.startswith("seg"))
    if "id" in kinds:
        parts += _pat_parts(src, ids, ent.ID_PATTERNS[:3], 40, "0.9e0")
    if "term" in kinds:
        parts += _pat_parts(src, ids, ent.TERM_PATTERNS, 50, "0.85e0", True)
    return f"""eraw AS ({' UNION ALL '.join(parts)}),
efst AS (SELECT *, row_number() OVER (PARTITION BY {ids}, entity_type, value ORDER BY pn, mi) AS k FROM eraw),
ents AS (SELECT {ids}, CAST(row_number() OVER (PARTITION BY {ids} ORDER BY pn, mi) - 1 AS BIGINT) AS item, entity_type, value, raw_text, confidence FROM efst WHERE k = 1)"""


SEGIDS = "call_id, segment_id"
ENTS = ent_cte("seg", SEGIDS)


def seg_entities(spark, sf, kinds=("money", "date", "id", "term")):
    return ent.entities(segments(spark, sf), ["call_id", "segment_id"], F.col("lang"), kinds)


def _shown(df, *ids):
    return df.select(*ids, F.col("item").cast("bigint").alias("item"), "entity_type", "value", "raw_text", "confidence")


@query("X3_money", f"WITH {SEG}, {ent_cte('seg', SEGIDS, ('money',))} SELECT * FROM ents")
def x3(spark, sf):
    return _shown(seg_entities(spark, sf, ("money",)), "call_id", "segment_id")


@query("X4_dates", f"WITH {ent_cte('documents', 'doc_id', ('date',))} SELECT * FROM ents")
def x4(spark, sf):
    return _shown(ent.entities(spread(load(spark, sf, "documents").select("doc_id", "text")), ["doc_id"], kinds=("date",)), "doc_id")


# Every third turn also names amounts and days in the language of its call.
LOCAL = {"en": "pay 4 lakh or 250 dollars by end of week or on May 5, 2026", "hi": "5 लाख और 250 रुपये कल या मार्च 12 या next friday", "ta": "3 லட்சம் அல்லது 700 ரூபாய் நாளை அல்லது ஜனவரி 9 or jan 4"}
SEGL = f"segl AS (SELECT * REPLACE (CASE WHEN turn % 3 = 0 THEN text || ' ' || {case('lang', LOCAL)} ELSE text END AS text) FROM seg)"


def local_entities(spark, sf, kinds):
    """Entities by a lexicon made of vocabulary files that are written and read back."""
    s = segments(spark, sf)
    s = s.withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" "), lookup(F.col("lang"), LOCAL))).otherwise(F.col("text")))
    files = {lang: {"currency_words": [{"words": ws, "currency": u} for u, ws in units.items()], "date_words": seeds.DATE_WORDS[lang]} for lang, units in seeds.CURRENCY_WORDS.items()}
    return ent.entities(s, SEGIDS.split(", "), F.col("lang"), kinds, ent.lexicon(vocab.round_trip(spark, files)))


@query("X3_vocabulary_money", f"WITH {SEG}, {SEGL}, {ent_cte('segl', SEGIDS, ('money',))} SELECT * FROM ents")
def x3b(spark, sf):
    return _shown(local_entities(spark, sf, ("money",)), "call_id", "segment_id")


@query("X4_vocabulary_dates", f"WITH {SEG}, {SEGL}, {ent_cte('segl', SEGIDS, ('date',))} SELECT * FROM ents")
def x4b(spark, sf):
    return _shown(local_entities(spark, sf, ("date",)), "call_id", "segment_id")


@query("X5_identifiers", f"WITH {ent_cte('documents', 'doc_id', ('id',))} SELECT * FROM ents")
def x5(spark, sf):
    return _shown(ent.entities(spread(load(spark, sf, "documents").select("doc_id", "text")), ["doc_id"], kinds=("id",)), "doc_id")


@query("X6_financial_terms", f"WITH {SEG}, {ent_cte('seg', SEGIDS, ('term',))} SELECT * FROM ents")
def x6(spark, sf):
    return _shown(seg_entities(spark, sf, ("term",)), "call_id", "segment_id")


@query("W19_first_entities", f"WITH {SEG}, {ENTS} SELECT * FROM ents")
def w19(spark, sf):
    return _shown(seg_entities(spark, sf), "call_id", "segment_id")


# ---- obligations -------------------------------------------------------------------------
# Every fifth turn also says one of these.
PROMISES = ["I will pay Rs 2,500 by tomorrow", "i promise to pay 3 lakh on 05/06/2025 if my salary comes", "maybe I will clear it next week", "i authorize the debit of Rs 900 and Rs 70", "I agree to the new terms",
            "we will waive the fee of $30 today", "this is not my loan, i never took 5 crore", "i already paid on 31/02/2025, then i will transfer Rs 40 on 1/2/2026"]
SEGOB = f"segob AS (SELECT * REPLACE (CASE WHEN turn % 5 = 1 THEN text || ' ' || {lst(PROMISES)}[(conv_id + turn) % 8 + 1] ELSE text END AS text) FROM seg)"
_CUES = [(w, k) for k, ws in obl.CUES.items() for w in ws]
_AT = r"(?i)^(?:%s)(?:$|[^\p{L}\p{M}\p{N}_])"
_ANY = r"(?i)(?:^|[^\p{L}\p{M}\p{N}_])(?:%s)(?:$|[^\p{L}\p{M}\p{N}_])"


def _near(kind: str) -> str:
    """Nearest entity of a kind to each cue: every place its text stands at, fewest characters between, then the earlier."""
    return f"""{kind}_at AS (SELECT c.call_id, c.segment_id, c.i, e.value, e.raw_text, s.s, greatest(s.s - c.e, c.i - s.s - length(e.raw_text), 0) AS gap
  FROM cue c JOIN ents e ON e.call_id = c.call_id AND e.segment_id = c.segment_id AND e.entity_type = '{'payment_amount' if kind == 'money' else 'due_date'}' JOIN segob g ON g.call_id = c.call_id AND g.segment_id = c.segment_id,
  (SELECT unnest(range(1, 6000)) AS s) s WHERE s.s <= length(g.text) AND substr(g.text, s.s, length(e.raw_text)) = e.raw_text),
{kind}_near AS (SELECT call_id, segment_id, i, value, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY call_id, segment_id, i ORDER BY gap, s, value) AS k FROM {kind}_at) WHERE k = 1)"""


OBL = f"""{SEGOB}, {ent_cte('segob', SEGIDS)},
cue AS (SELECT call_id, segment_id, speaker, text, start_ds, i, i + length(m) AS e, regexp_replace(lower(m), '\\s+', ' ', 'g') AS m FROM (SELECT call_id, segment_id, speaker, text, start_ds, i, regexp_extract(substr(text, i), {q(_AT.replace('(?:%s)', '(%s)') % '|'.join(w.replace(' ', chr(92) + 's+') for w, _ in _CUES))}, 1) AS m
  FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM segob) WHERE i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}_]')) WHERE m <> ''),
{_near('money')}, {_near('date')},
ob0 AS (SELECT c.*, {case('m', dict(_CUES))} AS obligation_type, a.value AS av, a.raw_text AS amount_raw, d.value AS dv FROM cue c LEFT JOIN money_near a USING (call_id, segment_id, i) LEFT JOIN date_near d USING (call_id, segment_id, i)),
ob1 AS (SELECT *, CASE WHEN obligation_type IN ('denial', 'dispute') THEN 'denial' WHEN obligation_type IN {inlist(obl.FIRM)} THEN 'binding' WHEN regexp_matches(text, {q(_ANY % '|'.join(obl.CONDITIONS))}) THEN 'conditional'
  WHEN regexp_matches(text, {q(_ANY % '|'.join(obl.HEDGES))}) THEN 'vague' WHEN av IS NOT NULL AND dv IS NOT NULL THEN 'binding' ELSE 'promise' END AS strength FROM ob0),
obls AS (SELECT call_id, CAST(row_number() OVER (PARTITION BY call_id, segment_id ORDER BY i) - 1 AS BIGINT) AS item, segment_id, speaker, text, obligation_type, strength, CAST(string_split(av, ' ')[1] AS DOUBLE) AS amount, string_split(av, ' ')[2] AS currency, amount_raw,
  CASE WHEN regexp_matches(dv, '^[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}$') THEN coalesce(CAST(try_strptime(replace(replace(dv, '-', '/'), '.', '/'), '%-d/%-m/%Y') AS DATE)::VARCHAR, dv) ELSE dv END AS date_referenced, start_ds,
  strength IN ('binding', 'denial') OR obligation_type IN {inlist(obl.FIRM)} AS legally_significant FROM ob1)"""


def promising(seg):
    return seg.withColumn("text", F.when(F.col("turn") % 5 == 1, F.concat("text", F.lit(" "), pick((F.col("conv_id") + F.col("turn")) % 8, PROMISES))).otherwise(F.col("text")))


@query("X27_obligations", f"WITH {SEG}, {OBL} SELECT * FROM obls")
def x27(spark, sf):
    o = obl.obligations(promising(segments(spark, sf)), F.col("lang"))
    return o.select("call_id", F.col("item").cast("bigint").alias("item"), "segment_id", "speaker", "text", "obligation_type", "strength", F.col("amount.value").alias("amount"), F.col("amount.currency").alias("currency"),
                    F.col("amount.raw_text").alias("amount_raw"), "date_referenced", "start_ds", "legally_significant")


# ---- layers ------------------------------------------------------------------------------
# Stand-in model outputs: capitalised pairs as named entities, short acronyms and numbers as a second tagger.
NER_P, SPACY_P = r"[A-Z][a-z]+ [A-Z][a-z]+", r"\b[A-Z]{2,5}\b|\b[0-9]+\b"
LAYERS = f"""nm AS (SELECT call_id, segment_id, unnest(regexp_extract_all(text, {q(NER_P)})) AS word, generate_subscripts(regexp_extract_all(text, {q(NER_P)}), 1) AS i FROM seg WHERE lang = 'en'),
ner AS (SELECT call_id, segment_id, CAST(i - 1 AS BIGINT) AS item, CASE WHEN length(word) % 3 = 0 THEN 'organization' ELSE 'person_name' END AS entity_type, word AS value, (length(word) * 71 + i * 13) % 1000 AS score_m FROM nm),
sp0 AS (SELECT call_id, segment_id, unnest(regexp_extract_all(text, {q(SPACY_P)})) AS word, generate_subscripts(regexp_extract_all(text, {q(SPACY_P)}), 1) AS i FROM seg WHERE lang = 'en'),
spc AS (SELECT call_id, segment_id, CAST(i - 1 AS BIGINT) AS item, CASE WHEN regexp_matches(word, '[0-9]') THEN 'reference_number' ELSE 'organization' END AS entity_type, word AS value FROM sp0),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, segment_id, entity_type ORDER BY item) AS k FROM ner x WHERE score_m >= 500 AND NOT EXISTS (SELECT 1 FROM ents e WHERE e.call_id = x.call_id AND e.segment_id = x.segment_id AND e.entity_type = x.entity_type)) WHERE k = 1),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, segment_id, entity_type ORDER BY item) AS k FROM spc x WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.call_id = x.call_id AND e.segment_id = x.segment_id AND e.entity_type = x.entity_type)
 AND NOT EXISTS (SELECT 1 FROM n1 e WHERE e.call_id = x.call_id AND e.segment_id = x.segment_id AND e.entity_type = x.entity_type)) WHERE k = 1),
merged AS (SELECT call_id, segment_id, item, entity_type, value, raw_text, confidence, 'regex' AS source FROM ents UNION ALL SELECT call_id, segment_id, item, entity_type, value, value, score_m / 1000e0, 'ner' FROM n1
 UNION ALL SELECT call_id, segment_id, item, entity_type, value, value, 0.75e0, 'spacy' FROM s1)"""
NOISE = f"""clean AS (SELECT * FROM merged WHERE NOT ((entity_type = 'reference_number' AND regexp_matches(trim(raw_text), '^[0-9]$')) OR (entity_type = 'organization' AND upper(trim(raw_text)) IN {inlist(seeds.NOT_ORGANISATIONS)})
 OR (entity_type IN ('due_date', 'date') AND (lower(trim(raw_text)) IN {inlist(seeds.VAGUE_DATES)} OR lower(trim(raw_text)) LIKE '%ago' OR regexp_matches(trim(raw_text), '^[0-9]+$')))))"""


def tagger(seg, pattern, label, score):
    """Rows of (word, label, score) as a model would return them for English turns."""
    s = seg.where(F.col("lang") == "en").select("call_id", "segment_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("item", "word"))
    return s.withColumn("label", label).withColumn("score_m", score)


def layers(spark, sf, seg=None):
    seg = settle(segments(spark, sf)) if seg is None else seg
    rx = ent.entities(seg, ["call_id", "segment_id"], F.col("lang")).withColumn("source", F.lit("regex"))
    ner = ent.ner_policy(tagger(seg, NER_P, F.when(F.length("word") % 3 == 0, "B-ORG").otherwise("B-PER"), (F.length("word") * 71 + (F.col("item") + 1) * 13) % 1000))
    spc = ent.ner_policy(tagger(seg, SPACY_P, F.when(F.col("word").rlike("[0-9]"), "CARDINAL").otherwise("ORG"), F.lit(750)))

    def shape(df, src, conf):
        return df.select("call_id", "segment_id", "item", "entity_type", "value", F.col("value").alias("raw_text"), conf.alias("confidence"), F.lit(src).alias("source"))
    return ent.merge_layers(rx, shape(ner, "ner", F.col("score_m") / 1000), shape(spc, "spacy", F.lit(0.75)))


@query("J7_entity_layers", f"WITH {SEG}, {ENTS}, {LAYERS} SELECT * FROM merged")
def j7(spark, sf):
    return layers(spark, sf).withColumn("item", F.col("item").cast("bigint"))


@query("U7_layer_difference", f"WITH {SEG}, {ENTS}, {LAYERS} SELECT call_id, segment_id, entity_type, count(*) AS n FROM spc x WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.call_id = x.call_id AND e.segment_id = x.segment_id AND e.entity_type = x.entity_type) GROUP BY 1, 2, 3")
def u7(spark, sf):
    seg = segments(spark, sf)
    spc = ent.ner_policy(tagger(seg, SPACY_P, F.when(F.col("word").rlike("[0-9]"), "CARDINAL").otherwise("ORG"), F.lit(750)))
    keys = ["call_id", "segment_id", "entity_type"]
    rx = ent.entities(seg, ["call_id", "segment_id"], F.col("lang")).select(*keys).distinct()
    return spc.join(rx, keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("M5_ner_policy", f"WITH {SEG}, {ENTS}, {LAYERS} SELECT call_id, segment_id, item, entity_type, value, score_m FROM ner WHERE score_m >= 500")
def m5(spark, sf):
    n = ent.ner_policy(tagger(segments(spark, sf), NER_P, F.when(F.length("word") % 3 == 0, "B-ORG").otherwise("B-PER"), (F.length("word") * 71 + (F.col("item") + 1) * 13) % 1000))
    return n.select("call_id", "segment_id", F.col("item").cast("bigint").alias("item"), "entity_type", "value", F.col("score_m").cast("bigint").alias("score_m"))


@query("P8_noise_filter", f"WITH {SEG}, {ENTS}, {LAYERS}, {NOISE} SELECT * FROM clean")
def p8(spark, sf):
    return ent.drop_noise(layers(spark, sf)).withColumn("item", F.col("item").cast("bigint"))


@query("J22_entity_markup", f"""WITH {SEG}, {ENTS}, l AS (SELECT call_id, segment_id, list(entity_type || chr(1) || raw_text ORDER BY item) AS es FROM ents WHERE raw_text <> '' GROUP BY 1, 2)
SELECT s.call_id, s.segment_id, CASE WHEN es IS NULL THEN text ELSE list_reduce(list_prepend(text, es), lambda t, e: CASE WHEN contains(t, split_part(e, chr(1), 2)) THEN left(t, strpos(t, split_part(e, chr(1), 2)) - 1) || '<entity type="' || split_part(e, chr(1), 1) || '">' || split_part(e, chr(1), 2) || '</entity>' || substr(t, strpos(t, split_part(e, chr(1), 2)) + length(split_part(e, chr(1), 2))) ELSE t END) END AS text
FROM seg s LEFT JOIN l USING (call_id, segment_id)""")
def j22(spark, sf):
    seg = segments(spark, sf)
    return ent.mark_up(seg.select("call_id", "segment_id", "text"), ent.entities(seg, ["call_id", "segment_id"], F.col("lang")))


# ---- personal data -----------------------------------------------------------------------

def _mask_sql(x: str, t: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"""CASE WHEN {t} = 'IN_AADHAAR' THEN 'XXXX XXXX ' || right({d}, 4) WHEN {t} = 'IN_PAN' THEN 'XXXXX' || substr({x}, 6, 4) || 'X' WHEN {t} IN ('PHONE_NUMBER', 'IN_PHONE') THEN 'XXXXXX' || right({d}, 4)
 WHEN {t} = 'EMAIL_ADDRESS' THEN left({x}, 1) || '***@' || split_part({x}, '@', 2) WHEN {t} = 'CREDIT_CARD' THEN 'XXXX XXXX XXXX ' || right({d}, 4) WHEN {t} = 'IN_UPI_ID' THEN '****@****' WHEN {t} = 'IN_IFSC' THEN 'XXXX0XXXXXX'
 WHEN {t} = 'IN_BANK_ACCOUNT' THEN 'XXXXXX' || right({x}, 4) ELSE '[' || {t} || ']' END"""


def verhoeff_sql(digits: str) -> str:
    d, p = ent.verhoeff_tables()
    e = "0"
    for i in range(12):
        e = f"CAST(substr('{d}', ({e}) * 10 + CAST(substr('{p}', {(i % 8) * 10} + CAST(substr({digits}, {12 - i}, 1) AS INTEGER) + 1, 1) AS INTEGER) + 1, 1) AS INTEGER)"
    return f"({e} = 0)"


def pii_cte(src: str = "documents", ids: str = "doc_id") -> str:
    parts = []
    for n, (t, p, s, c) in enumerate(ent.RECOGNISERS):
        ctx = " OR ".join(f"contains(w, {q(k)})" for k in c.split())
        parts.append(f"""SELECT {ids}, {n} AS rank, {q(t)} AS entity_type, m[i] AS text, CAST(coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) AS BIGINT) AS start, {s}e0 AS base, full_text, i,
 lambda_ctx FROM (SELECT {ids}, text AS full_text, regexp_extract_all(text, {q(p)}) AS m, string_split_regex(text, {q(p)}) AS g, {lst(c.split())} AS lambda_ctx FROM {src} WHERE regexp_matches(text, {q(p)})), (SELECT unnest(range(1, 400)) AS i) WHERE i <= len(m)""")
    lead = words_sql("lower(substr(full_text, 1, start))")
    return f"""pr AS ({' UNION ALL '.join(parts)}),
pc AS (SELECT * EXCLUDE (base), {lead} AS lw, base FROM pr),
ps AS (SELECT {ids}, rank, entity_type, text, start, start + length(text) AS "end", i, {hu("CASE WHEN len(list_filter(lw[greatest(len(lw) - 4, 1):len(lw)], lambda w: len(list_filter(lambda_ctx, lambda k: contains(w, k))) > 0)) > 0 THEN least(1e0, greatest(base + 0.35e0, 0.4e0)) ELSE base END", 3)} AS score FROM pc),
pk AS (SELECT *, row_number() OVER (PARTITION BY {ids}, entity_type, text ORDER BY rank, start) AS k FROM ps WHERE score >= CASE WHEN entity_type = 'DATE_TIME' THEN 0.7e0 ELSE 0.5e0 END AND (entity_type <> 'IN_AADHAAR' OR {verhoeff_sql("regexp_replace(text, '[^0-9]', '', 'g')")})),
pii AS (SELECT {ids}, entity_type, text, start, "end", score, rank, {_mask_sql('text', 'entity_type')} AS masked_text FROM pk WHERE k = 1)"""


PII = pii_cte()


def _docs(spark, sf):
    return spread(load(spark, sf, "documents"))


@query("X7_personal_data", f"WITH {PII} SELECT * EXCLUDE (rank) FROM pii")
def x7(spark, sf):
    p = ent.pii(_docs(spark, sf), ["doc_id"]).drop("rank")
    return p.withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint"))


@query("X8_verhoeff", f"WITH n AS (SELECT event_id, lpad(CAST((event_id * 104729 + 31337) * 7919 % 1000000000000 AS VARCHAR), 12, '0') AS number FROM events) SELECT event_id, number, {verhoeff_sql('number')} AS valid FROM n")
def x8(spark, sf):
    n = F.lpad(((F.col("event_id") * 104729 + 31337) * 7919 % 1000000000000).cast("string"), 12, "0")
    return load(spark, sf, "events").select("event_id", n.alias("number")).withColumn("valid", ent.verhoeff_ok(F.col("number")))


@query("X9_masks", f"WITH {PII} SELECT entity_type, masked_text, count(*) AS n FROM pii GROUP BY 1, 2")
def x9(spark, sf):
    return ent.pii(_docs(spark, sf), ["doc_id"]).groupBy("entity_type", "masked_text").agg(F.count(F.lit(1)).alias("n"))


CLUST = f"""mx AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (SELECT DISTINCT ON (doc_id, entity_type, text) * FROM pii)),
cz AS (SELECT *, sum(CASE WHEN pe IS NULL OR start >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end", score, entity_type ROWS UNBOUNDED PRECEDING) AS cl FROM mx),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cl ORDER BY score DESC, "end" - start DESC, start, entity_type) AS best FROM cz),
cs AS (SELECT doc_id, cl, min(start) AS start, max("end") AS "end", max(CASE WHEN best = 1 THEN entity_type END) AS entity_type, max(CASE WHEN best = 1 THEN masked_text END) AS masked_text FROM rk GROUP BY 1, 2)"""


@query("W21_span_clusters", f'WITH {PII}, {CLUST} SELECT doc_id, start, "end", entity_type, masked_text FROM cs')
def w21(spark, sf):
    c = _docs(spark, sf).select("doc_id", F.explode(ent.clusters(ent.pii_spans(F.col("text")))).alias("c"))
    return c.select("doc_id", F.col("c.start").cast("bigint").alias("start"), F.col("c.end").cast("bigint").alias("end"), "c.entity_type",
                    ent.mask(F.col("c.text"), F.col("c.entity_type")).alias("masked_text"))


# masking covers every occurrence, not the first of equal ones
PII_ALL = PII.replace(" FROM pk WHERE k = 1)", " FROM pk)")
CLUST_ALL = CLUST.replace("(SELECT DISTINCT ON (doc_id, entity_type, text) * FROM pii)", "pii")


@query("J6_positional_mask", f"""WITH {PII_ALL}, {CLUST_ALL}, pv AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM cs),
m AS (SELECT doc_id, string_agg(substr(d.text, prev + 1, start - prev) || masked_text, '' ORDER BY start) AS head, max("end") AS last_end FROM pv JOIN documents d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, m.head IS NOT NULL AS pii_masked, coalesce(head || substr(d.text, last_end + 1), d.text) AS text FROM documents d LEFT JOIN m USING (doc_id)""")
def j6(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text").withColumn("c", ent.clusters(ent.pii_occurrences(F.col("text"))))
    return d.select("doc_id", (F.size("c") > 0).alias("pii_masked"), ent.mask_positions(F.col("text"), F.col("c")).alias("text"))


@query("J5_masked_transcript", f"""WITH {PII}, l AS (SELECT doc_id, list(text || chr(1) || masked_text ORDER BY rank, start) AS ps FROM pii GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(ps), 0) AS BIGINT) AS pii_count, CASE WHEN ps IS NULL THEN text ELSE list_reduce(list_prepend(text, ps), lambda t, p: replace(t, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) END AS text FROM documents d LEFT JOIN l USING (doc_id)""")
def j5(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text").withColumn("p", ent.pii_spans(F.col("text")))
    return d.select("doc_id", F.size("p").cast("bigint").alias("pii_count"), ent.mask_everywhere(F.col("text"), F.col("p")).alias("text"))


@query("P9_pii_display", f"""WITH {PII}, dt AS (SELECT doc_id, 'DATE_TIME' AS entity_type, unnest(regexp_extract_all(text, '\\b[0-9]{{1,4}}[/.:-][0-9]{{1,4}}\\b|[0-9]+ ?(?:minutes?|hours?)')) AS text FROM documents),
a AS (SELECT doc_id, entity_type, text FROM pii UNION ALL SELECT * FROM dt)
SELECT doc_id, 'PII_' || entity_type AS type, text AS value, count(*) AS n FROM a WHERE text <> '' AND NOT (entity_type = 'DATE_TIME' AND (regexp_matches(lower(text), 'minute|second|moment|hour') OR regexp_matches(text, '^[0-9][0-9-]+$'))) GROUP BY ALL""")
def p9(spark, sf):
    d = _docs(spark, sf)
    dt = d.select("doc_id", F.lit("DATE_TIME").alias("entity_type"), F.explode(F.regexp_extract_all(
        "text", F.lit(r"\b[0-9]{1,4}[/.:-][0-9]{1,4}\b|[0-9]+ ?(?:minutes?|hours?)"), F.lit(0))).alias("text"))
    a = ent.pii(d, ["doc_id"]).select("doc_id", "entity_type", "text").unionByName(dt)
    t = F.lower("text")
    junk = (F.col("entity_type") == "DATE_TIME") & (t.rlike("minute|second|moment|hour") | t.rlike("^[0-9][0-9-]+$"))
    return a.where((F.col("text") != "") & ~junk).groupBy("doc_id", F.concat(F.lit("PII_"), "entity_type").alias("type"), F.col("text").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("M6_language_gate", f"WITH {PII} SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'english_models' ELSE 'patterns_only' END AS route, count(p.text) FILTER (WHERE lang = 'en') AS n_english, count(p.text) AS n_found FROM documents d LEFT JOIN pii p USING (doc_id) GROUP BY 1, 2")
def m6(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", F.size(ent.pii_spans(F.col("text"))).cast("bigint").alias("n_found"))
    en = d.where(F.col("lang") == "en").select("doc_id", "lang", F.lit("english_models").alias("route"), F.col("n_found").alias("n_english"), "n_found")
    rest = d.where(F.coalesce(F.col("lang") != "en", F.lit(True))).select("doc_id", "lang", F.lit("patterns_only").alias("route"), F.lit(0).cast("bigint").alias("n_english"), "n_found")
    return en.unionByName(rest)


# ---- reports over entities ---------------------------------------------------------------

GROUPS = {"payment_amount": "Amounts", "currency_amount": "Amounts", "emi_amount": "Amounts", "loan_amount": "Amounts", "interest_rate": "Rates & Terms",
          "tenure": "Rates & Terms", "due_date": "Dates", "date": "Dates", "organization": "People & Orgs", "person_name": "People & Orgs",
          "account_number": "Identifiers", "reference_number": "Identifiers", "pan_number": "Identifiers", "ifsc_code": "Identifiers", "product_name": "Products", "penalty": "Penalties"}


@query("A7_entity_groups", f"WITH {SEG}, {ENTS}, {LAYERS}, {NOISE} SELECT {case('entity_type', GROUPS, 'Other')} AS grp, count(*) AS n FROM clean GROUP BY 1")
def a7(spark, sf):
    dim = vocab.local_table(spark, list(GROUPS.items()), "entity_type string, grp string")
    e = ent.drop_noise(layers(spark, sf)).join(F.broadcast(dim), "entity_type", "left")
    return e.groupBy(F.coalesce("grp", F.lit("Other")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


KMETRIC = """km AS (SELECT call_id, CASE WHEN entity_type IN ('payment_amount', 'currency_amount', 'emi_amount', 'loan_amount') THEN 'financial_amount' WHEN entity_type = 'interest_rate' THEN 'rate' WHEN entity_type IN ('due_date', 'date') THEN 'date'
  WHEN entity_type = 'organization' THEN 'organization' WHEN entity_type = 'person_name' THEN 'key_person' END AS kind, value, raw_text, segment_id, item, TRY_CAST(replace(split_part(value, ' ', 1), ',', '') AS DOUBLE) AS amount, lower(trim(value)) AS nm FROM clean),
kd AS (SELECT *, row_number() OVER (PARTITION BY call_id, kind, nm ORDER BY segment_id, item, value) AS dup FROM km WHERE kind IS NOT NULL),
kr AS (SELECT *, row_number() OVER (PARTITION BY call_id, kind ORDER BY CASE WHEN kind = 'financial_amount' THEN -coalesce(amount, 0) ELSE 0 END, segment_id, item, value) AS rn FROM kd WHERE kind NOT IN ('organization', 'key_person') OR (dup = 1 AND length(nm) > 2))"""


@query("A33_key_metrics", f"WITH {SEG}, {ENTS}, {LAYERS}, {NOISE}, {KMETRIC} SELECT call_id, kind, rn, value, raw_text, segment_id FROM kr WHERE rn <= CASE kind WHEN 'financial_amount' THEN 8 WHEN 'rate' THEN 4 WHEN 'date' THEN 4 ELSE 6 END")
def a33(spark, sf):
    return key_metrics(ent.drop_noise(layers(spark, sf)), {"financial_amount": 8, "rate": 4, "date": 4, "organization": 6, "key_person": 6})


@query("K4_top_entities", f"WITH {SEG}, {ENTS}, {LAYERS}, {NOISE}, {KMETRIC} SELECT call_id, kind, rn, value, raw_text, segment_id FROM kr WHERE rn <= 3")
def k4(spark, sf):
    return key_metrics(ent.drop_noise(layers(spark, sf)), {k: 3 for k in ("financial_amount", "rate", "date", "organization", "key_person")})


def key_metrics(e, tops):
    """Top entities per call and kind: amounts by size, the rest by position, names once.

    row_number() <= k is applied per map task before the shuffle, so a call
    with most of the data sends k rows per task.
    """
    t = F.col("entity_type")
    kind = (F.when(t.isin("payment_amount", "currency_amount", "emi_amount", "loan_amount"), "financial_amount").when(t == "interest_rate", "rate")
            .when(t.isin("due_date", "date"), "date").when(t == "organization", "organization").when(t == "person_name", "key_person"))
    m = e.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("nm", F.lower(F.trim("value")))
    names = F.col("kind").isin("organization", "key_person")
    named = m.where(names & (F.length("nm") > 2)).groupBy("call_id", "kind", "nm").agg(
        F.min_by(F.struct("value", "raw_text", "segment_id", "item"), F.struct("segment_id", "item", "value")).alias("s")).select("call_id", "kind", "s.*")
    rest = m.where(~names).select("call_id", "kind", "value", "raw_text", "segment_id", "item")
    amount = F.expr("try_cast(replace(split(value, ' ')[0], ',', '') as double)")
    size = F.when(F.col("kind") == "financial_amount", -F.coalesce(amount, F.lit(0.0))).otherwise(0.0)
    w = Window.partitionBy("call_id", "kind").orderBy(size, "segment_id", "item", "value")
    ranked = rest.unionByName(named).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(tops.values()))
    limit = F.create_map(*[x for k, v in tops.items() for x in (F.lit(k), F.lit(v))])
    return ranked.where(F.col("rn") <= limit[F.col("kind")]).select("call_id", "kind", F.col("rn").cast("bigint").alias("rn"), "value", "raw_text", "segment_id")


# ---- corrections and lexicon ---------------------------------------------------------------

FIXES = list(seeds.CORRECTIONS.items())


def _fix_sql(x: str) -> str:
    import re
    for w, r in FIXES:
        x = rf"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{N}}_]){re.escape(w)}($|[^\p{{L}}\p{{N}}_])', '\1{r}\2', 'g')"
    return x


@query("X1_term_correction", f"WITH {SEG}, f AS (SELECT call_id, segment_id, text AS original_text, {_fix_sql('text')} AS text FROM seg) SELECT call_id, segment_id, text, text <> original_text AS corrected, CASE WHEN text <> original_text THEN original_text END AS original_text FROM f")
def x1(spark, sf):
    s = segments(spark, sf).select("call_id", "segment_id", F.col("text").alias("o"), ent.correct_terms(F.col("text"), FIXES).alias("text"))
    return s.select("call_id", "segment_id", "text", (F.col("text") != F.col("o")).alias("corrected"), F.when(F.col("text") != F.col("o"), F.col("o")).alias("original_text"))


@query("X2_amount_metadata", f"WITH {SEG}, a AS (" + " UNION ALL ".join(rf"SELECT call_id, segment_id, {n} AS pn, unnest(regexp_extract_all(text, '(?i)\d+\s*{w}')) AS raw, generate_subscripts(regexp_extract_all(text, '(?i)\d+\s*{w}'), 1) AS i, {k} AS k FROM seg" for n, (w, k) in enumerate(ent.AMOUNT_WORDS)) + r") SELECT call_id, segment_id, string_agg(raw || '=' || CAST(regexp_extract(raw, '\d+') AS BIGINT) * k, '; ' ORDER BY pn, i) AS amounts FROM a GROUP BY 1, 2")
def x2(spark, sf):
    s = segments(spark, sf).withColumn("a", ent.amount_metadata(F.col("text"))).where(F.size("a") > 0)
    return s.select("call_id", "segment_id", F.array_join(F.transform("a", lambda x: F.concat(x["raw"], F.lit("="), x["value"].cast("string"))), "; ").alias("amounts"))


_TOK = f"list_distinct({words_sql('lower(text)')})"
KS = f"ks AS (SELECT *, len(list_intersect({_TOK}, {lst(seeds.POSITIVE)})) AS p, len(list_intersect({_TOK}, {lst(seeds.NEGATIVE)})) AS n FROM seg)"
KSV = f"(CASE WHEN p + n = 0 THEN 0e0 ELSE {hu('(p - n) / (p + n)', 2)} END)"


@query("X10_keyword_sentiment", f"WITH {SEG}, {KS} SELECT call_id, segment_id, {KSV} AS sentiment FROM ks")
def x10(spark, sf):
    return segments(spark, sf).select("call_id", "segment_id", ent.keyword_sentiment(F.col("text")).alias("sentiment"))


@query("U6_lexicon_intersection", f"WITH {SEG}, {KS} SELECT conv_id, turn, p AS n_positive, n AS n_negative FROM ks")
def u6(spark, sf):
    from parleo.functions.columns import words
    t = F.array_distinct(words(F.lower(F.col("text"))))
    return raw_turns(spark, sf).select("conv_id", "turn", F.size(F.array_intersect(t, F.array(*[F.lit(w) for w in seeds.POSITIVE]))).cast("bigint").alias("n_positive"),
                                       F.size(F.array_intersect(t, F.array(*[F.lit(w) for w in seeds.NEGATIVE]))).cast("bigint").alias("n_negative"))
