"""Queries over corpora: phrases, terms, corrections, labels, names, retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from parleo.catalog.affect import SEN, with_sentiment
from parleo.catalog.base import *  # noqa: F403
from parleo.catalog.entities import ENTS, FIXES
from parleo.functions.columns import norm, pick, words
from parleo.operators import emotion as emo
from parleo.operators import entities as ent
from parleo.operators import mining, names
from parleo.plans.stage import settle
from parleo.sources import seeds, vocab
from parleo.sources.sinks import work_path
from parleo.sources.tables import load, raw_turns, segments, spread

LAB = "ld AS (SELECT d.doc_id, text, toxic FROM documents d JOIN labels l USING (doc_id))"


def labelled(spark, sf):
    return spread(load(spark, sf, "documents").select("doc_id", "text")).join(load(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")


def _grams(n: int) -> str:
    return f"SELECT toxic, array_to_string(ws[i:i + {n - 1}], ' ') AS phrase FROM (SELECT toxic, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM tk WHERE len(ws) >= {n})"


PHR = f"{LAB}, tk AS (SELECT toxic, {words_sql('lower(text)')} AS ws FROM ld), gr AS ({' UNION ALL '.join(_grams(n) for n in (3, 4, 5))}), pc AS (SELECT phrase, count(*) FILTER (WHERE toxic = 1) AS n_scam, count(*) FILTER (WHERE toxic <> 1) AS n_normal FROM gr GROUP BY 1)"


@query("A35_phrase_counts", f"WITH {PHR} SELECT * FROM pc")
def a35(spark, sf):
    return mining.phrase_counts(labelled(spark, sf), "toxic")


# Scripted turns are the corpus here: those that ask for codes, remote tools or threaten count as the labelled ones.
SCAM_LINES = (5, 7, 8)
_cats = seeds.MINED_CATEGORY_KEYWORDS
RATIO = "((n_scam / greatest(scam_docs, 1)) / greatest(n_normal / greatest(normal_docs, 1), 1e-4))"
SCR = f"ld AS (SELECT CASE WHEN (conv_id * 31 + turn * 7) % 24 IN {SCAM_LINES} THEN 1 ELSE 0 END AS toxic, text FROM seg)"
PHS = SCR + PHR[len(LAB):]
OVER = f"""sz AS (SELECT count(*) FILTER (WHERE toxic = 1) AS scam_docs, count(*) FILTER (WHERE toxic <> 1) AS normal_docs FROM ld), tp AS (SELECT * FROM pc WHERE n_scam > 0),
ov AS (SELECT phrase, n_scam, n_normal, {hu(RATIO, 3)} AS ratio, CASE {' '.join("WHEN " + " OR ".join(f"contains(' ' || phrase || ' ', {q(' ' + k + ' ')})" for k in ks) + f" THEN {q(c)}" for c, ks in _cats.items())} END AS category FROM tp, sz WHERE n_scam >= greatest(3, scam_docs // 100) AND {RATIO} >= 2)"""


def _over(spark, sf):
    d = raw_turns(spark, sf).select(((F.col("conv_id") * 31 + F.col("turn") * 7) % 24).isin(*SCAM_LINES).cast("int").alias("toxic"), "text")
    sizes = d.agg(F.count_if(F.col("toxic") == 1).alias("scam_docs"), F.count_if(F.col("toxic") != 1).alias("normal_docs"))
    return mining.over_represented(mining.phrase_counts(d, "toxic"), sizes, seeds.entries(_cats))


@query("A36_over_represented", f"WITH {SEG}, {PHS}, {OVER} SELECT * FROM ov WHERE category IS NOT NULL")
def a36(spark, sf):
    return _over(spark, sf)


_T = "lower(trim(text, ' '))"
SHORT = rf"""sh0 AS (SELECT CASE WHEN regexp_matches(text, '[\x{{0900}}-\x{{097f}}]') THEN 'hi' ELSE 'en' END AS lang, text, len({words_sql('text')}) AS n_w, {words_sql(_T)} AS toks FROM seg),
sh1 AS (SELECT lang, CASE WHEN lang = 'hi' THEN {_T} ELSE regexp_replace({_T}, '\.+$', '') END AS phrase, CASE WHEN lang = 'en' THEN list_has_any(toks, {lst(mining.GREETING_WORDS)}) ELSE regexp_matches({_T}, '{'|'.join(mining.GREETING_HI)}') END AS g FROM sh0 WHERE n_w <= CASE lang WHEN 'hi' THEN 3 ELSE 5 END),
shp AS (SELECT lang, phrase, count(*) AS n, bool_or(g) AS is_greeting FROM sh1 WHERE phrase <> '' GROUP BY 1, 2 HAVING lang = 'en' OR count(*) >= 2)"""


@query("A37_short_phrases", f"WITH {SEG}, {SHORT} SELECT * FROM shp")
def a37(spark, sf):
    return mining.short_phrases(raw_turns(spark, sf))


_AC = [t.lower() for t in seeds.FINANCE_PATTERN.split("|") if "\\" not in t]
ACR = f"tk2 AS (SELECT unnest(string_split({norm_sql('text')}, ' ')) AS w FROM seg), acr AS (SELECT upper(w) AS term, count(*) AS n FROM tk2 WHERE w IN {inlist(_AC)} GROUP BY 1 HAVING count(*) >= 2)"


@query("A38_term_frequency", f"WITH {SEG}, {ACR}, df AS (SELECT t AS term, count(*) AS n FROM seg, (SELECT unnest({lst(seeds.FINANCE_WORDS_LOCAL)}) AS t) WHERE contains(text, t) GROUP BY 1 ORDER BY n DESC, term LIMIT 50) SELECT term, n, 'acronym' AS kind FROM (SELECT * FROM acr ORDER BY n DESC, term LIMIT 100) UNION ALL SELECT term, n, 'local' FROM df")
def a38(spark, sf):
    t = raw_turns(spark, sf)
    return mining.acronyms(t, top=100).withColumn("kind", F.lit("acronym")).unionByName(mining.document_frequency(t, seeds.FINANCE_WORDS_LOCAL, top=50).withColumn("kind", F.lit("local")))


# ---- corrections ------------------------------------------------------------------------------------
def heard_pairs(spark, sf):
    """Every document with some words misheard: 'emi' as 'emmy', others spelled backwards or with a tail."""
    d = spread(load(spark, sf, "documents").select("doc_id", "text")).select("doc_id", norm(F.col("text")).alias("truth"))
    heard = F.transform(F.split("truth", " "), lambda w, i: F.when(w == "in", "emi").when((i + F.col("doc_id")) % 17 == 0, F.reverse(w)).when((i + F.col("doc_id")) % 17 == 1, F.concat(w, F.lit("x"))).otherwise(w))
    return d.select("doc_id", F.array_join(heard, " ").alias("heard"), "truth")


PAIRS = f"""tr AS (SELECT doc_id, string_split({norm_sql('text')}, ' ') AS ws FROM documents), ex AS (SELECT doc_id, unnest(ws) AS truth, unnest(range(0, len(ws))) AS i FROM tr),
hr AS (SELECT doc_id, i, CASE WHEN truth = 'in' THEN 'emi' WHEN (i + doc_id) % 17 = 0 THEN reverse(truth) WHEN (i + doc_id) % 17 = 1 THEN truth || 'x' ELSE truth END AS heard, truth FROM ex), mm AS (SELECT * FROM hr WHERE heard <> truth)"""
CORR = f"""mc AS (SELECT heard, truth, count(*) AS n FROM mm GROUP BY 1, 2 HAVING count(*) >= 3),
cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY heard ORDER BY n DESC, truth DESC) AS k FROM mc WHERE heard IN {inlist(seeds.FINANCE_TERMS)} OR truth IN {inlist(seeds.FINANCE_TERMS)}) WHERE k = 1),
cg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY heard ORDER BY n DESC, truth DESC) AS k FROM mc WHERE length(heard) >= 3 AND length(truth) >= 3 AND 1 - levenshtein(heard, truth) / greatest(length(heard), length(truth)) < 0.8e0 AND heard NOT IN (SELECT heard FROM cf)) WHERE k = 1),
corr AS (SELECT heard, truth, n, 'financial' AS kind FROM cf UNION ALL SELECT heard, truth, n, 'general' FROM cg)"""


@query("X26_word_alignment", f"WITH {PAIRS} SELECT heard, truth, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM mm GROUP BY 1, 2")
def x26(spark, sf):
    return mining.aligned_pairs(heard_pairs(spark, sf), ["doc_id"]).groupBy("heard", "truth").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


# Every word carries its place, so that the alignment is known: a misheard word counts unless a word next to it was dropped.
DROPPED = """tr AS (SELECT conv_id, turn, string_split(%s, ' ') AS ws FROM conversations), ex AS (SELECT conv_id, turn, unnest(ws) || 'z' || unnest(range(0, len(ws))) AS w, unnest(range(0, len(ws))) AS i FROM tr),
dr AS (SELECT *, (i + turn) %% 19 = 3 AS gone FROM ex), nb AS (SELECT *, coalesce(lag(gone) OVER v, false) OR coalesce(lead(gone) OVER v, false) AS beside FROM dr WINDOW v AS (PARTITION BY conv_id, turn ORDER BY i)),
kp AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS k FROM nb WHERE NOT gone)
SELECT conv_id, count(*) AS n, min(w) AS first_truth, max(w || 'q') AS last_heard FROM kp WHERE (k + conv_id) %% 11 = 0 AND NOT beside GROUP BY 1""" % norm_sql("text")


@query("X26_sequence_alignment", f"WITH {DROPPED}")
def x26b(spark, sf):
    """Texts of different length: words are dropped and others misheard."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", norm(F.col("text")).alias("truth"))
    c = c.withColumn("truth", F.array_join(F.transform(F.split("truth", " "), lambda w, i: F.concat(w, F.lit("z"), i.cast("string"))), " "))
    heard = F.transform(F.filter(F.split("truth", " "), lambda w, i: (i + F.col("turn")) % 19 != 3), lambda w, i: F.when((i + F.col("conv_id")) % 11 == 0, F.concat(w, F.lit("q"))).otherwise(w))
    p = c.select("conv_id", "turn", F.array_join(heard, " ").alias("heard"), "truth")
    return mining.aligned_pairs(p, ["conv_id", "turn"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("truth").alias("first_truth"), F.max("heard").alias("last_heard"))


# Words repeat here as they do in speech; what is misheard or put in occurs in no text and lies apart from drops, so the substitutions are known.
REPEATED = """tr AS (SELECT conv_id, turn, string_split(%s, ' ') AS ws FROM conversations), ex AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM tr),
mk AS (SELECT *, (i + turn) %% 19 = 3 AS gone, (i + conv_id) %% 11 = 0 AND (i + turn) %% 19 NOT IN (0, 1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 14) AND i > 0 AS bad FROM ex)
SELECT conv_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS places, min(w) AS first_truth, max(w || 'qq') AS last_heard FROM mk WHERE bad GROUP BY 1""" % norm_sql("text")


@query("X26_repeated_words", f"WITH {REPEATED}")
def x26c(spark, sf):
    """Repeated words, dropped words, inserted words and misheard ones apart from those."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", norm(F.col("text")).alias("truth"))

    def said(w, i):
        at = i + F.col("turn")
        bad = ((i + F.col("conv_id")) % 11 == 0) & ~(at % 19).isin(0, 1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 14) & (i > 0)
        return F.when(at % 19 == 3, "").when(bad, F.concat(w, F.lit("qq"))).when(at % 19 == 12, F.concat(w, F.lit(" uhmq"))).otherwise(w)

    heard = F.array_join(F.filter(F.transform(F.split("truth", " "), said), lambda w: w != ""), " ")
    p = mining.aligned_pairs(c.withColumn("heard", heard), ["conv_id", "turn"], with_truth_place=True)
    return p.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("truth_pos").alias("places"), F.min("truth").alias("first_truth"), F.max("heard").alias("last_heard"))


@query("A39_correction_discovery", f"WITH {PAIRS}, {CORR} SELECT * FROM corr")
def a39(spark, sf):
    return mining.discover_corrections(mining.aligned_pairs(heard_pairs(spark, sf), ["doc_id"]))


SEEDC = values_cte("seedc", "heard, truth", FIXES)


@query("S5_correction_dictionary", f"WITH {PAIRS}, {CORR}, {SEEDC} SELECT coalesce(s.heard, c.heard) AS heard, coalesce(c.truth, s.truth) AS truth, CASE WHEN c.truth IS NOT NULL THEN 'discovered' ELSE 'seed' END AS source FROM seedc s FULL JOIN corr c ON c.heard = s.heard")
def s5(spark, sf):
    seed = vocab.local_table(spark, FIXES, "heard string, truth string")
    return mining.overlay_dictionary(seed, a39(spark, sf))


@query("S15_discovery_report", f"WITH {PAIRS}, a AS (SELECT heard, truth, count(*) AS n FROM mm GROUP BY 1, 2), t AS (SELECT * FROM a ORDER BY n DESC, heard, truth LIMIT 50) SELECT heard, truth, n, (SELECT CAST(sum(n) AS BIGINT) FROM a) AS total_mismatches, (SELECT count(*) FROM a) AS unique_mismatches FROM t")
def s15(spark, sf):
    a = settle(mining.aligned_pairs(heard_pairs(spark, sf), ["doc_id"]).groupBy("heard", "truth").agg(F.count(F.lit(1)).alias("n")))
    top = a.orderBy(F.desc("n"), "heard", "truth").limit(50).withColumns({
        "total_mismatches": a.agg(F.sum("n").alias("x")).scalar(), "unique_mismatches": a.agg(F.count(F.lit(1)).alias("x")).scalar()})
    path = work_path(spark, "report")
    top.write.json(path)
    return spark.read.schema("heard string, truth string, n bigint, total_mismatches bigint, unique_mismatches bigint").json(path)


# ---- labels -------------------------------------------------------------------------------------------
FINE = {"view_0": "info_request", "view_1": "info_request", "click_0": "agreement", "click_2": "consent_given", "purchase_0": "payment_promise", "purchase_1": "payment_promise", "error_0": "complaint", "error_3": "dispute", "signup_2": "greeting"}
_FINE = "event_type || '_' || (event_id % 4)"


def _fine(spark, sf):
    return load(spark, sf, "events").select("event_id", F.concat("event_type", F.lit("_"), (F.col("event_id") % 4).cast("string")).alias("fine"))


@query("J18_label_remap", f"WITH f AS (SELECT event_id, {_FINE} AS fine FROM events) SELECT event_id, fine, {case('fine', FINE)} AS coarse FROM f WHERE {case('fine', FINE)} IS NOT NULL")
def j18(spark, sf):
    return mining.remap_labels(_fine(spark, sf), vocab.local_table(spark, list(FINE.items()), "fine string, coarse string"), "fine")[0]


@query("J18_unmapped_labels", f"WITH f AS (SELECT {_FINE} AS fine FROM events) SELECT fine, count(*) AS n FROM f WHERE {case('fine', FINE)} IS NULL GROUP BY 1 ORDER BY n DESC, fine LIMIT 10")
def j18b(spark, sf):
    return mining.remap_labels(_fine(spark, sf), vocab.local_table(spark, list(FINE.items()), "fine string, coarse string"), "fine")[1]


@query("U4_corpus_union", "SELECT text, label, count(*) AS n FROM (SELECT trim(text, ' ') AS text, CASE WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS label FROM documents JOIN labels USING (doc_id) UNION ALL SELECT trim(text, ' '), CASE WHEN role = 'assistant' THEN 'neutral' ELSE 'positive' END FROM conversations) GROUP BY 1, 2")
def u4(spark, sf):
    a = labelled(spark, sf).select(F.trim("text").alias("text"), F.when(F.col("toxic") == 1, "negative").otherwise("neutral").alias("label"))
    b = load(spark, sf, "conversations").select(F.trim("text").alias("text"), F.when(F.col("role") == "assistant", "neutral").otherwise("positive").alias("label"))
    return a.unionByName(b).groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))


@query("S6_labelled_corpus", "SELECT doc_id, text, quality AS label, length(text) AS n_chars FROM documents JOIN labels USING (doc_id) WHERE trim(text, ' ') <> ''")
def s6(spark, sf):
    d = mining.text_column(load(spark, sf, "documents").select("doc_id", F.col("text").alias("sentence")))
    return d.where(F.trim("text") != "").join(load(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").select("doc_id", "text", "label", F.length("text").cast("bigint").alias("n_chars"))


@query("A40_label_distribution", "SELECT quality AS label, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a40(spark, sf):
    return load(spark, sf, "labels").groupBy(F.col("quality").alias("label"), "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("A40_token_regroup", f"WITH {SEG}, t AS (SELECT conv_id, turn, unnest({words_sql('text')}) AS token, unnest(range(0, len({words_sql('text')}))) AS pos FROM seg) SELECT conv_id, turn, string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(CAST(length(token) % 7 AS VARCHAR), ' ' ORDER BY pos) AS labels FROM t GROUP BY 1, 2")
def a40b(spark, sf):
    t = raw_turns(spark, sf).select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("pos", "token")).withColumn("label", F.length("token") % 7)
    return mining.regroup_tokens(t, ["conv_id", "turn"])


@query("A41_class_metrics", f"""WITH p AS (SELECT quality + 2 * toxic AS label, CASE WHEN doc_id * 7 % 10 < 8 THEN quality + 2 * toxic ELSE (quality + 2 * toxic + 1) % 4 END AS pred FROM labels), c AS (SELECT label, pred, count(*) AS n FROM p GROUP BY 1, 2),
s AS (SELECT label AS c, sum(n) AS sup FROM c GROUP BY 1), r AS (SELECT pred AS c, sum(n) AS prd FROM c GROUP BY 1), t AS (SELECT label AS c, n AS tp FROM c WHERE label = pred), k AS (SELECT sup, coalesce(prd, 0) AS prd, coalesce(tp, 0) AS tp FROM s LEFT JOIN r USING (c) LEFT JOIN t USING (c)),
a AS (SELECT sum(tp) AS ok, sum(sup) AS n, sum(2e0 * tp / (prd + sup) * sup) AS wf FROM k), b AS (SELECT sum(n) FILTER (WHERE label > 0 AND pred > 0) AS btp, sum(n) FILTER (WHERE (label > 0) <> (pred > 0)) AS bw FROM c)
SELECT {hu('ok / n', 5)} AS accuracy, {hu('wf / n', 5)} AS f1_weighted, {hu('2e0 * btp / (2 * btp + bw)', 5)} AS entity_f1 FROM a, b""")
def a41(spark, sf):
    l = F.col("quality") + 2 * F.col("toxic")
    return mining.class_metrics(load(spark, sf, "labels").select(l.alias("label"), F.when(F.col("doc_id") * 7 % 10 < 8, l).otherwise((l + 1) % 4).alias("pred")))


@query("M9_stratified_split", "WITH h AS (SELECT doc_id, quality AS label, md5('42:' || doc_id)[1:8] AS h FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM h) SELECT doc_id, label, CASE WHEN rn <= floor(n * 0.85e0 + 0.5) THEN 'train' ELSE 'test' END AS split FROM r")
def m9(spark, sf):
    return mining.stratified_split(load(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "label", "doc_id")


# ---- vocabulary ------------------------------------------------------------------------------------------
_SEEDT = values_cte("seedt", "lang, phrase", [(r[0], r[4]) for r in vocab.phrases("trivial")])


@query("U5_phrase_union", f"WITH {SEG}, {SHORT}, {_SEEDT} SELECT lang, phrase FROM shp UNION SELECT lang, phrase FROM seedt")
def u5(spark, sf):
    seed = vocab.seed_vocab(spark).where("domain = 'trivial'").select("lang", "phrase")
    return mining.short_phrases(raw_turns(spark, sf)).select("lang", "phrase").union(seed).distinct().orderBy("lang", "phrase")


VSQL = f"""{SHORT}, {ACR}, {PHS}, {OVER}, {values_cte('seedv', 'lang, domain, category, phrase', sorted({(r[0], r[1], r[3], r[4].lower()) for r in vocab.seed_rows() if r[1] in ('prohibited', 'end_call', 'scam')}))},
vb AS (SELECT lang, 'trivial' AS domain, 'trivial' AS category, phrase FROM shp UNION SELECT lang, 'greeting', 'greeting', phrase FROM shp WHERE is_greeting UNION SELECT 'en', 'acronym', 'acronym', term FROM acr UNION SELECT 'en', 'scam', category, phrase FROM ov WHERE category IS NOT NULL UNION SELECT * FROM seedv)"""


def built_vocab(spark, sf):
    t = raw_turns(spark, sf)
    short = mining.short_phrases(t)
    cols = ["lang", "domain", "category", "phrase"]

    def named(df, domain):
        return df.select("lang", F.lit(domain).alias("domain"), F.lit(domain).alias("category"), "phrase")
    acr = mining.acronyms(t).select(F.lit("en").alias("lang"), F.lit("acronym").alias("domain"), F.lit("acronym").alias("category"), F.col("term").alias("phrase"))
    scam = _over(spark, sf).select(F.lit("en").alias("lang"), F.lit("scam").alias("domain"), "category", "phrase")
    seed = vocab.seed_vocab(spark).where(F.col("domain").isin("prohibited", "end_call", "scam")).select("lang", "domain", "category", F.lower("phrase").alias("phrase"))
    parts = [named(short, "trivial"), named(short.where("is_greeting"), "greeting"), acr, scam, seed]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*cols).distinct()


@query("U8_vocabulary_build", f"WITH {SEG}, {VSQL} SELECT * FROM vb")
def u8(spark, sf):
    return built_vocab(spark, sf)


@query("A60_vocabulary_sizes", f"WITH {SEG}, {VSQL} SELECT lang, domain, count(*) AS n, count(DISTINCT category) AS n_categories FROM vb GROUP BY 1, 2")
def a60(spark, sf):
    return built_vocab(spark, sf).groupBy("lang", "domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("n_categories"))


@query("S3_vocabulary_scan", f"WITH {SEG}, {SHORT} SELECT lang, 'trivial' AS domain, phrase FROM shp UNION ALL SELECT lang, 'greeting', phrase FROM shp WHERE is_greeting")
def s3(spark, sf):
    """Write the mined lists as vocabulary files, one folder per language, and read them back as rows."""
    s = mining.short_phrases(raw_turns(spark, sf))
    f = s.select("lang", F.array("phrase").alias("trivial_phrases"), F.when(F.col("is_greeting"), F.array("phrase")).alias("greetings"))
    path = work_path(spark, "vocab")
    f.write.partitionBy("lang").json(path)
    return vocab.read_vocab_json(spark, path, by_folder=True).select("lang", "domain", "phrase")


@query("S4_indicator_scan", f"WITH {SEG}, {PHS}, {OVER} SELECT 'scam' AS domain, category, phrase FROM ov WHERE category IS NOT NULL UNION ALL SELECT 'scam_type', 'mined', phrase FROM ov WHERE category IS NOT NULL")
def s4(spark, sf):
    """Write mined indicators as files of the indicator layout and read them back as rows."""
    o = _over(spark, sf)
    cats = [c for c in _cats]
    f = o.select(*[F.when(F.col("category") == c, F.array("phrase")).alias(c) for c in cats], F.create_map(F.lit("mined"), F.array("phrase")).alias("scam_type_keywords"))
    path = work_path(spark, "indicators")
    f.write.json(path)
    return vocab.read_indicators_json(spark, path, multi_line=False).select("domain", "category", "phrase")


# Folders are named after the page, some with a mark of the language in brackets.
MARKS = ["", " (EN set)", " (RU)", " (PL calls)", " (FR)", " (DE set)", " (Portuguese set)"]
_FOLDER = f"(SELECT page_id, replace(url, 'page', ['billing', 'sales', 'support', 'misc'][page_id % 4 + 1]) || {lst(MARKS)}[page_id % 7 + 1] || '/a.mp3' AS path FROM pages)"
_LANG = "CASE " + " ".join(f"WHEN contains(path, {q('(' + m + ' ')}) OR contains(path, {q('(' + m + ')')}) THEN {q(c)}" for m, c in mining.FOLDER_LANGUAGES.items()) + " ELSE 'en' END"


@query("S7_input_listing", f"SELECT page_id, path, {_LANG} AS language, CASE WHEN contains(lower(path), 'billing') OR contains(lower(path), 'account') THEN 'collections' WHEN contains(lower(path), 'sale') THEN 'general' WHEN contains(lower(path), 'support') OR contains(lower(path), 'customer service') THEN 'complaint' ELSE 'general' END AS call_type FROM {_FOLDER}")
def s7(spark, sf):
    path = F.concat(F.replace(F.col("url"), F.lit("page"), pick(F.col("page_id") % 4, ["billing", "sales", "support", "misc"])), pick(F.col("page_id") % 7, MARKS), F.lit("/a.mp3"))
    p = load(spark, sf, "pages").select("page_id", path.alias("path"))
    lang, ct = mining.from_folder(F.col("path"))
    return p.select("page_id", "path", lang.alias("language"), ct.alias("call_type"))


@query("X20_language_guess", r"""WITH d AS (SELECT doc_id, lang, text, list_distinct(string_split(trim(regexp_replace(lower(text), '[\p{P}\p{S}\s]+', ' ', 'g')), ' ')) AS t FROM documents),
s AS (SELECT doc_id, lang, regexp_matches(text, '[\x{0900}-\x{097f}]') AS hi, len(list_intersect(t, ['the', 'of', 'and', 'to', 'that', 'with'])) AS en, len(list_intersect(t, ['der', 'die', 'und', 'ein', 'ich', 'zu'])) AS de, len(list_intersect(t, ['le', 'la', 'que', 'un', 'et', 'ou'])) AS fr, len(list_intersect(t, ['el', 'los', 'del', 'y', 'una', 'por'])) AS es FROM d),
g AS (SELECT doc_id, lang, CASE WHEN hi THEN 'hi' WHEN greatest(en, de, fr, es) = 0 THEN 'en' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS guess FROM s)
SELECT lang, guess, count(*) AS n FROM g GROUP BY 1, 2""")
def x20(spark, sf):
    from parleo.functions.language import guess_language
    d = spread(load(spark, sf, "documents").select("lang", "text")).select("lang", guess_language(F.col("text")).alias("guess"))
    return d.groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n"))


# ---- training pairs ------------------------------------------------------------------------------------------
@query("J3_ner_pairs", f"""WITH {SEG}, {ENTS}, pn AS (SELECT call_id, segment_id, 'IN_PAN' AS t, unnest(list_distinct(regexp_extract_all(text, '\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b'))) AS v FROM seg),
a AS (SELECT call_id, segment_id, entity_type AS t, value AS v, raw_text AS r FROM ents UNION ALL SELECT call_id, segment_id, t, v, v FROM pn),
p AS (SELECT a.call_id, a.segment_id, t || ':' || v || ':' || CASE WHEN r <> '' AND contains(trim(text, ' '), r) THEN (strpos(trim(text, ' '), r) - 1) || '-' || (strpos(trim(text, ' '), r) - 1 + length(r)) ELSE 'none' END AS x, trim(text, ' ') AS text FROM a JOIN seg s ON s.call_id = a.call_id AND s.segment_id = a.segment_id)
SELECT call_id, segment_id, text, string_agg(x, ' ; ' ORDER BY x) AS entities FROM p GROUP BY 1, 2, 3""")
def j3(spark, sf):
    seg = settle(segments(spark, sf))
    e = ent.entities(seg, ["call_id", "segment_id"], F.col("lang")).select("call_id", "segment_id", F.col("entity_type").alias("t"), F.col("value").alias("v"), F.col("raw_text").alias("r"))
    pan = seg.select("call_id", "segment_id", F.lit("IN_PAN").alias("t"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"), F.lit(0)))).alias("v")).withColumn("r", F.col("v"))
    lists = e.unionByName(pan).groupBy("call_id", "segment_id").agg(F.collect_list(F.struct("t", "v", "r")).alias("es"))
    j = seg.select("call_id", "segment_id", F.trim("text").alias("text")).join(lists, ["call_id", "segment_id"])

    def at(x):
        p = F.position(x["r"], F.col("text")) - 1
        where = F.when((x["r"] != "") & (p >= 0), F.concat(p.cast("string"), F.lit("-"), (p + F.length(x["r"])).cast("string"))).otherwise("none")
        return F.concat(x["t"], F.lit(":"), x["v"], F.lit(":"), where)
    return j.select("call_id", "segment_id", "text", F.array_join(F.sort_array(F.transform("es", at)), " ; ").alias("entities"))


@query("J4_sentiment_pairs", f"""WITH {SEG}, {SEN}, z AS (SELECT *, CASE label WHEN 'positive' THEN score_m WHEN 'negative' THEN -score_m ELSE greatest(20, CAST(floor((1000 - score_m) * 0.3e0 + 0.5) AS BIGINT)) END AS m FROM s_label)
SELECT call_id, segment_id, trim(text, ' ') AS text, speaker, m AS score_m, CASE WHEN m > 150 THEN 'positive' WHEN m < -150 THEN 'negative' ELSE 'neutral' END AS label FROM z WHERE length(trim(text, ' ')) >= 5 AND m <> 0""")
def j4(spark, sf):
    """Turn joined to the k-th score of its role's trajectory, k counted inside the role."""
    seg = settle(with_sentiment(segments(spark, sf)))
    traj = emo.trajectory(emo.signed_scores(seg.select("call_id", "chunk", "segment_id", "speaker", "label", "score_m")), ["segment_id"]).select("call_id", "role", "ordinal", "signed_m")
    ord_ = emo.trajectory(emo.signed_scores(seg.select("call_id", "chunk", "segment_id", "speaker", "text", "label", "score_m")), ["segment_id"])
    mine = ord_.where(F.col("role") == F.when(F.col("speaker") == "agent", "agent").otherwise("customer")).select("call_id", "role", "ordinal", "segment_id", "speaker", F.trim("text").alias("text"))
    s = F.col("signed_m")
    j = mine.where(F.length("text") >= 5).join(traj, ["call_id", "role", "ordinal"]).where(s != 0)
    return j.select("call_id", "segment_id", "text", "speaker", s.alias("score_m"), F.when(s > 150, "positive").when(s < -150, "negative").otherwise("neutral").alias("label"))


# ---- names ---------------------------------------------------------------------------------------------------
NAMED = "seg AS (SELECT * REPLACE (CASE WHEN (conv_id * 3 + turn) % 8 = 1 THEN 'this is Asha Rao here. ' || text WHEN (conv_id * 3 + turn) % 8 = 5 THEN 'Thanks, Monday. welcome Meera Iyer ' || text ELSE text END AS text) FROM seg0)"


def named_turns(spark, sf):
    k = (F.col("conv_id") * 3 + F.col("turn")) % 8
    return segments(spark, sf).withColumn("text", F.when(k == 1, F.concat(F.lit("this is Asha Rao here. "), "text")).when(k == 5, F.concat(F.lit("Thanks, Monday. welcome Meera Iyer "), "text")).otherwise(F.col("text")))


def _name_parts() -> str:
    out = []
    for kind, pats, _ in names.KINDS:
        for p in pats:
            out.append(f"SELECT call_id, segment_id, speaker, {q(kind)} AS kind, trim(unnest(regexp_extract_all(text, {q(p)}, 1)), ' ') AS name FROM seg")
    return " UNION ALL ".join(out)


NAMES = f"""{seg_cte(True).replace('seg AS (', 'seg0 AS (')}, {NAMED}, nm0 AS ({_name_parts()}), nm AS (SELECT * FROM nm0 WHERE length(name) > 2 AND regexp_extract(name, '^[A-Za-z]+') NOT IN {inlist(seeds.SKIP_NAMES)})"""
EVID = f"""{NAMES}, ev AS (SELECT n.call_id, n.segment_id, kind, name, CASE kind WHEN 'self' THEN n.speaker WHEN 'handoff' THEN (SELECT arg_min(s.speaker, s.segment_id) FROM seg s WHERE s.call_id = n.call_id AND s.segment_id BETWEEN n.segment_id + 1 AND n.segment_id + 4 AND s.speaker <> n.speaker)
 ELSE (SELECT arg_max(s.speaker, s.segment_id) FROM seg s WHERE s.call_id = n.call_id AND s.segment_id BETWEEN n.segment_id - 4 AND n.segment_id - 1 AND s.speaker <> n.speaker) END AS owner, CASE kind WHEN 'address' THEN 1 ELSE 2 END AS weight FROM nm n)"""


@query("X14_name_capture", f"WITH {NAMES} SELECT call_id, segment_id, kind, name FROM nm")
def x14(spark, sf):
    return named_turns(spark, sf).select("call_id", "segment_id", F.explode(names.captured(F.col("text"))).alias("c")).select("call_id", "segment_id", "c.kind", "c.name")


@query("J10_handoff_next_speaker", f"WITH {EVID} SELECT call_id, segment_id, name, owner FROM ev WHERE kind = 'handoff'")
def j10(spark, sf):
    return names.evidence(named_turns(spark, sf)).where("kind = 'handoff'").select("call_id", "segment_id", "name", "owner")


@query("J11_thanks_previous_speaker", f"WITH {EVID} SELECT call_id, segment_id, name, owner FROM ev WHERE kind = 'address'")
def j11(spark, sf):
    return names.evidence(named_turns(spark, sf)).where("kind = 'address'").select("call_id", "segment_id", "name", "owner")


@query("A47_name_voting", f"""WITH {EVID}, v AS (SELECT call_id, owner, name, CAST(sum(weight) AS BIGINT) AS votes FROM ev WHERE owner IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, owner ORDER BY votes DESC, name) AS k FROM v) WHERE k = 1 AND votes >= 2)
SELECT call_id, owner AS speaker, name AS speaker_name, votes FROM (SELECT *, row_number() OVER (PARTITION BY call_id, name ORDER BY votes DESC, owner) AS u FROM b) WHERE u = 1""")
def a47(spark, sf):
    return names.vote(names.evidence(named_turns(spark, sf)))


# ---- retrieval -------------------------------------------------------------------------------------------------
NEAREST = """WITH qs AS (SELECT label, min(vec_id) AS q_id FROM embeddings GROUP BY 1), qv AS (SELECT e.label, q_id, embedding AS qe FROM qs JOIN embeddings e ON e.vec_id = q_id),
s AS (SELECT qv.label, q_id, v.vec_id, floor(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[])))) * 1000000e0 + 0.5e0) / 1000000e0 AS sim FROM embeddings v JOIN qv ON v.vec_id <> q_id)
SELECT label, q_id, vec_id, sim, rn FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS rn FROM s) WHERE rn <= 5"""


def _questions(v):
    return v.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q")).select("label", F.col("q.vec_id").alias("q_id"), F.col("q.embedding").alias("q"))


@query("M10_similar_digests", NEAREST)
def m10(spark, sf):
    v = load(spark, sf, "embeddings")
    return mining.top_similar(v, _questions(v))


@query("M10_indexed_digests", NEAREST)
def m10_indexed(spark, sf):
    v = load(spark, sf, "embeddings")
    return mining.top_indexed(*mining.vector_index(v), _questions(v))
