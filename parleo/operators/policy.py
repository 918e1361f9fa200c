"""Policies on model outputs and on text that models are not asked about."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleo.functions.columns import any_contains, let, n_words
from parleo.operators.turns import is_agent
from parleo.plans.skew import dim, salted_join
from parleo.sources import seeds

VALID_INTENTS = ["agreement", "refusal", "request_extension", "payment_promise", "complaint", "consent_given", "consent_denied", "info_request",
                 "negotiation", "escalation", "dispute", "acknowledgment", "greeting", "financial_disclosure", "guidance_forecast", "risk_warning",
                 "question", "explanation", "procedural", "unknown"]
# Hypotheses of the zero-shot model and the signal they stand for.
SCAM_HYPOTHESES = {
    "This is a scam call": "scam_call", "This is social engineering or manipulation": "social_engineering",
    "This is credential phishing for passwords or OTPs": "credential_phishing",
    "This is identity theft collecting personal information": "identity_theft", "This is a legitimate banking interaction": "legitimate"}
TOXIC = [("toxicity", 700), ("threat", 500), ("severe_toxicity", 300), ("obscene", 700), ("insult", 700), ("identity_attack", 700), ("sexual_explicit", 700)]


def toxicity_flags(s: DataFrame) -> DataFrame:
    """Seven scores in thousandths to categories and severity; agents are judged harder."""
    cats = F.array_compact(F.array(*[F.when(F.col(c) >= t, F.lit(c)) for c, t in TOXIC]))
    agent = F.lower("speaker").isin("agent", "speaker_00")
    mx = F.col("toxicity")
    sev = (F.when((F.col("severe_toxicity") >= 500) | (F.col("threat") >= 800), "critical").when((mx >= 900) | (agent & (mx >= 700)), "high")
           .when(mx >= 700, "medium").otherwise("low"))
    return s.withColumn("cats", cats).where(F.size("cats") > 0).withColumns({
        "categories": F.array_join("cats", ","), "severity": sev, "is_agent": agent}).drop("cats")


def abuse_flags(s: DataFrame, threshold_m: int = 600) -> DataFrame:
    """Abusive labels above the threshold, plus 'not abusive' labels the model is unsure about."""
    l = F.lower("label")
    bad = (l.contains("abusive") | l.contains("offensive") | l.contains("hate")) & ~l.contains("not")
    unsure = ~bad & (F.col("score_m") < 1000 - threshold_m)
    keep = (bad & (F.col("score_m") >= threshold_m)) | unsure
    f = s.where(keep).withColumns({"flag": F.when(bad, l).otherwise("possibly_abusive"), "flag_m": F.when(bad, F.col("score_m")).otherwise(1000 - F.col("score_m"))})
    agent = is_agent(F.col("speaker"))
    sev = F.when(F.col("flag_m") >= 900, F.when(agent, "critical").otherwise("high")).otherwise(F.when(agent, "high").otherwise("medium"))
    return f.withColumns({"severity": sev, "is_agent": agent})


def overlay_flags(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The second model only where the first one raised nothing."""
    fresh = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.withColumn("model", F.lit("first")).unionByName(fresh.withColumn("model", F.lit("second")))


def scam_hypothesis(scores: dict[str, Column], threshold_m: int = 700) -> Column:
    """Top hypothesis of the row as scam_<type>; null when legitimate or weak."""
    top = F.array_max(F.array(*[F.struct(c.alias("s"), F.lit(-i).alias("i"), F.lit(SCAM_HYPOTHESES[h]).alias("t"))
                                for i, (h, c) in enumerate(scores.items())]))
    return F.when((top["t"] != "legitimate") & (top["s"] >= threshold_m), F.struct(F.concat(F.lit("scam_"), top["t"]).alias("signal_type"), top["s"].alias("score_m")))


def keyword_intent(text: Column, call_type: Column) -> Column:
    """Ordered keyword rules as (intent, confidence); without any hit info_request in general calls, unknown elsewhere."""
    rules = seeds.INTENT_KEYWORDS

    def pair(name: str, conf: float) -> Column:
        return F.struct(F.lit(name).alias("intent"), F.lit(conf).alias("confidence"))

    def first_hit(low: Column) -> Column:
        out = None
        for (name, c), kws in rules.items():
            hit = any_contains(low, kws)
            if name == "question":
                hit = F.rtrim(low).endswith("?")
                for k in kws:
                    hit = hit | low.startswith(k)
            out = F.when(hit, pair(name, float(c))) if out is None else out.when(hit, pair(name, float(c)))
        return out.when(call_type == "general", pair("info_request", 0.50)).otherwise(pair("unknown", 0.30))

    return let(F.lower(F.trim(text)), first_hit)


def short_form(text: Column) -> Column:
    """A turn as it stands in the phrase lists: lower case, without blanks around and full stops at the end."""
    return F.rtrim(F.regexp_replace(F.lower(F.trim(text)), r"\.+$", ""))


def phrase_flags(turns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``is_trivial`` and ``is_greeting``: whether the whole turn is such a phrase of its language; ``lang_known``: whether the language lists any trivial phrase."""
    v = vocabulary.where(F.col("domain").isin("trivial", "greeting"))
    listed = v.groupBy(F.col("lang").alias("_l"), F.lower(F.trim("phrase")).alias("_p")).agg(
        F.bool_or(F.col("domain") == "trivial").alias("is_trivial"), F.bool_or(F.col("domain") == "greeting").alias("is_greeting"))
    known = v.where("domain = 'trivial'").select(F.col("lang").alias("_l"), F.lit(True).alias("lang_known")).distinct()
    x = turns.withColumns({"_l": F.col("lang"), "_p": short_form(F.col("text"))})
    for side, on in ((listed, ["_l", "_p"]), (known, ["_l"])):
        d, small = dim(side)
        x = x.join(d, on, "left") if small else salted_join(x, d, on, [c for c in turns.columns], how="left")
    return x.drop("_l", "_p").fillna(False, ["is_trivial", "is_greeting", "lang_known"])


def route(text: Column, lang: Column, label: Column, score_m: Column, trivial: Column | None = None, known: Column | None = None) -> Column:
    """skip, negative_subset or full: which turns need the expensive model.

    ``trivial`` and ``known`` come from ``phrase_flags``; without them the English list counts.
    """
    n = n_words(text)
    trivial = short_form(text).isin(*[p for _, p in seeds.entries(seeds.TRIVIAL_EN)]) & (lang == "en") if trivial is None else trivial
    known = lang == "en" if known is None else known | (lang == "en")
    return (F.when((n <= 3) & known & trivial, "skip").when((n <= 2) & ~known, "skip")
            .when((label == "negative") & (score_m > 850), "negative_subset")
            .when((label == "neutral") & (score_m > 900) & (n <= 5), "skip").otherwise("full"))


def assemble_intents(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """Routed-away turns by phrase list, valid model labels as they are, everything else by keywords.

    Greetings are those of ``phrase_flags`` where the turns carry them, else the English list.
    """
    greet = F.col("is_greeting") if "is_greeting" in turns.columns else short_form(F.col("text")).isin(*[p for _, p in seeds.entries(seeds.GREETINGS_EN)])
    j = turns.where(F.trim("text") != "").join(labels, ["call_id", "segment_id"], "left")
    raw = F.regexp_replace(F.lower(F.trim("model_label")), " ", "_")
    valid = F.when(raw.isin(*VALID_INTENTS), raw).when(raw.isNotNull(), "unknown")
    mc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("model_conf", F.lit(0.70))))

    def decide(k: Column) -> Column:
        use_kw = valid.isNull() | ((valid == "unknown") & (k["intent"] != "unknown"))
        return F.when(use_kw, k).otherwise(F.struct(valid.alias("intent"), mc.alias("confidence")))
    skipped = F.struct(F.when(greet, "greeting").otherwise("acknowledgment").alias("intent"), F.lit(0.90).alias("confidence"))
    got = F.when(F.col("route") == "skip", skipped).otherwise(let(keyword_intent(F.col("text"), F.col("call_type")), decide))
    return j.withColumn("_i", got).withColumns({"intent": F.col("_i.intent"), "confidence": F.col("_i.confidence")}).drop("_i")


Scorer = Callable[[Iterator["pandas.DataFrame"]], Iterator["pandas.DataFrame"]]  # noqa: F821


def lexicon_scorer(batches):
    """Default scorer: label and score from the two word lists; a model goes in its place."""
    pos, neg = set(seeds.POSITIVE), set(seeds.NEGATIVE)
    for pdf in batches:
        toks = [set(t.lower().split()) for t in pdf["text"].fillna("")]
        p = [len(t & pos) for t in toks]
        n = [len(t & neg) for t in toks]
        pdf["label"] = ["neutral" if a == b else "positive" if a > b else "negative" for a, b in zip(p, n)]
        pdf["score"] = [0.5 if a + b == 0 else max(a, b) / (a + b) for a, b in zip(p, n)]
        yield pdf


def score_texts(rows: DataFrame, ids: list[str], score_fn: Scorer = lexicon_scorer, max_chars: int | None = None) -> DataFrame:
    """Batched scoring with Arrow; filter rows before, since no filter moves through Python.

    ``max_chars`` is for models with an input limit; the default reads whole texts.
    """
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    src = rows.select(*ids, text.alias("text"))
    schema = T.StructType([*src.schema.fields, T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInPandas(score_fn, schema).drop("text")


def parse_reply_lines(replies: DataFrame, ids: list[str]) -> DataFrame:
    """Lines ``IDX|intent|conf``, ``ENTITY|type|value|raw`` and ``OBLIGATION|who|strength|text``; bad lines vanish."""
    line = F.explode(F.split("raw", "\n"))
    x = replies.select(*ids, line.alias("l0")).withColumn("line", F.trim(F.regexp_replace(F.trim("l0"), r"^[-*\s]+|[-*\s]+$", "")))
    f = F.split("line", r"\|")
    f4 = F.split(F.trim("l0"), r"\|", 4)
    x = x.withColumns({"f": f, "f4": f4})
    idx = F.expr("try_cast(trim(f[0]) as int)")
    conf = F.expr("try_cast(trim(try_element_at(f, 3)) as double)")
    name = F.regexp_replace(F.lower(F.trim(F.try_element_at("f", F.lit(2)))), " ", "_")
    kind = (F.when(F.trim("l0").startswith("ENTITY|") & (F.size("f4") >= 4), "entity").when(F.trim("l0").startswith("OBLIGATION|") & (F.size("f4") >= 4), "obligation")
            .when((F.size("f") >= 2) & idx.isNotNull() & (idx >= 0), "intent"))
    x = x.withColumns({"kind": kind, "idx": idx, "conf": conf, "nm": name}).where(F.col("kind").isNotNull())
    is_int = F.col("kind") == "intent"
    return x.select(*ids, "kind", F.when(is_int, F.col("idx")).cast("bigint").alias("idx"),
                    F.when(is_int, F.when(F.col("nm").isin(*VALID_INTENTS), F.col("nm")).otherwise("unknown")).otherwise(F.trim(F.try_element_at("f4", F.lit(2)))).alias("label"),
                    F.when(~is_int, F.trim(F.try_element_at("f4", F.lit(3)))).alias("value"), F.when(~is_int, F.trim(F.try_element_at("f4", F.lit(4)))).alias("text"),
                    F.when(is_int, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("conf", F.lit(0.70))))).when(F.col("kind") == "entity", 0.7).alias("confidence"))


# Text a model copied from its template.
TEMPLATE_MARKERS = ["[2-3 sentence", "[outcome", "[action", "[summary", "write a concise", "replace each description", "first key outcome",
                    "first follow-up action", "second key outcome", "third key outcome", "second follow-up", "<your ", "<outcome", "<action",
                    "key outcome was", "follow-up action needed", "[write ", "[first ", "[second ", "[third ", "specific finding", "concrete next step"]


def summary_sections(replies: DataFrame, ids: list[str]) -> DataFrame:
    """Summary, outcomes and actions of a reply, line by line, inside the row.

    The section heading is carried along the lines of one reply by a fold, so a
    reply never leaves its row.
    """
    fold = r"""aggregate(filter(transform(split(raw, '\n'), x -> trim(x)), x -> x <> ''),
      named_struct('sec', '', 'summary', '', 'outcomes', cast(array() as array<string>), 'actions', cast(array() as array<string>)),
      (a, l) -> CASE
        WHEN lower(l) LIKE 'summary:%' OR lower(l) LIKE '**summary%' THEN named_struct('sec', 'summary', 'summary', trim(BOTH '*' FROM trim(substring(l, instr(l, ':') + 1))), 'outcomes', a.outcomes, 'actions', a.actions)
        WHEN lower(l) LIKE 'outcomes:%' OR lower(l) LIKE '**outcomes%' OR lower(l) LIKE 'key outcomes%' THEN named_struct('sec', 'outcomes', 'summary', a.summary, 'outcomes', a.outcomes, 'actions', a.actions)
        WHEN lower(l) LIKE 'actions:%' OR lower(l) LIKE '**actions%' OR lower(l) LIKE 'next actions%' THEN named_struct('sec', 'actions', 'summary', a.summary, 'outcomes', a.outcomes, 'actions', a.actions)
        WHEN l LIKE '- %' OR l LIKE '* %' THEN named_struct('sec', a.sec, 'summary', a.summary,
          'outcomes', CASE WHEN a.sec = 'outcomes' THEN concat(a.outcomes, array(trim(regexp_replace(l, '^[-*0-9.) ]+', '')))) ELSE a.outcomes END,
          'actions', CASE WHEN a.sec = 'actions' THEN concat(a.actions, array(trim(regexp_replace(l, '^[-*0-9.) ]+', '')))) ELSE a.actions END)
        WHEN a.sec = 'summary' THEN named_struct('sec', a.sec, 'summary', trim(concat(a.summary, ' ', trim(BOTH '*' FROM l))), 'outcomes', a.outcomes, 'actions', a.actions)
        ELSE a END)"""
    x = replies.withColumn("_s", F.expr(fold))

    def good(items):
        tidy = F.transform(items, lambda s: F.trim(F.regexp_replace(s, r"(?i)^\[?(Outcome|Action|Step|Item)\s*\d*\]?:?\s*", "")))
        return F.filter(tidy, lambda s: (s != "") & ~any_contains(F.lower(s), TEMPLATE_MARKERS))

    bad_summary = any_contains(F.lower("_s.summary"), TEMPLATE_MARKERS)
    return x.select(*ids, F.when((F.col("_s.summary") == "") | bad_summary, "Call processed — see extracted fields.").otherwise(F.col("_s.summary")).alias("summary"),
                    F.array_join(good(F.col("_s.outcomes")), " ; ").alias("outcomes"), F.array_join(good(F.col("_s.actions")), " ; ").alias("actions"))
