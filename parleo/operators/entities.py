"""Entities, identifiers and personal data found by patterns; merging, masking and mark-up.

Everything found in a text belongs to that row, so extraction, first-wins
de-duplication, overlap resolution and masking are array expressions inside the
row: no shuffle, and no group that could grow with the data.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleo.functions.columns import explode_once, half_up, let, words
from parleo.plans.skew import dim, salted_join
from parleo.plans.stage import settle
from parleo.sources import seeds, vocab

# Currency patterns with the word that scales them.
SYMBOL_MONEY = [
    (r"(?i)(?:₹|(?<![A-Za-z0-9])Rs\.?\s*|(?<![A-Za-z0-9])INR\s*)(\d+(?:,\d{2,3})*(?:\.\d{1,2})?)(?!\d|[-/])\s*(crore|lakh|thousand|million|billion|cr|mn|bn|[mbk]\b)?", "INR"),
    (r"(?i)(?:\$|(?<![A-Za-z0-9])USD\s*)(\d+(?:,\d{2,3})*(?:\.\d{1,2})?)(?!\d|[-/])\s*(million|billion|thousand|mn|bn|[mbk]\b)?", "USD"),
    (r"(?i)(?:€|(?<![A-Za-z0-9])EUR\s*)(\d+(?:,\d{2,3})*(?:\.\d{1,2})?)(?!\d|[-/])\s*(million|billion|thousand|mn|bn|[mbk]\b)?", "EUR"),
]
MAGNITUDE = {"million": 1e6, "mn": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "thousand": 1e3, "k": 1e3,
             "crore": 1e7, "cr": 1e7, "lakh": 1e5}
# Units that scale an amount, with their currency.
UNITS = {"INR_LAKH": ("INR", 1e5), "INR_CRORE": ("INR", 1e7), "INR_THOUSAND": ("INR", 1e3)}
# Patterns of a number beside a currency or unit word, and of dates; %s stands for the words of a language.
PLAIN_MONEY = r"(?i)(\d{1,3}(?:,\d{2,3})*)\s*(%s)"
SCALED_MONEY = r"(?i)(\d+(?:\.\d+)?)\s*(%s)"
NUMERIC_DATE = r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})\b"
WORD_DATES = {"month": r"(?:%s)\s+\d{1,2}(?:,?\s*\d{4})?", "next_day": r"next\s+(?:%s)", "this_day": r"this\s+(?:%s)", "relative": r"(?:by\s+)?(?:%s)"}
DATE_LISTS = {"month": "months", "next_day": "days", "this_day": "days", "relative": "relative"}
#: A date word stands alone: no letter, mark, digit or underscore beside it, in any script.
ALONE = r"(?i)(?<![\p{L}\p{M}\p{N}_])(%s)(?![\p{L}\p{M}\p{N}_])"
# Identifier and term patterns.
ID_PATTERNS = [(r"\b(\d{10,16})\b", "account_number"), (r"(?i)\b([A-Z]{5}\d{4}[A-Z])\b", "pan_number"),
               (r"(?i)\b([A-Z]{4}0\d{6})\b", "ifsc_code"),
               (r"(?i)(?:ref(?:erence)?|ticket|case|complaint)\s*(?:#|no\.?|number)?\s*:?\s*([A-Z0-9\-]{6,20}(?=[A-Z])(?=.*\d))", "reference_number")]
TERM_PATTERNS = [(r"(?i)\b(\d+(?:\.\d+)?)\s*(?:%|percent|per\s*cent)", "interest_rate"),
                 (r"(?i)\bemi\s*(?:of|is|was|amount)?\s*(?:₹|Rs\.?\s*)?(\d{1,3}(?:,\d{2,3})*)", "emi_amount"),
                 (r"(?i)\bloan\s*(?:of|amount|is|was)?\s*(?:₹|Rs\.?\s*)?(\d{1,3}(?:,\d{2,3})*)", "loan_amount"),
                 (r"(?i)\b(\d+)\s*(?:months?|yrs?|years?)\s*(?:tenure|term|period)", "tenure")]


def _item(etype: Column | str, value: Column, raw: Column, conf: float) -> Column:
    t = F.lit(etype) if isinstance(etype, str) else etype
    return F.struct(t.alias("entity_type"), value.alias("value"), F.trim(raw).alias("raw_text"), F.lit(conf).alias("confidence"))


def _found(text: Column, pattern: str, make) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), make)


LEXICON = ["plain", "scaled", *WORD_DATES]


def lexicon(vocabulary: DataFrame) -> DataFrame:
    """One row per language: patterns made of its currency and date words (null where it has none) and its words with their units.

    Any vocabulary table will do; what is listed per language is a dictionary, not data.
    """
    word = F.regexp_replace(F.regexp_replace(F.lower("phrase"), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), " ", r"\\s+")
    v = vocabulary.where(F.col("domain").isin("currency", "date") & (F.trim("phrase") != "")).withColumn("_w", word)
    money, scaled = F.col("domain") == "currency", F.col("category").isin(*UNITS)

    def words_of(cond: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "_w"))))
        return F.nullif(F.array_join(F.transform(listed, lambda x: x["_w"]), "|"), F.lit(""))

    units = F.array_sort(F.collect_list(F.when(money, F.struct("rank", F.lower("phrase").alias("word"), F.col("category").alias("unit")))))
    lists = {"plain": words_of(money & ~scaled), "scaled": words_of(money & scaled)} | {k: words_of((F.col("domain") == "date") & (F.col("category") == c)) for k, c in DATE_LISTS.items()}
    frames = {"plain": PLAIN_MONEY, "scaled": SCALED_MONEY} | {k: ALONE % p for k, p in WORD_DATES.items()}

    def framed(k: str) -> Column:
        head, tail = frames[k].split("%s")
        return F.concat(F.lit(head), F.col(k), F.lit(tail))
    return v.groupBy("lang").agg(units.alias("units"), *[c.alias(k) for k, c in lists.items()]).select("lang", "units", *[framed(k).alias(k) for k in lists])


def with_lexicon(rows: DataFrame, lang: Column, lex: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows with the patterns of their language, and those of English, which apply to every language.

    The table has one row per language; it is broadcast after it was counted to be small.
    """
    own, small = dim(lex.where("lang <> 'en'").select(F.col("lang").alias("_lang"), F.struct("units", *LEXICON).alias("_own")))
    x = rows.withColumn("_lang", lang)
    x = x.join(own, "_lang", "left") if small else salted_join(x, own, ["_lang"], rows.columns, how="left")
    english = lex.where("lang = 'en'").groupBy().agg(F.first(F.struct("units", *LEXICON)).alias("s")).scalar()
    return x.withColumn("_en", english), F.col("_own"), F.col("_en")


def money_items(text: Column, own: Column, english: Column) -> Column:
    """Amounts by symbol, then by the words of the turn's language, then by English ones; units scale every match."""
    def number(raw: Column, p: str) -> Column:
        return F.regexp_replace(F.regexp_extract(raw, p, 1), ",", "").cast("double")

    def shown(v: Column, cur: Column) -> Column:
        # beyond 2^53 the formatter would pad the shortest digits with zeros; split the double exactly instead
        high = F.floor(v / float(1 << 40))
        exact = high.cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(15,0)") + (v - high * float(1 << 40)).cast("decimal(20,0)")
        return F.when(v < 1e15, F.format_string("%.2f %s", v, cur)).otherwise(F.concat(exact.cast("string"), F.lit(".00 "), cur))

    def symbol(p: str, cur: str) -> Column:
        def make(raw):
            mag = F.lower(F.regexp_extract(raw, p, 2))
            k = reduce(lambda e, m: e.when(mag == m[0], m[1]), list(MAGNITUDE.items())[1:], F.when(mag == "million", 1e6)).otherwise(1.0)
            return _item("payment_amount", shown(number(raw, p) * k, F.lit(cur)), raw, 0.95)
        return _found(text, p, make)

    def worded(lex: Column, k: str) -> Column:
        def make(raw):
            said = F.lower(F.regexp_replace(F.regexp_replace(raw, r"^[0-9.,]+\s*", ""), r"\s+", " "))
            unit = F.get(F.filter(lex["units"], lambda u: u["word"] == said), F.lit(0))["unit"]
            factor = reduce(lambda e, u: e.when(unit == u[0], u[1][1]), UNITS.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
            currency = reduce(lambda e, u: e.when(unit == u[0], u[1][0]), UNITS.items(), F.when(F.lit(False), "")).otherwise(unit)
            amount = F.regexp_replace(F.regexp_extract(raw, r"^[0-9.,]+", 0), ",", "").cast("double")
            return _item("payment_amount", shown(amount * factor, currency), raw, 0.95)
        return F.transform(F.regexp_extract_all(text, lex[k], F.lit(0)), make)

    parts = [symbol(*s) for s in SYMBOL_MONEY] + [worded(x, k) for x in (own, english) for k in ("plain", "scaled")]
    return F.flatten(F.array_compact(F.array(*parts)))


def _by_pattern(text: Column, patterns, conf: float, strip: bool = False) -> Column:
    def one(p, t):
        def make(raw):
            v = F.regexp_extract(raw, p, 1)
            return _item(t, F.regexp_replace(v, ",", "") if strip else v, raw, conf)
        return _found(text, p, make)
    return F.flatten(F.array(*[one(p, t) for p, t in patterns]))


def date_items(text: Column, own: Column, english: Column) -> Column:
    """Numeric dates, then by the words of the turn's language; of English ones beside another language only months and next days."""
    def worded(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, p, F.lit(1)), lambda v: _item("due_date", v, v, 0.90))

    own_parts = [worded(own[k]) for k in WORD_DATES]
    en_parts = [worded(english[k]) if k in ("month", "next_day") else F.when(own.isNull(), worded(english[k])) for k in WORD_DATES]
    return F.flatten(F.array_compact(F.array(_by_pattern(text, [(NUMERIC_DATE, "due_date")], 0.90), *own_parts, *en_parts)))


def reference_items(text: Column) -> Column:
    """Reference numbers; the pattern looks beyond its match, so the whole text is searched for match and number alike."""
    p, t = ID_PATTERNS[3]
    numbers = F.regexp_extract_all(text, F.lit(p), F.lit(1))
    return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m, i: _item(t, F.get(numbers, i), m, 0.90))


def id_items(text: Column) -> Column:
    return F.concat(_by_pattern(text, ID_PATTERNS[:3], 0.90), reference_items(text))


def term_items(text: Column) -> Column:
    return _by_pattern(text, TERM_PATTERNS, 0.85, strip=True)


def keep_first(items: Column, *fields: str) -> Column:
    """Drop later items that repeat an earlier one in the given fields."""
    def key(s):
        return F.concat_ws("\u0001", *[s[f] for f in fields])
    keys = F.transform(items, key)
    return F.filter(items, lambda s, i: F.array_position(keys, key(s)) == i + 1)


def entities(rows: DataFrame, ids: Sequence[str], lang: Column | None = None, kinds: Sequence[str] = ("money", "date", "id", "term"), lex: DataFrame | None = None) -> DataFrame:
    """Pattern entities of each text, first occurrence of a (type, value) only: one row each.

    ``lex`` is the ``lexicon`` of a vocabulary table, the built-in one by
    default.  Texts without a digit skip every pattern that needs one.
    """
    rows, found = entity_arrays(rows, lang, kinds, lex)
    return explode_once(rows, ids, found, "e", "item").select(*ids, "item", "e.entity_type", "e.value", "e.raw_text", "e.confidence")


def entity_arrays(rows: DataFrame, lang: Column | None = None, kinds: Sequence[str] = ("money", "date", "id", "term"), lex: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """The rows with what the column of their entities needs, and that column: for counts that never leave the row."""
    t = F.coalesce("text", F.lit(""))
    lex = lexicon(vocab.seed_vocab(rows.sparkSession)) if lex is None else lex
    rows, own, english = with_lexicon(rows, lang if lang is not None else F.lit("en"), lex) if {"money", "date"} & set(kinds) else (rows, F.lit(None), F.lit(None))
    empty = F.array().cast("array<struct<entity_type:string,value:string,raw_text:string,confidence:double>>")
    digit = t.rlike("[0-9]")
    parts = {"money": (lambda: F.when(digit, money_items(t, own, english))), "date": (lambda: date_items(t, own, english)), "id": (lambda: F.when(digit, id_items(t))), "term": (lambda: F.when(digit, term_items(t)))}
    both = F.concat(*[F.coalesce(parts[k](), empty) for k in kinds])
    found = let(both, lambda items: keep_first(items, "entity_type", "value"))
    return rows, found


def merge_layers(*layers: DataFrame) -> DataFrame:
    """First layer whole; of each later layer the first row of keys no earlier layer has."""
    keys = ["call_id", "segment_id", "entity_type"]
    cols = [*keys, "item", "value", "raw_text", "confidence", "source"]
    merged = settle(layers[0].select(*cols))  # far smaller than the texts it came from, and read by every layer
    for nxt in layers[1:]:
        fresh = nxt.join(merged.select(*keys).distinct(), keys, "left_anti")
        first = fresh.groupBy(*keys).agg(F.min_by(F.struct("item", "value", "raw_text", "confidence", "source"), "item").alias("s"))
        merged = merged.unionByName(first.select(*keys, "s.item", "s.value", "s.raw_text", "s.confidence", "s.source"))
    return merged


def drop_noise(ent: DataFrame) -> DataFrame:
    """One-digit references, acronyms posing as organisations, vague dates."""
    raw, low = F.trim("raw_text"), F.lower(F.trim("raw_text"))
    t = F.col("entity_type")
    bad = ((t == "reference_number") & raw.rlike("^[0-9]$")) | ((t == "organization") & F.upper(raw).isin(*seeds.NOT_ORGANISATIONS)) | (
        t.isin("due_date", "date") & (low.isin(*seeds.VAGUE_DATES) | low.endswith("ago") | low.rlike("^[0-9]+$")))
    return ent.where(~bad)


# ---- personal data --------------------------------------------------------------------

MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
# Recognisers as (type, pattern, base score, single context words).
RECOGNISERS = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0, "email mail"),
    ("IP_ADDRESS", r"\b(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\b", 0.6, "ip"),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0.5, "iban bank transaction"),
    ("PHONE_NUMBER", r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b", 0.75, "phone number telephone cell mobile call"),
    ("IN_AADHAAR", r"\b[0-9]{4}\s[0-9]{4}\s[0-9]{4}\b", 0.7, "aadhaar aadhar uid uidai identity verification"),
    ("IN_AADHAAR", r"\b[0-9]{12}\b", 0.5, "aadhaar aadhar uid uidai identity verification"),
    ("IN_PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.85, "pan tax"),
    ("IN_PHONE", r"\+91[\s-]?[6-9][0-9]{4}[\s-]?[0-9]{5}", 0.85, "phone mobile call number contact whatsapp"),
    ("IN_PHONE", r"\b[6-9][0-9]{9}\b", 0.6, "phone mobile call number contact whatsapp"),
    ("IN_UPI_ID", r"\b[A-Za-z0-9_.]+@(?:ybl|okhdfcbank|okicici|oksbi|paytm|apl|ibl|axl|upi|phonepe|gpay)\b", 0.9, "upi payment pay transfer gpay phonepe paytm"),
    ("IN_IFSC", r"\b[A-Z]{4}0[0-9]{6}\b", 0.9, "ifsc branch bank transfer neft rtgs imps"),
    ("IN_BANK_ACCOUNT", r"\b[0-9]{9,18}\b", 0.3, "account a/c savings current bank deposit credit debit"),
    ("CREDIT_CARD", r"\b[0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4}\b", 0.8, "card credit debit visa mastercard rupay cvv expiry"),
    ("CREDIT_CARD", r"\b[0-9]{16}\b", 0.4, "card credit debit visa mastercard rupay cvv expiry"),
    ("DATE_TIME", rf"\b(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-](?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{4}}[/.-][0-9]{{1,2}}[/.-][0-9]{{1,2}}|[0-9]{{1,2}}[ -](?i:{MONTHS})[a-z]*,?[ -][0-9]{{4}})\b", 0.6, "date birthday birth dob"),
]
# Types that need a higher score than the threshold; a bare date is seldom personal.
HIGHER = {"DATE_TIME": 0.7}
CONTEXT_GAIN, CONTEXT_FLOOR = 0.35, 0.4


def verhoeff_tables() -> tuple[str, str]:
    """Multiplication of the dihedral group of ten and the powers of its permutation, as digit strings."""
    def mul(j: int, k: int) -> int:
        if j < 5:
            return (j + k) % 5 if k < 5 else 5 + (j + k) % 5
        return 5 + (j - k) % 5 if k < 5 else (j - k) % 5
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows, cur = [], list(range(10))
    for _ in range(8):
        rows.append(cur)
        cur = [step[x] for x in cur]
    return "".join(str(mul(j, k)) for j in range(10) for k in range(10)), "".join(str(x) for r in rows for x in r)


def verhoeff_ok(digits: Column) -> Column:
    """Check digit test of a digit string, read from the right."""
    d, p = verhoeff_tables()
    rev = F.reverse(digits)
    step = F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0),
        lambda c, i: F.substring(F.lit(d), c * 10 + F.substring(
            F.lit(p), (i % 8) * 10 + F.substring(rev, i + 1, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int"))
    return F.when(digits.rlike("^[0-9]+$"), step == 0).otherwise(False)


def mask(text: Column, etype: Column) -> Column:
    """Replacement text per type: last four digits, first letter of a mail box, fixed tokens."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    last4 = F.right(digits, F.lit(4))
    four = F.length(digits) >= 4
    at = F.split(text, "@")
    return (F.when(etype == "IN_AADHAAR", F.when(four, F.concat(F.lit("XXXX XXXX "), last4)).otherwise("XXXX XXXX XXXX"))
            .when(etype == "IN_PAN", F.when(F.length(text) == 10, F.concat(F.lit("XXXXX"), F.substring(text, 6, 4), F.lit("X"))).otherwise("XXXXXXXXXX"))
            .when(etype.isin("PHONE_NUMBER", "IN_PHONE"), F.when(four, F.concat(F.lit("XXXXXX"), last4)).otherwise("XXXXXXXXXX"))
            .when(etype == "EMAIL_ADDRESS", F.when(F.size(at) == 2, F.concat(F.substring(at[0], 1, 1), F.lit("***@"), at[1])).otherwise("***@***"))
            .when(etype == "CREDIT_CARD", F.when(four, F.concat(F.lit("XXXX XXXX XXXX "), last4)).otherwise("XXXX XXXX XXXX XXXX"))
            .when(etype == "IN_UPI_ID", F.lit("****@****")).when(etype == "IN_IFSC", F.lit("XXXX0XXXXXX"))
            .when(etype == "IN_BANK_ACCOUNT", F.when(F.length(text) >= 4, F.concat(F.lit("XXXXXX"), F.right(text, F.lit(4)))).otherwise("XXXXXXXXXX"))
            .otherwise(F.concat(F.lit("["), etype, F.lit("]"))))


def _spans(text: Column, n: int, etype: str, pattern: str, score: float, context: str, before: int) -> Column:
    """Matches with exact offsets: the text cut at the matches gives the length in front of each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def make(m, i):
        start = F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(
            F.slice(found, 1, i), F.lit(0), lambda a, g: a + F.length(g))
        lead = words(F.lower(F.substring(text, F.lit(1), start)))
        near = F.slice(lead, F.greatest(F.lit(1), F.size(lead) - before + 1), before)
        said = F.exists(near, lambda w: F.exists(F.array(*[F.lit(c) for c in context.split()]), lambda c: F.contains(w, c)))
        s = F.when(said, F.least(F.lit(1.0), F.greatest(F.lit(score + CONTEXT_GAIN), F.lit(CONTEXT_FLOOR)))).otherwise(F.lit(score))
        return F.struct(start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("end"), F.lit(etype).alias("entity_type"),
                        m.alias("text"), half_up(s, 3).alias("score"), F.lit(n).alias("rank"))

    return F.transform(found, make)


PII_TYPE = "array<struct<start:int,end:int,entity_type:string,text:string,score:double,rank:int>>"


def pii_spans(text: Column, threshold: float = 0.5, before: int = 5) -> Column:
    """All personal data of a text at or above the threshold; first occurrence per type and text."""
    return let(pii_occurrences(text, threshold, before), lambda items: keep_first(items, "entity_type", "text"))


def pii_occurrences(text: Column, threshold: float = 0.5, before: int = 5) -> Column:
    """All personal data of a text at or above the threshold (dates: 0.7 at least, so only with a word of context), each occurrence of it.

    Every recogniser but e-mail and UPI needs a digit, those two an at sign;
    texts without either skip the patterns altogether.
    """
    parts = []
    for n, (t, p, s, c) in enumerate(RECOGNISERS):
        gate = F.contains(text, F.lit("@")) if "@" in p else text.rlike("[0-9]")
        # the match itself is cheap to test; offsets and context are worked out only where it occurs
        parts.append(F.when(gate & text.rlike(p), _spans(text, n, t, p, s, c, before)))
    spans = F.flatten(F.array_compact(F.array(*parts)))
    def needed(etype: Column) -> Column:
        e = F.lit(threshold)
        for t, least in HIGHER.items():
            e = F.when(etype == t, max(threshold, least)).otherwise(e)
        return e
    return F.filter(spans, lambda s: (s["score"] >= needed(s["entity_type"])) & (
        (s["entity_type"] != "IN_AADHAAR") | verhoeff_ok(F.regexp_replace(s["text"], r"\s", ""))))


def pii(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per personal datum with offsets, score and mask."""
    s = explode_once(rows, ids, pii_spans(F.coalesce("text", F.lit(""))), "p")
    return s.select(*ids, "p.entity_type", "p.text", "p.start", "p.end", "p.score", "p.rank").withColumn("masked_text", mask(F.col("text"), F.col("entity_type")))


def clusters(spans: Column) -> Column:
    """Overlapping spans become one span from first start to last end, named after the best member.

    Best is the higher score, then the longer, then the earlier span, so
    masking covers everything that was found.
    """
    typ = "array<struct<start:int,end:int,score:double,len:int,best_start:int,entity_type:string,text:string>>"
    shaped = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), (s["end"] - s["start"]).alias("len"),
        s["start"].alias("best_start"), s["entity_type"].alias("entity_type"), s["text"].alias("text")))

    def step(acc, s):
        last = F.element_at(acc, -1)
        better = (s["score"] > last["score"]) | ((s["score"] == last["score"]) & (s["len"] > last["len"]))
        win = F.when(better, s).otherwise(last)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), win["score"].alias("score"),
                          win["len"].alias("len"), win["best_start"].alias("best_start"), win["entity_type"].alias("entity_type"), win["text"].alias("text"))
        overlap = (F.size(acc) > 0) & (s["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)))
        return F.when(overlap, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    safe = F.array_sort(shaped)
    return F.aggregate(safe, F.array().cast(typ), lambda acc, s: step_or_first(acc, s, step))


def step_or_first(acc: Column, s: Column, step) -> Column:
    return F.when(F.size(acc) == 0, F.concat(acc, F.array(s))).otherwise(step(acc, s))


def mask_positions(text: Column, spans: Column) -> Column:
    """Replace clusters from the right, so that earlier offsets stay valid."""
    return F.aggregate(F.reverse(spans), text, lambda t, c: F.concat(
        F.substring(t, F.lit(1), c["start"]), mask(c["text"], c["entity_type"]), F.substring(t, c["end"] + 1, F.length(t))))


def mask_everywhere(text: Column, spans: Column) -> Column:
    """Replace every occurrence of every found text, in order of detection."""
    return F.aggregate(spans, text, lambda t, p: F.replace(t, p["text"], mask(p["text"], p["entity_type"])))


def mark_up(rows: DataFrame, ent: DataFrame) -> DataFrame:
    """Wrap the first occurrence of each entity's raw text in a tag, entity by entity."""
    lists = ent.groupBy("call_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("item", "entity_type", "raw_text"))).alias("_e"))
    j = rows.join(lists, ["call_id", "segment_id"], "left")

    def step(t, e):
        at = F.position(e["raw_text"], t)
        tag = F.concat(F.lit('<entity type="'), e["entity_type"], F.lit('">'), e["raw_text"], F.lit("</entity>"))
        return F.when((e["raw_text"] != "") & (at > 0), F.concat(
            F.substring(t, F.lit(1), at - 1), tag, F.substring(t, at + F.length(e["raw_text"]), F.length(t)))).otherwise(t)

    return j.withColumn("text", F.when(F.col("_e").isNull(), F.col("text")).otherwise(F.aggregate(F.col("_e"), F.col("text"), step))).drop("_e")


def ner_policy(spans: DataFrame, min_score_m: int = 500) -> DataFrame:
    """Model labels to entity types, weak ones dropped, sub-word marks removed."""
    label = F.regexp_replace("label", "^[BI]-", "")
    t = (F.when(label.isin("PER", "PERSON", "person_name"), "person_name").when(label.isin("ORG", "organization"), "organization")
         .when(label == "MONEY", "payment_amount").when(label == "DATE", "due_date").when(label.isin("LOC", "GPE", "location"), "location")
         .when((label == "CARDINAL") & F.col("word").rlike("[0-9]"), "reference_number"))
    clean = F.trim(F.regexp_replace("word", "##", ""))
    return spans.withColumn("entity_type", t).withColumn("value", clean).where(
        F.col("entity_type").isNotNull() & (F.col("score_m") >= min_score_m) & (F.col("value") != ""))


def correct_terms(text: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Whole-word, case-blind replacement, entry by entry; texts without any entry are left alone."""
    import re
    esc = [(re.escape(w), r) for w, r in table]
    out = text
    for w, r in esc:
        out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])", r)
    some = text.rlike("(?i)(?:" + "|".join(w for w, _ in esc) + ")")
    return F.when(some, out).otherwise(text)


AMOUNT_WORDS = [("thousand", 1000), ("lakh", 100000), ("crore", 10000000), (r"k\b", 1000)]


def amount_metadata(text: Column) -> Column:
    """Numbers with a magnitude word as (raw, value), leaving the text alone."""
    def one(w: str, k: int) -> Column:
        def make(m):
            return F.struct(m.alias("raw"), (F.regexp_extract(m, r"(\d+)", 1).cast("bigint") * k).alias("value"))
        return _found(text, rf"(?i)\d+\s*{w}", make)

    parts = [one(w, k) for w, k in AMOUNT_WORDS]
    return F.flatten(F.array(*parts))


def keyword_sentiment(text: Column) -> Column:
    """(positive - negative) / (positive + negative) over the distinct words, two digits, 0 without any."""
    toks = F.array_distinct(words(F.lower(text)))
    pos = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in seeds.POSITIVE])))
    neg = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in seeds.NEGATIVE])))
    return F.when(pos + neg == 0, 0.0).otherwise(half_up((pos - neg) / (pos + neg), 2))
