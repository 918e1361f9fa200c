"""Registry of queries: a Spark builder and, where SQL can say it, the same question in SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parleo.sources import seeds, tables, vocab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


# ---- SQL fragments shared by the checks -------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def inlist(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def hu(x: str, d: int) -> str:
    k = 10 ** d
    return f"(floor(({x}) * {k}e0 + 0.5e0) / {k}e0)"


def case(col: str, table: dict[str, str], default: str | None = None) -> str:
    body = " ".join(f"WHEN {col} = {q(k)} THEN {v if isinstance(v, (int, float)) else q(v)}" for k, v in table.items())
    return f"CASE {body} {'ELSE ' + q(default) if default is not None else ''} END"


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[\p{{P}}\p{{S}}\s]+', ' ', 'g'))"


def words_sql(x: str) -> str:
    """List of whitespace-separated words."""
    t = rf"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'))"
    return f"(CASE WHEN {t} = '' THEN [] ELSE string_split({t}, ' ') END)"


_SPK = "CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'customer' ELSE 'other' END"


def seg_cte(scripted: bool = True) -> str:
    k = "((conv_id * 31 + turn * 7) % 24)"
    text = "coalesce(text, '')"
    shown = (f"CASE WHEN {k} IN (0, 11) THEN {lst(tables.LINES)}[{k} + 1] ELSE {lst(tables.LINES)}[{k} + 1] || ' ' || {text} END"
             if scripted else text)
    return f"""turns AS (
  SELECT CAST(floor(conv_id / 5) AS BIGINT) AS call_id, conv_id, turn, {_SPK} AS speaker, {shown} AS text,
         CAST(10 + length({text}) % 190 AS BIGINT) AS dur_ds FROM conversations),
seg AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY call_id ORDER BY conv_id, turn) - 1 AS BIGINT) AS segment_id,
         CAST(sum(dur_ds) OVER (PARTITION BY call_id ORDER BY conv_id, turn) AS BIGINT) AS end_ds,
         CAST(sum(dur_ds) OVER (PARTITION BY call_id ORDER BY conv_id, turn) AS BIGINT) - dur_ds AS start_ds,
         ['en', 'hi', 'ta', 'en'][call_id % 4 + 1] AS lang, {lst(tables.CALL_TYPES)}[call_id % 6 + 1] AS call_type
  FROM turns)"""


SEG = seg_cte(True)
SEGRAW = seg_cte(False)
EMO = f"""emo AS (
  SELECT call_id, segment_id, speaker, {lst(tables.EMOTIONS)}[(conv_id * 13 + turn * 5) % 7 + 1] AS emotion,
         CAST((conv_id * 1777 + turn * 911 + length(text) * 37) % 10001 AS BIGINT) AS score_bp, turn FROM seg),
emo2 AS (SELECT *, CASE WHEN turn % 3 = 0 THEN score_bp * 7 % 10001 ELSE score_bp % 3000 END AS fear_bp, score_bp * 3 % 8000 AS surprise_bp FROM emo)"""
FR = """fr AS (
  SELECT event_id, user_id AS call_id, event_type,
         CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 36000000) AS BIGINT) AS t_ms,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS v100 FROM events)"""
EVEMO = FR + f""", ee AS (
  SELECT call_id, event_id, t_ms, {case('event_type', tables.EVENT_EMOTION)} AS emotion,
         CASE WHEN event_id % 2 = 0 THEN 'agent' ELSE 'customer' END AS speaker, least(v100, 10000) AS score_bp FROM fr)"""
EVINT = f"""ei AS (SELECT event_id, user_id AS call_id, {case('event_type', tables.EVENT_INTENT)} AS intent FROM events)"""
EVSEN = FR + """, es AS (
  SELECT call_id, event_id, t_ms, CASE WHEN event_type IN ('click', 'purchase') THEN 'positive'
           WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS label,
         CASE event_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'customer' ELSE 'unknown' END AS speaker,
         CAST(least(floor(v100 / 10), 1000) AS BIGINT) AS score_m FROM fr)"""
CALLS = """calls AS (
  SELECT o_orderkey AS call_id, o_custkey AS customer_id,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'collections' WHEN '2' THEN 'kyc' WHEN '3' THEN 'complaint'
              WHEN '4' THEN 'onboarding' ELSE 'general' END AS call_type,
         CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS dur_cs, o_orderstatus AS status, o_orderdate AS ingested_at
  FROM orders)"""
CHECKS = """checks AS (
  SELECT l_orderkey AS call_id, l_linenumber AS line, l_returnflag <> 'R' AS passed,
         CASE WHEN l_discount >= 0.09e0 THEN 'critical' WHEN l_discount >= 0.06e0 THEN 'high'
              WHEN l_discount >= 0.03e0 THEN 'medium' ELSE 'low' END AS severity,
         'check_' || l_linestatus || '_' || (l_suppkey % 5) AS check_name, l_quantity > 45 AS fraud FROM lineitem)"""


def values_cte(name: str, cols: str, rows: list[tuple]) -> str:
    def v(x):
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else q(x)
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows) + ")"


def vocab_cte(name: str, domain: str, lang: str | None = None) -> str:
    rows = [(r[2], r[3], r[4], r[5], r[6]) for r in vocab.phrases(domain, lang)]
    return values_cte(name, "call_type, category, phrase, regulation, rank", rows)


__all__ = [n for n in dir() if not n.startswith("_")]
