"""Text checks, routing and number grounding: V1-V4, R1-R2."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.functions import text as texts
from plumbline.operators import grounding
from plumbline.operators.profile import union_all
from plumbline.workload.evidencing import phrases_sql, rewrite_sql
from plumbline.workload.inputs import CLAIMS, QUESTIONS, claims, questions
from plumbline.workload.registry import Tables, query


_SHOUTED = f"(select finding_id, case when finding_id % 3 = 0 then upper(claim) else claim end as claim from {CLAIMS})"


def _violations_sql(text: str) -> str:
    found = [f"regexp_extract({text}, '(?i)\\b(?:{p})\\b')" for p in fixed.CAUSAL_REWRITES]
    sentence = fixed.CAUSAL_VIOLATION.replace("'", "''").split("%s")
    return "concat_ws(' ', " + ", ".join(f"case when {f} <> '' then '{sentence[0]}' || {f} || '{sentence[1]}' end" for f in found) + ")"


@query(
    "v1_causal_lint",
    f"""select finding_id, phrases = '' as passed, phrases, violations
        from (select finding_id, {phrases_sql('claim')} as phrases, {_violations_sql('claim')} as violations from {_SHOUTED})""",
)
def v1(t: Tables) -> DataFrame:
    """Every third claim is in capitals, which its violations quote."""
    claim = F.when(F.col("finding_id") % 3 == 0, F.upper("claim")).otherwise(F.col("claim"))
    found = claims(t.orders).withColumns({"found": texts.causal_phrases(claim), "written": texts.causal_texts(claim)})
    return found.select(
        "finding_id",
        (F.size("found") == 0).alias("passed"),
        F.concat_ws(", ", "found").alias("phrases"),
        F.concat_ws(" ", texts.causal_violations(F.col("written"))).alias("violations"),
    )


@query("v1_causal_documents", f"select doc_id, {phrases_sql('text')} as phrases from documents")
def v1_documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws(", ", texts.causal_phrases(F.col("text"))).alias("phrases"))


@query("v2_causal_rewrite", f"select finding_id, {rewrite_sql('claim')} as claim from {CLAIMS}")
def v2(t: Tables) -> DataFrame:
    return claims(t.orders).select("finding_id", texts.associational(F.col("claim")).alias("claim"))


NUMBER_VALUE_SQL = """try_cast(regexp_replace(lower(trim(token)), '[^0-9.+-]', '', 'g') as double)
  * case regexp_extract(lower(trim(token)), '(%|[a-z]+)$', 1) when '%' then 0.01 when 'k' then 1e3
      when 'thousand' then 1e3 when 'm' then 1e6 when 'million' then 1e6 when 'bn' then 1e9 when 'billion' then 1e9
      else 1 end::double"""


def _numbers_sql(table: str, key: str, text: str) -> str:
    return f"""(select {key}, place, token, {NUMBER_VALUE_SQL} as number from (
        select {key}, unnest(l) as token, generate_subscripts(l, 1) - 1 as place from (
          select {key}, list_filter(regexp_extract_all({text}, '{texts.NUMBER_TOKEN}', 1),
            lambda x: x is not null and x <> '') as l from {table})))"""


@query(
    "v3_extract_numbers",
    f"select doc_id, place, token, number from {_numbers_sql('documents', 'doc_id', 'text')}",
)
def v3(t: Tables) -> DataFrame:
    return grounding.number_rows(t.documents, "text", ["doc_id"])


@query("v3_narrow_numbers")
def v3_narrow(t: Tables) -> DataFrame:
    tokens = texts.number_tokens(F.col("text"), variant="narrow")
    return t.documents.select("doc_id", F.posexplode(tokens).alias("place", "token")).withColumn(
        "number", texts.number_value(F.col("token"))
    )


@query(
    "v4_number_grounding",
    f"""with n as {_numbers_sql('documents', 'doc_id', 'text')},
          v as (select distinct cast(value as double) as v from events),
          d as (select distinct number as x from n union select number * 100 from n where token like '%\\%' escape '\\'),
          g as (select x from d where exists (select 1 from v where (v = 0 and x = 0)
                  or (v <> 0 and abs(x - v) / abs(v) <= 0.01)))
        select doc_id, count(*) filter (ok) as grounded, count(*) filter (not ok) as ungrounded,
          coalesce(bool_and(ok), true) as passed
        from (select doc_id, null::boolean as ok from documents
              union all select doc_id, number in (select x from g)
                or (token like '%\\%' escape '\\' and number * 100 in (select x from g)) as ok from n) group by 1""",
)
def v4(t: Tables) -> DataFrame:
    return grounding.number_lint(t.documents, "text", ["doc_id"], t.events, "value")


def _any(words: list[str]) -> str:
    return f"regexp_matches(question, '(?i)\\b(?:{'|'.join(words)})\\b')"


WORDS_SQL = (
    "case when regexp_replace(question, '^\\s+|\\s+$', '', 'g') = '' then 0 else "
    "len(regexp_split_to_array(regexp_replace(question, '^\\s+|\\s+$', '', 'g'), '\\s+')) end"
)
ASKED = f"""(select 'customer' as origin, question_id, 0 as turn, question from {QUESTIONS}
  union all select 'conversation', conv_id, turn, text from conversations)"""


def _asked(t: Tables) -> DataFrame:
    """Derived questions and every line of the conversations."""
    derived = questions(t.customer).select(
        F.lit("customer").alias("origin"), "question_id", F.lit(0).cast("long").alias("turn"), "question"
    )
    lines = t.conversations.select(
        F.lit("conversation").alias("origin"),
        F.col("conv_id").alias("question_id"),
        "turn",
        F.col("text").alias("question"),
    )
    return union_all([derived, lines])


@query(
    "r1_request_tier",
    f"""select origin, question_id, turn, case when {_any(fixed.REPORT_WORDS)} then 'REPORT'
          when {_any(fixed.INVESTIGATION_WORDS)} then 'INVESTIGATION'
          when {_any(fixed.ANALYSIS_WORDS)} then 'ANALYSIS'
          when {_any(fixed.LOOKUP_WORDS)} and {WORDS_SQL} <= 12 then 'LOOKUP'
          when {WORDS_SQL} > 20 then 'INVESTIGATION' else 'ANALYSIS' end as tier from {ASKED}""",
)
def r1(t: Tables) -> DataFrame:
    return _asked(t).select("origin", "question_id", "turn", texts.request_tier(F.col("question")).alias("tier"))


_TIME_SQL = ", ".join(
    f"nullif(regexp_extract(lower(question), '({p})', 1), '')" for p in fixed.TIME_EXPRESSION_PATTERNS
)
MEASURE_NAMES = ["l_quantity", "balance", "revenue"]
DIMENSION_NAMES = ["l_returnflag", "region", "account"]


def _mentioned_sql(names: list[str]) -> str:
    return "concat_ws(', ', " + ", ".join(
        f"case when contains(lower(question), '{n}') then '{n}' end" for n in names
    ) + ")"


@query(
    "r2_intent",
    f"""select origin, question_id, turn, {_any(fixed.WHY_WORDS)} as why_question,
          {_any(fixed.COMPARISON_WORDS)} as comparison_requested, coalesce({_TIME_SQL}) as time_expression,
          {_mentioned_sql(MEASURE_NAMES)} as measures, {_mentioned_sql(DIMENSION_NAMES)} as dimensions from {ASKED}""",
)
def r2(t: Tables) -> DataFrame:
    question = F.col("question")
    return _asked(t).select(
        "origin",
        "question_id",
        "turn",
        texts.is_why_question(question).alias("why_question"),
        texts.asks_comparison(question).alias("comparison_requested"),
        texts.time_expression(question).alias("time_expression"),
        F.concat_ws(", ", texts.mentioned(question, MEASURE_NAMES)).alias("measures"),
        F.concat_ws(", ", texts.mentioned(question, DIMENSION_NAMES)).alias("dimensions"),
    )


@query(
    "r2_mentions",
    f"""select question_id, name, kind from (
          select question_id, lower(question) as q from {QUESTIONS}) a
        join (select c_name as name, 'customer' as kind from customer union all select distinct c_mktsegment, 'segment' from customer
              union all select n_name, 'nation' from nation) d on contains(a.q, lower(d.name))""",
)
def r2_mentions(t: Tables) -> DataFrame:
    """Every customer, segment and nation is an entry of the dictionary."""
    names = [
        t.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")),
        t.customer.select(F.col("c_mktsegment").alias("name"), F.lit("segment").alias("kind")).distinct(),
        t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")),
    ]
    return texts.mentions(questions(t.customer), union_all(names), "question_id", "question", "name")
