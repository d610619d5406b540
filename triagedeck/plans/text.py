"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nx
from ..functions import prompts as px
from ..functions import text as tx
from ..functions import stem as sm
from ..functions.stem import stem_tokens
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import reports as rp
from ..operators.splits import few_shot_block
from .base import (
    ANSWERS,
    DOCS,
    JUDGED,
    RAW,
    REPORTS,
    RESULTS,
    SCORED,
    STEPS,
    answers,
    docs,
    judged,
    query,
    r6,
    raw,
    reports,
    results,
    scored,
    sql,
    table,
    texts,
)

TOKENS_SQL = r"regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.format(c=column)


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _split_sql(source: str, out: str, suffixes) -> str:
    """The word without its longest suffix of a list, and that suffix."""
    found = f"regexp_extract(w, '({'|'.join(suffixes)})\\z', 1)"
    return f"{out} AS (SELECT t, left(w, length(w) - length({found})) AS stem, {found} AS e FROM {source})"


def _mapped_sql(source: str, out: str, rules: dict[str, str]) -> str:
    table_of = " ".join(f"WHEN '{end}' THEN '{new}'" for end, new in rules.items())
    return f"""{out} AS (SELECT t, stem || CASE WHEN regexp_matches(stem, '{sm.MEASURE_1}') THEN CASE e {table_of} ELSE '' END
  ELSE e END AS w FROM {source})"""


def with_stems(source: str) -> str:
    """CTEs from ``source`` (bug_id, description of tokens split by spaces) to ``stemmed``.

    Every distinct token goes through the rules once, step by step, and is joined back by its position.
    """
    return f"""tok AS (SELECT bug_id, unnest(string_split(description, ' ')) AS t,
  generate_subscripts(string_split(description, ' '), 1) AS pos FROM {source}),
s0 AS (SELECT DISTINCT t, regexp_replace(lower(t), '^y', 'Y') AS w FROM tok),
s1 AS (SELECT t, CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN left(w, length(w) - 2)
  WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS w FROM s0),
s2 AS (SELECT t, w, left(w, length(w) - 2) AS w_ed, left(w, length(w) - 3) AS w_ing FROM s1 WHERE length(w) > 3),
s3 AS (SELECT t, CASE WHEN suffix(w, 'eed') THEN CASE WHEN regexp_matches(w_ing, '{sm.MEASURE_1}') THEN left(w, length(w) - 1) ELSE w END
    WHEN suffix(w, 'ed') AND regexp_matches(w_ed, '[aeiouy]') THEN w_ed
    WHEN suffix(w, 'ing') AND regexp_matches(w_ing, '[aeiouy]') THEN w_ing ELSE w END AS w,
  NOT suffix(w, 'eed') AND (suffix(w, 'ed') AND regexp_matches(w_ed, '[aeiouy]')
    OR suffix(w, 'ing') AND regexp_matches(w_ing, '[aeiouy]')) AS open FROM s2
  UNION ALL SELECT t, w, false FROM s1 WHERE length(w) <= 3),
s4 AS (SELECT t, CASE WHEN NOT open THEN w WHEN regexp_matches(w, '(at|bl|iz)\\z') OR regexp_matches(w, '{sm.SHORT_END}') THEN w || 'e'
  WHEN regexp_matches(right(w, 1), '[^aeiouylsz]') AND right(w, 2) = right(w, 1) || right(w, 1) THEN left(w, length(w) - 1)
  ELSE w END AS w FROM s3),
s5 AS (SELECT t, CASE WHEN suffix(w, 'y') AND regexp_matches(left(w, length(w) - 1), '[aeiouy]')
  THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s4),
{_split_sql('s5', 's6', sm.STEP_2)},
{_mapped_sql('s6', 's7', sm.STEP_2)},
{_split_sql('s7', 's8', sm.STEP_3)},
{_mapped_sql('s8', 's9', sm.STEP_3)},
{_split_sql('s9', 's10', sm.STEP_4)},
s11 AS (SELECT t, CASE WHEN regexp_matches(stem, '{sm.MEASURE_2}') AND (e <> 'ion' OR regexp_matches(stem, '[st]\\z'))
  THEN stem ELSE stem || e END AS w FROM s10),
s12 AS (SELECT t, w, left(w, length(w) - 1) AS b FROM s11 WHERE w <> ''),
s13 AS (SELECT t, CASE WHEN suffix(w, 'e') AND (regexp_matches(b, '{sm.MEASURE_2}')
  OR regexp_matches(b, '{sm.MEASURE_1}') AND NOT regexp_matches(b, '{sm.SHORT_END}')) THEN b ELSE w END AS w FROM s12
  UNION ALL SELECT t, w FROM s11 WHERE w = ''),
dictionary AS (SELECT t, CASE WHEN length(lower(t)) <= 2 THEN lower(t) WHEN suffix(w, 'll') AND regexp_matches(w, '{sm.MEASURE_2}')
  THEN lower(left(w, length(w) - 1)) ELSE lower(w) END AS s FROM s13),
stemmed AS (SELECT bug_id, string_agg(s, ' ' ORDER BY pos) AS stemmed_description FROM tok JOIN dictionary USING (t) GROUP BY bug_id)"""


# --- projections, filters, predicates ---


@query("filter_severity", sql(REPORTS, body="""
SELECT bug_id, short_desc, bug_severity FROM reports
WHERE bug_severity IS NULL OR bug_severity NOT IN ('normal', 'enhancement')"""))
def filter_severity(spark, sf):
    return lb.filter_severity(
        reports(spark, sf), keep_columns=("bug_id", "short_desc", "bug_severity")
    )


@query("binary_label", sql(REPORTS, body="""
SELECT bug_id, bug_severity,
  CASE WHEN bug_severity IN ('blocker', 'critical', 'major') THEN 1 ELSE 0 END AS binary_severity FROM reports"""))
def binary_label(spark, sf):
    return lb.add_binary_label(reports(spark, sf)).select("bug_id", "bug_severity", "binary_severity")


BLANKED = """blanked AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN chr(10) || ' ' || chr(9)
  WHEN role = 'user' AND turn = 0 THEN '' WHEN role = 'assistant' AND turn = 1 THEN NULL ELSE text END AS description FROM conversations)"""


@query("drop_empty_text", sql(BLANKED, body=r"""
SELECT conv_id, turn, description FROM blanked
WHERE length(regexp_replace(description, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) > 0"""))
def drop_empty_text(spark, sf):
    """Conversations whose openings are blank, empty or missing."""
    role, turn = F.col("role"), F.col("turn")
    text = (
        F.when(role == "system", "\n \t")
        .when((role == "user") & (turn == 0), "")
        .when(~((role == "assistant") & (turn == 1)), F.col("text"))
    )
    blanked = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("description"))
    return rp.drop_empty_text(blanked)


@query("nan_to_code", sql(DOCS, JUDGED, body="""
SELECT bug_id, CASE WHEN severity_pred IS NULL OR isnan(severity_pred) THEN -2
  ELSE severity_pred::INT END AS severity_pred FROM judged"""))
def nan_to_code(spark, sf):
    return judged(spark, sf).select(
        "bug_id", nx.missing_to_failed(F.col("severity_pred")).alias("severity_pred")
    )


@query("code_to_name", sql(DOCS, JUDGED, body="""
SELECT bug_id, code, CASE code WHEN -2 THEN 'failed' WHEN -1 THEN 'mixed' WHEN 0 THEN 'not severe'
  ELSE 'severe' END AS name FROM judged"""))
def code_to_name(spark, sf):
    code = nx.missing_to_failed(F.col("severity_pred"))
    return judged(spark, sf).select("bug_id", code.alias("code"), nx.code_name(code).alias("name"))


@query("round_label", """
SELECT l_orderkey, l_linenumber, l_quantity / 2 AS half,
  CASE WHEN l_quantity / 2 - floor(l_quantity / 2) = 0.5
    THEN (2 * round(l_quantity / 4))::INT ELSE round(l_quantity / 2)::INT END AS label FROM lineitem""")
def round_label(spark, sf):
    half = F.col("l_quantity") / 2
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", half.alias("half"), nx.rounded_label(half).alias("label")
    )


@query("threshold_label", sql(SCORED, body="""
SELECT id, CASE WHEN score >= 0.05 THEN 1 ELSE 0 END AS at_least,
  CASE WHEN score > 0.05 THEN 1 ELSE 0 END AS above FROM scored"""))
def threshold_label(spark, sf):
    return scored(spark, sf).select(
        "id",
        nx.threshold_label(F.col("score"), 0.05).alias("at_least"),
        nx.threshold_label(F.col("score"), 0.05, strict=True).alias("above"),
    )


@query("query_filter", sql(REPORTS, body="""
SELECT bug_id, bug_severity, bug_status FROM reports
WHERE bug_severity = 'blocker' AND bug_status = 'F' AND price > 100000"""))
def query_filter(spark, sf):
    return (
        reports(spark, sf)
        .filter("bug_severity = 'blocker' AND bug_status = 'F' AND price > 100000")
        .select("bug_id", "bug_severity", "bug_status")
    )


@query("derived_names", sql(SCORED, STEPS, RESULTS, body="""
SELECT run, dataset_type, run || ' ' || dataset_choice || ', '
  || CASE WHEN prompt_id = 'alpaca' THEN 'weighted' ELSE 'not_weighted' END || ', r=' || lora_r AS name,
  run || ' ' || dataset_choice || ', '
  || CASE WHEN prompt_id = 'alpaca' THEN 'weighted' ELSE 'not_weighted' END || ', r=' || lora_r
  || ', ' || dataset_type AS id FROM results"""))
def derived_names(spark, sf):
    weighted = F.when(F.col("prompt_id") == "alpaca", "weighted").otherwise("not_weighted")
    name = F.concat_ws(
        ", ",
        F.concat_ws(" ", F.col("run").cast("string"), "dataset_choice"),
        weighted,
        F.concat(F.lit("r="), "lora_r"),
    )
    return results(spark, sf).select(
        "run", "dataset_type", name.alias("name"), F.concat_ws(", ", name, "dataset_type").alias("id")
    )


@query("nested_metrics", sql(SCORED, body="""
SELECT user_id, (n00 + n11)::BIGINT AS correct, round((n00 + n11) / n::DOUBLE, 6) AS accuracy,
  round(CASE WHEN 2 * n11 + n01 + n10 = 0 THEN 0 ELSE 2.0 * n11 / (2 * n11 + n01 + n10) END, 6) AS f1_severe,
  round((CASE WHEN 2 * n11 + n01 + n10 = 0 THEN 0 ELSE 2.0 * n11 / (2 * n11 + n01 + n10) END
   + CASE WHEN 2 * n00 + n01 + n10 = 0 THEN 0 ELSE 2.0 * n00 / (2 * n00 + n01 + n10) END) / 2, 6) AS f1_mean
FROM (SELECT user_id, count(*) AS n, count_if(y = 0 AND score < 0.05) AS n00, count_if(y = 0 AND score >= 0.05) AS n01,
  count_if(y = 1 AND score < 0.05) AS n10, count_if(y = 1 AND score >= 0.05) AS n11 FROM scored GROUP BY user_id)"""))
def nested_metrics(spark, sf):
    hit = F.col("score") >= 0.05
    cell = lambda y, p: F.count_if((F.col("y") == y) & (hit if p else ~hit))
    matrices = (
        scored(spark, sf)
        .groupBy("user_id")
        .agg(F.array(F.array(cell(0, 0), cell(0, 1)), F.array(cell(1, 0), cell(1, 1))).alias("m"))
    )
    at = lambda i, j: F.element_at(F.element_at(F.col("m"), i + 1), j + 1)
    f1 = F.transform(
        F.sequence(F.lit(1), F.lit(2)),
        lambda i: mt.ratio(
            2 * F.element_at(F.element_at(F.col("m"), i), i),
            2 * F.element_at(F.element_at(F.col("m"), i), i) + at(0, 1) + at(1, 0),
        ),
    )
    total = F.aggregate(F.flatten("m"), F.lit(0).cast("long"), lambda s, v: s + v)
    trace = at(0, 0) + at(1, 1)
    return matrices.withColumn("f1", f1).select(
        "user_id",
        trace.alias("correct"),
        r6(trace / total).alias("accuracy"),
        r6(F.element_at("f1", 2)).alias("f1_severe"),
        r6(F.aggregate("f1", F.lit(0.0), lambda s, v: s + v) / F.size("f1")).alias("f1_mean"),
    )


@query("nan_guard", sql(DOCS, JUDGED, body="""
SELECT count_if(binary_severity IS NULL)::BIGINT AS binary_severity,
  count_if(severity_pred IS NULL OR isnan(severity_pred))::BIGINT AS severity_pred FROM judged"""))
def nan_guard(spark, sf):
    return lb.nan_report(judged(spark, sf), ["binary_severity", "severity_pred"])


@query("informative_columns", sql(SCORED, STEPS, RESULTS, body="""
SELECT * FROM (SELECT 'learning_rate' AS parameter, min(learning_rate) AS lowest, max(learning_rate) AS highest FROM results
 UNION ALL SELECT 'lora_r', min(lora_r), max(lora_r) FROM results
 UNION ALL SELECT 'quant', min(quant), max(quant) FROM results
 UNION ALL SELECT 'prompt_id', min(prompt_id), max(prompt_id) FROM results) WHERE lowest < highest"""))
def informative_columns(spark, sf):
    return lb.informative_columns(
        results(spark, sf), ["learning_rate", "lora_r", "quant", "prompt_id"]
    )


# --- text ---


@query("replace_urls", r"""
SELECT page_id, regexp_replace('at ' || url || ' and x' || url || chr(10) || html, 'http[^\s\x{A0}]+', 'URL', 'g') AS text FROM pages""")
def replace_urls(spark, sf):
    text = F.concat(F.lit("at "), "url", F.lit(" and x"), "url", F.lit("\n"), "html")
    return table(spark, sf, "pages").select("page_id", tx.replace_urls(text).alias("text"))


@query("replace_code", sql(RAW, body="""
SELECT bug_id, regexp_replace(regexp_replace(description, '(?s)```.*?```', 'CODE', 'g'), '`[^`]+`', '', 'g') AS text FROM raw"""))
def replace_code(spark, sf):
    return raw(spark, sf).select("bug_id", tx.replace_code(F.col("description")).alias("text"))


@query("clean_text", sql(RAW, body=r"""
SELECT bug_id, regexp_replace(regexp_replace(regexp_replace(description, 'http[^\s\x{A0}]+', 'URL', 'g'),
  '(?s)```.*?```', 'CODE', 'g'), '`[^`]+`', '', 'g') AS description FROM raw"""))
def clean_text(spark, sf):
    return rp.remove_urls_and_code(raw(spark, sf)).select("bug_id", "description")


@query("join_list_text", r"""
SELECT doc_id, regexp_replace(array_to_string(string_split(text, chr(10)), ' '), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS description FROM documents""")
def join_list_text(spark, sf):
    return texts(spark, sf).select(
        "doc_id", tx.join_text(F.split("text", "\n")).alias("description")
    )


@query("tokenize_words", f"""
SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens, len({tokens_sql('text')}) AS n_tokens FROM documents""")
def tokenize_words(spark, sf):
    tok = texts(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return tok.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@query("filter_tokens", f"""
SELECT doc_id, array_to_string(list_filter({tokens_sql('text')},
  lambda t: NOT list_contains({quoted(tx.PUNCTUATION)}, t) AND NOT list_contains({quoted(tx.STOP_WORDS)}, lower(t))), ' ') AS tokens
FROM documents""")
def filter_tokens(spark, sf):
    return texts(spark, sf).select(
        "doc_id", F.array_join(tx.keep_content(tx.tokens(F.col("text"))), " ").alias("tokens")
    )


@query("stem_tokens", sql(DOCS, f"""kept AS (SELECT bug_id, array_to_string(list_filter({tokens_sql('description')},
  lambda t: NOT list_contains({quoted(tx.PUNCTUATION)}, t) AND NOT list_contains({quoted(tx.STOP_WORDS)}, lower(t))), ' ') AS description
  FROM docs)""", with_stems("kept"), body="SELECT bug_id, stemmed_description FROM kept JOIN stemmed USING (bug_id)"))
def stem(spark, sf):
    kept = docs(spark, sf).select("bug_id", tx.keep_content(tx.tokens(F.col("description"))).alias("t"))
    return kept.select("bug_id", F.array_join(stem_tokens("t"), " ").alias("stemmed_description"))


def _labelled_raw(spark, sf):
    """Raw texts with the severity words of the label domain."""
    severity = F.when(F.col("quality") == 0, "blocker").when(F.col("toxic") == 1, "normal").otherwise("minor")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("bug_id"), severity.alias("bug_severity"))
    return raw(spark, sf).join(labels, "bug_id")


def _chain_sql(cleaned: str, dropped: str) -> str:
    """The chain without its last step: every column but the stems."""
    tokens = tokens_sql(cleaned)
    return sql(RAW, body=f"""
, lab AS (SELECT r.bug_id, r.description, CASE WHEN quality = 0 THEN 'blocker' WHEN toxic = 1 THEN 'normal' ELSE 'minor' END AS bug_severity
  FROM raw r JOIN labels l ON r.bug_id = l.doc_id),
done AS (SELECT bug_id, bug_severity, CASE WHEN bug_severity = 'blocker' THEN 1 ELSE 0 END AS binary_severity,
  array_to_string(list_filter({tokens}, lambda t: NOT list_contains({quoted(tx.PUNCTUATION)}, t)
    AND NOT list_contains({quoted(tx.STOP_WORDS)}, lower(t))), ' ') AS description FROM lab WHERE {dropped})
SELECT * FROM done WHERE length(trim(description)) > 0""")


URL_SQL = "regexp_replace(description, 'http[^\\s\\x{A0}]+', 'URL', 'g')"
CODE_SQL = "regexp_replace(regexp_replace(" + URL_SQL + ", '(?s)```.*?```', 'CODE', 'g'), '`[^`]+`', '', 'g')"
KEPT_SQL = "bug_severity <> 'normal'"


@query("preprocess_description", _chain_sql(URL_SQL, "true"))
def preprocess_description(spark, sf):
    return preprocess_text(spark, sf).drop("stemmed_description")


@query("custom_description", _chain_sql(CODE_SQL, KEPT_SQL))
def custom_description(spark, sf):
    return custom_transformations(spark, sf).drop("stemmed_description")


@query("paper_description", _chain_sql(URL_SQL, KEPT_SQL))
def paper_description(spark, sf):
    return paper_transformations(spark, sf).drop("stemmed_description")


def _stemmed_sql(cleaned: str, dropped: str) -> str:
    """The whole chain."""
    return f"""WITH chain AS ({_chain_sql(cleaned, dropped)}),
{with_stems('chain')}
SELECT bug_id, bug_severity, binary_severity, description, stemmed_description FROM chain JOIN stemmed USING (bug_id)"""


@query("preprocess_text", _stemmed_sql(URL_SQL, "true"))
def preprocess_text(spark, sf):
    return rp.preprocess_text(lb.add_binary_label(_labelled_raw(spark, sf)))


@query("custom_transformations", _stemmed_sql(CODE_SQL, KEPT_SQL))
def custom_transformations(spark, sf):
    return rp.custom_transformations(_labelled_raw(spark, sf))


@query("paper_transformations", _stemmed_sql(URL_SQL, KEPT_SQL))
def paper_transformations(spark, sf):
    return rp.custom_transformations(_labelled_raw(spark, sf), strip_code=False)


@query("classify_answer", sql(ANSWERS, body=f"""
SELECT bug_id, CASE WHEN regexp_matches(answer, '{tx.DENIED_ANSWER}')
    OR (contains(answer, '0') AND NOT contains(answer, '1')) THEN 0
  WHEN regexp_matches(answer, '{tx.SEVERE_ANSWER}') OR (contains(answer, '1') AND NOT contains(answer, '0')) THEN 1
  ELSE -1 END AS severity_pred,
 CASE WHEN regexp_matches(answer, '^{tx.DENIED_ANSWER}')
    OR (contains(answer, '0') AND NOT contains(answer, '1')) THEN 0
  WHEN regexp_matches(answer, '^{tx.SEVERE_ANSWER}') OR (contains(answer, '1') AND NOT contains(answer, '0')) THEN 1
  ELSE -1 END AS anchored FROM answers"""))
def classify_answer(spark, sf):
    c = F.col("answer")
    return answers(spark, sf).select(
        "bug_id",
        tx.classify_answer(c).alias("severity_pred"),
        tx.classify_answer(c, anchored=True).alias("anchored"),
    )


@query("strip_prompt", sql(ANSWERS, body=r"""
SELECT bug_id, regexp_replace(substr(text || ' ' || answer, length(text) + 1), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS answer FROM answers"""))
def strip_prompt(spark, sf):
    echoed = F.concat("text", F.lit(" "), "answer")
    return answers(spark, sf).select("bug_id", tx.strip_echo(echoed, F.col("text")).alias("answer"))


PROMPT = "Rate the report: 0 = not severe, 1 = severe.\n$preprompt\nReport: $input\nAgain, rate the report in $lang.\nAnswer:"


@query("prompt_text", """
SELECT doc_id, 'Rate the report: 0 = not severe, 1 = severe.' || chr(10) || 'from ' || source || chr(10) || 'Report: ' || text
  || chr(10) || 'Again, rate the report in ' || lang || '.' || chr(10) || 'Answer:' AS prompt FROM documents""")
def prompt_text(spark, sf):
    prompt = tx.fill_template(
        PROMPT, input=F.col("text"), preprompt=F.concat(F.lit("from "), "source"), lang=F.col("lang")
    )
    return table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))


EXAMPLES = "Severe example: $severe_descr\nOther example: $non_severe_descr"


@query("few_shot_block", """
WITH turns AS (SELECT conv_id * 1000 + turn AS bug_id, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS y, text FROM conversations),
short AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY bug_id) AS rn FROM turns WHERE length(text) < 250),
pick AS (SELECT * FROM short WHERE rn = 1)
SELECT bug_id, y, text, (SELECT 'Severe example: ' || max(CASE WHEN y = 1 THEN text END) || chr(10)
   || 'Other example: ' || max(CASE WHEN y = 0 THEN text END) FROM pick) AS examples
FROM turns WHERE bug_id NOT IN (SELECT bug_id FROM pick)""")
def few_shot(spark, sf):
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("bug_id"),
        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("y"),
        "text",
    )
    template = tx.fill_template(
        EXAMPLES, severe_descr=F.col("severe_descr"), non_severe_descr=F.col("non_severe_descr")
    )
    block, rest = few_shot_block(turns, template, "bug_id", "y", "text")
    return rest.withColumn("examples", block.select("examples").scalar()).select(
        "bug_id", "y", "text", "examples"
    )


# --- arrays ---

TEMPLATE_TOKENS = ["<s>", "Rate", "this", "report", ":", "0", "or", "1", "?", "Answer"]
TEMPLATE_SQL = quoted(TEMPLATE_TOKENS)


@query("prompt_tokens", f"""
WITH t AS (SELECT doc_id, list_prepend('<s>', {tokens_sql('text')}) AS d, {TEMPLATE_SQL} AS t FROM documents),
p AS (SELECT doc_id, list_concat(list_concat(t[2:5], d[2:41]), t[6:10]) AS p FROM t)
SELECT doc_id, array_to_string(p, ' ') AS prompt, len(p) AS n_tokens FROM p""")
def prompt_tokens(spark, sf):
    described = F.concat(F.array(F.lit("<s>")), tx.tokens(F.col("text")))
    template = F.array(*[F.lit(t) for t in TEMPLATE_TOKENS])
    built = texts(spark, sf).select(
        "doc_id", px.splice(template, F.lit(5), described, 50).alias("p")
    )
    return built.select("doc_id", F.array_join("p", " ").alias("prompt"), F.size("p").cast("long").alias("n_tokens"))


@query("token_count", f"""
SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, len({tokens_sql('text')}) + {len(TEMPLATE_TOKENS)} AS n_with_template FROM documents""")
def token_count(spark, sf):
    n = F.size(tx.tokens(F.col("text"))).cast("long")
    return texts(spark, sf).select(
        "doc_id", n.alias("n_tokens"), (n + len(TEMPLATE_TOKENS)).alias("n_with_template")
    )


@query("truncate_tokens", f"""
WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)
SELECT doc_id, array_to_string(t[1:100], ' ') AS text, CASE WHEN len(t) > 100 THEN 1 ELSE 0 END AS is_long FROM t""")
def truncate_tokens(spark, sf):
    tok = texts(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return tok.select(
        "doc_id",
        F.array_join(px.truncate(F.col("t"), 100), " ").alias("text"),
        px.is_long(F.col("t"), 100).alias("is_long"),
    )


@query("pool_vectors", """
WITH c AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))
SELECT vec_id, CAST(i % 16 AS INT) AS dim, round(avg(v), 6) AS mean, round(sum(v), 6) AS total,
  round(max(CASE WHEN i < 16 THEN v END), 6) AS first FROM c GROUP BY vec_id, i % 16""")
def pool_vectors(spark, sf):
    """The 64 numbers of a vector read as four tokens of 16."""
    states = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding"), i * 16 + 1, F.lit(16))
    )
    e = table(spark, sf, "embeddings").select("vec_id", states.alias("s"))
    ways = {"mean": "mean", "total": "sum", "first": "first"}
    pooled = F.arrays_zip(*[mt.pooled("s", how).alias(name) for name, how in ways.items()])
    cells = e.select("vec_id", F.posexplode(pooled).alias("dim", "p"))
    return cells.select("vec_id", "dim", *[r6(f"p.{name}").alias(name) for name in ways])


# --- numbers, dates, JSON ---


@query("pct_of_group", """
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source),
p AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY lang) AS x FROM c)
SELECT lang, source, n, CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END AS pct FROM p""")
def pct_of_group(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return mt.percent_of_group(counts, "n", ["lang"])


@query("bce_loss", """
WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings),
p AS (SELECT vec_id, dim::INT AS dim, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-v::DOUBLE)) AS p FROM e)
SELECT vec_id, dim, round(p, 6) AS p, round(-(y * greatest(ln(p), -100) + (1 - y) * greatest(ln(1 - p), -100)), 6) AS loss FROM p""")
def bce_loss(spark, sf):
    p = nx.sigmoid(F.col("v").cast("double"))
    y = (F.col("label") >= 5).cast("int")
    cells = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "v"))
    return cells.select(
        "vec_id", "dim", r6(p).alias("p"), r6(nx.cross_entropy(y, p)).alias("loss")
    )


@query("param_rescale", """
WITH c AS (SELECT p_partkey, log10(p_retailprice) AS x, p_size::DOUBLE AS v FROM part),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(v) AS v0, max(v) AS v1 FROM c)
SELECT p_partkey, round(v0 + (x - x0) / (x1 - x0) * (v1 - v0), 6) AS scaled FROM c, r""")
def param_rescale(spark, sf):
    base = table(spark, sf, "part").select(
        "p_partkey", F.log10("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("v")
    )
    limits = base.agg(
        F.struct(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("v").alias("v0"), F.max("v").alias("v1")
        ).alias("r")
    )
    ranged = base.withColumn("r", limits.scalar())
    scaled = nx.rescale(F.col("x"), F.col("r.x0"), F.col("r.x1"), F.col("r.v0"), F.col("r.v1"))
    return ranged.select("p_partkey", r6(scaled).alias("scaled"))


@query("time_range", sql(REPORTS, body="""
SELECT bug_status AS dataset, strftime(min(creation_ts), '%Y-%m-%d %H:%M:%S') AS earliest,
  strftime(max(creation_ts), '%Y-%m-%d %H:%M:%S') AS latest FROM reports GROUP BY bug_status"""))
def time_range(spark, sf):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return (
        reports(spark, sf)
        .groupBy(F.col("bug_status").alias("dataset"))
        .agg(F.min("creation_ts").alias("a"), F.max("creation_ts").alias("b"))
        .select("dataset", shown("a").alias("earliest"), shown("b").alias("latest"))
    )


@query("json_records", """
SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k,
  '{"event_id":' || event_id || ',"type":"' || event_type || '","params":{"k":"' || regexp_extract(props, '"k": ([0-9]+)', 1) || '"}}' AS record FROM events""")
def json_records(spark, sf):
    params = F.from_json("props", "map<string,string>")
    known = F.map_filter(params, lambda k, v: v.isNotNull())
    record = F.to_json(
        F.struct("event_id", F.col("event_type").alias("type"), known.alias("params"))
    )
    back = F.from_json(record, "event_id long, type string, params map<string,string>")
    return table(spark, sf, "events").select(
        "event_id", back["params"]["k"].cast("int").alias("k"), record.alias("record")
    )
