"""The queries over the shared tables, each with its SQL for DuckDB where SQL can express it.

A query reads whole tables; limits occur only where they are what the operator does (top k, samples).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import python_code as PY
from ..functions import text as X
from ..operators import dedup, evaluation, filters, gates, joins, projections, sampling, similarity
from ..sources import readers
from . import settings as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """count_if(x), which DuckDB gives as a 128-bit number, as a filtered count."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 9 : end - 1]
        sql = f"{sql[:at]}count(*) FILTER (WHERE {inner}){sql[end:]}"
    return sql


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _bigint_counts(sql)
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


KEY = r"substr(sha256(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 20)"
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
BUCKET = "CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) % 20"


def in_order(key: str, seed: int = S.SEED) -> str:
    return f"sha256('{seed}:' || CAST({key} AS VARCHAR))"


# Curation ------------------------------------------------------------------------------------------


@query(rf"""
WITH e AS (SELECT * FROM documents WHERE length({STRIP}) BETWEEN 40 AND 5000),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) = 1),
c AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)))
SELECT lang, CASE WHEN {BUCKET.format("CAST(doc_id AS VARCHAR)")} = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM c GROUP BY ALL
""")
def curation_funnel(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text", "lang")
    docs = docs.where(filters.length_between(F.col("text"), 40, 5000))
    docs = dedup.dedup_text(docs, "text", "doc_id")
    bad = joins.contains_any(docs, "text", t(spark, d, "benchmark").withColumnRenamed("text", "passage"), "passage").select("doc_id")
    kept = joins.pending(docs, bad, "doc_id")
    return evaluation.value_counts(kept.withColumn("split", sampling.split(F.col("doc_id").cast("string"))), "lang", "split")


@query(rf"SELECT doc_id, lang FROM documents WHERE length({STRIP}) BETWEEN 200 AND 3000 AND regexp_matches(text, '(?i)heit|tion|ción')")
def eligible_documents(spark, d):
    docs = t(spark, d, "documents")
    return docs.where(filters.length_between(F.col("text"), 200, 3000) & X.matches_any_case(F.col("text"), "heit|tion|ción")).select("doc_id", "lang")


@query(f"SELECT min(doc_id) AS doc_id, {KEY} AS dedup_key FROM documents GROUP BY ALL")
def dedup_keep_first(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return dedup.dedup_text(docs, "text", "doc_id").select("doc_id", X.dedup_key(F.col("text")).alias("dedup_key"))


@query("SELECT source, arg_min(text, doc_id) AS text FROM documents GROUP BY source")
def first_text_per_source(spark, d):
    return dedup.first_value(t(spark, d, "documents"), "source", "text", "doc_id")


@query(f"SELECT doc_id, {BUCKET.format('CAST(doc_id AS VARCHAR)')} AS bucket, CASE WHEN {BUCKET.format('CAST(doc_id AS VARCHAR)')} = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
def hash_split(spark, d):
    key = F.col("doc_id").cast("string")
    return t(spark, d, "documents").select("doc_id", X.hash_bucket(key, 20).alias("bucket"), sampling.split(key).alias("split"))


@query(f"""
WITH k AS (SELECT {KEY} AS family, {BUCKET.format('CAST(doc_id AS VARCHAR)')} = 0 AS held FROM documents)
SELECT family FROM k GROUP BY family HAVING bool_or(held) AND bool_or(NOT held)
""")
def split_leakage(spark, d):
    docs = t(spark, d, "documents").select(X.dedup_key(F.col("text")).alias("family"), sampling.split(F.col("doc_id").cast("string")).alias("split"))
    return joins.shared_keys(docs.where("split = 'train'"), docs.where("split = 'validation'"), "family")


@query(f"""
WITH k AS (SELECT {KEY} AS family, {BUCKET.format('CAST(doc_id AS VARCHAR)')} = 0 AS held FROM documents)
SELECT family FROM k GROUP BY family HAVING bool_and(held)
""")
def validation_only(spark, d):
    docs = t(spark, d, "documents").select(X.dedup_key(F.col("text")).alias("family"), sampling.split(F.col("doc_id").cast("string")).alias("split"))
    return joins.absent_keys(docs.where("split = 'validation'"), docs.where("split = 'train'"), "family")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS equal")
def labels_cover(spark, d):
    return joins.same_keys(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def contaminated_documents(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return joins.contains_any(docs, "text", t(spark, d, "benchmark").withColumnRenamed("text", "passage"), "passage").select("doc_id")


@query(rf"""
SELECT stage, count(*) AS n FROM (SELECT CASE
  WHEN NOT coalesce(length({STRIP}) BETWEEN 200 AND 3000, false) THEN 'length'
  WHEN NOT coalesce(quality = 1, false) THEN 'quality' WHEN NOT coalesce(toxic = 0, false) THEN 'toxic' ELSE 'kept' END AS stage
FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY stage
""")
def rejection_funnel(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return evaluation.funnel(rows, [("length", filters.length_between(F.col("text"), 200, 3000)), ("quality", F.col("quality") == 1), ("toxic", F.col("toxic") == 0)])


@query(r"SELECT lang, source, count(*) AS before, count(*) FILTER (WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) <= 512) AS after FROM documents GROUP BY ALL")
def retention(spark, d):
    return evaluation.retention(t(spark, d, "documents"), filters.within_tokens(F.col("text"), 512), "lang", "source")


# Lanes, quotas, samples ----------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lane_counts(spark, d):
    return evaluation.value_counts(t(spark, d, "documents"), "lang")


@query("SELECT '{' || string_agg('\"' || lang || '\":' || n, ',' ORDER BY lang) || '}' AS counts FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def lane_count_map(spark, d):
    return evaluation.count_map(t(spark, d, "documents"), "lang").select(F.to_json("counts").alias("counts"))


@query("SELECT 'lane_ratio' AS \"check\", key, actual, expected FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS key, count_if(lang = '{k}') AS actual, CAST(round_even(count(*) * {r}, 0) AS BIGINT) AS expected FROM documents" for k, r in S.RATIOS.items()) + ") WHERE actual <> expected")
def lane_ratios(spark, d):
    return gates.ratio_violations(t(spark, d, "documents"), "lang", S.RATIOS)


@query("""
WITH s AS (SELECT count(*) AS t, CAST(round_even(count(*) * 0.05, 0) AS BIGINT) AS held FROM documents),
q AS (SELECT t, held, t - held AS train, CAST(round_even((t - held) * 0.65, 0) AS BIGINT) AS en, CAST(round_even((t - held) * 0.2, 0) AS BIGINT) AS sw FROM s)
SELECT name, CAST(n AS BIGINT) AS n FROM (SELECT unnest(['en', 'sw', 'sw_mix', 'train', 'validation']) AS name, unnest([en, sw, train - en - sw, train, held]) AS n FROM q)
""")
def quota_table(spark, d):
    """The sizes of the split of all documents, and the lanes' quotas of its larger side."""
    sizes = sampling.split_sizes(t(spark, d, "documents").count(), 0.05)
    rows = [*sampling.quotas(sizes["train"], {"en": 0.65, "sw": 0.20, "sw_mix": 0.15}, "sw_mix").items(), *sizes.items()]
    return spark.createDataFrame(rows, "name string, n long")


@query(f"""
WITH r AS (SELECT source, row_number() OVER (ORDER BY {in_order('source')}, source) AS rank, count(*) OVER () AS t FROM (SELECT DISTINCT source FROM documents)),
q(lane, quota) AS (VALUES ('en', 650), ('sw', 200), ('sw_mix', 150)),
i AS (SELECT lane, unnest(range(quota)) AS index FROM q)
SELECT lane, index, index // t AS variant, source FROM i JOIN r ON index % t = rank - 1
""")
def round_robin_expand(spark, d):
    lanes = sampling.quotas(1000, {"en": 0.65, "sw": 0.20, "sw_mix": 0.15}, "sw_mix")
    return sampling.round_robin(t(spark, d, "documents"), "source", lanes, S.SEED)


def _strat_sql() -> str:
    ratios = " UNION ALL ".join(f"SELECT '{k}' AS lang, {round(400 * r)} AS q" for k, r in S.RATIOS.items())
    return f"""
WITH b AS (SELECT doc_id, lang, coalesce(quality = 0, false) AS w FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY {in_order('doc_id')}, doc_id) AS rank FROM b),
s AS (SELECT lang, count_if(w) AS nw, count_if(NOT w) AS no, any_value(q) AS q FROM b JOIN ({ratios}) USING (lang) GROUP BY lang),
s1 AS (SELECT *, least(CAST(round_even(q * 0.3, 0) AS BIGINT), nw) AS f FROM s),
s2 AS (SELECT *, least(greatest(q - f, 0), no) AS g FROM s1),
s3 AS (SELECT *, least(q - f - g, nw - f) AS h FROM s2),
m AS (SELECT r.*, CASE WHEN w THEN rank <= f + h ELSE rank <= g END AS chosen FROM r JOIN s3 USING (lang)),
x AS (SELECT *, row_number() OVER (ORDER BY {in_order('doc_id', S.SEED + 1)}, doc_id) AS k FROM m WHERE NOT chosen)
SELECT doc_id, lang, w AS wanted FROM m WHERE chosen
UNION ALL SELECT doc_id, lang, w FROM x WHERE k <= (SELECT 400 - sum(f + g + h) FROM s3)
"""


@query(_strat_sql())
def stratified_sample(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("wanted"))
    return sampling.stratified(rows, "doc_id", "lang", F.col("wanted"), 400, S.RATIOS, 0.3, S.SEED)


@query(f"""
WITH q(lang, per) AS (VALUES ('en', 13), ('de', 4), ('fr', 3)),
r AS (SELECT doc_id, lang, per, row_number() OVER (PARTITION BY lang ORDER BY {in_order('doc_id')}, doc_id) AS rank FROM documents JOIN q USING (lang)),
b AS (SELECT CASE WHEN count(*) = 3 THEN min(n // per) ELSE 0 END AS blocks FROM (SELECT lang, any_value(per) AS per, count(*) AS n FROM r GROUP BY lang)),
p AS (SELECT doc_id, lang, (rank - 1) // per AS block FROM r)
SELECT doc_id, lang, block, CAST(row_number() OVER (PARTITION BY block ORDER BY sha256('{S.SEED}:' || block || ':' || doc_id), doc_id) - 1 AS INTEGER) AS place FROM p, b WHERE block < blocks
""")
def rebalance_interleave(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return sampling.interleave(docs, "doc_id", "lang", {"en": 13, "de": 4, "fr": 3}, S.SEED)


@query("SELECT doc_id, lang, CAST(1 AS INTEGER) AS repeat FROM documents UNION ALL SELECT doc_id, lang, CAST(r AS INTEGER) FROM documents, range(2, 4) x(r) WHERE lang <> 'en'")
def upsample_lanes(spark, d):
    return sampling.upsample(t(spark, d, "documents").select("doc_id", "lang"), F.col("lang") != "en", 3).withColumn("repeat", F.coalesce("repeat", F.lit(1)))


@query(f"SELECT doc_id FROM documents ORDER BY {in_order('doc_id')}, doc_id LIMIT 100")
def seeded_take(spark, d):
    return sampling.take(t(spark, d, "documents"), 100, X.hash_order(F.col("doc_id"), S.SEED), "doc_id").select("doc_id")


# Conversations and rendering -----------------------------------------------------------------------


def conversations(spark, d):
    return projections.gather_messages(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


CONV = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id"


@query(rf"""
WITH c AS ({CONV}), f AS (SELECT CAST(conv_id AS VARCHAR) AS key,
  coalesce(list_transform(m, lambda x: x.role) IN (['user', 'assistant'], ['system', 'user', 'assistant']), false) AS roles,
  len(list_filter(m, lambda x: NOT coalesce(length(regexp_replace(x.content, '^\s+|\s+$', '', 'g')) > 0, false))) = 0 AS filled FROM c)
SELECT 'message_roles' AS "check", key FROM f WHERE NOT roles UNION ALL SELECT 'message_content', key FROM f WHERE NOT filled
""")
def conversation_violations(spark, d):
    return gates.row_violations(conversations(spark, d), "conv_id")


@query(rf"""
WITH u AS (SELECT conv_id, arg_max(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, regexp_replace(prompt, '^\s+|\s+$', '', 'g') AS prompt, regexp_replace(answer, '^\s+|\s+$', '', 'g') AS answer FROM u JOIN a USING (conv_id)
""")
def last_exchange(spark, d):
    c = conversations(spark, d)
    return c.select("conv_id", projections.extract_pair(c).alias("p")).where("p IS NOT NULL").select("conv_id", "p.*")


@query(rf"""
WITH c AS ({CONV})
SELECT conv_id, array_to_string(list_transform(m, lambda x: upper(x.role) || ':' || chr(10) || regexp_replace(x.content, '^\s+|\s+$', '', 'g')), chr(10) || chr(10)) || chr(10) || chr(10) || 'END' || chr(10) AS chat FROM c
""")
def chat_render(spark, d):
    return conversations(spark, d).select("conv_id", projections.chat_text(F.col("messages")).alias("chat"))


FENCED = "'```' || CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'javascript' END || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || lang || ' explanation of ' || source"
BODY = r"regexp_replace(regexp_extract_all(answer, '(?is)```(?:python|py|javascript|js)\s*\n(.*?)```', 1)[1], '^\s+|\s+$', '', 'g')"


def answers(spark, d):
    docs = t(spark, d, "documents").withColumn("runtime", F.when(F.col("doc_id") % 2 == 0, "python").otherwise("javascript")).withColumn("code", F.col("text"))
    said = {x: F.concat_ws(" explanation of ", "lang", "source") for x in S.LANES}
    return docs.withColumn("answer", projections.render_answer(F.col("runtime"), F.col("code"), F.col("lang"), said))


@query(rf"""
WITH a AS (SELECT doc_id, text AS code, {FENCED} AS answer FROM documents)
SELECT doc_id, answer, sha256({BODY}) AS body_sha256, {BODY} = regexp_replace(code, '^\s+|\s+$', '', 'g') AS locked FROM a
""")
def code_lock(spark, d):
    a = answers(spark, d)
    body = X.strip(F.get(X.fences(F.col("answer")), F.lit(0)))
    return a.select("doc_id", "answer", X.sha256(body).alias("body_sha256"), projections.keeps_code(F.col("answer"), F.col("code")).alias("locked"))


@query(rf"""
WITH a AS (SELECT source, lang, {FENCED} AS answer, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS declared FROM documents),
g AS (SELECT source, list_sort(list(DISTINCT lang)) AS lanes, count(DISTINCT declared) AS hashes FROM a GROUP BY source)
SELECT 'lane_set' AS "check", source AS key FROM g WHERE lanes <> {sql_list(S.LANES)}
UNION ALL SELECT 'declared_hash', source FROM g WHERE hashes <> 1
UNION ALL SELECT 'code_lock', source || ':' || lang FROM a WHERE sha256({BODY}) <> declared
""")
def parallel_violations(spark, d):
    a = answers(spark, d).withColumn("declared", X.sha256(X.strip(F.col("code"))))
    return gates.parallel_violations(a, "source", "lang", "declared", "answer", S.LANES)


@query(f"SELECT source, list_sort(list(DISTINCT lang)) = {sql_list(S.LANES)} AS complete, count(DISTINCT lang) AS lanes FROM documents GROUP BY source")
def group_completeness(spark, d):
    lanes = F.array_sort(F.collect_set("lang"))
    return t(spark, d, "documents").groupBy("source").agg(lanes.eqNullSafe(F.array(*[F.lit(x) for x in S.LANES])).alias("complete"), F.count_distinct("lang").alias("lanes"))


@query("""
WITH g AS (SELECT greatest(1, CAST(round_even(count(DISTINCT doc_id) * 0.9, 0) AS BIGINT)) AS expected FROM documents)
SELECT 'unique_texts' AS "check", lang AS key, count(DISTINCT text) AS actual, any_value(expected) AS expected FROM documents, g GROUP BY lang HAVING count(DISTINCT text) < any_value(expected)
""")
def uniqueness_floor(spark, d):
    return gates.uniqueness_violations(t(spark, d, "documents"), "doc_id", "lang", "text")


@query(r"""
SELECT doc_id, variant, CASE variant WHEN 0 THEN 'full' WHEN 1 THEN 'full' ELSE 'hint' END AS kind,
  CASE variant WHEN 0 THEN 'Explain: ' || source WHEN 1 THEN source || ' in ' || lang ELSE 'A hint for ' || source END AS prompt
FROM documents, (SELECT CAST(unnest(range(3)) AS INTEGER) AS variant) v WHERE lang <> 'en' OR variant < 2
""")
def lane_variants(spark, d):
    src = F.col("source")
    full = [F.concat(F.lit("Explain: "), src), F.concat_ws(" in ", src, "lang")]
    hints = {x: [F.concat(F.lit("A hint for "), src)] for x in S.LANES if x != "en"}
    made = projections.lane_variants(F.col("lang"), {x: full for x in S.LANES}, hints, src, src)
    return projections.expand_variants(t(spark, d, "documents"), made, "doc_id").select("doc_id", "variant", "kind", "prompt")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Write ' || source || ' in ' || lang WHEN 1 THEN lang || ': ' || source ELSE 'Task ' || source END AS prompt FROM documents")
def template_render(spark, d):
    wrappers = ("Write {requirement} in {runtime}", "{runtime}: {requirement}", "Task {requirement}")
    return t(spark, d, "documents").select("doc_id", projections.render_template(wrappers, F.col("doc_id"), requirement=F.col("source"), runtime=F.col("lang")).alias("prompt"))


@query("""
SELECT c_custkey, language, value FROM (SELECT c_custkey, c_name AS v_en, c_mktsegment AS v_sw, CASE WHEN c_acctbal > 0 THEN c_name END AS v_af FROM customer)
UNPIVOT (value FOR language IN (v_en AS 'en', v_sw AS 'sw', v_af AS 'af'))
""")
def language_columns(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("v_en"), F.col("c_mktsegment").alias("v_sw"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("v_af"))
    return projections.by_language(c, "v", ["en", "sw", "af"], "value", "c_custkey")


@query("SELECT d.doc_id, d.lang, coalesce('q' || l.quality, d.source) AS source, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def overlay_fields(spark, d):
    fields = t(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("source"), "toxic")
    return projections.overlay(t(spark, d, "documents").select("doc_id", "lang", "source"), fields, "doc_id").withColumn("toxic", F.coalesce("toxic", F.lit(-1)))


# Text ----------------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)>\s*indented block', ' ', 'g'), '^\s*#+\s*', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM pages")
def html_clean(spark, d):
    return t(spark, d, "pages").select("page_id", X.clean_prompt(F.col("html")).alias("cleaned"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(replace(text, '```', ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS cleaned FROM documents")
def translation_clean(spark, d):
    return t(spark, d, "documents").select("doc_id", X.clean_translation(F.col("text")).alias("cleaned"))


@query(r"""
WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\.+$', '') AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 260 THEN regexp_replace(regexp_replace(substr(x, 1, 260), ' [^ ]*$', ''), '[ ,;:]+$', '') || '…' ELSE x END AS explanation FROM f
""")
def bounded_explanation(spark, d):
    return t(spark, d, "documents").select("doc_id", X.bounded(F.col("text")).alias("explanation"))


@query(r"""
WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\.+$', ''), '(?i)\s+and the.*$', '') AS x FROM documents)
SELECT doc_id, 'It does: ' || regexp_replace(x, '[ .]+$', '') || '. Nothing else.' AS framed FROM f
""")
def framed_explanation(spark, d):
    return t(spark, d, "documents").select("doc_id", X.framed(F.col("text"), "It does: ", ". Nothing else.", "and the").alias("framed"))


DEFS = "'def f' || doc_id % 7 || '(x):' || chr(10) || '    return x' || chr(10) || 'class C' || doc_id % 3 || ':' || chr(10) || '    pass' || chr(10) || 'def f1(y): return y'"


def rendered_code():
    return F.concat(F.lit("def f"), (F.col("doc_id") % 7).cast("string"), F.lit("(x):\n    return x\nclass C"), (F.col("doc_id") % 3).cast("string"), F.lit(":\n    pass\ndef f1(y): return y"))


@query(rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({DEFS}, '(?m)^\s*(?:def|class)\s+([A-Za-z_]\w*)', 1))), ', ') AS names FROM documents")
def identifier_note(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(X.defined_names(rendered_code()), ", ").alias("names"))


SNIPPET = "CASE doc_id % 6 WHEN 0 THEN 'import os; ' WHEN 1 THEN 'from sys import x; ' WHEN 2 THEN 'open (f); ' WHEN 3 THEN 'eval(x); ' WHEN 4 THEN 'require( ''fs''); ' ELSE '' END || text"


def snippet():
    m = F.col("doc_id") % 6
    lead = F.when(m == 0, "import os; ").when(m == 1, "from sys import x; ").when(m == 2, "open (f); ").when(m == 3, "eval(x); ").when(m == 4, "require( 'fs'); ").otherwise("")
    return F.concat(lead, F.col("text"))


def _reason_sql() -> str:
    cases = " ".join("WHEN regexp_matches(code, '(?i){0}') THEN '{0}'".format(p.replace("'", "''")) for p in filters.UNSAFE_PATTERNS)
    return f"WITH c AS (SELECT doc_id, {SNIPPET} AS code FROM documents) SELECT doc_id, CASE {cases} END AS reason FROM c"


@query(_reason_sql())
def unsafe_reason(spark, d):
    return t(spark, d, "documents").select("doc_id", filters.unsafe_reason(snippet()).alias("reason"))


@query(r"WITH c AS (SELECT doc_id, " + SNIPPET + r" AS code FROM documents) SELECT doc_id FROM c WHERE NOT regexp_matches(code, '(?i)" + filters.INCOMPLETE + "') AND NOT regexp_matches(code, '(?i)" + filters.UNSAFE_MARKERS.replace("'", "''") + "')")
def complete_and_safe(spark, d):
    return t(spark, d, "documents").where(filters.is_complete_and_safe(snippet())).select("doc_id")


def _script_sql() -> str:
    cases = " ".join(f"WHEN contains(flat, '{m.replace(' ', '')}') THEN '{m}'" for m in filters.SCRIPT_BANNED)
    return rf"WITH c AS (SELECT doc_id, regexp_replace(lower({SNIPPET}), '\s+', '', 'g') AS flat FROM documents) SELECT doc_id, CASE {cases} END AS reason FROM c"


@query(_script_sql())
def script_reason(spark, d):
    return t(spark, d, "documents").select("doc_id", filters.script_reason(snippet()).alias("reason"))


@query(rf"WITH c AS (SELECT doc_id, {SNIPPET} AS code FROM documents) SELECT doc_id, CASE WHEN regexp_matches(code, '(?i)(?:^|[^\w$])eval\s*\(') THEN 'eval(' WHEN regexp_matches(code, '(?i)\.sort\s*\(') THEN '.sort(' WHEN regexp_matches(code, '(?i)(?:^|[^\w$])open\s*\(') THEN 'open' END AS forbidden FROM c")
def forbidden_calls(spark, d):
    names = F.array(F.lit("eval("), F.lit(".sort("), F.lit("open"))
    return t(spark, d, "documents").select("doc_id", X.forbidden_call(snippet(), names).alias("forbidden"))


def _evidence_sql(least: str = "") -> str:
    lists = " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in S.LEXICON.items())
    return rf"""WITH w AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(replace(lower(regexp_replace(text, '(?s)```.*?```', ' ', 'g')), 'ß', 'ss'), '[\p{{L}}\p{{Nl}}\p{{No}}]+')) AS w, CASE lang {lists} END AS l FROM documents),
h AS (SELECT doc_id, lang, list_sort(list_intersect(w, l)) AS hits FROM w)"""


@query(_evidence_sql() + " SELECT doc_id, len(hits) AS evidence_count, array_to_string(hits, ',') AS evidence_words FROM h")
def language_evidence(spark, d):
    hits = F.coalesce(*[F.when(F.col("lang") == k, X.lexicon_hits(F.col("text"), v)) for k, v in S.LEXICON.items()])
    return t(spark, d, "documents").select("doc_id", hits.alias("h")).select("doc_id", F.size("h").cast("long").alias("evidence_count"), F.array_join("h", ",").alias("evidence_words"))


@query(_evidence_sql() + " SELECT lang, count(*) AS n, count_if(len(hits) >= 3) AS adherent FROM h GROUP BY lang")
def language_adherence(spark, d):
    ok = F.coalesce(*[F.when(F.col("lang") == k, X.is_adherent(F.col("text"), v, 3)) for k, v in S.LEXICON.items()])
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(ok).alias("adherent"))


@query(r"WITH p AS (SELECT doc_id, string_split_regex(text, '(?i)\b(?:and|of the|the)\b') AS parts, regexp_extract_all(text, '(?i)\b(?:and|of the|the)\b') AS found FROM documents WHERE lang = 'en') SELECT doc_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i > len(found) THEN '' WHEN lower(found[i]) = 'and' THEN 'plus' WHEN lower(found[i]) = 'the' THEN 'that' ELSE 'from the' END), '') AS replaced FROM p")
def lexicon_substitute(spark, d):
    return t(spark, d, "documents").where("lang = 'en'").select("doc_id", X.substitute(F.col("text"), S.SUBSTITUTES).alias("replaced"))


@query()
def phrase_substitute(spark, d):
    made = X.substitute_phrases(F.col("text"), S.PHRASES)
    return t(spark, d, "documents").select("doc_id", made.alias("s")).select("doc_id", "s.text", F.array_join(F.transform("s.hits", lambda h: h["source"]), ",").alias("phrases"))


@query()
def token_restore(spark, d):
    source = F.concat(F.lit("O(n) == None Python <= "), F.col("source"))
    target = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("python "), F.col("lang"))).otherwise(source)
    return t(spark, d, "documents").select("doc_id", X.restore_tokens(source, target, "Kept: ").alias("restored"))


@query(r"SELECT doc_id, text || CASE WHEN len(f) = 0 THEN '' ELSE ' Terms: ' || array_to_string(f, ', ') || '.' END AS kept FROM (SELECT doc_id, text, list_filter([CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])thes?(?:[^\p{L}\p{N}_]|$)') THEN 'the' END, CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])ques?(?:[^\p{L}\p{N}_]|$)') THEN 'que' END, CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])ders?(?:[^\p{L}\p{N}_]|$)') THEN 'der' END], lambda x: x IS NOT NULL) AS f FROM documents)")
def append_terms(spark, d):
    return t(spark, d, "documents").select("doc_id", X.append_terms(F.col("text"), F.col("text"), ("the", "que", "der"), " Terms: ").alias("kept"))


@query()
def repeated_word_collapse(spark, d):
    return t(spark, d, "documents").where(X.collapses(F.col("text"))).select("doc_id")


TOKENS = r"list_distinct(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z]+|[0-9]+(?:\.[0-9]+)?'))"


@query(f"WITH f AS (SELECT source, arg_min(text, doc_id) AS first FROM documents GROUP BY source), w AS (SELECT doc_id, {TOKENS.format('text')} AS a, {TOKENS.format('first')} AS b FROM documents JOIN f USING (source)) SELECT doc_id, 2 * len(list_intersect(a, b)) / greatest(1, len(a) + len(b)) AS f1 FROM w")
def token_f1(spark, d):
    docs = t(spark, d, "documents")
    first = dedup.first_value(docs, "source", "text", "doc_id").withColumnRenamed("text", "first")
    return docs.join(first, "source").select("doc_id", X.overlap_f1(X.ascii_tokens(F.col("text")), X.ascii_tokens(F.col("first"))).alias("f1"))


def document_pairs(spark, d):
    """Each document with the first one, by id, of its source and language: rows doc_id, text, first."""
    docs = t(spark, d, "documents").select("doc_id", "text", "source", "lang")
    firsts = docs.groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("first")).withColumnsRenamed({"source": "s", "lang": "l"})
    return docs.join(firsts, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l"))).select("doc_id", "text", "first")


PAIRS = "SELECT doc_id, text, first_value(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS first FROM documents"


def _anchor_sql() -> str:
    tests = " AND ".join(f"(len(list_intersect(a, {sql_list(x)})) > 0) = (len(list_intersect(b, {sql_list(x)})) > 0)" for x in [*[y for g in S.ANCHORS for y in g], S.NEGATIONS])
    num = r"list_sort(list_distinct(regexp_extract_all({}, '[0-9]+(?:\.[0-9]+)?')))"
    return f"WITH w AS (SELECT doc_id, {TOKENS.format('text')} AS a, {TOKENS.format('first')} AS b, {num.format('text')} AS x, {num.format('first')} AS y FROM ({PAIRS})) SELECT doc_id, x = y AND {tests} AS kept FROM w"


@query(_anchor_sql())
def anchor_check(spark, d):
    return document_pairs(spark, d).select("doc_id", X.anchors_kept(F.col("text"), F.col("first"), S.ANCHORS, S.NEGATIONS).alias("kept"))


def normalized(spark, d, name="documents", key="doc_id"):
    return t(spark, d, name).select(key, X.normalized_words(F.col("text"), S.ALIASES, S.STOP).alias("words"))


NORMAL = rf"list_distinct(list_filter(list_transform(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{Nl}}\p{{No}}]{{3,}}'), lambda w: CASE WHEN w LIKE '%s' AND length(w) > 4 THEN substr(w, 1, length(w) - 1) ELSE w END), lambda w: CASE w WHEN 'that' THEN 'this' WHEN 'tion' THEN 'ation' ELSE w END), lambda w: NOT list_contains({sql_list(S.STOP)}, w)))"


@query(f"""
WITH w AS (SELECT doc_id, {NORMAL} AS w FROM documents)
SELECT a, b, CASE WHEN i = 0 AND u = 0 THEN 1.0 ELSE i / u END AS jaccard FROM (
  SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)) AS u
  FROM w x JOIN w y ON x.doc_id < y.doc_id AND least(len(x.w), len(y.w)) >= 0.7 * greatest(len(x.w), len(y.w)) - 1e-9)
WHERE u = 0 OR i / u >= 0.7
""")
def jaccard_pairs(spark, d):
    return similarity.jaccard_pairs(normalized(spark, d), "doc_id", "words", 0.70)


@query()
def paraphrase_pairs(spark, d):
    return similarity.paraphrase_pairs(normalized(spark, d), "doc_id", "words")


@query()
def semantic_score(spark, d):
    a, b = X.ascii_tokens(F.col("text")), X.ascii_tokens(F.col("first"))
    ratio = PY.sequence_ratio_udf(F.array_join(a, " "), F.array_join(b, " "))
    return document_pairs(spark, d).select("doc_id", F.bround((X.overlap_f1(a, b) + ratio) / 2, 4).alias("score"))


@query(rf"WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```py' || chr(10) || text ELSE {FENCED} END AS answer FROM documents) SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(answer, '(?is)```(?:python|py|javascript|js)?\s*\n(.*?)```') THEN regexp_extract(answer, '(?is)```(?:python|py|javascript|js)?\s*\n(.*?)```', 1) ELSE regexp_extract(answer, '(?is)```(?:python|py|javascript|js)?\s*\n(.*)$', 1) END, '^\s+|\s+$', '', 'g') AS code, regexp_matches(answer, '(?is)```(?:python|py|javascript|js)?\s*\n(.*?)```') AS closed FROM a")
def fence_extract(spark, d):
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```py\n"), F.col("text"))).otherwise(F.col("answer"))
    return answers(spark, d).select("doc_id", X.extract_code(answer).alias("c")).select("doc_id", "c.code", "c.closed")


@query(r"SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: length(regexp_replace(x, '\s+', '', 'g')) > 0)) AS filled, right(text, 100) AS tail, greatest(1, len(list_filter(l, lambda x: contains(x, 'the')))) AS with_word FROM (SELECT doc_id, text, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents)")
def line_counts(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", F.size(F.split(text, r"\R", -1)).cast("long").alias("n_lines"), F.size(X.non_blank_lines(text)).cast("long").alias("filled"), X.tail(text, 100).alias("tail"), X.lines_with(text, "the").cast("long").alias("with_word"))


@query(r"SELECT doc_id, matched / 3.0 >= 0.75 AS passed, round_even(matched / 3.0, 4) AS score FROM (SELECT doc_id, CAST(regexp_matches(text, '(?i)tion') AS INT) + CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])the(?:[^\p{L}\p{N}_]|$)') AS INT) + CAST(regexp_matches(text, '(?i)[.]$') AS INT) AS matched FROM documents)")
def rubric_grade(spark, d):
    share = X.share_matched(F.col("text"), ("tion", r"\bthe\b", "[.]$"))
    return t(spark, d, "documents").select("doc_id", (share >= 0.75).alias("passed"), F.bround(share, 4).alias("score"))


@query("""
SELECT doc_id, 'format_' || CASE WHEN n <= 20 THEN 'fence' WHEN n <= 35 THEN 'json' ELSE 'bullets' END || '_' || lpad(CAST(n AS VARCHAR), 2, '0') AS id,
  CASE WHEN n <= 20 THEN 'exact_fence' WHEN n <= 35 THEN 'exact_json' ELSE 'exact_bullets' END AS contract, ['en', 'sw', 'sw_mix'][(n - 1) % 3 + 1] AS language
FROM (SELECT doc_id, doc_id % 50 + 1 AS n FROM documents)
""")
def format_probes(spark, d):
    """Each document with its probe, of a table of fifty that the code holds."""
    probes = readers.format_probes(spark, 20, 15, 15, ["en", "sw", "sw_mix"])
    docs = t(spark, d, "documents").select("doc_id", (F.pmod("doc_id", F.lit(50)) + 1).alias("ordinal"))
    return joins.lookup(docs, probes, "ordinal").select("doc_id", "id", "contract", "language")


@query("SELECT event_id, event_id % 4 <> 3 AS passed, CASE event_id % 4 WHEN 3 THEN 'JSON keys or values changed' ELSE 'passed' END AS reason FROM events")
def json_contract(spark, d):
    expected = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit('{"k": -'), F.get_json_object("props", "$.k"), F.lit("1}"))).otherwise(F.col("props"))
    return t(spark, d, "events").select("event_id", X.json_exact(F.col("props"), expected).alias("g")).select("event_id", "g.*")


@query("SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS rendered FROM events")
def compact_json(spark, d):
    return t(spark, d, "events").select("event_id", X.compact_json("event_type", "user_id").alias("rendered"))


@query("SELECT event_id, CAST(event_id % 50 + 1 AS INTEGER) AS number, CAST(50 AS INTEGER) AS total, 'task' || user_id AS task, event_type AS language, CAST(NULL AS BOOLEAN) AS passed, CAST(NULL AS DOUBLE) AS seconds FROM events UNION ALL SELECT event_id, 0, 0, NULL, NULL, value > 20, round(value, 1) FROM events")
def log_parse(spark, d):
    e = t(spark, d, "events")
    head = e.select("event_id", F.format_string("[%02d/50] task%d %s", F.col("event_id") % 50 + 1, F.col("user_id"), F.col("event_type")).alias("value"))
    tail = e.select("event_id", F.concat(F.lit("  "), F.when(F.col("value") > 20, "PASS").otherwise("FAIL"), F.lit(" | "), F.round("value", 1).cast("string"), F.lit("s")).alias("value"))
    noise = e.select("event_id", F.lit("loading").alias("value"))
    return readers.parse_progress(head.unionByName(tail).unionByName(noise)).na.fill(0, ["number", "total"])


# Evaluation ----------------------------------------------------------------------------------------


def results(spark, d):
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    n = F.col("n_chars")
    return docs.select(
        "doc_id", F.col("source").alias("task_id"), F.col("lang").alias("language"), F.when(n > 800, "code").otherwise("explanation").alias("kind"),
        (F.col("quality") == 1).alias("technical_pass"), (F.col("toxic") == 0).alias("format_compliant"), F.endswith("text", F.lit(".")).alias("side_effect_free"), (n > 100).alias("language_adherent"),
        (n / 100).alias("inference_seconds"), F.when(n % 7 > 0, n % 100).alias("completion_tokens"), F.when(F.col("doc_id") % 50 == 0, "timeout").alias("error"), "text",
    )


RESULTS = "SELECT doc_id, source AS task_id, lang AS language, CASE WHEN n_chars > 800 THEN 'code' ELSE 'explanation' END AS kind, quality = 1 AS ok, toxic = 0 AS fmt, text LIKE '%.' AS clean, n_chars > 100 AS adh, n_chars / 100 AS sec, CASE WHEN n_chars % 7 > 0 THEN n_chars % 100 END AS tok, doc_id % 50 = 0 AS err, text FROM documents JOIN labels USING (doc_id)"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE round_even({a} / {b}, 4) END"


@query(f"""
WITH r AS ({RESULTS}), n AS (SELECT language,
  count_if(NOT err) AS responses, count_if(err) AS error_rows, count_if(NOT err AND kind = 'code' AND ok) AS code_passed, count_if(NOT err AND kind = 'code') AS code_total,
  count_if(NOT err AND kind = 'code' AND fmt) AS format_compliant, count_if(NOT err AND kind = 'code' AND clean) AS side_effect_free,
  count_if(NOT err AND kind <> 'code' AND ok) AS explanations_passed, count_if(NOT err AND kind <> 'code') AS explanations_total,
  count_if(NOT err AND ok) AS overall_passed, count_if(NOT err) AS overall_total, count_if(NOT err AND adh) AS language_adherent,
  round_even(avg(sec) FILTER (NOT err), 3) AS mean_inference_seconds, round_even(median(sec) FILTER (NOT err), 3) AS median_inference_seconds,
  round_even(avg(tok) FILTER (NOT err), 2) AS mean_completion_tokens, CAST(coalesce(sum(tok) FILTER (NOT err), 0) AS BIGINT) AS total_completion_tokens FROM r GROUP BY language)
SELECT *, {_rate('code_passed', 'code_total')} AS code_pass_rate, {_rate('format_compliant', 'code_total')} AS format_compliance_rate, {_rate('side_effect_free', 'code_total')} AS side_effect_free_rate,
  {_rate('explanations_passed', 'explanations_total')} AS explanation_pass_rate, {_rate('overall_passed', 'overall_total')} AS overall_pass_rate, {_rate('language_adherent', 'overall_total')} AS language_adherence_rate FROM n
""")
def lane_summary(spark, d):
    return evaluation.lane_summary(results(spark, d))


PASSES = f"WITH r AS ({RESULTS}), p AS (SELECT task_id, " + ", ".join(f"bool_or(ok) FILTER (language = '{x}') AS {x}" for x in S.LANES) + " FROM r WHERE NOT err GROUP BY task_id), c AS (SELECT * FROM p WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in S.LANES) + ")"


@query(PASSES + f" SELECT complete_sets, all_passed, {_rate('all_passed', 'complete_sets')} AS all_pass_rate FROM (SELECT count(*) AS complete_sets, count_if({' AND '.join(S.LANES)}) AS all_passed FROM c)")
def all_lanes_pass(spark, d):
    return evaluation.pass_all_rate(results(spark, d), S.LANES)


@query(PASSES + " " + " UNION ALL ".join(f"SELECT '{x}' AS language, count_if({x} = en) AS same_outcome, count_if({x} AND en) AS both_pass, count_if(NOT {x} AND en) AS only_base_passes FROM c" for x in S.LANES if x != "en"))
def paired_parity(spark, d):
    return evaluation.paired_parity(results(spark, d), S.LANES)


@query(f"WITH r AS ({RESULTS}) SELECT CASE WHEN kind IS NULL THEN 'language' ELSE 'kind' END AS dimension, coalesce(kind, language) AS value, count_if(ok) AS passed, count(*) AS total FROM r GROUP BY GROUPING SETS ((kind), (language))")
def breakdown_sets(spark, d):
    return evaluation.breakdown(results(spark, d), "kind", "language", F.col("technical_pass"))


@query(f"WITH r AS ({RESULTS}), n AS (SELECT language, count_if(contains(text, '###') OR contains(text, '%%%')) AS hits, count(*) AS total FROM r GROUP BY language) SELECT *, {_rate('hits', 'total')} AS rate FROM n")
def marker_rate(spark, d):
    return evaluation.marker_rate(results(spark, d), F.col("text"), ("###", "%%%"), "language")


@query(f"WITH r AS ({RESULTS}) SELECT doc_id, language FROM r WHERE NOT err AND coalesce(sec >= 4, false) AND coalesce(ok, false) AND coalesce(coalesce(tok, 0) >= 1 AND sec / nullif(coalesce(tok, 0), 0) >= 0.5, false)")
def score_thresholds(spark, d):
    rows = filters.without_errors(results(spark, d))
    tokens = F.coalesce("completion_tokens", F.lit(0))
    return rows.where(filters.scores_pass({"inference_seconds": 4.0}, F.col("technical_pass")) & filters.ratio_at_least(F.col("inference_seconds"), tokens, 0.5)).select("doc_id", "language")


@query("SELECT count(*) AS keys, CAST(sum(q) AS BIGINT) AS c_nationkey, CAST(sum(b) AS BIGINT) AS orders FROM (SELECT o_custkey, arg_max(c_nationkey, o_orderkey) AS q, arg_max(o_orderkey % 10, o_orderkey) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)")
def sum_once_per_key(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("orders", F.col("o_orderkey") % 10)
    return evaluation.sum_once_per_key(rows, "o_custkey", "o_orderkey", "c_nationkey", "orders")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def merge_last_wins(spark, d):
    return dedup.keep_last(t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), F.struct("user_id", "event_type"), "event_id")


@query("""
WITH a AS (SELECT user_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS run, event_id FROM events),
m AS (SELECT user_id, event_type, run AS source_run, max(value) AS value FROM a GROUP BY ALL)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY source_run DESC) = 1
""")
def merge_runs(spark, d):
    e = t(spark, d, "events")
    runs = [e.where(F.col("event_id") % 3 == k).groupBy("user_id", "event_type").agg(F.max("value").alias("value")) for k in (1, 2, 0)]
    return dedup.merge_runs(runs, "user_id", "event_type")


@query("WITH a AS (SELECT user_id, value > 30 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, count(*) AS attempts, arg_min(ok, k) AS passed_first, bool_or(ok AND k <= 2) AS passed_in_two, bool_or(ok) AS passed FROM a GROUP BY user_id")
def attempts_pass_at_k(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "value")
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return evaluation.attempts_summary(e.withColumn("k", k).withColumn("ok", F.col("value") > 30), "user_id", "k", "ok")


@query("""
WITH a AS (SELECT user_id, value, value > 30 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
u AS (SELECT user_id, arg_min(ok, k) AS p1, bool_or(ok AND k <= 2) AS p2, bool_or(ok) AS p, sum(value) AS s, user_id % 2 = 0 AS py FROM a GROUP BY user_id)
SELECT count_if(p) AS passed, count(*) AS total, count_if(p1) AS pass_at_1, count_if(p2) AS pass_at_2, count_if(py AND p) AS python_passed, count_if(py) AS python_total, count_if(NOT py AND p) AS javascript_passed, count_if(NOT py) AS javascript_total, round_even(sum(s), 2) AS duration_seconds, round_even(count_if(p) / count(*), 4) AS pass_rate FROM u
""")
def repair_summary(spark, d):
    s = attempts_pass_at_k(spark, d).join(t(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("duration_seconds")), "user_id")
    rows = s.select("passed", F.col("passed_first").alias("passed_first_attempt"), "passed_in_two", F.when(F.col("user_id") % 2 == 0, "python").otherwise("javascript").alias("language"), "duration_seconds")
    return evaluation.repair_summary(rows)


@query("SELECT event_type, count(*) AS profiler_runs, round_even(median(value), 4) AS median_tps, round_even(max(value * 100), 4) AS highest_peak_rss_mb FROM events GROUP BY event_type")
def telemetry_rollup(spark, d):
    # Values have two digits and medians at most three: no rounding to four is a tie, which engines break differently.
    return evaluation.telemetry(t(spark, d, "events").withColumn("rss", F.col("value") * 100), "value", "rss", "event_type", digits=4)


MODELS = "SELECT event_type AS label, 100 * (0.30 * avg(CAST(value > 10 AS INT)) + 0.25 * avg(CAST(value > 20 AS INT)) + 0.25 * avg(CAST(value > 30 AS INT)) + 0.20 * avg(CAST(user_id % 2 AS INT))) AS acc, CASE WHEN event_type <> 'view' THEN avg(value) END AS tps, CASE WHEN event_type <> 'view' THEN 10 * max(value) END AS rss FROM events GROUP BY event_type"


@query(f"""
WITH m AS ({MODELS}), c AS (SELECT label, round_even(acc, 2) AS estimated_accuracy, CASE WHEN tps IS NOT NULL THEN round_even(0.5 * acc + 0.3 * least(tps / 15, 1) * 100 + 0.2 * greatest(0, (7 - rss / 1024) / 7) * 100, 2) END AS estimated_total FROM m)
SELECT *, CASE WHEN estimated_total IS NULL THEN 'estimated_accuracy' ELSE 'estimated_total' END AS score_basis, CAST(row_number() OVER (ORDER BY coalesce(estimated_total, estimated_accuracy) DESC, estimated_accuracy DESC, label) AS INTEGER) AS rank FROM c
""")
def composite_rank(spark, d):
    rate = lambda c: F.avg(c.cast("int"))
    v = F.col("value")
    m = t(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(rate(v > 10).alias("en"), rate(v > 20).alias("sw"), rate(v > 30).alias("sw_mix"), rate(F.col("user_id") % 2 == 1).alias("format"), F.avg(v).alias("tps"), (10 * F.max(v)).alias("rss"))
    m = m.withColumn("acc", evaluation.accuracy({k: F.col(k) for k in evaluation.ACCURACY_WEIGHTS}))
    seen = F.col("label") != "view"
    total = evaluation.composite(F.col("acc"), F.when(seen, F.col("tps")), F.when(seen, F.col("rss")))["estimated_total"]
    return evaluation.rank_models(m.select("label", F.bround("acc", 2).alias("estimated_accuracy"), total.alias("estimated_total")), "estimated_total", "estimated_accuracy", "label")


def _sides() -> dict[str, str]:
    rates = {"en": "l_discount >= 0.02", "en_code": "l_quantity > 5", "sw": "l_tax <= 0.06", "sw_mix": "l_discount <= 0.09", "fmt": "l_quantity >= 1", "p1": "l_linenumber <= 3", "p2": "l_linenumber <= 5", "adh_sw": "l_quantity > 8", "adh_mix": "l_tax >= 0.01", "tps": "l_extendedprice > 1000", "rss": "l_extendedprice > 90000"}
    return {f"{side}_{k}": f"count_if(l_returnflag = '{flag}' AND {c}) / count_if(l_returnflag = '{flag}')" for side, flag in (("b", "A"), ("c", "N")) for k, c in rates.items()}


def gate_metrics(spark, d):
    return t(spark, d, "lineitem").agg(*[F.expr(e).alias(k) for k, e in _sides().items()])


METRICS = "WITH m AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in _sides().items()) + " FROM lineitem)"


def _sides_of() -> tuple[dict, dict, dict]:
    c, b = ({k: F.col(f"{side}_{k}") for k in ("en", "en_code", "sw", "sw_mix")} for side in "cb")
    return c, b, {"candidate_1": F.col("c_p1"), "base_1": F.col("b_p1"), "candidate_2": F.col("c_p2"), "base_2": F.col("b_p2")}


@query(METRICS + """ SELECT "check", ok FROM (SELECT unnest(map_entries(MAP {'raw_model_only_evaluation': true, 'english_overall_not_below_base': c_en >= b_en, 'english_executable_code_not_below_base': c_en_code >= b_en_code,
  'kiswahili_at_least_75_percent': c_sw >= 0.75, 'kiswahili_gain_at_least_10_points': c_sw >= b_sw + 0.10, 'code_switching_at_least_85_percent': c_sw_mix >= 0.85, 'code_switching_gain_at_least_15_points': c_sw_mix >= b_sw_mix + 0.15,
  'format_compliance_at_least_98_percent': c_fmt >= 0.98, 'repair_pass_at_1_not_below_base': c_p1 >= b_p1, 'repair_pass_at_2_not_below_base': c_p2 >= b_p2})) AS e FROM m) x, LATERAL (SELECT e.key AS "check", e.value AS ok)""")
def checkpoint_gate(spark, d):
    c, b, r = _sides_of()
    return gates.check_rows(gates.gate(gate_metrics(spark, d), gates.checkpoint_checks(F.lit(True), c, b, r, [F.col("c_fmt"), F.col("c_fmt")])))


@query(METRICS + """ SELECT "check", ok FROM (SELECT unnest(map_entries(MAP {'raw_model_only_evaluation': true, 'kiswahili_at_least_75_percent': c_sw >= 0.75, 'kiswahili_gain_at_least_10_points': c_sw - b_sw >= 0.10,
  'kiswahili_code_switching_at_least_85_percent': c_sw_mix >= 0.85, 'kiswahili_code_switching_gain_at_least_15_points': c_sw_mix - b_sw_mix >= 0.15, 'english_not_below_base': c_en >= b_en, 'english_executable_code_not_below_base': c_en_code >= b_en_code,
  'all_language_formats_at_least_98_percent': c_fmt >= 0.98, 'kiswahili_language_adherence_at_least_80_percent': c_adh_sw >= 0.80, 'code_switch_language_adherence_at_least_80_percent': c_adh_mix >= 0.80,
  'repair_pass_at_1_not_lower': c_p1 >= b_p1, 'repair_pass_at_2_not_lower': c_p2 >= b_p2, 'throughput_within_3_percent': 10 * c_tps >= 10 * b_tps * 0.97, 'peak_ram_within_128_mb': 8000 * c_rss <= 8000 * b_rss + 128, 'peak_ram_below_7_gb': 8000 * c_rss < 7168})) AS e FROM m) x, LATERAL (SELECT e.key AS "check", e.value AS ok)""")
def release_gate(spark, d):
    c, b, r = _sides_of()
    speed = {"candidate": 10 * F.col("c_tps"), "base": 10 * F.col("b_tps")}
    memory = {"candidate": 8000 * F.col("c_rss"), "base": 8000 * F.col("b_rss")}
    checks = gates.release_checks(F.lit(True), c, b, r, [F.col("c_fmt"), F.col("c_fmt")], {"sw": F.col("c_adh_sw"), "sw_mix": F.col("c_adh_mix")}, speed, memory)
    return gates.check_rows(gates.gate(gate_metrics(spark, d), checks))


@query("SELECT event_id, event_type = 'click' AND user_id % 2 = 0 AND user_id % 3 > 0 AS direct FROM events")
def direct_mode(spark, d):
    e = t(spark, d, "events")
    rows = e.select("event_id", (F.col("event_type") == "click").alias("model_only"), F.when(F.col("user_id") % 2 == 0, "direct").otherwise("reviewed").alias("application_prompt_strategy"), F.lit(None).cast("boolean").alias("application_contract"), F.lit(False).alias("self_review"), F.lit(None).cast("boolean").alias("translate_then_solve"), F.when(F.col("user_id") % 3 == 0, F.lit(True)).alias("nllb_roundtrip_explanations"), F.lit(None).cast("string").alias("nllb_model"))
    return rows.select("event_id", filters.is_direct_model().alias("direct"))


# Incremental work ----------------------------------------------------------------------------------


@query("SELECT c_custkey AS user_id, language FROM customer, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS language) l WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c_custkey AND e.event_type = language)")
def resume_pending(spark, d):
    work = joins.grid(t(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), ["click", "error", "purchase", "signup", "view"])
    return joins.pending(work, t(spark, d, "events").select("user_id", F.col("event_type").alias("language")).distinct(), "user_id", "language")


@query("WITH k AS (SELECT doc_id, source || ':' || lang AS id, value > 20 AS p FROM documents JOIN events ON doc_id = event_id) SELECT doc_id, id, p AS passed FROM k WHERE NOT (NOT p AND doc_id % 2 = 0)")
def rerun_failures(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "events"), F.col("doc_id") == F.col("event_id")).select("doc_id", X.result_key(F.col("source"), F.col("lang")).alias("id"), (F.col("value") > 20).alias("passed"))
    return joins.rerun_failures(rows, rows.where(F.col("doc_id") % 2 == 0), "doc_id")


@query("SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels USING (doc_id))")
def cache_misses(spark, d):
    docs = t(spark, d, "documents").select("doc_id", X.sha256(F.col("text")).alias("key"))
    return joins.cache_misses(docs, docs.join(t(spark, d, "labels"), "doc_id", "left_semi"), "key")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, quality IS NOT NULL AS hit FROM documents LEFT JOIN labels USING (doc_id)")
def cache_lookup(spark, d):
    return joins.through_cache(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id", "quality").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def lookup_counts(spark, d):
    s = t(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return joins.lookup(s, t(spark, d, "nation"), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("suppliers"))


@query("SELECT user_id, c_nationkey AS ordinal, event_type, CAST(list_position(['view', 'click'], event_type) - 1 AS INTEGER) AS language_ordinal FROM events JOIN customer ON c_custkey = user_id WHERE event_type IN ('view', 'click')")
def ordinal_sort(spark, d):
    tasks = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("ordinal"))
    rows = joins.in_order(t(spark, d, "events").select("user_id", "event_type"), tasks, "user_id", "ordinal", "event_type", ["view", "click"])
    return rows.select("user_id", "ordinal", "event_type", "language_ordinal").orderBy("ordinal", "user_id", "language_ordinal")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def top_scores(spark, d):
    return joins.ranked_top(t(spark, d, "part").select("p_partkey", "p_retailprice"), 50, F.desc("p_retailprice"), F.col("p_partkey"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, least(p_retailprice, p_size * 30.0) AS score FROM part ORDER BY least(p_retailprice, p_size * 30.0) DESC, CAST(p_partkey AS VARCHAR) LIMIT 50")
def top_least_scores(spark, d):
    score = F.least(F.col("p_retailprice"), F.col("p_size") * 30.0)
    return joins.ranked_top(t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), score.alias("score")), 50, F.desc("score"), F.col("id"))


@query("SELECT count(*) AS found, CAST(600 AS BIGINT) AS wanted, greatest(0, 600 - count(*)) AS short FROM documents WHERE lang = 'en'")
def shortfall(spark, d):
    return joins.shortfall(t(spark, d, "documents").where("lang = 'en'"), 600)


@query("SELECT doc_id AS id, lang FROM documents UNION ALL SELECT item_id, NULL FROM benchmark")
def union_sources(spark, d):
    return joins.union_all([t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), t(spark, d, "benchmark").select(F.col("item_id").alias("id"))])


# Code: parsed, never run ---------------------------------------------------------------------------


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'call:eval' WHEN 2 THEN 'dunder' WHEN 3 THEN 'syntax' ELSE '' END AS preflight, CASE doc_id % 5 WHEN 0 THEN 'import:numpy' WHEN 2 THEN 'no-effect' WHEN 3 THEN 'syntax' ELSE '' END AS static_gate FROM documents")
def static_gate(spark, d):
    m = F.col("doc_id") % 5
    code = F.when(m == 0, "import numpy\n").when(m == 1, "eval('1')\n").when(m == 2, "x = 1\nx.__class__\n").when(m == 3, "def (:\n").otherwise("def f(x):\n    return x\n")
    code = F.concat(code, F.lit("# "), F.col("source"))
    return t(spark, d, "documents").select("doc_id", PY.preflight_udf(code).alias("preflight"), PY.static_gate_udf(code).alias("static_gate"))


@query("SELECT doc_id, '```python' || chr(10) || 'def f(x):' || chr(10) || '    return ' || doc_id || chr(10) || '```' || chr(10) || chr(10) || 'Done.' AS text, CASE WHEN doc_id % 2 = 0 THEN 'wrapped_bare_code,removed_trailing_demo' ELSE 'wrapped_bare_code' END AS actions FROM documents")
def normalize_code(spark, d):
    code = F.concat(F.lit("def f(x):\n    return "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "\n\nprint(f(1))\n").otherwise(""))
    f = PY.normalize_code_udf(explanations={"en": "Done."}, local_terms={}, mixed_terms=("code",), mixed=(), default="en")
    return t(spark, d, "documents").select("doc_id", f(code, F.lit("python"), F.lit("en")).alias("n")).select("doc_id", "n.text", F.array_join("n.actions", ",").alias("actions"))


@query("SELECT doc_id, 'f(a, *b)' AS signature, 'Gives ' || source || ' back.' AS requirement FROM documents")
def function_contract(spark, d):
    code = F.concat(F.lit('def f(a: int, *b: str) -> int:\n    """Gives\n    '), F.col("source"), F.lit(' back."""\n    return a\n'))
    return t(spark, d, "documents").select("doc_id", PY.function_contract_udf(code, F.lit("f")).alias("c")).select("doc_id", "c.*")


@query("SELECT doc_id, 'Do f(a). Sharti: ' || source AS locked FROM documents")
def contract_relock(spark, d):
    prompt, translated = F.lit("Implement f(a). Requirement: x"), F.concat(F.lit("abc hitaji: "), F.col("source"))
    return t(spark, d, "documents").select("doc_id", X.relocked(prompt, translated, r"^Implement (.+?)\. Requirement: .*$", r"\b(?:mahitaji|hitaji)\s*:\s*", "Do {signature}. Sharti: {requirement}").alias("locked"))


from . import incremental, more, programs  # noqa: E402, F401  (registers the rest)
