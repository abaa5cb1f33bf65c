"""More queries of the catalogue: sources and sinks, selections, graders, contracts, and the similarity anti-join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import python_code as PY
from ..functions import text as X
from ..operators import documents, evaluation, filters, gates, glossary, joins, projections, sampling, similarity, validation
from ..operators.ranks import ranked
from ..session import shared_folder
from ..sources import readers, writers
from . import settings as S
from .catalogue import BODY, BUCKET, FENCED, SQL, STRIP, _evidence_sql, answers, gate_metrics, in_order, normalized, query, sql_list, t

# Sources and sinks: written to the shared folder and read back ---------------------------------------


@query("SELECT doc_id, lang, source, text FROM documents")
def jsonl_round_trip(spark, d):
    path = shared_folder(spark)
    writers.write_jsonl(t(spark, d, "documents").select("doc_id", "lang", "source", "text"), path)
    return readers.read_jsonl(spark, path, "doc_id long, lang string, source string, text string")


@query(f"SELECT CASE WHEN {BUCKET.format('CAST(doc_id AS VARCHAR)')} = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n, sum(length(text)) AS characters FROM documents GROUP BY ALL")
def split_scan(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text").withColumn("split", sampling.split(F.col("doc_id").cast("string")))
    folder = shared_folder(spark)
    paths = {x: f"{folder}/{x}" for x in ("train", "validation")}
    for name, path in paths.items():
        writers.write_jsonl(docs.where(F.col("split") == name).drop("split"), path)
    return readers.read_splits(spark, paths, "doc_id long, text string").groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("decimal(38,0)").alias("characters"))


@query("SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def document_glob(spark, d):
    folder = shared_folder(spark)
    counts = t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))
    for x in S.LANES:
        writers.write_document(counts.where(F.col("lang") == x), f"{folder}/report-{x}.json")
    return readers.read_glob(spark, folder, "report-*.json", "lang string, documents long, sources long").drop("file")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def task_array_scan(spark, d):
    path = f"{shared_folder(spark)}/tasks.json"
    writers.write_array(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "n_nationkey")
    return readers.read_document(spark, path, "n_nationkey int, n_name string, n_regionkey int").drop("file")


@query("SELECT lang AS label, CASE WHEN n_chars > 800 THEN 'long' ELSE 'short' END AS part, count(*) AS n FROM documents GROUP BY ALL")
def labelled_scan(spark, d):
    folder, part = shared_folder(spark), F.when(F.col("n_chars") > 800, "long").otherwise("short")
    docs = t(spark, d, "documents").select("lang", part.alias("part"))
    for lane in S.LANES:
        for x in ("long", "short"):
            one = docs.where((F.col("lang") == lane) & (F.col("part") == x)).agg(F.count("*").alias("n"))
            writers.write_file(one.select(F.to_json(F.struct("n")).alias("value")), f"{folder}/{lane}-{x}.json")
    return readers.read_labelled(spark, folder, S.LANES, ("long", "short"), "n long").where("n > 0").select("label", "part", "n")


@query("SELECT n_name || chr(10) || coalesce(n_comment, '') AS block FROM (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_comment FROM nation)")
def text_blocks(spark, d):
    path = shared_folder(spark)
    blocks = t(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n"), F.col("n_regionkey").cast("string")).alias("block"))
    writers.write_blocks(blocks, "block", ["n_nationkey"], path)
    code = readers.read_source_files(spark, f"{path}/part-*")
    return code.select(F.explode(F.split("code", "\n\n")).alias("block")).where(F.length("block") > 0)


# Selections ------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id FROM documents WHERE {STRIP} <> regexp_replace({STRIP}, '\s+', ' ', 'g')")
def changed_answers(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").where(filters.changed(X.collapse_space(text), text)).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def known_ids(spark, d):
    return filters.select_ids(t(spark, d, "documents"), t(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 7 = 0")
def chosen_cases(spark, d):
    docs = t(spark, d, "documents")
    return filters.select_cases(docs, "doc_id", "doc_id", docs.where("doc_id % 7 = 0").select("doc_id")).select("doc_id", "source")


@query("SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unknown_cases(spark, d):
    return filters.unknown_ids(t(spark, d, "documents").where("lang = 'en'"), t(spark, d, "labels"), "doc_id")


@query(rf"""
WITH p AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS prompt, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id)
SELECT conv_id FROM p WHERE length({STRIP.replace('text', 'prompt')}) BETWEEN 40 AND 1800 AND length({STRIP.replace('text', 'answer')}) BETWEEN 40 AND 5000
""")
def pair_lengths(spark, d):
    pairs = projections.gather_messages(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    pairs = pairs.select("conv_id", projections.extract_pair(pairs).alias("p"))
    return pairs.where(filters.pair_between(F.col("p.prompt"), F.col("p.answer"))).select("conv_id")


@query(rf"SELECT doc_id FROM documents WHERE length({STRIP}) BETWEEN 40 AND 5000 ORDER BY {in_order('doc_id')} LIMIT 100")
def bounded_scan(spark, d):
    """A scan that wants 100 eligible rows, in the order that stands for a shuffle; the limit is what it does."""
    docs = t(spark, d, "documents").where(filters.length_between(F.col("text"), 40, 5000))
    return joins.ranked_top(docs, 100, X.hash_order(F.col("doc_id"), S.SEED)).select("doc_id")


# Projections -----------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(quality, 0) + coalesce(toxic, 0) AS total FROM documents LEFT JOIN labels USING (doc_id)")
def null_sum(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", projections.null_as_zero_sum(F.col("quality"), F.col("toxic")).alias("total"))


@query("SELECT doc_id, source || CASE WHEN lang = 'de' AND n_chars > 800 THEN chr(10) || chr(10) || 'Antworte kurz.' WHEN lang = 'fr' AND n_chars <= 800 THEN chr(10) || chr(10) || 'Explique.' ELSE '' END AS prompt FROM documents")
def register_prompts(spark, d):
    kind = F.when(F.col("n_chars") > 800, "code").otherwise("explanation")
    chosen = {("de", "code"): "Antworte kurz.", ("fr", "explanation"): "Explique."}
    return t(spark, d, "documents").select("doc_id", projections.with_instruction(F.col("source"), F.col("lang"), kind, chosen).alias("prompt"))


@query("SELECT doc_id, lang AS base FROM documents")
def base_lanes(spark, d):
    lane = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "_mix").when(F.col("doc_id") % 3 == 0, "-mix").otherwise(""))
    return t(spark, d, "documents").select("doc_id", X.base_lane(lane).alias("base"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS ordinal, role, text FROM conversations")
def zipped_messages(spark, d):
    turns = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return projections.zipped(turns, "conv_id", role=F.transform("m", lambda x: x["role"]), text=F.transform("m", lambda x: x["text"]))


@query("SELECT l.lang, avg(quality) AS rate FROM documents l JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY l.lang")
def summary_metric(spark, d):
    rates = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("overall_pass_rate"))
    lanes = F.map_from_entries(F.collect_list(F.struct("lang", F.struct("overall_pass_rate"))))
    document = rates.agg(F.struct(F.struct(lanes.alias("languages")).alias("summary")).alias("document"))
    return document.select(F.lit("en").alias("lang"), evaluation.metric(F.col("document"), "en", "overall_pass_rate").alias("rate"))


# Texts and graders -----------------------------------------------------------------------------------


@query(rf"SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN {STRIP} || chr(10) END AS code FROM documents")
def runtime_code(spark, d):
    # Half of the rows ask for the runtime that the fence does not name.
    asked = F.when((F.col("doc_id") % 4 < 2) == (F.col("runtime") == "python"), "python").otherwise("javascript")
    return answers(spark, d).select("doc_id", X.extract_runtime_code(F.col("answer"), asked).alias("code"))


@query(rf"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 WHEN doc_id % 3 = 1 THEN lang = 'en' ELSE n_chars > 800 END AS passed,
  CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'passed' ELSE 'code changed while copying' END
    WHEN 1 THEN CASE WHEN lang = 'en' THEN 'passed' ELSE 'JSON keys or values changed' END
    ELSE CASE WHEN n_chars > 800 THEN 'passed' ELSE 'bullet lines, ordering, or extra prose differ' END END AS reason
FROM documents
""")
def format_grades(spark, d):
    n = F.col("doc_id") % 3
    contract = F.when(n == 0, "exact_fence").when(n == 1, "exact_json").otherwise("exact_bullets")
    fence = F.concat(F.lit("```python\n"), F.col("source"), F.when(F.col("doc_id") % 2 == 1, "!").otherwise(""), F.lit("\n```\n"))
    given = F.when(n == 0, fence).when(n == 1, X.compact_json("lang", "source")).otherwise(F.concat(F.lit("- "), "source", F.lit("\n- "), "lang"))
    expected = F.when(n == 0, F.col("source")).otherwise(F.to_json(F.struct(F.lit("en").alias("lang"), "source")))
    bullets = F.array(F.concat(F.lit("- "), "source"), F.concat(F.lit("- "), F.when(F.col("n_chars") > 800, F.col("lang")).otherwise("none")))
    return t(spark, d, "documents").select("doc_id", X.grade_format(contract, given, expected, bullets).alias("g")).select("doc_id", "g.*")


@query(_evidence_sql() + f", x AS (SELECT doc_id, list_sort(list_intersect(w, {sql_list(('la', 'que', 'tion', 'and'))})) AS terms, h.hits FROM w JOIN h USING (doc_id)) SELECT doc_id, array_to_string(terms, ',') AS terms, len(hits) >= 3 AND len(terms) >= 1 AS adherent FROM x")
def code_switch_evidence(spark, d):
    terms, text = ("la", "que", "tion", "and"), F.col("text")
    ok = F.coalesce(*[F.when(F.col("lang") == k, X.is_adherent(text, v, 3, terms)) for k, v in S.LEXICON.items()])
    return t(spark, d, "documents").select("doc_id", F.array_join(X.lexicon_hits(text, terms), ",").alias("terms"), ok.alias("adherent"))


@query(rf"""
WITH w AS (SELECT doc_id, {STRIP} AS s, lang IN ('de', 'fr') AS mixed, len(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '(?:tionen|ement|schaft)'))) AS n FROM documents)
SELECT doc_id, CASE WHEN mixed AND length(s) > 0 AND n < 2 THEN s || chr(10) || chr(10) || 'Mehr dazu.' ELSE s END AS text, CASE WHEN mixed AND length(s) > 0 AND n < 2 THEN 1 ELSE 0 END AS actions FROM w
""")
def sentence_hints(spark, d):
    made = X.sentence_hint(F.col("text"), F.col("lang").isin("de", "fr"), "(?:tionen|ement|schaft)", "Mehr dazu.")
    return t(spark, d, "documents").select("doc_id", made.alias("m")).select("doc_id", "m.text", F.size("m.actions").alias("actions"))


@query(rf"SELECT doc_id, {STRIP} AS block FROM documents")
def last_block(spark, d):
    text = F.concat(F.lit("Answer: "), "source", F.lit("\nAnswer:\n"), F.col("text"))
    return t(spark, d, "documents").select("doc_id", X.after_last(text, "Answer:").alias("block"))


@query("""
SELECT doc_id, CASE WHEN lang = 'en' THEN target ELSE target || chr(10) || chr(10) || 'Signature: f(' || source || ').' END
  || chr(10) || chr(10) || 'Code:' || chr(10) || '```' || chr(10) || 'def f(x):' || chr(10) || '    return x' || chr(10) || '```' AS text
FROM (SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN 'Do f(' || source || ') now' ELSE lang END AS target FROM documents)
""")
def restored_contracts(spark, d):
    source = F.concat(F.lit("Write f( "), "source", F.lit(" ).\n  def f(x):\n      return x\n"))
    target = F.when(F.col("lang") == "en", F.concat(F.lit("Do f("), "source", F.lit(") now"))).otherwise(F.col("lang"))
    made = X.restore_contract(source, target, "Signature: ", "Code:")
    return t(spark, d, "documents").select("doc_id", made.alias("r")).select("doc_id", "r.text")


@query("SELECT doc_id, '## Hinweise' || chr(10) || chr(10) || upper(source) || chr(10) || chr(10) || '```py' || chr(10) || lang || chr(10) || '```Ende' AS text FROM documents")
def markdown_headings(spark, d):
    text = F.concat(F.lit("## Notes:\n\n"), "source", F.lit("\n\n```py\n"), "lang", F.lit("\n```\nend\n"))
    return t(spark, d, "documents").select("doc_id", PY.map_markdown_udf(str.upper, {"Notes": "Hinweise", "End": "Ende"})(text).alias("text"))


@query("SELECT doc_id, 'const f = (x) => { return \"}\" + ''' || source || '''; };' AS trimmed, 'const f = (x) => { return     + ' || repeat(' ', length(source) + 2) || '; };' || chr(10) || 'f(1);' AS masked FROM documents")
def script_trims(spark, d):
    code = F.concat(F.lit("const f = (x) => { return \"}\" + '"), "source", F.lit("'; };\nf(1);"))
    return t(spark, d, "documents").select("doc_id", PY.trim_script_udf(code).alias("trimmed"), PY.mask_script_udf(code).alias("masked"))


@query()
def code_mutants(spark, d):
    code = F.concat(F.lit("def f(x):\n    if x < "), F.col("doc_id").cast("string"), F.lit(" and x:\n        return x * 2 + 1\n    return None"))
    return t(spark, d, "documents").select("doc_id", F.posexplode(PY.mutants_udf(code)).alias("ordinal", "mutant"))


# Gates and the similarity anti-join ------------------------------------------------------------------

VERDICTS = """SELECT doc_id, quality = 1 AS passed, toxic = 0 AS anchors, n_chars % 100 / 100.0 AS score, lang AS method, CASE WHEN doc_id % 3 = 0 THEN 'suite:' ELSE 'set:' END || source AS src, n_chars % 5 AS killed, n_chars % 7 AS total FROM documents JOIN labels USING (doc_id)"""


@query(f"""
WITH v AS ({VERDICTS})
SELECT 'verified' AS "check", CAST(doc_id AS VARCHAR) AS key FROM v WHERE NOT passed
UNION ALL SELECT 'translation_anchors', CAST(doc_id AS VARCHAR) FROM v WHERE NOT anchors
UNION ALL SELECT 'translation_score', CAST(doc_id AS VARCHAR) FROM v WHERE NOT score >= 0.40
UNION ALL SELECT 'explanation_anchors', CAST(doc_id AS VARCHAR) FROM v WHERE NOT anchors
UNION ALL SELECT 'explanation_score', CAST(doc_id AS VARCHAR) FROM v WHERE NOT score >= 0.45
UNION ALL SELECT 'explanation_method', CAST(doc_id AS VARCHAR) FROM v WHERE method NOT IN ('de', 'en')
UNION ALL SELECT 'mutation_adequacy', CAST(doc_id AS VARCHAR) FROM v WHERE src LIKE 'suite:%' AND NOT (total >= 1 AND killed / nullif(total, 0) >= 0.5)
""")
def verification_gate(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    score = F.col("n_chars") % 100 / 100
    verdict = F.struct(
        (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 0).alias("translation_anchors_verified"), score.alias("translation_semantic_score"),
        (F.col("toxic") == 0).alias("explanation_translation_anchors_verified"), score.alias("explanation_translation_semantic_score"),
        F.col("lang").alias("explanation_verification_method"), (F.col("n_chars") % 5).alias("mutation_killed"), (F.col("n_chars") % 7).alias("mutation_total"),
    )
    source = F.concat(F.when(F.col("doc_id") % 3 == 0, "suite:").otherwise("set:"), "source")
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.concat(F.lit("x"), F.col("lang")).alias("content")) for r in ("user", "assistant")])
    rows = rows.select("doc_id", source.alias("source"), verdict.alias("v"), messages.alias("messages"))
    return gates.row_violations(rows, "doc_id", verification="v", methods=("de", "en"), mutated_prefix="suite:")


@query(f"SELECT 'empty_side' AS \"check\", s AS key FROM (SELECT unnest(['train', 'validation', 'test']) AS s) WHERE s NOT IN (SELECT CASE WHEN {BUCKET.format('CAST(doc_id AS VARCHAR)')} = 0 THEN 'validation' ELSE 'train' END FROM documents)")
def split_sides(spark, d):
    docs = t(spark, d, "documents").select(sampling.split(F.col("doc_id").cast("string")).alias("split"))
    return gates.empty_sides(docs, "split", ("train", "validation", "test"))


@query("WITH s AS (SELECT lang, round_even(count(*) / (SELECT count(*) FROM documents), 1) AS share FROM documents GROUP BY lang) SELECT count(*) = 4 AND bool_and(share = CASE lang WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.1 WHEN 'fr' THEN 0.1 WHEN 'es' THEN 0.1 END) AS ok FROM s")
def manifest_gate(spark, d):
    counts = t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).select("lang", F.bround(F.col("n") / F.col("total"), 1).alias("share"))
    manifest = shares.agg(F.lit("v1").alias("schema"), F.map_from_entries(F.collect_list(F.struct("lang", "share"))).alias("target_ratios"))
    return gates.manifest_matches(manifest, "v1", {"en": 0.6, "de": 0.1, "fr": 0.1, "es": 0.1})


@query()
def unseen_requirements(spark, d):
    """The documents that paraphrase no benchmark passage."""
    seen = normalized(spark, d, "benchmark", "item_id")
    return similarity.without_paraphrases(normalized(spark, d), seen, "words").select("doc_id")


def role_documents(spark, d):
    """The evaluation documents of base and candidate, written as files without a schema and read back by role."""
    m = gate_metrics(spark, d)
    folder, lit = shared_folder(spark), F.lit
    made = {}
    for side, name in documents.SIDES.items():
        x = lambda k: F.col(f"{side}_{k}")  # noqa: B023, E731
        lane = lambda rate, adherence, code: F.struct(rate.alias("overall_pass_rate"), code.alias("code_pass_rate"), x("fmt").alias("format_compliance_rate"), adherence.alias("language_adherence_rate"))  # noqa: B023, E731
        languages = F.struct(lane(x("en"), lit(1.0), x("en_code")).alias("en"), lane(x("sw"), x("adh_sw"), lit(0.5)).alias("sw"), lane(x("sw_mix"), x("adh_mix"), lit(0.5)).alias("sw_mix"))
        made[f"{name}_paired"] = F.struct(lit(True).alias("model_only"), lit("direct").alias("application_prompt_strategy"), lit(False).alias("self_review"), F.struct(languages.alias("languages")).alias("summary"))
        made[f"{name}_repairs"] = F.struct(F.struct(x("p1").alias("pass_at_1"), x("p2").alias("pass_at_2"), lit(1).alias("total")).alias("summary"))
        made[f"{name}_profiler"] = F.struct(F.struct((10 * x("tps")).alias("tokens_per_second_generation")).alias("throughput"), F.struct((8000 * x("rss")).alias("peak_rss_mb")).alias("memory"))
    for role, document in made.items():
        writers.write_file(m.select(F.to_json(document).alias("value")), f"{folder}/{role}.json")
    return documents.read_by_role(spark, {role: f"{folder}/{role}.json" for role in made})


@query(SQL["checkpoint_gate"])
def checkpoint_gate_of_documents(spark, d):
    return gates.check_rows(documents.checkpoint_gate(role_documents(spark, d)))


@query(SQL["release_gate"])
def release_gate_of_documents(spark, d):
    return gates.check_rows(documents.release_gate(role_documents(spark, d)))


@query(f"""
WITH a AS (SELECT doc_id, source, lang, coalesce(quality = 1, false) AS good, {FENCED} AS answer, sha256({STRIP}) AS declared, {BUCKET.format('CAST(doc_id AS VARCHAR)')} = 0 AS held FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT source, list_sort(list(DISTINCT lang)) AS lanes, count(DISTINCT declared) AS hashes, bool_or(held) AND bool_or(NOT held) AS leaks, bool_and(sha256({BODY}) = declared) AS locked FROM a GROUP BY source),
u AS (SELECT lang, count(DISTINCT source) AS n FROM a GROUP BY lang),
r AS (SELECT unnest({sql_list(S.LANES)}) AS lang, unnest({[S.RATIOS[x] for x in S.LANES]}) AS share)
SELECT "check", CAST(n AS BIGINT) AS n FROM (
SELECT unnest(['empty', 'too_few', 'message_roles', 'message_content', 'parallel_family', 'explanation', 'repeated_words']) AS "check", 0 AS n
UNION ALL SELECT 'lane_unexpected', count_if(lang NOT IN (SELECT lang FROM r)) FROM a UNION ALL SELECT 'quality', count_if(NOT good) FROM a
UNION ALL SELECT 'lane_missing', count_if(lang NOT IN (SELECT lang FROM a)) FROM r
UNION ALL SELECT 'lane_ratio', count_if((SELECT count(*) FROM a WHERE a.lang = r.lang) <> round_even((SELECT count(*) FROM a) * share, 0)) FROM r
UNION ALL SELECT 'split_leakage', count_if(leaks) FROM g UNION ALL SELECT 'lane_set', count_if(lanes <> {sql_list(S.LANES)}) FROM g
UNION ALL SELECT 'declared_hash', count_if(hashes <> 1) FROM g UNION ALL SELECT 'code_lock', count_if(NOT locked) FROM g
UNION ALL SELECT 'unique_explanations', count_if(n < greatest(1, round_even((SELECT count(*) FROM g) * 0.9, 0))) FROM u)
""")
def validated_write(spark, d):
    """What a data set of all documents fails, check by check; since it does, nothing is left of it."""
    a = answers(spark, d).join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    rows = a.select(F.col("doc_id").alias("key"), F.col("source").alias("family"), sampling.split(F.col("doc_id").cast("string")).alias("split"), F.col("lang").alias("language"), F.array(message("user", F.col("source")), message("assistant", F.col("answer"))).alias("messages"), X.sha256(X.strip(F.col("code"))).alias("declared"), "quality")
    rules = validation.Rules(languages=S.LANES, ratios=S.RATIOS, declared="declared", row_checks={"quality": F.col("quality") == 1})
    report = validation.write_validated(rows, f"{shared_folder(spark)}/set", rules)
    return spark.createDataFrame(list(report.failed.items()), "check string, n long")


#: Events of one log file, which one task sorts.
LOG_ROWS = 500_000


@query("SELECT CAST(event_id % 50 + 1 AS INTEGER) AS number, 't' || event_id AS task, event_type AS language, CASE WHEN event_id % 7 > 0 THEN value > 20 END AS passed, CASE WHEN event_id % 7 > 0 THEN round(value, 1) END AS seconds FROM events")
def log_sessions(spark, d):
    """Logs of runs, a seventh of whose tasks broke off: each task with its verdict, from files that are read in many pieces."""
    path = shared_folder(spark)
    head = F.format_string("[%02d/50] t%d %s", F.col("event_id") % 50 + 1, F.col("event_id"), F.col("event_type"))
    verdict = F.concat(F.lit("\n  "), F.when(F.col("value") > 20, "PASS").otherwise("FAIL"), F.lit(" | "), F.round("value", 1).cast("string"), F.lit("s"))
    text = F.concat(head, F.lit("\nloading"), F.when(F.col("event_id") % 7 > 0, verdict).otherwise(""))
    events = t(spark, d, "events")
    events.repartitionByRange(max(3, -(-events.count() // LOG_ROWS)), "event_id").sortWithinPartitions("event_id").select(text.alias("value")).write.text(path)
    return readers.read_sessions(spark, path).select("number", "task", "language", "passed", "seconds")


def phrase_table(spark, d):
    """A glossary made from the tables: the longer words of the benchmark and the first three words of each document, in alphabetical order."""
    words = lambda text, least: F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\w{{{least},}}"), F.lit(0))
    longer = t(spark, d, "benchmark").select(F.explode(words(F.col("text"), 6)).alias("phrase"))
    openings = t(spark, d, "documents").select(F.regexp_extract(F.lower("text"), r"(?U)\w+ \w+ \w+", 0).alias("phrase"))
    phrases = longer.unionByName(openings).where("phrase <> ''").distinct()
    return ranked(phrases, ["phrase"], name="ordinal").select("ordinal", "phrase", F.concat(F.lit("<"), F.col("phrase"), F.lit(">")).alias("value"))


@query()
def glossary_substitute(spark, d):
    """All texts with the phrases of a glossary table replaced."""
    made = glossary.substituted(t(spark, d, "documents").select("doc_id", "text"), phrase_table(spark, d), "doc_id", "text")
    return made.select("doc_id", "replaced", F.array_join("hits", "|").alias("hits"))


@query("SELECT doc_id, source || chr(10) || chr(10) || 'It failed:' || chr(10) || right(text, 1200) || chr(10) || chr(10) || right(answer, 3000) || chr(10) || chr(10) || 'Try again.' AS prompt FROM (SELECT doc_id, source, text, " + FENCED + " AS answer FROM documents)")
def retry_prompts(spark, d):
    """Prompts for a second try, with the ends of the feedback and of the answer; the limits are the prompt's."""
    return answers(spark, d).select("doc_id", projections.retry_prompt(F.col("source"), F.col("answer"), F.col("text"), "It failed:", "Try again.").alias("prompt"))


@query(rf"""
SELECT doc_id, coalesce(a, b, {STRIP.replace('text', 'c')}) AS prompt, {STRIP} AS answer FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN source END AS a, CASE WHEN doc_id % 3 = 1 THEN lang END AS b, CASE WHEN doc_id % 3 = 2 THEN text END AS c FROM documents)
""")
def key_pairs(spark, d):
    """Pairs that sources keep under one or another pair of names."""
    m, text = F.col("doc_id") % 3, F.col("text")
    docs = t(spark, d, "documents").select("doc_id", F.when(m == 0, F.concat(F.lit(" "), "source")).alias("query"), F.when(m < 2, text).alias("answer"), F.when(m == 1, F.concat("lang", F.lit("\n"))).alias("instruction"), F.when(m == 1, text).alias("output"), F.when(m == 2, text).alias("prompt"), F.when(m == 2, text).alias("response"))
    return docs.select("doc_id", projections.extract_pair(docs).alias("p")).select("doc_id", "p.*")


@query(r"""
WITH c AS (SELECT doc_id, replace(text, ',', ' (') AS code, regexp_extract_all(text, '[A-Za-z]{2,}')[1:8] AS names FROM documents)
SELECT doc_id, list_filter(names, lambda n: regexp_matches(code, '(?i)(?:^|[^\p{L}\p{N}_$])' || n || '\s*\('))[1] AS forbidden FROM c
""")
def row_forbidden_calls(spark, d):
    """Each row brings the names that its code may not call: here its first words; a comma in the text stands for a call."""
    code, names = F.replace("text", F.lit(","), F.lit(" (")), F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)), 1, 8)
    return t(spark, d, "documents").select("doc_id", X.forbidden_call(code, names).alias("forbidden"))
