import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import text as X
from corpuskiln.operators import dedup, evaluation, filters, gates, joins, projections, sampling, similarity


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, None), (4, None)], "i int, t string")
    assert rows(dedup.dedup_text(df, "t", "i").select("i"), "i") == [(1,), (3,)]
    assert rows(dedup.keep_last(df, F.lit(1), "i").select("i")) == [(4,)]


def test_later_runs_win(spark):
    a = spark.createDataFrame([("x", "en", 1), ("y", "en", 1)], "task string, language string, v int")
    b = spark.createDataFrame([("x", "en", 2)], "task string, language string, v int")
    assert rows(dedup.merge_runs([a, b], "task", "language"), "task") == [("x", "en", 2, 1), ("y", "en", 1, 0)]


def test_split_is_a_partition_of_families(spark):
    got = spark.range(2000).select(sampling.split(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()
    counts = {r.s: r["count"] for r in got}
    assert sum(counts.values()) == 2000 and 60 < counts["validation"] < 140


def test_quotas():
    assert sampling.quotas(9500, {"en": 0.65, "sw": 0.2, "mix": 0.15}, "mix") == {"en": 6175, "sw": 1900, "mix": 1425}
    assert sampling.split_sizes(10_000, 0.05) == {"train": 9500, "validation": 500}


def test_round_robin_covers_every_task_in_every_lane(spark):
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(5)], "k string")
    got = sampling.round_robin(tasks, "k", {"en": 65, "sw": 20, "mix": 15}, 7)
    assert {(r.lane, r["count"]) for r in got.groupBy("lane").count().collect()} == {("en", 65), ("sw", 20), ("mix", 15)}
    per = got.groupBy("lane", "k").agg(F.count("*").alias("n"), F.max("variant").alias("v")).collect()
    assert len(per) == 15 and all(r.n == r.v + 1 for r in per)
    assert got.select("lane", "index").distinct().count() == 100
    assert sampling.uncovered_lanes(16, {"en": 65, "mix": 15}) == ["mix"]


def test_hash_rank_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    one = rows(sampling.hash_rank(df.repartition(1), "id", 3, ["g"]), "id")
    many = rows(sampling.hash_rank(df.repartition(7), "id", 3, ["g"]), "id")
    assert one == many
    assert sorted(r[2] for r in one if r[1] == 0) == list(range(1, 168))


def test_interleave_has_exact_blocks(spark):
    df = spark.range(100).withColumn("lane", F.when(F.col("id") < 60, "a").otherwise("b"))
    got = sampling.interleave(df, "id", "lane", {"a": 3, "b": 1}, 1)
    per = got.groupBy("block").agg(F.count_if(F.col("lane") == "a").alias("a"), F.count("*").alias("n"), F.count_distinct("place").alias("p")).collect()
    assert len(per) == 20 and all((r.a, r.n, r.p) == (3, 4, 4) for r in per)
    assert sampling.feasible_total({"a": 60, "b": 40}, {"a": 0.75, "b": 0.25}) == 80


def test_stratified_fills_up(spark):
    df = spark.range(100).withColumn("lane", F.when(F.col("id") < 90, "a").otherwise("b")).withColumn("w", F.col("id") % 10 == 0)
    got = sampling.stratified(df, "id", "lane", F.col("w"), 50, {"a": 0.5, "b": 0.5}, 0.2, 1)
    counts = {r.lane: (r.n, r.w) for r in got.groupBy("lane").agg(F.count("*").alias("n"), F.count_if("w").alias("w")).collect()}
    assert got.count() == 50 and got.select("id").distinct().count() == 50
    assert counts["b"] == (10, 1) and counts["a"][0] == 40


def test_upsample(spark):
    got = sampling.upsample(spark.range(3), F.col("id") > 0, 3)
    assert got.count() == 7 and sampling.upsample(spark.range(3), F.col("id") > 0, 1).count() == 3


def test_pairs_and_messages(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", " a "), (2, 0, "user", "x")], "c int, t int, role string, text string")
    m = projections.gather_messages(turns, "c", "t", "role", "text")
    assert rows(m.select("c", projections.extract_pair(m)["answer"]), "c") == [(1, "b"), (2, None)]
    assert m.where("c = 1").select(projections.chat_text(F.col("messages"))).first()[0] == "USER:\na\n\nASSISTANT:\nb\n\nEND\n"
    plain = spark.createDataFrame([(None, "q", " p ", "r")], "query string, answer string, prompt string, response string")
    assert plain.select(projections.extract_pair(plain, None)["prompt"]).first()[0] == "p"


def test_overlay_and_languages(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x_en string, x_sw string")
    assert rows(projections.by_language(base, "x", ["en", "sw"], "v", "k"), "k", "language") == [(1, "en", "a"), (1, "sw", "b"), (2, "en", "c")]
    new = spark.createDataFrame([(2, "d")], "k int, x_sw string")
    assert rows(projections.overlay(base, new, "k"), "k") == [(1, "a", "b"), (2, "c", "d")]


def test_code_lock(spark):
    a = projections.render_answer(F.lit("python"), F.col("code"), F.lit("en"), {"en": F.lit("why")})
    df = spark.createDataFrame([("x = 1",), ("```",)], "code string")
    assert [r[0] for r in df.select(projections.keeps_code(a, F.col("code"))).collect()] == [True, False]


def results(spark):
    data = [
        ("t1", "en", "code", True, True, True, True, 1.0, 10, None), ("t1", "sw", "code", False, True, False, True, 3.0, None, None),
        ("t2", "en", "code", False, False, False, True, 2.0, 20, None), ("t2", "sw", "explanation", True, None, None, False, 4.0, 5, None),
        ("t3", "en", "code", True, True, True, True, 9.0, 10, None), ("t3", "sw", None, None, None, None, None, None, None, "timeout"),
    ]
    return spark.createDataFrame(data, "task_id string, language string, kind string, technical_pass boolean, format_compliant boolean, side_effect_free boolean, language_adherent boolean, inference_seconds double, completion_tokens long, error string")


def test_lane_summary_leaves_errors_out(spark):
    got = {r.language: r for r in evaluation.lane_summary(results(spark)).collect()}
    sw = got["sw"]
    assert (sw.responses, sw.error_rows, sw.code_total, sw.code_passed, sw.explanations_passed, sw.overall_pass_rate) == (2, 1, 1, 0, 1, 0.5)
    assert (sw.mean_completion_tokens, sw.total_completion_tokens, sw.median_inference_seconds) == (5.0, 5, 3.5)
    assert got["en"].explanation_pass_rate == 0 and got["en"].code_pass_rate == 0.6667


def test_parity_uses_complete_tasks(spark):
    r = results(spark)
    assert rows(evaluation.paired_parity(r, ["en", "sw"])) == [("sw", 0, 0, 1)]
    assert rows(evaluation.pass_all_rate(r, ["en", "sw"])) == [(2, 0, 0.0)]


def test_composite_golden_values(spark):
    rates = lambda en, sw, mix, fmt: evaluation.accuracy({"en": F.lit(en), "sw": F.lit(sw), "sw_mix": F.lit(mix), "format": F.lit(fmt)})
    c = evaluation.composite(F.lit(80.0), F.lit(15.0), F.lit(3584.0))
    got = spark.range(1).select(F.bround(rates(0.78, 0.42, 0.48, 0.70), 2).alias("a"), F.bround(rates(0.76, 0.48, 0.58, 0.60), 2).alias("b"), c["estimated_total"].alias("t")).first()
    assert tuple(got) == (59.9, 61.3, 80.0)


def test_telemetry_golden_values(spark):
    df = spark.createDataFrame([(x, 3370.16 - i) for i, x in enumerate((4.66, 4.68, 4.67, 4.68, 4.67))], "tps double, rss double")
    assert rows(evaluation.telemetry(df, "tps", "rss")) == [(5, 4.67, 3370.16)]


def test_ranking_falls_back(spark):
    df = spark.createDataFrame([("a", 50.0, None), ("b", 40.0, 60.0), ("c", 50.0, None)], "label string, acc double, total double")
    got = evaluation.rank_models(df, "total", "acc", "label")
    assert rows(got.select("label", "rank", "score_basis"), "rank") == [("b", 1, "total"), ("a", 2, "acc"), ("c", 3, "acc")]


def test_attempts(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 3, True), ("c", 1, True)], "k string, n int, p boolean")
    assert rows(evaluation.attempts_summary(df, "k", "n", "p"), "k") == [("a", 2, False, True, True), ("b", 2, False, False, True), ("c", 1, True, True, True)]


def test_funnel_counts_the_first_failure(spark):
    got = evaluation.funnel(spark.range(10), [("low", F.col("id") > 2), ("odd", F.col("id") % 2 == 0)])
    assert dict(rows(got)) == {"low": 3, "odd": 4, "kept": 3}


def test_row_gate_reports_everything(spark):
    df = spark.createDataFrame([(1, [("user", "a"), ("assistant", " ")]), (2, [("assistant", "a")]), (3, [("system", "s"), ("user", "a"), ("assistant", "b")])], "k int, messages array<struct<role:string,content:string>>")
    got = gates.row_violations(df, "k")
    assert set(rows(got)) == {("message_content", "1"), ("message_roles", "2")}
    with pytest.raises(gates.GateError):
        gates.require_none(got)
    gates.require_none(got.where("false"))


def test_verification_gate(spark):
    schema = "k string, source string, messages array<struct<role:string,content:string>>, v struct<passed:boolean,translation_anchors_verified:boolean,translation_semantic_score:double,explanation_translation_anchors_verified:boolean,explanation_translation_semantic_score:double,explanation_verification_method:string,mutation_killed:long,mutation_total:long>"
    ok = [("user", "a"), ("assistant", "b")]
    df = spark.createDataFrame([("good", "mut/x", ok, (True, True, 0.4, True, 0.45, "m", 1, 2)), ("bad", "mut/x", ok, (None, True, 0.39, True, None, "other", 0, 0)), ("free", "own", ok, (True, True, 1.0, True, 1.0, "m", 0, 0))], schema)
    got = gates.row_violations(df, "k", verification="v", methods=["m"], mutated_prefix="mut/")
    assert {r[0] for r in rows(got)} == {"verified", "translation_score", "explanation_score", "explanation_method", "mutation_adequacy"} and {r[1] for r in rows(got)} == {"bad"}


def test_parallel_gate(spark):
    code, sha = "x = 1", __import__("hashlib").sha256(b"x = 1").hexdigest()
    fence = f"```python\n{code}\n```"
    df = spark.createDataFrame([("a", "en", sha, fence + "\n\nfine"), ("a", "sw", sha, fence + "\n\nvery very very bad"), ("b", "en", sha, fence + fence), ("b", "sw", None, "```js\ny\n```")], "g string, l string, h string, t string")
    got = set(rows(gates.parallel_violations(df, "g", "l", "h", "t", ["sw", "en"])))
    assert {("repeated_words", "a:sw"), ("one_fence", "b:en"), ("declared_hash", "b"), ("code_lock", "b:sw"), ("explanation", "b:sw")} <= got
    assert not any(k == "a" or k == "a:en" for _, k in got)


def test_ratio_and_uniqueness_gates(spark):
    df = spark.range(20).select(F.when(F.col("id") < 13, "en").otherwise("sw").alias("l"), F.col("id").alias("g"), F.lit("same").alias("t"))
    assert rows(gates.ratio_violations(df, "l", {"en": 0.65, "sw": 0.35})) == []
    assert rows(gates.ratio_violations(df, "l", {"en": 0.6, "sw": 0.4})) == [("lane_ratio", "en", 13, 12), ("lane_ratio", "sw", 7, 8)]
    assert len(rows(gates.uniqueness_violations(df, "g", "l", "t"))) == 2
    assert rows(gates.lane_violations(df, "l", ["en", "af"]), "check") == [("lane_missing", "af"), ("lane_unexpected", "sw")]


RATES = {"en": 0.8, "en_code": 0.8, "sw": 0.75, "sw_mix": 0.85}


def release(spark, **changed):
    v = {"c_" + k: x for k, x in RATES.items()} | {"b_en": 0.8, "b_en_code": 0.8, "b_sw": 0.5, "b_sw_mix": 0.5, "fmt": 0.98, "a_sw": 0.8, "a_mix": 0.8, "c1": 0.5, "b1": 0.5, "c2": 0.5, "b2": 0.5, "ct": 9.7, "bt": 10.0, "cm": 3500.0, "bm": 3400.0} | changed
    m = spark.createDataFrame([tuple(v.values())], list(v))
    col = F.col
    c, b = ({k: col(f"{s}_{k}") for k in RATES} for s in "cb")
    checks = gates.release_checks(F.lit(True), c, b, {"candidate_1": col("c1"), "base_1": col("b1"), "candidate_2": col("c2"), "base_2": col("b2")}, [col("fmt"), F.lit(1.0)], {"sw": col("a_sw"), "sw_mix": col("a_mix")}, {"candidate": col("ct"), "base": col("bt")}, {"candidate": col("cm"), "base": col("bm")})
    got = gates.gate(m, checks).first()
    return got.passed, {k for k, ok in got.checks.items() if not ok}


def test_release_gate(spark):
    assert release(spark) == (True, set())
    assert release(spark, cm=3529.0) == (False, {"peak_ram_within_128_mb"})
    assert release(spark, ct=9.6) == (False, {"throughput_within_3_percent"})
    assert release(spark, fmt=0.979, a_sw=0.79)[1] == {"all_language_formats_at_least_98_percent", "kiswahili_language_adherence_at_least_80_percent"}


def test_checkpoint_gate_at_the_thresholds(spark):
    c, b = ({k: F.lit(x) for k, x in RATES.items()}, {"en": F.lit(0.8), "en_code": F.lit(0.8), "sw": F.lit(0.5), "sw_mix": F.lit(0.5)})
    r = {k: F.lit(0.5) for k in ("candidate_1", "base_1", "candidate_2", "base_2")}
    got = gates.gate(spark.range(1), gates.checkpoint_checks(F.lit(True), c, b, r, [F.lit(0.98), F.lit(1.0)])).first()
    assert got.passed and len(got.checks) == 10
    got = gates.gate(spark.range(1), gates.checkpoint_checks(F.lit(None).cast("boolean"), c, b, r, [F.lit(0.98), F.lit(1.0)])).first()
    assert not got.passed


def test_arguments():
    gates.check_arguments(9000, 0.05)
    for bad in ((7999, 0.05), (9000, 0.5)):
        with pytest.raises(ValueError):
            gates.check_arguments(*bad)
    with pytest.raises(ValueError):
        gates.check_modes(True, self_review=True)
    assert gates.parse_ratios("a=0.6, b=0.4", ["a", "b"]) == {"a": 0.6, "b": 0.4} and gates.parse_names(" a,,b ") == ["a", "b"]
    with pytest.raises(ValueError):
        gates.parse_ratios("a=0.6,b=0.5", ["a", "b"])


def test_direct_model(spark):
    schema = "model_only boolean, application_prompt_strategy string, application_contract boolean, self_review boolean, translate_then_solve boolean, nllb_roundtrip_explanations boolean, nllb_model string"
    df = spark.createDataFrame([(True, "direct", None, None, False, None, None), (True, "direct", True, None, None, None, None), (None, "direct", None, None, None, None, None), (True, "direct", None, None, None, None, "m")], schema)
    assert [r[0] for r in df.select(filters.is_direct_model()).collect()] == [True, False, False, False]


def test_contains_any_is_exact(spark):
    docs = spark.createDataFrame([(1, "xone two three four five sixy"), (2, "one two three"), (3, "hello"), (4, None), (4, "")], "i int, t string")
    passages = spark.createDataFrame([("one two three four five six",), ("ell",), ("",), (None,)], "p string")
    assert rows(joins.contains_any(docs, "t", passages, "p").select("i"), "i") == [(1,), (3,)]


def test_contains_any_by_brute_force(spark):
    import random

    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice("ab") for _ in range(n)) + rng.choice(["", " ", "\t"])
    texts = [(i % 50, make(rng.randint(0, 14))) for i in range(80)] + [(90, None), (3, "a  b"), (3, "a  b")]
    for low, high in ((3, 8), (1, 3), (5, 9)):
        wanted = [make(rng.randint(low, high)).strip() for _ in range(12)]
        docs, passages = spark.createDataFrame(texts, "i int, t string").repartition(3), spark.createDataFrame([(p,) for p in wanted], "p string")
        got = sorted(tuple(r) for r in joins.contains_any(docs, "t", passages, "p").collect())
        assert got == sorted(x for x in texts if x[1] is not None and any(p and p in x[1] for p in wanted))


def test_jaccard_pairs_match_brute_force(spark):
    import random

    rng = random.Random(4)
    data = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]) for i in range(60)]
    got = rows(similarity.jaccard_pairs(spark.createDataFrame(data, "k int, w array<string>"), "k", "w", 0.7).select("a", "b"), "a", "b")
    near = lambda x, y: not x | y or len(x & y) / len(x | y) >= 0.7
    assert got == [(i, j) for i, x in data for j, y in data if i < j and near(set(x), set(y))]


def test_paraphrase_pairs_match_brute_force(spark):
    import difflib
    import random

    rng = random.Random(5)
    words = ["implement", "function", "lists", "number", "numbers", "returns", "return"]
    data = [(i, sorted({rng.choice(words) for _ in range(rng.randint(0, 5))})) for i in range(40)]
    got = rows(similarity.paraphrase_pairs(spark.createDataFrame(data, "k int, w array<string>"), "k", "w"), "a", "b")

    def near(x, y):
        j = len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
        return j >= 0.7 or difflib.SequenceMatcher(None, " ".join(x), " ".join(y)).ratio() >= 0.86

    assert got == [(i, j) for i, x in data for j, y in data if i < j and near(x, y)]


def test_resume_and_cache(spark):
    work = joins.grid(spark.createDataFrame([("a",), ("b",)], "k string"), ["en", "sw"])
    done = spark.createDataFrame([("a", "en")], "k string, language string")
    assert joins.pending(work, done, "k", "language").count() == 3
    res = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "k string, passed boolean")
    assert rows(joins.rerun_failures(res, res.where("k <> 'c'"), "k").select("k"), "k") == [("a",), ("c",)]
    cache = spark.createDataFrame([("a", 1)], "k string, v int")
    assert rows(joins.through_cache(res.select("k"), cache, "k", "v"), "k") == [("a", 1, True), ("b", None, False), ("c", None, False)]
    assert joins.cache_misses(res, cache, "k").count() == 2


def test_selection(spark):
    df, ids = spark.createDataFrame([(i, str(i)) for i in range(5)], "o int, k string"), spark.createDataFrame([("1",), ("9",)], "k string")
    assert rows(filters.select_ids(df, ids, "k")) == [("1", 1)] and rows(filters.unknown_ids(df, ids, "k")) == [("9",)]
    assert filters.select_cases(df, "k", "o", limit=-1).count() == 0 and filters.select_cases(df, "k", "o", ids=["3"]).count() == 1
    assert rows(joins.same_keys(df, ids, "k")) == [(False,)]
    assert X.padded_id("f_", F.col("o")) is not None


def test_unknown_cases_are_an_error(spark):
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert [r.id for r in filters.select_cases(cases, "id", "n", ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="unknown ids"):
        filters.select_cases(cases, "id", "n", ["b", "zz"])
    assert filters.select_cases(cases, "id", "n", limit=-1).count() == 0


def test_overlay_takes_nulls_and_keeps_rows_without_fields(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    fields = spark.createDataFrame([(1, None, 5)], "k int, v string, w int")
    assert sorted(tuple(r) for r in projections.overlay(rows, fields, "k").collect()) == [(1, None, 5), (2, "b", None)]


def test_zip_needs_equal_lengths(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y"])], "k int, p array<string>, q array<string>")
    assert [tuple(r) for r in projections.zipped(df, "k", p=F.col("p"), q=F.col("q")).collect()] == [(1, 0, "a", "x"), (1, 1, "b", "y")]
    with pytest.raises(Exception, match="different lengths"):
        projections.zipped(df, "k", p=F.col("p"), q=F.slice("q", 1, 1)).collect()


def test_templates_fill_each_field_once(spark):
    df = spark.createDataFrame([(0, "{b}", "B")], "n int, a string, b string")
    assert df.select(projections.render_template(["{a}-{b}-{c}"], F.col("n"), a=F.col("a"), b=F.col("b")).alias("x")).first().x == "{b}-B-{c}"


def test_paraphrases_of_another_table_go(spark):
    words = lambda *sets: spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k int, w array<string>")
    a = words(["aa", "bb", "cc", "dd"], ["xx", "yy"], [], ["abcdefgh", "ijklmnop"], ["aa", "bb", "cc", "dd"])
    seen = words(["aa", "bb", "cc"], ["abcdefgh", "ijklmnoq"])
    assert sorted(r.k for r in similarity.without_paraphrases(a, seen, "w").collect()) == [1, 2]
    assert sorted(r.k for r in similarity.without_paraphrases(a, words([]), "w").collect()) == [0, 1, 3, 4]
