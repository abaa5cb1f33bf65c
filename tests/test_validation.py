"""Gates fed from documents, the validator, log sessions and glossary tables."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import documents, glossary, validation
from corpuskiln.plans import catalogue, more
from corpuskiln.sources import files, readers


def paired(rates, **settings):
    lanes = {lane: {"overall_pass_rate": r, "code_pass_rate": 0.5, "format_compliance_rate": 0.99, "language_adherence_rate": 0.8} for lane, r in rates.items()}
    return {"model_only": True, "application_prompt_strategy": "direct", "summary": {"languages": lanes}, "other": [1, {"x": None}]} | settings


def of_roles(spark, folder, **changed):
    made = {
        "base_paired": paired({"en": 0.8, "sw": 0.6, "sw_mix": 0.7}), "candidate_paired": paired({"en": 0.8, "sw": 0.75, "sw_mix": 0.85}),
        "base_repairs": {"summary": {"pass_at_1": 3, "pass_at_2": 5, "total": 10}}, "candidate_repairs": {"summary": {"pass_at_1": 6, "pass_at_2": 10, "total": 20}},
        "base_profiler": {"throughput": {"tokens_per_second_generation": 10.0}, "memory": {"peak_rss_mb": 5000}}, "candidate_profiler": {"throughput": {"tokens_per_second_generation": 9.7}, "memory": {"peak_rss_mb": 5128}},
    } | changed
    folder.mkdir()
    for role, document in made.items():
        (folder / f"{role}.json").write_text(json.dumps(document, indent=2))
    return documents.read_by_role(spark, {role: str(folder / f"{role}.json") for role in made})


def test_gates_at_the_thresholds(spark, tmp_path):
    docs = of_roles(spark, tmp_path / "a")
    for gate, n in ((documents.checkpoint_gate, 10), (documents.release_gate, 15)):
        got = gate(docs).first()
        assert got.passed and len(got.checks) == n
    worse = of_roles(spark, tmp_path / "b", candidate_paired=paired({"en": 0.8, "sw": 0.75, "sw_mix": 0.84}, nllb_model="m"), candidate_profiler={"throughput": {"tokens_per_second_generation": 9.69}, "memory": {"peak_rss_mb": 7168}})
    got = documents.release_gate(worse).first()
    assert not got.passed and {k for k, v in got.checks.items() if not v} == {
        "raw_model_only_evaluation", "kiswahili_code_switching_at_least_85_percent", "kiswahili_code_switching_gain_at_least_15_points", "throughput_within_3_percent", "peak_ram_within_128_mb", "peak_ram_below_7_gb",
    }
    falsy = paired({"en": 0.8, "sw": 0.75, "sw_mix": 0.85}, self_review=0, nllb_model="", application_contract=None)
    assert documents.checkpoint_gate(of_roles(spark, tmp_path / "c", candidate_paired=falsy)).first().checks["raw_model_only_evaluation"]


def test_a_missing_value_is_an_error(spark, tmp_path):
    docs = of_roles(spark, tmp_path / "a", base_repairs={"summary": {"pass_at_1": 3, "total": 10}})
    with pytest.raises(Exception, match="no b_p2 in the document of base_repairs"):
        documents.checkpoint_gate(docs).collect()
    with pytest.raises(Exception, match="MALFORMED_RECORD|malformed|Malformed"):
        (tmp_path / "bad.json").write_text("{")
        documents.read_by_role(spark, {"x": str(tmp_path / "bad.json")}).collect()


def dataset(spark, change=None):
    rows = []
    for i in range(10):
        for lane in ("en", "sw"):
            code = f"def f{i}():\n    return {i}"
            answer = f"```python\n{code}\n```\n\nIt gives {i} in {lane}."
            rows.append({"key": f"{i}-{lane}", "family": f"p{i}", "split": "validation" if i == 3 else "train", "language": lane, "messages": [("user", f"Do {i}"), ("assistant", answer)], "code": code})
    for row in rows:
        if change:
            change(row)
    schema = "key string, family string, split string, language string, messages array<struct<role: string, content: string>>, code string"
    return spark.createDataFrame(rows, schema).withColumn("declared", F.sha2("code", 256)).repartition(3)


RULES = validation.Rules(languages=("en", "sw"), least_rows=20, ratios={"en": 0.5, "sw": 0.5}, declared="declared")


def test_a_valid_set_is_written(spark, tmp_path):
    report = validation.write_validated(dataset(spark), str(tmp_path / "set"), RULES)
    assert report.passed and report.rows == 20 and spark.read.parquet(str(tmp_path / "set")).count() == 20
    with pytest.raises(files.FileExists):
        validation.write_validated(dataset(spark), str(tmp_path / "set"), RULES)


@pytest.mark.parametrize(("check", "change"), [
    ("message_roles", lambda r: r.update(messages=r["messages"] + [("user", "more")]) if r["key"] == "1-en" else None),
    ("message_content", lambda r: r.update(messages=[("user", " "), r["messages"][1]]) if r["key"] == "1-en" else None),
    ("split_leakage", lambda r: r.update(split="validation") if r["key"] == "1-en" else None),
    ("lane_unexpected", lambda r: r.update(language="af") if r["key"] == "1-en" else None),
    ("lane_ratio", lambda r: r.update(language="en") if r["key"] == "1-sw" else None),
    ("lane_set", lambda r: r.update(language="en") if r["key"] == "1-sw" else None),
    ("code_lock", lambda r: r.update(messages=[("user", "x"), ("assistant", "```python\nother\n```\n\nwhy")]) if r["key"] == "1-en" else None),
    ("declared_hash", lambda r: r.update(code="other") if r["key"] == "1-en" else None),
    ("explanation", lambda r: r.update(messages=[r["messages"][0], ("assistant", f"```python\n{r['code']}\n```\n")]) if r["key"] == "1-en" else None),
    ("repeated_words", lambda r: r.update(messages=[r["messages"][0], ("assistant", f"```python\n{r['code']}\n```\nno no no")]) if r["key"] == "1-en" else None),
    ("unique_explanations", lambda r: r.update(messages=[r["messages"][0], ("assistant", f"```python\n{r['code']}\n```\nsame")]) if r["language"] == "en" else None),
    ("parallel_family", lambda r: r.update(family=None) if r["family"] == "p1" else None),
])
def test_a_violation_leaves_nothing(spark, tmp_path, check, change):
    report = validation.write_validated(dataset(spark, change), str(tmp_path / "set"), RULES)
    assert not report.passed and report.failed[check] and check in report.examples and not list(tmp_path.iterdir())


def test_small_and_empty_sets(spark, tmp_path):
    rows = dataset(spark)
    assert validation.write_validated(rows.where("key < '3'"), str(tmp_path / "a"), RULES).failed["too_few"] == 1
    report = validation.write_validated(rows.limit(0), str(tmp_path / "b"), RULES)
    assert report.failed["empty"] == 1 and report.failed["lane_missing"] == 2 and not list(tmp_path.iterdir())


def test_sessions_do_not_depend_on_how_files_are_split(spark, tmp_path):
    rng = random.Random(4)
    want, lines = [], []
    for k in range(300):
        lines.append(f"[{k % 50 + 1:02d}/50] t{k} en")
        lines += ["noise"] * rng.randrange(3)
        verdict = rng.choice([None, (True, 1.5), (False, 0.2)])
        want.append((f"t{k}", *(verdict or (None, None))))
        if verdict:
            lines += [f"  {'PASS' if verdict[0] else 'FAIL'} | {verdict[1]}s"] * rng.choice([1, 2])
    (tmp_path / "a.log").write_text("  PASS | 9.9s\n" + "\n".join(lines))
    (tmp_path / "b.log").write_text("[01/50] only PASS\n[02/50] last en")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = readers.read_sessions(spark, str(tmp_path)).collect()
            mine = sorted((r for r in got if r.file.endswith("a.log")), key=lambda r: (r.block, r.line))
            assert [(r.task, r.passed, r.seconds) for r in mine] == want
            assert sorted((r.task, r.passed, r.seconds) for r in got if r.file.endswith("b.log")) == [("last", None, None), ("only", True, None)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def by_hand(text, phrases):
    """From the left, at each word's beginning the first phrase of the list that stands there."""
    first = {}
    for k, (p, v) in enumerate(phrases):
        first.setdefault(re.match(r"\w+", p)[0], []).append((k, p, v))
    out, hits, at, low = [], set(), 0, text.lower()
    for m in re.finditer(r"\w+", text):
        if m.start() < at:
            continue
        for k, p, v in first.get(m[0].lower(), ()):
            end = m.start() + len(p)
            if low.startswith(p, m.start()) and not (end < len(text) and re.match(r"\w", text[end])):
                out += [text[at : m.start()], v]
                at = end
                hits.add((k, p))
                break
    return "".join([*out, text[at:]]), [p for _, p in sorted(hits)]


def test_glossary_query_by_hand(spark, sf):
    phrases = [(r.phrase, r.value) for r in more.phrase_table(spark, sf).orderBy("ordinal").collect()]
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.replaced, r.hits) for r in catalogue.QUERIES["glossary_substitute"](spark, sf).collect()}
    assert got.keys() == texts.keys() and len(phrases) > 200
    for i, text in texts.items():
        replaced, hits = by_hand(text, phrases)
        assert got[i] == (replaced, "|".join(hits)), i


def test_ten_thousand_phrases_in_one_plan(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    phrases = list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(12_000)))[:10_000]
    texts = [(i, " ".join(rng.choice([*words, "W7,", "x"]) for _ in range(60))) for i in range(30)] + [(98, ""), (99, None)]
    table = spark.createDataFrame([(k, p, f"[{k}]") for k, p in enumerate(phrases)], "ordinal int, phrase string, value string")
    docs = spark.createDataFrame(texts, "i int, t string")
    want = {i: by_hand(t, [(p, f"[{k}]") for k, p in enumerate(phrases)]) if t is not None else (None, []) for i, t in texts}
    for size in (50_000, 2_000):
        monkeypatch.setattr(glossary, "PART_PHRASES", size)
        made = glossary.substituted(docs, table, "i", "t")
        assert {r.i: (r.replaced, r.hits) for r in made.collect()} == want
        assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    assert glossary.substituted(docs, table.limit(0), "i", "t").where("replaced IS NOT NULL").count() == 31
