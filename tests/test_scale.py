"""Work and memory that may not grow faster than the input."""

import difflib
import random
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from corpuskiln.operators import glossary, similarity
from corpuskiln.plans import catalogue, more


def shuffled(spark):
    """Bytes of shuffle files written so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("home", [2 << 20, 20_000])
def test_near_copies_are_not_sent_once_for_each_pair(spark, monkeypatch, home):
    dice = random.Random(5)
    common = [f"{dice.randrange(10**15):x}" for _ in range(1500)]
    sets = {k: common + [f"{dice.randrange(10**15):x}" for _ in range(dice.randrange(500))] for k in range(60)} | {60: None, 61: [], 62: [], 63: ["alone"]}
    want = {(a, b) for a, b in combinations(range(60), 2) if 1500 / (len(sets[a]) + len(sets[b]) - 1500) >= 0.7} | {(61, 62)}
    df = spark.createDataFrame(list(sets.items()), "k long, w array<string>").coalesce(1)
    monkeypatch.setattr(similarity, "HOME", home, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(df, "k", "w", 0.7).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want
    # All words have about 1.2 MB; a copy of a set for each pair has 60 times as much.
    assert shuffled(spark) - before < (12 << 20 if home > 20_000 else 24 << 20)


def test_long_sets_that_are_not_similar_are_not_sent(spark, monkeypatch):
    dice = random.Random(7)
    words = [f"{dice.randrange(10**15):x}" for _ in range(2600)]
    # Chosen from few words, all pairs are at a similarity of about 0.6, under the threshold; three are near copies.
    sets = {k: dice.sample(words, 2000) for k in range(90)}
    sets |= {90: sets[0][:1900], 91: sets[1][:1500] + ["x", "y"], 92: sets[2][:1200]}
    share = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b) for a, b in combinations(sets, 2) if share(set(sets[a]), set(sets[b])) >= 0.7}
    monkeypatch.setattr(similarity, "HOME", 20_000)
    df = spark.createDataFrame(list(sets.items()), "k long, w array<string>").repartition(4).cache()
    df.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(df, "k", "w", 0.7).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and {(0, 90), (1, 91)} <= got and (2, 92) not in got
    # All words have 1.5 MB; each of ten parts meeting each other part has ten times as much.
    assert shuffled(spark) - before < 8 << 20


def test_prefixes_are_joined_in_turns(spark, monkeypatch):
    dice = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    sets = {k: dice.sample(words, dice.randrange(1, 40)) for k in range(120)}
    sets |= {k + 120: sets[k][: max(len(sets[k]) * 4 // 5, 1)] for k in range(120)} | {300: []}
    monkeypatch.setattr(similarity, "PREFIXES", 200)
    turns = list(similarity._turns({0: 3, 1: 5, 4: 4000, 5: 10}))
    assert turns[0] == ([0, 1], 0, 1) and turns[-1] == ([5], 0, 1) and [t[1:] for t in turns[1:-1]] == [(k, len(turns) - 2) for k in range(len(turns) - 2)]
    want = {(a, b) for a, b in combinations(sets, 2) if sets[a] and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.7}
    df = spark.createDataFrame(list(sets.items()), "k long, w array<string>")
    assert {(r.a, r.b) for r in similarity.jaccard_pairs(df, "k", "w", 0.7).collect()} == want and len(want) >= 60


def test_short_texts_and_lookups_in_turns(spark, monkeypatch):
    dice = random.Random(11)
    letters = "etaoinshrdlucmfwypvbgkqjxz"
    words = ["".join(dice.choice(letters) for _ in range(dice.randint(3, 9))) for _ in range(300)]
    texts = [" ".join(sorted(dice.sample(words, n))) for n in [2, 3, 5, 12, 20, 28, 60] * 40]
    texts = list(dict.fromkeys([*texts, *[t[:-3] + "xyz" for t in texts[::5]], *[t + " w" for t in texts[::7]]]))
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(texts), 2) if min(len(a), len(b)) > 0.75 * max(len(a), len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.86}
    monkeypatch.setattr(similarity, "CHARACTERS", 20_000, raising=False)
    left, right = (spark.createDataFrame(list(enumerate(texts)), f"_{c} long, _t{c} string") for c in "ab")
    candidates = {tuple(r) for r in similarity.sequence_candidates(left, right, 0.86, ordered=True).collect()}
    assert candidates >= want and len(want) > 80
    # Random short texts are told apart before their texts meet.
    assert len(candidates) < 4 * len(want)
    shorter = {(i, j) for i, j in want if max(len(texts[i]), len(texts[j])) < 200}
    assert len(shorter) > 40


def test_only_words_of_the_other_side_leave_the_scan(spark):
    sets = [(0, list(range(10))), (1, [*range(7), 100, 101, 102]), (2, [*range(6), *range(100, 104)]), (3, list(range(200, 240))), (4, [])]
    df = spark.createDataFrame(sets, "k long, h array<long>").select(F.col("k").alias("_c"), F.lit(0).alias("_side"), F.size("h").alias("_n"), F.transform("h", lambda x: F.xxhash64(x)).alias("_h"))
    bitmap = similarity._bitmap(spark.range(10).select(F.xxhash64("id").alias("_x")))
    kept = similarity._within(df, bitmap, 0.7).groupBy("_c").count().collect()
    assert {r._c: r["count"] for r in kept} == {0: 10, 1: 7}


def test_contract_chain_reads_each_program_once(spark, sf):
    plan = catalogue.QUERIES["translated_contracts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # The documents meet the models of their groups, nothing else.
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("name", ["program_mutants", "program_findings", "program_trims", "program_contracts", "script_masks", "markdown_texts", "semantic_score"])
def test_python_gets_few_texts_at_once(spark, sf, name):
    # The defaults, whatever ran before.
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    df = catalogue.QUERIES[name](spark, sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512 and df.columns


def test_a_task_sorts_a_bounded_part_of_the_logs(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(more, "shared_folder", lambda _: f"{tmp_path}/log")
    monkeypatch.setattr(more, "LOG_ROWS", 100, raising=False)
    n = catalogue.t(spark, sf, "events").count()
    assert catalogue.QUERIES["log_sessions"](spark, sf).count() == n > 500
    assert len(list(tmp_path.glob("log/part-*"))) == -(-n // 100)


def test_a_larger_glossary_does_not_read_the_texts_again(spark, monkeypatch):
    monkeypatch.setattr(glossary, "PART_PHRASES", 4)
    texts = spark.createDataFrame([(1, "Alpha beta, gamma delta"), (2, None), (3, ""), (4, "beta alpha BETA")], "i long, t string")
    table = spark.createDataFrame([(k, p, p.upper()) for k, p in enumerate(["beta", "alpha beta", "gamma", "delta", "Beta", *[f"word{n}" for n in range(40)]])], "ordinal long, phrase string, value string")
    made = glossary.substituted(texts, table, "i", "t")
    assert {r.i: (r.replaced, r.hits) for r in made.collect()} == {1: ("ALPHA BETA, GAMMA DELTA", ["alpha beta", "gamma", "delta"]), 2: (None, []), 3: ("", []), 4: ("BETA ALPHA BETA", ["beta", "alpha beta"])}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_words_of_one_side_only_are_not_shuffled_for_their_places(spark):
    words = lambda k, n: [f"w{k}x{i:05d}y{i * 7919 % 10007}" for i in range(n)]
    base = words("s", 40)
    sets = [(0, base), (1, base[:30] + words("o", 2)), (2, base[:20] + words("p", 20)), *[(k, words(k, 2000) + base[:5]) for k in range(3, 60)]]
    candidates, seen = spark.createDataFrame(sets, "k long, w array<string>"), spark.createDataFrame([(base,)], "w array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = similarity._near_by_jaccard(candidates.select(F.array_sort("w").alias("_w")), seen.select(F.array_sort("w").alias("_w")), 0.7)._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k for r in similarity.without_paraphrases(candidates, seen, "w").collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == set(range(2, 60))
    # Only words that both sides have are ranked.
    assert "(_lo#" in plans and "< _hi#" in plans and plans.index("Window") < plans.index("< _hi#")
