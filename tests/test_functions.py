from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathom.functions import scalars, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first().x


def test_age_is_whole_days(spark):
    at = F.lit(datetime(2024, 1, 2, 23, 0))
    assert one(spark, scalars.age_days(F.lit(datetime(2024, 1, 2, 1, 0)), at)) == 0
    assert one(spark, scalars.age_days(F.lit(datetime(2024, 1, 1, 22, 59)), at)) == 1
    assert one(spark, scalars.age_days(F.lit(datetime(2024, 5, 1)), at)) == 0


@pytest.mark.parametrize(("seconds", "label"), [(59, "0m"), (3599, "59m"), (3600, "1h"), (86399, "23h"), (200000, "2d"), (None, "")])
def test_age_label(spark, seconds, label):
    assert one(spark, scalars.age_label(F.lit(seconds).cast("long"))) == label


@pytest.mark.parametrize(("notes", "gate"), [("Gate 2 failed", "LEARNING_BLOCK"), ("no branch given", "BRANCH_EVIDENCE"), ("PR not merged", "PR_URL"), ("project is fine", "UNKNOWN"), ("no tests, pr_url missing", "PR_URL")])
def test_failed_gate(spark, notes, gate):
    assert one(spark, scalars.failed_gate(F.lit(notes))) == gate


def test_tags(spark):
    tags = F.array(*map(F.lit, [" PG ", "js", "misc", "pg", "", "api", "x", "y", "z"]))
    got = one(spark, scalars.normalized_tags(tags, {"pg": "postgresql", "js": "javascript"}, ["misc"], {"api": 0}))
    assert got == ["api", "postgresql", "javascript", "x", "y"]


def test_scrub_reports_in_order(spark):
    clean, names = scalars.scrubbed(F.lit("key=abc1234 mail a@b.io"), [("key", r"key=\w+", "key=[x]"), ("mail", r"\S+@\S+", "[m]"), ("none", "zzz", "")])
    assert one(spark, clean) == "key=[x] mail [m]"
    assert one(spark, names) == ["key", "mail"]


def test_evidence(spark):
    note = F.lit("branch: feat/x-1 see https://h/o/r/pull/12 at 0a1b2c3d")
    assert one(spark, scalars.pr_url(note)) == "https://h/o/r/pull/12"
    assert one(spark, scalars.pr_number(note)) == 12
    assert one(spark, scalars.branch_name(note)) == "feat/x-1"
    assert one(spark, scalars.commit_shas(note)) == ["0a1b2c3d"]


def test_semver_and_json(spark):
    assert one(spark, scalars.semver(F.lit("v1.20.3-rc"))).asDict() == {"major": 1, "minor": 20, "patch": 3}
    assert one(spark, scalars.semver(F.lit("1.2"))) is None
    assert one(spark, scalars.json_merge(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}'))) == '{"a":"1","b":"3"}'
    assert one(spark, scalars.json_merge(F.lit(None).cast("string"), F.lit('{"b":"3"}'))) == '{"b":"3"}'


def test_normal_cdf(spark):
    assert one(spark, scalars.normal_cdf(F.lit(0.0))) == pytest.approx(0.5, abs=1e-6)
    assert one(spark, scalars.normal_cdf(F.lit(1.96))) == pytest.approx(0.975, abs=1e-4)
    assert one(spark, scalars.normal_cdf(F.lit(-1.96))) == pytest.approx(0.025, abs=1e-4)


def test_learning_block(spark):
    got = one(spark, scalars.learning_block(F.lit("done\n## LEARNING: Use indexes\nWHY: faster\nTAGS: db, Perf")))
    assert (got.what, got.why, got.category, got.tags) == ("Use indexes", "faster", "pattern", ["db", "perf"])
    assert one(spark, scalars.learning_block(F.lit("nothing"))) is None


def test_complexity(spark):
    score = scalars.complexity_score(F.lit(40), F.lit(250), F.lit(0), F.lit(10), F.lit(True), F.lit(False), F.lit(0))
    assert one(spark, score) == 58  # 20 + 7.5 + 15 + 15, half to even


def test_identifiers(spark):
    assert one(spark, text.tokens(F.lit("getUserProfile HTMLParser snake_case 42 s3 größe x"))) == ["get", "user", "profile", "html", "parser", "snake", "case", "s3", "größe"]


def test_similarities(spark):
    assert one(spark, text.jaccard(text.white_tokens(F.lit("A b")), text.white_tokens(F.lit("b c")))) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(text.white_tokens(F.lit(" ")), text.white_tokens(F.lit("")))) == 0
    assert one(spark, text.trigrams(F.lit("ab"))) == ["  a", " ab", "ab "]
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == pytest.approx(1)
    assert one(spark, text.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) is None
    assert text.sanitized_query('a [b]  "c"^~') == "a b c"


def test_preamble_first(spark):
    assert one(spark, scalars.stripped_preamble(F.lit("Sure! Here is the answer: The cat."))) == "The cat."


@pytest.mark.parametrize(("said", "left"), [
    ("Certainly! Here is a comprehensive overview: the rest. ", "the rest."), ("  Great question! Sure, here are some: x", "x"), ("Surely not", "Surely not"), ("The following is it: a: b", "a: b"), ("nothing chatty", "nothing chatty"), ("", ""), (None, None),
])
def test_preamble(spark, said, left):
    assert one(spark, scalars.stripped_preamble(F.lit(said).cast("string"))) == left


@pytest.mark.parametrize(("raw", "label"), [("72", "72"), ("72.0", "72"), ("72.10", "72.1"), ("100", "100"), ("0", "0"), ("NaN", None), ("inf", None), ("x", None), (None, None)])
def test_phase_label(spark, raw, label):
    assert one(spark, scalars.phase_label(F.lit(raw).cast("string"))) == label


def test_json_merge_keeps_types(spark):
    assert one(spark, scalars.json_merge(F.lit('{"b":{"x":[1,2]},"a":1,"c":null}'), F.lit('{"a":true,"d":"s"}'))) == '{"a":true,"b":{"x":[1,2]},"c":null,"d":"s"}'
    assert one(spark, scalars.json_merge(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "{}"
