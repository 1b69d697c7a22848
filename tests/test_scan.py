"""Many patterns at once against one after another."""

import random
import re

from fathom.operators import scan

PATTERNS = ["foo", "(?i)Bar+", "a{2}b|xyz", "^start", "end$", "[0-9]{3}", "q.*r", "(?:eval|exec)\\(", "\\bword\\b", "x?yz1", "(one|two|t)hree", "ÄÖÜ", "(?i)straße", "pass(?:word|wd)\\s*[:=]", "no[^a]pe", "(abc)*zzz", "\\p{Lu}abc", "a.b.c", ""]


def test_needed_literals():
    for p in PATTERNS:
        for literal in scan.needed_literals(p):
            assert len(literal) >= 3 and literal == scan._folded(literal)
    assert scan.needed_literals("foo|barx") == ["barx", "foo"]
    assert scan.needed_literals("foo|b[ar]x") == []
    assert scan.needed_literals("(abc)*") == [] == scan.needed_literals("\\Qabc\\E")
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choices(["foo", "BAR", "aab", "xyz", "start", "9", "q", "r", "exec(", "word", " ", "three", "one", "ÄÖÜ", "straße", "password", ":", "nope", "zzz"], k=draw.randrange(8)))
        for p in PATTERNS[:-3]:
            if "\\p" not in p and (needed := scan.needed_literals(p)) and re.search(p, text):
                assert any(x in scan._folded(text) for x in needed), (p, text)


def test_matches_nested_loop(spark):
    draw = random.Random(2)
    texts = [(i, "".join(draw.choices(["foo", "BAR", "aab", "start ", "123", "q", "r", "exec(", " word ", "yz1", "three", "two", "ÄÖÜ", "straße", "password =", "nope", "zzz", "\n"], k=draw.randrange(9)))) for i in range(300)] + [(900, None), (901, "")]
    rules = [(f"r{i}", p) for i, p in enumerate(PATTERNS)] + [("none", None), ("r0", "foo")]
    t, r = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rules, "rule_id string, pattern string")
    got = sorted((x.id, x.rule_id, x.pattern) for x in scan.matches(t, r).collect())
    want = sorted((x.id, x.rule_id, x.pattern) for x in t.join(r, t.text.rlike("") & r.pattern.isNotNull(), "inner").where("text RLIKE pattern").collect())
    assert got == want and len({x[1] for x in got}) > 12
    many = spark.createDataFrame([(f"m{i}", f"marker{i}(?:x|y)") for i in range(1000)] + rules, "rule_id string, pattern string")
    assert sorted((x.id, x.rule_id, x.pattern) for x in scan.matches(t, many).collect()) == want
    assert scan.matches(t, r.limit(0)).count() == 0
    assert scan.matches(t.limit(0), r).count() == 0


def test_file_sets(spark):
    files = spark.createDataFrame([("a/util.py", "import main"), ("b/main.py", "main"), ("c/lone.sh", "lone"), ("d/note.md", "see util and x.note"), ("e/data.csv", "lone-ly"), ("f/util.py", None)], "path string, text string")
    # A file of the same name in another folder that is referred to counts as referred to as well.
    assert {r.path for r in scan.unreferenced(files).collect()} == {"c/lone.sh", "d/note.md"}
    repo = spark.createDataFrame([("r1", "README.md"), ("r1", "src/x.py"), ("r2", "docs/readme.txt")], "repo string, path string")
    required = spark.createDataFrame([("readme", r, "(?i)^readme") for r in ("r1", "r2", "r3")] + [("src", r, "^src/") for r in ("r1", "r2")], "rule_id string, repo string, pattern string")
    assert {(r.rule_id, r.repo) for r in scan.missing_files(repo, required).collect()} == {("readme", "r2"), ("readme", "r3"), ("src", "r2")}


def tried(pattern, text):
    """Whether the pattern's expression is tried on the text."""
    if not (literals := scan._followed_literals(pattern)):
        return True
    low = scan._folded(text)
    return any(f is None or f.match(text, i + len(x)) for x, tails in literals.items() for f in tails for i in range(len(low)) if low.startswith(x, i))


def test_what_follows_a_literal(spark):
    """A text with a pattern's literal, but not what follows it there, isn't tried; no text that matches is left out."""
    assert not tried(r"one\W+three", "one two three, three one") and tried(r"one\W+three", "one, three")
    assert not tried(r"(?i)one[^a-z]+three|foo bar baz", "one two THREE foo bar") and tried(r"(?i)one[^a-z]+three", "ONE 2 THREE")
    assert tried("(?i:one) two", "ONE two") and tried("one[[a]b]two", "oneb]two")
    patterns = [r"one\W+two\W+three", r"(?i)two[^a-z]+three|foo  bar", r"(?:one|foo)-?two", r"foo\s{1,3}bar\d*one", r"one.*three", r"(?i)foo(?:bar|one)+x", "éone\\W+é", r"one\b two", "[^o]ne two|three{2}foo", r"(one two|foo){2}bar"]
    draw = random.Random(4)
    texts = ["".join(draw.choices(["one", "two", "three", "ONE", "Two", "foo", "bar", " ", "  ", "-", ", ", "é", "😀", "7", "x", "\n", "e", "\u0085"], k=draw.randrange(1, 14))) for _ in range(3000)]
    t, r = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(p, p) for p in patterns], "rule_id string, pattern string")
    want = sorted((x.id, x.rule_id) for x in t.crossJoin(r).where("text RLIKE pattern").collect())
    assert sorted((x.id, x.rule_id) for x in scan.matches(t, r).collect()) == want
    assert len({x[1] for x in want}) >= 9
