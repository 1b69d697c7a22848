"""Log filters, canonical JSON and variants against plain Python."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from fathom.functions import condensed


def plain_elided(out):
    ends = out.endswith("\n")
    lines = out.split("\n")
    if ends:
        lines.pop()
    if out == "" or len(lines) < 30:
        return out
    kept, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j] == lines[i]:
            j += 1
        kept.append(lines[i] if j == i + 1 else f"{lines[i]} (×{j - i})")
        i = j
    if len(kept) > 200:
        middle = kept[40:-40]
        told = [x for x in middle if re.search("error|fail|warning|panic|exception", x, re.I)]
        kept = kept[:40] + told + [f"… {len(middle) - len(told)} lines elided (raw available) …"] + kept[-40:]
    result = "\n".join(kept) + ("\n" if ends else "")
    return out if len(result) >= len(out) else result + ("" if ends else "\n") + "… output compressed (raw available) …\n"


def test_elided_log(spark):
    draw = random.Random(3)
    logs = ["", "\n", "a\nb", "x\n" * 29, "x\n" * 30, "\n" * 40, "same\n" * 500 + "end"]
    for _ in range(40):
        lines = [draw.choice(["ok", "ok", f"line {draw.randrange(9999)}", f"an ERROR {draw.randrange(99)}", "", "…ü"]) for _ in range(draw.randrange(20, 500))]
        logs.append("\n".join(lines) + draw.choice(["", "\n", "\n\n"]))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)] + [(-1, None)], "i int, t string")
    got = {r.i: r.out for r in df.select("i", condensed.elided_log(F.col("t")).alias("out")).collect()}
    assert got.pop(-1) is None
    assert got == {i: plain_elided(x) for i, x in enumerate(logs)}
    assert any(len(got[i]) < len(x) for i, x in enumerate(logs))


def test_container_list(spark):
    a = '{"Names": "web", "Image": "nginx", "State": "running", "Status": "Up 2 h", "Ports": "80/tcp"}'
    b = '{"Names": "db", "Image": null, "Status": "Exited", "Ports": "%s"}' % ("9" * 41)
    c = '{"Other": 1}'
    want = {
        a: "docker ps: 1 container\nweb  nginx  running(Up 2 h)  80/tcp\n1 containers — raw: docker ps --format json\n",
        f"{a}\n\n{b}\n{c}\n": "docker ps: 2 containers\nweb  nginx  running(Up 2 h)  80/tcp\ndb  Exited\n2 containers — raw: docker ps --format json\n",
        c: c, "": "", f"{a}\nplain": f"{a}\nplain", "[1]": "[1]", "{broken": "{broken",
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "t string")
    got = {r.t: r.out for r in df.select("t", condensed.container_list(F.col("t")).alias("out")).collect()}
    assert got.pop(None) is None
    assert got == want


def test_context_version(spark):
    rows = [("T1", 'quote " back \\ tab\t nl\n \x01 é 日 😀 \x7f', ["a", "ü"], "", [], ["f"], ["n/m", None]), (None, None, None, "s", ["x"], [], [])]
    names = ["task_id", "original_intent", "completed_work", "current_state", "active_constraints", "relevant_files", "next_actions"]
    df = spark.createDataFrame(rows, "task_id string, original_intent string, completed_work array<string>, current_state string, active_constraints array<string>, relevant_files array<string>, next_actions array<string>")
    got = [r.v for r in df.select(condensed.context_version(*[F.col(n) for n in names]).alias("v")).collect()]
    assert got == [hashlib.sha256(json.dumps(dict(zip(names, r, strict=True)), sort_keys=True).encode()).hexdigest() for r in rows]


def test_query_variants(spark):
    rows = [("How to cache pages", "caching"), ("what is a b c d e f g h", "testing"), ("plain", None), ("x", "security")]
    got = [[(v.type, v.query) for v in r.v] for r in spark.createDataFrame(rows, "q string, d string").select(condensed.query_variants(F.col("q"), F.col("d")).alias("v")).collect()]
    assert got[0] == [("inversion", "cache pages failures common mistakes"), ("anti-pattern", "cache pages anti-patterns worst practices"), ("cross-domain", "alternative approaches cache pages tradeoffs")]
    assert got[1][0] == ("inversion", "a b c d e f g h")
    assert got[1][2] == ("lateral", "natural systems analogy a b c d e")
    assert got[2][2] == ("lateral", "natural systems analogy plain")
    assert got[3][2] == ("constraint-removal", "unlimited resources approach x")


def test_json_string_goes_by_runs(spark):
    """As json.dumps writes them; signs are not taken apart one by one."""
    import json

    from pyspark.sql import functions as F

    from fathom.functions import condensed

    texts = ["", "plain", 'a"b\\c\\"', "\\u00e9 \\n", "é", "aéb€c", "\x00\x01\x1f\x7f\x80", "\b\t\n\f\r\x0b", "😀 x 😀😀é\n", "ü" * 5000 + "x" * 5000, "$1 \\$1", "   "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, t string").select("id", condensed.json_string(F.col("t")).alias("j"))
    assert [r.j for r in df.orderBy("id").collect()] == [json.dumps(t) for t in [*texts, None]]
    assert "conv(" not in df._jdf.queryExecution().optimizedPlan().toString()
