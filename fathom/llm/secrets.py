"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a value that is assigned to a telling name (password=...), a token of a known form, a
private key from its header to its END line (without one, the lines of its body), or a long token with
digits in it. All are taken whole, however long they are. The forest sees its length and make-up, how its
characters change from class to class, how much of it dictionary words cover, whether it or the row's path
looks like a path, test or sample, and the words beside it. It is trained from labelled findings: texts
that hold one candidate each, with label 1 for a secret and 0 for a false positive. `labelled_findings`
makes such a set from a seeded rule; any frame of (text, path, label) will do.

Null and empty texts have no findings. Repeated rows give findings each. Spans are counted in characters
from 0. An empty table gives no rows. Columns other than those named are not looked at; a null path is none.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, table

LABELLED, TREES, DEPTH, SEED = 6_000, 24, 7, 11
THRESHOLD = 0.5
AROUND = 48
#: Spans of secrets are broadcast to the texts up to this many, else the join is shuffled.
BROADCAST_SPANS = 1_000_000
MARK = "[SECRET]"

# Telling names, known forms, words of the dictionary, of samples and of other digests.
_NAMES = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?)"
_ASSIGNED = rf"{_NAMES}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
_FORMS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "git_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}+",
    # Three parts; encrypted ones have five, of which the second may be empty.
    "web_token": r"\beyJ[A-Za-z0-9_-]{8,}+\.(?:[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?+|\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)",
    # To the END line if it comes before the next block, else header lines and lines of the body.
    "private_key": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?:\s++[A-Za-z-]++: [^\r\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})*+)",
}
#: Possessive: a run is taken whole or not at all, in one pass. \G: also what a token of a fixed length leaves of its run.
_LONG = r"(?:\G|(?<![A-Za-z0-9+/_.-]))(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}"
_VALUE = r"(?:[^\s\"'<>,;-]|-(?!----BEGIN )){6,}+"
CANDIDATE = "|".join([rf"{_ASSIGNED}(?:{_FORMS['private_key']}|{_VALUE})", *_FORMS.values(), _LONG])
_DICTIONARY = (
    "password secret token access private public user name admin login account service server client config default value string number data test example sample "
    "dummy change your insert here fake none null true false empty required optional getenv environ get set make file path home index image page version "
    "release build commit branch module class function return import include the and for with from this that have will not are was one all can new"
).split()
_SAMPLES = "example|sample|dummy|placeholder|fake|changeme|change_me|your_|xxxx|redacted|todo|demo"
_DIGESTS = "sha1|sha256|sha-|md5|checksum|digest|commit|revision|etag|uuid|guid|hash|build|version|fingerprint"
_WORDS = "|".join(sorted(_DICTIONARY, key=lambda w: (-len(w), w)))
FEATURES = ["length", "digits", "upper", "lower", "signs", "changes", "vowel_pairs", "distinct", "runs", "hex", "covered", "pathlike", "sample_path", "named_before", "sample_near", "digest_near", "assigned", "known_form", "quoted", "calls"]
_INPUTS = [f"f_{name}" for name in FEATURES]


def _parts(text: str) -> tuple[Column, Column]:
    """The candidates of a text, and what stands before, between and after them."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE)


def _running(steps: str) -> Column:
    """The running sums of an array of longs: within blocks of 256, and then over the blocks, so that long arrays aren't copied once for each member."""
    block = f"aggregate(slice({steps}, b * 256 + 1, 256), named_struct('at', 0L, 'out', array(0L)), (a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at + x))), a -> slice(a.out, 2, 256))"
    blocks = f"transform(sequence(0, CAST((size({steps}) - 1) DIV 256 AS INT)), b -> {block})"
    return F.expr(f"aggregate({blocks}, named_struct('at', 0L, 'out', array(0L)), (a, y) -> named_struct('at', a.at + element_at(y, -1), 'out', concat(a.out, transform(y, x -> x + a.at))), a -> slice(a.out, 2, size(a.out) - 1))")


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row per candidate: the columns in keep, nth (from 0), start, length, value, before, after, match, path."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    found, between = _parts("_text")
    rows = docs.select(*keep, F.col(text_col).alias("_text"), path.alias("_path")).where(F.col("_text").rlike(CANDIDATE))
    rows = rows.select(*keep, "_path", found.alias("_found"), between.alias("_between"))
    parts = f"transform(_found, (m, i) -> named_struct('match', m, 'before', right(_between[i], {AROUND}), 'after', left(_between[i + 1], {AROUND})))"
    # From the begin of a candidate to that of the next one.
    steps = F.expr("transform(_found, (m, i) -> CAST(length(_between[i]) + IF(i = 0, 0, length(_found[i - 1])) AS BIGINT))")
    rows = rows.select(*keep, "_path", F.expr(parts).alias("_parts"), steps.alias("_steps"))
    rows = rows.select(*keep, "_path", F.posexplode(F.arrays_zip(F.col("_parts").alias("part"), _running("_steps").alias("at"))).alias("_nth", "_one"))
    match = F.col("_one.part.match")
    rows = rows.select(*keep, "_nth", "_path", F.col("_one.at").alias("_at"), match.alias("_match"), F.length(F.regexp_extract(match, f"^(?:{_ASSIGNED})?", 0)).alias("_lead"), F.col("_one.part.before").alias("_before"), F.col("_one.part.after").alias("_after"))
    value = F.expr("substring(_match, _lead + 1)")
    return rows.select(*keep, F.col("_nth").alias("nth"), (F.col("_at") + F.col("_lead")).alias("start"), F.length(value).alias("length"), value.alias("value"), F.col("_before").alias("before"), F.col("_after").alias("after"), F.col("_match").alias("match"), F.col("_path").alias("path"))


def with_features(found: DataFrame) -> DataFrame:
    """The candidates with FEATURES as f_..., all doubles."""
    value, low = F.col("value"), F.lower("value")
    size = F.greatest(F.length(value), F.lit(1))

    def share(chars: str) -> Column:
        return F.length(F.regexp_replace(value, f"[^{chars}]", "")) / size

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "."), "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    changes = F.regexp_count(kinds, F.lit(r"(?<=d)[^d]|(?<=l)[^l]|(?<=u)[^u]|(?<=\.)[^.]")) / size
    near = F.lower(F.concat_ws(" ", "before", "match", "after"))
    flag = {
        "length": F.least(F.length(value), F.lit(200)),
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "lower": share("a-z"),
        "signs": F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")) / size,
        "changes": changes,
        "vowel_pairs": F.regexp_count(low, F.lit("[aeiou][bcdfghjklmnpqrstvwxyz]|[bcdfghjklmnpqrstvwxyz][aeiou]")) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "runs": value.rlike(r"(.)\1{3}"),
        "hex": value.rlike("^[0-9a-f]+$"),
        "covered": 1 - F.length(F.regexp_replace(low, _WORDS, "")) / size,
        "pathlike": value.rlike(r"[/\\]|\.\w") | F.col("before").rlike(r"[/\\.]$"),
        "sample_path": F.lower("path").rlike("test|example|sample|docs?/|fixture|mock"),
        "named_before": F.lower(F.concat("before", "match")).rlike(_NAMES + "|bearer|authorization"),
        "sample_near": near.rlike(_SAMPLES),
        "digest_near": F.lower("before").rlike(_DIGESTS),
        "assigned": F.length("match") > F.length("value"),
        "known_form": value.rlike("|".join(f"^(?:{p})" for p in _FORMS.values())),
        "quoted": F.col("match").rlike("[\"']") & F.col("after").rlike("^[\"']"),
        "calls": value.rlike(r"[(){}$\[\]]"),
    }
    return found.withColumns({f"f_{k}": v.cast("double") for k, v in flag.items()})


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = SEED) -> DataFrame:
    """n texts (text, path, label) with one candidate each, from a rule that the seed sets."""
    draw = lambda k: F.sha2(F.concat_ws("/", F.lit(f"{seed}.{k}"), "id").cast("binary"), 256)
    rows = spark.range(0, n, 1, 1).withColumns({"hexes": draw("value"), "more": draw("more")} | {f"long{k}": draw(f"long{k}") for k in range(8)})
    hexes, more = F.col("hexes"), F.col("more")
    packed = F.regexp_replace(F.base64(F.unhex(hexes)), "[^A-Za-z0-9]", "Q")
    upper = F.upper(F.translate(packed, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    pick = lambda k, words: F.element_at(F.array(*map(F.lit, words)), (F.conv(F.substring(draw(k), 1, 6), 16, 10).cast("int") % len(words)) + 1)
    two = lambda k: F.concat_ws(" ", pick(k + "a", _DICTIONARY), pick(k + "b", _DICTIONARY))
    word = lambda k: pick(k, _DICTIONARY)
    name = pick("name", ["password", "passwd", "secret", "token", "api_key", "access_key", "Password", "API_KEY", "credential"])
    equals = pick("equals", ["=", " = ", ": ", '="', ' = "', ': "'])
    close = F.when(F.endswith(equals, F.lit('"')), '"').otherwise("")
    size = F.conv(F.substring(more, 1, 4), 16, 10).cast("int")
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    digest = F.substring(hexes, F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), size % 3 + 1))
    assigned = lambda v: F.concat(name, equals, v, close)
    whole = F.concat(*(F.regexp_replace(F.base64(F.unhex(f"long{k}")), "[^A-Za-z0-9]", "Q") for k in range(8)))  # 352 characters
    rows = stored(rows.withColumn("packed", packed).withColumn("long", whole), "draws")  # else Spark copies the expressions into each use
    packed, long = F.col("packed"), F.col("long")
    jwt = F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), F.substring(long, F.lit(1), size % 293 + 16), F.lit("."), F.substring(packed, 1, 43))
    kind_of_key = pick("pem", ["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "])
    body = F.regexp_replace(F.substring(long, F.lit(1), size % 253 + 100), "(.{64})", "$1\n")
    pem = F.concat(F.lit("-----BEGIN "), kind_of_key, F.lit("PRIVATE KEY-----\n"), body, F.lit("\n-----END "), kind_of_key, F.lit("PRIVATE KEY-----"))
    secrets = [
        F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)),
        assigned(F.substring(hexes, F.lit(1), size % 31 + 14)),
        assigned(F.substring(packed, F.lit(1), size % 24 + 14)),
        F.concat(F.lit("ghp_"), F.substring(packed, 1, 36)),
        assigned(F.concat(F.substring(packed, 1, 5), pick("sign", ["!", "#", "$", "@", "%"]), F.substring(packed, F.lit(9), size % 9 + 4))),
        F.concat(F.lit("xoxb-"), F.substring(F.conv(F.substring(hexes, 1, 12), 16, 10), 1, 11), F.lit("-"), F.substring(packed, 1, 24)),
        jwt,
        assigned(jwt),
        pem,
        assigned(pem),
        F.substring(packed, F.lit(1), size % 21 + 24),
        F.substring(long, F.lit(1), size % 313 + 40),
    ]
    others = [
        uuid,
        F.concat(pick("digest", ["commit ", "sha1 ", "md5 ", "checksum ", "sha256 ", "revision ", "etag "]), digest),
        F.concat(pick("digest", ["commit ", "sha1 ", "md5 ", "checksum ", "sha256 ", "revision ", "etag "]), F.substring(packed, 1, 43)),
        assigned(pick("sample", ["changeme", "your_password", "password123", "example", "xxxxxxxxxxxx", "placeholder", "test1234", "secret123", "dummy-value", "<redacted>", "********", "000000000000"])),
        assigned(F.concat_ws("_", word("p"), word("q"), word("r"))),
        F.concat(F.lit("AKIA"), F.substring(upper, 1, 9), F.lit("EXAMPLE")),
        F.concat(F.lit("https://host/"), word("p"), F.lit("/"), word("q"), F.lit("-"), word("r"), F.lit("-2024/"), word("s"), F.lit("-"), F.substring(F.conv(F.substring(hexes, 1, 6), 16, 10), 1, 4)),
        assigned(F.concat(pick("call", ["getenv", "os.environ", "config.get", "${env", "self.make"]), F.lit("(x1)"))),
        F.concat(word("p"), F.initcap(word("q")), F.initcap(word("r")), F.initcap(word("s")), F.lit("Version"), F.substring(F.conv(F.substring(hexes, 1, 4), 16, 10), 1, 2)),
        F.concat(F.lit("0000000000000000000000"), F.substring(F.conv(F.substring(hexes, 1, 4), 16, 10), 1, 3)),
        F.concat(word("p"), F.lit("_"), word("q"), F.lit("_"), word("r"), F.lit("_"), word("s"), F.lit("_20240101")),
    ]
    kind = F.conv(F.substring(draw("kind"), 1, 6), 16, 10).cast("int")
    one_of = lambda values: F.element_at(F.array(*values), kind % len(values) + 1)
    label = (F.conv(F.substring(draw("label"), 1, 6), 16, 10).cast("int") % 2).alias("label")
    rows = rows.withColumn("label", label)
    text = F.concat(two("before"), F.lit(" "), F.when(F.col("label") == 1, one_of(secrets)).otherwise(one_of(others)), F.lit(" "), two("after"))
    return stored(rows.select(text.alias("text"), pick("path", ["src/main.py", "app/settings.py", "lib/client.js", "deploy/values.yaml", "notes.txt", "src0"]).alias("path"), "label"), "labelled")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """The forest, as it is read from the shared folder: one fresh from fit() holds its training summary, and with it the session, which can't always be sent to tasks."""
    rows = with_features(stored(candidates(findings, ["label"], path_col="path"), "findings")).select("label", *_INPUTS)
    data = VectorAssembler(inputCols=_INPUTS, outputCol="features").transform(rows.coalesce(1))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(data.select("label", "features"))
    forest.write().save(path := new_path(findings.sparkSession, "forest"))
    return RandomForestClassificationModel.load(path)


def scan(docs: DataFrame, model: RandomForestClassificationModel, keep: list[str], threshold: float = THRESHOLD, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """The findings that the forest takes for secrets: keep, nth (the candidate's number in its text), start, length, rule, score, value."""
    rows = with_features(stored(candidates(docs, keep, text_col, path_col), "candidates"))
    rule = F.coalesce(*(F.when(F.col("value").rlike(f"^(?:{p})"), F.lit(n)) for n, p in _FORMS.items()), F.when(F.col("f_assigned") == 1, F.lit("assigned")), F.lit("long_token"))
    judged = model.transform(VectorAssembler(inputCols=_INPUTS, outputCol="features").transform(rows.withColumn("rule", rule)))
    score = vector_to_array("probability")[1]
    return judged.select(*keep, "nth", "start", "length", "rule", score.alias("score"), "value").where(F.col("score") >= threshold)


def redacted(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mark: str = MARK) -> DataFrame:
    """All rows of docs with their columns; secrets in the text are replaced by the mark."""
    keyed = docs.withColumn("_digest", F.xxhash64(text_col))
    found = scan(docs.select(id_col, text_col, *([path_col] if path_col else [])).withColumn("_digest", F.xxhash64(text_col)), model, [id_col, "_digest"], text_col=text_col, path_col=path_col)
    spans = stored(found.groupBy(F.col(id_col).alias("_id"), F.col("_digest").alias("_of")).agg(F.collect_set("nth").alias("_nths")), "spans")
    few = (spans.agg(F.sum(F.size("_nths") + 4)).first()[0] or 0) <= BROADCAST_SPANS
    joined = keyed.join(F.broadcast(spans) if few else spans, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), "left").withColumn("_t", F.col(text_col))
    # What isn't a candidate, and the candidates: as they are, or the mark after the name that the value is assigned to.
    found, between = _parts("_t")
    one = f"concat(_p.b[i], IF(array_contains(_nths, i), concat(regexp_extract(m, '^(?:{_sql(_ASSIGNED)})?', 0), '{_sql(mark)}'), m))"
    clean = F.expr(f"concat(array_join(transform(_p.f, (m, i) -> {one}), ''), element_at(_p.b, -1))")
    joined = joined.withColumn("_p", F.when(F.col("_nths").isNotNull(), F.struct(found.alias("f"), between.alias("b"))))
    return joined.withColumn(text_col, F.when(F.col("_nths").isNull(), F.col("_t")).otherwise(clean)).select(*docs.columns)


def _sql(text: str) -> str:
    """text within a quoted SQL string."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark)), ["doc_id"])
    return found.select("doc_id", "start", "length", "rule", F.round("score", 6).alias("score"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"))
