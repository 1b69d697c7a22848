"""Shorter forms of command output, canonical JSON, and variants of questions. All are column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log filter.
MIN_LINES, CAP, HEAD, TAIL = 30, 200, 40, 40
DIAGNOSTIC = "(?i)error|fail|warning|panic|exception"
ESCAPE_HATCH = "… output compressed (raw available) …"
PORTS = 40
# The third variant's kind by domain, the order of domains that tie, and the most words of a variant.
THIRD_VARIANT = {
    "database": "cross-domain", "api": "cross-domain", "security": "constraint-removal", "frontend": "lateral", "backend": "cross-domain", "infrastructure": "constraint-removal",
    "performance": "constraint-removal", "authentication": "constraint-removal", "caching": "cross-domain", "deployment": "constraint-removal", "monitoring": "constraint-removal", "testing": "lateral",
}
FIRST_DOMAINS = ["database", "api", "security", "frontend", "backend", "infrastructure"]
MOST_WORDS = 8


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def elided_log(text: Column) -> Column:
    """The text with adjacent equal lines as one with its count and, of more than CAP lines then left, the head, the diagnostic lines between, and the tail; as it is where that isn't shorter."""
    ends = F.endswith(text, F.lit("\n"))
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)

    def shortened(lines: Column) -> Column:
        n = F.size(lines)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(lines, i) != F.get(lines, i - 1)))
        def marked(starts: Column) -> Column:
            def one(s: Column, j: Column) -> Column:
                count = F.coalesce(F.get(starts, j + 1), n) - s
                return F.when(count > 1, F.concat(F.get(lines, s), F.lit(" (×"), count.cast("string"), F.lit(")"))).otherwise(F.get(lines, s))
            return F.transform(starts, one)
        def cut(kept: Column) -> Column:
            middle = F.slice(kept, F.lit(HEAD + 1), F.size(kept) - HEAD - TAIL)
            told = F.filter(middle, lambda x: x.rlike(DIAGNOSTIC))
            note = F.concat(F.lit("… "), (F.size(middle) - F.size(told)).cast("string"), F.lit(" lines elided (raw available) …"))
            return F.when(F.size(kept) > CAP, F.concat(F.slice(kept, 1, HEAD), told, F.array(note), F.slice(kept, F.size(kept) - TAIL + 1, F.lit(TAIL)))).otherwise(kept)
        return F.when(n < MIN_LINES, lines).otherwise(_bound(_bound(starts, marked), cut))

    result = F.concat(F.array_join(_bound(lines, shortened), "\n"), F.when(ends, "\n").otherwise(""))
    tail = F.concat(F.when(ends, "").otherwise("\n"), F.lit(ESCAPE_HATCH + "\n"))
    return _bound(result, lambda r: F.when(F.length(r) >= F.length(text), text).otherwise(F.concat(r, tail)))


def container_list(text: Column) -> Column:
    """A line for each container of JSON lines (Names, Image, State, Status, Ports), below their number. A text with any other line, or without a container, stays as it is."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")

    def listed(rows: Column) -> Column:
        ok = F.forall(rows, lambda r: r.isNotNull())
        found = F.filter(rows, lambda r: r["Names"].isNotNull() & (r["Image"].isNotNull() | r["State"].isNotNull() | r["Status"].isNotNull()))

        def one(c: Column) -> Column:
            part = lambda name: F.coalesce(c[name], F.lit(""))
            state = F.when((part("State") != "") & (part("Status") != ""), F.concat(part("State"), F.lit("("), part("Status"), F.lit(")"))).otherwise(F.concat(part("State"), part("Status")))
            gap = lambda x: F.when(x != "", F.concat(F.lit("  "), x)).otherwise("")
            return F.concat(c["Names"], gap(part("Image")), gap(state), F.when(F.length(part("Ports")) <= PORTS, gap(part("Ports"))).otherwise(""))

        def told(found: Column) -> Column:
            n = F.size(found).cast("string")
            head = F.concat(F.lit("docker ps: "), n, F.when(F.size(found) == 1, " container").otherwise(" containers"))
            foot = F.concat(n, F.lit(" containers — raw: docker ps --format json"))
            return F.when(ok & (F.size(found) > 0), F.concat(F.array_join(F.concat(F.array(head), F.transform(found, one), F.array(foot)), "\n"), F.lit("\n"))).otherwise(text)

        return _bound(found, told)

    parsed = F.transform(lines, lambda x: F.when(F.ltrim(x).startswith("{"), F.from_json(x, "map<string,string>")))
    return _bound(parsed, listed)


def json_string(value: Column) -> Column:
    """A string as JSON in ASCII; null is null. Signs beyond ASCII stand as the escapes of their UTF-16 units. Runs of plain signs are taken as they are, others run by run."""
    out = F.regexp_replace(value, r'(["\\])', r"\\$1")
    for c, escape in {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}.items():
        out = F.replace(out, F.lit(c), F.lit(escape))
    runs = F.regexp_extract_all(out, F.lit("[ -~]+|[^ -~]+"), F.lit(0))
    escaped = lambda r: F.regexp_replace(F.lower(F.hex(F.encode(r, "UTF-16BE"))), "(.{4})", r"\\u$1")
    one = lambda r: F.when(F.ascii(r).between(32, 126), r).otherwise(escaped(r))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(runs, one), ""), F.lit('"')))


def json_strings(values: Column) -> Column:
    return F.when(values.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(values, json_string), ", "), F.lit("]")))


def context_version(task_id: Column, original_intent: Column, completed_work: Column, current_state: Column, active_constraints: Column, relevant_files: Column, next_actions: Column) -> Column:
    """SHA-256 of the canonical JSON (keys sorted) of a context: texts, and arrays of texts for work, constraints, files and actions."""
    fields = {"active_constraints": json_strings(active_constraints), "completed_work": json_strings(completed_work), "current_state": json_string(current_state), "next_actions": json_strings(next_actions), "original_intent": json_string(original_intent), "relevant_files": json_strings(relevant_files), "task_id": json_string(task_id)}
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).cast("binary"), 256)


def query_variants(query: Column, domain: Column) -> Column:
    """Three other questions (type, query) for a question of a domain, of eight words at most."""
    topic = F.trim(F.regexp_replace(query, "^(?i)(how to |what is |why does )", ""))
    kinds = F.create_map(*[F.lit(x) for kv in THIRD_VARIANT.items() for x in kv])
    third = F.coalesce(kinds[domain], F.lit("lateral"))
    text = F.when(third == "lateral", F.concat(F.lit("natural systems analogy "), topic)).when(third == "cross-domain", F.concat(F.lit("alternative approaches "), topic, F.lit(" tradeoffs"))).otherwise(F.concat(F.lit("unlimited resources approach "), topic))
    variants = [(F.lit("inversion"), F.concat(topic, F.lit(" failures common mistakes"))), (F.lit("anti-pattern"), F.concat(topic, F.lit(" anti-patterns worst practices"))), (third, text)]

    def short(q: Column) -> Column:
        return _bound(F.split(q, r"\s+"), lambda w: F.when(F.size(w) > MOST_WORDS, F.array_join(F.slice(w, 1, MOST_WORDS), " ")).otherwise(q))

    return F.array(*[F.struct(kind.alias("type"), short(q).alias("query")) for kind, q in variants])
