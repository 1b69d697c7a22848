"""Roadmaps in Markdown, and where they and the files of their phases disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = r"\d+[A-Z]?(?:\.\d+)*"
# Which files of a phase's folder say what.
KINDS = {"plan": "PLAN.md", "summary": "SUMMARY.md", "context": "CONTEXT.md", "research": "RESEARCH.md"}


def roadmap_phases(roadmaps: DataFrame) -> DataFrame:
    """(path, at, number, name, goal, depends_on, ticked) of the phase headings of (path, text), in the order of the text.

    ticked: whether the first check box that names the phase is set. A phase with two headings gives two rows; a null text has none.
    """
    head = rf"(?i)#{{2,4}}\s*Phase\s+{NUMBER}\s*:[^\n]+(?:\n(?!#{{2,4}}\s+Phase\s+\d)[^\n]*)*"
    rows = roadmaps.select("path", "text", F.posexplode(F.regexp_extract_all("text", F.lit(head), F.lit(0))).alias("at", "part"))
    said = lambda label: F.nullif(F.trim(F.regexp_extract("part", rf"(?i)\*\*{label}:\*\*[ \t]*([^\n]+)", 1)), F.lit(""))
    number = F.regexp_extract("part", rf"(?i)^#{{2,4}}\s*Phase\s+({NUMBER})", 1)
    name = F.trim(F.regexp_replace(F.regexp_extract("part", rf"(?i)^#{{2,4}}\s*Phase\s+{NUMBER}\s*:\s*([^\n]+)", 1), r"(?i)\(INSERTED\)", ""))
    phases = rows.select("path", "at", number.alias("number"), name.alias("name"), said("Goal").alias("goal"), said("Depends on").alias("depends_on"))
    boxes = ticks(roadmaps).groupBy("path", "number").agg(F.min_by("ticked", "at").alias("ticked"))
    return phases.join(boxes, ["path", "number"], "left").select("path", "at", "number", "name", "goal", "depends_on", F.coalesce("ticked", F.lit(False)).alias("ticked"))


def ticks(roadmaps: DataFrame) -> DataFrame:
    """(path, at, number, ticked) of the check boxes that name a phase."""
    lines = roadmaps.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)-\s*\[[x ]\]\s*[^\n]*?Phase\s+" + NUMBER), F.lit(0))).alias("at", "box"))
    return lines.select("path", "at", F.regexp_extract("box", rf"(?i)Phase\s+({NUMBER})$", 1).alias("number"), F.col("box").rlike(r"(?i)^-\s*\[x\]").alias("ticked"))


def phase_folders(files: DataFrame) -> DataFrame:
    """(path, number, plans, summaries, has_context, has_research) of (path: the roadmap's, folder: NN-name, file)."""
    kind = lambda k: F.col("file").endswith(f"-{KINDS[k]}") | (F.col("file") == KINDS[k])
    number = F.regexp_replace(F.upper(F.regexp_extract("folder", rf"(?i)^({NUMBER})(?:-|$)", 1)), r"^0+(?=\d)", "")
    rows = files.withColumn("number", number).where("number <> ''")
    return rows.groupBy("path", "number").agg(
        F.count_if(kind("plan")).alias("plans"), F.count_if(kind("summary")).alias("summaries"),
        F.coalesce(F.bool_or(kind("context")), F.lit(False)).alias("has_context"), F.coalesce(F.bool_or(kind("research")), F.lit(False)).alias("has_research"),
    )


def phase_states(phases: DataFrame, folders: DataFrame) -> DataFrame:
    """Adds plans, summaries and state to phases: complete (also if ticked), partial, planned, researched, discussed, empty, or no_directory."""
    bare = F.regexp_replace(F.upper("number"), r"^0+(?=\d)", "")
    rows = phases.withColumn("_n", bare).join(folders.select(F.col("path").alias("_p"), F.col("number").alias("_f"), "plans", "summaries", "has_context", "has_research"), (F.col("path") == F.col("_p")) & (F.col("_n") == F.col("_f")), "left")
    plans, summaries = F.col("plans"), F.col("summaries")
    state = F.when(F.col("ticked"), "complete").when(F.col("_f").isNull(), "no_directory").when((summaries >= plans) & (plans > 0), "complete").when(summaries > 0, "partial")
    state = state.when(plans > 0, "planned").when(F.col("has_research"), "researched").when(F.col("has_context"), "discussed").otherwise("empty")
    return rows.select(*phases.columns, F.coalesce(plans, F.lit(0)).alias("plans"), F.coalesce(summaries, F.lit(0)).alias("summaries"), state.alias("state"))


def drift(phases: DataFrame, boxes: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, number, rule): boxes without a heading, headings without a folder, folders without a heading, and plans and summaries that don't match."""
    bare = F.regexp_replace(F.upper("number"), r"^0+(?=\d)", "").alias("number")
    known, ticked, there = phases.select("path", bare).distinct(), boxes.select("path", bare).distinct(), folders.select("path", "number")
    rule = lambda df, name: df.select("path", "number", F.lit(name).alias("rule"))
    keys = ["path", "number"]
    return (
        rule(ticked.join(known, keys, "left_anti"), "box_without_heading")
        .unionByName(rule(known.join(there, keys, "left_anti"), "phase_without_folder"))
        .unionByName(rule(there.join(known, keys, "left_anti"), "folder_without_phase"))
        .unionByName(rule(folders.where("plans > summaries AND summaries > 0"), "plan_without_summary"))
        .unionByName(rule(folders.where("summaries > plans"), "summary_without_plan"))
    )
