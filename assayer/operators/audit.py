"""Audits of what is published: cells of result tables against recomputed ones, and the files of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from assayer.functions.text import SECRETS
from assayer.operators.coverage import manifest_diff, published
from assayer.sources.files import below, digests, listing

# What a tree may hold, and which of its files are texts.
TEXT_ENDINGS = (".cfg", ".csv", ".ini", ".jinja", ".json", ".jsonl", ".md", ".py", ".sh", ".toml", ".txt", ".yaml", ".yml")
MANUSCRIPTS = (".doc", ".docx", ".hwp", ".hwpx", ".tex")
FIGURES = (".png", ".pdf", ".svg")


# Cells.
def cells(df: DataFrame, keys: list[str], name: str | Column) -> DataFrame:
    """(table, row, column, value, number): one row for each cell beside the keys; ``row`` is the keys' texts.

    ``value`` is the cell's text (null for an empty one), ``number`` its value where it is a number. Tables of many names may stand in one.
    """
    table = F.lit(name) if isinstance(name, str) else name
    row = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    each = []
    for f in df.schema:
        if f.name not in keys:
            text = F.nullif(F.col(f"`{f.name}`").cast("string"), F.lit(""))
            number = F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, NumericType) else text.try_cast("double")
            each.append(F.struct(F.lit(f.name).alias("column"), text.alias("value"), number.alias("number")))
    return df.select(table.alias("table"), row.alias("row"), F.explode(F.array(*each)).alias("_c")).select("table", "row", "_c.*")


def audit_cells(recorded: DataFrame, actual: DataFrame, within: float = 0.0) -> DataFrame:
    """(table, row, column, fault, recorded, actual) of tables of ``cells`` that should be alike.

    A column or a row that one side lacks as a whole is one fault (``column`` or ``row`` is null in it), not one a cell.
    Numbers may differ by ``within``; NaN equals NaN; an empty cell equals an empty one alone. A row that a side holds twice is a fault too.
    """
    sides = {"recorded": recorded, "actual": actual}
    out = []
    for kind, other in ((["table", "column"], "row"), (["table", "row"], "column")):
        has = [df.select(*kind).distinct().withColumn(f"_{n}", F.lit(True)) for n, df in sides.items()]
        fault = F.when(F.col("_actual").isNull(), F.lit(f"{kind[1]} missing")).when(F.col("_recorded").isNull(), F.lit(f"{kind[1]} added"))
        out.append(has[0].join(has[1], kind, "full_outer").where(fault.isNotNull()).select(*kind, fault.alias("fault")).withColumn(other, F.lit(None).cast("string")))
    for n, df in sides.items():
        twice = df.groupBy("table", "row", "column").agg(F.count("*").alias("n")).where("n > 1").select("table", "row").distinct()
        out.append(twice.select("table", "row", F.lit(f"row repeated, {n}").alias("fault"), F.lit(None).cast("string").alias("column")))
    own = [df.select("table", "row", "column", F.col("value").alias(f"{n}"), F.col("number").alias(f"_{n}")) for n, df in sides.items()]
    a, b = F.col("_recorded"), F.col("_actual")
    near = F.when(a.isNotNull() & b.isNotNull(), (F.isnan(a) & F.isnan(b)) | (a == b) | (F.abs(a - b) <= within))
    alike = F.coalesce(near, F.col("recorded").eqNullSafe(F.col("actual")))
    changed = own[0].join(own[1], ["table", "row", "column"]).where(~alike).select("table", "row", "column", F.lit("changed").alias("fault"), "recorded", "actual")
    nothing = F.lit(None).cast("string")
    for df in out:
        changed = changed.unionByName(df.select("table", "row", "column", "fault", nothing.alias("recorded"), nothing.alias("actual")))
    return changed


def table_checks(faults: DataFrame, tables: list[str]) -> DataFrame:
    """(name, ok) of each table that is expected; one without a fault is in order."""
    found = faults.groupBy("table").agg(F.count("*").alias("n"))
    named = faults.sparkSession.createDataFrame([(t,) for t in tables], "name string")
    return named.join(found, named["name"] == found["table"], "left").select("name", (F.coalesce("n", F.lit(0)) == 0).alias("ok"))


# Trees.
def is_text(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.exists(F.array(*map(F.lit, TEXT_ENDINGS)), lambda e: F.endswith(F.lower(name), e)) | name.isin("LICENSE", ".gitignore")


def scan(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    """(path, form): forms of secrets in the text files of a tree (``every``: in all files), whole files, each pair once.

    Files that are not UTF-8 as a whole are left out. Files are read by lines and large ones by several tasks: no form spans a line.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(root)
    path = below(spark, root, F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))
    lines = lines.select(path.alias("path"), F.col("value")) if every else lines.select(path.alias("path"), F.col("value")).where(is_text(F.col("path")))
    valid = F.is_valid_utf8("value")
    found = F.array(*(F.when(valid, F.col("value").rlike(p)).otherwise(False) for p in SECRETS.values()))
    of_file = lines.groupBy("path").agg(F.bool_and(valid).alias("_whole"), *(F.bool_or(F.get(found, F.lit(k))).alias(f"_f{k}") for k in range(len(SECRETS))))
    forms = F.array_compact(F.array(*(F.when(F.col(f"_f{k}"), F.lit(name)) for k, name in enumerate(SECRETS))))
    return of_file.where("_whole").select("path", F.explode(forms).alias("form"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(digest, path, sound) of a manifest's lines; ``sound``: a digest, two spaces and a path. The path of another line is the line."""
    lines = spark.read.text(path).where("value <> ''")
    sound = F.col("value").rlike(r"^[0-9a-f]{64}  \S.*$")
    path = F.when(sound, F.substring("value", F.lit(67), F.length("value"))).otherwise(F.col("value"))
    return lines.select(F.left("value", F.lit(64)).alias("digest"), path.alias("path"), sound.alias("sound"))


def tree_faults(spark: SparkSession, root: str, data: str = "data", manifest_name: str = "MANIFEST.sha256") -> DataFrame:
    """(rule, path) of everything that a tree must not hold, or lacks.

    Rules: README.md is the only Markdown; no manuscripts, no figures; a LICENSE; below ``data`` only published files and the manifest;
    the manifest's lines are sound, name each published file once and no other, with its digest; no form of a secret in a text.
    """
    files = listing(spark, root).select("path")
    lower = F.lower("path")

    def ends(*endings: str) -> Column:
        return F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(lower, e))

    def as_rule(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), "path")

    def lacking(name: str, path: str) -> DataFrame:
        wanted = spark.createDataFrame([(path,)], "path string")
        return as_rule(name, wanted.join(files, "path", "left_anti"))

    place = f"{data}/{manifest_name}"
    in_data = files.where(F.startswith("path", F.lit(f"{data}/"))).select(F.substring("path", F.lit(len(data) + 2), F.length("path")).alias("inner"), "path")
    out = [
        as_rule("Markdown", files.where(ends(".md") & (F.col("path") != "README.md"))), lacking("Markdown", "README.md"),
        as_rule("manuscript", files.where(ends(*MANUSCRIPTS))), as_rule("figure", files.where(ends(*FIGURES))), lacking("licence", "LICENSE"),
        as_rule("not published", in_data.where(~published(F.col("inner")) & (F.col("path") != place))), lacking("manifest", place),
        as_rule("secret", scan(spark, root)),
    ]
    fs_path = f"{root}/{place}"
    if _exists(spark, fs_path):
        recorded = manifest(spark, fs_path)
        actual = digests(spark, f"{root}/{data}").where(published(F.col("path"))).select(F.concat(F.lit(f"{data}/"), "path").alias("path"), "digest")
        states = manifest_diff(recorded.where("sound").groupBy("path").agg(F.min("digest").alias("digest")), actual).where("state <> 'ok'")
        out += [
            states.select(F.concat(F.lit("manifest: "), "state").alias("rule"), "path"),
            as_rule("manifest: line", recorded.where("not sound")),
            as_rule("manifest: repeated", recorded.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")),
        ]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
