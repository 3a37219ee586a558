"""Strict JSON lines: comments and blanks are skipped, everything else must be a whole, standard object."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from assayer.functions.text import safe_name
from assayer.functions.verdicts import strip
from assayer.operators.published import file_system
from assayer.schemas import QUESTION


def _fail(name: str):
    raise ValueError(name)


def line_error(line: str, nan: bool = False) -> str | None:
    """Why a line is refused: not JSON, trailing text, a bare NaN or Infinity (unless ``nan``), or no object."""
    try:
        value = json.loads(line) if nan else json.loads(line, parse_constant=_fail)
    except (ValueError, RecursionError) as e:
        return f"{type(e).__name__}: {e}"
    return None if isinstance(value, dict) else "not an object"


def is_object(text: Column) -> Column:
    """Whether the text is one JSON object and nothing else, as Spark's parser has it (which also refuses repeated names).

    The parser stops behind a value. Text behind it cannot close a list and an object alike, so both are tried; of one
    value its first sign tells whether it is an object.
    """
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(listed.isNotNull() & named.isNotNull() & text.rlike(r"^[ \t\r\n]*\{"), F.lit(False))


def check(line: str, nan: bool = False) -> Column:
    """The reason for which a line is refused, or null. Only lines that Spark's parser does not take go to Python."""
    reasons = F.pandas_udf(lambda lines: lines.map(lambda x: line_error(x, nan), na_action="ignore"), "string")
    return reasons(F.when(~is_object(F.col(line)), F.col(line)))


def decoded(path: Column) -> Column:
    """A file's path as it is on disk: Spark encodes it by percent signs, in which a plus stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, file, seq): files stay splittable; ``seq`` orders lines within a file, files sort by decoded name."""
    df = spark.read.text(path)
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(F.col("value").alias("line"), decoded(F.col("_metadata.file_path")).alias("file"), order.alias("at")).select("line", "file", F.struct("file", "at").alias("seq"))


def content(df: DataFrame, comments: bool = True) -> DataFrame:
    """Lines that count: no blanks, and with ``comments`` none that begin with #."""
    own = strip(F.col("line"))
    return df.where((own != "") & (~F.startswith(own, F.lit("#")) if comments else F.lit(True)))


def parse(df: DataFrame, schema: str, required: tuple[str, ...] = (), nan: bool = False) -> DataFrame:
    """Adds the record's columns and ``reject`` (null for a good line).

    A value of another type than its column's, or a required field that is missing, also rejects a line.
    ``nan`` admits bare NaN and Infinity.
    """
    mode = {"mode": "PERMISSIVE", "allowNonNumericNumbers": str(nan).lower(), "columnNameOfCorruptRecord": "_bad"}
    rows = df.withColumn("_r", F.from_json("line", f"{schema}, _bad string", mode)).withColumn("reject", check("line", nan))
    loose = F.when(F.col("_r._bad").isNotNull() | F.col("_r").isNull(), F.lit("types"))
    for name in required:
        loose = F.coalesce(loose, F.when(F.col(f"_r.{name}").isNull(), F.lit(f"missing {name}")))
    rows = rows.withColumn("reject", F.coalesce("reject", loose))
    return rows.select(*df.columns, "_r.*", "reject").drop("_bad")


def refused(spark: SparkSession, path: str | list[str], schema: str, required: tuple[str, ...] = (), **options) -> DataFrame:
    """(file, line, reject) of lines that ``read`` would not take."""
    rows = parse(content(lines(spark, path), options.pop("comments", True)), schema, required, **options)
    return rows.where("reject is not null").select("file", "line", "reject")


def read(spark: SparkSession, path: str | list[str], schema: str, required: tuple[str, ...] = (), comments: bool = True, nan: bool = False) -> DataFrame:
    """Records with file and seq, in one pass: any job over them fails at a line that is refused, and names it.

    ``comments``: whether lines that begin with # are skipped; ``nan``: whether bare NaN and Infinity are admitted.
    """
    rows = parse(content(lines(spark, path), comments), schema, required, nan)
    said = F.concat(F.lit("refused line in "), "file", F.lit(": "), "reject", F.lit(": "), F.left("line", F.lit(200)))
    return rows.where(F.when(F.col("reject").isNull(), True).otherwise(F.raise_error(said).cast("boolean"))).drop("reject", "line")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions in the order of their ids; raises at one that breaks a rule or repeats an id."""
    from assayer.operators.gates import duplicate_keys, question_rules, require_none, violations

    found = read(spark, path, QUESTION, ("question_id", "turns"))
    require_none(violations(found, question_rules()).select("file", "question_id", "reason"), "invalid questions")
    require_none(duplicate_keys(found, "question_id"), "repeated question_id")
    return found.select("question_id", "category", "turns", "reference").orderBy("question_id")


def judgments(spark: SparkSession, root: str, protocol: str, schema: str, required: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """All records of a protocol below ``root/{lang}/judgments/{family}/{judge}``, with path columns and ``seq``.

    Files of a folder are one table: models are those that records name, not file names.
    """
    return with_path_columns(read(spark, f"{root}/*/judgments/*/*/{protocol}/*.jsonl", schema, required))


def stems(spark: SparkSession, folder: str) -> list[str]:
    """Names of the .jsonl files of a folder without their ending, in order; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "*.jsonl"))
    return sorted(f.getPath().getName().removesuffix(".jsonl") for f in found or ())


def has_odd_number(value: Column, kind: DataType) -> Column | None:
    """Whether a value holds NaN or Infinity at any depth; None if its type holds no such numbers."""
    if isinstance(kind, (FloatType, DoubleType)):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    if isinstance(kind, ArrayType):
        inner = has_odd_number(F.lit(None).cast(kind.elementType), kind.elementType)
        return None if inner is None else F.coalesce(F.exists(value, lambda x: has_odd_number(x, kind.elementType)), F.lit(False))
    if isinstance(kind, MapType):
        parts = [has_odd_number(f(value), ArrayType(t)) for f, t in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))]
    elif isinstance(kind, StructType):
        parts = [has_odd_number(value.getField(f.name), f.dataType) for f in kind]
    else:
        return None
    found = [p for p in parts if p is not None]
    return reduce(Column.__or__, found) if found else None


def numbers_checked(df: DataFrame) -> DataFrame:
    """``df``; a job over it fails at a number that JSON does not have, in whatever array, struct or map it is."""
    odd = [o for f in df.schema if (o := has_odd_number(F.col(f"`{f.name}`"), f.dataType)) is not None]
    if not odd:
        return df
    return df.where(F.when(reduce(Column.__or__, odd), F.raise_error(F.lit("a number that is no JSON")).cast("boolean")).otherwise(True))


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """One JSON object a line, nulls written out, other scripts as they are; ``mode`` append adds files. Returns the number of rows.

    The job fails at a number that JSON does not have.
    """
    checked = numbers_checked(df)
    seen = Observation()
    checked.observe(seen, F.count("*").alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


#: Files of one tree.
MOST_FILES = 100_000


def write_tree(df: DataFrame, root: str, file: Column, order: list[str]) -> int:
    """One JSON-lines file for each value of ``file`` (a path below ``root``, such as ``answers/m.jsonl``), its rows in ``order``; the number of files.

    The whole tree is written beside ``root`` and takes its place at once; if a job fails, or a number is none that
    JSON has, the old tree stays. Rows are dealt out by file and each file is written by one task as it sorts, so tasks hold no file
    whole. Nulls are written out. Paths are names of the file system as they stand, so any sign but ``/`` may be part of a name.
    """
    spark = df.sparkSession
    rows = numbers_checked(df).withColumn("_file", file)
    names = [r[0] for r in rows.select("_file").distinct().orderBy("_file").limit(MOST_FILES + 1).collect()]
    odd = [n for n in names if not n or n.startswith("/") or any(part in ("", ".", "..") for part in n.split("/"))]
    if len(names) > MOST_FILES or odd:
        raise ValueError(f"over {MOST_FILES} files" if not odd else f"no paths of files: {odd[:10]}")
    numbered = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "_file string, _number int")
    fs, at = file_system(spark, root)
    new, old = (file_system(spark, f"{root}.{kind}-{uuid.uuid4().hex}")[1] for kind in ("new", "old"))
    try:
        dealt = rows.join(F.broadcast(numbered), "_file").drop("_file").repartition("_number").sortWithinPartitions("_number", *order)
        dealt.write.partitionBy("_number").option("ignoreNullFields", "false").json(f"{new}/.rows")
        for k, name in enumerate(names):
            written = [s.getPath() for s in fs.globStatus(file_system(spark, f"{new}/.rows/_number={k}/part-*")[1])]
            to = file_system(spark, f"{new}/{name}")[1]
            fs.mkdirs(to.getParent())
            if len(written) != 1 or not fs.rename(written[0], to):
                raise OSError(f"cannot put {name} into place")
            if fs.getScheme() == "file":  # checksums that Hadoop keeps beside local files are no part of a tree
                fs.getRawFileSystem().delete(file_system(spark, f"{to.getParent().toString()}/.{to.getName()}.crc")[1], False)
        fs.mkdirs(new)
        fs.delete(file_system(spark, f"{new}/.rows")[1], True)
        had = fs.exists(at)
        if had and not fs.rename(at, old) or not fs.rename(new, at):
            if had and not fs.exists(at):
                fs.rename(old, at)
            raise OSError(f"cannot replace {root}")
    finally:
        fs.delete(new, True)
    fs.delete(old, True)
    return len(names)


def answer_file(model: Column) -> Column:
    return F.concat(F.lit("answers/"), safe_name(model), F.lit(".jsonl"))


def judgment_file(family: Column, judge: Column, protocol: Column, *models: Column) -> Column:
    """``judgments/{family}/{judge}/{protocol}/{model}.jsonl``, or ``{a}_vs_{b}.jsonl`` of a pair."""
    return F.concat(F.lit("judgments/"), F.concat_ws("/", safe_name(family), safe_name(judge), protocol, F.concat_ws("_vs_", *map(safe_name, models))), F.lit(".jsonl"))


def with_path_columns(df: DataFrame) -> DataFrame:
    """lang, judge_key, protocol, file_name from ``.../{lang}/judgments/{family}/{judge}/{protocol}/{file_name}.jsonl``."""
    parts = F.split("file", "/")
    back = lambda k: F.try_element_at(parts, F.lit(-k))
    return df.withColumns({"lang": back(6), "judge_key": back(3), "protocol": back(2), "file_name": F.regexp_replace(back(1), r"\.jsonl$", "")})
