"""Strict scans of JSON files: what is not as declared becomes a finding, never a null (SC9, SC11, SC12, SC13, V20, V22, V41).

A file is parsed once into a variant; its fields' types are asked of the variant itself, so a number is no string and a
string no number. A file's fault is the first of: no JSON, no object, a field missing or of another type, an item of a
list at fault. Files without fault give typed rows.

Defined results: an empty or null content is no JSON; further fields are let be; a repeated file is a file of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a variant names the types that fields may have.
NAMES = {"string": "STRING", "long": "BIGINT", "boolean": "BOOLEAN"}
#: What lists and objects alone can be read as; their schema would be that of everything in them.
READ_AS = {"array": "array<variant>", "object": "map<string,variant>"}


@dataclass(frozen=True)
class Declared:
    """Fields with their types, those that may be absent or null, and the fields of the items of lists and of objects of objects."""

    fields: dict[str, str]
    optional: frozenset[str] = frozenset()
    items: dict[str, Declared] = field(default_factory=dict)


# The formats of the project's files and the schema versions that are read.
CHUNK = Declared({"schema_version": "long", "chunk_id": "string", "records": "array"}, frozenset({"schema_version"}), {"records": Declared({"id": "string", "source": "string"})})
VERSION = Declared({"version": "long", "subversion": "long", "version_ref": "string", "target": "string", "status": "string"})
STORE = Declared({"version": "long", "records": "object"}, items={"records": Declared({"source_sha256": "string", "active_version": "string", "versions": "array"}, frozenset({"active_version"}), {"versions": VERSION})})
OLD_STORE = Declared({"records": "object"}, items={"records": Declared({"target": "string", "status": "string", "source_sha256": "string"}, frozenset({"source_sha256"}))})
LEDGER = Declared({"versions": "array"}, items={"versions": Declared({"version_ref": "string"})})
MANIFEST = Declared({"chunk_size": "long", "record_id_scheme": "string", "source_sha256": "string"}, frozenset({"source_sha256"}))
CONTEXT = Declared({"glossary": "array", "style": "object"}, frozenset({"style"}), {"glossary": Declared({"source": "string", "target": "string"}, frozenset({"target"}))})
SUPPORTED = (1, 2)


def get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return get(value, "$", READ_AS[kind]).isNotNull() if kind in READ_AS else F.schema_of_variant(value).startswith(NAMES[kind])


def fault(value: Column, declared: Declared, where: str = "") -> Column:
    """The first fault of a variant against its declaration, or null."""
    faults = [F.when(value.isNull() | ~F.coalesce(_is(value, "object"), F.lit(False)), F.lit(f"{where}object"))]
    for name, kind in declared.fields.items():
        got = get(value, f"$.{name}")
        absent = got.isNull() | F.is_variant_null(got)
        wrong = absent if name not in declared.optional else F.lit(False)
        faults.append(F.when(wrong | (~absent & ~_is(got, kind)), F.lit(f"{where}field {name}")))
    for name, each in declared.items.items():
        if declared.fields[name] == "array":
            items = get(value, f"$.{name}", "array<variant>")
        else:
            items = F.map_values(get(value, f"$.{name}", "map<string,variant>"))
        found = F.filter(F.transform(items, _each(each, f"{where}{name} ")), lambda x: x.isNotNull())
        faults.append(F.get(found, 0))
    return F.coalesce(*faults)


def _each(declared: Declared, where: str) -> Callable[[Column], Column]:
    return lambda item: fault(item, declared, where)


def scanned(files: DataFrame, declared: Declared, content: str = "content", otherwise: Callable[[Column], tuple[Column, Declared]] | None = None) -> DataFrame:
    """files with `parsed`, their variant, and `fault`: "json", "object", "field x", "records field y" or null.

    otherwise: of a variant, when it has another declaration, and which.
    """
    text = F.trim(F.coalesce(content, F.lit("")))
    # one value and nothing behind it: as the only item of a list it parses too
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.size(get(one, "$", "array<variant>")) == 1
    rows = files.withColumn("parsed", F.when(alone, F.try_parse_json(text)))
    found = F.when(F.col("parsed").isNull(), "json")
    if otherwise:
        when, other = otherwise(F.col("parsed"))
        found = found.when(when, fault(F.col("parsed"), other))
    # as the item of a list: conditions on `fault` stay above it, else each of its mentions of `parsed` parses the file again
    return rows.select("*", F.explode(F.array(found.otherwise(fault(F.col("parsed"), declared)))).alias("fault"))


def findings(files: DataFrame, keys: list[str], declared: Declared, rule: str, otherwise: Callable[[Column], tuple[Column, Declared]] | None = None) -> DataFrame:
    """(keys, severity, rule, detail): V22, V41 - a finding for each file at fault."""
    return scanned(files, declared, otherwise=otherwise).where("fault IS NOT NULL").select(*keys, F.lit("error").alias("severity"), F.lit(rule).alias("rule"), F.col("fault").alias("detail"))


def chunk_findings(files: DataFrame, keys: list[str]) -> DataFrame:
    """SC11: files that are no chunks, and chunks of a schema version that is not supported."""
    rows = scanned(files, CHUNK).withColumn("v", get(F.col("parsed"), "$.schema_version", "long"))
    rule = F.when(F.col("fault").isNotNull(), "invalid_source_chunk").when(~F.col("v").isin(*SUPPORTED), "unsupported_chunk_schema_version")
    detail = F.coalesce("fault", F.concat(F.lit("version "), F.col("v").cast("string")))
    return rows.select(*keys, F.lit("error").alias("severity"), rule.alias("rule"), detail.alias("detail")).where("rule IS NOT NULL")


def chunk_records(files: DataFrame, keys: list[str]) -> DataFrame:
    """SC9: (keys, chunk, pos, record_id, source) of the chunks without fault."""
    rows = scanned(files, CHUNK).where("fault IS NULL")
    items = F.posexplode(get(F.col("parsed"), "$.records", "array<variant>")).alias("pos", "record")
    return rows.select(*keys, get(F.col("parsed"), "$.chunk_id", "string").alias("chunk"), items).select(*keys, "chunk", "pos", get(F.col("record"), "$.id", "string").alias("record_id"), get(F.col("record"), "$.source", "string").alias("source"))


def store_candidates(files: DataFrame, keys: list[str]) -> DataFrame:
    """SC13: (keys, record_id, version_ref, target, status, active) of the stores without fault; old ones as version 1.1, the active one."""
    version = F.when(F.try_parse_json("content").isNotNull(), get(F.try_parse_json("content"), "$.version", "long"))
    now = scanned(files.where(F.coalesce(version, F.lit(1)) == 2), STORE).where("fault IS NULL")
    old = scanned(files.where(F.coalesce(version, F.lit(1)) != 2), OLD_STORE).where("fault IS NULL")

    def records(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, F.explode(get(F.col("parsed"), "$.records", "map<string,variant>")).alias("record_id", "r"))

    made = records(now).select(*keys, "record_id", get(F.col("r"), "$.active_version", "string").alias("a"), F.explode(get(F.col("r"), "$.versions", "array<variant>")).alias("v"))
    made = made.select(*keys, "record_id", *(get(F.col("v"), f"$.{c}", "string").alias(c) for c in ("version_ref", "target", "status")), "a").withColumn("active", F.coalesce(F.col("version_ref") == F.col("a"), F.lit(False))).drop("a")
    raised = records(old).select(*keys, "record_id", F.lit("1.1").alias("version_ref"), *(get(F.col("r"), f"$.{c}", "string").alias(c) for c in ("target", "status")), F.lit(True).alias("active"))
    return made.unionByName(raised)


def store_findings(files: DataFrame, keys: list[str]) -> DataFrame:
    """Stores that are neither of the version that is written now nor of the old one; the files are read once."""
    return findings(files, keys, OLD_STORE, "invalid_translation_store", lambda parsed: (get(parsed, "$.version", "long") == 2, STORE))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a pattern, one row a file; empty ones, which Spark's readers pass over, are listed apart."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    empty = [(f.getPath().toString(), "") for f in listed if f.isFile() and f.getLen() == 0]
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("content"))
    return rows.unionByName(spark.createDataFrame(empty, "path string, content string"))
