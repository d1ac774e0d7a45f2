"""Template corpus: discovery, one shred per file, typed tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.graph import group_paths
from flowlens.session import cut, ship

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ELEMENTS = (
    "template string, path string, kind string, ord long, id string, name string, type string, comments string, "
    "group_id string, props array<struct<ord:int,name:string,value:string>>, source string, destination string, "
    "source_type string, destination_type string, relationships array<string>, parse_error string"
)
COLUMNS = [c.strip().split(" ")[0] for c in ELEMENTS.replace("array<struct<ord:int,name:string,value:string>>", "x").split(", ")]
LIGHT_SCHEMA = "id string, name string, type string, config struct<comments:string>"


def template_files(spark: SparkSession, location: str, pattern: str = "*.xml") -> DataFrame:
    """(path, modificationTime, length, content, template) of a file, a glob or a folder read recursively."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(location).select("path", "modificationTime", "length", "content")
    )
    return files.withColumn("template", template_key(spark, location))


def template_key(spark: SparkSession, location: str) -> Column:
    """A file's path below ``location``, so equal names in two folders are two templates; the whole path where it is not below."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(location)
    root = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    return F.when(F.startswith("path", F.lit(root)), F.expr(f"substring(path, {len(root) + 1})")).otherwise(F.col("path"))


def _text(node, path: str, default: str = "") -> str:
    return (node.findtext(path) or default).strip()


def _properties(node) -> list[dict]:
    holder = node.find(".//properties")
    found: dict[str, str | None] = {}
    for entry in [] if holder is None else holder.findall("entry"):
        if entry.findtext("key") is not None:
            found[entry.findtext("key")] = entry.findtext("value")
    return [{"ord": i, "name": k, "value": v} for i, (k, v) in enumerate(found.items())]


def _elements(content: bytes) -> Iterator[dict]:
    """Elements of one template at any depth, each with its document ordinal."""
    root = ET.fromstring(content)
    for i, g in enumerate(root.iterfind(".//processGroups")):
        name = g.findtext("name") or g.findtext("component/name") or g.findtext("component/component/name") or ""
        if _text(g, "id"):
            yield {"kind": "group", "ord": i, "id": _text(g, "id"), "name": name.strip() or "UnnamedGroup",
                   "group_id": _text(g, "parentGroupId") or None}
    for i, p in enumerate(root.iterfind(".//processors")):
        yield {"kind": "processor", "ord": i, "id": _text(p, "id", "Unknown"), "name": _text(p, "name", "Unknown"),
               "type": _text(p, "type", "Unknown"), "comments": _text(p, ".//config/comments"),
               "group_id": p.findtext("parentGroupId"), "props": _properties(p)}
    for kind in ("inputPorts", "outputPorts"):
        for i, p in enumerate(root.iterfind(f".//{kind}")):
            yield {"kind": "port", "ord": i, "id": _text(p, "id", "Unknown"), "name": _text(p, "name", "Unknown"),
                   "type": "INPUT_PORT" if kind == "inputPorts" else "OUTPUT_PORT", "group_id": p.findtext("parentGroupId")}
    for i, c in enumerate(root.iterfind(".//connections")):
        yield {"kind": "connection", "ord": i, "id": _text(c, "id") or None,
               "source": _text(c, ".//source/id", "Unknown"), "destination": _text(c, ".//destination/id", "Unknown"),
               "source_type": _text(c, ".//source/type", "PROCESSOR"),
               "destination_type": _text(c, ".//destination/type", "PROCESSOR"),
               "relationships": [r.text.strip() for r in c.iterfind(".//selectedRelationships") if r.text]}
    for i, s in enumerate(root.iterfind(".//controllerServices")):
        yield {"kind": "service", "ord": i, "id": _text(s, "id") or None, "name": _text(s, "name"),
               "type": _text(s, "type"), "props": _properties(s)}


def shred(files: DataFrame) -> DataFrame:
    """One typed row per element of every file; a file that does not parse gives one row with the error.

    ``files`` has (template, path, content). This is the only place a template is parsed.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for template, path, content in zip(pdf["template"], pdf["path"], pdf["content"]):
                base = {"template": template, "path": path}
                try:
                    rows = [{**base, **e} for e in _elements(bytes(content))]
                    rows.append({**base, "kind": "template", "ord": 0})
                except Exception as exc:  # whatever one file brings, the others are read
                    rows = [{**base, "kind": "template", "ord": 0, "parse_error": f"{type(exc).__name__}: {exc}"}]
                frame = pd.DataFrame(rows, columns=COLUMNS)
                yield frame.astype(object).where(frame.notna(), None)

    return files.select("template", "path", "content").mapInPandas(run, ELEMENTS)


class Corpus:
    """Typed tables of a shredded corpus; the shred is written once and shared by all of them."""

    def __init__(self, elements: DataFrame, fail_fast: bool = False):
        self.elements = cut(elements)
        if fail_fast and not self.errors.isEmpty():
            bad = self.errors.first()
            raise ValueError(f"{bad['path']}: {bad['parse_error']}")

    @classmethod
    def read(cls, spark: SparkSession, location: str, pattern: str = "*.xml", fail_fast: bool = False) -> Corpus:
        return cls(shred(template_files(spark, location, pattern)), fail_fast)

    def _of(self, kind: str) -> DataFrame:
        return self.elements.filter(F.col("kind") == kind)

    @property
    def errors(self) -> DataFrame:
        return self.elements.filter("parse_error IS NOT NULL").select("template", "path", "parse_error")

    @property
    def templates(self) -> DataFrame:
        counts = self.elements.groupBy("template", "path").agg(
            F.count_if(F.col("kind") == "processor").alias("processor_count"),
            F.count_if(F.col("kind") == "connection").alias("connection_count"),
            F.max("parse_error").alias("parse_error"),
        )
        return counts

    @property
    def groups(self) -> DataFrame:
        rows = self._of("group").select(
            "template", F.col("id").alias("group_id"), "name", F.col("group_id").alias("parent_id")
        )
        return rows.join(group_paths(rows), ["template", "group_id"])

    @property
    def processors(self) -> DataFrame:
        homes = self.groups.select(
            "template", "group_id", F.col("name").alias("home"), F.nullif("path", F.lit("")).alias("home_path")
        )
        group = F.coalesce("home", F.lit("Root"))
        return self._of("processor").join(homes, ["template", "group_id"], "left").select(
            "template", F.col("ord").alias("proc_ord"), F.col("id").alias("processor_id"), "name", "type", "comments",
            group.alias("parent_group"), F.coalesce("home_path", group).alias("parent_group_path"), "props",
            F.col("group_id").alias("parent_group_id"), F.substring_index("path", "/", -1).alias("source_file"), F.col("path").alias("source_path"),
        )

    @property
    def connections(self) -> DataFrame:
        return self._of("connection").select(
            "template", F.col("ord").alias("conn_ord"), F.col("id").alias("connection_id"), "source", "destination",
            "source_type", "destination_type", "relationships",
        )

    @property
    def ports(self) -> DataFrame:
        return self._of("port").select("template", F.col("id").alias("port_id"), F.col("type").alias("kind"), "name",
                                       F.col("group_id").alias("parent_group_id"))

    @property
    def services(self) -> DataFrame:
        return self._of("service").select("template", F.col("id").alias("service_id"), "name", "type", "props")


def light_processors(spark: SparkSession, location: str) -> DataFrame:
    """id, name, type and comments through the built-in XML source (no order, no properties)."""
    return (
        spark.read.format("xml").option("rowTag", "processors").option("recursiveFileLookup", "true").schema(LIGHT_SCHEMA)
        .load(location).withColumn("path", F.col("_metadata.file_path")).withColumn("template", template_key(spark, location))
        .select("template", "id", "name", "type",
                               F.coalesce("config.comments", F.lit("")).alias("comments"))
    )
