"""Versioned graph snapshots as Parquet, and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType

from .functions.ids import edge_id


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one of its own only for a local session that names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    All tables of an application lie in one folder of its name, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def listing(spark: SparkSession, folder: str) -> str:
    """A digest of a folder's tables as they stand: names, sizes and times of what lies in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return hashlib.sha256("|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found)).encode()).hexdigest()


NODES = "id string, kind string, name string, properties variant"
EDGES = "type string, src string, dst string, occurrence_count long, edge_id string, derived boolean, properties variant"
LOG = "project_id string, graph_version long, action string, path string, seq long"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def put_entry(spark: SparkSession, folder: str, seq: int, entry: dict) -> bool:
    """Write entry number seq of a log of JSON files, whole or not at all; False if there is one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    name = f"{seq:012d}.json"
    spare = fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")  # hidden from readers
    files = spare.getFileSystem(conf)
    out = files.create(spare)
    out.write(bytearray(json.dumps(entry | {"seq": seq}).encode()))
    out.close()
    try:
        never = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        fs.FileContext.getFileContext(files.makeQualified(spare).toUri(), conf).rename(files.makeQualified(spare), files.makeQualified(fs.Path(f"{folder}/{name}")), never)
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        files.delete(spare, False)
        return False


def read_entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The entries of such a log; none if there is no log."""
    try:
        return spark.read.schema(schema).json(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


class Conflict(ValueError):
    """Another writer has done what a commit rests on not being done."""


def property_of(name: str, kind: str = "string") -> Column:
    """One of a node's or an edge's open properties; null where it has none of that name or kind. Only this path is read."""
    return F.try_variant_get("properties", f"$['{name}']", kind)


def _with_properties(rows: DataFrame) -> DataFrame:
    """rows with their open properties as a variant: from a variant, a struct, a map or a JSON text; null if they have none."""
    if "properties" not in rows.columns:
        return rows.withColumn("properties", F.parse_json(F.lit(None).cast("string")))
    kind = rows.schema["properties"].dataType
    if isinstance(kind, VariantType):
        return rows
    return rows.withColumn("properties", F.parse_json("properties") if isinstance(kind, StringType) else F.to_variant_object("properties"))


class GraphStore:
    """Immutable (project, version) snapshots below a root, and a log of what happened to them.

    stage() writes a version to a folder of its own and validates it; what isn't valid leaves nothing behind. promote()
    makes a staged version current, rollback() the one that was current before. prune() deletes all but these two,
    delete() one version, which must not be current. A version number is used once. Nodes lie by kind, edges by type,
    so that filters on them read only those folders. Nodes and edges keep open properties as a variant.

    Any number of writers may share a root: an entry of the log is a file named by its number, put in place by a rename
    that fails if the name is taken. A writer that comes second reads the log again, checks again what its entry rests on,
    and takes the next number or raises Conflict. That holds where the file system's rename without overwriting does
    (HDFS; a local one checks the name and then renames).
    """

    tries = 20

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        return read_entries(self.spark, f"{self.root}/log", LOG)

    def _put(self, seq: int, entry: dict) -> bool:
        return put_entry(self.spark, f"{self.root}/log", seq, entry)

    def _note(self, project: str, version: int, action: str, path: str | None = None, check: Callable[[], None] = lambda: None) -> None:
        """Add an entry; check() raises Conflict if the log as it stands doesn't allow it."""
        for _ in range(self.tries):
            last = self.log().agg(F.max("seq")).first()[0] or 0
            check()
            if self._put(last + 1, {"project_id": project, "graph_version": version, "action": action, "path": path}):
                return
        raise Conflict(f"{self.tries} other writers came first")

    def versions(self, project: str) -> dict[int, str]:
        """The versions that are there, and their folders."""
        there: dict[int, str] = {}
        for r in self.log().where(F.col("project_id") == project).orderBy("seq", "action").collect():
            if r["action"] == "staged":
                there[r["graph_version"]] = r["path"]
            elif r["action"] == "deleted":
                there.pop(r["graph_version"], None)
        return there

    def _promoted(self, project: str) -> list[int]:
        """Versions in the order in which they became current, the last one current; deleted ones are left out."""
        there = self.versions(project)
        order: list[int] = []
        for r in self.log().where((F.col("project_id") == project) & (F.col("action") == "promoted")).orderBy("seq").collect():
            if r["graph_version"] in there:
                order = [v for v in order if v != r["graph_version"]] + [r["graph_version"]]
        return order

    def current(self, project: str) -> int | None:
        return (self._promoted(project) or [None])[-1]

    def _unused(self, project: str, version: int) -> None:
        if self.log().where((F.col("project_id") == project) & (F.col("graph_version") == version)).limit(1).count():
            raise Conflict(f"version {version} of {project} exists")

    def stage(self, project: str, version: int, nodes: DataFrame, edges: DataFrame, expected: tuple[int, int] | None = None) -> dict:
        """Write and validate a version; expected: the counts of nodes and edges that it must have.

        nodes (id, kind, name) and edges (type, src, dst, occurrence_count, edge_id) may have properties: a variant, a
        struct, a map or a JSON text. Edges without a column edge_id have that of functions.ids; such ids aren't written
        but made anew from type and ends where they are read.
        """
        from .operators.graph import validate

        self._unused(project, version)
        path = f"{self.root}/data/{project}-{version}-{uuid.uuid4().hex}"
        # written by the tasks that have them, so that no row moves: a large kind, type or hub is in as many files as it comes in
        _with_properties(nodes).select("id", "kind", "name", "properties").write.partitionBy("kind").parquet(f"{path}/nodes")
        ids = edge_id(F.col("type"), F.col("src"), F.col("dst"))
        own = F.lit(None).cast("string") if "edge_id" not in edges.columns else F.when(F.col("edge_id").eqNullSafe(ids), None).otherwise(F.col("edge_id"))
        derived = F.lit(True) if "edge_id" not in edges.columns else F.col("edge_id").eqNullSafe(ids)
        links = _with_properties(edges).select("type", "src", "dst", F.col("occurrence_count").cast("long").alias("occurrence_count"), own.alias("edge_id"), derived.alias("derived"), "properties")
        links.sortWithinPartitions("type", "src").write.partitionBy("type").parquet(f"{path}/edges")
        found = validate(*self._at(path)).first().asDict()
        if found["repeated_nodes"] or found["dangling_edges"] or (expected and expected != (found["nodes"], found["edges"])):
            remove(self.spark, path)
            raise ValueError(f"snapshot {project}/{version} is not valid: {found}")
        try:
            self._note(project, version, "staged", path, lambda: self._unused(project, version))
        except Conflict:
            remove(self.spark, path)
            raise
        return found

    def _at(self, path: str, properties: bool = False) -> tuple[DataFrame, DataFrame]:
        read = lambda what, schema: self.spark.read.schema(schema).parquet(f"{path}/{what}")
        ids = F.when(F.col("derived"), edge_id(F.col("type"), F.col("src"), F.col("dst"))).otherwise(F.col("edge_id"))
        nodes, edges = read("nodes", NODES).select("id", "kind", "name", "properties"), read("edges", EDGES).select("type", "src", "dst", "occurrence_count", ids.alias("edge_id"), "properties")
        return (nodes, edges) if properties else (nodes.drop("properties"), edges.drop("properties"))

    def snapshot(self, project: str, version: int | None = None, properties: bool = False) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a version, the current one if none is named; with `properties` also these and the envelope (project_id, graph_version)."""
        wanted = self.current(project) if version is None else version
        path = self.versions(project).get(wanted)
        if path is None:
            raise ValueError(f"no version {wanted} of {project}")
        nodes, edges = self._at(path, properties)
        if not properties:
            return nodes, edges
        envelope = {"project_id": F.lit(project), "graph_version": F.lit(wanted).cast("long")}
        return nodes.withColumns(envelope), edges.withColumns(envelope)

    def diagnostics(self, project: str) -> dict:
        """(versions, active, inactive): how many versions are stored, and the nodes of the current one and of all others."""
        counts = {v: self._at(path)[0].count() for v, path in self.versions(project).items()}
        now = self.current(project)
        return {"versions": len(counts), "active": counts.get(now, 0), "inactive": sum(n for v, n in counts.items() if v != now)}

    def promote(self, project: str, version: int, instead_of: int | None = None) -> None:
        """Make a staged version current; with instead_of only if that version is the current one still."""

        def check() -> None:
            if version not in self.versions(project):
                raise Conflict(f"version {version} of {project} isn't staged")
            if instead_of is not None and self.current(project) != instead_of:
                raise Conflict(f"version {instead_of} of {project} isn't current any more")

        self._note(project, version, "promoted", None, check)

    def rollback(self, project: str) -> int:
        """Make the version current that was so before; the failed one stays until it is pruned."""
        order = self._promoted(project)
        if len(order) < 2:
            raise ValueError(f"{project} has no earlier version")

        def check() -> None:
            if self._promoted(project) != order:
                raise Conflict(f"{project} has been changed meanwhile")

        self._note(project, order[-2], "promoted", None, check)
        return order[-2]

    def delete(self, project: str, version: int) -> None:
        if version == self.current(project):
            raise ValueError(f"version {version} of {project} is current")
        path = self.versions(project).get(version)
        if path is not None:

            def check() -> None:
                if version == self.current(project):
                    raise Conflict(f"version {version} of {project} is current")

            self._note(project, version, "deleted", None, check)
            remove(self.spark, path)

    def prune(self, project: str) -> list[int]:
        """Delete all versions but the current and the one before it; returns what went."""
        keep = self._promoted(project)[-2:]
        gone = sorted(v for v in self.versions(project) if v not in keep)
        for v in gone:
            self.delete(project, v)
        return gone

    def delete_project(self, project: str) -> None:
        for v, path in self.versions(project).items():
            self._note(project, v, "deleted")
            remove(self.spark, path)
