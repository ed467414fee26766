"""The statement store: graphs, staged changes, policies and justifications in immutable table files.

``catalog.json`` names the files of every graph; a change writes new files and then renames a new catalogue into
place, so readers keep the version they opened and a lost executor leaves the old version whole.  Only the
graphs that a change touches are written again.  A ``lock`` file, made only if there is none, keeps writers of other drivers
out for the length of a transaction, or of a store opened as ``exclusive``; a catalogue that another driver has changed in
between refuses the change until ``refresh``.  Blank nodes of imports are renamed; those of removals are kept, so
that they can match.
"""

from __future__ import annotations

import getpass
import json
import os
import socket
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import rdf
from .edits import STATEMENT, Edit, applied
from .minting import MintRefused, Pattern

FORMAT = 5
KINDS = ("vocabulary", "system", "inferred", "candidate")
WRITABLE = ("vocabulary",)
SOURCES = ("human", "import", "machine", "rule")
COLUMNS = ("g", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt")
SYSTEM = "urn:conceptmill:system"


class StoreRefused(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _migrate_1(c: dict) -> None:
    c.setdefault("candidates", [])


def _migrate_2(c: dict) -> None:
    for x in c["candidates"]:
        x.setdefault("confidence", None)


def _migrate_3(c: dict) -> None:
    c.setdefault("policies", {})


def _migrate_4(c: dict) -> None:
    c.setdefault("justifications", [])


#: step from a format to the next
MIGRATIONS = {1: _migrate_1, 2: _migrate_2, 3: _migrate_3, 4: _migrate_4}


def migrate(catalog: dict) -> dict:
    at = catalog.get("format")
    if not isinstance(at, int):
        raise StoreRefused("Corrupt", "no format stamp")
    if at > FORMAT:
        raise StoreRefused("FormatTooNew", str(at))
    while at < FORMAT:
        if at not in MIGRATIONS:
            raise StoreRefused("NoMigrationPath", str(at))
        MIGRATIONS[at](catalog)
        at += 1
        catalog["format"] = at
        catalog.setdefault("history", []).append({"to": at, "at": now()})
    return catalog


def _first_line(e: Exception) -> str:
    return str(e).strip().split("\n")[0]


def _no_statement() -> Column:
    """Rows that are no RDF: a part is missing, a literal stands for a subject or predicate, or a kind is unknown."""
    parts = F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull()
    kinds = ~F.coalesce(F.col("s_kind").isin("iri", "bnode") & F.col("o_kind").isin("iri", "bnode", "literal"), F.lit(False))
    return parts | kinds | F.col("p").startswith("_:") | F.col("p").contains(" ")


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def parse_stamp(text: str) -> datetime:
    """A time of the audit trail; one without a zone is refused."""
    t = datetime.fromisoformat(text)
    if t.tzinfo is None:
        raise StoreRefused("NoTimeZone", text)
    return t


class Store:
    def __init__(self, spark: SparkSession, folder: str, exclusive: bool = False):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._busy = self._mine = False
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.mkdirs(self._path(self.folder)):
            raise StoreRefused("CreateDir", self.folder)
        if exclusive:
            self._lock()
        try:
            self._open()
        except BaseException:
            self.close()
            raise

    def _open(self) -> None:
        text = self._read("catalog.json")
        self.catalog: dict = {"format": FORMAT, "graphs": {}, "candidates": [], "policies": {}, "justifications": [], "history": []}
        if text is None:
            with self._locked():
                self._commit()
            return
        try:
            self.catalog = json.loads(text)
        except ValueError as e:
            raise StoreRefused("Open", f"{self.folder}: {e}") from None
        was = self.catalog.get("format")
        migrate(self.catalog)
        self._check_registry()
        if was != FORMAT:
            with self._locked():
                self._commit()

    def _check_registry(self) -> None:
        """Every graph has a known kind and its files are there."""
        for g, x in self.catalog.get("graphs", {}).items():
            if x.get("kind") not in KINDS:
                raise StoreRefused("Corrupt", f"{g} is of the unknown kind {x.get('kind')}")
            if x.get("path") is not None and not self._fs.exists(self._path(x["path"])):
                raise StoreRefused("Corrupt", f"the files of {g} are missing")

    def refresh(self) -> "Store":
        """Read the catalogue again, as another driver may have left it."""
        self._open()
        return self

    # -- lock ------------------------------------------------------------------------------------------

    def _lock(self) -> None:
        at = self._path(f"{self.folder}/lock")
        try:
            out = self._fs.create(at, False)
        except Exception:
            if not self._fs.exists(at):
                raise
            raise StoreRefused("AlreadyInUse", f"{self.folder}, by {self._read('lock')}") from None
        out.write(bytearray(f"{getpass.getuser()} on {socket.gethostname()}, process {os.getpid()}, since {now()}".encode()))
        out.close()
        self._mine = True

    def close(self) -> None:
        """Give an exclusive store free."""
        if self._mine:
            self._fs.delete(self._path(f"{self.folder}/lock"), False)
            self._mine = False

    @staticmethod
    def unlock(spark: SparkSession, folder: str) -> None:
        """Take the lock away that a lost driver left behind."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/lock")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)

    @contextmanager
    def _locked(self):
        held = self._mine
        if not held:
            self._lock()
        try:
            yield
        finally:
            if not held:
                self.close()

    # -- files -----------------------------------------------------------------------------------------

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self) -> None:
        """A new catalogue beside the old one, renamed over it."""
        self.catalog["revision"] = uuid.uuid4().hex
        new = self._path(f"{self.folder}/catalog-{uuid.uuid4().hex}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(self.catalog).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path(f"{self.folder}/catalog.json")), options)

    @contextmanager
    def transaction(self):
        """One writer; an error brings the catalogue back, and files written in between are never named."""
        if self._busy:
            raise StoreRefused("NestedTransaction")
        self._busy, before = True, json.dumps(self.catalog)
        try:
            with self._locked():
                there = json.loads(self._read("catalog.json") or "{}")
                if there.get("revision") != self.catalog.get("revision"):
                    raise StoreRefused("ChangedElsewhere", self.folder)
                yield self
                self._commit()
        except BaseException:
            self.catalog = json.loads(before)
            raise
        finally:
            self._busy = False

    def _put(self, df: DataFrame) -> str:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.select(*COLUMNS).dropDuplicates().write.parquet(path)
        return path

    def _get(self, path: str | None) -> DataFrame:
        return self.spark.createDataFrame([], rdf.SCHEMA) if path is None else self.spark.read.schema(rdf.SCHEMA).parquet(path)

    # -- graphs ----------------------------------------------------------------------------------------

    def graphs(self) -> DataFrame:
        return self.spark.createDataFrame(sorted((g, x["kind"]) for g, x in self.catalog["graphs"].items()), "g string, kind string")

    def exists(self, g: str) -> bool:
        return g in self.catalog["graphs"]

    def create_graph(self, g: str, kind: str = "vocabulary") -> None:
        if kind not in KINDS or kind not in WRITABLE:
            raise StoreRefused("NotWritable", kind)
        if self.exists(g):
            raise StoreRefused("GraphExists", g)
        with self.transaction():
            self.catalog["graphs"][g] = {"kind": kind, "path": None}

    def scan(self, g: str) -> DataFrame:
        """All statements of a registered graph; an empty graph has none."""
        if not self.exists(g):
            raise StoreRefused("NoSuchGraph", g)
        return self._get(self.catalog["graphs"][g]["path"])

    def quads(self, *kinds: str) -> DataFrame:
        paths = [x["path"] for x in self.catalog["graphs"].values() if x["path"] and (not kinds or x["kind"] in kinds)]
        return self.spark.read.schema(rdf.SCHEMA).parquet(*paths) if paths else self._get(None)

    def load(self, g: str, statements: DataFrame, kind: str = "vocabulary") -> None:
        """Set a graph's statements without review; for building a store from tables."""
        with self.transaction():
            self.catalog["graphs"][g] = {"kind": kind, "path": self._put(statements.withColumn("g", F.lit(g)))}

    def export(self, g: str, path: str, syntax: str) -> None:
        whole = self.scan(g)
        try:
            rdf.write(whole, path, syntax)
        except AnalysisException as e:
            raise StoreRefused("Export", f"{path}: {_first_line(e)}") from e

    @contextmanager
    def _reading(self, what: str, path: str):
        """Files that are not there, and text that is no RDF, are refused by name."""
        try:
            yield
        except AnalysisException as e:
            raise StoreRefused(f"{what}Read", f"{path}: {_first_line(e)}") from e
        except (PySparkException, Py4JError, rdf.SyntaxRefused) as e:
            text = str(e)
            for mark in ("SyntaxRefused: ", "malformed line: "):
                if mark in text:
                    raise StoreRefused(f"{what}Syntax", f"{path}: {text[text.index(mark) + len(mark) :].splitlines()[0]}") from e
            raise

    # -- staged changes ----------------------------------------------------------------------------------

    def _stage(self, g: str, additions: DataFrame | None, removals: DataFrame | None, source: str, agent: str, note: str | None, confidence: float | None) -> int:
        if source not in SOURCES or not agent or not agent.strip():
            raise StoreRefused("CandidateProvenance", f"{source}, {agent}")
        if confidence is not None and not 0 <= confidence <= 1:
            raise StoreRefused("CandidateProvenance", str(confidence))
        if not self.exists(g):
            raise StoreRefused("NoSuchGraph", g)
        if self.catalog["graphs"][g]["kind"] != "vocabulary":
            raise StoreRefused("CandidateTargetNotVocabulary", g)
        for half in (additions, removals):
            if half is not None and not half.filter(F.col("g") != g).isEmpty():
                raise StoreRefused("ImportGraphMismatch", g)
            if half is not None and not half.filter(_no_statement()).isEmpty():
                raise StoreRefused("CandidateStatementInvalid", g)
        with self.transaction():
            id_ = max((c["id"] for c in self.catalog["candidates"]), default=0) + 1
            record = {"id": id_, "target": g, "source": source, "agent": agent, "note": note, "confidence": confidence, "state": "proposed", "proposed_at": now(), "decided_by": None, "decided_at": None}
            for name, half in (("additions", additions), ("removals", removals)):
                path = None if half is None else self._put(half.withColumn("g", F.lit(f"urn:conceptmill:candidate/{id_}/{name}")))
                n = 0 if path is None else self._get(path).count()
                record |= {name: n, f"{name}_path": path if n else None}
                if n:
                    self.catalog["graphs"][f"urn:conceptmill:candidate/{id_}/{name}"] = {"kind": "candidate", "path": path}
            if not record["additions"] and not record["removals"]:
                raise StoreRefused("ImportEmpty", g)
            if record["removals"]:
                self._all_there(g, self._get(record["removals_path"]).withColumn("g", F.lit(g)), "RetractionNotPresent")
            self.catalog["candidates"].append(record)
        return id_

    def _all_there(self, g: str, removals: DataFrame, code: str) -> None:
        have = self.scan(g)
        missing = removals.join(have, [removals[c].eqNullSafe(have[c]) for c in STATEMENT], "left_anti").limit(1).collect()
        if missing:
            raise StoreRefused(code, " ".join(missing[0][c] or "" for c in ("s", "p", "o")))

    def propose_import(self, g: str, path: str, syntax: str, source: str = "import", agent: str = "import", note: str | None = None, confidence: float | None = None) -> int:
        prefix = uuid.uuid4().hex[:8]
        named = lambda c, k: F.when(F.col(k) == "bnode", F.concat(F.lit(f"_:{prefix}"), F.regexp_replace(F.col(c), "^_:", ""))).otherwise(F.col(c))
        with self._reading("Import", path):
            got = rdf.read(self.spark, path, syntax, g)
            return self._stage(g, got.withColumn("s", named("s", "s_kind")).withColumn("o", named("o", "o_kind")), None, source, agent, note, confidence)

    def propose_retraction(self, g: str, path: str, syntax: str, source: str = "human", agent: str = "editor", note: str | None = None) -> int:
        with self._reading("Import", path):
            return self._stage(g, None, rdf.read(self.spark, path, syntax, g), source, agent, note, None)

    def propose_statements(self, g: str, statements: DataFrame, source: str = "import", agent: str = "import", note: str | None = None) -> int:
        """Additions that are statements already; blank nodes keep their names."""
        return self._stage(g, statements, None, source, agent, note, None)

    def propose_edit(self, g: str, edit: Edit, source: str = "human", agent: str = "editor", note: str | None = None) -> int:
        kind = F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri").alias("s_kind")
        whole = lambda df: df.select("*", kind) if "s_kind" not in df.columns else df
        try:
            return self._stage(g, whole(edit.additions), whole(edit.removals), source, agent, note, None)
        except StoreRefused as e:
            if e.code == "ImportEmpty":
                raise StoreRefused("CandidateEmpty", g) from None
            raise

    def candidates(self) -> DataFrame:
        keep = ("id", "target", "additions", "removals", "source", "agent", "note", "confidence", "state", "proposed_at", "decided_by", "decided_at")
        rows = [tuple(c[k] for k in keep) for c in self.catalog["candidates"]]
        return self.spark.createDataFrame(rows, "id long, target string, additions long, removals long, source string, agent string, note string, confidence double, state string, proposed_at string, decided_by string, decided_at string")

    def candidate(self, id_: int) -> dict:
        for c in self.catalog["candidates"]:
            if c["id"] == id_:
                return c
        raise StoreRefused("NoSuchCandidate", str(id_))

    def staged(self, id_: int) -> tuple[DataFrame, DataFrame]:
        """Additions and removals, as statements of the target."""
        c = self.candidate(id_)
        of = lambda half: self._get(c[half]).withColumn("g", F.lit(c["target"]))
        return of("additions_path"), of("removals_path")

    def decide(self, id_: int, approve: bool, by: str) -> None:
        """Once only.  An approval checks that every removal is still there, takes them out and puts the additions in."""
        c = self.candidate(id_)
        if c["state"] != "proposed":
            raise StoreRefused("CandidateDecided", c["state"])
        if not by or not by.strip():
            raise StoreRefused("CandidateProvenance", "no reviewer")
        with self.transaction():
            c = self.candidate(id_)
            if approve:
                additions, removals = self.staged(id_)
                self._all_there(c["target"], removals, "CandidateStale")
                out = applied(self.scan(c["target"]), additions, removals)
                out = out.withColumn("s_kind", F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri"))
                self.catalog["graphs"][c["target"]]["path"] = self._put(out)
            c |= {"state": "approved" if approve else "rejected", "decided_by": by, "decided_at": now()}

    # -- policies and justifications -----------------------------------------------------------------------

    def policy(self, g: str) -> str | None:
        return self.catalog["policies"].get(g)

    def record_policy(self, g: str, pattern: str) -> None:
        if not self.exists(g) or self.catalog["graphs"][g]["kind"] != "vocabulary":
            raise StoreRefused("PolicyRejected", g)
        try:
            Pattern.parse(pattern)
        except MintRefused as e:
            raise StoreRefused("PolicyRejected", str(e)) from e
        with self.transaction():
            self.catalog["policies"][g] = pattern

    def justify(self, records: list[dict]) -> list[int]:
        """Reasons for creations despite matches, all or none: target, created, because, considered and, if staged, candidate."""
        for r in records:
            if not str(r.get("because") or "").strip() or not r.get("considered") or not self.exists(r.get("target", "")):
                raise StoreRefused("JustificationRejected", str(r.get("created")))
        with self.transaction():
            first = max((j["id"] for j in self.catalog["justifications"]), default=0) + 1
            new = [{"id": first + i, "candidate": None, **r, "considered": sorted(set(r["considered"])), "at": now()} for i, r in enumerate(records)]
            self.catalog["justifications"].extend(new)
        return [j["id"] for j in new]

    def justifications(self, g: str | None = None) -> DataFrame:
        """With the fate of the change each belongs to."""
        rows = [(j["id"], j["target"], j["created"], j["because"], j["considered"], j["candidate"], j["at"]) for j in self.catalog["justifications"] if g in (None, j["target"])]
        out = self.spark.createDataFrame(rows, "id long, target string, created string, because string, considered array<string>, candidate long, at string")
        return out.join(self.candidates().select(F.col("id").alias("candidate"), F.col("state").alias("fate")), "candidate", "left")

    # -- backup ----------------------------------------------------------------------------------------------

    def backup(self, path: str) -> None:
        """The whole store as N-Quads; its records are statements of the system graph.  An existing path is refused."""
        record = self.spark.createDataFrame([(SYSTEM, "urn:conceptmill:store", "iri", "urn:conceptmill:catalog", json.dumps(self.catalog), "literal", None, "xsd:string")], rdf.SCHEMA)
        rdf.write(self.quads().select(*COLUMNS).unionByName(record), path, "nquads")

    def restore(self, path: str) -> None:
        """Into an empty store only, all or nothing."""
        if self.catalog["graphs"] or self.catalog["candidates"]:
            raise StoreRefused("RestoreNotEmpty")
        with self._reading("Restore", path):
            all_ = rdf.read(self.spark, path, "nquads")
            record = all_.filter((F.col("g") == SYSTEM) & (F.col("p") == "urn:conceptmill:catalog")).select("o").limit(2).collect()
        if len(record) != 1:
            raise StoreRefused("NotABackup", path)
        saved = json.loads(record[0][0])
        if saved.get("format", 0) > FORMAT:
            raise StoreRefused("RestoreFormatTooNew", str(saved["format"]))
        try:
            migrate(saved)
        except StoreRefused as e:
            raise StoreRefused("RestoreNoMigrationPath" if e.code == "NoMigrationPath" else "NotABackup", str(e)) from e
        known = [g for g, x in saved["graphs"].items()]
        stray = all_.filter(~F.col("g").isin([SYSTEM, *known])).select("g").limit(1).collect()
        if stray:
            raise StoreRefused("RestoreRefused", stray[0][0])
        with self.transaction():
            base = f"{self.folder}/data/{uuid.uuid4().hex}"
            all_.filter(F.col("g") != SYSTEM).withColumn("part", F.col("g")).write.partitionBy("part").parquet(base)
            moved = {}
            for g, x in saved["graphs"].items():
                old, x["path"] = x["path"], None
                if old:
                    x["path"] = moved[old] = self._put(self.spark.read.parquet(base).filter(F.col("part") == g))
            for c in saved["candidates"]:
                for half in ("additions_path", "removals_path"):
                    c[half] = moved.get(c[half])
            self.catalog = saved
