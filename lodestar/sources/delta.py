"""Delta tables: the transaction log on the driver, data through Parquet scans.

The log is metadata, whose size goes with commits and files; rows are never
read by the driver. Changes are copy-on-write on the files that may match;
commits are files that must not exist yet, so of two writers one fails.
"""

from __future__ import annotations

import json
import re
import struct
import time
import uuid
import zlib
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import roaring
from .storage import Storage

LOG = "_delta_log"
#: Fixed value: the letters of Z85, in which inline deletion vectors are written.
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
VECTOR_MAGIC = 1681511377


def json_value(text: str | None, kind: T.DataType):
    """A statistic for the log: numbers as numbers, but for those that JSON has no form of."""
    if text is None or text in ("NaN", "Infinity", "-Infinity"):
        return None
    return typed(text, kind) if isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType)) else text


class ConcurrentWrite(RuntimeError):
    """Another writer has made this version."""


#: The names of classic checkpoints and their columns, by the Delta protocol.
CHECKPOINT_NAME = re.compile(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet")
_DV = "deletionVector: struct<storageType:string,pathOrInlineDv:string,offset:int,sizeInBytes:int,cardinality:bigint>"
ACTIONS = {
    "protocol": "minReaderVersion: int, minWriterVersion: int, readerFeatures: array<string>, writerFeatures: array<string>",
    "metaData": "id: string, name: string, description: string, format: struct<provider:string,options:map<string,string>>, schemaString: string, partitionColumns: array<string>, configuration: map<string,string>, createdTime: bigint",
    "add": f"path: string, partitionValues: map<string,string>, size: bigint, modificationTime: bigint, dataChange: boolean, tags: map<string,string>, {_DV}, baseRowId: bigint, defaultRowCommitVersion: bigint, stats: string",
    "remove": f"path: string, deletionTimestamp: bigint, dataChange: boolean, extendedFileMetadata: boolean, partitionValues: map<string,string>, size: bigint, {_DV}",
    "txn": "appId: string, version: bigint, lastUpdated: bigint",
}


@dataclass
class Snapshot:
    version: int
    protocol: dict
    metadata: dict
    files: dict[str, dict] = field(default_factory=dict)
    tombstones: dict[str, dict] = field(default_factory=dict)
    transactions: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.metadata["schemaString"]))

    @property
    def partition_columns(self) -> list[str]:
        return self.metadata.get("partitionColumns", [])


def z85_decode(text: str) -> bytes:
    out = bytearray()
    for at in range(0, len(text), 5):
        n = 0
        for ch in text[at : at + 5]:
            n = n * 85 + Z85.index(ch)
        out += struct.pack(">I", n)
    return bytes(out)


def z85_encode(raw: bytes) -> str:
    raw, out = raw + b"\0" * (-len(raw) % 4), []
    for at in range(0, len(raw), 4):
        n = struct.unpack_from(">I", raw, at)[0]
        out.append("".join(Z85[n // 85**k % 85] for k in (4, 3, 2, 1, 0)))
    return "".join(out)


def _physical(schema: T.StructType) -> dict[str, str]:
    """Logical to physical names, where columns are mapped."""
    return {f.name: (f.metadata or {}).get("delta.columnMapping.physicalName", f.name) for f in schema}


def typed(text, kind: T.DataType):
    """A statistic or partition value, which logs keep as text or as JSON's own, as its column's type."""
    if text is None:
        return None
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.FractionalType):
        return float(text)
    return str(text).lower() == "true" if isinstance(kind, T.BooleanType) else text


class DeltaTable:
    """A table under a path. Files go by their paths in the log, which are URL-encoded and relative."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Storage(spark, path)
        self.root = self.store.path("").toUri().getPath()

    def _relative(self, place: Column) -> Column:
        """A file's place under the root, as it is on disk, of its encoded URL."""
        plain = F.url_decode(F.replace(place, F.lit("+"), F.lit("%2B")))
        return F.substr(plain, F.instr(plain, self.root) + F.lit(len(self.root) + 1))

    # the log

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n, _, _, _ in self.store.list(LOG) if n.endswith(".json") and n[:-5].isdigit()]

    def _actions(self, version: int) -> list[dict]:
        return [json.loads(x) for x in self.store.read(f"{LOG}/{version:020d}.json").decode().splitlines() if x.strip()]

    def history(self) -> list[dict]:
        out = []
        for v in self.versions():
            info = next((a["commitInfo"] for a in self._actions(v) if "commitInfo" in a), {})
            out.append({"version": v, **info})
        return out

    def version_at(self, timestamp_ms: int) -> int:
        before = [h["version"] for h in self.history() if h.get("timestamp", 0) <= timestamp_ms]
        if not before:
            raise ValueError("no version is that old")
        return max(before)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """Replays the newest checkpoint at or before the version, then later commits."""
        have = self.versions()
        marks = self._checkpoints()
        if not have and not marks:
            raise FileNotFoundError(f"no Delta table at {self.path}")
        want = max([*have, *marks]) if version is None else version
        base = max((m for m in marks if m <= want), default=-1)
        actions = self._checkpoint(marks[base]) if base >= 0 else []
        made = Snapshot(want, {}, {})
        self._replay(made, actions)
        for v in range(base + 1, want + 1):
            if v not in have:
                raise FileNotFoundError(f"version {v} is gone or was never made")
            self._replay(made, self._actions(v))
        return made

    @staticmethod
    def _replay(s: Snapshot, actions: list[dict]) -> None:
        for a in actions:
            if "protocol" in a:
                s.protocol = a["protocol"]
            elif "metaData" in a:
                s.metadata = a["metaData"]
            elif "add" in a:
                s.files[a["add"]["path"]] = a["add"]
                s.tombstones.pop(a["add"]["path"], None)
            elif "remove" in a:
                s.files.pop(a["remove"]["path"], None)
                s.tombstones[a["remove"]["path"]] = a["remove"]
            elif "txn" in a:
                s.transactions[a["txn"]["appId"]] = a["txn"]["version"]

    def _checkpoints(self) -> dict[int, list[str]]:
        """The files of each complete classic checkpoint: one file, or all of its numbered parts."""
        found: dict[tuple[int, int], list[str]] = {}
        for name, *_ in self.store.list(LOG):
            if m := CHECKPOINT_NAME.fullmatch(name):
                found.setdefault((int(m[1]), int(m[3] or 1)), []).append(name)
        return {version: sorted(names) for (version, parts), names in sorted(found.items()) if len(names) == parts}

    def _checkpoint(self, names: list[str]):
        """The actions of a checkpoint's files, a struct column each kind."""
        rows = self.spark.read.parquet(*[f"{self.path}/{LOG}/{n}" for n in names])
        kinds = [k for k in ACTIONS if k in rows.columns]
        for r in rows.select(F.to_json(F.struct(*kinds)).alias("action")).toLocalIterator():
            if action := json.loads(r["action"]):
                yield action

    def checkpoint(self) -> int:
        """Writes the live actions as one Parquet file of the format's columns, and the pointer to it."""
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        s = self.snapshot()
        actions = [{"protocol": s.protocol}, {"metaData": s.metadata}, *({"add": f} for f in s.files.values()), *({"remove": f} for f in s.tombstones.values())]
        actions += [{"txn": {"appId": k, "version": v}} for k, v in s.transactions.items()]
        schema = to_arrow_schema(T._parse_datatype_string(", ".join(f"{k} struct<{v}>" for k, v in ACTIONS.items())))
        maps = {(k, f.name) for k in ACTIONS for f in schema.field(k).type if pa.types.is_map(f.type)}

        def row(kind: str, action: dict) -> dict:
            held = {n: list(v.items()) if (kind, n) in maps and v is not None else v for n, v in action.items()}
            if kind == "metaData":
                held["format"] = {**held["format"], "options": list(held["format"].get("options", {}).items())}
            return {kind: held}

        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_pylist([row(*next(iter(a.items()))) for a in actions], schema=schema), sink)
        self.store.write(f"{LOG}/{s.version:020d}.checkpoint.parquet", sink.getvalue().to_pybytes())
        self.store.write(f"{LOG}/_last_checkpoint", json.dumps({"version": s.version, "size": len(actions)}).encode())
        return s.version

    def _commit(self, version: int, operation: str, actions: list[dict]) -> int:
        info = {"commitInfo": {"timestamp": int(time.time() * 1000), "operation": operation, "engineInfo": "lodestar"}}
        body = "\n".join(json.dumps(a) for a in [info, *actions]).encode()
        if not self.store.write_new(f"{LOG}/{version:020d}.json", body):
            raise ConcurrentWrite(f"version {version} exists")
        return version

    # writing

    def create(self, schema: T.StructType, partition_by: tuple[str, ...] = (), config: dict | None = None) -> int:
        meta = {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": schema.json(), "partitionColumns": list(partition_by), "configuration": config or {}, "createdTime": int(time.time() * 1000)}
        return self._commit(0, "CREATE TABLE", [{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7}}, {"metaData": meta}])

    def _write_files(self, df: DataFrame, s: Snapshot) -> list[dict]:
        """Writes rows as new files; each file's size, values of partition columns and statistics become add actions."""
        physical, parts = _physical(s.schema), s.partition_columns
        names = [f.name for f in s.schema]
        for f in s.schema:  # generated columns
            expr = (f.metadata or {}).get("delta.generationExpression")
            if expr and f.name not in df.columns:
                df = df.withColumn(f.name, F.expr(expr).cast(f.dataType))
        rows = df.select(*[F.col(n).cast(s.schema[n].dataType).alias(physical[n]) for n in names])
        folder = f"data-{uuid.uuid4().hex}"
        writer = rows.write.mode("error")
        if parts:
            writer = writer.partitionBy(*[physical[p] for p in parts])
        writer.parquet(f"{self.path}/{folder}")
        data = [n for n in names if n not in parts]
        back = self.spark.read.schema(T.StructType([T.StructField(physical[n], s.schema[n].dataType) for n in data])).parquet(f"{self.path}/{folder}")
        flat = [n for n in data if isinstance(s.schema[n].dataType, (T.NumericType, T.StringType, T.DateType, T.BooleanType))]
        sums = [F.count("*").alias("n")]
        for i, n in enumerate(flat):
            c = F.col(f"`{physical[n]}`")
            sums += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"), F.count_if(c.isNull()).alias(f"nu{i}")]
        found = back.groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).agg(*sums).collect()  # a row a file
        adds = []
        for r in found:
            relative = unquote(r["f"])[unquote(r["f"]).index(folder) :]  # on disk
            values = {}
            for piece in relative.split("/")[1:-1]:
                k, _, v = piece.partition("=")
                values[k] = None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)
            stats = {"numRecords": r["n"], "minValues": {physical[n]: json_value(r[f"lo{i}"], s.schema[n].dataType) for i, n in enumerate(flat)}, "maxValues": {physical[n]: json_value(r[f"hi{i}"], s.schema[n].dataType) for i, n in enumerate(flat)}, "nullCount": {physical[n]: r[f"nu{i}"] for i, n in enumerate(flat)}}
            adds.append({"path": quote(relative, safe="/=-_.~"), "partitionValues": values, "size": r["b"], "modificationTime": int(time.time() * 1000), "dataChange": True, "stats": json.dumps(stats)})
        return adds

    def append(self, df: DataFrame, base: int | None = None) -> int:
        s = self.snapshot(base)
        return self._commit(s.version + 1, "WRITE", [{"add": a} for a in self._write_files(df, s)])

    def overwrite(self, df: DataFrame) -> int:
        s = self.snapshot()
        return self._commit(s.version + 1, "WRITE", [*self._removed(s.files), *({"add": a} for a in self._write_files(df, s))])

    @staticmethod
    def _removed(files) -> list[dict]:
        now = int(time.time() * 1000)
        return [{"remove": {"path": p, "deletionTimestamp": now, "dataChange": True}} for p in files]

    # reading

    def _positions(self, add: dict) -> list[int]:
        d = add.get("deletionVector")
        if not d:
            return []
        if d["storageType"] == "i":
            raw = z85_decode(d["pathOrInlineDv"])[: d["sizeInBytes"]]
        elif d["storageType"] == "p":
            whole = self.store.read(d["pathOrInlineDv"])
            at = d.get("offset", 1)
            size = struct.unpack_from(">I", whole, at)[0]
            raw = whole[at + 4 : at + 4 + size]
            if zlib.crc32(raw) != struct.unpack_from(">I", whole, at + 4 + size)[0]:
                raise ValueError("damaged deletion vector")
        else:
            raise ValueError(f"deletion vectors of type {d['storageType']} are not read")
        if struct.unpack_from("<I", raw)[0] != VECTOR_MAGIC:
            raise ValueError("not a deletion vector")
        return roaring.read64(raw[4:]).tolist()

    def pruned(self, s: Snapshot, conditions: list[tuple[str, str, object]]) -> dict[str, dict]:
        """The files that may hold rows with all (column, op, value); by partition values and statistics, compared as the column's type."""
        physical, out = _physical(s.schema), {}
        for path, add in s.files.items():
            stats, ok = json.loads(add.get("stats") or "{}"), True
            for name, op, value in conditions:
                kind, p = s.schema[name].dataType, physical[name]
                if p in add["partitionValues"]:
                    low = high = typed(add["partitionValues"][p], kind)
                    ok &= low is not None
                else:
                    low, high = (typed(stats.get(k, {}).get(p), kind) for k in ("minValues", "maxValues"))
                if low is None or high is None or not ok:
                    continue
                ok &= {"=": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value, "!=": not low == high == value}[op]
            if ok:
                out[path] = add
        return out

    def read(self, version: int | None = None, timestamp_ms: int | None = None, conditions: list[tuple[str, str, object]] = ()) -> DataFrame:
        """Rows of a version; conditions prune files and filter rows."""
        s = self.snapshot(self.version_at(timestamp_ms) if timestamp_ms is not None else version)
        rows = self._rows(s, self.pruned(s, list(conditions)))
        for name, op, value in conditions:
            c = F.col(name)
            rows = rows.filter({"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "!=": c != value}[op])
        return rows.select(*[f.name for f in s.schema])

    def _rows(self, s: Snapshot, files: dict[str, dict]) -> DataFrame:
        """Rows of some files, with _file and _row."""
        physical, parts = _physical(s.schema), s.partition_columns
        if not files:
            return self.spark.createDataFrame([], s.schema).withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("bigint")})
        data = T.StructType([T.StructField(physical[f.name], f.dataType) for f in s.schema if f.name not in parts])
        rows = self.spark.read.schema(data).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{unquote(p)}" for p in files])
        rows = rows.withColumns({"_file": self._relative(F.col("_metadata.file_path")), "_row": F.col("_metadata.row_index")})
        if parts:
            table = self.spark.createDataFrame([(unquote(p), *[a["partitionValues"].get(physical[c]) for c in parts]) for p, a in files.items()], "_path string, " + ", ".join(f"`_p{i}` string" for i in range(len(parts))))
            rows = rows.drop(*[physical[p] for p in parts]).join(table, F.col("_file") == F.col("_path"))  # a row a file
            rows = rows.withColumns({physical[p]: F.col(f"_p{i}").cast(s.schema[p].dataType) for i, p in enumerate(parts)})
        gone = [(unquote(p), i) for p, a in files.items() for i in self._positions(a)]
        if gone:
            dead = self.spark.createDataFrame(gone, "_path2 string, _at bigint")
            rows = rows.join(dead, (F.col("_file") == F.col("_path2")) & (F.col("_row") == F.col("_at")), "left_anti")
        return rows.select(*[F.col(f"`{physical[f.name]}`").alias(f.name) for f in s.schema], "_file", "_row")

    # changes

    def _touched(self, s: Snapshot, where: Column) -> dict[str, dict]:
        hit = self._rows(s, s.files).filter(where).select("_file").distinct()
        named = {unquote(p): p for p in s.files}
        return {named[r[0]]: s.files[named[r[0]]] for r in hit.collect()}  # a row a file

    def _rewrite(self, s: Snapshot, operation: str, files: dict, rows: DataFrame) -> int:
        adds = self._write_files(rows.select(*[f.name for f in s.schema]), s)
        return self._commit(s.version + 1, operation, [*self._removed(files), *({"add": a} for a in adds)])

    def delete(self, where: Column) -> int:
        s = self.snapshot()
        files = self._touched(s, where)
        return self._rewrite(s, "DELETE", files, self._rows(s, files).filter(~F.coalesce(where, F.lit(False)))) if files else s.version

    def delete_by_vector(self, where: Column) -> int:
        """Deletes rows by marking their places in deletion vectors, without writing data."""
        s = self.snapshot()
        named = {unquote(p): p for p in s.files}
        hit = self._rows(s, s.files).filter(where).groupBy("_file").agg(F.sort_array(F.collect_list("_row")).alias("at"))
        actions = []
        for r in hit.toLocalIterator():  # the places become metadata
            add = dict(s.files[named[r["_file"]]])
            raw = struct.pack("<I", VECTOR_MAGIC) + roaring.write64(sorted({*self._positions(add), *r["at"]}))
            add["deletionVector"] = {"storageType": "i", "pathOrInlineDv": z85_encode(raw), "sizeInBytes": len(raw), "cardinality": len(r["at"])}
            actions += [*self._removed([add["path"]]), {"add": add}]
        return self._commit(s.version + 1, "DELETE", actions) if actions else s.version

    def update(self, where: Column, values: dict[str, Column]) -> int:
        s = self.snapshot()
        files = self._touched(s, where)
        if not files:
            return s.version
        hit = F.coalesce(where, F.lit(False))
        rows = self._rows(s, files)
        rows = rows.select(*[(F.when(hit, values[f.name]).otherwise(F.col(f.name)) if f.name in values else F.col(f.name)).alias(f.name) for f in s.schema])
        return self._rewrite(s, "UPDATE", files, rows)

    def merge(self, source: DataFrame, key: str, update: bool = True, insert: bool = True, delete: Column | None = None, match: Column | None = None) -> int:
        """Upserts rows by a key that the source doesn't repeat; predicates on source rows: `delete`, whose matches go, and
        `match`, which may match at all (the others are new whatever their key, and may repeat one)."""
        s = self.snapshot()
        names = [f.name for f in s.schema]
        src = source.select(*[F.col(n).alias(f"_s_{n}") for n in names], (delete if delete is not None else F.lit(False)).alias("_gone"), (match if match is not None else F.lit(True)).alias("_may"))
        same = (F.col(key) == F.col(f"_s_{key}")) & F.col("_may")
        everything = self._rows(s, s.files)
        named = {unquote(p): p for p in s.files}
        files = {named[r[0]]: s.files[named[r[0]]] for r in everything.join(src, same, "left_semi").select("_file").distinct().collect()}
        old = self._rows(s, files).withColumn("_old", F.lit(True))
        both = old.join(src.withColumn("_new", F.lit(True)), same, "full")
        both = both.filter(~(F.coalesce("_old", F.lit(False)) & F.coalesce("_gone", F.lit(False))))
        matched = F.col("_old").isNotNull() & F.col("_new").isNotNull()
        fresh = F.col("_old").isNull()
        if not insert:
            both = both.filter(~fresh)
        else:
            both = both.filter(~(fresh & F.coalesce("_gone", F.lit(False))))
        take = fresh | (matched if update else F.lit(False))
        return self._rewrite(s, "MERGE", files, both.select(*[F.when(take, F.col(f"_s_{n}")).otherwise(F.col(n)).alias(n) for n in names]))

    def restore(self, version: int) -> int:
        """Makes an old version's files the live ones again, with all that was known of them."""
        now, then = self.snapshot(), self.snapshot(version)
        back = [{"add": a} for p, a in then.files.items() if p not in now.files or now.files[p] != a]
        return self._commit(now.version + 1, "RESTORE", [*self._removed(p for p in now.files if p not in then.files), *back, {"metaData": then.metadata}])

    def optimize(self, files: int = 1, order_by: tuple[str, ...] = (), zorder: tuple[str, ...] = ()) -> int:
        """Rewrites the live files as a few, by ranges of columns or of their interleaved ranks."""
        s = self.snapshot()
        rows = self._rows(s, s.files)
        if zorder:
            rows = rows.repartitionByRange(files, z_value([F.col(c) for c in zorder]))
        else:
            rows = rows.repartitionByRange(files, *order_by) if order_by else rows.repartition(files)
        adds = self._write_files(rows.select(*[f.name for f in s.schema]), s)
        quiet = [{"remove": r["remove"] | {"dataChange": False}} for r in self._removed(s.files)]
        return self._commit(s.version + 1, "OPTIMIZE", [*quiet, *({"add": a | {"dataChange": False}} for a in adds)])

    def vacuum(self, retain_ms: int = 7 * 86_400_000, dry_run: bool = False) -> list[str]:
        """Deletes data files that no live file list names and that are older than the retention; lists them."""
        s, limit, gone = self.snapshot(), int(time.time() * 1000) - retain_ms, []
        live = {unquote(p) for p in s.files}

        def walk(folder: str) -> None:
            for name, _, modified, is_folder in self.store.list(folder):
                at = f"{folder}/{name}" if folder else name
                if name.startswith("_"):
                    continue
                if is_folder:
                    walk(at)
                elif at not in live and modified <= limit and name.endswith(".parquet"):
                    gone.append(at)

        walk("")
        for at in [] if dry_run else gone:
            self.store.delete(at)
        return gone

    def changes(self, first: int, last: int) -> DataFrame:
        """Rows that versions first..last added or removed, with _change_type and _commit_version."""
        out = None
        for v in range(first, last + 1):
            before, now = (self.snapshot(v - 1) if v else None), self.snapshot(v)
            actions = [a for a in self._actions(v) if ("add" in a or "remove" in a)]
            added = {a["add"]["path"]: a["add"] for a in actions if "add" in a and a["add"]["dataChange"]}
            removed = {a["remove"]["path"]: before.files[a["remove"]["path"]] for a in actions if "remove" in a and a["remove"]["dataChange"] and before and a["remove"]["path"] in before.files}
            names = [f.name for f in now.schema]
            new, old = self._rows(now, added).select(*names), self._rows(before or now, removed).select(*names)
            made = new.exceptAll(old).withColumn("_change_type", F.lit("insert")).unionAll(old.exceptAll(new).withColumn("_change_type", F.lit("delete"))).withColumn("_commit_version", F.lit(v))
            out = made if out is None else out.unionAll(made)
        return out


def z_value(columns: list[Column], bits: int = 16) -> Column:
    """Interleaves the low bits of whole-number columns."""
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        for i, c in enumerate(columns):
            bit = F.call_function("shiftrightunsigned", c.cast("bigint"), F.lit(b)).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.call_function("shiftleft", bit.cast("bigint"), F.lit(b * len(columns) + i)))
    return out


