"""A versioned snapshot store, run locks and the progress of a copy, through Hadoop's file system interface.

Parquet files can't be changed in place, so a table is what its manifest entry lists:

    <root>/v=<n>/<table>/       a version: whole rows (base), or the changes of a batch, one state for each key (delta)
    <root>/pages/<table>/p=<n>  rows that a copy brought, a folder for each page
    <root>/manifest.json        {"version", "max_lsn", "batch_id", "tables": {table: entry}, ...}

What is written is in proportion to what changed: a page adds a folder, a batch of changes adds a delta. Deltas of like
size are merged, so a change is rewritten a logarithmic number of times, and once they come to a quarter of the rows they
are folded into a new base. Reading merges base, pages and deltas by key; where nothing is pending it is a plain scan.

The manifest is replaced by a rename after all files are there: readers see one version of all tables, and a writer that
dies leaves the old one in place. A batch whose position isn't beyond the manifest's is a replay and is skipped. A store
has one writing process (see RunLock), whose threads take turns.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import SetupError, TableNotFound
from ..operators import changelog as C


class Files:
    """Small files and folders on any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str, overwrite: bool) -> bool:
        """Whether the file was made; without ``overwrite`` an existing one stays."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, overwrite)
        except Exception:
            if overwrite or not fs.exists(p):
                raise
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        self.create(f"{path}.new", text, True)
        fs, old = self._at(path)
        new = self.jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        if not fs.rename(new, old):  # some file systems don't rename onto a file
            fs.delete(old, False)
            fs.rename(new, old)

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing, if it isn't there."""
        fs, p = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.turn = threading.RLock()

    def manifest(self) -> dict:
        for name in ("manifest.json", "manifest.json.new"):
            if self.files.exists(f"{self.root}/{name}"):
                return json.loads(self.files.read(f"{self.root}/{name}"))
        return {"version": 0, "max_lsn": -1, "batch_id": -1, "tables": {}}

    def _entry(self, table: str) -> dict:
        found = self.manifest()["tables"].get(table)
        if found is None:
            raise TableNotFound(table)
        return found

    def _at(self, version: int, table: str) -> str:
        return f"{self.root}/v={version}/{table}"

    def _deltas(self, table: str, entry: dict, versions: list[int]) -> DataFrame:
        found = self.spark.read.parquet(*[self._at(v, table) for v in versions])
        return found if len(versions) == 1 else C.merged(found, entry["key"], [c for c in found.columns if c not in (*entry["key"], "gone", "full")])

    def _pages(self, table: str, entry: dict) -> DataFrame | None:
        """Pages that the manifest counts; what a dead writer left behind has a later number."""
        if not entry.get("pages"):
            return None
        return self.spark.read.parquet(f"{self.root}/pages/{table}").where(f"p <= {entry['pages']}").drop("p")

    def read(self, table: str) -> DataFrame:
        """The rows of a table. Only keys that pending changes touch are merged; the others pass by."""
        entry = self._entry(table)
        base = self.spark.read.parquet(self._at(entry["base"], table)) if entry.get("base") else None
        pages = self._pages(table, entry)
        if not entry.get("deltas"):
            if base is None or pages is None:
                return base if base is not None else pages
            return base.unionByName(pages.join(base.select(*entry["key"]), entry["key"], "left_anti").select(*base.columns))
        key = entry["key"]
        delta = self._deltas(table, entry, [v for v, _ in entry["deltas"]])
        columns = [c for c in delta.columns if c not in (*key, "gone", "full")]
        order = entry.get("columns") or [*key, *columns]
        touched, here = delta.select(*key), None
        for rows, at in ((base, C.BASE), (pages, C.COPIED)):
            if rows is not None:
                if here is not None:
                    rows = rows.join(here.select(*key), key, "left_anti")
                delta = delta.unionByName(C.row_states(rows.join(touched, key, "left_semi"), key, columns, at))
                here = rows.select(*order) if here is None else here.unionByName(rows.select(*order))
        changed = C.living(C.merged(delta, key, columns), key, columns, order)
        return changed if here is None else here.join(touched, key, "left_anti").select(*order).unionByName(changed)

    def _write(self, df: DataFrame, version: int, table: str) -> int:
        """Rows written."""
        df.write.mode("overwrite").parquet(self._at(version, table))
        return self.spark.read.parquet(self._at(version, table)).count()  # of the files' footers

    def _commit(self, old: dict, tables: dict[str, dict], version: int, max_lsn: int = -1, batch_id: int = -1, **more) -> dict:
        new = old | more | {"version": version, "max_lsn": max(max_lsn, old["max_lsn"]), "batch_id": max(batch_id, old["batch_id"]), "tables": old["tables"] | tables}
        self.files.replace(f"{self.root}/manifest.json", json.dumps(new))
        return new

    def publish(self, tables: dict[str, DataFrame], max_lsn: int = -1, batch_id: int = -1, key: dict[str, list[str]] | None = None) -> dict:
        """Write whole tables anew and make them current in one step."""
        with self.turn:
            old = self.manifest()
            version, entries = old["version"] + 1, {}
            for name, df in tables.items():
                known = old["tables"].get(name, {})
                entries[name] = {"base": version, "rows": self._write(df, version, name), "key": (key or {}).get(name, known.get("key")), "columns": df.columns}
            return self._commit(old, entries, version, max_lsn, batch_id)

    def append_pages(self, table: str, number: int, rows: DataFrame, key: list[str]) -> dict:
        """Add the rows of a copy's pages up to ``number``, with unique keys that no other page has. Rows that the table has
        already, or of which it has changes, win."""
        rows.write.mode("overwrite").parquet(f"{self.root}/pages/{table}/p={number}")
        with self.turn:
            old = self.manifest()
            entry = old["tables"].get(table, {"rows": 0})
            return self._commit(old, {table: entry | {"pages": number, "key": key, "columns": entry.get("columns") or rows.columns}}, old["version"])

    def clear_pages(self, table: str) -> None:
        """Delete pages that a dead writer has left behind: those that the manifest doesn't count."""
        counted = self.manifest()["tables"].get(table, {}).get("pages", 0)
        for name in self.files.names(f"{self.root}/pages/{table}"):
            if name.startswith("p=") and int(name[2:]) > counted:
                self.files.delete(f"{self.root}/pages/{table}/{name}")

    def apply(
        self, deltas: dict[str, tuple[DataFrame, list[str], list[str]]], max_lsn: int, batch_id: int = -1, copying: bool = False,
        held: DataFrame | None = None, **more
    ) -> dict:
        """Add the changes of a batch to some tables, in one step: states (one for each key), key, and the rows' columns in
        order. ``copying``: rows may yet come that were read before a change, so deletes are kept in mind. ``held``:
        messages that wait for the next batch."""
        with self.turn:
            old = self.manifest()
            version, entries = old["version"] + 1, {}
            for name, (states, key, order) in deltas.items():
                n = self._write(states, version, name)
                if not n:
                    continue
                entry = {"rows": 0} | old["tables"].get(name, {}) | {"key": key, "columns": order}
                entry["deltas"] = [*entry.get("deltas", []), [version, n]]
                entries[name] = entry
            after = self._commit(old, entries, version, max_lsn, batch_id, held=self._hold(held, version), **more)
            for name in entries:
                after = self._tidy(after, name, copying)
            return after

    def hold(self, messages: DataFrame, batch_id: int) -> dict:
        """Keep messages for the next batch."""
        with self.turn:
            old = self.manifest()
            return self._commit(old, {}, old["version"] + 1, batch_id=batch_id, held=self._hold(messages, old["version"] + 1))

    def _hold(self, messages: DataFrame | None, version: int) -> int | None:
        return version if messages is not None and self._write(messages, version, "_held") else None

    def held(self) -> DataFrame | None:
        version = self.manifest().get("held")
        return None if version is None else self.spark.read.parquet(self._at(version, "_held"))

    def _tidy(self, m: dict, table: str, copying: bool) -> dict:
        """Merge the last deltas while one isn't twice the next one's size; fold them into the rows once they come to a
        quarter of these."""
        entry = m["tables"][table]
        deltas = list(entry.get("deltas", []))
        if not copying and entry["rows"] and 4 * sum(n for _, n in deltas) >= entry["rows"]:
            return self.fold(table)
        run = 1
        while run < len(deltas) and deltas[-run - 1][1] <= 2 * sum(n for _, n in deltas[-run:]):
            run += 1
        if run == 1:
            return m
        version = m["version"] + 1
        n = self._write(self._deltas(table, entry, [v for v, _ in deltas[-run:]]), version, table)
        return self._commit(m, {table: entry | {"deltas": [*deltas[:-run], [version, n]]}}, version)

    def fold(self, table: str) -> dict:
        """Write what a table's parts amount to as its rows."""
        with self.turn:
            old = self.manifest()
            entry = old["tables"][table]
            if not entry.get("deltas") and not entry.get("pages"):
                return old
            version = old["version"] + 1
            rows = self._write(self.read(table), version, table)
            new = self._commit(old, {table: {"base": version, "rows": rows, "key": entry["key"], "columns": entry["columns"]}}, version)
            self.files.delete(f"{self.root}/pages/{table}")
            return new

    def settle(self, table: str) -> None:
        """The end of a copy. Pages without changes stay as they are."""
        with self.turn:
            m = self.manifest()
            entry = m["tables"].get(table)
            if entry and entry.get("pages") and (entry.get("base") or entry.get("deltas")):
                self.fold(table)
            elif entry and entry.get("pages"):
                rows = self._pages(table, entry).count()
                self._commit(m, {table: entry | {"rows": rows}}, m["version"])

    def create(self, table: str, df: DataFrame, force: bool = False) -> dict:
        """A table's first version; an existing one is an error unless forced."""
        if table in self.manifest()["tables"] and not force:
            raise SetupError(f"{table} exists")
        return self.publish({table: df})

    def forget(self, table: str) -> None:
        """Take a table out of the store."""
        with self.turn:
            m = self.manifest()
            m["tables"].pop(table, None)
            self._commit(m, {}, m["version"])
            self.files.delete(f"{self.root}/pages/{table}")

    def prune(self) -> None:
        """Delete versions that nothing reads any more: those between the last pruning and now."""
        with self.turn:
            m = self.manifest()
            used = {v for e in m["tables"].values() for v in [e.get("base"), *(v for v, _ in e.get("deltas", []))]} | {m.get("held")}
            left = []
            for v in [*m.get("unpruned", []), *range(m.get("pruned", 0) + 1, m["version"] + 1)]:
                if v in used:
                    left.append(v)
                else:
                    self.files.delete(f"{self.root}/v={v}")
            self._commit(m, {}, m["version"], unpruned=left, pruned=m["version"])

    def drop(self) -> None:
        self.files.delete(self.root)


class RunLock:
    """One runner for each name: a file made only if it isn't there, with its holder and the end of its lease. The holder
    renews the lease as long as it lives; a lease that has run out belongs to a dead run and is taken over."""

    def __init__(self, spark: SparkSession, root: str, name: str, lease: float = 60.0):
        self.files, self.path, self.lease = Files(spark), f"{root.rstrip('/')}/{name}.lock", lease
        self.holder, self.done = uuid.uuid4().hex, threading.Event()

    def _line(self) -> str:
        return json.dumps({"holder": self.holder, "until": time.time() + self.lease})

    def _found(self) -> dict:
        try:
            return json.loads(self.files.read(self.path))
        except Exception:  # half written, or gone meanwhile
            return {}

    def __enter__(self) -> RunLock:
        if not self.files.create(self.path, self._line(), False):
            found = self._found()
            if found.get("until", time.time() + 1) > time.time():
                raise SetupError(f"another run holds {self.path}")
            self.files.replace(self.path, self._line())
            if self._found().get("holder") != self.holder:  # another one was as quick
                raise SetupError(f"another run holds {self.path}")
        threading.Thread(target=self._renew, daemon=True).start()
        return self

    def _renew(self) -> None:
        while not self.done.wait(self.lease / 3):
            self.files.replace(self.path, self._line())

    def __exit__(self, *_) -> None:
        self.done.set()
        if self._found().get("holder") in (self.holder, None):
            self.files.delete(self.path)


class Progress:
    """Phase and pages of a copy: a line of JSON for each page, in files of their own, and a metadata file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark), root.rstrip("/")

    def metadata(self) -> dict:
        path = f"{self.root}/progress.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {}

    def set(self, **values) -> None:
        self.files.replace(f"{self.root}/progress.json", json.dumps(self.metadata() | values))

    def record(self, table: str, pages: list[tuple]) -> None:
        """Pages that were copied together: batch_no, first and last key, rows and milliseconds of each."""
        names = ("batch_no", "start_key", "end_key", "row_count", "duration_ms")
        lines = [json.dumps({"table_name": table} | dict(zip(names, p)) | {"start_key": json.dumps(p[1], default=str), "end_key": json.dumps(p[2], default=str)}) for p in pages]
        number, _, end, *_ = pages[-1]
        self.files.create(f"{self.root}/batches/{table}-{number:012d}.json", "\n".join(lines), True)
        self.set(**{f"last:{table}": {"batch_no": number, "end_key": end}})

    def last(self, table: str) -> tuple[int, list] | None:
        found = self.metadata().get(f"last:{table}")
        return (found["batch_no"], found["end_key"]) if found else None

    def batches(self) -> DataFrame:
        schema = "table_name string, batch_no long, start_key string, end_key string, row_count long, duration_ms long"
        if not self.files.exists(f"{self.root}/batches"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/batches")
