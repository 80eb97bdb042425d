"""The binary change log: encoding and decoding of its messages, big-endian, by field.

Row messages and the bounds of transactions are decoded in lockstep, a field of all messages of an Arrow batch at a time
(``_Parse``); the few others one by one. A row message names its columns by the relation announced last before it: that is
a join with the relations' versions, so any part of a log can be decoded anywhere. Messages are encoded by column
expressions.

Truncations have the tag T and types the tag Y, as in the protocol's own documentation.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LogError
from .session import ship

#: Microseconds from the Unix epoch to that of the log, 2000-01-01.
EPOCH = 946_684_800_000_000

MESSAGE = "kind string, lsn long, end_lsn long, at_us long, xid long, relation long, namespace string, name string, identity string, columns array<string>, old_kind string, old array<struct<state:string,text:string>>, new array<struct<state:string,text:string>>, relations array<long>, content binary"


class Relation(NamedTuple):
    id: int
    namespace: str
    name: str
    identity: str
    columns: tuple[str, ...]


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str):
        size = struct.calcsize(f">{form}")
        if self.at + size > len(self.raw):
            raise LogError("the message ends too early")
        out = struct.unpack_from(f">{form}", self.raw, self.at)
        self.at += size
        return out[0] if len(out) == 1 else out

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise LogError("the message ends too early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def string(self) -> str:
        end = self.raw.find(b"\0", self.at)
        if end < 0:
            raise LogError("a string has no end")
        out = self.raw[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def sign(self) -> str:
        return chr(self.take("B"))


class Decoder:
    """Decodes messages one by one. Values have a state: ``t`` text, ``n`` null, ``u`` unchanged."""

    def __init__(self):
        self.relations: dict[int, Relation] = {}

    def decode(self, raw: bytes) -> dict:
        r = _Reader(raw)
        kind = r.sign() if raw else ""
        read = getattr(self, f"_{kind}", None) if kind.isalpha() else None
        if read is None:
            raise LogError(f"unknown message {kind!r}")
        return {"kind": kind} | read(r)

    def _B(self, r: _Reader) -> dict:
        lsn, at, xid = r.take("QqI")
        return {"lsn": lsn, "at_us": at + EPOCH, "xid": xid}

    def _C(self, r: _Reader) -> dict:
        _, lsn, end, at = r.take("BQQq")
        return {"lsn": lsn, "end_lsn": end, "at_us": at + EPOCH}

    def _R(self, r: _Reader) -> dict:
        id_ = r.take("I")
        namespace, name, identity = r.string(), r.string(), r.sign()
        columns = []
        for _ in range(r.take("H")):
            r.take("B")
            columns.append(r.string())
            r.take("Ii")
        self.relations[id_] = Relation(id_, namespace, name, identity, tuple(columns))
        return {"relation": id_, "namespace": namespace, "name": name, "identity": identity, "columns": columns}

    def _head(self, r: _Reader) -> tuple[int, dict]:
        id_ = r.take("I")
        if id_ not in self.relations:
            raise LogError(f"a row of relation {id_} comes before the relation")
        x = self.relations[id_]
        return id_, {"relation": id_, "namespace": x.namespace, "name": x.name, "columns": list(x.columns)}

    def _tuple(self, r: _Reader) -> list[dict]:
        out = []
        for _ in range(r.take("H")):
            state = r.sign()
            if state not in "nut":
                raise LogError(f"unknown value state {state!r}")
            out.append({"state": state, "text": r.bytes(r.take("I")).decode("utf-8", "replace") if state == "t" else None})
        return out

    def _row(self, head: dict) -> dict:
        names = head["columns"]
        for part in ("old", "new"):
            extra = len(head.get(part) or ()) - len(names)
            names += [f"col_{len(names) + i}" for i in range(extra)]
        return head

    def _I(self, r: _Reader) -> dict:
        _, out = self._head(r)
        if (x := r.sign()) != "N":
            raise LogError(f"expected a new row, found {x!r}")
        return self._row(out | {"new": self._tuple(r)})

    def _U(self, r: _Reader) -> dict:
        _, out = self._head(r)
        if (x := r.sign()) in "KO":
            out |= {"old_kind": x, "old": self._tuple(r)}
            x = r.sign()
        if x != "N":
            raise LogError(f"expected a new row, found {x!r}")
        return self._row(out | {"new": self._tuple(r)})

    def _D(self, r: _Reader) -> dict:
        _, out = self._head(r)
        if (x := r.sign()) not in "KO":
            raise LogError(f"expected an old row, found {x!r}")
        return self._row(out | {"old_kind": x, "old": self._tuple(r)})

    def _T(self, r: _Reader) -> dict:
        n, _ = r.take("IB")
        return {"relations": [r.take("I") for _ in range(n)]}

    def _Y(self, r: _Reader) -> dict:
        return {"relation": r.take("I"), "namespace": r.string(), "name": r.string()}

    def _O(self, r: _Reader) -> dict:
        return {"lsn": r.take("Q"), "name": r.string()}

    def _M(self, r: _Reader) -> dict:
        _, lsn = r.take("BQ")
        name = r.string()
        return {"lsn": lsn, "name": name, "content": r.bytes(r.take("I"))}


def unframe(frame: bytes) -> tuple[str, int | None, bytes]:
    """A stream frame's kind (w: data, k: keepalive), its position and payload (for k: the reply flag)."""
    kind = chr(frame[0]) if frame else ""
    if kind == "w" and len(frame) >= 25:
        return kind, struct.unpack_from(">Q", frame, 1)[0], frame[25:]
    if kind == "k" and len(frame) >= 18:
        return kind, struct.unpack_from(">Q", frame, 1)[0], frame[17:18]
    raise LogError(f"unknown frame {kind!r}")


def _values(row: list[tuple[str, str | None]]) -> bytes:
    out = [struct.pack(">H", len(row))]
    for state, text in row:
        body = text.encode() if state == "t" else b""
        out.append(state.encode() + (struct.pack(">I", len(body)) + body if state == "t" else b""))
    return b"".join(out)


def begin(lsn: int, at_us: int, xid: int) -> bytes:
    return b"B" + struct.pack(">QqI", lsn, at_us - EPOCH, xid)


def commit(lsn: int, end_lsn: int, at_us: int) -> bytes:
    return b"C" + struct.pack(">BQQq", 0, lsn, end_lsn, at_us - EPOCH)


def relation(r: Relation) -> bytes:
    head = b"R" + struct.pack(">I", r.id) + r.namespace.encode() + b"\0" + r.name.encode() + b"\0" + r.identity.encode() + struct.pack(">H", len(r.columns))
    return head + b"".join(struct.pack(">B", 0) + c.encode() + b"\0" + struct.pack(">Ii", 25, -1) for c in r.columns)


def insert(relation_id: int, row: list[tuple[str, str | None]]) -> bytes:
    return b"I" + struct.pack(">I", relation_id) + b"N" + _values(row)


def update(relation_id: int, row: list[tuple[str, str | None]], old: list | None = None, old_kind: str = "K") -> bytes:
    return b"U" + struct.pack(">I", relation_id) + (old_kind.encode() + _values(old) if old is not None else b"") + b"N" + _values(row)


def delete(relation_id: int, old: list[tuple[str, str | None]], old_kind: str = "K") -> bytes:
    return b"D" + struct.pack(">I", relation_id) + old_kind.encode() + _values(old)


def truncate(relation_ids: list[int]) -> bytes:
    return b"T" + struct.pack(">IB", len(relation_ids), 0) + b"".join(struct.pack(">I", i) for i in relation_ids)


_CELLS = pa.list_(pa.struct([("state", pa.string()), ("text", pa.string())]))
_SCHEMA = pa.schema([
    ("seq", pa.int64()), ("kind", pa.string()), ("lsn", pa.int64()), ("end_lsn", pa.int64()), ("at_us", pa.int64()), ("xid", pa.int64()), ("relation", pa.int64()), ("namespace", pa.string()),
    ("name", pa.string()), ("identity", pa.string()), ("columns", pa.list_(pa.string())), ("old_kind", pa.string()), ("old", _CELLS), ("new", _CELLS), ("relations", pa.list_(pa.int64())), ("content", pa.binary()),
])
_STATES = pa.array(["n", "u", "t"])
_ROWS = 2048


class _Bytes:
    """Numbers at many places of a buffer, each within its own message."""

    def __init__(self, column: pa.Array):
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        self.raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    def number(self, at: np.ndarray, size: int, end: np.ndarray) -> np.ndarray:
        """Unsigned numbers of ``size`` bytes, as 64 bits that wrap like signed ones."""
        if (at + size > end).any():
            raise LogError("the message ends too early")
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out = (out << np.uint64(8)) | self.raw[at + k].astype(np.uint64)
        return out.view(np.int64)

    def tuples(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Of the tuples that start at some places: how many values each has, all values in order, and the places past."""
        parts = [self._tuples(at[i : i + _ROWS], end[i : i + _ROWS]) for i in range(0, len(at), _ROWS)]
        if not parts:
            return np.zeros(0, np.int64), pa.array([], _CELLS.value_type), at
        return np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def _tuples(self, at, end):
        many = self.number(at, 2, end)
        at = at + 2
        width = int(many.max(initial=0))
        state, first, size = (np.zeros((len(at), width), t) for t in (np.int8, np.int64, np.int64))
        for c in range(width):
            on = np.flatnonzero(many > c)
            sign = self.number(at[on], 1, end[on])
            code = np.select([sign == ord("n"), sign == ord("u"), sign == ord("t")], [0, 1, 2], -1)
            if (code < 0).any():
                raise LogError(f"unknown value state {chr(int(sign[code < 0][0]))!r}")
            state[on, c] = code
            at[on] += 1
            text = on[code == 2]
            size[text, c] = self.number(at[text], 4, end[text])
            first[text, c] = at[text] + 4
            at[text] += 4 + size[text, c]
            if (at[text] > end[text]).any():
                raise LogError("the message ends too early")
        real = np.arange(width) < many[:, None]
        return many, pa.StructArray.from_arrays([_STATES.take(pa.array(state[real])), self._texts(state[real], first[real], size[real])], ["state", "text"]), at

    def _texts(self, state, first, size) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        valid = pa.py_buffer(np.packbits(state == 2, bitorder="little").tobytes())
        out = pa.Array.from_buffers(pa.string(), len(state), [valid, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            out = pa.array([data[a:b].tobytes().decode("utf-8", "replace") if s == 2 else None for s, a, b in zip(state, ends[:-1], ends[1:])], pa.string())
        return out


def _lists(rows: np.ndarray, many: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """Lists of ``many`` values each for some of n rows, null for the others."""
    count, none = np.zeros(n, np.int64), np.ones(n + 1, bool)
    count[rows], none[rows], none[n] = many, False, False
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), mask=none), values)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages decoded but for the names of row messages."""
    one = Decoder()
    for b in batches:
        n, x = len(b), _Bytes(b.column("message"))
        start, end = x.offsets[:-1], x.offsets[1:]
        if (end == start).any():
            raise LogError("unknown message ''")
        kind = x.raw[start] if n else np.zeros(0, np.uint8)
        numbers = {c: (np.zeros(n, np.int64), np.ones(n, bool)) for c in ("lsn", "end_lsn", "at_us", "xid", "relation")}

        def put(name: str, rows, values, numbers=numbers) -> None:
            numbers[name][0][rows], numbers[name][1][rows] = values, False

        of = {k: np.flatnonzero(kind == ord(k)) for k in "BC"}
        for k, fields in (("B", (("lsn", 1, 8), ("at_us", 9, 8), ("xid", 17, 4))), ("C", (("lsn", 2, 8), ("end_lsn", 10, 8), ("at_us", 18, 8)))):
            for name, at, size in fields:
                put(name, of[k], x.number(start[of[k]] + at, size, end[of[k]]) + (EPOCH if name == "at_us" else 0))
        row = np.flatnonzero(np.isin(kind, np.frombuffer(b"IUD", np.uint8)))
        put("relation", row, x.number(start[row] + 1, 4, end[row]))
        at, sign = start[row] + 6, x.number(start[row] + 5, 1, end[row])
        keyed = (sign == ord("K")) | (sign == ord("O"))
        wrong = np.where(kind[row] == ord("I"), sign != ord("N"), np.where(kind[row] == ord("D"), ~keyed, ~keyed & (sign != ord("N"))))
        if wrong.any():
            raise LogError(f"a row message has {chr(int(sign[wrong][0]))!r} where its row should start")
        many, values, past = x.tuples(at[keyed], end[row][keyed])
        old = _lists(row[keyed], many, values, n)
        old_kind = np.full(n, None, object)
        old_kind[row[keyed]] = np.where(sign[keyed] == ord("K"), "K", "O")
        at[keyed] = past
        both = keyed & (kind[row] == ord("U"))
        if (x.number(at[both], 1, end[row][both]) != ord("N")).any():
            raise LogError("an update's old row isn't followed by its new one")
        at[both] += 1
        fresh = kind[row] != ord("D")
        many, values, _ = x.tuples(at[fresh], end[row][fresh])
        new = _lists(row[fresh], many, values, n)
        rest = np.flatnonzero(~np.isin(kind, np.frombuffer(b"IUDBC", np.uint8)))
        others = {c: [None] * n for c in ("namespace", "name", "identity", "columns", "relations", "content")}
        for i in rest.tolist():
            for name, value in one.decode(x.raw[start[i] : end[i]].tobytes()).items():
                if name in others:
                    others[name][i] = value
                elif name != "kind":
                    put(name, i, value)
        signs = pa.array([chr(i) for i in range(128)]).take(pa.array(kind))
        out = {"seq": b.column("seq"), "kind": signs, "old": old, "new": new, "old_kind": pa.array(old_kind, pa.string())}
        out |= {c: pa.array(v, mask=none) for c, (v, none) in numbers.items()} | {c: pa.array(v, _SCHEMA.field(c).type) for c, v in others.items()}
        yield pa.RecordBatch.from_arrays([out[f.name] for f in _SCHEMA], schema=_SCHEMA)


def parse(messages: DataFrame) -> DataFrame:
    """Messages (seq, message) decoded but for the names of row messages, which other messages have."""
    ship(messages.sparkSession)
    return messages.select("seq", "message").mapInArrow(_parse, f"seq long, {MESSAGE}")


_VERSION = "relation long, namespace string, name string, identity string, columns array<string>"


def relation_versions(messages: DataFrame, relations: list[Relation] = ()) -> DataFrame:
    """Every definition of each relation with the positions [since, until) in which it holds (until null: to the end);
    a relation that is announced again as it was makes no version. ``relations``: those announced before. There are as
    many rows as changes of definitions."""
    seen = parse(messages.where(F.substring("message", 1, 1) == F.lit(b"R"))).select("seq", *[c.split()[0] for c in _VERSION.split(", ")])
    known = messages.sparkSession.createDataFrame([(-(1 << 62), *r[:4], list(r[4])) for r in relations], f"seq long, {_VERSION}")
    order = Window.partitionBy("relation").orderBy("seq")
    what = F.struct("namespace", "name", "identity", "columns")
    every = known.union(seen).withColumn("same", F.coalesce(F.lag(what).over(order) == what, F.lit(False))).where("not same").drop("same")
    return every.withColumnRenamed("seq", "since").withColumn("until", F.lead("since").over(Window.partitionBy("relation").orderBy("since")))


def decode(messages: DataFrame, relations: list[Relation] = (), versions: DataFrame | None = None) -> DataFrame:
    """Messages (seq, message) decoded, with the names of each row's relation as of its position; columns beyond those
    announced are named col_0, col_1, ... by their place. A row whose relation wasn't announced is an error, and so is a
    message that can't be read. ``relations``: those announced before; ``versions``: all, where they are known."""
    parsed = parse(messages)
    v = (relation_versions(messages, relations) if versions is None else versions).select(*[F.col(c).alias(f"v_{c}") for c in (
        "relation", "namespace", "name", "columns", "since", "until"
    )])
    row = F.col("kind").isin("I", "U", "D")
    held = (F.col("seq") >= F.col("v_since")) & (F.col("v_until").isNull() | (F.col("seq") < F.col("v_until")))
    joined = parsed.join(v, row & (F.col("relation") == F.col("v_relation")) & held, "left")
    size = F.greatest(F.size("v_columns"), F.coalesce(F.size("new"), F.lit(0)), F.coalesce(F.size("old"), F.lit(0)))
    extra = F.transform(F.sequence(F.size("v_columns"), size - 1), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    names = F.when(
        F.col("v_columns").isNull(),
        F.raise_error(F.concat(F.lit("a row of relation "), F.col("relation").cast("string"), F.lit(" comes before the relation"))).cast("array<string>")
    )
    names = F.when(row, names.when(size > F.size("v_columns"), F.concat("v_columns", extra)).otherwise(F.col("v_columns"))).otherwise(F.col("columns"))
    own = {"namespace": F.when(row, F.col("v_namespace")).otherwise(F.col("namespace")), "name": F.when(row, F.col("v_name")).otherwise(F.col("name")), "columns": names}
    return joined.select("seq", *[own.get(c, F.col(c)).alias(c) for c in (f.split()[0] for f in MESSAGE.split(", ") if f.split()[0] in _SCHEMA.names)])


# --- encoding by column expressions ------------------------------------------------------------------------------------


def _unsigned(x: Column, size: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * size)))


def cell(text: Column, unchanged: Column | None = None) -> Column:
    """A value of a tuple from its text: null, unchanged or sent."""
    body = text.cast("binary")
    sent = F.when(text.isNull(), F.lit(b"n")).otherwise(F.concat(F.lit(b"t"), _unsigned(F.octet_length(body), 4), body))
    return sent if unchanged is None else F.when(unchanged, F.lit(b"u")).otherwise(sent)


def tuple_of(*cells: Column) -> Column:
    return F.concat(F.lit(struct.pack(">H", len(cells))), *cells)


def insert_of(relation_id: int | Column, new: Column) -> Column:
    return F.concat(F.lit(b"I"), _id(relation_id), F.lit(b"N"), new)


def update_of(relation_id: int | Column, new: Column, old: Column | None = None, old_kind: str = "K") -> Column:
    before = [F.lit(old_kind.encode()), old] if old is not None else []
    return F.concat(F.lit(b"U"), _id(relation_id), *before, F.lit(b"N"), new)


def delete_of(relation_id: int | Column, old: Column, old_kind: str = "K") -> Column:
    return F.concat(F.lit(b"D"), _id(relation_id), F.lit(old_kind.encode()), old)


def begin_of(lsn: Column, at_us: Column, xid: Column) -> Column:
    return F.concat(F.lit(b"B"), _unsigned(lsn, 8), _unsigned(at_us - EPOCH, 8), _unsigned(xid, 4))


def commit_of(lsn: Column, end_lsn: Column, at_us: Column) -> Column:
    return F.concat(F.lit(b"C\0"), _unsigned(lsn, 8), _unsigned(end_lsn, 8), _unsigned(at_us - EPOCH, 8))


def _id(relation_id: int | Column) -> Column:
    return _unsigned(relation_id if isinstance(relation_id, Column) else F.lit(relation_id), 4)


def encode_inserts(rows: DataFrame, relation_id: int, columns: list[str]) -> DataFrame:
    """An insert message for each row (seq and string columns)."""
    return rows.select("seq", insert_of(relation_id, tuple_of(*[cell(F.col(c)) for c in columns])).alias("message"))


def read_frames(files: DataFrame) -> DataFrame:
    """Messages (seq, message) of log files (path, content, as Spark's ``binaryFile`` source reads them): frames one
    after another, each after its length in four bytes; keepalives are left out. The digits of a file's name are its
    number; a message's position is that number times 2^32 plus its place in the file."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(_frames, "seq long, message binary")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, raw in zip(b.column("path").to_pylist(), b.column("content")):
            raw, at, seq, out = raw.as_py(), 0, [], []
            number = int("".join(c for c in path.rsplit("/", 1)[-1] if c.isdigit()) or 0) << 32
            while at < len(raw):
                if at + 4 > len(raw) or at + 4 + (size := struct.unpack_from(">I", raw, at)[0]) > len(raw):
                    raise LogError(f"{path} ends within a frame")
                kind, _, payload = unframe(raw[at + 4 : at + 4 + size])
                if kind == "w":
                    seq.append(number + len(seq))
                    out.append(payload)
                at += 4 + size
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(out, pa.binary())], ["seq", "message"])


def frame(payload: bytes, position: int = 0, at_us: int = EPOCH) -> bytes:
    """A data frame after its length, as log files have it."""
    body = b"w" + struct.pack(">QQq", position, position, at_us - EPOCH) + payload
    return struct.pack(">I", len(body)) + body
