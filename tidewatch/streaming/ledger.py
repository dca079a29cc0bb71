"""Append-only tables in plain Parquet that change together.

A batch writes its rows of every table, in folders of their own, and last of
all a manifest: one row, in one file, which Spark's committer moves to its
place by one rename. Readers see the folders that the newest manifest lists and
no others, so a batch is there in all tables or in none, whatever it was cut
off at; folders of a batch that failed are never listed.

One writer at a time. Folders of a table are merged in levels, so that their
number grows as the logarithm of the batches; each has the ranges of its order
columns and a Bloom filter of its keys, so that a batch reads only those that
may hold its keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.tables import spread

#: Bits of a key's filter word per key that set one, words per key, rows a file.
PROBES, ROWS_A_WORD, ROWS_A_FILE = 8, 2, 4_000_000


class Conflict(RuntimeError):
    """Another writer has committed since this batch began."""


def due(folders: list[dict], fanout: int) -> list[dict]:
    """The folders to merge next: `fanout` or more of the least level that has
    so many; none if no level has."""
    levels: dict[int, list[dict]] = {}
    for f in folders:
        levels.setdefault(f["level"], []).append(f)
    return next((levels[n] for n in sorted(levels) if len(levels[n]) >= fanout), [])


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def probe_bits(h: Column) -> Column:
    """Eight of a word's 64 bits, by a second hash."""
    g = F.xxhash64(h, F.lit(1))
    at = [F.shiftright(g, 6 * i).bitwiseAND(63).cast("int") for i in range(PROBES)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), a) for a in at])


class Ledger:
    """The tables under `base`, a folder that driver and executors share.

    `folds`: for a table, what merged rows are folded by (a sum per key, say);
    it must not change what the table is read for.
    """

    def __init__(self, spark: SparkSession, base: str, fanout: int = 8, folds: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.base, self.fanout, self.folds = spark, base.rstrip("/"), fanout, folds or {}

    def state(self) -> dict:
        """The newest manifest. Two slots take turns: while one is written the
        other holds the state before."""
        try:
            rows = self.spark.read.schema("seq long, state string").option("ignoreMissingFiles", True).parquet(f"{self.base}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        newest = max(rows, key=lambda r: r["seq"], default=None)
        return json.loads(newest["state"]) if newest else {"seq": 0, "runs": {}, "cursors": {}, "tables": {}}

    def table(self, name: str, state: dict | None = None, since: tuple[str, int] | None = None) -> DataFrame | None:
        """The committed rows of a table, None before its first. `since`, a column
        of the table's order and its least value: other rows, and folders without
        such rows, aren't read."""
        t = (state or self.state())["tables"].get(name)
        if t is None or since is None:
            return t and self.read(t, t["folders"])
        return self.read(t, [f for f in t["folders"] if f["ranges"][since[0]][1] >= since[1]]).where(F.col(since[0]) >= since[1])

    def read(self, t: dict, folders: list[dict]) -> DataFrame:
        schema = StructType.fromJson(t["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{f['path']}" for f in folders])

    def cursor(self, name: str, field: str = "processed") -> int | None:
        return self.state()["cursors"].get(name, {}).get(field)

    def begin(self, run: str | None = None, batch_id: int | None = None) -> Batch | None:
        """A batch to fill and commit; None if this run's batch is committed."""
        state = self.state()
        if run is not None and state["runs"].get(run, -1) >= batch_id:
            return None
        return Batch(self, state, run, batch_id)


class Batch:
    """Rows and cursors that become visible together by `commit`. `read` tells
    which folders were looked into for keys that are stored already."""

    def __init__(self, ledger: Ledger, state: dict, run: str | None, batch_id: int | None):
        self.ledger, self.spark, self.state, self.seq = ledger, ledger.spark, state, state["seq"]
        self.read: list[str] = []
        if run is not None:
            state["runs"][run] = batch_id

    def write(self, df: DataFrame, path: str) -> None:
        df.write.parquet(f"{self.ledger.base}/{path}")

    def append(self, table: str, rows: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
        """Adds rows to a table and returns them as they are stored. `keys` and
        `order`, columns of whole numbers without nulls by which folders are left
        out, are a table's from its first batch on."""
        t = self.state["tables"].setdefault(table, {"schema": rows.schema.jsonValue(), "keys": keys, "order": order or [], "folders": []})
        folder = self._folder(table, t, rows, 0)
        if folder["rows"]:
            t["folders"].append(folder)
        return self.ledger.read(t, [folder])

    def _folder(self, table: str, t: dict, rows: DataFrame, level: int, parts: int | None = None) -> dict:
        name = uuid.uuid4().hex
        path = f"data/{table}/{name}"
        if parts is not None:
            rows = rows.repartitionByRange(parts, t["order"][0]) if t["order"] else rows.repartition(parts)
        self.write(rows, path)
        stored = self.ledger.read(t, [{"path": path}])
        n, *ends = stored.agg(F.count("*"), *[end(c) for c in t["order"] for end in (F.min, F.max)]).first()
        folder = {"path": path, "rows": n, "level": level, "ranges": dict(zip(t["order"], zip(ends[::2], ends[1::2]))), "words": 0}
        if t["keys"] and n:
            folder |= {"words": -(-n // ROWS_A_WORD), "filter": f"keys/{table}/folder={name}"}
            h = key_hash(t["keys"])
            words = stored.select(F.pmod(h, folder["words"]).alias("word"), probe_bits(h).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
            self.write(words.coalesce(max(1, n // ROWS_A_FILE)), folder["filter"])
        return folder

    def holding(self, table: str, t: dict, rows: DataFrame) -> list[dict]:
        """The folders that may hold a key of rows: by the range of the first
        order column, then by the filters, one join of the rows' words with
        theirs."""
        folders = t["folders"]
        if t["order"] and folders:
            by = t["order"][0]
            low, high = rows.agg(F.min(by), F.max(by)).first()
            folders = [f for f in folders if low is not None and f["ranges"][by][0] <= high and f["ranges"][by][1] >= low]
        if not folders:
            return []
        base = f"{self.ledger.base}/keys/{table}"
        filters = self.spark.read.schema("word long, bits long, folder string").option("basePath", base).parquet(*[f"{self.ledger.base}/{f['filter']}" for f in folders])
        of = F.array(*[F.struct(F.lit(f["path"].rsplit("/")[-1]).alias("folder"), F.lit(f["words"]).cast("long").alias("words")) for f in folders])
        h = rows.select(key_hash(t["keys"]).alias("h")).select("h", probe_bits(F.col("h")).alias("probe"), F.inline(of))
        h = h.select("folder", F.pmod(F.col("h"), F.col("words")).alias("word"), "probe")
        hit = {r["folder"] for r in h.join(filters, ["folder", "word"]).where("bits & probe = probe").select("folder").distinct().collect()}
        return [f for f in folders if f["path"].rsplit("/")[-1] in hit]

    def append_once(self, table: str, rows: DataFrame, keys: list[str], order: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
        """Adds the first row of each key that isn't stored, and returns what was
        added. `first`: the columns by which a batch's rows of one key are ordered
        (all columns unless given); across batches what is stored wins. A row
        with a null in its key equals no other and is always added. `order`: a
        column that a key determines, such as its block; folders beyond the
        batch's range of it aren't read."""
        whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        row = F.min_by(F.struct(*rows.columns), F.struct(*(first or []), *rows.columns))
        # spread by key first: what comes in a few files is sorted for min_by by all tasks, once
        new = spread(rows.where(whole), *keys).groupBy(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]).agg(row.alias("row")).select("row.*").persist()
        t = self.state["tables"].get(table)
        if t:
            folders = self.holding(table, t, new)
            self.read += [f["path"] for f in folders]
            there = self.ledger.read(t, folders).select(*keys) if folders else None
        else:
            there = None
        added = new if there is None else new.join(there, keys, "left_anti").select(*rows.columns)
        out = self.append(table, added.unionByName(rows.where(~whole)), keys, order)
        new.unpersist()
        return out

    def table(self, name: str, since: tuple[str, int] | None = None) -> DataFrame | None:
        """A table with this batch's rows, before the commit."""
        return self.ledger.table(name, self.state, since)

    def advance(self, name: str, **blocks: int) -> None:
        """Moves a cursor's fields (processed, observed) forward, never back."""
        c = self.state["cursors"].setdefault(name, {})
        for field, block in blocks.items():
            c[field] = max(block, c.get(field, block))

    def merge(self) -> None:
        """Merges folders where a level is full, and what that fills in turn."""
        for table, t in self.state["tables"].items():
            while old := due(t["folders"], self.ledger.fanout):
                rows = self.ledger.read(t, old)
                if table in self.ledger.folds:
                    rows = self.ledger.folds[table](rows).select(*rows.columns)
                folder = self._folder(table, t, rows, old[0]["level"] + 1, -(-sum(f["rows"] for f in old) // ROWS_A_FILE))
                paths = {f["path"] for f in old}
                t["folders"] = [*(f for f in t["folders"] if f["path"] not in paths), folder]
                self.state["left"] += [[table, p] for p in sorted(paths)]

    def commit(self) -> None:
        """Merges folders, then writes the manifest. Folders that were merged by
        the batch before are emptied first: only the slot that is overwritten
        next still lists them."""
        for table, path in self.state.get("left", []):
            schema = StructType.fromJson(self.state["tables"][table]["schema"])
            self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.ledger.base}/{path}")
        self.state["left"] = []
        self.merge()
        if self.ledger.state()["seq"] != self.seq:
            raise Conflict(f"seq {self.seq} is not the newest")
        self.state["seq"] = seq = self.seq + 1
        row = self.spark.createDataFrame([(seq, json.dumps(self.state))], "seq long, state string").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.ledger.base}/manifest/slot={seq % 2}")
