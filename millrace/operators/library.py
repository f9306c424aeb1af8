"""The library: saved conversations as a table of Parquet files with versions, hashes, tags and a search."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import blank_to_null, stable_hash, trim
from .schema import MESSAGE, complete


def normal_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, trim), lambda t: t != ""))


def records(conversations: DataFrame, messages: DataFrame, reports: DataFrame, saved_at: Column, tags: Column | None = None, label: Column | None = None) -> DataFrame:
    """One record per conversation, with its messages, so that it can be rendered again (``stored``).

    The content hash is taken over a canonical form of ours: source, export time and the message hashes in order. It is
    for display; a record's id is 128 bits of a cryptographic hash, as a library can hold very many.
    """
    mark = stable_hash(F.concat_ws("\n", "role", "author_label", "text"))
    held = complete(messages).select("conv_id", "idx", mark.alias("hash"), F.struct("idx", *MESSAGE).alias("message"))
    by_position = lambda a, b: F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0)
    rows = held.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "hash", "message")), by_position).alias("rows"))
    rows = rows.select("conv_id", F.transform("rows", lambda r: r["hash"]).alias("message_hashes"), F.transform("rows", lambda r: r["message"]).alias("messages"))
    df = conversations.join(reports.select("conv_id", "status", "message_count", F.struct(*[c for c in reports.columns if c != "conv_id"]).alias("report")), "conv_id").join(rows, "conv_id", "left")
    df = df.withColumns({"message_hashes": F.coalesce("message_hashes", F.expr("cast(array() as array<string>)")), "saved_at": saved_at})
    df = df.withColumn("content_hash", stable_hash(F.concat_ws("\n", F.coalesce("source_url", F.lit("")), F.coalesce("exported_at", F.lit("")), F.array_join("message_hashes", ","))))
    ident = F.concat(F.lit("library-"), F.substring(F.sha2(F.concat_ws("\n", F.coalesce("source_url", F.lit("")), F.coalesce("exported_at", F.lit("")), "saved_at", F.array_join("message_hashes", ",")), 256), 1, 32))
    return df.select(
        ident.alias("id"), "conv_id", "saved_at", F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled conversation")).alias("title"),
        normal_tags(tags if tags is not None else F.expr("cast(array() as array<string>)")).alias("tags"),
        (blank_to_null(label) if label is not None else F.lit(None).cast("string")).alias("project_label"),
        F.col("platform_label").alias("source_platform"), F.col("platform").alias("source_platform_id"), "source_url", F.col("exported_at").alias("export_date"),
        "message_count", F.col("status").alias("completeness_status"), "content_hash", "message_hashes", "conversation_id", "report", "messages",
    )


def stored(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, reports) of ``records``, keyed by the record's id: what ``sinks.files.render_files`` takes."""
    key = F.col("id").alias("conv_id")
    heads = records.select(key, F.col("source_platform_id").alias("platform"), F.col("source_platform").alias("platform_label"), "source_url", "title", "conversation_id", F.col("export_date").alias("exported_at"))
    messages = records.select(key, F.explode("messages").alias("m")).select("conv_id", "m.*")
    return heads, messages, records.select(key, "report.*")


def search(df: DataFrame, query: str | None = None, label: str | None = None, platform: str | None = None, tags: Iterable[str] = ()) -> DataFrame:
    """Records that fit all that is asked for, without regard to case; texts of messages are not searched."""

    def asked(value: str | None) -> str | None:
        return (value or "").strip().lower() or None

    for column, want in (("project_label", asked(label)), ("source_platform", asked(platform))):
        if want:
            df = df.filter(F.lower(column) == want)
    if wanted := sorted({t.strip().lower() for t in tags if t.strip()}):
        have = F.transform("tags", F.lower)
        df = df.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), have)) == 0)
    if word := asked(query):
        df = df.filter(F.contains(_searched(), F.lit(word)))
    return df


def _searched() -> Column:
    """The text of a record that a query is looked for in."""
    fields = ("title", F.coalesce("project_label", F.lit("")), "source_platform", "source_url", "completeness_status", "content_hash", F.array_join("tags", " "))
    return F.lower(F.concat_ws(" ", *fields))


GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct strings of GRAM characters in a text."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(every, lambda g: F.length(g) == GRAM))


class Library:
    """A folder of immutable files, and numbered versions that say which of them are the table.

    Records lie in buckets of their id's hash. A ``put`` adds files with the new records and a list of their ids; the list
    hides what earlier versions hold under these ids. A ``delete`` adds a list only. No file is ever rewritten but by
    ``compact``, which merges young files, so reading joins with few lists.

    A version file is complete before it takes its name, and takes it only if no other has it: where two write at once,
    the one that comes second builds its version again on top of the first. Nothing of either is lost; of two records put
    under one id, the one of the later version stays. The file system must rename without overwriting (HDFS, local).
    """

    BUCKETS, COMPACT_AT, TRIES = 32, 16, 100
    #: An entry is merged with younger ones until it holds so many times their records.
    TIER = 4

    #: Slots of the index, and how many of a query's strings, the rarest, are looked up; what they find is verified.
    SLOTS, LOOKED_UP = 64, 3

    def __init__(self, spark: SparkSession, path: str, indexed: bool = False):
        """``indexed``: keep lists of the records that hold each string of GRAM characters, which ``search`` reads."""
        self.spark, self.path, self.indexed = spark, path.rstrip("/"), indexed
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def state(self) -> dict:
        """The newest version: its number, data and id lists, oldest first, each with the version it came with."""
        names = [n for n in self._names("versions") if n.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": self.BUCKETS, "data": [], "lists": []}
        stream = self.fs.open(self._path(f"versions/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _claim(self, state: dict) -> bool:
        """Write a version if nobody has taken its number."""
        name, own = f"{state['version']:020d}.json", self._path(f"versions/.{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        try:
            to = self._path(f"versions/{name}")
            if self.fs.getScheme() == "file":  # a local rename overwrites, a link does not
                os.link(own.toUri().getPath(), to.toUri().getPath())
            else:
                none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                kinds = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
                kinds[0] = none
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, to, kinds)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        finally:
            self.fs.delete(own, False)

    def _commit(self, change: Callable[[dict], dict | None]) -> dict | None:
        """The version that ``change`` makes of the newest one, tried again on top of whatever came between."""
        for _ in range(self.TRIES):
            state = self.state()
            new = change(dict(state, version=state["version"] + 1))
            if new is None or self._claim(new):
                return new
        raise RuntimeError(f"{self.path}: other writers took the version {self.TRIES} times")

    def _write(self, df: DataFrame, buckets: int) -> tuple[str, int]:
        """(the folder of new files, how many rows they hold)."""
        name = f"batch={uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        counted = Observation()
        df.withColumn("bucket", bucket).repartition("bucket").observe(counted, F.count("*").alias("rows")).write.partitionBy("bucket").parquet(f"{self.path}/files/{name}")
        return name, counted.get["rows"]

    def _index(self, name: str) -> bool:
        """Write the lists of the records in these files, beside them; sorted, so that readers skip most of a slot."""
        if not self.indexed:
            return False
        rows = self.spark.read.parquet(f"{self.path}/files/{name}").select("bucket", "id", F.explode(_grams(_searched())).alias("gram"))
        rows = rows.withColumn("slot", self._slot("gram")).repartition("slot").sortWithinPartitions("slot", "gram", "bucket")
        rows.write.partitionBy("slot").parquet(f"{self.path}/lists/{name}")
        return True

    def _slot(self, gram: str) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.SLOTS)).cast("int")

    def search(self, query: str | None = None, label: str | None = None, platform: str | None = None, tags: Iterable[str] = ()) -> DataFrame | None:
        """As the function ``search``; where all files are indexed and the query is long enough, only records that hold its rarest strings are read."""
        state, word = self.state(), (query or "").strip()
        df = self._live(state, state["data"])
        if df is None:
            return None
        asked = self.spark.createDataFrame([(word,)], "q string").select(F.explode(_grams(F.lower("q"))).alias("gram")).select("gram", self._slot("gram").alias("slot")).collect()
        if asked and all(e.get("indexed") for e in state["data"]):
            base = self.spark.read.option("basePath", f"{self.path}/lists").schema("bucket int, id string, gram string, batch string, slot int")
            lists = base.parquet(*(f"{self.path}/lists/{e['files']}" for e in state["data"]))
            lists = lists.filter(F.col("slot").isin(sorted({r["slot"] for r in asked})) & F.col("gram").isin([r["gram"] for r in asked]))
            sizes = {r["gram"]: 0 for r in asked} | {r["gram"]: r["count"] for r in lists.groupBy("gram").count().collect()}  # a row per string of the query
            rare = sorted(sizes, key=lambda g: (sizes[g], g))[: self.LOOKED_UP]
            found = lists.filter(F.col("gram").isin(rare)).groupBy("bucket", "id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rare)).select("bucket", "id")
            df = df.join(found, ["bucket", "id"], "left_semi")
        return search(df, query, label, platform, tags).drop("bucket")

    def _open(self, entries: list[dict]) -> DataFrame:
        """The rows of all files of these entries, with ``_came``, the version they came with."""
        whole = self.spark.read.option("basePath", f"{self.path}/files").schema(self._schema(entries)).parquet(*(f"{self.path}/files/{e['files']}" for e in entries))
        came = F.create_map(*(F.lit(x) for e in entries for x in (e["files"].removeprefix("batch="), e["came"])))
        return whole.withColumn("_came", F.element_at(came, F.col("batch"))).drop("batch")

    def _schema(self, entries: list[dict]):
        """Of the newest files; columns that older ones lack are null in their rows."""
        return StructType.fromJson(entries[-1]["schema"]).add("batch", "string").add("bucket", "integer")

    def _entry(self, name: str, rows: int, came: int, df: DataFrame) -> dict:
        return {"files": name, "rows": rows, "came": came, "schema": df.schema.jsonValue()}

    def _hidden(self, state: dict) -> DataFrame:
        """bucket, id and the last version that hides it."""
        lists = self._open(state["lists"])
        return lists.groupBy("bucket", "id").agg(F.max(F.coalesce("until", "_came")).alias("_until"))

    def _live(self, state: dict, data: list[dict]) -> DataFrame | None:
        if not data:
            return None
        rows = self._open(data)
        if not any(e["came"] >= data[0]["came"] for e in state["lists"]):
            return rows.drop("_came")
        hidden = self._hidden(state)
        mine = (rows["bucket"] == hidden["bucket"]) & (rows["id"] == hidden["id"]) & (hidden["_until"] > rows["_came"])
        return rows.join(hidden, mine, "left_anti").drop("_came")

    def read(self) -> DataFrame | None:
        state = self.state()
        df = self._live(state, state["data"])
        return None if df is None else df.drop("bucket")

    def list(self) -> DataFrame | None:
        """Newest first."""
        df = self.read()
        return None if df is None else df.orderBy(F.desc("saved_at"), "id")

    def get(self, ids: Iterable[str]) -> DataFrame | None:
        """The records of these ids; only files of their buckets are read."""
        state, ids = self.state(), list(ids)
        df = self._live(state, state["data"])
        if df is None or not ids:
            return None if df is None else df.drop("bucket").limit(0)
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string").select(F.pmod(F.xxhash64("id"), F.lit(state["buckets"])).cast("int").alias("b"))
        return df.filter(F.col("bucket").isin([r["b"] for r in asked.distinct().collect()]) & F.col("id").isin(ids)).drop("bucket")

    def put(self, new: DataFrame) -> None:
        """Records replace those of the same id; of several new ones with one id the last saved stays."""
        best = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), F.struct("saved_at", "content_hash")).alias("r")).select("r.*")
        name, rows = self._write(best, self.state()["buckets"])
        indexed = self._index(name)
        lists: list[tuple[str, int]] = []

        def change(state: dict) -> dict:
            came = state["version"]
            out = dict(state, data=[*state["data"], dict(self._entry(name, rows, came, best), indexed=indexed)])
            if state["data"]:  # there is something that the new ids may hide
                if not lists:
                    lists.append(self._write(_ids(self.spark.read.parquet(f"{self.path}/files/{name}")), state["buckets"]))
                out["lists"] = [*state["lists"], self._entry(*lists[0], came, _ids(best))]
            return out

        if len(self._commit(change)["data"]) > self.COMPACT_AT:
            self.compact()

    def delete(self, ids: DataFrame) -> None:
        state = self.state()
        if not state["data"]:
            return
        own = _ids(ids.select("id").distinct())
        name, rows = self._write(own, state["buckets"])
        self._commit(lambda s: dict(s, lists=[*s["lists"], self._entry(name, rows, s["version"], own)]))

    def clear(self) -> None:
        self._commit(lambda s: dict(s, data=[], lists=[]) if s["data"] else None)

    def compact(self, whole: bool = False) -> None:
        """Merge the youngest files, or all; a compaction that another one overtook is left out."""
        state = self.state()
        held, young = 0, len(state["data"])
        while young and (whole or len(state["data"]) - young < 2 or state["data"][young - 1]["rows"] < self.TIER * held):
            young -= 1
            held += state["data"][young]["rows"]
        old, merged = state["data"][:young], state["data"][young:]
        if len(merged) < 2 and not (whole and state["lists"]):
            return
        rows = self._live(state, merged).drop("bucket")
        name, n = self._write(rows, state["buckets"])
        entry = dict(self._entry(name, n, state["version"], rows), indexed=self._index(name))
        lists: list[dict] = []
        if old and state["lists"]:  # older files still need their ids hidden
            ids = self._hidden(state).select("id", F.col("_until").alias("until"))
            lists.append(self._entry(*self._write(ids, state["buckets"]), state["version"], ids))
        gone = {e["files"] for e in merged}
        listed = {e["files"] for e in state["lists"]}

        def change(now: dict) -> dict | None:
            if not gone <= {e["files"] for e in now["data"]} or not listed <= {e["files"] for e in now["lists"]}:
                return None
            since = [e for e in now["data"] if e["came"] > state["version"]]
            return dict(now, data=[*old, entry, *since], lists=[*lists, *(e for e in now["lists"] if e["files"] not in listed)])

        self._commit(change)

    def vacuum(self, versions: int = 10, older_than_s: float = 86_400) -> None:
        """Delete files that none of the last ``versions`` names, unless they are so young that a writer may still need them."""
        names = [n for n in self._names("versions") if n.endswith(".json")]
        used: set[str] = set()
        for n in names[-versions:]:
            stream = self.fs.open(self._path(f"versions/{n}"))
            state = json.loads(bytes(stream.readAllBytes()))
            stream.close()
            used |= {e["files"] for e in (*state["data"], *state["lists"])}
        limit = (time.time() - older_than_s) * 1000
        for at in (f"{folder}/{n}" for folder in ("files", "lists") for n in self._names(folder) if n not in used):
            if self.fs.getFileStatus(self._path(at)).getModificationTime() < limit:
                self.fs.delete(self._path(at), True)
        for n in names[:-versions]:
            self.fs.delete(self._path(f"versions/{n}"), False)

    def backup(self, path: str) -> None:
        """One JSON line per record, spread over files."""
        if (df := self.read()) is not None:
            df.write.json(path)

    def restore(self, path: str, schema: StructType | str) -> None:
        """Put the records of a backup; the schema is that of the records (``read().schema`` before, or ``records``)."""
        self.put(self.spark.read.schema(schema).json(path))


def _ids(df: DataFrame) -> DataFrame:
    """A list of ids as it is written: ``until`` is null where the version that the list came with hides them."""
    return df.select("id", F.lit(None).cast("long").alias("until"))
