"""L3: append-only tables and the views that stand for updates, counters and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memoquarry.operators.decay import cold_start


def latest(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    """Insert-or-replace: the newest version of each key (an aggregate, so it combines before the shuffle)."""
    row = F.max_by(F.struct(*versions.columns), version).alias("row")
    return versions.groupBy(*[F.col(k).alias(f"key_{k}") for k in key]).agg(row).select("row.*")


def access_counts(log: DataFrame, key: str, at: str) -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("load_count"), F.max(at).alias("last_loaded"))


def archived(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """All rows with superseded_by (null where none is named) and whether they live; a key with several tombstones has its first successor."""
    once = tombstones.groupBy(key).agg(F.min("superseded_by").alias("superseded_by"), F.lit(True).alias("dead"))
    return rows.join(once, key, "left").withColumn("live", F.col("dead").isNull()).drop("dead")


def records_view(stored: DataFrame) -> DataFrame:
    """Stored columns as a record has them: JSON lists as arrays, 0 and 1 as flags."""
    return stored.withColumn("entities", F.from_json("entities", "array<string>")).withColumn("archived", F.col("archived") == 1)


def search_entities(rows: DataFrame, names: list[str], k: int) -> DataFrame:
    """For each of a few given names the k most important rows whose entities, as JSON text, hold it in quotes, in any case and with live wildcards."""
    text = F.col("_json")
    rows = rows.withColumn("_json", F.to_json("entities"))
    found = reduce(DataFrame.unionByName, (rows.filter(text.ilike(f'%"{n}"%')).withColumn("pattern", F.lit(n)) for n in names))
    order = Window.partitionBy("pattern").orderBy(F.desc("importance"), "utt_key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_json", "rank")


def newest_snapshot(snapshots: DataFrame, namespace: str, step: str, body: str) -> DataFrame:
    return snapshots.groupBy(namespace).agg(F.max(step).alias(step), F.max_by(body, step).alias(body))


def restore(snapshots: DataFrame, body: str, slot_schema: str, elapsed: float = 0.0, slots: int | None = None) -> DataFrame:
    """One row per stored slot, its activation decayed for the time away; with ``slots``, trimmed or padded to so many (a padded slot is null, with activation 1)."""
    held = F.from_json(body, f"array<struct<{slot_schema.replace(', ', ',').replace(' ', ':')}>>")
    if slots is not None:
        empty = F.from_json(F.lit('{"activation": 1.0}'), f"struct<{slot_schema.replace(', ', ',').replace(' ', ':')}>")
        held = F.slice(F.concat(held, F.array_repeat(empty, slots)), 1, slots)
    rows = snapshots.select("*", F.posexplode(held).alias("slot_id", "slot")).select("*", "slot.*").drop("slot", body)
    return rows.withColumn("activation", cold_start(F.col("activation"), F.lit(elapsed)))


#: Tables of a store, and the column that version 2 added.
TABLES = {
    "records": "id string, namespace string, content string, topic string, source string, session_id string, importance double, entities string, created_at timestamp, archived int, embedding array<float>, version long",
    "tombstones": "id string, namespace string, superseded_by string, at timestamp",
    "loads": "id string, namespace string, at timestamp",
    "snapshots": "namespace string, step_count long, slots_json string, session_id string, created_at timestamp",
    "entities": "namespace string, name string, type string, description string, seq long",
    "relations": "namespace string, src string, dst string, type string, weight double, seq long",
}
ADDED = {"records": {"source": "string"}}


class ParquetStore:
    """Records, snapshots and graph events as append-only Parquet tables, one folder for each namespace (IO3-IO12, IO18, IO30, PF1).

    A write appends a version; reads take the newest of each id.  Readers see columns that were added later as null.
    """

    def __init__(self, spark: SparkSession, path: str, namespace: str = "default"):
        self.spark, self.path, self.namespace = spark, path.rstrip("/"), namespace

    def open(self) -> ParquetStore:
        """Create the tables that are not there."""
        for name in TABLES:
            try:
                self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}").schema  # noqa: B018
            except AnalysisException:
                self.spark.createDataFrame([], TABLES[name]).write.partitionBy("namespace").parquet(f"{self.path}/{name}")
        return self

    def close(self) -> None:
        """Nothing is held open."""

    def _append(self, name: str, rows: DataFrame) -> None:
        kinds = dict(x.split(" ", 1) for x in TABLES[name].split(", "))
        cols = [(F.lit(self.namespace) if c == "namespace" else F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        rows.select(*cols).write.mode("append").partitionBy("namespace").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        """This namespace's rows (its folder alone is read)."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}").filter(F.col("namespace") == self.namespace)

    def save(self, records: DataFrame, version: int) -> None:
        """Insert or replace by id; vectors, if any, go with their rows."""
        if "entities" in records.columns and dict(records.dtypes)["entities"] != "string":
            records = records.withColumn("entities", F.to_json("entities"))
        self._append("records", records.withColumn("version", F.lit(version)))

    def records(self) -> DataFrame:
        """The newest version of each record, archived ones marked."""
        newest = latest(self.table("records"), ["id"], "version")
        dead = self.table("tombstones").groupBy("id").agg(F.min("superseded_by").alias("superseded_by"), F.lit(1).alias("dead"))
        loads = access_counts(self.table("loads"), "id", "at").withColumnRenamed("last_loaded", "last_loaded_at")
        rows = newest.join(dead, "id", "left").join(loads, "id", "left")
        return records_view(rows.withColumn("archived", F.coalesce("dead", "archived", F.lit(0))).withColumn("load_count", F.coalesce("load_count", F.lit(0))).drop("dead"))

    def get(self, id: str) -> DataFrame:
        return self.records().filter(F.col("id") == id)

    def archive(self, ids: DataFrame) -> None:
        """``ids``: id, and superseded_by if there is a successor."""
        self._append("tombstones", ids.withColumn("at", F.current_timestamp()))

    def mark_loaded(self, ids: DataFrame) -> None:
        self._append("loads", ids.withColumn("at", F.current_timestamp()))

    def save_snapshot(self, slots: DataFrame, step: int, session: str = "") -> None:
        """``slots``: a row for each slot of the state, written as one JSON text."""
        body = slots.agg(F.to_json(F.collect_list(F.struct(*slots.columns))).alias("slots_json"))
        self._append("snapshots", body.select(F.lit(step).alias("step_count"), "slots_json", F.lit(session).alias("session_id"), F.current_timestamp().alias("created_at")))

    def load_snapshot(self) -> DataFrame:
        """The newest: step_count, slots_json."""
        return newest_snapshot(self.table("snapshots"), "namespace", "step_count", "slots_json").select("step_count", "slots_json")

    def checkpoint(self, slots: DataFrame, step: int, interval: int) -> bool:
        """A snapshot at every ``interval``-th step but the first (IO15)."""
        due = step > 0 and step % interval == 0
        if due:
            self.save_snapshot(slots, step)
        return due

    def export(self, slots: DataFrame, path: str, most: int = 10_000) -> None:
        """Status, active slots, and at most ``most`` records that are not archived, as JSON (IO16)."""
        records = self.records().filter("not archived")
        status = slots.agg(F.count_if(F.col("activation") > 0.5).alias("active_slots"), F.count(F.lit(1)).alias("used_slots")).crossJoin(records.agg(F.count(F.lit(1)).alias("records")))
        status.write.mode("overwrite").json(f"{path}/status")
        slots.write.mode("overwrite").json(f"{path}/slots")
        records.orderBy(F.desc("importance"), "id").limit(most).write.mode("overwrite").json(f"{path}/records")


class JdbcSink:
    """Records and snapshots into a database over JDBC (IO19): rows go to a staging table, and the upsert runs there.

    On a known id only the content changes.
    """

    UPSERT = "INSERT INTO {table} SELECT * FROM {staging} ON CONFLICT (id) DO UPDATE SET content = excluded.content"

    def __init__(self, url: str, **options: str):
        self.url, self.options = url, options

    def write(self, rows: DataFrame, table: str) -> str:
        """Appends to the staging table; returns the statement that merges it into ``table``."""
        rows.write.format("jdbc").options(url=self.url, dbtable=f"{table}_staging", **self.options).mode("append").save()
        return self.UPSERT.format(table=table, staging=f"{table}_staging")


class KeyValueMirror:
    """Slots of every namespace in a key-value server (IO20), as a foreachBatch sink: key prefix:namespace:slots, field slot id.

    ``connect`` gives a client with ``hset(key, field, value)`` and is called in every task.
    """

    def __init__(self, connect, prefix: str = "memoquarry"):
        self.connect, self.prefix = connect, prefix

    def key(self, namespace: str, suffix: str = "slots") -> str:
        return f"{self.prefix}:{namespace}:{suffix}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        connect, key = self.connect, self.key

        def put(rows):
            client = connect()
            for r in rows:
                client.hset(key(r["namespace"]), str(r["slot_id"]), r["state"])

        batch.select("namespace", "slot_id", "state").foreachPartition(put)
