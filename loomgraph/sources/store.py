"""The engine's tables on shared storage: fixed schemas, versions, partitioned vectors, key-value rows, step states, sheets, judgments.

A write makes a new version folder; a reader takes the last one that has its `_SUCCESS` marker, so a job that dies leaves the version
before it in force. Columns that a schema has gained since a version was written are read as null.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import positions

#: The tables of a build, by name.
SCHEMAS = {
    "paragraphs": "paragraph long, lang string, volume string, volume_num int, section string, chapter string, chapter_key long, paragraph_idx int, text string, text_norm string, anchor string, summary string",
    "sentences": "paragraph long, sentence_idx int, text string, lang string",
    "concepts": "concept long, label string, n_mentions long",
    "concept_aliases": "concept long, lang string, alias string",
    "entities": "entity long, label string, type string",
    "paragraph_entities": "paragraph long, entity long",
    "paragraph_concepts": "paragraph long, concept long, relation string, weight double",
    "concept_edges": "src long, dst long, relation string, weight double",
    "stats": "key string, value string",
    "concept_snapshot": "text_norm string, lang string, extractor_tag string, summary string, concepts_json string, entities_json string",
    "alias_snapshot": "label string, lang string, alias string",
}
#: What a wipe leaves: the snapshots that a new parse is warmed from.
KEPT = ("concept_snapshot", "alias_snapshot")
VECTORS = "node long, vec array<double>, node_kind string, lang string"
STATES = ("started", "progress", "done")
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-store-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new shared folder and read again, for what several later steps read."""
    path = f"{shared_root(df.sparkSession)}/loomgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas or SCHEMAS

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self, name: str) -> list[int]:
        """Versions that were written whole, in rising order."""
        store, at = self._at(f"{self.root}/{name}")
        if not store.exists(at):
            return []
        found = [(s.getPath().getName(), self._at(f"{self.root}/{name}/{s.getPath().getName()}/_SUCCESS")[1]) for s in store.listStatus(at)]
        return sorted(int(n[1:]) for n, marker in found if n[:1] == "v" and n[1:].isdigit() and store.exists(marker))

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes the columns of the table's schema as a new version and reads it back; versions but the last two are removed."""
        have = self.versions(name)
        n = have[-1] + 1 if have else 0
        kinds = self.spark.createDataFrame([], self.schemas[name]).schema
        missing = [f.name for f in kinds if f.name not in rows.columns]
        if missing:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.mode("overwrite").parquet(f"{self.root}/{name}/v{n:08d}")
        for old in have[:-1]:
            store, at = self._at(f"{self.root}/{name}/v{old:08d}")
            store.delete(at, True)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        have = self.versions(name)
        if not have:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}/v{have[-1]:08d}")

    def wipe(self, *names: str) -> None:
        """Removes tables, all but the snapshots where none is named."""
        for name in names or [n for n in self.schemas if n not in KEPT]:
            store, at = self._at(f"{self.root}/{name}")
            store.delete(at, True)

    # vectors

    def write_vectors(self, rows: DataFrame, append: bool = False) -> None:
        """Rows replace the vectors of the kinds and languages that they have, or add to them; the others stay. No language is the text `-`."""
        held = rows.select("node", F.col("vec").cast("array<double>"), "node_kind", F.coalesce("lang", F.lit("-")).alias("lang"))
        w = held.write.partitionBy("node_kind", "lang").option("partitionOverwriteMode", "dynamic")
        w.mode("append" if append else "overwrite").parquet(f"{self.root}/vectors")

    def vectors(self, kind: str | None = None, lang: str | None = None) -> DataFrame:
        """(node, vec, node_kind, lang); kind and lang prune folders."""
        store, at = self._at(f"{self.root}/vectors")
        if not store.exists(at):
            return self.spark.createDataFrame([], VECTORS)
        v = self.spark.read.schema(VECTORS).parquet(f"{self.root}/vectors")
        v = v.where(F.col("node_kind") == kind) if kind else v
        v = v.where(F.col("lang") == lang) if lang else v
        return v.withColumn("lang", F.nullif(F.col("lang"), F.lit("-")))

    def vector_of(self, nodes: DataFrame, kind: str, lang: str | None = None) -> DataFrame:
        """(node, vec) of the given nodes. nodes: node."""
        return self.vectors(kind, lang).join(nodes.select("node").distinct(), "node").select("node", "vec")

    # step states

    def mark(self, step: str, state: str, done: int = 0, total: int = 0, note: str = "") -> None:
        """Appends a state of a step; `started` resets its progress."""
        if state not in STATES:
            raise ValueError(state)
        row = self.spark.range(1).select(F.lit(step).alias("step"), F.lit(state).alias("state"), F.lit(done).cast("long").alias("progress"), F.lit(total).cast("long").alias("total"), F.lit(note).alias("note"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(f"{self.root}/steps")

    def steps(self) -> DataFrame:
        """(step, state, progress, total, note, at): the last state of each step."""
        kinds = "step string, state string, progress long, total long, note string, at timestamp"
        store, at = self._at(f"{self.root}/steps")
        rows = self.spark.read.schema(kinds).parquet(f"{self.root}/steps") if store.exists(at) else self.spark.createDataFrame([], kinds)
        rank = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (s, i)])[F.col("state")]
        last = Window.partitionBy("step").orderBy(F.desc("at"), F.desc(rank), F.desc("progress"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def finished(self, step: str) -> bool:
        return bool(self.steps().where((F.col("step") == step) & (F.col("state") == "done")).limit(1).count())


# sheets and judgments

_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_sheet(items: DataFrame, path: str, text_col: str = "paragraph_text", most: int = 1200) -> None:
    """A CSV sheet to annotate, with a header; texts are cut to `most` characters and stay whole over line breaks."""
    cut = items.withColumn(text_col, F.substring(F.col(text_col), 1, most))
    cut.write.mode("overwrite").options(**_CSV).option("quoteAll", True).csv(path)


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).option("multiLine", True).csv(path)


def write_judgments(judgments: DataFrame, path: str) -> None:
    """judgments: user, item, judgment (0 or 1). One JSON object per user: {userid, judgments: {item: 0 or 1}}."""
    lists = F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", F.col("judgment").cast("int").alias("judgment")))))
    judgments.groupBy(F.col("user").alias("userid")).agg(lists.alias("judgments")).write.mode("overwrite").json(path)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, judgment): entries that are 0 or 1; objects that cannot be read or name no user are skipped."""
    raw = spark.read.schema("userid string, judgments map<string, string>").option("mode", "DROPMALFORMED").json(path)
    entries = raw.where("userid IS NOT NULL").select(F.col("userid").alias("user"), F.explode("judgments").alias("item", "judgment"))
    return entries.where(F.col("judgment").isin("0", "1")).withColumn("judgment", F.col("judgment").cast("int"))


def progress(items: DataFrame, judgments: DataFrame) -> DataFrame:
    """(user, n_judged, next_item): how far each user is, and the first item in order of its number that is not judged, null when none is left.

    The first place in the order that a user's judged places leave out is found from these places alone.
    """
    sheet = positions(items.select(F.col("item").cast("long").alias("number"), F.col("item").cast("string").alias("item")).distinct(), "number", "place")
    done = judgments.select("user", F.col("item").cast("string").alias("item")).distinct()
    counted = done.groupBy("user").agg(F.count("*").alias("n_judged"))
    own = done.join(sheet.select("item", "place"), "item").select("user", "place")
    # places 0 to m - 1 are judged without a gap exactly where the m-th judged place is m
    n = F.row_number().over(Window.partitionBy("user").orderBy("place")) - 1
    first = own.withColumn("n", n).groupBy("user").agg(F.count(F.when(F.col("n") == F.col("place"), 1)).alias("place"))
    left = counted.join(first, "user", "left").select("user", "n_judged", F.coalesce("place", F.lit(0)).cast("long").alias("place"))
    return left.join(sheet.select("place", F.col("item").alias("next_item")), "place", "left").select("user", "n_judged", "next_item")
