"""From blocks of a page to volumes, sections, chapters, paragraphs and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def forward_filled(df: DataFrame, value: Column, partition: list[str], order: list[str], out: str) -> DataFrame:
    """The last non-null value so far within a partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def sessions(df: DataFrame, partition: list[str], order: list[str], key: list[str], out: str) -> DataFrame:
    """Numbers runs of consecutive rows with equal keys from 1; the same key later opens a new run."""
    w = Window.partitionBy(*partition).orderBy(*order)
    same = F.lit(True)
    for k in key:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    new = F.when((F.row_number().over(w) > 1) & same, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def asof(rows: DataFrame, marks: DataFrame, at: str, start: str, partition: list[str], values: list[str]) -> DataFrame:
    """Each row with the values of the last mark whose start is at or before it, null before the first.

    Both sides meet in one sorted run per partition, so neither is broadcast and no row is compared with all marks.
    """
    cols = [c for c in rows.columns if c not in partition]
    left = rows.select(*partition, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), *[F.lit(None).cast(dict(marks.dtypes)[v]).alias(v) for v in values], F.lit(None).cast("boolean").alias("_mark"))
    right = marks.select(*partition, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *values, F.lit(True).alias("_mark"))
    w = Window.partitionBy(*partition).orderBy("_at", "_side", *values).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_mark"), F.struct(*values)), ignorenulls=True).over(w)
    return left.unionByName(right).withColumn("_held", held).where("_side = 1").select(*partition, *[F.col(f"_row.{c}").alias(c) for c in cols], *[F.col(f"_held.{v}").alias(v) for v in values])


def chapters(blocks: DataFrame) -> DataFrame:
    """Paragraph rows of pages in the first shape: volume, section, chapter, chapter_id, paragraph_idx, text, offset, anchor.

    A volume heading resets section and chapter ordinal; a section replaces, a subsection is appended to the section.
    Chapters count even without paragraphs; paragraphs are numbered after those without meaningful text are dropped.
    """
    page = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_volume = F.col("kind") == "volume"
    b = blocks.withColumn("island", F.sum(is_volume.cast("int")).over(page))
    named = F.when(F.length("text") > 0, F.col("text"))
    b = b.withColumn("volume", F.coalesce(F.last(F.when(is_volume, F.coalesce(named, F.lit("Unknown Volume"))), ignorenulls=True).over(page), F.lit("Unknown Volume")))
    island = Window.partitionBy("id", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("root", F.last(F.when(F.col("kind") == "section", F.struct(named.alias("s"))), ignorenulls=True).over(island)["s"])
    joined = F.when(F.col("kind") == "section", F.struct(named.alias("s"))).when((F.col("kind") == "subsection") & (F.length("text") > 0), F.struct(F.concat_ws(" / ", "root", "text").alias("s")))
    b = b.withColumn("section", F.last(joined, ignorenulls=True).over(island)["s"])
    is_chapter = F.col("kind") == "chapter"
    b = b.withColumn("ordinal", F.sum(is_chapter.cast("int")).over(island) - 1)
    own = Window.partitionBy("id", "container").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = T.volume_number(F.col("volume"))
    given = F.first(F.when(is_chapter, F.col("anchor")), ignorenulls=True).over(own)
    b = b.withColumn("chapter_id", F.when(F.length(given) > 0, given).otherwise(F.concat(F.lit("ch_"), number.cast("string"), F.lit("_"), F.col("ordinal").cast("string"))))
    b = b.withColumn("chapter", F.coalesce(F.first(F.when((F.col("kind") == "title") & F.col("classes").contains("in:chapter"), F.col("text")), ignorenulls=True).over(own), F.lit("Untitled")))
    kept = b.where((F.col("kind") == "p") & F.col("classes").contains("in:chapter-content") & ~F.col("classes").rlike(r"(^|[^:\w-])(chapter-breadcrumb|nav)(\s|$)") & T.meaningful(F.col("text")))
    order = Window.partitionBy("id", "container").orderBy("pos")
    return kept.select("id", "volume", T.volume_number(F.col("volume")).alias("volume_num"), "section", "chapter", "chapter_id", (F.row_number().over(order) - 1).alias("paragraph_idx"), "text", "offset", "anchor", "pos")


#: The heading that opens a volume of the second shape, its number, a volume's name, and the title of a chapter without one.
VOLUME_MARK = (r"স্বামী\s+বিবেকানন্দ\s+সমগ্র\s+(খন্ড|খণ্ড)\s+[০-৯0-9]+", r"(?:খন্ড|খণ্ড)\s+([০-৯0-9]+)", "খণ্ড ")
UNTITLED = "(শিরোনামহীন)"


def items(blocks: DataFrame, mark: tuple[str, str, str] = VOLUME_MARK, untitled: str = UNTITLED) -> DataFrame:
    """Paragraph rows of pages in the second shape; the volume comes from the last marker heading before the container, the first volume where there is none.

    mark: pattern of a marker heading, pattern whose first group is its number, and what a volume's name starts with. Paragraphs outside of containers are left out.
    """
    any_item = F.max((F.col("kind") == "item").cast("int")).over(Window.partitionBy("id"))
    b = blocks.withColumn("wanted", F.when(any_item == 1, "item").otherwise("block"))
    marks = b.where((F.col("kind") == "h3") & F.col("text").rlike(mark[0]))
    number = F.regexp_extract("text", mark[1], 1)
    marks = marks.select("id", F.col("offset").alias("start"), F.concat(F.lit(mark[2]), number).alias("volume"), T.bengali_to_int(number).alias("volume_num"))
    own = Window.partitionBy("id", "container").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.when(F.col("kind") == F.col("wanted"), F.struct("anchor", "offset")), ignorenulls=True).over(own)
    title = F.first(F.when((F.col("kind") == "h2") & (F.length("text") > 0), F.col("text")), ignorenulls=True).over(own)
    b = b.withColumns({"head": head, "chapter": F.coalesce(title, F.lit(untitled))})
    inside = F.col("classes").rlike(r"(^|\s)in:bb-item(\s|$)") & (F.col("wanted") == "item") | F.col("classes").rlike(r"(^|\s)in:content-block(\s|$)") & (F.col("wanted") == "block")
    b = b.where(F.col("head").isNotNull() & (F.col("kind") == "p") & inside & T.meaningful(F.col("text")))
    b = b.select("id", "container", "pos", "text", "offset", "anchor", "chapter", F.col("head.anchor").alias("chapter_id"), F.col("head.offset").alias("from"))
    b = b.withColumn("paragraph_idx", F.row_number().over(Window.partitionBy("id", "container").orderBy("pos")) - 1)
    found = asof(b, marks, "from", "start", ["id"], ["volume", "volume_num"])
    return found.withColumns({"volume": F.coalesce("volume", F.lit(mark[2] + "১")), "volume_num": F.coalesce("volume_num", F.lit(1))})


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, paragraph_idx, text): lines of documents with meaningful text."""
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("text", T.clean_ws(F.col("raw")))
    kept = lines.where(T.meaningful(F.col("text")))
    return kept.select("doc_id", "lang", "source", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1).alias("paragraph_idx"), "text")


def chapter_text(paras: DataFrame, keys: list[str], title: Column, cap: int = 16_384, least: int = 20) -> DataFrame:
    """(keys, text): the title, a blank line, and a chapter's paragraphs in order, cut to `cap` characters.

    A paragraph has `least` characters or more, so only so many of a chapter's first ones can show, and no more are gathered.
    """
    shown = paras.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("paragraph_idx"))).where(F.col("_n") <= cap // (least + 1) + 1)
    before = F.sum(F.length("text") + 1).over(Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
    shown = shown.withColumn("_title", title).withColumn("_at", F.coalesce(before, F.lit(0))).where(F.col("_at") <= cap)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda p: p["text"]), " ")
    return shown.groupBy(*keys).agg(F.concat(F.min_by("_title", "_n"), F.lit("\n\n"), F.substring(body, 1, cap)).alias("text"))


def first_n(paras: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    return paras.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("rank") <= n)


def paragraphs_dim(paras: DataFrame, chapters_: DataFrame, volumes: DataFrame, books: DataFrame) -> DataFrame:
    """The hierarchy joined once, to be written partitioned by language; the dimensions are left to the optimizer's size check."""
    return paras.join(chapters_, "chapter_id").join(volumes, "volume_id").join(books, "book_id")


def loaded(rows: DataFrame, book: list[str], volume: list[str], chapter: list[str], paragraph: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Books, volumes, chapters and paragraphs of flat rows, each natural key once, with ids that depend on the keys alone.

    A volume is known by its book and its own columns, a chapter by its volume's and its own; the ids are hashes of these.
    """
    of = lambda *keys: F.xxhash64(*[k for x in keys for k in x])
    books = rows.select(of(book).alias("book_id"), *book).dropDuplicates(["book_id"])
    volumes = rows.select(of(book, volume).alias("volume_id"), of(book).alias("book_id"), *volume).dropDuplicates(["volume_id"])
    chapters_ = rows.select(of(book, volume, chapter).alias("chapter_id"), of(book, volume).alias("volume_id"), *chapter).dropDuplicates(["chapter_id"])
    rest = [c for c in rows.columns if c not in {*book, *volume, *chapter}]
    return books, volumes, chapters_, rows.select(of(book, volume, chapter).alias("chapter_id"), *rest).dropDuplicates([paragraph])


def write_dim(dim: DataFrame, path: str) -> None:
    """The joined hierarchy, one folder a language. dim: lang, ..."""
    dim.write.mode("overwrite").partitionBy("lang").parquet(path)


def read_dim(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """The joined hierarchy; of one language alone its folder is read."""
    dim = spark.read.parquet(path)
    return dim.where(F.col("lang") == lang) if lang is not None else dim
