"""Reading and writing the feeds: CSV and JSON with a schema, pages with front matter, runbooks, keyed and append-only tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV feed with a header; a row that doesn't fit the schema keeps its text in ``_bad``."""
    return spark.read.schema(f"{schema}, _bad string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Rows of a JSON feed, one object a line or one array a file."""
    return spark.read.schema(f"{schema}, _bad string").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_bad").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, title, body) of markdown pages: ``key: value`` lines between two rules of dashes, then the body.

    A page without such a head has an empty map; the title is meta's, else the first heading."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    x = x.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.transform(F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_]+): *(.*)$"), F.lit(0)), lambda l: F.struct(F.regexp_extract(l, r"^([A-Za-z_]+):", 1), F.trim(F.regexp_extract(l, r"^[A-Za-z_]+: *(.*)$", 1))))
    x = x.withColumns({"meta": F.map_from_entries(pairs), "body": F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")})
    return x.select("path", "meta", F.coalesce(F.col("meta")["title"], F.nullif(F.regexp_extract("body", r"(?m)^# +(.*)$", 1), F.lit(""))).alias("title"), "body")


def split_sections(pages: DataFrame, level: int = 2) -> DataFrame:
    """(path, position, heading, text): a runbook's parts at headings of a level; what stands before has an empty heading."""
    mark = "#" * level
    parts = F.split("body", rf"(?m)^(?={mark} )")
    x = pages.select("path", F.posexplode(parts).alias("position", "part"))
    heading = F.regexp_extract("part", rf"\A{mark} +([^\n]*)", 1)
    return x.select("path", "position", heading.alias("heading"), F.regexp_replace(F.regexp_replace("part", rf"\A{mark} [^\n]*\n?", ""), r"\A\s+|\s+\z", "").alias("text")).filter("heading <> '' OR text <> ''")


def write_pages(pages: DataFrame, path: str, by: str = "status") -> None:
    """Pages as a Parquet table in folders by status, so readers of approved pages skip the rest."""
    pages.write.mode("overwrite").partitionBy(by).parquet(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def upserted(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table after changes: for each key the row with the greatest ``order``; of equal ones a change wins, then
    the row whose values sort last. Rows with a null key stay as they are."""
    cols = table.columns
    both = table.select(*cols).withColumn("_new", F.lit(0)).union(changes.select(*cols).withColumn("_new", F.lit(1)))
    kept = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, "_new", F.to_json(F.struct(*cols)))).alias("r"))
    return kept.select("r.*").union(both.filter(F.col(key).isNull()).select(*cols))


class _Log:
    """Commits of an append-only table: file ``_log/<number>.json`` says which staged folder comes next.

    A number is claimed by creating its file, which fails where another writer was faster. Staged files move into
    the table after that; whoever comes next ends a move that was broken off."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def commits(self) -> list[str]:
        return [n for n in self.names("_log") if n.endswith(".json")]

    def highest(self) -> tuple[int, int | None]:
        """Number of commits, and the last number of the newest one."""
        done = self.commits()
        if not done:
            return 0, None
        stream = self.fs.open(self.at(f"_log/{done[-1]}"))
        try:
            return len(done), json.loads(stream.readLine())["high"]
        finally:
            stream.close()

    def claim(self, number: int, entry: dict) -> bool:
        try:
            out = self.fs.create(self.at(f"_log/{number:09d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def settle(self) -> None:
        """Moves what committed batches still have in their staging folders."""
        staged = set(self.names("_staged"))
        for commit in self.commits() if staged else []:
            stream = self.fs.open(self.at(f"_log/{commit}"))
            folder = json.loads(stream.readLine())["folder"]
            stream.close()
            if folder in staged:
                for name in self.names(f"_staged/{folder}"):
                    if name.startswith("part-"):
                        self.fs.rename(self.at(f"_staged/{folder}/{name}"), self.at(f"{folder}-{name}"))
                self.fs.delete(self.at(f"_staged/{folder}"), True)


def append_audit(rows: DataFrame, path: str, seq: str = "seq") -> None:
    """Adds rows to an append-only log; numbers that are not beyond the log's last are refused as a whole.

    Rows are staged first; then a commit claims the next place in the log, or is tried again behind the writer that
    took it. So of two writers with the same numbers one is refused, and readers never see half a batch but while
    its files move. Null numbers and an empty batch are refused too."""
    spark = rows.sparkSession
    log, folder = _Log(spark, path), uuid.uuid4().hex
    staged = f"{log.path}/_staged/{folder}"
    rows.write.parquet(staged)
    low, high, n, different = spark.read.schema(rows.schema).parquet(staged).agg(F.min(seq), F.max(seq), F.count("*"), F.count_distinct(seq)).first()
    try:
        if not n or n != different:
            raise ValueError("an append-only log takes new, different numbers only")
        before = None
        while True:
            number, last = log.highest()
            if not number and before is None and any(f.startswith("part-") for f in log.names("")):
                before = spark.read.parquet(path).agg(F.max(seq)).first()[0]
            last = before if last is None else last
            if last is not None and low <= last:
                raise ValueError("an append-only log takes new, different numbers only")
            if log.claim(number, {"low": low, "high": high, "n": n, "folder": folder}):
                break
    except ValueError:
        log.fs.delete(log.at(f"_staged/{folder}"), True)
        raise
    log.settle()


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of an append-only log."""
    _Log(spark, path).settle()
    return spark.read.parquet(path)


def numbered(rows: DataFrame, order: str, prefix: str = "CASE-", start: int = 1, ranges: int = 32) -> DataFrame:
    """Adds ``id``, numbers in the order of a column (nulls first, ties by the row), six digits or more.

    Rows are dealt to ranges and written once, so that counts and numbers read the same ranges; each range is
    numbered apart behind the counts of those before it. Repeated rows get numbers of their own; a column named
    ``id`` is replaced."""
    kept = [c for c in rows.columns if c != "id"]
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    x = rows.select(row, F.col(f"`{order}`").alias("o"), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("h"))
    x = written(x.repartitionByRange(ranges, "o", "h").withColumn("p", F.spark_partition_id()), "numbered")
    per = x.groupBy("p").agg(F.count("*").alias("n"))
    # one row a range
    per = per.select(F.col("p").alias("q"), F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("p").orderBy("o", "h"))
    number = (F.col("before") + F.col("k") + start - 1).cast("string")
    x = x.withColumn("k", k).join(F.broadcast(per), F.col("p") == F.col("q"))
    return x.select(*[F.col("row")[c].alias(c) for c in kept], F.concat(F.lit(prefix), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)).alias("id"))


def evidence(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations with the title and status of the page version that they name; unknown ones stay, with nulls."""
    return citations.join(pages.select("policy_id", "version", "title", "status"), ["policy_id", "version"], "left")
