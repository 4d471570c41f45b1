"""A folder of text files with a header as a source (posts by their rules, or any headed files by format("headed")), and write-once and text sinks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import MapType, StringType, StructField, StructType

from ..functions.text import WHITE_TEXT, frontmatter, slug_of
from ..operators.publishing import DATE, SLUG


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Published posts of the folder's .md files, the newest first; hash is that of the whole file.

    Files without a sound header, title, description, author or date are skipped, and so are those whose slug or published field is none.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_name").alias("file"))
    f = raw.select("file", "value", frontmatter(F.col("value")).alias("f"))
    field = lambda k: F.try_element_at("f.data", F.lit(k))
    posts = f.select(
        F.coalesce(field("slug"), slug_of(F.col("file"))).alias("slug"), field("title").alias("title"), field("description").alias("description"), field("date").alias("date"),
        F.coalesce(field("author"), F.lit("Team")).alias("author"), F.col("f.body").alias("content"), F.sha2("value", 256).alias("hash"), field("slug").alias("given"), F.coalesce(field("published"), F.lit("true")).alias("published"),
    )
    ok = (F.length("title") > 0) & (F.length("description") > 0) & (F.length("author") > 0) & F.col("date").rlike(DATE) & (F.col("published") == "true") & (F.col("given").isNull() | F.col("given").rlike(SLUG))
    return posts.filter(ok).drop("published", "given").orderBy(F.desc("date"), "slug")


#: Files whose headers make the schema of a headed folder, the first by name.
SAMPLED = 100


class HeadedFiles(DataSource):
    """spark.read.format("headed").load(folder): file, hash of the whole file, a text column for each header field, other fields by name, and body.

    Columns are the fields of the first SAMPLED files (option sampled); a field that only later files have is in others. Files without a sound header (see
    frontmatter) are skipped; option suffix, .md if not given. A partition reads filesPerPartition files (100).
    """

    @classmethod
    def name(cls) -> str:
        return "headed"

    def _number(self, name: str, otherwise: int) -> int:
        return int(self.options.get(name, self.options.get(name.lower(), str(otherwise))))

    def _files(self) -> list[str]:
        from pyarrow import fs

        path = self.options["path"]
        folder = path if "://" in path or path.startswith("file:") else f"file://{path}"
        store, at = fs.FileSystem.from_uri(folder)
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.endswith(self.options.get("suffix", ".md")))
        return [f"{folder.rstrip('/')}/{n}" for n in names]

    def schema(self) -> StructType:
        fields: dict[str, None] = {}
        for path in self._files()[: self._number("sampled", SAMPLED)]:
            headed = parse_headed(_whole(path))
            fields |= dict.fromkeys(headed[0] if headed else ())
        plain = [StructField(n, StringType()) for n in ("file", "hash")]
        return StructType([*plain, *[StructField(f, StringType()) for f in fields if f not in ("file", "hash", "others", "body")], StructField("others", MapType(StringType(), StringType())), StructField("body", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HeadedReader(self._files(), schema.names, self._number("filesPerPartition", 100))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _HeadedReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str], each: int):
        self.paths, self.names, self.each = paths, names, each

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.paths[i : i + self.each]) for i in range(0, max(1, len(self.paths)), self.each)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fields = self.names[2:-2]
        for path in partition.paths:
            raw = _whole(path)
            headed = parse_headed(raw)
            if headed:
                data, body = headed
                others = {k: v for k, v in data.items() if k not in fields}
                yield (path.rsplit("/", 1)[-1], hashlib.sha256(raw).hexdigest(), *[data.get(f) for f in fields], others, body)


def _whole(path: str) -> bytes:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def parse_headed(raw: bytes) -> tuple[dict[str, str], str] | None:
    """The header's fields and the body, by the rules of frontmatter: none without a block, or with a line that has no colon."""
    text = raw.decode("utf-8", "replace")
    lines = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?(.*)\Z", text, re.S)
    if not lines:
        return None
    data = {}
    for line in re.split(r"\r?\n", lines[1]):
        plain = line.strip(WHITE_TEXT)
        if plain and not plain.startswith("#"):
            name, colon, value = plain.partition(":")
            if not colon:
                return None
            value = value.strip(WHITE_TEXT)
            data[name.strip(WHITE_TEXT)] = re.sub(r"""^["'](.*)["']\Z""", r"\1", value)
    return data, lines[2]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeadedFiles)


def write_once(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key is not there yet: existing content is never changed, and a repeat is no error."""
    spark = rows.sparkSession
    own = rows.dropDuplicates([key])
    try:
        there = spark.read.parquet(path).select(key)
    except Exception as e:  # the path does not exist before the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = own.select(key).limit(0)
    own.join(there, key, "left_anti").write.mode("append").parquet(path)


def write_listing(tools: DataFrame, path: str) -> None:
    """A text listing, one line for each tool under its category's heading. Lines are sorted by the cluster, not gathered on the driver."""
    heads = tools.select("category").distinct().select("category", F.lit("").alias("name"), F.concat(F.lit("## "), "category").alias("value"))
    lines = tools.select("category", "name", F.concat(F.lit("- "), "title").alias("value"))
    heads.union(lines).orderBy("category", "name", "value").select("value").write.mode("overwrite").text(path)
