"""Reading and writing: line JSON, CSV of strings or of a schema, Parquet, checked files, manifests, graphs."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The schema of an extracted page.
PAGE = (
    "document_id string, page_number int, width double, height double, text string, "
    "blocks array<struct<block_id:int,bbox:array<double>,lines:array<struct<text:string,size:double,bold:boolean,bbox:array<double>>>,ocr_repaired:boolean>>, "
    "tables array<array<array<string>>>, figures array<struct<bbox:array<double>,ocr_text:string>>, "
    "repair_log array<struct<page:int,block_id:int,original_text:string,ocr_text:string>>, used_ocr boolean, extraction_method string, n_images int"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found) and len(found) > 0


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from line JSON; fields that a line lacks are null."""
    return spark.read.schema(PAGE).json(path)


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Line JSON of one file or a pattern of files, an empty table where nothing matches. Empty files add nothing."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else empty(spark, schema)


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with a header and quoted line breaks; all columns are strings without a schema; empty fields are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "")
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no table at {path}; build it first")
    return spark.read.parquet(path)


def checked_file(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The file's path, length and content, or an error where its hash is another. The hash is taken where the file lies."""
    files = spark.read.format("binaryFile").load(path)
    same = F.sha2("content", 256) == F.lit(sha256.lower())
    return files.select("path", "length", F.when(same, F.col("content")).otherwise(F.raise_error(F.lit("the file's hash is not the expected one")).cast("binary")).alias("content"))


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, file, bytes and sha256 of the files behind each name."""
    frames = [
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p)
        .select(F.lit(name).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        for name, p in paths.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_lines(df: DataFrame, path: str) -> None:
    """Line JSON with nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> int:
    """CSV with a header; arrays are written as ``;``-lists. Gives the number of rows written."""
    from pyspark.sql.types import ArrayType

    flat = df.select(*[F.array_join(f.name, ";").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the Parquet table at ``path`` does not hold yet; gives their number. Repeating it adds nothing."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def node_link(nodes: list[dict], edges: list[dict]) -> str:
    """A graph as node-link JSON. Nodes have id and attributes, edges source, target and attributes."""
    return json.dumps({"directed": False, "nodes": nodes, "links": edges}, ensure_ascii=False, sort_keys=True)


def graphml(nodes: list[dict], edges: list[dict]) -> str:
    """A graph as GraphML with typed attributes."""
    kinds: dict[tuple[str, str], str] = {}
    for what, rows, fixed in (("node", nodes, {"id"}), ("edge", edges, {"source", "target"})):
        for row in rows:
            for k, v in row.items():
                if k not in fixed and v is not None:
                    kinds[(what, k)] = "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
    ids = {key: f"d{i}" for i, key in enumerate(sorted(kinds))}

    def data(what: str, row: dict, fixed: set[str]) -> str:
        cells = [(ids[(what, k)], str(v).lower() if isinstance(v, bool) else str(v)) for k, v in row.items() if k not in fixed and v is not None]
        return "".join(f"<data key={quoteattr(k)}>{escape(v)}</data>" for k, v in cells)

    head = "".join(f'<key id={quoteattr(ids[k])} for={quoteattr(k[0])} attr.name={quoteattr(k[1])} attr.type={quoteattr(t)}/>' for k, t in sorted(kinds.items()))
    body = "".join(f"<node id={quoteattr(str(n['id']))}>{data('node', n, {'id'})}</node>" for n in nodes)
    body += "".join(f"<edge source={quoteattr(str(e['source']))} target={quoteattr(str(e['target']))}>{data('edge', e, {'source', 'target'})}</edge>" for e in edges)
    return f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{head}<graph edgedefault="undirected">{body}</graph></graphml>'
