"""Files as tables: discovery, kinds, contents and what a parser makes of them. Errors are a column, not an end."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import clean
from lectern.operators.layout import WORD
from lectern.operators.storage import numbered

PDF = b"%PDF-"


def is_kind(content: Column, magic: bytes = PDF) -> Column:
    """Whether a file begins with the mark of its kind."""
    return F.coalesce(F.substring(content, 1, len(magic)) == F.lit(bytearray(magic)), F.lit(False))


def _start(path: str, n: int) -> bytes:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        with open("/" + rest.lstrip("/"), "rb") as local:
            return local.read(n)
    system, at = FileSystem.from_uri(quote(path, safe=":/@"))
    with system.open_input_stream(at) as stream:
        return stream.read(n)


def kinds(files: DataFrame, **magics: bytes) -> DataFrame:
    """Files (path, length) with a column for each mark: whether a file begins with it. Only the first bytes are read, however
    large a file is."""
    n = max(map(len, magics.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts = [_start(path, n) for path in batch["path"]]
            yield batch.assign(**{name: [s.startswith(magic) for s in starts] for name, magic in magics.items()})

    return files.select("path", "length").mapInPandas(run, "path string, length bigint, " + ", ".join(f"{name} boolean" for name in magics))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all files below a folder that hold anything; empty ones aren't listed. Only asked columns are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")


def discovered(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """(path, length) of the files with a suffix, in any case, below a folder. No such folder is an error."""
    return contents(spark, root).drop("content").where(F.lower("path").endswith(suffix.lower()))


def targets(spark: SparkSession, paths: list[str], suffix: str = ".pdf", magic: bytes = PDF) -> DataFrame:
    """(place, path, error) of given files and folders, in the order given, each file once, where it came first.

    Folders give the files with the suffix below them, sorted. A given file of another kind has an error.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = None
    for k, path in enumerate(paths):
        where = hadoop(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            raise FileNotFoundError(path)
        nothing = F.lit(None).cast("string")
        if fs.getFileStatus(where).isDirectory():
            rows = discovered(spark, path, suffix).select("path", nothing.alias("error"))
        else:
            rows = kinds(contents(spark, path).drop("content"), fits=magic).select("path", F.when(~F.col("fits"), "not a file of this kind").alias("error"))
        rows = rows.withColumn("given", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    first = out.groupBy("path").agg(F.min("given").alias("given"), F.max("error").alias("error"))
    return numbered(first, [F.col("given"), F.col("path")], "place").select("place", "path", "error")


def hashed(files: DataFrame) -> DataFrame:
    """Files with ``sha`` of their bytes."""
    return files.withColumn("sha", F.sha2("content", 256))


def words_of(files: DataFrame, parse: Callable[[bytes], Iterable[dict]], magic: bytes = PDF) -> DataFrame:
    """Word boxes (with path and error) of files (path, doc_id, content) by a parser of bytes.

    The parser yields dicts of page, x0, y0, x1, y1, text, width, height and, if it knows them,
    block, line, word, source_text. A file that isn't one, or breaks the parser, is one row with an
    error and no word; words read before the break are left out.
    """
    names = [c.split()[0] for c in WORD.split(", ") if not c.startswith("doc_id")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, doc, content in zip(batch["path"], batch["doc_id"], batch["content"]):
                base = {"path": path, "doc_id": doc}
                try:
                    if not bytes(content or b"").startswith(magic):
                        raise ValueError("not a file of this kind")
                    rows += [base | {n: w.get(n) for n in names} for w in list(parse(bytes(content)))]
                except Exception as e:  # a bad file is a row, the batch goes on
                    rows.append(base | {"error": str(e) or type(e).__name__})
            frame = pd.DataFrame(rows, columns=["path", "doc_id", *names, "error"])
            yield frame.astype({n: "Int32" for n in ("page", "block", "line", "word")} | {n: object for n in ("path", "text", "source_text", "error")})

    return files.select("path", "doc_id", "content").mapInPandas(run, f"path string, {WORD}, error string")


_ENTRY = re.compile(rb"/(Title|Author)\s*\(((?:\\.|[^\\()])*)\)")
_ESCAPE = re.compile(rb"\\(.)", re.DOTALL)


def _document_info(contents_: pd.Series) -> pd.DataFrame:
    rows = []
    for content in contents_:
        found = {k.decode(): _ESCAPE.sub(rb"\1", v) for k, v in _ENTRY.findall(bytes(content or b""))}
        rows.append({k.lower(): None if v is None else v.decode("utf-16") if v.startswith((b"\xfe\xff", b"\xff\xfe")) else v.decode("latin-1") for k, v in ((k, found.get(k)) for k in ("Title", "Author"))})
    return pd.DataFrame(rows, columns=["title", "author"])


def embedded_metadata(files: DataFrame) -> DataFrame:
    """(path, title, authors) from the plain information dictionary of PDF files; titles that are none are null."""
    from lectern.functions.metadata import is_bad_title

    info = F.pandas_udf(_document_info, "title string, author string")(F.col("content"))
    told = files.select("path", info.alias("i")).select("path", clean(F.col("i.title")).alias("title"), clean(F.col("i.author")).alias("authors"))
    return told.withColumn("title", F.when(~is_bad_title(F.col("title")), F.col("title")))


def ingested(files: DataFrame, known: DataFrame, parse: Callable[[bytes], Iterable[dict]]) -> tuple[DataFrame, DataFrame]:
    """Outcomes (path, sha, outcome, error) of files (path, content), and their word boxes.

    Content that is known, or that another file of the batch has, is "existing"; of equal files the
    first path is the one created. Files that can't be parsed have failed; the others aren't held up.
    """
    named = hashed(files).withColumn("doc_id", F.xxhash64("sha"))
    first = named.groupBy("sha").agg(F.min("path").alias("__first"))
    marked = named.join(first, "sha").join(known.select("sha").distinct().withColumn("__known", F.lit(True)), "sha", "left")
    fresh = marked.where((F.col("path") == F.col("__first")) & F.col("__known").isNull())
    words = words_of(fresh, parse)
    failed = words.where("error is not null").select("path", "error")
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("__known").isNotNull() | (F.col("path") != F.col("__first")), "existing").otherwise("created")
    return marked.drop("content").join(failed, "path", "left").select("path", "sha", outcome.alias("outcome"), "error"), words.where("error is null").drop("error", "path")
