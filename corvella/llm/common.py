"""Shared pieces of the training-data operators: tables, scratch folders, text units, file systems."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word in the contracts of the queries (tab to carriage return, and space).
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and Spark is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/corvella-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def lower_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES)


def crc32_mod(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; of the empty text for null."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def crc32_mod_py(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def open_fs(uri: str):
    """(file system, path) for tasks that write files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else "file://" + uri)


# White space other than " " and "\n" that some engine's \s matches, and the mark used in keys.
_ODD = "\\x00\\x1c-\\x1f"
_WIDE = "\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ODD_RE = re.compile(f"[{_ODD}{_WIDE}]")
_PLAIN_RE = re.compile("[\t\x0b\x0c\r]")
_UNIT = re.compile("[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")


def unit_keys(text: str) -> list[str] | None:
    """Cuts a text into units at which no match of the byte-level pre-tokenizer pattern crosses a cut.

    Key to text: after a leading NUL the rest; a key that starts with a line break is itself; any other
    has lost the space before it. None: the text holds rare white space and must be taken whole.
    """
    if "  " not in text and " \n" not in text and "\n " not in text and "\n\n" not in text:
        odd = any(c in text for c in "\t\r\x0b\x0c\x00\x1c\x1d\x1e\x1f") or (not text.isascii() and _ODD_RE.search(text))
        if not odd:
            parts = text.replace("\n", " \n").split(" ")
            parts[0] = "\x00" + parts[0]
            return parts
    if _ODD_RE.search(text):
        return None
    return ["\x00" + u for u in _UNIT.findall(text)]


def unit_text(key: str) -> str:
    first = key[:1]
    return key[1:] if first == "\x00" else key if first == "\n" else " " + key


_kept: dict[tuple, object] = {}


def kept_by_worker(make, *key):
    """What a worker process keeps from task to task, made once; only the last asked for, as operators follow each other."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


class Memo(dict):
    """A bounded cache: filled by make(key), emptied when it holds limit entries or 64 MB of keys."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, key):
        if len(self) >= self.limit or self.held > 64_000_000:
            self.clear()
            self.held = 0
        value = self.make(key)
        if len(key) < 10_000:
            self.held += len(key)
            self[key] = value
        return value
