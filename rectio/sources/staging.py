"""Inputs, whatever they are: files, folders, globs, remote paths, URLs, streams and literals.

Files are listed with Hadoop's file systems, so remote ones too, and each file's first bytes tell
whether Spark's sources can read it. Plain text, and gzip or bzip2 under its usual name, is left to
Spark; what is zipped, renamed or in UTF-16 or UTF-32 passes through a copy in the folder that
the cluster shares. Lines in other charsets are decoded where they are read.
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import lzma
import os
import shutil
import tarfile
import tempfile
import urllib.parse
import urllib.request
import uuid
import warnings
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession

# First bytes of compressed files.
MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"PK\x03\x04": "zip", b"PK\x05\x06": "zip"}
BOMS = [(b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")]
_SUFFIX = {"gzip": ".gz", "bzip2": ".bz2"}
_ARCHIVES = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


@dataclass(frozen=True)
class I:  # noqa: E742
    """Literal data: a text, lines, or bytes."""

    data: str | bytes | list[str]


@dataclass(frozen=True)
class Input:
    """What Spark reads, what the caller calls it, and the files behind it, the one to look at first in front."""

    path: str
    shown: str
    files: tuple[str, ...]

    @property
    def first(self) -> str:
        return self.files[0]


def detect_compression(head: bytes) -> str | None:
    return next((kind for magic, kind in MAGIC.items() if head.startswith(magic)), None)


def charset_of(encoding: str) -> str | None:
    """The charset's usual name, None for UTF-8 and what it includes."""
    name = codecs.lookup(encoding).name.upper()
    return None if name in ("UTF-8", "ASCII") else name


def is_wide(charset: str | None) -> bool:
    """Whether a line feed isn't the one byte that Spark splits lines at."""
    return bool(charset) and charset.startswith(("UTF-16", "UTF-32"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that the executors see: below ``spark.checkpoint.dir``, or on a local master a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"rectio-{name}-")


def publish(spark: SparkSession, local: str, name: str) -> str:
    """Copy a local file to the shared folder; its path there."""
    target = f"{shared_folder(spark, 'staged')}/{uuid.uuid4().hex}/{name}"
    path, fs = _fs(spark, target)
    fs.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), path)
    return target


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, source: str) -> list[tuple[str, int]]:
    """Paths and lengths of the files that Spark would read, by name."""
    path, fs = _fs(spark, source)
    found = fs.globStatus(path)
    if not found:
        raise FileNotFoundError(f"'{source}' does not exist")
    out = []
    for status in found:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [(s.getPath().toString(), s.getLen()) for s in inside if s.isFile() and (s is status or s.getPath().getName()[0] not in "._")]
    return sorted(out)


def first_bytes(spark: SparkSession, file: str, n: int, plain: bool = False) -> bytes:
    """The first ``n`` bytes of a file; with ``plain`` of what it holds, where its name tells the compression."""
    path, fs = _fs(spark, file)
    stream = fs.open(path)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(path) if plain else None
        return bytes((codec.createInputStream(stream) if codec else stream).readNBytes(n))
    finally:
        stream.close()


def _local(path: str) -> str | None:
    plain = urllib.parse.unquote(path.removeprefix("file://").removeprefix("file:")) if path.startswith("file:") else path
    return plain if os.path.isfile(plain) else None


def _plain(local: str, kind: str | None, into: str) -> str:
    """A decompressed copy; of an archive with several members the first one."""
    out = os.path.join(into, "data.txt")
    if kind == "zip":
        with zipfile.ZipFile(local) as z, open(out, "wb") as f:
            members = [n for n in z.namelist() if not n.endswith("/")]
            if len(members) > 1:
                warnings.warn(f"several files in the archive, using '{members[0]}'", stacklevel=4)
            with z.open(members[0]) as source:
                shutil.copyfileobj(source, f)
        return out
    opened = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}.get(kind, open)
    with opened(local, "rb") as source, open(out, "wb") as f:
        shutil.copyfileobj(source, f)
    if tarfile.is_tarfile(out):
        with tarfile.open(out) as t, open(out + ".member", "wb") as f:
            shutil.copyfileobj(t.extractfile(next(m for m in t if m.isfile())), f)
        os.replace(out + ".member", out)
    return out


def _odd(name: str, head: bytes, charset: str | None) -> str | None:
    """Why a file needs a copy, if it does: its charset, or its compression."""
    kind = detect_compression(head)
    wide = next((e for bom, e in BOMS if head.startswith(bom) and e != "UTF-8"), charset if is_wide(charset) else None)
    if wide and kind is None:
        return wide
    if kind in ("zip", "xz") or name.endswith(_ARCHIVES) or not name.endswith(_SUFFIX.get(kind, "")):
        return kind or "archive"
    return wide


def _copied(spark: SparkSession, local: str, reason: str, charset: str | None) -> str:
    into = tempfile.mkdtemp(prefix="rectio-")
    with open(local, "rb") as f:
        kind = detect_compression(f.read(8))
    plain = _plain(local, kind, into)
    with open(plain, "rb") as f:
        head = f.read(8)
    wide = next((e for bom, e in BOMS if head.startswith(bom) and e != "UTF-8"), reason if is_wide(reason) else charset if is_wide(charset) else None)
    if wide:
        with open(plain, encoding=wide, newline="") as f, open(plain + ".utf8", "w", encoding="utf-8", newline="") as g:
            first = f.read(1)
            g.write("" if first == "﻿" else first)
            shutil.copyfileobj(f, g)
        plain += ".utf8"
    return publish(spark, plain, "data.txt")


def _written(spark: SparkSession, source, charset: str | None) -> tuple[str, str]:
    """A local copy of a literal, a stream or a URL, and the name to report."""
    local = os.path.join(tempfile.mkdtemp(prefix="rectio-"), "input")
    if isinstance(source, str):
        with urllib.request.urlopen(source) as r, open(local, "wb") as f:
            shutil.copyfileobj(r, f)
        return local, source
    data = source.data if isinstance(source, I) else source if isinstance(source, bytes) else source.read()
    data = "\n".join(data) + "\n" if isinstance(data, list) else data
    with open(local, "wb") as f:
        f.write(data.encode(charset or "utf-8") if isinstance(data, str) else data)
    return local, "literal"


def _resolved(spark: SparkSession, source, charset: str | None) -> list[Input]:
    if not isinstance(source, str) or source.split(":", 1)[0] in ("http", "https", "ftp", "ftps"):
        local, shown = _written(spark, source, charset)
        with open(local, "rb") as f:
            reason = _odd(shown if shown != "literal" else "", f.read(8), charset)
        path = _copied(spark, local, reason, charset) if reason else publish(spark, local, "data.txt")
        return [Input(path, shown, (path,))]
    local = _local(source)
    if local:
        with open(local, "rb") as f:
            reason = _odd(local, f.read(8), charset)
        path = _copied(spark, local, reason, charset) if reason else os.path.abspath(local)
        return [Input(path, source, (path,))]
    files = _files(spark, source)
    with ThreadPoolExecutor(16) as pool:
        reasons = list(pool.map(lambda f: _odd(f[0], first_bytes(spark, f[0], 8), charset), files))
    if not any(reasons):
        names = tuple(f for f, size in files if size) or tuple(f for f, _ in files)
        return [Input(source, source, names)] if files else []
    if len(files) > 1 and any(map(is_wide, reasons)):
        raise ValueError(f"'{source}': files in UTF-16 or UTF-32 must be read one by one")
    out = []
    for (file, _), reason in zip(files, reasons):
        path = file
        if reason:
            local = os.path.join(tempfile.mkdtemp(prefix="rectio-"), "input")
            there, fs = _fs(spark, file)
            fs.copyToLocalFile(False, there, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)
            path = _copied(spark, local, reason, charset)
        out.append(Input(path, file, (path,)))
    return out


def resolve(spark: SparkSession, sources, encoding: str = "UTF-8") -> tuple[list[Input], str | None]:
    """The inputs as Spark reads them, and the charset that their lines still are in (None: UTF-8)."""
    charset = charset_of(encoding)
    sources = sources if isinstance(sources, (list, tuple)) else [sources]
    if is_wide(charset) and len(sources) > 1:
        raise ValueError("files in UTF-16 or UTF-32 must be read one by one")
    found = [x for source in sources for x in _resolved(spark, source, charset)]
    return found, None if is_wide(charset) else charset
