"""Files opened inside tasks: local ones and objects of stores, with ranges read as they are asked for.

The settings of the stores are the session's, under the names that Hadoop's connectors know. What only Hadoop itself can open isn't opened here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import SparkSession

#: Names of Hadoop settings.
_SETTINGS = (
    "fs.s3a.access.key", "fs.s3a.secret.key", "fs.s3a.session.token", "fs.s3a.endpoint", "fs.s3a.endpoint.region", "fs.s3a.connection.ssl.enabled",
    "fs.s3a.path.style.access", "fs.s3a.aws.credentials.provider", "fs.gs.storage.root.url", "fs.gs.auth.type", "fs.gs.project.id",
)
_S3, _GCS = ("s3", "s3a", "s3n"), ("gs",)

Options = tuple[tuple[str, str], ...]
#: Opens a path for reading at any place; the second argument has the session's settings of stores.
Opener = Callable[[str, Options], pa.NativeFile]


def options(spark: SparkSession) -> Options:
    """The settings of stores that the session has. They go to tasks with the function that opens files."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return tuple((k, v) for k in _SETTINGS if (v := conf.get(k)))


def in_tasks(path: str) -> bool:
    """Whether tasks can open the path by themselves."""
    return (urlsplit(path).scheme or "file") in ("file", *_S3, *_GCS)


@lru_cache(maxsize=8)
def _store(kind: str, given: Options) -> pa.fs.FileSystem:
    import pyarrow.fs as fs

    have = dict(given)
    if kind == "gs":
        root = urlsplit(have.get("fs.gs.storage.root.url", ""))
        other = {"endpoint_override": root.netloc, "scheme": root.scheme} if root.netloc else {}
        return fs.GcsFileSystem(anonymous=have.get("fs.gs.auth.type") == "UNAUTHENTICATED", project_id=have.get("fs.gs.project.id"), **other)
    anonymous = "Anonymous" in have.get("fs.s3a.aws.credentials.provider", "")
    endpoint = have.get("fs.s3a.endpoint", "")
    scheme = urlsplit(endpoint).scheme or ("http" if have.get("fs.s3a.connection.ssl.enabled") == "false" else "https")
    keys = {} if anonymous else {"access_key": have.get("fs.s3a.access.key"), "secret_key": have.get("fs.s3a.secret.key"), "session_token": have.get("fs.s3a.session.token")}
    return fs.S3FileSystem(
        anonymous=anonymous, endpoint_override=(urlsplit(endpoint).netloc or endpoint) or None, scheme=scheme, region=have.get("fs.s3a.endpoint.region"),
        force_virtual_addressing=False, **{k: v for k, v in keys.items() if v},
    )


def opened(path: str, given: Options = ()) -> pa.NativeFile:
    """A file of the local file system or an object, at whose places one can read."""
    parts = urlsplit(path)
    if parts.scheme in _S3 or parts.scheme in _GCS:
        return _store("gs" if parts.scheme in _GCS else "s3", given).open_input_file(path.partition("://")[2])
    if parts.scheme not in ("", "file"):
        raise OSError(f"tasks can't open {parts.scheme}: paths")
    return pa.OSFile(path.removeprefix("file://").removeprefix("file:"))


def last_bytes(file: pa.NativeFile, size: int) -> Callable[[int], bytes]:
    """A function that reads the last n bytes."""

    def read(n: int) -> bytes:
        file.seek(size - n)
        return file.read(n)

    return read
