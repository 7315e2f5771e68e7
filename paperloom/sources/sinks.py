"""Where documents and reports go."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import tempfile
import time
import uuid
import zipfile

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from paperloom.functions.text import safe_filename
from paperloom.operators.documents import _mapped

DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Where that is
    unset, a local master gets a temporary folder; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    return f"{folder.rstrip('/')}/paperloom/{name}-{uuid.uuid4().hex}"


def data_url(docx: Column) -> Column:
    """A download link that holds the package."""
    return F.concat(F.lit(f"data:{DOCX_TYPE};base64,"), F.replace(F.base64(docx), F.lit("\r\n"), F.lit("")))


def file_name(title: Column) -> Column:
    return F.concat(safe_filename(title), F.lit(".docx"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object a line."""
    reports.drop("docx").write.mode("overwrite").json(path)


def write_texts(reports: DataFrame, path: str) -> None:
    """The extracted text of each document."""
    reports.select(F.coalesce("semantics.text", F.lit("")).alias("value")).write.mode("overwrite").text(path)


def write_checked(reports: DataFrame, path: str) -> None:
    """Valid packages under <path>/valid, the reports of all others under <path>/quarantine,
    without their packages. Reads the input twice: write or cache it first if it is costly."""
    from paperloom.operators.documents import split_valid

    good, bad = split_valid(reports)
    good.write.mode("overwrite").parquet(f"{path}/valid")
    bad.drop("docx").write.mode("overwrite").parquet(f"{path}/quarantine")


def archive(files: dict[str, bytes]) -> bytes:
    """A deflated ZIP with sorted names and a fixed date: the same files give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.create_system, info.external_attr, info.compress_type = 3, 0o100644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, files[name])
    return out.getvalue()


def release(bundles: DataFrame, files: str = "files") -> DataFrame:
    """bundles (files: map of name to bytes) with `zip` and `sha256sums` (lines of hash and name)."""

    def work(entries):
        found = dict(entries or [])
        return archive(found), "".join(f"{hashlib.sha256(found[n]).hexdigest()}  {n}\n" for n in sorted(found))

    return _mapped(bundles, [F.col(files)], "zip binary, sha256sums string", work)


class _Written(WriterCommitMessage):
    """What a task has staged: its folder, and the names in it in their order."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class _Staged:
    """The two phases of a write. Tasks write into a folder of their own attempt under a
    staging folder; commit moves what the attempts that count have written and abort moves
    nothing; both remove the staging folder with all that other attempts left in it. Files
    are reached by their URI, in any store that pyarrow knows."""

    def __init__(self, path: str, staging: str):
        self.path, self.staging = path, staging

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, rows):
        store, base = self._store()
        task = TaskContext.get()
        folder = f"{base}/{self.staging}/{task.partitionId() if task else 0}-{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=self.alone)  # else a task that outlives its job fails here
        names = {}
        for row in rows:
            name = posixpath.basename(row["name"].replace("\\", "/"))
            if not name.strip(". ") or row["docx"] is None:
                raise ValueError(f"no file can be made of the name {row['name']!r} and {'no' if row['docx'] is None else 'some'} content")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(row["docx"]))
            names[name] = None
        return _Written(folder, list(names))

    def _finish(self, messages):
        from pyarrow import fs

        store, base = self._store()
        for message in messages:
            for name in message.names if message else ():
                target = f"{base}/{name}"
                if store.get_file_info(target).type == fs.FileType.File:
                    store.delete_file(target)
                store.move(f"{message.folder}/{name}", target)
        self._clear()

    def _clear(self):
        from pyarrow import fs

        store, base = self._store()
        for tried in range(5):  # a task may still be writing when its job is given up
            if store.get_file_info(f"{base}/{self.staging}").type != fs.FileType.Directory:
                return
            try:
                store.delete_dir(f"{base}/{self.staging}")
            except OSError:
                if tried == 4:
                    raise
                time.sleep(0.2)


class _FileWriter(_Staged, DataSourceWriter):
    alone = False

    def __init__(self, path: str):
        super().__init__(path, f"_staging-{uuid.uuid4().hex}")
        store, base = self._store()
        store.create_dir(f"{base}/{self.staging}", recursive=True)

    def commit(self, messages):
        self._finish(messages)

    def abort(self, messages):
        self._clear()


class _StreamWriter(_Staged, DataSourceStreamWriter):
    """Made anew for each phase, so its staging folder has a fixed name: one query at a time
    writes to a folder. What a given-up batch leaves there goes with the next commit; a batch
    that is repeated writes the same names again."""

    alone = True

    def __init__(self, path: str):
        super().__init__(path, "_staging-stream")

    def commit(self, messages, batchId):
        self._finish(messages)

    def abort(self, messages, batchId):
        self._clear()


class DocxFiles(DataSource):
    """df.write.format("paperloom_docx").save(uri), and writeStream the same: a file for each
    row (name, docx) in a folder that all executors reach. Of rows with one name the last
    task's counts. A job that fails, and a task that fails or is repeated, leave no file."""

    @classmethod
    def name(cls):
        return "paperloom_docx"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"])

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxFiles)
