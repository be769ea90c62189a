"""Source trees, commit logs and change sets as tables."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S

#: Raised whenever extraction changes, so that kept records are made anew.
PARSER_VERSION = 1
COMMIT = "commit string, author string, timestamp long, file string, additions long, deletions long, binary boolean"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(uri, path) of all files below a root, names that begin with ``.`` or ``_`` too.

    Spark's own file sources pass over such names, ``__init__.py`` among them.
    Excluded directories and symbolic links are not entered.  The driver holds the
    names of one repository.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, rows = [(top, "")], []
    while todo:
        folder, prefix = todo.pop()
        for f in files.listStatus(folder):
            name = f.getPath().getName()
            path = f.getPath().toUri()
            if f.isSymlink() or path.getScheme() == "file" and os.path.islink(path.getPath()):
                continue
            if f.isDirectory():
                if name not in S.EXCLUDED_DIRS:
                    todo.append((f.getPath(), f"{prefix}{name}/"))
            else:
                rows.append((f.getPath().toString(), prefix + name))
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "uri string, path string")
    return df.repartition(max(1, min(len(rows) // 64, 1024)), "path")


def scan(spark: SparkSession, root: str, supported_only: bool = False) -> DataFrame:
    """(path, size, hash, language, parser_version, content) of all files below a root.

    Paths are relative with ``/``.  Files of no known language keep a null
    language.  Text that is not UTF-8 is an error where it is parsed.
    """

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for uri, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, at = fs.FileSystem.from_uri(uri)
                with files.open_input_file(at) as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], ["path", "content"])

    raw = listed(spark, root).mapInArrow(read, "path string, content binary")
    out = raw.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"), S.language_of(F.col("path"), F.col("content")).alias("language"), F.lit(PARSER_VERSION).alias("parser_version"), "content")
    return out.where("language IS NOT NULL") if supported_only else out


def source_text(files: DataFrame) -> DataFrame:
    """(path, language, text) of files of a known language; invalid UTF-8 fails."""
    return files.where("language IS NOT NULL").select("path", "language", F.validate_utf8(F.col("content").cast("string")).alias("text"))


def log_records(text: str) -> list[tuple]:
    """Rows of ``git log -z --numstat --format=%x01%H|%at|%an``; a renamed file counts under its new path, binary ``-`` as no lines."""
    rows = []
    for block in text.split("\x01")[1:]:
        head, _, rest = block.partition("\0") if "\0" in block.split("\n")[0] else block.partition("\n")
        commit, stamp, author = head.strip().split("|", 2)
        fields = [x.lstrip("\n") for x in rest.split("\0")]
        i = 0
        while i < len(fields):
            parts = fields[i].split("\t", 2)
            i += 1
            if len(parts) < 3:
                continue
            added, gone, path = parts
            if not path:  # renamed: old and new path follow
                path = fields[i + 1]
                i += 2
            binary = added == "-"
            rows.append((commit, author, int(stamp), path, 0 if binary else int(added), 0 if gone == "-" else int(gone), binary))
    return rows


def git_log(spark: SparkSession, root: str, most: int = 100) -> DataFrame:
    """One row per file of the last ``most`` commits; that bounds what the driver reads."""
    got = subprocess.run(["git", "-C", root, "log", f"-n{most}", "--numstat", "-z", "--format=%x01%H|%at|%an"], capture_output=True, text=True, check=True)
    return spark.createDataFrame(log_records(got.stdout), COMMIT)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (path, change) that were added, modified or deleted between two scans."""
    from ..operators.compare import file_changes

    return file_changes(old, new).where("change <> 'Unchanged'")


def synthetic(spark: SparkSession, files: int) -> DataFrame:
    """(path, language, text) of a made repository: four languages in turn, every file calls the helper of the next."""
    i, j = F.col("id").cast("string"), ((F.col("id") + 1) % files).cast("string")

    def form(template: str) -> Column:
        out = F.lit(template)
        for mark, value in (("@I", i), ("@J", j)):
            out = F.replace(out, F.lit(mark), value)
        return out

    kinds = [
        ("rust", "src/file_@I.rs", "use crate::file_@J::helper_@J;\npub struct Type@I;\npub fn helper_@I() {}\npub fn function_@I() { helper_@J(); }\n"),
        ("python", "src/file_@I.py", "from file_@J import helper_@J\nclass Type@I:\n    pass\ndef helper_@I():\n    pass\ndef function_@I():\n    helper_@J()\n"),
        ("typescript", "src/file_@I.ts", 'import { helper_@J } from "./file_@J";\nexport class Type@I {}\nexport function helper_@I() {}\nexport function function_@I() { helper_@J(); }\n'),
        ("go", "src/file_@I.go", 'package main\nimport "file_@J"\ntype Type@I struct {}\nfunc helper_@I() {}\nfunc function_@I() { helper_@J() }\n'),
    ]
    turn = F.col("id") % 4
    pick = lambda k: F.element_at(F.array(*(form(x[k]) for x in kinds)), (turn + 1).cast("int"))
    return spark.range(files).select(pick(1).alias("path"), pick(0).alias("language"), pick(2).alias("text"))
