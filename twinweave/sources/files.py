"""Directories of source files as a table."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from twinweave.session import parallelism


def ignore_regex(pattern: str, below: str = "") -> str:
    """A regular expression, for paths from the root, of a line of an ignore file that lies in the directory ``below``."""
    anchored = "/" in pattern.rstrip("/")
    body, i = "", 0
    text = pattern.strip("/")
    while i < len(text):
        if text.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif text.startswith("**", i):
            body, i = body + ".*", i + 2
        elif text[i] == "*":
            whole = text[i - 1 : i] in ("", "/") and text[i + 1 : i + 2] in ("", "/")  # a whole name isn't empty
            body, i = body + ("[^/]+" if whole else "[^/]*"), i + 1
        elif text[i] == "?":
            body, i = body + "[^/]", i + 1
        elif text[i] == "[" and (end := text.find("]", i + 1)) > 0:
            body, i = body + "[" + text[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            body, i = body + re.escape(text[i + 1] if text[i] == "\\" and i + 1 < len(text) else text[i]), i + 1 + (text[i] == "\\")
    start = "^" + (re.escape(below) + "/" if below else "") + ("" if anchored else "(?:.*/)?")
    return start + body + ("/" if pattern.endswith("/") else "(?:/|$)")


#: Bytes of a file that is read, at most; larger ones have no content.
LARGEST = 1 << 30


def _rules(text: str, below: str) -> list[tuple[re.Pattern[str], bool]]:
    """(expression, whether it ignores) of the lines of an ignore file in the directory ``below``."""
    lines = [x.rstrip() for x in text.split("\n")]
    return [(re.compile(ignore_regex(x.lstrip("!"), below)), not x.startswith("!")) for x in lines if x and not x.startswith("#")]


def _listing(system: fs.FileSystem, root: str) -> Iterator[tuple[str, str]]:
    """(relative path, full path) of the files below root, without what is hidden, linked or ignored; of the ignore rules that hit a path the last, innermost one decides."""
    todo: list[tuple[str, str, list]] = [(root, "", [])]
    local = isinstance(system, fs.LocalFileSystem)
    while todo:
        at, below, rules = todo.pop()
        infos = sorted(system.get_file_info(fs.FileSelector(at)), key=lambda x: x.base_name)
        for name in (".gitignore", ".ignore"):
            if any(x.base_name == name and x.is_file for x in infos):
                with system.open_input_stream(f"{at}/{name}") as f:
                    rules = rules + _rules(f.read().decode("utf-8", "replace"), below)
        for x in infos:
            path = f"{below}/{x.base_name}" if below else x.base_name
            folder = x.type == fs.FileType.Directory
            if x.base_name.startswith(".") or local and os.path.islink(x.path):
                continue
            # a directory that is left out isn't entered
            hits = [ignores for e, ignores in rules if e.search(path + "/" if folder else path)]
            if hits and hits[-1]:
                continue
            if folder:
                todo.append((x.path, path, rules))
            elif x.is_file:
                yield path, x.path


def _reader(directory: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), os.path.abspath(directory))


def _read(batches: Iterator[pa.RecordBatch], directory: str) -> Iterator[pa.RecordBatch]:
    system, _ = _reader(directory)
    for batch in batches:
        for ids, paths, places in ([c.to_pylist() for c in batch.slice(i, 64).columns] for i in range(0, batch.num_rows, 64)):
            kept, texts = [], []
            for row, place in zip(zip(ids, paths), places):
                info = system.get_file_info(place)
                if not info.is_file:
                    continue  # gone since it was listed
                text = None
                if info.size <= LARGEST:
                    with system.open_input_stream(place) as f:
                        try:
                            text = f.read().decode("utf-8")
                        except UnicodeDecodeError:
                            pass
                kept.append(row)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.string()), pa.array(texts, pa.string())], ["file_idx", "path", "content"])


def read_directory(spark: SparkSession, directory: str) -> DataFrame:
    """(file_idx, path, content) of the files under a directory, without those hidden, in hidden directories, linked or named by ignore files.

    The directory is a local path or a URI of a file system that Arrow knows. The listing
    is made first, on the driver, and only files it keeps are read, by the tasks, where they lie. file_idx is the
    place of the path among all. content is null where the bytes aren't UTF-8 or are more than LARGEST; paths are relative to
    the directory. A missing directory gives an empty table; what can't be listed or read is an error.
    """
    schema = "file_idx bigint, path string, content string"
    system, root = _reader(directory)
    if system.get_file_info(root).type != fs.FileType.Directory:
        return spark.createDataFrame([], schema)
    listed = sorted(_listing(system, root))
    if not listed:
        return spark.createDataFrame([], schema)
    t = pa.table({"file_idx": pa.array(range(len(listed)), pa.int64()), "path": [x[0] for x in listed], "place": [x[1] for x in listed]})
    tasks = min(len(listed), 4 * parallelism(spark))
    return spark.createDataFrame(t).repartition(tasks, "file_idx").mapInArrow(lambda it: _read(it, directory), schema)
