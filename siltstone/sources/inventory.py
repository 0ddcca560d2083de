"""A batch data source that walks directory roots, and the mount table.

spark.dataSource.register(InventorySource)
spark.read.format("inventory").option("roots", "/a:/a/b").option("excludes", "/a/tmp").load()

One partition per first-level entry of a root. Links are skipped, special files too; errors are skipped and logged. A
root inside another root is walked once, as its own. The roots must be readable on all executors.
"""

from __future__ import annotations

import logging
import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root_id long, path_raw binary, path string, item_type string, size_bytes long, allocated_bytes long, mtime_ns long, ctime_ns long, device long, inode long, nlink long"
#: Left out if / is a root.
SYSTEM = ["/proc", "/sys", "/dev", "/run"]
log = logging.getLogger(__name__)


def shown(path: str) -> str:
    """Text of a path that any output can hold."""
    text = path.encode("utf-8", "backslashreplace").decode()
    names = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "".join(names.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c) for c in text)


def beneath(path: str, parent: str) -> bool:
    return path == parent or path.startswith(parent.rstrip("/") + "/")


def valid_roots(raw: list[str]) -> list[str]:
    out = [os.path.realpath(os.path.abspath(os.path.expanduser(r))) for r in raw]
    for r in out:
        if not os.path.isdir(r):
            raise ValueError(f"not a directory: {r}")
    return list(dict.fromkeys(out))


class _Subtree(InputPartition):
    def __init__(self, root_id: int, device: int, start: str, fence: list[str], recurse: bool):
        self.root_id, self.device, self.start, self.fence, self.recurse = root_id, device, start, fence, recurse


class _Reader(DataSourceReader):
    def __init__(self, options):
        split = lambda name: [x for x in options.get(name, "").split(":") if x]
        self.roots = valid_roots(split("roots"))
        self.excludes = split("excludes") + (SYSTEM if "/" in self.roots else [])
        self.one_file_system = options.get("oneFileSystem", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for i, root in enumerate(self.roots, 1):
            device = os.stat(root).st_dev
            fence = self.excludes + [r for r in self.roots if r != root and beneath(r, root)]
            out.append(_Subtree(i, device, root, fence, False))
            with os.scandir(root) as entries:
                out += [_Subtree(i, device, e.path, fence, True) for e in sorted(entries, key=lambda e: os.fsencode(e.path)) if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        todo = [partition.start]
        if partition.recurse:
            # the directory itself is an item of this partition
            found = self._item(partition, partition.start)
            if found is None or not found[0]:
                return
            yield found[1]
        while todo:
            try:
                with os.scandir(todo.pop()) as entries:
                    names = [e.path for e in entries]
            except OSError as e:
                log.warning("skipped: %s", e)
                continue
            for path in names:
                found = self._item(partition, path)
                if found is None:
                    continue
                descend, row = found
                if row[3] == "directory" and not partition.recurse:
                    continue  # a partition of its own
                yield row
                if descend:
                    todo.append(path)

    def _item(self, partition: _Subtree, path: str):
        """(whether to descend, row), or None for what is skipped."""
        if any(beneath(path, x) for x in partition.fence):
            return None
        try:
            info = os.lstat(path)
        except OSError as e:
            log.warning("skipped: %s", e)
            return None
        is_dir = stat.S_ISDIR(info.st_mode)
        if not is_dir and not stat.S_ISREG(info.st_mode):
            return None
        row = (partition.root_id, os.fsencode(path), shown(path), "directory" if is_dir else "file", info.st_size, info.st_blocks * 512, info.st_mtime_ns, info.st_ctime_ns, info.st_dev, info.st_ino, info.st_nlink)
        return is_dir and not (self.one_file_system and info.st_dev != partition.device), row


class InventorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def mounts(text: str) -> list[tuple[str, str, str, str]]:
    """(major:minor, mount point, type, source) of each line of a mountinfo table."""
    out = []
    for line in text.splitlines():
        fields = line.split()
        if len(fields) >= 10 and "-" in fields:
            tail = fields[fields.index("-") + 1 :]
            if len(tail) >= 2:
                out.append((fields[2], fields[4].replace("\\040", " "), tail[0], tail[1].replace("\\040", " ")))
    return out
