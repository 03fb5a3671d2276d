"""Changes of a tree as the system tells them, where it does (inotify of Linux); others poll."""

from __future__ import annotations

import ctypes
import os
import select
import struct
from collections.abc import Callable

CREATE, CLOSED, MOVED_FROM, MOVED_TO, DELETE = 0x100, 0x8, 0x40, 0x80, 0x200
NONBLOCK, IS_DIR = 0o4000, 0x40000000
HEAD = struct.calcsize("iIII")


class Events:
    """A watch of each folder of a tree, new ones included; skipped folders have none."""

    def __init__(self, root: str, counts: Callable[[str], bool], skip: tuple[str, ...] = ()) -> None:
        self.libc = ctypes.CDLL(None, use_errno=True)
        self.fd = self.libc.inotify_init1(NONBLOCK)
        if self.fd < 0:
            raise OSError(ctypes.get_errno(), "inotify isn't there")
        self.counts, self.skip, self.folders = counts, skip, {}
        self._add(root)

    def _add(self, root: str) -> list[str]:
        """Watch a folder and those below; files that are there already."""
        found = []
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d not in self.skip]
            at = self.libc.inotify_add_watch(self.fd, os.fsencode(folder), CREATE | CLOSED | MOVED_FROM | MOVED_TO | DELETE)
            if at >= 0:
                self.folders[at] = folder
            found += [os.path.join(folder, n) for n in names]
        return found

    def changed(self, wait: float) -> set[str]:
        """Paths that count and changed, after ``wait`` seconds at most."""
        if not select.select([self.fd], [], [], wait)[0]:
            return set()
        raw, out, at = os.read(self.fd, 1 << 16), set(), 0
        while at < len(raw):
            watch, mask, _, size = struct.unpack_from("iIII", raw, at)
            name = os.fsdecode(raw[at + HEAD : at + HEAD + size].rstrip(b"\0"))
            at += HEAD + size
            path = os.path.join(self.folders.get(watch, ""), name)
            if mask & IS_DIR:
                if mask & (CREATE | MOVED_TO) and name not in self.skip:
                    out.update(p for p in self._add(path) if self.counts(p))
            elif self.counts(path):
                out.add(path)
        return out

    def close(self) -> None:
        os.close(self.fd)
