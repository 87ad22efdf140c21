"""AVI files of images (Motion JPEG and the like): each frame is an image of its own, found by the file's index.

The layout is RIFF: chunks of a four-letter name, a length and data, of which LIST chunks hold others. ``avih`` and ``strh`` have
size and rate, ``movi`` the frames, ``idx1`` their places.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO


def _chunks(file: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end of data) of the chunks in a stretch of the file; a LIST is named by what it lists."""
    while at + 8 <= end:
        file.seek(at)
        head = file.read(12)
        if len(head) < 8:
            return
        name, size = struct.unpack("<4sI", head[:8])
        stop = min(at + 8 + size, end)
        yield (head[8:12], at + 12, stop) if name in (b"LIST", b"RIFF") else (name, at + 8, stop)
        at += 8 + size + size % 2


class Avi:
    """An open file: ``fps`` (0: unknown), ``width``, ``height``, ``len``, and ``frames`` of a range by seeking."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        size = file.seek(0, 2)
        riff = next(_chunks(file, 0, size), None)
        if riff is None or riff[0] != b"AVI ":
            raise ValueError("not an AVI file")
        self.fps, self.width, self.height, movi, index = 0.0, 0, 0, None, None
        for name, begin, end in _chunks(file, *riff[1:]):
            if name == b"hdrl":
                self._header(begin, end)
            elif name == b"movi":
                movi = begin, end
            elif name == b"idx1":
                index = begin, end
        if movi is None:
            raise ValueError("an AVI file without frames")
        self.places = self._indexed(*index, movi[0] - 4) if index else [(b, e - b) for name, b, e in _chunks(file, *movi) if self._is_frame(name)]

    @staticmethod
    def _is_frame(name: bytes) -> bool:
        return name[2:] in (b"dc", b"db")

    def _header(self, begin: int, end: int) -> None:
        for name, at, stop in _chunks(self.file, begin, end):
            self.file.seek(at)
            if name == b"avih":
                micro, *_, self.width, self.height = struct.unpack("<10I", self.file.read(40))
                self.fps = self.fps or (1e6 / micro if micro else 0.0)
            elif name == b"strl":
                for inner, a, _ in _chunks(self.file, at, stop):
                    self.file.seek(a)
                    if inner == b"strh" and (head := self.file.read(28))[:4] == b"vids":
                        scale, rate = struct.unpack("<2I", head[20:28])
                        self.fps = rate / scale if scale and rate else self.fps

    def _indexed(self, begin: int, end: int, base: int) -> list[tuple[int, int]]:
        self.file.seek(begin)
        entries = [e for e in struct.iter_unpack("<4s3I", self.file.read((end - begin) // 16 * 16)) if self._is_frame(e[0])]
        if entries:  # places count from the list's name or, in some files, from the file's begin
            self.file.seek(base + entries[0][2])
            base = base if self.file.read(4) == entries[0][0] else 0
        return [(base + place + 8, size) for _, _, place, size in entries]

    def __len__(self) -> int:
        return len(self.places)

    def frames(self, first: int, end: int) -> Iterator[bytes]:
        for at, size in self.places[first:end]:
            self.file.seek(at)
            image = self.file.read(size)
            if len(image) != size:
                raise ValueError("a frame is cut off")
            yield image


def written(images: list[bytes], fps: int, width: int, height: int, indexed: bool = True) -> bytes:
    """An AVI file of these images."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)

    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10 * indexed, len(images), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<12I", 0, 0, 0, 1, fps, 0, len(images), 0, 0, 0, 0, 0)
    strf = struct.pack("<3I2H6I", 40, width, height, 1, 24, int.from_bytes(b"MJPG", "little"), width * height * 3, 0, 0, 0, 0)
    frames = [chunk(b"00dc", x) for x in images]
    entries, at = [], 4
    for image, held in zip(images, frames, strict=True):
        entries.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(image)))
        at += len(held)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(frames)) + (chunk(b"idx1", b"".join(entries)) if indexed else b""))
