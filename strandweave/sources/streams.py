"""Byte streams of source files inside executor tasks: any store that pyarrow opens, gzip members inflated on the way.

A task holds one block of compressed and one of inflated bytes, whatever the size of the file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs

BLOCK = 1 << 20
GZIP = b"\x1f\x8b"
#: Fixed value: the empty block that ends a complete BGZF file (SAM specification, 4.1.2).
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class Cut(ValueError):
    """The compressed data end inside a member."""


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a path or URI, as Spark's readers name files (file:/a, file:///a, s3://b/a, /a)."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def blocks(path: str) -> Iterator[bytes]:
    """The bytes of a file as they are."""
    fs, at = located(path)
    with fs.open_input_stream(at, compression=None) as stream:
        while block := stream.read(BLOCK):
            yield block


def tail(path: str, n: int) -> bytes:
    """The last n bytes of a file."""
    fs, at = located(path)
    with fs.open_input_file(at) as file:
        size = file.size()
        return file.read_at(min(n, size), max(size - n, 0))


def inflated(source: Iterator[bytes], exact: bool = False) -> Iterator[bytes]:
    """Inflated bytes of gzip or BGZF data, other data unchanged.

    Data that end inside a member raise Cut after all bytes that could be inflated. What follows the last member is
    left out, as gzip does; with `exact` it is an error.
    """
    held = b""
    for block in source:
        held += block
        if len(held) >= 2:
            break
    if not held.startswith(GZIP):
        if held:
            yield held
        yield from source
        return
    member = zlib.decompressobj(wbits=31)
    while True:
        try:
            # Output is given in blocks; an empty input brings out what a member still holds.
            while not member.eof and (out := member.decompress(held, BLOCK)):
                yield out
                held = member.unconsumed_tail
        except zlib.error as e:
            raise ValueError(f"damaged gzip data: {e}") from None
        if not member.eof:
            held = next(source, b"")
            if not held:
                raise Cut("the gzip data end inside a member")
            continue
        held = member.unused_data
        while len(held) < 2 and (more := next(source, None)) is not None:
            held += more
        if not held.startswith(GZIP):
            if held and exact:
                raise ValueError("data after the last gzip member")
            return
        member = zlib.decompressobj(wbits=31)


class Bytes:
    """Reads of exact sizes from blocks of any sizes."""

    def __init__(self, source: Iterator[bytes]):
        self._source, self._held, self._at = source, b"", 0

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer at the end; they are read again."""
        if len(self._held) - self._at < n:
            parts, size = [self._held[self._at :]], len(self._held) - self._at
            while size < n and (block := next(self._source, None)) is not None:
                parts.append(block)
                size += len(block)
            self._held, self._at = b"".join(parts), 0
        return self._held[self._at : self._at + n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self._at += len(out)
        return out

    def rest(self) -> Iterator[bytes]:
        """All bytes that are left, in blocks."""
        if self._at < len(self._held):
            yield self._held[self._at :]
        yield from self._source


def lines(source: Iterator[bytes]) -> Iterator[bytes]:
    """Lines without their ends (\\n or \\r\\n); a line of any length is joined once."""
    parts: list[bytes] = []
    for block in source:
        first, *others = block.split(b"\n")
        parts.append(first)
        for line in others:
            yield b"".join(parts).removesuffix(b"\r")
            parts = [line]
    if any(parts):
        yield b"".join(parts).removesuffix(b"\r")
