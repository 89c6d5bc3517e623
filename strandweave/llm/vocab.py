"""Access to the public tokenizer files; they are read on the driver and sent to the workers once."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import SparkSession

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
#: A larger file is refused rather than broadcast.
MOST_BYTES = 64 << 20


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The file's bytes, for workers that may not see the driver's disk."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


class Memo:
    """A cache of at most 2 * size entries: when the young half is full, it becomes the old half."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def stretches(data: bytes, limit: int = 1 << 20):
    """The bytes of a text in stretches of about `limit`, cut at ASCII white space only."""
    at = 0
    while len(data) - at > limit:
        end = at + limit
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data
