"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks by the tokenizer's own library, with offsets. Two neighbouring chunks
are spliced at a common boundary: a token that begins a word after ASCII white space, in the overlap, from which both
encodings agree in ids and offsets over the following tokens. When no such place is found, the overlap is widened, at
last to the whole rest of the document. The boundary is proven stable for tokenizers that drop white space, since
normalising, splitting and merging never look across it; what a chunk cut inside a word gets wrong lies before it.

For such tokenizers documents of up to HUGE characters are counted word by word: each distinct word goes to the library
once and its count to a bounded cache. Other tokenizers get whole documents, and are never cut.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and repeated doc_ids are counted each; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import text, vocab
from strandweave.session import ship

HUGE, CHUNK, OVERLAP, AGREE = 32_768, 16_384, 256, 8
SPACE = " \t\n\r\x0b\x0c"
WORDS = 400_000
_made: dict[str, Counter] = text.stores.setdefault("token_count", {})


def drops_space(source: bytes) -> bool:
    """Whether no token of this tokenizer holds white space and splitting removes it."""
    spec = json.loads(source)
    split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
    return bool(split) and split[0]["behavior"] == "Removed" and split[0]["invert"] and r"[^\s\p{L}\p{N}]+" in split[0]["pattern"].get("Regex", "")


class Counter:
    """Counts the tokens of texts for one tokenizer file."""

    def __init__(self, source: bytes, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.huge, self.chunk, self.overlap, self.widened = huge, chunk, overlap, 0
        if source[:1] == b"{":
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(source.decode())
            self.library.no_truncation()
            self.library.no_padding()
            self.apart = drops_space(source)
        else:
            import sentencepiece

            self.library, self.apart = sentencepiece.SentencePieceProcessor(model_proto=source), False
        self.words = vocab.Memo(WORDS)

    def whole(self, texts: list[str]) -> list[int]:
        """Counts by one call of the library for each text."""
        if not hasattr(self.library, "encode_batch_fast"):
            return [len(x) for x in self.library.encode(texts, num_threads=1)] if texts else []
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def by_words(self, texts: list[bytes]) -> list[int]:
        """Counts of texts as the sums of their words' counts; words that are not known yet go to the library together."""
        words, out = self.words, []
        for data in texts:
            split = data.split()
            found = list(map(words.young.get, split))
            if None in found:
                missing = {}
                for i, n in enumerate(found):
                    if n is None:
                        found[i] = words.get(split[i])
                        if found[i] is None:
                            missing.setdefault(split[i], []).append(i)
                if missing:
                    for (w, places), n in zip(missing.items(), self.whole([w.decode() for w in missing]), strict=True):
                        words.put(w, n)
                        for i in places:
                            found[i] = n
            out.append(sum(found))
        return out

    def _encode(self, text_: str, begin: int, end: int) -> list[tuple[int, int, int]]:
        e = self.library.encode(text_[begin:end], add_special_tokens=False)
        return [(i, a + begin, b + begin) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def by_chunks(self, text_: str) -> int:
        """The count of a huge text, from overlapping chunks."""
        size = len(text_)
        begin, end = 0, min(self.chunk, size)
        left = self._encode(text_, begin, end)
        total = since = 0  # tokens counted; the first token of `left` that is not
        while end < size:
            overlap = self.overlap
            while True:
                start = max(begin, end - overlap)
                if overlap > self.overlap and not any(c in SPACE for c in text_[start:end]):
                    overlap = max(overlap, end - begin)  # no boundary can be there: grow the chunk at once
                    start = begin
                stop = min(size, start + max(self.chunk, 2 * overlap))
                if start > begin or any(c in SPACE for c in text_[start:end]):
                    right = self._encode(text_, start, stop)
                    place = self._common(text_, left, right, start, end, since)
                    if place is not None:
                        break
                # Nothing in the overlap agrees. It is widened to the left; once it covers all of the chunk, the chunk itself grows.
                self.widened += 1
                if start == begin:
                    end = min(size, begin + 2 * (end - begin))  # doubled, so that all encodings together stay linear
                    grown = self._encode(text_, begin, end)
                    left, since = grown, self._after(left, since, grown)
                    if end == size:
                        return total + len(left) - since
                overlap *= 2
            total += place[0] - since
            begin, end, left, since = start, stop, right, place[1]
        return total + len(left) - since

    @staticmethod
    def _after(old: list, since: int, grown: list) -> int:
        """`since` in the encoding of the grown chunk: tokens before a spliced boundary do not change."""
        if since == 0:
            return 0
        at = old[since][1]
        return next(i for i, t in enumerate(grown) if t[1] == at)

    def _common(self, text_: str, left: list, right: list, start: int, end: int, since: int) -> tuple[int, int] | None:
        """Indexes in left and right of the first token of a stable common boundary."""
        place = {t[1]: j for j, t in reversed(list(enumerate(right))) if t[1] < end}
        first = next((i for i in range(len(left)) if left[i][1] > start), len(left))
        for i in range(max(first, since), len(left)):
            at = left[i][1]
            if at == 0 or text_[at - 1] not in SPACE or at not in place:
                continue
            j = place[at]
            # A token that ends at the chunk's border may be cut there, so agreement must end at white space before it.
            tail = [t for t in left[i : i + AGREE] if t[2] < end]
            if tail and tail == right[j : j + len(tail)] and (len(tail) == AGREE or text_[tail[-1][2]] in SPACE):
                return i, j
        return None

    def counts(self, column: pa.Array) -> tuple[list[int], list[int]]:
        """(bytes, tokens) of each text."""
        raw = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
        sizes = [len(x) for x in raw]
        if not self.apart:
            return sizes, self.whole([x.decode() for x in raw])
        out = [0] * len(raw)
        short = [i for i, n in enumerate(sizes) if n <= self.huge]
        for i, n in zip(short, self.by_words([raw[i] for i in short]), strict=True):
            out[i] = n
        for i, n in enumerate(sizes):
            if n > self.huge:
                out[i] = self.by_chunks(raw[i].decode())
        return sizes, out


def counter(source: bytes) -> Counter:
    key = hashlib.sha256(source).hexdigest()
    if key not in _made:
        _made[key] = Counter(source)
    return _made[key]


def _mapper(source, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(source.value)
        for batch in batches:
            for part in text.pieces(batch, "text", 4 << 20):
                sizes, n = c.counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; over_limit: more than `limit` tokens."""
    spark = ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(text.tidied(_mapper(vocab.shipped(spark, path), limit), "token_count"), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
